"""The same queries as plain SQL for DuckDB, used only to check results."""

from __future__ import annotations

VIEWS = {
    "daily_by_brand": """
  select series_key, date, demand, production_plan,
    case when day(date) % 5 = 0 then null else demand + day(date) % 7 - 3 end as forecast,
    cast(sum(production_plan - demand) over (partition by series_key order by date) as bigint) as inventory
  from (
    select series_key, date, coalesce(demand, 0) as demand, coalesce(production_plan, 0) as production_plan
    from (select p_brand as series_key, cast(l_shipdate as date) as date, cast(sum(l_quantity) as bigint) as demand
          from lineitem join part on l_partkey = p_partkey group by 1, 2)
    full join (select p_brand as series_key, cast(o_orderdate as date) as date,
                 cast(sum(l_quantity) as bigint) as production_plan
               from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
               group by 1, 2)
    using (series_key, date))""",
    "daily_all": """
  select date, demand, production_plan,
    case when day(date) % 5 = 0 then null else demand + day(date) % 7 - 3 end as forecast,
    cast(sum(production_plan - demand) over (order by date) as bigint) as inventory
  from (
    select date, coalesce(demand, 0) as demand, coalesce(production_plan, 0) as production_plan
    from (select cast(l_shipdate as date) as date, cast(sum(l_quantity) as bigint) as demand
          from lineitem group by 1)
    full join (select cast(o_orderdate as date) as date, cast(sum(l_quantity) as bigint) as production_plan
               from lineitem join orders on l_orderkey = o_orderkey group by 1)
    using (date))""",
    "stale": """
  select series_key, date, demand, production_plan, forecast,
    cast(inventory + day(date) % 3 + 1 as bigint) as inventory
  from daily_by_brand""",
    "stale_all": """
  select date, demand, production_plan, forecast, cast(inventory + day(date) % 3 + 1 as bigint) as inventory
  from daily_all""",
    "edits": """
  select series_key, date, 'production_plan' as field, demand + 10 as value, cast(1 as bigint) as seq
  from daily_by_brand where day(date) = 15
  union all
  select series_key, date, 'demand', demand + 25, cast(2 as bigint) from daily_by_brand where day(date) = 20
  union all
  select series_key, date, 'production_plan', demand + 30, cast(3 as bigint)
  from daily_by_brand where day(date) = 15 and month(date) = 6
  union all
  select 'NO_SUCH_KEY', date '1990-01-01', 'demand', cast(1 as bigint), cast(4 as bigint)""",
    "changes": """
  select series_key, cast(date + 400 as date) as date, demand + 1 as demand,
    production_plan + 2 as production_plan, forecast
  from daily_by_brand where date >= date '2000-06-01'""",
    "history": """
  select cast(row_number() over (order by conv_id, turn) as bigint) as id,
    concat('c', cast(conv_id as varchar)) as session_id,
    case when conv_id % 10 = 9 then null else cast(conv_id % 20 as varchar) end as user_id,
    role, text as content,
    timestamp '2024-01-01 00:00:00' + to_minutes(cast((conv_id * 7919) % 43200 + turn as int)) as timestamp
  from conversations""",
    "users_int": """
  select c_custkey as id, c_name as username,
    case c_custkey % 3 when 0 then null when 1 then '' else concat('D', cast(c_custkey as varchar)) end
      as display_name
  from customer""",
    "agent_events": """
  select concat('u', cast(user_id as varchar)) as session_id, event_id as seq, ts,
    case event_type when 'view' then 'raw_response' when 'click' then 'tool_called'
      when 'purchase' then 'tool_output' when 'signup' then 'agent_updated' else 'other' end as kind,
    event_type as name,
    case when event_type = 'view' and event_id % 2 = 0 then null else props end as text,
    props as output
  from events""",
    "numbered": """
  select series_key, date, demand,
    row_number() over (partition by series_key order by date) as i,
    row_number() over (partition by series_key order by date desc) as back
  from daily_by_brand""",
    "periods": "select unnest(range(1, 8)) as period",
    "uneven": """
  select series_key, date, case when not (series_key like '%2' and day(date) = 13) then demand end as demand,
    production_plan, forecast, inventory
  from daily_by_brand where not (series_key like '%1' and date >= date '1995-01-10')""",
}

NEEDS = {
    "stale": ["daily_by_brand"],
    "stale_all": ["daily_all"],
    "edits": ["daily_by_brand"],
    "changes": ["daily_by_brand"],
    "numbered": ["daily_by_brand"],
    "uneven": ["daily_by_brand"],
}


def using(views: str, body: str, /, **more: str) -> str:
    """``body`` after the named views and further ones given as ``name=sql``."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in views.split():
        add(name)
    parts = [f"{name} as ({VIEWS[name]})" for name in wanted]
    parts += [f"{name} as ({sql})" for name, sql in more.items()]
    return "with " + ",\n".join(parts) + "\n" + body


DAILY = "series_key, date, demand, production_plan, forecast, inventory"


def summary_sql(column: str, label: str, view: str, keys: str = "") -> str:
    group = f"group by {keys}" if keys else ""
    shown = f"{keys}, " if keys else ""
    return using(
        view,
        f"""select {shown}cast(coalesce(sum({column}), 0) as bigint) as total_{label},
          coalesce(cast(format('{{:.2f}}', avg({column})) as double), 0) as average_{label},
          cast(coalesce(min({column}), 0) as bigint) as min_{label},
          cast(coalesce(max({column}), 0) as bigint) as max_{label}
        from {view} {group}""",
    )


def edited_sql(where: str = "true") -> str:
    """Edits of the stale table, then a recalculation from each series' first hit."""
    return using(
        "stale edits",
        """select e.series_key, e.date, demand, production_plan, forecast,
          cast(case when start is null or e.date < start then inventory
            else coalesce(b, 0) + sum(case when e.date >= start then production_plan - demand else 0 end)
              over (partition by e.series_key order by e.date) end as bigint) as inventory
        from edited e left join starts using (series_key) left join base using (series_key)""",
        folded=f"""select series_key, date,
            arg_max(value, seq) filter (where field = 'production_plan') as p,
            arg_max(value, seq) filter (where field = 'demand') as d
          from edits where {where} group by 1, 2""",
        edited="""select s.series_key, s.date, coalesce(d, demand) as demand,
            coalesce(p, production_plan) as production_plan, forecast, inventory,
            p is not null or d is not null as hit
          from stale s left join folded f on f.series_key = s.series_key and f.date = s.date""",
        starts="select series_key, min(date) as start from edited where hit group by 1",
        base="""select e.series_key, arg_max(inventory, date) as b
          from edited e join starts using (series_key) where date < start group by 1""",
    )


UPSERT = {
    "merged": """select coalesce(c.series_key, s.series_key) as series_key, coalesce(c.date, s.date) as date,
            case when c.date is null then s.demand else c.demand end as demand,
            case when c.date is null then s.production_plan else c.production_plan end as production_plan,
            case when c.date is null then s.forecast else c.forecast end as forecast,
            s.inventory, c.date is not null as hit
          from stale s full join changes c on c.series_key = s.series_key and c.date = s.date""",
    "starts": "select series_key, min(date) as start from merged where hit group by 1",
    "base": """select m.series_key, arg_max(inventory, date) as b
          from merged m join starts using (series_key) where date < start group by 1""",
}


def upsert_sql(reached: str) -> str:
    return using(
        "stale changes",
        f"""select m.series_key, m.date, demand, production_plan, forecast,
          cast(case when {reached} then coalesce(b, 0)
              + sum(case when {reached} then production_plan - demand else 0 end)
                over (partition by m.series_key order by m.date)
            else inventory end as bigint) as inventory
        from merged m left join starts using (series_key) left join base using (series_key)""",
        **UPSERT,
    )


def smoothed_sql(source: str, partition: str) -> str:
    """The level by the recursion itself, as a fold over the ordered demands."""
    key = f"{partition}, " if partition else ""
    group = f"group by {partition}" if partition else ""
    return f"""select {key}last_date, cast(format('{{:.2f}}', list_reduce(list_prepend(l0, ys),
        lambda level, y: 0.5 * level + 0.5 * y)) as double) as forecast
      from (select {key}max(date) as last_date, list(cast(demand as double) order by date) as ys,
              regr_intercept(cast(demand as double), i) filter (where i <= 10) as l0
            from {source} {group})"""


AVERAGED = """select series_key, max(date) as last_date, round_even(avg(demand), 2) as forecast
  from numbered where back <= 3 group by 1"""

START = "date '1997-06-01'"
END = "date '1999-12-31'"

CUT_NUMBERED = f"""select series_key, date, demand,
    row_number() over (partition by series_key order by date) as i,
    row_number() over (partition by series_key order by date desc) as back
  from daily_by_brand d
  where date <= {START}
    or (select min(date) from daily_by_brand m where m.series_key = d.series_key) > {START}"""

NEW_ID = """concat(substr(md5({0}), 1, 8), '-', substr(md5({0}), 9, 4), '-', substr(md5({0}), 13, 4), '-',
  substr(md5({0}), 17, 4), '-', substr(md5({0}), 21, 12))"""

DEBUG = """select session_id, seq, ts, 'debug' as role,
    case kind when 'raw_response' then concat('📝 Modelo envía: ', text)
      when 'tool_called' then concat('▶️ Llamada a herramienta ', name)
      when 'tool_output' then concat('✅ Resultado herramienta: ', output)
      when 'agent_updated' then concat('🤖 Nuevo agente: ', name)
      else concat('• Evento ', name) end as content
  from agent_events where not (kind = 'raw_response' and coalesce(text, '') = '')"""

SPACE = r"[ \t\n\r\f\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

MARKUP = rf"""with messages as (
  select conv_id * 1000000 + turn as id, concat('c', cast(conv_id as varchar)) as session_id,
    concat('- **', role, '** *said*', chr(10),
      replace(replace(text, ', ', ' **'), '. ', '* ' || chr(10) || ' - ')) as content
  from conversations
  union all
  select doc_id, 'documents', text from documents),
lines as (
  select id, session_id, unnest(string_split(content, chr(10))) as line,
    generate_subscripts(string_split(content, chr(10)), 1) as line_no
  from messages),
pieces as (
  select id, session_id, line_no,
    regexp_split_to_array(line, '\*\*.*?\*\*') as plain,
    regexp_extract_all(line, '\*\*(.*?)\*\*', 1) as bold
  from lines),
parsed as (
  select *, flatten(list_transform(plain, lambda p: regexp_split_to_array(p, '\*.*?\*'))) as texts,
    list_transform(plain, lambda p: regexp_extract_all(p, '\*(.*?)\*', 1)) as italics
  from pieces),
spanned as (
  select *,
    flatten(list_transform(italics, lambda found, k:
      case when k <= len(bold) then list_append(found, bold[k]) else found end)) as spans,
    regexp_matches(list_aggregate(texts, 'string_agg', ''), '^{SPACE}*[-*]{SPACE}+') as item,
    list_position(list_transform(texts, lambda t: regexp_matches(t, '^{SPACE}*[-*]{SPACE}+')), true) as place
  from parsed),
shown as (
  select id, session_id, line_no, len(bold) as bold, len(spans) - len(bold) as italic, item,
    list_aggregate(list_transform(texts, lambda t, k: concat(
      case when item and k = place then regexp_replace(t, '^{SPACE}*[-*]{SPACE}+', '') else t end,
      coalesce(spans[k], ''))), 'string_agg', '') as shown
  from spanned)
select id, session_id, string_agg(shown, chr(10) order by line_no) as plain_text,
  cast(sum(bold) as bigint) as bold_spans, cast(sum(italic) as bigint) as italic_spans,
  cast(count(*) filter (where item) as bigint) as list_items
from shown group by 1, 2"""

TEXT_FORMS = """select date,
    case day(date) % 16 when 0 then strftime(date, '%Y-%m-%d')
      when 1 then strftime(date, '%d-%m-%Y')
      when 2 then concat(cast(day(date) as varchar), '/', cast(month(date) as varchar), '/', cast(year(date) as varchar))
      when 3 then concat(monthname(date), ' ', cast(year(date) as varchar))
      when 4 then concat(lower(left(monthname(date), 3)), '  ', cast(year(date) as varchar))
      when 5 then upper(monthname(date))
      when 6 then concat('31-02-', cast(year(date) as varchar))
      when 8 then concat(monthname(date), ' ', cast(day(date) as varchar), ', ', cast(year(date) as varchar))
      when 9 then concat(monthname(date), ' ', cast(day(date) as varchar), 'th ', cast(year(date) as varchar))
      when 10 then strftime(date, '%d.%m.%Y')
      when 11 then concat(strftime(date, '%Y-%m-%d'), ' 00:00:00')
      when 12 then concat('in ', cast(month(date) as varchar), ' days')
      when 13 then concat(cast(month(date) as varchar), ' weeks ago')
      when 14 then concat(cast(day(date) as varchar), ' de ', spanish[month(date)], ' de ', cast(year(date) as varchar))
      when 15 then concat(upper(spanish[month(date)][1]), spanish[month(date)][2:], ' ', cast(year(date) as varchar))
      else ['today', 'Yesterday', 'tomorrow', 'junk'][month(date) % 4 + 1] end as raw
  from daily_all, (select ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto',
    'septiembre', 'octubre', 'noviembre', 'diciembre'] as spanish)"""

TEXT_DATES = """select strftime(date, '%Y-%m-%d') as date_text, demand from daily_all where day(date) % 3 = 0
  union all select strftime(date, '%d-%m-%Y'), demand from daily_all where day(date) % 3 = 1
  union all select concat(cast(year(date) as varchar), '-', cast(month(date) as varchar), '-',
    cast(day(date) as varchar)), demand from daily_all where day(date) % 3 = 2
  union all select strftime(date, '%d-%m-%Y'), demand + 1 from daily_all where day(date) = 3
  union all select concat(cast(day(date) as varchar), '-', cast(month(date) as varchar), '-',
    cast(year(date) as varchar)), demand + 2 from daily_all where day(date) = 4
  union all select 'not-a-date', 0"""

PROJECTED = {
    "level": smoothed_sql("numbered", "series_key"),
    "projected": f"""select {DAILY} from daily_by_brand
          union all
          select series_key, cast(last_date + n as date), null, null, cast(trunc(forecast) as bigint), null
          from level, (select cast(unnest(range(1, 15)) as int) as n)""",
}

UNEVEN_PLAN = {
    "failed": """select series_key, case when count(demand) < count(*) then 'missing_demand'
            else 'insufficient_history' end as status
          from uneven group by 1 having count(demand) < count(*) or count(*) < 10""",
    "placed": """select series_key, date, demand,
            row_number() over (partition by series_key order by date) as i
          from uneven where series_key not in (select series_key from failed)""",
    "level": smoothed_sql("placed", "series_key"),
    "ahead": """select l.series_key, cast(last_date + cast(period as int) as date) as date,
            cast(trunc(forecast) as bigint) as demand, b, points
          from level l, periods, (select series_key as k, arg_max(inventory, date) as b, count(*) as points
            from uneven group by 1) where k = l.series_key""",
}



def nearest_sql(view: str, key: str = "") -> str:
    """Misses with slices of the whole sorted list of dates."""
    joined = "using (series_key)" if key else "on true"
    return using(
        view,
        f"""select {key}date, list_contains(dates, date) as found,
          case when not list_contains(dates, date) then
            array_to_string(list_filter(dates, lambda d: d < date)[-4:], ',') end as dates_before,
          case when not list_contains(dates, date) then
            array_to_string(list_filter(dates, lambda d: d > date)[:4], ',') end as dates_after
        from wanted join offered {joined}""",
        wanted=f"""select distinct {key}cast(date_trunc('month', date) + interval 60 month as date) as date from {view}
          union select distinct {key}date '1980-06-15' from {view}""",
        offered=f"select {key}list(date order by date) as dates from {view} {'group by series_key' if key else ''}",
    )


ORACLE: dict[str, str] = {
    "scan_daily": using("daily_by_brand", f"select {DAILY} from daily_by_brand"),
    "lookup_daily": using(
        "daily_by_brand", f"select {DAILY} from daily_by_brand where date = date '1996-06-01'"
    ),
    "lookup_available_dates": nearest_sql("daily_by_brand", "series_key, "),
    "lookup_available_dates_single": nearest_sql("daily_all"),
    "publish_snapshot": using("daily_by_brand", f"select {DAILY} from daily_by_brand"),
    "publish_edits_by_month": edited_sql("date >= date '1999-03-01'"),
    "append_messages": using(
        "history",
        """select cast((select max(id) from history) + row_number() over (order by ts, event_id) as bigint) as id,
          concat('u', cast(user_id as varchar)) as session_id, cast(null as varchar) as user_id,
          'assistant' as role, props as content, ts as timestamp
        from events""",
    ),
    "ensure_column": using(
        "daily_by_brand",
        """select series_key, date, demand, production_plan, inventory, cast(0 as bigint) as forecast
        from daily_by_brand""",
    ),
    "demand_series": using("numbered", "select series_key, date, demand, i as position from numbered"),
    "rows_in_range": using(
        "daily_by_brand", f"select {DAILY} from daily_by_brand where date between {START} and {END}"
    ),
    "forecast_rows_in_range": using(
        "daily_by_brand",
        f"""select series_key, count(forecast) as forecast_rows
        from daily_by_brand where date between {START} and {END} group by 1""",
    ),
    "stockouts": using(
        "daily_by_brand",
        """select series_key, date, demand, production_plan, inventory
        from daily_by_brand where inventory <= 0""",
    ),
    "stockout_proposals": using(
        "daily_by_brand",
        """select series_key, date, demand, production_plan as current_production_plan,
          demand as proposed_production_plan, cast(0 as bigint) as resulting_inventory
        from daily_by_brand where inventory <= 0""",
    ),
    "stockout_backlog_proposals": using(
        "daily_by_brand",
        """select series_key, date, demand, production_plan as current_production_plan,
          production_plan - inventory as proposed_production_plan, cast(0 as bigint) as resulting_inventory
        from daily_by_brand where inventory <= 0""",
    ),
    "agent_context": using(
        "history",
        """select session_id, id, role, content from (
          select *, row_number() over (partition by session_id order by id desc) as back from talk)
        where back > 1 and role <> 'debug'""",
        talk="""select session_id, id, role, content from history
          union all select concat('c', cast(user_id as varchar)), event_id + 1000000000000, 'debug', props
          from events""",
    ),
    "production_summary": summary_sql("production_plan", "production", "daily_by_brand", "series_key"),
    "demand_summary": summary_sql("demand", "demand", "daily_by_brand", "series_key"),
    "inventory_summary": summary_sql("inventory", "inventory", "daily_by_brand", "series_key"),
    "inventory_summary_single": summary_sql("inventory", "inventory", "daily_all"),
    "latest_inventory": using(
        "daily_by_brand",
        """select series_key, inventory as latest_inventory from daily_by_brand
        qualify row_number() over (partition by series_key order by date desc) = 1""",
    ),
    "latest_inventory_single": using(
        "daily_all", "select inventory as latest_inventory from daily_all order by date desc limit 1"
    ),
    "kpi_cards": using(
        "daily_by_brand",
        """select series_key, cast(sum(production_plan) as bigint) as total_production,
          cast(sum(demand) as bigint) as total_demand,
          arg_max(inventory, date) as projected_inventory
        from daily_by_brand group by 1""",
    ),
    "history_bounds": using(
        "daily_by_brand",
        """select series_key, min(date) as first_date, max(date) as last_date, count(*) as days
        from daily_by_brand group by 1""",
    ),
    "delete_all_daily": using(
        "daily_by_brand",
        "select count(*) as rows_removed, cast(0 as bigint) as rows_left from daily_by_brand",
    ),
    "recalc_inventory": using(
        "stale",
        f"""select series_key, date, demand, production_plan, forecast,
          cast(case when date < {START} then inventory else coalesce(b, 0)
            + sum(case when date >= {START} then production_plan - demand else 0 end)
              over (partition by series_key order by date) end as bigint) as inventory
        from stale left join base using (series_key)""",
        base=f"select series_key, arg_max(inventory, date) as b from stale where date < {START} group by 1",
    ),
    "recalc_inventory_by_year": using(
        "stale",
        f"""select series_key, date, demand, production_plan, forecast,
          cast(case when date < {START} then inventory else coalesce(b, 0)
            + sum(case when date >= {START} then production_plan - demand else 0 end)
              over (partition by series_key order by date) end as bigint) as inventory
        from stale left join base using (series_key)""",
        base=f"select series_key, arg_max(inventory, date) as b from stale where date < {START} group by 1",
    ),
    "recalc_inventory_single": using(
        "stale_all",
        f"""select date, demand, production_plan, forecast,
          cast(case when date < {START} then inventory
            else (select arg_max(inventory, date) from stale_all where date < {START})
            + sum(case when date >= {START} then production_plan - demand else 0 end)
              over (order by date) end as bigint) as inventory
        from stale_all""",
    ),
    "shift_demand": using(
        "stale",
        """select series_key, date, demand + 50 as demand, production_plan, forecast,
          cast(sum(production_plan - demand - 50) over (partition by series_key order by date) as bigint)
            as inventory
        from stale""",
    ),
    "set_production_plan": edited_sql("field = 'production_plan'"),
    "set_demand": edited_sql("field = 'demand'"),
    "apply_edits": edited_sql(),
    "apply_edits_by_year": edited_sql(),
    "stream_apply_edits": edited_sql(),
    "set_forecast": using(
        "edits",
        """select d.series_key, d.date, demand, production_plan, coalesce(value, forecast) as forecast,
          inventory
        from daily_by_brand d left join last on last.series_key = d.series_key and last.date = d.date""",
        last="select series_key, date, arg_max(value, seq) as value from edits group by 1, 2",
    ),
    "edit_report": using(
        "edits",
        """select e.series_key, e.date, field, value, seq,
          case when exists (select 1 from daily_by_brand d
            where d.series_key = e.series_key and d.date = e.date) then 'updated' else 'not_found' end as outcome
        from edits e""",
    ),
    "upsert_daily": upsert_sql("start is not null and m.date >= start"),
    "upsert_daily_range_only": upsert_sql("hit"),
    "clear_all_forecast": using(
        "daily_by_brand",
        """select series_key, date, demand, production_plan, cast(null as bigint) as forecast, inventory
        from daily_by_brand""",
    ),
    "clear_forecast_range": using(
        "daily_by_brand",
        f"""select series_key, date, demand, production_plan,
          case when date between {START} and {END} then null else forecast end as forecast, inventory
        from daily_by_brand""",
    ),
    "clear_forecast_outcome": using(
        "daily_by_brand",
        f"""select count(*) as cleared, 'cleared' as outcome,
          'Forecast cleared from 1997-06-01 to 1999-12-31.' as message
        from daily_by_brand where forecast is not null and date between {START} and {END}""",
    ),
    "extend_calendar": using(
        "daily_by_brand",
        """select series_key, cast(last_date + cast(n as int) as date) as date
        from (select series_key, max(date) as last_date from daily_by_brand group by 1),
          (select unnest(range(1, 15)) as n)""",
    ),
    "moving_average_forecast": using(
        "numbered periods",
        "select series_key, period, forecast, 'ok' as status from level, periods",
        level=AVERAGED,
    ),
    "moving_average_series": using(
        "numbered",
        """select series_key, date, demand,
          case when i >= 3 then round_even(avg(demand) over
            (partition by series_key order by date rows between 2 preceding and current row), 2) end
            as moving_average
        from numbered""",
    ),
    "moving_average_year": using(
        "numbered",
        """select series_key, date, demand,
          case when i >= 365 then round_even(avg(demand) over
            (partition by series_key order by date rows between 364 preceding and current row), 2) end
            as moving_average
        from numbered""",
    ),
    "ses_forecast": using(
        "numbered periods",
        "select series_key, period, forecast, 'ok' as status from level, periods",
        level=smoothed_sql("numbered", "series_key"),
    ),
    "ses_forecast_single": using(
        "daily_all periods",
        "select period, forecast, 'ok' as status from level, periods",
        placed="select date, demand, row_number() over (order by date) as i from daily_all",
        level=smoothed_sql("placed", ""),
    ),
    "forecast_from_date": using(
        "daily_by_brand periods",
        "select series_key, period, forecast, 'ok' as status from level, periods",
        cut=CUT_NUMBERED,
        level=smoothed_sql("cut", "series_key"),
    ),
    "future_forecast_rows": using(
        "numbered periods",
        """select series_key, cast(last_date + cast(period as int) as date) as date, forecast, 'ok' as status
        from level, periods""",
        level=smoothed_sql("numbered", "series_key"),
    ),
    "demand_forecast_series": using(
        "numbered periods",
        """select series_key, date, 'Historical Demand' as series, cast(demand as double) as value from numbered
        union all
        select series_key, cast(last_date + cast(period as int) as date), 'Forecast', forecast
        from level, periods where period <= 5""",
        level=smoothed_sql("numbered", "series_key"),
    ),
    "persist_forecast": using(
        "daily_by_brand",
        f"""select d.series_key, d.date, demand, production_plan,
          case when d.date between {START} and {START} + 13 then cast(trunc(level.forecast) as bigint)
            else d.forecast end as forecast, inventory
        from daily_by_brand d join level using (series_key)""",
        cut=CUT_NUMBERED,
        level="select series_key, round_even(avg(demand), 2) as forecast from cut where back <= 3 group by 1",
    ),
    "persist_forecast_upsert": using(
        "numbered periods", f"select {DAILY} from projected", **PROJECTED
    ),
    "latest_inventory_projected": using(
        "daily_by_brand",
        """select series_key, inventory as latest_inventory from daily_by_brand
        qualify row_number() over (partition by series_key order by date desc) = 1""",
    ),
    "apply_edits_projected": using(
        "edits numbered periods",
        """select e.series_key, e.date, demand, production_plan, forecast,
          cast(case when inventory is null then null when start is null or e.date < start then inventory
            else coalesce(b, 0) + sum(case when e.date >= start then production_plan - demand else 0 end)
              over (partition by e.series_key order by e.date) end as bigint) as inventory
        from edited e left join starts using (series_key) left join base using (series_key)""",
        **PROJECTED,
        folded="""select series_key, date,
            arg_max(value, seq) filter (where field = 'production_plan') as p,
            arg_max(value, seq) filter (where field = 'demand') as d
          from edits group by 1, 2""",
        edited="""select s.series_key, s.date, coalesce(d, demand) as demand,
            coalesce(p, production_plan) as production_plan,
            case when inventory is null and s.date = last_date + 3 then 77 else s.forecast end as forecast,
            inventory, p is not null or d is not null as hit
          from projected s left join folded f on f.series_key = s.series_key and f.date = s.date
          join level on level.series_key = s.series_key""",
        starts="select series_key, min(date) as start from edited where hit group by 1",
        base="""select e.series_key, arg_max(inventory, date) as b
          from edited e join starts using (series_key) where date < start group by 1""",
    ),
    "forecast_to_plan": using(
        "uneven periods",
        """select series_key, date, demand, production_plan, forecast, inventory,
          coalesce(status, 'planned') as status
        from uneven left join failed using (series_key)
        union all
        select series_key, date, demand, demand, demand, b, 'planned' from ahead""",
        **UNEVEN_PLAN,
    ),
    "forecast_to_plan_outcomes": using(
        "uneven periods",
        """select series_key, status, count(*) as points_used, max(date) as last_date,
          cast(null as bigint) as forecast, cast(null as date) as first_planned,
          cast(null as date) as last_planned, cast(0 as bigint) as days_planned
        from uneven join failed using (series_key) group by 1, 2
        union all
        select series_key, 'planned', max(points), min(date) - 1, max(demand), min(date), max(date), count(*)
        from ahead group by 1""",
        **UNEVEN_PLAN,
    ),
    "forecast_to_plan_projected": using(
        "numbered periods",
        f"""select {DAILY}, 'planned' as status from daily_by_brand
        union all
        select p.series_key, p.date, p.forecast, p.forecast, p.forecast, b, 'planned'
        from projected p join (select series_key, arg_max(inventory, date) as b
          from daily_by_brand group by 1) using (series_key) where inventory is null""",
        **PROJECTED,
    ),
    "normalize_date": using(
        "daily_all",
        """select date, raw, cast(case
            when raw = 'today' then date '2024-06-15' when raw = 'Yesterday' then date '2024-06-14'
            when raw = 'tomorrow' then date '2024-06-16' when raw = 'junk' then null
            else case day(date) % 16 when 3 then date_trunc('month', date) when 4 then date_trunc('month', date)
              when 15 then date_trunc('month', date) when 5 then make_date(2024, month(date), 1)
              when 6 then null when 12 then date '2024-06-15' + cast(month(date) as int)
              when 13 then date '2024-06-15' - 7 * cast(month(date) as int) else date end end as date) as parsed
        from texts""",
        texts=TEXT_FORMS,
    ),
    "migrate_date_format": using(
        "daily_all",
        """select case when rank = 1 and not taken then target else date_text end as date_text, demand
        from (select *, row_number() over (partition by target order by date_text) as rank from aimed)""",
        texts=TEXT_DATES,
        aimed="""select *, target in (select date_text from texts) as taken from (
          select date_text, demand, case when regexp_full_match(date_text, '\\d{1,2}-\\d{1,2}-\\d{4}')
            then strftime(try_strptime(date_text, '%d-%m-%Y'), '%Y-%m-%d') end as target from texts)""",
    ),
    "remap_user_ids": using(
        "users_int",
        f"""select {NEW_ID.format("concat('id:', cast(id as varchar))")} as id, username,
          coalesce(nullif(display_name, ''), username) as display_name from users_int""",
    ),
    "remap_message_users": using(
        "history users_int",
        f"""select id, session_id,
          case when user_id in (select cast(id as varchar) from users_int)
            then {NEW_ID.format("concat('id:', user_id)")} else user_id end as user_id, role, content, timestamp
        from history""",
    ),
    "get_or_create_users": using(
        "users_int",
        f"""select cast(id as varchar) as id, username,
          coalesce(nullif(display_name, ''), username) as display_name, false as created
        from users_int where username in (select username from names)
        union all
        select {NEW_ID.format("concat('name:', username)")}, username, username, true
        from names where username not in (select username from users_int)""",
        names="select distinct username from (select c_name as username from customer union all select s_name from supplier)",
    ),
    "set_display_name": using(
        "users_int",
        """select cast(id as varchar) as id, username,
          case when c_acctbal < 0 then c_mktsegment else display_name end as display_name
        from users_int join customer on c_custkey = id""",
    ),
    "user_profile": using(
        "users_int",
        "select id, username, coalesce(nullif(display_name, ''), username) as display_name from users_int",
    ),
    "session_history": using("history", "select session_id, id, role, content from history"),
    "user_session_history": using(
        "history",
        "select user_id, session_id, id, role, content from history where user_id is not null",
    ),
    "user_sessions": using(
        "history",
        """select user_id, session_id, min(timestamp) as min_time
        from history where user_id is not null group by 1, 2""",
    ),
    "session_history_single": using(
        "history", "select session_id, id, role, content from history where session_id = 'c17'"
    ),
    "user_session_history_single": using(
        "history",
        """select user_id, session_id, id, role, content from history
        where user_id = '4' and session_id = 'c24'""",
    ),
    "user_sessions_single": using(
        "history",
        """select user_id, session_id, min(timestamp) as min_time
        from history where user_id = '4' group by 1, 2""",
    ),
    "session_labels": using(
        "history",
        """select session_id, strftime(arg_min(timestamp, id), '%d/%m/%Y %H:%M') as label
        from history group by 1""",
    ),
    "clear_session": using("history", "select * from history where user_id is not null"),
    "message_markup": MARKUP,
    "debug_messages": using("agent_events", DEBUG),
    "stream_debug_messages": using("agent_events", DEBUG),
    "two_stage_events": using(
        "agent_events",
        """select session_id, cast(case when kind in ('raw_response', 'tool_called') then 1 else 2 end as bigint)
          as stage, seq, kind, name from agent_events""",
    ),
}

ORACLE["set_forecast_bucketed"] = ORACLE["set_forecast"]
