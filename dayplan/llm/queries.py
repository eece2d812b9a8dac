"""The operators of this subpackage over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayplan.llm import (
    ball_kmeans,
    line_templates,
    mixing,
    order_minhash,
    positional_index,
    private_spans,
    quality_rules,
    site_quality,
    term_ranking,
    token_orc,
    tool_chat,
    url_lists,
    warc,
)
from dayplan.llm.common import table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.word_budget(table(spark, sf_dir, "documents"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def digit(key: Column, place: int, n: int = 1) -> Column:
    """A number from hexadecimal digits of a hash."""
    return F.conv(F.substring(F.md5(key), place, n), 16, 10).cast("int")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries from the hosts of the pages: hosts that are blocked, set free and
    blocked again, domains blocked for ten days, and first path segments that are allowed."""
    start = F.lit("2023-01-01").cast("date")
    keys = pages.filter("url is not null").select(url_lists.url_keys("url").alias("k")).filter(F.size("k") > 0)
    hosts = keys.select(F.col("k")[0].alias("pattern")).distinct()
    domains = keys.select(F.element_at(F.filter("k", lambda x: ~F.contains(x, F.lit("/"))), -1).alias("pattern")).distinct()
    paths = keys.select(F.get(F.filter("k", lambda x: F.contains(x, F.lit("/"))), 0).alias("pattern")).filter("pattern is not null").distinct()

    def listed(rows: DataFrame, name: str, kind: str, days: list[tuple[str, int]], least: int) -> DataFrame:
        first = F.date_add(start, digit(F.col("pattern"), 1, 3) % 700)
        events = F.array(*[F.struct(F.lit(a).alias("action"), F.date_add(first, d).alias("dated")) for a, d in days])
        chosen = rows.filter(digit(F.col("pattern"), 32) < least)
        return chosen.select(F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), "pattern", F.explode(events).alias("e")).select("list_name", "kind", "pattern", "e.*")

    return (
        listed(hosts, "hosts", "block", [("add", 0), ("remove", 90), ("add", 200)], 6)
        .unionByName(listed(domains, "domains", "block", [("add", 0), ("remove", 10), ("add", 300)], 16))
        .unionByName(listed(paths, "paths", "allow", [("add", 0), ("remove", 400)], 8))
    )


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures fetched over 900 days."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2023-01-01").cast("date"), ((F.col("page_id") * 7919) % 900).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched_at"))
    return url_lists.url_verdicts(captures, list_entries(pages)).drop("url")


def chat_messages(conversations: DataFrame) -> DataFrame:
    """The conversations with tool calls: an assistant's turn calls a tool named by a hash of
    the turn, often with arguments that break the schema or refer to another call, and most
    calls have a result, now and then before the call."""
    key = F.concat_ws(":", "conv_id", "turn")
    call_id = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    tool = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("score"), F.lit("unlisted")), digit(key, 1) % 4 + 1)
    other = F.col("turn") + F.when(digit(key, 2) == 0, 2).otherwise(-2)
    number = F.when(digit(key, 3) < 3, F.lit('"many"')).otherwise(F.length("text").cast("string"))
    query = F.when(digit(key, 4) == 0, F.lit("null")).otherwise(
        F.regexp_replace(F.to_json(F.struct(F.col("text").alias("x"))), r'^\{"x":|\}$', "")
    )
    more = F.when(digit(key, 5) < 4, F.concat(F.lit(', "after": "{{'), call_id(other), F.lit('}}"'))).otherwise(F.lit(""))
    arguments = F.when(digit(key, 6) == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('{"query": '), query, F.lit(', "limit": '), number, more, F.lit("}"))
    )
    calls = F.array(F.struct(call_id(F.col("turn")).alias("id"), tool.alias("name"), arguments.alias("arguments")))
    said = conversations.select(
        "conv_id", (10 * F.col("turn")).alias("turn"), "role", "text",
        F.when(F.col("role") == "assistant", calls).alias("calls"), F.lit(None).cast("string").alias("result_of"),
    )
    answered = conversations.filter((F.col("role") == "assistant") & (digit(key, 7) > 1))
    results = answered.select(
        "conv_id", (10 * F.col("turn") + F.when(digit(key, 8) == 0, -5).otherwise(5)).alias("turn"), F.lit("tool").alias("role"),
        F.concat(F.lit("result of "), F.length("text").cast("string")).alias("text"), F.lit(None).cast(tool_chat.CALLS).alias("calls"),
        call_id(F.col("turn")).alias("result_of"),
    )
    return said.unionByName(results)


def tool_schemas(spark: SparkSession) -> DataFrame:
    rows = [
        (tool, name, kind, required)
        for tool in ("search", "lookup", "score")
        for name, kind, required in (("query", "string", True), ("limit", "integer", tool == "search"), ("after", "string", False))
        if (tool, name) != ("score", "after")
    ]
    return spark.createDataFrame(rows, "tool string, parameter string, kind string, required boolean")


def op5_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_chat.format_chats(chat_messages(table(spark, sf_dir, "conversations")), tool_schemas(spark))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is its site, the language its path in it."""
    return site_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_templates.without_templates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge_texts(table(spark, sf_dir, "documents"))
    return rows.withColumn("text_sha256", F.sha2("text", 256)).drop("source", "text_hash", "text")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2)


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.compress(table(spark, sf_dir, "embeddings"))


def op12_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans.find_private(table(spark, sf_dir, "documents"))


def op13_term_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_token_orc": op3_token_orc,
    "op4_url_lists": op4_url_lists,
    "op5_tool_chat": op5_tool_chat,
    "op6_site_quality": op6_site_quality,
    "op7_line_templates": op7_line_templates,
    "op8_quality_rules": op8_quality_rules,
    "op9_order_minhash": op9_order_minhash,
    "op10_positional_index": op10_positional_index,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_private_spans": op12_private_spans,
    "op13_term_ranking": op13_term_ranking,
}


def ball_kmeans_sql(rounds: int = ball_kmeans.ROUNDS, entries: int = ball_kmeans.ENTRIES) -> str:
    """Plain k-means by comparing every part with every entry, one pair of views for each round."""
    views = []
    for n in range(rounds + 1):
        views.append(f"""near{n} as materialized (
            select vec_id, part, min(far * {entries} + entry) as best from (
                select vec_id, part, entry, sum((x - c) * (x - c)) as far
                from xs join book{n} using (part, place) group by all) group by all)""")
        if n < rounds:
            views.append(f"""book{n + 1} as materialized (
            select part, entry, place, coalesce(s, c) as c from book{n} left join (
                select part, best % {entries} as entry, place, floor(sum(x)::double / count(*))::bigint as s
                from xs join near{n} using (vec_id, part) group by all) using (part, entry, place))""")
    chain = ",\n        ".join(views)
    return f"""
        with kept as materialized (
            select vec_id, label, row_number() over (order by vec_id) - 1 as turn, len(embedding) // {ball_kmeans.PARTS} as size,
                list_transform(embedding, lambda x: floor({ball_kmeans.SCALE}::double * x)::bigint) as v
            from embeddings
            where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        ), xs as materialized (
            select vec_id, turn, (i - 1) // size as part, (i - 1) % size as place, v[i] as x
            from (select vec_id, turn, size, v, unnest(range(1, len(v) + 1)) as i from kept)
        ), book0 as materialized (select part, turn as entry, place, x as c from xs where turn < {entries}),
        {chain}, coded as (
            select vec_id, string_agg(lower(lpad(to_hex(best % {entries}), 2, '0')), '' order by part) as code,
                sum(best // {entries})::bigint as error
            from near{rounds} group by vec_id
        )
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
            (select sha256(string_agg(c::varchar, ',' order by part, entry, place)) from book{rounds}) as codebooks_sha256
        from coded join kept using (vec_id)
    """


TERMS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

ORACLE: dict[str, str] = {
    "op2_mixing": f"""
        with sizes as (
            select doc_id, source,
                coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
            from documents
        ), by_source as (
            select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank
            from sizes group by source
        ), weighed as (
            select *, [3, 1, 2][rank % 3 + 1] as weight, 2 * source_size as cap from by_source
        ), rated as (
            select *, row_number() over fill as turn,
                (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (fill rows between unbounded preceding and 1 preceding), 0)::double)
                / (sum(weight) over (fill rows between current row and unbounded following))::double as rate
            from weighed window fill as (order by cap::double / weight, rank)
        ), targets as (
            select *, coalesce(least(cap::double, (
                select rate from rated where rate * weight <= cap order by turn limit 1) * weight), 0) as target
            from rated
        ), placed as (
            select s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::bigint as drawn,
                coalesce(sum(s.size) over (
                    partition by t.rank order by md5('{mixing.SEED}:' || coalesce(s.doc_id::varchar, '')), s.size
                    rows between unbounded preceding and 1 preceding), 0)::bigint as start
            from sizes s join targets t on s.source is not distinct from t.source
        )
        select doc_id, size, source_size, target,
            case when source_size = 0 then 0 else (drawn // source_size) * size
                + greatest(least(drawn % source_size - start, size), 0) end::bigint as taken
        from placed
    """,
    "op11_ball_kmeans": ball_kmeans_sql(),
    "op13_term_ranking": f"""
        with docs as (
            select doc_id, {TERMS_SQL} as terms
            from documents
        ), items as (
            select item_id, unnest({TERMS_SQL}) as term
            from benchmark
        ), asked as (select item_id, term, count(*)::bigint as repeats from items group by all),
        corpus as (
            select count(*) filter (where len(terms) > 0)::bigint as n_docs, coalesce(sum(len(terms)), 0)::bigint as n_terms from docs
        ), postings as (
            select doc_id, any_value(n)::bigint as n, term, count(*)::bigint as tf
            from (select doc_id, len(terms) as n, unnest(terms) as term from docs)
            where term in (select term from asked) group by doc_id, term
        ), weights as (
            select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
            from postings, corpus group by term
        ), scores as (
            select item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
            from asked join weights using (term) join postings using (term), corpus group by item_id, doc_id
        ), ranked as (
            select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
            from scores where score > 0
        )
        select item_id, rank, doc_id, score from ranked where rank <= {term_ranking.TOP}
    """,
}
