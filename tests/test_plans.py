"""What the physical plans must and must not contain."""

import re

import pytest
from conftest import make_daily
from dayplan.operators import conversations as talk
from dayplan.operators import edits as ed
from dayplan.operators import forecast as fc
from dayplan.operators import inventory as inv
from dayplan.operators import scans, summary, users
from dayplan.plans import queries
from dayplan.plans.oracle import ORACLE
from dayplan.sources import staging, views

KEYS = ["series_key"]


@pytest.fixture(scope="module")
def stored(spark, many, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "daily")
    many[1].write.parquet(path)
    return spark.read.parquet(path)


def tree(df):
    """(depth, operator text) for each node of the physical plan."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    nodes = []
    for line in text.splitlines():
        body = re.sub(r"^[\s:+|-]*", "", line)
        nodes.append((len(line) - len(body), re.sub(r"^\*\(\d+\) ", "", body)))
    return nodes


def below(nodes, at):
    depth = nodes[at][0]
    for node in nodes[at + 1 :]:
        if node[0] <= depth:
            return
        yield node[1]


def single_series(df):
    return df.drop("series_key")


@pytest.mark.parametrize(
    "build",
    [
        lambda d: inv.recalc_inventory(d),
        lambda d: inv.recalc_inventory(d, "2020-06-01"),
        lambda d: scans.demand_series(d),
        lambda d: fc.moving_average_series(d),
        lambda d: fc.ses_forecast(d),
        lambda d: fc.moving_average_forecast(d, 500),
    ],
)
def test_one_series_reaches_one_task_only_as_totals(stored, build):
    nodes = tree(build(single_series(stored)))
    single = [at for at, (_, text) in enumerate(nodes) if text.startswith("Exchange SinglePartition")]
    assert single
    for at in single:
        assert any("Aggregate" in text for text in below(nodes, at))
        first = next(below(nodes, at))
        assert not first.startswith(("FileScan", "Filter", "Sort", "Window"))


@pytest.mark.parametrize(
    "build",
    [
        lambda d: inv.recalc_inventory(d, None, KEYS),
        lambda d: scans.demand_series(d, KEYS),
        lambda d: fc.moving_average_series(d, 3, KEYS),
    ],
)
def test_daily_rows_are_windowed_by_series_and_year(stored, build):
    for depth, text in tree(build(stored)):
        if text.startswith("Window") and "date#" in text:
            assert "_year" in text


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_has_check_sql(name):
    assert name in ORACLE


def test_a_moving_average_shuffles_only_the_last_rows(stored):
    text = [node for _, node in tree(fc.moving_average_forecast(stored, keys=KEYS))]
    moved = next(at for at, node in enumerate(text) if node.startswith("Exchange hashpartitioning"))
    assert text[moved + 1].startswith("WindowGroupLimit") and "Partial" in text[moved + 1]
    text = [node for _, node in tree(fc.moving_average_forecast(single_series(stored)))]
    assert any(node.startswith("TakeOrderedAndProject(limit=3") for node in text)


def test_edits_travel_in_the_shuffle_of_the_recalculation(spark, stored):
    change = ed.one_edit(spark, "2020-06-01", "demand", 5, {"series_key": "s5"})
    text = [node for _, node in tree(ed.set_demand(stored, change, KEYS))]
    full = [node for node in text if node.startswith("Exchange hashpartitioning(series_key")]
    assert sum("REPARTITION_BY_COL" in node for node in full) == 1
    windows = [at for at, node in enumerate(text) if node.startswith("Window [")]
    between = text[windows[0] : windows[1]]
    assert not any(node.startswith(("Exchange", "Sort ")) for node in between)


def test_untouched_rows_are_not_shuffled(stored):
    nodes = tree(inv.recalc_inventory(stored, "2020-06-01", KEYS))
    top = [text for depth, text in nodes]
    passing = [at for at, text in enumerate(top) if "LessThan(date,2020-06-01)" in text]
    assert any("forecast" in top[at] for at in passing)
    full = [text for text in top if text.startswith("FileScan") and "GreaterThanOrEqual(date" in text]
    # The stored balance is read beside the flows, as it tells projected days from days with missing numbers.
    # The yearly sums read no forecast.
    assert any("forecast" not in re.search(r"FileScan parquet \[(.*?)\]", text)[1] for text in full)


def test_a_summary_is_one_pruned_scan(stored):
    text = "\n".join(node for _, node in tree(summary.kpi_cards(stored, KEYS)))
    assert text.count("FileScan") == 1 and "forecast" not in text
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_no_python_in_any_plan(spark):
    folder = "/root/testdata/sf0.001"
    slow = {"stream_debug_messages", "stream_apply_edits", "publish_snapshot", "publish_edits_by_month", "recalc_inventory_by_year", "apply_edits_by_year"}
    for name, build in queries.QUERIES.items():
        if name in slow:
            continue
        text = build(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Pandas" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_flows_scan_the_lines_once(spark):
    text = views.daily_flows(spark, "/root/testdata/sf0.001", "brand")
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3
    assert "l_extendedprice" not in plan


def test_staged_tables_live_in_the_shared_folder(spark, daily_13):
    kept = staging.stage(daily_13, "probe")
    folder = staging.app_folder(spark)
    assert folder.startswith(staging.shared_folder(spark))
    assert all(folder in name for name in kept.inputFiles())
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert folder.startswith(named.rstrip("/"))


def test_release_deletes_what_was_staged(spark, daily_13):
    kept = staging.stage(daily_13, "probe")
    once = staging.stage_once(spark, "probe", "x", lambda: daily_13)
    assert once.count() == 13
    staging.release(spark)
    with pytest.raises(Exception):
        kept.collect()
    assert staging.stage_once(spark, "probe", "x", lambda: daily_13).count() == 13


def test_a_year_is_small_even_for_the_longest_series(spark, many):
    rows = [row[1:] for row in many[0] if row[0] == "s6"]
    years = fc.year_levels(make_daily(spark, rows), 0.5, []).collect()
    assert sum(row["size"] for row in years) == len(rows)
    assert max(row["size"] for row in years) <= 366
    assert max(len(row["head"]) for row in years) <= 10


@pytest.fixture
def small_partitions(spark):
    """Thresholds low enough for a small table to show what a large one would do."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("hot", ["'7'", "cast(null as string)"])
def test_a_user_with_a_third_of_the_log_is_split(spark, small_partitions, hot):
    log = spark.range(0, 60_000, 1, 8).selectExpr(
        "id", "cast(id as string) as session_id",
        f"if(id % 3 = 0, {hot}, cast(id % 900 as string)) as user_id", "'user' as role",
        "sha2(cast(id as string), 256) as content",
    )
    people = spark.range(500).selectExpr("id", "cast(id as string) as username",
                                         "cast(null as string) as display_name")
    rows, plan = final_plan(users.remap_message_users(log, people))
    assert len(rows) == 60_000 and "skew=true" in plan


def test_a_session_with_a_third_of_the_log_is_split(spark, small_partitions):
    log = spark.range(0, 60_000, 1, 8).selectExpr(
        "id", "if(id % 3 = 0, 'hot', cast(id as string)) as session_id",
        "sha2(cast(id as string), 256) as content",
    )
    gone = spark.range(1, 200).selectExpr("cast(id as string) as session_id")
    rows, plan = final_plan(talk.clear_session(log, gone))
    assert len(rows) == 60_000 - 133 and "skew=true" in plan
