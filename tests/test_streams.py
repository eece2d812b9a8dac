from pathlib import Path

import pytest
from conftest import day, values
from dayplan.operators import edits as ed
from dayplan.operators import scans
from dayplan.schema import EVENT_SCHEMA
from dayplan.sources import staging
from dayplan.sources.tables import StoredTable, publish_snapshot
from dayplan.streaming import events as ev
from dayplan.streaming.edits import stream_apply_edits, write_edits
from pyspark.sql import functions as F


@pytest.fixture
def events(spark):
    rows = [
        ("s", 1, None, "tool_called", "t1", None, None),
        ("s", 2, None, "raw_response", None, None, None),
        ("s", 3, None, "raw_response", None, "", None),
        ("s", 4, None, "raw_response", None, "words", None),
        ("s", 5, None, "tool_output", None, None, "42"),
        ("s", 6, None, "tool_output", None, None, None),
        ("s", 7, None, "agent_updated", "planner", None, None),
        ("s", 8, None, "other", "handoff", None, None),
    ]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


EXPECTED = [
    "▶️ Llamada a herramienta t1",
    "📝 Modelo envía: words",
    "✅ Resultado herramienta: 42",
    "✅ Resultado herramienta: None",
    "🤖 Nuevo agente: planner",
    "• Evento handoff",
]


def test_debug_messages(events):
    out = ev.debug_messages(events).orderBy("seq")
    assert values(out, "content") == EXPECTED
    assert set(values(out, "role")) == {"debug"}
    assert ev.debug_messages(events.filter("seq < 3")).count() == 1


def test_stream_equals_batch_and_survives_its_callback(spark, events, tmp_path):
    source = str(tmp_path / "in")
    for part in ("seq < 4", "seq >= 4"):
        events.filter(part).coalesce(1).write.mode("append").parquet(source)
    seen = []

    def callback(batch, number):
        seen.append((number, batch.count()))
        raise ValueError("shown in the log only")

    def run():
        stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        out = ev.collect_events(stream, str(tmp_path / "out"), str(tmp_path / "check"), callback)
        return out.orderBy("batch", "seq")

    assert values(run(), "content") == EXPECTED
    assert sum(count for _, count in seen) == 6 and len(seen) == 2
    assert values(run(), "content") == EXPECTED and len(seen) == 2


def test_a_stream_without_events(spark, events, tmp_path):
    events.filter("false").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    out = ev.collect_events(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert out.count() == 0 and out.columns[-1] == "batch"


def test_two_stages_keep_each_event_once(events):
    late = events.filter("seq > 4")
    out = ev.two_stage_events(events.filter("seq <= 4"), late.unionByName(late))
    assert sorted(values(out, "stage", "seq")) == [(1, n) for n in range(1, 5)] + [
        (2, n) for n in range(5, 9)
    ]


def files_of(table):
    """Data files by partition."""
    root = Path(table.root) / "data"
    return {part.name: sorted(f.name for f in part.glob("*.parquet")) for part in root.iterdir() if "=" in part.name}


def test_a_stored_table_is_changed_in_place(spark, daily_13, tmp_path):
    table = StoredTable(spark, str(tmp_path / "daily"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.create(daily_13)
    with pytest.raises(FileExistsError):
        table.create(daily_13)
    write_edits(table, ed.one_edit(spark, "2024-01-05", "demand", 300))
    assert values(table.read().orderBy("date"), "inventory")[-1] == -95
    assert table.read().columns == daily_13.columns
    again = StoredTable(spark, table.root)
    assert again.settings["layout"] == "month" and again.read().schema.names == daily_13.columns
    again.clear()
    assert table.read().collect() == [] and table.with_layout().columns[-1] == "month"
    table.overwrite(daily_13)
    assert sorted(table.read().collect()) == sorted(daily_13.collect())


def test_a_broken_write_leaves_the_table(spark, daily_13, tmp_path):
    table = StoredTable(spark, str(tmp_path / "daily")).create(daily_13)
    before = files_of(table)
    with pytest.raises(Exception, match="broken"):
        table.overwrite(daily_13.withColumn("demand", F.when(F.col("demand") > 105, F.raise_error(F.lit("broken")).cast("bigint"))))
    assert files_of(table) == before and table.read().count() == 13


@pytest.mark.parametrize("layout", ["month", "year"])
def test_an_edit_rewrites_only_partitions_from_its_day_on(spark, many, tmp_path, layout):
    rows, daily = many
    keys = ["series_key"]
    table = StoredTable(spark, str(tmp_path / "daily")).create(daily, layout, keys)
    own = sorted(row[1] for row in rows if row[0] == "s6")
    first = own[len(own) // 2]
    edits = ed.one_edit(spark, first, "demand", 5, {"series_key": "s6"}).unionByName(
        ed.one_edit(spark, own[-1], "forecast", 6, {"series_key": "s6"})
    )
    expected = sorted(ed.apply_edits(daily, edits, keys).collect(), key=str)
    before = files_of(table)
    write_edits(table, edits, keys)
    after = files_of(table)
    start = first.strftime("%Y-%m" if layout == "month" else "%Y")
    assert before.keys() == after.keys() and len(before) > 3
    for name in before:
        assert (before[name] == after[name]) == (name.split("=")[1] < start), name
    assert sorted(table.read().collect(), key=str) == expected
    nothing = ed.one_edit(spark, None, "demand", 5, {"series_key": "s6"})
    write_edits(table, nothing, keys)
    assert files_of(table) == after


def test_a_range_prunes_months(spark, daily_13, tmp_path):
    table = StoredTable(spark, str(tmp_path / "daily"))
    table.create(daily_13.unionByName(ed.ensure_column(daily_13, "x", "int").drop("x").selectExpr(
        "add_months(date, 2) as date", "demand", "production_plan", "forecast", "inventory")))
    rows = scans.rows_in_range(table.with_layout(), "2024-03-02", "March 2024")
    assert rows.count() == 0
    rows = scans.rows_in_range(table.with_layout(), "2024-03-02", "05/03/2024")
    assert values(rows.orderBy("date"), "date")[0] == day("2024-03-02") and rows.count() == 4
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_published_rows_come_back(daily_13, tmp_path):
    back = publish_snapshot(daily_13, str(tmp_path / "daily"))
    assert sorted(back.collect()) == sorted(daily_13.collect())


def test_streamed_edits(spark, daily_13, tmp_path):
    folder, check = str(tmp_path / "edits"), str(tmp_path / "check")
    changes = [("2024-01-05", 300), ("2024-01-05", 105), ("2024-01-12", 0)]
    frames = [ed.one_edit(spark, date, "demand", value) for date, value in changes]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
    table = StoredTable(spark, str(tmp_path / "daily")).create(daily_13)
    staged = set(Path(staging.app_folder(spark)).glob("*")) if "://" not in staging.app_folder(spark) else set()

    def run():
        stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1)
        return stream_apply_edits(stream.parquet(folder), table, check)

    expected = [10] * 4 + [20, 30, 40, 50, 60, 70, 80, 202, 212]
    assert values(run().orderBy("date"), "inventory") == expected
    assert table.last_batch(check) == 2 and table.last_batch("other") == -1
    files = files_of(table)
    run()
    assert files_of(table) == files
    # What the batches staged is gone.
    if "://" not in staging.app_folder(spark):
        assert set(Path(staging.app_folder(spark)).glob("*")) == staged


def test_edits_rewrite_only_the_parts_they_touch(spark, many, tmp_path):
    rows, daily = many
    keys = ["series_key"]
    table = StoredTable(spark, str(tmp_path / "daily")).create(daily, "series", keys, 16)
    assert sorted(table.read().collect(), key=str) == sorted(daily.collect(), key=str)
    date = max(row[1] for row in rows if row[0] == "s5")
    change = ed.one_edit(spark, date, "demand", 5, {"series_key": "s5"})
    before = files_of(table)
    write_edits(table, change, keys)
    after = files_of(table)
    assert before.keys() == after.keys()
    assert sum(before[name] != after[name] for name in before) == 1
    expected = sorted(ed.apply_edits(daily, change, keys).collect(), key=str)
    assert sorted(table.read().collect(), key=str) == expected
    stray = ed.one_edit(spark, date, "demand", 5, {"series_key": "nobody"})
    write_edits(table, stray, keys)
    assert sorted(table.read().collect(), key=str) == expected
    # A new series may open a part of its own.
    added = spark.createDataFrame([("new", date, 1, 2, None)], "series_key string, date date, demand bigint, production_plan bigint, forecast bigint")
    table.change(added, lambda held: ed.upsert_daily(held, added, keys))
    assert values(table.read().filter("series_key = 'new'"), "inventory") == [1]
    assert table.read().count() == len(rows) + 1


def test_a_replayed_batch_is_skipped(spark, daily_13, tmp_path):
    folder, check = str(tmp_path / "edits"), str(tmp_path / "check")
    edit = ed.one_edit(spark, "2024-01-05", "demand", 300)
    edit.write.parquet(folder)
    table = StoredTable(spark, str(tmp_path / "daily")).create(daily_13)
    table.note_batch(check, 0)
    out = stream_apply_edits(spark.readStream.schema(edit.schema).parquet(folder), table, check)
    assert values(out.orderBy("date"), "inventory")[-1] == 10
    # Written but not noted: the same edits again give the same table.
    write_edits(table, edit)
    once = sorted(table.read().collect())
    write_edits(table, edit)
    assert sorted(table.read().collect()) == once


def test_short_lived_tables_go(spark, daily_13):
    with pytest.raises(RuntimeError), staging.short_lived(spark):
        made = staging.stage(daily_13, "brief")
        path = made.inputFiles()[0].rsplit("/", 1)[0]
        assert staging.path_exists(spark, path)
        raise RuntimeError("a failing block cleans up as well")
    assert not staging.path_exists(spark, path)
