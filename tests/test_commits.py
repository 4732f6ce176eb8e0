"""Commits, keyed tables and the change log: what is rewritten, what survives a crash, what a replay changes."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from platelake.sources import sinks, workspace
from platelake.sources.commits import Conflict, Files, Versions
from platelake.sources.keyed import ChangeLog, KeyedTable
from platelake.streaming import flows


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def data_files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_commits_appear_whole_and_once(spark, tmp_path):
    versions = Versions(Files(spark, str(tmp_path)))
    assert versions.newest() == (0, None)
    assert versions.commit(0, {"a": "ü"}) == 1 and versions.newest() == (1, {"a": "ü"})
    with pytest.raises(Conflict):
        versions.commit(0, {"a": 2})
    assert versions.newest() == (1, {"a": "ü"})
    for n in range(1, 5):
        versions.commit(n, {"n": n})
    assert versions.forget(2) == [{"n": 3}, {"n": 4}] and versions.numbers() == [4, 5]
    assert not [n for n in os.listdir(tmp_path / "commits") if n.endswith(".tmp")]


def test_an_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    assert table.read() is None
    table.upsert(spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    before = data_files(tmp_path / "t")
    assert len(before) == 8
    table.upsert(spark.createDataFrame([(7, "new")], "k bigint, v string"))
    after = data_files(tmp_path / "t")
    assert len(after - before) == 1 and before <= after  # the version before is kept whole
    assert rows_of(table.read().filter("k in (6, 7)")) == [(6, "old"), (7, "new")] and table.read().count() == 400
    table.upsert(spark.createDataFrame([(7, "newer")], "k bigint, v string"))
    now = data_files(tmp_path / "t")
    assert len(now) == 9 and len(now & before) == 7  # the bucket's first file is swept, the others are the first ones still
    for _ in range(2):  # the same rows again
        table.upsert(spark.createDataFrame([(7, "newer"), (400, "more")], "k bigint, v string"))
    assert table.read().count() == 401 and rows_of(table.read().filter("k = 7")) == [(7, "newer")]


def test_a_crash_between_write_and_switch_leaves_the_table(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"))

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(Versions, "commit", fail)
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([(1, "x")], "k int, v string"))
    monkeypatch.undo()
    assert sorted(table.read().collect(), key=lambda r: r.v) == [(1, "a"), (2, "b"), (None, "n")]
    table.upsert(spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string"))
    assert sorted(r.v for r in table.read().collect()) == ["a", "n", "y", "z"]
    # The lost run's files are gone with the next sweep.
    named = {f for c in table.versions.forget(2) for f in c["folders"].values()}
    assert {os.path.dirname(os.path.relpath(f, tmp_path / "t")) for f in data_files(tmp_path / "t")} == named


def test_versions_new_columns_and_replace(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.upsert(spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, n int, v string"))
    table.upsert(spark.createDataFrame([(2, 6, "c", True), (2, 4, "d", True), (3, 1, "e", False)], "k int, n int, v string, w boolean"), "n")
    assert sorted(((r.k, r.v, r.w) for r in table.read().collect())) == [(1, "a", None), (2, "c", True), (3, "e", False)]
    reader = table.read()
    table.replace(spark.createDataFrame([(9, "only")], "k int, v string"))
    assert rows_of(table.read()) == [(9, "only")] and reader.count() == 3  # a running reader keeps its files
    assert KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=99).buckets == 4
    table.replace(table.read().limit(0))
    assert table.read().count() == 0


def test_change_log_before_and_after_compaction(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ["id"], "seq", "kind = 'erase'", buckets=4)
    schema = "id int, seq int, kind string, email string"
    assert log.read() is None
    log.append(spark.createDataFrame([(1, 10, "set", "a@x"), (2, 10, "set", "b@x"), (3, 10, "set", "c@x")], schema), 0)
    log.append(spark.createDataFrame([(1, 12, "set", "a2@x"), (2, 15, "erase", "b@x"), (1, 11, "set", "no")], schema), 1)
    want = [(1, 12, "set", "a2@x"), (3, 10, "set", "c@x")]
    assert rows_of(log.read()) == want and log.pending() == 2
    log.append(spark.createDataFrame([(1, 12, "set", "a2@x"), (2, 15, "erase", "b@x"), (1, 11, "set", "no")], schema), 1)  # replayed
    assert rows_of(log.read()) == want and log.pending() == 2
    log.compact()
    assert rows_of(log.read()) == want and log.pending() == 0
    raw = spark.read.parquet(*data_files(log.root))
    assert raw.filter("id = 2 AND email IS NOT NULL AND seq = 15").count() == 0  # a tombstone holds no contact data
    log.append(spark.createDataFrame([(2, 14, "set", "late@x"), (3, 9, "set", "late@x"), (4, 1, "set", "d@x")], schema), 2)
    assert rows_of(log.read()) == want + [(4, 1, "set", "d@x")]
    log.compact()
    log.compact()  # nothing to do
    assert rows_of(log.read()) == want + [(4, 1, "set", "d@x")]


def test_read_cost_follows_live_keys(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ["id"], "seq", buckets=4)
    for batch in range(6):
        log.append(spark.range(50).select(F.col("id"), F.lit(batch).alias("seq")), batch)
        log.compact()
    _, state = log.versions.newest()
    assert state["deltas"] == {} and len(state["folders"]) == 4
    assert spark.read.parquet(*[f"{log.root}/{f}" for f in state["folders"].values()]).count() == 50
    assert len(data_files(log.root)) <= 2 * 4 + 8  # two versions of every bucket and the parts of the last folded delta


def test_followed_stream_compacts_and_late_changes_lose(spark, tmp_path):
    feed = str(tmp_path / "feed")
    base = datetime(2026, 1, 1)
    for n in range(5):
        rows = [(i, base + timedelta(hours=(n if i % 2 else 5 - n)), f"{i}-{n}") for i in range(20)]
        spark.createDataFrame(rows, "id int, at timestamp, v string").coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema("id int, at timestamp, v string").option("maxFilesPerTrigger", 1).parquet(feed)
    log = flows.scd1_stream(spark, stream, ["id"], "at", str(tmp_path / "scd"), compact_every=2, buckets=4)
    want = sorted((i, f"{i}-4" if i % 2 else f"{i}-0") for i in range(20))
    assert sorted((r.id, r.v) for r in log.read().collect()) == want and log.pending() == 1
    log.compact()
    assert sorted((r.id, r.v) for r in log.read().collect()) == want
    assert spark.streams.active == []


def events(spark, ids):
    return spark.createDataFrame([("payment", i, 5, datetime(2026, 1, 1)) for i in ids] + [("shift", ids[0], 5, datetime(2026, 1, 1))],
                                 "event_type string, event_id bigint, unit_id bigint, event_ts timestamp")


def test_one_commit_for_several_tables(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    sinks.append_events(events(spark, [1, 2]), root, "b1")

    def fail(*_):
        raise OSError("killed between the tables and the commit")

    monkeypatch.setattr(Files, "write_once", fail)
    with pytest.raises(OSError):
        sinks.append_events(events(spark, [3]), root, "b2")
    monkeypatch.undo()
    count = lambda t: sinks.read_events(spark, root, t).count()
    assert (count("order_events"), count("workforce_events")) == (2, 1)
    sinks.append_events(events(spark, [3]), root, "b2")
    sinks.append_events(events(spark, [1, 2]), root, "b1")  # run again: in place of its first rows
    assert (count("order_events"), count("workforce_events")) == (3, 2)
    assert sorted(r.event_id for r in sinks.read_events(spark, root, "order_events").collect()) == [1, 2, 3]
    assert len(os.listdir(f"{root}/order_events")) == 4
    sinks.sweep_events(spark, root)
    assert len(os.listdir(f"{root}/order_events")) == 2 and count("order_events") == 3


def test_stored_folders_can_be_cleared(spark):
    workspace.clear(spark)
    df = workspace.stored(spark.range(3), "clear-me")
    path = df.inputFiles()[0]
    assert df.count() == 3 and workspace.clear(spark) == 1 and workspace.clear(spark) == 0
    assert not os.path.exists(path.replace("file://", "").replace("file:", ""))
