"""Golden tests: fuzzy match levels, exact ranks, metrics, streaming = batch."""

import math
import uuid

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from limnos.operators import history as H
from limnos.operators import ml as ML
from limnos.operators import profile as P
from tests.conftest import SMOKE

BASE_SCHEMA = "state_name string, river_name string, parameter string, median double, min double, max double"
CUR_SCHEMA = ("station_name string, river_name string, state_name string, dissolved_oxygen double, bod double, "
              "ph double, temperature double, conductivity double")


def test_fuzzy_levels(spark):
    base = spark.createDataFrame([
        ("Assam", "Brahmaputra Main", "ph", 7.0, 6.0, 8.0),
        ("Karnataka", "Kaveri", "ph", 7.5, 7.0, 8.0),
        ("Goa", "Mandovi Estuary", "ph", 7.2, 7.0, 7.4),
        ("Kerala", "Periyar", "ph", 7.1, 7.0, 7.2),
    ], BASE_SCHEMA)
    cur = spark.createDataFrame([
        ("S1 Brahmaputra", "Brahmaputra Main", "Assam", None, None, 8.5, None, None),   # L1 river + state
        ("S2 Kaveri", "Kaveri", "Tamil Nadu", None, None, 6.9, None, None),            # L2 river only
        ("Mandovi bridge", None, "Maharashtra", None, None, 7.3, None, None),          # L3 station -> river
        ("S4 tank", "Unknown creek", "Kerala", None, None, 7.0, None, None),           # L4 state only
        ("S5 nowhere", "Zzz", "Nowhere", None, None, 7.0, None, None),                 # sentinel
    ], CUR_SCHEMA)
    out = {r["station_name"]: r for r in H.hist_fuzzy(cur, base).collect()}
    assert out["S1 Brahmaputra"]["attempted_match_level"] == "river_state"
    assert out["S1 Brahmaputra"]["match_confidence"] == "Medium"
    assert "EXCEEDS historical max=8.00" in out["S1 Brahmaputra"]["context_note"]
    assert out["S2 Kaveri"]["attempted_match_level"] == "river_only"
    assert out["Mandovi bridge"]["attempted_match_level"] == "station_to_river_fuzzy"
    assert out["S4 tank"]["attempted_match_level"] == "state_only"
    assert out["S4 tank"]["match_confidence"] == "Very Low"
    assert out["S5 nowhere"]["attempted_match_level"] == "no_reliable_match"


def test_exact_levels(spark):
    base = spark.createDataFrame([("Assam", "Brahmaputra", "ph", 7.0, 6.0, 8.0),
                                  ("Kerala", "Periyar", "ph", 7.1, 7.0, 7.2)], BASE_SCHEMA)
    cur = spark.createDataFrame([("A", "Brahmaputra", "Assam", None, None, 8.5, None, None),
                                 ("B", "Brahmaputra", "Goa", None, None, 6.0, None, None),
                                 ("C", "Other", "Kerala", None, None, 7.5, None, None)], CUR_SCHEMA)
    out = {r["station_name"]: r for r in H.hist_exact(cur, base).collect()}
    assert out["A"]["match_level"] == "river_state"
    assert out["A"]["historical_context"] == ("ph current=8.50 vs historical median=7.00 (above); "
                                              "WARNING: ph current=8.50 exceeds historical max=8.00")
    assert out["B"]["match_level"] == "river_only"
    assert out["C"]["match_level"] == "state_only"


def test_rank_table_is_exact(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 5.0, 5.0, 0.5, 9.0] * 7
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["x"]: r["_rank"] for r in P.rank_table(df, "x", buckets=4).collect()}
    want = pd.Series(vals).rank(method="average")
    for v, r in zip(vals, want):
        assert math.isclose(got[v], r)


def test_metrics_and_auc(spark):
    rows = [(1, 1.0, 0.9), (1, 0.0, 0.4), (0, 0.0, 0.4), (0, 1.0, 0.6), (0, 0.0, 0.1), (1, 1.0, 0.8)]
    df = spark.createDataFrame(rows, "target int, prediction double, score double")
    m = ML.metrics(df).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (2, 1, 2, 1)
    assert math.isclose(m["precision"], 2 / 3) and math.isclose(m["recall"], 2 / 3)
    # positives 0.9, 0.4, 0.8 vs negatives 0.4, 0.6, 0.1: wins 3 + 0.5 + 1 + 3 -> 7.5 / 9
    assert math.isclose(m["roc_auc"], 7.5 / 9)


def _tables(spark, drop, max_files):
    from limnos.sources import files as FS
    from limnos.streaming import live as ST
    from limnos.streaming import stale as SL
    paths = ST.run_live(spark, drop, FS.scratch_path(spark, "test", uuid.uuid4().hex), max_files=max_files)
    state = ST.current_state(spark, paths).select("station_id", "parameter", "latest_timestamp", "latest_value", "latest_value_text")
    stale = SL.current_stale(spark, SL.run_stale(spark, drop, paths["out"], max_files=max_files))
    parts = (ST.readings(spark, paths).select("event_id"), state, ST.current_alerts(spark, paths), stale)
    return [sorted(map(str, p.collect())) for p in parts]


@pytest.mark.parametrize("writers,max_files,reverse", [(1, 10, False), (8, 1000, False), (8, 10, False), (8, 7, True)])
def test_stream_equals_batch_in_any_order(spark, writers, max_files, reverse):
    """A feed of one or eight writers, in the order of time or against it, in batches of any size."""
    from limnos.operators import live as LV
    from limnos.sources import bindings as B
    from limnos.sources import files as FS
    feed = B.live_feed(spark, SMOKE)
    order = F.col("timestamp").desc() if reverse else F.xxhash64("event_id") if writers > 1 else F.col("timestamp")
    drop = FS.scratch_path(spark, "test", uuid.uuid4().hex)
    for k in range(6):  # deliveries one after the other
        part = feed.withColumn("part", F.ntile(6).over(Window.orderBy(order))).where(F.col("part") == k + 1).drop("part")
        part.repartition(writers).write.mode("append").option("timestampNTZFormat", FS.TS_FORMAT).json(drop)
    again = feed.orderBy("event_id").limit(50)  # delivered twice
    again.coalesce(1).write.mode("append").option("timestampNTZFormat", FS.TS_FORMAT).json(drop)
    log, state, alerts, stale = _tables(spark, drop, max_files)
    r = LV.ingest(feed)
    import __spark_entry__ as E
    q = E.queries()
    assert log == sorted(map(str, r.select("event_id").collect()))
    assert state == sorted(map(str, q["win_latest"](spark, SMOKE).collect()))
    assert alerts == sorted(map(str, q["alr_live"](spark, SMOKE).collect()))
    times = r.select("station_id", "timestamp").distinct().toPandas().sort_values(["station_id", "timestamp"])
    gap = times.groupby("station_id")["timestamp"].shift(-1).fillna(times["timestamp"].max()) - times["timestamp"]
    assert len(stale) == int((gap > pd.Timedelta(hours=24)).sum()) > 0


def _drop(spark, drop, rows):
    """One file of (event_id, station, hours) readings; its name has the delivery's number."""
    from limnos.sources import files as FS
    from limnos.sources.files import LIVE_SCHEMA
    start = pd.Timestamp("2024-03-01 00:30:00")
    data = [(k, s, None, None, None, None, None, "pH", (start + pd.Timedelta(hours=h)).to_pydatetime(), "7.0", None) for k, (s, h) in enumerate(rows)]
    spark.createDataFrame(data, LIVE_SCHEMA).coalesce(1).write.mode("append").option("timestampNTZFormat", FS.TS_FORMAT).json(drop)


def _silences(rows):
    """Silences of all readings, as (station, from hour, to hour or None)."""
    out, now = set(), max(h for _, h in rows)
    for s in {s for s, _ in rows}:
        times = sorted({h for x, h in rows if x == s})
        out |= {(s, a, b) for a, b in zip(times, times[1:]) if b - a > 24}
        out |= {(s, times[-1], None)} if now - times[-1] > 24 else set()
    return out


def test_timers_open_and_late_readings_withdraw(spark):
    """After each delivery, with a restart from the checkpoint in between, the alerts are those of all readings so far."""
    from limnos.sources import files as FS
    from limnos.streaming import stale as SL
    drop, out = FS.scratch_path(spark, "test", uuid.uuid4().hex), FS.scratch_path(spark, "test", uuid.uuid4().hex)
    start, seen = pd.Timestamp("2024-03-01 00:30:00"), []
    deliveries = [
        [(1, 0), (2, 0), (3, 5)],
        [(2, 40), (3, 20)],                          # station 1 is silent since 0; 2 has a closed silence, 3 none yet
        [(1, 10), (3, 60)],                          # a late reading moves the open silence of 1; 3 has a closed one
        [(2, 20), (1, 30)],                          # late readings withdraw the silence of 2 and split that of 1
        [(1, 100), (4, 2), (4, 90), (3, 41)],        # new station with readings of the past; part of 3's silence is filled
        [(2, 41), (2, 64), (2, 88), (1, 30), (1, 53.75), (1, 77)],
    ]
    for rows in deliveries:
        _drop(spark, drop, rows)
        seen += rows
        log = SL.run_stale(spark, drop, out)
        got = {(r.station_id, r.latest_timestamp, r.next_timestamp) for r in SL.current_stale(spark, log).collect()}
        at = lambda h: None if h is None else (start + pd.Timedelta(hours=h)).to_pydatetime()
        assert got == {(s, at(a), at(b)) for s, a, b in _silences(seen)}, rows


class _Counted(dict):
    """State of one station in memory, with the number of accesses."""

    def __init__(self):
        self.used, self.value, self.timers = 0, None, set()

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return type("Value", (), {"get": lambda _: self.value, "update": lambda _, v: setattr(self, "value", v)})()

    def getValue(self, key):
        self.used += 1
        return self.get(key)

    def containsKey(self, key):
        self.used += 1
        return key in self

    def updateValue(self, key, value):
        self.used += 1
        self[key] = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_batch_reads_and_writes_chunks_of_days():
    """State accesses follow the chunks of days that a batch touches, and neither its days nor the length of a silence."""
    from collections import namedtuple

    from limnos.streaming import stale as SL
    Reading, day = namedtuple("Reading", "day at"), SL.DAY_MICROS
    state, station = _Counted(), SL.Silences()
    station.init(state)
    days = [d for d in range(0, 60) if d % 7]
    assert list(station.handleInputRows((1,), iter(Reading(d, d * day + 5) for d in days), None)) != [] and state.used <= 4
    state.used = 0
    found = list(station.handleInputRows((1,), iter([Reading(900, 900 * day + 5), Reading(7, 7 * day + 5)]), None))
    assert state.used <= 20 and state.timers == {(901 * day + 5) // 1000}
    assert {(r.latest // day, r.next // day, r.live) for r in found} == {(59, 900, True), (6, 7, False)}


def test_batches_hold_bytes(spark):
    """Many small files are one batch where a batch may hold their bytes, and the answer is the same."""
    from limnos.sources import files as FS
    from limnos.streaming import live as ST
    from limnos.streaming import stale as SL
    drop, outs, seen = FS.scratch_path(spark, "test", uuid.uuid4().hex), [], []
    for k in range(6):
        _drop(spark, drop, [(1, 30 * k), (2, 5 * k)])
        seen += [(1, 30 * k), (2, 5 * k)]
    got = []
    for batch_bytes, epochs in ((0, 3), (1 << 20, 1)):
        outs.append(FS.scratch_path(spark, "test", uuid.uuid4().hex))
        paths = ST.run_live(spark, drop, outs[-1], max_files=2, parts=("readings",), batch_bytes=batch_bytes)
        assert len(spark.read.parquet(paths["readings"]).select("epoch").distinct().collect()) == epochs
        got.append(sorted(map(str, SL.current_stale(spark, SL.run_stale(spark, drop, outs[-1], 2, batch_bytes)).collect())))
    assert got[0] == got[1] and len(got[0]) == len(_silences(seen))


def test_changes_of_a_batch_follow_the_batch(spark):
    """After a large delivery a small one writes a small epoch; an epoch written again changes nothing; bases take over."""
    from limnos.sources import files as FS
    from limnos.sources.versions import ChangeLog
    from limnos.streaming import live as ST
    drop, out = FS.scratch_path(spark, "test", uuid.uuid4().hex), FS.scratch_path(spark, "test", uuid.uuid4().hex)
    seen = [(s, h) for s in range(300) for h in (0, 7)]
    _drop(spark, drop, seen)
    paths = ST.run_live(spark, drop, out, parts=("state", "stations"))
    for k in range(3):
        new = [(5, 10 + k), (7, 3)]
        seen += new
        _drop(spark, drop, new)
        ST.run_live(spark, drop, out, parts=("state", "stations"))
    log = ST.logs(spark, out)["state"]
    assert [spark.read.parquet(log._at("epoch", e)).count() for e in log._folders("epoch")] == [300, 2, 2, 2] and log._folders("base") == []
    start = pd.Timestamp("2024-03-01 00:30:00")
    newest = {s: max(h for x, h in seen if x == s) for s, _ in seen}
    rows = ST.current_state(spark, paths).collect()
    assert {r.station_id: r.latest_timestamp for r in rows} == {s: start + pd.Timedelta(hours=h) for s, h in newest.items()} and len(rows) == 300
    last = log._folders("epoch")[-1]
    before = sorted(map(str, rows))
    same = spark.read.parquet(log._at("epoch", last)).drop("_epoch")
    log.append(spark.createDataFrame(same.collect(), same.schema), last)
    log.most = 1
    log.compact(last)  # all but the last epoch become a base
    assert log._folders("base") == [last - 1] and log._folders("epoch") == [last]
    log.append(log.read().limit(0), 0)  # an epoch that the base has
    assert sorted(map(str, ST.current_state(spark, paths).collect())) == before
    small = ChangeLog(spark, FS.scratch_path(spark, "test", uuid.uuid4().hex), ["k"], least=0)
    for e in range(12):  # as many rows as there are keys, again and again: merged into bases, nothing lost
        small.append(spark.range(50).select(F.col("id").alias("k"), (F.col("id") + e).alias("v")).where(f"k % 4 = {e % 4}"), e)
    assert {r.k: r.v for r in small.read().collect()} == {k: k + 8 + k % 4 for k in range(50)}
    assert len(small._folders("base")) <= 2 and len(small._folders("epoch")) < 12


def test_versioned_table(spark):
    """A reader has one whole version while others are written; old versions and stagings go; the first of two writers wins."""
    from limnos.sources import files as FS
    from limnos.sources.versions import VersionedTable, _names
    path = FS.scratch_path(spark, "test", uuid.uuid4().hex)
    table = VersionedTable(spark, path)
    assert table.current() is None
    table.write(spark.range(10).withColumn("p", F.col("id") % 2), partition_by="p")
    reader = table.read()
    staged = table.stage(lambda p: spark.range(20).write.parquet(p))
    assert table.read().count() == reader.count() == 10  # staged, not published
    table.publish(staged)
    assert table.read().count() == 20 and reader.count() == 10  # the version before is still there
    for n in (30, 40):
        table.write(spark.range(n))
    assert table.read().count() == 40 and [v for v, _ in table.versions()] == [3, 4]
    assert sum(n.startswith("data.") for n in _names(spark, path)) == 2
    first = VersionedTable(spark, FS.scratch_path(spark, "test", uuid.uuid4().hex))
    a, b = (first.stage(lambda p, n=n: spark.range(n).write.parquet(p)) for n in (1, 2))
    assert first.publish(a, first_only=True) == first.publish(b, first_only=True) == a and first.read().count() == 1
    assert sum(n.startswith("data.") for n in _names(spark, first.path)) == 1


def test_changed_code_gives_new_tables(tmp_path):
    import pathlib
    import shutil

    import limnos
    from limnos.plans import datasets as D
    root = pathlib.Path(limnos.__file__).parent
    shutil.copytree(root, tmp_path / "limnos", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    assert D.code_key(tmp_path / "limnos") == D.code_key(root) == D._code_key()
    for name in ("constants.py", "operators/labels.py", "functions/rules.py", "operators/ml.py", "plans/queries_ml.py"):
        before = D.code_key(tmp_path / "limnos")
        (tmp_path / "limnos" / name).write_text((root / name).read_text() + "\nX = 1\n")
        assert D.code_key(tmp_path / "limnos") != before
