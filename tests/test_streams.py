"""Streams end with what the batch form of the same operator gives."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from dayledger.functions.checks import record_rules, violations
from dayledger.sources.pointers import catalogue
from dayledger.streaming import results, streams
from tests import records as made

SCHEMA = "id BIGINT, ts TIMESTAMP, key STRING, kind STRING, published TIMESTAMP"


@pytest.fixture(scope="module")
def rows():
    """In order of time; half of the rows belong to one key."""
    rng = random.Random(9)
    now, out = dt.datetime(2024, 1, 1), []
    for i in range(300):
        now += dt.timedelta(minutes=rng.choice([1, 5, 30, 40, 300]))
        key = "hot" if rng.random() < 0.5 else rng.choice("ab")
        out.append((i, now, key, rng.choice("xyz"), now + dt.timedelta(minutes=rng.randrange(120))))
    return out


@pytest.fixture
def arriving(spark, rows, tmp_path):
    """The rows in six files, of which a batch takes two."""
    folder = str(tmp_path / "in")
    for i in range(6):
        part = spark.createDataFrame(rows[i * 50:(i + 1) * 50], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/part={i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).option(
        "recursiveFileLookup", "true"
    ).parquet(folder)


@pytest.fixture
def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted((tuple(r) for r in df.select(*got.columns).collect()), key=repr) for df in (got, want)]
    assert rows[0] == rows[1] != []


@pytest.mark.parametrize("slide", [None, "3 hours"])
def test_arrivals(arriving, batch, slide):
    def counted(df):
        return streams.arrivals(
            df, "ts", "6 hours", {"n": F.count("*"), "last": F.max("id")}, slide, "30 days"
        )

    same(streams.latest_result(counted(arriving)), counted(batch))


def test_finished_windows_are_appended(arriving, batch):
    def counted(df):
        return streams.arrivals(df, "ts", "6 hours", {"n": F.count("*")}, delay="1 hour")

    got, want = streams.append_to_table(counted(arriving)), counted(batch)
    assert got.exceptAll(want).count() == 0
    assert 0 < got.count() < want.count()  # the last windows are still open


def test_sessions(arriving, batch, rows):
    def sessions(df):
        return streams.coverage_sessions(df, "ts", "30 minutes", ["key"], "30 days")

    got = streams.latest_result(sessions(arriving))
    same(got, sessions(batch))
    expected = []
    for key in {r[2] for r in rows}:
        times = [r[1] for r in rows if r[2] == key]
        start = previous = times[0]
        for t in times[1:]:
            if t - previous > dt.timedelta(minutes=30):
                expected.append((key, start))
                start = t
            previous = t
        expected.append((key, start))
    assert sorted((r["key"], r["session_start"]) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("spread", [0, 3])
def test_dedup(arriving, batch, spread):
    twice = arriving.union(arriving)
    got = streams.append_to_table(streams.dedup_stream(twice, "ts", ["id"], "30 days", spread))
    same(got, batch)
    same(streams.dedup_stream(batch.union(batch), "ts", ["id"], "30 days"), batch)


def test_late_rows_are_kept(arriving, batch):
    def split(df):
        return streams.late_split(df, "ts", "published", 3600)

    got = streams.append_to_table(split(arriving))
    same(got, split(batch))
    assert 0 < got.where("is_late").count() < 300


def test_completeness(arriving, batch):
    def complete(df):
        return streams.day_completeness(
            df.withColumn("day", F.to_date("ts")), ["day"], "kind", ["z", "x", "y"]
        )

    got = streams.latest_result(complete(arriving))
    same(got, complete(batch))
    assert {r["seen"] for r in got.where("complete").collect()} == {"x+y+z"}
    assert got.where("NOT complete AND seen = 'x+y+z'").count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, rows, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = spark.readStream.schema(SCHEMA).parquet

    def deliver(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        return streams.append_to_table(
            streams.dedup_stream(stream(folder), "ts", ["id"], "30 days"), out, state
        )

    assert deliver(rows[:100]).count() == 100
    assert deliver(rows[50:200]).count() == 200  # half a part is delivered again


def test_the_last_result_stands_after_a_restart(spark, rows, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        return streams.latest_result(stream.groupBy("key").count(), out, state)

    first = sorted(map(tuple, run().collect()))
    assert first and sorted(map(tuple, run().collect())) == first
    spark.createDataFrame(rows[:10], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert sum(r["count"] for r in run().collect()) == 310


def test_updates_give_the_last_state_and_state_ends(arriving, batch):
    def complete(df):
        return streams.day_completeness(df, ["key"], "kind", ["z", "x", "y"], "ts", "1 hour")

    same(streams.updated_result(complete(arriving), ["key", "day"]), complete(batch))


def test_alarms(spark, arriving, rows):
    """A complete day is told by the batch that completes it, an incomplete one once, when it is over."""
    told = [tuple(r) for r in streams.append_to_table(
        streams.day_alarms(arriving, ["key"], "kind", ["z", "x", "y"], "ts", "1 hour")
    ).collect()]
    days = {}
    for r in rows:
        days.setdefault((r[2], r[1].date()), set()).add(r[3])
    last = max(r[1] for r in rows) - dt.timedelta(hours=1)
    want = []
    for (key, day), seen in days.items():
        over = dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1) < last
        if len(seen) == 3 or over:
            want.append((key, day, "+".join(sorted(seen)), len(seen) == 3))
    assert sorted(told) == sorted(want)
    assert {t[3] for t in told} == {True, False}


def test_alarms_with_nulls_and_in_a_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 5)
    rows = [(1, day, None, "x", None), (2, day, "a", None, None), (3, None, "a", "x", None), (4, day, "a", "q", None),
            (5, day + dt.timedelta(days=9), "a", "x", None), (6, day, None, "y", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = streams.day_alarms(df, ["key"], "kind", ["x", "y"], "ts")
    assert sorted(map(tuple, got.select("key", "day", "seen", "complete").collect()), key=repr) == sorted([
        (None, day.date(), "x+y", True), ("a", day.date(), "", False), ("a", dt.date(2024, 1, 10), "x", False),
    ], key=repr)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    told = streams.append_to_table(streams.day_alarms(stream, ["key"], "kind", ["x", "y"], "ts"))
    assert sorted(map(tuple, told.collect()), key=repr) == sorted([
        (None, day.date(), "x+y", True), ("a", day.date(), "", False),
    ], key=repr)


def test_alarms_keep_the_keys_of_a_day_in_parts(spark, tmp_path):
    """State and calls go by parts of a day, not by key; keys come back as they were."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, day = "id BIGINT, name STRING, ts TIMESTAMP, kind STRING", dt.datetime(2024, 1, 1, 5)
    ids = [None, 0, 2**53 + 1, -(2**63), *range(10, 3000)]
    names = [None, "", "a\nb", '"k1": null', "\u00e9\U0001f600"]
    keys = [(n, names[i % 5]) for i, n in enumerate(ids)]

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        told = streams.day_alarms(stream, ["id", "name"], "kind", ["x", "y"], "ts")
        assert told.dtypes == [("id", "bigint"), ("name", "string"), ("day", "date"), ("seen", "string"), ("complete", "boolean")]
        return sorted(map(tuple, streams.append_to_table(told, out, state).collect()), key=repr)

    assert deliver([(*k, day, "x") for k in keys]) == []
    kept = spark.read.format("statestore").load(state)
    assert 0 < kept.count() < len(keys) / 10
    whole = [(*k, day.date(), "x+y", True) for k in keys[::3]]
    again = [(*k, day, kind) for k in keys[::3] for kind in "yx"]
    assert deliver(again) == sorted(whole, key=repr)
    assert deliver(again) == sorted(whole, key=repr)
    lacking = [(*k, day.date(), "x", False) for i, k in enumerate(keys) if i % 3]
    assert deliver([(None, None, day + dt.timedelta(days=9), "q")]) == sorted(whole + lacking, key=repr)


@pytest.mark.parametrize("of_type", ["DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "DOUBLE", "DECIMAL(38,6)", "BINARY", "BOOLEAN", "STRUCT<p: INT, q: ARRAY<STRING>>"])
def test_alarms_by_keys_of_any_type(spark, tmp_path, of_type):
    values = {
        "DATE": "DATE'1899-12-31'", "TIMESTAMP": "TIMESTAMP'2024-03-31 01:30:00.123456'", "BOOLEAN": "true",
        "TIMESTAMP_NTZ": "TIMESTAMP_NTZ'0999-02-28 23:59:59.999999'", "DOUBLE": "1 / 3D", "BINARY": "X'00FF0A'",
        "DECIMAL(38,6)": "12345678901234567890123456789012.345678BD", "STRUCT<p: INT, q: ARRAY<STRING>>": "struct(1, array('a', null))",
    }
    others = {"DOUBLE": ["DOUBLE('NaN')", "DOUBLE('-Infinity')", "4.9E-324D"], "DATE": ["DATE'+12024-01-01'"]}.get(of_type, [])
    some = ["NULL", values[of_type], *others]
    rows = [f"SELECT CAST({v} AS {of_type}) AS key, TIMESTAMP'{ts}' AS ts, 'x' AS kind" for ts in ("2024-01-01 05:00:00", "2024-01-10 05:00:00") for v in some]
    df = spark.sql(" UNION ALL ".join(rows)).coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    told = streams.append_to_table(streams.day_alarms(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["key"], "kind", ["x", "y"], "ts"))
    want = streams.day_alarms(df, ["key"], "kind", ["x", "y"], "ts").where("day = '2024-01-01'")
    assert told.select(*want.columns).exceptAll(want).count() == 0
    assert told.count() == want.count() == len(some)


def table_of(spark, out, keys=("k",)):
    schema = spark.range(0).selectExpr("CAST(id AS INT) AS k", "'' AS v").schema
    return results.ResultTable(spark, str(out), schema, list(keys))


def changed(spark, rows):
    return spark.createDataFrame(rows, "k INT, v STRING").coalesce(1)


def test_a_result_after_many_batches(spark, tmp_path, monkeypatch):
    """Reading touches one base and the later batches, whatever the number of batches."""
    monkeypatch.setattr(results, "COMPACT", 5)
    rng, result, want = random.Random(3), table_of(spark, tmp_path / "r"), {}
    assert result.read().count() == 0
    for number in range(32):
        rows = [(rng.randrange(12), f"{number}") for _ in range(3)]
        rows = list(dict(rows).items())
        want.update(rows)
        result.write(changed(spark, rows), number)
        if number in (3, 4, 17, 31):
            assert dict(map(tuple, result.read().collect())) == want
    folders = {f.split("/")[-2] for f in result.read().inputFiles()}
    assert folders == {"base=29", "batch=30", "batch=31"}
    assert result.versions() == [24, 29] and min(result.batches()) > 24


def test_a_repeated_batch_replaces_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "COMPACT", 2)
    result = table_of(spark, tmp_path / "r")
    result.write(changed(spark, [(1, "a"), (2, "a")]), 0)
    result.write(changed(spark, [(1, "half")]), 1)
    assert result.versions() == [1]
    # The batch comes again after its base was committed, then a batch that failed on its way.
    result.write(changed(spark, [(1, "half")]), 1)
    result.write(changed(spark, [(2, "b"), (None, "n")]), 2)
    result.write(changed(spark, [(2, "b"), (None, "n")]), 2)
    os.makedirs(tmp_path / "r" / "batch=3")
    assert sorted(map(tuple, result.read().collect()), key=repr) == [(1, "half"), (2, "b"), (None, "n")]


def test_another_stream_is_refused(spark, rows, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder).groupBy("key").count()
    first = sorted(map(tuple, streams.updated_result(stream, ["key"], out, state).collect()))
    assert sorted(map(tuple, streams.updated_result(stream, ["key"], out, state).collect())) == first != []
    with pytest.raises(ValueError, match="another stream"):
        streams.updated_result(stream, ["key"], out, str(tmp_path / "other"))


def test_pointer_stream(spark, tmp_path):
    root, late = str(tmp_path / "v1.1"), str(tmp_path / "late")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    written = made.write_tree(root)

    def run():
        return streams.append_to_table(
            streams.stream_pointers(spark, root, files_per_batch=5), out, state
        )

    same(run(), catalogue(spark, root))
    name = "20120303_notice.csv"
    path = made.write_record(late, "20120303", made.record(name))
    folder = os.path.dirname(path).replace(late, root)
    os.makedirs(folder)
    shutil.copy(path, folder)
    records = run()
    assert records.count() == len(written) + 1
    assert records.where(F.col("out.path") == name).count() == 1
    assert violations(records, record_rules(), ["file_path"]).count() == 0


def test_pointer_stream_by_kind(spark, tmp_path):
    root = str(tmp_path / "v1.1")
    written = made.write_tree(root)
    traces = streams.append_to_table(streams.stream_pointers(spark, root, ["trace"]))
    assert {r["path"] for r in traces.select("out.path").collect()} == {n for n in written if n.endswith(".gz")}


@pytest.mark.parametrize("as_folder", [False, True])
def test_stream_table(spark, batch, tmp_path, as_folder):
    folder = str(tmp_path)
    if as_folder:
        batch.repartition(3).write.parquet(f"{folder}/rows.parquet")
    else:
        batch.coalesce(1).write.parquet(f"{folder}/tmp")
        (part,) = [f for f in os.listdir(f"{folder}/tmp") if f.endswith(".parquet")]
        shutil.copy(f"{folder}/tmp/{part}", f"{folder}/rows.parquet")
    same(streams.append_to_table(streams.stream_table(spark, folder, "rows")), batch)
