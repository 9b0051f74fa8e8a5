"""Sources and sinks."""

import gzip
import hashlib
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayledger.operators import joins
from dayledger.plans.catalogue import day_report, verify_archive, yearly_volume
from dayledger.sources import labels, payloads, pointers
from tests import records as made

HEADER = (
    "anomalyID, srcIP, srcPort, dstIP, dstPort, taxonomy, heuristic, distance, nbDetectors, label\n"
)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree") / "v1.1")
    return root, made.write_tree(root)


def test_scan_by_kind(spark, tree):
    root, written = tree
    assert pointers.scan_pointers(spark, root).count() == len(written)
    for kinds in (["notice_csv"], ["notice_xml", "trace"], ["anomalous_csv", "anomalous_xml"]):
        rows = pointers.catalogue(spark, root, kinds).select("kind", "out.path").collect()
        wanted = {n for n in written for k in kinds if made.names_of(n[:8])[k] == n}
        assert {r["path"] for r in rows} == wanted
        assert {r["kind"] for r in rows} == set(kinds)


def test_catalogue_copy(spark, tree, tmp_path):
    root, written = tree
    records = pointers.catalogue(spark, root)
    out = str(tmp_path / "copy")
    pointers.write_catalogue(records, out)
    copy = spark.read.parquet(out)
    assert copy.select(*records.columns).exceptAll(records).count() == 0
    assert copy.count() == len(written)
    assert sorted(d for d in os.listdir(out) if d.startswith("year=")) == ["year=2010", "year=2011", "year=2012"]
    by_day = pointers.in_range(copy, "2011-01-01", "2011-12-31")
    plan = by_day._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert by_day.count() == len([n for n in written if n.startswith("2011")])


def test_increments_by_day(spark, tmp_path):
    """Days are replaced, records delivered again change nothing, other days' files stay as they are."""
    out = str(tmp_path / "copy")
    schema = "year INT, month INT, day INT, file_path STRING, published INT, size INT, tie STRING"

    def deliver(*rows):
        df = spark.createDataFrame(rows, schema)
        return sorted(map(tuple, pointers.merge_days(df, out, ["file_path"], "published", "tie").collect()))

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
                for d, _, names in os.walk(out) for f in names if f.endswith(".parquet")}

    first = [(2011, 1, 5, "a", 1, 10, "x"), (2011, 1, 5, "b", 1, 20, "x"), (2012, 3, 1, "c", 1, 30, "x")]
    assert deliver(*first) == sorted(first)
    before = files()
    again = [(2011, 1, 5, "a", 1, 10, "x"), (2011, 1, 5, "b", 1, 20, "x")]
    assert deliver(*again) == sorted(first)
    untouched = {f: t for f, t in before.items() if "year=2012" in f}
    assert untouched and untouched.items() <= files().items()
    # A later record replaces its key, an older one does not, equal ones go by the tie; a new day joins.
    news = [(2011, 1, 5, "a", 2, 11, "w"), (2011, 1, 5, "b", 0, 99, "z"), (2011, 1, 5, "b", 1, 21, "y"), (2013, 1, 1, "d", 1, 1, "x")]
    want = [news[0], news[2], first[2], news[3]]
    assert deliver(*news) == sorted(want)
    assert untouched.items() <= files().items()


def test_record_texts_by_day(spark, tree, tmp_path):
    root, written = tree
    out = str(tmp_path / "texts")
    pointers.write_pointers(pointers.catalogue(spark, root), out)
    assert os.path.isdir(f"{out}/year=2011/month=01/day=05")
    lines = spark.read.text(out).where("value LIKE 'md5: %'")
    assert {r[0][5:] for r in lines.select("value").collect()} == {made.stage_md5(v) for v in written.values()}


def test_written_texts_scan_back(spark, tree, tmp_path):
    """All records of a day in one file, of three layouts, come back as they were."""
    root, written = tree
    records = pointers.catalogue(spark, root)
    out = str(tmp_path / "v1.1")
    pointers.write_pointers(records.coalesce(1), out)
    back = pointers.catalogue(spark, out, suffix=".txt")
    same = [c for c in records.columns if c != "file_path"]
    assert back.count() == len(written)
    assert back.select(*same).exceptAll(records.select(*same)).count() == 0
    some = pointers.DataLoader(spark, out, ".txt").load("2010-12-31", "2011-01-06", kinds=["trace"])
    assert {r[0] for r in some.select("out.path").collect()} == {
        n for n in written if n.endswith(".gz") and "20101231" <= n[:8] <= "20110106"
    }


def test_records_with_another_suffix_and_odd_folders(spark, tmp_path):
    root = tmp_path / "a b%20c+d" / "v1.1"
    path = made.write_record(str(root), "20110105", made.record("20110105_notice.csv"))
    os.rename(path, path.replace(".dvc", ".rec"))
    (row,) = pointers.catalogue(spark, str(root).replace("%", "[%]"), suffix=".rec").collect()
    assert (row["kind"], row["format"], str(row["capture_date"])) == ("notice_csv", "csv", "2011-01-05")
    assert row["file_path"].endswith("/a b%20c+d/v1.1/year=2011/month=01/day=05/20110105_notice.csv.rec")


def test_one_of_two_versions(spark, tmp_path):
    for version, days in (("v1.0", ["20101231", "20110105"]), ("v1.1", ["20110105", "20110207", "20120101"])):
        for day in days:
            for name in ("notice.csv", "anomalous_suspicious.xml"):
                made.write_record(str(tmp_path / version), day, made.record(f"{day}_{name}"))
    loader = pointers.DataLoader(spark, str(tmp_path))
    assert loader.load("2010-01-01", "2012-12-31").count() == 10
    got = loader.load("2011-01-01", "2011-12-31", kinds=["notice_csv"], version="v1.1")
    assert sorted((r["version"], str(r["capture_date"])) for r in got.collect()) == [
        ("v1.1", "2011-01-05"), ("v1.1", "2011-02-07"),
    ]
    listed = {f.split("/")[-4:][0] for f in got.inputFiles()}
    assert listed == {"year=2011"} and all("v1.1" in f for f in got.inputFiles())
    assert loader.load("1999-01-01", "1999-12-31").count() == 0
    assert loader.load("2011-01-01", "2011-12-31", version="v9").count() == 0


def test_folders_of_a_range():
    import datetime as dt

    def folders(a, b):
        return pointers.folders_of(dt.date.fromisoformat(a), dt.date.fromisoformat(b))

    assert folders("2011-01-01", "2012-12-31") == ["year=2011", "year=2012"]
    assert folders("2011-01-30", "2011-03-01") == [
        "year=2011/month=01/day=30", "year=2011/month=01/day=31", "year=2011/month=02",
        "year=2011/month=03/day=01",
    ]
    assert folders("2011-01-02", "2011-01-01") == []


def test_a_record_of_no_kind_lacks_all(spark):
    rows = spark.createDataFrame(
        [(2011, 1, 5, "2011-01-05", None, 7)], "year INT, month INT, day INT, d STRING, kind STRING, size BIGINT"
    ).selectExpr("year", "month", "day", "date(d) AS capture_date", "kind", "struct(size) AS out")
    (row,) = day_report(rows, "2011-01-05", "2011-01-05").collect()
    assert len(row["lacks"]) == 5 and row["files"] == 1


def test_archive_paths_that_lie_elsewhere(spark):
    records = spark.createDataFrame(
        [("file:/r/no%tice a.csv.dvc", 1, "m"), ("/r/x/b.csv.dvc", 1, "m"), ("/else/c.csv.dvc", 1, "m")],
        "file_path STRING, size BIGINT, md5 STRING",
    ).selectExpr("file_path", "struct(size, md5, regexp_extract(file_path, '([^/]*).dvc$', 1) AS path) AS out")
    files = spark.createDataFrame(
        [("file:/s/no%tice a.csv", 1), ("hdfs://h:1/s/x/b.csv", 1), ("/s/d.csv", 1)], "path STRING, length BIGINT"
    )
    got = verify_archive(records, files, "file:///r", "/s/")
    assert {(r["path"], r["status"]) for r in got.collect()} == {
        ("no%tice a.csv", "ok"), ("x/b.csv", "ok"), ("/else/c.csv.dvc"[:-4], "missing"), ("d.csv", "untracked"),
    }


def test_day_report(spark, tree):
    root, written = tree
    rows = {str(r["capture_date"]): r for r in day_report(
        pointers.catalogue(spark, root), "2010-12-30", "2011-01-07"
    ).collect()}
    assert len(rows) == 9
    assert rows["2011-01-02"]["files"] == 0 and len(rows["2011-01-02"]["lacks"]) == 5
    assert rows["2011-01-05"]["lacks"] == ["notice_csv", "notice_xml", "anomalous_xml"]
    assert rows["2011-01-01"]["lacks"] == []
    day = [v for n, v in written.items() if n.startswith("20110105")]
    assert rows["2011-01-05"]["bytes"] == sum(v["out_size"] for v in day)


def test_yearly_volume(spark, tree):
    root, written = tree
    rows = yearly_volume(pointers.catalogue(spark, root)).collect()
    (total,) = [r for r in rows if r["level"] == 3]
    assert (total["files"], total["bytes"]) == (len(written), sum(v["out_size"] for v in written.values()))


@pytest.fixture
def payload_files(tmp_path):
    root = tmp_path / "payloads"
    contents = {
        "a/one.csv": b"x" * 10, "a/two.csv": b"", "b/three.xml": os.urandom(100_000), "b/extra.bin": b"?",
        "top.csv": b"", "b/c/deep.csv": b"",
    }
    for name, content in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root), contents


def short(df, root):
    return {r["path"].split(root + "/")[1]: r for r in df.collect()}


def test_inventory(spark, payload_files):
    root, contents = payload_files
    rows = short(payloads.scan_payloads(spark, root), root)
    assert {n: r["length"] for n, r in rows.items()} == {n: len(c) for n, c in contents.items()}
    assert set(short(payloads.scan_payloads(spark, root, "*.csv"), root)) == {
        "a/one.csv", "a/two.csv", "top.csv", "b/c/deep.csv",
    }


def test_digests(spark, payload_files):
    root, contents = payload_files
    expected = {n: hashlib.md5(c).hexdigest() for n, c in contents.items()}
    both = payloads.payload_digests(spark, root)
    assert {n: r["md5"] for n, r in short(both, root).items()} == expected
    assert both.count() == len(contents)
    some = payloads.digest_files(both.where("length > 50"), tasks=2)
    assert {r["md5"] for r in some.collect()} == {expected["b/three.xml"]}


def test_inventory_of_odd_names_and_hidden_folders(spark, tmp_path):
    names = ["a b/c%20d/e+f.csv", "a b/empty.csv", "deep/1/2/3/x.csv", "ü.csv"]
    for name in [*names, "_temporary/0/x.csv", ".stage/empty.csv", "a b/_SUCCESS"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"abc")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        rows = short(payloads.scan_payloads(spark, root, "*.csv"), str(tmp_path))
        assert set(rows) == set(names)
        digests = short(payloads.payload_digests(spark, root, "*.csv"), str(tmp_path))
        assert digests["a b/c%20d/e+f.csv"]["md5"] == hashlib.md5(b"abc").hexdigest()


def test_a_flat_folder_is_many_rows(spark, tmp_path, monkeypatch):
    """20,000 files in one folder: pages of rows, lengths looked up in at least eight tasks."""
    folder = tmp_path / "flat"
    folder.mkdir()
    for i in range(20_000):
        (folder / f"{i}.csv").touch()
    (folder / "7.csv").write_bytes(b"seven")
    files = payloads.scan_payloads(spark, str(folder))
    tasks = files.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 20_000 and len(tasks) >= 8
    assert max(r["n"] for r in tasks) < 5000
    assert files.agg(F.sum("length")).first()[0] == 5
    pages = [len(p) for p in payloads.lister(False)(iter([pd.DataFrame({"path": [str(folder)]})]))]
    assert max(pages) == payloads.PAGE and sum(pages) == 20_000


def test_deep_and_wide_folders(spark, tmp_path, monkeypatch):
    """Many folders are walked whole, few are listed level by level; both find the same files."""
    names = {f"y{i % 9}/m{i % 5}/d{i}/{i}.csv" for i in range(90)} | {"a.csv", "y1/b.csv", "y1/m1/c.csv"}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "y1/empty").mkdir()
    for wide in (1, 5, 20, 1000):
        monkeypatch.setattr(payloads, "WIDE", wide)
        rows = short(payloads.scan_payloads(spark, str(tmp_path)), str(tmp_path))
        assert {n: r["length"] for n, r in rows.items()} == {n: len(n) for n in names}
    assert payloads.scan_payloads(spark, str(tmp_path / "none")).count() == 0


def loads(spark, lengths, tasks):
    files = spark.createDataFrame([(f"/f{i}", n) for i, n in enumerate(lengths)], "path STRING, length BIGINT")
    dealt = payloads.dealt_by_length(files, tasks)
    got = dealt.groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum("length").alias("bytes"), F.count("*").alias("n")
    ).collect()
    assert sum(r["n"] for r in got) == len(lengths)
    return [r["bytes"] or 0 for r in got]


def test_files_are_dealt_by_their_length(spark):
    rng = random.Random(5)
    outliers = [15_062_156_019, 14_000_000_000, 9_000_000_000, 4_000_000_000]
    for lengths in (
        outliers + [int(rng.lognormvariate(17, 2)) for _ in range(3000)],
        outliers + [93] * 5000, [5] * 1000, [0] * 50 + [1], [int(2 ** (i / 9)) for i in range(300)],
    ):
        for tasks in (1, 7, 40):
            most = max(loads(spark, lengths, tasks))
            assert most <= 1.2 * max(sum(lengths) / tasks, max(lengths)) + 1


def test_unknown_lengths_and_no_files(spark):
    assert loads(spark, [None, 4, None], 2)
    none = spark.createDataFrame([], "path STRING, length BIGINT")
    assert payloads.digest_files(none, 3).count() == 0


def test_a_file_above_two_gibibytes(spark, tmp_path):
    path, size = tmp_path / "sparse.gz", 2**31 + 5
    with open(path, "wb") as f:
        f.truncate(size)
    (tmp_path / "small.gz").write_bytes(b"small")
    rows = short(payloads.payload_digests(spark, str(tmp_path)), str(tmp_path))
    want = hashlib.md5()
    for _ in range(2**11):
        want.update(bytes(2**20))
    want.update(bytes(5))
    assert (rows["sparse.gz"]["length"], rows["sparse.gz"]["md5"]) == (size, want.hexdigest())
    assert rows["small.gz"]["md5"] == hashlib.md5(b"small").hexdigest()


def test_compressed_files_are_digested_as_they_are(spark, tmp_path):
    for name in ("a.gz", "a.bz2", "a.zst"):
        (tmp_path / name).write_bytes(gzip.compress(b"content") if name == "a.gz" else b"no such stream")
    rows = short(payloads.payload_digests(spark, str(tmp_path)), str(tmp_path))
    for name in rows:
        assert rows[name]["md5"] == hashlib.md5((tmp_path / name).read_bytes()).hexdigest()
    assert len(rows) == 3


def test_block_reads_cover_long_files(tmp_path, monkeypatch):
    content = os.urandom(1_000_003)
    path = tmp_path / "long"
    path.write_bytes(content)
    monkeypatch.setattr(payloads, "BLOCK", 1000)
    assert payloads.file_md5(f"file://{path}") == hashlib.md5(content).hexdigest()


def test_verify(spark):
    catalogue = spark.createDataFrame(
        [("ok", 1, "a"), ("gone", 1, "a"), ("short", 9, "a"), ("changed", 1, "a"), ("unread", 1, "a")],
        "path STRING, size BIGINT, md5 STRING",
    )
    files = spark.createDataFrame(
        [("ok", 1, "a"), ("extra", 1, "a"), ("short", 8, "a"), ("changed", 1, "b"), ("unread", 1, None)],
        "path STRING, size BIGINT, md5 STRING",
    )
    rows = {r["path"]: r["status"] for r in joins.verify_payloads(catalogue, files).collect()}
    assert rows == {
        "ok": "ok", "gone": "missing", "extra": "untracked", "short": "size_mismatch",
        "changed": "md5_mismatch", "unread": "ok",
    }


def test_verify_archive(spark, tmp_path):
    """Payloads on disk against their records: sound, altered, cut, emptied, gone and unrecorded."""
    root, store = str(tmp_path / "v1.1"), tmp_path / "store"
    expected = {}
    for i, fate in enumerate(["ok", "md5_mismatch", "size_mismatch", "emptied", "missing", "untracked"]):
        name = f"2011010{i + 1}_notice.csv"
        content = os.urandom(100 + i)
        if fate != "untracked":
            made.write_record(root, name[:8], made.record(
                name, size=len(content), out_md5=hashlib.md5(content).hexdigest()
            ))
        folder = store / "year=2011" / "month=01" / f"day={name[6:8]}"
        folder.mkdir(parents=True)
        held = {"md5_mismatch": content[::-1], "size_mismatch": content[:-1], "emptied": b""}
        if fate != "missing":
            (folder / name).write_bytes(held.get(fate, content))
        key = f"year=2011/month=01/day={name[6:8]}/{name}"
        expected[key] = "size_mismatch" if fate == "emptied" else fate
    records = pointers.catalogue(spark, root)

    def statuses(files):
        return {r["path"]: r["status"] for r in verify_archive(records, files, root, str(store)).collect()}

    assert statuses(payloads.payload_digests(spark, str(store))) == expected
    by_size = {k: "ok" if v == "md5_mismatch" else v for k, v in expected.items()}
    assert statuses(payloads.scan_payloads(spark, str(store))) == by_size


def test_label_header_digest():
    assert hashlib.md5(HEADER.encode()).hexdigest() == "b9bfb5f5554d023eb895f6bcef6b7247"
    assert HEADER.strip().split(", ") == [c.split()[0] for c in labels.LABEL_SCHEMA.split(", ")]


def test_label_table(spark, tmp_path):
    (tmp_path / "20110105_notice.csv").write_text(
        HEADER
        + "1, 10.0.0.1, 80, , , alpha, 20, 1.5, 3, notice\n"
        + "2, , , 10.0.0.2, 53, beta, 504, 0.25, 2, anomalous\n"
    )
    (tmp_path / "20110106_anomalous_suspicious.csv").write_text(HEADER)
    (tmp_path / "note.txt").write_text("not a label table")
    rows = labels.read_labels_csv(spark, str(tmp_path)).orderBy("anomalyID").collect()
    assert [tuple(r)[:10] for r in rows] == [
        (1, "10.0.0.1", 80, None, None, "alpha", 20, 1.5, 3, "notice"),
        (2, None, None, "10.0.0.2", 53, "beta", 504, 0.25, 2, "anomalous"),
    ]
    assert {(str(r["capture_date"]), r["file_kind"]) for r in rows} == {("2011-01-05", "notice_csv")}


def test_label_table_with_exchanged_columns_fails(spark, tmp_path):
    swapped = HEADER.replace("srcIP, srcPort, dstIP", "dstIP, srcPort, srcIP")
    (tmp_path / "20110105_notice.csv").write_text(swapped + "1, 10.0.0.1, 80, , , alpha, 20, 1.5, 3, notice\n")
    with pytest.raises(Exception, match="(?i)header"):
        labels.read_labels_csv(spark, str(tmp_path)).collect()


def test_damaged_label_rows_are_marked(spark, tmp_path):
    (tmp_path / "20110105_notice.csv").write_text(
        HEADER + "1, 10.0.0.1, eighty, , , alpha, 20, 1.5, 3, notice\n2, , , , , beta, 504, 0.25, 2, x\n3, short\n"
    )
    (tmp_path / "20110105_notice.xml").write_text(
        "<set><entry><id>one</id><kind>a</kind></entry><entry><id>2</id></entry></set>"
    )
    rows = labels.read_labels_csv(spark, str(tmp_path))
    assert {r["anomalyID"]: r["damaged"] for r in rows.collect()} == {1: True, 2: False, 3: True}
    assert rows.where("damaged").count() == 2
    found = labels.read_labels_xml(spark, str(tmp_path), "entry", "id INT, kind STRING").collect()
    assert {(r["id"], r["damaged"]) for r in found} == {(None, True), (2, False)}


def test_label_document(spark, tmp_path):
    (tmp_path / "20110105_notice.xml").write_text(
        "<set><entry><id>1</id><kind>a</kind></entry><entry><id>2</id></entry></set>"
    )
    rows = labels.read_labels_xml(spark, str(tmp_path), "entry", "id INT, kind STRING").orderBy("id")
    assert [(r["id"], r["kind"], str(r["capture_date"])) for r in rows.collect()] == [
        (1, "a", "2011-01-05"), (2, None, "2011-01-05"),
    ]
    assert rows.select(F.col("file_path")).first()[0].endswith("20110105_notice.xml")
