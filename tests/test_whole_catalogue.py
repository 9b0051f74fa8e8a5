"""Known figures of a whole catalogue; runs where CATALOGUE_ROOT names its folder of years."""

import os

import pytest
from pyspark.sql import functions as F

from dayledger.functions.checks import record_rules, violations
from dayledger.functions.records import parse_pointer, render_pointer, stage_digest
from dayledger.operators import coverage, joins, quantiles, ranks, series, volume
from dayledger.session import kept
from dayledger.sources.pointers import DataLoader, catalogue, scan_pointers

ROOT = os.environ.get("CATALOGUE_ROOT")
pytestmark = pytest.mark.skipif(not ROOT, reason="CATALOGUE_ROOT is not set")

LABELS = ["notice_csv", "notice_xml", "anomalous_csv", "anomalous_xml"]


@pytest.fixture(scope="module")
def records(spark):
    return kept(catalogue(spark, ROOT), "catalogue")


@pytest.fixture(scope="module")
def flat(records):
    """One row per record, with dump and pcap as kinds of their own."""
    fine = F.when(F.col("kind") == "trace", F.col("format")).otherwise(F.col("kind"))
    return records.select(
        "capture_date", "year", "kind", "format", fine.alias("fine_kind"), "stage_md5",
        F.col("dep.etag").alias("etag"), F.col("dep.url").alias("url"),
        F.col("out.md5").alias("md5"), F.col("out.path").alias("path"),
        F.col("out.size").alias("size"), "tag_size", "tag_modified",
    )


def test_records(records):
    assert records.count() == 18962
    assert records.agg(F.sum("out.size")).first()[0] == 7090955074993
    assert stage_digest(records).where("stage_ok").count() == 18962
    assert violations(records, record_rules(), ["file_path"]).count() == 0


def test_rendered_text_is_the_file_but_for_reordered_keys(spark):
    raw = scan_pointers(spark, ROOT).withColumn("raw", F.col("value"))
    assert render_pointer(parse_pointer(raw)).where("raw = value").count() == 18952


def test_load(spark):
    loader = DataLoader(spark, ROOT)
    assert loader.load("2011-01-05", "2011-01-10").count() == 30
    assert loader.load("2011-01-05", "2011-01-10", kinds=["trace"], version="v1.1").count() == 6


def test_source_tags(flat):
    traces = flat.where("kind = 'trace'")
    assert traces.where("tag_size = size").count() == 4429
    first = traces.agg(F.date_trunc("second", F.min("tag_modified")).cast("string")).first()[0]
    assert first == "2007-01-01 18:42:13"


def test_volume_and_medians(flat):
    got = {r["fine_kind"]: (r["files"], r["bytes"]) for r in volume.volume(flat, ["fine_kind"], "size").collect()}
    assert got == {
        "notice_csv": (4264, 90736282),
        "notice_xml": (4264, 441089382),
        "anomalous_csv": (3374, 30363429),
        "anomalous_xml": (2631, 93286339),
        "dump": (2828, 3317352977769),
        "pcap": (1601, 3772946621792),
    }
    medians = {
        "notice_csv": 14409.5,
        "notice_xml": 69712,
        "anomalous_csv": 8231,
        "anomalous_xml": 32212,
        "dump": 892551856.5,
        "pcap": 2195301600,
    }
    for slices in (None, 20):
        sizes = quantiles.size_distribution(flat, ["fine_kind"], "size", slices=slices)
        assert {r["fine_kind"]: r["median"] for r in sizes.collect()} == medians


def test_duplicates_and_collisions(flat):
    groups = volume.duplicate_groups(flat, ["md5", "size"], "path").collect()
    assert [r["copies"] for r in groups] == [2, 2]
    assert volume.duplicate_content(flat, ["md5", "size"], "path").count() == 4
    collisions = volume.tag_collisions(flat, "etag", "md5").groupBy("direction", "n_values").count()
    assert {tuple(r) for r in collisions.collect()} == {
        ("tag_with_digests", 2, 4), ("digest_with_tags", 2, 2),
    }
    counts = volume.cardinality(flat, ["stage_md5", "etag", "md5", "url"]).first()
    assert tuple(counts) == (18962, 18958, 18960, 18962)


def test_kinds_per_day(flat):
    signatures = coverage.kind_signature(flat, ["capture_date"], "fine_kind").orderBy(F.desc("n_keys")).collect()
    assert len(signatures) == 15
    assert [r["n_keys"] for r in signatures[:5]] == [2229, 734, 350, 346, 298]
    missing = coverage.expected_minus_actual(flat, ["capture_date"], "kind", [*LABELS, "trace"])
    assert {tuple(r) for r in missing.groupBy("missing_kind").count().collect()} == {
        ("anomalous_xml", 1827), ("anomalous_csv", 1084), ("notice_csv", 194),
        ("notice_xml", 194), ("trace", 29),
    }


def test_companions(flat):
    def days(left, right, how):
        return joins.companions(flat, ["capture_date"], "kind", left, right, how).count()

    assert days(LABELS, ["trace"], "left_only") == 29
    assert days(LABELS, ["trace"], "right_only") == 51
    assert days(["anomalous_csv"], ["anomalous_xml"], "left_only") == 803
    assert days(["anomalous_csv"], ["anomalous_xml"], "right_only") == 60


def test_calendar(flat):
    assert coverage.missing_days(flat, "capture_date", [], "2007-01-01", "2024-11-19").count() == 2075
    gaps = coverage.coverage_gaps(flat, "capture_date", [])
    assert gaps.count() == 646
    longest = gaps.orderBy(F.desc("n_days")).first()
    assert (str(longest["gap_start"]), str(longest["gap_end"]), longest["n_days"]) == (
        "2022-01-14", "2023-01-07", 359,
    )
    runs = coverage.coverage_runs(flat, "capture_date", [])
    assert runs.count() == 647
    longest = runs.orderBy(F.desc("n_days")).first()
    assert (str(longest["run_start"]), str(longest["run_end"]), longest["n_days"]) == (
        "2012-09-22", "2012-12-30", 100,
    )


def test_format_change(flat):
    traces = flat.where("kind = 'trace'")
    for slices in (None, 20):
        (change,) = series.transitions(
            traces, ["kind"], ["capture_date", "path"], "format", slices
        ).collect()
        assert (str(change["capture_date"]), change["previous"], change["format"]) == (
            "2015-12-28", "dump", "pcap",
        )


def test_largest(flat):
    top = [(r["path"][:12], r["size"]) for r in ranks.largest(flat, 3, "size", "path").collect()]
    assert top == [
        ("202401241400", 15062156019), ("202401231400", 14921132901), ("202404241400", 13630368074),
    ]


def test_outliers(flat):
    for slices in (None, 20):
        far = quantiles.robust_outliers(flat, ["fine_kind", "year"], "size", 3.5, slices)
        assert {tuple(r) for r in far.groupBy("fine_kind").count().collect()} == {
            ("anomalous_csv", 97), ("notice_csv", 73), ("notice_xml", 64),
            ("anomalous_xml", 33), ("dump", 18), ("pcap", 11),
        }


def test_batches(flat):
    for slices in (None, 20):
        binned = series.byte_bins(flat, ["capture_date", "path"], "size", 128 * 2**30, slices)
        assert binned.select("bin").distinct().count() == 52


def test_yearly(flat):
    per_year = series.growth(flat, F.col("year"), F.count("*")).orderBy("period").collect()
    assert [r["total"] for r in per_year[:4]] == [1580, 1663, 1760, 1619]
    assert per_year[1]["change"] == 83


def test_large_payloads(flat):
    assert flat.where(F.col("size") > 2**31 - 1).count() == 1297
