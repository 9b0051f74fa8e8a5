"""Physical plans: what is pushed down, what is shuffled, how hot keys are met."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from dayledger.operators import joins, ranks, volume
from dayledger.plans.tables import QUERIES
from dayledger.session import kept, local_folder, shared_folder

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    batch = [n for n in queries() if n in QUERIES and not n.startswith("stream_")]
    return {n: plan_of(queries()[n](spark, FOLDER)) for n in batch}


def test_no_query_pairs_all_rows(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_python_only_reads_files(plans):
    with_python = {n for n, p in plans.items() if "InPandas" in p or "EvalPython" in p or "MapInArrow" in p}
    assert with_python == {"payload_digests", "payload_inventory"}


def test_scans_read_only_what_they_need(plans):
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plans["orders_in_range"]
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in plans["orders_in_range"]
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plans["kind_matrix"]
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string>" in plans["volume_rollup"]
    for name in ("violations", "largest_docs", "topk_docs", "extremes"):
        assert "text" not in plans[name].split("ReadSchema")[1], name


def test_one_shuffle_is_enough(plans):
    for name in ("kind_matrix", "missing_cells", "user_days_in_all", "companion_days",
                 "reconcile_quality", "duplicate_groups"):
        assert plans[name].count("Exchange") == 1, name


def test_subtotals_expand_groups_and_not_rows(plans):
    for name in ("volume_rollup", "volume_cube", "volume_grouping_sets"):
        below = plans[name].split("Expand [")[1]
        assert plans[name].count("Expand [") == 1 and "HashAggregate" in below.split("Exchange")[0], name


def test_topk_prunes_before_the_shuffle(plans):
    for name in ("topk_docs", "topk_with_ties"):
        before_shuffle = plans[name].split("Exchange hashpartitioning")[-1]
        assert "WindowGroupLimit" in before_shuffle, name
    assert "TakeOrderedAndProject" in plans["largest_docs"]


def test_one_shuffle_per_side_for_extremes(plans):
    assert plans["extremes"].count("WindowGroupLimit") >= 1
    assert plans["extremes"].count("Exchange hashpartitioning(source") == 2


def test_sliced_operators_have_no_single_task(spark, plans):
    for name in ("type_transitions", "size_distribution", "robust_outliers"):
        assert "SinglePartition" not in plans[name], name
    # Of byte_bins only the slices' totals, one row each, meet in one task.
    assert plans["byte_bins"].count("SinglePartition") == 1


def test_the_latest_record_takes_one_shuffle(plans):
    assert plans["as_of_latest"].count("Exchange") == 1
    assert "Window" not in plans["as_of_latest"]


def test_large_k_is_ranked_in_slices(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("g"))
    plan = plan_of(ranks.topk(df, ["g"], "id", 5000, tie="id", slices=3))
    windows = [line for line in plan.split("\n") if "Window [" in line and "windowspecdefinition" in line]
    # Whole groups meet only as one row per slice.
    assert len(windows) == 2
    assert sum("__slice" in w.split("windowspecdefinition(")[1].split("ASC")[0].split("DESC")[0] for w in windows) == 2


@pytest.fixture
def strict(spark):
    """Joins by shuffle, with partitions counted as skewed from a few kilobytes on."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot(strict):
    """A third of 60,000 rows share one value."""
    number = F.col("id")
    value = F.when(number % 3 == 0, F.lit("hot")).otherwise((number % 9973).cast("string"))
    return strict.range(0, 60_000, 1, 12).select(number, F.md5(value).alias("md5"), F.lit("g").alias("g"))


def splits_skew(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_one_content_are_split(hot):
    got = volume.duplicate_content(hot, ["md5"], "id")
    assert splits_skew(got)
    assert got.where(F.col("copies") == 20_000).count() == 20_000


def test_moved_copies_are_split(hot):
    old = hot.select(F.concat(F.lit("old/"), "id").alias("path"), "md5")
    new = hot.select(F.concat(F.lit("new/"), "id").alias("path"), "md5")
    got = joins.moved_content(old, new, "path", "md5")
    assert splits_skew(got)
    assert got.count() == 60_000


def test_ties_are_split(hot):
    sized = hot.select("id", "g", F.when(F.col("id") % 3 == 0, 9).otherwise(F.col("id") % 9).alias("size"))
    got = ranks.topk(sized, ["g"], "size", 2)
    assert splits_skew(got)
    assert got.count() == 20_000


def test_busy_flows_are_split(strict, hot):
    rules = strict.range(0, 40, 1, 4).select(
        F.md5(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string"))).alias("md5"),
        F.when(F.col("id") % 2 == 1, "g").alias("srcIP"),
        F.col("id").alias("rule"),
    )
    got = joins.match_labels(hot, rules, ["md5"], {"g": "srcIP"})
    assert splits_skew(got)
    assert got.where("rule = 0").count() == 20_000


def test_rows_with_a_hot_partner_are_split(hot):
    other = hot.where("id < 9")
    assert splits_skew(joins.having(hot, other, ["md5"]))
    assert splits_skew(joins.lacking(hot, other.where(F.col("id") % 3 > 0), ["md5"]))


def test_shared_folder_is_the_one_named(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or local_folder(spark.sparkContext.master))
    written = kept(spark.range(3)).inputFiles()
    assert all(f"/{spark.sparkContext.applicationId}/" in f for f in written)
    with pytest.raises(ValueError):
        local_folder("local-cluster[2,1,1024]")
    with pytest.raises(ValueError):
        local_folder("yarn")
