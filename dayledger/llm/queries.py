"""The operators bound to the given tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayledger.llm import (
    caps, collisions, lines, manifest, mixing, packing, quality, secret_scan, simhash, templates, top_scores,
    toxicity, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_neighbours(spark, folder):
    return collisions.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_toxicity(spark, folder):
    documents, labels = (table(spark, folder, t) for t in ("documents", "labels"))
    return toxicity.rated(documents, toxicity.train(documents, labels))


@query
def op3_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@query
def op4_secrets(spark, folder):
    return secret_scan.report(secret_scan.secrets(table(spark, folder, "documents")))


@query
def op5_lines(spark, folder):
    documents = lines.deduplicated(table(spark, folder, "documents"), share=lines.SHARE)
    return documents.select(
        "doc_id", F.coalesce(F.size("line_info"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(F.filter("line_info", lambda x: x["stays"])), F.lit(0)).cast("bigint")
        .alias("n_kept"),
        F.coalesce(F.aggregate("line_info", F.lit(0).cast("bigint"), lambda n, x: n + x["links"]), F.lit(0))
        .alias("n_links"),
        "line_info", "text",
    )


@query
def op6_main_text(spark, folder):
    return templates.main_texts(table(spark, folder, "pages"))


@query
def op7_quality(spark, folder):
    documents, labels = (table(spark, folder, t) for t in ("documents", "labels"))
    return quality.rated(documents, quality.train(documents, labels))


@query
def op8_caps(spark, folder):
    return caps.near_duplicates(table(spark, folder, "embeddings"))


@query
def op9_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query
def op10_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op11_scores(spark, folder):
    return top_scores.best(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op11_scores"] = """
WITH own AS (
    SELECT vec_id, [floor(256 * CAST(v AS DOUBLE)) FOR v IN embedding] AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM own q JOIN own c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""


@query
def op12_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_manifest(spark, folder):
    return manifest.manifest(table(spark, folder, "documents"))
