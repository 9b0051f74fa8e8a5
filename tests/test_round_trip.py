"""Any record that can be written parses back to the same values."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayledger.functions import records
from tests import records as made

hexes = st.text("0123456789abcdef", min_size=32, max_size=32)
words = st.text("abcdefghijklmnopqrstuvwxyz0123456789_.-~%", min_size=1, max_size=90)
one = st.fixed_dictionaries({
    "name": words, "frozen": st.sampled_from(["true", "false"]),
    "url": words.map(lambda w: f"http://example.org/{w}"),
    "dep_size": st.integers(0, 2**62), "out_size": st.integers(0, 2**62),
    "dep_hash": st.sampled_from(["md5", "sha1"]), "out_hash": st.sampled_from(["md5", "sha1"]),
    "out_md5": hexes, "etag": st.text("0123456789abcdef-", min_size=1, max_size=40),
})


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(one, st.sampled_from(["plain", "folded", "reordered"])), min_size=5, max_size=40))
def test_parse_and_render(spark, drawn):
    df = spark.createDataFrame(
        [(i, made.text_of(v, layout)) for i, (v, layout) in enumerate(drawn)], "i INT, value STRING"
    )
    parsed = records.stage_digest(records.parse_pointer(df))
    for row in parsed.collect():
        v = drawn[row["i"]][0]
        assert tuple(row["dep"]) == (v["etag"], v["dep_size"], v["dep_hash"], v["url"])
        assert tuple(row["out"]) == (v["out_hash"], v["name"], v["out_md5"], v["out_size"])
        assert row["frozen"] == (v["frozen"] == "true")
        assert row["stage_ok"] and row["stage_md5"] == made.stage_md5(v)
    rendered = records.render_pointer(parsed.drop("stage_digest", "stage_ok")).select("i", "value")
    again = records.parse_pointer(rendered)
    first = parsed.select(*again.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    canonical = rendered.join(df.withColumnRenamed("value", "text"), "i").where(
        F.col("value") == F.col("text")
    )
    kept = {r["i"] for r in canonical.select("i").collect()}
    assert kept == {i for i, (v, layout) in enumerate(drawn) if layout == made.layout_of(v)}


def test_incomplete_records_have_no_text(spark):
    df = spark.createDataFrame([("md5: 0123\nfrozen: true\ndeps:\nouts:\n",)], ["value"])
    assert records.render_pointer(records.parse_pointer(df)).first()["value"] is None
