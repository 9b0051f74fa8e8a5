"""The operators bound to the given tables, one query per binding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayledger.functions import checks, names, records, tags
from dayledger.operators import coverage, joins, quantiles, ranks, series, sketches, volume
from dayledger.plans import catalogue
from dayledger.session import fresh_path, kept
from dayledger.sources import labels, payloads, pointers
from dayledger.streaming import streams

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# What follows the date in the names of the first four kinds.
ENDINGS = ["_notice.csv", "_notice.xml", "_anomalous_suspicious.csv", "_anomalous_suspicious.xml"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_DAYS = ("2024-01-01", "2024-01-30")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def local(ts: Column) -> Column:
    """An instant as the tables write it, without a zone."""
    return ts.cast("timestamp_ntz")


def event_days(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("day", F.to_date("ts"))


def document_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a catalogue record: its text is the payload."""
    docs = table(spark, folder, "documents")
    digest, size = F.md5("text"), F.octet_length("text").cast("bigint")
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    url = F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/"), path)
    etag = F.concat(F.lower(F.hex(size)), F.lit("-"), F.substring(digest, 1, 12))
    plain = docs.select(
        "doc_id",
        F.lit(True).alias("frozen"),
        F.struct(
            etag.alias("etag"), size.alias("size"), F.lit("md5").alias("hash"), url.alias("url")
        ).alias("dep"),
        F.struct(
            F.lit("md5").alias("hash"), path.alias("path"), digest.alias("md5"), size.alias("size")
        ).alias("out"),
    )
    return plain.withColumn("stage_md5", F.md5(records.stage_text()))


def order_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per month of orders and priority, dated on the month's first day.

    Priorities stand for the five kinds; traces change their format in 1996.
    """
    orders = table(spark, folder, "orders").select(
        F.trunc("o_orderdate", "month").alias("date"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("cents"),
    )
    totals = orders.groupBy("date", "priority").agg(F.count("*").alias("n"), F.sum("cents").alias("size"))
    digits = F.date_format("date", "yyyyMMdd")
    trace = F.col("priority") == PRIORITIES[4]
    ending = F.when(trace, F.when(F.year("date") < 1996, "1400.dump.gz").otherwise("1400.pcap.gz"))
    for priority, name in zip(PRIORITIES, ENDINGS):
        ending = ending.when(F.col("priority") == priority, name)
    path = F.concat(digits, ending)
    host = F.when(trace, F.concat(F.lit("http://traces.example.net/point/"), F.date_format("date", "yyyy/")))
    url = F.concat(host.otherwise(
        F.concat(F.lit("http://labels.example.org/records/v1.1/"), F.date_format("date", "yyyy/MM/dd/"))
    ), path)
    tag = F.concat_ws("-", F.lower(F.hex("size")), F.lower(F.hex("n")))
    etag = F.when(trace, tag).otherwise(F.col("n").cast("string"))
    filed = totals.select(
        F.year("date").alias("year"), F.month("date").alias("month"), F.day("date").alias("day"),
        "priority", F.lit(True).alias("frozen"),
        F.struct(etag.alias("etag"), "size", F.lit("md5").alias("hash"), url.alias("url")).alias("dep"),
        F.struct(
            F.lit("md5").alias("hash"), path.alias("path"),
            F.md5(F.col("size").cast("string")).alias("md5"), "size",
        ).alias("out"),
    )
    return filed.withColumn("stage_md5", F.md5(records.stage_text()))


def order_texts(filed: DataFrame) -> DataFrame:
    """The records' texts; those of traces list the keys of the local file in the other order."""
    other = F.regexp_replace(
        "value", r"- hash: (\S+)\n  path: (\S+)\n  md5: (\S+)\n  size: (\d+)\n$",
        "- md5: $3\n  size: $4\n  hash: $1\n  path: $2\n",
    )
    rendered = records.render_pointer(filed)
    return rendered.withColumn(
        "value", F.when(F.endswith("out.path", F.lit(".gz")), other).otherwise(F.col("value"))
    )


def order_files(spark: SparkSession, folder: str) -> str:
    """A catalogue on disk in two versions; the older one ends with 1996. A file holds many records."""
    root = fresh_path(spark, "records")
    filed = order_records(spark, folder)
    versions = {"v1.0": filed.where("year <= 1996"), "v1.1": filed}
    for version, own in versions.items():
        texts = order_texts(own).repartitionByRange("year", "month", "day", "out.path")
        pointers.write_texts(texts, f"{root}/{version}")
    return root


def order_days(spark: SparkSession, folder: str) -> str:
    """One file per month of orders with the texts of its records, in order.

    A task writes the sorted texts of a file one by one; they never meet in a cell.
    """
    day = ["year", "month", "day"]
    texts = order_texts(order_records(spark, folder)).select(
        "year", F.lpad("month", 2, "0").alias("month"), F.lpad("day", 2, "0").alias("day"), "value"
    )
    root = fresh_path(spark, "days")
    # The writer ends each row with a line break; only behind the last text is it one more.
    last = F.lead("value").over(Window.partitionBy(*day).orderBy("value")).isNull()
    cut = F.substr("value", F.lit(1), F.length("value") - 1)
    rows = texts.withColumn("last", last).withColumn("value", F.when(F.col("last"), F.col("value")).otherwise(cut))
    rows.drop("last").write.partitionBy(*day).text(root)
    return root


def flat_records(parsed: DataFrame) -> DataFrame:
    return records.stage_digest(parsed).select(
        "version", "capture_date", "kind", "format", "frozen", "n_deps", "n_outs", "stage_ok",
        F.col("dep.etag").alias("etag"), F.col("dep.url").alias("url"),
        F.col("dep.size").alias("dep_size"), F.col("out.path").alias("path"),
        F.col("out.md5").alias("md5"), F.col("out.size").alias("size"), "tag_size",
        local(F.col("tag_modified")).alias("tag_modified"),
    )


# Records, names and rules


@query
def scan_records(spark, folder):
    return flat_records(
        pointers.catalogue(spark, order_files(spark, folder), suffix=".txt")
    )


@query
def load_records(spark, folder):
    loader = pointers.DataLoader(spark, order_files(spark, folder), suffix=".txt")
    kinds = ["notice_csv", "anomalous_xml", "trace"]
    return flat_records(loader.load("1995-11-15", "1997-02-14", kinds=kinds, version="v1.1"))


@query
def content_digest(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return checks.content_digest(docs, "text").drop("text")


@query
def stage_digest(spark, folder):
    return records.stage_digest(document_records(spark, folder)).select(
        "doc_id", "stage_digest", "stage_ok"
    )


@query
def pointer_round_trip(spark, folder):
    rendered = records.render_pointer(document_records(spark, folder)).select("doc_id", "value")
    back = records.stage_digest(records.parse_pointer(rendered))
    return back.select(
        "doc_id", "stage_md5", "frozen", "dep.etag", "dep.url",
        F.col("dep.size").alias("dep_size"), F.col("out.path").alias("path"),
        F.col("out.md5").alias("md5"), F.col("out.size").alias("size"),
        "n_deps", "n_outs", "stage_ok",
    )


@query
def rendered_digest(spark, folder):
    rendered = records.render_pointer(document_records(spark, folder))
    return rendered.select("doc_id", F.md5("value").alias("text_md5"))


@query
def violations(spark, folder):
    rules = {
        "too_short": F.col("n_chars") >= 50,
        "too_long": F.col("n_chars") <= 5000,
        "not_english": F.col("lang") == "en",
    }
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "lang")
    return checks.violations(docs, rules, ["doc_id"])


@query
def record_violations(spark, folder):
    """The records of orders, twelve of every thirteen with a fault."""
    number = F.substring("priority", 1, 1).cast("int")
    filed = order_records(spark, folder).withColumns({
        "fault": F.pmod(F.col("year") * 12 + F.col("month") + number, F.lit(13)),
        "kind": F.when(F.endswith("out.path", F.lit(".gz")), "trace").otherwise("label"),
        "n_deps": F.lit(1), "n_outs": F.lit(1),
    })

    def faulty(fault: int, column: Column, value: Column) -> Column:
        return F.when(F.col("fault") == fault, value).otherwise(column)

    file_path = F.concat(F.lit("/v1.1/"), F.col("out.path"), F.lit(".dvc"))
    sizes = {
        "dep": faulty(5, faulty(10, F.col("dep.size"), F.lit(0).cast("bigint")), F.col("dep.size") + 1),
        "out": faulty(10, F.col("out.size"), F.lit(0).cast("bigint")),
    }
    elsewhere = F.regexp_replace("dep.url", r"/\d{4}/", "/1900/")
    url = faulty(9, faulty(7, F.col("dep.url"), F.concat("dep.url", F.lit(".bak"))), elsewhere)
    broken = filed.withColumns({
        "file_path": faulty(6, file_path, F.lit("/v1.1/other.csv.dvc")),
        "frozen": faulty(1, F.col("frozen"), F.lit(False)),
        "n_deps": faulty(4, F.col("n_deps"), F.lit(2)),
        "month": faulty(12, F.col("month"), F.lit(13)),
        "day": faulty(8, F.col("day"), F.lit(2)),
        "dep": F.struct(
            faulty(11, F.col("dep.etag"), F.lit("f-1")).alias("etag"), sizes["dep"].alias("size"),
            faulty(2, F.col("dep.hash"), F.lit("sha1")).alias("hash"), url.alias("url"),
        ),
        "out": F.struct(
            "out.hash", "out.path", faulty(3, F.col("out.md5"), F.lit("abc")).alias("md5"),
            sizes["out"].alias("size"),
        ),
    })
    found = checks.violations(broken, checks.record_rules(), ["out.path", "fault"])
    return found


@query
def empty_payloads(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    smallest = {"en": 100, "de": 80, "fr": 60, "es": 60}
    return checks.is_empty_payload(docs, smallest, kind="lang", size="n_chars")


@query
def classify_names(spark, folder):
    """Orders filed under the names of a catalogue; low priority ones under another name."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("readme-"), day))
        .when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("_notice.csv")))
        .when(F.col("o_orderstatus") == "P", F.concat(day, F.lit("_anomalous_suspicious.xml")))
        .otherwise(F.concat(day, F.lit("1400.pcap.gz")))
    )
    filed = table(spark, folder, "orders").select("o_orderkey", name.alias("name"))
    timed = names.capture_time(names.classify_kind(filed, "name"), "name")
    return timed.withColumn("captured_at", local(F.col("captured_at")))


@query
def classify_pages(spark, folder):
    path = F.try_parse_url("url", F.lit("PATH"))
    shape = r"^/([a-z]{2})/(\d+)"
    return table(spark, folder, "pages").select(
        "page_id",
        names.blank_to_null(F.regexp_extract(path, shape, 1)).alias("lang"),
        F.regexp_extract(path, shape, 2).try_cast("bigint").alias("number"),
    )


@query
def page_url_parts(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return names.url_parts(pages, "url").drop("url")


@query
def hex_decode(spark, folder):
    tagged = document_records(spark, folder).select("doc_id", F.col("dep.etag").alias("etag"))
    return tags.decode_source_tag(tagged, "etag").select(
        "doc_id", "tag_size", local(F.col("tag_modified")).alias("tag_modified")
    )


@query
def publish_lag(spark, folder):
    shipped = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    ordered = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    both = shipped.join(ordered, shipped.l_orderkey == ordered.o_orderkey)
    return tags.publish_lag(both, "l_shipdate", "o_orderdate").select(
        "l_orderkey", "l_linenumber", "lag_seconds"
    )


# Sources and sinks


@query
def orders_in_range(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return pointers.in_range(orders, "1996-01-01", "1996-12-31", "o_orderdate")


@query
def orders_catalogue(spark, folder):
    """All orders written as a columnar catalogue by year."""
    filed = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"),
        F.to_date("o_orderdate").alias("capture_date"),
        F.col("o_orderpriority").alias("kind"),
        F.col("o_orderkey").alias("file_path"),
    )
    path = fresh_path(spark, "catalogue")
    pointers.write_catalogue(filed, path)
    return spark.read.parquet(path).select("year", "capture_date", "kind", "file_path")


@query
def orders_catalogue_range(spark, folder):
    """A range of days of that catalogue."""
    return pointers.in_range(
        orders_catalogue(spark, folder), "1995-03-01", "1997-02-28", "capture_date"
    )


@query
def catalogue_increments(spark, folder):
    """Orders delivered in three parts that overlap, the second one with raised totals."""
    day = F.to_date(F.trunc("o_orderdate", "month"))
    filed = table(spark, folder, "orders").select(
        F.year(day).alias("year"), F.month(day).alias("month"), F.col("o_orderkey").alias("file_path"),
        F.lit(1).alias("published"), F.col("o_totalprice").alias("total"),
    )
    later = filed.where("year >= 1995").withColumns({"published": F.lit(2), "total": F.col("total") + 1})
    path = fresh_path(spark, "increments")
    for part in (filed.where("year <= 1996"), later, filed.where("year >= 1994")):
        copy = pointers.merge_days(part, path, ["file_path"], "published", "total", ("year", "month"))
    return copy


@query
def labels_csv(spark, folder):
    """Line items written as a label table and read back; an unset field is empty in the file."""
    sent = F.col("l_returnflag") != "N"
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("int").alias("anomalyID"),
        F.concat(F.lit("10.0.0."), F.col("l_suppkey").cast("string")).alias("srcIP"),
        F.col("l_linenumber").alias("srcPort"),
        F.when(sent, F.concat(F.lit("10.1.0."), F.col("l_suppkey").cast("string"))).alias("dstIP"),
        F.when(sent, F.col("l_partkey").cast("int")).alias("dstPort"),
        F.col("l_returnflag").alias("taxonomy"),
        F.col("l_quantity").cast("int").alias("heuristic"),
        F.col("l_discount").alias("distance"),
        F.col("l_linenumber").alias("nbDetectors"),
        F.col("l_linestatus").alias("label"),
    )
    path = fresh_path(spark, "labels")
    rows.write.option("header", "true").csv(path)
    # The files' names, which Spark makes up, name no day and no kind.
    return labels.read_labels_csv(spark, path).drop("file_path")


@query
def labels_damaged(spark, folder):
    """Line items as a label table in which some ports are words, against orders.

    A label sets the line's status, and its port where the item was not returned; a damaged port
    must not become a wildcard.
    """
    port = F.when(F.col("l_linenumber") == 4, "eighty").when(
        F.col("l_returnflag") != "R", F.col("l_linenumber").cast("string")
    )
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("int").alias("order"), port.alias("port"),
        F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"),
    )
    path = fresh_path(spark, "labels")
    rows.write.option("header", "true").csv(path)
    read = labels.read_labels_csv(spark, path, "order INT, port INT, status STRING, line INT")
    rules = read.select("order", "port", "status", "line", "damaged")
    flows = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("int").alias("order"), F.col("o_orderstatus").alias("state"),
        F.pmod("o_custkey", F.lit(7)).cast("int").alias("number"),
    )
    matched = joins.match_labels(flows, rules, ["order"], {"number": "port", "state": "status"})
    return matched.select("order", "line", F.lit("matched").alias("what")).unionByName(
        read.where("damaged").select("order", "line", F.lit("damaged").alias("what"))
    )


@query
def labels_xml(spark, folder):
    rows = table(spark, folder, "labels")
    path = fresh_path(spark, "labels")
    rows.write.format("xml").option("rowTag", "row").save(path)
    read = labels.read_labels_xml(spark, path, "row", rows.schema)
    return read.drop("file_path")


def day_named(files: DataFrame) -> DataFrame:
    """Files by the day that their folders name."""
    day = F.regexp_replace(
        F.regexp_extract("path", r"year=\d+/month=\d+/day=\d+", 0), r"year=|month=|day=", ""
    )
    return files.withColumn("day", F.to_date(day, "yyyy/MM/dd")).drop("path")


@query
def payload_inventory(spark, folder):
    files = payloads.scan_payloads(spark, order_days(spark, folder), "*.txt")
    return day_named(files).select("day", "length")


@query
def payload_digests(spark, folder):
    files = payloads.payload_digests(spark, order_days(spark, folder), "*.txt")
    return day_named(files).select("day", "length", "md5")


# Joins


def digested(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.octet_length("text").alias("size"), F.md5("text").alias("md5")
    )


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Size and digest of every document, for queries that would read the texts more than once."""
    return kept(digested(table(spark, folder, "documents")), "digests")


def mirror(spark: SparkSession, folder: str, recorded: DataFrame) -> DataFrame:
    """A mirror of the documents with every kind of fault.

    It keeps the first copy of each content, holds the benchmark texts besides, has lost the text
    of toxic documents and has swapped a letter in those of low quality.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text")
    first = recorded.groupBy("md5").agg(F.min("doc_id").alias("doc_id"))
    marked = (
        docs.join(first.select("doc_id"), "doc_id", "left_semi")
        .join(table(spark, folder, "labels"), "doc_id", "left")
    )
    text = (
        F.when(F.col("toxic") == 1, "")
        .when(F.col("quality") == 0, F.replace("text", F.lit("e"), F.lit("x")))
        .otherwise(F.col("text"))
    )
    extra = table(spark, folder, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    return marked.select("doc_id", text.alias("text")).unionByName(extra)


@query
def verify_join(spark, folder):
    """Documents named by source and length, so that some share a name, against their mirror."""
    name = F.concat("source", F.lit("/"), F.col("n_chars").cast("string"))
    named = table(spark, folder, "documents").select("doc_id", name.alias("path"))
    recorded = document_digests(spark, folder)
    found = digested(mirror(spark, folder, recorded)).join(named, "doc_id", "left").withColumn(
        "path", F.coalesce("path", F.col("doc_id").cast("string"))
    )
    return joins.verify_payloads(recorded.join(named, "doc_id"), found)


@query
def labelled_docs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return joins.having(docs, table(spark, folder, "labels"), ["doc_id"])


@query
def unlabelled_docs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return joins.lacking(docs, table(spark, folder, "labels"), ["doc_id"])


@query
def companion_days(spark, folder):
    return joins.companions(
        event_days(spark, folder), ["user_id", "day"], "event_type", ["purchase"], ["error"]
    )


def order_states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Order states on record, and those that follow from the line items, by customer and month."""
    on_record = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"),
        F.to_date(F.trunc("o_orderdate", "month")).alias("month"), F.col("o_orderstatus").alias("state"),
    )
    finished, opened = (F.bool_and(F.col("l_linestatus") == state) for state in ("F", "O"))
    derived = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("orderkey"))
        .agg(F.when(finished, "F").when(opened, "O").otherwise("P").alias("state"))
        .join(on_record.drop("state"), "orderkey")
    )
    return on_record, derived


@query
def snapshot_diff(spark, folder):
    """Order states of both kinds. A customer may have several orders in a month."""
    return joins.snapshot_diff(*order_states(spark, folder), ["custkey", "month"], ["state"])


@query
def snapshot_changes(spark, folder):
    """The same without what is unchanged: customers of a month with equal digests are not compared."""
    on_record, derived = (
        side.withColumn("customers", F.col("custkey") % 16) for side in order_states(spark, folder)
    )
    return joins.snapshot_changes(
        on_record, derived, ["custkey", "month"], ["state"], ["month", "customers"]
    )


@query
def moved_content(spark, folder):
    """Documents before and after the labelled ones move to a folder of their own."""
    docs = kept(table(spark, folder, "documents").select(
        "doc_id", "source", F.md5("text").alias("md5")
    ), "digests")
    number = F.col("doc_id").cast("string")
    home = F.concat_ws("/", "source", number)
    moved = docs.join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    ).select(
        F.when(F.col("quality").isNotNull(), F.concat_ws("/", F.lit("labelled"), number))
        .otherwise(home).alias("path"),
        "md5",
    )
    return joins.moved_content(docs.select(home.alias("path"), "md5"), moved, "path", "md5")


@query
def reconcile_quality(spark, folder):
    """Documents that are good by their label against those that are good by their length."""
    labelled = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    by_length = table(spark, folder, "documents").where("n_chars >= 500").select("doc_id")
    return joins.reconcile_labels(labelled, by_length, ["doc_id"])


@query
def match_labels(spark, folder):
    """Orders against one rule per customer, whose segment decides which fields the rule sets."""
    segment = F.col("c_mktsegment")
    rules = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.when(segment.isin("BUILDING", "MACHINERY"), "F").alias("status"),
        F.when(segment.isin("BUILDING", "AUTOMOBILE"), "1-URGENT").alias("priority"),
        F.col("c_name").alias("rule"),
    )
    flows = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    fields = {"o_orderstatus": "status", "o_orderpriority": "priority"}
    return joins.match_labels(flows, rules, ["o_custkey"], fields)


# Aggregations


@query
def volume_by_kind(spark, folder):
    docs = table(spark, folder, "documents").withColumn("size", F.octet_length("text"))
    return volume.volume(docs, ["source", "lang"], "size")


def quantities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("quantity")
    )


@query
def volume_rollup(spark, folder):
    return volume.volume(
        quantities(spark, folder), ["l_returnflag", "l_linestatus"], "quantity", "rollup"
    )


@query
def volume_cube(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderstatus", "o_orderpriority",
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    return volume.volume(orders, ["o_orderstatus", "o_orderpriority"], "price", "cube")


@query
def volume_grouping_sets(spark, folder):
    sets = [["l_returnflag"], ["l_linestatus"], []]
    return volume.volume(
        quantities(spark, folder), ["l_returnflag", "l_linestatus"], "quantity", "sets", sets
    )


@query
def size_distribution(spark, folder):
    docs = table(spark, folder, "documents").select("source", "n_chars")
    sizes = quantiles.size_distribution(docs, ["source"], "n_chars")
    # Interpolation may differ in the last bit of a double from engine to engine.
    return sizes.withColumn("p99", F.round("p99", 6))


@query
def duplicate_content(spark, folder):
    docs = document_digests(spark, folder)
    return volume.duplicate_content(docs, ["md5", "size"], "doc_id")


@query
def duplicate_groups(spark, folder):
    docs = digested(table(spark, folder, "documents"))
    return volume.duplicate_groups(docs, ["md5", "size"], "doc_id")


@query
def tag_collisions(spark, folder):
    """Source and length as a tag: the same tag on different texts, the same text under many tags."""
    docs = table(spark, folder, "documents").select(
        F.concat_ws("-", "source", F.col("n_chars").cast("string")).alias("tag"),
        F.md5("text").alias("md5"),
    )
    return volume.tag_collisions(docs, "tag", "md5")


@query
def kind_matrix(spark, folder):
    return coverage.kind_matrix(event_days(spark, folder), ["day"], "event_type", EVENT_TYPES)


@query
def kind_signature(spark, folder):
    return coverage.kind_signature(event_days(spark, folder), ["user_id", "day"], "event_type")


@query
def cardinality(spark, folder):
    return volume.cardinality(event_days(spark, folder), ["user_id", "event_type", "day"])


@query
def sketched_cardinality(spark, folder):
    """Distinct values from the events' daily sketches beside the exact numbers."""
    columns = ["user_id", "event_type", "event_id"]
    events = event_days(spark, folder)
    daily = kept(sketches.daily_sketches(events, ["day"], columns), "sketches")
    about = sketches.merged_cardinality(daily, [], columns)
    exact = volume.cardinality(events, columns)
    named = [F.struct(F.lit(c).alias("field"), F.col(c).cast("bigint").alias("n")) for c in columns]
    told = about.select(F.inline(F.array(*named))).withColumnRenamed("n", "about")
    near = F.abs(F.col("about") - F.col("n")) <= sketches.DISTINCT_ERROR * F.col("n")
    return exact.select(F.inline(F.array(*named))).join(told, "field").select(
        "field", F.col("n").alias("n_distinct"), near.alias("within_bound")
    )


@query
def sketched_quantiles(spark, folder):
    """Quantiles of line item quantities from monthly sketches, judged by their ranks."""
    fractions = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    items = table(spark, folder, "lineitem").select(
        "l_returnflag", F.trunc("l_shipdate", "month").alias("month"),
        (F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    monthly = kept(sketches.daily_sketches(items, ["l_returnflag", "month"], values=["cents"]), "sketches")
    told = sketches.merged_quantiles(monthly, ["l_returnflag"], "cents", fractions)
    return items.join(told, "l_returnflag").groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"),
        *[
            ((F.count_if(F.col("cents") < F.col(name)) <= (p + sketches.RANK_ERROR) * F.count("*"))
             & (F.count_if(F.col("cents") <= F.col(name)) >= (p - sketches.RANK_ERROR) * F.count("*")))
            .alias(name)
            for name, p in fractions.items()
        ],
    )


@query
def extremes(spark, folder):
    docs = table(spark, folder, "documents").select("source", "n_chars", "doc_id")
    return volume.extremes(docs, ["source"], "n_chars", "doc_id")


@query
def label_profile(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    labelled = docs.join(table(spark, folder, "labels"), "doc_id")
    return volume.label_profile(labelled, ["quality", "lang"], ["source"], "rollup", exact=True)


# Coverage and series


@query
def missing_days(spark, folder):
    return coverage.missing_days(table(spark, folder, "events"), "ts", ["user_id"], *EVENT_DAYS)


@query
def missing_cells(spark, folder):
    return coverage.expected_minus_actual(
        event_days(spark, folder), ["user_id", "day"], "event_type", EVENT_TYPES
    )


@query
def missing_cells_of_days(spark, folder):
    """The same for all days of the calendar, also those on which a user did nothing."""
    events = event_days(spark, folder)
    start, end = (F.lit(d).cast("date") for d in EVENT_DAYS)
    days = events.select("user_id").distinct().select(
        "user_id", F.explode(F.sequence(start, end)).alias("day")
    )
    return coverage.expected_minus_actual(events, ["user_id", "day"], "event_type", EVENT_TYPES, days)


@query
def user_days_in_all(spark, folder):
    return coverage.days_in_all(
        event_days(spark, folder), ["user_id", "day"], "event_type", ["purchase", "error"]
    )


@query
def user_days_in_any(spark, folder):
    return coverage.days_in_any(
        event_days(spark, folder), ["user_id", "day"], "event_type", ["purchase", "error"]
    )


@query
def coverage_gaps(spark, folder):
    return coverage.coverage_gaps(table(spark, folder, "events"), "ts", ["user_id"])


@query
def coverage_runs(spark, folder):
    return coverage.coverage_runs(table(spark, folder, "events"), "ts", ["user_id"])


@query
def type_transitions(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    return series.transitions(events, ["user_id"], ["ts", "event_id"], "event_type")


@query
def rolling_orders(spark, folder):
    return series.rolling(table(spark, folder, "orders"), [], "o_orderdate", F.count("*"), 7)


@query
def yearly_growth(spark, folder):
    return series.growth(table(spark, folder, "orders"), F.year("o_orderdate"), F.count("*"))


@query
def robust_outliers(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return quantiles.robust_outliers(docs, ["source"], "n_chars")


@query
def byte_bins(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return series.byte_bins(docs, ["doc_id"], "n_chars", 100_000)


@query
def byte_bin_totals(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return series.bin_totals(series.byte_bins(docs, ["doc_id"], "n_chars", 100_000), "n_chars")


@query
def day_report(spark, folder):
    """Days of two years: orders, their value in cents and the priorities without an order."""
    day = F.to_date("o_orderdate")
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    filed = table(spark, folder, "orders").select(
        F.year(day).alias("year"), F.month(day).alias("month"), F.day(day).alias("day"),
        day.alias("capture_date"), F.col("o_orderpriority").alias("kind"),
        F.struct(cents.alias("size")).alias("out"),
    )
    report = catalogue.day_report(filed, "1996-01-01", "1997-12-31", PRIORITIES)
    return report.withColumn("lacks", F.concat_ws("+", "lacks"))


# Rankings


@query
def topk_docs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return ranks.topk(docs, ["source"], "n_chars", 3, tie="doc_id")


@query
def topk_with_ties(spark, folder):
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity")
    return ranks.topk(items, ["l_suppkey"], "l_quantity", 5)


@query
def topk_orders(spark, folder):
    """More rows a group than map tasks prune: selected by rank."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ranks.topk(orders, ["o_orderstatus"], "o_totalprice", 500, tie="o_orderkey")


@query
def as_of_latest(spark, folder):
    until = F.lit("2024-01-15").cast("timestamp_ntz")
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return ranks.as_of(events, ["user_id"], "ts", until, tie="event_id")


@query
def largest_docs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return ranks.largest(docs, 20, "n_chars", "doc_id")


# Streams


@query
def stream_records(spark, folder):
    root = order_files(spark, folder) + "/v1.1"
    arrived = streams.append_to_table(streams.stream_pointers(spark, root, suffix=".txt"))
    return flat_records(arrived)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return streams.zoned(streams.stream_table(spark, folder, "events"), "ts")


def closed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events and, last, a row ten years on, which moves the watermark past all of them."""
    events = event_stream(spark, folder)
    batch = table(spark, folder, "events")
    last = F.expr("timestamp'2034-01-01 00:00:00'")
    path = fresh_path(spark, "last-event")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in batch.schema]
    spark.range(1).select(*nothing).withColumn("ts", last).write.parquet(path)
    end = spark.readStream.schema(events.schema).parquet(path)
    return events.unionByName(end)


def unzoned(df: DataFrame) -> DataFrame:
    return df.withColumns({c: local(F.col(c)) for c, t in df.dtypes if t == "timestamp"})


@query
def stream_daily(spark, folder):
    measures = {"n_events": F.count("*"), "n_purchases": F.count_if(F.col("event_type") == "purchase")}
    return unzoned(streams.latest_result(
        streams.arrivals(event_stream(spark, folder), "ts", "1 day", measures)
    ))


@query
def stream_sliding(spark, folder):
    measures = {"n_events": F.count("*")}
    return unzoned(streams.append_to_table(
        streams.arrivals(closed_stream(spark, folder), "ts", "6 hours", measures, slide="3 hours")
    ))


@query
def stream_sessions(spark, folder):
    return unzoned(streams.append_to_table(
        streams.coverage_sessions(closed_stream(spark, folder), "ts", "30 minutes", ["user_id"])
    ))


@query
def stream_dedup(spark, folder):
    """Every event delivered twice."""
    twice = event_stream(spark, folder).union(event_stream(spark, folder))
    return unzoned(streams.append_to_table(
        streams.dedup_stream(twice, "ts", ["event_id"], "1 day")
    ))


@query
def stream_late(spark, folder):
    """Events published ``value`` minutes after they happened, late beyond an hour."""
    hundredths = F.round(F.col("value") * 100).cast("bigint")
    published = F.timestamp_micros(F.unix_micros("ts") + hundredths * 600_000)
    events = event_stream(spark, folder).withColumn("published", published)
    split = streams.late_split(events, "ts", "published", 3600)
    return unzoned(streams.append_to_table(split.select("event_id", "ts", "published", "is_late")))


@query
def stream_sets(spark, folder):
    sets = streams.day_completeness(
        event_stream(spark, folder), ["user_id"], "event_type", EVENT_TYPES, "ts"
    )
    return streams.updated_result(sets, ["user_id", "day"])


@query
def stream_alarms(spark, folder):
    """Days of a user that lack an event type when the watermark has passed them."""
    told = streams.append_to_table(streams.day_alarms(
        closed_stream(spark, folder), ["user_id"], "event_type", EVENT_TYPES, "ts"
    ))
    return told.where("NOT complete").drop("complete")
