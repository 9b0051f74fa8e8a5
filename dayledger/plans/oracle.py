"""The same results as plain SQL over the given tables."""

from __future__ import annotations

# The record every document makes, as columns.
DOCUMENT_RECORDS = r"""
doc_bytes AS (
  SELECT doc_id, source, md5(text) AS digest,
         CAST(octet_length(encode(text)) AS BIGINT) AS size
  FROM documents
), doc_fields AS (
  SELECT doc_id, digest, size,
         concat(doc_id, '.txt') AS path,
         concat('https://example.org/', source, '/', doc_id, '.txt') AS url,
         concat(format('{:x}', size), '-', substr(digest, 1, 12)) AS etag
  FROM doc_bytes
), doc_records AS (
  SELECT *, md5(concat('{"deps": [{"checksum": "\"', etag, '\"", "hash": "md5", "path": "', url,
         '"}], "outs": [{"hash": "md5", "md5": "', digest, '", "path": "', path, '"}]}')) AS stage_md5
  FROM doc_fields
)"""

# One record per month of orders and priority.
ORDER_RECORDS = r"""
totals AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, o_orderpriority AS priority, count(*) AS n,
         CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * 100 AS BIGINT)) AS BIGINT) AS size
  FROM orders GROUP BY ALL
), kinds AS (
  SELECT *, strftime(day, '%Y%m%d') AS digits,
         CASE priority WHEN '1-URGENT' THEN 'notice_csv' WHEN '2-HIGH' THEN 'notice_xml'
              WHEN '3-MEDIUM' THEN 'anomalous_csv' WHEN '4-NOT SPECIFIED' THEN 'anomalous_xml'
              ELSE 'trace' END AS kind
  FROM totals
), named AS (
  SELECT *, CASE WHEN kind <> 'trace' THEN split_part(kind, '_', 2) WHEN year(day) < 1996 THEN 'dump'
                 ELSE 'pcap' END AS format,
         concat(digits, CASE kind WHEN 'notice_csv' THEN '_notice.csv' WHEN 'notice_xml' THEN '_notice.xml'
           WHEN 'anomalous_csv' THEN '_anomalous_suspicious.csv'
           WHEN 'anomalous_xml' THEN '_anomalous_suspicious.xml'
           ELSE CASE WHEN year(day) < 1996 THEN '1400.dump.gz' ELSE '1400.pcap.gz' END END) AS path
  FROM kinds
), filed AS (
  SELECT *, md5(CAST(size AS VARCHAR)) AS md5,
         CASE kind WHEN 'trace' THEN concat(format('{:x}', size), '-', format('{:x}', n))
              ELSE CAST(n AS VARCHAR) END AS etag,
         CASE kind WHEN 'trace' THEN concat('http://traces.example.net/point/', strftime(day, '%Y/'), path)
              ELSE concat('http://labels.example.org/records/v1.1/', strftime(day, '%Y/%m/%d/'), path)
              END AS url
  FROM named
), flat AS (
  SELECT day AS capture_date, kind, format, TRUE AS frozen, 1 AS n_deps, 1 AS n_outs, TRUE AS stage_ok,
         etag, url, size AS dep_size, path, md5, size,
         CASE kind WHEN 'trace' THEN size END AS tag_size,
         CASE kind WHEN 'trace' THEN make_timestamp(n) END AS tag_modified
  FROM filed
)"""

# The text of every such record, and of the days they make.
ORDER_DAYS = ORDER_RECORDS + r""",
texts AS (
  SELECT day, concat('md5: ', md5(concat('{"deps": [{"checksum": "\"', etag, '\"", "hash": "md5", "path": "',
           url, '"}], "outs": [{"hash": "md5", "md5": "', md5, '", "path": "', path, '"}]}')), chr(10),
         'frozen: true', chr(10), 'deps:', chr(10), '- checksum: ''"', etag, '"''', chr(10),
         '  size: ', size, chr(10), '  hash: md5', chr(10), '  path: ',
         CASE WHEN length(url) > 72 THEN concat(chr(10), '    ') ELSE '' END, url, chr(10), 'outs:', chr(10),
         CASE kind WHEN 'trace' THEN concat('- md5: ', md5, chr(10), '  size: ', size, chr(10),
                '  hash: md5', chr(10), '  path: ', path, chr(10))
              ELSE concat('- hash: md5', chr(10), '  path: ', path, chr(10), '  md5: ', md5, chr(10),
                '  size: ', size, chr(10)) END) AS value
  FROM filed
), days AS (
  SELECT day, concat(string_agg(value, '' ORDER BY value), chr(10)) AS value FROM texts GROUP BY day
)"""

EVENT_DAYS = "event_days AS (SELECT *, CAST(ts AS DATE) AS day FROM events)"
USER_DAYS = "user_days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)"

SQL = {
    "scan_records": f"""
WITH {ORDER_RECORDS}
SELECT 'v1.1' AS version, * FROM flat
UNION ALL SELECT 'v1.0', * FROM flat WHERE year(capture_date) <= 1996""",
    "load_records": f"""
WITH {ORDER_RECORDS}
SELECT 'v1.1' AS version, * FROM flat
WHERE capture_date BETWEEN DATE '1995-11-15' AND DATE '1997-02-14'
  AND kind IN ('notice_csv', 'anomalous_xml', 'trace')""",
    "stream_records": f"WITH {ORDER_RECORDS} SELECT 'v1.1' AS version, * FROM flat",
    "payload_inventory": f"""
WITH {ORDER_DAYS} SELECT day, CAST(octet_length(encode(value)) AS BIGINT) AS length FROM days""",
    "payload_digests": f"""
WITH {ORDER_DAYS}
SELECT day, CAST(octet_length(encode(value)) AS BIGINT) AS length, md5(value) AS md5 FROM days""",
    "record_violations": f"""
WITH {ORDER_RECORDS}, faults AS (
  SELECT path, kind = 'trace' AS is_trace,
         CAST((year(day) * 12 + month(day) + CAST(substr(priority, 1, 1) AS INTEGER)) % 13 AS INTEGER) AS fault
  FROM filed
), broken AS (
  SELECT path, fault, unnest(CASE fault
    WHEN 1 THEN ['frozen'] WHEN 2 THEN ['hash_name'] WHEN 3 THEN ['digest_shape']
    WHEN 4 THEN ['one_dep_one_out'] WHEN 5 THEN ['sizes_agree'] WHEN 6 THEN ['name_is_file']
    WHEN 7 THEN ['name_is_url'] WHEN 8 THEN ['name_date', 'url_date'] WHEN 9 THEN ['url_date']
    WHEN 10 THEN CASE WHEN is_trace THEN ['size_positive', 'tag_size'] ELSE ['size_positive'] END
    WHEN 11 THEN CASE WHEN is_trace THEN ['tag_size'] ELSE [] END
    WHEN 12 THEN ['name_date', 'url_date', 'calendar_date'] ELSE [] END) AS rule
  FROM faults)
SELECT path, fault, rule FROM broken""",
    "content_digest": """
SELECT doc_id, md5(text) AS md5, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes
FROM documents""",
    "stage_digest": f"""
WITH {DOCUMENT_RECORDS}
SELECT doc_id, stage_md5 AS stage_digest, TRUE AS stage_ok FROM doc_records""",
    "pointer_round_trip": f"""
WITH {DOCUMENT_RECORDS}
SELECT doc_id, stage_md5, TRUE AS frozen, etag, url, size AS dep_size, path, digest AS md5, size,
       CAST(1 AS INTEGER) AS n_deps, CAST(1 AS INTEGER) AS n_outs, TRUE AS stage_ok
FROM doc_records""",
    "rendered_digest": f"""
WITH {DOCUMENT_RECORDS}
SELECT doc_id, md5(concat('md5: ', stage_md5, chr(10), 'frozen: true', chr(10), 'deps:', chr(10),
  '- checksum: ''"', etag, '"''', chr(10), '  size: ', size, chr(10), '  hash: md5', chr(10),
  '  path: ', CASE WHEN length(url) > 72 THEN concat(chr(10), '    ') ELSE '' END, url, chr(10),
  'outs:', chr(10), '- hash: md5', chr(10), '  path: ', path, chr(10), '  md5: ', digest, chr(10),
  '  size: ', size, chr(10))) AS text_md5
FROM doc_records""",
    "violations": """
SELECT doc_id, 'too_short' AS rule FROM documents WHERE n_chars < 50
UNION ALL SELECT doc_id, 'too_long' FROM documents WHERE n_chars > 5000
UNION ALL SELECT doc_id, 'not_english' FROM documents WHERE lang <> 'en'""",
    "empty_payloads": """
SELECT doc_id, lang, n_chars,
       n_chars <= CASE lang WHEN 'en' THEN 100 WHEN 'de' THEN 80 ELSE 60 END AS is_empty
FROM documents""",
    "classify_names": r"""
WITH named AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'other' WHEN o_orderstatus = 'F' THEN 'notice'
              WHEN o_orderstatus = 'P' THEN 'anomalous' ELSE 'trace' END AS what
  FROM orders)
SELECT o_orderkey,
       CASE what WHEN 'other' THEN concat('readme-', strftime(d, '%Y%m%d'))
                 WHEN 'notice' THEN concat(strftime(d, '%Y%m%d'), '_notice.csv')
                 WHEN 'anomalous' THEN concat(strftime(d, '%Y%m%d'), '_anomalous_suspicious.xml')
                 ELSE concat(strftime(d, '%Y%m%d'), '1400.pcap.gz') END AS name,
       CASE what WHEN 'notice' THEN 'notice_csv' WHEN 'anomalous' THEN 'anomalous_xml'
                 WHEN 'trace' THEN 'trace' END AS kind,
       CASE what WHEN 'notice' THEN 'notice' WHEN 'anomalous' THEN 'anomalous_suspicious' END
         AS label_set,
       CASE what WHEN 'notice' THEN 'csv' WHEN 'anomalous' THEN 'xml' WHEN 'trace' THEN 'pcap' END
         AS format,
       CASE what WHEN 'trace' THEN 'gzip' END AS compression,
       CASE WHEN what <> 'other' THEN d END AS name_date,
       CASE WHEN what = 'trace' THEN CAST(d AS TIMESTAMP) + INTERVAL 5 HOUR END AS captured_at
FROM named""",
    "classify_pages": r"""
SELECT page_id,
       nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/(\d+)', 1), '') AS lang,
       TRY_CAST(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/(\d+)', 2) AS BIGINT) AS number
FROM pages""",
    "page_url_parts": r"""
WITH parts AS (
  SELECT page_id,
         nullif(regexp_extract(url, '^([a-z]+)://', 1), '') AS url_scheme,
         nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS url_host,
         nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '') AS url_path,
         nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS url_query,
         nullif(regexp_extract(url, '#(.*)$', 1), '') AS url_fragment
  FROM pages)
SELECT *, nullif(regexp_extract(url_path, '([^/]*)$', 1), '') AS url_name,
       TRY_CAST(replace(regexp_extract(url_path, '/(\d{4}/\d{2}/\d{2})/', 1), '/', '-') AS DATE) AS url_date
FROM parts""",
    "hex_decode": """
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS tag_size,
       make_timestamp(CAST(concat('0x', substr(md5(text), 1, 12)) AS BIGINT)) AS tag_modified
FROM documents""",
    "publish_lag": """
SELECT l_orderkey, l_linenumber,
       (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000.0::DOUBLE AS lag_seconds
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "orders_in_range": """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'""",
    "orders_catalogue": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS capture_date,
       o_orderpriority AS kind, o_orderkey AS file_path
FROM orders""",
    "orders_catalogue_range": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS capture_date,
       o_orderpriority AS kind, o_orderkey AS file_path
FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1997-03-01'""",
    "catalogue_increments": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       o_orderkey AS file_path, CASE WHEN year(o_orderdate) >= 1995 THEN 2 ELSE 1 END AS published,
       CASE WHEN year(o_orderdate) >= 1995 THEN o_totalprice + 1 ELSE o_totalprice END AS total
FROM orders""",
    "labels_csv": """
SELECT CAST(l_orderkey AS INTEGER) AS "anomalyID", concat('10.0.0.', l_suppkey) AS "srcIP",
       l_linenumber AS "srcPort",
       CASE WHEN l_returnflag <> 'N' THEN concat('10.1.0.', l_suppkey) END AS "dstIP",
       CASE WHEN l_returnflag <> 'N' THEN CAST(l_partkey AS INTEGER) END AS "dstPort",
       l_returnflag AS taxonomy, CAST(l_quantity AS INTEGER) AS heuristic, l_discount AS distance,
       l_linenumber AS "nbDetectors", l_linestatus AS label, CAST(NULL AS DATE) AS capture_date,
       CAST(NULL AS VARCHAR) AS file_kind, FALSE AS damaged
FROM lineitem""",
    "labels_damaged": """
SELECT CAST(l_orderkey AS INTEGER) AS "order", l_linenumber AS line, 'matched' AS what
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_linenumber <> 4 AND l_linestatus = o_orderstatus
  AND (l_returnflag = 'R' OR l_linenumber = o_custkey % 7)
UNION ALL
SELECT CAST(l_orderkey AS INTEGER), l_linenumber, 'damaged' FROM lineitem WHERE l_linenumber = 4""",
    "labels_xml": """
SELECT doc_id, quality, toxic, CAST(NULL AS DATE) AS capture_date, CAST(NULL AS VARCHAR) AS file_kind,
       FALSE AS damaged
FROM labels""",
    "verify_join": """
WITH recorded AS (
  SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS size, md5(text) AS md5
  FROM documents
), first_copy AS (
  SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1
), mirror AS (
  SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN '' WHEN l.quality = 0 THEN replace(d.text, 'e', 'x')
                        ELSE d.text END AS text
  FROM documents d JOIN first_copy f ON f.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL SELECT -1 - item_id, text FROM benchmark
), sides AS (
  SELECT source || '/' || n_chars AS path, r.size, r.md5, TRUE AS recorded
  FROM recorded r JOIN documents d ON d.doc_id = r.doc_id
  UNION ALL
  SELECT coalesce(source || '/' || n_chars, CAST(m.doc_id AS VARCHAR)),
         CAST(octet_length(encode(m.text)) AS INTEGER), md5(m.text), FALSE
  FROM mirror m LEFT JOIN documents d ON d.doc_id = m.doc_id
), paths AS (
  SELECT path, count(*) FILTER (recorded) AS n_recorded, count(*) FILTER (NOT recorded) AS n_found,
         min(size) FILTER (recorded) AS expected_size, min(size) FILTER (NOT recorded) AS found_size,
         min(md5) FILTER (recorded) AS expected_md5, min(md5) FILTER (NOT recorded) AS found_md5
  FROM sides GROUP BY path)
SELECT path,
       CASE WHEN n_recorded > 1 OR n_found > 1 THEN 'duplicate' WHEN n_found = 0 THEN 'missing'
            WHEN n_recorded = 0 THEN 'untracked' WHEN expected_size <> found_size THEN 'size_mismatch'
            WHEN expected_md5 <> found_md5 THEN 'md5_mismatch' ELSE 'ok' END AS status,
       expected_size, found_size
FROM paths""",
    "labelled_docs": """
SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "unlabelled_docs": """
SELECT doc_id, source, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "companion_days": f"""
WITH {EVENT_DAYS},
p AS (SELECT DISTINCT user_id, day FROM event_days WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT user_id, day FROM event_days WHERE event_type = 'error')
SELECT *, 'both' AS side FROM (SELECT * FROM p INTERSECT SELECT * FROM e)
UNION ALL SELECT *, 'left_only' FROM (SELECT * FROM p EXCEPT SELECT * FROM e)
UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM e EXCEPT SELECT * FROM p)""",
    "snapshot_diff": """
WITH derived AS (
  SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'P' END
         AS state
  FROM lineitem GROUP BY l_orderkey
), sides AS (
  SELECT o_custkey, o_orderdate, o_orderstatus AS state, TRUE AS on_record FROM orders
  UNION ALL SELECT o_custkey, o_orderdate, state, FALSE FROM derived JOIN orders ON o_orderkey = l_orderkey
), months AS (
  SELECT o_custkey AS custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         count(*) FILTER (on_record) AS n_old, count(*) FILTER (NOT on_record) AS n_new,
         min(state) FILTER (on_record) AS old_state, min(state) FILTER (NOT on_record) AS new_state
  FROM sides GROUP BY 1, 2)
SELECT custkey, month,
       CASE WHEN n_old > 1 OR n_new > 1 THEN 'duplicate' WHEN n_old = 0 THEN 'added'
            WHEN n_new = 0 THEN 'removed' WHEN old_state IS NOT DISTINCT FROM new_state THEN 'unchanged'
            ELSE 'changed' END AS status,
       old_state, new_state
FROM months""",
    "snapshot_changes": """
WITH derived AS (
  SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'P' END
         AS state
  FROM lineitem GROUP BY l_orderkey
), sides AS (
  SELECT o_custkey AS custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         o_orderstatus AS state, TRUE AS on_record FROM orders
  UNION ALL
  SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE), state, FALSE
  FROM derived JOIN orders ON o_orderkey = l_orderkey
), differing AS (
  SELECT DISTINCT month, custkey % 16 AS customers FROM (
    (SELECT custkey, month, state FROM sides WHERE on_record
     EXCEPT ALL SELECT custkey, month, state FROM sides WHERE NOT on_record)
    UNION ALL
    (SELECT custkey, month, state FROM sides WHERE NOT on_record
     EXCEPT ALL SELECT custkey, month, state FROM sides WHERE on_record))
), months AS (
  SELECT custkey, month,
         count(*) FILTER (on_record) AS n_old, count(*) FILTER (NOT on_record) AS n_new,
         min(state) FILTER (on_record) AS old_state, min(state) FILTER (NOT on_record) AS new_state
  FROM sides GROUP BY 1, 2)
SELECT * FROM (
  SELECT custkey, month,
         CASE WHEN n_old > 1 OR n_new > 1 THEN 'duplicate' WHEN n_old = 0 THEN 'added'
              WHEN n_new = 0 THEN 'removed' WHEN old_state IS NOT DISTINCT FROM new_state THEN 'unchanged'
              ELSE 'changed' END AS status,
         old_state, new_state
  FROM months
  WHERE (month, custkey % 16) IN (SELECT (month, customers) FROM differing))
WHERE status <> 'unchanged'""",
    "moved_content": """
WITH moved AS (
  SELECT concat(source, '/', d.doc_id) AS home, concat('labelled/', d.doc_id) AS path,
         md5(text) AS md5
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT m.path, m.md5, s.moved_from, s.n_sources
FROM moved m
JOIN (SELECT md5, min(home) AS moved_from, count(*) AS n_sources FROM moved GROUP BY md5) s
  ON s.md5 = m.md5""",
    "reconcile_quality": """
SELECT coalesce(l.doc_id, d.doc_id) AS doc_id,
       CASE WHEN d.doc_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM (SELECT doc_id FROM labels WHERE quality = 1) l
FULL OUTER JOIN (SELECT doc_id FROM documents WHERE n_chars >= 500) d ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL OR d.doc_id IS NULL""",
    "match_labels": """
WITH rules AS (
  SELECT c_custkey, c_name AS rule,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'F' END AS status,
         CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN '1-URGENT' END AS priority
  FROM customer)
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, rule
FROM orders JOIN rules ON o_custkey = c_custkey
 AND (status IS NULL OR status = o_orderstatus) AND (priority IS NULL OR priority = o_orderpriority)
""",
    "volume_by_kind": """
SELECT source, lang, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes
FROM documents GROUP BY ALL""",
    "volume_rollup": """
SELECT l_returnflag, l_linestatus, count(*) AS files,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes,
       CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "volume_cube": """
SELECT o_orderstatus, o_orderpriority, count(*) AS files,
       sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS bytes,
       CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "volume_grouping_sets": """
SELECT l_returnflag, l_linestatus, count(*) AS files,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes,
       CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
    "size_distribution": """
SELECT source, count(n_chars) AS n_rows, min(n_chars) AS min_value,
       CAST(quantile_cont(n_chars, 0.25) AS DOUBLE) AS q1,
       CAST(quantile_cont(n_chars, 0.5) AS DOUBLE) AS median,
       CAST(quantile_cont(n_chars, 0.75) AS DOUBLE) AS q3,
       round(CAST(quantile_cont(n_chars, 0.99) AS DOUBLE), 6) AS p99,
       max(n_chars) AS max_value
FROM documents GROUP BY source""",
    "duplicate_content": """
WITH d AS (
  SELECT doc_id, md5(text) AS md5, CAST(octet_length(encode(text)) AS INTEGER) AS size
  FROM documents
), g AS (
  SELECT md5, size, count(*) AS copies, min(doc_id) AS first_key FROM d GROUP BY 1, 2
)
SELECT doc_id, md5, size, copies, first_key FROM d JOIN g USING (md5, size) WHERE copies > 1""",
    "duplicate_groups": """
SELECT md5(text) AS md5, CAST(octet_length(encode(text)) AS INTEGER) AS size, count(*) AS copies,
       min(doc_id) AS first_key, max(doc_id) AS last_key
FROM documents GROUP BY 1, 2 HAVING count(*) > 1""",
    "tag_collisions": """
WITH d AS (SELECT concat(source, '-', n_chars) AS tag, md5(text) AS md5 FROM documents)
SELECT 'tag_with_digests' AS direction, tag AS value, count(DISTINCT md5) AS n_values
FROM d GROUP BY tag HAVING count(DISTINCT md5) > 1
UNION ALL
SELECT 'digest_with_tags', md5, count(DISTINCT tag) FROM d GROUP BY md5
HAVING count(DISTINCT tag) > 1""",
    "kind_matrix": """
SELECT CAST(ts AS DATE) AS day,
       CAST(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS INTEGER) AS click,
       CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS error,
       CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS purchase,
       CAST(max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS INTEGER) AS signup,
       CAST(max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS INTEGER) AS view
FROM events GROUP BY 1""",
    "kind_signature": f"""
WITH {EVENT_DAYS}, sets AS (
  SELECT user_id, day, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS signature
  FROM event_days GROUP BY 1, 2)
SELECT signature, count(*) AS n_keys FROM sets GROUP BY 1""",
    "cardinality": """
SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type,
       count(DISTINCT CAST(ts AS DATE)) AS day
FROM events""",
    "sketched_cardinality": """
SELECT 'user_id' AS field, count(DISTINCT user_id) AS n_distinct, TRUE AS within_bound FROM events
UNION ALL SELECT 'event_type', count(DISTINCT event_type), TRUE FROM events
UNION ALL SELECT 'event_id', count(DISTINCT event_id), TRUE FROM events""",
    "sketched_quantiles": """
SELECT l_returnflag, count(*) AS n_rows, TRUE AS q1, TRUE AS median, TRUE AS q3, TRUE AS p99
FROM lineitem GROUP BY l_returnflag""",
    "extremes": """
SELECT source, arg_min(n_chars, (n_chars, doc_id)) AS min_value,
       arg_min(doc_id, (n_chars, doc_id)) AS min_key, max(n_chars) AS max_value,
       arg_min(doc_id, (-n_chars, doc_id)) AS max_key
FROM documents GROUP BY source""",
    "label_profile": """
SELECT quality, lang, count(*) AS rows, count(DISTINCT source) AS distinct_source
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (quality, lang)""",
    "missing_days": f"""
WITH {USER_DAYS}, calendar AS (
  SELECT CAST(d AS DATE) AS day
  FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) t(d))
SELECT user_id, day AS missing_day FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN calendar
EXCEPT SELECT user_id, day FROM user_days""",
    "missing_cells": f"""
WITH {EVENT_DAYS}
SELECT user_id, day, kind AS missing_kind
FROM (SELECT DISTINCT user_id, day FROM event_days)
CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS kind)
EXCEPT SELECT user_id, day, event_type FROM event_days""",
    "missing_cells_of_days": f"""
WITH {EVENT_DAYS}
SELECT user_id, CAST(day AS DATE) AS day, kind AS missing_kind
FROM (SELECT DISTINCT user_id FROM event_days)
CROSS JOIN generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) AS calendar(day)
CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS kind)
EXCEPT SELECT user_id, day, event_type FROM event_days""",
    "user_days_in_all": f"""
WITH {EVENT_DAYS}
SELECT user_id, day FROM event_days WHERE event_type = 'purchase'
INTERSECT SELECT user_id, day FROM event_days WHERE event_type = 'error'""",
    "user_days_in_any": f"""
WITH {EVENT_DAYS}
SELECT user_id, day FROM event_days WHERE event_type = 'purchase'
UNION SELECT user_id, day FROM event_days WHERE event_type = 'error'""",
    "coverage_gaps": f"""
WITH {USER_DAYS}, steps AS (
  SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS previous FROM user_days)
SELECT user_id, CAST(previous + INTERVAL 1 DAY AS DATE) AS gap_start,
       CAST(day - INTERVAL 1 DAY AS DATE) AS gap_end, CAST(day - previous - 1 AS INTEGER) AS n_days
FROM steps WHERE day - previous > 1""",
    "coverage_runs": f"""
WITH {USER_DAYS}, numbered AS (
  SELECT user_id, day,
         day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run
  FROM user_days)
SELECT user_id, min(day) AS run_start, max(day) AS run_end, count(*) AS n_days
FROM numbered GROUP BY user_id, run""",
    "type_transitions": """
SELECT event_id, ts, user_id, event_type, previous FROM (
  SELECT event_id, ts, user_id, event_type,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous
  FROM events)
WHERE previous <> event_type""",
    "rolling_orders": """
WITH days AS (
  SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS total FROM orders GROUP BY 1)
SELECT day, total, CAST(sum(total) OVER w AS BIGINT) AS rolling_sum,
       sum(total) OVER w / 7.0::DOUBLE AS rolling_mean
FROM days
WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""",
    "yearly_growth": """
WITH years AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS total FROM orders GROUP BY 1)
SELECT period, total, lag(total) OVER (ORDER BY period) AS previous_total,
       total - lag(total) OVER (ORDER BY period) AS change
FROM years""",
    "robust_outliers": """
WITH m AS (
  SELECT source, CAST(quantile_cont(n_chars, 0.5) AS DOUBLE) AS median FROM documents GROUP BY 1
), s AS (
  SELECT source, median, CAST(quantile_cont(abs(n_chars - median), 0.5) AS DOUBLE) AS mad
  FROM documents JOIN m USING (source) GROUP BY 1, 2
)
SELECT doc_id, source, n_chars, median, mad FROM documents JOIN s USING (source)
WHERE abs(n_chars - median) > 3.5::DOUBLE * 1.4826::DOUBLE * mad""",
    "byte_bins": """
SELECT doc_id, n_chars, CAST((running - n_chars) // 100000 AS BIGINT) AS bin
FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS running FROM documents)""",
    "byte_bin_totals": """
SELECT CAST((running - n_chars) // 100000 AS BIGINT) AS bin, count(*) AS files,
       CAST(sum(n_chars) AS BIGINT) AS bytes
FROM (SELECT n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS running FROM documents) GROUP BY 1""",
    "day_report": """
WITH calendar AS (
  SELECT CAST(d AS DATE) AS day
  FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1997-12-31', INTERVAL 1 DAY) t(d)
), cells AS (
  SELECT day, kind, o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * 100 AS BIGINT) AS cents
  FROM calendar
  CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS kind)
  LEFT JOIN orders ON CAST(o_orderdate AS DATE) = day AND o_orderpriority = kind
)
SELECT day AS capture_date, count(o_orderkey) AS files,
       CAST(coalesce(sum(cents), 0) AS BIGINT) AS bytes,
       coalesce(string_agg(DISTINCT kind, '+' ORDER BY kind) FILTER (WHERE o_orderkey IS NULL), '')
         AS lacks
FROM cells GROUP BY day""",
    "topk_docs": """
SELECT doc_id, source, n_chars, CAST(place AS INTEGER) AS rank FROM (
  SELECT doc_id, source, n_chars,
         row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place
  FROM documents)
WHERE place <= 3""",
    "topk_with_ties": """
SELECT l_suppkey, l_orderkey, l_quantity, CAST(place AS INTEGER) AS rank FROM (
  SELECT l_suppkey, l_orderkey, l_quantity,
         rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS place
  FROM lineitem)
WHERE place <= 5""",
    "topk_orders": """
SELECT * FROM (
  SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(row_number() OVER (
    PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
  FROM orders) WHERE rank <= 500""",
    "as_of_latest": """
SELECT event_id, user_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
  FROM events WHERE ts <= TIMESTAMP '2024-01-15')
WHERE place = 1""",
    "largest_docs": """
SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20""",
    "stream_daily": """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start,
       date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, count(*) AS n_events,
       count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases
FROM events GROUP BY ALL""",
    "stream_sliding": """
WITH starts AS (
  SELECT time_bucket(INTERVAL 3 HOUR, ts) - step AS window_start
  FROM events CROSS JOIN (SELECT unnest([INTERVAL 0 HOUR, INTERVAL 3 HOUR]) AS step))
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n_events
FROM starts GROUP BY ALL""",
    "stream_sessions": """
WITH steps AS (
  SELECT user_id, ts,
         CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS is_first
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), numbered AS (
  SELECT user_id, ts, sum(is_first) OVER (PARTITION BY user_id ORDER BY ts
                                          ROWS UNBOUNDED PRECEDING) AS n
  FROM steps)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
       count(*) AS n_rows
FROM numbered GROUP BY user_id, n""",
    "stream_dedup": "SELECT DISTINCT * FROM events",
    "stream_late": """
SELECT event_id, ts, to_microseconds(CAST(round(value * 100) AS BIGINT) * 600000) + ts AS published,
       CAST(round(value * 100) AS BIGINT) * 600000 > 3600000000 AS is_late
FROM events""",
    "stream_sets": f"""
WITH {EVENT_DAYS}
SELECT user_id, day, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS seen,
       count(DISTINCT event_type) = 5 AS complete
FROM event_days GROUP BY 1, 2""",
    "stream_alarms": f"""
WITH {EVENT_DAYS}
SELECT user_id, day, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS seen
FROM event_days GROUP BY 1, 2 HAVING count(DISTINCT event_type) < 5""",
}
