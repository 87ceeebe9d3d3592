"""Queries of packing, decontamination and toxicity."""

from lotweave.llm import packing, toxicity, winnowing
from lotweave.llm.registry import query, table
from pyspark.sql import functions as F

OP10_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS span,
        unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda p: array_to_string(ws[p:p + least(len(ws), 10) - 1], ' '))) AS win FROM i WHERE len(ws) > 0),
dw AS (SELECT doc_id, span, unnest(range(1, len(ws) - span + 2)) AS p, unnest(list_transform(range(1, len(ws) - span + 2), lambda p: array_to_string(ws[p:p + span - 1], ' '))) AS win
        FROM d, (SELECT DISTINCT span FROM iw) s),
h AS (SELECT doc_id, p, span, item_id FROM dw JOIN iw USING (span, win)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + span)) AS q FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op3_packing")
def op3(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query("op10_decontamination", OP10_SQL)
def op10(spark, folder):
    found = winnowing.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op1_toxicity")
def op1(spark, folder):
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
