"""Queries over pages: archives, rendered text and languages."""

from pyspark.sql import functions as F

from lotweave.llm import html_text, language, rollups, warc
from lotweave.llm.common import scratch_path, written
from lotweave.llm.registry import query, table

OP2_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""


@query("op2_warc", OP2_SQL)
def op2(spark, folder):
    place = scratch_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), place)
    return warc.read(spark, place).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_html_extraction")
def op5(spark, folder):
    return html_text.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op7_language_id")
def op7(spark, folder):
    """Documents by text and source, pages by text, markup, address and host."""
    documents = table(spark, folder, "documents")
    names, scores = language.train(documents)
    none = F.lit(None).cast("string")
    by_text = documents.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), F.coalesce("text", F.lit("")).alias("text"), none.alias("declared"), none.alias("suffix"),
                               F.col("source").alias("host"), none.alias("domain"))
    host = language.host_of(F.col("url"))
    by_page = table(spark, folder, "pages").select(
        F.lit(None).cast("bigint").alias("doc_id"), "page_id", language.plain_text(F.col("html")).alias("text"), language.markup_language(F.col("html")).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -3).alias("domain"))
    return language.fuse(by_text.unionByName(by_page), names, scores)


OP8_SQL = r"""
WITH t AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS spaced,
  len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS lettered FROM documents),
l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
k AS (SELECT t.*, coalesce(toxic, 0) = 1 AS revised FROM t LEFT JOIN l USING (doc_id) WHERE coalesce(quality, 1) <> 0),
r AS (SELECT source, lang, 'space-1' AS version, CASE WHEN revised THEN lettered ELSE spaced END AS n FROM k
  UNION ALL SELECT source, lang, 'letter-1' AS version, lettered AS n FROM k)
SELECT source, lang, version, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM r GROUP BY ALL
"""


@query("op8_token_rollups", OP8_SQL)
def op8(spark, folder):
    """All documents are counted by two tokenizer versions; rows labelled poor are withdrawn, counts of toxic ones revised."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", rollups.space_words(F.col("text")).alias("spaced"), rollups.letter_words(F.col("text")).alias("lettered"))
    counted = written(docs, "counts")
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))

    def changes(rows, operation, version, tokens, old=None):
        return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(operation).alias("operation"), F.col(tokens).alias("tokens"), (F.col(old) if old else F.lit(0)).alias("old_tokens"))

    marked = counted.join(labels, "doc_id")
    poor, toxic = marked.filter("quality = 0"), marked.filter("toxic = 1 and coalesce(quality, 1) <> 0")
    rollup = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    batches = {
        "load-space": changes(counted, "insert", "space-1", "spaced"), "load-letter": changes(counted, "insert", "letter-1", "lettered"),
        "withdraw": changes(poor, "delete", "space-1", "spaced").unionByName(changes(poor, "delete", "letter-1", "lettered")),
        "revise": changes(toxic, "revise", "space-1", "lettered", "spaced")}
    for name, rows in batches.items():
        rollup.commit(name, rows)
    rollup.commit("withdraw", batches["withdraw"])  # a batch that arrives twice counts once
    return rollup.totals()
