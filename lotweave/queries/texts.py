"""Regulation corpus and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import text as tx
from lotweave.functions import vocab
from lotweave.operators import corpus
from lotweave.queries.registry import query

NUMBERED = "SELECT source, text, page_id, row_number() OVER (PARTITION BY source ORDER BY page_id) AS page_num FROM {reg_pages}"
PIECES = f"""SELECT source, page_num, k AS para_no, pieces[k + 1] AS raw FROM (SELECT source, page_num, pieces, unnest(range(len(pieces))) AS k FROM (
  SELECT source, page_num, CASE WHEN regexp_matches(text, '(?i)§\\d{{4}}|Section\\s+\\d{{4}}') THEN string_split(regexp_replace(text, '(?i)(§\\d{{4}}|Section\\s+\\d{{4}})', '\\1' || chr(1), 'g'), chr(1))
    ELSE string_split(text, chr(10) || chr(10)) END AS pieces FROM ({NUMBERED}) n) p) q"""
PARAS = f"SELECT source, page_num, para_no, p AS para, length(p) + 2 AS width FROM (SELECT source, page_num, para_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS p FROM ({PIECES}) a) b WHERE length(p) >= 50"
CHUNKS = f"""WITH RECURSIVE para AS MATERIALIZED (SELECT *, sum(width) OVER (PARTITION BY source ORDER BY page_num, para_no)::BIGINT AS s FROM ({PARAS}) p),
nexts AS MATERIALIZED (SELECT a.source, a.s, b.s AS nx FROM (SELECT source, s FROM para UNION SELECT DISTINCT source, 302 AS s FROM para) a ASOF JOIN para b ON a.source = b.source AND a.s + 1200 <= b.s),
walk AS (SELECT DISTINCT source, 302::BIGINT AS mark FROM para UNION ALL SELECT w.source, n.nx FROM walk w JOIN nexts n ON n.source = w.source AND n.s = w.mark),
marked AS (SELECT p.*, w.mark AS opened FROM para p ASOF JOIN (SELECT source, CASE WHEN mark = 302 THEN 0 ELSE mark END AS mark FROM walk) w ON w.source = p.source AND p.s > w.mark),
parts AS (SELECT source, opened, string_agg(para, chr(10) || chr(10) ORDER BY s) AS body, max(s) AS close, max_by(page_num, s) AS last_page FROM marked GROUP BY 1, 2),
closed AS (SELECT p.source, p.close, right(p.body, 300) AS lead, p.last_page FROM parts p JOIN walk w ON w.source = p.source AND w.mark = p.close AND p.close > 302),
ends AS (SELECT source, max(page_num) AS doc_last FROM ({NUMBERED}) n GROUP BY 1),
made AS (SELECT p.source, coalesce(c.last_page, 1) AS start_page, CASE WHEN d.close IS NOT NULL THEN p.last_page ELSE e.doc_last END AS end_page,
    CASE WHEN c.lead IS NOT NULL THEN concat(c.lead, chr(10) || chr(10), p.body) ELSE p.body END AS text, d.close IS NOT NULL AS full_one
  FROM parts p LEFT JOIN closed c ON c.source = p.source AND c.close = p.opened LEFT JOIN closed d ON d.source = p.source AND d.close = p.close JOIN ends e ON e.source = p.source
  UNION ALL SELECT c.source, c.last_page, e.doc_last, c.lead, FALSE FROM closed c JOIN ends e ON e.source = c.source WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.source = c.source AND p.opened = c.close)),
chunks AS (SELECT source, start_page, end_page, text FROM made WHERE full_one OR length(text) >= 100)"""


@query("c01_section_split", f"SELECT source, cast(page_num AS bigint) AS page_num, cast(para_no AS int) AS para_no, sha256(raw) AS digest, length(raw) AS size FROM ({PIECES}) p")
def _(d):
    pieces = d.pages.select("source", F.col("page_num").cast("bigint").alias("page_num"), F.posexplode(corpus.split_sections(F.col("text"))).alias("para_no", "raw"))
    return pieces.select("source", "page_num", "para_no", F.sha2("raw", 256).alias("digest"), F.length("raw").cast("bigint").alias("size"))


@query("c02_chunking", CHUNKS + " SELECT source, cast(start_page AS bigint) AS start_page, cast(end_page AS bigint) AS end_page, sha256(text) AS digest FROM chunks")
def _(d):
    c = corpus.chunk_texts(d.pages)
    return c.select("source", F.col("start_page").cast("bigint").alias("start_page"), F.col("end_page").cast("bigint").alias("end_page"), F.sha2("text", 256).alias("digest"))


@query("c02_chunking_small_blocks", CHUNKS + " SELECT source, sha256(text) AS digest FROM chunks")
def _(d):
    """The same chunks when documents are cut into many small blocks."""
    return corpus.chunk_texts(d.pages, block_chars=5_000).select("source", F.sha2("text", 256).alias("digest"))


_CATS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in vocab.ZONE_PATTERNS) + ")"


_MARKS = lambda ms: " + ".join(f"max(cast(contains(lower(text), '{m}') AS int))" for m in ms)
_BY_MARKS = f"(SELECT CASE WHEN k > c THEN '{vocab.COUNTY}' WHEN c > k THEN '{vocab.CITY}' ELSE 'Unknown' END FROM (SELECT {_MARKS(vocab.COUNTY_MARKERS)} AS k, {_MARKS(vocab.CITY_MARKERS)} AS c FROM {{reg_pages}} p WHERE p.source = chunks.source) m)"


@query("c03_chunk_metadata", CHUNKS + f""" SELECT sha256(text) AS digest, source, {_CATS} AS zone_categories,
  CASE WHEN contains(source, 'county') THEN '{vocab.COUNTY}' WHEN contains(source, 'city') THEN '{vocab.CITY}' ELSE {_BY_MARKS} END AS jurisdiction FROM chunks""")
def _(d):
    return corpus.chunks(d.pages, "2024-01-01 00:00:00").select(F.sha2("text", 256).alias("digest"), "source", "zone_categories", "jurisdiction")


@query("c04_chunk_id", CHUNKS + " SELECT concat(regexp_replace(source, '\\.[^.]*$', ''), ':', cast(start_page AS string), '-', cast(end_page AS string), ':', substr(sha256(text), 1, 16)) AS chunk_id FROM chunks")
def _(d):
    return corpus.chunks(d.pages, "2024-01-01 00:00:00").select("chunk_id")


@query("c05_corpus_ingest", CHUNKS + ", ids AS (SELECT concat(regexp_replace(source, '\\.[^.]*$', ''), ':', cast(start_page AS string), '-', cast(end_page AS string), ':', substr(sha256(text), 1, 16)) AS chunk_id, source FROM chunks)"
       " SELECT DISTINCT chunk_id FROM ids WHERE chunk_id NOT IN (SELECT chunk_id FROM ids WHERE source LIKE 'src1%')")
def _(d):
    stored = corpus.ingest(d.pages.filter(F.col("source").startswith("src1")), None)
    return corpus.ingest(d.pages, stored).select("chunk_id")


def store(d):
    """Vectors as chunks: jurisdiction, category, section and pages from the id, text from the documents."""
    return d.sql(f"""SELECT v.vec_id AS chunk_id, v.embedding, CASE v.vec_id % 3 WHEN 0 THEN '{vocab.COUNTY}' WHEN 1 THEN '{vocab.CITY}' ELSE 'Unknown' END AS jurisdiction,
  CASE v.vec_id % 4 WHEN 0 THEN 'Residential,Commercial' WHEN 1 THEN 'Agricultural' WHEN 2 THEN '' ELSE 'Commercial' END AS zone_categories,
  CASE WHEN v.vec_id % 2 = 0 THEN cast(1000 + v.vec_id AS string) ELSE '' END AS section, coalesce(x.source, '') AS source, v.vec_id % 90 AS start_page, v.vec_id % 90 + 2 AS end_page,
  coalesce(x.text, '') AS text FROM {{embeddings}} v LEFT JOIN {{documents}} x ON x.doc_id = v.vec_id""")


def questions(d):
    """One question per label: its mean vector, with a jurisdiction for even labels and a zone for some."""
    rows = d.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))
    place = F.when(F.col("label") % 2 == 0, F.when(F.col("label") % 4 == 0, vocab.COUNTY).otherwise(vocab.CITY))
    zone = F.when(F.col("label") % 3 == 0, "Commercial").when(F.col("label") % 3 == 1, "Industrial")
    return vectors.select(F.col("label").cast("bigint").alias("query_id"), "embedding", place.alias("jurisdiction"), zone.alias("zone_filter"))


HITS = f"""SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
  SELECT q.label AS query_id, v.vec_id AS chunk_id, list_sum(list_transform(list_zip(q.m, v.embedding), lambda p: (p[1] - p[2]::DOUBLE) * (p[1] - p[2]::DOUBLE))) AS distance
  FROM (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {{embeddings}}) e GROUP BY 1, 2) g GROUP BY 1) q
  JOIN {{embeddings}} v ON CASE WHEN q.label % 4 = 0 THEN v.vec_id % 3 = 0 WHEN q.label % 4 = 2 THEN v.vec_id % 3 = 1 ELSE TRUE END) z"""


@query("t10_vector_topk", f"SELECT cast(query_id AS bigint) AS query_id, chunk_id, cast(rank AS int) AS rank, round(1 - distance, 5) AS score FROM ({HITS}) h WHERE rank <= 12")
def _(d):
    hits = corpus.retrieve_candidates(questions(d), store(d), 4)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


ZONES = "CASE chunk_id % 4 WHEN 0 THEN 'Residential,Commercial' WHEN 1 THEN 'Agricultural' WHEN 2 THEN '' ELSE 'Commercial' END"
WANT = "CASE query_id % 3 WHEN 0 THEN 'Commercial' WHEN 1 THEN 'Industrial' END"


@query("t11_zone_preference", f"""SELECT cast(query_id AS bigint) AS query_id, chunk_id FROM (SELECT *, max(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_match FROM (
  SELECT *, coalesce(contains({ZONES}, {WANT}), FALSE) AS m FROM ({HITS}) h WHERE rank <= 12) a) b WHERE m OR any_match = 0""")
def _(d):
    hits = corpus.retrieve_candidates(questions(d), store(d), 4).join(store(d).select("chunk_id", "zone_categories"), "chunk_id")
    return corpus.prefer_zone(hits.join(questions(d).select("query_id", "zone_filter"), "query_id")).select("query_id", "chunk_id")


@query("t12_diversity_rerank")
def _(d):
    return corpus.retrieve(questions(d), store(d), 4).select("query_id", "place", "chunk_id", "score")


@query("p41_context_and_answers")
def _(d):
    hits = corpus.retrieve(questions(d), store(d), 6)
    parcels = questions(d).select("query_id", F.col("jurisdiction").alias("JURISDICTION"), F.lit("RS-1-7").alias("ZONING_CODE"))
    return corpus.context_text(hits, parcels).join(corpus.plain_answers(hits), "query_id")


@query("p41_excerpt_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS preview, concat('[', lang, ' §', cast(doc_id AS string), ', ', source, ' p.1-2]') AS cite FROM {documents}")
def _(d):
    return d.table("documents").select("doc_id", tx.preview(F.col("text")).alias("preview"),
                                       tx.citation(F.col("lang"), F.col("doc_id").cast("string"), F.col("source"), F.lit(1), F.lit(2)).alias("cite"))
