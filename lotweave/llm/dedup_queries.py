"""Queries of the two deduplication operators."""

from lotweave.llm import exact_dedup, near_join
from lotweave.llm.registry import query, table

OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, md5_number(unnest(sh)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT u.b AS id, r.root FROM r JOIN u ON u.a = r.id WHERE r.root < u.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id FROM n JOIN c ON c.id = n.doc_id
"""


@query("op4_exact_dedup", OP4_SQL)
def op4(spark, folder):
    return exact_dedup.decide(table(spark, folder, "documents"))


@query("op9_ngram_jaccard_join", OP9_SQL)
def op9(spark, folder):
    return near_join.near_classes(table(spark, folder, "documents"), words=3, percent=90)
