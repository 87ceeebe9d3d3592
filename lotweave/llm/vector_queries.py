"""Queries of the embedding operators."""

from lotweave.llm import embedding_links, whitening
from lotweave.llm.registry import query, table

OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT r, vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(e, lambda c: c <> 0)) > 0),
l AS (SELECT x.r AS a, y.r AS b FROM u x JOIN u y ON x.label = y.label AND x.r <> y.r AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.93),
w AS (SELECT r AS id, vec_id AS root FROM v UNION SELECT l.b AS id, w.root FROM w JOIN l ON l.a = w.id),
c AS (SELECT id, min(root) AS component_id FROM w GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN c ON c.id = v.r LEFT JOIN n ON n.a = v.r
"""


@query("op11_embedding_links", OP11_SQL)
def op11(spark, folder):
    return embedding_links.near_classes(table(spark, folder, "embeddings"))


@query("op12_embedding_whitening")
def op12(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))
