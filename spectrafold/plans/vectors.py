"""Filtered vector search over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import vector_search as v
from spectrafold.registry import register
from spectrafold.session import table

_FULL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] v, label FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x*x)) > 0),
 s AS (SELECT q.vec_id query, b.vec_id id, round(list_cosine_similarity(q.v, b.v), 12) s FROM e q JOIN e b ON {on} WHERE q.vec_id%100=0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id)::INT AS rank FROM s WHERE s >= {least})
SELECT query, id, round(s,6) AS similarity, rank FROM r WHERE rank <= {k}"""


def _answers(spark, d, k, **how):
    rows = table(spark, d, "embeddings")
    found = v.search(v.build_index(rows, "vec_id", "embedding"), rows.where("vec_id % 100 = 0"), "vec_id", "embedding", k, "vec_id", **how)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@register("nearest_vectors", _FULL.format(on="q.vec_id<>b.vec_id", least=-1, k=10))
def nearest_vectors(spark, d):
    return _answers(spark, d, 10, exclude_self=True)


@register("filtered_neighbours", _FULL.format(on="b.label%2=0", least=0.1, k=5))
def filtered_neighbours(spark, d):
    """Among the rows of even labels, of a similarity of at least 0.1."""
    return _answers(spark, d, 5, where=F.col("label") % 2 == 0, least=0.1)


@register("recommended_vectors", """WITH m AS (SELECT list(x ORDER BY i) m FROM (SELECT i, avg(embedding[i]::DOUBLE) x FROM embeddings, range(1, (SELECT max(len(embedding)) FROM embeddings)+1) r(i) WHERE label=1 GROUP BY i)),
 s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], m),12) s FROM embeddings, m WHERE label IS DISTINCT FROM 1) SELECT vec_id, round(s,6) AS similarity, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank FROM s ORDER BY s DESC, vec_id LIMIT 20""")
def recommended_vectors(spark, d):
    """Rows most like the mean of label 1."""
    rows = table(spark, d, "embeddings")
    found = v.recommend(v.build_index(rows, "vec_id", "embedding"), rows.where("label = 1"), "vec_id", "embedding", 20)
    return found.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")
