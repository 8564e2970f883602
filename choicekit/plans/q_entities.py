"""Registered queries: entity candidates, best match, entity JSON."""
from __future__ import annotations

from ..operators import entities as E
from ..sources.tables import table
from .fixtures import ENTITY_QUERY_KEY, entities, entity_queries, with_ctes
from .registry import register

_EK = """
ek AS (SELECT *, concat(coalesce(label, ' '), '. ', coalesce(description, ' '), '.') AS knowledge,
              lower(trim(search_term)) AS term FROM entities)"""


@register("entity_candidates", with_ctes("entities", "entity_queries") + "," + _EK + """
SELECT c.concept, ek.entity_id, ek.vec_id, ek.knowledge
FROM (SELECT DISTINCT concept FROM entity_queries) c
LEFT JOIN ek ON lower(trim(c.concept)) = ek.term""")
def q_entity_candidates(spark, sf):
    return E.candidates(entity_queries(spark, sf), entities(spark, sf))


@register("entity_best_match", with_ctes("entities", "entity_queries") + "," + _EK + """,
vec AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
qd AS (SELECT DISTINCT concept, pivot_vec_id FROM entity_queries),
sc AS (SELECT qd.concept, qd.pivot_vec_id, ek.entity_id, ek.knowledge,
              round(list_sum(list_transform(range(1, len(cv.v) + 1),
                    lambda i: cv.v[i] * pv.v[i])) / greatest(cv.n * pv.n, 1e-8), 6) AS sim
       FROM qd JOIN ek ON lower(trim(qd.concept)) = ek.term
       JOIN vec cv ON cv.vec_id = ek.vec_id JOIN vec pv ON pv.vec_id = qd.pivot_vec_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept, pivot_vec_id
                                                     ORDER BY sim DESC, entity_id) AS r
                        FROM sc) WHERE r = 1)
SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, b.entity_id, b.knowledge, b.sim
FROM entity_queries q LEFT JOIN best b
  ON q.concept = b.concept AND q.pivot_vec_id = b.pivot_vec_id""")
def q_entity_best_match(spark, sf):
    return E.best_match(entity_queries(spark, sf), entities(spark, sf),
                        table(spark, sf, "embeddings"), key=ENTITY_QUERY_KEY)


@register("entity_json", with_ctes("entities") + "," + _EK + """
SELECT search_term, entity_id, knowledge FROM ek""")
def q_entity_json(spark, sf):
    return E.parse_entity_json(E.entities_to_json(entities(spark, sf)))
