"""Queries that fit a model on some rows of the given tables and apply it to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import language
from .base import R6, query, table

_S = language.SMOOTHING


@query(f"""
WITH t AS (SELECT doc_id, lang, text, ' ' || lower(substr(coalesce(text, ''), 1, {language.CHARS})) || ' ' AS h FROM documents),
g AS (SELECT doc_id, lang, text, unnest(list_transform(range(1, length(h) - 1), lambda i: substr(h, i, {language.SIZE}))) AS gram FROM t),
c AS (SELECT lang AS language, gram, count(*) AS n FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL AND length(text) > 0 GROUP BY ALL),
u AS (SELECT language, ln({_S}::DOUBLE / (sum(n) + {_S}::DOUBLE * (SELECT count(DISTINCT gram) FROM c))) AS base FROM c GROUP BY language),
d AS (SELECT doc_id, gram, count(*) AS n FROM g WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL),
s AS (SELECT doc_id, language, sum(d.n * ln((c.n + {_S}::DOUBLE) / {_S}::DOUBLE)) AS gain FROM d JOIN c USING (gram) GROUP BY ALL),
e AS (SELECT doc_id, language, coalesce(gain, 0) / m.n + base AS score
      FROM (SELECT doc_id, sum(n) AS n FROM d GROUP BY doc_id) m CROSS JOIN u LEFT JOIN s USING (doc_id, language)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS k FROM e),
l AS (SELECT doc_id, max(language) FILTER (WHERE k = 1) AS language, max(score) FILTER (WHERE k = 1) - max(score) FILTER (WHERE k = 2) AS lead FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(lead, 0) >= {language.MARGIN} THEN language ELSE '{language.UNKNOWN}' END AS language, round(coalesce(lead, 0), 6) AS lead
FROM documents LEFT JOIN l USING (doc_id)
""")
def language_id(spark: SparkSession, d: str) -> DataFrame:
    """Languages of all documents by n-grams of four fifths of them."""
    docs = table(spark, d, "documents")
    return language.identify(docs, language.fit(docs.where("doc_id % 5 <> 0"))).withColumn("lead", R6(F.col("lead")))
