"""Queries of safe sharing: names of users and kinds of events, replaced in texts that are derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import sharing
from tracewell.session import table


def _values(spark, d):
    e = table(spark, d, "events")
    users = e.select(F.lit("user").alias("category"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), "event_id")
    return users.unionByName(e.select(F.lit("kind").alias("category"), F.col("event_type").alias("name"), "event_id"))


def shared_texts(spark, d):
    """u1 is part of u12, and of names that no user has: only whole names are replaced."""
    texts = table(spark, d, "events").selectExpr("event_id", "concat('u', CAST(user_id AS STRING), ' (', event_type, ') xu', CAST(user_id AS STRING), ' u', CAST(user_id AS STRING), '_', event_type, '.') AS text")
    return sharing.shared_rows(texts, "text", _values(spark, d), "category", "name", "event_id")[0]


def shared_dictionary(spark, d):
    return sharing.numbered_placeholders(_values(spark, d), "category", "name", "event_id")


QUERIES = {f.__name__: f for f in (shared_texts, shared_dictionary)}

_DICTIONARY = """WITH v AS (SELECT 'user' AS category, 'u' || user_id AS name, event_id FROM events UNION ALL SELECT 'kind', event_type, event_id FROM events),
n AS (SELECT category, name, row_number() OVER (PARTITION BY category ORDER BY min(event_id), name) AS k FROM v GROUP BY 1, 2),
p AS (SELECT category, name, upper(category) || '_' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS placeholder FROM n)"""
ORACLES = {
    "shared_dictionary": f"{_DICTIONARY} SELECT * FROM p",
    "shared_texts": f"{_DICTIONARY} SELECT event_id, u.placeholder || ' (' || t.placeholder || ') xu' || user_id || ' u' || user_id || '_' || event_type || '.' AS text FROM events JOIN p u ON u.category = 'user' AND u.name = 'u' || user_id JOIN p t ON t.category = 'kind' AND t.name = event_type",
}
