"""Query over near-duplicate classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import neardup
from .common import table


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count, component and whether it stays."""
    return neardup.classes(table(spark, sf_dir, "documents"))


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
ORACLES = {
    "op7_near_duplicates": r"""
        WITH RECURSIVE cut AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM cut
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM sets
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), least AS (
            SELECT a, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN least ON least.a = sets.doc_id
    """,
}
