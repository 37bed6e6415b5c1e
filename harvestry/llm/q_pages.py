"""Queries over captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import revisits, wrappers
from .common import table


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a crawl of the pages, resolved; headers as sorted text."""
    rows = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return rows.select("record_id", "url", "canonical_url", "ts", "refers_to", "digest", "outcome", text.alias("headers"))


QUERIES = {"op4_revisits": op4_revisits, "op8_main_text": op8_main_text}
ORACLES = {
    "op4_revisits": r"""
        WITH t AS (
            SELECT CAST(page_id AS BIGINT) AS p, url, md5(coalesce(html, '')) AS digest, regexp_replace(trim(url), '#.*$', '') AS u FROM pages
        ), parts AS (
            SELECT *, '"' || substr(digest, 1, 16) || '"' AS tag, 'day ' || CAST(p % 365 AS VARCHAR) AS date,
                lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme,
                regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)), '^[^@]*@', '') AS authority,
                regexp_extract(u, '^[A-Za-z]+://[^/?]*(/[^?]*)', 1) AS path,
                list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'),
                    lambda x: x <> '' AND NOT regexp_matches(lower(regexp_extract(x, '^([^=]*)', 1)), '^(utm_[a-z]+|fbclid|gclid|dclid|msclkid|sessionid|jsessionid|phpsessid|sid)$'))) AS kept
            FROM t
        ), named AS (
            SELECT *, CASE WHEN scheme IN ('http', 'https') AND authority <> '' THEN
                scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(authority, ':80$', '') ELSE regexp_replace(authority, ':443$', '') END
                || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END
                ELSE u END AS target FROM parts
        ), again AS (
            SELECT p * 2 + 1 AS record_id, url, target, p * 10 + 5 + p % 9 * 1000 AS ts, date,
                CASE p % 4 WHEN 0 THEN tag WHEN 1 THEN tag WHEN 2 THEN '"other"' END AS etag FROM named
        ), joined AS (
            SELECT a.*, f.p AS fp, f.tag AS ftag, f.date AS fdate, f.digest AS fdigest
            FROM again a ASOF LEFT JOIN (SELECT *, p * 10 AS at FROM named WHERE target IS NOT NULL) f ON a.target = f.target AND a.ts > f.at
        ), judged AS (
            SELECT *, CASE WHEN fp IS NULL THEN 'missing' WHEN CASE WHEN etag IS NOT NULL THEN etag = ftag ELSE date = fdate END THEN 'resolved' ELSE 'mismatch' END AS outcome FROM joined
        )
        SELECT record_id, url, target AS canonical_url, ts, fp * 2 AS refers_to, CASE WHEN outcome = 'resolved' THEN fdigest END AS digest, outcome,
            CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600; content-type: text/html; date: ' || date || '; etag: ' || ftag || '; x-page: ' || CAST(fp AS VARCHAR) END AS headers
        FROM judged
    """.replace("\\\\", "\\"),
}
