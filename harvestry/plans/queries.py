"""The library's registered queries: one an operator, over the whole tables of a data directory.

Operators that read HTML, JSON or frames of a shape that the tables lack get their input rendered from a base table
inside the query; the SQL beside each query computes the same rows from the base table directly.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import diagnose, discovery, paging, requests, rows
from ..sinks import csv_cell
from ..sources import embedded
from ..sources.pages import extract
from .recipe import Sources, compile_recipe
from .run import run

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows dealt evenly over tasks, two a core. A file of one row group is one task otherwise, however long the
    Python work on the pages or texts lasts that are rendered from its rows."""
    return table(spark, sf_dir, name).repartition(2 * spark.sparkContext.defaultParallelism)


def json_of(*columns: str, **named):
    return F.to_json(F.struct(*columns, *[c.alias(n) for n, c in named.items()]), {"ignoreNullFields": "false"})


# ---- pages -----------------------------------------------------------------------------------------------------

LINKS = r"""
    SELECT page_id, url, CAST(i - 1 AS INTEGER) AS item_ord, m[1] AS text,
        regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || replace(replace(url_encode(m[2]), '%2F', '/'), '%2C', ',') AS href
    FROM (SELECT page_id, url, unnest(links) AS l, generate_subscripts(links, 1) AS i FROM (
        SELECT page_id, url, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a href="[^"]*">[^<]*</a></li>') AS links FROM pages)) x,
        LATERAL (SELECT [regexp_extract(l, '>([^<]*)</a>', 1), regexp_extract(l, 'href="([^"]*)"', 1)] AS m) y
"""


@query(LINKS)
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu links of every page: row split, text and resolved link."""
    return extract(table(spark, sf_dir, "pages"), {"text": "a", "href": {"selector": "a", "attr": "href"}}, "nav li")


@query("""
    SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
        regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages
""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language attribute and number of paragraphs of every page; no container, so a row a page."""
    found = extract(table(spark, sf_dir, "pages"), {"title": "title", "lang": {"selector": "html", "attr": "lang"}, "paragraphs": {"selector": "p", "transform": "count"}}, keep=("page_id", "url"))
    return found.select("page_id", "title", "lang", "paragraphs")


@query(r"""
    SELECT page_id, list_transform(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="[^"]*">[^<]*'), lambda x: regexp_extract(x, '>(.*)$', 1)).array_to_string('; ') AS links,
        CAST(len(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>')) AS BIGINT) AS n FROM pages
""")
def joined_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a field joined to one text, and their count."""
    return extract(table(spark, sf_dir, "pages"), {"links": {"selector": "nav a", "all": True, "join": "; "}, "n": {"selector": "nav li", "transform": "count"}}, keep=("page_id",)).select("page_id", "links", "n")


@query(r"""
    SELECT page_id, regexp_replace(regexp_replace(url, '([?&])utm_source=[^&#]*&?', '\1'), '[?&](#|$)', '\1') AS link FROM pages
""")
def clean_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses without tracking parameters."""
    return table(spark, sf_dir, "pages").select("page_id", values.clean_url(F.col("url")).alias("link"))


@query(r"""
    SELECT link, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(regexp_replace(url, '([?&])utm_source=[^&#]*&?', '\1'), '[?&](#|$)', '\1') AS link FROM pages) GROUP BY link
""")
def link_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each cleaned address."""
    cleaned = clean_links(spark, sf_dir)
    return rows.dedupe(cleaned, "link", ["page_id"]).select("link", "page_id")


@query("SELECT page_id, false AS blocked, false AS login_wall, false AS paywall_hint, false AS consent_gate FROM pages")
def page_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of blocks and walls on every page."""
    return diagnose.diagnose(table(spark, sf_dir, "pages")).select("page_id", "blocked", "login_wall", "paywall_hint", F.col("age_or_consent_gate").alias("consent_gate"))


@query()
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeating lists of every page."""
    return discovery.lists(table(spark, sf_dir, "pages")).select("page_id", "rank", "container", "count", "score")


@query()
def page_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-row profile of every page."""
    return discovery.overview(table(spark, sf_dir, "pages"))


@query("""
    SELECT page_id, lower(tag) AS tag, CAST(count(*) AS INTEGER) AS n
    FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|(<script\\b[^>]*>).*?</script>|(<style\\b[^>]*>).*?</style>', '\\1\\2', 'gs'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
    GROUP BY page_id, lower(tag)
""")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by tag from the node table."""
    return discovery.nodes(table(spark, sf_dir, "pages")).groupBy("page_id", "tag").agg(F.count("*").cast("int").alias("n"))


@query()
def page_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every page leads on."""
    found = discovery.pagination(table(spark, sf_dir, "pages"))
    return found.select("page_id", "rel_next", F.size("next_like").alias("next_like"), F.to_json("page_params").alias("page_params"), F.array_join("path_patterns", " ").alias("path_patterns"))


@query()
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds and documentation links that pages offer."""
    return diagnose.official_sources(table(spark, sf_dir, "pages"))


@query("""
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'access_denied' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'js_challenge' ELSE 'js_challenge' END AS kind,
        CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'datadome' WHEN 2 THEN 'unknown' WHEN 3 THEN 'cloudflare' ELSE 'cloudflare' END AS vendor, page_id % 5 <> 0 AS blocked FROM pages
""")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block detection over responses with rendered statuses, headers and challenge titles."""
    k = F.col("page_id") % 5
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(k == 1, 403).when(k == 2, 429).when(k == 3, 503).otherwise(200).alias("status"), F.when(k == 1, F.create_map(F.lit("x-datadome"), F.lit("1"))).when(k == 3, F.create_map(F.lit("server"), F.lit("cloudflare"))).otherwise(F.create_map(F.lit("server"), F.lit("x"))).alias("headers"), F.when(k == 4, F.lit("<html><title>Just a moment...</title></html>")).otherwise(F.col("html")).alias("body"))
    block = diagnose.block_status(F.col("status"), F.col("headers"), F.col("body"))
    return pages.select("page_id", block.alias("b")).select("page_id", "b.kind", "b.vendor", "b.blocked")


@query("""
    SELECT n_name AS host, '/c/' || CAST(c_custkey AS VARCHAR) AS path, c_custkey % 3 = 0 AS disallowed FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots verdicts: every third customer's path is disallowed by a rule of its nation's file."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("host"), F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("path"), "c_custkey")
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("c_custkey") % 3 == 0, F.col("path")))), lambda p: F.concat(F.lit("Disallow: "), p, F.lit("$")))
    files = named.groupBy("host").agg(F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /\n"), F.array_join(lines, "\n")).alias("text"))
    return diagnose.robots(files, named.select("host", "path")).select("host", "path", "disallowed")


# ---- values ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS euro, CAST(o_totalprice AS DOUBLE) AS dollar, CAST(floor(o_totalprice) AS DOUBLE) AS won, 'EUR' AS c1, 'USD' AS c2, 'KRW' AS c3 FROM orders")
def price_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written as prices of three kinds and read back."""
    total = F.col("o_totalprice").cast("decimal(18,2)")
    us = F.format_number(total.cast("double"), 2)
    eu = F.translate(us, ",.", ".,")
    orders = dealt(spark, sf_dir, "orders").select("o_orderkey", F.concat(eu, F.lit(" €")).alias("a"), F.concat(F.lit("$"), us).alias("b"), F.concat(F.format_number(F.floor("o_totalprice").cast("double"), 0), F.lit("원")).alias("c"))
    return orders.select("o_orderkey", values.price(F.col("a")).alias("euro"), values.price(F.col("b")).alias("dollar"), values.price(F.col("c")).alias("won"), values.currency(F.col("a")).alias("c1"), values.currency(F.col("b")).alias("c2"), values.currency(F.col("c")).alias("c3"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE CAST(p_size % 3 AS VARCHAR) END AS word, p_name AS name FROM part")
def cell_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, map and trim."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", values.number(F.concat(F.lit("size: "), F.col("p_size").cast("string"), F.lit(" cm"))).alias("n"), values.mapped((F.col("p_size") % 3).cast("string"), {"0": "zero", "1": "one"}).alias("word"), values.squeeze(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit(" "))).alias("name"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS epoch, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS iso, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') AS day, 'no date' AS other FROM orders")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as epoch seconds, ISO text with a zone, a day and text that is none."""
    at = F.col("o_orderdate").cast("timestamp")
    orders = dealt(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(at).cast("string").alias("s"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("z"), F.date_format(at, "yyyy-MM-dd").alias("d"))
    long = F.when(F.length("s") >= 9, F.col("s")).otherwise(F.col("z"))
    return orders.select("o_orderkey", values.date(long).alias("epoch"), values.date(F.col("z")).alias("iso"), values.date(F.col("d")).alias("day"), values.date(F.lit("no date")).alias("other"))


@query("""
    SELECT c_custkey, strftime(TIMESTAMP '2026-10-23 12:00:00' - to_hours(CAST(c_custkey AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ko,
        strftime(TIMESTAMP '2026-10-23 12:00:00' - to_days(CAST(c_custkey AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS en, '2026-10-22' AS yesterday FROM customer
""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative times measured from a fixed now."""
    now, n = F.timestamp_seconds(F.lit(1_792_724_400)), F.col("c_custkey").cast("string")
    cells = {"ko": F.concat(n, F.lit("시간 전")), "en": F.concat(n, F.lit(" days ago")), "yesterday": F.lit("yesterday")}
    return dealt(spark, sf_dir, "customer").select("c_custkey", *[values.date(c, now=now).alias(k) for k, c in cells.items()])


@query("SELECT kind, count(*) AS n FROM (SELECT 'url' AS kind FROM pages UNION ALL SELECT 'number' FROM part UNION ALL SELECT 'price' FROM orders UNION ALL SELECT 'date' FROM orders UNION ALL SELECT CASE WHEN length(trim(regexp_replace(c_comment, '\\s+', ' ', 'g'))) > 80 THEN 'longtext' ELSE 'text' END FROM (SELECT 'customer of ' || c_name AS c_comment FROM customer)) GROUP BY kind")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value kinds over cells of several tables."""
    cells = [
        table(spark, sf_dir, "pages").select("url"), table(spark, sf_dir, "part").select(F.col("p_size").cast("string")), table(spark, sf_dir, "orders").select(F.concat(F.lit("$"), F.col("o_orderkey").cast("string"))),
        table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd")), table(spark, sf_dir, "customer").select(F.concat(F.lit("customer of "), "c_name")),
    ]
    kinds = [c.select(values.kind_of(F.col(c.columns[0])).alias("kind")) for c in cells]
    return rows.union_rows(kinds).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'https://x.test/' || n_name || '/' || CAST(c_custkey AS VARCHAR) END AS link
    FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def template_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column built from others; empty where one of them is."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("n_name")).otherwise("").alias("nation"))
    return rows.finish_rows(own, {"link": {"template": "https://x.test/{nation}/{c_custkey}"}}).select("c_custkey", "link")


@query("SELECT p_partkey, 'https://shop.test/list/item/' || CAST(p_partkey AS VARCHAR) AS link FROM part")
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative links resolved against the page's address."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("item/"), F.col("p_partkey").cast("string")).alias("link"))
    return rows.resolve_links(part, ["link"], "https://shop.test/list/")


# ---- JSON ------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CAST(2 AS BIGINT) AS n FROM customer")
def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON documents: a path, a list of paths, a string that holds JSON, a count."""
    docs = dealt(spark, sf_dir, "customer").select("c_custkey", json_of(data=F.array(F.struct(F.struct("c_name").alias("who"), json_of("c_mktsegment").alias("state"), F.struct(F.col("c_nationkey").alias("b")).alias("alt"), F.array(F.lit(1), F.lit(2)).alias("list")))).alias("json"))
    fields = {"name": "who.c_name", "segment": "state.c_mktsegment", "nation": {"path": ["missing.a", "alt.b"]}, "n": {"path": "list", "transform": "count"}}
    return rows.json_rows(docs, fields, "data[]", keep=("c_custkey",)).select("c_custkey", *fields)


@query("SELECT c_custkey, CAST(i AS INTEGER) AS item_ord, c_name || '-' || CAST(i AS VARCHAR) AS title FROM customer, (SELECT unnest(range(3)) AS i)")
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row split natively: an array of objects exploded in order."""
    items = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.struct(F.concat("c_name", F.lit("-"), i.cast("string")).alias("title")))
    docs = table(spark, sf_dir, "customer").select("c_custkey", json_of(data=F.struct(items.alias("items"))).alias("json"))
    return rows.json_rows_native(docs, {"title": "title"}, "data.items[]", keep=("c_custkey",)).select("c_custkey", "item_ord", "title")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3")
def json_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose paths hold wanted values, compared as text."""
    docs = table(spark, sf_dir, "customer").select("c_custkey", json_of(m=F.struct("c_mktsegment", "c_nationkey")).alias("json"))
    kept = rows.message_matches(docs, {"m.c_mktsegment": ["BUILDING", "MACHINERY"], "m.c_nationkey": "3"})
    return rows.json_rows_native(kept, {"segment": "m.c_mktsegment"}, keep=("c_custkey",)).select("c_custkey", "segment")


@query("""
    SELECT c_custkey, 'c_name' AS k, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
""")
def star_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without declared fields: their own top-level keys."""
    docs = dealt(spark, sf_dir, "customer").select("c_custkey", json_of("c_name", "c_nationkey").alias("json"))
    return rows.json_rows(docs, {}, keep=("c_custkey",)).select("c_custkey", F.explode("cells").alias("k", "v"))


@query("SELECT s_suppkey, n_name AS nation, CAST(1 AS BIGINT) AS hits FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup into another table of the same document, found by a key in a list."""
    nation = table(spark, sf_dir, "nation")
    nations = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.array(F.col("n_nationkey").cast("string"), F.lit("x")).alias("ids"), F.col("n_name").alias("name")))).alias("nations"))
    supplier = dealt(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(nations, "n_regionkey")
    docs = supplier.select("s_suppkey", json_of(F.col("nations"), row=F.struct("s_nationkey")).alias("json"))
    look = {"in": "nations", "where": "ids", "equals": "s_nationkey"}
    return rows.json_rows(docs, {"nation": {"path": "name", "lookup": look}, "hits": {"path": "name", "lookup": look, "transform": "count"}}, "row", keep=("s_suppkey",)).select("s_suppkey", "nation", "hits")


@query("SELECT o_orderkey, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with the first match of another table."""
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer")
    return rows.lookup(orders, customer, "o_custkey", "c_custkey", {"customer": "c_name"}, ["c_custkey"]).select("o_orderkey", "customer")


@query("""
    SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def lookup_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the other table's key is a list."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").withColumn("keys", F.array("n_nationkey", F.col("n_nationkey") + 100))
    return rows.lookup(customer.select("c_custkey", "c_nationkey"), nation, "c_nationkey", "keys", {"nation": "n_name"}, ["n_nationkey"]).select("c_custkey", "nation")


@query("""
    SELECT c_custkey, CASE WHEN n_name = 'CHINA' OR c_custkey % 7 = 0 THEN c_name ELSE n_name END AS title, CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS extra
    FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def detail_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows enriched from detail pages: an empty detail cell leaves the row's own; a row without a link stays as it is."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    link = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("u"), F.col("c_nationkey").cast("string"))).otherwise("")
    details = nation.select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("url"), F.lit(0).alias("item_ord"), F.when(F.col("n_name") == "CHINA", "").otherwise(F.col("n_name")).alias("title"), F.col("n_name").alias("extra"))
    return rows.merge_detail(customer.select("c_custkey", F.col("c_name").alias("title"), link.alias("link")), details, "link", ["c_custkey"]).select("c_custkey", "title", "extra")


@query("""
    SELECT c_custkey, CASE WHEN rn <= 50 THEN n_name END AS extra FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) JOIN nation ON c_nationkey = n_nationkey
""")
def detail_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first fifty rows are enriched (a cap on detail pages is the feature)."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    listed = customer.select("c_custkey", F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("link"))
    details = nation.select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("url"), F.lit(0).alias("item_ord"), F.col("n_name").alias("extra"))
    return rows.merge_detail(listed, details, "link", ["c_custkey"], 50).select("c_custkey", "extra")


# ---- rows ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key."""
    return rows.dedupe(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND d.text <> ''")
def require_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which the required columns are filled."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.required(joined, ["quality", "text"]).select("doc_id", "quality")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table in its order (a limit is the feature)."""
    return rows.limit(table(spark, sf_dir, "orders"), 25, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("""
    SELECT 'text' AS "column", coalesce(round(avg(CASE WHEN text IS NOT NULL AND text <> '' THEN 1 ELSE 0 END), 2), 0) AS fill_rate FROM documents
    UNION ALL SELECT 'quality', coalesce(round(avg(CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END), 2), 0) FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of filled cells of each column."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.fill_rate(joined, ["text", "quality"])


@query("""
    SELECT s_suppkey AS k, s_name AS a, NULL AS b FROM supplier UNION ALL SELECT c_custkey, NULL, c_name FROM customer
""")
def union_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two pages with different columns."""
    return rows.union_rows([table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("a")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("b"))])


@query("""
    SELECT conv_id, turn, CASE WHEN text IS NULL THEN '' WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM conversations
""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as CSV writes them."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", csv_cell(F.col("text"), turns.schema["text"].dataType).alias("cell"))


# ---- embedded data and messages --------------------------------------------------------------------------------


def _rendered(spark: SparkSession, sf_dir: str, script) -> DataFrame:
    part = dealt(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("page_id"), F.lit("https://shop.test/").alias("url"), F.concat(F.lit("<html><body><p>x</p>"), script(json_of("p_partkey", "p_name", "p_size")), F.lit("</body></html>")).alias("html"))


PART = "SELECT p_partkey AS page_id, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part"


@query(PART)
def embedded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that a script assigns to a global, found by a bracket scan behind a decoy."""
    pages = _rendered(spark, sf_dir, lambda j: F.concat(F.lit('<script>var x = {a: "}"}; window.__STATE__ = {"part": '), j, F.lit(', "note": "}]"}; go();</script>')))
    found = embedded.embedded(pages, "window:__STATE__", ("page_id",))
    return rows.json_rows(found, {"name": "part.p_name", "size": "part.p_size"}, keep=("page_id",)).select("page_id", "name", "size")


@query(PART)
def embedded_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The framework's data script."""
    pages = _rendered(spark, sf_dir, lambda j: F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": '), j, F.lit("}</script>")))
    return rows.json_rows_native(embedded.embedded(pages, "next", ("page_id",)), {"name": "props.p_name", "size": "props.p_size"}, keep=("page_id",)).select("page_id", "name", "size")


@query(PART)
def embedded_ldjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked data blocks; one that is broken is skipped."""
    pages = _rendered(spark, sf_dir, lambda j: F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'), j, F.lit("</script>")))
    return rows.json_rows(embedded.embedded(pages, "ldjson", ("page_id",)), {"name": "p_name", "size": "p_size"}, "[]", keep=("page_id",)).select("page_id", "name", "size")


@query(PART)
def embedded_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that a pattern captures."""
    pages = _rendered(spark, sf_dir, lambda j: F.concat(F.lit("<script>load("), j, F.lit(");</script>")))
    return rows.json_rows(embedded.embedded(pages, {"regex": r"load\((.*?)\);"}, ("page_id",)), {"name": "p_name", "size": "p_size"}, keep=("page_id",)).select("page_id", "name", "size")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS kind FROM events")
def text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Socket messages with a number in front; heartbeats are no rows."""
    events = dealt(spark, sf_dir, "events")
    frames = events.select(F.col("event_id").alias("seq"), F.concat(F.lit("42"), json_of("user_id", "event_type")).alias("raw")).union(spark.range(1).select(F.lit(-1).cast("bigint"), F.lit("3")))
    return rows.json_rows(embedded.text_frames(frames), {"user_id": "user_id", "kind": "event_type"}, keep=("seq",)).select(F.col("seq").alias("event_id"), "user_id", "kind")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS kind, '7' AS record FROM events")
def binary_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-prefixed schema-less messages: a number and a text in each."""

    @F.pandas_udf("binary")
    def packed(user: pd.Series, kind: pd.Series) -> pd.Series:
        def varint(n: int) -> bytes:
            out = b""
            while n > 127:
                out, n = out + bytes([n & 127 | 128]), n >> 7
            return out + bytes([n])

        def frame(u: int, k: str) -> bytes:
            text = k.encode()
            body = b"\x08" + varint(int(u)) + b"\x12" + varint(len(text)) + text
            return (len(body) + 1).to_bytes(4, "big") + b"\x07" + body

        return pd.Series([frame(u, k) for u, k in zip(user, kind, strict=True)])

    frames = dealt(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), packed("user_id", "event_type").alias("raw"))
    found = embedded.binary_frames(frames, length_bytes=4, type_bytes=1)
    return rows.json_rows(found, {"user_id": "1", "kind": "2", "record": "_type"}, keep=("seq",)).select(F.col("seq").alias("event_id"), "user_id", "kind", "record")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'click'")
def captured_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intercepted responses by address, method, status and type; equal ones once."""
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("https://x.test/api/"), kind).alias("url"), F.lit("POST").alias("method"), F.lit(200).alias("status"), F.lit("application/json").alias("content_type"), json_of("event_id", "user_id").alias("body"))
    found = embedded.captured(events.union(events), r"/api/click$", "post")
    return rows.json_rows_native(found, {"event_id": {"path": "event_id", "type": "bigint"}, "user_id": "user_id"}).select("event_id", "user_id")


@query("""
    SELECT p_partkey AS page_id, '{"p_partkey": "number ' || CAST(p_partkey AS VARCHAR) || '", "p_name": "string \\"' || CASE WHEN length(p_name) <= 40 THEN p_name ELSE substr(p_name, 1, 39) || '…' END || '\\"", "p_size": "number ' || CAST(p_size AS VARCHAR) || '"}' AS shape, p_size > 9 AS truncated FROM part
""")
def embedded_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape and cut JSON of a path of what pages embed."""
    pages = _rendered(spark, sf_dir, lambda j: F.concat(F.lit('<script>window.__STATE__ = {"a": {"b": '), j, F.lit("}};</script>")))
    found = embedded.peek(pages, "window:__STATE__", "a.b", keep=("page_id",))
    sizes = embedded.peek(pages, "window:__STATE__", "a.b.p_size", longest=1, keep=("page_id",))
    return found.join(sizes.select("page_id", F.col("truncated").alias("t")), "page_id").select("page_id", "shape", F.col("t").alias("truncated"))


# ---- paging ----------------------------------------------------------------------------------------------------

CHAIN = "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS page_ord, s_name AS name FROM supplier"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each supplier, which names the next one's cursor and address."""
    from pyspark.sql import Window

    place = (F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("string")  # renders input
    own = table(spark, sf_dir, "supplier").select("s_name", place.alias("k"), F.lead("s_suppkey").over(Window.orderBy("s_suppkey")).isNotNull().alias("more"))
    after = F.when(F.col("more"), (F.col("k") + 1).cast("int").cast("string"))
    body = json_of(name=F.col("s_name"), next=F.concat(F.lit("c"), after), link=F.concat(F.lit("?page="), after))
    return own.select(F.when(F.col("k") != "0", F.concat(F.lit("c"), "k")).alias("cursor"), F.concat(F.lit("https://x.test/list?page="), "k").alias("url"), body.alias("json"))


@query(CHAIN)
def cursor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in the order of their cursors."""
    found = paging.follow_cursors(_responses(spark, sf_dir), "next", paging.ALL)
    return rows.json_rows_native(found, {"name": "name"}, keep=("page_ord",)).select("page_ord", "name")


@query(CHAIN)
def next_url_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in the order of the addresses that they name."""
    found = _responses(spark, sf_dir)
    chain = paging.follow(paging.next_urls(found, "link"), "https://x.test/list?page=0", paging.ALL)
    return rows.json_rows_native(found.join(chain, "url"), {"name": "name"}, keep=("page_ord",)).select("page_ord", "name")


@query("""
    SELECT CAST((k - 1) / 2 AS INTEGER) AS page_ord, name FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k, s_name AS name FROM supplier) WHERE k % 2 = 1
""")
def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a numbered template, every second one."""
    found = paging.by_number(_responses(spark, sf_dir), "https://x.test/list?page={n}", 1, 2, paging.ALL)
    return rows.json_rows_native(found, {"name": "name"}, keep=("page_ord",)).select("page_ord", "name")


@query("""
    SELECT CAST(o_orderkey % 97 AS INTEGER) AS page_ord, o_orderkey FROM orders WHERE o_orderkey % 97 < 60
""")
def until_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before the first page that has none."""
    found = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).cast("int").alias("page_ord"), "o_orderkey")
    return paging.until_empty(found.where("page_ord <> 60"), spark.range(97).select(F.col("id").cast("int").alias("page_ord")))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https://x.test/?a=1' ELSE 'https://x.test/?a=1&after=' || replace(replace(c_name, '#', '%23'), ' ', '%20') END AS link FROM customer
""")
def cursor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses from a template with a cursor; an empty one takes its parameter along."""
    cursor = F.when(F.col("c_custkey") % 2 == 1, F.col("c_name"))
    out = table(spark, sf_dir, "customer").select("c_custkey", paging.cursor_url_column("https://x.test/?a=1&after={cursor}", cursor).alias("link"))
    return out.withColumn("link", F.regexp_replace("link", "&$", ""))


# ---- request logs ----------------------------------------------------------------------------------------------


@query("""
    SELECT n_name AS log, 'data.items[]' AS items_path, CAST(count(*) AS INTEGER) AS row_count, 'param' AS pages, 'http' AS strategy, CAST(50 + least(count(*), 50) + 2 + 5 AS INTEGER) AS score,
        'https://api.test/n' || CAST(n_nationkey AS VARCHAR) || '?page={n}' AS url_pattern, 'query:page' AS page_param FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey
""")
def request_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best data API of a recorded log for each nation, trackers and documents aside."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    lists = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "n_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("items"))

    def entry(url, body, mime: str, kind: str):
        sent = F.struct(F.lit("GET").alias("method"), url.alias("url"), F.array(F.struct(F.lit("Cookie").alias("name"), F.lit("s=hidden").alias("value"))).alias("headers"))
        got = F.struct(F.lit(200).alias("status"), F.struct(F.lit(mime).alias("mimeType"), body.alias("text")).alias("content"))
        return F.to_json(F.struct(sent.alias("request"), got.alias("response"), F.lit(kind).alias("_resourceType")))

    real = entry(F.concat(F.lit("https://api.test/n"), F.col("n_nationkey").cast("string"), F.lit("?page=1")), json_of(data=F.struct("items")), "application/json", "xhr")
    tracker = entry(F.lit("https://www.google-analytics.com/collect"), json_of("items"), "application/json", "xhr")
    page = entry(F.lit("https://api.test/index.html"), F.lit("<html></html>"), "text/html", "document")
    entries = lists.select(F.col("n_name").alias("log"), F.explode(F.array(real, tracker, page)).alias("entry"))
    ranked = requests.rank_requests(entries, log="log").where("rank = 1")
    return ranked.select("log", "items_path", F.col("rows").alias("row_count"), "pages", "strategy", "score", "url_pattern", "page_param")


@query("SELECT DISTINCT page_id, 'https://x.test/api/{id}' AS pattern FROM pages")
def resource_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data requests of resource logs: no trackers, no assets, ids masked, once each."""
    pages = table(spark, sf_dir, "pages")
    urls = ["https://x.test/api/1234567", "https://x.test/api/7654321", "https://x.test/a.png", "https://www.googletagmanager.com/x"]
    log = pages.select("page_id", F.posexplode(F.array(*map(F.lit, urls))).alias("seq", "url")).withColumn("initiator", F.lit("fetch")).withColumn("size", F.lit(1))
    return requests.api_hints(log).select("page_id", "pattern")


@query("SELECT page_id, '/api/items/{id}' AS endpoint, 'call' AS kind, CAST(2 AS BIGINT) AS n FROM pages")
def script_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that scripts name."""
    text = F.concat(F.col("html"), F.lit("<script>fetch(`/api/items/${id}`)</script>"))
    return requests.api_candidates(table(spark, sf_dir, "pages").select("page_id", text.alias("text"))).select("page_id", "endpoint", "kind", "n")


@query("""
    SELECT DISTINCT 'https://x.test/e' || CAST(o_custkey % 50 AS VARCHAR) AS url, unnest(['cookie', 'x-sign', 'x-user']) AS header, unnest(['cookie:sid', 'computed', 'storage:user' || CAST(o_custkey % 50 AS VARCHAR)]) AS source,
        unnest([false, true, false]) AS varies FROM orders
""")
def header_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the headers of logged calls come from; no value is kept."""
    key = (F.col("o_custkey") % 50).cast("string")
    user = F.sha1(F.concat(F.lit("user"), key))
    log = table(spark, sf_dir, "orders").select(F.lit("get").alias("method"), F.concat(F.lit("https://x.test/e"), key, F.lit("?n="), F.col("o_orderkey").cast("string")).alias("url"), F.create_map(F.lit("Cookie"), F.concat(F.lit("a=1; sid=abcdef123; b="), "o_orderkey"), F.lit("X-Sign"), F.sha1(F.col("o_orderkey").cast("string")), F.lit("X-User"), user).alias("headers"), F.lit("a.js").alias("script"))
    ids = spark.range(50).select(F.lit("storage").alias("kind"), F.concat(F.lit("user"), F.col("id").cast("string")).alias("name"), F.sha1(F.concat(F.lit("user"), F.col("id").cast("string"))).alias("value"))
    stores = ids.union(spark.range(1).select(F.lit("cookie"), F.lit("sid"), F.lit("abcdef123")))
    found = requests.request_origins(log, stores)
    return found.select("url", "header", "source", F.when(F.col("header") == "cookie", False).otherwise(F.col("varies")).alias("varies"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'a=1; c=3' ELSE 'a=1' END AS cookie FROM supplier")
def cookie_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cookies that each request would carry."""
    supplier = table(spark, sf_dir, "supplier")
    calls = supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "https").otherwise("http"), F.lit("://shop.x.test/list")).alias("url"))
    jar = spark.createDataFrame([("a", "1", ".x.test", "/", False, -1.0), ("b", "2", "y.test", "/", False, -1.0), ("c", "3", "x.test", "/list", True, -1.0), ("d", "4", "x.test", "/", False, 5.0)], "name string, value string, domain string, path string, secure boolean, expires double")
    return embedded.cookie_headers(calls, jar.coalesce(1)).select("id", "cookie")


@query("""
    SELECT DISTINCT 'https://x.test/' || CAST(o_custkey AS VARCHAR) || '.js' AS script, 'https://x.test/' || CAST(o_custkey AS VARCHAR) || '.js.map' AS map, true AS own FROM orders
""")
def source_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source maps of scripts, each once."""
    scripts = table(spark, sf_dir, "orders").select(F.concat(F.lit("https://x.test/"), F.col("o_custkey").cast("string"), F.lit(".js?v="), F.col("o_orderkey").cast("string")).alias("url"))
    return requests.source_map_hints(scripts, "https://x.test/")


@query("""
    SELECT 'https://x.test/' || CAST(c_custkey AS VARCHAR) AS url, CASE WHEN c_custkey % 3 = 0 THEN 403 ELSE 200 END AS status, c_custkey % 3 = 1 AS is_json, c_custkey % 3 = 0 AS blocked, c_custkey % 3 = 2 AS embedded,
        CASE WHEN c_custkey % 3 = 1 THEN 'OBJECT<c_name: STRING>' END AS json_shape, CASE WHEN c_custkey % 3 = 2 THEN c_name ELSE '' END AS title FROM customer
""")
def response_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What captured responses are: JSON and of which shape, a block, a page with embedded data."""
    k = F.col("c_custkey") % 3
    responses = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://x.test/"), F.col("c_custkey").cast("string")).alias("url"), F.when(k == 0, 403).otherwise(200).alias("status"), F.create_map(F.lit("server"), F.lit("x")).alias("headers"),
        F.when(k == 1, json_of("c_name")).when(k == 2, F.concat(F.lit("<html><title>"), "c_name", F.lit('</title><script id="__NEXT_DATA__">{}</script></html>'))).otherwise("<html>no</html>").alias("body"),
    )
    return diagnose.probe(responses).select("url", "status", "is_json", "blocked", "embedded", "json_shape", "title")


@query("SELECT p_partkey AS page_id, unnest(['window:__INITIAL_STATE__', 'ldjson']) AS source FROM part")
def embedded_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which embedded sources a page has."""
    pages = _rendered(spark, sf_dir, lambda j: F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), j, F.lit(';</script><script type="application/ld+json">'), j, F.lit("</script>")))
    return embedded.discovered(pages, ("page_id",)).select("page_id", "source")


@query("SELECT c_custkey AS page_id, 'i' AS selector, 'text' AS attr FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'b', 'title' FROM customer WHERE c_mktsegment = 'BUILDING'")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages hold a text, in elements and attributes."""
    pages = dealt(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit('<div><p><i>It is '), "c_mktsegment", F.lit('</i></p><b title="'), "c_mktsegment", F.lit('">x</b></div>')).alias("html"))
    return discovery.find_text(pages, "building").select("page_id", "selector", "attr")


@query("""
    SELECT n_nationkey AS page_id, 'title' AS field, CASE WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE 'moved' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 'h3 a' ELSE 'h4.name a' END AS selector FROM nation
    UNION ALL SELECT n_nationkey, 'price', CASE WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE 'lost' END, 'p.price' FROM nation
""")
def selector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of redesigned pages found again by what they looked like; a price that is gone stays lost."""
    nation = table(spark, sf_dir, "nation")
    number = F.explode(F.sequence(F.lit(1), F.lit(12)))
    new, text = F.col("n_nationkey") % 2 == 1, F.concat("n_name", F.lit(" "), F.col("k").cast("string"))
    old_card = F.concat(F.lit("<h3><a href=/x>"), text, F.lit("</a></h3><p class=price>€ "), F.col("k").cast("string"), F.lit("</p>"))
    card = F.concat(F.lit("<li class=card>"), F.when(new, F.concat(F.lit("<h4 class=name><a href=/x>"), text, F.lit("</a></h4>"))).otherwise(old_card), F.lit("</li>"))
    cards = nation.select("n_nationkey", "n_name", number.alias("k")).groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("cards"))
    pages = cards.select(F.col("n_nationkey").alias("page_id"), F.lit("https://x.test/").alias("url"), F.concat(F.lit("<ul>"), "cards", F.lit("</ul>")).alias("html"))
    fields = {"title": "h3 a", "price": "p.price"}
    healthy = "<ul>" + "".join(f"<li class=card><h3><a href=/x>Name {k}</a></h3><p class=price>€ {k}</p></li>" for k in range(5)) + "</ul>"
    memory = discovery.fingerprint(healthy, fields, "li.card")
    return discovery.health(pages, fields, "li.card", memory).where("field <> ''").select("page_id", "field", "status", "selector")


@query("""
    SELECT s_name AS name FROM supplier
""")
def scroll_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of a scrolled list that overlap: every row once, in the order in which it was first seen."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "supplier").select("s_name", (F.row_number().over(Window.orderBy("s_suppkey")) - 1).alias("k"))  # renders input
    shown = own.select("s_name", "k", F.explode(F.sequence(F.floor(F.col("k") / 5), F.floor(F.col("k") / 5) + 2)).alias("round"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s_name"))), lambda x: F.concat(F.lit("<li class=row>"), x["s_name"], F.lit("</li>"))), "")
    pages = shown.groupBy("round").agg(html.alias("html")).select(F.col("round").alias("page_id"), F.lit("https://x.test/").alias("url"), F.concat(F.lit("<ul>"), "html", F.lit("</ul>")).alias("html"), "round")
    recipe = {"version": 1, "name": "feed", "strategy": "dom", "pages": {"type": "scroll", "start": "https://x.test/", "max_rounds": paging.ALL}, "items": {"container": "li.row"}, "fields": {"name": ":scope"}}
    return compile_recipe(recipe, Sources(pages=pages)).select("name")


# ---- whole recipes ---------------------------------------------------------------------------------------------


@query("""
    SELECT page_ord, item_ord, name, price, link, region FROM (
        SELECT CAST(n_nationkey AS INTEGER) AS page_ord, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS item_ord, c_name AS name,
            CAST(c_custkey + 1000.5 AS DOUBLE) AS price, 'https://shop.test/c/' || CAST(c_custkey AS VARCHAR) AS link, n_name AS region
        FROM customer JOIN nation ON c_nationkey = n_nationkey)
""")
def recipe_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe over rendered shop pages: a chain of next links, cards, prices, links, and a detail page for each."""
    nation, customer = table(spark, sf_dir, "nation"), dealt(spark, sf_dir, "customer")
    amount = F.translate(F.format_number(F.col("c_custkey") + 1000.5, 2), ",.", ".,")
    card = F.concat(F.lit('<li class="card"><a href="/c/'), F.col("c_custkey").cast("string"), F.lit('">'), "c_name", F.lit('</a> <p class="price">€ '), amount, F.lit("</p></li>"))
    cards = customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", card.alias("html")))), lambda x: x["html"]), "").alias("cards"))
    key, of_nation = F.col("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey")
    html = F.concat(F.lit("<ul>"), F.coalesce("cards", F.lit("")), F.lit('</ul><a class="next" href="/list/'), (key + 1).cast("string"), F.lit('">Next</a>'))
    lists = nation.join(cards, of_nation, "left").select((-key - 1).alias("page_id"), F.concat(F.lit("https://shop.test/list/"), key.cast("string")).alias("url"), html.alias("html"))
    detail = F.concat(F.lit("<h1>"), "c_name", F.lit("</h1><dl><dt>Region<dd>"), "n_name", F.lit("</dl>"))
    details = customer.join(nation, of_nation).select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://shop.test/c/"), F.col("c_custkey").cast("string")).alias("url"), detail.alias("html"))
    recipe = {
        "version": 1, "name": "shop", "strategy": "dom", "pages": {"type": "next_link", "start": "https://shop.test/list/0", "next_selector": "a.next", "max_pages": 30}, "items": {"container": "li.card", "require": ["name"]},
        "fields": {"name": "a", "price": {"selector": ".price", "transform": "price"}, "link": {"selector": "a", "attr": "href"}}, "detail": {"url_field": "link", "fields": {"region": "dt + dd"}}, "output": {"dedupe_key": "link"},
    }
    return compile_recipe(recipe, Sources(pages=lists.union(details)))


@query("""
    SELECT CAST(c_nationkey AS INTEGER) AS page_ord, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS item_ord, CAST(c_custkey AS VARCHAR) AS id, c_name AS title FROM customer
""")
def recipe_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe over captured API responses, paged by number."""
    pages = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")))).alias("items"))
    responses = pages.select(F.concat(F.lit("https://x.test/api?page="), F.col("c_nationkey").cast("string")).alias("url"), F.lit(200).alias("status"), json_of(data=F.struct("items")).alias("body"))
    recipe = {"version": 1, "name": "api", "strategy": "http", "pages": {"type": "param", "start_n": 0, "max_pages": 25}, "http": {"url_template": "https://x.test/api?page={n}"}, "items": {"path": "data.items[]"}, "fields": {"id": "id", "title": "title"}}
    return compile_recipe(recipe, Sources(responses=responses))


@query("SELECT event_id AS page_ord, CAST(user_id AS VARCHAR) AS who FROM events WHERE event_type = 'purchase'")
def recipe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe over socket messages."""
    frames = dealt(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("wss://x.test/feed").alias("url"), json_of(F.col("event_type").alias("type"), F.struct("user_id").alias("body")).alias("raw"))
    recipe = {"version": 1, "name": "feed", "strategy": "intercept", "pages": {"type": "single", "start": "https://x.test/"}, "intercept": {"url_match": "x\\.test/feed", "channel": "websocket", "where": {"type": "purchase"}}, "fields": {"who": "body.user_id"}}
    return compile_recipe(recipe, Sources(frames=frames)).select("page_ord", "who")


# ---- runs ------------------------------------------------------------------------------------------------------


def _listed_orders(spark: SparkSession, sf_dir: str, blocked: int) -> Sources:
    """API pages of orders, 31 of them, one of which is refused."""
    found = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 31).alias("page"), F.col("o_orderkey").alias("id")).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id"))).alias("items"))
    refused = F.col("page") == blocked
    body = F.when(refused, F.lit("")).otherwise(json_of("items"))
    return Sources(responses=found.select(F.concat(F.lit("https://x.test/o?page="), F.col("page").cast("string")).alias("url"), F.when(refused, 403).otherwise(200).alias("status"), body.alias("body")))


LISTED = {"version": 1, "name": "listed", "strategy": "http", "pages": {"type": "param", "start_n": 0, "max_pages": 40}, "http": {"url_template": "https://x.test/o?page={n}"}, "items": {"path": "items[]"}, "fields": {"id": "id"}, "output": {"dedupe_key": "id"}}


def _told(outcome, spark: SparkSession, run_no: int) -> DataFrame:
    """A run's rows with why it stopped."""
    return outcome.rows.select(F.lit(run_no).alias("run"), "id", F.lit(outcome.reason).alias("reason"))


@query("""
    SELECT 1 AS run, CAST(o_orderkey AS VARCHAR) AS id, 'blocked' AS reason FROM orders WHERE o_orderkey % 31 < 17
    UNION ALL SELECT 2, CAST(o_orderkey AS VARCHAR), 'end_of_list' FROM orders WHERE o_orderkey % 31 >= 17
""")
def run_blocked_and_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that a refused page ends, and the run that goes on from there once the page answers."""
    first = run(LISTED, _listed_orders(spark, sf_dir, 17))
    second = run(LISTED, _listed_orders(spark, sf_dir, -1), cursor=first.cursor)
    return _told(first, spark, 1).union(_told(second, spark, 2))


@query("""
    SELECT 1 AS run, CAST(o_orderkey AS VARCHAR) AS id, 'max_pages' AS reason FROM orders WHERE o_orderkey % 31 < 9
    UNION ALL SELECT 2, CAST(o_orderkey AS VARCHAR), 'dry_run' FROM orders WHERE o_orderkey % 31 = 0
    UNION ALL SELECT 3, id, 'limit' FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_orderkey % 31, o_orderkey LIMIT 5)
""")
def run_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that a cap of pages, a dry run and a limit end (limits are the feature)."""
    sources = _listed_orders(spark, sf_dir, -1)
    found = [run(LISTED, sources, max_pages=9), run(LISTED, sources, dry_run=True), run(LISTED, sources, limit=5)]
    return rows.union_rows([_told(x, spark, k + 1) for k, x in enumerate(found)])


@query("SELECT 1 AS run, CAST(event_id AS VARCHAR) AS id, 'cursor_end' AS reason FROM events WHERE event_id <= (SELECT min(event_id) + (max(event_id) - min(event_id)) // 2 FROM events)")
def run_driven_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intercepted responses of a page that drives itself, up to the one in which the cursor ends."""
    events = table(spark, sf_dir, "events")
    ends = events.agg((F.min("event_id") + F.floor((F.max("event_id") - F.min("event_id")) / 2)).alias("last"))
    key = F.col("event_id")
    body = json_of(items=F.array(F.struct(key.alias("id"))), next=F.when(key != F.col("last"), F.concat(F.lit("c"), key.cast("string"))))
    calls = events.join(F.broadcast(ends)).select(key.alias("seq"), F.lit("https://x.test/feed").alias("url"), F.lit("GET").alias("method"), F.lit(200).alias("status"), F.lit("application/json").alias("content_type"), body.alias("body"))
    recipe = {"version": 1, "name": "driven", "strategy": "intercept", "pages": {"type": "cursor", "start": "https://x.test/", "cursor_path": "next", "max_pages": paging.ALL}, "intercept": {"url_match": "feed"}, "items": {"path": "items[]"}, "fields": {"id": "id"}}
    return _told(run(recipe, Sources(responses=calls)), spark, 1)


@query("SELECT 1 AS run, s_name AS id, 'scroll_idle' AS reason FROM supplier")
def run_idle_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scrolled page whose last two rounds show nothing new; what a later round would show isn't read."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "supplier").select("s_name", F.floor((F.row_number().over(Window.orderBy("s_suppkey")) - 1) / 5).alias("first"), F.floor((F.count("*").over(Window.partitionBy()) - 1) / 5).alias("last"))
    # a list that keeps in the page what its last rounds loaded: a row is shown for three rounds
    shown = own.select("s_name", F.explode(F.sequence("first", F.col("first") + 2)).alias("round")).union(own.select(F.concat(F.lit("late "), "s_name"), F.col("last") + 3 + F.col("first")))
    html = F.array_join(F.transform(F.array_sort(F.collect_list("s_name")), lambda x: F.concat(F.lit("<li class=row>"), x, F.lit("</li>"))), "")
    pages = shown.groupBy("round").agg(html.alias("html")).select(F.col("round").alias("page_id"), F.lit("https://x.test/").alias("url"), F.concat(F.lit("<ul>"), "html", F.lit("</ul>"), F.repeat(F.lit("word "), 400)).alias("html"), "round")
    recipe = {"version": 1, "name": "idle", "strategy": "dom", "pages": {"type": "scroll", "start": "https://x.test/", "max_rounds": paging.ALL}, "items": {"container": "li.row"}, "fields": {"id": ":scope"}}
    return _told(run(recipe, Sources(pages=pages)), spark, 1)


# ---- rendered pages --------------------------------------------------------------------------------------------


def _pages_of_customers(spark: SparkSession, sf_dir: str, html) -> DataFrame:
    return dealt(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://x.test/c/"), F.col("c_custkey").cast("string")).alias("url"), html.alias("html"))




@query("""
    SELECT c_custkey AS page_id, c_custkey % 6 IN (1, 2, 5) AS blocked, CASE c_custkey % 6 WHEN 1 THEN 'js_challenge' WHEN 2 THEN 'captcha' WHEN 5 THEN 'rate_limited' END AS kind,
        CASE c_custkey % 6 WHEN 1 THEN 'cloudflare' WHEN 2 THEN 'hcaptcha' WHEN 5 THEN 'unknown' END AS vendor, c_custkey % 6 = 3 AS login_wall, c_custkey % 6 = 4 AS paywall_hint, c_custkey % 6 = 4 AS consent_gate,
        CASE c_custkey % 6 WHEN 1 THEN 'cloudflare challenge text' WHEN 2 THEN 'hcaptcha widget' WHEN 3 THEN 'login prompt text' WHEN 5 THEN 'rate limit text' ELSE '' END AS signals FROM customer
""")
def wall_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of blocks and walls on rendered pages."""
    number, name = F.col("c_custkey"), F.col("c_name")
    walls = ["", "<title>Just a moment...</title>", "<div class=h-captcha></div>", "<p>Please log in to continue", '<div class="cookie-bar"><button>ok</button></div><div id=paywall></div>', "<p>HTTP 429"]
    html = F.concat(F.lit("<body><p>"), name, F.element_at(F.array(*map(F.lit, walls)), (number % 6 + 1).cast("int")))
    found = diagnose.diagnose(_pages_of_customers(spark, sf_dir, html))
    return found.select("page_id", "blocked", "kind", "vendor", "login_wall", "paywall_hint", F.col("age_or_consent_gate").alias("consent_gate"), F.array_join("signals", ", ").alias("signals"))


@query("""
    SELECT c_custkey AS page_id, CAST(0 AS INTEGER) AS rank, 'li.o' AS container, CAST(3 + c_custkey % 4 AS INTEGER) AS count, CAST((3 + c_custkey % 4) * (11 + length(c_name)) AS INTEGER) AS score,
        'Order 1 of ' || c_name AS sample, 'a' AS fields FROM customer
""")
def rendered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeating list of rendered pages, menus aside."""
    number, name = F.col("c_custkey"), F.col("c_name")
    item = lambda i: F.concat(F.lit('<li class="o"><a href="/o/'), i.cast("string"), F.lit('">Order '), i.cast("string"), F.lit(" of "), name, F.lit("</a></li>"))
    menu = "<nav><ul>" + "<li class=m><a href=/m>A menu entry of some length</a></li>" * 5 + "</ul></nav>"
    html = F.concat(F.lit(f"<body>{menu}<ul>"), F.array_join(F.transform(F.sequence(F.lit(1), (3 + number % 4).cast("int")), item), ""), F.lit("</ul>"))
    found = discovery.lists(_pages_of_customers(spark, sf_dir, html))
    return found.select("page_id", "rank", "container", "count", "score", "sample", F.array_join(F.transform("fields", lambda f: f["selector"]), " ").alias("fields"))


LEADING = """
    SELECT c_custkey AS page_id, '/list?page=' || CAST(c_custkey + 1 AS VARCHAR) AS rel_next, 1 AS next_like, '{"page":["' || CAST(c_custkey + 1 AS VARCHAR) || '"],"offset":["40"]}' AS page_params, '/p/page-{n}.html /q_{n}.htm' AS path_patterns FROM customer
"""


@query(LEADING)
def rendered_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rendered pages lead on."""
    number, name = F.col("c_custkey"), F.col("c_name")
    text = number.cast("string")
    html = F.concat(F.lit('<a rel=next href="/list?page='), (number + 1).cast("string"), F.lit('">Next →</a><a href="/p/page-'), text, F.lit('.html">a</a><a href="/q_'), text, F.lit('.htm?offset=40&x=1">b</a><a href="https://other.test/?page=9">c</a>'))
    found = discovery.pagination(_pages_of_customers(spark, sf_dir, html))
    return found.select("page_id", "rel_next", F.size("next_like").alias("next_like"), F.to_json("page_params").alias("page_params"), F.array_join("path_patterns", " ").alias("path_patterns"))


@query("""
    SELECT c_custkey AS page_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS ord, unnest(['feed', 'api_or_docs', 'api_or_docs']) AS kind, unnest([c_mktsegment, 'Developers', 'API']) AS text,
        unnest(['https://x.test/feed/' || CAST(c_custkey AS VARCHAR) || '.xml', 'https://x.test/docs', 'https://api.test/' || CAST(c_custkey AS VARCHAR)]) AS href, unnest(['head', 'nav', 'footer']) AS place FROM customer
""")
def rendered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds and documentation that rendered pages offer; headlines that only speak of them are left out."""
    number, name = F.col("c_custkey"), F.col("c_name")
    text = number.cast("string")
    html = F.concat(
        F.lit('<head><link rel="alternate" type="application/rss+xml" title="'), "c_mktsegment", F.lit('" href="/feed/'), text, F.lit('.xml"></head><nav><a href="/docs">Developers</a></nav><a href="/n">The new API of our friends is now in public beta</a>'),
        F.lit('<a href="/docs">Open API</a><footer><a href="https://api.test/'), text, F.lit('">API</a></footer>'),
    )
    return discovery_sources(_pages_of_customers(spark, sf_dir, html))


def discovery_sources(pages: DataFrame) -> DataFrame:
    return diagnose.official_sources(pages).select("page_id", "ord", "kind", "text", "href", "place")


@query("""
    SELECT c_custkey AS page_id, c_name AS title, CAST(4 + c_custkey % 4 AS INTEGER) AS links, 1 AS images, 1 AS forms, 0 AS tables, 'li.o' AS best_list, CAST(3 + c_custkey % 4 AS INTEGER) AS best_count,
        CASE WHEN c_custkey % 2 = 0 THEN 'ldjson' ELSE '' END AS embedded, true AS has_next, 1 AS sources, false AS blocked, false AS login_wall FROM customer
""")
def rendered_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of rendered pages, from one parse."""
    number, name = F.col("c_custkey"), F.col("c_name")
    item = lambda i: F.concat(F.lit('<li class="o"><a href="/o/'), i.cast("string"), F.lit('">Order '), i.cast("string"), F.lit(" of "), name, F.lit("</a></li>"))
    data = F.when(number % 2 == 0, F.lit('<script type="application/ld+json">{"a": 1}</script>')).otherwise("")
    html = F.concat(F.lit("<head><title>"), name, F.lit("</title>"), data, F.lit("</head><body><form></form><img src=a.png><ul>"), F.array_join(F.transform(F.sequence(F.lit(1), (3 + number % 4).cast("int")), item), ""), F.lit('</ul><a href="/api/">Next</a>'))
    found = discovery.overview(_pages_of_customers(spark, sf_dir, html))
    return found.select("page_id", "title", "links", "images", "forms", "tables", "best_list", "best_count", F.array_join("embedded", ",").alias("embedded"), "has_next", "sources", "blocked", "login_wall")
