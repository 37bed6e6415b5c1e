"""Steps whose work must grow no faster than their input."""

import json
from pathlib import Path

import pytest

from harvestry.operators import diagnose
from harvestry.plans import queries
from harvestry.plans.run import run as queries_run
from harvestry.sources import dom

DATA = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@tables
def test_rendered_pages_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    pages = queries._pages_of_customers(spark, str(DATA), F.lit("<p>x</p>"))
    tasks = pages.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 2 * spark.sparkContext.defaultParallelism and max(r["count"] for r in tasks) < pages.count() / 4


@pytest.mark.parametrize("selector", ["a, .x, #i", "li.x > a", "[href]", "*", "li:has(a)", "ul li:nth-of-type(2)", "p, li a, .x", ".none", "div b", "li.x:not(.y)"])
def test_selectors_find_the_same_by_key_as_by_walking(selector):
    page = dom.parse('<ul><li class="x y"><a href=/1 id=i>1</a><li class=x><a href=/2>2</a></ul><p class="x x">p<b>b</b></p><div><template shadowrootmode=open><b>in</b></template></div>')
    matchers = dom.compile_selector(selector)
    walked = [n for n in page.walk() if any(m(n, page) for m, _ in matchers)]
    assert dom._light(selector, page) == walked
    assert [n.text for n in dom.query("b", dom.parse("<i><template shadowrootmode=open><b>in</b></template></i>"))] == ["in"]


def test_pages_held_at_once_are_bounded_by_their_source():
    big = diagnose.SOURCE_AT_ONCE
    assert list(diagnose.slices([1] * 300)) == [(0, 256), (256, 44)] and list(diagnose.slices([])) == []
    assert list(diagnose.slices([big * 2, 1, big, 5, 5])) == [(0, 1), (1, 1), (2, 1), (3, 2)]


def test_robots_meet_only_rules_that_a_path_begins_with(spark):
    n = 3000
    rules = "\n".join(f"Disallow: /c/{k}$" for k in range(n)) + "\nAllow: /c/7*\nDisallow: *.pdf\nDisallow: /x.y\nAllow: /a$b"
    files = spark.createDataFrame([("h", f"User-agent: *\n{rules}")], "host string, text string")
    paths = spark.createDataFrame([("h", f"/c/{k}") for k in range(n)] + [("h", p) for p in ("/c/12/e.pdf", "/x.y/z", "/xzy", "/a$bc", "/", "/c/7z.pdf")], "host string, path string")
    found = diagnose.robots(files, paths)
    got = {r.path: (r.disallowed, r.matched_rule) for r in found.collect()}
    assert all(got[f"/c/{k}"] == (True, f"/c/{k}$") for k in range(10, n)) and len(got) == n + 6
    assert [got[p] for p in ("/c/12/e.pdf", "/x.y/z", "/xzy", "/a$bc", "/", "/c/7z.pdf")] == [(True, "*.pdf"), (True, "/x.y"), (False, None), (False, "/a$b"), (False, None), (False, "/c/7*")]
    plan = found._jdf.queryExecution().toString()
    assert "head" in plan and "NestedLoop" not in plan


def test_relative_times_keep_the_clock_of_now(spark):
    from pyspark.sql import functions as F

    from harvestry.functions import values

    cells = spark.createDataFrame([("13894 days ago",), ("90000 days ago",), ("740300 days ago",), ("900000 days ago",), ("700000시간 전",), ("99999999999 days ago",)], "c string")
    got = [r[0] for r in cells.select(values.date(F.col("c"), now=F.timestamp_seconds(F.lit(1_792_724_400)))).collect()]
    assert got == ["1988-10-08 12:00:00", "1780-05-25 12:00:00", "-1-12-09 12:00:00", "-438-09-11 12:00:00", "1946-12-15 20:00:00", "99999999999 days ago"]


def test_chains_without_a_bound_are_followed_to_their_end(spark, monkeypatch):
    from harvestry.operators import paging

    monkeypatch.setattr(paging, "LOCAL", 4)
    edges = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(37)], "url string, next string")
    for most in (paging.ALL, 38, 20, 16, 4, 3):
        got = sorted(tuple(r) for r in paging.follow(edges, "p0", most).collect())
        assert got == [(k, f"p{k}") for k in range(int(min(most, 38)))]
    circle = edges.union(spark.createDataFrame([("p37", "p9")], edges.schema))
    assert sorted(tuple(r) for r in paging.follow(circle, "p0", paging.ALL).collect()) == [(k, f"p{k}") for k in range(38)]


def test_numbered_pages_are_read_from_their_addresses(spark):
    from harvestry.operators import paging

    urls = [f"https://x.test/a.b?p={n}&q={n}" for n in range(30)] + ["https://x.test/a.b?p=7&q=9", "https://x.test/a.b?p=07&q=07", "https://x.test/axb?p=5&q=5", "https://x.test/a.b?p=-3&q=-3"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    for start, step, most in ((1, 2, paging.ALL), (1, 2, 5), (0, 1, 3), (20, -4, paging.ALL), (3, -6, 2)):
        template = "https://x.test/a.b?p={n}&q={n}"
        wanted = {u: k for k, u in enumerate(paging.numbered(template, start, step, 50 if most == paging.ALL else most))}
        got = {r.url: r.page_ord for r in paging.by_number(pages, template, start, step, most).collect()}
        assert got == {u: wanted[u] for u in urls if u in wanted}


@tables
def test_scrolled_snapshots_grow_with_their_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    drawn = []
    monkeypatch.setattr(queries, "run", lambda _recipe, sources: drawn.append(sources.pages) or queries_run(_recipe, sources))
    found = queries.run_idle_scroll(spark, str(DATA))
    rows = queries.table(spark, str(DATA), "supplier").count()
    shown = drawn[0].select(F.sum(F.size(F.split("html", "<li ")) - 1)).first()[0]
    assert shown == 4 * rows and found.count() == rows  # three rounds of each, and the late ones


def test_driven_pages_end_where_a_cursor_ends_or_stays(spark):
    from harvestry.operators import paging

    def read(cursors, most=paging.ALL):
        own = spark.createDataFrame([(k * 3, json.dumps({"next": c})) for k, c in enumerate(cursors)], "seq bigint, json string").repartition(3)
        return sorted((r.seq // 3, r.following) for r in paging.until_cursor_ends(own, "next", most).collect())

    many = [f"c{k}" for k in range(200)]
    walked = list(enumerate(many))
    assert read(many, 7) == walked[:7] and read([]) == []
    assert read([*many[:100], None, *many[100:]]) == [*walked[:100], (100, None)]
    assert read([*many[:50], many[49], *many[50:]]) == [*walked[:50], (50, None)]
    plan = paging.until_cursor_ends(spark.range(9).selectExpr("id AS seq", "'{}' AS json"), "next")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_documents_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    from harvestry.plans.recipe import Sources, documents_of

    found = spark.range(31).select(F.concat(F.lit("https://x.test/o?page="), "id").alias("url"), F.lit(200).alias("status"), F.lit("{}").alias("body")).coalesce(1)
    tasks = documents_of(queries.LISTED, Sources(responses=found), 40).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 31 and len(tasks) == 2 * spark.sparkContext.defaultParallelism
