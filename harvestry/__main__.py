"""Command line: run a recipe over captured tables, rank a request log, finish a file of rows.

    python -m harvestry collect recipe.json --pages pages.parquet --responses r.parquet --frames f.parquet --out t.csv --state s.json --resume
    python -m harvestry har log.har --match 39000
    python -m harvestry finish rows.json --out t.csv --dedupe-key id --limit 10

Prints one line of JSON. Exit codes: 0 done, 1 failed, 2 wrong use, 3 blocked.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sinks
from .operators import requests, rows
from .plans import recipe as recipes
from .plans import run as runs


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="harvestry")
    commands = parser.add_subparsers(dest="command", required=True)
    collect = commands.add_parser("collect")
    collect.add_argument("recipe")
    for name in ("pages", "responses", "frames", "seen"):
        collect.add_argument(f"--{name}")
    collect.add_argument("--max-pages", type=int)
    collect.add_argument("--dry-run", action="store_true")
    collect.add_argument("--state")
    collect.add_argument("--resume", action="store_true")
    har = commands.add_parser("har")
    har.add_argument("log")
    har.add_argument("--match")
    finish = commands.add_parser("finish")
    finish.add_argument("rows")
    finish.add_argument("--dedupe-key")
    for p in (collect, finish):
        p.add_argument("--out")
        p.add_argument("--format", choices=sinks.FORMATS)
    for p in (collect, har, finish):
        p.add_argument("--limit", type=int)
    return parser.parse_args(argv)


def _written(spark: SparkSession, table, fmt: str, path: str, columns: list[str], order: list[str], append: bool) -> None:
    """Writes rows; a file that can't be appended to is written anew from a file of all rows beside it."""
    if fmt in ("csv", "jsonl"):
        sinks.write(table, fmt, path, columns, order, append)
        return
    beside = f"{path}.rows.jsonl"
    sinks.write(table, "jsonl", beside, columns, order, append)
    whole = spark.read.schema(table.select(*[F.col(f"`{c}`") for c in columns]).schema).json(beside).withColumn("item_ord", F.monotonically_increasing_id())
    sinks.write(whole, fmt, path, columns, ["item_ord"])


def collect(spark: SparkSession, args: argparse.Namespace) -> dict:
    """One run of a recipe. With --state, what the next run needs is kept there: the cursor, the keys seen, the file."""
    with open(args.recipe, encoding="utf-8") as f:
        recipe = recipes.load(f.read())
    found = {n: spark.read.parquet(p) for n in ("pages", "responses", "frames", "seen") if (p := getattr(args, n))}
    state, keys = {}, f"{args.state}.seen"
    if args.resume and args.state and os.path.exists(args.state):
        with open(args.state, encoding="utf-8") as f:
            state = json.load(f)
        state = state if state.get("cursor") and not state.get("done") else {}
        if state and os.path.exists(keys) and "seen" not in found:
            found["seen"] = spark.read.parquet(keys)
    outcome = runs.run(recipe, recipes.Sources(**found), args.limit, args.max_pages, args.dry_run, state.get("cursor"))
    table, order = outcome.rows.persist(), ["page_ord", "item_ord"]
    columns = state.get("columns") or outcome.columns
    for c in columns:
        if c not in table.columns:
            table = table.withColumn(c, F.lit(None).cast("string"))
    told = sinks.summary(table, columns, order, outcome.pages, outcome.reason)
    told |= {"recipe": recipe["name"], **({"blocked_by": outcome.blocked_by} if outcome.blocked_by else {}), **({"rows_previous": state["rows_written"]} if state else {})}
    if not args.dry_run:
        fmt, path = (state["format"], state["output"]) if state and not args.out and not args.format else sinks.output_of(recipe, args.format, args.out)
        _written(spark, table, fmt, path, columns, order, bool(state))
        told |= {"format": fmt, "path": path}
        if args.state:
            key = (recipe.get("output") or {}).get("dedupe_key")
            if key:
                table.select(F.col(f"`{key}`").cast("string").alias(key)).where(F.col(f"`{key}`").isNotNull()).write.mode("append" if state else "overwrite").parquet(keys)
            kept = {"recipe": recipe["name"], "cursor": outcome.cursor, "done": outcome.cursor is None, "output": path, "format": fmt, "columns": columns, "rows_written": told["rows"] + state.get("rows_written", 0), "pages_done": outcome.pages, "stop_reason": outcome.reason}
            with open(args.state, "w", encoding="utf-8") as f:
                json.dump(kept | ({"blocked_by": outcome.blocked_by} if outcome.blocked_by else {}), f, ensure_ascii=False)
    table.unpersist()
    return told


def har(spark: SparkSession, args: argparse.Namespace) -> dict:
    entries = requests.har_entries(spark, args.log)
    ranked = requests.rank_requests(entries, args.match, args.limit or 10).orderBy("rank")
    return {"ok": True, "entries": entries.count(), "candidates": [json.loads(r.j) for r in ranked.selectExpr("to_json(struct(*)) j").collect()], "exit": 0}


def finish(spark: SparkSession, args: argparse.Namespace) -> dict:
    """A file with an array of rows, deduplicated by the values of a key as they are, cut and written under a free name."""
    with open(args.rows, encoding="utf-8") as f:
        own = json.load(f)
    if not isinstance(own, list):
        raise recipes.RecipeError("the file must hold an array of rows")
    columns = list(dict.fromkeys(k for r in own for k in r))
    # one file with one array is one partition, read in its order
    read = spark.read.option("multiLine", True).json(args.rows).withColumn("item_ord", F.monotonically_increasing_id()) if own else spark.createDataFrame([], "item_ord long")
    out = rows.dedupe(read, args.dedupe_key, ["item_ord"], typed=True) if args.dedupe_key and own else read
    out = rows.limit(out, args.limit, ["item_ord"])
    fmt, path = sinks.output_of({"name": "rows"}, args.format, args.out)
    path = sinks.free_path(path)
    return {"ok": True, "rows": sinks.write(out, fmt, path, columns, ["item_ord"]), "path": path, "exit": 0}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("harvestry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        told = {"collect": collect, "har": har, "finish": finish}[args.command](spark, args)
    except (recipes.RecipeError, ValueError, FileNotFoundError) as e:
        told = {"ok": False, "error": str(e), "exit": sinks.EXIT["usage"]}
    print(json.dumps(told, ensure_ascii=False, default=str))
    return told.get("exit", 0)


if __name__ == "__main__":
    sys.exit(main())
