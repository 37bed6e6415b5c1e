"""Rows out of JSON documents, and what happens to rows after that: filters, dedupe, limits, joins, unions.

Row order is carried by ``page_ord`` and ``item_ord``; every "first wins" uses them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonpath, values
from ..sources import dom
from ..sources.pages import ITEM_ORD, Field, fields_of, finish, with_templates

# ---- JSON documents to rows ------------------------------------------------------------------------------------


def split(document, path: str | None) -> list:
    """A document's items: an array is taken apart (and flattened once less than the path iterates), anything else is
    one item; null elements are left out."""
    found = jsonpath.get(document, path) if path else document
    if found is jsonpath.MISSING or found is None:
        return []
    if not isinstance(found, list):
        return [found]
    for _ in range(jsonpath.iterations(path) - 1 if path else 0):
        found = [y for x in found for y in (x if isinstance(x, list) else [x])]
    return [x for x in found if x is not None and x is not jsonpath.MISSING]


def _looked_up(row, look: tuple[str, str, str], document):
    """The first element of another table in the document whose key equals (or, as a list, contains) the row's."""
    table, where, equals = look
    key = jsonpath.get(row, equals)
    if jsonpath.is_empty(key):
        return jsonpath.MISSING
    key = jsonpath.text_of(key)
    found = jsonpath.get(document, table)
    for element in found if isinstance(found, list) else found.values() if isinstance(found, dict) else ():
        other = jsonpath.get(element, where)
        if any(jsonpath.text_of(x) == key for x in (other if isinstance(other, list) else [other]) if x not in (None, jsonpath.MISSING)):
            return element
    return jsonpath.MISSING


def raw_cell(row, f: Field, document):
    """A field's value before it is cleaned."""
    base = row
    if f.lookup:
        base = _looked_up(row, f.lookup, document)
        if base is jsonpath.MISSING:
            return 0 if f.transform == "count" else None
    value = jsonpath.MISSING
    for path in f.selector if isinstance(f.selector, tuple) else (f.selector,):
        value = jsonpath.get(base, path)
        if not jsonpath.is_empty(value):
            break
    if f.transform == "count":
        return len(value) if isinstance(value, list) else int(value is not None and value is not jsonpath.MISSING)
    if _is_list(f):
        return None if not isinstance(value, list) else [jsonpath.text_of(x) or "" for x in value]
    return jsonpath.text_of(value)


def _is_list(f: Field) -> bool:
    """Whether a field's paths iterate, so that its cells are lists of texts."""
    paths = f.selector if isinstance(f.selector, tuple) else (f.selector,)
    return not (f.regex or f.map or f.transform or f.type) and any(not jsonpath.is_static(p) for p in paths)


def json_rows(documents: DataFrame, fields: dict, items: str | None = None, json: str = "json", keep: tuple[str, ...] = (), now: Column | None = None) -> DataFrame:
    """A row for each item of each document's JSON text; unparsable documents give none.

    Without fields an item's own top-level keys are kept as a map of texts (a scalar under ``value``). All-empty rows
    are dropped.
    """
    specs = fields_of(fields)
    read = {n: f for n, f in specs.items() if f.template is None}
    names = {n: f"f{k}" for k, n in enumerate(read)}
    types = {n: T.LongType() if f.transform == "count" else T.ArrayType(T.StringType()) if _is_list(f) else T.StringType() for n, f in read.items()}
    arrow = {n: pa.int64() if isinstance(t, T.LongType) else pa.list_(pa.string()) if isinstance(t, T.ArrayType) else pa.string() for n, t in types.items()}
    if fields:
        item, kind = T.StructType([T.StructField(names[n], types[n]) for n in read]), pa.struct([(names[n], arrow[n]) for n in read])
    else:
        item, kind = T.MapType(T.StringType(), T.StringType()), pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch[json].to_pylist():
                try:
                    document = jsonpath.loads(text) if text else None
                except ValueError:
                    document = None
                rows = split(document, items)
                if fields:
                    out.append([{names[n]: raw_cell(r, f, document) for n, f in read.items()} for r in rows])
                else:
                    own = [r if isinstance(r, dict) else {"value": r} for r in rows]
                    out.append([[(k, jsonpath.text_of(v)) for k, v in r.items()] for r in own if any(not jsonpath.is_empty(v) for v in r.values())])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(out, pa.list_(kind))], [*keep, "rows"])

    schema = T.StructType([*[documents.schema[c] for c in keep], T.StructField("rows", T.ArrayType(item))])
    found = documents.select(*dict.fromkeys([*keep, json])).mapInArrow(run, schema).select(*keep, F.posexplode("rows").alias(ITEM_ORD, "r"))
    if not fields:
        return found.withColumnRenamed("r", "cells")
    raw = found.select(*keep, ITEM_ORD, *[F.col(f"r.{names[n]}").alias(n) for n in read])
    out = finish(raw, specs, [*keep, ITEM_ORD], False, now)
    full = [(F.col(f"`{n}`"), out.schema[n].dataType) for n, f in specs.items() if f.template is None]
    return out.where(values.any_filled(full)) if full else out


MOST_COLUMNS = 10_000


def spread(found: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``cells`` (maps) with a column for each key, in the order in which the keys are first met.

    The keys are looked for by a job of its own; more than MOST_COLUMNS of them are refused.
    """
    met = found.select(*order, F.posexplode(F.map_keys("cells")).alias("_at", "key")).groupBy("key").agg(F.min(F.struct(*order, "_at")).alias("first"))
    keys = [r.key for r in met.orderBy("first").limit(MOST_COLUMNS + 1).select("key").collect()]
    if len(keys) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} different keys: declare fields")
    return found.select(*[c for c in found.columns if c != "cells"], *[F.col("cells")[k].alias(k) for k in keys])


def json_rows_native(documents: DataFrame, fields: dict, items: str | None = None, json: str = "json", keep: tuple[str, ...] = (), now: Column | None = None) -> DataFrame:
    """The same for static paths and at most one ``[]`` in the items path, JVM-side: VARIANT access and an exploded array.

    Strings that hold JSON aren't entered and duplicate keys make a document null; that is the price of staying native.
    """
    specs = fields_of(fields)
    document = F.try_parse_json(F.col(json))
    path = (items or "").removesuffix("[]")
    if not jsonpath.is_static(path) or any(not jsonpath.is_static(p) for f in specs.values() for p in (f.selector if isinstance(f.selector, tuple) else (f.selector,))) or any(f.lookup for f in specs.values()):
        raise ValueError("paths that iterate need json_rows")
    parsed = documents.select(*keep, document.alias("d"))
    if items:
        elements = F.try_variant_get("d", jsonpath.variant_path(path), "array<variant>")
        parsed = parsed.select(*keep, F.posexplode(elements).alias(ITEM_ORD, "d")).where("d is not null and not is_variant_null(d)")
    else:
        parsed = parsed.select(*keep, F.lit(0).alias(ITEM_ORD), "d").where("d is not null")
    cells = []
    for n, f in specs.items():
        if f.template is None:
            paths = f.selector if isinstance(f.selector, tuple) else (f.selector,)
            cells.append((F.size(F.try_variant_get("d", jsonpath.variant_path(paths[0]), "array<variant>")) if f.transform == "count" else jsonpath.first_filled(F.col("d"), paths)).alias(n))
    out = finish(parsed.select(*keep, ITEM_ORD, *cells), specs, [*keep, ITEM_ORD], False, now)
    full = [(F.col(f"`{n}`"), out.schema[n].dataType) for n, f in specs.items() if f.template is None]
    return out.where(values.any_filled(full)) if full else out


def message_matches(documents: DataFrame, where: dict, json: str = "json") -> DataFrame:
    """Documents in which every path holds the wanted value, or one of several, compared as text."""
    parsed = F.try_parse_json(F.col(json))
    for path, want in where.items():
        wanted = [jsonpath.text_of(w) if w is not None else "null" for w in (want if isinstance(want, list) else [want])]
        documents = documents.where(F.coalesce(jsonpath.native(parsed, path), F.lit("null")).isin(wanted))
    return documents


# ---- finishing -------------------------------------------------------------------------------------------------


def resolve_links(rows: DataFrame, columns: list[str], base: Column | str) -> DataFrame:
    """Relative links of the columns made absolute."""

    @F.pandas_udf("string")
    def resolved(link: pd.Series, against: pd.Series) -> pd.Series:
        return pd.Series([dom.absolute(a, b or "") if isinstance(a, str) and a else a for a, b in zip(link, against, strict=True)], dtype=object)

    against = F.lit(base) if isinstance(base, str) else base
    return rows.withColumns({c: resolved(F.col(f"`{c}`"), against.cast("string")) for c in columns})


def finish_rows(rows: DataFrame, fields: dict, base: Column | str = "", require: list[str] | None = None) -> DataFrame:
    """Links resolved, templates filled, then rows without a required column dropped."""
    specs = fields_of(fields)
    for n, f in specs.items():
        if f.absolute and n in rows.columns and isinstance(rows.schema[n].dataType, T.StringType):
            rows = resolve_links(rows, [n], f.absolute if isinstance(f.absolute, str) else base)
    return required(with_templates(rows, specs), require or [])


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        rows = rows.where(values.non_empty(F.col(f"`{c}`"), rows.schema[c].dataType))
    return rows


def dedupe(rows: DataFrame, key: str, order: list[str], typed: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """The first row of each key in the order. Empty keys are all kept; ``typed`` compares values as they are and lets
    only null pass. ``seen`` holds keys of earlier runs (a column of the key's name)."""
    kind = rows.schema[key].dataType
    c = F.col(f"`{key}`")
    passes = c.isNull() if typed else ~values.non_empty(c, kind)
    text = c if typed else values.js_text(c, kind)
    # the key of a passing row is its own place, so no group holds them all
    group = Window.partitionBy(passes, F.when(~passes, text), *[F.when(passes, F.col(o)) for o in order]).orderBy(*order)
    out = rows.withColumn("_nth", F.row_number().over(group)).where(F.col("_nth") == 1).drop("_nth")
    if seen is not None:
        known = seen.select(F.col(f"`{key}`").cast("string").alias("_seen")).where("_seen is not null").distinct()
        out = out.join(known, values.js_text(F.col(f"`{key}`"), kind) == F.col("_seen"), "left_anti")
    return out


def dedupe_rows(rows: DataFrame, order: list[str], key: str | None = None) -> DataFrame:
    """The first of equal rows: by key where it is there, else by the whole row."""
    own = [c for c in rows.columns if c not in order]
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]))
    by = F.coalesce(F.col(f"`{key}`").cast("string"), whole) if key else whole
    group = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(group)).where("_nth = 1").drop("_nth")


def limit(rows: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first n rows in the order."""
    if n is None:
        return rows
    if not isinstance(n, int) or n < 1:
        raise ValueError("limit must be a whole number of 1 or more")
    return rows.orderBy(*order).limit(n)


def union_rows(parts: list[DataFrame]) -> DataFrame:
    """Rows of several pages; columns in the order in which they are first met."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fill_rate(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, fill_rate: the share of filled cells, to two decimals; 0 without rows. One pass over the rows."""
    shares = [F.coalesce(F.round(F.avg(values.non_empty(F.col(f"`{c}`"), rows.schema[c].dataType).cast("int")), 2), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(columns)]
    quoted = ", ".join(f"'{c}', c{k}".replace("\\", "\\\\") for k, c in enumerate(columns))
    return rows.agg(*shares).selectExpr(f"stack({len(columns)}, {quoted}) as (column, fill_rate)")


# ---- joins -----------------------------------------------------------------------------------------------------


def lookup(rows: DataFrame, table: DataFrame, key: str, where: str, take: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """Left join with the first match: ``where`` equals the key as text, or contains it where it is an array.

    ``take`` names the table's columns to add. An empty key matches nothing.
    """
    key_text = values.js_text(F.col(f"`{key}`"), rows.schema[key].dataType)
    key_text = F.when(values.non_empty(F.col(f"`{key}`"), rows.schema[key].dataType), key_text)
    other = table.withColumn("_at", F.struct(*order) if order else F.monotonically_increasing_id())
    kind = table.schema[where].dataType
    if isinstance(kind, T.ArrayType):
        other = other.withColumn("_key", F.explode(F.transform(F.col(f"`{where}`"), lambda x: values.js_text(x, kind.elementType))))
    else:
        other = other.withColumn("_key", values.js_text(F.col(f"`{where}`"), kind))
    # the first match of each key: partial aggregation, no window over a hot key
    first = other.where("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*[F.col(f"`{c}`").alias(n) for n, c in take.items()]), "_at").alias("_hit"))
    return rows.withColumn("_rk", key_text).join(first, F.col("_rk") == F.col("_key"), "left").select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_hit.`{n}`").alias(n) for n in take])


def merge_detail(rows: DataFrame, details: DataFrame, url_field: str, order: list[str], max_items: int | None = None, detail_url: str = "url", detail_order: str = ITEM_ORD) -> DataFrame:
    """Rows enriched from their detail page: a detail's first row wins wherever it isn't empty.

    With a cap only the first rows (in the order) that have a link are enriched.
    """
    own = [c for c in details.columns if c not in (detail_url, detail_order, "page_ord", "page_id")]
    first = details.groupBy(F.col(detail_url).alias("_url")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in own]), detail_order).alias("_d"))
    link = F.when(values.non_empty(F.col(f"`{url_field}`"), T.StringType()), F.col(f"`{url_field}`"))
    linked = rows.withColumn("_link", link)
    if max_items is not None:
        capped = linked.where("_link is not null").orderBy(*order).limit(max_items).select(*[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)])
        on = [F.col(o) == F.col(f"_o{k}") for k, o in enumerate(order)]
        linked = linked.join(capped, on, "left").withColumn("_link", F.when(F.col("_o0").isNotNull(), F.col("_link"))).drop(*[f"_o{k}" for k in range(len(order))])
    joined = linked.join(first, F.col("_link") == F.col("_url"), "left")
    cells = []
    for c in dict.fromkeys([*rows.columns, *own]):
        if c not in own:
            cells.append(F.col(f"`{c}`"))
            continue
        new = F.col(f"_d.`{c}`")
        filled = F.when(values.non_empty(new, details.schema[c].dataType), new)
        cells.append((F.coalesce(filled, F.col(f"`{c}`").cast(details.schema[c].dataType)) if c in rows.columns else filled).alias(c))
    return joined.select(*cells)
