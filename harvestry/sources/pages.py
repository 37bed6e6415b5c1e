"""Extraction of rows from pages: one parse a page, all fields in one pass, then native columns.

``extract`` runs a single Arrow function that gives each page an array of rows with the raw values, explodes it in
document order and finishes the values (regex, map, transforms, templates) with native columns, so that Catalyst sees
everything after the parse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from . import dom

PAGE_ORD, ITEM_ORD = "page_ord", "item_ord"


@dataclass(frozen=True)
class Field:
    """How one column is read: where, what of it, and how it is cleaned (in this order: regex, map, transform)."""

    selector: str | tuple[str, ...] = ""
    attr: str | None = None
    all: bool = False
    join: str | None = None
    regex: str | None = None
    regex_flags: str = ""
    map: tuple[tuple[str, object], ...] = ()
    transform: str | None = None
    tz: str = "Asia/Seoul"
    absolute: bool | str | None = None
    template: str | None = None
    lookup: tuple[str, str, str] | None = None
    type: str | None = None

    @classmethod
    def of(cls, raw) -> Field:
        """From a recipe's field: a selector or path, or an object."""
        if isinstance(raw, cls):
            return raw
        if not isinstance(raw, dict):
            return cls(selector=raw or "")
        path = raw.get("path", raw.get("selector")) or ""
        known = {k: raw[k] for k in ("attr", "join", "regex", "transform", "absolute", "template", "type") if raw.get(k) is not None}
        look = raw.get("lookup")
        return cls(
            selector=tuple(path) if isinstance(path, list) else path, all=bool(raw.get("all")), regex_flags=raw.get("regex_flags") or "", map=tuple((raw.get("map") or {}).items()),
            tz=raw.get("tz") or "Asia/Seoul", lookup=(look["in"], look["where"], look.get("equals") or "$") if look else None, **known,
        )

    def clean(self, c: Column, now: Column | None = None) -> Column:
        """The value of one cell's text."""
        if self.regex:
            c = values.first_match(c, self.regex, self.regex_flags)
        if self.map:
            table = dict(self.map)
            numeric = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in table.values()) and self.type in ("double", "bigint")
            c = values.mapped(c, table, self.type if numeric else "string")
        if self.transform == "date":
            c = values.date(c, self.tz, now)
        elif self.transform in values.TRANSFORMS:
            c = values.TRANSFORMS[self.transform](c)
        if self.type and not self.map:
            c = c.try_cast(self.type)
        return c


def fields_of(raw: dict) -> dict[str, Field]:
    return {name: Field.of(spec) for name, spec in raw.items()}


def _raw_type(f: Field) -> T.DataType:
    return T.LongType() if f.transform == "count" else T.ArrayType(T.StringType()) if f.all else T.StringType()


def rows_of(html: str, base: str, fields: dict[str, Field], container: str | None) -> list[dict]:
    """The raw rows of one page."""
    document = dom.parse(html)
    out = []
    for scope in dom.query(container, document) if container else [document]:
        row, some = {}, False
        for name, f in fields.items():
            found = dom.resolve(f.selector, scope)
            if f.transform == "count":
                row[name] = len(found)
                some |= bool(found)
                continue
            got = [dom.read(n, f.attr, base, f.absolute) for n in (found if f.all else found[:1])]
            row[name] = [v for v in got if v not in (None, "")] if f.all else (got[0] if got else None)
            some |= bool(row[name])
        if some or not container:
            out.append(row)
    document.release()
    return out


def extract(pages: DataFrame, fields: dict, container: str | None = None, keep: tuple[str, ...] = ("page_id", "url"), now: Column | None = None) -> DataFrame:
    """Rows of all pages (url, html): the kept page columns, item_ord, then the fields in order.

    A row without any filled field is dropped where there is a container; null pages give no row with a container and
    one empty row without.
    """
    specs = fields_of(fields)
    read = {n: f for n, f in specs.items() if f.template is None}
    struct = T.StructType([T.StructField(f"f{k}", _raw_type(f)) for k, f in enumerate(read.values())])
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("rows", T.ArrayType(struct))])
    kind = pa.list_(pa.struct([(f"f{k}", pa.int64() if f.transform == "count" else pa.list_(pa.string()) if f.all else pa.string()) for k, f in enumerate(read.values())]))
    spark_base = "url" if "url" in pages.columns else None
    numbered = {n: f"f{k}" for k, n in enumerate(read)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                bases = part[spark_base].to_pylist() if spark_base else [""] * part.num_rows
                got = [[{numbered[n]: v for n, v in r.items()} for r in rows_of(h, b or "", read, container)] for h, b in zip(part["html"].to_pylist(), bases, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], pa.array(got, kind)], [*keep, "rows"])

    own = pages.select(*dict.fromkeys([*keep, *([spark_base] if spark_base else []), "html"]))
    found = own.mapInArrow(run, schema).select(*keep, F.posexplode("rows").alias(ITEM_ORD, "r"))
    return finish(found.select(*keep, ITEM_ORD, *[F.col(f"r.{numbered[n]}").alias(n) for n in read]), specs, [*keep, ITEM_ORD], bool(container), now)


def finish(rows: DataFrame, specs: dict[str, Field], lead: list[str], drop_empty: bool, now: Column | None = None) -> DataFrame:
    """Clean the raw columns, fill templates, drop rows with nothing in them; columns come out in the fields' order."""

    def cell(n: str, f: Field) -> Column:
        c = F.col(f"`{n}`")
        if f.transform == "count":
            return c
        if isinstance(rows.schema[n].dataType, T.ArrayType):
            cleaned = F.filter(F.transform(c, lambda x: f.clean(x, now)), lambda x: x.isNotNull() & (x.cast("string") != ""))
            return F.array_join(cleaned, f.join) if f.join is not None else cleaned
        return f.clean(c, now)

    out = rows.select(*[F.col(f"`{c}`") for c in lead], *[cell(n, f).alias(n) for n, f in specs.items() if f.template is None])
    if drop_empty and any(f.template is None for f in specs.values()):
        full = F.lit(False)
        for n, f in specs.items():
            if f.template is None:
                c = F.col(f"`{n}`")
                full = full | ((c > 0) if f.transform == "count" else values.non_empty(c, out.schema[n].dataType))
        out = out.where(full)
    return with_templates(out, specs).select(*[F.col(f"`{c}`") for c in lead], *[F.col(f"`{n}`") for n in specs])


def with_templates(rows: DataFrame, specs: dict[str, Field]) -> DataFrame:
    """Template columns filled from the others, in the fields' order."""
    for n, f in specs.items():
        if f.template is not None:
            cells = {c: (F.col(f"`{c}`"), rows.schema[c].dataType) for c in rows.columns}
            cells |= {c: (F.lit(None).cast("string"), T.StringType()) for c in specs if c not in cells}
            rows = rows.withColumn(n, values.template(f.template, cells))
    return rows
