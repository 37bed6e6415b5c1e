"""Value cleaning as columns: emptiness, numbers, prices, currencies, links, dates.

Every builder takes a column and returns a column. All are native but prices, currencies and dates, whose rules are in
``texts``. White space is what JavaScript's ``\\s`` means, written out, because Java's differs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import texts

WS = r"[\t\n\x0B\f\r    -     　﻿]"


def non_empty(c: Column, kind: T.DataType) -> Column:
    """Whether a cell counts as filled: not null, not '' and not []. 0 and false are filled."""
    there = c.isNotNull()
    if isinstance(kind, T.StringType):
        return there & (c != "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return there & (F.size(c) > 0)
    return there


def any_filled(columns: list[tuple[Column, T.DataType]]) -> Column:
    out = F.lit(False)
    for c, kind in columns:
        out = out | non_empty(c, kind)
    return out


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def number(c: Column) -> Column:
    """The longest numeric prefix of what is left without anything but digits, points and hyphens."""
    return F.regexp_extract(F.regexp_replace(c.cast("string"), r"[^0-9.\-]", ""), r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")


def first_match(c: Column, pattern: str, flags: str = "") -> Column:
    """Group 1 of the first match if it took part, else the whole match; null without a match.

    ``regexp_extract`` gives '' for a group that took no part, so the whole match is taken where group 1 is ''
    and optional; a group that matched the empty string is then indistinguishable and gives the whole match too.
    """
    if set(flags) - set("imsu"):
        raise ValueError(f"regex flags {flags!r}: only i, m, s and u")
    inline = "".join(f for f in flags if f in "ims") + ("u" if "i" in flags else "")
    pattern = f"(?{inline}){pattern}" if inline else pattern
    import re

    groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern.replace(r"\z", r"\Z")) if not inline else re.sub(r"^\(\?[a-z]+\)", "", pattern)).groups
    whole = F.regexp_extract(c, pattern, 0)
    got = F.when(F.regexp_extract(c, pattern, 1) != "", F.regexp_extract(c, pattern, 1)).otherwise(whole) if groups else whole
    return F.when(F.regexp_like(c, F.lit(pattern)), got)


def mapped(c: Column, table: dict, to: str = "string") -> Column:
    """The table's value for a cell, as text; cells that it doesn't name pass."""
    if not table:
        return c
    pairs = [F.lit(x) for k, v in table.items() for x in (str(k), str(v) if to == "string" else v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c.cast("string")), c.cast(to) if to == "string" else c.try_cast(to))


def _each(work, kind: str):
    """A column function that applies ``work`` to each distinct text of a batch once; null and '' stay null."""

    @F.pandas_udf(kind)
    def over(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts, use_na_sentinel=True)
        made = pd.Series([work(t) if t else None for t in distinct] + [None], dtype="float64" if kind == "double" else object)
        return made.iloc[codes].reset_index(drop=True)

    return over


def price(c: Column) -> Column:
    """The amount in a price's text as a double."""
    return _each(texts.price, "double")(c.cast("string"))


def currency(c: Column) -> Column:
    """The ISO 4217 code that a price's text names, by code, prefixed dollar, symbol or word; null if none."""
    return _each(texts.currency, "string")(c.cast("string"))


#: Query parameters that only say where a link was shared.
TRACKING = r"(?i)^(?:utm_[a-z_]+|fbclid|gclid|gbraid|wbraid|dclid|msclkid|yclid|twclid|mc_cid|mc_eid|igshid|igsh|_hsenc|_hsmi|mkt_tok|ref_src)$"


def _form(c: Column) -> Column:
    """A query part written as a form serialiser writes it."""
    return F.url_encode(F.coalesce(F.try_url_decode(c), c))


def clean_url(c: Column) -> Column:
    """A link without tracking parameters. With none to drop the trimmed text stays as it is; else the query is written
    anew, a relative path gets a leading slash and a scheme-relative address the scheme http."""
    s = strip(c.cast("string"))
    before_hash = F.regexp_extract(s, r"^([^#]*)", 1)
    fragment = F.regexp_extract(s, r"(#.*)$", 1)
    query = F.regexp_extract(before_hash, r"\?(.*)$", 1)
    base = F.regexp_extract(before_hash, r"^([^?]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.coalesce(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)), F.regexp_extract(p, "^([^=]*)", 1))
    keep = F.filter(parts, lambda p: ~F.regexp_like(name(p), F.lit(TRACKING)))
    written = F.array_join(F.transform(keep, lambda p: F.concat(_form(F.regexp_extract(p, "^([^=]*)", 1)), F.lit("="), _form(F.regexp_extract(p, "=(.*)$", 1)))), "&")
    head = (
        F.when(F.regexp_like(base, F.lit(r"(?i)^https?://[^/]*$")), F.concat(base, F.lit("/")))
        .when(F.startswith(base, F.lit("//")), F.concat(F.lit("http:"), base))
        .when(F.regexp_like(base, F.lit(r"(?i)^[a-z][a-z0-9+.\-]*:|^/")), base)
        .otherwise(F.concat(F.lit("/"), base))
    )
    rebuilt = F.concat(head, F.when(F.size(keep) > 0, F.concat(F.lit("?"), written)).otherwise(""), fragment)
    return F.when(c.isNull() | (c.cast("string") == ""), None).when(F.size(keep) == F.size(parts), s).otherwise(rebuilt)


def date(c: Column, tz: str = "Asia/Seoul", now: Column | None = None) -> Column:
    """The date or time in a text, in a zone; see ``texts.date``. Relative texts are measured from ``now``."""

    @F.pandas_udf("string")
    def over(cells: pd.Series, at: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(pd.MultiIndex.from_arrays([cells.fillna(""), at]))
        made = pd.Series([texts.date(t, n, tz) if t else None for t, n in distinct], dtype=object)
        return made.iloc[codes].reset_index(drop=True)

    return over(c.cast("string"), F.unix_micros(F.current_timestamp() if now is None else now.cast("timestamp")) / 1e6)


def kind_of(c: Column, dtype: T.DataType | None = None) -> Column:
    """What kind of value a cell holds: empty, number, bool, url, price, date, text or longtext; the first rule wins."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), "empty").otherwise("bool")
    if isinstance(dtype, T.NumericType):
        return F.when(c.isNull(), "empty").otherwise("number")
    raw = F.array_join(c, " ") if isinstance(dtype, T.ArrayType) else c.cast("string")
    s = squeeze(raw)
    like = lambda p: F.regexp_like(s, F.lit(p))
    return (
        F.when(raw.isNull() | (raw == ""), "empty")
        .when(like(rf"^(https?:)?//\S+\z|^/\S*\z"), "url")
        .when((F.length(s) < 30) & like("[0-9]") & (like("[£€$¥￥₩₹₽₫฿원円元]") | like(r"(?<![A-Za-z0-9_])[A-Z]{3}\s?[0-9]")), "price")
        .when((F.length(s) < 40) & like(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}:[0-9]{2}|(?<![A-Za-z0-9_])(?:ago|yesterday)(?![A-Za-z0-9_])|(?:전|前)\z"), "date")
        .when(like(r"^[-+]?[0-9.,\s%]+\z"), "number")
        .when(F.length(s) > 80, "longtext")
        .otherwise("text")
    )


def js_text(c: Column, kind: T.DataType) -> Column:
    """A cell as JavaScript prints it: whole doubles without a fraction, booleans in lower case."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: F.coalesce(js_text(x, kind.elementType), F.lit(""))), ",")
    return c.cast("string")


def template(text: str, columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """``{column}`` filled in; null if any of them is empty."""
    import re

    parts, at, filled = [], 0, F.lit(True)
    for m in re.finditer(r"\{([^{}]+)\}", text):
        c, kind = columns[m[1]]
        parts += [F.lit(text[at : m.start()]), js_text(c, kind)]
        filled = filled & non_empty(c, kind)
        at = m.end()
    return F.when(filled, F.concat(*parts, F.lit(text[at:])))


def shorten(c: Column, n: int = 80) -> Column:
    """At most n characters; a cut text ends in an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


TRANSFORMS = {"number": number, "trim": squeeze, "price": price, "currency": currency, "clean_url": clean_url}
