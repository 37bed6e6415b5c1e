"""Paths into JSON values: ``a.b[0].c``, ``[]`` (each element), ``[*]`` (each value), ``["quoted.key"]``.

A path is tokenized once, at plan time. Static paths compile to native VARIANT access; the others are walked in Python.
"""

from __future__ import annotations

import functools
import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EACH, VALUES = object(), object()
MISSING = object()

_STEP = re.compile(r"""\[\s*(?P<mark>["'])(?P<quoted>(?:\\.|(?!(?P=mark))[^\\])*)(?P=mark)\s*\]|\[(?P<index>\d+)\]|(?P<values>\[\*\])|(?P<each>\[\])|(?P<key>[^.\[\]]+)""")


@functools.lru_cache(maxsize=4096)
def steps(path: str) -> tuple:
    """The steps of a path: keys (and indexes) as text, EACH, VALUES. '' and '$' have none."""
    if path in ("", "$"):
        return ()
    out = []
    for m in _STEP.finditer(path):
        if m["mark"]:
            out.append(re.sub(r"\\(.)", r"\1", m["quoted"]))
        elif m["values"]:
            out.append(VALUES)
        elif m["each"]:
            out.append(EACH)
        else:
            out.append(m["index"] if m["index"] is not None else m["key"])
    return tuple(out)


def is_static(path: str) -> bool:
    """Whether a path has neither ``[]`` nor ``[*]``."""
    return not any(s is EACH or s is VALUES for s in steps(path))


def iterations(path: str) -> int:
    return sum(s is EACH or s is VALUES for s in steps(path))


@functools.lru_cache(maxsize=16)
def _inner(text: str):
    try:
        return loads(text)
    except ValueError:
        return MISSING


def loads(text: str):
    """JSON as JavaScript reads it: no NaN or Infinity; of repeated keys the last."""

    def refuse(name: str):
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def walk(value, path: tuple):
    """The value at a path, MISSING if there is none. A string on the way that holds JSON is read."""
    for k, step in enumerate(path):
        if value is None or value is MISSING:
            return MISSING
        if isinstance(value, str):
            value = _inner(value) if value.lstrip()[:1] in ("{", "[") else MISSING
            if value is MISSING:
                return MISSING
        if step is EACH or step is VALUES:
            rest = path[k + 1 :]
            if isinstance(value, list):
                return [walk(x, rest) for x in value]
            if not isinstance(value, dict):
                return MISSING
            return [walk(x, rest) for x in (value.values() if step is VALUES else (value,))]
        if isinstance(value, dict):
            value = value.get(step, MISSING)
        elif isinstance(value, list):
            value = value[int(step)] if step.isdigit() and int(step) < len(value) else MISSING
        else:
            return MISSING
    return value


def get(value, path: str):
    return walk(value, steps(path))


def is_empty(value) -> bool:
    return value is MISSING or value is None or value == "" and isinstance(value, str) or isinstance(value, list) and not value


def js_number(x: float | int) -> str:
    """A number as JavaScript prints it."""
    if isinstance(x, int) and abs(x) < 1 << 53:
        return str(x)
    x = float(x)
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x)) if abs(x) < 1 << 53 else format(int(float(repr(x))), "d")
    text = repr(x)
    if "e" in text:
        mantissa, _, power = text.partition("e")
        exponent = int(power)
        if -7 < exponent < 0:
            return f"{x:.{len(mantissa.replace('.', '').lstrip('-')) - 1 - exponent}f}"
        return f"{mantissa}e{'+' if exponent > 0 else '-'}{abs(exponent)}"
    return text


def plain(value):
    """Numbers made such that they print as in JavaScript; missing elements are null."""
    if value is MISSING:
        return None
    if isinstance(value, list):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return {k: plain(x) for k, x in value.items()}
    if isinstance(value, float) and value == int(value) and abs(value) < 1 << 53:
        return int(value)
    return value


def text_of(value) -> str | None:
    """A cell's text: scalars as JavaScript prints them, objects and arrays as JSON."""
    if value is MISSING or value is None:
        return None
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return js_number(value)
    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))


def variant_path(path: str) -> str:
    """A static path as VARIANT access expects it."""
    return "$" + "".join(f"[{s}]" if s.isdigit() else '["' + s.replace("\\", "\\\\").replace('"', '\\"') + '"]' for s in steps(path))


def native(document: Column, path: str, kind: str = "string") -> Column:
    """A static path's value in a VARIANT column, null where it is missing or of another kind."""
    if not is_static(path):
        raise ValueError(f"path {path!r} iterates")
    return F.try_variant_get(document, variant_path(path), kind)


def first_filled(document: Column, paths: tuple[str, ...], kind: str = "string") -> Column:
    """The first non-empty value of several static paths."""
    got = [native(document, p, kind) for p in paths]
    return F.coalesce(*[F.when(c != "", c) for c in got[:-1]], got[-1]) if kind == "string" else F.coalesce(*got)
