"""JSON that pages ship in their scripts, and recorded or streamed messages as JSON text.

Page code is never evaluated: only strict JSON counts, found by a bracket scan that knows strings.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonpath
from ..functions.values import shorten

SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.I | re.S)
#: Global variables that well-known page frameworks fill.
KNOWN_GLOBALS = ("__NUXT__", "__INITIAL_STATE__", "__APOLLO_STATE__", "__PRELOADED_STATE__", "__REDUX_STATE__", "__DATA__", "__STATE__", "__APP_STATE__", "__remixContext", "__INITIAL_DATA__", "__INITIAL_PROPS__", "ytInitialData", "__STORE__")


class NotFound(ValueError):
    """Nothing of that kind is in the page; the message says what to try."""


def scripts(html: str) -> list[tuple[str, str]]:
    """Attributes and body of every script."""
    return SCRIPT.findall(html or "")


def closing(text: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes, -1 if it doesn't; brackets in strings don't count."""
    depth = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*(?:"|\Z)|\'(?:\\.|[^\'\\])*(?:\'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|[\[\]{}]', text[at:], re.S):
        if m[0] in "[{":
            depth += 1
        elif m[0] in "]}":
            depth -= 1
            if depth == 0:
                return at + m.start()
    return -1


def _parsed(text: str):
    try:
        return jsonpath.loads(text)
    except ValueError:
        return jsonpath.MISSING


#: A global that a script gives an object, an array or parsed text: its name and, ahead, where the value begins.
GIVEN = re.compile(
    r"""(?:\b(?:window|globalThis)(?:\.(?P<member>[\w$]+)|\[["'](?P<key>[^"']+)["']\])|\b(?:var|let|const)\s+(?P<variable>[\w$]+))\s*=\s*(?=(?P<call>JSON\.parse\(\s*)?(?P<opens>[\[{"']))"""
)
QUOTED = re.compile(r""""((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'""", re.S)
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


def given(found: list[tuple[str, str]]) -> Iterator[tuple[str, str, re.Match]]:
    """(name, script, where) of every value that one of a page's inline scripts gives a global."""
    for attrs, body in found:
        if not re.search(r"\ssrc=", attrs, re.I):
            for m in GIVEN.finditer(body):
                if (m["call"] is None) == (m["opens"] in "[{"):
                    yield m["member"] or m["key"] or m["variable"], body, m


def script_text(quoted: str) -> str:
    """What a quoted text of a script stands for. Halves of a surrogate pair come together again."""

    def plain(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(int(code, 16)) if code else PLAIN_ESCAPES.get(m[4], m[4])

    return ESCAPE.sub(plain, quoted).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def given_value(body: str, m: re.Match):
    """The strict JSON of such a value, MISSING if it is none."""
    if m["call"] is not None:
        text = QUOTED.match(body, m.end() + len(m["call"]))
        return _parsed(script_text(text[1] if text[1] is not None else text[2])) if text else jsonpath.MISSING
    end = closing(body, m.end())
    return _parsed(body[m.end() : end + 1]) if end >= 0 else jsonpath.MISSING


def assignment(gifts: list[tuple[str, str, re.Match]], name: str):
    """The first strict JSON value that a script gives a global of that name. gifts: what ``given`` finds."""
    return next((v for n, body, m in gifts if n == name and (v := given_value(body, m)) is not jsonpath.MISSING), jsonpath.MISSING)


def assigned_names(gifts: list[tuple[str, str, re.Match]], limit: int = 20) -> list[str]:
    """Globals that are given values of some size, the largest first. Quoted texts count as of 200 characters."""
    sizes: dict[str, int] = {}
    for name, body, m in gifts:
        size = 200 if m["call"] is not None else closing(body, m.end()) - m.end()
        if size > 40:
            sizes[name] = max(size, sizes.get(name, 0))
    return sorted(sizes, key=sizes.get, reverse=True)[:limit]


def read(html: str, source, found: list | None = None, gifts: list | None = None):
    """The JSON value of a page: ``next``, ``ldjson``, ``window:NAME`` or ``{"regex": ..., "flags": ...}``. The page's
    scripts and what they give globals may be handed in."""
    found = scripts(html) if found is None else found
    if source == "next":
        body = next((b for a, b in found if re.search(r"""id=["']?__NEXT_DATA__["']?""", a, re.I)), None)
        value = _parsed(body) if body is not None else jsonpath.MISSING
        if value is jsonpath.MISSING:
            raise NotFound("no __NEXT_DATA__ script with JSON; try window:__NUXT__ or strategy dom")
        return value
    if source == "ldjson":
        blocks = [v for a, b in found if re.search(r"""type=["']?application/ld\+json["']?""", a, re.I) and (v := _parsed(b.strip())) is not jsonpath.MISSING]
        if not blocks:
            raise NotFound("no application/ld+json block")
        return blocks
    if isinstance(source, str) and source.startswith("window:"):
        gifts = list(given(found)) if gifts is None else gifts
        value = assignment(gifts, source.removeprefix("window:"))
        if value is jsonpath.MISSING:
            raise NotFound(f"no strict JSON is assigned to {source.removeprefix('window:')} (candidates: {', '.join(assigned_names(gifts, 8)) or 'none'})")
        return value
    if isinstance(source, dict) and source.get("regex"):
        flags = sum(getattr(re, f.upper()) for f in source.get("flags") or "" if f in "ims")
        m = re.search(source["regex"], html or "", flags)
        value = _parsed(m[1] if m.re.groups and m[1] is not None else m[0]) if m else jsonpath.MISSING
        if value is jsonpath.MISSING:
            raise NotFound("the pattern finds no JSON")
        return value
    raise ValueError("source must be next, ldjson, window:NAME or an object with a regex")


def embedded(pages: DataFrame, source, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, ``json`` (null where nothing is found) and ``problem``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, problems = [], []
            for html in batch["html"].to_pylist():
                try:
                    values.append(json.dumps(read(html or "", source), ensure_ascii=False, separators=(",", ":")))
                    problems.append(None)
                except NotFound as e:
                    values.append(None)
                    problems.append(str(e))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(values, pa.string()), pa.array(problems, pa.string())], [*keep, "json", "problem"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, "html").mapInArrow(run, f"{kinds}, json string, problem string")


def discover(html: str) -> list[tuple[str, str, int]]:
    """(source, shape, size) of what a page embeds: framework data, known globals, ld+json, other large scripts."""
    out = []
    found = scripts(html)
    if not found:
        return out
    gifts = list(given(found))
    names = {n for n, *_ in gifts}
    for source in ("next", *[f"window:{n}" for n in KNOWN_GLOBALS if n in names], "ldjson"):
        try:
            value = read(html, source, found, gifts)
        except NotFound:
            continue
        text = json.dumps(value, ensure_ascii=False)
        out.append((source, json.dumps(shape(value), ensure_ascii=False), len(text)))
    known = {s for s, *_ in out}
    for name in assigned_names(gifts):
        if f"window:{name}" not in known and (value := assignment(gifts, name)) is not jsonpath.MISSING and len(text := json.dumps(value)) > 2000:
            out.append((f"window:{name}", json.dumps(shape(value), ensure_ascii=False), len(text)))
    return out


def discovered(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """A row for each embedded source of each page: its name, shape and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("source", pa.string()), ("shape", pa.string()), ("size", pa.int64())]))
        for batch in batches:
            found = [[{"source": s, "shape": t, "size": n} for s, t, n in discover(h or "")] for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(found, kind)], [*keep, "found"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, "html").mapInArrow(run, f"{kinds}, found array<struct<source:string,shape:string,size:bigint>>").select(*keep, F.inline("found"))


def peek(pages: DataFrame, source, path: str = "", depth: int = 2, longest: int = 2000, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Of one path of each page's embedded source: ``shape``, ``json`` (cut at a length), ``truncated``, and ``problem``
    where the source isn't there."""

    @F.pandas_udf("struct<shape:string,json:string>")
    def told(documents: pd.Series) -> pd.DataFrame:
        values = [jsonpath.get(jsonpath.loads(d), path) if d is not None else jsonpath.MISSING for d in documents]
        plain = [None if v is jsonpath.MISSING else jsonpath.plain(v) for v in values]
        return pd.DataFrame({"shape": [json.dumps(shape(v, depth), ensure_ascii=False) for v in plain], "json": [json.dumps(v, ensure_ascii=False) for v in plain]})

    found = embedded(pages, source, keep).withColumn("told", F.when(F.col("json").isNotNull(), told("json")))
    return found.select(*keep, "told.shape", shorten(F.col("told.json"), longest).alias("json"), (F.length("told.json") > longest).alias("truncated"), "problem")


def shape(value, depth: int = 2):
    """A sketch of a value's type: keys and lengths down to a depth."""
    if value is None:
        return "null"
    if isinstance(value, list):
        name = f"array({len(value)})"
        return name if depth <= 0 else {name: shape(value[0], depth - 1) if value else "empty"}
    if isinstance(value, dict):
        keys = list(value)
        if depth <= 0:
            return "object{" + ",".join(keys[:8]) + (",…" if len(keys) > 8 else "") + "}"
        out = {k: shape(value[k], depth - 1) for k in keys[:25]}
        if len(keys) > 25:
            out["…"] = f"{len(keys) - 25} more keys"
        return out
    if isinstance(value, str):
        return f'string "{value if len(value) <= 40 else value[:39] + "…"}"'
    return ("boolean " if isinstance(value, bool) else "number ") + jsonpath.text_of(value)


# ---- messages --------------------------------------------------------------------------------------------------


def text_frames(frames: DataFrame, column: str = "raw") -> DataFrame:
    """JSON objects and arrays of text frames; a Socket.IO number in front is cut off, other frames go."""
    body = F.regexp_replace(F.col(column), r"^[0-9]+(?=[\[{])", "")
    return frames.withColumn("json", F.when(F.regexp_like(F.ltrim(body), F.lit(r"^[\[{]")) & F.try_parse_json(body).isNotNull(), body)).where("json is not null")


def distinct_responses(responses: DataFrame) -> DataFrame:
    """One response of the same address and body: the first by ``seq``. Bodies are compared by their digest."""
    own = [c for c in responses.columns if c not in ("url",)]
    by = responses.withColumn("_body", F.sha1(F.col("body").cast("binary"))).groupBy("url", "_body")
    return by.agg(F.min_by(F.struct(*own), "seq").alias("_r")).select("url", *[F.col(f"_r.`{c}`") for c in own]).select(*responses.columns)


def captured(responses: DataFrame, url_match: str, method: str | None = None) -> DataFrame:
    """Successful JSON responses whose address matches, as ``json``; an optional method must equal."""
    own = responses.where(F.regexp_like("url", F.lit(url_match)) & (F.col("status") < 400) & F.lower("content_type").contains("json"))
    if method:
        own = own.where(F.upper("method") == method.upper())
    return distinct_responses(own).withColumn("json", F.when(F.try_parse_json("body").isNotNull(), F.col("body"))).where("json is not null")


SAFE_INTEGER = (1 << 53) - 1
FIELDS, DEEPEST = 536_870_911, 24
VARINT = re.compile(rb"[\x80-\xff]{0,9}[\x00-\x7f]", re.S)
CONTROL = re.compile("[\x00-\x1f\x7f\ufffd]")
#: How compressed frames begin, and what opens them.
PACKED = {b"\x1f\x8b": gzip.decompress, b"\x78\x01": zlib.decompress, b"\x78\x5e": zlib.decompress, b"\x78\x9c": zlib.decompress, b"\x78\xda": zlib.decompress}


class _Reader:
    """A cursor over the bytes of one message."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        m = VARINT.match(self.data, self.at)
        if m is None:
            raise ValueError("bad varint")
        self.at = m.end()
        return sum((b & 0x7F) << 7 * k for k, b in enumerate(m[0]))

    def take(self, size: int) -> bytes:
        part = self.data[self.at : self.at + size]
        if len(part) != size:
            raise ValueError("truncated field")
        self.at += size
        return part


def _whole(n: int) -> int | str:
    return n if n <= SAFE_INTEGER else str(n)


def _fixed(part: bytes) -> int | float:
    """A small integer while the part's top is zero, else a float."""
    top = part[-len(part) // 4 :]
    return struct.unpack({4: "<f", 8: "<d"}[len(part)], part)[0] if any(top) else int.from_bytes(part, "little")


def _delimited(part: bytes, depth: int):
    """Printable text, a nested message or base64, whichever a part can be first."""
    text = part.decode("utf-8", "replace")
    if not CONTROL.search(text):
        return text
    try:
        return protobuf(part, depth + 1)
    except ValueError:
        return f"base64:{base64.b64encode(part).decode()}"


#: By wire type, how a field's value is read.
WIRE = {0: lambda r, _: _whole(r.varint()), 1: lambda r, _: _fixed(r.take(8)), 2: lambda r, depth: _delimited(r.take(r.varint()), depth), 5: lambda r, _: _fixed(r.take(4))}


def protobuf(data: bytes, depth: int = 0) -> dict:
    """A message without its schema: field numbers as keys, repeated fields as arrays.

    Integers beyond 2**53 are text; fixed 8- and 4-byte values are integers while their top quarter is 0, else floats;
    bytes are text where they are printable UTF-8, else a nested message, else ``base64:`` text.
    """
    if depth > DEEPEST:
        raise ValueError("nested too deep")
    reader, values = _Reader(data), defaultdict(list)
    while reader.at < len(data):
        number, wire = divmod(reader.varint(), 8)
        if wire not in WIRE or not 1 <= number <= FIELDS:
            raise ValueError("no field")
        values[str(number)].append(WIRE[wire](reader, depth))
    return {k: v[0] if len(v) == 1 else v for k, v in values.items()}


def _records(data: bytes, length_bytes: int, type_bytes: int) -> list[tuple[dict, bytes]]:
    """The records of a frame, each with its type; the length counts the type's bytes. Bad framing gives none."""
    reader, out = _Reader(data), []
    try:
        while len(data) - reader.at >= length_bytes:
            record = _Reader(reader.take(int.from_bytes(reader.take(length_bytes), "big")))
            kind = {"_type": int.from_bytes(record.take(type_bytes), "big")} if type_bytes else {}
            out.append((kind, record.data[record.at :]))
    except ValueError:
        return []
    return out


def binary_messages(data: bytes, length_bytes: int = 0, type_bytes: int = 0) -> list:
    """The messages in a binary frame: inflated, then JSON, else records of a length prefix (which counts the type's
    bytes), else one schema-less message. What can't be read gives none."""
    try:
        data = PACKED.get(data[:2], bytes)(data)
    except (OSError, EOFError, zlib.error):
        return []
    value = _parsed(re.sub(r"^\d+(?=[\[{])", "", data.decode("utf-8", "replace")))
    if isinstance(value, (dict, list)):
        return [value]
    out = []
    for kind, body in _records(data, length_bytes, type_bytes) if length_bytes else [({}, data)]:
        with contextlib.suppress(ValueError):
            out.append(kind | protobuf(body))
    return out


def binary_frames(frames: DataFrame, column: str = "raw", length_bytes: int = 0, type_bytes: int = 0, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """A row with ``json`` for each message of each binary frame, in order (``part``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[json.dumps(jsonpath.plain(m), ensure_ascii=False, separators=(",", ":")) for m in binary_messages(d or b"", length_bytes, type_bytes)] for d in batch[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(found, pa.list_(pa.string()))], [*keep, "found"])

    kinds = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in keep)
    return frames.select(*keep, column).mapInArrow(run, f"{kinds}, found array<string>").select(*keep, F.posexplode("found").alias("part", "json"))


# ---- sessions and headers --------------------------------------------------------------------------------------


def cookies(spark, path: str) -> DataFrame:
    """Cookies of a storage-state file or of a bare array."""
    whole = spark.read.text(path, wholetext=True)
    kind = "array<struct<name:string,value:string,domain:string,path:string,secure:boolean,expires:double>>"
    parsed = F.coalesce(F.from_json("value", f"struct<cookies:{kind}>")["cookies"], F.from_json("value", kind))
    return whole.select(F.explode(parsed).alias("c")).select("c.*")


def cookie_headers(requests: DataFrame, jar: DataFrame, now: Column | None = None) -> DataFrame:
    """Each request (id, url) with the cookie header that a browser would send: domain suffix, path prefix, secure and
    expiry decide. The jar is a few rows, so it is broadcast."""
    now = F.unix_timestamp() if now is None else now
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+(/[^?#]*)", 1)
    own = requests.withColumn("_host", host).withColumn("_path", F.when(path == "", "/").otherwise(path))
    c = jar.select(*[F.col(x).alias(f"c_{x}") for x in jar.columns], F.monotonically_increasing_id().alias("c_at"))
    domain = F.lower(F.regexp_replace("c_domain", r"^\.", ""))
    want = F.coalesce(F.col("c_path"), F.lit("/"))
    fits = (F.col("_host") == domain) | F.col("_host").endswith(F.concat(F.lit("."), domain))
    below = (F.col("_path") == want) | (F.col("_path").startswith(want) & (want.endswith("/") | (F.substring(F.col("_path"), F.length(want) + 1, F.lit(1)) == "/")))
    alive = F.coalesce(F.col("c_expires"), F.lit(-1.0)) <= 0
    alive = alive | (F.col("c_expires") > now)
    safe = ~F.coalesce(F.col("c_secure"), F.lit(False)) | F.lower("url").startswith("https:")
    joined = own.join(F.broadcast(c), fits & below & alive & safe, "left")
    pair = F.when(F.col("c_name").isNotNull(), F.struct("c_at", F.concat("c_name", F.lit("="), "c_value").alias("text")))
    return joined.groupBy("id", "url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["text"]), "; ").alias("cookie"))


def merged_headers(*maps: Column) -> Column:
    """Header maps laid over one another: names in lower case, later ones win, nulls are left out."""
    out = F.create_map().cast("map<string,string>")
    for m in maps:
        entries = F.filter(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull())
        new = F.map_from_entries(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
        out = _laid_over(out, new)
    return out


def _laid_over(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
