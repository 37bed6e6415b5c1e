import gzip
import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harvestry.functions import jsonpath
from harvestry.sources import dom, embedded
from harvestry.sources.pages import extract


def test_path_steps():
    assert jsonpath.steps('a.b[0]["x.y"].c') == ("a", "b", "0", "x.y", "c")
    store = {"state": {"loaderData": {"routes/kr._index": {"items": [{"t": 1}, {"t": 2}]}}}}
    assert jsonpath.get(store, 'state.loaderData["routes/kr._index"].items[].t') == [1, 2]
    assert jsonpath.get({"a": {"x": {"v": 1}, "y": {"v": 2}}}, "a[*].v") == [1, 2]
    assert jsonpath.get({"a": {"v": 1}}, "a[].v") == [1]
    assert jsonpath.get({"a": '{"b": [1, 2]}'}, "a.b[1]") == 2
    assert jsonpath.get({"a": "x"}, "a.b") is jsonpath.MISSING


@pytest.mark.parametrize(("value", "text"), [(1.0, "1"), (1.5, "1.5"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.000001, "0.000001"), (True, "true"), ({"a": 2.0}, '{"a":2}'), (None, None)])
def test_js_text(value, text):
    assert jsonpath.text_of(value) == text


PAGE = '<ul id=l><li class="a x"><a href="/p?q=1">One <b>b</b></a><li class=b>Two</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y<div>z</div><script>var a="<p>"</script>'


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("li", ["One b", "Two"]), ("li.a > a", ["One b"]), ("li:nth-child(2)", ["Two"]), ("td", ["1", "2", "3"]), ("tr:nth-child(2) td", ["3"]), ("p + p", ["y"]), ("p ~ div", ["z"]), ("li:not(.a)", ["Two"]),
        ('[href^="/p"]', ["One b"]), ("#l li, p", ["One b", "Two", "x", "y"]), ("li:::", []), ("ul > li:first-child a b", ["b"]), ("li:nth-child(odd)", ["One b"]), ("ul:has(b)", ["One b Two"]),
    ],
)
def test_selectors(selector, texts):
    found = [n.text.replace("bTwo", "b Two") for n in dom.query(selector, dom.parse(PAGE))]
    assert found == texts


def test_siblings_and_shadow():
    page = dom.parse("<table><tr class=t><td>a</td></tr><tr><td class=s>1</td></tr></table><x-y><template shadowrootmode=open><i>in</i></template></x-y>")
    row = dom.query("tr.t", page)[0]
    assert [n.text for n in dom.resolve("+ td.s", row)] == ["1"] and dom.resolve("++ td", row) == []
    assert [n.text for n in dom.query("i", page)] == ["in"] and [n.text for n in dom.query("x-y >>> i", page)] == ["in"]


@pytest.mark.parametrize(("link", "full"), [("/a b/ü?x=é#t", "https://ex.com/a%20b/%C3%BC?x=%C3%A9#t"), ("mailto:x@y", "mailto:x@y"), ("//o.com/x", "https://o.com/x"), ("?p=2", "https://ex.com/z?p=2")])
def test_absolute(link, full):
    assert dom.absolute(link, "https://Ex.com/z") == full


def test_extract(spark):
    pages = spark.createDataFrame([(1, "https://s.test/l", '<div class=c><a href="x">A</a><p>£2.00</p><i></i><i></i></div><div class=c></div>'), (2, "u", None)], "page_id long, url string, html string")
    fields = {"name": "a", "link": {"selector": "a", "attr": "href"}, "price": {"selector": "p", "transform": "price"}, "stars": {"selector": "i", "transform": "count"}, "id": {"template": "{name}-{price}"}}
    assert [r.asDict() for r in extract(pages, fields, "div.c").collect()] == [{"page_id": 1, "url": "https://s.test/l", "item_ord": 0, "name": "A", "link": "https://s.test/x", "price": 2.0, "stars": 2, "id": "A-2"}]
    assert extract(pages, {"name": "a"}).count() == 2


def test_embedded():
    page = '<script src=a.js>window.S = {"no":1}</script><script>var t="}"; window.S = {"a": [1, "}]"]}; const big = JSON.parse(\'{"q": "it\\\'s"}\');</script><script type="application/ld+json">[broken</script><script type="application/ld+json">{"k":1}</script>'
    assert embedded.read(page, "window:S") == {"a": [1, "}]"]} and embedded.read(page, "window:big") == {"q": "it's"} and embedded.read(page, "ldjson") == [{"k": 1}]
    for source in ("next", "window:none", {"regex": "zzz"}):
        with pytest.raises(embedded.NotFound):
            embedded.read(page, source)
    with pytest.raises(embedded.NotFound):
        embedded.read("<script>window.S = {a: 1}</script>", "window:S")
    assert embedded.shape({"a": [1], "b": {"c": None}}, 1) == {"a": "array(1)", "b": "object{c}"} and embedded.shape({"a": [1]}) == {"a": {"array(1)": "number 1"}}


def _field(n, wire, body):
    return bytes([n << 3 | wire]) + body


def test_frames():
    inner = _field(1, 2, b"\x07KRW-BTC")
    message = _field(1, 2, bytes([len(inner)]) + inner) + _field(2, 0, b"\x96\x01") + _field(3, 1, struct.pack("<d", 0.0187)) + _field(4, 0, b"\x01") + _field(4, 0, b"\x02")
    want = {"1": {"1": "KRW-BTC"}, "2": 150, "3": 0.0187, "4": [1, 2]}
    assert embedded.protobuf(message) == want
    record = (len(message) + 1).to_bytes(4, "big") + b"\x02" + message
    assert embedded.binary_messages(record * 2, 4, 1) == [{"_type": 2, **want}] * 2
    assert embedded.binary_messages(gzip.compress(b'42["tick", 1]')) == [["tick", 1]]
    assert embedded.binary_messages(b"\xff\xff\xff") == [] and embedded.binary_messages(b"\x00\x00\x00\x09x", 4, 1) == []


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**50), 2**50) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=12).filter(lambda v: isinstance(v, (dict, list))))
def test_assigned_json_round_trip(value):
    text = json.dumps(value).replace("<", "\\u003c")
    assert embedded.read(f"<script>let a = 1; window.X = {text};</script>", "window:X") == value


def test_cookies_and_headers(spark, tmp_path):
    from pyspark.sql import functions as F

    jar = [{"name": "a", "value": "1", "domain": ".x.test", "path": "/"}, {"name": "b", "value": "2", "domain": "y.test"}, {"name": "c", "value": "3", "domain": "x.test", "path": "/list", "secure": True}]
    (tmp_path / "bare.json").write_text(json.dumps(jar))
    (tmp_path / "state.json").write_text(json.dumps({"cookies": jar}))
    calls = spark.createDataFrame([(1, "https://shop.x.test/list"), (2, "http://x.test/")], "id int, url string")
    for name in ("bare.json", "state.json"):
        got = embedded.cookie_headers(calls, embedded.cookies(spark, str(tmp_path / name)))
        assert {r.id: r.cookie for r in got.collect()} == {1: "a=1; c=3", 2: "a=1"}
    merged = spark.range(1).select(embedded.merged_headers(F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3"))).alias("m")).first().m
    assert merged == {"a": "3", "b": "2"}
