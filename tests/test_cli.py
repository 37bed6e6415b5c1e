import json

from harvestry.__main__ import main


def test_collect(spark, tmp_path, capsys):
    page = "<ul>" + "".join(f"<li class=i><a href=/{k}>N{k}</a></li>" for k in range(3)) + "</ul>"
    spark.createDataFrame([(1, "https://x.test/", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    recipe = {"version": 1, "name": "r", "strategy": "dom", "pages": {"type": "single", "start": "https://x.test/"}, "items": {"container": "li.i"}, "fields": {"name": "a", "link": {"selector": "a", "attr": "href"}}}
    (tmp_path / "r.json").write_text(json.dumps(recipe))
    assert main(["collect", str(tmp_path / "r.json"), "--pages", str(tmp_path / "p"), "--out", str(tmp_path / "o.csv"), "--limit", "2"], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["rows"] == 2 and told["stop_reason"] == "end_of_list" and told["fill_rate"] == {"name": 1.0, "link": 1.0}
    assert (tmp_path / "o.csv").read_text(encoding="utf-8-sig").splitlines() == ["name,link", "N0,https://x.test/0", "N1,https://x.test/1"]
    (tmp_path / "bad.json").write_text(json.dumps({**recipe, "version": 3}))
    assert main(["collect", str(tmp_path / "bad.json")], spark) == 2


def test_blocked_runs_and_resumed_ones(spark, tmp_path, capsys):
    body = lambda *own: json.dumps([{"id": i} for i in own])
    write = lambda rows: spark.createDataFrame(rows, "url string, status int, body string").write.mode("overwrite").parquet(str(tmp_path / "r"))
    recipe = {"version": 1, "name": "r", "strategy": "http", "pages": {"type": "param"}, "http": {"url_template": "u?p={n}"}, "fields": {"id": "id"}, "output": {"dedupe_key": "id"}}
    (tmp_path / "r.json").write_text(json.dumps(recipe))
    command = ["collect", str(tmp_path / "r.json"), "--responses", str(tmp_path / "r"), "--state", str(tmp_path / "s.json")]
    for fmt in ("csv", "json", "xlsx"):
        out = str(tmp_path / f"o.{fmt}")
        write([("u?p=1", 200, body(1, 2)), ("u?p=2", 403, "")])
        assert main([*command, "--out", out], spark) == 3
        told = json.loads(capsys.readouterr().out)
        assert (told["rows"], told["stop_reason"], told["blocked_by"]["kind"], told["ok"]) == (2, "blocked", "access_denied", False)
        write([("u?p=1", 200, body(1, 2)), ("u?p=2", 200, body(2, 3)), ("u?p=3", 200, "[]")])
        assert main([*command, "--resume"], spark) == 0
        told = json.loads(capsys.readouterr().out)
        assert (told["rows"], told["rows_previous"], told["stop_reason"], told["path"]) == (1, 2, "empty_page", out)
        if fmt == "csv":
            assert open(out, encoding="utf-8-sig").read().splitlines() == ["id", "1", "2", "3"]
        if fmt == "json":
            assert [r["id"] for r in json.load(open(out))] == ["1", "2", "3"]
        assert json.loads((tmp_path / "s.json").read_text())["done"]
    write([("u?p=1", 500, "")])
    assert main([*command, "--out", str(tmp_path / "e.csv")], spark) == 1


def test_finish_and_har(spark, tmp_path, capsys):
    (tmp_path / "rows.json").write_text(json.dumps([{"id": "1", "n": 10}, {"id": "2", "n": 20}, {"id": "2", "n": 20}, {"z": "x"}]))
    for _ in range(2):
        assert main(["finish", str(tmp_path / "rows.json"), "--out", str(tmp_path / "f.csv"), "--dedupe-key", "id"], spark) == 0
    assert (tmp_path / "f-2.csv").read_text(encoding="utf-8-sig").splitlines() == ["id,n,z", "1,10,", "2,20,", ",,x"]
    log = {"log": {"entries": [{"request": {"method": "GET", "url": "https://a.test/api?page=1"}, "response": {"status": 200, "content": {"mimeType": "application/json", "text": json.dumps([{"a": 1}, {"a": 2}])}}, "_resourceType": "xhr"}]}}
    (tmp_path / "l.har").write_text(json.dumps(log))
    capsys.readouterr()
    assert main(["har", str(tmp_path / "l.har")], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["entries"] == 1 and told["candidates"][0]["items_path"] == "[]" and told["candidates"][0]["pages"] == "param"
