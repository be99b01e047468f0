from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from loomstone.plans import registry as R
from loomstone.sources import files, sinks


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿x,y\n1,"two\nlines"\n,"say ""hi"""\n', encoding="utf-8")
    (tmp_path / "l.json").write_text('[{"a":1},"t"]')
    (tmp_path / "o.json").write_text('﻿{"a":2}', encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines"), (None, 'say "hi"')]
    assert files.read_json(spark, str(tmp_path / "l.json")).count() == 2
    assert files.read_json(spark, str(tmp_path / "o.json")).select(F.try_variant_get("record", "$.a", "int")).first()[0] == 2
    assert files.read_text(spark, str(tmp_path / "o.json"), limit=3).count() == 0
    assert {r.format for r in files.inspect(spark, str(tmp_path)).collect()} == {"csv", "json"}


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc/></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/media/image1.png", b"x")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = [(r.kind, r.text) for r in files.read_docx(spark, str(tmp_path / "d.docx")).orderBy("pos").collect()]
    assert got == [("paragraph", "## Head"), ("paragraph", "one two"), ("table", "| a\\|b |  |\n| --- | --- |\n| c |  |"), ("images", "1")]
    assert files.read_docx(spark, str(tmp_path / "bad.docx")).first().kind == "error"


def test_urls_and_envelopes(spark):
    df = spark.createDataFrame([(2, "see https://a.example/x. and http://127.0.0.1/"), (1, "https://b.example, https://a.example/x!"), (3, None)], "k int, t string")
    got = [(r.url, r.first_key, r.first_pos) for r in files.urls(df, "k", "t", limit=10).orderBy("first_key", "first_pos").collect()]
    assert got == [("https://b.example", 1, 0), ("https://a.example/x", 1, 1)]
    rows = [("url_list", '{"urls":["u1","u2"],"url":"src"}', "n"), ("file", '{"records":[{"a":1}]}', "n2"), ("web", '{"text":"t","url":""}', "n3"), ("crawl", "[1,2,3]", "n4"), ("web", "broken", "n5")]
    env = spark.createDataFrame(rows, "kind string, body string, name string")
    out = files.source_records(env, F.col("kind"), F.col("body"), F.col("name")).groupBy("_source").count().where("_source <> 'n5'").collect()
    assert {(r["_source"], r["count"]) for r in out} == {("src", 2), ("n2", 1), ("n3", 1), ("n4", 3)}


def test_pages(spark):
    df = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True), ("t", 1, True), ("t", 2, True), ("t", 9, None)], "start string, n int, nxt boolean")
    assert {(r.start, r.n) for r in files.follow_pages(df, "start", "n", "nxt", 2).collect()} == {("s", 1), ("s", 2), ("t", 1), ("t", 2)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q" | x', None), (2, None, "多\nline")], "i int, a string, b string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c")).collect())) == [("1", 'a "q" | x', None), ("2", None, "多\nline")]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j")).count() == 2
    sinks.write_parquet(df, str(tmp_path / "p"), ["i"])
    sinks.append(df, str(tmp_path / "q"))
    sinks.append(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 4
    assert sinks.enrich(df, "crawl_time", "now").first().crawl_time == "now" and sinks.enrich(df, "b", "x").where("b is null").count() == 1
    assert sinks.markdown_table(df, ["i"]).splitlines()[2:] == ["| 1 | a \"q\" \\| x |  |", "| 2 |  | 多 line |"]


def test_registry_and_workflow(spark, tmp_path):
    reg = R.Registry(R.Operator("file.read", lambda df: df, frozenset({"path"})), R.Operator("data.normalize", lambda df: df))
    with pytest.raises(ValueError):
        reg.add(R.Operator("file.read", lambda df: df))
    assert list(reg) == ["data.normalize", "file.read"] and reg.describe()[1]["needs"] == ["path"]
    (tmp_path / "w.yaml").write_text("requires: [files]\nsteps:\n- {tool: file.read, for_each: files, description: 'read $item of $go', arguments: {path: $item, }}\n- {tool: data.normalize}\n- {tool: data.normalize, when: nothing}\n- {tool: data.normalize, when: always, for_each: nothing}\n")
    definition = files.read_config(str(tmp_path / "w.yaml"))
    steps = R.expand(definition, reg, {"files": ["a", "b"], "nothing": []}, {"go": "g", "goal": "h"})
    assert [(s["id"], s["description"], s["arguments"]) for s in steps] == [("step-01", "read a of g", {"path": "a"}), ("step-02", "read b of g", {"path": "b"}), ("step-03", "Run data.normalize", {})]
    for bad in ({"steps": []}, {}, {"steps": [{"tool": "none"}]}, {"steps": [{"tool": "file.read"}]}, {"steps": [{"tool": "data.normalize", "when": "odd"}]}, {"requires": ["files"], "steps": [{"tool": "data.normalize"}]}):
        with pytest.raises(ValueError):
            R.expand(bad, reg, {"files": []}, {})
    assert R.fill({"a": ["$goal", "$go and $goal", "$x", 3]}, {"go": [1], "goal": 2}) == {"a": [2, "[1] and 2", "$x", 3]}
    assert R.fingerprint({"b": 1, "a": "é"}) == R.fingerprint({"a": "é", "b": 1})
    row = R.catalogue(spark, {"w": definition}).first()
    assert (row.name, row.n_steps, row.tools) == ("w", 4, ["data.normalize", "file.read"]) and row.sha256 == R.fingerprint(definition)
    known = R.built_in()
    assert {"records.deduplicate", "memory.best_repairs", "snapshots.changes"} <= set(known) and "df" in known["records.deduplicate"].needs
