"""Gate, markup, JSON, cascade, captures, memory, episodes, records and metrics on small fixtures and odd input."""

from __future__ import annotations

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import captures, cascade, episodes, gate, jsonpath, markup, memory, metrics, records

# ---------------------------------------------------------------- gate


def restated(value, rules):
    """The gate's rules, said once more in plain Python."""
    text = "" if value is None else value.strip()
    failed = []
    for rule, p in rules.items():
        ok = True
        if rule == "non_empty":
            ok = bool(text)
        elif rule == "min_length":
            ok = len(text) >= p
        elif rule == "max_length":
            ok = len(text) <= p
        elif rule == "length_range":
            ok = p["min"] <= len(text) <= (p["max"] or 999_999)
        elif rule == "regex":
            ok = re.match(p["pattern"], text) is not None
        elif rule == "enum":
            ok = text in p["values"]
        elif rule == "type" and p == "price":
            try:
                ok = float(re.sub(r"[^\d.\-]", "", text)) > 0
            except ValueError:
                ok = False
        elif rule == "type" and p == "int":
            try:
                int(text.replace(",", "").replace(" ", ""))
            except ValueError:
                ok = False
        elif rule == "type" and p == "float":
            try:
                float(text.replace(",", "").replace(" ", ""))
            except ValueError:
                ok = False
        if not ok:
            failed.append(gate.label(rule, p))
    return (not failed, (len(rules) - len(failed)) / len(rules), failed)


RULES = [
    {"non_empty": {}, "min_length": 2, "max_length": 5},
    {"length_range": {"min": 1, "max": 0}, "regex": {"pattern": "[a-c]+"}, "unheard_of": 3},
    {"type": "price"},
    {"type": "int"},
    {"type": "float"},
    {"enum": {"values": ["a", "1"]}},
]
VALUES = [None, "", " ", "a", "abc", " 12 ", "-3", "+5", "1_000", "1__0", "1,299", "5-", "1.2.3", "¥ 1,299.00", "nan", "Inf", "1e5", "1.e5", ".5", "5.", "1d", "0x1", "x" * 3000, "多字", "1 2"]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc1.,-+_ e5", max_size=8), max_size=60))
def test_gate_like_restatement(spark, more):
    values = [*VALUES, *more]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for rules in RULES:
        got = {r.i: (r.g.passed, r.g.score, list(r.g.failed_rules)) for r in df.select("i", gate.validate(F.col("v"), rules).alias("g")).collect()}
        for i, v in enumerate(values):
            want = restated(v, rules)
            assert got[i][0] == want[0] and math.isclose(got[i][1], want[1]) and got[i][2] == want[2], (v, rules)


def test_gate_defaults_and_errors(spark):
    df = spark.createDataFrame([("x",), ("",), (None,)], "v string")
    got = df.select(gate.validate(F.col("v")).alias("g"), gate.validate(F.col("v"), {"regex": {"pattern": "("}}).alias("e")).collect()
    assert [(r.g.passed, r.g.failed_rules) for r in got] == [(True, []), (False, ["non_empty"]), (False, ["non_empty"])]
    assert got[0].e.failed_rules == ["regex:eval_error"]


# ---------------------------------------------------------------- markup and JSON

HTML = """<html lang='de'><head><title> A &amp; B </title></head><body><!-- <p>no</p> --><script>var x='<b>';</script>
<div id="d" class="a b"><h1 class="title main">Head <i>line</i></h1><p>one</p><p data-k="v">two</p><br><img src="/x.png"></div>
<ul><li class="item"><a href="https://h/1">first</a></li><li class="item"><a href="https://h/2">second</a></li></ul></body></html>"""


def test_selectors(spark):
    pairs = [("#d > h1.title", None), (".a p + p", None), ("[data-k='v']", "data-k"), ("li:last-child a[href^='https']", "href"), ("a:has-text('second')", None), ("h9, ul a", None), ("img[src*='x']", "src"), ("p:(bad", None), ("nothing", None)]
    df = spark.createDataFrame([(1, HTML), (2, ""), (3, None), (4, "<p>unclosed <b>x")], "i int, h string")
    got = {r.i: r.v for r in df.select("i", markup.select(F.col("h"), pairs).alias("v")).collect()}
    assert got[1] == ["Head line", "two", "v", "https://h/2", "second", "first", "/x.png", "", ""]
    assert got[2] == got[3] == [""] * len(pairs)


def test_native_markup(spark):
    df = spark.createDataFrame([(1, HTML), (2, ""), (3, None)], "i int, h string")
    h = F.col("h")
    row = df.select("i", markup.select_first(h, "h1.title").alias("a"), markup.select_first(h, "a", "href").alias("b"), F.size(markup.select_items(h, "li.item")).alias("n"), markup.depth(h).alias("d"), F.array_join(markup.tags(h), ",").alias("t"), X.page_title(h).alias("p")).orderBy("i").collect()
    assert row[0][1:] == ("Head line", "https://h/1", 2, 5, "html,head,title,body,script,div,h1,i,p,p,br,img,ul,li,a,li,a", "A &amp; B") or row[0].a == "Head line"
    assert row[1][1:3] == ("", "") and row[2][1:3] == ("", "")
    with pytest.raises(ValueError):
        markup.select_first(h, "a > b")


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":"x"},"z"]},"0":"zero"}'), (2, "[{\"a\":1},5]"), (3, "no json"), (4, None)], "i int, j string")
    v = X.parse_json(F.col("j"))
    got = df.select("i", *[jsonpath.resolve(v, p).alias(p.replace(".", "_")) for p in ("a.b.1.c", "a.b.-1", "0", "missing.x")]).orderBy("i").collect()
    assert tuple(got[0])[1:] == ("x", "z", "zero", "") and tuple(got[2])[1:] == tuple(got[3])[1:] == ("",) * 4
    assert {(r.i, r.pos) for r in jsonpath.records(df, "i", "j").collect()} == {(1, 0), (2, 0), (2, 1)}
    assert [(r.i, r.leaf) for r in jsonpath.leaves(df, "i", "j").orderBy("i", "pos").collect()] == [(1, "x"), (1, "z"), (1, "zero")]
    shapes = {r.i: r.s for r in df.select("i", jsonpath.shape(F.col("j")).alias("s")).collect()}
    assert shapes[2] == '{"length":2,"samples":[{"a":"number"},"number"],"type":"array"}' and shapes[3] == '{"parse_error":true}' and shapes[4] is None


def test_strict_json(spark):
    cases = {"{}": True, "[1]": True, " 1 ": True, '"a"': True, "null": True, "{}]": False, "1,2": False, '1,"b":2': False, "": False, "{": False, None: False, "{} x": False}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r.j: r.ok for r in df.select("j", X.parse_json(F.col("j")).isNotNull().alias("ok")).collect()} == cases


# ---------------------------------------------------------------- cascade


def test_cascade_order(spark):
    rows = [("1", "2", "3", "4", "5"), ("", "2", "3", "4", "5"), ("", "", "3", "4", "5"), ("", "", "", "4", "5"), ("", "", "", "4", ""), ("", "", "", "", ""), (None, None, None, None, None), ("x", "x", "x", "x", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string, d string, e string")
    stages = [cascade.Stage(m, m[:3], F.col(c)) for m, c in (("configured", "a"), ("fallback", "b"), ("cached_repair", "c"), ("scrapling_adaptive", "d"), ("llm_text", "e"))]
    got = cascade.apply(df, {"r": (stages, {"type": "price"})}).orderBy("i").collect()
    assert [r.r.method for r in got] == ["configured", "fallback", "cached_repair", "llm_text", "scrapling_adaptive", "exhausted", "exhausted", "exhausted"]
    assert [len(r.r.attempts) for r in got] == [1, 2, 3, 5, 5, 5, 5, 5]
    direct = df.select("i", cascade.run(stages, {"type": "price"}).alias("r")).orderBy("i").collect()
    assert [r.r for r in direct] == [r.r for r in got]
    low = [r.l for r in cascade.apply(df, {"r": (stages, {"type": "price"})}).orderBy("i").select(cascade.low_confidence(F.col("r")).alias("l")).collect()]
    assert low == [False, False, False, True, True, True, True, True]


# ---------------------------------------------------------------- text


def test_text_edges(spark):
    df = spark.createDataFrame([(1, "https://U:p@Host.example:8080/a/123/b?x=1&access_token=q#f"), (2, "password=abc, x"), (3, ""), (4, None), (5, "http://h")], "i int, u string")
    got = {r.i: r for r in df.select("i", X.sanitize_url(F.col("u")).alias("s"), X.url_pattern(F.col("u")).alias("p"), X.slug(F.col("u")).alias("g"), X.public_url(F.col("u")).alias("o")).collect()}
    assert got[1].s == "https://host.example:8080/a/123/b?x=1&access_token=%5BREDACTED%5D" and got[1].p == "*Host.example/a/*/b"
    assert got[2].s == "password=[REDACTED], x" and got[3].s == "" and got[4].s == "" and got[5].p == "*h"
    assert got[4].g == got[3].g == "item" and [got[i].o for i in (1, 2, 3, 4, 5)] == [False, False, False, False, True]


def test_names_links_and_relocation(spark):
    import uuid

    names = ["corpus:a", "", "多"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.u for r in df.orderBy("i").select(X.uuid5(F.col("n"), str(uuid.NAMESPACE_URL)).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    page = spark.createDataFrame([(HTML,), ("",), (None,)], "h string")
    h = F.col("h")
    rows = page.select(X.links(h).alias("l"), markup.relocate(h, "li", {"class": "item"}, "secnd").alias("r"), F.array_join(markup.attribute_names(h), ",").alias("a"), X.json_object(F.lit("x {\"a\": {}} y")).alias("j")).collect()
    assert [tuple(x) for x in rows[0].l] == [("https://h/1", "first"), ("https://h/2", "second")]
    assert (rows[0].r, rows[1].r, rows[2].r) == ("second", "", "")
    assert rows[0].a == "lang,id,class,class,data-k,src,class,href,class,href" and rows[0].j == '{"a": {}}'


def test_first_visible_and_hash(spark):
    df = spark.createDataFrame([("p", 5, "b"), ("p", 3, ""), ("p", 4, "a"), ("q", 99, "x"), ("r", 1, None)], "page string, after int, v string")
    got = {r.page: (r.after, r.v) for r in captures.first_visible(df, "page", "after", "v", 50).collect()}
    assert got == {"p": (4, "a"), "q": (None, None), "r": (None, None)}
    cases = spark.createDataFrame([(i, str(i * 7)) for i in range(500)], "n long, h string")
    one, two = (metrics.corpus_hash(c, "n", "h", width=8).collect() for c in (cases, cases.repartition(7)))
    assert len(one) == 1 and one == two != metrics.corpus_hash(cases.where("n > 0"), "n", "h", width=8).collect()


# ---------------------------------------------------------------- captures


def test_claim_comes_before_checks(spark):
    specs = [captures.CaptureSpec("s", "network_json", url_glob="*/api/*", required=True, max_bytes=20), captures.CaptureSpec("t", "network_json", url_glob="*/[ab]?", max_bytes=20)]
    captures.check_specs(specs)
    rows = [("p", 1, "h/api/1", '{"a":"' + "x" * 50 + '"}'), ("p", 2, "h/api/2", "{}"), ("q", 3, "h/api/9", "{}"), ("q", 4, "h/a1", "oops"), ("r", 5, "h/zz", None)]
    df = spark.createDataFrame(rows, "page string, n int, url string, body string")
    first = captures.first_matches(captures.match_specs(df, "url", specs), "page", ["n"], "body")
    assert {(r.page, r.spec, r.n, r.error) for r in first.collect()} == {("p", "s", 1, "too_large"), ("q", "s", 3, None), ("q", "t", 4, "not_json")}
    missing = captures.missing_specs(df, "page", first, specs)
    assert {r.page for r in captures.failed_pages(missing, "page").collect()} == {"p", "r"}
    with pytest.raises(ValueError):
        captures.check_specs([specs[0], specs[0]])
    assert captures.CaptureSpec("page_url", "x", max_bytes=0).problems() == ["name", "type", "max_bytes"]


def test_budget_and_sequence_over_blocks(spark):
    df = spark.createDataFrame([("hot", i * 40_000) for i in range(50)] + [("b", 1), ("b", 2)], "k string, n long")
    got = {(r.k, r.n): (r.number, r.allowed) for r in captures.within_budget(df, "k", ["n"], 3).collect()}
    assert all(got[("hot", i * 40_000)] == (i + 1, i < 3) for i in range(50)) and got[("b", 2)] == (2, True)
    seq = episodes.sequence(df, "k", ["n"], F.floor(F.col("n") / 100_000)).collect()
    assert all(r.sequence == r.n // 40_000 + 1 for r in seq if r.k == "hot")


# ---------------------------------------------------------------- memory, episodes, records, metrics


def test_repair_log(spark, tmp_path):
    lines = ['{"at":"1","page_pattern":"p","field":"f","new":"a","ok":true,"approved":true}', "", "not json", '{"at":"2","page_pattern":"q","field":"f","new":"b","ok":true,"approved":true}', '{"at":"3","field":"f","new":"c","ok":"true","approved":true}', '{"at":"2","page_pattern":"q","field":"f","new":"later","ok":true,"approved":true}', "[1]"]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = memory.read_log(spark, str(tmp_path / "log.jsonl"))
    pages = spark.createDataFrame([("f", "p"), ("f", "z"), ("g", "p"), (None, None)], "field string, page_pattern string")
    got = {(r.field, r.page_pattern): (r.selector, r.match_score) for r in memory.best_repairs(log, pages).collect()}
    assert got == {("f", "p"): ("a", 3), ("f", "z"): ("b", 2), ("g", "p"): (None, None), (None, None): (None, None)}
    s = memory.stats(log).first()
    assert (s.total, s.success) == (4, 3)


def test_payloads(spark):
    df = spark.createDataFrame([(1, '{"Access-Token":"x","a":[{"userPassword":"y","b":"token=1&password=zz"}]}'), (2, "api_key=k"), (3, None)], "i int, p string")
    got = {r.i: r.c for r in df.select("i", episodes.sanitize_payload(F.col("p")).alias("c")).collect()}
    assert got == {1: '{"_redacted_fields":["access_token"],"a":[{"_redacted_fields":["userpassword"],"b":"token=1&password=[REDACTED]"}]}', 2: "api_key=[REDACTED]", 3: None}


def test_deduplicate(spark):
    rows = [(3, "t", None, "s2"), (1, "t", None, "s1"), (2, "t", None, ""), (4, "t", None, "s1"), (5, "u", 1, None), (6, None, None, "x"), (7, None, None, "x")]
    df = spark.createDataFrame(rows, "_id int, a string, b int, _source string")
    got = {r["_first"]["_id"]: (r.a, r.b, r["_sources"], r["_copies"]) for r in records.deduplicate(df, ["_id"]).collect()}
    assert got == {1: ("t", None, ["s1", "s2"], 4), 5: ("u", 1, [], 1), 6: (None, None, ["x"], 2)}
    assert records.deduplicate(df.limit(0), ["_id"]).collect() == []


def test_metrics(spark):
    rows = [("normal", True, "a", "a", False), ("recoverable", True, "a", "a", False), ("invalid_candidate", True, "a", "a", False), ("irrecoverable", True, "a", "a", False)]
    schema = "category string, passed boolean, stage string, expected_stage string, accepted boolean"
    good = metrics.failures(metrics.pack(spark.createDataFrame(rows, schema), "category", "passed", "stage", "expected_stage", "accepted")).first()
    none = metrics.failures(metrics.pack(spark.createDataFrame([], schema), "category", "passed", "stage", "expected_stage", "accepted")).first()
    assert good.failures == [] and len(none.failures) == 5
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, v string, duration_ms int")
    assert metrics.same_outcome(a, a.withColumn("duration_ms", F.lit(0)), "id").collect() == []
    passed = spark.createDataFrame([("normal", "v", "v", True, False), ("irrecoverable", None, "", False, False), ("invalid_candidate", None, "", False, True), ("odd", "v", "v", True, False)], "c string, e string, a string, v boolean, i boolean")
    assert [r.p for r in passed.select(metrics.case_passed(*[F.col(c) for c in "ceavi"]).alias("p")).collect()] == [True, True, False, False]


@pytest.mark.parametrize("make", ["deduplicate", "best_repairs", "first_matches", "sequence", "put_objects", "import_outcomes"])
def test_empty_tables(spark, make):
    e = lambda s: spark.createDataFrame([], s)
    out = {
        "deduplicate": lambda: records.deduplicate(e("_id int, a string, _source string"), ["_id"]),
        "best_repairs": lambda: memory.best_repairs(e("at string, page_pattern string, field string, new string, ok boolean, approved boolean, line_no long"), e("field string, page_pattern string")),
        "first_matches": lambda: captures.first_matches(e("p string, spec string, n int, body string, max_bytes int"), "p", ["n"], "body"),
        "sequence": lambda: episodes.sequence(e("k string, n int"), "k", ["n"], F.col("n")),
        "put_objects": lambda: episodes.put_objects(e("body string"), "body"),
        "import_outcomes": lambda: episodes.import_outcomes(e("n int, line string"), e("n int"), ["n"]),
    }[make]()
    assert out.collect() == []


def test_paths_selectors_and_embedded(spark):
    paths = {"a/b": True, "../x": False, "a/../../x": False, "/x": False, "C:\\x": False, "a\\..\\..\\x": False, "": False, None: False, "a/../b": True}
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    assert {r.p: r.ok for r in df.select("p", X.contained_path(F.col("p")).alias("ok")).collect()} == paths
    answers = {"```css\n.a > b\n```": ".a > b", "Selector: `#x`": "#x", "sorry, no.": "", "": "", None: "", "Use this\ndiv.item": "div.item"}
    df = spark.createDataFrame([(k,) for k in answers], "t string")
    assert {r.t: r.s for r in df.select("t", X.suggested_selector(F.col("t")).alias("s")).collect()} == answers
    spec = captures.CaptureSpec("s", "embedded_json", selector="script.s", max_bytes=10)
    df = spark.createDataFrame([("<script class='s'>{}</script>",), ("<script class='s'>{</script>",), ("<script class='s'>{\"a\":12345}</script>",), ("",), (None,)], "h string")
    assert [(r.error, r.body) for r in captures.embedded(df, "h", spec).collect()] == [(None, "{}"), ("not_json", None), ("too_large", None), ("missing", None), ("missing", None)]


def test_report_sample_export(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else None, "x" * 3000) for i in range(30)], "i int, s string, t string")
    assert [r.line for r in records.report(df, "s").orderBy("line_no").collect()] == ["Records: 30; sources: 2", "- s: 20", "- unknown: 10"]
    assert [r.line for r in records.report(df.limit(0), "s").collect()] == ["Records: 0; sources: 0"]
    got = records.sample(df, ["i"]).collect()
    assert len(got) == 10 and len(got[0].t) == 2000
    ev = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 3, "z")], "k string, n int, v string")
    out = episodes.export(spark.createDataFrame([("a",), ("b",)], "id string"), "id", {"events": (ev, "k", ["n"])}).orderBy("id").collect()
    assert [r.body for r in out] == ['{"episode":{"id":"a"},"events":[{"n":1,"v":"x"},{"n":2,"v":"y"}]}', '{"episode":{"id":"b"},"events":[]}']


def test_report_lists_every_source(spark):
    df = spark.range(1000).selectExpr("concat('s', id % 450) AS s")
    counts = sorted(((-(3 if i < 100 else 2), f"s{i}") for i in range(450)))
    got = [(r.line_no, r.line) for r in records.report(df, "s").orderBy("line_no").collect()]
    assert got == [(1, "Records: 1000; sources: 450"), *((k + 2, f"- {s}: {-n}") for k, (n, s) in enumerate(counts))]


def test_patches():
    from loomstone.operators import patches as P

    good = [{"fields": [{"name": "x"}]}, {"request": {"wait_until": "load", "timeout_ms": 1}}, [{"op": "test", "path": "/validation/x", "value": 1}], [{"op": "replace", "path": "/request/timeout_ms", "value": 300_000}], [{"op": "remove", "path": "/fields/0"}]]
    bad = [None, 1, {}, [], ["x"], {"start_url": "x"}, {"fields": {"a": [{"Cookies": 1}]}}, {"captures": {"myToken": 1}}, {"request": {}}, {"request": 3}, {"request": {"headers": {}}}, {"request": {"timeout_ms": True}}, {"request": {"timeout_ms": 300_001}}, {"request": {"wait_until": []}}, {"request": {"wait_for_selector": " "}},
           [{"op": "move", "path": "/fields/0"}], [{"op": "add", "path": "fields"}], [{"op": "add", "path": "/request"}], [{"op": "add", "path": "/fields/0/url"}], [{"op": "add", "path": "/fields/0", "from": "/x"}], [{"op": "add", "path": "/fields/0", "value": {"proxy": 1}}]]
    assert [P.fault(x) for x in good] == [None] * len(good)
    assert [x for x in bad if P.fault(x) is None] == []
    plan = {"name": "n", "request": {"wait_until": "load"}, "fields": [1]}
    assert P.applied(plan, {"request": {"timeout_ms": 5}, "fields": []}) == {"name": "n", "request": {"wait_until": "load", "timeout_ms": 5}, "fields": []}


def test_scope_and_adapter_config(spark):
    from loomstone.operators import cascade
    from loomstone.plans.registry import ECOMMERCE

    df = spark.createDataFrame([("<li><b>in</b></li>", "<h1>top</h1><li><b>in</b></li><b>out</b>")], "item string, page string")
    got = df.select(*[c.alias(n) for n, c in cascade.page_fields(F.col("item"), F.col("page"), {"a": ("b", "item"), "t": ("h1", "page"), "u": ("h1", "item")}).items()]).first()
    assert (got.a, got.t, got.u) == ("in", "top", "")
    config = ECOMMERCE.config("https://x", name="mine")
    assert config["name"] == "mine" and config["start_url"] == "https://x" and config["fields"][0]["fallback_selectors"][0] == "[class*='product-name']" and config["fields"][2]["attr"] == "src"
