"""The queries of the engine's own operators with their DuckDB equivalents.

The page tables are made from the listings, so that both engines read the same markup.
"""

from __future__ import annotations


import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import captures, cascade, episodes, gate, jsonpath, markup, memory, metrics, patches, records
from loomstone.plans.registry import ECOMMERCE, adapter_name
from loomstone.session import once, spread, table
from loomstone.sources import files
from loomstone.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where SQL can say it."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


# ---------------------------------------------------------------- tables made for the queries

_PAGE = """'<html lang="zh"><head><title>' || coalesce({t}, '') || '</title><style>p > b {{ color: red }}</style></head><body><!-- <p>old</p> --><script>var a = "<b>";</script>'
 || CASE WHEN row_id % 3 = 0 THEN '' ELSE '<h1 class="goods title"> ' || coalesce({t}, '') || ' </h1>' END
 || CASE WHEN row_id % 5 = 0 THEN '' ELSE '<span class="price">' || coalesce({p}, '') || '</span>' END
 || '<div data-field="price">' || coalesce({o}, '') || '</div><ul><li class="item"><a href="' || coalesce({u}, '') || '">' || coalesce({k}, '') || '</a></li><li class="item">' || coalesce({s}, '') || '</li></ul><br></body></html>'"""


def _page(quote: str) -> str:
    names = {"t": "商品标题", "p": "页面价", "o": "原价", "u": "来源页", "k": "sku名称", "s": "店铺名称"}
    return _PAGE.format(**{k: f"{quote}{v}{quote}" for k, v in names.items()})


PAGES = f'pages AS (SELECT row_id, "来源页" AS url, {_page(chr(34))} AS html FROM taobao)'


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "taobao")).select("row_id", F.col("来源页").alias("url"), F.expr(_page("`")).alias("html"))


LOG = """log AS (SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at", event_type AS field, 'p' || CAST(user_id % 7 AS VARCHAR) AS page_pattern,
 'sel-' || CAST(event_id AS VARCHAR) AS "new", value > 20 AS ok, value > 40 AS approved FROM events)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("line_no"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("event_type").alias("field"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("page_pattern"),
        F.concat(F.lit("sel-"), F.col("event_id").cast("string")).alias("new"), (F.col("value") > 20).alias("ok"), (F.col("value") > 40).alias("approved"),
    )


# ---------------------------------------------------------------- projections and text

_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|noscript|svg)\b[^>]*>.*?</(script|style|noscript|svg)\s*>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '[\s\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{1680}]+', ' ', 'g'))"


@query(f"WITH {PAGES} SELECT row_id, {_STRIP} AS text, trim({_STRIP.replace('(html,', '(regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1),', 1)}) AS title FROM pages")
def html_to_text(spark, d):
    return _pages(spark, d).select("row_id", X.strip_html(F.col("html")).alias("text"), X.page_title(F.col("html")).alias("title"))


_PATTERN = r"""CASE WHEN h <> '' THEN '*' || h || CASE WHEN len(p) > 0 THEN '/' || array_to_string(list_transform(p, lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') OR length(s) > 32 THEN '*' ELSE s END), '/') ELSE '' END END"""
_HOSTPATH = r"""SELECT id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS h,
 list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS p FROM """


@query(f"WITH u AS ({_HOSTPATH} (SELECT record_id AS id, page_url AS url FROM crawler_cli)) SELECT id AS record_id, {_PATTERN} AS pattern, lower(h) AS host FROM u")
def url_pattern(spark, d):
    c = table(spark, d, "crawler_cli")
    return c.select("record_id", X.url_pattern(F.col("page_url")).alias("pattern"), X.hostname(F.col("page_url")).alias("host"))


@query(
    r"""SELECT p_partkey, coalesce(nullif(left(lower(regexp_replace(regexp_replace(coalesce(p_name, ''), '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')), 64), ''), 'item') AS slug,
 'part-' || coalesce(nullif(left(lower(regexp_replace(regexp_replace(coalesce(p_name, ''), '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')), 64), ''), 'item') || '-' || left(sha256(p_name), 10) || '.md' AS file FROM part"""
)
def slug_filename(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.filename("part", F.col("p_name"), ".md").alias("file"))


_SECRET_TEXT = """'api_key=' || CAST(c_custkey AS VARCHAR) || ', note ' || c_name || '; https://h/?token=t' || CAST(c_custkey AS VARCHAR) || '&x=1 Cookie: c' || CAST(c_custkey AS VARCHAR)"""


@query(
    rf"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace({_SECRET_TEXT},
 '(?i)(["'']?(?:set[-_]?cookie|cookie(?:[-_]?header)?)["'']?\s*[:=]\s*)[^,}}\r\n]+', '\1[REDACTED]', 'g'),
 '(?i)(["'']?(?:api[-_]?key|client[-_]?secret|access[-_]?token|refresh[-_]?token|auth[-_]?token|id[-_]?token|session[-_]?token|(?:csrf|xsrf)(?:[-_]?token)?|password|passwd)["'']?\s*[:=]\s*)(?:"[^"\r\n]*"|''[^''\r\n]*''|[^,;}}\r\n]+)', '\1[REDACTED]', 'g'),
 '(?i)([?&](?:api[_-]?key|token|access_token|secret|password|auth)=)[^&#\s]+', '\1[REDACTED]', 'g') AS clean FROM customer"""
)
def redact_text(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", X.redact(F.expr(_SECRET_TEXT.replace("VARCHAR", "STRING"))).alias("clean"))


@query(
    r"""WITH u AS (SELECT record_id, page_url || '?a=1&token=x' || CAST(record_id AS VARCHAR) || '&q=2#top' AS url FROM crawler_cli)
 SELECT record_id, regexp_replace(regexp_replace(url, '#.*$', ''), '([?&]token)=[^&]*', '\1=%5BREDACTED%5D') AS url FROM u WHERE url IS NOT NULL"""
)
def sanitize_url(spark, d):
    c = table(spark, d, "crawler_cli").where("page_url is not null")
    return c.select("record_id", X.sanitize_url(F.expr("page_url || '?a=1&token=x' || cast(record_id as string) || '&q=2#top'")).alias("url"))


@query(
    """WITH k AS (SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'Access-Token' WHEN 1 THEN 'userName' WHEN 2 THEN 'clientSecret ' WHEN 3 THEN 'authorization_category' WHEN 4 THEN 'Local Storage' ELSE n_name END AS k FROM nation)
 SELECT n_nationkey, trim(regexp_replace(lower(trim(k)), '[^a-z0-9]+', '_', 'g'), '_') AS name, n_nationkey % 6 IN (0, 2, 4) AS sensitive FROM k"""
)
def sensitive_keys(spark, d):
    k = table(spark, d, "nation").select("n_nationkey", F.expr("CASE n_nationkey % 6 WHEN 0 THEN 'Access-Token' WHEN 1 THEN 'userName' WHEN 2 THEN 'clientSecret ' WHEN 3 THEN 'authorization_category' WHEN 4 THEN 'Local Storage' ELSE n_name END").alias("k"))
    return k.select("n_nationkey", X.normalize_key(F.col("k")).alias("name"), X.is_sensitive_key(F.col("k")).alias("sensitive"))


@query("""SELECT row_id, TRY_CAST(regexp_extract("页面价", '[0-9.]+') AS DOUBLE) AS price_num, TRY_CAST(regexp_extract("原价", '[0-9.]+') AS DOUBLE) AS list_num FROM taobao""")
def price_clean(spark, d):
    return records.clean_numbers(table(spark, d, "taobao"), ["页面价", "原价"]).select("row_id", F.col("页面价_num").alias("price_num"), F.col("原价_num").alias("list_num"))


@query(
    r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + CASE WHEN ends_with(t, chr(10)) THEN 0 ELSE 1 END END AS lines, length(text) AS characters
 FROM (SELECT doc_id, text, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]', chr(10), 'g') AS t FROM documents)"""
)
def text_summary(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", X.splitlines_count(F.col("text")).alias("lines"), F.length("text").cast("bigint").alias("characters"))


@query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^# (.+)$', 1)), ''), source) AS title FROM documents""")
def markdown_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", X.markdown_title(F.col("text"), F.col("source")).alias("title"))


# ---------------------------------------------------------------- selectors and the cascade

_H1 = r"""trim(regexp_extract(html, '(?is)<h1[^>]*class="[^"]*title[^"]*"[^>]*>(.*?)</h1>', 1))"""
_SPAN = r"""trim(regexp_extract(html, '(?is)<span class="price">(.*?)</span>', 1))"""
_DIV = r"""trim(regexp_extract(html, '(?is)<div data-field="price">(.*?)</div>', 1))"""
_COLLAPSE = r"""regexp_replace({x}, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{0085}}\x{{1680}}]+', ' ', 'g')"""


def _c(x: str) -> str:
    return f"trim({_COLLAPSE.format(x=x)})"


@query(f"WITH {PAGES} SELECT row_id, {_c(_SPAN)} AS price, {_c(_DIV)} AS list_price, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS link, 'zh' AS lang FROM pages")
def attr_extract(spark, d):
    h = F.col("html")
    return _pages(spark, d).select("row_id", markup.select_first(h, "span.price").alias("price"), markup.select_first(h, "div[data-field=price]").alias("list_price"), markup.select_first(h, "a", "href").alias("link"), markup.select_first(h, "html", "lang").alias("lang"))


@query(f"WITH {PAGES} SELECT row_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS item FROM (SELECT row_id, regexp_extract_all(html, '(?is)<li class=\"item\">.*?</li>') AS x FROM pages)")
def item_explode(spark, d):
    return _pages(spark, d).select("row_id", F.posexplode(markup.select_items(F.col("html"), "li.item")).alias("pos", "item"))


_PRICE_OK = "coalesce(TRY_CAST(regexp_replace({x}, '[^0-9.-]', '', 'g') AS DOUBLE) > 0, false)"


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    stages = [cascade.Stage("configured", "span.price", markup.select_first(h, "span.price")), cascade.Stage("fallback", "div[data-field=price]", markup.select_first(h, "div[data-field=price]"))]
    return cascade.apply(_pages(spark, d), {"r": (stages, {"type": "price"})})


_CASCADE = f"""WITH {PAGES}, v AS (SELECT row_id, url, {_c(_SPAN)} AS a, {_c(_DIV)} AS b FROM pages),
 w AS (SELECT *, a <> '' AND {_PRICE_OK.format(x="a")} AS oka, b <> '' AND {_PRICE_OK.format(x="b")} AS okb FROM v)"""


@query(
    _CASCADE
    + """ SELECT row_id, CASE WHEN oka THEN 'configured' WHEN okb THEN 'fallback' ELSE 'exhausted' END AS method, CASE WHEN oka THEN 1.0 WHEN okb THEN 0.9 ELSE 0.0 END AS confidence,
 CASE WHEN oka THEN a WHEN okb THEN b ELSE '' END AS value, CASE WHEN oka OR NOT okb THEN 'span.price' ELSE 'div[data-field=price]' END AS selector, oka OR okb AS validated FROM w"""
)
def extract_cascade(spark, d):
    return _cascade(spark, d).select("row_id", "r.method", "r.confidence", "r.value", "r.selector", "r.validated")


@query(
    _CASCADE
    + """ SELECT row_id, 0 AS pos, 'configured' AS stage, oka AS accepted, a <> '' AS had_value FROM w UNION ALL SELECT row_id, 1, 'fallback', okb, b <> '' FROM w WHERE NOT oka"""
)
def cascade_attempts(spark, d):
    return _cascade(spark, d).select("row_id", F.posexplode("r.attempts").alias("pos", "t")).select("row_id", "pos", "t.stage", "t.accepted", "t.had_value")


@query(_CASCADE + """ SELECT CASE WHEN oka THEN 'configured' WHEN okb THEN 'fallback' ELSE 'exhausted' END AS method, count(*) AS n, sum(CASE WHEN oka THEN 0 ELSE 1 END) AS episodes FROM w GROUP BY 1""")
def cascade_stage_summary(spark, d):
    below = cascade.low_confidence(F.col("r"), 0.95)
    return _cascade(spark, d).groupBy(F.col("r.method").alias("method")).agg(F.count("*").alias("n"), F.count_if(below).alias("episodes"))


@query(
    f"""WITH {PAGES}, t AS (SELECT row_id, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(script|style)[^>]*>).*?(</(script|style)\\s*>)', '\\1\\3', 'g'), '<([a-zA-Z][a-zA-Z0-9-]*)\\b[^>]*>', 1))) AS tag FROM pages)
 SELECT tag, count(*) AS n, count(DISTINCT row_id) AS pages FROM t GROUP BY tag"""
)
def html_tag_profile(spark, d):
    t = _pages(spark, d).select("row_id", F.explode(markup.tags(F.col("html"))).alias("tag"))
    return t.groupBy("row_id", "tag").count().groupBy("tag").agg(F.sum("count").alias("n"), F.count("*").alias("pages"))


@query()
def html_depth(spark, d):
    return _pages(spark, d).select("row_id", markup.depth(F.col("html")).alias("depth"))


@query()
def css_select(spark, d):
    pairs = [("ul > li.item a[href^='https']", "href"), ("h1.goods.title, [data-field=price]", None), ("li.item + li.item", None)]
    made = F.inline(F.array(F.struct(markup.select(F.col("html"), pairs).alias("v"))))
    return _pages(spark, d).select("row_id", made).select("row_id", *[F.col("v")[i].alias(n) for i, n in enumerate(("link", "head", "shop"))])


@query()
def adapter_records(spark, d):
    wanted = [(s, f.attr) for f in ECOMMERCE.fields for s in f.selectors]
    found = _pages(spark, d).select("row_id", "url", F.inline(F.array(F.struct(markup.select(F.col("html"), wanted).alias("v")))))
    found = once(found, {**{f"v{i}": F.col("v")[i] for i in range(len(wanted))}, "adapter": adapter_name(F.col("url"), [ECOMMERCE])}, ["row_id"])
    fields, at = {}, 0
    for f in ECOMMERCE.fields:
        fields[f.name] = ([cascade.Stage("configured" if i == 0 else "fallback", s, F.col(f"v{at + i}")) for i, s in enumerate(f.selectors)], f.rules)
        at += len(f.selectors)
    done = cascade.apply(found, fields)
    return ECOMMERCE.post_process(done.select("row_id", "adapter", *[F.col(f"`{n}`.value").alias(n) for n in fields]))


# ---------------------------------------------------------------- the quality gate

_GATES: dict[str, tuple[str, str, dict | None, str]] = {
    # name: (table, value in both dialects, rules, SQL condition on t)
    "gate_non_empty": ("taobao", 'row_id|"sku名称"', None, "t <> ''"),
    "gate_min_length": ("taobao", 'row_id|"商品标题"', {"min_length": 12}, "length(t) >= 12"),
    "gate_max_length": ("taobao", 'row_id|"商品标题"', {"max_length": 30}, "length(t) <= 30"),
    "gate_length_range": ("taobao", 'row_id|"店铺名称"', {"length_range": {"min": 5, "max": 0}}, "length(t) BETWEEN 5 AND 999999"),
    "gate_price": ("taobao", 'row_id|"页面价"', {"type": "price"}, _PRICE_OK.format(x="t")),
    "gate_int": ("taobao", 'row_id|"库存"', {"type": "int"}, "regexp_full_match(regexp_replace(t, '[, ]', '', 'g'), '[+-]?[0-9]+(_[0-9]+)*')"),
    "gate_float": ("crawler_cli", 'record_id|"评分"', {"type": "float"}, r"regexp_full_match(regexp_replace(t, '[, ]', '', 'g'), '(?i)[+-]?([0-9]+(_[0-9]+)*\.?|([0-9]+(_[0-9]+)*)?\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+)?|[+-]?(inf|infinity|nan)')"),
    "gate_url": ("crawler_cli", "record_id|page_url", {"type": "url"}, r"regexp_matches(t, '^https?://[^\s]+')"),
    "gate_date": ("crawler_cli", "record_id|crawl_time", {"type": "date"}, "regexp_matches(t, '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}')"),
    "gate_email": ("customer", "c_custkey|c_name || CASE WHEN c_custkey % 3 = 0 THEN '@shop.example' ELSE '' END", {"type": "email"}, r"regexp_full_match(t, '[^\s@]+@[^\s@]+\.[^\s@]+')"),
    "gate_regex": ("part", "p_partkey|p_name", {"regex": {"pattern": "[a-m]"}}, "regexp_matches(t, '^[a-m]')"),
    "gate_enum": ("orders", "o_orderkey|o_orderstatus", {"enum": {"values": ["O", "F"]}}, "t IN ('O', 'F')"),
}
_BLANKS = r"[\s\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{1680}]+"


def _gate_sql(source: str, key: str, value: str, condition: str) -> str:
    return f"SELECT {key}, {condition} AS passed, CASE WHEN {condition} THEN 1.0 ELSE 0.0 END AS score FROM (SELECT {key}, regexp_replace(coalesce({value}, ''), '^{_BLANKS}|{_BLANKS}$', '', 'g') AS t FROM {source})"


def _add_gates() -> None:
    for name, (source, what, rules, condition) in _GATES.items():
        key, value = what.split("|", 1)

        def run(spark, d, source=source, key=key, value=value, rules=rules):
            made = gate.validate(F.expr(value.replace('"', "`")), rules)
            return table(spark, d, source).select(key, F.inline(F.array(made))).select(key, "passed", "score")

        QUERIES[name] = run
        ORACLES[name] = _gate_sql(source, key, value, condition)


_add_gates()


@query(
    f"""WITH g AS (SELECT row_id, regexp_replace(coalesce("商品标题", ''), '^{_BLANKS}|{_BLANKS}$', '', 'g') AS t FROM taobao),
 f AS (SELECT row_id, list_filter([CASE WHEN NOT (t <> '') THEN 'non_empty:{{}}' END, CASE WHEN NOT (length(t) >= 10) THEN 'min_length:10' END, CASE WHEN NOT (length(t) <= 40) THEN 'max_length:40' END, CASE WHEN NOT regexp_matches(t, '^[A-Z]') THEN 'regex:[A-Z]' END], lambda x: x IS NOT NULL) AS l FROM g)
 SELECT row_id, len(l) = 0 AS passed, (5 - len(l)) / 5.0 AS score, array_to_string(l, ';') AS failed FROM f"""
)
def gate_report(spark, d):
    rules = {"non_empty": {}, "min_length": 10, "max_length": 40, "regex": {"pattern": "[A-Z]"}, "unheard_of": 1}
    made = F.inline(F.array(gate.validate(F.col("商品标题"), rules)))
    return table(spark, d, "taobao").select("row_id", made).select("row_id", "passed", "score", F.array_join("failed_rules", ";").alias("failed"))


# ---------------------------------------------------------------- JSON


@query("""SELECT id, coalesce(json_extract_string(payload_json, '$.field'), '') AS field, coalesce(json_extract_string(payload_json, '$.stage'), '') AS stage, TRY_CAST(json_extract_string(payload_json, '$.confidence') AS DOUBLE) AS confidence FROM repair_events""")
def json_path(spark, d):
    v = table(spark, d, "repair_events").withColumn("v", X.parse_json(F.col("payload_json")))
    return v.select("id", jsonpath.resolve(F.col("v"), "field").alias("field"), jsonpath.resolve(F.col("v"), "stage").alias("stage"), jsonpath.resolve(F.col("v"), "confidence").try_cast("double").alias("confidence"))


@query()
def json_shapes(spark, d):
    s = table(spark, d, "repair_events").select(jsonpath.shape(F.col("payload_json"), ["token"]).alias("shape"))
    return s.groupBy("shape").count()


@query("""SELECT id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS value FROM (SELECT id, regexp_split_to_array(page_pattern, '/') AS x FROM repair_episodes WHERE page_pattern IS NOT NULL)""")
def json_records(spark, d):
    r = table(spark, d, "repair_episodes").where("page_pattern is not null").select("id", F.to_json(F.split("page_pattern", "/")).alias("body"))
    return jsonpath.records(r, "id", "body").select("id", "pos", F.try_variant_get("record", "$", "string").alias("value"))


@query()
def json_leaves(spark, d):
    return jsonpath.leaves(table(spark, d, "repair_episodes"), "id", "metadata_json")


# ---------------------------------------------------------------- sources and records


@query(
    rf"""WITH x AS (SELECT row_id, unnest(regexp_extract_all(html, '({files.URL.replace("'", "''")})', 1)) AS u, generate_subscripts(regexp_extract_all(html, '({files.URL.replace("'", "''")})', 1), 1) - 1 AS p FROM (WITH {PAGES} SELECT row_id, html FROM pages)),
 c AS (SELECT row_id, p, regexp_replace(u, '[.,;:!?]+$', '') AS url FROM x)
 SELECT url, arg_min(row_id, (row_id, p)) AS first_key, CAST(arg_min(p, (row_id, p)) AS INTEGER) AS first_pos FROM c WHERE regexp_matches(url, '^https?://[^/?#@:]+(:(80|443))?([/?#]|$)') GROUP BY url"""
)
def url_list_extract(spark, d):
    return files.urls(_pages(spark, d), "row_id", "html")


@query(
    """WITH h AS (SELECT n_nationkey AS id, unnest(['http://a.example/' || n_name, 'https://127.0.0.1/x', 'https://10.0.0.' || CAST(n_nationkey AS VARCHAR), 'ftp://a.example', 'https://u:p@a.example/', 'https://a.example:8443/', 'https://b.local', 'https://8.8.8.' || CAST(n_nationkey AS VARCHAR) || ':443/'])
 AS url, unnest([true, false, false, false, false, false, false, true]) AS public FROM nation) SELECT id, url, public FROM h"""
)
def public_url_filter(spark, d):
    made = F.expr("array('http://a.example/' || n_name, 'https://127.0.0.1/x', 'https://10.0.0.' || cast(n_nationkey as string), 'ftp://a.example', 'https://u:p@a.example/', 'https://a.example:8443/', 'https://b.local', 'https://8.8.8.' || cast(n_nationkey as string) || ':443/')")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.explode(made).alias("url")).withColumn("public", X.public_url(F.col("url")))


@query(
    """SELECT min(doc_id) AS doc_id, count(*) AS copies, count(DISTINCT nullif(source, '')) AS n_sources FROM documents GROUP BY text, lang"""
)
def normalize_dedup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_id"), "text", "lang", F.col("source").alias("_source"))
    out = records.deduplicate(docs, ["_id"])
    return out.select(F.col("_first._id").alias("doc_id"), F.col("_copies").alias("copies"), F.size("_sources").cast("bigint").alias("n_sources"))


@query("""SELECT 0 AS rank, row_id AS id, "商品标题" AS title, "来源页" AS url FROM taobao UNION ALL SELECT 1, record_id, title, url FROM approved_browser_template UNION ALL SELECT 2, record_id, NULL, page_url FROM crawler_cli""")
def normalize_union(spark, d):
    a = table(spark, d, "taobao").select(F.col("row_id").alias("id"), F.col("商品标题").alias("title"), F.col("来源页").alias("url"))
    b = table(spark, d, "approved_browser_template").select(F.col("record_id").alias("id"), "title", "url")
    c = table(spark, d, "crawler_cli").select(F.col("record_id").alias("id"), F.col("page_url").alias("url"))
    return records.union([a, b, c]).select(F.col("_rank").alias("rank"), "id", "title", "url")


@query("""SELECT page_url AS url, min(record_id) AS first_id, row_number() OVER (ORDER BY min(record_id)) AS position FROM crawler_cli WHERE trim(page_url) <> '' GROUP BY page_url""")
def stable_dedup(spark, d):
    out = records.stable_distinct(table(spark, d, "crawler_cli"), "page_url", ["record_id"])
    return out.select(F.col("page_url").alias("url"), F.col("_o.record_id").alias("first_id"), "position")


@query("""SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS row_no, '| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS line FROM nation ORDER BY 1 LIMIT 20""")
def markdown_table(spark, d):
    return records.markdown_rows(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"], 20)


@query("""SELECT source, count(*) AS n_records, max(coalesce(nullif(page_pattern, ''), nullif(lang, ''), source)) AS label FROM documents GROUP BY source""")
def source_manifest(spark, d):
    return records.source_manifest(table(spark, d, "documents"), "source", "page_pattern", "lang")


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || CAST(n_nationkey AS VARCHAR) || ',"n_regionkey":' || CAST(n_regionkey AS VARCHAR) || '}') AS fingerprint FROM nation""")
def canonical_hash(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select("n_nationkey", records.fingerprint(n.columns).alias("fingerprint"))


@query("""WITH k AS (SELECT id, unnest(json_keys(metadata_json)) AS name, generate_subscripts(json_keys(metadata_json), 1) - 1 AS pos FROM repair_episodes) SELECT name, arg_min(id, (id, pos)) AS row, CAST(arg_min(pos, (id, pos)) AS INTEGER) AS pos FROM k GROUP BY name""")
def first_seen_columns(spark, d):
    e = table(spark, d, "repair_episodes").select("id", F.from_json("metadata_json", "map<string,string>").alias("fields"))
    return records.first_seen_columns(e, "id", "fields")


@query()
def files_round_trip(spark, d):
    """Writes listings as JSON lines and reads them back; the rows must be the same."""
    from loomstone.session import shared_folder
    from loomstone.sources import sinks

    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    sinks.write_jsonl(table(spark, d, "crawler_cli").select("record_id", "page_url", "crawl_time"), path)
    r = files.read_jsonl(spark, path)
    return r.select(F.try_variant_get("record", "$.record_id", "bigint").alias("record_id"), F.try_variant_get("record", "$.page_url", "string").alias("page_url"), F.try_variant_get("record", "$.crawl_time", "string").alias("crawl_time"))


ORACLES["files_round_trip"] = "SELECT record_id, page_url, crawl_time FROM crawler_cli"

# ---------------------------------------------------------------- repair memory


@query(
    f"""WITH {LOG}, u AS (SELECT * FROM log WHERE ok AND approved), s AS (SELECT field, page_pattern, arg_max("new", ("at", -line_no)) AS n FROM u GROUP BY 1, 2), a AS (SELECT field, arg_max("new", ("at", -line_no)) AS n FROM u GROUP BY 1),
 p AS (SELECT DISTINCT field, page_pattern FROM log) SELECT p.field, p.page_pattern, coalesce(s.n, a.n) AS selector, CASE WHEN s.n IS NOT NULL THEN 3 WHEN a.n IS NOT NULL THEN 2 END AS match_score
 FROM p LEFT JOIN s ON p.field = s.field AND p.page_pattern = s.page_pattern LEFT JOIN a ON p.field = a.field"""
)
def repair_suggest(spark, d):
    log = _log(spark, d)
    return memory.best_repairs(log, log.select("field", "page_pattern").distinct())


@query(f"""WITH {LOG} SELECT field, count(*) AS total, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE ok) / count(*) AS rate FROM log GROUP BY field""")
def repair_stats(spark, d):
    return memory.stats(_log(spark, d), "field")


# ---------------------------------------------------------------- episodes


@query("""SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence FROM events""")
def event_sequence(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return episodes.sequence(e, "user_id", ["ts", "event_id"], F.to_date("ts")).select("event_id", "user_id", "sequence")


@query(
    """WITH v AS (SELECT * FROM repair_events WHERE event_type = 'validation') SELECT e.id, coalesce(a.n, 0) AS n_events, coalesce(b.n, 0) AS n_validations, a.last AS last_events_id, b.last AS last_validations_id FROM repair_episodes e
 LEFT JOIN (SELECT episode_id, count(*) AS n, arg_max(id, (sequence, id)) AS last FROM repair_events GROUP BY 1) a ON e.id = a.episode_id LEFT JOIN (SELECT episode_id, count(*) AS n, arg_max(id, (sequence, id)) AS last FROM v GROUP BY 1) b ON e.id = b.episode_id"""
)
def episode_bundle(spark, d):
    ev = table(spark, d, "repair_events").select("id", "episode_id", "sequence", "event_type")
    out = episodes.bundle(table(spark, d, "repair_episodes").select("id"), "id", {"events": (ev.withColumnRenamed("id", "eid"), "episode_id", ["sequence", "eid"]), "validations": (ev.where("event_type = 'validation'").withColumnRenamed("id", "eid"), "episode_id", ["sequence", "eid"])})
    number = lambda c: F.get_json_object(c, "$.eid").cast("bigint")
    return out.select("id", "n_events", "n_validations", number("last_events").alias("last_events_id"), number("last_validations").alias("last_validations_id"))


@query("""SELECT id, created_at, status FROM repair_episodes ORDER BY created_at DESC, id DESC LIMIT 50""")
def episode_list(spark, d):
    return episodes.newest(table(spark, d, "repair_episodes"), 50).select("id", "created_at", "status")


@query("""SELECT episode_id, arg_max(event_type, (sequence, id)) AS event_type FROM repair_events GROUP BY episode_id""")
def latest_event(spark, d):
    return episodes.latest(table(spark, d, "repair_events"), "episode_id", "event_type", ["sequence", "id"])


@query("""WITH h AS (SELECT sha256(text) AS sha256, max(octet_length(encode(text))) AS size_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT sha256, CAST(size_bytes AS BIGINT) AS size_bytes, 'objects/' || sha256[1:2] || '/' || sha256[3:4] || '/' || sha256 AS object_path FROM h WHERE sha256 NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de' AND text IS NOT NULL)""")
def cas_dedup(spark, d):
    docs = table(spark, d, "documents")
    store = docs.where("lang = 'de' and text is not null").select(F.sha2("text", 256).alias("sha256")).distinct()
    return episodes.put_objects(docs, "text", store).drop("body")


@query()
def cas_verified(spark, d):
    docs = episodes.put_objects(table(spark, d, "documents"), "text")
    return episodes.verified(docs).groupBy("intact").agg(F.count("*").alias("n"))


@query("""SELECT e.id, e.episode_id FROM repair_events e WHERE artifact_sha256 IS NOT NULL AND EXISTS (SELECT 1 FROM repair_episodes x WHERE x.id = e.episode_id AND x.status = 'open')""")
def artifact_visibility(spark, d):
    ev = table(spark, d, "repair_events").where("artifact_sha256 is not null").select("id", "episode_id")
    live = table(spark, d, "repair_episodes").where("status = 'open'").select(F.col("id").alias("episode_id"))
    return ev.join(live, "episode_id", "left_semi").select("id", "episode_id")


_LINES = """CASE WHEN line_no % 5 = 0 THEN 'not json' WHEN line_no % 7 = 0 THEN '{"field":"","new":"x","ok":true}' WHEN line_no % 11 = 0 THEN '{"field":"f","new":"x","ok":"true"}' ELSE '{"field":"f","new":"x","ok":true}' END"""


@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'skipped' WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN 'invalid' ELSE 'imported' END AS outcome, count(*) AS n FROM events GROUP BY 1"""
)
def legacy_import(spark, d):
    lines = table(spark, d, "events").select(F.col("event_id").alias("line_no")).withColumn("line", F.expr(_LINES))
    done = lines.where("line_no % 3 = 0").select("line_no")
    return episodes.import_outcomes(lines, done, ["line_no"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query()
def sanitize_payloads(spark, d):
    e = table(spark, d, "repair_events").select("id", F.concat(F.lit('{"Api-Key":"k","note":"password=x1","p":'), "payload_json", F.lit("}")).alias("body"))
    return e.select("id", episodes.sanitize_payload(F.col("body")).alias("clean"))


@query("""WITH a AS (SELECT n_nationkey AS k, n_name AS h FROM nation WHERE n_nationkey % 4 <> 0), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS h FROM nation WHERE n_nationkey % 3 <> 0)
 SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' ELSE 'altered' END AS state FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h""")
def manifest_check(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("h"))
    other = n.where("k % 3 <> 0").withColumn("h", F.when(F.col("k") % 5 == 0, "").otherwise(F.col("h")))
    return episodes.manifest_differences(n.where("k % 4 <> 0"), other, "k", "h")


# ---------------------------------------------------------------- captures

_SPECS = [captures.CaptureSpec("lists", "network_json", url_glob="https://*.shop.example/list/*", required=True, max_bytes=40), captures.CaptureSpec("items", "network_json", url_glob="https://s00?.shop.example/item/*")]
_MATCHED = """m AS (SELECT run_id, record_id, page_url, '{"price":"' || coalesce("价格", 'none') || CASE WHEN record_id % 4 = 0 THEN '' ELSE '"}' END AS body, spec, max_bytes FROM crawler_cli,
 (SELECT unnest(['lists', 'items']) AS spec, unnest(['https://.*[.]shop[.]example/list/.*', 'https://s00.[.]shop[.]example/item/.*']) AS re, unnest([40, 1000000]) AS max_bytes) WHERE regexp_full_match(page_url, re))"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("""'{"price":"' || coalesce(`价格`, 'none') || CASE WHEN record_id % 4 = 0 THEN '' ELSE '"}' END""")
    return captures.match_specs(table(spark, d, "crawler_cli").select("run_id", "record_id", "page_url", body.alias("body")), "page_url", _SPECS)


@query(f"WITH {_MATCHED} SELECT run_id, record_id, spec FROM m")
def spec_theta_join(spark, d):
    return _matched(spark, d).select("run_id", "record_id", "spec")


@query(f"""WITH {_MATCHED}, f AS (SELECT *, row_number() OVER (PARTITION BY run_id, spec ORDER BY record_id) AS rn FROM m) SELECT run_id, spec, record_id, CASE WHEN octet_length(encode(body)) > max_bytes THEN 'too_large' WHEN NOT json_valid(body) THEN 'not_json' END AS error FROM f WHERE rn = 1""")
def capture_first_match(spark, d):
    return captures.first_matches(_matched(spark, d), "run_id", ["record_id"], "body").select("run_id", "spec", "record_id", "error")


@query(f"""WITH {_MATCHED}, f AS (SELECT *, row_number() OVER (PARTITION BY run_id, spec ORDER BY record_id) AS rn FROM m), g AS (SELECT run_id, spec FROM f WHERE rn = 1 AND octet_length(encode(body)) <= max_bytes AND json_valid(body)),
 w AS (SELECT DISTINCT run_id, s.spec, s.required FROM crawler_cli, (SELECT unnest(['lists', 'items']) AS spec, unnest([true, false]) AS required) s) SELECT w.run_id, count(*) AS n_missing FROM w LEFT JOIN g ON w.run_id = g.run_id AND w.spec = g.spec WHERE g.spec IS NULL GROUP BY 1 HAVING bool_or(w.required)""")
def capture_failures(spark, d):
    taken = captures.first_matches(_matched(spark, d), "run_id", ["record_id"], "body")
    return captures.failed_pages(captures.missing_specs(table(spark, d, "crawler_cli"), "run_id", taken, _SPECS), "run_id")


@query("""SELECT record_id, number, number <= 20 AS allowed FROM (SELECT record_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY record_id) AS BIGINT) AS number FROM crawler_cli)""")
def request_budget(spark, d):
    out = captures.within_budget(table(spark, d, "crawler_cli").select("run_id", "record_id"), "run_id", ["record_id"], 20)
    return out.select("record_id", F.col("number").cast("bigint").alias("number"), "allowed")


@query("""SELECT record_id, CASE WHEN regexp_matches(page_url, '^https://[^/]*taobao[.]com') THEN 'ecommerce' END AS adapter FROM (SELECT record_id, CASE WHEN record_id % 2 = 0 THEN replace(page_url, 'shop.example', 'taobao.com') ELSE page_url END AS page_url FROM crawler_cli)""")
def adapter_match(spark, d):
    c = table(spark, d, "crawler_cli").select("record_id", F.expr("CASE WHEN record_id % 2 = 0 THEN replace(page_url, 'shop.example', 'taobao.com') ELSE page_url END").alias("u"))
    return c.select("record_id", adapter_name(F.col("u"), [ECOMMERCE]).alias("adapter"))


# ---------------------------------------------------------------- metrics

_CASES = "cases AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'recoverable' WHEN 2 THEN 'invalid_candidate' ELSE 'irrecoverable' END AS category, l_quantity > 10 AS passed, l_returnflag AS stage, l_linestatus AS expected_stage, l_discount > 0.09 AS accepted_invalid FROM lineitem)"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    e = ["l_orderkey * 10 + l_linenumber AS id", "CASE l_linenumber % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'recoverable' WHEN 2 THEN 'invalid_candidate' ELSE 'irrecoverable' END AS category", "l_quantity > 10 AS passed", "l_returnflag AS stage", "l_linestatus AS expected_stage", "l_discount > 0.09 AS accepted_invalid"]
    return table(spark, d, "lineitem").selectExpr(*e)


@query(f"WITH {_CASES} SELECT category, count(*) FILTER (WHERE passed) AS passed, count(*) AS total, count(*) FILTER (WHERE passed) / count(*) AS rate FROM cases GROUP BY category")
def benchmark_rates(spark, d):
    return metrics.rates(_cases(spark, d), "category", "passed")


@query(
    f"""WITH {_CASES}, r AS (SELECT unnest(['normal_exact_match', 'recoverable_recovery', 'invalid_candidate_acceptance', 'irrecoverable_correct_failure', 'expected_stage_match']) AS gate,
 unnest([count(*) FILTER (WHERE category = 'normal'), count(*) FILTER (WHERE category = 'recoverable'), count(*) FILTER (WHERE category = 'invalid_candidate'), count(*) FILTER (WHERE category = 'irrecoverable'), count(*)]) AS total,
 unnest([count(*) FILTER (WHERE category = 'normal' AND passed), count(*) FILTER (WHERE category = 'recoverable' AND passed), count(*) FILTER (WHERE category = 'invalid_candidate' AND accepted_invalid), count(*) FILTER (WHERE category = 'irrecoverable' AND passed), count(*) FILTER (WHERE stage = expected_stage)]) AS good,
 unnest([1, 1, 0, 1, 1]) AS wanted FROM cases) SELECT gate, total, CASE WHEN total > 0 THEN good / total ELSE 0.0 END AS rate, total <= 0 OR good / total <> wanted AS failed FROM r"""
)
def benchmark_gate(spark, d):
    """Every rate of the pack with the gate it passes or fails."""
    out = metrics.failures(metrics.pack(_cases(spark, d), "category", "passed", "stage", "expected_stage", "accepted_invalid"))
    gates = [F.struct(F.lit(n).alias("gate"), F.col(f"{n}_total").alias("total"), F.col(n).cast("double").alias("rate"), F.array_join("failures", "\n").rlike(rf"(?m)^{n} ").alias("failed")) for n in metrics.GATES]
    return out.select(F.inline(F.array(*gates)))


@query()
def corpus_hash(spark, d):
    return metrics.corpus_hash(table(spark, d, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h")), "o_orderkey", "h")


# ---------------------------------------------------------------- streams (extensions: windows and watermarks)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    events = streams.read_files(spark, path, spark.read.parquet(path).schema)
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    from loomstone.session import shared_folder

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    return streams.run_available(stream, _folder(spark), _folder(spark), mode)


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = _run(spark, streams.tumbling(_stream(spark, d), "at", "1 day", "1 day", ["event_type"]), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("WITH w AS (SELECT date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS s, event_type FROM events, range(2) r(i)) SELECT s AS window_start, event_type, count(*) AS n FROM w GROUP BY 1, 2")
def stream_sliding(spark, d):
    out = _run(spark, streams.sliding(_stream(spark, d), "at", "2 days", "1 day", "1 day", ["event_type"]), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS session_start, count(*) AS n FROM h GROUP BY user_id, k"""
)
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT event_type, count(*) AS n, max(k) AS last FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) GROUP BY 1")
def stream_sequence(spark, d):
    target = _folder(spark)
    streams.run_batches(_stream(spark, d).select("event_id", "event_type", "at"), streams.sequence_batches(target, "event_type", ["at", "event_id"]), _folder(spark))
    out = spark.read.parquet(f"{target}/rows")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.max("sequence").alias("last"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_first_match(spark, d):
    return _run(spark, streams.first_matches(_stream(spark, d).select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id"), "append")


@query("SELECT user_id, page, event_type, min(event_id) AS event_id FROM (SELECT user_id, event_id % 3 AS page, event_type, event_id FROM events) GROUP BY 1, 2, 3")
def stream_page_matches(spark, d):
    """A page of a run has its own claims: the number of the page is part of the key."""
    rows = _stream(spark, d).select("user_id", (F.col("event_id") % 3).alias("page"), "event_type", "event_id")
    return _run(spark, streams.first_matches(rows, ["user_id", "page"], "event_type", "event_id"), "append")


@query("SELECT user_id, count(*) AS n, least(count(*), 20) AS n_allowed FROM events GROUP BY 1")
def stream_budget(spark, d):
    out = _run(spark, streams.within_budget(_stream(spark, d).select("user_id", "event_id"), "user_id", 20), "append")
    return out.groupBy("user_id").agg(F.max("number").alias("n"), F.count_if("allowed").alias("n_allowed"))


@query(
    """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
 p AS (SELECT user_id, min(ts) AS opened, max(ts) AS last, bool_or(event_type = 'view') AS v, bool_or(event_type = 'purchase') AS p FROM h GROUP BY user_id, k)
 SELECT user_id, opened, concat_ws(',', CASE WHEN NOT v THEN 'view' END, CASE WHEN NOT p THEN 'purchase' END) AS missing FROM p WHERE NOT (v AND p) AND last + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)"""
)
def stream_missing_specs(spark, d):
    out = _run(spark, streams.missing_after(_stream(spark, d).select("user_id", "event_type", "at"), "user_id", "event_type", "at", "1 day", ["view", "purchase"]), "append")
    return out.select("user_id", F.col("opened").cast("timestamp_ntz").alias("opened"), F.array_join("missing", ",").alias("missing"))


# ---------------------------------------------------------------- further helpers of the data path


@query(r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '!\[([^\]]*)\]\(([^)\s]+)[^)]*\)', 2)) AS ref FROM documents) SELECT doc_id, ref, count(*) AS n, regexp_matches(ref, '(?i)^(https?:)?//|^data:') AS remote FROM r GROUP BY 1, 2""")
def image_references(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.explode(X.image_references(F.col("text"))).alias("ref"))
    return r.groupBy("doc_id", "ref").agg(F.count("*").alias("n")).withColumn("remote", X.is_remote(F.col("ref")))


@query(r"""SELECT doc_id, regexp_replace(text, '(!\[[^\]]*\]\()([^)\s/]*/)*([^)\s/]+)', '\1kept/\3', 'g') AS text FROM documents WHERE contains(text, '![')""")
def rewrite_images(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("!["))).select("doc_id", X.rewrite_images(F.col("text"), "kept").alias("text"))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE payload_json END AS body FROM repair_events""")
def json_object_from_text(spark, d):
    noisy = F.expr("CASE WHEN id % 3 = 0 THEN 'no object {here' ELSE 'Sure:\n```json\n' || payload_json || '\n``` done' END")
    return table(spark, d, "repair_events").select("id", X.json_object(noisy).alias("body"))


@query(f"""WITH {PAGES} SELECT row_id, regexp_extract(html, '<a href="([^"]*)"', 1) AS url, {_c("regexp_extract(html, '(?is)<a href=[^>]*>(.*?)</a>', 1)")} AS title FROM pages""")
def page_links(spark, d):
    return _pages(spark, d).select("row_id", F.inline(X.links(F.col("html"))))


@query()
def name_uuids(spark, d):
    return table(spark, d, "repair_episodes").select("id", X.uuid5(F.concat(F.lit("corpus:"), "id"), "6ba7b811-9dad-11d1-80b4-00c04fd430c8").alias("uuid"))


@query(
    f"""WITH {PAGES} SELECT row_id, octet_length(encode(html)) AS size_bytes, length(html) AS characters, sha256(html) AS sha256 FROM pages"""
)
def structural_summary(spark, d):
    h = F.col("html")
    return _pages(spark, d).select("row_id", F.octet_length(h).cast("bigint").alias("size_bytes"), F.length(h).cast("bigint").alias("characters"), F.sha2(h, 256).alias("sha256"))


@query()
def html_attribute_profile(spark, d):
    a = _pages(spark, d).select(F.explode(markup.attribute_names(F.col("html"))).alias("attribute"))
    return a.groupBy("attribute").agg(F.count("*").alias("n"))


@query()
def adaptive_relocation(spark, d):
    found = markup.relocate(F.col("html"), "li", {"class": "item"}, "旗舰店")
    return _pages(spark, d).select("row_id", found.alias("text"))


@query("""SELECT episode_id, min(sequence) FILTER (WHERE sequence <= 4 AND coalesce(artifact_sha256, '') <> '') AS sequence, arg_min(artifact_sha256, sequence) FILTER (WHERE sequence <= 4 AND coalesce(artifact_sha256, '') <> '') IS NOT NULL AS shown FROM repair_events GROUP BY 1""")
def hydration_first_visible(spark, d):
    out = captures.first_visible(table(spark, d, "repair_events"), "episode_id", "sequence", "artifact_sha256", 4)
    return out.select("episode_id", "sequence", F.col("artifact_sha256").isNotNull().alias("shown"))


@query(r"""SELECT row_id, NOT starts_with(p, '/') AND regexp_matches(p, '^a/[.][.]/x') = false AND p NOT LIKE '..%' AS inside FROM (SELECT row_id, CASE row_id % 4 WHEN 0 THEN '../x' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'a/../../x' ELSE 'a/./b/../c' END AS p FROM taobao) WHERE p <> 'a/../../x' UNION ALL SELECT row_id, false FROM taobao WHERE row_id % 4 = 2""")
def path_containment(spark, d):
    p = F.expr("CASE row_id % 4 WHEN 0 THEN '../x' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'a/../../x' ELSE 'a/./b/../c' END")
    return table(spark, d, "taobao").select("row_id", X.contained_path(p).alias("inside"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '.price-now' WHEN 1 THEN 'h1.title' WHEN 2 THEN '' ELSE 'li.item > a' END AS selector FROM nation""")
def selector_sanitize(spark, d):
    t = F.expr("CASE n_nationkey % 4 WHEN 0 THEN '```css\n.price-now\n```' WHEN 1 THEN 'Selector: \"h1.title\"' WHEN 2 THEN 'I cannot help with that!' ELSE 'li.item > a' END")
    return table(spark, d, "nation").select("n_nationkey", X.suggested_selector(t).alias("selector"))


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN 'missing' WHEN octet_length(encode(payload_json)) > 66 THEN 'too_large' WHEN id % 7 = 0 THEN 'not_json' END AS error FROM (SELECT id, CASE WHEN id % 7 = 0 THEN payload_json || ']' ELSE payload_json END AS payload_json FROM repair_events)""")
def embedded_json_capture(spark, d):
    page = F.expr("CASE WHEN id % 5 = 0 THEN '<p>none</p>' ELSE '<html><script type=\"x\">no</script><script class=\"state\"> ' || payload_json || CASE WHEN id % 7 = 0 THEN ']' ELSE '' END || ' </script></html>' END")
    spec = captures.CaptureSpec("state", "embedded_json", selector="script.state", max_bytes=66)
    return captures.embedded(table(spark, d, "repair_events").select("id", page.alias("html")), "html", spec).select("id", "error")


@query("""SELECT event_id, event_id % 2 = 0 AND event_type IN ('view', 'click') AND 150 + event_id % 200 BETWEEN 200 AND 299 AS taken FROM events""")
def json_responses(spark, d):
    made = captures.is_json_response(F.expr("CASE WHEN event_id % 2 = 0 THEN 'get' ELSE 'POST' END"), F.expr("CASE event_type WHEN 'view' THEN 'xhr' WHEN 'click' THEN 'fetch' ELSE 'image' END"), F.expr("150 + event_id % 200"), F.lit("application/JSON; charset=utf-8"))
    return table(spark, d, "events").select("event_id", made.alias("taken"))


@query("""SELECT id, CASE WHEN length(s) >= 8 THEN s ELSE 'picked' END AS captured, s AS kept FROM (SELECT id, coalesce(json_extract_string(payload_json, '$.stage'), '') AS s FROM repair_events)""")
def source_path_field(spark, d):
    stage = jsonpath.resolve(F.col("v"), "stage")
    e = once(table(spark, d, "repair_events").withColumn("v", X.parse_json(F.col("payload_json"))), {"s": stage}, ["id"])
    return e.select("id", cascade.from_context(F.col("s"), F.lit("picked"), True, {"min_length": 8}).alias("captured"), cascade.from_context(F.col("s"), F.lit("picked"), False, {"min_length": 8}).alias("kept"))


@query("""WITH c AS (SELECT coalesce(source, 'unknown') AS s, count(*) AS n FROM documents GROUP BY 1) SELECT 1 AS line_no, 'Records: ' || CAST(sum(n) AS VARCHAR) || '; sources: ' || CAST(count(*) AS VARCHAR) AS line FROM c
 UNION ALL SELECT CAST(row_number() OVER (ORDER BY n DESC, s) + 1 AS INTEGER), '- ' || s || ': ' || CAST(n AS VARCHAR) FROM c""")
def report_summary(spark, d):
    return records.report(table(spark, d, "documents"), "source")


@query("""SELECT doc_id, left(text, 2000) AS text, left(source, 2000) AS source FROM documents ORDER BY doc_id LIMIT 10""")
def model_sample(spark, d):
    return records.sample(table(spark, d, "documents").select("doc_id", "text", "source"), ["doc_id"])


@query("""WITH p AS (SELECT p_partkey, 'in/' || p_name || CASE p_partkey % 4 WHEN 0 THEN '.YAML' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' ELSE '' END AS path FROM part)
 SELECT p_partkey, path, p_partkey % 4 = 0 AS is_yaml, p_partkey % 4 = 1 AS is_document, p_partkey % 4 = 1 AS is_markdown, p_partkey % 4 = 2 AS is_table, p_partkey % 4 = 1 AS is_text FROM p""")
def input_groups(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("'in/' || p_name || CASE p_partkey % 4 WHEN 0 THEN '.YAML' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' ELSE '' END").alias("path"))
    return records.input_groups(p, "path")


@query("""SELECT e.id, count(v.id) AS n_events FROM repair_episodes e LEFT JOIN repair_events v ON v.episode_id = e.id GROUP BY 1""")
def episode_export(spark, d):
    ev = table(spark, d, "repair_events").select("episode_id", F.col("id").alias("event_id"), "sequence", "event_type")
    out = episodes.export(table(spark, d, "repair_episodes").select("id", "status"), "id", {"events": (ev, "episode_id", ["sequence", "event_id"])})
    listed = F.from_json("body", "struct<events:array<struct<event_id:bigint>>>")["events"]
    return out.select("id", F.size(listed).cast("bigint").alias("n_events"))


@query("""WITH v AS (SELECT artifact_sha256 AS sha256 FROM repair_events WHERE event_type <> 'validation' UNION SELECT json_extract_string(payload_json, '$.evidence') FROM repair_events WHERE event_type = 'validation' UNION SELECT artifact_sha256 FROM repair_events WHERE event_type = 'validation'),
 o AS (SELECT artifact_sha256 AS sha256, count(*) AS n_events FROM repair_events WHERE artifact_sha256 IS NOT NULL GROUP BY 1) SELECT sha256, n_events FROM o JOIN v USING (sha256)""")
def artifact_objects(spark, d):
    """Artifacts named by events of any kind but validations, and as evidence by validations."""
    ev = table(spark, d, "repair_events")
    evidence = ev.where("event_type = 'validation'").select(F.explode(F.array("artifact_sha256", F.get_json_object("payload_json", "$.evidence"))).alias("evidence_sha256"))
    store = ev.where("artifact_sha256 is not null").groupBy(F.col("artifact_sha256").alias("sha256")).agg(F.count("*").alias("n_events"))
    return episodes.artifact_objects(ev.where("event_type <> 'validation'"), evidence, store)


_PATCH = """CASE id % 8 WHEN 0 THEN '{"fields":[{"name":"' || event_type || '"}]}' WHEN 1 THEN '{"request":{"timeout_ms":' || CAST(sequence AS VARCHAR) || '00000}}' WHEN 2 THEN '{"browser":{}}' WHEN 3 THEN '{"validation":{"x":{"apiKey":1}}}'
 WHEN 4 THEN '[{"op":"replace","path":"/captures/0/selector","value":"' || event_type || '"}]' WHEN 5 THEN '[{"op":"move","from":"/fields/0","path":"/fields/1"}]' WHEN 6 THEN '{}' ELSE payload_json END"""


@query(f"""SELECT id, CASE id % 8 WHEN 0 THEN true WHEN 1 THEN sequence BETWEEN 1 AND 3 WHEN 4 THEN true ELSE false END AS allowed FROM (SELECT *, {_PATCH} AS patch FROM repair_events)""")
def patch_allowed(spark, d):
    p = table(spark, d, "repair_events").select("id", F.expr(_PATCH.replace("VARCHAR", "STRING")).alias("patch"))
    return p.select("id", patches.patch_fault(F.col("patch")).isNull().alias("allowed"))


@query("""SELECT id, '{"fields":[' || CAST(sequence AS VARCHAR) || '],"name":"' || event_type || '","request":{"timeout_ms":' || CAST(1 + id % 9 AS VARCHAR) || ',"wait_until":"load"}}' AS plan FROM repair_events""")
def patch_applied(spark, d):
    plan = F.expr("""'{"name":"' || event_type || '","fields":[0],"request":{"wait_until":"load","timeout_ms":10}}'""")
    patch = F.expr("""'{"fields":[' || cast(sequence as string) || '],"request":{"timeout_ms":' || cast(1 + id % 9 as string) || '}}'""")
    return table(spark, d, "repair_events").select("id", patches.patched(plan, patch).alias("plan"))


@query("""SELECT p.id, CASE WHEN e.id IS NULL THEN 'no such episode' END AS fault FROM repair_events p LEFT JOIN (SELECT id FROM repair_episodes WHERE status = 'open') e ON e.id = p.episode_id""")
def repair_proposals(spark, d):
    made = table(spark, d, "repair_events").select("id", "episode_id", F.lit('{"fields":[1]}').alias("patch"))
    return patches.proposals(made, table(spark, d, "repair_episodes").where("status = 'open'"), "episode_id", "patch").select("id", "fault")


@query(f"""WITH {PAGES}, t AS (SELECT row_id, list_transform(regexp_extract_all(html, '(?is)<li class="item">(.*?)</li>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'gs'), '{_BLANKS}', ' ', 'g'))) AS l FROM pages) SELECT row_id, array_to_string(list_filter(l, lambda x: x <> ''), ' ') AS items FROM t""")
def select_all_text(spark, d):
    return _pages(spark, d).select("row_id", markup.select_all_text(F.col("html"), "li.item").alias("items"))


@query("""SELECT id, coalesce(json_extract_string(payload_json, '$.stage'), '') AS named, coalesce(json_extract_string(payload_json, '$.stage'), '') AS fallen_back, id % 3 || '' AS own FROM repair_events""")
def context_paths(spark, d):
    e = table(spark, d, "repair_events").select("id", X.parse_json(F.col("payload_json")).alias("p"), X.parse_json(F.concat(F.lit('{"n":"'), (F.col("id") % 3).cast("string"), F.lit('"}'))).alias("m"))
    context = {"body": F.col("p"), "meta": F.col("m")}
    read = lambda path: cascade.read_context(path, context, "body")
    return e.select("id", read("payload.stage").alias("named"), read("stage").alias("fallen_back"), read("meta.n").alias("own"))


# ---------------------------------------------------------------- extensions: not in the reference


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def ext_rollup(spark, d):
    line = table(spark, d, "lineitem")
    return line.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, sum(l_quantity) AS sum_qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def ext_star_join(spark, d):
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))  # before the join, on its key
    joined = line.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.sum("q").alias("sum_qty"))


@query("""SELECT e.event_id, max(p.event_id) AS before_id FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) < (e.ts, e.event_id) AND NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND (q.ts, q.event_id) < (e.ts, e.event_id) AND (q.ts, q.event_id) > (p.ts, p.event_id)) GROUP BY 1""")
def ext_asof(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("before_id"))
