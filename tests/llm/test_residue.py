from __future__ import annotations

import pytest

from loomstone.llm import residue as R

RESIDUE = {
    "placeholder": ["{{title}}", "城市旧书 {{{name}}} 指南", "${brand} 杯", "#{规格}", "<%= name %>", "{% title %}", "%%h1%% x", "%(title)s", "__item_title__ 台灯", "@@品牌@@", "[[name]]", "[标题未填写]", ":title:placeholder", "&lt;品牌&gt; 杯", "<page.title>", "{品牌} 岫朗", "{{标题", "%s - %s"],
    "mistake": ["null", "undefined undefined", "NaN | Marlow Depot", "(null)", "[object HTMLElement]", "None", "function () { [native code] }"],
    "filler": ["Lorem ipsum dolor sit amet", "ut labore et dolore", "test test 3", "标题标题标题标题", "Your title here-4", "占位文字 待替换", "Texto de relleno", "Blindtext für die Vorschau", "请输入商品标题(最多60字)"],
    "scripts": ["Please enable JavaScript to continue", "请开启JavaScript后继续访问", "您的浏览器不支持JavaScript 页面无法显示", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen", "Merci d'activer les scripts", "Esta página requiere que los scripts estén habilitados", "Please allow scrip..."],
    "error": ["404 Page not found", "Access denied", "503 访问过于频繁 请完成验证 · Marlow Depot", "La page est introuvable. Retour à l'accueil", "页面不存在 (Error 404)", "Der Server existiert nicht mehr | Laden", "Just a moment", "登录已过期 请重新登录", "Página no encontrada", "The link you followed was not found on this server"],
}
CONTENT = [
    "The history of lorem ipsum", "Undefined behaviour in C, chapter 3", "Enabling JavaScript in embedded browsers: three options compared", "How to fix a 404 page: a field guide", "Null Island: a travelogue, part 2", "Not Found Gallery opens its spring show",
    "Error budgets explained for small teams", "Fehler 404 verstehen: Teil 2", "为什么页面会返回 404 - 运维笔记 3", "占位图设计史 第9讲", "Template engines compared: {{ }} or <% %>?", "JavaScript 从入门到实践 第6版 图书", "Python Django 模板语法 手册", "月书墨 模板 尺子 {圆形} 绘图",
    "麦米门 404 号色 哑光口红", "loading 图案马克杯", "Lorem Ipsum 排版海报 青笔鼓 43x90cm", "请勿打扰 门挂牌 东白林", "验证码 T恤 黑色", "程序员 Hello World {} 徽章", "Service level report, week 30", "use `{{name}}` in Jinja templates", "", " ", None,
    "our product is available", "The store is available", "Unser Akku ist nicht wasserdicht", "Notre lampe n'est pas chère", "Cargando bateria solar", "Merci d'avoir choisi notre lampe", "Sorry, the product ships late",
    "Diese Lampe ist nicht dimmbar", "La lampe n'est pas étanche", "El cargador no está incluido", "Chargement solaire rapide",
]


@pytest.mark.parametrize("kind", sorted(RESIDUE))
def test_residue(spark, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(RESIDUE[kind])], "k long, t string")
    got = {r.text: r.kind for r in R.find(df, "k", "t").collect()}
    assert {t: got.get(t) for t in RESIDUE[kind]} == dict.fromkeys(RESIDUE[kind], kind)


def test_content(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CONTENT)], "k long, t string")
    assert R.find(df, "k", "t").collect() == []


def test_edges(spark):
    df = spark.createDataFrame([(1, "a " * 50_000), (2, "x" * 50_000 + " {{title}}"), (3, "null"), (3, "null")], "k long, t string").selectExpr("k", "t", "t as text", "k as kind")
    got = sorted((r.k, r.kind) for r in R.find(df, "k", "t").collect())
    assert got == [(2, "placeholder"), (3, "mistake"), (3, "mistake")]
    assert R.find(df.limit(0), "k", "t").collect() == []


def test_every_scripts_notice_passes_the_hint(spark):
    notices = ["开启JS后继续", "Activa tu navegador", "Enable cookies and reload", "Veuillez autoriser les scri...", "Habilite las secuencias de comandos en su navegador", "请启用js后继续", "本站需要启用js", "CE SITE NÉCESSITE LES SCRIPTS"]
    df = spark.createDataFrame(list(enumerate(notices)), "k long, t string")
    assert {r.text: r.kind for r in R.find(df, "k", "t").collect()} == dict.fromkeys(notices, "scripts")
