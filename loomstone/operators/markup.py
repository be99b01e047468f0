"""Values from markup: simple selectors as JVM expressions, the full selector grammar as one Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import collapse, strip

_SIMPLE = re.compile(r"^([a-zA-Z][\w-]*)?(?:\.([\w-]+)|\[([\w-]+)=['\"]?([^'\"\]]*)['\"]?\])?$")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _opening(selector: str) -> tuple[str, str] | None:
    """A pattern of the opening tag and the tag's name, for ``tag``, ``.class``, ``tag.class`` and ``tag[attr=v]``."""
    m = _SIMPLE.match(selector.strip())
    if not m or not any(m.groups()):
        return None
    tag = m[1] or r"[a-zA-Z][\w-]*"
    if m[2]:
        return rf"<({tag})\b(?=[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{re.escape(m[2])}(?:\s[^\"']*)?[\"'])[^>]*>", tag
    if m[3]:
        return rf"<({tag})\b(?=[^>]*\b{re.escape(m[3])}\s*=\s*[\"']{re.escape(m[4])}[\"'])[^>]*>", tag
    return rf"<({tag})\b[^>]*>", tag


def select_first(html: Column, selector: str, attr: str | None = None) -> Column:
    """Text (or attribute) of the first element a simple selector meets, stripped; ``''`` for none and for null.

    Runs in the JVM. Elements of the same name inside the element end it early; use :func:`select` for those.
    """
    opening = _opening(selector)
    if opening is None:
        raise ValueError(f"not a simple selector: {selector!r}")
    if attr:
        tag = F.regexp_extract(html, "(?is)(" + opening[0] + ")", 1)
        value = F.regexp_extract(tag, rf"(?is)\s{re.escape(attr)}\s*=\s*[\"']([^\"']*)[\"']", 1)
        return F.coalesce(strip(value), F.lit(""))
    inner = F.regexp_extract(html, "(?is)" + opening[0] + r"(.*?)</\1\s*>", 2)
    return F.coalesce(collapse(F.regexp_replace(inner, r"(?s)<[^>]+>", " ")), F.lit(""))


def select_items(html: Column, selector: str) -> Column:
    """The elements a simple selector meets, as an array of markup in document order."""
    opening = _opening(selector)
    if opening is None:
        raise ValueError(f"not a simple selector: {selector!r}")
    return F.regexp_extract_all(html, F.lit("(?is)(" + opening[0] + r".*?</\2\s*>)"), 1)


def select_all_text(html: Column, selector: str) -> Column:
    """Stripped texts of all elements a simple selector meets, without empty ones, joined by a blank; ``''`` for none."""
    texts = F.transform(select_items(html, selector), lambda item: collapse(F.regexp_replace(item, r"(?s)<[^>]+>", " ")))
    return F.coalesce(F.array_join(F.filter(texts, lambda t: t != ""), " "), F.lit(""))


def _plain(html: Column) -> Column:
    """Markup without comments and without the bodies of scripts and styles."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")


def tags(html: Column) -> Column:
    """Names of the opening tags in order, lower case."""
    return F.transform(F.regexp_extract_all(_plain(html), F.lit(r"<([a-zA-Z][a-zA-Z0-9-]*)\b[^>]*>"), 1), F.lower)


def depth(html: Column) -> Column:
    """Greatest nesting: opening tags go deeper, closing tags come back, never above the top."""
    marks = F.regexp_extract_all(_plain(html), F.lit(r"<(/?[a-zA-Z][^>]*)>"), 1)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(state: Column, mark: Column) -> Column:
        change = F.when(mark.startswith("/"), -1).when(mark.endswith("/"), 0).otherwise(1)
        now = F.greatest(F.lit(0), state["now"] + change)
        return F.struct(now.alias("now"), F.greatest(state["top"], now).alias("top"))

    return F.aggregate(marks, start, step)["top"]


def attribute_names(html: Column) -> Column:
    """Names of the attributes of all opening tags in order, lower case."""
    opened = F.regexp_extract_all(_plain(html), F.lit(r"<[a-zA-Z][a-zA-Z0-9-]*\b([^>]*)>"), 1)
    names = F.transform(opened, lambda x: F.regexp_extract_all(x, F.lit(r"(?:^|\s)([a-zA-Z_:][\w:.-]*)(?=\s*=|\s|/|$)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"), 1))
    return F.transform(F.flatten(names), F.lower)


def relocate(html: Column, tag: str, attributes: Mapping[str, str], text: str, least: float = 0.4) -> Column:
    """Text of the element most like a remembered one: same tag, shared attribute values, similar text.

    Likeness is the mean of the share of remembered attributes found again and of the likeness of the texts (one less
    the edit distance over the longer length); ``''`` where none reaches ``least``, first of equals wins.
    """
    found = F.regexp_extract_all(html, F.lit(rf"(?is)(<{tag}\b[^>]*>.*?</{tag}\s*>)"), 1)

    def like(node: Column) -> Column:
        words = collapse(F.regexp_replace(node, r"(?s)<[^>]+>", " "))
        longest = F.greatest(F.length(words), F.lit(len(text)), F.lit(1))
        near = 1 - F.levenshtein(words, F.lit(text)) / longest
        head = F.regexp_extract(node, r"(?s)^(<[^>]*>)", 1)
        hits = [F.when(head.contains(f'{k}="{v}"'), 1.0).otherwise(0.0) for k, v in attributes.items()]
        kept = sum(hits[1:], hits[0]) / len(hits) if hits else F.lit(1.0)
        return F.struct(((near + kept) / 2).alias("score"), words.alias("words"))

    best = F.aggregate(F.transform(found, like), F.struct(F.lit(least).alias("score"), F.lit("").alias("words")), lambda a, x: F.when((x["score"] > a["score"]) | ((x["score"] == a["score"]) & (a["words"] == "")), x).otherwise(a))
    return F.coalesce(best["words"], F.lit(""))


class _Node:
    __slots__ = ("attrs", "children", "name", "parent", "text")

    def __init__(self, name: str, attrs: dict[str, str], parent: _Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[_Node] = []
        self.text: list[str | _Node] = []

    def words(self) -> str:
        out, todo = [], list(reversed(self.text))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.name not in ("script", "style", "noscript"):
                todo.extend(reversed(x.text))
        return " ".join("".join(out).split())

    def walk(self) -> Iterator[_Node]:
        todo = list(reversed(self.children))
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.at.text.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node: _Node | None = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.text.append(data)


_PART = re.compile(r"\s*(>|\+|~)?\s*([a-zA-Z][\w-]*|\*)?((?:#[\w-]+|\.[\w-]+|\[[^\]]*\]|:has-text\((?:'[^']*'|\"[^\"]*\")\)|:first-child|:last-child)*)")
_COND = re.compile(r"#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*['\"]?([^'\"\]]*)['\"]?)?\s*\]|:has-text\(['\"](.*?)['\"]\)|:(first-child|last-child)")


def compile_selector(selector: str) -> list[list[tuple[str, str, list[tuple]]]]:
    """Alternatives, each a chain of ``(combinator, tag, conditions)``; raises ``ValueError`` for other grammar."""
    chains = []
    for one in re.split(r",(?![^\[(]*[\])])", selector):
        chain, at, one = [], 0, one.strip()
        while at < len(one):
            m = _PART.match(one, at)
            if not m or m.end() == at or not (m[2] or m[3]):
                raise ValueError(f"selector not understood: {selector!r}")
            chain.append((m[1] or " ", m[2] or "*", [c.groups() for c in _COND.finditer(m[3] or "")]))
            at = m.end()
        if not chain:
            raise ValueError(f"selector not understood: {selector!r}")
        chains.append(chain)
    return chains


def _meets(node: _Node, tag: str, conditions: list[tuple]) -> bool:
    if tag != "*" and node.name != tag.lower():
        return False
    for id_, cls, attr, op, value, words, place in conditions:
        if id_ and node.attrs.get("id") != id_:
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None:
                return False
            good = {None: True, "=": have == value, "*=": bool(value) and value in have, "^=": bool(value) and have.startswith(value), "$=": bool(value) and have.endswith(value), "~=": value in have.split(), "|=": have == value or have.startswith(f"{value}-")}[op]
            if not good:
                return False
        if words and words not in node.words():
            return False
        if place and node.parent is not None and node.parent.children[0 if place == "first-child" else -1] is not node:
            return False
    return True


def _matches(node: _Node, chain: list[tuple[str, str, list[tuple]]]) -> bool:
    if not _meets(node, *chain[-1][1:]):
        return False
    if len(chain) == 1:
        return True
    combinator, rest = chain[-1][0], chain[:-1]
    if combinator == ">":
        return node.parent is not None and _matches(node.parent, rest)
    if combinator in "+~":
        before = node.parent.children[: node.parent.children.index(node)] if node.parent else []
        return any(_matches(b, rest) for b in (before[-1:] if combinator == "+" else before))
    up = node.parent
    while up is not None:
        if _matches(up, rest):
            return True
        up = up.parent
    return False


def parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def select(html: Column, selectors: Sequence[tuple[str, str | None]]) -> Column:
    """One value per ``(selector, attribute or null)`` pair, as an array, from a single parse of each page.

    The value is that of the first element met, ``''`` where none is met, the selector is not understood, or the page
    is null or empty.
    """
    compiled: list[tuple[list | None, str | None]] = []
    for selector, attr in selectors:
        try:
            compiled.append((compile_selector(selector), attr))
        except ValueError:
            compiled.append((None, attr))

    def run(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            values = [""] * len(compiled)
            if page:
                nodes = list(parse(page).walk())
                for i, (chains, attr) in enumerate(compiled):
                    hit = next((n for n in nodes if chains and any(_matches(n, c) for c in chains)), None)
                    if hit is not None:
                        values[i] = (hit.attrs.get(attr, "") if attr else hit.words()).strip()
            out.append(values)
        return pd.Series(out)

    return F.pandas_udf(run, "array<string>")(html)
