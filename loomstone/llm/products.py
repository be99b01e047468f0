"""Listings of different sellers that offer the same product.

Titles and sku names are reduced to normalised tokens. Size, colour and number of pieces have to be equal, whatever the
wording, so they are read by tables of units and colours and become a key of the class. All other words of a title are
tokens, codes of letters and digits in one spelling, and what each is worth is counted over the whole column:

* *information*: how much likelier two listings that share the token also share their code (``WH-1000XM5``) than any
  two listings, as a logarithm. Advertising comes out near nothing, a brand near the logarithm of the number of brands.
* *steadiness*: how often the token of one listing stands in another listing of the same code too. Words that sellers
  choose freely among several come out low.

The weight of a token is the product of the two. The distinct token sets go through a weighted set-similarity join:
tokens ordered by rarity, prefix, length and positional filters, exact weighted containment. Stars follow: a set that no
fuller one contains is a centre, any other joins the centre that contains it. No list of brands, goods or advertising
words is used.

Only distinct sets enter the join, so copies, however many, weigh nothing. Pairs of a class are written only where
the result is defined as pairs; classes that are hot are salted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import lookalikes, residue
from loomstone.session import cut_lineage, once

# Colour words of one meaning, by group; a shade is a group of its own.
COLOURS = (
    "黑 黑色 纯黑 纯黑色 black",
    "白 白色 纯白 纯白色 white",
    "红 红色 大红 大红色 red",
    "粉 粉色 粉红 粉红色 pink",
    "灰 灰色 grey gray",
    "紫 紫色 purple violet",
    "绿 绿色 green",
    "蓝 蓝色 blue",
    "黄 黄色 yellow",
    "橙 橙色 橘色 orange",
    "棕 棕色 褐色 brown",
    "金 金色 gold golden",
    "银 银色 silver",
    "青 青色 cyan",
    "深灰 深灰色 dark_grey dark_gray",
    "浅灰 浅灰色 light_grey light_gray",
    "米白 米白色 off_white creamy_white ivory_white",
    "酒红 酒红色 wine_red burgundy",
    "玫红 玫红色 rose_red",
    "天蓝 天蓝色 sky_blue",
    "深蓝 深蓝色 dark_blue",
    "浅蓝 浅蓝色 light_blue",
    "藏青 藏青色 藏蓝 藏蓝色 navy navy_blue",
    "墨绿 墨绿色 dark_green",
    "军绿 军绿色 army_green",
    "米色 米黄 米黄色 beige",
    "透明 透明色 transparent clear",
)
# Units of size, the kind of size and the factor to its base unit.
UNITS = {
    "mg": ("g", "0.001"), "g": ("g", "1"), "克": ("g", "1"), "kg": ("g", "1000"), "公斤": ("g", "1000"), "千克": ("g", "1000"), "斤": ("g", "500"), "两": ("g", "50"),
    "ml": ("ml", "1"), "毫升": ("ml", "1"), "l": ("ml", "1000"), "升": ("ml", "1000"),
    "mm": ("mm", "1"), "毫米": ("mm", "1"), "cm": ("mm", "10"), "厘米": ("mm", "10"), "m": ("mm", "1000"), "米": ("mm", "1000"),
    "w": ("w", "1"), "瓦": ("w", "1"), "kw": ("w", "1000"), "千瓦": ("w", "1000"),
    "mah": ("mah", "1"), "毫安": ("mah", "1"), "毫安时": ("mah", "1"), "ah": ("mah", "1000"), "安时": ("mah", "1000"), "万毫安": ("mah", "10000"), "万毫安时": ("mah", "10000"),
    "mb": ("mb", "1"), "gb": ("mb", "1024"), "tb": ("mb", "1048576"),
    "英寸": ("inch", "1"), "寸": ("inch", "1"), "inch": ("inch", "1"), "码": ("eu", "1"),
}
# Words that relate an accessory to a product.
RELATION = frozenset("兼容 适配 适用 适用于 通用 配件 for fits compatible accessory".split())
# Endings that make another product of a series or model.
SUFFIX = frozenset("pro max lite plus mini ultra".split())
# First halves of two-word colours.
SHADES = frozenset("sky dark light wine rose off creamy ivory navy army".split())
DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九十")} | {"单": 1, "两": 2, "双": 2}

_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
_SIZE = re.compile(rf"(?<![A-Za-z0-9.])(\d+(?:\.\d+)?) ?(?:({_UNIT})(?![A-Za-z]))", re.I)
_PIECES = re.compile(r"(?<![A-Za-z0-9.])(?:[x*×] ?(\d{1,4})(?![\d.]|\s?[A-Za-z%])|(\d{1,4}|[单两双一二三四五六七八九十]{1,3}) ?(?:件套|件组合|件装|个装|只装|条装|包装|瓶装|盒装|支装|片装|套装|pcs|pieces|pack|件|只|个)(?![A-Za-z]))", re.I)
#: A word of letters and a number beside it, one code in any of its spellings.
_CODE_PARTS = re.compile(rf"(?<![a-z0-9])(?!(?:{'|'.join(sorted(SUFFIX))})[- ]?\d)([a-z]{{2,}})[- ](\d+[a-z0-9]*)(?![\d.\-a-z一-鿿])")
_CODE = re.compile(r"(?=.*[a-z])(?=.*\d)[a-z\d.\-]+")
#: Two spellings of a name side by side, one in Han characters and one in Latin letters.
_ALIAS = re.compile(r"(?<![一-鿿])([一-鿿]{2,6})[/(]([A-Za-zÀ-ɏ]{2,})(?![A-Za-zÀ-ɏ])\)?|(?<![A-Za-zÀ-ɏ])([A-Za-zÀ-ɏ]{2,})[/(]([一-鿿]{2,6})(?![一-鿿])\)?")
_WORD = re.compile(r"[^\s【】\[\]{}()（）「」《》<>,;，；、|/+*#!?！？:：\"'~·•_=&@]+")
_HAN_OR_DIGIT = re.compile(r"[一-鿿\d]")


def number(text: str) -> int:
    """A text as a signed number of 64 bits. Tokens, names and sellers are compared by it, which is all they are for."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Reader:
    """Titles and sku names to normalised tokens, remembering words and the parts of sku names."""

    def __init__(self) -> None:
        self.colours = {w: g.split()[0] for g in COLOURS for w in g.split()}
        self.skus: dict[str, tuple[str, str, str]] = {}
        self.titles: dict[str, tuple | None] = {}
        self.numbers: dict[str, int] = {}
        self.sizes: dict[tuple[str, str], str] = {}

    def number(self, word: str) -> int:
        known = self.numbers.get(word)
        if known is None:
            if len(self.numbers) > 100_000:
                self.numbers.clear()
            known = self.numbers[word] = number(word)
        return known

    @staticmethod
    def size(number: str, written: str) -> str:
        """The kind of a size and its value in the base unit."""
        unit = written.lower()
        if written == "G" and number.isdigit() and int(number) >= 8 and int(number).bit_count() == 1:
            unit = "gb"  # capacities of memories are powers of two
        kind, factor = UNITS[unit]
        return f"{kind}:{(Decimal(number) * Decimal(factor)).normalize():f}"

    def measures(self, text: str) -> tuple[str, str, str]:
        """Sizes and pieces, empty where the text names none, and the text without them."""
        sizes, pieces = [], ""
        for written in _SIZE.findall(text):
            if (size := self.sizes.get(written)) is None:
                if len(self.sizes) > 20_000:
                    self.sizes.clear()
                size = self.sizes[written] = self.size(*written)
            sizes.append(size)
        if sizes:
            text = _SIZE.sub(" ", text)
        if m := _PIECES.search(text):
            raw = m[1] or m[2]
            number = int(raw) if raw.isdigit() else (DIGITS.get(raw) if len(raw) == 1 else DIGITS.get(raw[-1], 0) + 10 if raw[0] == "十" else None)
            pieces = str(number) if number else ""
            text = text[: m.start()] + " " + text[m.end() :]
        return "+".join(sorted(set(sizes))), pieces, text

    def words(self, text: str) -> tuple[list[str], str]:
        """The words of a lower-case text without those of colour, and the first colour."""
        words, colour, found = [], "", _WORD.findall(text)
        skip = False
        for i, word in enumerate(found):
            if skip:
                skip = False
                continue
            if word in SHADES and i + 1 < len(found) and (shade := self.colours.get(f"{word}_{found[i + 1]}")):
                colour, skip = colour or shade, True
            elif plain := self.colours.get(word):
                colour = colour or plain
            elif word in SUFFIX and words and _HAN_OR_DIGIT.search(words[-1]):
                words[-1] += word
            else:
                words.append(word)
        return words, colour

    def sku(self, text: str) -> tuple[str, str, str]:
        """Size, colour and pieces named in a sku."""
        known = self.skus.get(text)
        if known is None:
            if len(self.skus) > 20_000:
                self.skus.clear()
            size, pieces, rest = self.measures(text)
            known = self.skus[text] = (size, self.words(rest.lower())[1], pieces)
        return known

    def title(self, text: str) -> tuple | None:
        """``(tokens, code, Han name, Latin name, size, colour, pieces)``, null for accessories and titles without words."""
        size, pieces, rest = self.measures(text)
        han = latin = code = None
        if ("/" in rest or "(" in rest) and (m := _ALIAS.search(rest)):
            han, latin = (m[1], m[2].lower()) if m[1] else (m[4], m[3].lower())
            rest = f"{rest[: m.start()]} {latin} {rest[m.end() :]}"
        words, colour = self.words(_CODE_PARTS.sub(r"\1\2", rest.lower()))
        tokens, length = {}, 0
        for word in words:
            if word in RELATION:
                return None
            if not word.isalnum():
                if _CODE.fullmatch(word):
                    word = word.replace("-", "")
                elif not (word := word.strip("-.—–")):
                    continue
            tokens[word] = None
            if len(word) > length and word.isascii() and not word.isalpha() and _CODE.fullmatch(word):
                code, length = word, len(word)
        return (tokens, code, han, latin, size, colour, pieces) if tokens else None

    def numbered(self, title: str | None, sku: str | None) -> tuple | None:
        """``(tokens, id of the token set, code, Han name, Latin name, specs)`` in numbers, or null."""
        if not title:
            return None
        if (known := self.titles.get(title, 0)) == 0:
            if len(self.titles) > 20_000:
                self.titles.clear()
            if (known := self.title(title)) is not None:
                tokens, code, han, latin, *specs = known
                words = [None if x is None else self.number(x) for x in (code, han, latin)]
                known = ([self.number(t) for t in tokens], number("\x1f".join(sorted(tokens))), *words), specs
            self.titles[title] = known
        if known is None:
            return None
        read, (size, colour, pieces) = known
        if sku:
            own = self.sku(sku)
            size, colour, pieces = own[0] or size, own[1] or colour, own[2] or pieces
        return *read, self.number(f"{size}\x1f{colour}\x1f{pieces or 1}")


def offers(df: DataFrame, key: str, title: str, sku: str, seller: str, arrived: str) -> DataFrame:
    """``_key``, ``_seller``, ``_row`` (what makes rows equal), ``list_id``, ``tokens``, ``code``, ``han``, ``latin`` and
    ``specs`` of each row that may offer a product, all but the key in numbers of 64 bits.

    Left out are rows with a null seller, blank titles and titles with template residue, and accessories.
    """
    rest = [F.col(f"`{c}`").cast("string") for c in df.columns if c not in (key, arrived)]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in rest])
    rows = df.where(F.col(seller).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(F.col(seller)).alias("_seller"), F.array(F.xxhash64(nulls, *rest), F.xxhash64(F.lit(1), *rest)).alias("_row"), F.col(title).alias("_title"), F.col(sku).alias("_sku"))
    plan = lookalikes.Canonical.plan()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, canonical = Reader(), lookalikes.Canonical(*plan)
        for batch in batches:
            titles, skus = (canonical(batch[c].to_pylist()) for c in ("_title", "_sku"))
            found = [reader.numbered(a, b) for a, b in zip(titles, skus)]
            keep = [i for i, x in enumerate(found) if x]
            if not keep:
                continue
            tokens, *numbers = zip(*(found[i] for i in keep))
            kept = batch.select(["_key", "_seller", "_row"]).take(pa.array(keep))
            made = [pa.array([titles[i] for i in keep], pa.string()), pa.array(tokens, pa.list_(pa.int64())), *(pa.array(v, pa.int64()) for v in numbers)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], ["_key", "_seller", "_row", "_title_canonical", "tokens", "list_id", "code", "han", "latin", "specs"])

    kind = dict(df.dtypes)[key]
    schema = f"_key {kind}, _seller long, _row array<long>, _title_canonical string, tokens array<long>, list_id long, code long, han long, latin long, specs long"
    read_rows = rows.mapInArrow(read, schema)
    title = F.col("_title_canonical")
    read_rows = once(read_rows, {"_parts": F.when(F.col("code").isNull(), residue.parts(title))}, read_rows.columns)
    # A title with a code is no message; what may be missing in it is a placeholder's value.
    content = F.when(F.col("code").isNotNull(), ~residue.has_placeholder(title)).otherwise(residue.residue_kind(title, F.col("_parts")).isNull())
    return read_rows.where(content).drop("_title_canonical", "_parts")


def first_delivered(rows: DataFrame) -> DataFrame:
    """Of rows of :func:`offers` that are equal in all but key and arrival only the one of the lowest key."""
    same = [F.col("_row")[i].alias(f"_row{i}") for i in (0, 1)]
    return rows.groupBy(*same).agg(*[F.min(c).alias(c) for c in ("_key", "_seller", "specs", "list_id")]).drop("_row0", "_row1")


def spellings(rows: DataFrame) -> DataFrame:
    """``han`` and ``_latin``, the Latin spelling most often written beside each Han name."""
    beside = rows.where("han is not null").groupBy("han", "latin").count()
    return beside.groupBy("han").agg(F.max_by("latin", F.struct("count", "latin")).alias("_latin"))


def lists(rows: DataFrame) -> DataFrame:
    """The distinct token lists of ``rows``: ``list_id``, ``tokens``, ``code``. A title that stands over several skus
    counts once."""
    return rows.groupBy("list_id").agg(F.first("tokens").alias("tokens"), F.first("code").alias("code"))


def weights(lists: DataFrame, names: DataFrame, prior: float = 8.0) -> DataFrame:
    """What each token of ``lists`` (``tokens``, ``code``) is worth, counted over all of them.

    Gives ``token``, ``plain`` (its spelling in the sets), ``df`` (lists that hold it), ``info`` (nats), ``w``
    (information times steadiness in thousandths, whole so that sums are exact), ``is_name`` (one of ``names``) and
    ``needed``, the information that singles out one product. Where no two lists share a code, information is
    ``ln(lists / df)``. Information starts from two pairs of lists, steadiness
    from ``prior``, of which half agree. Han names of ``names`` come as tokens with the values of their Latin spelling.
    """
    # A list holds its code once, so the lists of a code are counted before they are taken apart; lists without a code
    # are dealt out by their tokens.
    sized = lists.select("tokens", "code", F.coalesce("code", F.xxhash64("tokens")).alias("_key"))
    sized = sized.withColumn("_size", F.count("code").over(Window.partitionBy("_key"))).withColumn("_size", F.when(F.col("code").isNotNull(), F.col("_size")))
    flat = sized.select("_key", "code", "_size", F.explode("tokens").alias("token")).join(names, F.col("token") == F.col("han"), "left")
    counts = flat.groupBy("_key", F.coalesce("_latin", "token").alias("token"), "code", "_size").agg(F.count("*").alias("n"))
    sizes = lists.where("code is not null").groupBy("code").agg(F.count("*").alias("_size"))
    n, size = F.col("n"), F.col("_size")
    each = counts.groupBy("token").agg(
        F.sum("n").alias("df"), F.sum(F.when(size.isNotNull(), n)).alias("_coded"), F.sum(F.when(size.isNotNull(), n * (n - 1))).alias("_same"), F.sum(n * (size - 1)).alias("_possible"),
        F.max(F.col("token") == F.col("code")).alias("_is_code"),
    )
    whole = lists.agg(F.count("*").alias("_all"), F.count("code").alias("_all_coded")).crossJoin(sizes.agg(F.sum(size * (size - 1)).alias("_all_same")))
    each = each.crossJoin(F.broadcast(whole))  # one row
    coded, same = F.coalesce("_coded", F.lit(0)), F.coalesce("_same", F.lit(0))
    rarity = F.log(F.col("_all") / F.col("df"))
    chance = F.col("_all_same") / (F.col("_all_coded") * (F.col("_all_coded") - 1))
    known = F.col("_all_same") > 0
    shared = F.when(F.coalesce("_is_code", F.lit(False)), 1.0).otherwise((same + 1) / (coded * (coded - 1) + 2))
    info = F.when(known, F.least(rarity, F.log(shared / chance))).otherwise(rarity)
    steady = F.when(F.coalesce("_is_code", F.lit(False)), 1.0).otherwise((same + prior / 2) / (F.coalesce("_possible", F.lit(0)) + prior))
    made = each.select("token", "df", F.greatest(F.lit(0.0), info).alias("info"), steady.alias("_steady"), F.when(known, -F.log(chance)).otherwise(F.log("_all")).alias("needed"))
    made = made.select("token", "df", "info", F.round(1000 * F.col("info") * F.col("_steady")).cast("long").alias("w"), "needed")
    latin = names.groupBy(F.col("_latin").alias("token")).agg(F.collect_list("han").alias("_han"))  # the few spellings of one name
    values = ["df", "info", "w", F.col("_han").isNotNull().alias("is_name"), "needed"]
    spelled = made.join(latin, "token", "left").select(F.explode(F.concat(F.array("token"), F.coalesce("_han", F.array().cast("array<long>")))).alias("spelled"), F.col("token").alias("plain"), *values)
    return spelled.withColumnRenamed("spelled", "token")


def _weight(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda sum_, t: sum_ + t["w"])


def token_sets(lists: DataFrame, worth: DataFrame, least: int = 300) -> DataFrame:
    """``list_id``, ``set_id`` and ``_set`` of the lists whose tokens single out a product.

    ``_set`` holds ``df``, ``token``, ``w`` and ``is_name`` of the tokens worth at least ``least``, the rarest first.
    """
    flat = lists.select("list_id", F.explode("tokens").alias("token")).join(worth.where(F.col("w") >= least), "token")
    tokens = F.sort_array(F.collect_set(F.struct("df", F.col("plain").alias("token"), "w", "is_name", "info")))
    sets = flat.groupBy("list_id").agg(tokens.alias("_set"), F.first("needed").alias("needed"))
    sets = sets.where(F.aggregate("_set", F.lit(0.0), lambda sum_, t: sum_ + t["info"]) >= F.col("needed"))
    return sets.select("list_id", F.xxhash64(F.col("_set")["token"]).alias("set_id"), F.transform("_set", lambda t: t.dropFields("info")).alias("_set"))


def placed(sets: DataFrame) -> DataFrame:
    """``sets`` with ``_w``, the weight of each set, and the weight ``before`` and ``after`` each of its tokens."""
    sets = sets.withColumn("_w", _weight(F.col("_set")))
    before = F.transform("_set", lambda t, i: t.withField("before", _weight(F.slice("_set", F.lit(1), i))))
    return sets.withColumn("_set", F.transform(before, lambda t: t.withField("after", F.col("_w") - t["before"] - t["w"])))


def contained(sets: DataFrame, threshold: float) -> DataFrame:
    """``a_id``, ``b_id``, ``a_n``, ``b_n`` and ``held``: each set and every fuller one that holds at least ``threshold``
    of its weight and all of its names.

    ``sets`` holds ``set_id``, ``n`` and the columns of :func:`placed`. Fuller is heavier, of equal weight the greater
    id. A pair is met once, at the rarest token its sets share.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    a, b = (sets.select(F.col("set_id").alias(f"{p}_id"), F.col("n").alias(f"{p}_n"), F.col("_w").alias(f"{p}_w"), F.col("_set")["token"].alias(f"{p}_tokens"), F.col("_set").alias(f"{p}_set")) for p in "ab")
    least = F.broadcast(sets.agg(F.min("_w").alias("_least")))  # one row
    part = lambda p: F.inline(F.transform(f"{p}_set", lambda t: F.struct(t["token"].alias("token"), t["w"].alias(f"_w{p}"), t["before"].alias(f"_before{p}"), t["after"].alias(f"_after{p}"))))
    # Prefix: the rarest shared token is one from which on there is weight enough.
    left = a.select("*", part("a")).where(F.col("a_w") - F.col("_beforea") >= threshold * F.col("a_w")).drop("_beforea")
    right = b.crossJoin(least).select("*", part("b")).where(F.col("b_w") - F.col("_beforeb") >= threshold * F.col("_least")).drop("_wb", "_beforeb", "_least", "b_set")
    enough = threshold * F.col("a_w")
    fuller = (F.col("b_w") > F.col("a_w")) | ((F.col("b_w") == F.col("a_w")) & (F.col("b_id") > F.col("a_id")))  # length
    met = left.join(right, "token").where(fuller & (F.col("_wa") + F.least("_aftera", "_afterb") >= enough))  # position
    met = met.where(F.get(F.array_intersect("a_tokens", "b_tokens"), F.lit(0)) == F.col("token"))
    lost = F.filter("a_set", lambda t: ~F.array_contains("b_tokens", t["token"]))
    ends = ["a_id", "b_id", "a_n", "b_n", "a_w"]
    met = once(met, {"_lost": lost}, ends)
    met = once(met, {"_common": F.col("a_w") - _weight(F.col("_lost")), "_nameless": F.exists("_lost", lambda t: t["is_name"])}, ends)
    met = met.where((F.col("_common") >= enough) & ~F.col("_nameless"))
    return met.select("a_id", "b_id", "a_n", "b_n", (F.col("_common") / F.col("a_w")).alias("held"))


def stars(sets: DataFrame, links: DataFrame, lead: float = 0.8) -> DataFrame:
    """``set_id`` and ``product``, the centre it belongs to.

    ``links`` are those of :func:`contained`. Sets without a fuller one are centres. A set joins the centre that holds
    it, where several do the one with at least ``lead`` of their listings; sets that fit several centres alike (a
    series of several models) form stars of their own.
    """
    held = links.select(F.col("a_id").alias("set_id")).distinct()  # all but the centres
    votes = links.join(held, F.col("b_id") == F.col("set_id"), "left_anti")
    best = votes.groupBy("a_id").agg(F.max_by("b_id", F.struct("b_n", "held", "b_id")).alias("b_id"), F.max("b_n").alias("_top"), F.sum("b_n").alias("_all"))
    joined = best.where(F.col("_top") >= lead * F.col("_all")).select(F.col("a_id").alias("set_id"), F.col("b_id").alias("product"))
    rest = held.join(joined, "set_id", "left_anti")
    among = links.join(rest, F.col("a_id") == F.col("set_id"), "left_semi").join(rest, F.col("b_id") == F.col("set_id"), "left_semi")
    own = among.groupBy(F.col("a_id").alias("set_id")).agg(F.max_by("b_id", F.struct("held", "b_n", "b_id")).alias("product"))
    return sets.select("set_id").join(joined.unionByName(own), "set_id", "left").select("set_id", F.coalesce("product", "set_id").alias("product"))


def classes(df: DataFrame, key: str, title: str, sku: str, seller: str, arrived: str, threshold: float = 0.75) -> DataFrame:
    """``_key``, ``_seller`` and ``class_id`` (product, size, colour and pieces) of every row that offers a product.

    Rows that name no size, colour or pieces form classes with others that name none; no number of pieces means one.
    """
    read = cut_lineage(offers(df, key, title, sku, seller, arrived))
    distinct = cut_lineage(lists(read))
    members = cut_lineage(token_sets(distinct, weights(distinct, spellings(read))))
    sets = cut_lineage(placed(members.groupBy("set_id").agg(F.first("_set").alias("_set"), F.count("*").alias("n"))))
    product = members.select("list_id", "set_id").join(stars(sets, cut_lineage(contained(sets, threshold))), "set_id")
    found = first_delivered(read).join(product.select("list_id", "product"), "list_id")
    return cut_lineage(found.select("_key", "_seller", F.xxhash64("product", "specs").alias("class_id")))


def pairs(members: DataFrame, hot: int = 1000) -> DataFrame:
    """``row_a`` < ``row_b`` of one class with different sellers.

    Rows of a class and seller are gathered in lists of about ``hot`` first, so that rows of one seller are never laid
    against each other; classes of more than ``hot`` such lists are salted. Classes of one seller drop out.
    """
    own = members.groupBy("class_id", "_seller").agg(F.count("*").alias("_n"))
    several = own.groupBy("class_id").agg(F.count("*").alias("_sellers"), F.sum(F.ceil(F.col("_n") / hot)).alias("_lists")).where("_sellers > 1")
    sized = own.where(F.col("_n") > hot).select("class_id", "_seller", F.ceil(F.col("_n") / hot).alias("_of"))
    rows = members.join(several.select("class_id", F.ceil(F.col("_lists") / hot).cast("int").alias("_parts")), "class_id").join(sized, ["class_id", "_seller"], "left")
    piece = F.pmod(F.hash("_key"), F.coalesce("_of", F.lit(1)))
    gathered = rows.groupBy("class_id", "_seller", piece.alias("_piece")).agg(F.collect_list("_key").alias("_keys"), F.first("_parts").alias("_parts"))
    left = gathered.select("class_id", F.col("_keys").alias("_a"), F.col("_seller").alias("_sa"), F.pmod(F.hash("_seller", "_piece"), F.col("_parts")).alias("_part"))
    right = gathered.select("class_id", F.col("_keys").alias("_b"), F.col("_seller").alias("_sb"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    met = left.join(right, ["class_id", "_part"]).where("_sa < _sb").select(F.explode("_a").alias("_a"), "_b").select("_a", F.explode("_b").alias("_b"))
    return met.select(F.least("_a", "_b").alias("row_a"), F.greatest("_a", "_b").alias("row_b"))


def links(members: DataFrame) -> DataFrame:
    """One row per listing: ``_key``, ``class_id`` and ``n_links``, the listings of other sellers in its class."""
    own = members.groupBy("class_id", "_seller").agg(F.count("*").alias("_own"))
    whole = own.groupBy("class_id").agg(F.sum("_own").alias("_all"))
    counted = own.join(whole, "class_id").select("class_id", "_seller", (F.col("_all") - F.col("_own")).alias("n_links"))
    return members.join(counted, ["class_id", "_seller"]).select("_key", F.lower(F.lpad(F.hex("class_id"), 16, "0")).alias("class_id"), "n_links")
