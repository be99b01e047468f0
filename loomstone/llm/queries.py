"""Queries of the operators on text: placeholders (2), products (3), look-alikes (5), packing (7), mixing (8), abuse (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import abuse, lookalikes, mixing, packing, products, residue
from loomstone.session import spread, table

TEXT_FIELDS = ["商品标题", "sku名称", "店铺名称"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of taobao that are not in the one consistent form."""
    return lookalikes.disguised(spread(table(spark, sf_dir, "taobao")), "row_id", TEXT_FIELDS).select("row_id", "field")


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every taobao row with its three text fields in the one consistent form."""
    return lookalikes.canonical(spread(table(spark, sf_dir, "taobao")), ["row_id"], TEXT_FIELDS)


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are wholly or partly no content, with the kind of residue."""
    shop = residue.find(spread(table(spark, sf_dir, "taobao").select("row_id", "商品标题")), "row_id", "商品标题")
    pages = residue.find(spread(table(spark, sf_dir, "approved_browser_template")), "record_id", "title")
    named = [(shop, "taobao", "row_id"), (pages, "approved_browser_template", "record_id")]
    one, two = (d.select(F.lit(t).alias("tbl"), F.col(k).alias("row_key"), "kind") for d, t, k in named)
    return one.unionByName(two)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose title is wholly or partly no content."""
    return p2_kinds(spark, sf_dir).select("tbl", "row_key")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.classes(spread(table(spark, sf_dir, "taobao")), "row_id", "商品标题", "sku名称", "卖家昵称", "received_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings of different sellers that offer the same product."""
    return products.pairs(_classes(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing of a product with its class and the number of listings of other sellers in it."""
    return products.links(_classes(spark, sf_dir)).withColumnRenamed("_key", "row_id")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in a container of each kind."""
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf_dir, "pack_bins"))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and room left per kind."""
    return packing.usage(p7_packed(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str, **options) -> mixing.Mixture:
    return mixing.Mixture(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source", "lang", mixing.DOMAINS, **options)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uses of texts that make up the mixture with the target shares."""
    return _mixture(spark, sf_dir).rows()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mixture reaches."""
    return _mixture(spark, sf_dir).shares()


#: Expected grade from which a text counts as abusive.
ABUSIVE = 0.2


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its severity and its worst sentence."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    model = abuse.train(docs, table(spark, sf_dir, "review_labels"), "doc_id", "text", "abusive")
    return abuse.score(docs, "doc_id", "text", model, ["source"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that insult, threaten, demean or offer sex in their own voice."""
    return p9_scores(spark, sf_dir).where(F.col("severity") >= ABUSIVE).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of abusive documents per source."""
    return abuse.rates(p9_scores(spark, sf_dir), "source", ABUSIVE)


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p7_packed": p7_packed, "p7_usage": p7_usage, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p3_found": p3_found, "p3_groups": p3_groups, "p2_found": p2_found, "p2_kinds": p2_kinds, "p5_found": p5_found, "p5_canonical": p5_canonical}
ORACLES: dict[str, str] = {}
