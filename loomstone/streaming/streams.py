"""The same operators over streams: first matches, sequences, budgets and windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.operators import records
from loomstone.session import cut_lineage


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder as they come; a single file is a stream of its own."""
    jvm, reader = spark.sparkContext._jvm, spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def tumbling(stream: DataFrame, at: str, width: str, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per window and key; rows later than ``late`` behind the newest are dropped."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "n")


def sliding(stream: DataFrame, at: str, width: str, step: str, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per overlapping window and key."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width, step).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "n")


def sessions(stream: DataFrame, at: str, gap: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Counts per session: rows of a key with less than ``gap`` between them."""
    w = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *keys, "n")


def once_each(stream: DataFrame, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def _write_batch(df: DataFrame, target: str, number: int) -> None:
    """The rows of a batch under its number; a batch that is run again replaces what it wrote before."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={number}")


def _earlier(spark: SparkSession, target: str, number: int, schema: str) -> DataFrame:
    """What earlier batches have written, empty before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(f"{schema}, batch bigint").parquet(target).where(F.col("batch") < number) if there else spark.createDataFrame([], f"{schema}, batch bigint")


def sequence_batches(target: str, key: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the rows with a ``sequence`` per key that goes on from batch to batch.

    Within a batch rows are numbered in blocks over the whole order, so a hot key is spread over tasks; between batches
    only one number per key and batch is kept (under ``_counts``). Rows of a null key are numbered together.
    """

    def number(batch: DataFrame, at: int) -> None:
        spark, kind = batch.sparkSession, dict(batch.dtypes)[key]
        placed = records.numbered(batch, [key, *order], "_place")
        placed = cut_lineage(placed)
        counts = cut_lineage(placed.groupBy(key).agg(F.min("_place").alias("_least"), F.count("*").alias("n")))
        held = _earlier(spark, f"{target}/_counts", at, f"`{key}` {kind}, n bigint").groupBy(F.col(key).alias("_k")).agg(F.sum("n").alias("_held"))
        starts = counts.join(held, F.col(key).eqNullSafe(F.col("_k")), "left").select(F.col(key).alias("_k"), (F.coalesce("_held", F.lit(0)) - F.col("_least") + 1).alias("_shift"))
        out = placed.join(starts, F.col(key).eqNullSafe(F.col("_k"))).select(*[F.col(f"`{c}`") for c in batch.columns], (F.col("_place") + F.col("_shift")).alias("sequence"))
        _write_batch(out, f"{target}/rows", at)
        _write_batch(counts.select(key, "n"), f"{target}/_counts", at)

    return number


def first_matches(stream: DataFrame, page: Sequence[str], spec: str, order: str) -> DataFrame:
    """The first match per page and spec; ``page`` may be several columns, such as a run and the number of its page.

    A match of an earlier batch has claimed its spec for good; within a batch the lowest ``order`` claims it. The state
    is one flag per claim, and the rows of a claim are read in portions of which only the lowest is held, so a hot one
    takes time but no memory.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def claim(keys: tuple, portions: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for rows in portions:
            if not state.exists and len(rows):
                low = rows.loc[[rows[order].idxmin()]] if rows[order].notna().any() else rows.head(1)
                best = low if best is None or low[order].iloc[0] < best[order].iloc[0] else best
        if best is not None:
            state.update((True,))
            yield best

    return stream.groupBy(*page, spec).applyInPandasWithState(claim, ", ".join(f"`{n}` {k}" for n, k in kinds.items()), "claimed boolean", "append", GroupStateTimeout.NoTimeout)


def within_budget(stream: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows with ``number`` (their count per key so far, in order of arrival) and whether that is ``allowed``."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def count(keys: tuple, portions: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for rows in portions:
            numbers = range(used + 1, used + len(rows) + 1)
            used += len(rows)
            yield rows.assign(number=numbers, allowed=[n <= limit for n in numbers])
        state.update((used,))

    out = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", number bigint, allowed boolean"
    return stream.groupBy(key).applyInPandasWithState(count, out, "used bigint", "append", GroupStateTimeout.NoTimeout)


def missing_after(stream: DataFrame, page: str, spec: str, at: str, wait: str, specs: Sequence[str]) -> DataFrame:
    """``page``, ``opened`` and ``missing``: once the watermark has passed ``wait`` after a page's first row, the
    ``specs`` that nothing matched in that time. Null specs are rows that matched none; pages with all specs give none.
    """
    windows = stream.withWatermark(at, "0 seconds").groupBy(page, F.session_window(at, wait).alias("_w")).agg(F.collect_set(spec).alias("_met"))
    missing = F.array_except(F.array(*[F.lit(s) for s in specs]), F.col("_met"))
    return windows.select(page, F.col("_w.start").alias("opened"), missing.alias("missing")).where(F.size("missing") > 0)


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet files under ``target``, and give what they hold.

    In mode ``complete`` each batch replaces the result. Nothing passes through the driver.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.outputMode(mode).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(target))
    else:
        writer = writer.outputMode(mode).format("parquet").option("path", target)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a ``foreachBatch`` function over what is there now."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
