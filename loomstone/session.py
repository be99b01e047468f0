"""Session factory, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "loomstone", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; every setting may be overridden through ``conf``."""
    builder = SparkSession.builder.appName(app)
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # a call to the JVM for every column function
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input below which a table is dealt over all cores: less than this for each would leave some idle.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files hold less than ``SPREAD_BYTES`` together and give fewer partitions than there
    are cores; the rows are the same either way.

    The size is that of the files in the optimized plan, so the choice costs no job, and no table above that size is
    ever moved, however many cores there are.
    """
    spark = df.sparkSession
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SPREAD_BYTES:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def once(df: DataFrame, columns: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the new columns, each computed once per row.

    The columns come out of a generator of one row, through which the optimizer neither pushes filters nor merges
    projections; either would repeat costly expressions in every later use.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*keep, F.inline(made))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in one process (tests) a temporary folder is chosen; a cluster
    without the setting is refused, since a folder of one machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "loomstone-checkpoint")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back: a lost executor costs no recomputation of what
    led to it, and later plans scan only the columns they need. The table is removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def ntz_micros(column):
    """Microseconds since 1970-01-01 of a timestamp without zone, whatever the session's zone is."""
    ntz = column.cast("timestamp_ntz")
    days = F.unix_date(F.to_date(ntz)).cast("bigint")
    seconds = (days * 24 + F.hour(ntz)) * 3600 + F.minute(ntz) * 60
    return seconds * F.lit(1_000_000) + (F.extract(F.lit("SECOND"), ntz) * F.lit(1_000_000)).cast("bigint")
