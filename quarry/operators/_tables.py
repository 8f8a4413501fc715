"""Tables between the rounds of an operator: written to the folder that all machines share, and deleted at its end.

Also joins and running sums that hold for hot keys: no task gets all rows of a key.
"""

from __future__ import annotations

import functools
import gc
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than this share of a table's rows, and more than HOT_ROWS, is hot; at most the share's inverse can be.
HOT_SHARE, HOT_ROWS = 0.001, 100_000
#: Tables of at most so many bytes on disk, about three times that in memory, go to the rows by broadcast.
BROADCAST_BYTES = 24 << 20
_OPEN: list[list[str]] = []
#: Seconds until the driver is asked again to collect its garbage.
_collected, COLLECT_AFTER = [0.0], 20.0


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine, where it is unset, one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written and read again: its lineage ends, and executors may go."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    if time.monotonic() - _collected[0] > COLLECT_AFTER:  # shuffle files stay on the executors until the driver collects its garbage
        gc.collect()
        spark._jvm.System.gc()
        _collected[0] = time.monotonic()
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose tables are deleted once its result is one."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _OPEN.append([])
        try:
            out = operator(*args, **kwargs)
        finally:
            made = _OPEN.pop()
        out = cut(out)
        for path in made:
            delete(out.sparkSession, path)
        return out

    return run


def is_small(df: DataFrame) -> bool:
    """Whether the files behind df, a cut table or columns of one, are few enough bytes to be broadcast."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(name) for name in df.inputFiles()]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths) <= BROADCAST_BYTES


def light(other: DataFrame) -> DataFrame:
    """other, a cut table, to be broadcast if it is small."""
    return F.broadcast(other) if is_small(other) else other


def attach(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """join_unique(), by broadcast if other is small: rows stay where they are."""
    return rows.join(F.broadcast(other), keys, how) if is_small(other) else join_unique(rows, other, keys, how)


def join_unique(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows.join(other, keys) of two cut tables; a key is one row of other, and may be very many of rows.

    Rows of hot keys are joined by broadcast of their rows of other, at most 1 / HOT_SHARE. Rows of
    null keys are not joined: they stay as they are in a left join and go in an inner one.
    """
    null = functools.reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    if how == "left":
        alone = rows.filter(null).select(*keys, *(c for c in rows.columns if c not in keys), *(F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name not in keys))
        return _joined(rows.filter(~null), other, keys, how).unionByName(alone)
    return _joined(rows.filter(~null), other, keys, how)


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    total = rows.count()
    if total <= HOT_ROWS:
        return rows.join(other, keys, how)
    least = max(HOT_ROWS, HOT_SHARE * total)
    hot = [r for r in rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).collect()]  # at most 1 / HOT_SHARE rows
    if not hot:
        return rows.join(other, keys, how)
    schema = rows.select(*keys).schema
    few = rows.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in hot], schema)
    held = F.broadcast(other.join(F.broadcast(few), keys, "left_semi"))
    return rows.join(F.broadcast(few), keys, "left_anti").join(other, keys, how).unionByName(rows.join(F.broadcast(few), keys, "left_semi").join(held, keys, how))


def running(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each row, sums over the rows before it in its group, and the last value before it that isn't null.

    Rows are dealt by ranges of (group, order), so that a group of any size is spread over many tasks;
    what runs within a range starts from what the ranges before it come to, a row per range and group.
    """
    sums, lasts = sums or {}, lasts or {}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *map(F.col, group), *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *(F.sum(c).over(within).alias(f"_s_{n}") for n, c in sums.items()), *(F.last(c, ignorenulls=True).over(within).alias(f"_l_{n}") for n, c in lasts.items()))
    place = F.struct(*order)
    ends = dealt.groupBy(*group, "_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in lasts.items()), F.count("*").alias("_n"))
    start = ends.select(*group, "_part", *(F.sum(n).over(earlier).alias(f"_b_{n}") for n in sums), *(F.last(n, ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in lasts))
    both = local.join(start, [*group, "_part"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(*rows.columns, *((zero(f"_s_{n}") + zero(f"_b_{n}")).alias(n) for n in sums), *(F.coalesce(f"_l_{n}", f"_b_{n}").alias(n) for n in lasts))
