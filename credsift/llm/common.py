"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsift.session import cut, ship

# A word is a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


# Arrow batches are bounded in bytes as well as rows: some texts are very long.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not hold in any letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def row_hash(df: DataFrame) -> Column:
    """A hash over all columns of a row; maps, which cannot be hashed, as JSON."""

    def hashable(name: str, kind: str) -> Column:
        column = F.col("`" + name.replace("`", "``") + "`")
        return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column

    return F.xxhash64(*(hashable(name, kind) for name, kind in df.dtypes))


def row_key(key: str, content: Column) -> Column:
    """A key that is never NULL, of an id of any type (or none) and a hash of what goes with it."""
    return F.struct(
        F.col(key).isNull().alias("none"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        content.alias("content"),
    )


def hash_unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only; 52 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def running_totals(df: DataFrame, order: list[str], values: list[str], label: str) -> DataFrame:
    """Add ``_index`` (0-based) and ``_before_<value>`` (exclusive sums) in a global order.

    The rows are range partitioned, and only one total per partition meets in one task. The
    order must be total for the sums to be reproducible.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        df.repartitionByRange(parts, *(F.col(c) for c in order)).withColumn(
            "_part", F.spark_partition_id()
        ),
        label,
    )
    sums = [F.count("*").alias("_n"), *(F.sum(v).alias(f"_s_{v}") for v in values)]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(*sums)
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
            *(F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_s_{v}") for v in values),
        )
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, so the broadcast is as small as the list of partitions
    return (
        ranged.withColumn("_index", F.row_number().over(inside) - 1)
        .select(
            "*",
            *(
                F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before_{v}")
                for v in values
            ),
        )
        .join(F.broadcast(offsets), "_part")
        .withColumn("_index", (F.col("_index") + F.col("_n")).cast("long"))
        .withColumns({f"_before_{v}": F.col(f"_before_{v}") + F.col(f"_s_{v}") for v in values})
        .drop("_part", "_n", *(f"_s_{v}" for v in values))
    )
