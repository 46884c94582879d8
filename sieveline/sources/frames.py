"""Feature frames (id, features ARRAY<DOUBLE>, label) and pair frames (i, j, value) from files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def features(table: DataFrame, id: str, vec: str | list[str], label: str | None = None) -> DataFrame:
    """A feature frame from an array column, or from scalar columns in order."""
    packed = F.col(vec).cast("array<double>") if isinstance(vec, str) else F.array(*[F.col(c).cast("double") for c in vec])
    keep = [F.col(label).alias("label")] if label else []
    return table.select(F.col(id).cast("long").alias("id"), packed.alias("features"), *keep)


def read_text(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """Rows of delimited numbers, numbered in file order; for files of one partition's size."""
    rows = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    return rows.select(F.monotonically_increasing_id().alias("id"), F.array(*[F.col(c).cast("double") for c in rows.columns]).alias("features"))


def write(frame: DataFrame, path: str, fmt: str = "parquet", *partition_by: str) -> None:
    writer = frame.write.format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def check_pairs(pairs: DataFrame, tolerance: float = 1e-8, by: str | None = None) -> None:
    """Raises unless the pair frame of each group is square and symmetric."""
    pairs = pairs.select((F.col(by) if by else F.lit(0)).alias("g"), "i", "j", "value")
    shape = pairs.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("i").alias("a"), F.count_distinct("j").alias("b"), F.count_distinct("i", "j").alias("c"))
    if not shape.where("n <> a * b or a <> b or c <> n").isEmpty():
        raise ValueError("the pairs are not square")
    turned = pairs.select("g", F.col("i").alias("j"), F.col("j").alias("i"), F.col("value").alias("other"))
    a, b = pairs.alias("a"), turned.alias("b")
    both = a.join(b, F.expr("a.g <=> b.g and a.i = b.i and a.j = b.j"), "left")
    if not both.where(~F.coalesce(F.abs(F.col("value") - F.col("other")) <= tolerance, F.lit(False))).isEmpty():
        raise ValueError("the pairs are not symmetric")
