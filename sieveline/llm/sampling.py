"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in fold 0 of its own text, the empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, *, rows: int, most_bytes: int = 64 << 20, key: str = "doc_id", text: str = "text", label: str = "label", seed: int = 11) -> list:
    """At most rows (text, label) pairs of most_bytes in all, chosen by a hash of the key: the ids are chosen alone, and fetch their texts.

    A key has one label, the largest, and one text, the least of the shortest; keys null or with
    a null label take no part.  All that reaches the driver is bounded by rows and most_bytes.
    """
    order = (F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    chosen = known.orderBy(*order).limit(rows)
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(key, F.struct(F.octet_length(body).cast("long").alias("size"), body.alias("text")).alias("_t"))
    one = texts.join(F.broadcast(chosen), key).groupBy(key).agg(F.min("_t").alias("_t"), F.first("_label").alias("_label"))  # rows bounds the broadcast
    so_far = F.sum("_t.size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = one.withColumn("_sum", so_far).where(F.col("_sum") <= most_bytes).select(key, "_t.text", "_label")
    return [(t, y) for _, t, y in sorted((r[0], r[1], r[2]) for r in got.collect())]
