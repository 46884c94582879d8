"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

White space is made even, then each text has three forms: all words lower-cased; a template with
typed placeholders for numbers, units after numbers and capitalised names inside sentences; and
one in which every capitalised word is a name, so that names that begin sentences may differ.
Windows match if they are equal in any form.  They are joined by hash: every window of a
benchmark item is known by its anchor, its longest word that is literal in all forms, so that a
document's words are probed once each, and only windows around an anchor are compared in full.
Hits of a document and an item on one diagonal (equal distance of places) belong together, and
count by the words that the union of their windows covers; their slots, without punctuation at
either end, must be filled by a function: one value of the item's stands for one value of the
document's.  So questions asked again with other numbers or names are found, also where two
values become equal, and chance overlaps of templates are not.  Where the whole diagonal is not
consistent, windows that are equal word for word count alone, whatever the other slots hold, and
so does a consistent run of windows that covers twice as many words.

Only the benchmark is broadcast, in parts of a bounded size; texts are never shuffled.

Defined results: null and empty texts match nothing.  Items of fewer than MIN_ITEM words, and
windows of which fewer than MIN_LITERAL words are literal in a template, are found word for word
only.  Rows of equal text and id count once; null ids are found as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.scratch import written

WINDOW = 8
#: Words that the windows of one diagonal must cover, or all of a shorter item.
COVER = 12
MIN_ITEM = 4
MIN_LITERAL = 3
#: Bytes of the benchmark's windows that are broadcast at a time, about; more are joined part by part.
BROADCAST_BYTES = 64 << 20

NUMBER, UNIT, NAME = "\u0001", "\u0002", "\u0003"
#: Units of measure and money that may follow a number.
UNITS = "km|cm|mm|m|mi|miles|ft|feet|in|inches|kg|g|mg|lb|lbs|oz|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|mph|kmh|%|percent|dollars|euros|pounds|cents|usd|eur"
_SPACE = r"[\x20\x09-\x0D]+"


def with_forms(rows: DataFrame, text: str) -> DataFrame:
    """rows with plain, inner and named: the words of text lower-cased, with names inside sentences as placeholders, and with all capitalised words so."""
    even = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\u0001-\u0003]", "?"), _SPACE, " "))
    # a unit's placeholder ends in a letter as far as a name behind it goes
    slots = F.regexp_replace(F.col("_even"), r"(?<![\p{L}\p{N}])[+-]?\d++(?:[.,:/]\d++)*+", NUMBER)
    slots = F.regexp_replace(slots, rf"(?i)({NUMBER}\x20?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")
    rows = rows.withColumn("_even", even).withColumn("_slots", slots)
    words = lambda t: F.filter(F.split(F.lower(t), "\x20"), lambda w: w != "")
    inner = F.regexp_replace("_slots", rf"(?<=[\p{{Ll}},;{UNIT}]\x20)\p{{Lu}}\p{{Ll}}+", NAME)
    named = F.regexp_replace("_slots", r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+", NAME)
    return rows.withColumns({"plain": words(F.col("_even")), "inner": words(inner), "named": words(named)}).drop("_even", "_slots")


def literal(word: Column) -> Column:
    return ~word.rlike("[\u0001-\u0003]")


FORMS = ("plain", "inner", "named")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, item_size, start, w, low, places, plain, inner, named, anchor, offset) of each window of each item; forms that are not used are null.

    The plain form is always used, so that whatever stands word for word is found.
    """
    b = with_forms(benchmark.select("item_id", "text"), "text").drop("text").distinct()
    b = b.withColumn("item_size", F.size("plain")).where("item_size > 0").withColumn("w", F.least(F.lit(window), F.col("item_size")))
    b = b.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("item_size") - F.col("w"))))
    b = b.withColumns({f: F.slice(f, F.col("start") + 1, F.col("w")) for f in FORMS})
    # words by the forms in which they are literal: 0, all; 1, not named; 2, plain, but no number or unit; 3, the others
    free = lambda form, i: literal(F.get(form, i))
    rank = lambda i: F.when(free("named", i), 0).when(free("inner", i), 1).when(~F.get("inner", i).rlike(f"[{NUMBER}{UNIT}]"), 2).otherwise(3)
    b = b.withColumn("ranked", F.array_sort(F.transform("plain", lambda x, i: F.struct(rank(i).alias("rank"), (-F.length(x)).alias("l"), x.alias("word"), i.alias("offset")))))
    used = lambda form, top: F.when((F.col("item_size") >= MIN_ITEM) & (F.size(F.filter("ranked", lambda s: s["rank"] <= top)) >= MIN_LITERAL), F.col(form))
    places = F.transform("named", lambda x, i: F.when(~free("inner", i), 1).when(~literal(x), 2))
    b = b.withColumn("places", places).withColumns({"inner": used("inner", 1), "named": used("named", 0)})
    first = F.col("ranked")[0]
    return b.select("item_id", "item_size", "start", "w", F.col("plain").alias("low"), "places", *FORMS, first["word"].alias("anchor"), first["offset"].alias("offset"))


def covered(starts: Column, w: Column) -> Column:
    """Words in the union of windows of w words at sorted distinct starts."""
    n = F.greatest(F.size(starts) - 1, F.lit(0))
    steps = F.zip_with(F.slice(starts, F.lit(1), n), F.slice(starts, F.lit(2), n), lambda a, b: F.least(b - a, w))
    return F.when(F.size(starts) < 1, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x) + w)


def longest_run() -> Column:
    """Words that a diagonal's windows (starts, w, places) cover in its best run whose slots are consistent."""
    by_value = F.array_sort(F.transform("places", lambda p: F.struct(p["item"].alias("item"), p["at"].alias("at"), p["doc"].alias("doc"))))

    def breaks(sorted_: Column) -> Column:
        # neighbours with one value of the item's and two of the document's: no run holds both
        n = F.greatest(F.size(sorted_) - 1, F.lit(0))
        both = F.zip_with(F.slice(sorted_, F.lit(1), n), F.slice(sorted_, F.lit(2), n), lambda a, b: F.when((a["item"] == b["item"]) & (a["doc"] != b["doc"]), F.struct(b["at"].alias("hi"), a["at"].alias("lo"))))
        return F.concat(F.filter(both, lambda x: x.isNotNull()), F.array(F.struct(F.lit(1 << 30).alias("hi"), F.lit(-1).alias("lo"))))

    def step(st: Column, b: Column) -> Column:
        inside = F.filter("starts", lambda s: (s > st["lo"]) & (s + F.col("w") <= b["hi"]))
        return F.struct(F.greatest(st["lo"], b["lo"]).alias("lo"), F.greatest(st["best"], covered(inside, F.col("w"))).alias("best"))

    return F.aggregate(F.array_sort(breaks(by_value)), F.struct(F.lit(-1).alias("lo"), F.lit(0).alias("best")), step, lambda st: st["best"])


def blocks_of(items: DataFrame) -> list[DataFrame]:
    """items in parts of at most about BROADCAST_BYTES each, as counted from their words."""
    size = 4 * F.octet_length(F.array_join("low", " ")) + 64 * F.col("w") + 200
    total = items.agg(F.sum(size)).first()[0] or 0
    n = int(-(-total // BROADCAST_BYTES)) or 1
    if n == 1:
        return [items]
    items = written(items.withColumn("_part", F.pmod(F.xxhash64("item_id", "start"), F.lit(n))), "windows")
    return [items.where(F.col("_part") == i).drop("_part") for i in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, cover: int = COVER) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_covered, n_slots): a row for each document and item of which it holds a passage."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = with_forms(d.withColumn("text_hash", F.xxhash64("_text")), "_text").withColumnsRenamed({f: f"_{f}" for f in FORMS})
    d = d.select("doc_id", "text_hash", *[f"_{f}" for f in FORMS], F.posexplode("_plain").alias("_at", "_word"))
    begin = F.col("_at") - F.col("offset")
    part = lambda form: F.slice(f"_{form}", F.greatest(begin, F.lit(0)) + 1, F.col("w"))
    equal = (part("plain") == F.col("plain")) | (part("inner") == F.col("inner")) | (part("named") == F.col("named"))
    on = (F.col("_word") == F.col("anchor")) & (begin >= 0) & equal
    # a scan of docs for each part of the benchmark, whose size does not grow with docs
    hits = reduce(DataFrame.unionAll, [d.join(F.broadcast(items), on) for items in blocks_of(item_windows(benchmark, window))])
    bare = lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    pair = lambda x, i: F.struct((F.col("start") + i).alias("at"), bare(x).alias("item"), bare(F.get("_low", i)).alias("doc"), F.get("places", i).alias("by"))
    strict = F.coalesce((part("plain") == F.col("plain")) | (part("inner") == F.col("inner")), F.lit(False))
    hits = hits.select("doc_id", "text_hash", "item_id", "item_size", "start", "w", "low", "places", begin.alias("begin"), part("plain").alias("_low"), strict.alias("strict"))
    slots = F.transform("low", lambda x, i: F.when(F.get("places", i).isNotNull(), pair(x, i)))
    hits = hits.withColumn("slots", F.filter(slots, lambda s: s.isNotNull())).withColumn("same", F.col("low") == F.col("_low"))
    starts = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("start"))))
    lines = hits.groupBy("doc_id", "text_hash", "item_id", (F.col("begin") - F.col("start")).alias("diagonal")).agg(
        starts(F.lit(True)).alias("starts"),
        starts(F.col("same")).alias("same"),
        starts(F.col("strict")).alias("strict"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("strict"), F.col("slots"))))).alias("strict_places"),
        F.max("w").alias("w"),
        F.max("item_size").alias("item_size"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("places"),
    )
    values = lambda places: F.array_distinct(F.transform(places, lambda p: F.struct(p["item"], p["doc"])))
    function = lambda slots: F.size(F.array_distinct(F.transform(slots, lambda s: s["item"]))) == F.size(slots)
    lines = lines.withColumn("slots", values("places")).withColumn("strict_slots", values(F.filter("strict_places", lambda p: p["by"] == 1)))
    lines = lines.withColumns({"n_windows": F.size("starts"), "n_slots": F.size("slots")} | {f"c_{c}": covered(F.col(c), F.col("w")) for c in ("starts", "same", "strict")})
    enough = F.least(F.lit(cover), F.col("item_size"))
    # the looser form must not clear what the stricter ones find alone
    good = (F.col("c_same") >= enough) | (F.col("c_starts") >= enough) & function("slots") | (F.col("c_strict") >= enough) & function("strict_slots")
    good = F.when(good, True).when(F.col("c_starts") < 2 * cover, False).otherwise(longest_run() >= 2 * cover)
    return lines.where(good).groupBy("doc_id", "text_hash", "item_id").agg(F.max("n_windows").cast("long").alias("n_windows"), F.max("c_starts").cast("long").alias("n_covered"), F.max("n_slots").cast("long").alias("n_slots"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a passage of a benchmark item."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_hash"])
    return docs.join(bad, same, "left_anti")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.drop("text_hash")
