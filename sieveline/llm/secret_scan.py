"""Secret scanning over an incremental blob ledger, in DataFrame operations only.

Every text is content-addressed by its SHA-256.  The ledger holds, for each blob and each
``rule@version`` under which it was scanned, the spans found.  A scan looks only at pairs
of blob and rule version that the ledger lacks; findings are joined back to every row
(path) that has the blob.  Spans count code points; ends are exclusive.

Defined results: nulls count as empty texts, which have no findings.  Repeated rows each get the
findings, and repeated ledger rows count once.  A private key is a finding as far as its end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.textkit import unused, without


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches count if their group has least characters.

    hint is a pattern that every text with a counting match has; it is cheaper to look for.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1
    base: bool = False

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

_KEY_BEGINS = "-----BEGIN [A-Z ]*PRIVATE KEY-----"

#: The contract's kinds come first, in its order; the others add spans.
RULES = (
    Rule("assign", _ASSIGN + "([A-Za-z0-9+/_.=-]+)", 2, 8, _ASSIGN + "[A-Za-z0-9+/_.=-]{8}", base=True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}", base=True),
    Rule("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}", base=True),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]+", 0, 40, "gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 15, "xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, r"eyJ[A-Za-z0-9_-]+\."),
    # as far as its end; without one, or with another beginning before it, the line alone
    Rule("private_key", _KEY_BEGINS + "(?:(?:[^-]++|-(?!----(?:BEGIN|END)\\x20))*+-----END [A-Z ]*PRIVATE KEY-----)?+", 0, 1, _KEY_BEGINS, version=2),
)

#: The rules of the ledger's first version.
FIRST_RULES = tuple(r for r in RULES if r.base)

LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"
_SPANS = "array<struct<start:int,end:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in text: what split() leaves between matches gives their places."""
    pattern = F.lit(rule.pattern)
    parts = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.zip_with(
        F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))),
        value,
        lambda step, v: F.struct(step.gap.alias("gap"), step.hit.alias("hit"), (F.length(v) >= rule.least).alias("counts")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state.at + x.gap
        span = F.array(F.struct(begin.alias("start"), (begin + x.hit).alias("end")))
        return F.struct((begin + x.hit).alias("at"), F.when(x.counts, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    return F.aggregate(steps, start, step, lambda state: state.spans)


def scan(docs: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: one for each blob of docs and rule version that the ledger lacks (empty spans too)."""
    blobs = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).select(F.sha2("_text", 256).alias("blob"), "_text")
    blobs = blobs.groupBy("blob").agg(F.first("_text").alias("_text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("_seen"))
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("_seen", F.lit(None).cast("array<string>"))
    none = F.array().cast(_SPANS)
    entries = []
    for rule in rules:
        unseen = ~F.coalesce(F.array_contains("_seen", rule.id), F.lit(False))
        spans = F.when(F.col("_text").rlike(rule.hint), spans_of(F.col("_text"), rule)).otherwise(none)
        entries.append(F.when(unseen, F.struct(F.lit(rule.id).alias("rule"), spans.alias("spans"))))
    return blobs.select("blob", F.array_compact(F.array(*entries)).alias("_entries")).select("blob", F.inline("_entries"))


def findings(docs: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secret_spans") -> DataFrame:
    """docs with into: array of (start, kind_no, end, kind), in that order; empty where nothing was found.

    With a ledger, only unseen pairs are scanned and the ledger's own findings are used for the
    others.  A column of the name into is replaced; all others stay.
    """
    docs = without(docs, into)
    fresh = scan(docs, ledger, text=text, rules=rules)
    if ledger is not None:
        fresh = fresh.unionByName(ledger.select("blob", "rule", "spans").where(F.col("rule").isin([r.id for r in rules])))
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.id, i)])
    kinds = F.split("rule", "@")[0]
    key, found = unused(docs, "secret_blob"), unused(docs, "secret_found")
    hits = (
        fresh.where(F.size("spans") > 0)
        .select("blob", F.transform("spans", lambda s: F.struct(s.start.alias("start"), order[F.col("rule")].alias("kind_no"), s.end.alias("end"), kinds.alias("kind"))).alias("_s"))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_set("_s"))).alias("spans"))
        .select(F.col("blob").alias(key), F.col("spans").alias(found))
    )
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    joined = keyed.join(hits, key, "left")
    return joined.select(*[f"`{c}`" for c in docs.columns], F.coalesce(F.col(found), empty).alias(into))


def advance(ledger: DataFrame | None, docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with what a scan of docs adds to it."""
    fresh = scan(docs, ledger, text=text, rules=rules)
    return fresh if ledger is None else ledger.select("blob", "rule", "spans").unionByName(fresh)


def merged(spans: Column) -> Column:
    """Sorted spans without overlaps: those that touch or overlap become one."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.array(F.struct(s.start.alias("start"), s.end.alias("end")))
        grown = F.array(F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end")))
        return F.when(F.size(acc) == 0, one).when(s.start <= last.end, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(F.concat(acc, one))

    return F.aggregate(spans, F.array().cast(kind), step)


def redact(docs: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every found span replaced by mask; texts without findings, and all other columns, stay as they are."""
    spans = unused(docs, "secret_spans")
    found = findings(docs, ledger, text=text, rules=rules, into=spans)
    gone = unused(found, "secret_gone")
    found = found.withColumn(gone, merged(F.col(spans)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.col(f"`{text}`")
    built = F.aggregate(
        gone,
        start,
        lambda st, s: F.struct(s.end.alias("at"), F.concat(st.out, body.substr(st.at + 1, s.start - st.at), F.lit(mask)).alias("out")),
        lambda st: F.concat(st.out, body.substr(st.at + 1, F.length(body))),
    )
    return found.withColumn(text, F.when(F.size(gone) > 0, built).otherwise(body)).select(*[f"`{c}`" for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # two versions of the rules: the second scan finds the first one's pairs in the ledger
    ledger = scan(docs, rules=FIRST_RULES)
    found = findings(docs, ledger).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s.kind_no < 3)
    count = lambda n: F.size(F.filter("secret_spans", lambda s: s.kind_no == n)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))
