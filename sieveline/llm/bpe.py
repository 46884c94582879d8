"""Byte-level BPE by a monoid reduction over a binary tree of text pieces.

A text is cut in halves down to leaves of ``leaf`` characters.  A leaf is encoded by
itself; two neighbours are joined by encoding only a window around their common edge
anew.  The window grows, doubling on either side, until both of its ends lie where a
white-space character follows one that is none (or at an end of the text).  No match of
the pre-tokeniser covers such a place, and no look-ahead reaches over it, so tokens
outside the window cannot change: joining is exact, and associative.  Decoding is the
concatenation of the pieces' bytes up the same tree.

That holds for patterns whose alternatives are all in SAFE; for any other one a text is a piece
by itself.

Defined results: nulls count as empty texts.  An empty text has no tokens.  Repeated rows each get
theirs.  Columns of the results' names are replaced, all others kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.textkit import without

#: Characters of a leaf: a window is a small part of it.
LEAF = 1024
WINDOW = 32
#: The characters of Unicode's White_Space, which is the pattern's \\s.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


#: Alternatives of a pre-tokeniser's pattern none of which covers a place where white space follows another character.
SAFE = frozenset([*["'" + s for s in ("s", "t", "re", "ve", "m", "ll", "d")], r" ?\p{L}+", r" ?\p{N}+", r"\p{N}{1,3}", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+"])


def splits(pattern: str) -> bool:
    """Whether texts may be cut for a pattern: its alternatives are all SAFE."""
    return set(pattern.split("|")) <= SAFE


@lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """The encoding of a rank file, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cut_before(text: str, end: int, size: int) -> int:
    """The last hard boundary in text[:end], looking at ever larger windows; 0 if there is none."""
    lo = end
    while lo > 0:
        hi, lo = lo, max(0, end - size)
        for p in range(hi - 1, max(lo, 1) - 1, -1):
            if text[p] in WHITE and text[p - 1] not in WHITE:
                return p
        size *= 2
    return 0


def _cut_after(text: str, begin: int, size: int) -> int:
    """The first hard boundary in text after begin; the end if there is none."""
    hi = begin
    while hi < len(text):
        lo, hi = hi, min(len(text), begin + size)
        for p in range(max(lo, begin + 1), hi):
            if text[p] in WHITE and text[p - 1] not in WHITE:
                return p
        size *= 2
    return len(text)


def encode(text: str, enc, leaf: int = LEAF) -> list[int]:
    """The ids of a text."""

    def piece(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return enc.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = piece(lo, mid), piece(mid, hi)
        part = text[lo:hi]
        a, b = _cut_before(part, mid - lo, WINDOW), _cut_after(part, mid - lo, WINDOW)
        window = enc.encode_ordinary(part[a:b])
        dropped = len(enc.encode_ordinary(part[a : mid - lo])) if a < mid - lo else 0
        skipped = len(enc.encode_ordinary(part[mid - lo : b])) if b > mid - lo else 0
        return left[: len(left) - dropped] + window + right[skipped:]

    return piece(0, len(text))


def decode(ids, enc, leaf: int = LEAF) -> bytes:
    """The bytes of ids, concatenated up the tree."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    mid = len(ids) // 2
    return decode(ids[:mid], enc, leaf) + decode(ids[mid:], enc, leaf)


def encode_texts(
    docs: DataFrame, path: str, pattern: str, *, text: str = "text", leaf: int = LEAF, keep_ids: bool = True, verify: bool = True
) -> DataFrame:
    """docs with bpe_n_tokens, bpe_ids (little-endian unsigned 32-bit integers; null unless
    keep_ids), bpe_ids_sha256, and, if verify, bpe_decoded_sha256 of the decoded bytes."""
    docs = without(docs, "bpe_n_tokens", "bpe_ids", "bpe_ids_sha256", "bpe_decoded_sha256")
    schema = "bpe_n_tokens long, bpe_ids binary, bpe_ids_sha256 string, bpe_decoded_sha256 string"
    if not splits(pattern):  # a text is one piece
        leaf = 1 << 62
    out_schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns] + [schema])

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, raw, ids_sha, text_sha = [], [], [], []
                for value in part.column(text):
                    ids = encode(value.as_py() or "", enc, leaf)
                    packed = np.array(ids, dtype="<u4").tobytes()
                    n.append(len(ids))
                    raw.append(packed if keep_ids else None)
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    text_sha.append(hashlib.sha256(decode(ids, enc, leaf)).hexdigest() if verify else None)
                cols = [part.column(c) for c in names]
                cols += [pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "bpe_n_tokens", "bpe_ids", "bpe_ids_sha256", "bpe_decoded_sha256"])

    return docs.mapInArrow(run, out_schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", F.col("bpe_n_tokens").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"))
