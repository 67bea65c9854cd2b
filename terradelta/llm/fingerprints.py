"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed level by level.  At each level equal neighbours are
first contracted to runs; deterministic coin tossing (Cole and Vishkin) then compares
each symbol to its left neighbour, keeps the place and value of the lowest bit in
which they differ, and repeats until few labels are left; local maxima of the labels
begin phrases, and a phrase's name is a hash of its symbols.  A boundary depends only
on a few symbols around it, so equal substrings get equal names inside, whatever
stands before them.  The names of the levels are the text's features; the fingerprint
is a one-permutation min-hash of them: ``BINS`` hex groups, the least name of each bin.
The likeness of two fingerprints is the share of bins in which they agree.

The edited text of a row needs the next document by doc_id.  Rows are dealt to ranges
of doc_id and each range also gets the first document of the range after it (the last
gets the very first), so no row looks beyond its range.  There are at most ``RANGES``
ranges, so the bounds and first keys, two literal arrays, don't grow with the input; a
range's rows are sorted by Spark, which spills, and pass its task a batch at a time, so
memory depends neither on its length nor on how many rows share a doc_id.

Defined cases: null counts as the empty text, whose fingerprint has no features; two
of those are alike (1.0), one of those and another are not (0.0); null doc_ids come
last; rows of one doc_id are ordered by text; a single row is its own next; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bounds, parts_for, range_of, table, with_columns_of
from .kernels import U64, mix, slices, utf8

BINS = 64
#: Levels whose phrase names are features: phrases of about 7, 18 and 45 bytes.
LEVELS = (2, 3, 4)
#: Most ranges of doc_id, which bounds what the plan and the driver hold; beyond it ranges grow, and a range streams through its task.
RANGES = 16384
LAST = np.iinfo(np.int64).max
EMPTY = 0xFFFF


def phrase_starts(symbol: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where phrases begin in a sequence without equal neighbours; ``begin`` marks the first symbol of each text."""
    n = len(symbol)
    label = symbol
    # 64 bits -> 7 -> 4 -> 3 bits: after three rounds labels are below six or so
    for _ in range(3):
        left = np.empty(n, U64)
        left[0], left[1:] = 0, label[:-1]
        x = label ^ left
        low = x & (~x + U64(1))
        place = np.bitwise_count(low - U64(1)).astype(U64)
        label = (place << U64(1)) | ((label & low) != 0).astype(U64)
        label[begin] = U64(129)
    first = np.zeros(n, bool)
    if n > 2:
        first[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    first[1:] &= ~first[:-1]
    first[begin] = True
    return np.flatnonzero(first)


def parse(symbol: np.ndarray, at: np.ndarray, levels: int = max(LEVELS)):
    """Yields per level the names of the phrases and the texts' offsets in them."""
    odd = U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for _ in range(levels):
            n = len(symbol)
            if not n:
                yield symbol, at
                continue
            begin = np.unique(at[at < n])
            new = np.ones(n, bool)
            new[1:] = symbol[1:] != symbol[:-1]
            new[begin] = True
            head = np.flatnonzero(new)
            run = np.diff(np.append(head, n)).astype(U64)
            symbol = mix(symbol[head] + run * odd)
            at = np.searchsorted(head, at)
            n = len(symbol)
            begin = np.unique(at[at < n])
            start = phrase_starts(symbol, begin)
            # a phrase's name: a sum of its symbols, each scrambled with its place in the phrase
            owner = np.zeros(n, np.int64)
            owner[start] = 1
            place = np.arange(n) - start[np.cumsum(owner) - 1]
            symbol = mix(np.add.reduceat(mix(symbol ^ ((place.astype(U64) + U64(1)) * odd)), start))
            at = np.searchsorted(start, at)
            yield symbol, at


def fingerprint_batch(texts: pa.Array) -> np.ndarray:
    """BINS 16-bit values a text; EMPTY marks a bin without features."""
    data, offsets = utf8(texts)
    out = np.full((len(offsets) - 1, BINS), EMPTY, np.uint16)
    for i, j in slices(offsets, 1 << 18):
        at = offsets[i : j + 1] - offsets[i]
        symbol = mix(data[offsets[i] : offsets[j]].astype(U64) + U64(1))
        if not len(symbol):
            continue
        flat = np.full((j - i) * BINS, EMPTY, np.uint16)
        for level, (names, where) in enumerate(parse(symbol, at), 1):
            if level in LEVELS and len(names):
                doc = np.repeat(np.arange(j - i), np.diff(where))
                h = mix(names + U64(level))
                value = np.minimum((h >> U64(8)) & U64(0xFFFF), U64(EMPTY - 1)).astype(np.uint16)
                np.minimum.at(flat, doc * BINS + (h % U64(BINS)).astype(np.int64), value)
        out[i:j] = flat.reshape(-1, BINS)
    return out


def to_hex(fp: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in fp]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins with a feature in either that agree; 1 where neither text has any."""
    some = (a != EMPTY) | (b != EMPTY)
    n = some.sum(1)
    return np.where(n == 0, 1.0, ((a == b) & some).sum(1) / np.maximum(n, 1))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    parts = min(parts or parts_for(docs, 8 << 20), RANGES)
    docs = with_columns_of(docs, "doc_id", "text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(int(LAST))).alias("key"))
    bounds = id_bounds(rows, "key", parts)
    rows = rows.withColumn("part", range_of(F.col("key"), bounds).cast("int"))
    # one first key a range reaches the driver; the first document of each is copied to the range before
    heads = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    if heads:
        keys, before = F.lit([key for _, key in heads]), F.lit([heads[i - 1][0] for i in range(len(heads))])
        chosen = rows.where(F.col("key").isin([key for _, key in heads])).groupBy("key").agg(F.min("text").alias("text"))
        to = F.element_at(before, F.array_position(keys, F.col("key")).cast("int"))
        extra = chosen.select(F.lit(None).cast("long").alias("doc_id"), "text", "key", to.alias("part"), F.lit(1).alias("extra"))
        rows = rows.withColumn("extra", F.lit(0)).unionByName(extra)
    else:
        rows = rows.withColumn("extra", F.lit(0))

    def run(batches):
        hold = None  # the last row so far, which awaits the next one's text
        for b in batches:
            t = pa.Table.from_batches([b])
            if hold is not None:
                t = pa.concat_tables([hold, t])
            hold = t.slice(t.num_rows - 1)
            if t.num_rows < 2:
                continue
            text, extra, ids = t["text"], t["extra"].to_numpy(), t["doc_id"]
            here = text.to_pylist()
            edits = [edited(here[i], here[i + 1]) if not extra[i] else "" for i in range(len(here) - 1)]
            fp, fe = fingerprint_batch(text), fingerprint_batch(pa.array(edits, pa.large_string()))
            own = np.flatnonzero(extra[:-1] == 0)
            yield pa.record_batch(
                [
                    pa.array([ids[int(i)].as_py() for i in own], pa.int64()),
                    pa.array([len(here[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(edits[i].encode()).hexdigest() for i in own], pa.string()),
                    pa.array(to_hex(fp[own]), pa.string()),
                    pa.array(to_hex(fe[own]), pa.string()),
                    pa.array(likeness(fp[own], fe[own])),
                    pa.array(likeness(fp[own], fp[own + 1])),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    ranged = rows.repartition(parts, "part").sortWithinPartitions("part", "extra", "key", "text").select("doc_id", "text", "extra")
    return ranged.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
