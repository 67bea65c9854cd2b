"""SimHash near-dedup over an inverted index of byte positions with count filtering.

A fingerprint is eight positional bytes.  Two that differ in at most ``distance`` = 3
bits share at least 8 - 3 = 5 of them, the guaranteed minimum.  The index holds
postings of position tuples: a family of r-tuples such that any five positions hold
one of them, so every pair worth counting meets in some posting.  In a posting the
equal positional bytes of two fingerprints are tallied, pairs with fewer than five
are dropped, the rest verified by bit count.

Only distinct fingerprints are indexed, so copies cost one entry.  r grows with the
number of fingerprints, which keeps postings short.  A posting that is still long is
split by a further byte: of its open positions any four hold another match.  Within
a long posting a search from fingerprint to unseen fingerprint finds its classes
without listing pairs; its links suffice for the components.

Defined cases: null or empty text (no words) has fingerprint zero and links like any
other; fewer than three words make one shingle; rows with one doc_id are rows of
their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, with_columns_of
from .components import connected_components
from .kernels import U64

SEED = 42
SHINGLE = 3
DISTANCE = 3
POSITIONS = 8
#: A posting of more fingerprints is split by another byte while one is left to split by.
LONG = 1 << 13
#: Postings up to this length compare all their pairs.
SHORT = 48


def fingerprint_of(text: str | None, size: int = SHINGLE) -> bytes:
    """The eight bytes of one text's fingerprint."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest, seed = xxhash.xxh64_digest, SEED
    found = np.frombuffer(b"".join([digest(x, seed) for x in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[i : i + (1 << 16)], axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > len(found)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for b in batches:
            out = b"".join([fingerprint_of(x.as_py()) for x in b.column(1)])
            yield pa.record_batch([b.column(0), pa.array(np.frombuffer(out, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    return with_columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def tuples(r: int, shared: int = POSITIONS - DISTANCE) -> list[tuple[int, ...]]:
    """r-tuples of positions such that any ``shared`` positions hold one of them all."""
    if r == 2:
        return [(0, 1), (2, 3), (4, 5), (6, 7)]
    if r == 3:
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    open_sets, out = {frozenset(x) for x in combinations(range(POSITIONS), shared)}, []
    while open_sets:
        best = max(combinations(range(POSITIONS), r), key=lambda t: sum(set(t) <= s for s in open_sets))
        out.append(best)
        open_sets = {s for s in open_sets if not set(best) <= s}
    return out


def tuple_size(n: int) -> int:
    """The least r with which an average fingerprint meets at most some dozens of others by chance."""
    return next((r for r in (2, 3, 4) if n <= 128 * 256**r / len(tuples(r))), 5)


def masked(fp, mask):
    return fp.bitwiseAND(mask)


def mask_of(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def links_within(key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links within postings; rows are sorted by posting."""
    least = POSITIONS - distance
    out_a, out_b = [], []

    def verified(x):
        # the tally of positions at which both have one byte; pairs below the minimum are never verified
        x = np.ascontiguousarray(x)
        shared = np.zeros(len(x), np.int8)
        for column in x.view(np.uint8).reshape(-1, POSITIONS).T:
            shared += column == 0
        out = shared >= least
        at = np.flatnonzero(out)
        out[at] = np.bitwise_count(x[at]) <= distance
        return out

    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    owner = np.repeat(np.arange(len(begin)), size)
    small = size[owner] <= SHORT
    at = np.flatnonzero(small)
    d = 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[owner[at + d] == owner[at]]
        good = at[verified(fp[at] ^ fp[at + d])] if len(at) else at
        out_a.append(fp[good])
        out_b.append(fp[good + d])
        d += 1
    for i in np.flatnonzero(size > SHORT):
        rest = fp[begin[i] : begin[i] + size[i]]
        while len(rest) > 1:
            root, rest, front = rest[0], rest[1:], [rest[0]]
            while front and len(rest):
                near = verified(rest ^ front.pop())
                if near.any():
                    found = rest[near]
                    rest = rest[~near]
                    out_a.append(np.full(len(found), root))
                    out_b.append(found)
                    front.extend(found)
    empty = np.zeros(0, U64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def fingerprint_links(distinct: DataFrame, r: int | None = None, long: int = LONG) -> DataFrame:
    """(a, b) fingerprints at most three bits apart: enough of them to give all components.  distinct: one column fp."""
    r = r or tuple_size(distinct.count())
    posting = F.explode(F.array(*[F.struct(F.lit(mask_of(t)).alias("mask"), masked(F.col("fp"), F.lit(mask_of(t))).alias("bytes")) for t in tuples(r)]))
    rows = distinct.select("fp", posting.alias("p")).select("fp", "p.mask", "p.bytes")
    done = []
    for depth in range(r, POSITIONS - DISTANCE):
        count = rows.groupBy("mask", "bytes").count().where(F.col("count") > long)
        hot = cut(count.select("mask", "bytes"))
        if hot.isEmpty():
            break
        done.append(rows.join(hot, ["mask", "bytes"], "left_anti"))
        # of the open positions, any four hold one more match; the first four in order
        free = F.slice(F.filter(F.array(*[F.lit(mask_of((p,))) for p in range(POSITIONS)]), lambda m: m.bitwiseAND(F.col("mask")) == 0), 1, DISTANCE + 1)
        more = rows.join(hot, ["mask", "bytes"], "left_semi").withColumn("m", F.explode(free)).select("fp", F.col("mask").bitwiseOR(F.col("m")).alias("mask"))
        rows = cut(more.select("fp", "mask", masked(F.col("fp"), F.col("mask")).alias("bytes")).distinct())
    for x in done:
        rows = rows.unionByName(x)

    def link(batches):
        # a partition's postings come sorted; one that spans batches is kept together
        tail = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if tail is not None:
                t = pa.concat_tables([tail, t])
            key = t["key"].to_numpy()
            stop = int(np.searchsorted(key, key[-1])) if len(key) else 0
            tail = t.slice(stop)
            if stop:
                a, c = links_within(key[:stop], t["fp"].to_numpy()[:stop].view(U64))
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"])
        if tail is not None and tail.num_rows:
            a, c = links_within(tail["key"].to_numpy(), np.ascontiguousarray(tail["fp"].to_numpy()).view(U64))
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"])

    # postings whose hashed names collide only compare more fingerprints than needed
    keyed = rows.select(F.xxhash64("mask", "bytes").alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    return keyed.mapInArrow(link, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links) of every row."""
    rows = cut(fingerprints(docs))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.select("fp", "root").join(low, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
