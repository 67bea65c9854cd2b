"""Benchmark decontamination over a distributed positional inverted index.

``positional_index`` stores, for each shard of documents, the postings of its terms:
sorted word positions, one list a term.  ``phrase_matches`` takes the windows of the
benchmark items; in each shard it starts from a window's rarest term there, shifts
that list by the term's place in the window, and intersects it with the shifted lists
of the other terms, rarest first, until it is empty or the window is found.
``proximity_matches`` finds all of some terms within so many words.  An index split by
document needs no shuffle, and a passage that a third of all documents share costs
only its own postings.

Items travel in blocks of bounded size; a further block is a further pass over the
stored index.  The index keeps the items' terms if their hashes fit a bound, else all.

Defined cases: null or empty texts have no words, no hits and are not contaminated;
items without words match nothing; a null item_id counts as the empty string; items
that share an id are one item; repeated documents are rows of their own; extra
columns are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, with_columns_of
from .kernels import U64, ranges, slices, utf8, word_hashes

WINDOW = 13
#: Bytes of item text in a block, and distinct terms up to which the index keeps the items' terms alone.
BLOCK = 32 << 20
TERMS = 4 << 20
#: Bytes of text in a shard.
SHARD = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of 0-9, a-z and bytes of characters beyond ASCII.
BREAK = np.ones(256, bool)
BREAK[48:58] = BREAK[97:123] = BREAK[128:] = False

INDEX = "doc_ids array<long>, at binary, terms binary, first binary, places binary, hit binary, found array<struct<doc:int,item:string>>"
_found = pa.list_(pa.struct([("doc", pa.int32()), ("item", pa.string())]))
_kinds = pa.schema([("doc_ids", pa.list_(pa.int64())), ("at", pa.binary()), ("terms", pa.binary()), ("first", pa.binary()), ("places", pa.binary()), ("hit", pa.binary()), ("found", _found)])


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the texts' word offsets."""
    data, offsets = utf8(texts)
    h, _, _, at = word_hashes(LOWER[data], offsets, BREAK)
    return h, at


def positional_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """One row a shard: its doc_ids, word offsets, terms (sorted hashes) and positions; only terms of the vocabulary if there is one."""
    spark = docs.sparkSession
    named = spark.sparkContext.broadcast(np.unique(vocabulary)) if vocabulary is not None else None

    def build(batches):
        wanted = named.value if named else None
        quick = None
        if wanted is not None:
            quick = np.zeros(1 << 16, bool)
            quick[(wanted & U64(0xFFFF)).astype(np.int64)] = True
        for b in batches:
            text = b.column(1)
            _, offsets = utf8(text)
            for i, j in slices(offsets, SHARD):
                h, at = term_hashes(text.slice(i, j - i))
                if wanted is None:
                    places = np.arange(len(h))
                else:
                    places = np.flatnonzero(quick[(h & U64(0xFFFF)).astype(np.int64)])
                    spot = np.searchsorted(wanted, h[places])
                    places = places[(spot < len(wanted)) & (wanted[np.minimum(spot, len(wanted) - 1)] == h[places])] if len(wanted) else places[:0]
                terms, which = np.unique(h[places], return_inverse=True)
                order = np.argsort(which.astype(np.uint16) if len(terms) < 1 << 16 else which, kind="stable")
                first = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(terms)))]) if len(terms) else np.zeros(1)
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
                one = lambda x: pa.array([x.tobytes()], pa.binary())
                yield pa.record_batch(
                    [ids, one(at), one(terms), one(first.astype(np.int64)), one(places[order].astype(np.int32)), one(np.zeros(len(h), np.uint8)), pa.array([[]], _found)], schema=_kinds
                )

    return with_columns_of(docs, "doc_id", "text").mapInArrow(build, INDEX)


class Shard:
    """The posting lists of one row of the index."""

    def __init__(self, row: dict):
        self.at = np.frombuffer(row["at"], np.int64)
        self.terms, self.first, self.places = np.frombuffer(row["terms"], U64), np.frombuffer(row["first"], np.int64), np.frombuffer(row["places"], np.int32)

    def postings(self, term) -> np.ndarray:
        i = int(np.searchsorted(self.terms, term))
        return self.places[self.first[i] : self.first[i + 1]] if i < len(self.terms) and self.terms[i] == term else self.places[:0]

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, place, "right") - 1


def shifted_in(starts: np.ndarray, shift: int, places: np.ndarray) -> np.ndarray:
    """Which starts + shift are in the sorted posting list."""
    x = starts + shift
    i = np.searchsorted(places, x)
    return (i < len(places)) & (places[np.minimum(i, len(places) - 1)] == x) if len(places) else np.zeros(len(x), bool)


def occurrences(shard: Shard, item: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, int]]:
    """(first places, length) of the item's windows in the shard, each within one document."""
    w = min(window, len(item))
    lists = [shard.postings(t) for t in item]
    size = np.array([len(x) for x in lists])
    starts = np.arange(len(item) - w + 1)
    alive = np.array([size[s : s + w].min() > 0 for s in starts])
    rarest = np.array([s + int(size[s : s + w].argmin()) for s in starts])
    for r in np.unique(rarest[alive]):
        group = starts[alive & (rarest == r)]
        low, high = int(group[0]), int(group[-1])
        base = lists[r].astype(np.int64) - r  # where the item would begin
        core = sorted(range(high, low + w), key=lambda j: size[j])  # terms of every window of the group
        for j in core:
            if j != r and len(base):
                base = base[shifted_in(base, j, lists[j])]
        if not len(base):
            continue
        match = {j: shifted_in(base, j, lists[j]) for j in range(low, high + w)}
        for s in group:
            good = np.logical_and.reduce([match[j] for j in range(s, s + w)])
            first = base[good] + s
            first = first[shard.doc_of(first) == shard.doc_of(first + w - 1)]
            if len(first):
                yield first, w


class Block:
    """Items, and their windows by term: which items a shard can hold at all is told without looking at each."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.items = items
        size = np.array([len(x) for _, x in items], np.int64)
        self.terms, self.term = np.unique(np.concatenate([x for _, x in items]), return_inverse=True)
        width = np.minimum(window, size)
        self.owner = np.repeat(np.arange(len(items)), size - width + 1)
        self.begin = ranges(np.cumsum(size) - size, size - width + 1)
        self.end = self.begin + width[self.owner]

    def candidates(self, terms: np.ndarray) -> np.ndarray:
        """The items with a window all of whose terms are among the sorted ones given."""
        i = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        total = np.concatenate([[0], np.cumsum((terms[i] == self.terms)[self.term])]) if len(terms) else np.zeros(len(self.term) + 1)
        return np.unique(self.owner[total[self.end] - total[self.begin] == self.end - self.begin])


def phrase_matches(index: DataFrame, items: list[tuple[str, np.ndarray]], window: int = WINDOW) -> DataFrame:
    """The index with the hits of a block of items (id, term hashes) added."""
    block = index.sparkSession.sparkContext.broadcast(Block(items, window))

    def search(batches):
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                step = np.zeros(len(row["hit"]) + 1, np.int64)
                found = {(x["doc"], x["item"]) for x in row["found"]}
                for name, item in (block.value.items[i] for i in block.value.candidates(shard.terms)):
                    for first, w in occurrences(shard, item, window):
                        np.add.at(step, first, 1)
                        np.add.at(step, first + w, -1)
                        found.update((int(d), name) for d in np.unique(shard.doc_of(first)))
                hit = np.frombuffer(row["hit"], np.uint8) | (np.cumsum(step[:-1]) > 0)
                yield pa.RecordBatch.from_pylist([row | {"hit": hit.astype(np.uint8).tobytes(), "found": [{"doc": d, "item": n} for d, n in sorted(found)]}], schema=_kinds)

    return index.mapInArrow(search, INDEX)


def proximity_matches(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id, place: every place of the rarest term with all terms at most ``within`` words away, in the same document."""
    hashes = np.concatenate([term_hashes(pa.array([t]))[0] for t in terms])

    def search(batches):
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                lists = sorted((shard.postings(t).astype(np.int64) for t in hashes), key=len)
                at = lists[0]
                doc = shard.doc_of(at)
                for places in lists[1:]:
                    lo = np.searchsorted(places, np.maximum(at - within, shard.at[doc]))
                    hi = np.searchsorted(places, np.minimum(at + within + 1, shard.at[doc + 1]))
                    at, doc = at[hi > lo], doc[hi > lo]
                yield pa.record_batch([pa.array([row["doc_ids"][d] for d in doc], pa.int64()), pa.array(at - shard.at[doc])], names=["doc_id", "place"])

    return index.mapInArrow(search, "doc_id long, place long")


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Blocks of (item_id, term hashes) of at most ``block`` bytes of text (or one item)."""
    have = {c.lower(): c for c in benchmark.columns}
    name = F.coalesce(F.col(f"`{have['item_id']}`").cast("string"), F.lit(""))
    rows: Iterable = benchmark.select(name.alias("item_id"), F.col(f"`{have['text']}`").cast("string").alias("text")).toLocalIterator()
    out, size = [], 0
    for row in rows:
        h, _ = term_hashes(pa.array([row.text], pa.string()))
        if not len(h):
            continue
        if out and size + len(h) * 8 > block:
            yield out
            out, size = [], 0
        out.append((row.item_id, h))
        size += len(h) * 8
    if out:
        yield out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids with occurring windows), spans (hit word runs) of every row of docs."""
    terms: np.ndarray | None = np.zeros(0, U64)
    for b in item_blocks(benchmark, block):  # the driver holds one block at a time, and terms up to the bound
        terms = np.union1d(terms, np.concatenate([h for _, h in b]))
        if len(terms) > TERMS:
            terms = None
            break
    index = cut(positional_index(docs, terms))
    for i, b in enumerate(item_blocks(benchmark, block)):
        index = phrase_matches(cut(index) if i else index, b, window)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches):
        for b in batches:
            for row in b.to_pylist():
                at, hit = np.frombuffer(row["at"], np.int64), np.frombuffer(row["hit"], np.uint8)
                items: dict[int, list[str]] = {}
                for x in row["found"]:
                    items.setdefault(x["doc"], []).append(x["item"])
                total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                n = len(at) - 1
                spans: list = [[]] * n
                for d in np.flatnonzero(total[at[1:]] > total[at[:-1]]):
                    edge = np.diff(np.concatenate([[0], hit[at[d] : at[d + 1]].astype(np.int8), [0]]))
                    spans[d] = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0))]
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]]), pa.array([items.get(d, []) for d in range(n)], pa.list_(pa.string())), pa.array(spans, span)],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    out = index.mapInArrow(rows, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
    return out.withColumn("items", F.array_sort(F.array_distinct("items")))


def is_contaminated():
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )
