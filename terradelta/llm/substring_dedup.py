"""Substring dedup: a compressed FM-index per shard, searched backward over wavelet trees.

Every word covered by a window of ``window`` words whose word sequence also starts
anywhere else, the same document included, is removed.  Windows are judged on the
input; words are compared by 64-bit hash, position by position, so two different
windows count as equal only if the hashes of two different words collide.

A shard is the distinct runs of text around a range of anchors (see ``repeats``), so
all copies of a window are in one shard.  The shard's words become an FM-index: the
Burrows-Wheeler transform of the runs as a wavelet matrix of bit vectors with 64-bit
blocks and block ranks, and prefix sums of how often each run occurs.  The runs then
stream past it.  Backward search extends a match to the left while its interval holds
at least two occurrences; where it can't, the match gives up words at its right end.
That yields the matching statistics: for each place the most words, up to ``window``,
that begin there and occur twice.  Windows whose statistic reaches ``window`` go.

Defined cases: a null or empty text has no words and keeps none; extra columns are
ignored; repeated rows count as different places; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns_of
from .kernels import U64, ranges
from .repeats import Spec, Unit, repeated_windows
from .suffix_dedup import suffix_order

WINDOW = 35
#: Length of the word grams that deal windows to shards.
GRAM = 8
RESULT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"


class Bits:
    """A bit vector with rank in constant time: 64-bit blocks and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.block = np.zeros(len(bits) // 64 + 1, U64)
        self.block.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.block))[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        b = i >> 6
        return self.before[b] + np.bitwise_count(self.block[b] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))


class FMIndex:
    """Words 1.. with 0 between segments; the wavelet matrix holds the transform, a level for each bit."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):  # depth: of the longest match
        n = len(text)
        order, _ = suffix_order(text, 1, depth)
        bwt = text[order - 1]
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])
        top = int(text.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        self.n, self.depth = n, max(1, (top - 1).bit_length())
        self.levels, self.zeros, x = [], [], bwt
        for d in range(self.depth - 1, -1, -1):
            bit = (x >> d) & 1
            self.levels.append(Bits(bit.astype(bool)))
            self.zeros.append(int(n - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        begin = np.flatnonzero(np.diff(x, prepend=-1))
        self.block = np.zeros(top, np.int64)  # where a word's block starts below the last level
        self.block[x[begin]] = begin

    def back(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The row bound reached from i by putting word in front."""
        at = i
        for d, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros):
            ones = bits.ones(at)
            at = np.where((word >> d) & 1, zeros + ones, at - ones)
        return self.first[word] + at - self.block[word]


def matching_statistics(content: np.ndarray, length: np.ndarray, least: np.ndarray, times: np.ndarray, spec: Spec) -> np.ndarray:
    """For each window of each run the most words, up to a window, that begin at its start and occur at least twice.

    A run is left where what remains before the match is too short for a window: there the statistic stays 0."""
    _, dense = np.unique(content, return_inverse=True)
    begin = np.cumsum(length + 1) - length - 1
    text = np.zeros(int(length.sum()) + len(length), np.int64)
    text[ranges(begin, length)] = dense + 1
    w = spec.window
    index = FMIndex(text, np.repeat(times, length + 1), int(length.max()))
    n_windows = length - w + 1
    first = np.cumsum(n_windows) - n_windows
    out = np.zeros(int(n_windows.sum()), np.uint8)
    # all runs go in step: run, right end, left end, and the interval of text[left:right]
    run = np.arange(len(length))
    right, left = length.copy(), length.copy()
    lo, hi = np.zeros(len(run), np.int64), np.full(len(run), index.n, np.int64)
    while len(run):
        word = text[begin[run] + left - 1]
        both = index.back(np.concatenate([word, word]), np.concatenate([lo, hi]))
        nlo, nhi = both[: len(run)], both[len(run) :]
        good = index.weight[nhi] - index.weight[nlo] >= 2
        # a match of a whole window makes way for the next one; one that can't be extended gives up its last word
        fresh = np.where(good, right, np.minimum(left - 1 + w, right - 1))
        lo, hi = np.where(good, nlo, 0), np.where(good, nhi, index.n)
        left = np.where(good, left - 1, fresh)
        right = fresh
        at = np.flatnonzero(good & (left < n_windows[run]))
        place = first[run[at]] + left[at]
        out[place] = np.maximum(out[place], np.minimum(right - left, w)[at])  # a match begun anew passes places again
        on = (left > 0) & (right >= w)
        run, right, left, lo, hi = run[on], right[on], left[on], lo[on], hi[on]
    return out


def words_kept(unit: Unit | None, covered: np.ndarray | None) -> pa.Table:
    """Per document the removed word spans and the kept words joined by one space."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.string())]
    if unit is None:
        return pa.schema(kinds).empty_table()
    at, n = unit.at, len(unit.at) - 1
    before, after = np.zeros(len(covered), bool), np.zeros(len(covered), bool)
    before[1:], after[:-1] = covered[:-1], covered[1:]
    inner = at[(at > 0) & (at < len(covered))]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
    owner = np.searchsorted(at, start, "right") - 1
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - at[owner]), pa.array(end - at[owner])], fields=list(span))
    )
    kept = np.flatnonzero(~covered)
    doc = np.searchsorted(at, kept, "right") - 1
    last = np.append(doc[1:] != doc[:-1], True) if len(kept) else np.zeros(0, bool)
    size = unit.ends[kept] - unit.starts[kept]
    wide = size + ~last
    out = np.full(int(wide.sum()), 0x20, np.uint8)
    out[ranges(np.cumsum(wide) - wide, size)] = unit.data[ranges(unit.starts[kept], size)]
    text_at = np.concatenate([[0], np.cumsum(wide)])[np.searchsorted(doc, np.arange(n + 1))]
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(text_at.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())
    return pa.table([unit.rows["doc_id"].combine_chunks(), pa.array(np.diff(at)), spans, text], names=[k for k, _ in kinds])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, parts: int | None = None) -> DataFrame:
    """doc_id, n_words, the removed word spans and the text kept, for every row of docs."""
    rows = with_columns_of(docs, "doc_id", "text")
    return repeated_windows(rows, Spec("word", window, gram, False), matching_statistics, words_kept, RESULT, parts)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
