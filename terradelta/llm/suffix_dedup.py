"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

Every byte covered by a string of ``window`` bytes that also starts in a document
with a smaller doc_id is removed.  Strings are judged on the input.

An index gets the distinct runs around a range of anchors (see ``repeats``), in
``SHARDS`` shards by the units they came from.  A shard's suffix array, ordered to the
window's depth, gives its transform; the transform alone gives the LF mapping.  Merging
refines one interleave of all shards, as in Holt and McMillan: it begins with the
shards' suffixes merged by their first eight symbols, and a stable counting sort of the
interleave by the two preceding symbols, followed by the LF mapping, orders it by two
more.  Blocks of the interleave are the intervals of a common prefix; one that has come
to hold a single shard's suffixes needs no more refinement (Egidi and Manzini), and the
step at which that happens is their common prefix with the other shards.  What is left
at the window's depth are the intervals repeated across shards; a shard's own suffix
array gives those within it.  Each interval's least document decides.

Defined cases: a null or empty text has no bytes and keeps none; null doc_ids come
after all others and are equal to each other; rows with one doc_id never remove each
other's bytes; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns_of
from .kernels import U64, ranges
from .repeats import LAST, Spec, Unit, repeated_windows

WINDOW = 50
#: Length of the byte grams that deal windows to indexes.
GRAM = 20
#: Shards of an index.
SHARDS = 4
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def suffix_order(key: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their first ``depth`` symbols, and which differ in these from the one before.

    key: a number that orders positions by their first ``step`` symbols.  Prefix doubling that sorts ties only."""
    n = len(key)
    order = np.argsort(key)
    k = key[order]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    slot = np.arange(n)
    rank = np.zeros(n + depth, np.int64)  # past the end: before all others
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0)) + 1
    while step < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        ahead = min(step, depth - step)
        idx = order[at]
        key = (rank[idx] << 32) | rank[idx + ahead]
        o = np.argsort(key)
        idx, key = idx[o], key[o]
        order[at] = idx
        differs = np.ones(len(at), bool)
        differs[1:] = key[1:] != key[:-1]
        new[at] = differs
        rank[idx] = np.maximum.accumulate(np.where(differs, at, 0)) + 1
        step += ahead
    return order, new


@dataclass
class Transform:
    """The Burrows-Wheeler transform of a shard, and what its suffix array knows: which text position a row is, and
    which rows begin with the window of the row before."""

    symbol: np.ndarray
    order: np.ndarray
    new: np.ndarray
    key: np.ndarray

    def back(self) -> np.ndarray:
        """The LF mapping: the row that begins with the symbol before each row's suffix."""
        out = np.empty(len(self.symbol), np.int32)
        out[np.argsort(self.symbol, kind="stable")] = np.arange(len(out), dtype=np.int32)
        return out


def shard_transform(content: np.ndarray, length: np.ndarray, window: int) -> Transform:
    """Each string is followed by one end mark 0; bytes count from 1 (UTF-8 has no byte 0xFF)."""
    ends = np.cumsum(length + 1)
    n = int(ends[-1])
    text = np.zeros(n + 8, U64)
    put = np.ones(n, bool)
    put[ends - 1] = False
    text[:n][put] = content.astype(U64) + U64(1)
    eight = (text[:-1] << U64(8)) | text[1:]
    eight = (eight[:-2] << U64(16)) | eight[2:]
    eight = ((eight[:-4] << U64(32)) | eight[4:])[:n]
    if window < 8:
        eight &= ~U64((1 << 8 * (8 - window)) - 1)
    order, new = suffix_order(eight, min(8, window), window)
    text = text[:n].astype(np.uint8)
    return Transform(text[order - 1], order.astype(np.int32), new, eight[order])


def interleave(shards: list[Transform], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, common): the rows whose windows stand in several shards, by blocks of equal ones, and for every row
    how many symbols at least it shares with another shard.  Rows are numbered through all shards."""
    base = np.cumsum([0, *(len(s.symbol) for s in shards)])
    symbol = np.concatenate([s.symbol for s in shards])
    back = np.concatenate([s.back() + np.int32(b) for s, b in zip(shards, base)])
    before = symbol[back]
    two = np.where((symbol > 0) & (before > 0), before.astype(np.uint16) << 8 | symbol, np.uint16(0))
    back2 = back[back]
    common = np.zeros(len(symbol), np.uint8)
    key = np.concatenate([s.key for s in shards])
    row = np.argsort(key, kind="stable").astype(np.int32)  # a merge of the shards' rows, which are in order
    key = key[row]
    new = np.ones(len(row), bool)
    new[1:] = key[1:] != key[:-1]
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), np.diff(base))[row]
    block, depth = np.cumsum(new, dtype=np.int32), min(8, window)
    ended = np.zeros(len(key), bool)  # an end mark among the first symbols
    for i in range(8 - depth, 8):
        ended |= (key >> U64(8 * i)) & U64(255) == 0
    del key
    while True:
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(new)))
        mixed = np.repeat(z[begin] != z[begin + size - 1], size) if len(begin) else new
        if ended is not None:
            mixed, ended = mixed & ~ended, None
        if not mixed.all():
            row, z, block = row[mixed], z[mixed], block[mixed]
        common[row] = depth
        if depth == window or not len(row):
            return row, block, common
        step = 2 if window - depth > 1 else 1
        c = (two if step == 2 else symbol)[row]
        order = np.argsort(c, kind="stable")
        order = order[int(np.searchsorted(c[order], 0, "right")) :]
        c, z, b, row = c[order], z[order], block[order], (back2 if step == 2 else back)[row[order]]
        new = np.ones(len(row), bool)
        new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        block = np.cumsum(new, dtype=np.int32)
        depth += step


def merge_shards(content: np.ndarray, length: np.ndarray, least: np.ndarray, times: np.ndarray, spec: Spec) -> np.ndarray:
    """For each window of each string the least document of its interval, or LAST if it stands once."""
    w, ends = spec.window, np.cumsum(length)
    share = np.searchsorted(ends, ends[-1] * np.arange(1, SHARDS) / SHARDS) if len(ends) else []
    cuts = np.unique([0, *share, len(length)])
    shards, rows, base = [], [], 0
    for i, j in zip(cuts, cuts[1:]):
        n = length[i:j]
        t = shard_transform(content[ends[i] - n[0] : ends[j - 1]], n, w)
        place = np.empty(len(t.order), np.int64)
        place[t.order] = np.arange(len(t.order))
        rows.append(place[ranges(np.cumsum(n + 1) - n - 1, n - w + 1)] + base)
        shards.append(t)
        base += len(t.order)
    at = np.concatenate(rows)
    string = np.repeat(np.arange(len(length)), length - w + 1)
    group = np.cumsum(np.concatenate([t.new for t in shards])) - 1  # the shards' own intervals
    row, block, _ = interleave(shards, w)
    if len(row):
        block = block + (group[-1] + 1)
        group[row] = block
    group = group[at]
    order = np.argsort(group)
    begin = np.flatnonzero(np.diff(group[order], prepend=-1))
    owner = string[order]
    weight = np.add.reduceat(times[owner], begin)
    low = np.where(weight > 1, np.minimum.reduceat(least[owner], begin), LAST)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(begin, len(order))))
    return out


def spans_and_kept(unit: Unit | None, covered: np.ndarray | None) -> pa.Table:
    """Per document its maximal removed runs and the bytes left."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())]
    if unit is None:
        return pa.schema(kinds).empty_table()
    at, n = unit.offsets, len(unit.offsets) - 1
    before = np.zeros(len(covered), bool)
    before[1:] = covered[:-1]
    inner = at[(at > 0) & (at < len(covered))]
    before[inner] = False
    start = np.flatnonzero(covered & ~before)
    after = np.zeros(len(covered), bool)
    after[:-1] = covered[1:]
    after[inner - 1] = False
    end = np.flatnonzero(covered & ~after) + 1
    owner = np.searchsorted(at, start, "right") - 1
    # an empty text shares its offset with the next one; the last of equals owns the bytes
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - at[owner]), pa.array(end - at[owner])], fields=list(span))
    )
    left = unit.data[~covered]
    kept_at = np.concatenate([np.zeros(1, np.int32), np.cumsum(~covered, dtype=np.int32)])[at]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept_at.astype(np.int64).tobytes()), pa.py_buffer(left.tobytes())]).cast(pa.binary())
    return pa.table([unit.rows["doc_id"].combine_chunks(), pa.array(np.diff(at)), spans, kept], names=[k for k, _ in kinds])


def suffix_array_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, the removed byte spans and the bytes kept, for every row of docs."""
    rows = with_columns_of(docs, "doc_id", "text")
    return repeated_windows(rows, Spec("byte", window, gram, True), merge_shards, spans_and_kept, RESULT, parts)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
