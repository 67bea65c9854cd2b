"""Finding every repeated window of W units (bytes or words) over a whole corpus.

Each window of W units belongs to one *anchor*: the q-gram in it with the least
hash.  Equal windows have equal anchors, so all copies of a window meet under one
anchor, wherever they stand.  Consecutive windows with one anchor form a *run*.
Rows are dealt by hash into *units* of a bounded size, and anchors into buckets by
hash; what passes between them is packed arrays.

1. Each unit sends the hashes of its distinct anchors to the buckets, which answer
   whether another unit has the anchor too.  A run whose anchor stands nowhere else
   has no window that does; this only chooses what is looked at.
2. Each unit sends one copy of every distinct run whose anchor stands elsewhere, there
   or in the unit itself, with the least document and the number of its occurrences.
3. A shard of the index takes the runs of one range of anchors, keeps each distinct
   one once, and ``resolve`` answers with one value a window.
4. Each unit recomputes its runs, applies the answers, and makes the result.  Nothing
   is removed but on the index's word.

Runs are told apart by two hashes, and those that agree are compared unit by unit.
Recomputing runs is cheap and deterministic, so a lost executor costs only its own
groups, and no list of occurrences is ever gathered for a key: rows of one doc_id, or
of none, are dealt over units like any others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for
from .kernels import U64, RunHash, mix, ranges, release, slices, sliding_min, utf8, word_hashes

LAST = np.iinfo(np.int64).max
LOW = U64((1 << 26) - 1)
#: Longer texts are worked on in pieces of so many units that overlap by window - 1.
PIECE = 1 << 22
#: Stored bytes of input in a unit.
EACH = 3 << 20


@dataclass(frozen=True)
class Spec:
    """kind: "byte" or "word"; earlier: only copies in a smaller doc_id count, else any other copy does."""

    kind: str
    window: int
    gram: int
    earlier: bool


def runs_of(units: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash and content hash of every run; ``at``: offsets of the texts in units."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    if len(units) < window:
        return empty
    hashes = RunHash(units)
    gram_hash = hashes.fixed(gram)
    place = np.arange(len(gram_hash), dtype=U64)
    # the place breaks ties between equal q-grams of a window: the leftmost counts
    least = sliding_min((gram_hash & ~LOW) | (place & LOW), window - gram + 1)
    anchor = (least & LOW).astype(np.int64)
    long = np.flatnonzero(np.diff(at) >= window)
    step = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(step, at[long], 1)
    np.add.at(step, at[long + 1] - window + 1, -1)
    p = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    if not len(p):
        return empty
    a = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    if len(long) > 1:  # a run never spans two texts
        opens = np.zeros(len(units) + 1, bool)
        opens[at] = True
        new |= opens[p]
    f = np.flatnonzero(new)
    first, count = p[f], np.diff(np.append(f, len(p)))
    # anchors are least hashes, so their own values would crowd the first buckets
    return first, count, mix(gram_hash[a[f]]), hashes.of(first, first + count + window - 1)


def same_units(units: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the runs of na units at a equal those of nb at b, unit by unit."""
    out = na == nb
    at = np.flatnonzero(out)
    total = np.cumsum(na[at])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 20), "right")))
        part = at[i:j]
        n = na[part]
        equal = units[ranges(a[part], n)] == units[ranges(b[part], n)]
        out[part] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        i = j
    return out


def distinct_runs(units: np.ndarray, first: np.ndarray, length: np.ndarray, major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every run and the first run of each group, groups in the order of (major, minor) hash.

    Runs of one group are equal, unit by unit; where hashes agree and runs don't, the runs' own order is the minor one."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(major)
    m = major[order]
    new = np.ones(len(order), bool)
    new[1:] = m[1:] != m[:-1]
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    if len(slots):
        idx = order[slots]
        idx = idx[np.lexsort((minor[idx], major[idx]))]
        order[slots] = idx
        a, b = major[idx], minor[idx]
        differs = np.ones(len(idx), bool)
        differs[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[slots] = differs
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    sample = np.minimum.reduceat(order, np.flatnonzero(new))
    others = np.flatnonzero(sample[entry] != np.arange(len(order)))
    twin = sample[entry[others]]
    same = same_units(units, first[others], first[twin], length[others], length[twin])
    if not same.all():
        inside = np.flatnonzero(np.isin(entry, entry[others[~same]]))
        content = [units[first[i] : first[i] + length[i]].tobytes() for i in inside]
        rank = {c: r for r, c in enumerate(sorted(set(content)))}
        minor = minor.copy()
        minor[inside] = [rank[c] for c in content]
        return distinct_runs(units, first, length, major, minor)
    return entry, sample


class Unit:
    """The rows of one unit and their runs."""

    def __init__(self, rows: pa.Table, spec: Spec):
        self.rows, self.spec = rows, spec
        self.key = rows["key"].to_numpy()
        self.data, self.offsets = utf8(rows["text"])
        if spec.kind == "word":
            parts, n = [], 0
            at = [np.zeros(1, np.int64)]
            for i, j in slices(self.offsets):
                b0 = self.offsets[i]
                h, s, e, w = word_hashes(self.data[b0 : self.offsets[j]], self.offsets[i : j + 1] - b0)
                parts.append((h, s + b0, e + b0))
                at.append(w[1:] + n)
                n += len(h)
            self.units, self.starts, self.ends = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, d) for k, d in ((0, U64), (1, np.int64), (2, np.int64)))
            self.at = np.concatenate(at)
        else:
            self.units, self.at = self.data, self.offsets
        found = []
        for i, j in slices(self.at, 1 << 18):
            lo, hi = int(self.at[i]), int(self.at[j])
            for p in range(lo, max(lo + 1, hi), PIECE):
                q = hi if hi - p <= PIECE + spec.window else p + PIECE + spec.window - 1
                at = self.at[i : j + 1] - lo if q == hi and p == lo else np.array([0, q - p])
                f, c, h, s = runs_of(self.units[p:q], at, spec.window, spec.gram)
                found.append((f + p, c, h, s))
                if q == hi:
                    break
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
        self.first, self.count, self.head, self.content = (np.concatenate([x[k] for x in found]) if found else empty[k] for k in range(4))

    def heads(self) -> np.ndarray:
        """The distinct anchors, in order."""
        return np.unique(self.head)

    def choose(self, elsewhere: np.ndarray) -> None:
        """Groups the runs into entries; those to send have an anchor that stands elsewhere, as told for each of heads(), or here."""
        length = self.count + self.spec.window - 1
        self.doc = np.searchsorted(self.at, self.first, "right") - 1
        heads, which = np.unique(self.head, return_inverse=True)
        if self.spec.earlier:  # places in one document don't count
            low, high = np.full(len(heads), LAST), np.full(len(heads), np.iinfo(np.int64).min)
            np.minimum.at(low, which, self.key[self.doc])
            np.maximum.at(high, which, self.key[self.doc])
            here = low < high
        else:
            here = np.bincount(which, minlength=len(heads)) > 1
        self.sent = np.flatnonzero((elsewhere | here)[which])  # runs
        s = self.sent
        self.entry, sample = distinct_runs(self.units, self.first[s], length[s], self.head[s], self.content[s])
        self.sample = s[sample]
        self.times = np.bincount(self.entry, minlength=len(sample))
        self.least = np.full(len(sample), LAST)
        np.minimum.at(self.least, self.entry, self.key[self.doc[s]])

    def covered(self, value: np.ndarray) -> np.ndarray:
        """One boolean a unit: covered by a window that is to go.  value: the index's answer for each window of each entry."""
        spec = self.spec
        step = np.zeros(len(self.units) + 1, np.int32)
        if len(self.sent):
            many = self.count[self.sample]
            begin = np.cumsum(many) - many
            count = self.count[self.sent]
            answer = value[ranges(begin[self.entry], count)]
            if spec.earlier:
                # 2: in a smaller document than any here; 1: repeated, so in the least document here, which keeps it
                gone = answer > np.repeat(self.key[self.doc[self.sent]] == self.least[self.entry], count)
            else:
                gone = answer >= spec.window
            w = ranges(self.first[self.sent], count)[gone]
            np.add.at(step, w, 1)
            np.add.at(step, w + spec.window, -1)
        return np.cumsum(step[:-1], dtype=np.int32) > 0


def dealt(head: np.ndarray, groups: int):
    """(group, first, last + 1) of every group of the sorted hashes."""
    group = ((head >> U64(32)) * U64(groups) >> U64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    return zip(group[edges].tolist(), edges.tolist(), np.append(edges[1:], len(head)).tolist()) if len(head) else ()


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def _bytes(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) if x.as_buffer().size else np.zeros(0, dtype) for x in column]


def _answers(rows: pa.Table, kind: int) -> np.ndarray:
    """The answers of one kind to a unit, joined in the order of groups."""
    table = rows.filter(pa.array(rows["kind"].to_numpy() == kind)).sort_by("bucket") if rows.num_rows else rows
    found = _bytes(table["body"], np.uint8) if table.num_rows else []
    return np.concatenate(found) if found else np.zeros(0, np.uint8)


def released(f: Callable) -> Callable:
    """f, after which a worker gives freed memory back."""

    def run(*tables: pa.Table) -> pa.Table:
        out = f(*tables)
        release()
        return out

    return (lambda left, right: run(left, right)) if f.__code__.co_argcount == 2 else lambda rows: run(rows)


def repeated_windows(
    docs: DataFrame, spec: Spec, resolve: Callable, finish: Callable[[Unit, np.ndarray], pa.Table], result: str, parts: int | None = None
) -> DataFrame:
    """docs has doc_id and text.  ``resolve(units, length, least, times, spec)`` is the index of one range of anchors over
    distinct runs, see the operators; ``finish(unit, covered)`` makes the result's rows of a unit, of schema ``result``."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = parts or parts_for(docs, EACH, cores)
    buckets, shards = max(parts // 4, min(parts, cores)), parts
    key = F.coalesce(F.col("doc_id"), F.lit(int(LAST)))
    unit = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(parts)).cast("int")
    rows = docs.select("doc_id", "text", key.alias("key"), unit.alias("unit"))
    i4, b8 = pa.int32(), pa.binary()

    @released
    def send(table: pa.Table) -> pa.Table:
        heads = Unit(table, spec).heads()
        unit = table["unit"][0].as_py()
        return _rows(["bucket", "unit", "body"], [i4, i4, b8], [(k, unit, heads[i:j].tobytes()) for k, i, j in dealt(heads, buckets)])

    @released
    def judge(table: pa.Table) -> pa.Table:
        found = _bytes(table["body"], U64)
        heads = np.concatenate(found)
        order = np.argsort(heads)
        h = heads[order]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        out = np.empty(len(h), np.uint8)
        out[order] = twice
        cuts = np.cumsum([0, *map(len, found)])
        bucket = table["bucket"][0].as_py()
        return _rows(["unit", "kind", "bucket", "body"], [i4, i4, i4, b8], [(u, 1, bucket, out[i:j].tobytes()) for u, i, j in zip(table["unit"].to_pylist(), cuts, cuts[1:])])

    @released
    def ship(table: pa.Table, answers: pa.Table) -> pa.Table:
        names, kinds = ["bucket", "unit", "length", "least", "times", "content"], [i4, i4, b8, b8, b8, b8]
        if not table.num_rows:
            return _rows(names, kinds, [])
        u = Unit(table, spec)
        u.choose(_answers(answers, 1).astype(bool))
        out, unit = [], table["unit"][0].as_py()
        for k, i, j in dealt(u.head[u.sample], shards):
            s = u.sample[i:j]
            length = u.count[s] + spec.window - 1
            body = u.units[ranges(u.first[s], length)]
            out.append((k, unit, length.astype(np.int32).tobytes(), u.least[i:j].tobytes(), np.minimum(u.times[i:j], 2).astype(np.int8).tobytes(), body.tobytes()))
        return _rows(names, kinds, out)

    @released
    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        found = [_bytes(table[n], d) for n, d in (("length", np.int32), ("least", np.int64), ("times", np.int8), ("content", np.uint8 if spec.kind == "byte" else U64))]
        cuts = np.cumsum([0, *map(len, found[0])])
        hashes = np.concatenate([RunHash(x).of(np.cumsum(n) - n, np.cumsum(n)) for x, n in zip(found[3], found[0])])
        length, least, times, content = map(np.concatenate, found)
        length = length.astype(np.int64)
        first = np.cumsum(length) - length
        entry, sample = distinct_runs(content, first, length, hashes, length.astype(U64))
        # the distinct runs, each where the first unit that has it sent it
        order = np.argsort(sample)
        sample, place = sample[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        entry = place[entry]
        low = np.full(len(sample), LAST)
        np.minimum.at(low, entry, least)
        many = length - spec.window + 1
        own = many[sample]
        value = resolve(content[ranges(first[sample], length[sample])], length[sample], low, np.bincount(entry, times).astype(np.int64), spec)
        value = value[ranges((np.cumsum(own) - own)[entry], many)]
        if spec.earlier:  # to each unit, of its own least document
            value = np.where(value < np.repeat(least, many), 2, value < LAST)
        value, ends = value.astype(np.uint8), np.concatenate([[0], np.cumsum(many)])
        bucket = table["bucket"][0].as_py()
        return _rows(["unit", "kind", "bucket", "body"], [i4, i4, i4, b8], [(u, 2, bucket, value[ends[i] : ends[j]].tobytes()) for u, i, j in zip(table["unit"].to_pylist(), cuts, cuts[1:])])

    @released
    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finish(None, None)
        u = Unit(table, spec)
        u.choose(_answers(answers, 1).astype(bool))
        return finish(u, u.covered(_answers(answers, 2)))

    grouped = rows.groupBy("unit")
    answer = "unit int, kind int, bucket int, body binary"
    known = grouped.applyInArrow(send, "bucket int, unit int, body binary").groupBy("bucket").applyInArrow(judge, answer)
    shipped = grouped.cogroup(known.groupBy("unit")).applyInArrow(ship, "bucket int, unit int, length binary, least binary, times binary, content binary")
    found = shipped.groupBy("bucket").applyInArrow(index, answer)
    return grouped.cogroup(known.unionByName(found).groupBy("unit")).applyInArrow(apply, result)
