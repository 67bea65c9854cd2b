import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.llm.substring_dedup import substring_dedup
from terradelta.llm.suffix_dedup import suffix_array_dedup

SCHEMA = "doc_id long, text string, lang string, unit int, key string"


def corpus(seed, n=40):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "über", "naïve", "x", "passage", "1234"] + [f"w{i}" for i in range(60)]
    words = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [words(60) for _ in range(4)]
    out = []
    for i in range(n):
        kind = r.randrange(6)
        text = words(r.randrange(1, 120))
        if kind == 1 and out:
            text = r.choice(out)[1]
        if kind == 2 and out and out[-1][1]:
            t = r.choice([x[1] for x in out if x[1]]).split(" ")
            t[r.randrange(len(t))] = "edited"
            text = " ".join(t)
        if kind == 3:
            text = text + "\n" + r.choice(shared) + " " + words(10)
        if kind == 4:
            text = "ab " * r.randrange(1, 80)
        out.append((i * 3, text))
    out += [(1, None), (2, ""), (4, "   "), (None, shared[0]), (5, shared[0]), (5, shared[0])]
    r.shuffle(out)
    return [(a, b, "en", 1, "k") for a, b in out]


def brute_bytes(rows, w):
    first = {}
    key = lambda d: (d is None, d or 0)
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            s = b[i : i + w]
            first[s] = min(first.get(s, key(d)), key(d))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - w + 1):
            if first[b[i : i + w]] < key(d):
                gone[i : i + w] = [True] * w
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[x] for x in gone))]
        out.append((d, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def brute_words(rows, w):
    count = {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for _, t, *_ in rows:
        s = split(t)
        for i in range(len(s) - w + 1):
            count[tuple(s[i : i + w])] = count.get(tuple(s[i : i + w]), 0) + 1
    out = []
    for d, t, *_ in rows:
        s = split(t)
        gone = [False] * len(s)
        for i in range(len(s) - w + 1):
            if count[tuple(s[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append((d, len(s), sum(gone), " ".join(x for x, g in zip(s, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,window,gram,parts", [(1, 50, 20, 3), (2, 12, 5, 1), (3, 50, 24, 7)])
def test_suffix_dedup_equals_brute_force(spark, seed, window, gram, parts):
    rows = corpus(seed)
    got = suffix_array_dedup(spark.createDataFrame(rows, SCHEMA), window, gram, parts).collect()
    assert sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got), key=repr) == brute_bytes(rows, window)


@pytest.mark.parametrize("seed,window,gram,parts", [(1, 35, 8, 3), (2, 6, 3, 1), (3, 12, 4, 7)])
def test_substring_dedup_equals_brute_force(spark, seed, window, gram, parts):
    rows = corpus(seed)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), window, gram, parts).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got), key=repr) == brute_words(rows, window)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_array_dedup(none).count() == 0
    assert substring_dedup(none).count() == 0


def test_very_long_text_is_worked_in_pieces(spark, monkeypatch):
    from terradelta.llm import repeats

    monkeypatch.setattr(repeats, "PIECE", 300)
    rows = corpus(5, 12)
    from terradelta.llm.repeats import Spec, Unit
    import pyarrow as pa

    text = " ".join(t or "" for _, t, *_ in rows)
    unit = Unit(pa.table({"key": pa.array([1], pa.int64()), "doc_id": pa.array([1], pa.int64()), "text": [text]}), Spec("byte", 50, 20, True))
    b = text.encode()
    assert int(unit.count.sum()) == len(b) - 49
    seen = {}
    for f, c, e in zip(unit.first, unit.count, zip(unit.head.tolist(), unit.content.tolist())):
        seen.setdefault(b[f : f + c + 49], set()).add(e)
    assert all(len(v) == 1 for v in seen.values())


def strings(r, w):
    base = bytes(r.choice(b"ab") for _ in range(300))
    out = []
    for _ in range(40):
        at = r.randrange(200)
        out.append(base[at : at + w + r.randrange(20)] if r.random() < 0.5 else bytes(r.choice(b"abc") for _ in range(w + r.randrange(30))))
    return out


@pytest.mark.parametrize("window", [50, 12, 9, 5])
def test_merged_transforms_and_statistics_equal_brute_force(window):
    from terradelta.llm.repeats import LAST, Spec
    from terradelta.llm.substring_dedup import matching_statistics
    from terradelta.llm.suffix_dedup import merge_shards

    r = random.Random(window)
    found = strings(r, window)
    content, length = np.frombuffer(b"".join(found), np.uint8), np.array([len(x) for x in found])
    least, times = np.array([r.randrange(9) for _ in found]), np.array([1 + (r.random() < 0.1) for _ in found])
    count, low = Counter(), {}
    for x, d, t in zip(found, least, times):
        for i in range(len(x)):
            for k in range(1, min(window, len(x) - i) + 1):
                count[x[i : i + k]] += t
            low[x[i : i + window]] = min(low.get(x[i : i + window], LAST), d)
    starts = [(x, i) for x in found for i in range(len(x) - window + 1)]
    got = merge_shards(content, length, least, times, Spec("byte", window, 3, True))
    assert got.tolist() == [low[x[i : i + window]] if count[x[i : i + window]] > 1 else LAST for x, i in starts]
    got = matching_statistics(content.astype(np.uint64), length, least, times, Spec("word", window, 3, False))
    want = [max([k for k in range(1, window + 1) if count[x[i : i + k]] > 1], default=0) for x, i in starts]
    assert all(g == w or g < w < window for g, w in zip(got, want))


def test_a_wrong_suffix_order_changes_the_merge(monkeypatch):
    from terradelta.llm import suffix_dedup
    from terradelta.llm.repeats import Spec

    found = strings(random.Random(2), 12)
    args = np.frombuffer(b"".join(found), np.uint8), np.array([len(x) for x in found]), np.arange(40), np.ones(40, np.int64), Spec("byte", 12, 3, True)
    right = suffix_dedup.merge_shards(*args)
    real = suffix_dedup.suffix_order

    def wrong(key, step, depth):
        order, new = real(key, step, depth)
        return np.random.default_rng(0).permutation(order), new

    monkeypatch.setattr(suffix_dedup, "suffix_order", wrong)
    assert (suffix_dedup.merge_shards(*args) != right).any()


def test_common_prefixes_of_the_interleave():
    from terradelta.llm.suffix_dedup import interleave, shard_transform

    found = strings(random.Random(3), 12)
    shards = [shard_transform(np.frombuffer(b"".join(x), np.uint8), np.array([len(y) for y in x]), 12) for x in (found[:20], found[20:])]
    row, block, common = interleave(shards, 12)
    texts = [b"\0".join(x) + b"\0" for x in (found[:20], found[20:])]
    base = 0
    for mine, other, t in zip(texts, texts[::-1], shards):
        for i, place in enumerate(t.order.tolist()):
            here = mine[place : place + 12].split(b"\0")[0]
            k = max(k for k in range(len(here) + 1) if here[:k] in other)
            assert k - 1 <= common[base + i] <= k or k < 8 and not common[base + i]
        base += len(t.order)
    assert len(row) == (common == 12).sum()


def test_nothing_is_removed_without_the_index(spark, monkeypatch):
    from terradelta.llm import repeats, substring_dedup, suffix_dedup

    rows = spark.createDataFrame(corpus(7, 20), SCHEMA)
    none = lambda value: lambda content, length, least, times, spec: np.full(int((length - spec.window + 1).sum()), value)
    out = suffix_dedup.repeated_windows(rows.select("doc_id", "text"), repeats.Spec("byte", 50, 20, True), none(repeats.LAST), suffix_dedup.spans_and_kept, suffix_dedup.RESULT, 3)
    assert not any(r.spans for r in out.collect())
    out = suffix_dedup.repeated_windows(rows.select("doc_id", "text"), repeats.Spec("word", 12, 5, False), none(0), substring_dedup.words_kept, substring_dedup.RESULT, 3)
    assert not any(r.spans for r in out.collect())


def test_runs_are_told_apart_unit_by_unit():
    from terradelta.llm.repeats import distinct_runs

    units = np.frombuffer(b"abcabdabcxyzabd", np.uint8)
    first, length, same = np.arange(0, 15, 3), np.full(5, 3), np.zeros(5, np.uint64)
    entry, sample = distinct_runs(units, first, length, same, same)  # all hashes agree
    assert entry.tolist() == [0, 1, 0, 2, 1] and sample.tolist() == [0, 1, 3]


def thue_morse(flip, n=1024):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_words_that_a_polynomial_takes_for_one_another(spark):
    rows = [(i, " ".join([f"w{k}" for k in range(20)] + [thue_morse(i)] + [f"v{k}" for k in range(20)]), "en", 1, "k") for i in range(2)]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), parts=2).collect()
    assert [r.spans for r in got] == [[], []]
