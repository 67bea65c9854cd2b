"""Each operator against a brute-force version, and on nulls, empties, ties, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terradelta.llm import decontamination, fingerprints, html_text, mixing, pii, quotation, simhash, toxicity
from terradelta.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, unit string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 5, "x", "y", "z") for i, t, s in rows], DOCS)


def texts(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "THE", "of,", "x1"]
    make = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    out = [(i, make(r.choice([1, 2, 5, 30, 80, 200])), r.choice(["a", "b", "b", "b", None])) for i in range(n)]
    out += [(1000 + i, out[3][1], "b") for i in range(4)] + [(2000, None, "a"), (2001, "", None), (2002, " \n\t", "a"), (None, "x y z", "c")]
    base = make(150).split()
    for i in range(80):
        w = list(base)
        w[r.randrange(150)] = "edit"
        out.append((3000 + i, " ".join(w), "c"))
    r.shuffle(out)
    return out


# SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    rows = texts(1)
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(docs(spark, rows)).collect()}
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    roots = brute_classes(fps)
    least = {c: min((i for (i, _, _), k in zip(rows, roots) if k == c and i is not None), default=None) for c in set(roots)}
    assert got == {(i, f, least[c]) for (i, _, _), f, c in zip(rows, fps, roots)}


@pytest.mark.parametrize("r,long", [(2, 8192), (2, 10), (3, 20), (4, 8192), (5, 8192)])
def test_links_give_all_components(spark, r, long):
    g = random.Random(r)
    centres = [g.getrandbits(64) for _ in range(30)]
    fps = sorted({c ^ (1 << g.randrange(64)) ^ (1 << g.randrange(64)) ^ (1 << g.randrange(64)) for c in centres for _ in range(12)} | {1 << i for i in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = connected_components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), r, long)).collect()
    root = {x.node: x.root for x in found}
    classes = brute_classes(fps)
    pairs = lambda key: {frozenset(i for i, k in enumerate(key) if k == c) for c in set(key)}
    assert pairs([root.get(s, s) for s in signed]) == pairs(classes)


def test_position_tuples_cover():
    from itertools import combinations

    for r in (2, 3, 4, 5):
        family = [set(t) for t in simhash.tuples(r)]
        assert all(any(t <= set(s) for t in family) for s in combinations(range(8), 5))


# decontamination


def brute_hits(text, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = split(text), set(), set()
    for name, item in items:
        v = split(item)
        k = min(window, len(v))
        for s in range(len(v) - k + 1) if v else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[s : s + k]:
                    hit.update(range(i, i + k))
                    names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


def test_decontamination_tells_words_apart_that_a_polynomial_does_not(spark):
    word = lambda flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024))
    bench = spark.createDataFrame([(1, word(0))], "item_id long, text string")
    got = decontamination.decontaminate(docs(spark, [(1, f"x {word(1)} y", "a"), (2, f"x {word(0)} y", "a"), (2, f"x {word(0)} y", "a")]), bench).collect()
    assert sorted((r.doc_id, r.n_hit) for r in got) == [(1, 0), (2, 1), (2, 1)]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, block):
    r = random.Random(4)
    make = lambda k: " ".join(r.choice(["The", "of", "and", "é", "a", "b-c", "x9"] + [f"w{i}" for i in range(9)]) for _ in range(k))
    items = [(i, make(k)) for i, k in enumerate([40, 13, 5, 1, 14, 30, 3])] + [(7, None), (8, "..."), (None, make(15)), (1, make(20))]
    rows = [(i, make(60) + " " + " ".join((r.choice(items)[1] or "").split()[: r.choice([4, 13, 20, 40])]) + " " + make(r.choice([0, 30, 400])), "a") for i in range(50)] + [(90, None, "a"), (91, "", "b"), (92, items[0][1], None), (92, items[0][1], None)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_ids", F.lit(1))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.items) for r in decontamination.decontaminate(docs(spark, rows), bench, block=block).collect())
    assert got == sorted((i, *brute_hits(t, items)) for i, t, _ in rows)


def test_proximity(spark):
    rows = [(1, "alpha x x beta", "a"), (2, "alpha x x x x beta", "a"), (3, "alpha", "a"), (4, "beta alpha", "a")]
    index = decontamination.positional_index(docs(spark, rows))
    assert {r.doc_id for r in decontamination.proximity_matches(index, ["Alpha", "beta"], 3).collect()} == {1, 4}


# mixing


def test_mixing_targets_and_copies(spark):
    rows = texts(2, 300)
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for _, t, s in rows:
        per[s] = per.get(s, 0) + size(t)
    names = sorted((s for s in per if s is not None), key=str) + ([None] if None in per else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, 1.5 * sum(per.values()), set(names)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * per[s]:
                left += target[s] - 2 * per[s]
                target[s] = 2.0 * per[s]
                open_.remove(s)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == per[r.source] and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in names)
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


# fingerprints


def test_fingerprints_and_edits(spark):
    rows = [x for x in texts(3) if x[0] is not None]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs(spark, rows), 4).collect()}
    order = sorted(rows, key=lambda x: x[0])
    assert len(got) == len(rows)
    for (i, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = [got[i].fingerprint for i, t, _ in rows if t == rows[[x[0] for x in rows].index(1000)][1]]
    assert len(same) > 1 and len(set(same)) == 1
    long = [g for g in got.values() if g.n_chars > 300 and g.doc_id < 1000]
    assert np.mean([g.near_edited for g in long]) > np.mean([g.near_next for g in long]) + 0.1


def test_fingerprints_do_not_depend_on_the_ranges(spark, monkeypatch):
    rows = [x for x in texts(4) if x[0] is not None]
    whole = lambda parts: sorted(map(tuple, fingerprints.fingerprint_documents(docs(spark, rows), parts).collect()))
    one = whole(1)
    assert one == whole(7)
    monkeypatch.setattr(fingerprints, "RANGES", 3)
    assert one == whole(50)
    many = [(5, f"same id {i % 4} " * (1 + i % 90), "a") for i in range(300)] + [(None, f"no id {i}", None) for i in range(200)] + [(6, "x " * 300000, "a")]
    got = fingerprints.fingerprint_documents(docs(spark, many), 6).collect()
    order = sorted(many, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    edits = [fingerprints.edited(a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])]
    assert sorted((repr(x.doc_id), x.n_chars, x.edited_sha256) for x in got) == sorted((repr(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t, _), e in zip(order, edits))


def test_parse_does_not_depend_on_the_offset():
    import pyarrow as pa

    r = random.Random(1)
    body = "".join(r.choice("abcdefghij klmn") for _ in range(3000))
    names = []
    for head in ("", "zz", "another beginning "):
        data, at = fingerprints.utf8(pa.array([head + body]))
        for level, (x, _) in enumerate(fingerprints.parse(fingerprints.mix(data.astype(np.uint64) + np.uint64(1)), at), 1):
            if level == 3:
                names.append(x.tolist())
    for other in names[1:]:
        assert other[-len(names[0]) + 4 :] == names[0][4:] or set(names[0][6:-3]) <= set(other)


# personal data


CLEAN = "a 1.2.3.4 b.c+d@mail.example.com, +1 (605) 555-9305 and 4539578763621486"


def brute_spans(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(d[-1::-2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) % 10:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_brute_force(spark):
    r = random.Random(8)
    bits = ["4539578763621486", "4539 5787 6362 1486", "1234567890123456", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "é@x.y", "a@b.c", "a.b@c-d.e.f", "+1 (605) 555-9305", "+12", "@", "x", "007.08.09.10", "ü", "\n", "-", "+"]
    rows = [(i, "".join(r.choice(bits) + r.choice([" ", "", ", "]) for _ in range(r.randrange(12))), "a") for i in range(400)] + [(900, None, "a"), (901, "", "a"), (902, "7" * 6000, "a")]
    got = {x.doc_id: x for x in pii.find_personal_data(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        assert [tuple(s) for s in got[i].base] == brute_spans(t)
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))


def test_skip_edges_carry_a_kind_to_a_repeat():
    r = random.Random(3)

    def card():
        d = [4] + [r.randrange(10) for _ in range(14)]
        return "".join(map(str, d)) + str(-sum(d[-2::-2] + [sum(divmod(2 * x, 10)) for x in d[-1::-2]]) % 10)

    train = [f"word {card()} other {card()}, and 12 of 300 in 1999" for _ in range(200)]
    field = pii.Field()
    field.fit([pii.Tokens(t, pii.base_spans(t)) for t in train])
    c = card()
    text = f"first {c} stands alone, then {card()} {c} together; 7 of 9"
    base, more = pii.spans_of([text], field)
    at = text.rindex(c)
    assert ("card", at, at + 16) in more[0]
    assert pii.mask(text, base[0] + more[0]).count("[CARD]") >= 2
    assert pii.spans_of(["nothing 12 here", ""], field) == ([[], []], [[], []])


def test_links_find_what_patterns_and_features_miss():
    r = random.Random(4)
    number = lambda: f"+1 ({r.randrange(200, 990)}) 555-{r.randrange(1000, 9999)}"
    part = lambda: f"555-{r.randrange(1000, 9999)}"
    train = [f"call {number()} now, item {part()} of {r.randrange(99)}; or {n} and again {n}, item {m} and {m}" for n, m in ((number(), part()) for _ in range(300))]
    field = pii.Field()
    field.fit([pii.Tokens(t, pii.base_spans(t)) for t in train])
    text = "call +1 (605) 555-9305 now; later ask for 555-9305 there, and item 555-1111"
    at = text.index("555-9305 there")
    assert ("phone", at, at + 8) in pii.spans_of([text], field)[1][0]
    assert not any(s == text.index("555-1111") for _, s, _ in pii.spans_of([text], field)[1][0])
    field.pair[:] = 0
    assert ("phone", at, at + 8) not in pii.spans_of([text], field)[1][0]


def test_personal_data_in_very_long_texts_takes_linear_time():
    import time

    began = time.time()
    field = pii.Field()
    field.fit([pii.Tokens(CLEAN, pii.base_spans(CLEAN))])
    for text in ("7" * 1_000_000, "a" * 1_000_000 + " @", "a" * 500_000 + "@" + "b" * 500_000, "1." * 500_000, "+1" + " " * 1_000_000, "a@" * 300_000, "x" * 1_000_000 + "1"):
        pii.spans_of([text], field)
    assert time.time() - began < 60


# toxicity


def test_toxicity_learns_and_scores_whole_texts(spark):
    r = random.Random(2)
    make = lambda k, bad: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(r.randrange(30)) if not (bad and j == k // 2) else r.choice(["idiot", "scum", "moron"]) for j in range(k))
    rows = [(i, make(r.randrange(5, 150), i % 4 == 0), "a") for i in range(400)] + [(900, None, "a"), (901, "", "b"), (902, "idiot " * 5 + make(4000, False), None), (None, "x", "a")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _, _ in rows[:400]] + [(77777, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    got = {x.doc_id: x for x in toxicity.score_documents(d, toxicity.fit(d, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(x.held_out for x in got.values() if x.doc_id is not None and x.doc_id < 400) == len(held)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.9
    assert got[902].predicted == 1 and got[900].score == got[901].score
    none = toxicity.fit(d, labels.where("false"))
    assert {x.score for x in toxicity.score_documents(d, none).collect()} == {0.0}


def test_toxicity_is_fitted_on_1500_texts_a_class(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.Network, "learn", lambda self, texts, y, share: seen.append(np.bincount(y).tolist()))
    labels = spark.range(4500).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").where("toxic = 0 or doc_id < 4000")
    toxicity.fit(spark.range(4500).selectExpr("id as doc_id", "concat('text ', id) as text"), labels)
    learnable = [sum(i % 2 == k and (k == 0 or i < 4000) and zlib.crc32(str(i).encode()) % 4 != 2 for i in range(4500)) for k in (0, 1)]
    assert seen == [[1500, min(1500, learnable[1])]] and min(learnable) > 1000


def test_gradients():
    import pyarrow as pa

    n = toxicity.Network()
    n.known = np.unique(toxicity.Text(pa.array(["a bb dddd"])).hash)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    n.p["word"] = np.random.default_rng(1).standard_normal((len(n.known) + 1, toxicity.WIDTH))
    n.p["word"][0] = 0
    text = toxicity.Text(pa.array(["a bb ccc dddd a bb", "eeeee ffffff a"]))
    first, size, y = np.array([0, 6]), np.array([6, 3]), np.array([1.0, 0.0])
    place = np.arange(6)[:, None]
    mask = place < size

    def loss():
        words = np.concatenate([n.p["word"][n.ids(text.hash)], n.spelled(text.letters, text.size)[0]], 1)
        x = words[text.word[np.where(mask, first + place, 0)]] * mask[:, :, None]
        h, _, _ = n.run(x @ n.p["in"] + n.p["bias"], mask)
        z = n.pool(h, mask)[3]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    before = {k: v.copy() for k, v in n.p.items()}
    n.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in n.p.items()}
    n.train(text, n.ids(text.hash), first, size, y, forget=0)
    seen = {k: m[0] / 0.1 for k, m in n.moment.items()}
    n.p = before
    r = np.random.default_rng(0)
    for name in [*before, "word", "char", "char", "char"]:
        i = tuple(r.integers(0, s) for s in before[name].shape)
        if name == "char":
            i = (int(r.choice(list(b"abcdef"))), i[1])
        old = before[name][i]
        before[name][i] = old + 1e-4
        up = loss()
        before[name][i] = old - 1e-4
        down = loss()
        before[name][i] = old
        if name != "word" or i[0]:
            assert seen[name][i] == pytest.approx((up - down) / 2e-4, abs=2e-4), name


def test_toxicity_of_very_long_words_and_texts():
    import pyarrow as pa

    n = toxicity.Network()
    text = toxicity.Text(pa.array(["x" * 1000 + " ab", "q " * 300_000, None]))
    assert np.diff(text.at).tolist() == [63 + 1, 300_000, 0] and text.size.max() == toxicity.LETTERS
    assert n.score(pa.array(["x" * 100_000, "q " * 100_000, ""])).shape == (3,)


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now and save a lot of money with this offer, dear reader of pages.</div>
<article><h1>Head &amp; shoulders</h1><p><b>Unclosed bold text of some length that goes on for quite a while, as text does.<br><p>Short.</p>
<aside>Elsewhere</aside><p>More &lt;text&gt; here with <a href="x">a link</a>,
 and a second   line.</p></article><section id="comments"><p>First! This is a reader's comment that is long enough to look like text, I think.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_html(spark):
    want = "Head & shoulders Unclosed bold text of some length that goes on for quite a while, as text does. Short. More <text> here with a link, and a second line."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <!-- never"), (None, "u", PAGE)]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got[(1, "u")] == got[(None, "u")] == (want, len(want))
    assert got[(2, None)] == got[(3, "u")] == ("", 0)


def test_html_distribution_decides_with_and_without_article():
    long = "A sentence of the body that is certainly long enough to be taken for running text by its length."
    div = f"<div><p>{long}</p><p>Short.</p><p>{long}</p></div>"
    body = f"{long} Short. {long}"
    nav = "<nav><a href='/'>Home</a></nav>"
    # an article that is only a teaser doesn't take the page from the body
    assert html_text.main_text(f"{nav}<article><p>Teaser</p></article>{div}") == body
    assert html_text.main_text(f"{nav}{div}<article><a href='/x'>Next one</a></article><article>More</article>") == body
    # a short text, with an article and without, is the page's main text
    assert html_text.main_text(f"{nav}<article><h1>Hi</h1><p>Short.</p></article>") == html_text.main_text(f"{nav}<h1>Hi</h1><p>Short.</p>") == "Hi Short."
    # short blocks next to a surge, before and after it
    assert html_text.main_text(f"<p>a.</p><p>b.</p><p>c.</p><p>d.</p>{div}<div class='ad'>Buy</div><p>The end.</p>") == f"a. b. c. d. {body} The end."
    # short clutter outside doesn't ride on the article, links alone are no text
    assert html_text.main_text(f"<div>Site</div><article>{div}</article><div>Imprint</div>") == body
    assert html_text.main_text("<ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul>") == ""
    # names only weigh: comments lose to an article, a body in an element of such a name is still the body
    talk = f"<section id='comments'><p>{long}</p><p>{long}</p></section>"
    assert html_text.main_text(f"<article>{div}{div}</article>{talk}") == html_text.main_text(f"{div}{div}{talk}") == f"{body} {body}"
    assert html_text.main_text(f"{nav}<div class='post share-holder social'>{div * 4}</div>") == " ".join([body] * 4)
    assert html_text.main_text(f"<div class='sidebar-left'><article>{div}</article><div class='ad'><div>x</div>Buy</div></div>") == body
    # a side block of some length is below a share of the highest sum
    assert html_text.main_text(f"<article><p>{long * 5}</p></article><div><p>{long}</p></div>") == long * 5


def test_html_distribution_equals_brute_force():
    r = random.Random(12)
    for _ in range(400):
        n = r.randrange(0, 14)
        w = [r.choice([0, 0, 3, 20, 50, 90, 300]) for _ in range(n)]
        s = [r.choice([0, 1, 1, 1, 2, 2]) for _ in range(n)]
        own = {k: [x if y == k else 0 for x, y in zip(w, s)] for k in range(3)}
        # lines with weight of one side belong together if no three lines between them are without
        runs = []
        for k in range(3):
            for i in range(n):
                if own[k][i] and not any(own[k][max(0, i - 3) : i]):
                    j = i
                    while any(own[k][j + 1 : j + 4]):
                        j = max(x for x in range(j + 1, min(n, j + 4)) if own[k][x])
                    runs.append((max(sum(own[k][x : x + 3]) for x in range(i, j + 1)), [x for x in range(i, j + 1) if s[x] == k], k))
        best = max((t for t, _, _ in runs), default=0)
        want = sorted(x for t, lines, _ in runs if t >= max(80, best / 4) for x in lines) or next((lines for t, lines, _ in runs if t == best), [])
        assert html_text.surges(w, s) == want


def test_every_page_needs_the_distribution():
    import duckdb

    for (page,) in duckdb.sql("select html from read_parquet('/root/testdata/sf0.001/pages.parquet')").fetchall():
        everything = " ".join(x for x, _, _ in html_text.lines_of(page) if x)
        assert 0 < len(html_text.main_text(page)) < len(everything)


def test_html_of_great_length():
    page = "<p>" + "word " * 300_000 + "</p>" + "<p>x</p>" * 20_000
    assert len(html_text.main_text(page)) == 300_000 * 5 - 1 + 2 * 20_000


# quotations


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are  you?"),
        (1, 1, "assistant", "> how ARE you?\nFine, thanks."),
        (1, 2, "user", ">> How are you?\n> Fine, thanks.\nGood to hear."),
        (1, 3, "user", "> nobody said this\nReally?"),
        (1, 4, "user", "No quotes"),
        (2, 0, "user", "> Fine, thanks.\nAnother conversation"),
        (2, 1, None, None),
        (None, 0, "user", "> x"),
        (2, 1, "user", "twice"),
    ]
    got = {(r.conv_id, r.turn, r.role): r for r in quotation.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1))).collect()}
    assert len(got) == len(rows)
    a, b, c, d = (got[(1, i, r)] for i, r in ((1, "assistant"), (2, "user"), (3, "user"), (4, "user")))
    assert (a.body, a.n_quotes, a.n_linked, a.reply_to, a.root, a.depth) == ("Fine, thanks.", 1, 1, 0, 0, 1)
    assert (b.n_quotes, b.n_linked, b.reply_to, b.root, b.depth) == (2, 2, 1, 0, 2)
    assert b.reply_path == "/".join(f"{(1 << 63) + k:016x}" for k in range(3))
    assert (c.n_quotes, c.n_linked, c.reply_to, c.depth) == (1, 0, None, 0) and d.body == "No quotes"
    assert got[(2, 0, "user")].n_linked == 0


def test_quoted_passages_of_many_lines(spark):
    said = ["Hi all", "Hi all\nnothing yet", "the plan", "Hi all\nthe plan\n\nis long\nand good", "bye"]
    quotes = {
        "> Hi all\n> the plan\n>\n> is long\n> and good": 3,  # the whole body
        "> Hi all\n> the plan\n> is long": 3,  # a run of lines, by far not the first to say the first of them
        "> the plan\n> is long\n> and good": 3,
        "> and the like\n> is long": 3,  # the first line is said by nobody
        "> Hi all\n> [...]\n> and good": 3,  # the line of most characters
        "> Hi all": 0,
        "> all\n> or nothing": None,
    }
    rows = [(1, i, "user", t) for i, t in enumerate(said)] + [(1, 10 + i, "user", q + "\nYes %d." % i) for i, q in enumerate(quotes)]
    got = {r.turn: r.reply_to for r in quotation.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[10 + i] for i in range(len(quotes))] == list(quotes.values())


def brute_threads(rows):
    """(conv, turn) -> (n_quotes, n_linked, reply_to, root, depth, turns from the root) by comparing texts, one message with all earlier ones."""
    plain = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(t.split()))
    lines = lambda t: [plain(x) for x in t.split("\n") if x.strip()]
    parsed = {(c, t): quotation.parse_message(x) for c, t, _, x in rows}

    def earliest(conv, turn, wanted, whole=None):
        for t in sorted(u for c, u in parsed if c == conv and u < turn):
            body = parsed[conv, t][0]
            own = lines(body)
            if (whole and plain(body) == whole) or any(own[i : i + len(wanted)] == wanted for i in range(len(own) - len(wanted) + 1)):
                return t

    found = {}
    for (c, t), (_, quotes) in parsed.items():
        links = []
        for n, (depth, q) in enumerate(quotes):
            own, best = lines(q), None
            if not own:
                continue
            source = earliest(c, t, own, plain(q))
            if source is None:
                step = 1
                while step < len(own):
                    for i in range(len(own) - step + 1):
                        part = own[i : i + step]
                        s = earliest(c, t, part)
                        if s is not None:
                            rank = (-len(" ".join(part)), s)
                            best = min(best or rank, rank)
                    step *= 2
                source = best and best[1]
            if source is not None:
                links.append((depth, n, source))
        found[c, t] = (len(quotes), len(links), min(links)[2] if links else None)
    out = {}
    for (c, t), (n, k, reply) in found.items():
        path, at = [t], reply
        while at is not None:
            path, at = [at, *path], found[c, at][2]
        out[c, t] = (n, k, reply, path[0], len(path) - 1, path)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_threads_equal_brute_force(spark, seed):
    r = random.Random(seed)
    rows, pool = [], ["Hi all", "hi  ALL", "Thanks", "the plan", "see you", "-- ", "Yes"] + [f"line {i}" for i in range(25)]
    for conv in range(6):
        said = []
        for turn in sorted(r.sample(range(-3, 60), 25)):
            text = [r.choice(pool) for _ in range(r.randrange(4))]
            for _ in range(r.randrange(3)):
                source = r.choice(said).split("\n") if said and r.random() < 0.8 else [r.choice(pool), "never said"]
                at = r.randrange(len(source))
                mark = r.choice([">", "> ", ">> ", " > > "])
                text[r.randrange(len(text) + 1) : 0] = [mark + x for x in source[at : at + r.randrange(1, 5)]]
            if said and r.random() < 0.4:
                text = ["> " + said[-1].split("\n")[-1], *text]
            said.append("\n".join([*text, f"only here {turn}"]))
            rows.append((conv, turn, r.choice(["user", "assistant"]), said[-1]))
    got = quotation.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = brute_threads(rows)
    number = lambda x: (int(x, 16) ^ (1 << 63)) - (1 << 64 if int(x, 16) ^ (1 << 63) >= 1 << 63 else 0)
    assert {(x.conv_id, x.turn): (x.n_quotes, x.n_linked, x.reply_to, x.root, x.depth, [number(s) for s in x.reply_path.split("/")]) for x in got} == want
    assert sum(x[1] for x in want.values()) > 40 and max(x[4] for x in want.values()) > 2


def test_empty_tables(spark):
    none = docs(spark, [])
    for f in (simhash.simhash_components, mixing.mix, fingerprints.fingerprint_documents, pii.find_personal_data):
        assert f(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(docs(spark, [(1, "a b", "x")]), bench).first().n_hit == 0
    assert toxicity.score_documents(none, toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert quotation.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(9)
    rows = texts(6)
    bench = " ".join(f"q{i}" for i in range(20))
    rows += [(5000, bench, "a"), (5001, f"mail me at a.b@c.example.com {r.random()} soon please thanks", "b")]
    d = docs(spark, [x for x in rows if x[0] is not None]).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = c.run(spark, str(tmp_path)).collect()
    found = {x.doc_id: x for x in out}
    assert len(found) == len(out) and 5000 not in found
    assert not any("@" in (x.text or "") for x in out)
    assert len([x for x in out if 1000 <= x.doc_id < 1004]) <= 1
    assert all(x.taken == x.size * x.copies and (x.n_chars or 0) == len(x.text or "") for x in out)


def test_pipeline_decides_on_each_row(spark, tmp_path):
    import corpus_pipeline as c
    import pyarrow as pa

    r = random.Random(5)
    bench = " ".join(f"q{i}" for i in range(20))
    make = lambda k, bad: " ".join(r.choice(["idiot", "scum", "moron"]) if bad and j == k // 2 else r.choice(["lorem", "ipsum", "dolor"]) + str(r.randrange(900)) for j in range(k))
    labelled = [(i, make(r.randrange(20, 60), i % 4 == 0), "a") for i in range(300)]
    rows = [*labelled, *[(None, make(40, bad), s) for bad in (True, False) for s in ("a", "b", None)], (None, bench, "a"), (None, make(40, False) + " " + bench, "b")]
    rows += [(None, rows[-3][1], None), (None, rows[1][1], "a")]  # copies: of a row without doc_id, and of one with
    rows += [(7, rows[7][1], "a")] * 2 + [(900, make(30, False), "b"), (900, make(30, True), "b"), (900, make(30, False), "b")]
    r.shuffle(rows)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], kind)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda rows: sorted(map(repr, rows))
    stage = lambda f, rows: [(x.doc_id, x.text, x.source) for x in f(spark, frame(rows).repartition(3), str(tmp_path)).collect()]

    network = toxicity.fit(frame(rows), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = network.score(pa.array([t for _, t, _ in rows]))
    kept = [x for x, s in zip(rows, score) if s < toxicity.THRESHOLD]
    assert any(i is None for i, _, _ in kept) and any(x[0] is None and x not in kept for x in rows)
    assert key(stage(c.toxicity, rows)) == key(kept)

    classes = brute_classes([brute_fingerprint(t) for _, t, _ in kept])
    groups = {k: [x for x, g in zip(kept, classes) if g == k] for k in set(classes)}
    got = stage(c.simhash_near_dedup, kept)
    assert len(got) == len(groups) < len(kept)
    assert sorted(repr(min((x[0] for x in g if x[0] is not None), default=None)) for g in groups.values()) == sorted(repr(x[0]) for x in got)

    clean = [x for x in got if bench not in x[1]]
    assert len(clean) < len(got) and key(stage(c.benchmark_decontamination, got)) == key(clean)

    out = c.source_mixing(spark, frame(clean), str(tmp_path)).collect()
    wanted = [(x.doc_id, x.size, x.copies, x.source) for x in mixing.mix(frame(clean)).collect() if x.copies]
    assert len(out) == len(wanted) <= len(clean)
    assert sorted((x.size, x.copies, repr(x.source)) for x in out) == sorted((n, k, repr(s)) for _, n, k, s in wanted)
    assert {(x.doc_id, x.text, x.source) for x in out} <= set(clean) and any(x.doc_id is None for x in out)


def test_whole_pipeline_equals_brute_force(spark, tmp_path):
    """run() against its stages done by hand, the toxicity stage by the scores of the network it fits."""
    import corpus_pipeline as c
    import pyarrow as pa

    r = random.Random(17)
    bench = " ".join(f"q{i}" for i in range(20))
    make = lambda k, bad: " ".join(r.choice(["idiot", "scum", "moron"]) if bad and j == k // 2 else r.choice(["lorem", "ipsum", "dolor"]) + str(r.randrange(900)) for j in range(k))
    rows = [(i, make(r.randrange(20, 60), i % 4 == 0), r.choice(["a", "b", "b", None])) for i in range(300)]
    rows += [(400 + i, rows[1 + 4 * i][1], "a") for i in range(5)] + [(500, make(30, False) + " " + bench, "a"), (501, bench, "b"), (502, None, "a"), (503, "", "b")]
    rows += [(600 + i, make(25, False) + f" write to me{i}@mail.example.com or 10.0.0.{i} today", "b") for i in range(6)]
    r.shuffle(rows)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], kind)
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    score = toxicity.fit(frame(rows), spark.read.parquet(f"{tmp_path}/labels.parquet")).score(pa.array([t for _, t, _ in rows]))
    left = [x for x, s in zip(rows, score) if s < toxicity.THRESHOLD]
    classes = brute_classes([brute_fingerprint(t) for _, t, _ in left])
    left = [min(x for x, g in zip(left, classes) if g == k) for k in set(classes)]
    hits = {i for i, t, _ in left if bench in (t or "")}
    left = [x for x in left if x[0] not in hits]
    masked = lambda t: t and re.sub(r"10\.0\.0\.[0-9]", "[IP]", re.sub(r"me[0-9]@mail\.example\.com", "[EMAIL]", t))
    left = [(i, masked(t), s) for i, t, s in left]
    assert hits and len(left) > 100 and any("[EMAIL]" in (t or "") for _, t, _ in left)

    out = c.run(spark, str(tmp_path)).collect()
    text = {i: t for i, t, _ in left}
    assert {x.doc_id for x in out} <= set(text) and all(text[x.doc_id] == x.text and x.size == len((x.text or "").split()) for x in out)
    mixed = {x.doc_id: (x.size, x.source_size, x.target) for x in mixing.mix(frame(left)).collect()}
    assert all((x.size, x.source_size, x.target) == mixed[x.doc_id] and x.taken == x.size * x.copies for x in out)
    for s in {x.source for x in out}:
        own = [x for x in out if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 60  # the longest document
