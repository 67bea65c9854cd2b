"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs.

A text is lower-cased and cut to words; all windows of ``WINDOW`` words, each half
over the one before, are scored, and the text's score is that of its highest window.
A word's input is its embedding, if it is one of the words that stand in ``COMMON``
fitting texts at least, and the last state of a second, character-level GRU that reads
its bytes.  A forward and a backward GRU read the window, attention weighs their states,
and a linear layer gives the window's logit.  No statistic of words enters: what
is toxic is learned by back-propagation, in numpy, from the labels of whole texts: first
on any window of a text, then on the one that the network scores highest.

Only rows of ``labels`` whose crc32(doc_id as text) mod 4 is not 2 are learned from,
at most ``SAMPLE`` of either class, taken in hash order; these texts are what reaches
the driver.  A third of them is kept from the network to fit the scale of the final
score, weighted to the classes' shares among all rows that may be learned from.

Defined cases: null or empty text gets the score of an empty window; a word of more than
``LETTERS`` bytes counts as several; labels that are null or of unknown documents teach
nothing; without a row of each class every score is the share of label 1 (0 if there
are no labels); rows with one doc_id are rows of their own, the least text among them is
learned from; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns_of
from .decontamination import BREAK, LOWER
from .kernels import U64, ranges, slices, span_hashes, utf8, words

WINDOW = 64
STRIDE = 32
#: Widths: states of a direction, word embedding, character embedding and states.
HIDDEN = 12
WIDTH = 8
SPELL = 8
LETTERS = 16
#: Fitting texts that a word must stand in to have an embedding.
COMMON = 3
SAMPLE = 1500
THRESHOLD = 0.3
EPOCHS = 12
BATCH = 64
#: Steps of training at least, however few the texts.
STEPS = 400
#: Share of words read by their spelling alone while learning, and how fast embeddings shrink.
FORGET = 0.2
DECAY = 0.02


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


class Text:
    """A batch of texts: distinct words with their letters, and every word's index.  Words of more than LETTERS bytes are read in pieces."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        data = LOWER[data]
        starts, ends, at = words(data, offsets, BREAK)
        pieces = -(-(ends - starts) // LETTERS)
        first = ranges(np.zeros(len(starts), np.int64), pieces) * LETTERS + np.repeat(starts, pieces)
        last = np.minimum(first + LETTERS, np.repeat(ends, pieces))
        self.at = np.concatenate([[0], np.cumsum(pieces)])[at]
        self.hash, sample, self.word = np.unique(span_hashes(data, first, last), return_index=True, return_inverse=True)
        s, self.size = first[sample], (last - first)[sample]
        place = np.arange(LETTERS)[:, None]
        self.letters = data[np.minimum(s + place, max(0, len(data) - 1))] if len(s) else np.zeros((LETTERS, 0), np.uint8)

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and number of words of every window; an empty text has one of none."""
        n = np.diff(self.at)
        count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // stride) + 1)
        doc = np.repeat(np.arange(len(n)), count)
        begin = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
        return doc, self.at[doc] + begin, np.minimum(WINDOW, n[doc] - begin)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Gru:
    """One direction: inputs are projections (T, B, 3H); a masked step keeps the state."""

    @staticmethod
    def forward(p, u, mask, keep=False):
        t, b, h3 = p.shape
        h = h3 // 3
        state = np.zeros((b, h), p.dtype)
        out = np.empty((t, b, h), p.dtype)
        saved = []
        for i in range(t):
            g = state @ u
            zr = sigmoid(p[i, :, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(p[i, :, 2 * h :] + r * g[:, 2 * h :])
            m = mask[i][:, None]
            if keep:
                saved.append((state, z, r, n, g[:, 2 * h :], m))
            state = np.where(m, n + z * (state - n), state)
            out[i] = state
        return out, saved

    @staticmethod
    def backward(d_out, u, saved):
        t, b, h = d_out.shape
        dp = np.empty((t, b, 3 * h), d_out.dtype)
        du, carry = np.zeros_like(u), np.zeros((b, h), d_out.dtype)
        for i in range(t - 1, -1, -1):
            state, z, r, n, gn, m = saved[i]
            d = d_out[i] + carry
            live = d * m
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (state - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dp[i] = np.concatenate([dz, dr, dn], 1)
            dg = np.concatenate([dz, dr, dn * r], 1)
            du += state.T @ dg
            carry = d * ~m + live * z + dg @ u.T
        return dp, du


class Network:
    def __init__(self, seed: int = 7):
        self.random = np.random.default_rng(seed)
        f = lambda *s, k=0.3: (self.random.standard_normal(s) * k).astype(np.float32)
        h, c = HIDDEN, SPELL
        self.p = {
            "char": f(256, c), "cin": f(c, 3 * c), "cbias": np.zeros(3 * c, np.float32), "cu": f(c, 3 * c),
            "word": np.zeros((1, WIDTH), np.float32), "in": f(WIDTH + c, 6 * h), "bias": np.zeros(6 * h, np.float32), "uf": f(h, 3 * h), "ub": f(h, 3 * h),
            "att": f(2 * h, 8), "v": f(8), "out": f(2 * h), "b": np.zeros(1, np.float32),
        }
        self.step = 0
        self.known = np.zeros(0, U64)
        self.scale, self.shift, self.prior = 1.0, 0.0, None

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word in the embedding; 0 for words that aren't known."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[i] == hashes, i + 1, 0)

    def spelled(self, letters, size, keep=False):
        """The state after a word's last letter, of every word."""
        t = int(size.max(initial=1))
        table = self.p["char"] @ self.p["cin"] + self.p["cbias"]
        out, saved = Gru.forward(table[letters[:t]], self.p["cu"], np.arange(t)[:, None] < size, keep)
        return out[-1], saved

    def pool(self, h, mask):
        a = np.tanh(h @ self.p["att"])
        e = np.exp(np.clip(a @ self.p["v"], -20, 20)) * mask
        w = e / np.maximum(e.sum(0), 1e-9)
        c = np.einsum("tb,tbh->bh", w, h)
        return a, w, c, c @ self.p["out"] + self.p["b"][0]

    def run(self, proj, mask, keep=False):
        h = HIDDEN
        f, sf = Gru.forward(proj[:, :, : 3 * h], self.p["uf"], mask, keep)
        b, sb = Gru.forward(proj[::-1, :, 3 * h :], self.p["ub"], mask[::-1], keep)
        return np.concatenate([f, b[::-1]], 2), sf, sb

    def inputs(self, text: Text) -> np.ndarray:
        """Word embedding and spelling of every distinct word."""
        out = np.empty((len(text.hash), WIDTH + SPELL), np.float32)
        out[:, :WIDTH] = self.p["word"][self.ids(text.hash)]
        order = np.argsort(text.size, kind="stable")  # words of like length go together
        for i in range(0, len(order), 4096):
            w = order[i : i + 4096]
            out[w, WIDTH:] = self.spelled(text.letters[:, w], text.size[w])[0]
        return out

    def logits(self, text: Text, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """Text and logit of every window."""
        doc, first, n = text.windows(stride)
        table = self.inputs(text) @ self.p["in"] + self.p["bias"]
        table = np.concatenate([table, np.zeros((1, 6 * HIDDEN), np.float32)]).astype(np.float32)
        out = np.empty(len(doc), np.float32)
        order = np.argsort(n, kind="stable")
        for i in range(0, len(order), 2048):
            w = order[i : i + 2048]
            place = np.arange(max(1, int(n[w].max())))[:, None]
            mask = place < n[w]
            index = np.where(mask, text.word[np.minimum(first[w] + place, len(text.word) - 1)] if len(text.word) else 0, len(table) - 1)
            h, _, _ = self.run(table[index], mask)
            out[w] = self.pool(h, mask)[3]
        return doc, out

    def highest(self, text: Text) -> np.ndarray:
        doc, x = self.logits(text)
        return np.maximum.reduceat(x, np.searchsorted(doc, np.arange(len(text.at) - 1))) if len(doc) else x

    def score(self, column: pa.Array) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(column), self.prior)
        _, offsets = utf8(column)
        out = [self.highest(Text(column.slice(i, j - i))) for i, j in slices(offsets, 1 << 20)]
        return sigmoid(self.scale * np.concatenate(out).astype(float) + self.shift) if out else np.zeros(0)

    def learn(self, texts: list[str], labels: np.ndarray, share: float) -> None:
        if len(set(labels.tolist())) < 2:
            self.prior = float(share)
            return
        r = self.random
        part = r.permutation(len(texts)) % 3 == 0
        if len(set(labels[part].tolist())) < 2 or len(set(labels[~part].tolist())) < 2:
            part[:] = False
        fit = np.flatnonzero(~part)
        text = Text(pa.array([texts[i] for i in fit], pa.large_string()))
        y = labels[fit]
        doc_of = np.repeat(np.arange(len(fit)), np.diff(text.at))
        # words that stand in few of the texts would only let the network know these by heart
        pairs = np.unique(doc_of * np.int64(max(1, len(text.hash))) + text.word)
        self.known = text.hash[np.bincount(pairs % max(1, len(text.hash)), minlength=len(text.hash)) >= COMMON]
        self.p["word"] = (r.standard_normal((len(self.known) + 1, WIDTH)) * 0.1).astype(np.float32)
        self.p["word"][0] = 0
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        ids = self.ids(text.hash)
        doc, first, n = text.windows()
        begin = np.searchsorted(doc, np.arange(len(fit)))
        many = np.diff(np.append(begin, len(doc)))
        epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(fit))))
        for epoch in range(epochs):
            some = begin + (r.random(len(fit)) * many).astype(np.int64)
            if epoch < epochs // 3:
                chosen = some
            else:  # a text is as toxic as its highest window; clean texts also give any one
                _, x = self.logits(text)
                order = np.lexsort((x, doc))
                top = order[np.append(doc[order][1:] != doc[order][:-1], True)]
                chosen = np.concatenate([top, some[y == 0]])
            chosen = r.permutation(chosen)
            for batch in np.array_split(chosen, max(1, len(chosen) // BATCH)):
                self.train(text, ids, first[batch], n[batch], y[doc[batch]].astype(np.float32), epoch / epochs)
        cal = np.flatnonzero(part) if part.any() else fit
        x = np.concatenate([self.highest(Text(pa.array([texts[i] for i in c], pa.large_string()))) for c in np.array_split(cal, max(1, len(cal) // 50))]).astype(float)
        self.calibrate(x, labels[cal], share)

    def calibrate(self, x, y, share):
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's method, with a little ridge
            p = sigmoid(a * x + b)
            g = np.array([(weight * (p - y) * x).sum() + 1e-3 * (a - 1), (weight * (p - y)).sum() + 1e-4 * b])
            q = weight * p * (1 - p)
            h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-4]])
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = max(0.05, float(a)), float(b)

    def train(self, text, ids, first, n, y, progress=0.0, forget=FORGET):
        t = max(1, int(n.max()))
        place = np.arange(t)[:, None]
        mask = place < n
        where = np.where(mask, first + place, 0)
        used, index = np.unique(text.word[where] if len(text.word) else where, return_inverse=True)
        index = index.reshape(where.shape)
        if not len(text.hash):
            return
        row = ids[used]
        if forget:  # some words only by their spelling, so that this tells of words unseen
            row = np.where(self.random.random(len(row)) < forget, 0, row)
        letters, size = text.letters[:, used], text.size[used]
        spelling, sc = self.spelled(letters, size, True)
        e = np.concatenate([self.p["word"][row], spelling], 1)
        x = (e[index] * mask[:, :, None]).astype(e.dtype)
        proj = x @ self.p["in"] + self.p["bias"]
        h, sf, sb = self.run(proj, mask, True)
        a, w, c, logit = self.pool(h, mask)
        d = ((sigmoid(logit) - y) / len(y)).astype(e.dtype)
        grad = {"out": c.T @ d, "b": np.array([d.sum()])}
        dc = d[:, None] * self.p["out"]
        dw = np.einsum("bh,tbh->tb", dc, h)
        de = w * (dw - (w * dw).sum(0))
        da = de[:, :, None] * self.p["v"] * (1 - a * a)
        grad["v"] = np.einsum("tb,tba->a", de, a)
        grad["att"] = np.einsum("tbh,tba->ha", h, da)
        dh = w[:, :, None] * dc + da @ self.p["att"].T
        k = HIDDEN
        dpf, grad["uf"] = Gru.backward(dh[:, :, :k], self.p["uf"], sf)
        dpb, grad["ub"] = Gru.backward(dh[::-1, :, k:], self.p["ub"], sb)
        dp = np.concatenate([dpf, dpb[::-1]], 2)
        grad["in"], grad["bias"] = np.einsum("tbx,tbp->xp", x, dp), dp.sum((0, 1))
        dx = (dp @ self.p["in"].T) * mask[:, :, None]
        de = np.zeros((len(used), e.shape[1]), e.dtype)
        np.add.at(de, index.ravel(), dx.reshape(-1, e.shape[1]))
        grad["word"] = np.zeros_like(self.p["word"])
        np.add.at(grad["word"], row, de[:, :WIDTH])
        grad["word"][0] = 0
        last = np.zeros((len(sc), len(used), SPELL), e.dtype)
        last[-1] = de[:, WIDTH:]
        dpc, grad["cu"] = Gru.backward(last, self.p["cu"], sc)
        seen = np.arange(len(sc))[:, None] < size
        dtable = np.zeros((256, 3 * SPELL), e.dtype)
        np.add.at(dtable, letters[: len(sc)][seen], dpc[seen])
        grad["cbias"], grad["cin"], grad["char"] = dtable.sum(0), self.p["char"].T @ dtable, dtable @ self.p["cin"].T
        self.step += 1
        for name, g in grad.items():  # Adam, slower toward the end
            m, v = self.moment[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            rate = 0.01 * (1 - 0.9 * progress)
            if name == "word":
                self.p[name] *= 1 - rate * DECAY
            self.p[name] -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)).astype(self.p[name].dtype)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Trains on at most ``sample`` texts of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    network = Network()
    rows: list = []
    for label in (0, 1):
        # one more hash than asked for is never needed: documents that are missing only make the sample smaller
        ids = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
        rows += [(r["doc_id"], label) for r in ids.select("doc_id").collect()]
    if rows:
        wanted = dict(rows)
        chosen = with_columns_of(docs, "doc_id", "text").join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")), "doc_id", "left_semi")
        one = chosen.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        got = sorted((r["doc_id"], r["text"]) for r in one.toLocalIterator())
        network.learn([t for _, t in got], np.array([wanted[i] for i, _ in got], np.int64), share)
    else:
        network.prior = 0.0
    return network


def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast({k: v for k, v in network.__dict__.items() if k not in ("moment", "random")})

    def run(batches):
        n = Network.__new__(Network)
        n.__dict__.update(model.value)
        for b in batches:
            score = n.score(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = with_columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of docs that the network doesn't reject, each decided on by its own text; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast({k: v for k, v in network.__dict__.items() if k not in ("moment", "random")})
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        n = Network.__new__(Network)
        n.__dict__.update(model.value)
        for b in batches:
            for i in range(0, b.num_rows, 200):  # whole rows travel: small pieces keep their copies small
                part = b.slice(i, 200)
                yield part.filter(pa.array(n.score(part.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
