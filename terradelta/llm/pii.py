"""Personal data: fixed patterns, and a skip-chain conditional random field on top.

The patterns give the base spans, which always stay.  The field adds what a pattern
misses at one place but the document shows at another, such as a card number that
stands beside a second one.  Its variables are a document's tokens with a digit or an
``@``; a token in a base span is observed.  Neighbouring tokens share chain
potentials.  Each token also shares a skip potential with the last one of the same
normalised form, and a weaker one with the last one of the same shape and beginning,
however far away.  Loopy belief propagation runs on all documents of a batch at once;
a token whose most likely kind has probability ``SURE`` becomes a span.

The weights are fitted in numpy on at most ``SAMPLE`` documents with such tokens, in
hash order, labelled by the patterns.  Unary weights of token features and the three
tables of pair potentials are learned together, by the pseudo-likelihood of each token
given its features and the labels of the tokens it is linked to.  ``HIDE`` of the tokens
are read without their features: else these, which the patterns see too, would explain
every label and nothing would be learned of the links.

Defined cases: null or empty text has no spans; offsets count code points; a text of
any length is read whole; repeated rows are rows of their own; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
SURE = 0.5
ROUNDS = 12
FEATURES = 1 << 12

#: Share of tokens whose features are hidden while fitting.
HIDE = 0.3

# Every pattern takes a maximal run once, whether it matches or not, so that texts of any length take linear time.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
TOKEN = re.compile(r"([^\s\"'<>|,;:=0-9@]*+[0-9@][^\s\"'<>|,;:=]*+)|[^\s\"'<>|,;:=]++")
NOT_DIGIT = re.compile(r"[^0-9]+")
EDGE = "().!?*#$%&[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def small_parts(match: str) -> bool:
    return all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in match.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text) if m[1]]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if m[1] and small_parts(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Tokens:
    """The variables of one document: spans, features, observed labels, and links to earlier tokens."""

    __slots__ = ("span", "features", "label", "links")

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        self.span, self.features, self.label, self.links = [], [], [], []
        kind_of = sorted((s, e, KINDS.index(k) + 1) for k, s, e in base)
        same, alike, b, last = {}, {}, 0, -9
        for i, m in enumerate(x for x in TOKEN.finditer(text) if x[1]):
            word = m.group().strip(EDGE)
            start = m.start() + len(m.group()) - len(m.group().lstrip(EDGE))
            end = start + len(word)
            while b < len(kind_of) and kind_of[b][1] <= start:
                b += 1
            label = next((k for s, e, k in kind_of[b : b + 3] if s < end and e > start), 0)
            digits = NOT_DIGIT.sub("", word)
            shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda x: f"9{min(20, len(x.group()))}", word))
            checks = f"{len(digits)}|{13 <= len(digits) <= 19 and luhn(digits)}|{word.count('.') == 3 and (ip := IP.match(word)) is not None and ip.end() == len(word) and small_parts(word)}|{(at := EMAIL.match(word)) is not None and bool(at[1]) and at.end() == len(word)}"
            before = text[max(0, m.start() - 2) : m.start()].strip() or "_"
            names = (f"s{shape[:24]}", f"c{checks}", f"p{text[m.start() - 1 : m.start()]}", f"n{before[-1:]}", f"l{min(40, len(word))}", "bias")
            self.features.append([zlib.crc32(x.encode()) % FEATURES for x in names])
            self.span.append((start, end))
            self.label.append(label)
            if m.start() - last <= 1:
                self.links.append((i - 1, i, 0))
            last = m.end()
            key = digits if len(digits) >= 7 else word.lower()
            if len(key) >= 6:
                if key in same:
                    self.links.append((same[key], i, 1))
                same[key] = i
                near = (shape, key[:4])
                if near in alike and alike[near] != same.get(key, -1) and (alike[near], i, 1) not in self.links[-2:]:
                    self.links.append((alike[near], i, 2))
                alike[near] = i


class Field:
    """Unary weights and the three kinds of pair potentials (chain, same, alike), as logarithms."""

    def __init__(self):
        k = len(KINDS) + 1
        self.unary = np.zeros((FEATURES, k))
        self.pair = np.zeros((3, k, k))

    def fit(self, docs: list[Tokens], rounds: int = 400, seed: int = 3) -> None:
        k = len(KINDS) + 1
        features, label, src, dst, kind = self.graph(docs)
        if not len(label):
            return
        r = np.random.default_rng(seed)
        goal = np.eye(k)[label]
        step = [np.zeros_like(self.unary), np.zeros_like(self.pair)]
        for _ in range(rounds):  # Adagrad
            shown = r.random(len(label)) >= HIDE
            x = self.unary[features].sum(1) * shown[:, None]
            near = self.pair[kind, label[src]]
            for c in range(k):
                x[:, c] += np.bincount(dst, near[:, c], len(label))
            p = np.exp(x - x.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - goal) / len(label)
            g, h = 1e-4 * self.unary, 1e-4 * self.pair
            own = d * shown[:, None]
            for c in range(k):
                g[:, c] += np.bincount(features.ravel(), np.repeat(own[:, c], features.shape[1]), FEATURES)
                h[:, :, c] += np.bincount(kind * k + label[src], d[dst, c], 3 * k).reshape(3, k)
            h = (h + h.transpose(0, 2, 1)) / 2  # a link has no direction
            for weights, grad, power in ((self.unary, g, step[0]), (self.pair, h, step[1])):
                power += grad * grad
                weights -= 0.5 * grad / (np.sqrt(power) + 1e-6)

    @staticmethod
    def graph(docs: list[Tokens]) -> tuple[np.ndarray, ...]:
        """Features and labels of all tokens, and the links in both directions: from, to, kind; the second half turns the first."""
        features = np.array([f for d in docs for f in d.features], np.int64).reshape(-1, 6)
        label = np.array([x for d in docs for x in d.label], np.int64)
        at = np.cumsum([0, *(len(d.label) for d in docs)])
        links = np.array([(a + o, b + o, t) for d, o in zip(docs, at) for a, b, t in d.links], np.int64).reshape(-1, 3)
        src, dst, kind = np.concatenate([links[:, [0, 1, 2]], links[:, [1, 0, 2]]]).T
        return features, label, src, dst, kind

    def marginals(self, docs: list[Tokens], rounds: int = ROUNDS) -> np.ndarray:
        """Beliefs of all tokens of the documents, by damped sum-product on the whole graph."""
        k = len(KINDS) + 1
        features, label, src, dst, kind = self.graph(docs)
        own = self.unary[features].sum(1)
        seen = label > 0
        own[seen] = np.where(np.eye(k)[label[seen]] > 0, 0.0, -30.0)
        if not len(src):
            belief = own
        else:
            half = len(src) // 2
            back = np.concatenate([np.arange(half) + half, np.arange(half)])
            message = np.zeros((len(src), k))
            belief = own
            for _ in range(rounds):
                cavity = belief[src] - message[back]
                cavity -= cavity.max(1, keepdims=True)
                new = np.log(np.einsum("ei,eij->ej", np.exp(cavity), np.exp(self.pair[kind])) + 1e-30)
                new -= new.max(1, keepdims=True)
                message = 0.5 * message + 0.5 * new
                belief = own + np.stack([np.bincount(dst, message[:, c], len(own)) for c in range(k)], 1)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Spans besides the base ones, per text.  Only texts with a token that isn't in a base span need inference."""
        docs, which = [], []
        for i, (text, spans) in enumerate(zip(texts, base)):
            if SIGN.search(text):  # else there is no token
                t = Tokens(text, spans)
                if not all(t.label):
                    docs.append(t)
                    which.append(i)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not docs:
            return out
        belief = self.marginals(docs)
        at = 0
        for i, d in zip(which, docs):
            b = belief[at : at + len(d.label)]
            at += len(d.label)
            for j in np.flatnonzero((b[:, 0] < 1 - SURE) & (np.array(d.label) == 0)):
                c = int(b[j].argmax())
                if c and b[j, c] >= SURE:
                    kind, (start, end) = KINDS[c - 1], d.span[j]
                    if kind == "phone" and out[i] and out[i][-1][0] == kind and not texts[i][out[i][-1][2] : start].strip(" ()"):
                        start = out[i].pop()[1]  # the parts of one number
                    out[i].append((kind, start, end))
        return out


def fit_field(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fits the field on at most ``sample`` documents that hold a base span."""
    rows = with_columns_of(docs, "doc_id", "text")
    # the patterns' signs, so that the sample isn't spent on texts without a candidate
    some = rows.where(F.col("text").rlike(r"@[A-Za-z0-9-]+\.|[0-9]{7}|\+[0-9]|[0-9]\.[0-9]+\.[0-9]"))
    # ids first: a sort that carries texts would bring a sample's worth from each partition to one task
    ids = some.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample).collect()
    field = Field()
    if ids:
        chosen = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in {r["doc_id"] for r in ids}], "doc_id long"))
        got = sorted((r["doc_id"], r["text"] or "") for r in rows.join(chosen, "doc_id", "left_semi").toLocalIterator())
        field.fit([Tokens(t, base_spans(t)) for _, t in got])
    return field


def spans_of(texts: list[str], field: Field) -> tuple[list, list]:
    """Base and added spans of each text."""
    base = [base_spans(t) if SIGN.search(t) else [] for t in texts]
    return base, field.added(texts, base)


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and spans (all), arrays of (kind, start, end) in order, for every row."""
    model = docs.sparkSession.sparkContext.broadcast(field or fit_field(docs))
    span = "array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                ids, texts = b.column(0).slice(i, 500), [x or "" for x in b.column(1).slice(i, 500).to_pylist()]
                base, more = spans_of(texts, model.value)
                every = [sorted(x + y, key=lambda s: (order[s[0]], s[1], s[2])) if y else x for x, y in zip(base, more)]
                pack = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in r] for r in rows], kind)
                yield pa.record_batch([ids, pack(base), pack(every)], names=["doc_id", "base", "spans"])

    return with_columns_of(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its first kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def mask_personal_data(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """docs with personal data replaced in the text column; all columns stay, null stays null."""
    model = docs.sparkSession.sparkContext.broadcast(field or fit_field(docs))
    at = [c.lower() for c in docs.columns].index(text)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = part.column(at).to_pylist()
                base, more = spans_of([t or "" for t in texts], model.value)
                new = pa.array([t if t is None else mask(t, x + y) for t, x, y in zip(texts, base, more)], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
