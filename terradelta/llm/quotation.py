"""Chat formatting by quotation linking.

A message's lines that begin with ``>`` marks are quotes, nested as deep as the marks.
Consecutive lines of one depth form a passage.  Passages are normalised (ASCII lower
case, white space as one space, trimmed) and hashed, as are each message's own body,
its lines, and its runs of lines that aren't empty.  A passage links to the first
earlier message of its conversation that says it whole: as its body, as a line, or as
a run of lines.  If none does, the passage's own runs of 1, 2, 4, 8 ... lines are looked
up, at any place in it, and the one of most characters that an earlier message says
links to the first that says it.  The message at the shallowest linked depth is the
one replied to.  Messages come in reply order: each with the root of its thread, its
depth, and a path to sort by.

Bodies are only hashed in runs of lengths that some passage asks for.
Links come from hash joins against the least turn of each (conversation, hash), an
aggregate that combines map-side, so a line that everybody writes costs one row.  The
threads resolve by pointer doubling, in as many joins as the logarithm of the depth.
Nothing gathers a conversation in one place, however long it is.

Returns per row: conv_id, turn, role, body (without quotes), n_quotes, n_linked,
reply_to (turn or null), root (turn), depth, reply_path (turns from the root on, each
as 16 hex digits that sort like the numbers; the order of the conversation).  Only messages with a linked quote hang under
another; the others are roots, so a conversation without quotes stays in turn order.

Defined cases: null text counts as empty; null conv_id or turn are kept, but link to
nothing; rows with one (conv_id, turn) are rows of their own and share links; quotes
of unknown passages count in n_quotes only; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, with_columns_of


def normalised(text: str) -> str:
    return " ".join(text.split()).translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def passage_hash(text: str) -> int | None:
    x = normalised(text)
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True) if x else None


def line_hashes(text: str) -> list[tuple[int, int]]:
    """(hash, normalised length) of the lines that aren't empty."""
    return [(passage_hash(x), len(normalised(x))) for x in text.split("\n") if x.strip()]


def run_hash(lines: list[tuple[int, int]]) -> int:
    """The hash of a run of lines; of one line, its own."""
    if len(lines) == 1:
        return lines[0][0]
    return int.from_bytes(hashlib.blake2b(b"".join([h.to_bytes(8, "big", signed=True) for h, _ in lines]), digest_size=8).digest(), "big", signed=True)


def passage_keys(passage: str) -> list[dict]:
    """What to look a passage up by: each hash with the characters it stands for, the whole passage's being the most."""
    lines = line_hashes(passage)
    if not lines:
        return []
    size = len(normalised(passage))
    keys = {passage_hash(passage): size, run_hash(lines): size}
    step = 1
    while step < len(lines):
        for i in range(len(lines) - step + 1):
            part = lines[i : i + step]
            keys.setdefault(run_hash(part), sum(n for _, n in part) + step - 1)
        step *= 2
    return [{"hash": h, "chars": n} for h, n in keys.items()]


def said_hashes(body: str, lengths: list[int]) -> list[int]:
    """Hashes of a body, its lines, and its runs of the given numbers of lines."""
    lines = line_hashes(body)
    own = {passage_hash(body)} - {None}
    for k in lengths:
        own.update(run_hash(lines[i : i + k]) for i in range(len(lines) - k + 1))
    return sorted(own)


def parse_message(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The body without quotes, and (depth, passage) of each quoted passage."""
    body, quotes, last = [], [], 0
    for line in text.split("\n"):
        depth, rest = 0, line.lstrip(" \t")
        while rest.startswith(">"):
            depth += 1
            rest = rest[1:].lstrip(" \t")
        if not depth:
            body.append(line)
        elif depth == last:
            quotes[-1][1].append(rest)
        else:
            quotes.append((depth, [rest]))
        last = depth
    return "\n".join(body).strip(), [(d, "\n".join(x)) for d, x in quotes]


def parse_messages(messages: DataFrame) -> DataFrame:
    schema = "conv_id long, turn long, role string, body string, n_quotes long, quoted array<struct<depth:int,lines:int,keys:array<struct<hash:bigint,chars:bigint>>>>"
    keys = pa.list_(pa.struct([("hash", pa.int64()), ("chars", pa.int64())]))
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("body", pa.string()), ("n_quotes", pa.int64()), ("quoted", pa.list_(pa.struct([("depth", pa.int32()), ("lines", pa.int32()), ("keys", keys)])))])

    def run(batches):
        for b in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                body, quotes = parse_message(text or "")
                rows.append({"conv_id": conv, "turn": turn, "role": role, "body": body, "n_quotes": len(quotes), "quoted": [{"depth": d, "lines": len(line_hashes(q)), "keys": passage_keys(q)} for d, q in quotes]})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return with_columns_of(messages, "conv_id", "turn", "role", "text").mapInArrow(run, schema)


def said_in(parsed: DataFrame, lengths: list[int]) -> DataFrame:
    """conv_id, turn, hash of all that the messages say in runs of such lengths."""

    def run(batches):
        for b in batches:
            said = [said_hashes(x, lengths) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(said, pa.list_(pa.int64()))], names=["conv_id", "turn", "said"])

    rows = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", "body")
    return rows.mapInArrow(run, "conv_id long, turn long, said array<bigint>").select("conv_id", "turn", F.explode("said").alias("hash"))


def path_step(turn):
    """A whole turn, negative ones too, as text that sorts like the number."""
    return F.lower(F.lpad(F.hex(turn.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def link_quotations(messages: DataFrame) -> DataFrame:
    parsed = cut(parse_messages(messages))
    passages = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode("quoted").alias("n", "q"))
    quoted = cut(passages.select("conv_id", "turn", "n", "q.depth", F.explode("q.keys").alias("key")).select("conv_id", "turn", "n", "depth", "key.hash", "key.chars").distinct())
    # the distinct numbers of lines: few, as all passages together have at least their sum
    asked = {r["lines"] for r in passages.select("q.lines").where("lines > 0").distinct().collect()}
    lengths = sorted(asked | {1 << i for i in range(max(asked, default=0).bit_length())})
    # only conversations' passages that somebody quotes are looked up
    said = said_in(parsed, lengths)
    origin = said.join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    links = quoted.join(origin, ["conv_id", "hash"]).where("source < turn")
    # the most characters first, so the whole passage before its parts; then the earliest message
    per_quote = links.groupBy("conv_id", "turn", "n").agg(F.min("depth").alias("depth"), F.min(F.struct((-F.col("chars")).alias("less"), "source"))["source"].alias("source"))
    reply = cut(per_quote.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("depth", "n", "source"))["source"].alias("reply_to")))
    # pointer doubling: far is the ancestor reached so far, path the turns from below it down to the message
    path = path_step(F.col("turn"))
    tree = reply.select("conv_id", "turn", F.col("reply_to").alias("far"), F.lit(1).alias("depth"), path.alias("path"))
    while True:
        up = tree.select("conv_id", F.col("turn").alias("far"), F.col("far").alias("next"), F.col("depth").alias("more"), F.col("path").alias("above"))
        joined = tree.join(up, ["conv_id", "far"], "left")
        moved = cut(joined.select("conv_id", "turn", F.coalesce("next", "far").alias("far"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", F.lit("/"), "path")).alias("path"), F.col("next").isNotNull().alias("moved")))
        done = moved.where("moved").isEmpty()
        tree = moved.drop("moved")
        if done:
            break
    thread = tree.join(reply, ["conv_id", "turn"]).withColumnRenamed("far", "root")
    out = parsed.select("conv_id", "turn", "role", "body", "n_quotes").join(thread, ["conv_id", "turn"], "left")
    full = F.when(F.col("root").isNull(), path).otherwise(F.concat(path_step(F.col("root")), F.lit("/"), "path"))
    return out.select("conv_id", "turn", "role", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), full.alias("reply_path"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))
