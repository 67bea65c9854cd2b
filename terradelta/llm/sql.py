"""DuckDB SQL of the corpus queries that SQL can express, over views ``documents`` and ``benchmark``."""

from __future__ import annotations

from .mixing import GROUP, MOST, SHARE, WEIGHTS

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
NAMED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
NO_ID = (1 << 63) - 1

SUFFIX_ARRAY_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {NO_ID}) AS key, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT rid, key, i, h[i + 1 : i + 50] AS s FROM (SELECT *, unnest(range(0, octet_length(h) - 49)) AS i FROM d)),
least AS (SELECT s, min(key) AS low FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT w.rid, w.i FROM w JOIN least USING (s) WHERE least.low < w.key),
runs AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run
         FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM gone)),
spans AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY rid, run),
pieces AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM spans),
per AS (SELECT d.rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
               string_agg(hex(d.h[before + 1 : a]), '' ORDER BY a) AS kept
        FROM pieces JOIN d USING (rid) GROUP BY d.rid)
SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(h[coalesce(last, 0) + 1 : octet_length(h)]))) AS kept_sha256
FROM d LEFT JOIN per USING (rid)
"""

_weight = f"list_extract([{', '.join(map(str, WEIGHTS))}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT)"
SOURCE_MIXING = f"""
WITH RECURSIVE rows_ AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {SPACED}))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, {_weight}::DOUBLE AS weight, sum(size)::DOUBLE * {MOST} AS most FROM rows_ GROUP BY source),
levels AS (SELECT *, ((SELECT sum(size) FROM rows_) * {SHARE}::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
           FROM per WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
free AS (SELECT arg_min(own, most / weight) AS level FROM levels WHERE most > own * weight),
targets AS (SELECT source, source_size, n_docs, coalesce(least(most, level * weight), most) AS target FROM levels, free),
rates AS (SELECT *, CASE WHEN source_size > 0 AND target > 0 THEN least(round(target / source_size, 12), {MOST}) ELSE 0.0 END AS rate FROM targets),
ranked AS MATERIALIZED (
  SELECT r.doc_id, r.size, t.source, t.source_size, t.target, t.rate, least(floor(rate + 1e-9), {MOST}) AS low, salt, row_number() OVER (PARTITION BY t.source, salt ORDER BY size DESC, doc_id NULLS LAST) AS n
  FROM (SELECT *, ('0x' || substring(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 8))::BIGINT AS digest FROM rows_) r
  JOIN rates t ON r.source IS NOT DISTINCT FROM t.source, LATERAL (SELECT digest % ceil(t.n_docs / {GROUP}.0)::BIGINT AS salt)),
parts AS MATERIALIZED (SELECT *, CASE WHEN low >= {MOST} OR rate - low <= 1e-12 THEN 0.0 ELSE rate - low END AS part FROM ranked),
walk AS (
  SELECT source, salt, 0::BIGINT AS n, 0.0::DOUBLE AS open, 0 AS more FROM (SELECT DISTINCT source, salt FROM parts)
  UNION ALL
  SELECT p.source, p.salt, p.n, CASE WHEN p.size > 0 AND 2 * (w.open + p.part * p.size) >= p.size AND p.part > 0 THEN w.open + p.part * p.size - p.size ELSE w.open + p.part * p.size END,
         CASE WHEN p.size > 0 AND 2 * (w.open + p.part * p.size) >= p.size AND p.part > 0 THEN 1 ELSE 0 END
  FROM walk w JOIN parts p ON p.source IS NOT DISTINCT FROM w.source AND p.salt = w.salt AND p.n = w.n + 1)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * (p.low + w.more))::BIGINT AS taken, p.source, p.rate, (p.low + w.more)::BIGINT AS copies
FROM parts p JOIN walk w ON p.source IS NOT DISTINCT FROM w.source AND p.salt = w.salt AND p.n = w.n
"""

# XXH64 (seed 42) of a string given as hex, by the constants of its published definition
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_SEED, _ALL = 42, 1 << 64


def _mul(a: str, b) -> str:
    return f"((({a})::UHUGEINT * ({b})::UHUGEINT) % {_ALL}::UHUGEINT)::UBIGINT"


def _add(a: str, b) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {_ALL}::UHUGEINT)::UBIGINT"


def _rotl(x: str, r: int) -> str:
    return f"xor({_mul(x, 1 << r)}, ({x}) >> {64 - r})"


def _round(acc: str, lane: str) -> str:
    """One accumulation, in a scalar subquery-free form: the rotated sum is named by a one-element list."""
    total = _add(acc, _mul(lane, _P[1]))
    return f"list_transform([{total}], lambda t: {_mul(_rotl('t', 31), _P[0])})[1]"


def _read(h: str, at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes at byte ``at`` (from 0) of the hex string."""
    return "('0x' || " + " || ".join(f"substring({h}, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT"


def xxh64_steps(source: str, key: str) -> str:
    """CTEs that end in ``hashed(key, h)`` from ``source`` with distinct strings ``key``."""
    starts = [(_SEED + _P[0] + _P[1]) % _ALL, (_SEED + _P[1]) % _ALL, _SEED, (_SEED - _P[0]) % _ALL]
    lane = lambda k: f"list_reduce(list_prepend({starts[k]}::UBIGINT, list_transform(range(0, n // 32), lambda s: {_read('hx', f'32 * s + {8 * k}', 8)})), lambda acc, x: {_round('acc', 'x')})"
    merged = lambda h, v: _add(_mul(f"xor({h}, {_round('0::UBIGINT', v)})", _P[0]), _P[3])
    by8 = f"list_reduce(list_prepend(h0, list_transform(range(0, (n % 32) // 8), lambda s: {_read('hx', 'n - n % 32 + 8 * s', 8)})), lambda acc, x: list_transform([xor(acc, {_round('0::UBIGINT', 'x')})], lambda t: {_add(_mul(_rotl('t', 27), _P[0]), _P[3])})[1])"
    by4 = f"CASE WHEN n % 8 >= 4 THEN list_transform([xor(h1, {_mul(_read('hx', 'n - n % 8', 4), _P[0])})], lambda t: {_add(_mul(_rotl('t', 23), _P[1]), _P[2])})[1] ELSE h1 END"
    by1 = f"list_reduce(list_prepend(h2, list_transform(range(0, n % 4), lambda s: {_read('hx', 'n - n % 4 + s', 1)})), lambda acc, x: list_transform([xor(acc, {_mul('x', _P[4])})], lambda t: {_mul(_rotl('t', 11), _P[0])})[1])"
    fold = lambda x, by, p: _mul(f"xor({x}, ({x}) >> {by})", p)
    return f"""
x0 AS (SELECT {key}, hex(encode({key})) AS hx, (octet_length(encode({key})))::BIGINT AS n FROM {source}),
x1 AS (SELECT *, {lane(0)} AS v1, {lane(1)} AS v2, {lane(2)} AS v3, {lane(3)} AS v4 FROM x0 WHERE n >= 32),
x2 AS (SELECT {key}, hx, n, {_add(_add(_rotl('v1', 1), _rotl('v2', 7)), _add(_rotl('v3', 12), _rotl('v4', 18)))} AS m, v1, v2, v3, v4 FROM x1),
x3 AS (SELECT * EXCLUDE (m), {merged('m', 'v1')} AS m FROM x2), x4 AS (SELECT * EXCLUDE (m), {merged('m', 'v2')} AS m FROM x3),
x5 AS (SELECT * EXCLUDE (m), {merged('m', 'v3')} AS m FROM x4), x6 AS (SELECT * EXCLUDE (m), {merged('m', 'v4')} AS m FROM x5),
x7 AS (SELECT {key}, hx, n, {_add('m', 'n')} AS h0 FROM x6 UNION ALL SELECT {key}, hx, n, {_add(str((_SEED + _P[4]) % _ALL) + '::UBIGINT', 'n')} AS h0 FROM x0 WHERE n < 32),
x8 AS (SELECT *, {by8} AS h1 FROM x7), x9 AS (SELECT *, {by4} AS h2 FROM x8), x10 AS (SELECT *, {by1} AS h3 FROM x9),
x11 AS (SELECT {key}, {fold('h3', 33, _P[1])} AS h3 FROM x10), x12 AS (SELECT {key}, {fold('h3', 29, _P[2])} AS h3 FROM x11),
hashed AS MATERIALIZED (SELECT {key}, xor(h3, h3 >> 32) AS h FROM x12)"""


_bits = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
SIMHASH = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, {SPACED}) AS w FROM documents),
s AS MATERIALIZED (SELECT rid, array_to_string(w[i : i + 2], ' ') AS shingle FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
names AS (SELECT DISTINCT shingle FROM s), {xxh64_steps('names', 'shingle')},
prints AS (SELECT rid, ({_bits})::UBIGINT AS fp FROM s JOIN hashed USING (shingle) GROUP BY rid),
every AS MATERIALIZED (SELECT rid, doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN prints USING (rid)),
nodes AS MATERIALIZED (SELECT fp, min(doc_id) AS low FROM every GROUP BY fp),
links AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::HUGEINT) <= 3),
reach AS (SELECT fp AS a, fp AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
found AS (SELECT reach.a AS fp, min(nodes.low) AS component_id FROM reach JOIN nodes ON nodes.fp = reach.b GROUP BY reach.a)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM every JOIN found USING (fp)
"""

SUBSTRING_DEDUP = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
s AS MATERIALIZED (SELECT rid, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM s SEMI JOIN twice USING (s)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, {NAMED}) AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER}, {NAMED}) AS w FROM benchmark),
asked AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s
          FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
said AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM asked))),
hits AS MATERIALIZED (SELECT rid, said.k, i, item FROM said JOIN asked ON said.k = asked.k AND said.s = asked.s),
n AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) FROM hits) GROUP BY rid),
names AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN names USING (rid)
"""

ORACLE_SQL = {
    "op1_suffix_array_dedup": SUFFIX_ARRAY_DEDUP,
    "op2_source_mixing": SOURCE_MIXING,
    "op5_simhash_near_dedup": SIMHASH,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op8_benchmark_decontamination": DECONTAMINATION,
}
