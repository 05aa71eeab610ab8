"""SQL of the newer corpus queries, built from their constants."""

from __future__ import annotations

from . import sharding


def crc_table() -> list[int]:
    """CRC-32 of each byte, by its definition: eight steps of the reversed polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


TABLE = f"CAST({crc_table()} AS BIGINT[])"


def crc32(blob: str) -> str:
    """The CRC-32 of a blob: its bytes, by way of hexadecimal digits, folded over the table."""
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce([4294967295] || {octets}, lambda c, b: xor(c >> 8, list_extract({TABLE}, CAST(xor(c & 255, b) + 1 AS BIGINT)))))"


def feistel(rows: str) -> str:
    """SQL over rows (row, x, n) -> (row, x, n): one pass of the network; halves are l and r."""
    low, (m1, m2), (s1, s2, s3) = sharding.LOW, sharding.MULTIPLY, sharding.SHIFT
    bits = "CAST(greatest(2, length(bin(n - 1))) AS BIGINT)"
    sql = f"SELECT row, n, rb, lb, x >> rb AS l, x & ((CAST(1 AS UBIGINT) << rb) - 1) AS r FROM (SELECT row, n, CAST(x AS UBIGINT) AS x, CAST({bits} - {bits} // 2 AS UBIGINT) AS rb, CAST({bits} // 2 AS UBIGINT) AS lb FROM ({rows}) a)"
    for i, key in enumerate(sharding.round_keys(sharding.SEED)):
        to, other, width = ("l", "r", "lb") if i % 2 == 0 else ("r", "l", "rb")
        sql = f"SELECT row, n, rb, lb, l, r, xor({other}, CAST({key} AS UBIGINT)) AS f FROM ({sql}) a"
        for shift, times in ((s1, m1), (s2, m2)):
            sql = f"SELECT row, n, rb, lb, l, r, (xor(f, f >> {shift}) * CAST({times} AS UBIGINT)) & {low} AS f FROM ({sql}) a"
        sql = f"SELECT row, n, rb, lb, {other}, xor({to}, xor(f, f >> {s3}) & ((CAST(1 AS UBIGINT) << {width}) - 1)) AS {to} FROM ({sql}) a"
    return f"SELECT row, CAST((l << rb) | r AS BIGINT) AS x, n FROM ({sql}) a"


def op13(shards: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
u AS (SELECT DISTINCT bytes, {crc32("bytes")} AS crc32 FROM (SELECT DISTINCT bytes FROM d) a),
k AS (SELECT doc_id, bytes, CAST(row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(bytes)) - 1 AS BIGINT) AS row, CAST(count(*) OVER () AS BIGINT) AS n FROM d),
w AS ({feistel("SELECT row, row AS x, n FROM k")} UNION ALL {feistel("SELECT row, x, n FROM w WHERE x >= n")})
SELECT doc_id, CAST(octet_length(k.bytes) + 8 AS BIGINT) AS size, u.crc32 AS text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM k JOIN u USING (bytes) JOIN w ON w.row = k.row AND w.x < w.n
"""


def op11() -> str:
    """Backwards over the turns, the best (cost, audit) from each state of the grammar: start (z), after s, after u, after a."""
    edit = lambda name, cost, to: f"{{'c': {cost} + {to}.c, 'a': '{name}' || {to}.a}}"
    least = lambda *options: f"list_sort([{', '.join(options)}])[1]"

    def use(state: str) -> str:
        """Deleting, keeping or changing the turn (initial x, p: what it costs to leave it in) in a state."""
        wanted, after = ("a", "a") if state == "u" else ("u", "u")
        keep = f"WHEN x = '{wanted}' THEN {edit('K', 'p', f'g.{after}')}" + (f" WHEN x = 's' THEN {least(edit('K', 'p', 'g.s'), edit('R', 'p + 3', 'g.u'))}" if state == "z" else "")
        drop = edit("D", 4, f"g.{state}")
        return f"CASE WHEN forced THEN {drop} ELSE {least(drop, f'CASE {keep} ELSE {edit("R", "p + 3", f"g.{after}")} END')} END"

    used = ", ".join(f"'{s}': {use(s)}" for s in "zsua")
    closed = f"{{'z': {least('h.z', edit('I', 3, 'v.u'))}, 's': {least('h.s', edit('I', 3, 'v.u'))}, 'u': v.u, 'a': v.a}}"
    inner = f"{{'u': {least('h.u', edit('I', 3, 'h.a'))}, 'a': {least('h.a', edit('I', 3, 'h.u'))}}}"
    end = "{'z': {'c': 0, 'a': ''}, 's': {'c': 6, 'a': 'II'}, 'u': {'c': 3, 'a': 'I'}, 'a': {'c': 0, 'a': ''}}"
    return f"""
WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32("encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM n WHERE kind <> 0),
e AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth) AS i, count(*) OVER (PARTITION BY conv_id) AS n, substr(role, 1, 1) AS x, t = '' AS blank, t <> '' AND nth > 1 AS dup, t <> '' AND nth = 1 AND right(t, 1) NOT IN ('.', '!', '?') AS cut FROM e),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM f) a GROUP BY conv_id),
w AS (SELECT DISTINCT conv_id, CAST(n + 1 AS BIGINT) AS i, {end} AS g FROM f
  UNION ALL SELECT conv_id, i, {closed} FROM (SELECT conv_id, i, h, {inner} AS v FROM (SELECT w.conv_id, f.i, {{{used}}} AS h
    FROM w JOIN (SELECT conv_id, i, x, blank OR dup AS forced, CASE WHEN cut THEN 3 ELSE 0 END AS p FROM f) f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i - 1) a) b),
r AS (SELECT conv_id, g.z.c AS cost, g.z.a AS audit FROM w WHERE i = 1),
l AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, audit FROM r),
o AS (SELECT conv_id, k, substr(audit, k, 1) AS edit, length(replace(substr(audit, 1, k), 'I', '')) AS i, length(replace(substr(audit, k), 'D', '')) AS rest FROM l),
z AS (SELECT o.conv_id, string_agg(CASE WHEN edit = 'K' THEN f.role WHEN rest % 2 = 1 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS s
  FROM o LEFT JOIN f ON o.conv_id IS NOT DISTINCT FROM f.conv_id AND o.i = f.i WHERE edit <> 'D' GROUP BY o.conv_id)
SELECT c.conv_id, coalesce(m.gaps, 0) AS gaps, coalesce(m.blank, 0) AS blank, coalesce(m.duplicate, 0) AS duplicate, coalesce(m.truncated, 0) AS truncated, coalesce(m.illegal, 0) AS illegal,
  CAST(coalesce(r.cost, 0) AS BIGINT) AS cost, coalesce(r.audit, '') AS audit, sha256(coalesce(z.s, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
