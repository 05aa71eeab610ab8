"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, langid, license_scan, merkle, mixing, packing, quality, repair, sharding, simhash, sql, toxicity, warc
from .common import checkpointed, crc32_mod, scratch_path

TOKENIZER = "word_bpe_49k.json"
#: Tokenizers A and B of op12.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["start"].alias("first_word"), F.get("places", F.size("places") - 1)["start"].alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(*chat.swapped_reply_pairs(table(spark, sf_dir, "conversations"))).withColumnRenamed("pair_id", "conv_id")


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.with_next(table(spark, sf_dir, "documents")).withColumn("edited", merkle.half_edited(F.col("text"), F.col("next_text")))
    for name in ("text", "edited", "next_text"):
        rows = merkle.merkle(rows, name, f"{name}_print")
    a, b, c = (F.col(f"{x}_print") for x in ("text", "edited", "next_text"))
    return rows.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        a.alias("fingerprint"), b.alias("edited_fingerprint"), merkle.likeness(a, b).alias("near_edited"), merkle.likeness(a, c).alias("near_next"),
        F.array_join(merkle.differing(a, b), ",").alias("edited_paragraphs"),
    )


def packed(docs: DataFrame, ids: bool = False) -> DataFrame:
    """Pieces of docs in sequences of at most 2048 tokens: with a digest of their token ids, and the ids on demand.

    Ids stay in the stored pieces while these are placed, and are joined to their places.
    """
    cut = packing.pieces(docs, tokenizer_path(), ids=ids, digest=True).withColumnRenamed("id", "doc_id")
    pieces = checkpointed(cut.withColumn("piece", F.monotonically_increasing_id()))
    found = packing.pack(pieces.drop("ids"))
    found = found.join(pieces.select("piece", "ids"), "piece") if ids else found
    return found.select("doc_id", "start", "length", *["ids"] * ids, "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.mixing_plan(docs, repetition=4.0)
    return mixing.mix(docs.select("doc_id", "source"), plan)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc32_mod("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED)).withColumnRenamed("id", "doc_id")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_license_scan, op2_warc, op3_simhash, op4_preferences, op5_merkle, op6_packing, op7_langid, op8_mixing, op9_quality, op10_toxicity, op11_repair, op12_alignment, op13_sharding, pipeline]
    return {f.__name__: f for f in own}


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS first, count(*) AS n FROM d GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', CAST(1 + (CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN n = 1 OR page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n = 1 OR page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM d JOIN m USING (hex)
"""

OP4_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
reply AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS l FROM t WHERE role = 'assistant' GROUP BY conv_id),
ends AS (SELECT a.conv_id, a.l.turn AS fin, b.l.text AS lent FROM reply a JOIN reply b ON b.conv_id = xor(a.conv_id, 1)),
r AS (SELECT t.conv_id, turn, role, text FROM t JOIN ends USING (conv_id) WHERE turn < fin UNION ALL SELECT conv_id, fin, 'assistant', lent FROM ends),
c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS o FROM t),
r2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS o FROM r),
diff AS (SELECT coalesce(c2.conv_id, r2.conv_id) AS conv_id, min(CASE WHEN c2.role = r2.role AND c2.text = r2.text THEN NULL ELSE coalesce(c2.o, r2.o) END) AS d, count(c2.o) AS n
  FROM c2 FULL JOIN r2 ON c2.conv_id = r2.conv_id AND c2.o = r2.o GROUP BY 1),
k AS (SELECT conv_id, coalesce(d - 1, n) AS n FROM diff WHERE conv_id IN (SELECT conv_id FROM ends)),
x AS (SELECT 'c' AS side, c2.*, k.n FROM c2 JOIN k USING (conv_id) UNION ALL SELECT 'r', r2.*, k.n FROM r2 JOIN k USING (conv_id)),
y AS (SELECT conv_id, side, o, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s,
  CASE WHEN role = 'assistant' THEN CAST(13 + length(role) AS VARCHAR) || ':' || CAST(length(text) + 11 AS VARCHAR) ELSE CAST(24 + length(role) + length(text) AS VARCHAR) || ':0' END AS m FROM x)
SELECT conv_id, n AS prompt_turns, coalesce(string_agg(s, '' ORDER BY o) FILTER (side = 'c' AND o <= n), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY o) FILTER (side = 'c' AND o > n), '') AS chosen, coalesce(string_agg(s, '' ORDER BY o) FILTER (side = 'r' AND o > n), '') AS rejected,
  coalesce(string_agg(m, ',' ORDER BY o) FILTER (side = 'c' AND o > n), '') AS chosen_mask, coalesce(string_agg(m, ',' ORDER BY o) FILTER (side = 'r' AND o > n), '') AS rejected_mask
FROM y GROUP BY conv_id, n
"""


def op1_sql() -> str:
    """Every block of every text against every template of its class, by counting, and phrases at every word."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    scan = license_scan
    templates = ", ".join(
        f"('{t.label}', {t.places}, {scan.stride_of(t)}, {scan.needed(t)}, {quoted(sorted(set(t.words)))}, {quoted(t.words)})" for t in scan.PHRASES + scan.NOTICES
    )
    return f"""
WITH t(label, phrase, stride, need, tw, seq) AS (VALUES {templates}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT doc_id, stride, unnest(range(0, len(ws), stride)) AS start, ws FROM d, (SELECT DISTINCT stride FROM t WHERE NOT phrase) s),
h AS (SELECT doc_id, stride, list_distinct(ws[start + 1:start + 2 * stride]) AS held FROM b),
m AS (SELECT doc_id, label, max(len(list_intersect(held, tw))) / len(any_value(tw)) AS share FROM h JOIN t USING (stride) WHERE NOT phrase AND len(list_intersect(held, tw)) >= need GROUP BY 1, 2),
p AS (SELECT doc_id, label, unnest(list_filter(range(0, len(ws) - len(seq) + 1), lambda i: ws[i + 1:i + len(seq)] = seq)) AS place FROM d, t WHERE phrase),
q AS (SELECT doc_id, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY 1),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM p) u GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(q.n, 0) AS n_base, f AS first_word, l AS last_word, coalesce(q.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE WHEN q.n > 0 THEN 1.0 ELSE coalesce((SELECT max(share) FROM m WHERE m.doc_id = d.doc_id), 0.0) END AS score
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN a USING (doc_id)
"""


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx, length(t) // 2 AS h FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(t, 1, length(t) - h) || substr(nx, 1, h) AS ed FROM n),
c AS (SELECT t, list_transform(string_split(t, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s)(?:.{0,62}?[.!?;][\\x09-\\x0d ]|.{1,64})'), lambda x: sha256(x))) AS l
  FROM (SELECT t FROM e UNION SELECT ed FROM e) u),
p AS (SELECT t, list_transform(l, lambda y: {'h': sha256(coalesce(array_to_string(y, ''), '')), 'c': coalesce(array_to_string(list_transform(y, lambda z: substr(z, 1, 8)), ''), '')}) AS ps FROM c),
m AS (SELECT t, list_transform(ps, lambda x: x.c || CASE WHEN substr(x.h, 1, 1) IN ('0', '8') THEN '|' ELSE ',' END) AS cs,
  list_transform(ps, lambda x: x.h || CASE WHEN substr(x.h, 1, 1) IN ('0', '8') THEN '|' ELSE ',' END) AS hs FROM p),
s AS (SELECT t, left(array_to_string(cs, ''), -1) AS cs, left(array_to_string(hs, ''), -1) AS hs FROM m),
f AS (SELECT t, substr(sha256(array_to_string(list_transform(string_split(hs, '|'), lambda x: sha256(x)), ',')), 1, 32) AS r, string_split(cs, '|') AS s, cs FROM s),
q AS (SELECT doc_id, 0 AS k, a.t AS ta, b.t AS tb, a.r = b.r AS eq, a.s AS x, b.s AS y FROM e JOIN f a ON a.t = e.t JOIN f b ON b.t = e.ed
  UNION ALL SELECT doc_id, 1, a.t, b.t, a.r = b.r, a.s, b.s FROM e JOIN f a ON a.t = e.t JOIN f b ON b.t = e.nx),
q1 AS (SELECT *, list_distinct(list_filter(x, lambda v: list_contains(y, v))) AS ss,
  list_distinct(flatten(list_transform(list_filter(x, lambda v: NOT list_contains(y, v)), lambda v: string_split(v, ',')))) AS px,
  list_distinct(flatten(list_transform(list_filter(y, lambda v: NOT list_contains(x, v)), lambda v: string_split(v, ',')))) AS py FROM q),
q2 AS (SELECT *, list_filter(px, lambda v: list_contains(py, v)) AS sp,
  list_distinct(flatten(list_transform(list_filter(px, lambda v: NOT list_contains(py, v)), lambda v: regexp_extract_all(v, '.{8}')))) AS cx,
  list_distinct(flatten(list_transform(list_filter(py, lambda v: NOT list_contains(px, v)), lambda v: regexp_extract_all(v, '.{8}')))) AS cy FROM q1),
q3 AS (SELECT *, (length(replace(array_to_string(ss, ''), ',', '')) + length(array_to_string(sp, ''))) / 8 + len(list_filter(cx, lambda v: list_contains(cy, v))) AS same,
  len(list_filter(cx, lambda v: NOT list_contains(cy, v))) + len(list_filter(cy, lambda v: NOT list_contains(cx, v))) AS rest FROM q2),
z AS (SELECT doc_id, k, CASE WHEN eq THEN 1.0 ELSE same / (same + greatest(rest, 1)) END AS near,
  CASE WHEN eq THEN '' ELSE coalesce((SELECT string_agg(i - 1, ',' ORDER BY i) FROM (SELECT unnest(ay) AS v, generate_subscripts(ay, 1) AS i) w WHERE NOT list_contains(ax, v)), '') END AS at
  FROM (SELECT *, flatten(list_transform(x, lambda v: string_split(v, ','))) AS ax, flatten(list_transform(y, lambda v: string_split(v, ','))) AS ay FROM q3) q4)
SELECT e.doc_id, length(e.t) AS n_chars, sha256(ed) AS edited_sha256, a.r || ':' || a.cs AS fingerprint, b.r || ':' || b.cs AS edited_fingerprint,
  CAST(z0.near AS DOUBLE) AS near_edited, CAST(z1.near AS DOUBLE) AS near_next, z0.at AS edited_paragraphs
FROM e JOIN f a ON a.t = e.t JOIN f b ON b.t = e.ed JOIN z z0 ON z0.doc_id = e.doc_id AND z0.k = 0 JOIN z z1 ON z1.doc_id = e.doc_id AND z1.k = 1
"""

#: The quotas in closed form: with the least budget that shows every document, the most repeated
#: source is seen (largest / smallest share) ** (1 - alpha) times.
OP8_SQL = """
WITH n AS (SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS u, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))) AS tokens,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS doc FROM documents),
t AS (SELECT s, u, sum(tokens) AS tokens FROM n GROUP BY 1, 2),
p AS (SELECT *, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS p, CAST(sum(tokens) OVER () AS DOUBLE) AS every FROM t),
a AS (SELECT CASE WHEN max(p) / min(p) <= 4.0 THEN 0.0 ELSE 1 - ln(4.0) / ln(max(p) / min(p)) END AS alpha FROM p),
w AS (SELECT p.*, pow(p, alpha) / sum(pow(p, alpha)) OVER () AS w FROM p, a),
q AS (SELECT *, max(p / w) OVER () * w * every AS quota, CAST(greatest(1, tokens // 1048576) AS BIGINT) AS blocks FROM w),
e AS (SELECT *, CAST(floor(quota / tokens + 1e-9) AS BIGINT) AS epochs, greatest(0, quota - floor(quota / tokens + 1e-9) * tokens) AS rest FROM q),
k AS (SELECT n.*, e.epochs, e.rest, n.doc % e.blocks AS block FROM n JOIN e USING (s, u)),
o AS (SELECT *, CAST('0x' || substr(md5('11:' || epochs || ':' || block), 1, 15) AS BIGINT) AS bk, CAST('0x' || substr(md5('12:' || epochs || ':' || doc), 1, 15) AS BIGINT) AS dk FROM k),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY s, u ORDER BY bk, dk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(tokens) OVER (PARTITION BY s, u, bk, dk) AS used FROM o),
r AS (SELECT *, unnest(range(CAST(0 AS BIGINT), epochs + CASE WHEN rest >= 1 AND used < rest THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, block, CAST('0x' || substr(md5('11:' || epoch || ':' || block), 1, 15) AS BIGINT) AS block_key,
  CAST('0x' || substr(md5('12:' || epoch || ':' || doc), 1, 15) AS BIGINT) AS doc_key FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": op1_sql(), "op2_warc": OP2_SQL, "op4_preferences": OP4_SQL, "op5_merkle": OP5_SQL, "op8_mixing": OP8_SQL, "op11_repair": sql.op11(), "op13_sharding": sql.op13(SHARDS)}
