"""Registered queries of the text operators: each reads whole tables and derives the result's digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontam, licenses, lines, negatives, ppm, quality, sentencepiece_bpe, sharding, simhash, suffixes, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose two texts consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat.digests(chat.assembled(turns, ranks), ranks).drop("n_tokens")


OP1_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, length(r) + length(x) + len(regexp_extract_all(r, '<\\*/?s>|\[\\*/?INST\]')) + len(regexp_extract_all(x, '<\\*/?s>|\[\\*/?INST\]')) n FROM t)
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) loss_sha256,
  CAST(3 + sum(n + 17) AS BIGINT) formatted_chars
FROM l GROUP BY conv_id
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words"),
        F.col("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM docs),
b AS (SELECT CAST(item_id AS VARCHAR) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, text, n, i, array_to_string(w[i:i + n - 1], ' ') g
       FROM (SELECT doc_id, text, w, n, unnest(range(1, len(w) - n + 2)) i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, text, n, i, item_id FROM dw JOIN bw USING (n, g)),
hits AS (SELECT doc_id, text, count(DISTINCT p) n_hit FROM (SELECT doc_id, text, unnest(range(i, i + n)) p FROM h) GROUP BY ALL),
items AS (SELECT doc_id, text, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) s FROM (SELECT DISTINCT doc_id, text, item_id FROM h) GROUP BY ALL)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id AND d.text IS NOT DISTINCT FROM hits.text
  LEFT JOIN items ON d.doc_id = items.doc_id AND d.text IS NOT DISTINCT FROM items.text
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs))


def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.sign_codes(table(spark, sf_dir, "embeddings"))
    return topk.nearest(codes.where("id % 20 = 0"), codes, 10)


OP9_SQL = """
WITH c AS (SELECT vec_id id, list_transform(embedding, lambda x: x > 0) b FROM embeddings),
p AS (SELECT q.id query_id, c.id neighbour_id, CAST(list_sum([CASE WHEN q.b[i] = c.b[i] THEN 0 ELSE 1 END FOR i IN range(1, 65)]) AS BIGINT) distance
  FROM c q, c WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) rank FROM p)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of lines that the threshold links counts, whether anchors bring it together or not."""
    found = lines.deduplicated(table(spark, sf_dir, "documents"), exact=True)
    return found.select("doc_id", "line_counts.n_lines", "line_counts.n_kept", "text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 50; every seventh id has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.scaled(table(spark, sf_dir, "embeddings"), label)
    return negatives.mined(rows, F.col("id") % 50 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT a.id, c.id other, a.label = c.label same, CAST(list_inner_product(a.v, c.v) AS BIGINT) score FROM e a JOIN e c ON a.id % 50 = 0 AND a.id <> c.id),
p AS (SELECT id, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 5)
SELECT p.id anchor_id, p.other positive_id, CAST(row_number() OVER (PARTITION BY p.id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) rank, s.other negative_id,
  p.score positive_score, s.score negative_score
FROM p JOIN s ON p.id = s.id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
"""


def op12_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``: forty shards in eight racks of four regions, and one more as a region of its own."""
    tree = sharding.even_tree(40)
    placed = sharding.assigned(table(spark, sf_dir, "documents"), tree, sharding.grown(tree, 40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _nibble(x: int) -> int:
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


OP12_SQL = f"""
WITH leaves AS (SELECT range s, '/r' || (range * 8 // 40 * 4 // 8) reg, '/k' || (range * 8 // 40) rk FROM range(40)),
keys AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') k FROM documents),
tops AS (SELECT reg, CAST(count(*) AS DOUBLE) w FROM leaves GROUP BY reg UNION ALL SELECT '/own40', 1.0),
racks AS (SELECT reg, rk, CAST(count(*) AS DOUBLE) w FROM leaves GROUP BY ALL),
d1 AS (SELECT k, reg, -ln((('0x' || substr(md5(k || reg), 1, 13))::BIGINT + 0.5) / 16.0 ** 13) / w d FROM keys, tops),
r1 AS (SELECT k, arg_min(reg, d) FILTER (reg <> '/own40') reg, arg_min(reg, d) = '/own40' own FROM d1 GROUP BY k),
r2 AS (SELECT k, reg, own, arg_min(rk, -ln((('0x' || substr(md5(k || reg || rk), 1, 13))::BIGINT + 0.5) / 16.0 ** 13) / w) rk FROM r1 JOIN racks USING (reg) GROUP BY ALL),
r3 AS (SELECT k, own, arg_min(s, -ln((('0x' || substr(md5(k || reg || rk || '/' || s), 1, 13))::BIGINT + 0.5) / 16.0 ** 13)) s FROM r2 JOIN leaves USING (reg, rk) GROUP BY ALL),
t AS (SELECT {[_nibble(x) for x in range(16)]}::BIGINT[] t),
b AS (SELECT doc_id, coalesce(text, '') x, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') h FROM documents),
c AS (SELECT doc_id, strlen(x) + 16 size, xor(4294967295::BIGINT, list_reduce(list_transform(h, lambda c: ('0x' || c)::BIGINT),
    lambda a, x: xor(xor(a, x) >> 8, xor(t[1 + (xor(a, x) & 15)] >> 4, t[1 + (xor(xor(a, x) >> 4, t[1 + (xor(a, x) & 15)]) & 15)])), 4294967295::BIGINT)) crc FROM b, t)
SELECT doc_id, size, crc text_crc32, 'key' law, CAST(s AS INTEGER) shard, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, size, crc) - 1 slot,
  CAST(CASE WHEN own THEN 40 ELSE s END AS INTEGER) grown_shard
FROM c JOIN r3 ON coalesce(CAST(doc_id AS VARCHAR), '') = k
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') phrase, count(*) a
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) i FROM w, range(1, 5) sizes(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') ws, a FROM g WHERE m > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, c.k, l.a l, r.a r, CAST(2000000::HUGEINT * c.a // (l.a::HUGEINT + r.a) AS BIGINT) score
  FROM (SELECT *, unnest(range(1, m)) k FROM c) c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(ws[:k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT DISTINCT lang, a, array_to_string(ws[i:i + j - 1], ' ') phrase
  FROM (SELECT *, unnest(range(1, m - j + 2)) i FROM (SELECT *, unnest(range(2, m)) j FROM c))),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN parts ON s.lang = parts.lang AND s.phrase = parts.phrase AND 100 * parts.a >= 80 * s.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank, phrase, a, l, r, score FROM worst ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_license_scan": op2_license_scan,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_ppm_score": op6_ppm_score,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op9_hamming_topk": op9_hamming_topk,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_hash_tree_shards": op12_hash_tree_shards,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op1_chat_format": OP1_SQL,
    "op9_hamming_topk": OP9_SQL,
    "op4_decontaminate": OP4_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_hash_tree_shards": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
