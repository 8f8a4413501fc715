"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, language, near_text, passages, prefix_trie, quality, quality_rules, suffixes, token_files, vectors, warc, whitening
from ._shared import scratch, stash, table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.similar(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {near_text.THRESHOLD} * (p.n + q.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT m.a AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.a = component_id AS kept
FROM m LEFT JOIN n ON n.doc_id = m.a
"""


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_passages(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d),
k AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS g FROM i),
f AS (SELECT g, min(doc_id) AS low FROM k GROUP BY g),
h AS (SELECT k.doc_id, k.pos FROM k JOIN f ON f.g = k.g WHERE f.low < k.doc_id),
c AS (SELECT t.doc_id, t.pos, t.word, coalesce(max(h.pos) OVER (PARTITION BY t.doc_id ORDER BY t.pos) >= t.pos - 12, false) AS gone
      FROM t LEFT JOIN h ON h.doc_id = t.doc_id AND h.pos = t.pos),
o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stash(warc.write_warc(table(spark, sf_dir, "pages"), scratch(spark)))
    paths = archives.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return warc.read_warc(paths, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT *, CASE WHEN n >= {warc.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM w
"""


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
k AS (SELECT doc_id, n, blk, substr(x, blk * 512 + 1, 512 + {2 * suffixes.LENGTH}) AS piece FROM (SELECT *, unnest(range(0, (n + 255) // 256)) AS blk FROM d)),
q AS (SELECT doc_id, blk * 256 + i AS pos, substr(piece, 2 * i + 1, 2) AS byte, CASE WHEN blk * 256 + i <= n - {suffixes.LENGTH} THEN substr(piece, 2 * i + 1, {2 * suffixes.LENGTH}) END AS s
      FROM (SELECT *, unnest(range(0, least(256, n - blk * 256))) AS i FROM k)),
w AS (SELECT doc_id, pos, byte, CASE WHEN s IS NOT NULL THEN hash(s) END AS h, md5_number_lower(s) AS g FROM q),
r AS (SELECT doc_id, pos, byte, h IS NOT NULL AND count(*) OVER (PARTITION BY h, g) > 1 AS again FROM w),
p AS (SELECT doc_id, pos, byte, coalesce(max(CASE WHEN again THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) > pos - {suffixes.LENGTH}, false) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM p),
o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER)
    return token_files.with_crc32(token_files.read_tokens(spark, path)).withColumnRenamed("key", "doc_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_TOKENIZER)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {vectors.THRESHOLD}),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT c.a AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.a = component_id AS kept
FROM c LEFT JOIN n ON n.a = c.a
"""


def _remainder(divisor: int):
    """crc32 of the document id as text, modulo divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.filter(_remainder(3) != 1))
    return quality.score(docs, model).select(
        "doc_id",
        (_remainder(3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs, _remainder(4) != 2)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (_remainder(4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 bit by bit, as this SQL has no function for it.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda y, z: xor(y // 2, (y % 2) * 3988292384))), 4294967295)"
OP12_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, md5(md5(r) || md5(x))) AS l FROM t GROUP BY c),
h AS (SELECT c, l, {_CRC32.format('c::VARCHAR')} % {prefix_trie.HEADS} AS h FROM o),
s AS (SELECT h.c, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN o b ON b.c = h.c - h.c % {prefix_trie.FAMILY}),
m AS (SELECT c, l, d, l[1:d] AS node FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM s)),
n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends_sha256 FROM m GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.node[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n LEFT JOIN k ON k.node = n.node),
z AS (SELECT node[1:i] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM v) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, z.n_leaves::BIGINT AS n_leaves, z.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN z ON z.node = v.node LEFT JOIN n p ON v.d > 0 AND p.node = v.node[1:v.d - 1]
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {
        "op1_near_text": op1_near_text,
        "op3_passages": op3_passages,
        "op2_warc": op2_warc,
        "op4_suffixes": op4_suffixes,
        "op5_token_files": op5_token_files,
        "op6_bpe": op6_bpe,
        "op7_vectors": op7_vectors,
        "op8_quality": op8_quality,
        "op9_language": op9_language,
        "op10_contamination": op10_contamination,
        "op11_whitening": op11_whitening,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_text": OP1_SQL, "op2_warc": OP2_SQL, "op3_passages": OP3_SQL, "op4_suffixes": OP4_SQL, "op7_vectors": OP7_SQL, "op12_prefix_trie": OP12_SQL}
