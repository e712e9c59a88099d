"""The queries of this folder: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, jaccard_join, language, lm_scoring, minhash, mixing, prefix_trie, quality, resampling, sharding, token_counts, warc
from .common import documents

#: The vocabulary that the encoding and counting queries use; a parameter of the operators.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir)).drop("spans")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary_path())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(pages(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir), vocabulary_path())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_language, op4_jaccard_join, op5_bpe, op6_sharding, op7_lm_scoring, op8_warc, op9_token_counts, op10_mixing, op11_resampling, op12_prefix_trie, op13_minhash)}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Sets by list functions, links by the shingles that two documents share, components by reaching out along links.
_LINKED = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: {shingle})) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n_shingles FROM s),
y AS (SELECT doc_id, unnest(s) AS sh FROM s),
x AS (SELECT DISTINCT doc_id, sh FROM y WHERE sh IN (SELECT sh FROM y GROUP BY sh HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * common >= {percent} * (u.n_shingles + v.n_shingles - common)),
r(doc_id, id) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.id)
SELECT doc_id, n_shingles, component_id{more} FROM n JOIN (SELECT doc_id, min(id) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""


def _linked(words: int, percent: int, more: str = "") -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return _LINKED.format(lower=_LOWER.format("text"), words=words, percent=percent, shingle=shingle, more=more)


_OP8 = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM k"""


#: A table for crc32 byte by byte, and the crc32 of a string by it.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_t)"
_CRC = "xor(4294967295, list_reduce(list_transform(range(1, octet_length(encode({0})) + 1), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i, 1)) - 1), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1]), 4294967295))"
#: Features by document and by bucket, gains by bucket, ranks by a window.
_OP11 = r"""WITH {table},
d AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS w FROM d), g AS (SELECT unnest(regexp_extract_all({lower}, '{word}')) AS w FROM benchmark),
v AS (SELECT w, {crc} % 10000 AS b FROM (SELECT w FROM f UNION SELECT w FROM g), crc),
s AS (SELECT b, count(*) AS s FROM f JOIN v USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM g JOIN v USING (w) GROUP BY b),
e AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM g) AS t),
k AS (SELECT s.b, CAST(floor(1000 * ln(CAST(coalesce(t.t, 0) + 1 AS DOUBLE) * (e.s + 10000) / (CAST(s.s + 1 AS DOUBLE) * (e.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), e),
m AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN v USING (w) JOIN k USING (b) GROUP BY doc_id),
h AS (SELECT doc_id, coalesce(len(w), 0) AS n_features, CASE WHEN total IS NULL THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight, list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1), lambda a, x: a * 16 + x) AS h FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM h),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM o) // 100 THEN place END AS rank FROM r LEFT JOIN o USING (doc_id)""".format(table=_CRC_TABLE, lower=_LOWER.format("text"), word=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", crc=_CRC.format("w"))
#: Nodes by prefix; subtrees by the prefixes of their nodes.
_OP12 = r"""WITH {table},
o AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT o.conv_id, o.t, coalesce(b.t, []) AS b, {crc} % 4 AS h FROM crc, (SELECT *, CAST(conv_id AS VARCHAR) AS c FROM o) o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
r AS (SELECT conv_id, b[1:h] || t[h + 1:] AS t FROM h),
q AS (SELECT conv_id, len(t) AS len, d AS depth, t[1:d] AS p FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM r)),
n AS (SELECT depth, md5(CAST(p AS VARCHAR)) AS id, md5(CAST(p[1:depth - 1] AS VARCHAR)) AS up, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256 FROM q GROUP BY depth, id, up),
k AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth][2], '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN (SELECT depth - 1 AS depth, up AS id, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2) c USING (depth, id)),
a AS (SELECT unnest(range(depth + 1)) AS up_to, p, n_children, saved FROM k),
u AS (SELECT up_to AS depth, md5(CAST(p[1:up_to] AS VARCHAR)) AS id, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a GROUP BY 1, 2)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, u.n_leaves, u.saved_tokens, k.ends_sha256 FROM k JOIN u USING (depth, id) LEFT JOIN n p ON p.depth = k.depth - 1 AND p.id = k.up""".format(table=_CRC_TABLE, crc=_CRC.format("c"))


def oracle_sql() -> dict[str, str]:
    """The others hang on seeded hashes, trained models or a tokenizer; tests compare those with brute force."""
    kept = ", doc_id = component_id AS kept"
    return {"op4_jaccard_join": _linked(4, 85), "op8_warc": _OP8, "op11_resampling": _OP11, "op12_prefix_trie": _OP12, "op13_minhash": _linked(2, 80, kept)}
