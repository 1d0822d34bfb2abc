"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import (
    chat,
    divergence,
    embedding_dedup,
    exact_dedup,
    jaccard_join,
    language_id,
    licences,
    mixing,
    packing,
    prefix_trie,
    quality,
    substring_dedup,
    warc,
)
from gridloom.session import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a table in fewer row groups than there are cores is dealt anew, as one task would read it all."""
    docs = _read(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    used = docs.select(F.spark_partition_id().alias("p")).distinct().count()  # reads no column
    return docs if used >= cores else docs.repartition(cores)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = licences.scan(docs, licences.train(docs))
    best = F.expr("array_max(transform(filter(found, x -> x.confirmed), x -> x.probability))")
    return found.select("doc_id", "n_paragraphs", "licences", F.size("found").alias("n_predicted"), best.alias("probability"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), with_text=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", (F.coalesce(language_id.bucket(), F.lit(0)) == 0).alias("held_out"), "lang_pred", "score")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "order_key")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir), n=3, num=90, den=100)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"), rebuild=True)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.segments(chat.planted(_read(spark, sf_dir, "conversations")))
    return chat.read_back(found, ordered=True).drop("valid")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_licences": op2_licences,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_language_id": op5_language_id,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_packing": op10_packing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_chat_format": op12_chat_format,
        "op13_divergence": op13_divergence,
    }


#: The upper-case base32 digits.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, max(page_id) OVER (PARTITION BY h, strlen(html)) AS top FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + ((
    ((instr('0123456789abcdef', substr(h, (1 + (5 * i) // 4)::INTEGER, 1)) - 1) * 16
      + CASE WHEN (5 * i) // 4 < 39 THEN instr('0123456789abcdef', substr(h, (2 + (5 * i) // 4)::INTEGER, 1)) - 1 ELSE 0 END)
    >> (3 - (5 * i) % 4)::INTEGER) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM d"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


#: Words as lists, for documents d(doc_id, ws); white space is the six ASCII characters.
_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: From links(u, v), in both directions: the smallest node that each reaches.
_REACHED = """reach AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
low AS (SELECT u, min(v) AS v FROM reach GROUP BY u)"""

SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS key FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM w) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hits, range(50) t(k)),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT p.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (gone.i IS NULL) AS text
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

VECTOR_SQL = f"""
WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM x WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACHED},
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.v, vec_id)) AS component_id, least(vec_id, coalesce(low.v, vec_id)) = vec_id AS kept
FROM x LEFT JOIN n ON n.u = vec_id LEFT JOIN low ON low.u = vec_id"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM i JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 90 * (a.n + b.n - i)),
{_REACHED}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.v, d.doc_id)) AS component_id, least(d.doc_id, coalesce(low.v, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.u = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": WARC_SQL,
        "op3_exact_dedup": EXACT_SQL,
        "op4_substring_dedup": SUBSTRING_SQL,
        "op6_embedding_dedup": VECTOR_SQL,
        "op7_mixing": mixing.mix_sql(),
        "op9_jaccard_join": JACCARD_SQL,
        "op11_prefix_trie": prefix_trie.trie_sql(),
        "op12_chat_format": chat.format_sql(),
        "op13_divergence": divergence.audit_sql(),
    }
