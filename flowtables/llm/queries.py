"""The registered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.llm import (
    decontamination,
    filter_audit,
    graph_search,
    language,
    licenses,
    minmax,
    packing,
    pii,
    prefix_trie,
    source_mix,
    substrings,
    token_counts,
    warc,
)
from flowtables.session import new_folder
from flowtables.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function
    return register


@query(licenses.scan_sql("documents"))
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentences", ",").alias("sentences"),
                        F.array_join("licenses", ",").alias("licenses"),
                        F.size("unmatched").cast("long").alias("n_unmatched"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT sha256(html) AS digest, min(page_id) AS first FROM p
      WHERE strlen(html) >= 100 GROUP BY 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON sha256(html) = digest
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then read the archives back."""
    folder = new_folder(spark, "archives")
    warc.write_archives(read_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS words
  FROM documents),
places AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 49)) AS p, words FROM split),
windows AS (SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS h FROM places),
smallest AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
removed AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS i
  FROM windows JOIN smallest USING (h) WHERE m < doc_id),
each AS (
  SELECT doc_id, unnest(words) AS w, unnest(generate_series(1, len(words))) AS i FROM split),
kept AS (
  SELECT e.doc_id, string_agg(w, ' ' ORDER BY e.i) AS t, count(*) AS n
  FROM each e ANTI JOIN removed r ON e.doc_id = r.doc_id AND e.i = r.i GROUP BY e.doc_id)
SELECT s.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that a document with a smaller id holds."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(documents).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
each AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM split WHERE len(w) > 0),
sized AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM each),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b
    ON a.s = b.s AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= 80 * (a.n + b.n - count(*))),
reach(d, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT d, b FROM reach JOIN links ON r = a),
sizes AS (SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id)
SELECT d AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id,
       min(r) = d AS kept
FROM reach LEFT JOIN sizes ON d = doc_id GROUP BY d
""")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 80 percent of their 2-word shingles."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minmax.near_groups(documents, shingle=2, similarity=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query()
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth vector, found in the graphs of all."""
    rows = read_table(spark, sf_dir, "embeddings")
    found = graph_search.nearest(graph_search.index_vectors(rows),
                                 rows.where(F.col("vec_id") % 50 == 0))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return language.identify(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score")


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences of at most 2048."""
    return packing.pack(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


@query()
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    found = decontamination.contaminated(read_table(spark, sf_dir, "documents"),
                                         read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("items").alias("item_id"))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(documents)
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}")
              for kind in pii.KINDS]
    return found.select("doc_id", *counts,
                        F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


@query()
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mixture of the sources takes."""
    return source_mix.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query(filter_audit.audit_sql())
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of each order, per language."""
    counts = filter_audit.failure_counts(read_table(spark, sf_dir, "documents"),
                                         read_table(spark, sf_dir, "labels"))
    return filter_audit.interactions(counts)


@query(prefix_trie.TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.rebuilt(read_table(spark, sf_dir, "conversations")))
