"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain.llm import (
    bitplanes,
    budget_mix,
    byte_cnn,
    fragment_jaccard,
    gru_lm,
    heap_bpe,
    lexical_scan,
    pivots,
    secret_dfa,
    suffix_decontam,
    toxic_grammar,
    url_temporal,
    whitening,
)
from scenegrain.sources.tables import shared_dir, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DAYS = 720


def op1_bitplane_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/scenegrain/planes-{uuid.uuid4().hex}"
    bitplanes.write_planes(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return bitplanes.read_planes(spark, path)


def op2_pivot_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_gru_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gru_lm.score_documents(table(spark, sf_dir, "documents"), byte_cnn.crc_fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_heap_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_bpe.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.predict_languages(table(spark, sf_dir, "documents"))


def op6_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_secret_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_dfa.scan_secrets(table(spark, sf_dir, "documents"))


def op8_fragment_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_jaccard.near_documents(table(spark, sf_dir, "documents"))


def op9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.mix(table(spark, sf_dir, "documents")).drop("copies")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetch, spread over DAYS days by their id."""
    return pages.select("page_id", "url", (F.col("page_id") * 7919 % DAYS).alias("fetch_day"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list made of all pages: the host, or for every second page the domain above it, is added, or for every third
    one removed, on a day spread by the id."""
    host = url_temporal.host_of(F.col("url"))
    above = F.regexp_replace(host, r"^[^.]*\.", "")
    return pages.select(
        F.when(F.col("page_id") % 2 == 0, host).otherwise(above).alias("domain"),
        (F.col("page_id") * 104729 % DAYS).alias("day"),
        F.when(F.col("page_id") % 3 == 2, "remove").otherwise("add").alias("action"),
        F.col("page_id").alias("entry_id"),
    )


def op10_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_temporal.temporal_filter(captures(pages), list_entries(pages))


def op11_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_grammar.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_scan.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bitplane_token_ids,
        op2_pivot_near_vectors,
        op3_gru_lm_score,
        op4_heap_bpe_count,
        op5_byte_cnn_language,
        op6_suffix_decontamination,
        op7_secret_dfa,
        op8_fragment_jaccard,
        op9_budget_mix,
        op10_temporal_url_list,
        op11_toxic_grammar,
        op12_block_whitening,
        op13_automaton_search,
    )
}

ORACLES = {
    "op2_pivot_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / norm) AS e FROM v WHERE norm > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.98
), reach(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE r.c < l.b
), comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, CAST(comp.c AS BIGINT) AS component_id, e.vec_id = comp.c AS kept
FROM embeddings e JOIN comp ON comp.id = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
""",
    "op6_suffix_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
""",
    "op8_fragment_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT o.a, o.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) o
  JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * o.o >= 75 * (p.n + q.n - o.o)
), reach(id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE r.c < l.b
)
SELECT e.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c.c AS BIGINT) AS component_id
FROM documents e JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) c ON c.id = e.doc_id LEFT JOIN n ON n.doc_id = e.doc_id
""",
    "op10_temporal_url_list": r"""
WITH p AS (
  SELECT page_id, url, page_id * 7919 % 720 AS fetch_day,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host FROM pages
), e AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN host ELSE regexp_replace(host, '^[^.]*\.', '') END AS domain,
    page_id * 104729 % 720 AS day, CASE WHEN page_id % 3 = 2 THEN 'remove' ELSE 'add' END AS action, page_id AS entry_id
  FROM p
), asked AS (
  SELECT page_id, url, fetch_day, array_to_string(list_slice(l, i, len(l)), '.') AS domain
  FROM (SELECT page_id, url, fetch_day, string_split(host, '.') AS l, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM p WHERE host IS NOT NULL)
), last AS (
  SELECT a.page_id, a.url, a.domain, arg_max(e.action, (e.day, e.entry_id)) AS action, max(e.day) AS day
  FROM asked a JOIN e ON e.domain = a.domain AND e.day <= a.fetch_day GROUP BY ALL
), runs AS (SELECT * FROM last WHERE action = 'add'),
best AS (SELECT page_id, url, count(DISTINCT domain) AS n, arg_max(domain, (length(domain), domain)) AS matched, arg_max(day, (length(domain), domain)) AS active_from FROM runs GROUP BY ALL)
SELECT p.page_id, host, fetch_day, CAST(coalesce(n, 0) AS BIGINT) AS n_active, matched, CAST(coalesce(active_from, -1) AS BIGINT) AS active_from, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN best ON best.page_id = p.page_id AND best.url = p.url
""",
    "op13_automaton_search": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark
), s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM b) GROUP BY term),
p AS (
  SELECT doc_id, t.term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part
  FROM t JOIN f ON f.term = t.term, s
), scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM p JOIN b ON b.term = p.term GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""",
}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
