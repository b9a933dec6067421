"""The queries of the corpus operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift.llm import (
    bpe,
    centroids,
    chat,
    html_content,
    language,
    lexical,
    mixing,
    quality,
    quality_rules,
    simhash,
    token_files,
    topk,
    toxicity,
)
from credsift.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_digest(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatting_digest(spark, table(spark, sf_dir, "conversations"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with markup, address and host evidence."""
    pages = table(spark, sf_dir, "pages")
    return language.page_languages(pages, table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_rules.rules_digest(documents, table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.files_digest(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.hundredth_queries(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxicity_digest(documents, table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.quality_digest(documents, table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return lexical.ranked_documents(documents, table(spark, sf_dir, "benchmark"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.pages_digest(table(spark, sf_dir, "pages"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters_digest(table(spark, sf_dir, "embeddings"))


def quality_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over pages, whose addresses give host and path."""
    pages = table(spark, sf_dir, "pages")
    texts = html_content.main_text(F.col("html"), html_content.train(pages))
    documents = table(spark, sf_dir, "documents")
    return quality.page_quality(pages, texts, documents, table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_simhash_dedup,
        op3_chat_format,
        op4_language_id,
        language_id_pages,
        op5_byte_bpe,
        op6_quality_rules,
        op7_token_files,
        op8_exact_topk,
        op9_toxicity,
        op10_quality,
        quality_pages,
        op11_lexical_search,
        op12_html_text,
        op13_centroid_clusters,
    )
}

# The same weights, limits and seeded draws as in ``mixing``.
_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight,
         2e0 * source_size AS most
  FROM sources),
before AS (
  SELECT *, most / weight AS ratio,
         coalesce(sum(most) OVER w, 0e0) AS capped, coalesce(sum(weight) OVER w, 0e0) AS used,
         row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place
  FROM weighted
  WINDOW w AS (ORDER BY most / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
totals AS (SELECT 1.5e0 * sum(source_size) AS total, sum(weight) AS weights FROM weighted),
levels AS (
  SELECT arg_min((total - capped) / (weights - used), place) AS level
  FROM before, totals WHERE (total - capped) / (weights - used) <= ratio),
targets AS (
  SELECT source, source_size, coalesce(least(most, level * weight), most) AS target
  FROM before, levels),
rates AS (
  SELECT doc_id, size, source_size, target, target / source_size AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
           / 4503599627370496e0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0
            THEN size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)
            ELSE 0 END::BIGINT AS taken
FROM rates
"""

_TOPK = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024e0 * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.ints::DOUBLE[], c.ints::DOUBLE[])::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
                         AND len(q.ints) = len(c.ints)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""



_LEXICAL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT d, doc_id, len(words)::BIGINT AS n FROM docs WHERE len(words) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
tfs AS (
  SELECT d, word, count(*)::BIGINT AS tf FROM (SELECT d, unnest(words) AS word FROM docs)
  GROUP BY d, word),
weights AS (
  SELECT word, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM tfs, corpus GROUP BY word, docs),
items AS (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id),
asked AS (
  SELECT item_id, word, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word
    FROM items)
  GROUP BY item_id, word),
scored AS (
  SELECT item_id, d, doc_id,
         sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))
           ::BIGINT AS score
  FROM asked JOIN tfs USING (word) JOIN weights USING (word) JOIN sizes USING (d), corpus
  GROUP BY item_id, d, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


# What the pages of the tables need of the rules: one article, inline <b>, three references.
_HTML = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inside FROM pages),
texts AS (
  SELECT page_id, url, regexp_replace(regexp_replace(inside, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')
           AS raw
  FROM inner_html),
decoded AS (
  SELECT page_id, url,
         trim(regexp_replace(regexp_replace(regexp_replace(raw, '&quot;?', '"', 'g'),
                                            '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
  FROM texts)
SELECT page_id, url, coalesce(text, '') AS text, coalesce(length(text), 0)::BIGINT AS n_chars
FROM decoded
"""


def _clustering(rounds: int = 10) -> str:
    """One step of the WITH list per round; squared distances as sums over unnested components."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id,
         list_transform(embedding, lambda x: floor(1024e0 * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster, ints
  FROM kept QUALIFY cluster < 8)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT place, vec_id, k.ints, cluster,
         list_sum(list_transform(list_zip(k.ints, c.ints),
                                 lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
  FROM kept k CROSS JOIN c{r} c
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT cluster, d, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean
  FROM (SELECT cluster, unnest(ints) AS x, generate_subscripts(ints, 1) AS d FROM a{r})
  GROUP BY cluster, d),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.ints, c.ints) AS ints
  FROM c{r} c LEFT JOIN (
    SELECT cluster, list(mean ORDER BY d) AS ints FROM m{r} GROUP BY cluster) m USING (cluster))""")
    listed = ",\n".join(steps)
    return f"""WITH {listed}
SELECT vec_id, a.cluster, distance,
       sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.ints, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)
"""


ORACLES: dict[str, str] = {
    "op1_source_mixing": _MIXING,
    "op8_exact_topk": _TOPK,
    "op11_lexical_search": _LEXICAL,
    "op12_html_text": _HTML,
    "op13_centroid_clusters": _clustering(),
}
