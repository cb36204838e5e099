"""The operators applied to their whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolake.llm.chat_perspectives import rotate_perspectives
from kinolake.llm.collocations import mine_collocations
from kinolake.llm.compression_bands import apply_quality_rules
from kinolake.llm.divergence import audit_sources
from kinolake.llm.embedding_dedup import link_vectors
from kinolake.llm.mixing import mix_sources, word_count
from kinolake.llm.packing import pack_documents
from kinolake.llm.simhash_dedup import group_near_duplicates
from kinolake.llm.suffix_dedup import remove_repeats
from kinolake.llm.token_counts import count_tokens
from kinolake.llm.toxicity import fit_toxicity, held_out, score_toxicity
from kinolake.llm.vector_search import nearest
from kinolake.llm.window_dedup import dedup_windows

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op2_substring_dedup", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM words WHERE len(w) >= 20),
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) > 1 AS late
  FROM starts),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
marked AS (
  SELECT p.doc_id, p.i, p.word,
    coalesce(max(CASE WHEN r.late THEN 1 ELSE 0 END)
      OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM places p LEFT JOIN ranked r ON p.doc_id = r.doc_id AND p.i = r.s),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text
  FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_windows(docs).select("doc_id", "n_words", "n_removed",
                                      F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return group_near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_nearest_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query("op3_perspective_rotation", r"""
WITH lines AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM lines WHERE speaker <> 'system'),
told AS (
  SELECT l.*, p.perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM lines l JOIN people p ON l.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM told)
SELECT conv_id, perspective, turn, speaker, role, name, head || text || '<|im_end|>' || chr(10) AS rendered,
  CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END::INTEGER AS mask_start,
  CASE WHEN role = 'assistant' THEN length(text) + 10 ELSE 0 END::INTEGER AS mask_length
FROM headed""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def packable(docs: DataFrame) -> DataFrame:
    """Sizes in words, and clusters of documents that are equal but for case and white space."""
    plain = F.lower(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.xxhash64(plain).alias("cluster"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(packable(table(spark, sf_dir, "documents")))


@query("op9_source_mixing", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS n,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS w FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS k,
    sum(n) OVER () - coalesce(sum(3 * n) OVER before, 0) AS a, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS b
  FROM s WINDOW before AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT a, b FROM o WHERE 3 * n * b >= w * a ORDER BY k LIMIT 1),
t AS (
  SELECT source, n, CASE WHEN 3 * n * b < w * a THEN 3 * n ELSE (w * a)::HUGEINT // b::HUGEINT END AS quota,
    CASE WHEN 3 * n * b < w * a THEN (3 * n)::DOUBLE ELSE (w * a)::DOUBLE / b::DOUBLE END AS target
  FROM s, level),
r AS (
  SELECT d.*, t.n, t.quota, t.target, CASE WHEN n = 0 THEN 0 ELSE quota // n END AS whole,
    CASE WHEN n = 0 THEN 0 ELSE quota % n END AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n::BIGINT AS source_size, round(target, 6) AS target,
  ((whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, plan = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    plan = plan.withColumnRenamed("source", "name")
    return mixed.join(plan, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("toxic_spans").cast("long").alias("n_spans"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, table(spark, sf_dir, "documents"))


@query("op11_source_divergence", r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (
  SELECT s.lang, s.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS p
  FROM g JOIN v USING (lang) JOIN kept USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (
  SELECT lang, term, 1 + 1000000000 * (sum(n) + 1) // (any_value(lang_n) + any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS lang_n FROM c GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 200""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


@query("op12_quality_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_quality_rules(docs).drop("text")


@query("op13_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
sized AS (SELECT lang, w, unnest(range(1, 6)) AS size FROM w WHERE len(w) > 0),
placed AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized WHERE len(w) >= size),
f AS (
  SELECT lang, w[i:i + size - 1] AS words, count(*)::HUGEINT AS f FROM placed GROUP BY ALL HAVING count(*) >= 100),
many AS (SELECT lang, words, f AS a, unnest(range(1, len(words))) AS k FROM f WHERE len(words) > 1),
cuts AS (
  SELECT m.lang, m.words, m.a, n, k, x.f AS l, y.f AS r, (1000 * m.a * n) // (x.f * y.f) AS score
  FROM many m JOIN totals USING (lang) JOIN f x ON x.lang = m.lang AND x.words = m.words[1:k]
  JOIN f y ON y.lang = m.lang AND y.words = m.words[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
spans AS (
  SELECT lang, words, f, unnest(range(1, len(words))) AS i, unnest(range(1, len(words))) AS x FROM f WHERE len(words) > 2),
inside AS (
  SELECT lang, words[i:i + m - 1] AS words, max(f) AS longer
  FROM (SELECT lang, words, f, i, unnest(range(2, len(words) - i + 2)) AS m FROM spans)
  WHERE m < len(words) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.words, ' ')) AS rank,
  array_to_string(b.words, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.words = b.words
WHERE longer IS NULL OR longer < a QUALIFY rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))
