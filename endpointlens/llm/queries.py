"""One query for each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (filter_audit, heap_kmeans, language_id, line_dedup, pii, qgram_filter, recompression, sentencepiece_lattice,
               simhash_vptree, toxicity, url_filter, va_file, warc)
from .common import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return qgram_filter.contaminated(docs, table(spark, sf_dir, "benchmark")).drop("text")


def scaled(embeddings: DataFrame) -> DataFrame:
    """Components as floor(64 x); null where a component is missing or not finite."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")))
    return embeddings.select("vec_id", F.when(fit, vector).alias("vector"))


@query("op2_exact_top_k", """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 20""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(scaled(table(spark, sf_dir, "embeddings")), F.expr("vec_id % 20 = 0"), k=20)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = language_id.held_out(parts=4, part=2)
    docs = table(spark, sf_dir, "documents").select("doc_id", apart.alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").where(~apart).select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.learn(docs, labels)).drop("text")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.learn(docs.where("NOT held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
         url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
         url_filter.Rule("block", "net", "/fr/")]


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "lines", "removed", "text")


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_lattice.load()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, model), model)
    same = F.col("decoded") == F.replace("text", F.lit(sentencepiece_lattice.SPACE), F.lit(" "))
    return both.select("doc_id", F.size("ids").alias("n_ids"), "ids", same.alias("round_trip"))


@query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

def _kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as plain scans of all pairs of a vector and a centroid."""
    parts = [r"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c
  FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, j, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id, v ORDER BY d, j) AS place FROM (
      SELECT vec_id, v, j, c, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
      FROM v, c{r}))
  WHERE place = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.j, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM (
      SELECT j, pos, sum(x) AS s, count(*) AS n
      FROM (SELECT j, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM a{r}) GROUP BY j, pos)
    GROUP BY j) AS m USING (j))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds}"""


@query("op11_centroid_clustering", _kmeans_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    kept = table(spark, sf_dir, "embeddings").where((F.size("embedding") == 64) & fit)
    return heap_kmeans.cluster(kept.select("vec_id", vector.alias("vector")))


@query("op12_filter_interaction_audit", r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
      len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f
  FROM texts LEFT JOIN marks USING (doc_id)),
docs AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, f),
one AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS t(l, i)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
  FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
seen AS (
  SELECT part, filter_order, step, o[step] AS filter, n, good, toxic, f[o[step]] AS failing,
         len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 AS earlier,
         len(list_filter(f, lambda x: x)) = 1 AND f[o[step]] AS alone
  FROM docs, steps),
totals AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (NOT failing AND NOT earlier), 0) AS kept,
         coalesce(sum(n) FILTER (failing AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (failing AND earlier), 0) AS redundant,
         coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (failing AND NOT earlier), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (failing AND NOT earlier), 0) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM totals""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))

@query("op13_substring_dedup", r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts WHERE len(words) >= 50),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w FROM places),
gone AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE doc_id > least),
covered AS (
  SELECT doc_id, list(k) AS ks FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM gone) GROUP BY doc_id),
kept AS (
  SELECT doc_id, words, CASE WHEN ks IS NULL THEN words
         ELSE list_filter(words, lambda w, k: NOT list_contains(ks, k)) END AS left_words
  FROM texts LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(left_words) AS BIGINT) AS n_removed,
       sha256(array_to_string(left_words, ' ')) AS kept_sha256
FROM kept""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
