"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import clusters, encoding, language, leaks, pii, runs, splitting, turns


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = runs.region_runs(_read(spark, d, "speaker_regions"))
    return found.where("n_regions >= 2").select("job_id", "start_sample", "end_sample")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.region_runs(_read(spark, d, "speaker_regions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(_read(spark, d, "segment_records")).select("job_id", "speaker", "start_sample", "end_sample")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of each spoken record with its turn."""
    return turns.turn_texts(_read(spark, d, "segment_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_long_jobs(_read(spark, d, "transcription_jobs"), _read(spark, d, "segment_records"))
    return pieces.select("job_id", "start_sample", "end_sample")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(_read(spark, d, "documents"), _read(spark, d, "segment_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(_languages(spark, d))


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document, every line of a mixed document and every segment with its language and a confidence."""
    rows = _languages(spark, d).where("kind <> 'line' or mixed").groupBy("kind", "ref", "part_no")
    return rows.agg(F.min("language").alias("language"), F.max("confidence").alias("confidence"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    windows = _read(spark, d, "speaker_embedding_windows").select("vector_id", F.col("embedding").cast("array<double>").alias("v"))
    return windows.unionByName(_read(spark, d, "anonymous_speaker_clusters").select("vector_id", F.col("centroid").alias("v")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_groups(_vectors(spark, d), "vector_id", "v", alone=False).select("group_id", "vector_id")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group with its size and most typical members, those nearest to its centre."""
    vectors = _vectors(spark, d)
    return clusters.described(clusters.similarity_groups(vectors, "vector_id", "v"), vectors, "vector_id", "v")


def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each group with the number of its cells, the size of the densest and some members of that."""
    return clusters.densest(clusters.similarity_groups(_vectors(spark, d), "vector_id", "v"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(_read(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(_read(spark, d, "documents"), _read(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without the leaked passages."""
    docs = _read(spark, d, "documents")
    return leaks.without_leaks(docs, leaks.leaked(docs, _read(spark, d, "eval_items"))).select("doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(_read(spark, d, "documents")).select("doc_id", "kind", "start_char")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents with a placeholder for each piece of personal data."""
    return pii.redacted(_read(spark, d, "documents"))


_QUERIES = (p1_found, p1_runs, p2_found, p2_turns, p3_found, p4_found, p4_languages, p5_found, p5_groups, p5_cells, p6_ids, p7_found, p7_clean, p8_found, p8_clean)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_RUNS = r"""
WITH named AS (
  SELECT job_id, start_sample, end_sample, received_at,
    nullif(regexp_extract(trim(regexp_replace(upper(translate(anonymous_speaker, '{wide}', '{plain}')), '\s+', ' ', 'g')),
      '^(?:(?:SPEAKER|SPKR|SPK|UNKNOWN|说话人|說話人|話者|화자|SPRECHER|LOCUTEUR|LOCUTOR)[\s_-]*)?([A-Z]{{1,3}})\s*[:>]?$', 1), '') AS speaker
  FROM speaker_regions WHERE end_sample > start_sample AND job_id IS NOT NULL),
one AS (
  SELECT job_id, start_sample AS s, end_sample AS e, coalesce(arg_min(speaker, received_at) FILTER (speaker IS NOT NULL), '') AS l
  FROM named GROUP BY ALL),
marked AS (SELECT *, coalesce(lag(l) OVER w, '?') <> l AS fresh FROM one WINDOW w AS (PARTITION BY job_id ORDER BY s, e)),
blocks AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY job_id ORDER BY s, e) AS b FROM marked),
reached AS (SELECT *, max(e) OVER (PARTITION BY job_id, b ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM blocks),
numbered AS (SELECT *, sum((m IS NULL OR s > m + 1600)::INT) OVER (PARTITION BY job_id ORDER BY s, e) AS r FROM reached),
runs AS (
  SELECT job_id, any_value(l) AS speaker, min(s) AS start_sample, max(e) AS end_sample, count(*) AS n_regions
  FROM numbered WHERE l <> '' GROUP BY job_id, r)
"""


_PAIRS = """
WITH a AS (SELECT vector_id, embedding::DOUBLE[] AS v FROM speaker_embedding_windows UNION ALL SELECT vector_id, centroid FROM anonymous_speaker_clusters),
u AS (SELECT vector_id AS id, any_value(v) AS v FROM a WHERE vector_id IS NOT NULL AND len(v) = 192 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND list_sum(list_transform(v, lambda x: abs(x))) > 0 GROUP BY vector_id),
n AS (SELECT id, w, w::FLOAT[192] AS v FROM (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS w FROM u)),
g AS (SELECT min(b.id) AS group_id, a.id AS vector_id FROM n a JOIN n b ON array_inner_product(a.v, b.v) >= 0.675 GROUP BY a.id)"""


def oracle_sql() -> dict[str, str]:
    from .marks import _PLAIN, _WIDE

    base = _RUNS.format(wide=_WIDE, plain=_PLAIN)
    return {
        "p1_found": base + "SELECT job_id, start_sample, end_sample FROM runs WHERE n_regions >= 2",
        "p1_runs": base + "SELECT job_id, speaker, start_sample, end_sample, n_regions, end_sample - start_sample AS duration FROM runs",
        # Brute force over all pairs; groups being cliques, the least like vector names the group.
        "p5_found": _PAIRS + """
SELECT group_id, vector_id FROM g WHERE group_id <> vector_id OR vector_id IN (SELECT group_id FROM g WHERE group_id <> vector_id)""",
        "p5_groups": _PAIRS + """,
x AS (SELECT group_id, vector_id, w FROM g JOIN n ON id = vector_id),
m AS (SELECT group_id, i, avg(w[i]) AS a FROM x, generate_series(1, 192) AS t(i) GROUP BY ALL),
c AS (SELECT group_id, list(a ORDER BY i) AS c FROM m GROUP BY group_id),
r AS (SELECT group_id, vector_id, row_number() OVER (PARTITION BY group_id ORDER BY list_dot_product(w, c) / sqrt(list_dot_product(c, c)) DESC, vector_id) AS r FROM x JOIN c USING (group_id))
SELECT group_id, count(*) AS size, list(vector_id ORDER BY r) FILTER (r <= 5) AS typical FROM r GROUP BY group_id""",
        "p3_found": """
WITH RECURSIVE sizes AS (SELECT id AS job_id, max(total_samples) AS size FROM transcription_jobs WHERE id IS NOT NULL GROUP BY id HAVING max(total_samples) > 4800000),
spans AS (SELECT DISTINCT job_id, start_sample AS s, end_sample AS e FROM segment_records SEMI JOIN sizes USING (job_id)),
ends AS (
  SELECT DISTINCT a.job_id, a.e AS b FROM spans a JOIN sizes z ON z.job_id = a.job_id
  WHERE a.e > 0 AND a.e < z.size AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.job_id = a.job_id AND x.s < a.e AND x.e > a.e)),
lists AS (SELECT z.job_id, z.size, coalesce(list(b ORDER BY b) FILTER (b IS NOT NULL), []) AS bs FROM sizes z LEFT JOIN ends USING (job_id) GROUP BY ALL),
pieces AS (
  SELECT job_id, size, bs, 0::BIGINT AS s, coalesce(list_max(list_filter(bs, lambda b: b > 80000 AND b <= 4800000)), 4800000)::BIGINT AS e FROM lists
  UNION ALL
  SELECT job_id, size, bs, e - 80000, CASE WHEN size - (e - 80000) <= 4800000 THEN size ELSE
    coalesce(list_max(list_filter(bs, lambda b: b > e AND b <= e - 80000 + 4800000)), e - 80000 + 4800000) END FROM pieces WHERE e < size)
SELECT job_id, s AS start_sample, e AS end_sample FROM pieces""",
    }
