"""Registered queries about result documents and resources, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalogue import _KNOWN, _PIECES, _SEG, _known, _read, _segments, _strip
from .operators import documents, resources
from .registry import query as _query


def _quote(c: str) -> str:
    return f"coalesce(to_json({c})::VARCHAR, 'null')"


def _sec(c: str) -> str:
    """Seconds of a sample as DuckDB writes a DOUBLE."""
    return f"({c} / 16000.0::DOUBLE)::VARCHAR"


_OPTIONS = """opt AS (SELECT job_id, json_extract_string(o, '$.response_format') AS format, json_extract_string(o, '$.language') AS language,
    list_filter(['emotion', 'audio_events'], lambda k: contains(json_extract_string(o, '$.include'), '"' || k || '"')) AS rich, total
  FROM (SELECT id AS job_id, min(canonical_options_json) AS o, max(total_samples) AS total FROM transcription_jobs WHERE id IS NOT NULL GROUP BY id) WHERE json_extract_string(o, '$.response_format') IS NOT NULL)"""
_TOLD = """told AS (SELECT job_id, max(end_sample) AS last_end, arg_min_null(language, segment_index) FILTER (ok) AS first_language, bool_or(ok AND anonymous_speaker IS NULL) AS unlabelled FROM seg GROUP BY job_id),
j AS (SELECT *, coalesce(total, last_end) AS size FROM opt JOIN (SELECT job_id, last_end, first_language, unlabelled FROM told) USING (job_id))"""
_BOUNDS = f"""'"start":' || {_sec("start_sample")} || ',"end":' || {_sec("end_sample")}"""
_RICH_LIST = ", ".join(
    f"""'"{k}":[' || coalesce(string_agg('{{"label":' || {_quote(f"annotations.{a}")} || ',' || {_BOUNDS} || '}}', ',' ORDER BY segment_index) FILTER (annotations.{a} IS NOT NULL), '') || ']' AS r_{k}"""
    for k, a in documents.RICH.items()
)


def _bodies(speaker: str, match: str, joined: str) -> str:
    """CTEs up to ``d`` (job_id, format, size, body): documents by string concatenation."""
    return f"""WITH {_SEG}, {_PIECES}, {_OPTIONS}, {_TOLD}{joined},
t AS (SELECT job_id, string_agg(piece, '' ORDER BY segment_index) AS text FROM pieces GROUP BY job_id),
sg AS (SELECT job_id,
  string_agg('{{"id":"' || segment_index || '",' || {_BOUNDS} || ',"text":' || {_quote(_strip("text"))} || '}}', ',' ORDER BY segment_index) AS plain,
  string_agg('{{"id":"' || segment_index || '","type":"transcript.text.segment",' || {_BOUNDS} || ',"speaker":' || {_quote(speaker)} || ',"text":' || {_quote(_strip("text"))} || {match} || '}}', ',' ORDER BY segment_index) AS named,
  {_RICH_LIST} FROM seg {"LEFT JOIN named USING (job_id, anonymous_speaker)" if joined else ""} WHERE ok GROUP BY job_id),
x AS (SELECT j.*, coalesce(text, '') AS text, coalesce(plain, '') AS plain, coalesce(named, '') AS named,
    CASE WHEN len(rich) > 0 THEN ',"funasr":{{' || array_to_string(list_transform(rich, lambda k: CASE WHEN k = 'emotion' THEN coalesce(r_emotion, '"emotion":[]') ELSE coalesce(r_audio_events, '"audio_events":[]') END), ',') || '}}' ELSE '' END AS extra,
    CASE WHEN size = 0 THEN '0' ELSE {_sec("size")} END AS duration FROM j LEFT JOIN t USING (job_id) LEFT JOIN sg USING (job_id)),
d AS (SELECT job_id, format, size, format = 'diarized_json' AND unlabelled AS bad, CASE format WHEN 'text' THEN text WHEN 'json' THEN '{{"text":' || {_quote("text")} || extra || '}}'
  WHEN 'verbose_json' THEN '{{"task":"transcribe","language":' || {_quote("CASE WHEN language <> 'auto' THEN language ELSE coalesce(first_language, 'unknown') END")} || ',"duration":' || duration || ',"text":' || {_quote("text")} || ',"segments":[' || plain || ']' || extra || '}}'
  ELSE '{{"task":"transcribe","duration":' || duration || ',"text":' || {_quote("text")} || ',"segments":[' || named || ']' || extra || '}}' END AS body FROM x)"""


_LABELS = _bodies("anonymous_speaker", "''", "")
_NAMES = _bodies(
    "coalesce(m_name, 'Unknown ' || anonymous_speaker)",
    """CASE WHEN m_name IS NOT NULL THEN ',"funasr":{"speaker_id":' || to_json(m_id) || ',"anonymous_speaker":' || to_json(anonymous_speaker) || ',"similarity":' || m_like || '}' ELSE '' END""",
    f""", {_KNOWN}, named AS (SELECT job_id, label AS anonymous_speaker, max(m.name) AS m_name, max_by(m.id, m.name) AS m_id, max_by(round(m.sim, 4), m.name) AS m_like FROM c JOIN m USING (vector_id) GROUP BY ALL)""",
)


def _parts(spark: SparkSession, d: str, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    options = documents.with_options(_read(spark, d, "transcription_jobs"))
    return options, documents.parts(_segments(spark, d), options, names)


@_query(f"{_LABELS} SELECT job_id, format, CASE WHEN NOT bad THEN body END AS body, CASE WHEN bad THEN 'unlabelled' END AS error FROM d")
def result_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The result document of each job in the format it asked for, with the parts it asked for."""
    options, fragments = _parts(spark, d)
    return documents.bodies(fragments).join(options.select("job_id", "format"), "job_id").select("job_id", "format", "body", "error")


@_query(f"{_LABELS} SELECT job_id, sum(CASE WHEN bad THEN 0 ELSE octet_length(encode(body)) END)::BIGINT AS bytes FROM d GROUP BY job_id")
def result_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The size of each document from its parts alone, without ever joining them."""
    return _parts(spark, d)[1].groupBy("job_id").agg(F.sum(F.octet_length("fragment")).alias("bytes"))


@_query(f"{_NAMES} SELECT job_id, CASE WHEN NOT bad THEN body END AS body, CASE WHEN bad THEN 'unlabelled' END AS error FROM d WHERE format = 'diarized_json'")
def named_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The documents with speakers, named by the known profiles."""
    known = _known(spark, d).where("name is not null").groupBy("job_id", "label").agg(F.max("name").alias("name"), F.max_by("id", "name").alias("id"), F.max_by(F.round("similarity", 4), "name").alias("similarity"))
    options = documents.with_options(_read(spark, d, "transcription_jobs")).where("format = 'diarized_json'")
    return documents.bodies(documents.parts(_segments(spark, d), options, known))


@_query(f"""{_LABELS}, b AS (SELECT job_id, bool_or(start_sample < 0 OR end_sample <= start_sample OR start_sample < coalesce(p, 0) OR end_sample > size) AS out FROM (
  SELECT job_id, start_sample, end_sample, lag(end_sample) OVER (PARTITION BY job_id ORDER BY segment_index) AS p FROM seg WHERE ok) JOIN j USING (job_id) GROUP BY job_id)
SELECT job_id, CASE WHEN format IN ('verbose_json', 'diarized_json') AND out THEN 'bad_bounds' END AS error FROM d LEFT JOIN b USING (job_id) WHERE NOT bad""")
def body_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each document read back strictly: what it breaks. The bounds are those of the segments, some of which overlap."""
    options, fragments = _parts(spark, d)
    sizes = _segments(spark, d).groupBy("job_id").agg(F.max("end_sample").alias("last_end"))
    rows = documents.bodies(fragments).where("error is null").drop("error").join(options.select("job_id", "format", "total"), "job_id").join(sizes, "job_id")
    return documents.body_errors(rows.withColumn("total", F.coalesce("total", "last_end"))).select("job_id", "error")


_INSTANT = "CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime(timezone('UTC', {c}), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(timezone('UTC', {c}), '%Y-%m-%dT%H:%M:%S.%fZ') END"


@_query(f"""SELECT DISTINCT id, status, CASE
  WHEN status IN ('queued', 'running') THEN '{{"id":' || to_json(id) || ',"status":' || to_json(status) || ',"progress":{{"processed_audio_secs":' || {_sec("processed_samples")} || ',"total_audio_secs":' || coalesce({_sec("total_samples")}, 'null') || '}}}}'
  WHEN status = 'failed' THEN '{{"id":' || to_json(id) || ',"status":"failed","error":{{"message":"' || CASE WHEN error_code = 'worker_crashed' THEN 'The transcription worker crashed' ELSE 'Internal server error' END || '","type":"server_error","param":null,"code":"' ||
    CASE WHEN error_code = 'worker_crashed' THEN 'worker_crashed' ELSE 'internal_error' END || '"}},"finished_at":"' || {_INSTANT.format(c="finished_at")} || '"}}'
  WHEN status = 'cancelled' THEN '{{"id":' || to_json(id) || ',"status":"cancelled","finished_at":"' || {_INSTANT.format(c="finished_at")} || '"}}' END AS resource
FROM transcription_jobs WHERE phase = 'visible' AND id IS NOT NULL""")
def job_resources(spark: SparkSession, d: str) -> DataFrame:
    return resources.jobs(_read(spark, d, "transcription_jobs").where("phase = 'visible' and id is not null")).distinct()


@_query(f"""SELECT id, '{{"id":' || to_json(id) || ',"object":"speaker","name":' || to_json(name) || ',"description":' || {_quote("description")} || ',"sample_count":' || sample_count || ',"embedding_model":{{"id":"encoder","revision":' || to_json(embedding_model_revision) ||
  ',"dimension":' || embedding_dimension || ',"policy_fingerprint":' || to_json(embedding_policy_fingerprint) || '}},"created_at":"' || {_INSTANT.format(c="created_at")} || '","updated_at":"' || {_INSTANT.format(c="updated_at")} || '"}}' AS resource FROM speaker_profiles""")
def speaker_resources(spark: SparkSession, d: str) -> DataFrame:
    return resources.speakers(_read(spark, d, "speaker_profiles"), "encoder")


@_query("""SELECT model AS id, '{"id":"' || model || '","object":"model","created":1704067200,"owned_by":"engine"}' AS resource FROM (
  SELECT DISTINCT json_extract_string(canonical_options_json, '$.model') AS model FROM transcription_jobs) WHERE model IS NOT NULL""")
def model_list(spark: SparkSession, d: str) -> DataFrame:
    """The models that jobs ask for, as a list of resources."""
    names = _read(spark, d, "transcription_jobs").select(F.get_json_object("canonical_options_json", "$.model").alias("id")).where("id is not null").distinct()
    return resources.models(names, 1_704_067_200, "engine")
