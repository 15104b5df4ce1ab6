"""Registered queries about options, sizes, batches and identities, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalogue import _ISL, _LEASES, _REG, _SEG, _leases, _read, _regions, _segments, _spans
from .operators import admission, identity, ledger, packing
from .registry import query as _query

# Options as the jobs carry them.
_OPT = """opt AS (SELECT DISTINCT id, o, json_extract_string(o, '$.model') AS model, json_extract_string(o, '$.language') AS lang, json_extract_string(o, '$.response_format') AS fmt,
  json_extract_string(o, '$.chunking_strategy') AS chunking, coalesce(json_extract(o, '$.include')::VARCHAR[], []) AS incl, coalesce(json_extract(o, '$.known_speaker_ids')::VARCHAR[], []) AS known
  FROM (SELECT id, canonical_options_json AS o FROM transcription_jobs WHERE canonical_options_json IS NOT NULL))"""


def _options(spark: SparkSession, d: str, *more: str) -> DataFrame:
    o = "canonical_options_json"
    rows = _read(spark, d, "transcription_jobs").where(f"{o} is not null").select("id", o, *more).distinct()
    text = {"model": "model", "lang": "language", "fmt": "response_format", "chunking": "chunking_strategy"}
    lists = {"incl": "include", "known": "known_speaker_ids"}
    return rows.select("id", *more, *[F.get_json_object(o, f"$.{k}").alias(a) for a, k in text.items()], *[F.from_json(F.get_json_object(o, f"$.{k}"), "array<string>").alias(a) for a, k in lists.items()])


@_query(f"""WITH {_OPT} SELECT DISTINCT id, CASE WHEN model IS NULL OR model NOT IN ('sensevoice', 'sensevoice-diarize') THEN 'invalid_model'
  WHEN lang IS NULL OR lang NOT IN ('auto', 'zh', 'en', 'yue', 'ja', 'ko') THEN 'invalid_language' WHEN chunking <> 'auto' THEN 'invalid_chunking_strategy'
  WHEN model = 'sensevoice-diarize' AND chunking IS NULL THEN 'diarization_requires_vad' WHEN model = 'sensevoice-diarize' AND fmt IS DISTINCT FROM 'diarized_json' THEN 'diarization_requires_format'
  WHEN model = 'sensevoice' AND fmt = 'diarized_json' THEN 'diarized_format_requires_model' WHEN fmt NOT IN ('', 'json', 'text', 'verbose_json', 'diarized_json') THEN 'invalid_response_format'
  WHEN len(list_filter(incl, lambda x: x NOT IN ('funasr.emotion', 'funasr.audio_events'))) > 0 THEN 'invalid_include' WHEN fmt = 'text' AND len(incl) > 0 THEN 'incompatible_response_format'
  WHEN len(list_distinct(known)) < len(known) OR len(known) > 32 OR len(list_filter(known, lambda x: NOT regexp_full_match(x, '[0-9A-HJKMNP-TV-Z]{{8}}'))) > 0 THEN 'invalid_known_speaker_ids'
  WHEN len(known) > 0 AND model <> 'sensevoice-diarize' THEN 'known_speakers_require_diarization' END AS error FROM opt""")
def option_checks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _options(spark, d).select("id", admission.option_error(c("model"), c("lang"), c("fmt"), c("chunking"), c("incl"), c("known")).alias("error")).distinct()


@_query(f"""WITH {_OPT} SELECT DISTINCT id, list_filter(['emotion', 'audio_events'], lambda x: list_contains(incl, x)) AS include FROM opt""")
def option_includes(spark: SparkSession, d: str) -> DataFrame:
    """The parts each job asks for, in the order in which they are written."""
    return _options(spark, d).select("id", admission.ordered(F.col("incl"), ["emotion", "audio_events"]).alias("include")).distinct()


@_query(f"""WITH {_OPT} SELECT DISTINCT id, CASE WHEN model = 'sensevoice-diarize' AND s > 1800 THEN 'diarization_too_long' WHEN s > 43200 THEN 'audio_too_long'
  WHEN chunking IS NULL AND s > 30 THEN 'long_audio_requires_vad' WHEN input_size_bytes < 67108864 AND s > 3600 THEN 'async_required' END AS error
FROM opt JOIN (SELECT DISTINCT id, canonical_options_json AS o, total_samples / 16000.0 AS s, input_size_bytes FROM transcription_jobs WHERE total_samples IS NOT NULL) USING (id, o)""")
def length_checks(spark: SparkSession, d: str) -> DataFrame:
    """Why the audio of each job of known size would not be taken; somebody waits for what is below 64 MiB."""
    rows = _options(spark, d, "total_samples", "input_size_bytes").where("total_samples is not null")
    error = admission.length_error(F.col("total_samples") / 16_000, F.col("model") == "sensevoice-diarize", F.col("chunking").isNotNull(), F.col("input_size_bytes") < 67_108_864, F.lit(43_200), F.lit(30), F.lit(3_600))
    return rows.select("id", error.alias("error")).distinct()


@_query("""SELECT DISTINCT id, CASE WHEN effective_max_audio_samples IS NULL OR effective_max_audio_samples NOT BETWEEN 1 AND 691200000 THEN 'bad_most'
  WHEN effective_direct_max_audio_samples IS NULL OR effective_direct_max_audio_samples NOT BETWEEN 1 AND least(effective_max_audio_samples, 480000) THEN 'bad_direct' END AS error,
  least(effective_direct_max_audio_samples // 16000 * 16000, effective_max_audio_samples // 16000 * 16000, 480000) AS direct FROM transcription_jobs WHERE id IS NOT NULL""")
def cap_checks(spark: SparkSession, d: str) -> DataFrame:
    most, direct = F.col("effective_max_audio_samples"), F.col("effective_direct_max_audio_samples")
    rows = _read(spark, d, "transcription_jobs").where("id is not null")
    whole = lambda c: F.floor(c / 16_000)
    # A bound that is missing leaves none, though the other one is there.
    return rows.select("id", admission.cap_error(most, direct).alias("error"), admission.direct_cap(whole(direct), whole(most)).alias("direct")).distinct()


@_query("""WITH p AS (SELECT embedding_model_id AS a, embedding_model_revision AS b, embedding_dimension AS c, embedding_policy_fingerprint AS f FROM speaker_profiles ORDER BY id LIMIT 1)
SELECT id, coalesce(embedding_model_id = a AND embedding_model_revision = b AND embedding_dimension = c AND embedding_policy_fingerprint = f, false) AS fits FROM speaker_profiles, p""")
def profile_fits(spark: SparkSession, d: str) -> DataFrame:
    """Which profiles were made by the policy of the first one."""
    rows, names = _read(spark, d, "speaker_profiles"), ["embedding_model_id", "embedding_model_revision", "embedding_dimension", "embedding_policy_fingerprint"]
    first = rows.orderBy("id").limit(1).select(*names).first()
    policy = tuple(F.lit(x) for x in first) if first else (F.lit(None),) * 4
    return rows.select("id", admission.compatible(*map(F.col, names), policy).alias("fits"))


_WANTED = ["00000001", "00000007", "00000042", "00000042", "ZZZZZZZZ", None]


@_query("""SELECT w.id, p.name, p.id IS NOT NULL AS found FROM (SELECT DISTINCT unnest(['00000001', '00000007', '00000042', 'ZZZZZZZZ']) AS id) w LEFT JOIN speaker_profiles p ON p.id = w.id""")
def requested_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A lookup of several ids at once: what is found and what is missing."""
    wanted = spark.createDataFrame([(x,) for x in _WANTED], "id string")
    found, missing = admission.lookup(_read(spark, d, "speaker_profiles").select("id", "name"), wanted)
    return found.withColumn("found", F.lit(True)).unionByName(missing.select("id", F.lit(None).cast("string").alias("name"), F.lit(False).alias("found")))


@_query(f"""WITH RECURSIVE {_SEG}, r AS (SELECT job_id, segment_index, language, start_sample AS s, end_sample AS e, row_number() OVER (PARTITION BY job_id ORDER BY segment_index) AS i FROM seg WHERE end_sample > start_sample),
b AS (SELECT job_id, segment_index, i, language, 0::BIGINT AS batch_no, 1::BIGINT AS n, (e - s)::BIGINT AS total, s AS first FROM r WHERE i = 1
  UNION ALL SELECT r.job_id, r.segment_index, r.i, r.language, b.batch_no + x, CASE WHEN x = 1 THEN 1 ELSE b.n + 1 END, CASE WHEN x = 1 THEN r.e - r.s ELSE b.total + r.e - r.s END, CASE WHEN x = 1 THEN r.s ELSE b.first END
  FROM b JOIN r ON r.job_id = b.job_id AND r.i = b.i + 1, LATERAL (SELECT (b.n + 1 > 32 OR b.total + r.e - r.s > 960000 OR r.e - b.first > 4800000)::INT AS x))
SELECT job_id, batch_no, count(*) AS n FROM b GROUP BY ALL HAVING bool_and(language IS NOT NULL)""")
def sound_batches(spark: SparkSession, d: str) -> DataFrame:
    """The batches of segments all of whose rows name a language; one that does not rejects its batch."""
    seg = _segments(spark, d)
    batches = packing.packed(_spans(seg, "segment_index")).join(seg.select("job_id", "segment_index", "language"), ["job_id", "segment_index"])
    return admission.whole_batches(batches, ["job_id", "batch_no"], F.col("language").isNotNull()).groupBy("job_id", "batch_no").agg(F.count("*").alias("n"))


@_query(f"""WITH {_SEG}, {_REG}, {_ISL}, g AS (SELECT DISTINCT job_id, start_sample AS a, end_sample AS b FROM seg WHERE end_sample > start_sample),
o AS (SELECT isl.job_id, s, e, greatest(s, a) AS x, least(e, b) AS y FROM isl JOIN g ON g.job_id = isl.job_id AND a < e AND s < b),
u AS (SELECT job_id, s, e, sum(y - x) AS summed, sum(greatest(0, y - greatest(x, coalesce(m, x)))) AS covered FROM (
  SELECT *, max(y) OVER (PARTITION BY job_id, s, e ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o) GROUP BY ALL),
v AS (SELECT isl.job_id, isl.s, isl.e, coalesce(summed, 0) AS summed, coalesce(covered, 0) AS covered FROM isl LEFT JOIN u ON u.job_id = isl.job_id AND u.s = isl.s)
SELECT job_id, 'uncovered' AS kind, s AS start, e AS "end", (e - s - covered)::BIGINT AS samples FROM v WHERE e - s > covered
UNION ALL SELECT job_id, 'twice', s, e, (summed - covered)::BIGINT FROM v WHERE summed > covered
UNION ALL SELECT job_id, 'outside', a, b, b - a FROM g WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.job_id = g.job_id AND s < b AND a < e)""")
def tiling_checks(spark: SparkSession, d: str) -> DataFrame:
    return admission.tiling_errors(_regions(spark, d), _spans(_segments(spark, d)))


@_query(f"WITH {_LEASES} SELECT owner_id, count(*) AS n FROM l WHERE owner_kind = 'job' GROUP BY ALL HAVING count(*) > 1")
def repeated_leases(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that own several leases."""
    return admission.repeated(_leases(spark, d).where("owner_kind = 'job'"), ["owner_id"])


@_query(f"WITH {_LEASES} SELECT id, owner_id FROM l WHERE owner_kind = 'job' AND owner_id NOT IN (SELECT id FROM transcription_jobs WHERE id IS NOT NULL AND status = 'succeeded')")
def unfinished_leases(spark: SparkSession, d: str) -> DataFrame:
    """Leases of jobs that never succeeded."""
    return ledger.orphans(_leases(spark, d), _read(spark, d, "transcription_jobs").where("status = 'succeeded'").select("id")).select("id", "owner_id")


@_query("""SELECT substr(id, 1, 7) AS key, row_number() OVER (PARTITION BY substr(id, 1, 7) ORDER BY id) - 1 AS position, id, name, octet_length(embedding) // 4 AS dimension FROM speaker_profiles""")
def packed_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Profiles packed into snapshots by the first signs of their id, and read back."""
    rows = _read(spark, d, "speaker_profiles").select(F.substring("id", 1, 7).alias("key"), "id", "name", "embedding")
    back = identity.unpacked(identity.packed(rows, "key"), "snapshot", ["key"])
    return back.select("key", F.col("position").cast("long").alias("position"), "id", "name", F.size("embedding").cast("long").alias("dimension"))


@_query("SELECT count(*) AS queued, CASE WHEN count(*) >= 16 THEN 'too_many_queued_jobs' END AS error FROM (SELECT DISTINCT id FROM transcription_jobs WHERE phase = 'visible' AND status = 'queued')")
def queue_limit(spark: SparkSession, d: str) -> DataFrame:
    return admission.queue_error(_read(spark, d, "transcription_jobs").where("status = 'queued'").select("id", "phase", "status").distinct())


@_query("""SELECT id, phase, epoch_us(finished_at) AS finished FROM (SELECT DISTINCT id, phase, finished_at FROM transcription_jobs WHERE status IN ('succeeded', 'failed', 'cancelled')
  AND (phase = 'deleting' OR (phase = 'visible' AND finished_at <= TIMESTAMPTZ '2026-06-01 00:00:00+00'))) ORDER BY CASE phase WHEN 'deleting' THEN 0 ELSE 1 END, finished_at NULLS FIRST, id LIMIT 32""")
def retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The next 32 jobs to clear away; the limit is the batch."""
    cutoff = F.timestamp_micros(F.lit(1_780_272_000_000_000))
    return admission.sweep(_read(spark, d, "transcription_jobs"), cutoff).select("id", "phase", F.unix_micros("finished_at").alias("finished"))


@_query("""SELECT DISTINCT id, owner_generation, coalesce(owner_generation = (SELECT max(owner_generation) FROM transcription_jobs), false) AS current FROM transcription_jobs WHERE id IS NOT NULL""")
def generations(spark: SparkSession, d: str) -> DataFrame:
    """Whether each job belongs to the generation of the marker, here the greatest."""
    jobs = _read(spark, d, "transcription_jobs")
    rows = jobs.where("id is not null").select("id", "owner_generation").distinct()
    return admission.generation_of(rows, "owner_generation", jobs.agg(F.max("owner_generation").alias("generation")))


_HEADERS = ["respond-async", "wait=5, Respond-Async ", "handling=lenient", "", "respond-async;q=1", ",,RESPOND-ASYNC,"]
_CONTAINERS = ["mov,mp4,m4a,3gp,3g2,mj2", "wav", "matroska,webm", "avi", "mov,exe", ""]


@_query(f"""SELECT h AS value, len(list_filter(string_split(h, ','), lambda x: lower(trim(x, ' ')) = 'respond-async')) > 0 AS waits_not,
  CASE WHEN len(list_filter(string_split(h, ','), lambda x: x NOT IN ('3g2', '3gp', 'flac', 'm4a', 'matroska', 'mj2', 'mov', 'mp3', 'mp4', 'mpeg', 'ogg', 'wav', 'webm'))) > 0 THEN 'invalid_audio' END AS container
FROM (SELECT unnest({_HEADERS + _CONTAINERS[:-1]}) AS h)""")
def header_checks(spark: SparkSession, d: str) -> DataFrame:
    """Lists in texts, read as preferences and as names of containers."""
    rows = spark.createDataFrame([(x,) for x in _HEADERS + _CONTAINERS[:-1]], "value string")
    return rows.select("value", admission.prefers_async(F.col("value")).alias("waits_not"), admission.container_error(F.col("value")).alias("container"))


@_query("""SELECT DISTINCT embedding_model_id AS model, embedding_model_revision AS revision, sha256('{"dimension":' || embedding_dimension || ',"model_id":' || to_json(embedding_model_id) || ',"revision":' || to_json(embedding_model_revision) || '}') AS fingerprint
FROM speaker_profiles""")
def policy_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each embedding policy that profiles were made by."""
    rows = _read(spark, d, "speaker_profiles").select(F.col("embedding_model_id").alias("model"), F.col("embedding_model_revision").alias("revision"), "embedding_dimension").distinct()
    return rows.select("model", "revision", identity.fields_fingerprint(dimension=F.col("embedding_dimension"), model_id=F.col("model"), revision=F.col("revision")).alias("fingerprint")).distinct()


@_query(f"""WITH {_LEASES}, f AS (SELECT owner_id, controlled_path AS p, min({{'s': actual_bytes, 'd': content_sha256}}) AS f FROM l WHERE owner_id IS NOT NULL AND controlled_path IS NOT NULL GROUP BY ALL)
SELECT owner_id, count(*) AS files, sha256('{{"files":[' || string_agg('{{"byte_size":' || coalesce(f.s::VARCHAR, 'null') || ',"relative_path":' || to_json(p) || ',"sha256":' || coalesce(to_json(f.d)::VARCHAR, 'null') || '}}', ',' ORDER BY p) || '],"version":1}}') AS fingerprint
FROM f GROUP BY owner_id""")
def manifest_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The digest of the files that each owner's leases control."""
    return identity.manifest_digests(_leases(spark, d), "owner_id", "controlled_path", "actual_bytes", "content_sha256")
