"""The registered queries of the core and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import clock, text, vectors
from .operators import identity, intervals, ledger, markers, matching, packing, segments, spectral
from .operators.ordered import along
from .operators.store import settle
from .plans import diarization
from .registry import FOUND, SQL, Query, query as _query
from .sources import jsonl

def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.once(_read(spark, d, "segment_records"))


def _spans(df: DataFrame, *more: str) -> DataFrame:
    return df.select("job_id", *more, F.col("start_sample").alias("start"), F.col("end_sample").alias("end"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Each region once, with the least of its labels."""
    rows = _spans(_read(spark, d, "speaker_regions"), "anonymous_speaker")
    return rows.groupBy("job_id", "start", "end").agg(F.min("anonymous_speaker").alias("label"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "speaker_embedding_windows")


# What the SQL twins share. White space and scripts as in functions.text.
_W = text.WHITE
_SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}"


def _strip(column: str) -> str:
    return rf"regexp_replace({column}, '^{_W}+|{_W}+$', '', 'g')"


_SEG = f"""seg AS (SELECT job_id, segment_index, r.*, length({_strip("coalesce(r.text, '')")}) > 0 AS ok FROM (
  SELECT job_id, segment_index, arg_min({{'start_sample': start_sample, 'end_sample': end_sample, 'text': text, 'language': language, 'annotations': annotations, 'anonymous_speaker': anonymous_speaker}},
    received_at) AS r FROM segment_records WHERE job_id IS NOT NULL AND segment_index IS NOT NULL GROUP BY ALL))"""
_REG = """reg AS (SELECT job_id, start_sample AS s, end_sample AS e, min(anonymous_speaker) AS label FROM speaker_regions
  WHERE job_id IS NOT NULL AND end_sample > start_sample GROUP BY ALL)"""
_ISL = """isl AS (SELECT job_id, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(f) OVER (PARTITION BY job_id ORDER BY s, e) AS g FROM (
      SELECT job_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f
      FROM (SELECT DISTINCT job_id, s, e FROM reg))) GROUP BY job_id, g)"""
_PIECES = rf"""pieces AS (SELECT job_id, segment_index, CASE WHEN p IS NOT NULL AND NOT (regexp_matches(p, '[\p{{Ps}}\p{{Pi}}{_SCRIPTS}]$')
    OR regexp_matches(t, '^[\p{{Pe}}\p{{Pf}}\p{{Po}}{_SCRIPTS}]')) THEN ' ' || t ELSE t END AS piece FROM (
  SELECT *, right(lag(t) OVER (PARTITION BY job_id ORDER BY segment_index), 1) AS p FROM (
    SELECT job_id, segment_index, {_strip("text")} AS t FROM seg WHERE ok)))"""
_USABLE = "coalesce(len({v}) = {n} AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform({v}, lambda x: abs(x))) > 0, false)"
_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"


@_query(f"""WITH {_SEG},
c AS (SELECT job_id, count(*) AS records, count(*) FILTER (ok) AS with_text, count(*) FILTER (ok AND anonymous_speaker IS NOT NULL) AS labelled,
  max(end_sample) AS last_end, arg_min_null(language, segment_index) FILTER (ok) AS language FROM seg GROUP BY job_id),
l AS (SELECT job_id, list(anonymous_speaker ORDER BY a, anonymous_speaker) AS labels FROM (
  SELECT job_id, anonymous_speaker, min(segment_index) AS a FROM seg WHERE ok AND anonymous_speaker IS NOT NULL GROUP BY ALL) GROUP BY job_id)
SELECT c.*, coalesce(labels, []) AS labels FROM c LEFT JOIN l USING (job_id)""")
def transcript_summary(spark: SparkSession, d: str) -> DataFrame:
    return segments.summary(_segments(spark, d))


@_query(f"WITH {_SEG}, {_PIECES} SELECT * FROM pieces")
def transcript_pieces(spark: SparkSession, d: str) -> DataFrame:
    return segments.pieces(_segments(spark, d))


@_query(f"""WITH {_SEG}, {_PIECES} SELECT job_id, string_agg(piece, '' ORDER BY segment_index) AS text FROM pieces GROUP BY job_id""")
def transcript_text(spark: SparkSession, d: str) -> DataFrame:
    return segments.joined(_segments(spark, d))


@_query(f"""WITH {_SEG}, {_PIECES} SELECT job_id, segment_index // 256 AS part_no, string_agg(piece, '' ORDER BY segment_index) AS text FROM pieces GROUP BY ALL""")
def transcript_parts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of transcripts in parts that do not grow with the recording."""
    return segments.joined_parts(_segments(spark, d), 256)


@_query(f"WITH {_SEG} SELECT job_id, segment_index, row_number() OVER (PARTITION BY job_id ORDER BY segment_index) - 1 AS dense_index FROM seg WHERE text <> ''")
def segments_dense(spark: SparkSession, d: str) -> DataFrame:
    return segments.dense(_segments(spark, d)).select("job_id", "segment_index", "dense_index")


@_query(f"""WITH {_SEG} SELECT job_id, segment_index::VARCHAR AS id, start_sample / 16000.0 AS start, end_sample / 16000.0 AS "end", {_strip("text")} AS text FROM seg WHERE ok""")
def verbose_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.verbose(_segments(spark, d))


@_query(f"""WITH {_SEG} SELECT job_id, kind, label, start_sample / 16000.0 AS start, end_sample / 16000.0 AS "end" FROM (
  SELECT *, 'emotion' AS kind, annotations.emotion AS label FROM seg WHERE ok UNION ALL SELECT *, 'audio_event', annotations.audio_event FROM seg WHERE ok) WHERE label IS NOT NULL""")
def rich_labels(spark: SparkSession, d: str) -> DataFrame:
    return segments.rich(_segments(spark, d))


@_query(f"""WITH {_SEG} SELECT job_id, CASE WHEN count(anonymous_speaker) = count(*) THEN 'all' WHEN count(anonymous_speaker) = 0 THEN 'none' ELSE 'some' END AS use FROM seg WHERE ok GROUP BY job_id""")
def label_use(spark: SparkSession, d: str) -> DataFrame:
    return segments.label_use(_segments(spark, d))


@_query(f"""WITH {_SEG}, o AS (SELECT job_id, anonymous_speaker, row_number() OVER (PARTITION BY job_id ORDER BY a, anonymous_speaker) - 1 AS n FROM (
  SELECT job_id, anonymous_speaker, min(segment_index) AS a FROM seg WHERE anonymous_speaker IS NOT NULL GROUP BY ALL))
SELECT job_id, anonymous_speaker, n AS ordinal, CASE WHEN n < 26 THEN chr((65 + n)::INT) ELSE chr((64 + n // 26)::INT) || chr((65 + n % 26)::INT) END AS letters FROM o""")
def speaker_letters(spark: SparkSession, d: str) -> DataFrame:
    return segments.ordinals(_segments(spark, d)).withColumn("letters", text.letters(F.col("ordinal")))


_TAGS = r"'^<\|([^|<>]{1,64})\|><\|([^|<>]{1,64})\|><\|([^|<>]{1,64})\|><\|([^|<>]{1,64})\|>'"


def _tag(slot: str, names: dict[str, str], others: list[str]) -> str:
    known = " ".join(f"WHEN {slot} = '{k}' THEN '{v}'" for k, v in names.items())
    foreign = ", ".join(f"'{x}'" for x in others)
    return f"CASE {known} WHEN {slot} NOT IN ({foreign}) AND regexp_full_match({slot}, '{text.TAG_WORD}') THEN '{text.TAG_PREFIX}{slot}:' || {slot} END"


@_query(rf"""WITH {_SEG},
p AS (SELECT job_id, segment_index, regexp_extract(text, {_TAGS}, 1) AS l, regexp_extract(text, {_TAGS}, 2) AS emotion, regexp_extract(text, {_TAGS}, 3) AS audio_event,
  regexp_extract(text, {_TAGS}, 4) AS itn, regexp_replace(text, {_TAGS}, '') AS body FROM seg WHERE regexp_matches(text, {_TAGS})),
m AS (SELECT job_id, segment_index, l, itn, body, {_tag("emotion", text.EMOTIONS, [*text.EVENTS, "Event_UNK", *text.CONTROL])} AS fe,
  {_tag("audio_event", text.EVENTS, [*text.EMOTIONS, "EMO_UNKNOWN", *text.CONTROL])} AS fa,
  l = 'nospeech' AND emotion = 'EMO_UNKNOWN' AND audio_event = 'Event_UNK' AND {_strip("body")} IN ('', '.') AS silent FROM p),
v AS (SELECT *, itn = 'withitn' AND NOT contains(body, '<|') AND (silent OR (l IN ('zh', 'en', 'yue', 'ja', 'ko') AND fe IS NOT NULL AND fa IS NOT NULL)) AS valid FROM m)
SELECT job_id, segment_index, valid, CASE WHEN valid THEN CASE WHEN silent THEN '' ELSE body END END AS text, CASE WHEN valid AND NOT silent THEN l END AS language,
  CASE WHEN valid THEN fe END AS emotion, CASE WHEN valid THEN fa END AS audio_event FROM v""")
def control_prefixes(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d).where(F.col("text").rlike(text.PREFIX))
    return rows.select("job_id", "segment_index", text.control_prefix(F.col("text")).alias("p")).select("job_id", "segment_index", "p.*")


@_query("""WITH e AS (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS ms, event_type AS k FROM events WHERE event_type IN ('click', 'purchase')),
x AS (SELECT *, lag(k) OVER w AS pk, lag(ms) OVER w AS pms, event_id AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
y AS (SELECT *, max(CASE WHEN k = 'purchase' AND pk = 'click' AND ms > pms AND ms >= 0 THEN ms END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM x),
o AS (SELECT *, CASE WHEN ms < 0 THEN 'void' WHEN k = 'purchase' AND pk IS DISTINCT FROM 'click' THEN 'unopened' WHEN k = 'purchase' AND ms <= pms THEN 'void'
  WHEN k = 'purchase' THEN 'closed' WHEN pk = 'click' THEN 'nested' WHEN ms < last THEN 'rollback' ELSE 'opened' END AS outcome FROM y)
SELECT user_id, event_id, outcome, CASE WHEN outcome = 'closed' THEN pms * 16 END AS start, CASE WHEN outcome = 'closed' THEN ms * 16 END AS stop FROM o""")
def marker_pairs(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1000
    e = _read(spark, d, "events").where("event_type in ('click', 'purchase')").select("user_id", "event_id", "event_type", F.floor(ms).alias("ms"))
    e = e.withColumn("b", F.when(F.col("event_type") == "click", F.col("ms"))).withColumn("e", F.when(F.col("event_type") == "purchase", F.col("ms")))
    return markers.paired(e, "user_id", ["ms", "event_id"], "b", "e", 3.6e8).select("user_id", "event_id", "outcome", "start", "stop")


@_query(f'WITH {_REG}, {_ISL} SELECT job_id, s AS start, e AS "end" FROM isl')
def speech_islands(spark: SparkSession, d: str) -> DataFrame:
    return intervals.islands(_regions(spark, d))


@_query(f"""WITH {_REG}, a AS (SELECT DISTINCT job_id, unnest(generate_series(greatest(0, floor((s - 24000) / 12000.0)::BIGINT + 1), ((e - 1) // 12000)::BIGINT)) AS j FROM reg)
SELECT job_id, j * 12000 AS start, j * 12000 + 24000 AS "end" FROM a""")
def hop_windows(spark: SparkSession, d: str) -> DataFrame:
    return intervals.hop_windows(_regions(spark, d))


@_query(f"""WITH {_SEG}, {_REG} SELECT seg.job_id, segment_index, label, greatest(start_sample, s) AS start, least(end_sample, e) AS "end" FROM seg JOIN reg
  ON seg.job_id = reg.job_id AND s < end_sample AND start_sample < e WHERE end_sample > start_sample""")
def region_overlaps(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.overlaps(_spans(_segments(spark, d), "segment_index"), _regions(spark, d))
    return found.select("job_id", F.col("l.segment_index").alias("segment_index"), F.col("r.label").alias("label"), "start", "end")


@_query(f"""WITH {_SEG}, {_REG}, {_ISL}, x AS (SELECT DISTINCT job_id, start_sample, end_sample FROM seg WHERE end_sample > start_sample)
SELECT x.job_id, start_sample AS start, end_sample AS "end", coalesce(sum(least(end_sample, e) - greatest(start_sample, s)) FILTER (e IS NOT NULL), 0)::BIGINT AS covered
FROM x LEFT JOIN isl ON x.job_id = isl.job_id AND s < end_sample AND start_sample < e GROUP BY ALL""")
def segment_coverage(spark: SparkSession, d: str) -> DataFrame:
    return intervals.coverage(_spans(_segments(spark, d)), _regions(spark, d))


@_query(f"""WITH {_REG}, {_ISL}, a AS (SELECT DISTINCT job_id, unnest(generate_series(greatest(0, floor((s - 24000) / 12000.0)::BIGINT + 1), ((e - 1) // 12000)::BIGINT)) * 12000 AS w FROM reg)
SELECT a.job_id, w AS start, w + 24000 AS "end", coalesce(sum(least(w + 24000, e) - greatest(w, s)) FILTER (e IS NOT NULL), 0)::BIGINT AS covered
FROM a LEFT JOIN isl ON a.job_id = isl.job_id AND s < w + 24000 AND w < e GROUP BY ALL""")
def window_masks(spark: SparkSession, d: str) -> DataFrame:
    regions = _regions(spark, d)
    return intervals.coverage(intervals.hop_windows(regions), regions)


@_query("""WITH w AS (SELECT DISTINCT job_id, start_sample AS s FROM speaker_embedding_windows WHERE job_id IS NOT NULL),
t AS (SELECT job_id, max(end_sample) AS total FROM speaker_embedding_windows GROUP BY job_id),
x AS (SELECT w.job_id, s, total, lag(s) OVER o AS p, lead(s) OVER o AS n FROM w JOIN t USING (job_id) WINDOW o AS (PARTITION BY job_id ORDER BY s))
SELECT job_id, s AS start, CASE WHEN p IS NULL THEN 0 ELSE greatest(0, least(total, (p + s + 1) // 2 + 12000)) END AS cell_start,
  CASE WHEN n IS NULL THEN total ELSE greatest(0, least(total, (s + n + 1) // 2 + 12000)) END AS cell_end FROM x""")
def window_cells(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d).where("job_id is not null")
    rows = w.select("job_id", F.col("start_sample").alias("start")).distinct().join(w.groupBy("job_id").agg(F.max("end_sample").alias("total")), "job_id")
    return intervals.cells(rows, "total").select("job_id", "start", "cell_start", "cell_end")


@_query(f"""WITH {_REG}, x AS (SELECT *, CASE WHEN lag(e) OVER o = s AND lag(label) OVER o IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS f FROM reg WINDOW o AS (PARTITION BY job_id ORDER BY s, e)),
g AS (SELECT *, sum(f) OVER (PARTITION BY job_id ORDER BY s, e) AS g FROM x)
SELECT job_id, label, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY job_id, g.g, label""")
def region_merge(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged(_regions(spark, d), "label")


@_query(f"""WITH {_SEG}, x AS (SELECT job_id, segment_index, start_sample AS s, end_sample AS e, unnest(generate_series(0, (end_sample - start_sample - 1) // 480000)) AS piece FROM seg WHERE end_sample > start_sample)
SELECT job_id, segment_index, piece, s + piece * 480000 AS start, least(e, s + (piece + 1) * 480000) AS "end" FROM x""")
def segment_split(spark: SparkSession, d: str) -> DataFrame:
    return intervals.split(_spans(_segments(spark, d), "segment_index")).withColumn("piece", F.col("piece").cast("long"))


@_query(f"""WITH {_REG}, x AS (SELECT job_id, s, e, unnest(generate_series(s // 9600, (e - 1) // 9600)) AS block FROM reg)
SELECT job_id, block, count(*) AS n, sum(least(e, (block + 1) * 9600) - greatest(s, block * 9600))::BIGINT AS samples FROM x GROUP BY ALL""")
def region_blocks(spark: SparkSession, d: str) -> DataFrame:
    return intervals.blocks(_regions(spark, d)).groupBy("job_id", "block").agg(F.count("*").alias("n"), F.sum(F.expr("`end` - `start`")).alias("samples"))


@_query("""WITH x AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER o <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM x)
SELECT user_id, session, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM g GROUP BY ALL""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    hour = 3_600_000_000.0
    e = along(e, "user_id", ["t", "event_id"], 24 * hour, prev={"p": F.col("t")})
    e = settle(e.withColumn("f", (F.col("p").isNull() | (F.col("t") - F.col("p") > hour / 2)).cast("long")).drop("p"))
    e = along(e, "user_id", ["t", "event_id"], 24 * hour, total={"session": F.col("f")})
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("micros"))


@_query(f"""WITH RECURSIVE {_SEG}, r AS (SELECT job_id, segment_index, start_sample AS s, end_sample AS e, row_number() OVER (PARTITION BY job_id ORDER BY segment_index) AS i FROM seg WHERE end_sample > start_sample),
b AS (SELECT job_id, segment_index, i, 0::BIGINT AS batch_no, 1::BIGINT AS n, (e - s)::BIGINT AS total, s AS first FROM r WHERE i = 1
  UNION ALL SELECT r.job_id, r.segment_index, r.i, b.batch_no + x, CASE WHEN x = 1 THEN 1 ELSE b.n + 1 END, CASE WHEN x = 1 THEN r.e - r.s ELSE b.total + r.e - r.s END, CASE WHEN x = 1 THEN r.s ELSE b.first END
  FROM b JOIN r ON r.job_id = b.job_id AND r.i = b.i + 1, LATERAL (SELECT (b.n + 1 > 32 OR b.total + r.e - r.s > 960000 OR r.e - b.first > 4800000)::INT AS x))
SELECT job_id, segment_index, batch_no FROM b""")
def segment_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_spans(_segments(spark, d), "segment_index"))


@_query(f"""WITH {_SEG}, l AS (SELECT job_id, segment_index, end_sample - start_sample AS n FROM seg WHERE end_sample > start_sample),
w AS (SELECT *, unnest(CASE WHEN n <= 24000 THEN [0::BIGINT] ELSE list_distinct(list_append(generate_series(0, n - 24000, 12000), n - 24000)) END) AS start FROM l)
SELECT job_id, segment_index, start, least(start + 24000, n) AS "end" FROM w""")
def enrollment_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d).where("end_sample > start_sample").select("job_id", "segment_index", (F.col("end_sample") - F.col("start_sample")).alias("n"))
    return intervals.tail_windows(rows, F.col("n")).drop("n")


@_query(f"""WITH x AS (SELECT job_id, {_USABLE.format(v="embedding", n=192)} AS usable, {_NORM.format(v="embedding")} AS norm FROM speaker_embedding_windows)
SELECT job_id, count(*) AS windows, count(*) FILTER (usable) AS usable, count(*) FILTER (usable AND abs(norm - 1) <= 1e-5) AS unit FROM x GROUP BY job_id""")
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return _windows(spark, d).groupBy("job_id").agg(F.count("*").alias("windows"), F.count_if(vectors.usable(v, 192)).alias("usable"), F.count_if(vectors.is_unit(v, 192)).alias("unit"))


@_query(f"""WITH x AS (SELECT vector_id, any_value(job_id) AS job_id, any_value(embedding) AS v FROM speaker_embedding_windows WHERE {_USABLE.format(v="embedding", n=192)} GROUP BY vector_id),
m AS (SELECT job_id, i, avg(v[i]::DOUBLE) AS a, count(*) AS n FROM x, generate_series(1, 192) AS t(i) GROUP BY ALL),
c AS (SELECT job_id, any_value(n) AS n, list(a ORDER BY i) AS a FROM m GROUP BY job_id)
SELECT job_id, n, list_transform(a, lambda y: round(y / {_NORM.format(v="a")}, 5) + 0.0) AS centroid FROM c""")
def job_centroids(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d).where(vectors.usable(F.col("embedding"), 192)).groupBy("vector_id").agg(F.first("job_id").alias("job_id"), F.first("embedding").alias("v"))
    return vectors.group_means(w, "job_id", "v", 192, scaled=False).select("job_id", "n", F.transform("centroid", lambda x: F.round(x, 5) + 0.0).alias("centroid"))


# A little-endian 32-bit float out of the hexadecimal text of a BLOB.
_FLOATS = """list_transform(generate_series(0, 191), lambda i: list_transform([('0x' || substr(h, (8*i+7)::INT, 2) || substr(h, (8*i+5)::INT, 2) || substr(h, (8*i+3)::INT, 2) || substr(h, (8*i+1)::INT, 2))::BIGINT],
  lambda u: CASE WHEN u & 2147483647 = 0 THEN 0.0::DOUBLE ELSE (1 - 2 * (u >> 31)) * power(2.0::DOUBLE, ((u >> 23) & 255) - 127) * (1 + (u & 8388607) / 8388608.0::DOUBLE) END)[1])"""
_KNOWN = f"""p AS (SELECT id, name, {_FLOATS} AS v FROM (SELECT id, name, hex(embedding) AS h FROM speaker_profiles)),
c AS (SELECT vector_id, any_value(job_id) AS job_id, any_value(label) AS label, any_value(centroid) AS v FROM anonymous_speaker_clusters GROUP BY vector_id),
s AS (SELECT c.vector_id, p.id, p.name, list_dot_product(c.v, p.v) / ({_NORM.format(v="c.v")} * {_NORM.format(v="p.v")}) AS sim FROM c JOIN p ON {_USABLE.format(v="c.v", n=192)}),
k AS (SELECT vector_id, max(sim) AS best FROM s GROUP BY vector_id),
m AS (SELECT s.vector_id, any_value(id) AS id, any_value(name) AS name, any_value(best) AS sim FROM s JOIN k ON s.vector_id = k.vector_id AND sim = best WHERE best >= 0.31 GROUP BY s.vector_id HAVING count(*) = 1)"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    profiles = _read(spark, d, "speaker_profiles").select("id", "name", vectors.from_blob("embedding").alias("embedding"))
    clusters = _read(spark, d, "anonymous_speaker_clusters").groupBy("vector_id").agg(F.first("job_id").alias("job_id"), F.first("label").alias("label"), F.first("centroid").alias("centroid"))
    return matching.best_known(clusters, profiles, ["vector_id", "job_id", "label"])


@_query(f"WITH {_KNOWN} SELECT c.vector_id, c.job_id, c.label, m.id, m.name, round(m.sim, 6) AS similarity FROM c LEFT JOIN m USING (vector_id)")
def known_speakers(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).withColumn("similarity", F.round("similarity", 6))


@_query(f"""WITH {_SEG}, {_KNOWN}, n AS (SELECT job_id, label, max(m.name) AS name FROM c JOIN m USING (vector_id) GROUP BY ALL)
SELECT seg.job_id, segment_index::VARCHAR AS id, start_sample / 16000.0 AS start, end_sample / 16000.0 AS "end", coalesce(n.name, 'Unknown ' || anonymous_speaker) AS speaker, {_strip("text")} AS text
FROM seg LEFT JOIN n ON seg.job_id = n.job_id AND anonymous_speaker = label WHERE ok AND anonymous_speaker IS NOT NULL""")
def diarized_names(spark: SparkSession, d: str) -> DataFrame:
    names = _known(spark, d).where("name is not null").groupBy("job_id", "label").agg(F.max("name").alias("name"))
    return segments.diarized(_segments(spark, d), names)


_MEANS = f"""x AS (SELECT label, vec_id % 5 AS sample, i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, generate_series(1, 64) AS t(i) GROUP BY ALL),
u AS (SELECT label, sample, list(a ORDER BY i) AS v FROM x GROUP BY ALL),
s AS (SELECT label, sample, list_transform(v, lambda y: y / {_NORM.format(v="v")}) AS v FROM u)"""


@_query(f"""WITH {_MEANS}, y AS (SELECT label, i, avg(v[i]) AS a, count(*) AS n FROM s, generate_series(1, 64) AS t(i) GROUP BY ALL),
c AS (SELECT label, any_value(n) AS n, list(a ORDER BY i) AS a FROM y GROUP BY label)
SELECT label, n, list_transform(a, lambda z: round(z / {_NORM.format(v="a")}, 5) + 0.0) AS centroid FROM c""")
def sample_means(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "embeddings").withColumn("sample", F.col("vec_id") % 5)
    return matching.mean_of_means(rows, "label", "sample", "embedding", 64).select("label", "n", F.transform("centroid", lambda x: F.round(x, 5) + 0.0).alias("centroid"))


@_query(f"""WITH {_MEANS}, p AS (SELECT a.label, list_dot_product(a.v, b.v) AS c FROM s a JOIN s b ON a.label = b.label AND a.sample < b.sample)
SELECT label, count(*) AS pairs, round(min(c), 6) AS least, min(c) >= 0.31 AS consistent FROM p GROUP BY label""")
def sample_consistency(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "embeddings").withColumn("sample", F.col("vec_id") % 5)
    return matching.consistency(rows, "label", "sample", "embedding", 64).withColumn("least", F.round("least", 6))


@_query()
def recording_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spectral.by_recording(_windows(spark, d), longest=None)


@_query()
def diarized_regions(spark: SparkSession, d: str) -> DataFrame:
    return diarization.regions(_regions(spark, d).select("job_id", "start", "end"), _windows(spark, d))


_LEASES = "l AS (SELECT DISTINCT * FROM storage_leases WHERE id IS NOT NULL)"


def _leases(spark: SparkSession, d: str) -> DataFrame:
    return ledger.once(_read(spark, d, "storage_leases"), "id")


@_query(f"""WITH {_LEASES}, j AS (SELECT DISTINCT id, input_lease_id FROM transcription_jobs WHERE id IS NOT NULL),
o AS (SELECT owner_id, count(*) AS leases, sum(actual_bytes) AS bytes FROM l WHERE owner_kind = 'job' GROUP BY owner_id)
SELECT j.id, j.input_lease_id, l.phase AS input_phase, l.actual_bytes AS input_bytes, coalesce(o.leases, 0) AS leases, coalesce(o.bytes, 0)::BIGINT AS bytes
FROM j LEFT JOIN l ON l.id = j.input_lease_id LEFT JOIN o ON o.owner_id = j.id""")
def job_leases(spark: SparkSession, d: str) -> DataFrame:
    jobs = _read(spark, d, "transcription_jobs").where("id is not null").select("id", "input_lease_id").distinct().withColumn("status", F.lit(None).cast("string"))
    return ledger.with_leases(jobs, _leases(spark, d)).drop("status")


@_query(f"WITH {_LEASES} SELECT id, owner_id FROM l WHERE owner_kind = 'job' AND owner_id NOT IN (SELECT id FROM transcription_jobs WHERE id IS NOT NULL)")
def orphan_leases(spark: SparkSession, d: str) -> DataFrame:
    return ledger.orphans(_leases(spark, d), _read(spark, d, "transcription_jobs").select("id")).select("id", "owner_id")


@_query(f"WITH {_LEASES} SELECT DISTINCT id FROM transcription_jobs j WHERE EXISTS (SELECT 1 FROM l WHERE l.owner_id = j.id AND owner_kind = 'job' AND phase = 'sealed')")
def guarded_jobs(spark: SparkSession, d: str) -> DataFrame:
    return ledger.guarded(_read(spark, d, "transcription_jobs").select("id").distinct(), _leases(spark, d))


@_query(f"""WITH {_LEASES} SELECT lease_type, phase, count(*) AS n, coalesce(sum(reserved_bytes), 0)::BIGINT AS reserved, coalesce(sum(actual_bytes), 0)::BIGINT AS actual,
  coalesce(sum(reserved_bytes - actual_bytes), 0)::BIGINT AS outstanding, coalesce(sum(greatest(8388608, ((actual_bytes + 8388607) // 8388608) * 8388608)), 0)::BIGINT AS quanta FROM l GROUP BY ALL""")
def lease_usage(spark: SparkSession, d: str) -> DataFrame:
    return ledger.usage(_leases(spark, d))


@_query("""SELECT DISTINCT id, CASE WHEN started_at IS NOT NULL THEN greatest(epoch_us(started_at) - epoch_us(created_at), 0) / 1000.0 END AS wait_ms,
  CASE WHEN finished_at IS NOT NULL AND started_at IS NOT NULL THEN greatest(epoch_us(greatest(finished_at, started_at)) - epoch_us(started_at), 0) / 1000.0 END AS run_ms, total_samples / 16000.0 AS audio_s,
  CASE WHEN finished_at IS NOT NULL THEN strftime(timezone('UTC', greatest(finished_at, coalesce(started_at, finished_at))), '%Y-%m-%dT%H:%M:%S.%fZ') END AS finished,
  CASE WHEN epoch_us(created_at) % 1000000 = 0 THEN strftime(timezone('UTC', created_at), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(timezone('UTC', created_at), '%Y-%m-%dT%H:%M:%S.%fZ') END AS created FROM transcription_jobs""")
def job_times(spark: SparkSession, d: str) -> DataFrame:
    jobs = _read(spark, d, "transcription_jobs")
    created = jobs.select("id", "created_at", "started_at", "finished_at", "total_samples").distinct()
    times = ledger.waits(created.withColumn("id", F.struct("id", "created_at")))
    return times.select("id.id", "wait_ms", "run_ms", "audio_s", clock.fixed_instant(F.col("finished")).alias("finished"), clock.instant(F.col("id.created_at")).alias("created")).distinct()


@_query("""SELECT id, epoch_us(created_at) AS created FROM (SELECT DISTINCT id, created_at FROM transcription_jobs WHERE status = 'queued') ORDER BY created_at, id LIMIT 32""")
def queue_head(spark: SparkSession, d: str) -> DataFrame:
    """The 32 oldest queued jobs, by true time and id; the limit is the report."""
    return _read(spark, d, "transcription_jobs").where("status = 'queued'").select("id", "created_at").distinct().orderBy("created_at", "id").limit(32).select("id", F.unix_micros("created_at").alias("created"))


@_query("""SELECT id, count(*) AS states, count(DISTINCT status) AS statuses, max(processed_samples) AS processed, max(total_samples) AS total, max(attempt_no) AS attempts,
  bool_or(cancel_requested) AS cancelled FROM transcription_jobs WHERE id IS NOT NULL GROUP BY id""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each job got over all its states; progress never falls back."""
    jobs = _read(spark, d, "transcription_jobs").where("id is not null")
    return jobs.groupBy("id").agg(
        F.count("*").alias("states"), F.count_distinct("status").alias("statuses"), F.max("processed_samples").alias("processed"), F.max("total_samples").alias("total"),
        F.max("attempt_no").alias("attempts"), F.bool_or("cancel_requested").alias("cancelled"),
    )


@_query("""SELECT DISTINCT id, json_extract_string(canonical_options_json, '$.model') AS model, json_extract_string(canonical_options_json, '$.language') AS language,
  json_extract_string(canonical_options_json, '$.response_format') AS response_format FROM transcription_jobs WHERE canonical_options_json IS NOT NULL""")
def job_options(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "transcription_jobs").where("canonical_options_json is not null").select("id", "canonical_options_json").distinct()
    return rows.select("id", *[F.get_json_object("canonical_options_json", f"$.{k}").alias(k) for k in ("model", "language", "response_format")]).distinct()


@_query("""SELECT DISTINCT id, sha256('{"input_size_bytes":' || coalesce(input_size_bytes::VARCHAR, 'null') || ',"options":' || coalesce(to_json(canonical_options_json)::VARCHAR, 'null') ||
  ',"snapshot_sha256":' || coalesce(to_json(snapshot_sha256)::VARCHAR, 'null') || ',"version":1}') AS fingerprint FROM transcription_jobs""")
def job_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "transcription_jobs").select("id", "input_size_bytes", "canonical_options_json", "snapshot_sha256").distinct()
    identity = text.canonical_json(options=F.col("canonical_options_json"), input_size_bytes=F.col("input_size_bytes"), snapshot_sha256=F.col("snapshot_sha256"), version=F.lit(1))
    return rows.select("id", F.sha2(identity, 256).alias("fingerprint")).distinct()


_NAMES = ["chunking_strategy", "include", "known_speaker_ids", "language", "model", "response_format"]


@_query(f"""WITH {_LEASES}, j AS (SELECT DISTINCT id, input_lease_id, canonical_options_json AS o, selected_speaker_snapshot AS s, snapshot_sha256, request_fingerprint FROM transcription_jobs),
p AS (SELECT j.*, l.content_sha256 AS d, CASE WHEN o IS NULL THEN 'no_json' WHEN list_sort(json_keys(o)) <> {_NAMES} THEN 'unknown_key' END AS options_error FROM j LEFT JOIN l ON l.id = input_lease_id),
f AS (SELECT *, CASE WHEN options_error IS NULL AND regexp_full_match(d, '[0-9a-f]{{64}}') THEN sha256('{{"canonical_options":' || o || ',"input_sha256":"' || d || '","speaker_snapshot_sha256":"' ||
  sha256(coalesce(s, ''::BLOB)) || '","version":1}}') END AS fingerprint FROM p)
SELECT id, options_error, snapshot_sha256 IS NOT DISTINCT FROM (CASE WHEN s IS NOT NULL THEN sha256(s) END) AS snapshot_fits, fingerprint, fingerprint = request_fingerprint AS same FROM f""")
def request_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each job whether its options are canonical, its snapshot has its digest, and the fingerprint made anew from options, input and snapshot."""
    jobs = _read(spark, d, "transcription_jobs").select("id", "input_lease_id", "canonical_options_json", "selected_speaker_snapshot", "snapshot_sha256", "request_fingerprint").distinct()
    lease = _leases(spark, d).select(F.col("id").alias("lease"), "content_sha256")
    options, snapshot = F.col("canonical_options_json"), F.col("selected_speaker_snapshot")
    rows = jobs.join(lease, F.col("input_lease_id") == F.col("lease"), "left").withColumn("fingerprint", identity.request_fingerprint(options, F.col("content_sha256"), snapshot))
    fits = F.col("snapshot_sha256").eqNullSafe(F.when(snapshot.isNotNull(), F.sha2(snapshot, 256)))
    return rows.select("id", identity.options_error(options).alias("options_error"), fits.alias("snapshot_fits"), "fingerprint", (F.col("fingerprint") == F.col("request_fingerprint")).alias("same"))


@_query("""WITH j AS (SELECT DISTINCT id, decode(selected_speaker_snapshot) AS s FROM transcription_jobs WHERE selected_speaker_snapshot IS NOT NULL),
x AS (SELECT id, unnest(generate_series(0, json_array_length(s, '$.speakers')::INT - 1)) AS position, s FROM j)
SELECT id, position, json_extract_string(s, '$.speakers[' || position || '].id') AS speaker, json_extract_string(s, '$.speakers[' || position || '].name') AS name,
  octet_length(from_base64(json_extract_string(s, '$.speakers[' || position || '].embedding'))) // 4 AS dimension FROM x""")
def selected_speakers(spark: SparkSession, d: str) -> DataFrame:
    jobs = _read(spark, d, "transcription_jobs").select("id", "selected_speaker_snapshot").distinct().withColumnRenamed("id", "job")
    rows = identity.unpacked(jobs, "selected_speaker_snapshot", ["job"])
    return rows.select(F.col("job").alias("id"), F.col("position").cast("long").alias("position"), F.col("id").alias("speaker"), "name", F.size("embedding").cast("long").alias("dimension"))


@_query(rf"""SELECT id, lower({_strip("name")}) = name_key AS key_fits, length({_strip("name")}) BETWEEN 1 AND 80 AND NOT regexp_full_match({_strip("name")}, '[A-Z]+')
  AND NOT regexp_full_match(lower({_strip("name")}), 'unknown [a-z]+') AS name_fits, octet_length(embedding) = 4 * embedding_dimension AS size_fits, sample_count BETWEEN 2 AND 5 AS samples_fit FROM speaker_profiles""")
def profile_checks(spark: SparkSession, d: str) -> DataFrame:
    name = text.strip(F.col("name"))
    fits = F.char_length(name).between(1, 80) & ~text.matches(name, "[A-Z]+") & ~text.matches(F.lower(name), "unknown [a-z]+")
    return _read(spark, d, "speaker_profiles").select(
        "id", (text.casefold(name) == F.col("name_key")).alias("key_fits"), fits.alias("name_fits"),
        (F.octet_length("embedding") == 4 * F.col("embedding_dimension")).alias("size_fits"), F.col("sample_count").between(2, 5).alias("samples_fit"),
    )


_RULES = """SELECT 'lease_bytes' AS rule, count(*) FILTER (NOT coalesce(actual_bytes >= 0 AND actual_bytes <= reserved_bytes, false)) AS rows FROM storage_leases
UNION ALL SELECT 'lease_sealed', count(*) FILTER (NOT coalesce(phase <> 'sealed' OR (actual_bytes = reserved_bytes AND regexp_full_match(content_sha256, '[0-9a-f]{64}')), false)) FROM storage_leases
UNION ALL SELECT 'lease_phase', count(*) FILTER (NOT coalesce(phase IN ('writing', 'sealed'), false)) FROM storage_leases
UNION ALL SELECT 'lease_owner', count(*) FILTER (NOT coalesce(owner_kind IN ('sync', 'job', 'legacy'), false)) FROM storage_leases
UNION ALL SELECT 'job_id', count(*) FILTER (NOT coalesce(regexp_full_match(id, '[0-9A-HJKMNP-TV-Z]{8}'), false)) FROM transcription_jobs
UNION ALL SELECT 'job_progress', count(*) FILTER (NOT coalesce(processed_samples >= 0 AND (total_samples IS NULL OR processed_samples <= total_samples), false)) FROM transcription_jobs
UNION ALL SELECT 'job_times', count(*) FILTER (NOT coalesce(started_at IS NULL OR started_at >= created_at, false)) FROM transcription_jobs
UNION ALL SELECT 'job_recoveries', count(*) FILTER (NOT coalesce(crash_recoveries BETWEEN 0 AND 1, false)) FROM transcription_jobs
UNION ALL SELECT 'segment_span', count(*) FILTER (NOT coalesce(start_sample >= 0 AND end_sample > start_sample, false)) FROM segment_records
UNION ALL SELECT 'segment_index', count(*) FILTER (NOT coalesce(segment_index >= 0, false)) FROM segment_records
UNION ALL SELECT 'segment_longest', count(*) FILTER (NOT coalesce(end_sample <= 691200000, false)) FROM segment_records"""


@_query(_RULES)
def row_checks(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.violations(_read(spark, d, "storage_leases"), ledger.lease_rules())
    found = found.unionByName(ledger.violations(_read(spark, d, "transcription_jobs"), ledger.job_rules()))
    return found.unionByName(ledger.violations(_read(spark, d, "segment_records"), ledger.segment_rules()))


def _shape(held: list[str], empty: list[str]) -> str:
    return " AND ".join([f"{x} IS NOT NULL" for x in held] + [f"{x} IS NULL" for x in empty])


_L = ledger.STATES
_STATES = {
    "known_state": "phase IN ('receiving', 'visible', 'deleting') AND (status IS NULL OR status IN ('queued', 'running', 'succeeded', 'failed', 'cancelled')) AND (phase <> 'visible' OR status IS NOT NULL)",
    "deleted_when_done": "phase <> 'deleting' OR status IS NULL OR status IN ('succeeded', 'failed', 'cancelled')",
    "counts": "coalesce(input_size_bytes, 0) >= 0 AND coalesce(total_samples, 0) >= 0 AND processed_samples >= 0 AND attempt_no >= 0 AND crash_recoveries BETWEEN 0 AND attempt_no",
    "digests": " AND ".join(f"({x} IS NULL OR regexp_full_match({x}, '[0-9a-f]{{64}}'))" for x in ("snapshot_sha256", "request_fingerprint", "processor_fingerprint")),
    "no_empty_texts": "'' NOT IN (" + ", ".join(f"coalesce({x}, '-')" for x in ("input_lease_id", "canonical_options_json", "attempt_token", "owner_generation", "result_lease_id", "error_code")) + ")",
    "caps": "(effective_max_audio_samples IS NULL OR effective_max_audio_samples BETWEEN 1 AND 691200000) AND (effective_direct_max_audio_samples IS NULL OR effective_direct_max_audio_samples BETWEEN 1 AND least(480000, coalesce(effective_max_audio_samples, 0)))",
    "within_caps": "greatest(processed_samples, coalesce(total_samples, 0)) <= coalesce(effective_max_audio_samples, 9000000000000)",
    "times_in_order": "coalesce(started_at, created_at) >= created_at AND coalesce(finished_at, started_at, created_at) >= coalesce(started_at, created_at)",
    "receiving": f"NOT (phase = 'receiving' OR (phase = 'deleting' AND status IS NULL)) OR ({_shape(ledger.RECEIVING_SET, ledger.RECEIVING_EMPTY)} AND processed_samples = 0 AND attempt_no = 0 AND crash_recoveries = 0 AND NOT cancel_requested AND NOT input_cleanup_pending)",
    "described": f"status IS NULL OR ({_shape(ledger.DESCRIBED, [])})",
    "queued": f"status IS DISTINCT FROM 'queued' OR ({_shape(*_L['queued'])} AND processed_samples = 0 AND NOT cancel_requested AND NOT input_cleanup_pending AND (attempt_no <> 0 OR total_samples IS NULL))",
    "running": f"status IS DISTINCT FROM 'running' OR ({_shape(*_L['running'])} AND attempt_no >= 1 AND NOT input_cleanup_pending)",
    "succeeded": f"status IS DISTINCT FROM 'succeeded' OR ({_shape(*_L['succeeded'])} AND attempt_no >= 1 AND processed_samples = total_samples AND NOT cancel_requested)",
    "failed": f"status IS DISTINCT FROM 'failed' OR ({_shape(*_L['failed'])} AND attempt_no >= 1 AND NOT cancel_requested)",
    "cancelled": f"status IS DISTINCT FROM 'cancelled' OR ({_shape(*_L['cancelled'])} AND CASE WHEN attempt_no = 0 THEN started_at IS NULL AND NOT cancel_requested ELSE started_at IS NOT NULL AND cancel_requested END)",
    "cleanup_told": "status IS NULL OR status NOT IN ('succeeded', 'failed', 'cancelled') OR input_cleanup_pending = (input_lease_id IS NOT NULL)",
}


@_query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT coalesce({v}, false)) AS rows FROM transcription_jobs" for k, v in _STATES.items()))
def state_checks(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of jobs break each rule on their state's shape."""
    return ledger.violations(_read(spark, d, "transcription_jobs"), ledger.state_rules())


@_query(f"""WITH {_SEG}, x AS (SELECT *, lag(segment_index) OVER o AS pi, lag(end_sample) OVER o AS pe FROM seg WINDOW o AS (PARTITION BY job_id ORDER BY segment_index))
SELECT job_id, count(*) FILTER (segment_index <> coalesce(pi + 1, 0)) AS gaps, count(*) FILTER (start_sample < pe) AS overlaps FROM x GROUP BY job_id""")
def segment_order(spark: SparkSession, d: str) -> DataFrame:
    """Breaks of a job's order: indices that do not follow on, starts before the last end."""
    rows = along(_segments(spark, d), "job_id", ["segment_index"], segments.SPAN, prev={"p": F.struct("segment_index", "end_sample")})
    gap = F.col("segment_index") != F.coalesce(F.col("p.segment_index") + 1, F.lit(0))
    return rows.groupBy("job_id").agg(F.count_if(gap).alias("gaps"), F.count_if(F.col("start_sample") < F.col("p.end_sample")).alias("overlaps"))


@_query(f"""WITH {_SEG}, x AS (SELECT *, lag(segment_index) OVER o AS pi, lag(end_sample) OVER o AS pe FROM seg WINDOW o AS (PARTITION BY job_id ORDER BY segment_index)),
f AS (SELECT job_id, segment_index, CASE WHEN NOT coalesce(end_sample > start_sample, false) THEN 'void' WHEN segment_index <> coalesce(pi + 1, 0) THEN 'gap' WHEN start_sample < pe THEN 'overlap' END AS fault FROM x)
SELECT * FROM f WHERE fault IS NOT NULL""")
def segment_faults(spark: SparkSession, d: str) -> DataFrame:
    return segments.order_faults(_segments(spark, d))


@_query("SELECT DISTINCT id, status, error_code FROM transcription_jobs WHERE phase = 'visible' AND status IN ('failed', 'cancelled') AND input_size_bytes >= 100000")
def visible_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A filtered scan of few columns; the filters reach the files."""
    rows = _read(spark, d, "transcription_jobs").where("phase = 'visible' and status in ('failed', 'cancelled') and input_size_bytes >= 100000")
    return rows.select("id", "status", "error_code").distinct()


_TABLES = ["transcription_jobs", "segment_records", "speaker_regions", "storage_leases", "speaker_profiles"]


@_query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", column_name AS "column" FROM (DESCRIBE {t})""" for t in _TABLES))
def table_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the domain tables, from their files' footers alone."""
    return spark.createDataFrame([(t, c) for t in _TABLES for c in _read(spark, d, t).columns], "table string, column string")


@_query("""SELECT id, CASE WHEN sample_count = 2 THEN 'removed' WHEN sample_count = 3 THEN 'changed' END AS change FROM speaker_profiles WHERE sample_count IN (2, 3)
UNION ALL SELECT 'new' || id, 'added' FROM speaker_profiles WHERE sample_count = 5""")
def changed_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Two states of the profiles compared row by row: some are gone, some renamed, some new."""
    before = _read(spark, d, "speaker_profiles").drop("embedding")
    after = before.where("sample_count <> 2").withColumn("name", F.when(F.col("sample_count") == 3, F.concat("name", F.lit(" 2"))).otherwise(F.col("name")))
    added = before.where("sample_count = 5").withColumn("id", F.concat(F.lit("new"), "id"))
    return ledger.differing(before, after.unionByName(added), "id")


@_query(f"""WITH {_KNOWN}, n AS (SELECT c.job_id, c.label, m.id, m.name FROM c LEFT JOIN m USING (vector_id) WHERE c.job_id IS NOT NULL AND c.label IS NOT NULL),
g AS (SELECT job_id, count(*) AS n, count(DISTINCT label) AS k, list_distinct(list(label)) AS labels FROM n GROUP BY job_id)
SELECT job_id, CASE WHEN n > k THEN 'repeated' ELSE 'not_dense' END AS error FROM g WHERE n > k OR NOT list_has_all(labels, list_transform(range(n), lambda i: chr((65 + i)::INT)))""")
def mapping_checks(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose clusters' labels are repeated or not the first letters in a row."""
    names = _known(spark, d).where("job_id is not null and label is not null")
    return segments.mapping_errors(names).where("error <> 'two_names'")


@_query("SELECT DISTINCT id FROM transcription_jobs WHERE finished_at IS NOT NULL AND epoch_us(finished_at) <= epoch_us(TIMESTAMPTZ '2026-06-01 00:00:00+00') - 24 * 3600000000")
def due_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that finished at least a day before an instant."""
    now = F.timestamp_micros(F.lit(1_780_272_000_000_000))
    return _read(spark, d, "transcription_jobs").where(clock.due(F.col("finished_at"), now, 24)).select("id").distinct()


@_query("SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return e.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("window_start"), "event_type", "n", "value")


@_query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query(f"SELECT source, count(*) AS documents, count(*) FILTER (length({_strip("coalesce(text, '')")}) > 0) AS with_text, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def documents_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").groupBy("source")
    return rows.agg(F.count("*").alias("documents"), F.count_if(~text.is_blank(F.col("text"))).alias("with_text"), F.sum("n_chars").alias("chars"))


@_query("""SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL""")
def document_digests(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def _json(c: str) -> str:
    return f"coalesce(to_json({c})::VARCHAR, 'null')"


@_query(f"""WITH {_SEG} SELECT job_id, segment_index, '{{"annotations":{{"audio_event":' || {_json("annotations.audio_event")} || ',"emotion":' || {_json("annotations.emotion")} || '}},"anonymous_speaker":' || {_json("anonymous_speaker")}
  || ',"end_sample":' || end_sample || ',"index":' || segment_index || ',"language":' || {_json("language")} || ',"start_sample":' || start_sample || ',"text":' || {_json("text")} || '}}' AS line FROM seg""")
def segment_lines(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.lines(_segments(spark, d))


# These enter their queries too; they build on the names above.
from . import catalogue_admission, catalogue_results, catalogue_streams  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
