"""Identities of requests and of the speakers selected for them: canonical JSON, digests and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import canonical_json, matches
from ..functions.vectors import from_blob

DIGEST = "[0-9a-f]{64}"
#: Speakers a snapshot holds at most, and its bytes.
SELECTED, SNAPSHOT_BYTES, OPTION_BYTES = 32, 64 * 1024, 4096
# Fixed value: Crockford's base 32.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
# The keys of canonical options, in order, and their types.
OPTIONS = "chunking_strategy string, include array<string>, known_speaker_ids array<string>, language string, model string, response_format string"
_ENTRY = "embedding string, id string, name string"
_SNAPSHOT = f"speakers array<struct<{_ENTRY.replace(' string', ':string').replace(', ', ',')}>>, version int"


def request_fingerprint(options: Column, input_digest: Column, snapshot: Column) -> Column:
    """The digest of a request: its canonical options (JSON text), the digest of its input and that of its snapshot (BINARY, NULL as empty).

    NULL where the options are not canonical or the input's digest is none.
    """
    whole = F.concat(
        F.lit('{"canonical_options":'), options, F.lit(',"input_sha256":"'), input_digest, F.lit('","speaker_snapshot_sha256":"'),
        F.sha2(F.coalesce(snapshot, F.lit("").cast("binary")), 256), F.lit('","version":1}'),
    )
    return F.when(options_error(options).isNull() & matches(input_digest, DIGEST), F.sha2(whole, 256))


def options_error(options: Column) -> Column:
    """NULL, or why a text is no canonical options: too_long, no_json, unknown_key, not_canonical (not what its own content is written as)."""
    parsed = F.from_json(options, OPTIONS, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(options)
    names = [f.split(" ")[0] for f in OPTIONS.split(", ")]
    again = F.to_json(parsed, {"ignoreNullFields": "false"})
    return (
        F.when(F.octet_length(options) > OPTION_BYTES, "too_long").when(options.isNull() | keys.isNull() | parsed.isNull(), "no_json")
        .when(F.array_sort(keys) != F.array(*map(F.lit, names)), "unknown_key").when(again != options, "not_canonical")
    )


def random_id(seed: int | None = None) -> Column:
    """A public id of eight signs, drawn anew for each row; not for keys that a lost task must make again the same."""
    signs = F.lit(ALPHABET)
    draw = [F.floor((F.rand() if seed is None else F.rand(seed + i)) * 32).cast("int") + 1 for i in range(8)]
    return F.concat(*[F.substring(signs, d, F.lit(1)) for d in draw])


def fields_fingerprint(**fields: Column) -> Column:
    """The digest of named values, as of an embedding policy or a processor: that of their canonical JSON."""
    return F.sha2(canonical_json(**fields), 256)


def manifest_digests(files: DataFrame, key: str, path: str, size: str, digest: str) -> DataFrame:
    """(key, files, fingerprint): the digest of each key's file listing: paths, sizes and digests by path, each file once. A key's files are few.

    Rows with a NULL key or path are dropped; of several rows of one path the least by size and digest counts.
    """
    once = files.where(F.col(key).isNotNull() & F.col(path).isNotNull()).groupBy(key, F.col(path).alias("__p")).agg(F.min(F.struct(F.col(size).alias("s"), F.col(digest).alias("d"))).alias("f"))
    entry = F.struct(F.col("f.s").alias("byte_size"), F.col("__p").alias("relative_path"), F.col("f.d").alias("sha256"))
    lists = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__p", entry.alias("e")))).alias("l"))
    return lists.select(key, F.size("l").cast("long").alias("files"), fields_fingerprint(files=F.transform("l", lambda x: x["e"]), version=F.lit(1)).alias("fingerprint"))


def packed(profiles: DataFrame, key: str) -> DataFrame:
    """(key, snapshot BINARY): the selected profiles (id, name, embedding BINARY) of each key as canonical JSON, by id; NULL beyond ``SELECTED`` speakers or ``SNAPSHOT_BYTES``.

    A key's selected profiles are few; each id counts once.
    """
    once = profiles.groupBy(key, "id").agg(F.min(F.struct("name", "embedding")).alias("p"))
    entry = F.struct(F.base64("p.embedding").alias("embedding"), F.col("id"), F.col("p.name").alias("name"))
    lists = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))).alias("l"))
    text = canonical_json(speakers=F.transform("l", lambda x: x["e"]), version=F.lit(1))
    fits = (F.size("l") <= SELECTED) & (F.octet_length(text) <= SNAPSHOT_BYTES)
    return lists.select(key, F.when(fits, text.cast("binary")).alias("snapshot"))


def unpacked(df: DataFrame, snapshot: str, keys: list[str]) -> DataFrame:
    """(keys, position, id, name, embedding ARRAY<FLOAT>): a row a speaker of each snapshot that is valid: within its bounds, ids in order, each once."""
    text = F.decode(F.col(snapshot), "UTF-8")
    rows = df.where(F.octet_length(snapshot) <= SNAPSHOT_BYTES).select(*keys, F.from_json(text, _SNAPSHOT, {"mode": "PERMISSIVE"})["speakers"].alias("s"))
    ids = F.transform("s", lambda x: x["id"])
    rows = rows.where((F.size("s") <= SELECTED) & (F.array_sort(F.array_distinct(ids)) == ids))
    rows = rows.select(*keys, F.posexplode("s").alias("position", "e"))
    return rows.select(*keys, "position", "e.id", "e.name", from_blob(F.try_to_binary("e.embedding", F.lit("base64"))).alias("embedding"))
