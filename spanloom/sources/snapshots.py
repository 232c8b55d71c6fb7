"""Snapshots of final decisions: records behind a manifest that says what they must be, judged when they are read.

A snapshot is a folder: records as JSON lines in a folder of their own, and a manifest
with format, version, count and a hash of the records.  The manifest is put in place
last, by one rename, so a snapshot is replaced whole or not at all.  A payload is the
same in one JSON text.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import Files

# What a record may decide.
ACTIONS = ("approved", "rejected", "needs_review")
#: Lengths that texts of a record are cut to.
LENGTHS = {"editorial_key": 80, "score_version": 64, "action": 24, "reason_code": 48, "created_at": 40, "source_signature": 64}
TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
STATUS = "state, format, version, declared, found, invalid, consistent, valid, generated_at"


def decision_records(feedback: DataFrame, clips: DataFrame) -> DataFrame:
    """The last final decision of each clip that has an editorial key, as a record without texts or paths.

    ``feedback`` has ``id, clip_id, action, reason_code, tags, created_at``; ``clips`` has
    ``clip_id, editorial_key, start, end, duration, score, score_version, source_signature``.
    """
    final = feedback.filter(F.col("action").isin(*ACTIONS))
    last = final.groupBy("clip_id").agg(F.max_by(F.struct("action", "reason_code", "tags", "created_at"), "id").alias("f")).select("clip_id", "f.*")
    rows = clips.filter(F.coalesce("editorial_key", F.lit("")) != "").join(last, "clip_id")
    seconds = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 3).alias(f"{c}_seconds")
    cut = lambda c: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, LENGTHS[c]).alias(c)
    return rows.select(
        cut("editorial_key"), *(seconds(c) for c in ("start", "end", "duration")), F.coalesce(F.col("score").cast("long"), F.lit(0)).alias("score"),
        *(cut(c) for c in ("score_version", "action", "reason_code")), F.coalesce("tags", F.array().cast("array<string>")).alias("quality_tags"), *(cut(c) for c in ("created_at", "source_signature")),
    )


def is_record(value: Column) -> Column:
    """Whether a variant is an object with a key, an action of ACTIONS and a time of ISO 8601."""
    get = lambda name: F.trim(F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.lit("")))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    at = get("created_at")
    return is_object & (get("editorial_key") != "") & get("action").isin(*ACTIONS) & at.rlike(TIME) & F.replace(at, F.lit("T"), F.lit(" ")).try_cast("timestamp").isNotNull()


def _state(given: Column, valid: Column, found: Column) -> Column:
    return F.when(~given, "missing").when(~valid, "invalid").when(found == 0, "empty").otherwise("ready")


def judged(payloads: DataFrame, column: str, kind: str, version: int) -> DataFrame:
    """Adds STATUS of JSON payloads with ``format, format_version, record_count, records, generated_at``.

    A payload without count is held against no count.  ``state`` is missing for null
    texts, invalid, empty or ready; ``found`` and ``invalid`` count records.
    """
    v = F.try_parse_json(F.col(column))
    get = lambda name, type_: F.try_variant_get("__v", f"$.{name}", type_)
    rows = payloads.withColumn("__v", v).withColumn("__r", get("records", "array<variant>"))
    rows = rows.withColumns({"format": get("format", "string"), "version": F.nullif(get("format_version", "string").try_cast("long"), F.lit(0)), "found": F.coalesce(F.size("__r"), F.lit(0)).cast("long")})
    rows = rows.withColumn("found", F.when(F.col("__r").isNull(), 0).otherwise(F.col("found")).cast("long"))
    count = get("record_count", "string")
    rows = rows.withColumns({
        "declared": count.try_cast("long"),
        "invalid": F.coalesce(F.size(F.filter("__r", lambda r: ~F.coalesce(is_record(r), F.lit(False)))), F.lit(0)).cast("long"),
        "consistent": count.isNull() | F.coalesce(count.try_cast("long") == F.col("found"), F.lit(False)),
        "generated_at": F.nullif(F.substring(get("generated_at", "string"), 1, 40), F.lit("")),
    })
    rows = rows.withColumn("invalid", F.when(F.col("__r").isNull(), 0).otherwise(F.col("invalid")).cast("long"))
    sound = F.col("__r").isNotNull() & F.col("format").eqNullSafe(F.lit(kind)) & F.col("version").eqNullSafe(F.lit(version)) & F.col("consistent") & (F.col("invalid") == 0)
    rows = rows.withColumn("valid", F.coalesce(sound, F.lit(False))).withColumn("state", _state(F.col(column).isNotNull(), F.col("valid"), F.col("found")))
    return rows.drop("__v", "__r")


def _hash(lines: DataFrame) -> tuple[int, str]:
    """Count of the lines, and a sum of parts of their SHA-256 that knows no order."""
    part = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    found = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("h")).first()
    return found["n"], found["h"]


def write_snapshot(records: DataFrame, folder: str, kind: str, version: int, generated_at: str) -> dict:
    """Replaces the snapshot of ``folder`` by these records and returns the manifest, whose count and hash are of what was written."""
    spark, folder = records.sparkSession, folder.rstrip("/")
    files, data = Files(spark, folder), f"records-{uuid.uuid4().hex}"
    records.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in records.columns))).alias("value")).write.text(f"{folder}/{data}")
    count, digest = _hash(spark.read.text(f"{folder}/{data}"))
    manifest = {"format": kind, "format_version": version, "record_count": count, "records_hash": digest, "generated_at": generated_at, "data": data}
    names = _manifests(files, folder)
    number = int(names[-1].removesuffix(".json")) + 1 if names else 0
    files.put(f"{folder}/manifests/{number:012d}.json", json.dumps(manifest))
    # the snapshot before stays for those who read it; older ones go
    for name in names[:-1]:
        old = json.loads(files.read(f"{folder}/manifests/{name}"))
        files.delete(f"{folder}/{old['data']}")
        files.delete(f"{folder}/manifests/{name}")
    return manifest


def _manifests(files: Files, folder: str) -> list[str]:
    return [n for n in files.names(f"{folder}/manifests") if n.endswith(".json") and not n.startswith(".")]


def snapshot_status(spark: SparkSession, folder: str, kind: str, version: int) -> DataFrame:
    """One row of STATUS for the snapshot of a folder; records whose hash isn't the manifest's are not consistent."""
    lines, manifest = _lines(spark, folder)
    records = lines.withColumn("v", F.try_parse_json("value"))
    part = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    out = records.agg(
        F.count("*").alias("found"), F.count_if(~F.coalesce(is_record(F.col("v")), F.lit(False))).alias("invalid"),
        F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("h"),
    )
    lit = lambda name, type_: F.lit(manifest.get(name)).cast(type_)
    out = out.withColumns({"format": lit("format", "string"), "version": lit("format_version", "long"), "declared": lit("record_count", "long"), "generated_at": lit("generated_at", "string")})
    out = out.withColumn("consistent", (F.col("declared").eqNullSafe(F.col("found"))) & F.col("h").eqNullSafe(lit("records_hash", "string")))
    out = out.withColumn("valid", F.col("format").eqNullSafe(F.lit(kind)) & F.col("version").eqNullSafe(F.lit(version)) & F.col("consistent") & (F.col("invalid") == 0))
    return out.withColumn("state", _state(F.lit(bool(manifest)), F.col("valid"), F.col("found"))).select(*STATUS.split(", "))


def _lines(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    folder = folder.rstrip("/")
    files = Files(spark, folder)
    names = _manifests(files, folder)
    manifest = json.loads(files.read(f"{folder}/manifests/{names[-1]}")) if names else {}
    return spark.read.text(f"{folder}/{manifest['data']}") if manifest else spark.createDataFrame([], "value string"), manifest


def read_snapshot(spark: SparkSession, folder: str, schema: str, kind: str, version: int) -> DataFrame:
    """The records of a ready or empty snapshot; an error if there is none or it isn't valid."""
    status = snapshot_status(spark, folder, kind, version).first()
    if status["state"] not in ("ready", "empty"):
        raise ValueError(f"the snapshot of {folder} is {status['state']}: {status.asDict()}")
    lines, _ = _lines(spark, folder)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
