"""Readers of review exports, result caches, profile packs, catalogs, manifests and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import coerce, text, timecode

# The names that review exports, result caches and profile packs use.
REVIEW_COLUMNS = (
    "clip_id", "editorial_key", "label", "decision", "review_status", "action", "duration_sec", "short_duration", "clip_duration", "duration", "format_id", "format", "visual_format", "editorial_family", "family", "hook_family", "hook",
    "headline_sanitized", "headline", "artwork_text", "title", "opening_pattern", "has_qa_bridge", "rejection_reason", "topic",
)
# Names under which lists stand in files of others.
ENVELOPES = ("results", "rows", "items", "mentions", "data")
PROFILE_LISTS = {"acervo_blocks": "archive_block", "blocks": "archive_block", "acervo_pauta": "agenda", "pauta_candidates": "agenda"}


def review_rows(spark: SparkSession, path: str) -> DataFrame:
    """``line, body, error`` of a CSV, JSONL or JSON file of reviews; body is a JSON object of texts.

    Lines that don't parse, or aren't objects, stay as rows with an error.  JSON may be
    an array or an object with items, records or features.
    """
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
        return rows.select(F.monotonically_increasing_id().alias("line"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("body"), F.lit(None).cast("string").alias("error"))
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("raw"))
        return _checked(lines)
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        lists = F.coalesce(*(F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.items", "$.records", "$.features")))
        rows = whole.select(F.posexplode(lists).alias("line", "item"))
        return _checked(rows.select(F.col("line").cast("long").alias("line"), F.to_json("item").alias("raw")))
    raise ValueError("reviews are read from .csv, .jsonl or .json")


def _checked(rows: DataFrame) -> DataFrame:
    parsed = F.try_parse_json("raw")
    kind = F.schema_of_variant(parsed)
    error = F.when(parsed.isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "row_must_be_object")
    return rows.select("line", F.when(error.isNull(), F.col("raw")).alias("body"), error.alias("error"))


def reviews(rows: DataFrame) -> DataFrame:
    """Canonical reviews of ``line, body, error``: accepted ones have no ``reason``.

    Only bounded fields survive; of the headline its shape, never its text.
    """
    got = {c: F.get_json_object("body", f"$.{c}") for c in REVIEW_COLUMNS}
    pick = lambda *names: coerce.first_text(*(got[n] for n in names))
    seconds = coerce.finite_or(pick("duration_sec", "short_duration", "clip_duration", "duration"), -1.0)
    label = F.lower(F.left(F.coalesce(pick("label", "decision", "review_status", "action"), F.lit("")), F.lit(24)))
    reason = F.coalesce("error", F.when(~label.isin("approved", "rejected"), "invalid_label"), F.when((seconds <= 0) | (seconds > 600), "invalid_duration_or_schema"))
    fallback = F.concat(F.lit("row_"), F.col("line").cast("string"), F.lit("_"), F.substring(F.sha2(F.coalesce("body", F.lit("")), 256), 1, 20))
    named = lambda c, n, d="unknown": F.coalesce(F.left(F.lower(c), F.lit(n)), F.lit(d))
    return rows.select(
        "line",
        F.left(F.coalesce(pick("clip_id", "editorial_key"), fallback), F.lit(128)).alias("clip_id"),
        label.alias("decision"),
        seconds.alias("duration"),
        named(pick("format_id", "format", "visual_format"), 40).alias("format_id"),
        named(pick("editorial_family", "family", "hook_family", "hook"), 48).alias("editorial_family"),
        named(got["opening_pattern"], 24).alias("opening_pattern"),
        coerce.flag(got["has_qa_bridge"]).alias("has_qa_bridge"),
        named(got["rejection_reason"], 64, "").alias("rejection_reason"),
        named(got["topic"], 64).alias("topic"),
        text.headline_shape(pick("headline_sanitized", "headline", "artwork_text", "title")).alias("headline_shape"),
        reason.alias("reason"),
    )


def imported(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted reviews (the last one of each clip), and counts: input, accepted, rejected, deduplicated, by reason."""
    good = found.filter("reason is null")
    w = Window.partitionBy("clip_id").orderBy(F.desc("line"))
    kept = good.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "reason")
    counts = found.agg(F.count("*").alias("input"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_distinct(F.when(F.col("reason").isNull(), F.col("clip_id"))).alias("accepted"))
    return kept, counts.withColumn("deduplicated", F.col("input") - F.col("rejected") - F.col("accepted"))


def cached_records(spark: SparkSession, folder: str) -> DataFrame:
    """``file, pos, account, platform, record`` of all result files below a folder, but manifest.json.

    A file is an object, or holds one as JSON text in content[].text.  Its rows stand in
    the first of the known lists, there or one level down; account and platform come
    from the row, else from the envelope.  Files that don't parse give no rows.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    files = files.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("outer")).filter(~F.col("file").endswith("/manifest.json"))
    texts = F.try_variant_get("outer", "$.content", "array<struct<text:string>>")
    inner = F.get(F.filter(F.transform(texts, lambda t: F.try_parse_json(t["text"])), lambda v: v.isNotNull()), F.lit(0))
    body = files.select("file", F.coalesce(inner, "outer").alias("v"))
    paths = [p for k in ENVELOPES for p in (f"$.{k}", *(f"$.{k}.{n}" for n in ENVELOPES[:4]))]
    rows = F.coalesce(*(F.try_variant_get("v", p, "array<variant>") for p in paths))
    value = lambda v, *names: coerce.first_text(*(F.try_variant_get(v, f"$.{n}", "string") for n in names))
    out = body.select("file", "v", F.posexplode(rows).alias("pos", "record"))
    return out.select("file", "pos", F.coalesce(value("record", "channel", "account"), value("v", "channel", "account")).alias("account"), F.lower(F.coalesce(value("record", "platform"), value("v", "platform"))).alias("platform"), "record")


def profile_records(spark: SparkSession, path: str) -> DataFrame:
    """``account, mode, pos, record`` of a profile pack: accounts by name, each with lists of blocks and agenda items."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    accounts = whole.select(F.explode(F.try_variant_get("v", "$.accounts", "map<string,variant>")).alias("account", "data"))
    found = None
    for name, mode in PROFILE_LISTS.items():
        rows = F.coalesce(*(F.try_variant_get("data", p, "array<variant>") for p in (f"$.{name}", f"$.{name}.items", f"$.{name}.results")))
        part = accounts.select("account", F.lit(mode).alias("mode"), F.posexplode(rows).alias("pos", "record"))
        found = part if found is None else found.unionByName(part)
    return found


def pack_status(records: DataFrame) -> DataFrame:
    """Counts of a pack's records by mode, and ready or empty."""
    counts = records.agg(F.count_distinct("account").alias("accounts"), F.count_if(F.col("mode") == "archive_block").alias("blocks"), F.count_if(F.col("mode") == "agenda").alias("agenda"))
    return counts.withColumn("status", F.when(F.col("blocks") + F.col("agenda") > 0, "ready").otherwise("empty"))


def search_fields(records: DataFrame) -> DataFrame:
    """``place, account, platform, url, published, text, similarity, ratio, has_timestamps`` of cached records."""
    get = lambda *names: coerce.first_text(*(F.try_variant_get("record", f"$.{n}", "string") for n in names))
    parts = F.try_variant_get("record", "$.segments", "array<struct<start:double,end:double,text:string>>")
    joined = F.nullif(F.array_join(F.transform(parts, lambda s: s["text"]), " "), F.lit(""))
    ratio = F.coalesce(*(coerce.floored_or_null(get(n), 0.0, float("inf")) for n in ("settledRatio", "ratio", "performanceRatio")))
    timed = F.coalesce(F.exists(parts, lambda s: s["end"] > s["start"]), F.lit(False)) | timecode.seconds_strict(get("start", "startTime", "timestamp", "timecode")).isNotNull()
    place = F.struct(*(F.col(c) for c in ("file", "account", "mode", "pos") if c in records.columns))
    return records.select(
        place.alias("place"),
        F.coalesce("account", F.lit("unknown")).alias("account"),
        F.col("platform") if "platform" in records.columns else F.lower(get("platform")).alias("platform"),
        F.coalesce(get("url", "sourceUrl", "source_url", "youtubeUrl"), F.lit("")).alias("url"),
        timecode.day_of(get("publishedAt", "published_at", "publishedDate")).alias("published"),
        F.coalesce(get("fullScript", "full_script", "transcript", "script", "text"), joined, get("caption", "title", "summary"), F.lit("")).alias("text"),
        coerce.clamp(coerce.finite_or(get("similarity", "semanticScore"), 0.0), 0.0, 1.0).alias("similarity"),
        F.coalesce(ratio, F.lit(0.0)).alias("ratio"),
        F.coalesce(timed, F.lit(False)).alias("has_timestamps"),
    )


def manifest(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """Files of a folder with their content's hash; of equal contents the first path stays."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions)
    hashed = files.filter(wanted).select("path", F.col("length").alias("size"), "modificationTime", F.sha2("content", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min_by(F.struct("path", "size", "modificationTime"), "path").alias("f")).select("f.*", "content_hash")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of a CSV with counts as numbers, and the share of engaged views."""
    rows = spark.read.csv(path, header=True)
    n = lambda c: F.col(c).try_cast("long")
    out = rows.withColumns({c: n(c) for c in ("like_count", "comment_count", "view_count", "play_count") if c in rows.columns})
    seen = F.coalesce(*(F.col(c) for c in ("play_count", "view_count") if c in rows.columns))
    return out.withColumn("rate", F.round(F.try_divide(F.col("like_count") + F.col("comment_count"), F.nullif(seen, F.lit(0))), 6))


def log_pace(lines: DataFrame, pattern: str = r"\[(\d+):(\d+):(\d+)\].*?(\d+) segments") -> DataFrame:
    """Seconds for each new segment from log lines ``line, value`` that state the time and a count, in each ``file`` if they have one."""
    part = lambda i: F.regexp_extract("value", pattern, i).cast("long")
    files = [c for c in ("file",) if c in lines.columns]
    found = lines.filter(F.col("value").rlike(pattern)).select(*files, "line", (part(1) * 3600 + part(2) * 60 + part(3)).alias("at"), part(4).alias("n"))
    w = Window.partitionBy(*files).orderBy("line")
    steps = found.withColumns({"d_at": F.col("at") - F.lag("at").over(w), "d_n": F.col("n") - F.lag("n").over(w)}).filter("d_n > 0")
    return steps.select(*files, "line", "d_at", "d_n", (F.col("d_at") / F.col("d_n")).alias("pace"))


def tolerant_json(raw: Column) -> Column:
    """A variant of text that may be fenced, have typographic quotes or trailing commas; null if nothing helps."""
    body = F.regexp_replace(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), "[“”]", '"')
    inside = F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_replace(inside, r",\s*([\]}])", "$1")))


def api_items(spark: SparkSession, path: str, list_path: str = "$.items", cursor: str = "$.next_max_id") -> DataFrame:
    """``file, cursor, item_id, taken_at, caption, likes, comments, views`` of paged JSON answers; an item is kept once, from the first file that has it."""
    pages = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    rows = pages.select("file", F.try_variant_get("v", cursor, "string").alias("cursor"), F.explode(F.try_variant_get("v", list_path, "array<variant>")).alias("i"))
    get = lambda kind, *paths: F.coalesce(*(F.try_variant_get("i", p, kind) for p in paths))
    out = rows.select(
        "file", "cursor", get("string", "$.code", "$.shortcode", "$.id").alias("item_id"), F.timestamp_seconds(get("bigint", "$.taken_at", "$.taken_at_timestamp")).alias("taken_at"), get("string", "$.caption.text", "$.caption").alias("caption"),
        get("bigint", "$.like_count", "$.likes.count").alias("likes"), get("bigint", "$.comment_count", "$.comments.count").alias("comments"), get("bigint", "$.play_count", "$.view_count", "$.video_view_count").alias("views"),
    )
    rest = [c for c in out.columns if c != "item_id"]
    return out.filter("item_id is not null").groupBy("item_id").agg(F.min_by(F.struct(*rest), "file").alias("r")).select("item_id", "r.*")


def replicated(priors: DataFrame, count: str, most: int = 20) -> DataFrame:
    """Aggregate priors as single observations: each row as often as its count says, once at least and ``most`` times at most."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(F.col(count).cast("int"), F.lit(1))))
    return priors.withColumn("observation", F.explode(F.sequence(F.lit(1), n)))


def highlights(value: Column, most: int = 20) -> Column:
    """Valid intervals of an array of (start, end, label), in order, the first ``most``."""
    return F.slice(F.filter(value, lambda h: (h["start"] >= 0) & (h["end"] > h["start"])), 1, most)


def source_key(value: Column) -> Column:
    """The 11-character video id of a link, else the text in lower case."""
    found = F.regexp_extract(F.coalesce(value, F.lit("")), r"(?:v=|youtu\.be/|shorts/|live/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lower(F.trim(F.coalesce(value, F.lit("")))))


def preview_url(url: Column, start: Column) -> Column:
    """A link with its start in whole seconds as t=, where it has a video id."""
    key = source_key(url)
    return F.when(F.length(key) == 11, F.concat(F.lit("https://www.youtube.com/watch?v="), key, F.lit("&t="), F.floor(start).cast("string"), F.lit("s"))).otherwise(url)
