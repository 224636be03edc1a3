"""Caption files, sidecars, hosts, metadata and tracks as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import clean_lines
from cuelake.functions.times import parse_timestamp

_STAMP = r"((?:\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{1,3})"
# Hosts of the known platforms.
HOSTS = {"youtube": ["youtube.com", "youtu.be"], "bilibili": ["bilibili.com", "b23.tv"]}
# Track names that hold no captions.
NOT_CAPTIONS = ["live_chat", "danmaku", "comments"]


def scan_captions(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, place, s, e, text): the cues of WebVTT and SubRip texts, one file per row.

    Files are whole rows, as ``spark.read.text(path, wholetext=True)`` gives them; a byte-order mark is dropped. Blocks are
    parted by blank lines; a block without timing is no cue, nor is one without text or with an end before its start.
    """
    flat = F.regexp_replace(F.regexp_replace(F.col(content), "^\ufeff", ""), "\r\n?", "\n")
    blocks = files.select(key, F.posexplode(F.split(flat, r"\n[ \t]*\n")).alias("place", "block")).where(F.col("block").contains("-->"))
    # the first line with an arrow is the timing; what follows it is text
    lined = blocks.select(key, "place", F.split("block", "\n").alias("lines")).withColumn("at", F.array_position(F.transform("lines", lambda x: x.contains("-->")), True).cast("int"))
    timed = lined.select(key, "place", F.get("lines", F.col("at") - 1).alias("timing"), F.slice("lines", F.col("at") + 1, F.size("lines")).alias("body"))
    pattern = rf"{_STAMP}\s*-->\s*{_STAMP}"
    ms = lambda i: F.round(parse_timestamp(F.regexp_extract("timing", pattern, i)) * 1000).cast("bigint")
    cues = timed.where(F.col("timing").rlike(pattern)).select(key, "place", ms(1).alias("s"), ms(2).alias("e"), clean_lines(F.col("body")).alias("text"))
    return cues.where("text <> '' and e >= s")


def caption_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files under a path: as UTF-8, undecodable bytes replaced; each file is one row, as a whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all caption files under a path, with the file they came from."""
    return scan_captions(caption_files(spark, path).withColumnRenamed("path", "file"), "file", "content")


def sidecars(files: DataFrame) -> DataFrame:
    """(stem, path, cues, warning): the caption file next to a medium: WebVTT before SubRip, the first that has cues.

    ``files``: (path, content). A WebVTT file without cues gives way to SubRip with a warning; a stem without any file
    that can be used has no row.
    """
    named = files.where(F.col("path").rlike(r"\.(vtt|srt)$")).select("path", "content")
    n = scan_captions(named, "path", "content").groupBy("path").agg(F.count(F.lit(1)).alias("cues"))
    j = named.select("path", F.regexp_extract("path", r"([^/]*)\.(vtt|srt)$", 1).alias("stem"), F.col("path").endswith(".srt").cast("int").alias("later")).join(n, "path", "left")
    usable = F.when(F.col("cues") > 0, F.struct("later", "path", "cues"))
    g = j.groupBy("stem").agg(F.min(usable).alias("best"), F.min(F.when(F.col("cues").isNull(), F.col("later"))).alias("unusable"))
    warning = F.when(F.col("unusable") < F.col("best.later"), "the WebVTT file has no cues, SubRip was used")
    return g.where("best is not null").select("stem", F.col("best.path").alias("path"), F.col("best.cues").alias("cues"), warning.alias("warning"))


def content_ids(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_id, size): files by the digest of their bytes. A file that isn't as long as it was when it was listed
    changed while it was read: it has no id. Empty files aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    same = F.octet_length("content") == F.col("length")
    return files.select("path", F.when(same, F.concat(F.lit("local-"), F.sha2("content", 256))).alias("content_id"), F.col("length").alias("size"))


def platform_of(url: Column) -> Column:
    """The platform of a web address by its host, exactly or as a subdomain; ``unsupported`` otherwise."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"\.$", "")
    out = F.when(~F.coalesce(url.rlike("^(?i:https?)://"), F.lit(False)), "unsupported")
    for platform, hosts in HOSTS.items():
        for h in hosts:
            out = out.when((host == h) | host.endswith(f".{h}"), platform)
    return out.otherwise("unsupported")


def request_url(url: Column) -> Column:
    """Addresses of one platform's videos end with a slash."""
    return F.when(platform_of(url) == "bilibili", F.regexp_replace(url, r"^([^?#]*/video/[^/?#]+)(?=[?#]|$)", "$1/")).otherwise(url)


INFO = "id string, title string, uploader string, channel string, creator string, duration string, webpage_url string"


def metadata(info: DataFrame, key: str, json: str, url: str) -> DataFrame:
    """Source metadata from a downloader's JSON: rows without an id are no source; unusable durations are 0."""
    m = info.select(key, F.from_json(json, INFO).alias("m"), F.col(url).alias("u"))
    text = lambda x: F.nullif(F.trim(F.col(f"m.{x}")), F.lit(""))
    d = F.col("m.duration").try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < float("inf"))
    return m.where(text("id").isNotNull()).select(
        key, text("id").alias("source_id"), F.coalesce(text("title"), text("id")).alias("title"), F.coalesce(text("uploader"), text("channel"), text("creator"), F.lit("")).alias("author"),
        F.when(ok, d).otherwise(0.0).alias("duration_seconds"), F.coalesce(text("webpage_url"), F.col("u")).alias("webpage_url"),
    )


def listed_tracks(info: DataFrame, key: str, tracks: str) -> DataFrame:
    """(key, language, formats): languages of a map of language to formats that hold captions."""
    t = info.select(key, F.explode(tracks).alias("language", "formats"))
    return t.where((F.trim("language") != "") & ~F.lower(F.trim("language")).isin(NOT_CAPTIONS) & (F.size("formats") > 0)).select(key, "language", F.size("formats").alias("formats"))


PROBE = "format struct<duration: string>, streams array<struct<codec_type: string, duration: string, disposition: struct<attached_pic: int>>>"


def probed(media: DataFrame, key: str, json: str) -> DataFrame:
    """(key, kinds, duration_seconds) of a probe's JSON: cover pictures are no video; media without sound or picture go."""
    p = media.select(key, F.from_json(json, PROBE).alias("p"))
    real = F.filter("p.streams", lambda s: ~((s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 1)))
    kinds = F.array_sort(F.array_intersect(F.transform(real, lambda s: s["codec_type"]), F.array(F.lit("audio"), F.lit("video"))))
    longest = F.array_max(F.transform(real, lambda s: s["duration"].try_cast("double")))
    d = F.coalesce(F.col("p.format.duration").try_cast("double"), longest, F.lit(0.0))
    out = p.select(key, F.array_join(kinds, ",").alias("kinds"), d.alias("duration_seconds"))
    return out.where((F.col("kinds") != "") & ~F.isnan("duration_seconds") & (F.abs("duration_seconds") < float("inf")))


READING = "engine string, frames array<struct<path: string, error: string, observations array<struct<text: string, confidence: double, boundingBox: struct<x: double, y: double, width: double, height: double>>>>>"
READING = READING.replace("observations array", "observations: array").replace("frames array", "frames array")


def readings(responses: DataFrame, key: str, json: str, engine: str, expected: str | None = None) -> DataFrame:
    """Observations of a recogniser's JSON; responses of another engine, unreadable ones, and ones with another number of
    frames than the column ``expected`` says, give none."""
    count = F.col(expected) if expected else F.lit(None).cast("int")
    r = responses.select(key, count.alias("n"), F.from_json(json, READING).alias("r")).where((F.col("r.engine") == engine) & F.coalesce(F.size("r.frames") == F.col("n"), F.lit(expected is None)))
    f = r.select(key, F.posexplode("r.frames").alias("frame", "f")).select(key, "frame", F.explode("f.observations").alias("o"))
    b = F.col("o.boundingBox")
    finite = ~F.isnan("o.confidence") & F.col("o.confidence").isNotNull() & b.getField("x").isNotNull() & b.getField("y").isNotNull()
    return f.where(finite & (F.trim("o.text") != "")).select(key, "frame", F.col("o.text").alias("text"), F.col("o.confidence").alias("confidence"), b.getField("x").alias("x"), b.getField("y").alias("y"))
