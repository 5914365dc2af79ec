"""Readers for transcripts, service results, turns and reference texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.transcripts import FAR_END, channel_speaker, glue_punctuation, speaker, utterances

_SEGMENT = "struct<speaker:struct<kind:string,label:string>,start:double,end:double,text:string>"
TRANSCRIPT_SCHEMA = f"segments array<{_SEGMENT}>, transcript struct<segments:array<{_SEGMENT}>>"
_ITEM = "struct<start_time:string,end_time:string,type:string,alternatives:array<struct<content:string>>>"
SERVICE_SCHEMA = (
    "results struct<channel_labels:struct<channels:array<struct<channel_label:string,"
    f"items:array<{_ITEM}>>>>,items:array<{_ITEM}>>"
)
TURNS_SCHEMA = "array<struct<speaker:string,text:string>>"


def from_path() -> Column:
    """Identifier of a record: its file name without folder and extension."""
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "")


def _segments(df: DataFrame) -> DataFrame:
    """Explode parsed documents, bare or wrapped, with defaults filled in."""
    segs = F.coalesce("doc.transcript.segments", "doc.segments")
    return df.select("recording_id", F.posexplode(segs).alias("seq", "s")).select(
        "recording_id",
        F.col("seq").cast("long").alias("seq"),
        F.col("s.speaker").alias("speaker"),
        F.coalesce("s.start", F.lit(0.0)).alias("start"),
        F.coalesce("s.end", F.lit(0.0)).alias("end"),
        F.coalesce("s.text", F.lit("")).alias("text"),
    )


def read_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Diarized transcripts, one JSON document per file, named by the file, or one per line.

    A line's document is named by its own ``recording_id``; without one, by its
    file and a hash of the line, so that no two documents of a file are one.
    """
    if multi_line:
        raw = spark.read.schema(TRANSCRIPT_SCHEMA).json(path, multiLine=True)
        return _segments(raw.select(from_path().alias("recording_id"), F.struct("segments", "transcript").alias("doc")))
    doc = F.from_json("value", f"recording_id string, {TRANSCRIPT_SCHEMA}")
    lines = spark.read.text(path).filter("trim(value) <> ''").select(from_path().alias("_file"), "value", doc.alias("doc"))
    unnamed = F.concat("_file", F.lit(":"), F.lower(F.hex(F.xxhash64("value"))))
    return _segments(lines.select(F.coalesce("doc.recording_id", unnamed).alias("recording_id"), "doc"))


def parse_transcripts(rows: DataFrame) -> DataFrame:
    """The same from a table (recording_id, json)."""
    return _segments(rows.select("recording_id", F.from_json("json", TRANSCRIPT_SCHEMA).alias("doc")))


def _items(df: DataFrame, items: str, *keys: str) -> DataFrame:
    time = lambda c: F.expr(f"try_cast({c} as double)")
    return df.select(*keys, F.posexplode(items).alias("seq", "i")).select(
        *keys,
        F.col("seq").cast("long").alias("seq"),
        F.col("i.type").alias("type"),
        F.try_element_at("i.alternatives", F.lit(1))["content"].alias("content"),
        time("i.start_time").alias("start"),
        time("i.end_time").alias("end"),
    )


def service_words(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channel-identified results (recording_id, json): words and rejects.

    A document without channel labels is an error row, never dropped.
    """
    doc = rows.select("recording_id", F.from_json("json", SERVICE_SCHEMA).alias("d"))
    labels = F.col("d.results.channel_labels")
    rejects = doc.filter(labels.isNull()).select(
        "recording_id", F.lit("result has no channel labels").alias("error")
    )
    chans = doc.filter(labels.isNotNull()).select(
        "recording_id", F.posexplode(labels["channels"]).alias("channel_no", "c")
    )
    items = _items(
        chans.select("recording_id", "channel_no", F.col("c.channel_label").alias("channel_label"), F.col("c.items").alias("items")),
        "items",
        "recording_id",
        "channel_no",
        "channel_label",
    )
    return glue_punctuation(items, ["recording_id", "channel_no", "channel_label"]), rejects


def service_segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channel-identified results as segments; channel ch_0 is the recorder."""
    words, rejects = service_words(rows)
    chan = F.when(F.col("channel_label") == "ch_0", 0).otherwise(F.col("channel_no") + 1)
    segs = utterances(words.withColumn("channel", chan))
    return segs.withColumn("speaker", channel_speaker(F.col("channel"))), rejects


def flat_service_segments(rows: DataFrame) -> DataFrame:
    """Single-channel results: every utterance is the far end's."""
    doc = rows.select("recording_id", F.from_json("json", SERVICE_SCHEMA).alias("d"))
    items = _items(doc.select("recording_id", F.col("d.results.items").alias("items")), "items", "recording_id")
    words = glue_punctuation(items, ["recording_id"]).withColumn("channel", F.lit(1))
    return utterances(words).withColumn("speaker", speaker("other", F.lit(FAR_END)))


def read_reference_text(spark: SparkSession, path: str) -> DataFrame:
    """Plain reference texts, one whole file per row, verbatim."""
    raw = spark.read.text(path, wholetext=True)
    folders = [c for c in raw.columns if c != "value"]
    return raw.select(*folders, from_path().alias("fixture"), F.col("value").alias("text"))


def read_reference_turns(spark: SparkSession, path: str) -> DataFrame:
    """Ordered reference turns, one JSON array per file: fixture, seq, speaker, text.

    A fixture is named by its folder ``fixture=...`` where there is one, else by its file.
    """
    whole = spark.read.text(path, wholetext=True)
    fixture = F.col("fixture").cast("string") if "fixture" in whole.columns else from_path()
    return parse_turns(whole.select(fixture.alias("fixture"), F.col("value").alias("json")))


def parse_turns(rows: DataFrame) -> DataFrame:
    turns = F.from_json("json", TURNS_SCHEMA)
    return rows.select("fixture", F.posexplode(turns).alias("seq", "t")).select(
        "fixture",
        F.col("seq").cast("long").alias("seq"),
        "t.speaker",
        F.coalesce("t.text", F.lit("")).alias("text"),
    )
