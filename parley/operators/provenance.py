"""How a transcript was made, as one JSON document under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "made"
SCHEMA_VERSION = 1
CLOUD_MODEL = "cloud/default"
LOCAL_MODEL = "local/default"
DIARIZER_MODEL = "local/diarizer"
VAD_MODEL = "local/voice-activity"
EMBEDDING_MODEL = "local/speaker-embedding"


def number(x: Column) -> Column:
    """A number as JSON holds it. JSON cannot hold NaN or infinities, so those are described in text."""
    x = x.cast("double")
    text = F.when(F.isnan(x), '"NaN"').when(x == float("inf"), '"inf"').when(x == float("-inf"), '"-inf"').otherwise(x.cast("string"))
    return F.parse_json(text)


def _model(id_: Column, artifact: Column) -> Column:
    return F.when(id_.isNotNull(), F.struct(id_.alias("id"), artifact.alias("artifact")))


def build(configs: DataFrame, version: str) -> DataFrame:
    """Provenance of each configuration row: an allowlist, nothing else.

    configs: mode (live or batch), backend, threads, diarize and threshold (of
    the diarization); and, where the columns are there, language, asr_engine,
    provider, asr_artifact, vad_threshold, vad_min_silence, vad_model,
    diarization_artifact and embedding_model. Absent and NULL fields are left
    out of the document; finite numbers are numbers in it.
    """
    given = lambda name, kind="string": F.col(name).cast(kind) if name in configs.columns else F.lit(None).cast(kind)
    local = F.col("backend") == "local"
    diarized = local & F.col("diarize")
    settings = F.struct(
        F.when(F.col("mode") == "live", "live_pcm_stream").otherwise("completed_recording").alias("input"),
        F.when(~local, given("language")).alias("language"),
        F.when(local, given("asr_engine")).alias("asr_engine"),
        F.when(local, given("provider")).alias("provider"),
        F.when(local, F.col("threads")).alias("threads"),
        F.when(local, F.col("diarize")).alias("diarize_far_end"),
        F.when(~local, "channel_identification").when(diarized, "channels+diarizer").otherwise("channels").alias("speaker_attribution"),
        F.when(local, number(F.col("threshold"))).alias("threshold"),
        F.when(local, number(given("vad_threshold", "double"))).alias("vad_threshold"),
        F.when(local, number(given("vad_min_silence", "double"))).alias("vad_min_silence_seconds"),
    )
    models = F.struct(
        _model(F.when(local, LOCAL_MODEL).otherwise(CLOUD_MODEL), F.when(local, given("asr_artifact"))).alias("asr"),
        _model(F.when(local, F.coalesce(given("vad_model"), F.lit(VAD_MODEL))), F.lit(None).cast("string")).alias("vad"),
        _model(F.when(diarized, DIARIZER_MODEL), given("diarization_artifact")).alias("diarization"),
        _model(F.when(diarized, F.coalesce(given("embedding_model"), F.lit(EMBEDDING_MODEL))), F.lit(None).cast("string")).alias("speaker_embedding"),
    )
    doc = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema"),
        F.lit(version).alias("version"),
        "mode",
        "backend",
        models.alias("models"),
        settings.alias("configuration"),
    )
    return configs.withColumn("provenance", F.to_json(F.struct(doc.alias(KEY))))


def header_line(provenance: Column) -> Column:
    """One header line; JSON escapes line breaks, so it cannot inject another."""
    return F.concat(F.lit(f"{KEY}: "), F.get_json_object(provenance, f"$.{KEY}"), F.lit("\n"))


def legacy(mode: Column) -> Column:
    """For transcripts made before provenance existed: nothing is inferred."""
    doc = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema"),
        F.lit("unknown").alias("version"),
        mode.alias("mode"),
        F.lit("unknown").alias("backend"),
        F.struct(F.struct(F.lit("unknown").alias("id")).alias("asr")).alias("models"),
        F.create_map().cast("map<string,string>").alias("configuration"),
    )
    return F.to_json(F.struct(doc.alias(KEY)))


def fill_legacy(rows: DataFrame, mode: Column) -> DataFrame:
    return rows.withColumn("provenance", F.coalesce("provenance", legacy(mode)))


def search(
    rows: DataFrame,
    backend: str | None = None,
    mode: str | None = None,
    model: str | None = None,
    setting: str | None = None,
    at_least: float | None = None,
) -> DataFrame:
    """Transcripts by backend, mode, model or a numeric setting."""
    doc = F.parse_json("provenance")
    at = lambda path, kind: F.try_variant_get(doc, f"$.{KEY}.{path}", kind)
    keep = F.lit(True)
    if backend is not None:
        keep = keep & (at("backend", "string") == backend)
    if mode is not None:
        keep = keep & (at("mode", "string") == mode)
    if model is not None:
        keep = keep & (at("models.asr.id", "string") == model)
    if setting is not None and at_least is not None:
        value = F.expr(f"try_cast(try_variant_get(parse_json(provenance), '$.{KEY}.configuration.{setting}', 'string') AS double)")
        keep = keep & (~F.isnan(value)) & (value >= at_least)
    return rows.filter(keep)
