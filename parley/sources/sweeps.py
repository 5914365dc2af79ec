"""Sweep specifications, results and corpus manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "run string, fixture string, flags string, ok boolean, wer_norm double, wer_raw double, "
    "peak_rss_mb double, asr_ms double, wall_s double, n_segments long, stderr string, "
    "erle struct<sample_rate:int,erle_db:double,echo_only_frames:int,near_active_frames:int,"
    "near_seg_snr_db:double,near_correlation:double>, "
    "cpwer struct<cpwer:double,ref_speakers:int,hyp_speakers:int,speaker_count_error:int,note:string,error:string>"
)
SPEC_SCHEMA = (
    "mode string, fixtures array<struct<id:string,wav:string,ref:string,turns:string,near:string>>, "
    "runs array<struct<name:string,flags:string>>"
)
MANIFEST_SCHEMA = (
    "source string, episodes array<struct<id:string,title:string,mp3_sha256:string,duration_s:double,"
    "speaker_count:int,speakers:array<string>,ref_word_count:long,turn_count:long,"
    "excerpt_start_s:int,excerpt_len_s:int>>"
)
ENGINE_SCHEMA = (
    "engine string, iteration int, fixture string, audio_secs double, asr_ms double, wall_s double, "
    "peak_rss_bytes long, n_segments long, ref_words long, hyp_words long, wer_normalized double, backend string"
)


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Result rows of any number of JSON-lines files; blank lines are skipped.

    The schema is explicit because failed rows lack fields. ``flags`` stays
    JSON text, whatever keys it has.
    """
    return spark.read.schema(RESULT_SCHEMA).json(list(paths))


def read_engine_rows(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(ENGINE_SCHEMA).json(list(paths))


def read_spec(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs (run, flags) and fixtures (fixture, ...) of a sweep specification."""
    return explode_spec(spark.read.schema(SPEC_SCHEMA).json(path, multiLine=True))


def explode_spec(spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    runs = spec.select(F.posexplode("runs").alias("ord", "r")).select("ord", F.col("r.name").alias("run"), "r.flags")
    fixtures = spec.select(F.posexplode("fixtures").alias("ord", "f")).select(
        "ord", F.col("f.id").alias("fixture"), "f.wav", "f.ref", "f.turns", "f.near"
    )
    return runs, fixtures


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    doc = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=multi_line)
    return doc.select("source", F.explode("episodes").alias("e")).select("source", "e.*")


def append_results(results: DataFrame, path: str) -> None:
    """Append rows as JSON lines. Feed it only pending cells to stay resumable."""
    results.write.mode("append").json(path)
