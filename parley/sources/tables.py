"""State tables, dimensions and operational feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import clock
from parley.operators import consent

RECORDINGS_SCHEMA = (
    "id string, started_at timestamp_ntz, ended_at timestamp_ntz, owning_app string, bundle_id string, "
    "audio_path string, status string, remote_uri string, remote_job string, note_path string, "
    "error string, transcribe_secs double, updated_at timestamp_ntz"
)
JOBS_SCHEMA = (
    "id long, kind string, payload string, state string, attempts int, max_attempts int, "
    "next_run_at timestamp_ntz, period_secs long, last_error string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz"
)
LOG_SCHEMA = "timestamp string, level string, target string, message string, fields map<string,string>"
STATS_SCHEMA = (
    "timestamp string, backend string, detector_recording boolean, webinar_recording boolean, "
    "phys_mb double, rss_mb double, threads array<struct<name:string,cpu_pct:double>>"
)
JURISDICTION_FILE_SCHEMA = (
    "id string, name string, region string, scope string, consent string, phoneRule string, "
    "inPersonRule string, statute string, notes string, confidence string, lastReviewed string, "
    "sourceDisagreement boolean"
)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDINGS_SCHEMA).parquet(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOBS_SCHEMA).parquet(path)


def normalize_times(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Any-offset timestamp texts as fixed-width UTC text, NULL when malformed."""
    for c in columns:
        rows = rows.withColumn(c, clock.utc_text(clock.parse_offset(F.col(c))))
    return rows


def read_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(LOG_SCHEMA).json(path)


def read_stats(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(STATS_SCHEMA).json(path)


def read_jurisdictions(spark: SparkSession, path: str) -> DataFrame:
    """A jurisdiction dimension from a JSON array file, in file order."""
    whole = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", f"array<struct<{_struct_fields(JURISDICTION_FILE_SCHEMA)}>>")
    return whole.select(F.posexplode(rows).alias("ord", "j")).select(
        "ord",
        *[F.col(f"j.{c.split()[0]}").alias(n) for c, n in zip(JURISDICTION_FILE_SCHEMA.split(", "), _NAMES)],
    )


_NAMES = [
    "id", "name", "region", "scope", "consent", "phone_rule", "in_person_rule", "statute", "notes",
    "confidence", "last_reviewed", "source_disagreement",
]


def _struct_fields(schema: str) -> str:
    return ",".join(":".join(part.split()) for part in schema.split(", "))


def jurisdictions(spark: SparkSession) -> DataFrame:
    """The built-in dimension."""
    return spark.createDataFrame(consent.jurisdiction_rows(), consent.JURISDICTION_SCHEMA)
