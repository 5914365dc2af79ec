"""Recording and job tables: state, retries, recovery, retention.

recordings: id, started_at, ended_at, owning_app, bundle_id, audio_path,
status, remote_uri, remote_job, note_path, error, transcribe_secs, updated_at
jobs: id, kind, payload (JSON text), state, attempts, max_attempts,
next_run_at, period_secs, last_error, created_at, updated_at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import clock, maths, text
from parley.session import dealt

# Statuses, retry policy and retention horizons.
STATUSES = ["recording", "pending_transcription", "transcribing", "pending_note", "done", "failed"]
TERMINAL = ["done", "failed"]
ACTIVE = ["pending", "running"]
RETRY_KIND = "retry_transcription"
RETRY_MAX_ATTEMPTS = 5
RETRY_BASE_SECS = 30
RETRY_CAP_SECS = 3600
MIN_ROW_DAYS = 90
FAILED_JOB_DAYS = 30
CHECKPOINT_VERSION = 1
HISTORY_LIMIT = 5
STRANDED = "app quit during the recording — audio incomplete"


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def known_status(status: Column) -> Column:
    return status.isin(*STATUSES)


def resumable(recordings: DataFrame) -> DataFrame:
    return recordings.filter(~is_terminal(F.col("status"))).orderBy("started_at", "id")


def expired(recordings: DataFrame, cutoff: Column) -> DataFrame:
    return recordings.filter(is_terminal(F.col("status")) & (F.col("updated_at") < cutoff)).orderBy(
        "started_at", "id"
    )


def mode(bundle: Column, app: Column) -> Column:
    return F.when(bundle.isNull() & (app == text.WEBINAR), "webinar").otherwise("call")


def note_title(app: Column, bundle: Column, started: Column) -> Column:
    suffix = F.when((mode(bundle, app) == "call") & bundle.isNotNull(), " call").otherwise("")
    return F.concat(app, suffix, F.lit(" — "), clock.minute_stamp(started))


def source_label(app: Column, started: Column) -> Column:
    return F.concat(text.yaml_safe(app), F.lit(" · "), clock.minute_stamp(started))


def stem(app: Column, started: Column) -> Column:
    return F.concat(F.date_format(started, "yyyyMMdd-HHmmss"), F.lit("-"), text.slug(app))


def file_stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def recording_id(path: Column, started: Column) -> Column:
    return F.coalesce(F.nullif(file_stem(path), F.lit("")), F.date_format(started, "yyyyMMdd-HHmmssSSS"))


def clean_path(path: Column) -> Column:
    folder = F.regexp_extract(path, r"^(.*/)?", 0)
    return F.concat(folder, file_stem(path), F.lit("-clean.wav"))


def name_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\.wav$", ""), "-clean$", "")


def meta_from_name(files: DataFrame, path: str, fallback: Column) -> DataFrame:
    """Recording facts from a file name alone."""
    s = name_stem(F.substring_index(F.col(path), "/", -1))
    at = F.try_to_timestamp(
        F.when(F.substring(s, 1, 15).rlike(r"^\d{8}-\d{6}$"), F.substring(s, 1, 15)), F.lit("yyyyMMdd-HHmmss")
    ).cast("timestamp_ntz")
    rest = F.when(at.isNotNull(), F.substr(s, F.lit(17))).otherwise(s)
    rest = F.regexp_replace(rest, "^-+|-+$", "")
    return files.select(
        *files.columns,
        s.alias("stem"),
        F.coalesce(at, fallback).alias("started_at"),
        F.when(rest == "", text.UNKNOWN_APP).otherwise(text.humanize_slug(rest)).alias("app"),
    )


def payload_id(payload: Column) -> Column:
    return F.get_json_object(payload, "$.id")


def active_retries(jobs: DataFrame) -> DataFrame:
    """First active retry job per recording."""
    live = jobs.filter((F.col("kind") == RETRY_KIND) & F.col("state").isin(*ACTIVE))
    return (
        live.groupBy(payload_id(F.col("payload")).alias("id"))
        .agg(F.min_by("attempts", F.col("id")).alias("retry_attempts"))
        .filter(F.col("id").isNotNull())
    )


def with_retry(recordings: DataFrame, jobs: DataFrame) -> DataFrame:
    return recordings.join(active_retries(jobs), "id", "left").withColumn(
        "retry_pending", F.col("retry_attempts").isNotNull()
    )


def with_artifacts(recordings: DataFrame, files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Existence facts against a file listing (path, length).

    checkpoints: id, version, ...; only the supported version counts.
    """
    audio = files.select(F.col("path").alias("audio_path"), F.col("length").alias("audio_bytes"))
    notes = files.select(F.col("path").alias("_np"), F.lit(True).alias("_note"))
    valid = checkpoints.filter(F.col("version") == CHECKPOINT_VERSION).select("id", F.lit(True).alias("_cp"))
    # Rows without a note would all meet in one task under a NULL key.
    note_key = F.coalesce("note_path", F.concat(F.lit("\u0000"), "id"))
    return (
        recordings.withColumn("_np", note_key)
        .join(audio, "audio_path", "left")
        .join(notes, "_np", "left")
        .join(valid.distinct(), "id", "left")
        .withColumn("audio_exists", F.col("audio_bytes").isNotNull())
        .withColumn("note_exists", F.coalesce("_note", F.lit(False)))
        .withColumn("checkpoint_valid", F.coalesce("_cp", F.lit(False)))
        .withColumn("recovery_exists", F.col("audio_exists") | F.col("checkpoint_valid"))
        .drop("_note", "_cp", "_np")
    )


def recoverable(recordings: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Unfinished rows whose transcript is already durable."""
    valid = checkpoints.filter(F.col("version") == CHECKPOINT_VERSION)
    return recordings.filter(~is_terminal(F.col("status"))).join(valid, "id", "left_semi")


def owned_notes(recordings: DataFrame, checkpoints: DataFrame, jobs: DataFrame) -> DataFrame:
    """Which note belongs to a recording.

    Canonical checkpoint, then canonical payload, then any checkpoint note,
    then any payload note, then the row's own path.
    """
    cp = checkpoints.filter(F.col("version") == CHECKPOINT_VERSION).select(
        "id", F.col("note_path").alias("cp_note"), F.coalesce("note_canonical", F.lit(False)).alias("cp_canon")
    )
    doc = F.col("payload")
    pl = (
        jobs.filter((F.col("kind") == RETRY_KIND) & F.col("state").isin(*ACTIVE))
        .select(
            payload_id(doc).alias("id"),
            F.col("id").alias("_job"),
            F.get_json_object(doc, "$.preferred_note").alias("pl_note"),
            (F.get_json_object(doc, "$.note_canonical") == "true").alias("pl_canon"),
        )
        .groupBy("id")
        .agg(F.min_by(F.struct("pl_note", "pl_canon"), "_job").alias("_p"))
        .select("id", F.col("_p.pl_note"), F.coalesce("_p.pl_canon", F.lit(False)).alias("pl_canon"))
    )
    c, p, r = F.col("cp_note"), F.col("pl_note"), F.col("note_path")
    owner = (
        F.when(c.isNotNull() & F.col("cp_canon"), F.struct(c.alias("note"), F.lit("checkpoint").alias("origin"), F.lit(True).alias("canonical")))
        .when(p.isNotNull() & F.col("pl_canon"), F.struct(p.alias("note"), F.lit("payload").alias("origin"), F.lit(True).alias("canonical")))
        .when(c.isNotNull(), F.struct(c.alias("note"), F.lit("checkpoint").alias("origin"), F.lit(False).alias("canonical")))
        .when(p.isNotNull(), F.struct(p.alias("note"), F.lit("payload").alias("origin"), F.lit(False).alias("canonical")))
        .when(r.isNotNull(), F.struct(r.alias("note"), F.lit("row").alias("origin"), F.lit(False).alias("canonical")))
    )
    return (
        recordings.select("id", "note_path")
        .join(cp, "id", "left")
        .join(pl, "id", "left")
        .withColumn("_o", owner)
        .filter(F.col("_o").isNotNull())
        .select("id", "_o.note", "_o.origin", "_o.canonical")
    )


def retry_action(status: Column, checkpoint: Column, canonical: Column, audio: Column) -> Column:
    return (
        F.when(is_terminal(status), "stale")
        .when(checkpoint, "file_checkpoint")
        .when(canonical, "complete_canonical_note")
        .when(status == "recording", "stale")
        .when(~audio, "missing_audio")
        .when(status == "pending_note", "transcribe_legacy_pending_note")
        .otherwise("transcribe")
    )


def stranded(recordings: DataFrame) -> DataFrame:
    """Rows left at ``recording``: retry where audio survived, else fail."""
    there = F.col("audio_exists")
    return recordings.filter(F.col("status") == "recording").select(
        "id",
        F.when(there, "retry").otherwise("fail").alias("action"),
        F.when(there, "pending_transcription").otherwise("failed").alias("new_status"),
        F.when(~there, STRANDED).alias("error"),
    )


def failure_outcomes(jobs: DataFrame, error: Column, now: Column, base: int = RETRY_BASE_SECS, cap: int = RETRY_CAP_SECS) -> DataFrame:
    """Next state of running jobs that just failed."""
    periodic = F.col("period_secs").isNotNull()
    again = F.col("attempts") < F.col("max_attempts")
    wait = F.when(periodic, F.col("period_secs").cast("long")).when(
        again, maths.backoff(F.col("attempts").cast("long"), base, cap)
    )
    return (
        jobs.filter(F.col("state") == "running")
        .withColumn("state", F.when(wait.isNotNull(), "pending").otherwise("failed"))
        .withColumn(
            "next_run_at",
            F.when(wait.isNotNull(), clock.from_millis(clock.millis(now) + wait * 1000)).otherwise(F.col("next_run_at")),
        )
        .withColumn("attempts", F.when(periodic, F.lit(0)).otherwise(F.col("attempts")))
        .withColumn("last_error", error)
        .withColumn("updated_at", now)
    )


def recover_running(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs orphaned by a crash become due now; their attempts stand."""
    hung = F.col("state") == "running"
    return (
        jobs.withColumn("next_run_at", F.when(hung, now).otherwise(F.col("next_run_at")))
        .withColumn("updated_at", F.when(hung, now).otherwise(F.col("updated_at")))
        .withColumn("state", F.when(hung, "pending").otherwise(F.col("state")))
    )


def due(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter((F.col("state") == "pending") & (F.col("next_run_at") <= now)).orderBy("next_run_at", "id")


def earliest_due(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    return due(jobs, now).limit(n)


def next_due(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.min(F.when(F.col("state") == "pending", F.col("next_run_at"))).alias("next_due_at"))


def apply_changes(changes: DataFrame, fields: list[str]) -> DataFrame:
    """Current state from a change log (id, version, fields): NULL keeps.

    One combining aggregate per field; no ordering of a key's whole log.
    """
    newest = [
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("version"))).alias(f) for f in fields
    ]
    return changes.groupBy("id").agg(*newest, F.max("version").alias("version"))


def enqueue_missing(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert by id unless tracked; tracked rows stay as they are.

    Of new rows with one id the earliest goes in; equal times are told apart
    by the whole row, so the choice never depends on the order of rows.
    """
    earliest = F.struct("started_at", F.to_json(F.struct(*new.columns)))
    once = new.groupBy("id").agg(F.min_by(F.struct(*new.columns), earliest).alias("_r")).select("_r.*")
    return existing.unionByName(once.join(existing, "id", "left_anti"), allowMissingColumns=True)


def enqueue_jobs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New jobs to insert: none with an equal active (kind, payload)."""
    active = existing.filter(F.col("state").isin(*ACTIVE)).select("kind", "payload")
    once = new.groupBy("kind", "payload").agg(F.min("ord").alias("ord"))
    return once.join(active, ["kind", "payload"], "left_anti")


def artifact_paths(recordings: DataFrame, temps: DataFrame | None = None) -> DataFrame:
    """Every path a recording may own, once each."""
    p = F.col("audio_path")
    listed = F.array(
        p,
        clean_path(p),
        F.concat(p, F.lit(".checkpoint.json")),
        F.concat(p, F.lit(".staging.json")),
    )
    out = recordings.select("id", F.explode(F.array_distinct(listed)).alias("path"))
    return out if temps is None else dealt(out.unionByName(temps.select("id", "path")), "id", "path").distinct()


def retention_plan(recordings: DataFrame, jobs: DataFrame, staging: DataFrame, now: Column, days: int) -> DataFrame:
    """What a sweep would remove: a plan table, deleting nothing.

    Terminal rows past ``days`` lose their artifacts, with the temporary files
    beside them, past max(days, 90) the row too; rows with unresolved staging keep everything. Unfinished rows
    lose only stale temporary files. Failed jobs go after 30 days.
    """
    before = lambda d: clock.from_millis(clock.millis(now) - d * 86_400_000)
    old = recordings.filter(F.col("updated_at") < before(days))
    ready = old.filter(is_terminal(F.col("status"))).join(staging.select("id"), "id", "left_anti")
    stray = F.concat("audio_path", F.lit(".checkpoint.json.tmp*")).alias("path")
    files = artifact_paths(ready, ready.select("id", stray)).select("id", F.lit("delete_artifact").alias("action"), "path")
    rows_ = ready.filter(F.col("updated_at") < before(max(days, MIN_ROW_DAYS))).select(
        "id", F.lit("delete_row").alias("action"), F.lit(None).cast("string").alias("path")
    )
    temps = old.filter(~is_terminal(F.col("status"))).select(
        "id",
        F.lit("delete_stale_temps").alias("action"),
        stray,
    )
    debris = jobs.filter((F.col("state") == "failed") & (F.col("updated_at") < before(FAILED_JOB_DAYS))).select(
        F.col("id").cast("string").alias("id"),
        F.lit("delete_job").alias("action"),
        F.lit(None).cast("string").alias("path"),
    )
    return files.unionByName(rows_).unionByName(temps).unionByName(debris)


def sweep_summary(plan: DataFrame) -> DataFrame:
    hit = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(
        hit("delete_artifact").alias("files"),
        hit("delete_row").alias("rows"),
        hit("delete_job").alias("jobs"),
    )


def retry_target(status: Column, checkpoint: Column) -> Column:
    return F.when((status == "pending_note") | checkpoint, "pending_note").otherwise("pending_transcription")


def reset_for_retry(requests: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual retries (id, target): accepted updates and rejected requests."""
    r = requests.join(recordings.select("id", "status"), "id", "left")
    legal = F.col("target").isin("pending_transcription", "pending_note")
    ok = legal & F.coalesce(F.col("status") == "failed", F.lit(False))
    accepted = r.filter(ok).select("id", F.col("target").alias("status"), F.lit(None).cast("string").alias("error"))
    why = (
        F.when(~legal, F.concat(F.lit("cannot reset to "), "target"))
        .when(F.col("status").isNull(), "no such recording")
        .otherwise("recording is not failed")
    )
    return accepted, r.filter(~ok).select("id", "target", why.alias("reason"))


def reflect_backoff(recordings: DataFrame, failed_jobs: DataFrame) -> DataFrame:
    """Show a waiting retry on its unfinished recording.

    recordings need ``checkpoint_valid``; failed_jobs: payload, last_error, id.
    """
    by_id = failed_jobs.groupBy(payload_id(F.col("payload")).alias("id")).agg(
        F.max_by("last_error", F.col("id")).alias("error")
    )
    open_rows = recordings.filter(~is_terminal(F.col("status"))).drop("error")
    return open_rows.join(by_id, "id").select(
        "id", retry_target(F.col("status"), F.col("checkpoint_valid")).alias("status"), "error"
    )


def resolve_audio(requests: DataFrame, recordings: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Which audio a bare file name means.

    A tracked row's raw audio, then its cleaned sibling. Without a row: the
    literal name, the stem, the cleaned stem, all in ``folder``. requests: name.
    """
    at = F.lit(f"{folder.rstrip('/')}/")
    arg_clean = F.col("name").endswith("-clean.wav")
    r = requests.withColumn("stem", name_stem(F.col("name"))).join(
        recordings.select(F.col("id").alias("stem"), "audio_path"), "stem", "left"
    )
    tries = F.when(
        F.col("audio_path").isNotNull(),
        F.array(
            F.struct(F.col("audio_path").alias("path"), F.lit(False).alias("clean")),
            F.struct(clean_path(F.col("audio_path")).alias("path"), F.lit(True).alias("clean")),
        ),
    ).otherwise(
        F.array(
            F.struct(F.concat(at, "name").alias("path"), arg_clean.alias("clean")),
            F.struct(F.concat(at, "stem", F.lit(".wav")).alias("path"), F.lit(False).alias("clean")),
            F.struct(F.concat(at, "stem", F.lit("-clean.wav")).alias("path"), F.lit(True).alias("clean")),
        )
    )
    options = r.select("name", "stem", F.col("audio_path").isNotNull().alias("tracked"), F.posexplode(tries).alias("ord", "t"))
    present = options.select("name", "stem", "tracked", "ord", "t.path", "t.clean").join(
        files.select("path", F.lit(True).alias("_there")), "path", "left"
    )
    best = F.min_by(F.struct("path", "clean"), F.when(F.col("_there"), F.col("ord")))
    return (
        present.groupBy("name", "stem", "tracked")
        .agg(best.alias("_b"))
        .select(
            "name",
            "stem",
            "tracked",
            "_b.path",
            F.col("_b.clean").alias("skip_cleaning"),
            F.when(F.col("_b").isNull(), F.when(F.col("tracked"), "audio is gone").otherwise("no recording found")).alias("error"),
        )
    )


def catalog_status(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Artifact catalog (id, present_path, install_path) against a listing.

    Bytes count everything under the install path, only when present.
    """
    key = files.select(F.col("path").alias("present_path"), F.lit(True).alias("_there")).distinct()
    sizes = bytes_under(catalog.select(F.col("install_path").alias("prefix")).distinct(), files)
    return (
        catalog.join(key, "present_path", "left")
        .join(sizes.withColumnRenamed("prefix", "install_path"), "install_path", "left")
        .select(
            "id",
            F.coalesce("_there", F.lit(False)).alias("present"),
            F.when(F.col("_there"), F.coalesce("bytes", F.lit(0))).otherwise(0).alias("on_disk_bytes"),
        )
    )


def bytes_under(prefixes: DataFrame, files: DataFrame) -> DataFrame:
    """Total file length under each prefix; a missing prefix has 0.

    Each file is expanded to its own ancestor folders, which turns a prefix
    test into an equi-join.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )
    sums = (
        files.select("length", F.explode(ancestors).alias("prefix"))
        .groupBy("prefix")
        .agg(F.sum("length").alias("bytes"))
    )
    return prefixes.join(sums, "prefix", "left").select("prefix", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def integrity(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """Files whose bytes do not match the manifest hash (path, sha256)."""
    actual = content.select("path", F.sha2("content", 256).alias("actual"))
    return manifest.join(actual, "path", "left").filter(
        F.col("actual").isNull() | (F.col("actual") != F.col("sha256"))
    )


def history(entries: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """Newest recordings, each id once in its latest version."""
    rest = [c for c in entries.columns if c != "id"]
    once = entries.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("pushed")).alias("_e"))
    return once.select("id", "_e.*").orderBy(F.col("pushed").desc(), "id").limit(n)


def row_state(df: DataFrame) -> DataFrame:
    """Label, tone and action of a queue row.

    Needs status, mode, duration_secs, error, transcribe_secs, note_path,
    note_exists, recovery_exists, retry_pending, retry_attempts.
    """
    c = F.col
    dur = clock.duration_text(c("duration_secs"))
    what = F.concat(
        F.when(dur != "", F.concat(dur, F.lit(" "))).otherwise(""),
        F.when(c("mode") == "webinar", "webinar").otherwise("call"),
    )
    tries = F.when(
        F.coalesce(c("retry_attempts"), F.lit(0)) > 0,
        F.concat(F.lit(" (attempt "), c("retry_attempts").cast("string"), F.lit("/5)")),
    ).otherwise("")
    waits = c("retry_pending") & (F.coalesce(c("error"), F.lit("")) != "")
    took = F.when(
        c("transcribe_secs").isNotNull(), F.concat(F.lit(" in "), clock.duration_text(c("transcribe_secs")))
    ).otherwise("")
    noted = F.coalesce(c("note_path"), F.lit("")) != ""
    s = c("status")
    state = lambda label, tone, action=None: F.struct(
        (label if isinstance(label, Column) else F.lit(label)).alias("label"),
        F.lit(tone).alias("tone"),
        F.lit(action).cast("string").alias("action"),
    )
    out = (
        F.when(s == "recording", state("Recording…", "progress"))
        .when(
            (s == "pending_transcription") & waits,
            state(F.concat(F.lit("Will retry"), tries, F.lit(": "), c("error")), "progress"),
        )
        .when(s == "pending_transcription", state("Queued", "progress"))
        .when(s == "transcribing", state("Transcribing…", "progress"))
        .when(
            (s == "pending_note") & waits,
            state(F.concat(F.lit("Will retry filing"), tries, F.lit(": "), c("error")), "progress"),
        )
        .when(s == "pending_note", state("Filing note…", "progress"))
        .when(
            (s == "done") & noted & c("note_exists"),
            state(F.concat(F.lit("Transcribed "), what, took), "ok", "open-note"),
        )
        .when((s == "done") & noted, state("Filed in brain", "info"))
        .when(s == "done", state("Done", "ok"))
        .when(
            (s == "failed") & c("recovery_exists"),
            state(
                F.concat(F.lit("Could not transcribe "), what, F.lit(": "), F.coalesce(c("error"), F.lit("unknown error"))),
                "error",
                "retry",
            ),
        )
        .when(s == "failed", state("Failed (recovery expired)", "error"))
        .otherwise(state(s, "info"))
    )
    return df.withColumn("_s", out).select(*df.columns, "_s.*")


def live_resolution(kind: Column, dropped: Column) -> Column:
    """Canonical only when filed with nothing dropped; else the batch path."""
    return (
        F.when((kind == "filed") & (dropped == 0), "filed")
        .when(kind.isin("filed", "fallback"), "batch_rewrite")
        .otherwise("batch")
    )


def live_reason(enabled: Column, backend: Column, compiled: Column) -> Column:
    """Why a call is not transcribed live; NULL when eligible."""
    return (
        F.when(~enabled, "live_filing is off")
        .when(backend != "local", "transcribe backend is not local")
        .when(~compiled, "local backend not compiled into this build")
    )
