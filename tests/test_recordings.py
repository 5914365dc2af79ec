"""Recording and job tables on hand cases."""

from pyspark.sql import functions as F

from parley.operators import recordings as ops


def ts(s):
    return F.lit(s).cast("timestamp_ntz")


def test_change_log_keeps_on_null(spark):
    rows = [("a", 1, "x", None), ("a", 2, None, "e"), ("a", 3, "y", None), ("b", 1, None, None)]
    df = spark.createDataFrame(rows, "id string, version long, status string, error string")
    got = {r.id: (r.status, r.error, r.version) for r in ops.apply_changes(df, ["status", "error"]).collect()}
    assert got == {"a": ("y", "e", 3), "b": (None, None, 1)}


def test_failure_outcomes(spark):
    schema = "id long, kind string, state string, attempts int, max_attempts int, period_secs long, n string"
    rows = [(1, "k", "running", 1, 5, None, "x"), (2, "k", "running", 5, 5, None, "x"), (3, "k", "running", 9, 5, 60, "x"), (4, "k", "pending", 1, 5, None, "x")]
    jobs = spark.createDataFrame(rows, schema).withColumn("next_run_at", ts("2026-01-01 00:00:00"))
    out = ops.failure_outcomes(jobs, F.lit("boom"), ts("2026-01-02 00:00:00"))
    got = {r.id: (r.state, r.attempts, str(r.next_run_at)) for r in out.collect()}
    assert got == {
        1: ("pending", 1, "2026-01-02 00:00:30"),
        2: ("failed", 5, "2026-01-01 00:00:00"),
        3: ("pending", 0, "2026-01-02 00:01:00"),
    }


def test_retry_matrix(spark):
    rows = [
        ("done", True, True, True, "stale"), ("failed", False, False, True, "stale"),
        ("recording", True, False, False, "file_checkpoint"), ("recording", False, False, True, "stale"),
        ("transcribing", False, True, False, "complete_canonical_note"), ("transcribing", False, False, True, "transcribe"),
        ("pending_note", False, False, True, "transcribe_legacy_pending_note"), ("pending_note", False, False, False, "missing_audio"),
    ]
    df = spark.createDataFrame(rows, "s string, c boolean, n boolean, a boolean, want string")
    got = df.select(ops.retry_action(F.col("s"), F.col("c"), F.col("n"), F.col("a")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_row_states(spark):
    schema = (
        "status string, mode string, duration_secs long, error string, transcribe_secs double, note_path string, "
        "note_exists boolean, recovery_exists boolean, retry_pending boolean, retry_attempts int"
    )
    rows = [
        ("done", "call", 3300, None, 30.0, "/n", True, True, False, None),
        ("done", "webinar", None, None, None, "/n", False, True, False, None),
        ("pending_transcription", "call", 1, "no net", None, None, False, True, True, 2),
        ("pending_transcription", "call", 1, "no net", None, None, False, True, False, None),
        ("failed", "call", 1800, None, None, None, False, True, False, None),
        ("failed", "call", 1800, None, None, None, False, False, False, None),
        ("odd", "call", 1, None, None, None, False, False, False, None),
    ]
    got = [(r.label, r.tone, r.action) for r in ops.row_state(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got == [
        ("Transcribed 55 min call in 30 s", "ok", "open-note"),
        ("Filed in brain", "info", None),
        ("Will retry (attempt 2/5): no net", "progress", None),
        ("Queued", "progress", None),
        ("Could not transcribe 30 min call: unknown error", "error", "retry"),
        ("Failed (recovery expired)", "error", None),
        ("odd", "info", None),
    ]


def test_retention_spares_staging_and_unfinished(spark):
    rows = [("old", "done", "2025-01-01 00:00:00"), ("mid", "failed", "2025-12-01 00:00:00"), ("held", "done", "2025-01-01 00:00:00"),
            ("open", "transcribing", "2025-01-01 00:00:00"), ("new", "done", "2025-12-31 00:00:00")]
    rec = spark.createDataFrame(rows, "id string, status string, u string").select(
        "id", "status", F.concat(F.lit("/r/"), "id", F.lit(".wav")).alias("audio_path"), F.col("u").cast("timestamp_ntz").alias("updated_at")
    )
    jobs = spark.createDataFrame([(1, "failed", "2025-01-01 00:00:00"), (2, "pending", "2025-01-01 00:00:00")], "id long, state string, u string").select(
        "id", "state", F.col("u").cast("timestamp_ntz").alias("updated_at")
    )
    plan = ops.retention_plan(rec, jobs, spark.createDataFrame([("held",)], "id string"), ts("2026-01-01 00:00:00"), 14)
    got = {(r.id, r.action) for r in plan.collect()}
    assert got == {("old", "delete_artifact"), ("old", "delete_row"), ("mid", "delete_artifact"), ("open", "delete_stale_temps"), ("1", "delete_job")}
    # Four artifacts and the temporary files beside them.
    gone = {r.path for r in plan.filter("id = 'old' AND action = 'delete_artifact'").collect()}
    assert gone == {f"/r/old{end}" for end in (".wav", "-clean.wav", ".wav.checkpoint.json", ".wav.staging.json", ".wav.checkpoint.json.tmp*")}


def test_bytes_under_prefix_is_a_folder(spark):
    files = spark.createDataFrame([("/a/b/x", 1), ("/a/bc/y", 2), ("/a/b/c/z", 4)], "path string, length long")
    got = ops.bytes_under(spark.createDataFrame([("/a/b",), ("/a",), ("/q",)], "prefix string"), files)
    assert {r.prefix: r.bytes for r in got.collect()} == {"/a/b": 5, "/a": 7, "/q": 0}


def test_only_new_ids_are_enqueued(spark):
    old = spark.createDataFrame([("a", "done", 1)], "id string, status string, started_at int")
    new = spark.createDataFrame([("a", "new", 2), ("b", "new", 5), ("b", "new", 4)], "id string, status string, started_at int")
    got = sorted((r.id, r.status, r.started_at) for r in ops.enqueue_missing(old, new).collect())
    assert got == [("a", "done", 1), ("b", "new", 4)]


def test_paths_keep_all_tasks_of_the_session_and_come_once(spark):
    rec = spark.createDataFrame([(f"r{k % 30}", f"/rec/r{k % 30}.wav") for k in range(60)], "id string, audio_path string")
    temps = rec.select("id", F.concat("audio_path", F.lit(".checkpoint.json.tmp*")).alias("path"))
    paths = ops.artifact_paths(rec, temps)
    assert paths.rdd.getNumPartitions() == 4
    assert paths.count() == paths.distinct().count() == 30 * 5
