"""Queries over recordings, jobs, artifacts and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.adapters import duck as d
from parley.adapters.tables import Tables, now
from parley.catalog.registry import query
from parley.functions import clock, maths, text
from parley.operators import recordings as ops
from parley.sinks import notes

NOW = d.NOW_SQL
TERMINAL = "status IN ('done', 'failed')"
REC = d.RECORDINGS
_APP = f"CASE WHEN bundle_id IS NULL THEN 'Webinar' ELSE {d.app_name('bundle_id')} END"


def ms(col: str) -> str:
    return f"(epoch_us({col}) // 1000)"


def _with_app(df):
    return df.withColumn(
        "owning_app", F.when(F.col("bundle_id").isNull(), text.WEBINAR).otherwise(text.app_name(F.col("bundle_id")))
    )


def _ms(df, *cols):
    for c in cols:
        df = df.withColumn(c, clock.millis(F.col(c)))
    return df


@query(
    "resumable_recordings",
    f"WITH {REC} SELECT id, status, {ms('started_at')} AS started_at FROM recordings WHERE NOT {TERMINAL}",
)
def resumable_recordings(spark, sf):
    return _ms(ops.resumable(Tables(spark, sf).recordings).select("id", "status", "started_at"), "started_at")


@query(
    "expired_recordings",
    f"WITH {REC} SELECT id, status FROM recordings WHERE {TERMINAL} AND updated_at < TIMESTAMP '1999-06-01'",
)
def expired_recordings(spark, sf):
    cut = F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")
    return ops.expired(Tables(spark, sf).recordings, cut).select("id", "status")


@query(
    "newest_recordings",
    f"WITH {REC} SELECT id, {ms('started_at')} AS started_at FROM recordings ORDER BY started_at DESC, id",
)
def newest_recordings(spark, sf):
    r = Tables(spark, sf).recordings.orderBy(F.col("started_at").desc(), "id")
    return _ms(r.select("id", "started_at"), "started_at")


@query(
    "app_predicates",
    f"""WITH {REC} SELECT bundle_id, ({d.known("bundle_id")}) IS NOT NULL AS known, starts_with(bundle_id, 'com.apple.') AS helper,
    (({d.known("bundle_id")}) IS NOT NULL OR NOT starts_with(bundle_id, 'com.apple.')) AS call_owner, count(*) AS n
    FROM recordings WHERE bundle_id IS NOT NULL GROUP BY ALL""",
)
def app_predicates(spark, sf):
    b = F.col("bundle_id")
    r = Tables(spark, sf).recordings.filter(b.isNotNull())
    return r.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n")).select(
        "bundle_id",
        text.known_app(b).isNotNull().alias("known"),
        text.is_system_helper(b).alias("helper"),
        text.is_call_owner(b).alias("call_owner"),
        "n",
    )


@query(
    "app_names",
    f"""WITH {REC} SELECT bundle_id, coalesce({d.known("bundle_id")}, {d.humanize("bundle_id")}, 'Unknown app') AS app,
    {d.humanize("bundle_id")} AS humanized, count(*) AS n FROM recordings GROUP BY ALL""",
)
def app_names(spark, sf):
    b = F.col("bundle_id")
    r = Tables(spark, sf).recordings.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"))
    return r.select("bundle_id", text.app_name(b).alias("app"), text.humanize(b).alias("humanized"), "n")


_MODE = f"CASE WHEN bundle_id IS NULL AND {_APP} = 'Webinar' THEN 'webinar' ELSE 'call' END"


@query(
    "recording_titles",
    f"""WITH {REC} SELECT id, {_MODE} AS mode,
    {_APP} || CASE WHEN bundle_id IS NOT NULL THEN ' call' ELSE '' END || ' — ' || strftime(started_at, '%Y-%m-%d %H:%M') AS title,
    {_APP} || ' · ' || strftime(started_at, '%Y-%m-%d %H:%M') AS source FROM recordings""",
)
def recording_titles(spark, sf):
    a, b, s = F.col("owning_app"), F.col("bundle_id"), F.col("started_at")
    return _with_app(Tables(spark, sf).recordings).select(
        "id", ops.mode(b, a).alias("mode"), ops.note_title(a, b, s).alias("title"), ops.source_label(a, s).alias("source")
    )


@query(
    "yaml_safe_labels",
    r"""WITH n AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '#' || role || ': ' || text WHEN 1 THEN '"' || text || '" # ' || role
      WHEN 2 THEN role || ':' || chr(10) || text || ':' ELSE '###' END AS name FROM conversations),
    c AS (SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(name, '\s+'), lambda w: w <> ''), ' ') AS t FROM n),
    p AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, ': ', '- ', 'g'), ':$', '-'), '["''`]', '', 'g') AS t FROM c),
    h AS (SELECT conv_id, turn, regexp_replace(t, ' #+', ' ', 'g') AS t FROM p),
    s AS (SELECT conv_id, turn, trim(regexp_replace(trim(t), '^[#&*!|>%@,\-?:\[\]{}]+', '')) AS t FROM h)
    SELECT conv_id, turn, CASE WHEN t = '' THEN 'Unknown app' ELSE t END AS label FROM s""",
)
def yaml_safe_labels(spark, sf):
    c = Tables(spark, sf).raw("conversations")
    t = F.col("turn") % 4
    name = (
        F.when(t == 0, F.concat(F.lit("#"), "role", F.lit(": "), "text"))
        .when(t == 1, F.concat(F.lit('"'), "text", F.lit('" # '), "role"))
        .when(t == 2, F.concat("role", F.lit(":\n"), "text", F.lit(":")))
        .otherwise("###")
    )
    return c.select("conv_id", "turn", text.yaml_safe(name).alias("label"))


@query(
    "recording_stems",
    f"""WITH {REC}, a AS (SELECT *, {_APP} AS app FROM recordings)
    SELECT id, strftime(started_at, '%Y%m%d-%H%M%S') || '-' || regexp_replace(regexp_replace(lower(app), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g') AS stem,
           'r' || k AS recording_id FROM a""",
)
def recording_stems(spark, sf):
    r = _with_app(Tables(spark, sf).recordings)
    return r.select(
        "id",
        ops.stem(F.col("owning_app"), F.col("started_at")).alias("stem"),
        ops.recording_id(F.col("audio_path"), F.col("started_at")).alias("recording_id"),
    )


@query(
    "known_app_prefix_join",
    f"""WITH {d.HOLDERS} SELECT coalesce({d.known("bundle_id")}, 'none') AS app, count(*) AS holders FROM holders GROUP BY 1""",
)
def known_app_prefix_join(spark, sf):
    h = Tables(spark, sf).holders
    return h.groupBy(F.coalesce(text.known_app(F.col("bundle_id")), F.lit("none")).alias("app")).agg(
        F.count(F.lit(1)).alias("holders")
    )


_RETRIES = """
retries AS (SELECT rid AS id, min_by(attempts, jobs.id) AS retry_attempts FROM jobs
            WHERE kind = 'retry_transcription' AND state IN ('pending', 'running') GROUP BY rid)"""


@query(
    "recording_retries",
    f"""WITH {REC},{d.JOBS},{_RETRIES} SELECT r.id, status, retry_attempts, retry_attempts IS NOT NULL AS retry_pending
    FROM recordings r LEFT JOIN retries USING (id)""",
)
def recording_retries(spark, sf):
    t = Tables(spark, sf)
    return ops.with_retry(t.recordings, t.jobs).select("id", "status", "retry_attempts", "retry_pending")


_FACTS = f"""
facts AS (
  SELECT r.*, a.length AS audio_bytes, a.length IS NOT NULL AS audio_exists, n.path IS NOT NULL AS note_exists,
         c.id IS NOT NULL AS checkpoint_valid, a.length IS NOT NULL OR c.id IS NOT NULL AS recovery_exists
  FROM recordings r LEFT JOIN files a ON a.path = r.audio_path LEFT JOIN files n ON n.path = r.note_path
  LEFT JOIN (SELECT id FROM checkpoints WHERE version = 1) c ON c.id = r.id)"""
_BASE = f"{REC},{d.CHECKPOINTS},{d.FILES},{_FACTS}"


def _facts(t: Tables):
    return ops.with_artifacts(t.recordings, t.files, t.checkpoints)


@query(
    "artifact_facts",
    f"WITH {_BASE} SELECT id, audio_bytes, audio_exists, note_exists, checkpoint_valid, recovery_exists FROM facts",
)
def artifact_facts(spark, sf):
    return _facts(Tables(spark, sf)).select(
        "id", "audio_bytes", "audio_exists", "note_exists", "checkpoint_valid", "recovery_exists"
    )


@query(
    "checkpoint_recovery",
    f"WITH {_BASE} SELECT id, status FROM facts WHERE checkpoint_valid AND NOT {TERMINAL}",
)
def checkpoint_recovery(spark, sf):
    t = Tables(spark, sf)
    return ops.recoverable(t.recordings, t.checkpoints).select("id", "status")


@query(
    "note_ownership",
    f"""WITH {REC},{d.CHECKPOINTS},{d.JOBS},
    pl AS (SELECT rid AS id, min_by({{'n': pl_note, 'c': pl_canon}}, jobs.id) AS p FROM jobs
           WHERE kind = 'retry_transcription' AND state IN ('pending', 'running') GROUP BY rid),
    j AS (SELECT r.id, r.note_path AS row_note, c.note_path AS cp, coalesce(c.note_canonical, FALSE) AS cc, p.n AS pn, p.n IS NOT NULL AND coalesce(p.c, FALSE) AS pc
          FROM recordings r LEFT JOIN (SELECT * FROM checkpoints WHERE version = 1) c ON c.id = r.id LEFT JOIN pl ON pl.id = r.id)
    SELECT id, CASE WHEN cp IS NOT NULL AND cc THEN cp WHEN pn IS NOT NULL AND pc THEN pn WHEN cp IS NOT NULL THEN cp WHEN pn IS NOT NULL THEN pn ELSE row_note END AS note,
           CASE WHEN cp IS NOT NULL AND cc THEN 'checkpoint' WHEN pn IS NOT NULL AND pc THEN 'payload' WHEN cp IS NOT NULL THEN 'checkpoint' WHEN pn IS NOT NULL THEN 'payload' ELSE 'row' END AS origin,
           (cp IS NOT NULL AND cc) OR (pn IS NOT NULL AND pc) AS canonical
    FROM j WHERE cp IS NOT NULL OR pn IS NOT NULL OR row_note IS NOT NULL""",
)
def note_ownership(spark, sf):
    t = Tables(spark, sf)
    return ops.owned_notes(t.recordings, t.checkpoints, t.jobs)


@query(
    "artifact_integrity",
    """SELECT '/doc/' || doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN 'damaged' ELSE 'missing' END AS problem FROM documents WHERE doc_id % 10 IN (3, 7)""",
)
def artifact_integrity(spark, sf):
    """Every tenth document was changed after hashing, another tenth is gone."""
    doc = Tables(spark, sf).raw("documents").select(F.concat(F.lit("/doc/"), "doc_id").alias("path"), "doc_id", "text")
    manifest = doc.select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    now_ = doc.filter("doc_id % 10 <> 7").select(
        "path", F.encode(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "UTF-8").alias("content")
    )
    return ops.integrity(manifest, now_).select(
        "path", F.when(F.col("actual").isNull(), "missing").otherwise("damaged").alias("problem")
    )


@query(
    "audio_resolution",
    f"""WITH {_BASE},
    asked AS (SELECT 'r' || k || CASE WHEN k % 4 = 1 THEN '-clean.wav' ELSE '.wav' END AS name, 'r' || k AS stem, k,
                     CASE WHEN k % 2 = 0 THEN 'r' || k END AS row_id FROM recordings),
    tries AS (
      SELECT name, stem, row_id IS NOT NULL AS tracked, 0 AS ord, CASE WHEN row_id IS NOT NULL THEN '/rec/' || stem || '.wav' ELSE '/rec/' || name END AS path,
             CASE WHEN row_id IS NOT NULL THEN FALSE ELSE ends_with(name, '-clean.wav') END AS clean FROM asked
      UNION ALL SELECT name, stem, row_id IS NOT NULL, 1, CASE WHEN row_id IS NOT NULL THEN '/rec/' || stem || '-clean.wav' ELSE '/rec/' || stem || '.wav' END, row_id IS NOT NULL FROM asked
      UNION ALL SELECT name, stem, FALSE, 2, '/rec/' || stem || '-clean.wav', TRUE FROM asked WHERE row_id IS NULL),
    hit AS (SELECT t.* FROM tries t JOIN files f ON f.path = t.path QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1)
    SELECT a.name, a.stem, a.row_id IS NOT NULL AS tracked, hit.path, hit.clean AS skip_cleaning,
           CASE WHEN hit.path IS NULL THEN CASE WHEN a.row_id IS NOT NULL THEN 'audio is gone' ELSE 'no recording found' END END AS error
    FROM asked a LEFT JOIN hit USING (name)""",
)
def audio_resolution(spark, sf):
    """Every recording asked for by name; only even ones are tracked."""
    t = Tables(spark, sf)
    r, k = t.recordings, F.col("k")
    asked = r.select(F.concat("id", F.when(k % 4 == 1, "-clean.wav").otherwise(".wav")).alias("name"))
    return ops.resolve_audio(asked, r.filter(k % 2 == 0), t.files, "/rec")


@query(
    "artifact_catalog_status",
    f"""WITH {REC}, lst AS (SELECT '/models/m' || (k % 97) || '/part' || k AS path, k % 1000 AS length FROM recordings),
    cat AS (SELECT DISTINCT 'm' || (k % 131) AS id, '/models/m' || (k % 131) AS dir FROM recordings),
    sz AS (SELECT '/models/m' || (k % 97) AS dir, sum(k % 1000) AS bytes, min(k) AS k0 FROM recordings GROUP BY 1)
    SELECT cat.id, k0 IS NOT NULL AS present, coalesce(bytes, 0)::BIGINT AS on_disk_bytes FROM cat LEFT JOIN sz USING (dir)""",
)
def artifact_catalog_status(spark, sf):
    """131 artifacts, 97 installed as many part files; the first part marks presence."""
    r, k = Tables(spark, sf).recordings, F.col("k")
    folder = lambda n: F.concat(F.lit("/models/m"), (k % n).cast("string"))
    files = r.select(F.concat(folder(97), F.lit("/part"), k.cast("string")).alias("path"), (k % 1000).alias("length"))
    cat = (
        r.select((k % 131).alias("m")).distinct().select(
            F.concat(F.lit("m"), "m").alias("id"),
            F.concat(F.lit("/models/m"), "m", F.lit("/part"), "m").alias("present_path"),
            F.concat(F.lit("/models/m"), "m").alias("install_path"),
        )
    )
    return ops.catalog_status(cat, files)


@query(
    "bytes_under_folder",
    f"""WITH {_BASE} SELECT p AS prefix, coalesce((SELECT sum(length) FROM files WHERE starts_with(path, p || '/')), 0)::BIGINT AS bytes
    FROM (VALUES ('/rec'), ('/notes'), ('/none')) v(p)""",
)
def bytes_under_folder(spark, sf):
    t = Tables(spark, sf)
    return ops.bytes_under(spark.createDataFrame([("/rec",), ("/notes",), ("/none",)], "prefix string"), t.files)


@query(
    "recording_history",
    f"""WITH {d.SIGNAL}, e AS (SELECT key AS id, ord AS pushed, ts FROM signal)
    SELECT id, max(pushed) AS pushed, max_by(ts, pushed) AS ts FROM e GROUP BY id ORDER BY 2 DESC LIMIT 5""",
)
def recording_history(spark, sf):
    s = Tables(spark, sf).signal.select(F.col("key").alias("id"), F.col("ord").alias("pushed"), "ts")
    return ops.history(s)


_DUR = """CASE WHEN {s} IS NULL OR {s} < 0 THEN '' WHEN {s} < 60 THEN CAST(floor({s} + 0.5) AS BIGINT) || ' s'
  WHEN floor({s} / 60 + 0.5) < 60 THEN CAST(floor({s} / 60 + 0.5) AS BIGINT) || ' min'
  WHEN CAST(floor({s} / 60 + 0.5) AS BIGINT) % 60 > 0 THEN (CAST(floor({s} / 60 + 0.5) AS BIGINT) // 60) || ' h ' || lpad(CAST(CAST(floor({s} / 60 + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' min'
  ELSE (CAST(floor({s} / 60 + 0.5) AS BIGINT) // 60) || ' h' END"""


def dur(col: str) -> str:
    return _DUR.format(s=f"({col})::DOUBLE")


_SECS = f"({ms('ended_at')} - {ms('started_at')}) // 1000"


@query("duration_texts", f"WITH {REC} SELECT id, {dur(_SECS)} AS duration FROM recordings")
def duration_texts(spark, sf):
    secs = clock.seconds_between(F.col("started_at"), F.col("ended_at"))
    return Tables(spark, sf).recordings.select("id", clock.duration_text(secs).alias("duration"))


@query(
    "queue_row_states",
    f"""WITH {_BASE},{d.JOBS},{_RETRIES},
    x AS (SELECT f.*, retry_attempts, retry_attempts IS NOT NULL AS waits,
                 CASE WHEN {dur(_SECS)} <> '' THEN {dur(_SECS)} || ' ' ELSE '' END || {_MODE} AS what,
                 CASE WHEN coalesce(retry_attempts, 0) > 0 THEN ' (attempt ' || retry_attempts || '/5)' ELSE '' END AS tries
          FROM facts f LEFT JOIN retries USING (id))
    SELECT id, CASE status WHEN 'recording' THEN 'Recording…' WHEN 'transcribing' THEN 'Transcribing…'
        WHEN 'pending_transcription' THEN CASE WHEN waits AND error IS NOT NULL THEN 'Will retry' || tries || ': ' || error ELSE 'Queued' END
        WHEN 'pending_note' THEN CASE WHEN waits AND error IS NOT NULL THEN 'Will retry filing' || tries || ': ' || error ELSE 'Filing note…' END
        WHEN 'done' THEN CASE WHEN note_path IS NOT NULL AND note_exists THEN 'Transcribed ' || what || CASE WHEN transcribe_secs IS NOT NULL THEN ' in ' || {dur("transcribe_secs")} ELSE '' END
                              WHEN note_path IS NOT NULL THEN 'Filed in brain' ELSE 'Done' END
        ELSE CASE WHEN recovery_exists THEN 'Could not transcribe ' || what || ': ' || coalesce(error, 'unknown error') ELSE 'Failed (recovery expired)' END END AS label,
      CASE WHEN status = 'done' THEN CASE WHEN note_path IS NOT NULL AND NOT note_exists THEN 'info' ELSE 'ok' END WHEN status = 'failed' THEN 'error' ELSE 'progress' END AS tone,
      CASE WHEN status = 'done' AND note_path IS NOT NULL AND note_exists THEN 'open-note' WHEN status = 'failed' AND recovery_exists THEN 'retry' END AS action
    FROM x""",
)
def queue_row_states(spark, sf):
    t = Tables(spark, sf)
    r = _with_app(ops.with_retry(_facts(t), t.jobs))
    r = r.withColumn("mode", ops.mode(F.col("bundle_id"), F.col("owning_app"))).withColumn(
        "duration_secs", clock.seconds_between(F.col("started_at"), F.col("ended_at"))
    )
    return ops.row_state(r).select("id", "label", "tone", "action")


@query(
    "relative_ages",
    f"""WITH {REC}, a AS (SELECT id, status, ended_at, started_at,
      greatest((epoch_us(TIMESTAMP '2000-03-04 10:00:00') - epoch_us(coalesce(ended_at, started_at))) // 1000000, 0) AS s,
      date_diff('day', coalesce(ended_at, started_at)::DATE, DATE '2000-03-04') AS dd FROM recordings)
    SELECT id, CASE WHEN status = 'recording' THEN 'recording now' WHEN s < 60 THEN 'just concluded' WHEN s < 3600 THEN (s // 60) || ' min ago'
      WHEN dd = 0 THEN (s // 3600) || ' hours ago' WHEN dd = 1 THEN 'yesterday' ELSE dd || ' days ago' END AS age FROM a""",
)
def relative_ages(spark, sf):
    at = F.lit("2000-03-04 10:00:00").cast("timestamp_ntz")
    r = Tables(spark, sf).recordings
    return r.select("id", clock.relative_age(F.col("status"), F.col("started_at"), F.col("ended_at"), at).alias("age"))


@query(
    "elapsed_clocks",
    f"""WITH {REC}, a AS (SELECT id, greatest(({ms('CASE WHEN status = ' + "'recording'" + ' THEN ' + NOW + ' ELSE ended_at END')} - {ms('started_at')}) // 1000, 0) AS s,
      status <> 'recording' AND ended_at IS NULL AS unknown FROM recordings)
    SELECT id, CASE WHEN unknown THEN '—' ELSE CASE WHEN s // 3600 < 100 THEN lpad((s // 3600)::VARCHAR, 2, '0') ELSE (s // 3600)::VARCHAR END || ':' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS elapsed FROM a""",
)
def elapsed_clocks(spark, sf):
    end = F.when(F.col("status") == "recording", now()).otherwise(F.col("ended_at"))
    secs = clock.seconds_between(F.col("started_at"), end)
    return Tables(spark, sf).recordings.select("id", clock.elapsed(secs).alias("elapsed"))


_BACKOFF = "least(3600, 30 * power(2, attempts - 1))::BIGINT"


@query(
    "backoff_schedule",
    f"WITH {d.JOBS} SELECT attempts, {_BACKOFF} AS delay_secs, count(*) AS jobs FROM jobs GROUP BY ALL",
)
def backoff_schedule(spark, sf):
    j = Tables(spark, sf).jobs.groupBy("attempts").agg(F.count(F.lit(1)).alias("jobs"))
    return j.select("attempts", maths.backoff(F.col("attempts"), 30, 3600).alias("delay_secs"), "jobs")


@query(
    "job_failure_outcomes",
    f"""WITH {d.JOBS}, x AS (SELECT *, CASE WHEN period_secs IS NOT NULL THEN period_secs WHEN attempts < max_attempts THEN {_BACKOFF} END AS wait FROM jobs WHERE state = 'running')
    SELECT id, CASE WHEN wait IS NOT NULL THEN 'pending' ELSE 'failed' END AS state, CASE WHEN period_secs IS NOT NULL THEN 0 ELSE attempts END AS attempts,
           CASE WHEN wait IS NOT NULL THEN {ms(NOW)} + wait * 1000 ELSE {ms('next_run_at')} END AS next_run_at, 'boom' AS last_error FROM x""",
)
def job_failure_outcomes(spark, sf):
    out = ops.failure_outcomes(Tables(spark, sf).jobs, F.lit("boom"), now())
    return _ms(out.select("id", "state", "attempts", "next_run_at", "last_error"), "next_run_at")


@query(
    "job_crash_recovery",
    f"""WITH {d.JOBS} SELECT id, CASE WHEN state = 'running' THEN 'pending' ELSE state END AS state, attempts,
    CASE WHEN state = 'running' THEN {ms(NOW)} ELSE {ms('next_run_at')} END AS next_run_at FROM jobs""",
)
def job_crash_recovery(spark, sf):
    return _ms(
        ops.recover_running(Tables(spark, sf).jobs, now()).select("id", "state", "attempts", "next_run_at"), "next_run_at"
    )


_AT = "TIMESTAMP '1998-01-01'"


def _at():
    return F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")


@query(
    "due_jobs",
    f"WITH {d.JOBS} SELECT id, kind, {ms('next_run_at')} AS next_run_at FROM jobs WHERE state = 'pending' AND next_run_at <= {_AT}",
)
def due_jobs(spark, sf):
    return _ms(ops.due(Tables(spark, sf).jobs, _at()).select("id", "kind", "next_run_at"), "next_run_at")


@query(
    "earliest_due_job",
    f"""WITH {d.JOBS} SELECT id, kind, {ms('next_run_at')} AS next_run_at FROM jobs WHERE state = 'pending' AND next_run_at <= {_AT}
    ORDER BY jobs.next_run_at, id LIMIT 1""",
)
def earliest_due_job(spark, sf):
    return _ms(ops.earliest_due(Tables(spark, sf).jobs, _at()).select("id", "kind", "next_run_at"), "next_run_at")


@query(
    "next_due_time",
    f"WITH {d.JOBS} SELECT {ms('min(next_run_at)')} AS next_due_at FROM jobs WHERE state = 'pending'",
)
def next_due_time(spark, sf):
    return _ms(ops.next_due(Tables(spark, sf).jobs), "next_due_at")


@query(
    "retry_actions",
    f"""WITH {_BASE}, x AS (SELECT id, status, checkpoint_valid AS cp, k % 16 < 3 AND k % 8 < 3 AS canon, audio_exists AS au FROM facts)
    SELECT id, CASE WHEN {TERMINAL} THEN 'stale' WHEN cp THEN 'file_checkpoint' WHEN canon THEN 'complete_canonical_note' WHEN status = 'recording' THEN 'stale'
      WHEN NOT au THEN 'missing_audio' WHEN status = 'pending_note' THEN 'transcribe_legacy_pending_note' ELSE 'transcribe' END AS action FROM x""",
)
def retry_actions(spark, sf):
    f = _facts(Tables(spark, sf))
    canon = (F.col("k") % 16 < 3) & (F.col("k") % 8 < 3)
    act = ops.retry_action(F.col("status"), F.col("checkpoint_valid"), canon, F.col("audio_exists"))
    return f.select("id", act.alias("action"))


@query(
    "stranded_recordings",
    f"""WITH {_BASE} SELECT id, CASE WHEN audio_exists THEN 'retry' ELSE 'fail' END AS action,
    CASE WHEN audio_exists THEN 'pending_transcription' ELSE 'failed' END AS new_status,
    CASE WHEN NOT audio_exists THEN '{ops.STRANDED}' END AS error FROM facts WHERE status = 'recording'""",
)
def stranded_recordings(spark, sf):
    return ops.stranded(_facts(Tables(spark, sf)))


_PLAN = f"""{REC},{d.JOBS},
old AS (SELECT * FROM recordings WHERE updated_at < {_AT} - INTERVAL 30 DAY),
ready AS (SELECT * FROM old WHERE {TERMINAL} AND k % 13 <> 5),
plan AS (
  SELECT id, 'delete_artifact' AS action, unnest(['/rec/' || id || '.wav', '/rec/' || id || '-clean.wav', audio_path || '.checkpoint.json', audio_path || '.staging.json', audio_path || '.checkpoint.json.tmp*']) AS path FROM ready
  UNION ALL SELECT id, 'delete_row', NULL FROM ready WHERE updated_at < {_AT} - INTERVAL 90 DAY
  UNION ALL SELECT id, 'delete_stale_temps', audio_path || '.checkpoint.json.tmp*' FROM old WHERE NOT {TERMINAL}
  UNION ALL SELECT id::VARCHAR, 'delete_job', NULL FROM jobs WHERE state = 'failed' AND updated_at < {_AT} - INTERVAL 30 DAY)"""


def _plan(t: Tables):
    staging = t.recordings.filter(F.col("k") % 13 == 5).select("id")
    return ops.retention_plan(t.recordings, t.jobs, staging, _at(), 30)


@query("retention_plan", f"WITH {_PLAN} SELECT id, action, path FROM plan")
def retention_plan(spark, sf):
    return _plan(Tables(spark, sf))


@query(
    "sweep_summary",
    f"""WITH {_PLAN} SELECT count(*) FILTER (action = 'delete_artifact') AS files, count(*) FILTER (action = 'delete_row') AS rows,
    count(*) FILTER (action = 'delete_job') AS jobs FROM plan""",
)
def sweep_summary(spark, sf):
    return ops.sweep_summary(_plan(Tables(spark, sf)))


@query(
    "artifact_paths",
    f"""WITH {REC} SELECT id, unnest(['/rec/' || id || '.wav', '/rec/' || id || '-clean.wav', audio_path || '.checkpoint.json', audio_path || '.staging.json']) AS path FROM recordings""",
)
def artifact_paths(spark, sf):
    return ops.artifact_paths(Tables(spark, sf).recordings)


@query(
    "live_resolutions",
    """WITH x AS (SELECT user_id, event_type, count(*) FILTER (event_id % 50 = 0) AS dropped FROM events GROUP BY ALL)
    SELECT user_id, event_type, CASE WHEN event_type = 'click' AND dropped = 0 THEN 'filed' WHEN event_type IN ('click', 'view') THEN 'batch_rewrite' ELSE 'batch' END AS resolution FROM x""",
)
def live_resolutions(spark, sf):
    e = Tables(spark, sf).raw("events")
    g = e.groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 50 == 0).alias("dropped"))
    kind = F.when(F.col("event_type") == "click", "filed").when(F.col("event_type") == "view", "fallback").otherwise("no_note")
    return g.select("user_id", "event_type", ops.live_resolution(kind, F.col("dropped")).alias("resolution"))


@query(
    "live_eligibility",
    f"""WITH {REC} SELECT CASE WHEN k % 5 = 0 THEN 'live_filing is off' WHEN k % 3 = 0 THEN 'transcribe backend is not local'
    WHEN k % 7 = 0 THEN 'local backend not compiled into this build' END AS reason, count(*) AS n FROM recordings GROUP BY ALL""",
)
def live_eligibility(spark, sf):
    k = F.col("k")
    why = ops.live_reason(k % 5 != 0, F.when(k % 3 == 0, "cloud").otherwise("local"), k % 7 != 0)
    return Tables(spark, sf).recordings.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "manual_retry_reset",
    f"""WITH {_BASE} SELECT id, CASE WHEN k % 6 = 1 THEN 'done' WHEN checkpoint_valid THEN 'pending_note' ELSE 'pending_transcription' END AS target,
    CASE WHEN k % 6 = 1 THEN 'cannot reset to done' WHEN status = 'failed' THEN 'accepted' ELSE 'recording is not failed' END AS outcome
    FROM facts WHERE k % 4 = 0 OR k % 6 = 1""",
)
def manual_retry_reset(spark, sf):
    f = _facts(Tables(spark, sf))
    k = F.col("k")
    target = F.when(k % 6 == 1, "done").otherwise(ops.retry_target(F.lit("failed"), F.col("checkpoint_valid")))
    asked = f.filter((k % 4 == 0) | (k % 6 == 1)).select("id", target.alias("target"))
    accepted, rejected = ops.reset_for_retry(asked, f)
    return accepted.select("id", F.col("status").alias("target"), F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("id", "target", F.col("reason").alias("outcome"))
    )


@query(
    "metadata_from_names",
    rf"""WITH {REC}, f AS (SELECT CASE WHEN k % 3 = 0 THEN '/x/' || strftime(started_at, '%Y%m%d-%H%M%S') || '-microsoft-teams-clean.wav'
        WHEN k % 3 = 1 THEN '/x/team-standup-' || k || '.wav' ELSE '/x/' || strftime(started_at, '%Y%m%d-%H%M%S') || '-.wav' END AS path, started_at, k FROM recordings)
    SELECT path, CASE WHEN k % 3 = 1 THEN {ms(NOW)} ELSE {ms('started_at')} END AS started_at,
           CASE k % 3 WHEN 0 THEN 'Microsoft Teams' WHEN 1 THEN 'Team Standup ' || k ELSE 'Unknown app' END AS app FROM f""",
)
def metadata_from_names(spark, sf):
    k = F.col("k")
    at = F.date_format("started_at", "yyyyMMdd-HHmmss")
    name = (
        F.when(k % 3 == 0, F.concat(F.lit("/x/"), at, F.lit("-microsoft-teams-clean.wav")))
        .when(k % 3 == 1, F.concat(F.lit("/x/team-standup-"), k.cast("string"), F.lit(".wav")))
        .otherwise(F.concat(F.lit("/x/"), at, F.lit("-.wav")))
    )
    files = Tables(spark, sf).recordings.select(name.alias("path"))
    return _ms(ops.meta_from_name(files, "path", now()).select("path", "started_at", "app"), "started_at")


@query(
    "reflected_backoff",
    f"""WITH {_BASE},{d.JOBS},
    fl AS (SELECT rid AS id, max_by(last_error, jobs.id) AS error FROM jobs WHERE last_error IS NOT NULL GROUP BY rid)
    SELECT f.id, CASE WHEN status = 'pending_note' OR checkpoint_valid THEN 'pending_note' ELSE 'pending_transcription' END AS status, fl.error
    FROM facts f JOIN fl USING (id) WHERE NOT {TERMINAL}""",
)
def reflected_backoff(spark, sf):
    t = Tables(spark, sf)
    return ops.reflect_backoff(_facts(t), t.jobs.filter("last_error IS NOT NULL"))


_LOGGED = """
changes AS (
  SELECT 'r' || l_orderkey AS id, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS version,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'status ' || l_returnflag END AS status,
         CASE WHEN l_quantity < 10 THEN 'error ' || l_suppkey END AS error FROM lineitem)"""


@query(
    "state_from_changes",
    f"""WITH {_LOGGED} SELECT id, max_by(status, version) FILTER (status IS NOT NULL) AS status,
    max_by(error, version) FILTER (error IS NOT NULL) AS error, max(version) AS version FROM changes GROUP BY id""",
)
def state_from_changes(spark, sf):
    ln = Tables(spark, sf).raw("lineitem")
    changes = ln.select(
        F.concat(F.lit("r"), "l_orderkey").alias("id"),
        (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("version"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("status "), "l_returnflag")).alias("status"),
        F.when(F.col("l_quantity") < 10, F.concat(F.lit("error "), "l_suppkey")).alias("error"),
    )
    return ops.apply_changes(changes, ["status", "error"])


@query(
    "enqueue_if_absent",
    f"""WITH {REC} SELECT id, status, k % 3 <> 0 AS was_there FROM recordings
    WHERE k % 3 <> 0 UNION ALL SELECT id, 'pending_transcription', FALSE FROM recordings WHERE k % 3 = 0""",
)
def enqueue_if_absent(spark, sf):
    """A third of the recordings is new; half of those that arrive are known."""
    r = Tables(spark, sf).recordings.select("id", "status", "started_at", "k")
    old = r.filter("k % 3 <> 0").withColumn("was_there", F.lit(True))
    new = r.filter("k % 3 = 0 OR k % 3 = 1").withColumn("status", F.lit("pending_transcription")).withColumn("was_there", F.lit(False))
    return ops.enqueue_missing(old, new.unionByName(new)).select("id", "status", "was_there")


@query(
    "enqueue_unless_active",
    f"""WITH {d.JOBS}, n AS (SELECT kind, payload, min(id) AS ord FROM jobs GROUP BY ALL)
    SELECT kind, payload, ord FROM n WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.kind = n.kind AND j.payload = n.payload AND j.state IN ('pending', 'running'))""",
)
def enqueue_unless_active(spark, sf):
    """All jobs offered again: only those without an active twin are inserted."""
    j = Tables(spark, sf).jobs
    return ops.enqueue_jobs(j, j.select("kind", "payload", F.col("id").alias("ord")))


@query(
    "timestamps_to_utc",
    """SELECT event_id, strftime(to_timestamp(0)::TIMESTAMP + INTERVAL (epoch_us(ts) // 1000) MILLISECONDS, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS started_at,
    CAST(NULL AS VARCHAR) AS bad FROM events""",
)
def timestamps_to_utc(spark, sf):
    """Texts with changing offsets back to one UTC form; junk becomes NULL."""
    from parley.sources.tables import normalize_times

    e = Tables(spark, sf).raw("events")
    hours = (F.col("event_id") % 12).cast("int")
    local = F.date_format(clock.from_millis(clock.millis(F.col("ts")) + hours * 3_600_000), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    txt = e.select("event_id", F.concat(local, F.lit("+"), clock.pad2(hours), F.lit(":00")).alias("started_at"), F.lit("soon").alias("bad"))
    return normalize_times(txt, ["started_at", "bad"])


@query(
    "processing_speed",
    f"""WITH {REC} SELECT status, count(*) AS n, round(avg(CASE WHEN transcribe_secs > 0 THEN coalesce({_SECS}, 0)::DOUBLE / transcribe_secs ELSE 0 END), 6) AS mean_factor FROM recordings GROUP BY status""",
)
def processing_speed(spark, sf):
    secs = F.coalesce(clock.seconds_between(F.col("started_at"), F.col("ended_at")), F.lit(0)).cast("double")
    x = maths.real_time_factor(secs, F.col("transcribe_secs"))
    return Tables(spark, sf).recordings.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean_factor")
    )


_DOC = "'---' || chr(10) || 'title: n' || doc_id || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'made: {{}}' || chr(10) || '  old: 1' || chr(10) ELSE '' END || 'tags: [x]' || chr(10) || '---' || chr(10) || '# head' || chr(10)"


def _note(d_):
    k = F.col("doc_id")
    head = F.concat(
        F.lit("---\ntitle: n"), k.cast("string"), F.lit("\n"),
        F.when(k % 3 == 0, "made: {}\n  old: 1\n").otherwise(""), F.lit("tags: [x]\n---\n# head\n"),
    )
    return d_.select("doc_id", F.concat(head, F.when(k % 2 == 0, notes.STATE_OPEN).otherwise(notes.STATE_DONE), F.lit("\n"), "text").alias("body"))


_HEAD = _DOC.replace("{{}}", "{}")
_STATE = "CASE WHEN doc_id % 2 = 0 THEN 'State: transcribing' ELSE 'State: transcribed ' END"


@query(
    "note_state_flip",
    f"SELECT doc_id, {_HEAD} || 'State: transcribed ' || chr(10) || text AS body FROM documents",
)
def note_state_flip(spark, sf):
    n = _note(Tables(spark, sf).raw("documents"))
    # Flipping twice is the same as once.
    return n.select("doc_id", notes.flip_state(notes.flip_state(F.col("body"))).alias("body"))


@query(
    "note_rewrite",
    """SELECT doc_id, '---' || chr(10) || 'title: n' || doc_id || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'made: {"v":1}' || chr(10) ELSE '' END || 'tags: [x]' || chr(10)
    || CASE WHEN doc_id % 3 <> 0 THEN 'made: {"v":1}' || chr(10) ELSE '' END || '---' || chr(10) || '# head' || chr(10) || 'State: transcribed ' || chr(10) || 'new' AS body FROM documents""",
)
def note_rewrite(spark, sf):
    n = _note(Tables(spark, sf).raw("documents"))
    new = F.lit(notes.STATE_DONE + "\nnew")
    return n.select("doc_id", notes.rewrite_note(F.col("body"), new, "made", F.lit('made: {"v":1}\n')).alias("body"))


@query(
    "failed_note_annotation",
    f"""SELECT doc_id, {_HEAD} || CASE WHEN doc_id % 4 = 0 THEN 'State: transcribed ' ELSE {_STATE} END || chr(10) || text
    || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '> recorder: transcription incomplete — gone' || chr(10) ELSE '' END AS body FROM documents""",
)
def failed_note_annotation(spark, sf):
    n = _note(Tables(spark, sf).raw("documents"))
    status = F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("done")
    return n.select("doc_id", notes.close_failed_note(F.col("body"), status, F.lit("gone")).alias("body"))


@query(
    "parameter_limits",
    """SELECT event_id, greatest(5, least(300, round(value * 10)::BIGINT)) AS ring_secs,
    CASE WHEN round(value)::BIGINT BETWEEN 1 AND 30 THEN round(value)::BIGINT ELSE 14 END AS retention_days FROM events""",
)
def parameter_limits(spark, sf):
    v = F.col("value")
    return Tables(spark, sf).raw("events").select(
        "event_id",
        maths.clamp(F.round(v * 10).cast("long"), F.lit(5), F.lit(300)).alias("ring_secs"),
        maths.in_range_or(F.round(v).cast("long"), 1, 30, F.lit(14).cast("long")).alias("retention_days"),
    )


@query(
    "scalar_text_functions",
    r"""SELECT doc_id, regexp_replace(source || ' ' || lang || '/v1', '[^0-9a-zA-Z._-]', '-', 'g') AS job,
    array_to_string(list_transform(string_split(source || '-x-' || lang, '-'), lambda w: upper(w[1:1]) || w[2:]), ' ') AS titled FROM documents""",
)
def scalar_text_functions(spark, sf):
    doc = Tables(spark, sf).raw("documents")
    return doc.select(
        "doc_id",
        text.job_name(F.concat("source", F.lit(" "), "lang", F.lit("/v1"))).alias("job"),
        text.humanize_slug(F.concat("source", F.lit("-x-"), "lang")).alias("titled"),
    )


@query(
    "byte_capped_text",
    """WITH c AS (SELECT doc_id, text, string_split(text, '') AS cs FROM documents),
    k AS (SELECT doc_id, text, strlen(text) AS bytes, list_reduce(list_prepend(0::BIGINT, list_transform(cs, lambda c: strlen(c)::BIGINT)), lambda a, b: CASE WHEN a < 0 THEN a WHEN a + b > 333 THEN -1 - a ELSE a + b END) AS cut FROM c)
    SELECT doc_id, bytes AS full_bytes, CASE WHEN bytes <= 333 THEN bytes ELSE (-1 - cut) + 3 END AS capped_bytes FROM k""",
)
def byte_capped_text(spark, sf):
    doc = Tables(spark, sf).raw("documents")
    return doc.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("full_bytes"),
        F.octet_length(text.cap_bytes(F.col("text"), 333)).cast("long").alias("capped_bytes"),
    )


@query(
    "scalar_time_ranges",
    f"""WITH {d.WORDS}, r AS (SELECT recording_id, channel, seq, {d.stamp("start")} AS a, {d.stamp('"end" + seq % 3')} AS b FROM words)
    SELECT recording_id, channel::BIGINT AS channel, seq, CASE WHEN a = b THEN a ELSE a || '–' || b END AS shown FROM r""",
)
def scalar_time_ranges(spark, sf):
    w = Tables(spark, sf).words
    return w.select(
        "recording_id", F.col("channel").cast("long").alias("channel"), "seq",
        clock.clock_range(F.col("start"), F.col("end") + F.col("seq") % 3).alias("shown"),
    )


@query(
    "scalar_sample_math",
    """SELECT vec_id, i::INTEGER AS i, trunc(greatest(-1, least(1, x * 3)) * 32767)::INTEGER AS pcm, round(20 * log10(abs(x) + 1e-9), 6) AS level_db
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings)""",
)
def scalar_sample_math(spark, sf):
    e = Tables(spark, sf).raw("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    x = F.col("x").cast("double")
    return e.select("vec_id", "i", maths.to_int16(x * 3).alias("pcm"), F.round(20 * F.log10(F.abs(x) + 1e-9), 6).alias("level_db"))
