"""Queries over live lines, logs, statistics and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.adapters import duck as d
from parley.adapters.tables import Tables
from parley.catalog.registry import query
from parley.operators import feeds, provenance
from parley.operators import transcripts as tr
from parley.session import scratch
from parley.sources.tables import read_logs


def _lines(t: Tables):
    """Utterances as session lines, numbered by their first word."""
    u = tr.utterances(t.words)
    return feeds.live_lines(
        u.select(
            F.col("recording_id").alias("session_id"),
            "seq",
            tr.display_name(F.col("speaker")).alias("speaker"),
            "start",
            "end",
            "text",
        )
    )


_LINES = f"""{d.WORDS},{d.MINE},
lines AS (
  SELECT recording_id AS session_id, seq, CASE WHEN channel = 0 THEN 'Me' ELSE 'Them 1' END AS speaker, start, "end", text,
         64 + CASE WHEN channel = 0 THEN 2 ELSE 6 END + strlen(text) AS cost FROM utterances),
tail AS (
  SELECT *, row_number() OVER w AS rn, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM lines
  WINDOW w AS (PARTITION BY session_id ORDER BY seq DESC)),
kept AS (SELECT * FROM tail WHERE rn <= 40 AND used <= 4000)"""


@query("live_lines", f'WITH {_LINES} SELECT session_id, seq, speaker, start, "end", text FROM lines')
def live_lines(spark, sf):
    return _lines(Tables(spark, sf))


@query("retained_lines", f"WITH {_LINES} SELECT session_id, seq, speaker, text FROM kept")
def retained_lines(spark, sf):
    return feeds.retained_lines(_lines(Tables(spark, sf)), 40, 4000).select("session_id", "seq", "speaker", "text")


@query(
    "retention_state",
    f"""WITH {_LINES}, k AS (SELECT session_id, count(*) AS n, min(seq) AS f FROM kept GROUP BY 1)
    SELECT l.session_id, coalesce(any_value(k.n), 0) AS retained_lines, count(*) - coalesce(any_value(k.n), 0) AS evicted_lines,
           coalesce(any_value(k.f), max(l.seq) + 1) AS retained_from_seq FROM lines l LEFT JOIN k USING (session_id) GROUP BY l.session_id""",
)
def retention_state(spark, sf):
    return feeds.retention_state(_lines(Tables(spark, sf)), 40, 4000)


_LINE = "timestamp || ' ' || level || ' ' || target || ': ' || message"


@query("log_lines", f"WITH {d.LOGS} SELECT ord, {_LINE} AS line FROM logs")
def log_lines(spark, sf):
    return Tables(spark, sf).logs.select("ord", feeds.log_line().alias("line"))


@query(
    "log_search",
    f"""WITH {d.LOGS} SELECT ord, level, message FROM logs WHERE level IN ('ERROR', 'WARN') AND contains(lower({_LINE}), 'user 1')""",
)
def log_search(spark, sf):
    return feeds.search_logs(Tables(spark, sf).logs, ["ERROR", "WARN"], "User 1").select("ord", "level", "message")


@query(
    "recent_logs",
    f"""WITH {d.LOGS}, s AS (SELECT ord, sum(strlen(timestamp) + strlen(level) + strlen(target) + strlen(message)) OVER (ORDER BY "at" DESC, ord DESC) AS used FROM logs)
    SELECT ord FROM s WHERE used <= 200000""",
)
def recent_logs(spark, sf):
    return feeds.recent_logs(Tables(spark, sf).logs, 3_600_000, 200_000).select("ord")


@query(
    "log_export",
    f"WITH {d.LOGS} SELECT {_LINE} AS line FROM logs",
)
def log_export(spark, sf):
    """Logs written as text and read back."""
    path = scratch(spark, "log-export")
    Tables(spark, sf).logs.select(feeds.log_line()).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "log_messages",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'user=' || user_id || ' type=' || event_type END AS message FROM events",
)
def log_messages(spark, sf):
    """Log events written as JSON lines; half of them have no message."""
    path = scratch(spark, "logs")
    e = Tables(spark, sf).raw("events")
    e.select(
        F.col("event_id").cast("string").alias("timestamp"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("message"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), "event_type").alias("fields"),
    ).write.json(path)
    logs = read_logs(spark, path)
    return logs.select(F.col("timestamp").cast("long").alias("event_id"), feeds.log_message(F.col("message"), F.col("fields")).alias("message"))


@query(
    "newest_snapshots",
    f"WITH {d.STAGES} SELECT ord, stage FROM stages ORDER BY timestamp DESC, ord DESC LIMIT 300",
)
def newest_snapshots(spark, sf):
    return feeds.newest(Tables(spark, sf).stages, ["timestamp", "ord"], feeds.SNAPSHOT_LIMIT).select("ord", "stage")


@query(
    "newest_per_backend",
    f"""WITH {d.STAGES} SELECT backend, ord FROM stages
    QUALIFY row_number() OVER (PARTITION BY backend ORDER BY timestamp DESC, ord DESC) <= 512""",
)
def newest_per_backend(spark, sf):
    s = Tables(spark, sf).stages
    return feeds.newest_per_key(s, "backend", ["timestamp", "ord"], feeds.STAGE_LIMIT).select("backend", "ord")


@query(
    "last_stages",
    f"WITH {d.STAGES} SELECT ord, stage, backend, duration_ms FROM stages ORDER BY timestamp DESC, ord DESC LIMIT 8",
)
def last_stages(spark, sf):
    return feeds.newest(Tables(spark, sf).stages, ["timestamp", "ord"], 8).select("ord", "stage", "backend", "duration_ms")


@query(
    "shown_threads",
    """WITH t AS (SELECT event_id // 40 AS snapshot_id, CASE WHEN user_id % 5 = 0 THEN 'app-' ELSE 'os-' END || event_id AS name, value AS cpu_pct, user_id % 5 = 0 AS own FROM events)
    SELECT snapshot_id, name, cpu_pct FROM t
    QUALIFY own OR row_number() OVER (PARTITION BY snapshot_id, own ORDER BY cpu_pct DESC, name DESC) <= 8""",
)
def shown_threads(spark, sf):
    return feeds.shown_threads(Tables(spark, sf).threads, "app-").select("snapshot_id", "name", "cpu_pct")


def _feed(t: Tables):
    """Live events per user: a reset now and then, two sessions, repeated seqs."""
    e = t.raw("events")
    k = F.col("event_id")
    line = F.struct(
        (k % 400).alias("seq"),
        F.col("value").alias("start"),
        (F.col("value") + 1).alias("end"),
        F.col("event_type").alias("speaker"),
        F.col("props").alias("text"),
    )
    return e.select(
        F.col("user_id").alias("feed_id"),
        k.alias("revision"),
        F.concat(F.lit("s"), (k / 6000).cast("int").cast("string")).alias("session_id"),
        (k % 97 == 0).alias("reset"),
        (k % 400 / 4).cast("long").alias("retained_from_seq"),
        F.when(F.col("event_type") != "error", line).alias("line"),
    )


@query(
    "live_reconcile",
    """WITH e AS (SELECT user_id AS feed_id, event_id AS revision, 's' || (event_id // 6000) AS sid, event_id % 97 = 0 AS reset, (event_id % 400) // 4 AS keep,
      event_type <> 'error' AS has, event_id % 400 AS seq, value, event_type, props FROM events),
    cur AS (SELECT feed_id, max_by(sid, revision) AS sid, max_by(keep, revision) AS keep FROM e GROUP BY 1),
    b AS (SELECT e.feed_id, max(revision) FILTER (e.sid <> cur.sid) AS other, max(revision) FILTER (e.sid = cur.sid AND reset) AS rs
          FROM e JOIN cur USING (feed_id) GROUP BY 1)
    SELECT e.feed_id, e.sid AS session_id, seq, max_by(value, revision) AS start, max_by(event_type, revision) AS speaker
    FROM e JOIN cur ON cur.feed_id = e.feed_id AND cur.sid = e.sid JOIN b ON b.feed_id = e.feed_id
    WHERE has AND revision > coalesce(other, -1) AND revision >= coalesce(rs, -1) AND seq >= cur.keep GROUP BY ALL""",
)
def live_reconcile(spark, sf):
    return feeds.reconcile(_feed(Tables(spark, sf))).select("feed_id", "session_id", "seq", "start", "speaker")


@query(
    "dropped_chunks",
    """SELECT user_id AS session_id, count(*) AS received, max(event_id) + 1 AS expected, max(event_id) + 1 - count(*) AS dropped FROM events GROUP BY 1""",
)
def dropped_chunks(spark, sf):
    e = Tables(spark, sf).raw("events")
    return feeds.dropped_chunks(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_no")))


@query(
    "epoch_offsets",
    """WITH e AS (SELECT 'u' || user_id AS recording_id, event_id AS epoch_no, 100 + event_id % 900 AS samples FROM events)
    SELECT recording_id, epoch_no, (sum(samples) OVER w - samples)::BIGINT AS base_samples, round((sum(samples) OVER w - samples) / 16000, 7) AS offset_sec
    FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY epoch_no)""",
)
def epoch_offsets(spark, sf):
    e = Tables(spark, sf).raw("events").select(
        F.concat(F.lit("u"), "user_id").alias("recording_id"), F.col("event_id").alias("epoch_no"), (100 + F.col("event_id") % 900).alias("samples")
    )
    out = feeds.epoch_offsets(e, 16_000, 500)
    return out.select("recording_id", "epoch_no", "base_samples", F.round("offset_sec", 7).alias("offset_sec"))


def _provenance(t: Tables):
    o = t.raw("orders")
    k = F.col("o_orderkey")
    conf = o.select(
        "o_orderkey",
        F.when(k % 2 == 0, "live").otherwise("batch").alias("mode"),
        F.when(k % 3 == 0, "cloud").otherwise("local").alias("backend"),
        F.when(k % 10 == 0, float("nan")).otherwise((k % 8) / 8.0).alias("threshold"),
        (k % 4).cast("int").alias("threads"),
        (k % 5 == 0).alias("diarize"),
        F.when(k % 7 != 0, F.concat(F.lit("lang"), (k % 4).cast("string"))).alias("language"),
        F.when(k % 4 == 1, "second").otherwise("first").alias("asr_engine"),
        F.lit("cpu").alias("provider"),
        F.concat(F.lit("model-"), (k % 6).cast("string")).alias("asr_artifact"),
        ((k % 16) / 16.0).alias("vad_threshold"),
        F.lit(0.25).alias("vad_min_silence"),
        F.when(k % 2 == 0, F.lit("titan")).alias("embedding_model"),
    )
    return provenance.build(conf, "1.0")


@query(
    "provenance_documents",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'live' ELSE 'batch' END AS mode, CASE WHEN o_orderkey % 3 = 0 THEN 'cloud' ELSE 'local' END AS backend,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 0 THEN (o_orderkey % 8) / 8.0::DOUBLE END AS threshold,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10 = 0 THEN 'NaN' END AS threshold_text,
    CASE WHEN o_orderkey % 3 = 0 THEN 'channel_identification' WHEN o_orderkey % 5 = 0 THEN 'channels+diarizer' ELSE 'channels' END AS attribution,
    o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 AS diarized,
    o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 0 AS threshold_is_number,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 'lang' || (o_orderkey % 4) END AS language,
    CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'second' ELSE 'first' END || '/cpu/' || (o_orderkey % 4) || '/' || (o_orderkey % 5 = 0)::VARCHAR END AS engine,
    CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 16) / 16.0::DOUBLE END AS vad_threshold, CASE WHEN o_orderkey % 3 <> 0 THEN 0.25::DOUBLE END AS vad_min_silence,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'model-' || (o_orderkey % 6) END AS asr_artifact, o_orderkey % 3 <> 0 AS has_vad,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'titan' ELSE 'local/speaker-embedding' END END AS embedding FROM orders""",
)
def provenance_documents(spark, sf):
    p = _provenance(Tables(spark, sf))
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    doc = p.withColumn("doc", F.parse_json("provenance"))
    is_number = F.schema_of_variant(F.try_variant_get("doc", "$.made.configuration.threshold", "variant")) != "STRING"
    return doc.select(
        "o_orderkey",
        get("$.made.mode", "string").alias("mode"),
        get("$.made.backend", "string").alias("backend"),
        F.when(is_number, get("$.made.configuration.threshold", "double")).alias("threshold"),
        F.when(~is_number, get("$.made.configuration.threshold", "string")).alias("threshold_text"),
        get("$.made.configuration.speaker_attribution", "string").alias("attribution"),
        get("$.made.models.diarization.id", "string").isNotNull().alias("diarized"),
        F.coalesce(is_number, F.lit(False)).alias("threshold_is_number"),
        get("$.made.configuration.language", "string").alias("language"),
        F.concat(
            get("$.made.configuration.asr_engine", "string"), F.lit("/"), get("$.made.configuration.provider", "string"), F.lit("/"),
            get("$.made.configuration.threads", "string"), F.lit("/"), get("$.made.configuration.diarize_far_end", "string"),
        ).alias("engine"),
        get("$.made.configuration.vad_threshold", "double").alias("vad_threshold"),
        get("$.made.configuration.vad_min_silence_seconds", "double").alias("vad_min_silence"),
        get("$.made.models.asr.artifact", "string").alias("asr_artifact"),
        get("$.made.models.vad.id", "string").isNotNull().alias("has_vad"),
        get("$.made.models.speaker_embedding.id", "string").alias("embedding"),
    )


@query(
    "provenance_search",
    """SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0 AND (o_orderkey % 8) / 8.0 >= 0.5""",
)
def provenance_search(spark, sf):
    p = _provenance(Tables(spark, sf))
    return provenance.search(p, backend="local", mode="live", setting="threshold", at_least=0.5).select("o_orderkey")


@query(
    "provenance_fill",
    """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN 'cloud' ELSE 'local' END AS backend, count(*) AS n FROM orders GROUP BY 1""",
)
def provenance_fill(spark, sf):
    p = _provenance(Tables(spark, sf)).withColumn(
        "provenance", F.when(F.col("o_orderkey") % 4 != 0, F.col("provenance"))
    )
    full = provenance.fill_legacy(p, F.lit("batch"))
    return full.groupBy(F.get_json_object("provenance", "$.made.backend").alias("backend")).agg(F.count(F.lit(1)).alias("n"))
