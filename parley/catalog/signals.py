"""Queries over edges, frames and samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from parley.adapters import duck as d
from parley.adapters.tables import Tables
from parley.catalog.registry import query
from parley.functions import maths
from parley.operators import sessions, signals
from parley.operators.ordered import in_order
from parley.session import scratch
from parley.sources import wav

HOUR = 3_600_000
DEBOUNCE, COALESCE, MINIMUM, SPAN = 3 * HOUR, 4 * HOUR, 6 * HOUR, 48 * HOUR

_INTERVALS = """
edges AS (SELECT *, lag(is_on) OVER (PARTITION BY key ORDER BY ts, ord) AS was FROM signal),
changes AS (SELECT * FROM edges WHERE is_on IS DISTINCT FROM was),
spells AS (
  SELECT key, ts AS on_at, lead(ts) OVER (PARTITION BY key ORDER BY ts, ord) AS off_at, is_on FROM changes),
intervals AS (SELECT key, on_at, off_at FROM spells WHERE is_on)"""

def _session_steps(debounce: int, coalesce: int, minimum: int) -> str:
    return f"""{_INTERVALS},
joined AS (
  SELECT *, CASE WHEN on_at - lag(off_at) OVER (PARTITION BY key ORDER BY on_at) < {coalesce} THEN 0 ELSE 1 END AS brk FROM intervals),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY key ORDER BY on_at) AS run FROM joined),
found AS (
  SELECT key, min(CASE WHEN off_at IS NULL OR off_at - on_at >= {debounce} THEN on_at END) + {debounce} AS started,
         CASE WHEN bool_or(off_at IS NULL) THEN NULL ELSE max(off_at) END AS ended FROM runs GROUP BY key, run),
sessions AS (
  SELECT key, started, ended, ended - started AS duration,
         CASE WHEN ended IS NOT NULL THEN ended - started >= {minimum} END AS keep FROM found WHERE started IS NOT NULL)"""


_SESSIONS = f"{d.SIGNAL},{_session_steps(DEBOUNCE, COALESCE, MINIMUM)}"


def _sessions(t: Tables):
    return sessions.detect(t.signal, DEBOUNCE, COALESCE, MINIMUM, SPAN)


@query("recording_sessions", f"WITH {_SESSIONS} SELECT key, started, ended, duration, keep FROM sessions")
def recording_sessions(spark, sf):
    return _sessions(Tables(spark, sf))


@query(
    "session_lifecycle",
    f"""WITH {_SESSIONS} SELECT key, started AS ts, 'started' AS event, started FROM sessions
    UNION ALL SELECT key, ended + {COALESCE}, CASE WHEN keep THEN 'finished' ELSE 'discarded' END, started
    FROM sessions WHERE ended IS NOT NULL""",
)
def session_lifecycle(spark, sf):
    return sessions.lifecycle(_sessions(Tables(spark, sf)), COALESCE)


@query(
    "input_owner",
    f"""WITH {d.HOLDERS}
    SELECT snapshot_id, bundle_id, pid FROM holders
    QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY
      CASE WHEN {d.known("bundle_id")} IS NOT NULL THEN 0 WHEN NOT starts_with(bundle_id, 'com.apple.') THEN 1 ELSE 2 END, ord) = 1""",
)
def input_owner(spark, sf):
    return sessions.best_owner(Tables(spark, sf).holders)


@query(
    "held_signal",
    f"""WITH {d.HOLDERS}
    SELECT key, snapshot_id, ts, bool_or(pid <> 3 AND ({d.known("bundle_id")} IS NOT NULL OR NOT starts_with(bundle_id, 'com.apple.'))) AS "on"
    FROM holders GROUP BY ALL""",
)
def held_signal(spark, sf):
    return sessions.held_signal(Tables(spark, sf).holders, own_pid=3)


@query(
    "held_sessions",
    f"""WITH {d.HOLDERS},
    signal AS (SELECT key, ts, snapshot_id AS ord, bool_or(pid <> 3 AND ({d.known("bundle_id")} IS NOT NULL OR NOT starts_with(bundle_id, 'com.apple.'))) AS is_on
               FROM holders GROUP BY ALL),{_session_steps(2, 3, 4)}
    SELECT key, started, ended, duration, keep FROM sessions""",
)
def held_sessions(spark, sf):
    """Sessions of the signal derived from holder snapshots."""
    held = sessions.held_signal(Tables(spark, sf).holders, own_pid=3)
    return sessions.detect(held.withColumn("ord", F.col("snapshot_id")), 2, 3, 4, 200)




@query(
    "signal_level",
    f"""WITH {d.FRAMES} SELECT recording_id, round(sum(mic * mic), 6) AS energy, count(*) AS samples,
    round(sqrt(avg(mic * mic)), 6) AS rms FROM frames GROUP BY recording_id""",
)
def signal_level(spark, sf):
    g = signals.level(Tables(spark, sf).frames, "mic")
    return g.select("recording_id", F.round("energy", 6).alias("energy"), "samples", F.round("rms", 6).alias("rms"))


_ERLE = (
    "CASE WHEN {c} <= 0 THEN CASE WHEN {m} > 0 THEN 200.0::DOUBLE ELSE 0.0::DOUBLE END "
    "WHEN {m} <= 0 THEN 0.0::DOUBLE ELSE 10 * log10({m} / {c}) END"
)


def erle(m: str, c: str) -> str:
    return _ERLE.format(m=m, c=c)


@query(
    "gated_echo_report",
    f"""WITH {d.FRAMES},
    per AS (SELECT recording_id, frame_no, sqrt(avg(near * near)) AS rms, sum(near * near) AS rp,
                   sum((near - clean) * (near - clean)) AS ep FROM frames GROUP BY ALL),
    flag AS (SELECT *, rms <= max(rms) OVER (PARTITION BY recording_id) * power(10, -1.5) AS quiet FROM per),
    s AS (SELECT f.*, g.quiet FROM frames f JOIN flag g USING (recording_id, frame_no)),
    a AS (SELECT recording_id, sum(mic * mic) FILTER (quiet) AS qm, sum(clean * clean) FILTER (quiet) AS qc,
                 sum(mic * mic) AS am, sum(clean * clean) AS ac, corr(clean, near) FILTER (NOT quiet) AS cc FROM s GROUP BY 1),
    b AS (SELECT recording_id, count(*) FILTER (quiet) AS echo_only_frames, count(*) FILTER (NOT quiet) AS near_active_frames,
                 avg(10 * log10(rp / ep)) FILTER (NOT quiet AND rp > 0 AND ep > 0) AS snr FROM flag GROUP BY 1)
    SELECT recording_id, round(CASE WHEN echo_only_frames > 0 THEN {erle("qm", "qc")} ELSE {erle("am", "ac")} END, 6) AS erle_db,
           echo_only_frames, near_active_frames, round(snr, 6) AS near_seg_snr_db, round(cc, 6) AS near_correlation
    FROM a JOIN b USING (recording_id)""",
)
def gated_echo_report(spark, sf):
    g = signals.echo_report(Tables(spark, sf).frames, 16)
    return g.select(
        "recording_id",
        F.round("erle_db", 6).alias("erle_db"),
        "echo_only_frames",
        "near_active_frames",
        F.round("near_seg_snr_db", 6).alias("near_seg_snr_db"),
        F.round("near_correlation", 6).alias("near_correlation"),
    )


@query(
    "whole_signal_erle",
    f"""WITH {d.FRAMES}, g AS (SELECT recording_id, sum(mic * mic) AS m, sum(clean * clean) AS c FROM frames GROUP BY 1)
    SELECT recording_id, round({erle("m", "c")}, 6) AS erle_db FROM g""",
)
def whole_signal_erle(spark, sf):
    return signals.whole_signal_erle(Tables(spark, sf).frames).select("recording_id", F.round("erle_db", 6).alias("erle_db"))


@query(
    "sample_gated_erle",
    f"""WITH {d.FRAMES},
    gate AS (SELECT recording_id, sqrt(avg(near * near)) * 0.05::DOUBLE AS g FROM frames GROUP BY 1),
    q AS (SELECT f.recording_id, coalesce(sum(mic * mic) FILTER (abs(near) <= g), 0) AS m,
                 coalesce(sum(clean * clean) FILTER (abs(near) <= g), 0) AS c FROM frames f JOIN gate USING (recording_id) GROUP BY 1)
    SELECT recording_id, round(CASE WHEN m <= 1e-12 THEN 0.0::DOUBLE ELSE 10 * log10(m / greatest(c, 1e-12)) END, 6) AS erle_db FROM q""",
)
def sample_gated_erle(spark, sf):
    return signals.sample_erle(Tables(spark, sf).frames).select("recording_id", F.round("erle_db", 6).alias("erle_db"))


_CORR = (
    "(sum({a} * {b}) - sum({a}) * sum({b}) / count(*)) / greatest(sqrt(greatest(sum({a} * {a}) - sum({a}) * sum({a}) / count(*), 0)) "
    "* sqrt(greatest(sum({b} * {b}) - sum({b}) * sum({b}) / count(*), 0)), 1e-12)"
)


def corr(a: str, b: str) -> str:
    return _CORR.format(a=a, b=b)


@query(
    "echo_scores",
    f"""WITH {d.FRAMES},
    w AS (SELECT recording_id, k AS window_no, sum(mic * mic) AS me, sum(far * far) AS fe, sum(clean * clean) AS ce,
                 {corr("clean", "far")} AS cf, {corr("mic", "far")} AS mf, count(*) AS n
          FROM (SELECT *, unnest(range(greatest(0, pos // 12 - 1), pos // 12 + 1)) AS k FROM frames)
          GROUP BY ALL HAVING count(*) = 24),
    g AS (SELECT recording_id, avg(abs(cf)) FILTER (fe > 1e-10) AS r,
                 avg(least(ce / me, 1)) FILTER (me > 2 * fe AND me > 1e-10 AND abs(mf) < 0.5) AS kept FROM w GROUP BY 1),
    s AS (SELECT recording_id, CASE WHEN r IS NULL THEN 0.5::DOUBLE ELSE greatest(0, least(1, 1 - r)) END AS sup,
                 coalesce(kept, 1) AS pres FROM g)
    SELECT recording_id, round(sup, 6) AS echo_suppression, round(pres, 6) AS near_end_preservation,
           round(0.7::DOUBLE * sup + 0.3::DOUBLE * pres, 6) AS combined FROM s""",
)
def echo_scores(spark, sf):
    g = signals.echo_scores(Tables(spark, sf).frames, 16, 24)
    return g.select(
        "recording_id", *[F.round(c, 6).alias(c) for c in ("echo_suppression", "near_end_preservation", "combined")]
    )


@query(
    "aligned_tracks",
    """WITH m AS (SELECT vec_id, embedding FROM embeddings), f AS (SELECT vec_id - 1 AS vec_id, embedding FROM embeddings)
    SELECT 'v' || vec_id AS recording_id, 40::BIGINT AS samples,
           round(list_sum(list_transform(range(1, 41), lambda i: m.embedding[i]::DOUBLE * f.embedding[i]::DOUBLE)), 6) AS cross_energy
    FROM m JOIN f USING (vec_id)""",
)
def aligned_tracks(spark, sf):
    """Tracks of 64 and 40 samples joined frame by frame, cut to the shortest."""
    e = Tables(spark, sf).raw("embeddings")

    def track(shift, n):
        # Frames of 16; the last one of a 40-sample track has 8.
        v = e.select((F.col("vec_id") - shift).alias("v"), F.slice("embedding", 1, n).alias("x"))
        cut = v.select("v", "x", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 16))).alias("frame_no"))
        return cut.select(
            F.concat(F.lit("v"), "v").alias("recording_id"), F.col("frame_no").cast("long").alias("frame_no"),
            F.slice("x", F.col("frame_no") * 16 + 1, F.lit(16)).alias("samples"),
        )

    both = signals.align_tracks({"mic": track(0, 64), "far": track(1, 40)})
    return (
        both.groupBy("recording_id")
        .agg(F.sum(F.size("mic")).alias("samples"), F.sum(maths.dot(F.col("mic"), F.col("far"))).alias("cross_energy"))
        .withColumn("cross_energy", F.round("cross_energy", 6))
    )


@query(
    "full_frames",
    """SELECT 'v' || vec_id AS recording_id, f::BIGINT AS frame_no, round(list_sum(list_transform(embedding[f * 20 + 1:f * 20 + 20], lambda x: x::DOUBLE)), 6) AS total
    FROM (SELECT vec_id, embedding, unnest(range(3)) AS f FROM embeddings)""",
)
def full_frames(spark, sf):
    e = Tables(spark, sf).raw("embeddings")
    s = e.select(F.concat(F.lit("v"), "vec_id").alias("recording_id"), F.posexplode("embedding").alias("idx", "value"))
    fr = signals.reframe(s, 20)
    return fr.select(
        "recording_id",
        "frame_no",
        F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"),
    )


# Lags: mic is the far track delayed by 5 samples, in segments of 16.
_LAG = 5


def _segments(t: Tables):
    e = t.raw("embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    late = F.concat(F.array_repeat(F.lit(0.0), _LAG), F.slice(x, 1, 64 - _LAG))
    cut = e.select(
        F.concat(F.lit("v"), "vec_id").alias("recording_id"), late.alias("m"), x.alias("f"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s")
    )
    part = lambda c: F.slice(c, F.col("s") * 16 + 1, F.lit(16))
    return cut.select(
        "recording_id", F.col("s").cast("long").alias("seg_no"), F.lit(4).cast("long").alias("n_segments"), part("m").alias("mic"), part("f").alias("far")
    )


@query(
    "delay_estimate",
    f"""WITH s AS (SELECT 'v' || vec_id AS recording_id, s AS seg_no,
        list_transform(range(1, 65), lambda i: CASE WHEN i > {_LAG} THEN embedding[i - {_LAG}]::DOUBLE ELSE 0::DOUBLE END)[s * 16 + 1:s * 16 + 16] AS m,
        list_transform(embedding, lambda v: v::DOUBLE)[s * 16 + 1:s * 16 + 16] AS f
        FROM (SELECT vec_id, embedding, unnest(range(4)) AS s FROM embeddings)),
    e AS (SELECT *, list_sum(list_transform(f, lambda v: v * v)) AS en FROM s),
    loud AS (SELECT * FROM e QUALIFY en >= 0.05 * max(en) OVER (PARTITION BY recording_id)),
    x AS (SELECT recording_id, lag, sum(list_sum(list_transform(range(1, 17 - lag), lambda i: f[i] * m[i + lag]))) AS v
          FROM (SELECT *, unnest(range(12)) AS lag FROM loud) GROUP BY ALL)
    SELECT recording_id, lag FROM x QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY v DESC, lag DESC) = 1""",
)
def delay_estimate(spark, sf):
    return signals.estimate_lag(_segments(Tables(spark, sf)), 12)


@query(
    "speech_regions",
    """WITH s AS (SELECT 'u' || user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no,
                       value FROM events),
    sp AS (SELECT *, CASE WHEN frame_no - lag(frame_no) OVER (PARTITION BY recording_id ORDER BY frame_no) - 1 < 2 THEN 0 ELSE 1 END AS brk
           FROM s WHERE value >= 20),
    r AS (SELECT *, sum(brk) OVER (PARTITION BY recording_id ORDER BY frame_no) AS run FROM sp),
    g AS (SELECT recording_id, min(frame_no) AS a, max(frame_no) AS b FROM r GROUP BY recording_id, run HAVING max(frame_no) - min(frame_no) + 1 >= 3),
    c AS (SELECT recording_id, b, unnest(range(a, b + 1, 10)) AS f FROM g)
    SELECT recording_id, round(f * 0.1::DOUBLE, 6) AS start, round((least(f + 9, b) + 1) * 0.1::DOUBLE, 6) AS "end" FROM c""",
)
def speech_regions(spark, sf):
    """Frames of 0.1 s: silences of two frames close, three frames keep, ten cut."""
    from parley.operators.ordered import row_chunk, running_total

    e = Tables(spark, sf).raw("events").select(
        F.concat(F.lit("u"), "user_id").alias("recording_id"), "event_id", "value"
    )
    numbered = running_total(e, ["recording_id"], ["event_id"], row_chunk("event_id"), F.lit(1), "n")
    scores = numbered.select("recording_id", (F.col("n") - 1).alias("frame_no"), F.col("value").alias("score"))
    out = signals.speech_regions(scores, 0.1, 20.0, 0.2, 0.3, 1.0, chunk_rows=7)
    return out.select("recording_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "downmixed_tracks",
    """WITH s AS (SELECT 'v' || vec_id AS recording_id, embedding AS x, unnest(range(21)) AS f FROM embeddings)
    SELECT recording_id, f::BIGINT AS pos, round((x[f * 3 + 1]::DOUBLE + x[f * 3 + 2]::DOUBLE) / 2, 6) AS mic,
           round(x[f * 3 + 3]::DOUBLE, 6) AS tap FROM s""",
)
def downmixed_tracks(spark, sf):
    """64 interleaved samples as three channels: two microphones, one tap."""
    e = Tables(spark, sf).raw("embeddings")
    fr = e.select(
        F.concat(F.lit("v"), "vec_id").alias("recording_id"), F.lit(0).cast("long").alias("frame_no"), F.col("embedding").alias("samples")
    )
    mono = signals.downmix(fr, 3, 2)
    return mono.select("recording_id", F.posexplode(F.arrays_zip("mic", "tap")).alias("pos", "s")).select(
        "recording_id", F.col("pos").cast("long").alias("pos"), F.round("s.mic", 6).alias("mic"), F.round("s.tap", 6).alias("tap")
    )


@query(
    "wav_ingest",
    """WITH p AS (SELECT vec_id // 50 AS rec, vec_id % 50 * 64 AS base, unnest(embedding) AS x, unnest(range(64)) AS k FROM embeddings),
    q AS (SELECT rec, base + k AS i, trunc(greatest(-1, least(1, x::DOUBLE)) * 32767) / 32768 AS v FROM p)
    SELECT '/rec/v' || rec || '.wav' AS path, 16000 AS sample_rate, (i // 2) // 10 AS frame_no,
           count(*) FILTER (i % 2 = 0) AS mic_samples,
           round(sum(v) FILTER (i % 2 = 0), 5) AS mic_total, round(sum(v) FILTER (i % 2 = 1), 5) AS tap_total
    FROM q GROUP BY ALL""",
)
def wav_ingest(spark, sf):
    """Vectors, fifty to a recording, written as two-track 16-bit files and read back in byte ranges."""
    @F.pandas_udf(BinaryType())
    def to_wav(v: pd.Series) -> pd.Series:
        return v.map(lambda x: wav.encode_pcm16(np.concatenate(x)[0::2], np.concatenate(x)[1::2], 16_000))

    e = Tables(spark, sf).raw("embeddings")
    parts = e.groupBy(F.floor(F.col("vec_id") / 50).alias("rec")).agg(in_order(F.col("embedding"), F.col("vec_id")).alias("parts"))
    files = parts.select(F.concat(F.lit("v"), F.col("rec").cast("string"), F.lit(".wav")).alias("name"), to_wav("parts").alias("content"))
    folder = scratch(spark, "recordings")
    wav.write_files(files, folder).write.format("noop").mode("overwrite").save()
    fr = wav.read_wav(spark, folder, 10, range_bytes=4096)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")), 5)
    return fr.select(
        F.concat(F.lit("/rec/"), F.substring_index("path", "/", -1)).alias("path"), "sample_rate", "frame_no", F.size("mic").cast("long").alias("mic_samples"),
        total("mic").alias("mic_total"), total("tap").alias("tap_total"),
    )
