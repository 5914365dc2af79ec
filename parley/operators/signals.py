"""Echo and energy metrics over frame tables.

frames: recording_id, frame_no, and one array<float> column per track (mic,
far, near, clean), each frame ``frame_len`` samples long except the last one.
Samples are folded inside their frame first; only frame or recording totals
are shuffled, so a recording of any length spreads over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from parley.functions import maths
from parley.operators.ordered import first, islands, last, rows, time_chunk

# Fixed values of the two published metrics.
SILENCE_GATE_DB = 30.0
NEAR_GATE = 0.05
ENERGY_FLOOR = 1e-12
FAR_FLOOR = 1e-10
SEGMENT_GATE = 0.05
MIN_SPEECH_SECS = 0.25
MAX_SPEECH_SECS = 20.0


def cut_to_shortest(frames: DataFrame, tracks: list[str]) -> DataFrame:
    """Keep, per frame, the samples all tracks have; frames missing one go."""
    n = F.least(*[F.size(t) for t in tracks]) if len(tracks) > 1 else F.size(tracks[0])
    have = None
    for t in tracks:
        have = F.col(t).isNotNull() if have is None else have & F.col(t).isNotNull()
    out = frames.filter(have).withColumn("_n", n).filter(F.col("_n") > 0)
    for t in tracks:
        out = out.withColumn(t, F.slice(F.col(t), F.lit(1), F.col("_n")))
    return out.drop("_n")


def align_tracks(tracks: dict[str, DataFrame]) -> DataFrame:
    """Join single-track frame tables (recording_id, frame_no, samples)."""
    out = None
    for name, df in tracks.items():
        one = df.select("recording_id", "frame_no", F.col("samples").alias(name))
        out = one if out is None else out.join(one, ["recording_id", "frame_no"])
    return cut_to_shortest(out, list(tracks))


def reframe(samples: DataFrame, frame_len: int) -> DataFrame:
    """Single samples (recording_id, idx, value) to full frames only."""
    f = max(1, frame_len)
    frames = (
        samples.withColumn("frame_no", F.floor(F.col("idx") / f).cast("long"))
        .groupBy("recording_id", "frame_no")
        .agg(
            F.sort_array(F.collect_list(F.struct("idx", "value")))["value"].alias("samples")
        )
    )
    return frames.filter(F.size("samples") == f)


def level(frames: DataFrame, track: str) -> DataFrame:
    """Energy and RMS per recording."""
    return (
        frames.select("recording_id", maths.energy(F.col(track)).alias("_e"), F.size(track).cast("long").alias("_n"))
        .groupBy("recording_id")
        .agg(F.sum("_e").alias("energy"), F.sum("_n").alias("samples"))
        .withColumn("rms", F.sqrt(F.col("energy") / F.col("samples")))
    )


def _folded(frames: DataFrame, frame_len: int) -> DataFrame:
    """Per-frame sums; the sample arrays end here."""
    diff = F.aggregate(
        F.arrays_zip(F.col("near").alias("a"), F.col("clean").alias("b")),
        F.lit(0.0),
        lambda s, x: s + F.pow(x["a"].cast("double") - x["b"].cast("double"), F.lit(2.0)),
    )
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return frames.select(
        "recording_id",
        "frame_no",
        (F.size("near") >= frame_len).alias("full"),
        F.size("near").cast("long").alias("n"),
        maths.energy(F.col("mic")).alias("mic_e"),
        maths.energy(F.col("clean")).alias("clean_e"),
        maths.energy(F.col("near")).alias("near_e"),
        maths.dot(F.col("near"), F.col("clean")).alias("cross"),
        total(F.col("near")).alias("near_s"),
        total(F.col("clean")).alias("clean_s"),
        diff.alias("err_e"),
    )


def echo_report(frames: DataFrame, frame_len: int) -> DataFrame:
    """Gated echo metrics per recording with a near-end track.

    Frames whose near RMS is within the gate below the loudest frame are
    near-active; the quieter full frames are echo-only. A short last frame is
    in neither set but counts where the whole signal is the fallback; a signal
    shorter than one frame is one frame.
    """
    f = _folded(cut_to_shortest(frames, ["mic", "clean", "near"]), frame_len)
    rms = F.sqrt(F.col("near_e") / F.col("n"))
    peak = f.groupBy("recording_id").agg(
        F.coalesce(F.max(F.when(F.col("full"), rms)), F.max(rms)).alias("peak"),
        F.bool_or("full").alias("_any"),
    )
    usable = F.col("full") | ~F.col("_any")
    gate = F.col("peak") * (10.0 ** (-SILENCE_GATE_DB / 20.0))
    t = f.join(peak, "recording_id").withColumn("quiet", usable & (rms <= gate)).withColumn(
        "active", usable & (rms > gate)
    )
    on = lambda flag, c: F.sum(F.when(F.col(flag), F.col(c)))
    snr = F.when(
        F.col("active") & F.col("full") & (F.col("near_e") > 0) & (F.col("err_e") > 0),
        maths.decibels(F.col("near_e"), F.col("err_e")),
    )
    g = t.groupBy("recording_id").agg(
        F.count_if("quiet").alias("echo_only_frames"),
        F.count_if("active").alias("near_active_frames"),
        on("quiet", "mic_e").alias("_qm"),
        on("quiet", "clean_e").alias("_qc"),
        F.sum("mic_e").alias("_am"),
        F.sum("clean_e").alias("_ac"),
        F.avg(snr).alias("near_seg_snr_db"),
        on("active", "n").alias("_n"),
        on("active", "near_s").alias("_x"),
        on("active", "clean_s").alias("_y"),
        on("active", "near_e").alias("_xx"),
        on("active", "clean_e").alias("_yy"),
        on("active", "cross").alias("_xy"),
    )
    vx = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_n")
    vy = F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_n")
    cov = F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_n")
    return g.select(
        "recording_id",
        F.when(F.col("echo_only_frames") > 0, maths.erle_db(F.col("_qm"), F.col("_qc")))
        .otherwise(maths.erle_db(F.col("_am"), F.col("_ac")))
        .alias("erle_db"),
        "echo_only_frames",
        "near_active_frames",
        "near_seg_snr_db",
        F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("near_correlation"),
    )


def whole_signal_erle(frames: DataFrame) -> DataFrame:
    """The same ratio without a near-end track: over everything."""
    return (
        cut_to_shortest(frames, ["mic", "clean"])
        .select("recording_id", maths.energy(F.col("mic")).alias("m"), maths.energy(F.col("clean")).alias("c"))
        .groupBy("recording_id")
        .agg(F.sum("m").alias("m"), F.sum("c").alias("c"))
        .select("recording_id", maths.erle_db(F.col("m"), F.col("c")).alias("erle_db"))
    )


def sample_erle(frames: DataFrame) -> DataFrame:
    """Sample-gated echo return loss enhancement.

    Samples with |near| at most 5 % of the near RMS count as echo-only; a
    missing near sample is silent.
    """
    both = cut_to_shortest(frames, ["mic", "clean"]).withColumn(
        "near", F.slice(F.coalesce("near", F.array().cast("array<float>")), F.lit(1), F.size("mic"))
    )
    rms = level(both, "near").select(
        "recording_id", (F.coalesce("rms", F.lit(0.0)) * NEAR_GATE).alias("_gate")
    )
    gated = both.join(rms, "recording_id")
    quiet = F.filter(
        F.arrays_zip("mic", "clean", "near"),
        lambda x: F.abs(F.coalesce(x["near"].cast("double"), F.lit(0.0))) <= F.col("_gate"),
    )
    sq = lambda name: F.aggregate(
        F.col("_q"), F.lit(0.0), lambda s, x: s + x[name].cast("double") * x[name].cast("double")
    )
    g = (
        gated.withColumn("_q", quiet)
        .select("recording_id", sq("mic").alias("m"), sq("clean").alias("c"))
        .groupBy("recording_id")
        .agg(F.sum("m").alias("m"), F.sum("c").alias("c"))
    )
    return g.select(
        "recording_id",
        F.when(F.col("m") <= ENERGY_FLOOR, 0.0)
        .otherwise(maths.decibels(F.col("m"), F.greatest("c", F.lit(ENERGY_FLOOR))))
        .alias("erle_db"),
    )


def window_stats(frames: DataFrame, frame_len: int, window: int, tracks: list[str]) -> DataFrame:
    """Sums per half-overlapping window; only windows that are full.

    Each sample is folded into its windows inside the frame's task before
    anything is shuffled.
    """
    step = window // 2
    cut = cut_to_shortest(frames, tracks)
    pos = F.col("frame_no") * frame_len + F.col("_i")
    first_w = F.greatest(F.floor((pos - window) / step) + 1, F.lit(0))
    samples = cut.select("recording_id", "frame_no", F.posexplode(F.arrays_zip(*tracks)).alias("_i", "_s"))
    spread = samples.withColumn("window_no", F.explode(F.sequence(first_w, F.floor(pos / step))))
    sums = [F.count(F.lit(1)).alias("n")]
    val = {t: F.col("_s")[t].cast("double") for t in tracks}
    for i, a in enumerate(tracks):
        sums.append(F.sum(val[a]).alias(f"{a}_s"))
        for b in tracks[i:]:
            sums.append(F.sum(val[a] * val[b]).alias(f"{a}_{b}"))
    return spread.groupBy("recording_id", "window_no").agg(*sums).filter(F.col("n") == window)


def _corr(a: str, b: str) -> Column:
    """Pearson correlation from window sums, with a floored denominator."""
    n = F.col("n")
    cov = F.col(f"{a}_{b}") - F.col(f"{a}_s") * F.col(f"{b}_s") / n
    var = lambda x: F.greatest(F.col(f"{x}_{x}") - F.col(f"{x}_s") * F.col(f"{x}_s") / n, F.lit(0.0))
    return cov / F.greatest(F.sqrt(var(a)) * F.sqrt(var(b)), F.lit(ENERGY_FLOOR))


def echo_scores(frames: DataFrame, frame_len: int, window: int) -> DataFrame:
    """Suppression, near-end preservation and their weighted sum per recording."""
    w = window_stats(frames, frame_len, window, ["mic", "clean", "far"])
    ids = frames.select("recording_id").distinct()
    heard = F.col("far_far") > FAR_FLOOR
    residual = F.avg(F.when(heard, F.abs(_corr("clean", "far"))))
    talking = (
        (F.col("mic_mic") > 2 * F.col("far_far"))
        & (F.col("mic_mic") > FAR_FLOOR)
        & (F.abs(_corr("mic", "far")) < 0.5)
    )
    kept = F.avg(F.when(talking, F.least(F.col("clean_clean") / F.col("mic_mic"), F.lit(1.0))))
    g = w.groupBy("recording_id").agg(residual.alias("_r"), kept.alias("_k"))
    sup = F.when(F.col("_r").isNull(), 0.5).otherwise(
        maths.clamp(1.0 - F.col("_r"), F.lit(0.0), F.lit(1.0))
    )
    return (
        ids.join(g, "recording_id", "left")
        .select("recording_id", sup.alias("echo_suppression"), F.coalesce("_k", F.lit(1.0)).alias("near_end_preservation"))
        .withColumn("combined", 0.7 * F.col("echo_suppression") + 0.3 * F.col("near_end_preservation"))
    )


def lag_segments(segments: DataFrame) -> DataFrame:
    """The loud enough segments of each recording.

    segments: recording_id, seg_no, mic, far. Segments stay whose far energy
    reaches 5 % of the loudest. All are looked at: a segment is a row, and
    correlations are summed before they move.
    """
    measured = segments.withColumn("_e", maths.energy(F.col("far")))
    top = measured.groupBy("recording_id").agg(F.max("_e").alias("_top"))
    return (
        measured.join(top, "recording_id")
        .filter((F.col("_top") > 0) & (F.col("_e") >= SEGMENT_GATE * F.col("_top")))
        .drop("_e", "_top")
    )


def cross_correlations(max_lag: int):
    """A column function giving one segment's correlation at lags [0, max_lag)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def at_lags(mic: pd.Series, far: pd.Series) -> pd.Series:
        out = []
        for m, f in zip(mic, far):
            m, f = np.asarray(m, dtype=np.float64), np.asarray(f, dtype=np.float64)
            size = 1 << (len(f) + max_lag - 1).bit_length()
            spec = np.conj(np.fft.rfft(f, size)) * np.fft.rfft(m, size)
            out.append(np.fft.irfft(spec, size)[:max_lag])
        return pd.Series(out)

    return at_lags


def estimate_lag(segments: DataFrame, max_lag: int) -> DataFrame:
    """Delay of mic after far per recording, 0 where nothing can be aligned."""
    ids = segments.select("recording_id").distinct()
    xc = cross_correlations(max_lag)(F.col("mic"), F.col("far"))
    summed = (
        lag_segments(segments)
        .select("recording_id", F.posexplode(xc).alias("lag", "v"))
        .groupBy("recording_id", "lag")
        .agg(F.sum("v").alias("v"))
    )
    # Equal peaks go to the later lag.
    best = summed.groupBy("recording_id").agg(F.max_by("lag", F.struct("v", "lag")).alias("lag"))
    return ids.join(best, "recording_id", "left").select(
        "recording_id", F.coalesce("lag", F.lit(0)).cast("long").alias("lag")
    )


def speech_regions(
    scores: DataFrame,
    frame_secs: float,
    threshold: float = 0.5,
    min_silence: float = 0.25,
    min_speech: float = MIN_SPEECH_SECS,
    max_speech: float = MAX_SPEECH_SECS,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Speech regions from frame scores (recording_id, frame_no, score).

    Frames at or above the threshold are speech. Silences shorter than
    ``min_silence`` are bridged, regions shorter than ``min_speech`` dropped,
    and longer ones cut every ``max_speech`` from their own start.
    """
    speech = scores.filter(F.col("score") >= threshold)
    quiet_frames = round(min_silence / frame_secs)
    regions = islands(
        speech,
        ["recording_id"],
        ["frame_no"],
        time_chunk("frame_no", chunk_rows),
        ["frame_no"],
        lambda prev, cur: cur("frame_no") - prev("frame_no") - 1 >= quiet_frames,
        {"first_frame": first("frame_no"), "last_frame": last("frame_no"), "speech_frames": rows()},
    )
    frames_min, frames_max = round(min_speech / frame_secs), round(max_speech / frame_secs)
    long_enough = regions.filter(F.col("last_frame") - F.col("first_frame") + 1 >= frames_min)
    cuts = F.sequence(F.col("first_frame"), F.col("last_frame"), F.lit(frames_max).cast("long"))
    return long_enough.select(
        "recording_id", "last_frame", F.explode(cuts).alias("_from")
    ).select(
        "recording_id",
        (F.col("_from") * frame_secs).alias("start"),
        ((F.least(F.col("_from") + frames_max - 1, F.col("last_frame")) + 1) * frame_secs).alias("end"),
    )


def downmix(interleaved: DataFrame, channels: int, mic_channels: int) -> DataFrame:
    """Interleaved frames (recording_id, frame_no, samples) to mono mic and tap."""
    whole = F.floor(F.size("samples") / channels)
    group = F.transform(
        F.sequence(F.lit(1), whole),
        lambda i: F.slice("samples", ((i - 1) * channels + 1).cast("int"), channels),
    )
    mono = lambda off, n: F.when(
        whole > 0, F.transform(F.col("_g"), lambda g: maths.mean_of(g, off, n))
    ).otherwise(F.array().cast("array<double>"))
    return (
        interleaved.withColumn("_g", group)
        .withColumn("mic", mono(0, mic_channels))
        .withColumn("tap", mono(mic_channels, channels - mic_channels))
        .drop("_g", "samples")
    )

