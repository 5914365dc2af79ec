"""Signal metrics against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import signals, speakers
from parley.sources import wav

FRAMES = "recording_id string, frame_no long, mic array<double>, far array<double>, clean array<double>, near array<double>"


def frames(spark, mic, far, clean, near, n=20):
    rows = [
        ("r", k, *[list(map(float, x[i : i + n])) for x in (mic, far, clean, near)])
        for k, i in enumerate(range(0, len(mic), n))
    ]
    return spark.createDataFrame(rows, FRAMES)


@pytest.fixture(scope="module")
def tracks():
    rng = np.random.default_rng(0)
    far = rng.standard_normal(210)
    near = np.where((np.arange(210) // 40) % 2 == 0, rng.standard_normal(210), 1e-4)
    mic = near + 0.5 * far
    return mic, far, near + 0.05 * far, near


def test_gated_report(spark, tracks):
    mic, far, clean, near = tracks
    got = signals.echo_report(frames(spark, mic, far, clean, near), 20).first()
    full = near[:200].reshape(-1, 20)
    rms = np.sqrt((full**2).mean(axis=1))
    quiet = np.repeat(rms <= rms.max() * 10**-1.5, 20)
    m, c, r = mic[:200], clean[:200], near[:200]
    assert math.isclose(got.erle_db, 10 * np.log10((m[quiet] ** 2).sum() / (c[quiet] ** 2).sum()))
    err = ((r - c) ** 2).reshape(-1, 20).sum(axis=1)
    act = ~(rms <= rms.max() * 10**-1.5)
    assert math.isclose(got.near_seg_snr_db, np.mean(10 * np.log10((full**2).sum(axis=1)[act] / err[act])))
    assert math.isclose(got.near_correlation, np.corrcoef(c[~quiet], r[~quiet])[0, 1])
    assert (got.echo_only_frames, got.near_active_frames) == (int((~act).sum()), int(act.sum()))


def test_silent_clean_signal(spark):
    z, one = np.zeros(40), np.ones(40)
    assert signals.whole_signal_erle(frames(spark, one, one, z, one)).first().erle_db == 200.0
    assert signals.whole_signal_erle(frames(spark, z, one, z, one)).first().erle_db == 0.0
    assert signals.whole_signal_erle(frames(spark, z, one, one, one)).first().erle_db == 0.0


def test_window_scores(spark, tracks):
    mic, far, clean, near = tracks
    got = signals.echo_scores(frames(spark, mic, far, clean, near), 20, 50).first()
    sup, kept = [], []
    for p in range(0, 210 - 50 + 1, 25):
        m, f, c = mic[p : p + 50], far[p : p + 50], clean[p : p + 50]
        sup.append(abs(np.corrcoef(c, f)[0, 1]))
        if (m**2).sum() > 2 * (f**2).sum() and abs(np.corrcoef(m, f)[0, 1]) < 0.5:
            kept.append(min(1, (c**2).sum() / (m**2).sum()))
    assert math.isclose(got.echo_suppression, 1 - np.mean(sup), rel_tol=1e-9)
    assert math.isclose(got.near_end_preservation, np.mean(kept) if kept else 1.0, rel_tol=1e-9)
    short = signals.echo_scores(frames(spark, mic[:30], far[:30], clean[:30], near[:30]), 20, 50).first()
    assert (short.echo_suppression, short.near_end_preservation) == (0.5, 1.0)


def test_lag_is_found(spark):
    rng = np.random.default_rng(1)
    far = rng.standard_normal(4000)
    mic = np.concatenate([np.zeros(37), far[:-37]]) + 0.1 * rng.standard_normal(4000)
    rows = [("r", k, 4, mic[k * 1000 : k * 1000 + 1000].tolist(), far[k * 1000 : k * 1000 + 1000].tolist()) for k in range(4)]
    rows.append(("silent", 0, 1, [1.0] * 10, [0.0] * 10))
    df = spark.createDataFrame(rows, "recording_id string, seg_no long, n_segments long, mic array<double>, far array<double>")
    assert {r.recording_id: r.lag for r in signals.estimate_lag(df, 100).collect()} == {"r": 37, "silent": 0}


def test_every_loud_segment_counts(spark):
    df = spark.range(200).select(
        F.lit("r").alias("recording_id"), F.col("id").alias("seg_no"), F.lit(200).cast("long").alias("n_segments"),
        F.array(F.lit(1.0)).alias("mic"), F.array(F.lit(1.0)).alias("far"),
    )
    got = sorted(r.seg_no for r in signals.lag_segments(df).collect())
    assert got == list(range(200))


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_pcm_is_scaled(bits):
    import struct

    full = 1 << (bits - 1)
    ints = [0, full // 2, -full]
    raw = b"".join((v + 128).to_bytes(1, "little") if bits == 8 else v.to_bytes(bits // 8, "little", signed=True) for v in ints)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, 8000, 0, bits // 8, bits, b"data", len(raw))
    rate, mic, tap = wav.decode(head + raw)
    assert rate == 8000 and len(mic) == 0 and tap.tolist() == [0.0, 0.5, -1.0]


def test_bad_files_become_error_rows(spark):
    good = wav.encode_pcm16(np.array([0.5, 0.25]), np.array([-0.5, 0.0]), 16000)
    df = spark.createDataFrame([("g", good), ("b", b"nope")], "path string, content binary")
    got = {r.path: r for r in wav.frames_of(df, 10).collect()}
    assert got["b"].error and got["g"].error is None
    assert [round(v, 3) for v in got["g"].mic] == [0.5, 0.25]


@pytest.mark.parametrize("range_bytes", [64, 1000, 10**6])
def test_long_files_are_read_in_ranges(spark, tmp_path, range_bytes):
    """Whatever the ranges, frames are those of the whole file; a long file is many partitions."""
    import struct

    rng = np.random.default_rng(3)
    left, right = rng.uniform(-1, 1, 2345), rng.uniform(-1, 1, 2345)
    whole = wav.encode_pcm16(left, right, 16000)
    odd = whole[:12] + b"LIST" + struct.pack("<I", 5) + b"hello\0" + whole[12:] + b"junk after the data"
    mono = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 3, 1, 8000, 0, 4, 32, b"data", 4002) + left.astype("<f4").tobytes()[:4002]
    files = {"a.wav": whole, "deep/b.wav": odd, "m.WAV": mono, "bad.wav": b"RIFFxxxxWAVEfmt ", "none.wav": b"", "text.txt": whole}
    (tmp_path / "deep").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    df = wav.read_wav(spark, str(tmp_path), 100, range_bytes)
    found = {}
    for r in df.collect():
        found.setdefault(r.path.split("/")[-1], []).append(r)
    assert set(found) == {"a.wav", "b.wav", "m.WAV", "bad.wav", "none.wav"}
    for name in ("a.wav", "b.wav", "m.WAV"):
        _, mic, tap = wav.decode(files[name] if name in files else files["deep/b.wav"])
        rows = sorted(found[name], key=lambda r: r.frame_no)
        assert [r.frame_no for r in rows] == list(range(-(-len(tap) // 100)))
        assert [x for r in rows for x in r.tap] == tap.tolist() and [x for r in rows for x in r.mic] == mic.tolist()
    assert all(len(found[n]) == 1 and found[n][0].error for n in ("bad.wav", "none.wav"))
    assert df.rdd.getNumPartitions() == sum(-(-max(len(c), 1) // range_bytes) for n, c in files.items() if n != "text.txt")


def test_no_files_no_frames(spark, tmp_path):
    assert wav.read_wav(spark, str(tmp_path), 10).count() == 0


def test_regions_bridge_drop_and_cut(spark):
    on = [*range(0, 5), *range(6, 10), 20, *range(40, 75)]
    df = spark.createDataFrame([("r", i, 0.9) for i in on], "recording_id string, frame_no long, score double")
    for chunk in (3, 1000):
        got = signals.speech_regions(df, 0.1, 0.5, 0.2, 0.3, 2.0, chunk)
        assert sorted((round(r.start, 3), round(r.end, 3)) for r in got.collect()) == [(0.0, 1.0), (4.0, 6.0), (6.0, 7.5)]


def test_clusters_find_separate_voices(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((3, 16))
    rows = [("r", i, (centres[i % 3] + 0.02 * rng.standard_normal(16)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "recording_id string, vec_id long, embedding array<double>")
    for got in (speakers.by_threshold(spark, df, 0.9), speakers.by_threshold(spark, df, 0.9, block=7), speakers.pinned(spark, df, 3)):
        by = {}
        for r in got.collect():
            by.setdefault(r.speaker, set()).add(r.vec_id % 3)
        assert by == {"Them 1": {0}, "Them 2": {1}, "Them 3": {2}}


def test_links_are_exact_across_blocks(spark):
    """Chains of alike vectors hold together whatever blocks they fall into, and recordings stay apart."""
    rng = np.random.default_rng(5)
    vecs = rng.standard_normal((120, 6))
    rows = [(f"r{i % 2}", i, v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "recording_id string, vec_id long, embedding array<double>")
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    low = list(range(120))
    changed = True
    while changed:
        changed = False
        for i in range(120):
            for j in range(i % 2, 120, 2):
                if u[i] @ u[j] >= 0.8 and low[j] < low[i]:
                    low[i], changed = low[j], True
    for block in (5, 1000):
        got = {r.vec_id: r.comp for r in speakers.by_threshold(spark, df, 0.8, block).collect()}
        assert got == dict(enumerate(low))
    assert 2 < len(set(low)) < 118


def test_pinned_count_is_per_recording(spark):
    rows = [(f"r{i % 2}", i, [float(i % 3 == 0), float(i % 3 == 1), 0.1]) for i in range(12)] + [("one", 99, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "recording_id string, vec_id long, embedding array<double>")
    per = {}
    for r in speakers.pinned(spark, df, 3).collect():
        per.setdefault(r.recording_id, set()).add(r.speaker)
    assert {k: len(v) for k, v in per.items()} == {"r0": 3, "r1": 3, "one": 1}


def test_settled_recordings_take_no_more_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("still", i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(8)]
    rows += [("moving", i, [rng.gauss(0, 1) for _ in range(2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "recording_id string, vec_id long, embedding array<double>")
    seen, plain = [], speakers.settle

    def settle(spark, frame, name):
        out = plain(spark, frame, name)
        seen.append((name, out.count() if "centres" in name else 0))
        return out

    monkeypatch.setattr(speakers, "settle", settle)
    found = speakers.pinned(spark, df, 3)
    assert found.count() == len(rows)
    rounds = [n for name, n in seen if name == "centres"][1:]
    assert rounds[0] == 2 and rounds[-1] == 1 and len(rounds) > 2

    seen.clear()
    few = speakers.by_threshold(spark, df.filter("recording_id = 'still'"), 0.5)
    assert sorted((r.vec_id, r.comp, r.speaker) for r in few.collect()) == [(i, i % 2, f"Them {i % 2 + 1}") for i in range(8)]
    assert "comp" not in [name for name, _ in seen]
