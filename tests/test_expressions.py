"""Column functions on hand cases."""

import pytest
from pyspark.sql import functions as F

from parley.functions import clock, maths, text
from parley.operators import recordings as ops


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v"))).first()[0]


@pytest.mark.parametrize("s,want", [(0.0, "00:00"), (5.4, "00:05"), (72.0, "01:12"), (3661.0, "1:01:01"), (-3.0, "00:00")])
def test_clock(spark, s, want):
    assert one(spark, clock.clock, s, "double") == want


@pytest.mark.parametrize("s,want", [(30, "30 s"), (3300, "55 min"), (3900, "1 h 05 min"), (7200, "2 h"), (None, ""), (-1, ""), (59, "59 s"), (3599, "1 h")])
def test_duration(spark, s, want):
    assert one(spark, clock.duration_text, s, "long") == want


APPS = [
    ("us.zoom.xos", "Zoom"),
    ("com.tinyspeck.slackmacgap.helper (Renderer)", "Slack"),
    ("com.google.Chrome.canary", "Chrome Canary"),
    ("com.google.Chrome.helper", "Chrome"),
    ("com.acme.SuperPhone", "SuperPhone"),
    ("org.example.cool-app", "Cool App"),
    ("com.google.Chromex", "Chromex"),
    (None, "Unknown app"),
]


@pytest.mark.parametrize("bundle,want", APPS)
def test_app_name(spark, bundle, want):
    assert one(spark, text.app_name, bundle) == want


YAML = [
    ("My Call: part 2", "My Call- part 2"),
    ("evil\ninjected: true", "evil injected- true"),
    ("#tag", "tag"),
    ('"quoted"', "quoted"),
    ("###", "Unknown app"),
    ("a #b", "a b"),
    ("x:", "x-"),
    ("10:30", "10:30"),
]


@pytest.mark.parametrize("raw,want", YAML)
def test_yaml_safe(spark, raw, want):
    assert one(spark, text.yaml_safe, raw) == want


def test_backoff(spark):
    df = spark.range(1, 80).select(maths.backoff(F.col("id"), 30, 3600).alias("s"))
    got = sorted(r.s for r in df.collect())
    assert got[:7] == [30, 60, 120, 240, 480, 960, 1920] and set(got[7:]) == {3600}


@pytest.mark.parametrize("raw,limit,want", [("abc", 3, "abc"), ("abcd", 3, "abc…"), ("éé", 3, "é…"), ("€€", 2, "…"), ("a€b", 4, "a€…")])
def test_byte_cap(spark, raw, limit, want):
    assert one(spark, lambda c: text.cap_bytes(c, limit), raw) == want


AGES = [
    ("done", "2026-05-29 11:59:30", "just concluded"),
    ("done", "2026-05-29 11:15:00", "45 min ago"),
    ("done", "2026-05-29 02:00:00", "10 hours ago"),
    ("done", "2026-05-28 23:00:00", "yesterday"),
    ("done", "2026-05-26 12:00:00", "3 days ago"),
    ("recording", "2026-05-29 11:00:00", "recording now"),
    ("done", "2026-05-29 13:00:00", "just concluded"),
]


@pytest.mark.parametrize("status,ended,want", AGES)
def test_relative_age(spark, status, ended, want):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    col = clock.relative_age(F.lit(status), ts(ended), ts(ended), ts("2026-05-29 12:00:00"))
    assert spark.range(1).select(col).first()[0] == want


def test_slug_and_titles(spark):
    at = F.lit("2026-05-29 14:05:00").cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    r = spark.range(1).select(
        ops.stem(F.lit("Microsoft Teams!"), at),
        ops.note_title(F.lit("Zoom"), F.lit("us.zoom.xos"), at),
        ops.note_title(F.lit("Webinar"), none, at),
        ops.mode(none, F.lit("Webinar")),
        ops.recording_id(F.lit("/x/20260529-a.b.wav"), at),
        ops.clean_path(F.lit("/x/y.wav")),
        ops.recording_id(F.lit(""), at),
    ).first()
    assert list(r) == [
        "20260529-140500-microsoft-teams", "Zoom call — 2026-05-29 14:05", "Webinar — 2026-05-29 14:05", "webinar",
        "20260529-a.b", "/x/y-clean.wav", "20260529-140500000",
    ]


def test_flag_arguments(spark):
    flags = F.create_map(F.lit("a"), F.lit("true"), F.lit("b"), F.lit("false"), F.lit("c"), F.lit("3"), F.lit("d"), F.lit(None).cast("string"))
    assert spark.range(1).select(text.flag_arguments(flags)).first()[0] == ["--a", "--c", "3"]


def test_offsets_to_utc(spark):
    got = [one(spark, lambda c: clock.utc_text(clock.parse_offset(c)), v) for v in ("2026-05-29T14:05:00.120+02:00", "junk")]
    assert got == ["2026-05-29T12:05:00.120Z", None]


def test_sample_limits(spark):
    assert [one(spark, maths.to_int16, v, "double") for v in (2.0, -2.0, 0.5, -0.00001)] == [32767, -32767, 16383, 0]


def test_provenance_holds_numbers_as_numbers(spark):
    import json

    from parley.operators import provenance

    rows = [("live", "local", 0.5, 4, True, 0.25), ("batch", "local", float("nan"), 2, False, float("inf")), ("batch", "cloud", 0.5, 1, True, 0.5), ("live", "local", None, None, None, None)]
    df = spark.createDataFrame(rows, "mode string, backend string, threshold double, threads int, diarize boolean, vad_threshold double")
    first, second, third, fourth = [json.loads(r.provenance)["made"] for r in provenance.build(df, "1").collect()]
    assert first["configuration"] == {
        "input": "live_pcm_stream", "threads": 4, "diarize_far_end": True, "speaker_attribution": "channels+diarizer", "threshold": 0.5, "vad_threshold": 0.25,
    }
    assert set(first["models"]) == {"asr", "vad", "diarization", "speaker_embedding"}
    assert (second["configuration"]["threshold"], second["configuration"]["vad_threshold"]) == ("NaN", "inf") and set(second["models"]) == {"asr", "vad"}
    assert third["configuration"] == {"input": "completed_recording", "speaker_attribution": "channel_identification"} and set(third["models"]) == {"asr"}
    assert fourth["configuration"] == {"input": "live_pcm_stream", "speaker_attribution": "channels"}


def test_scan_before_equals_a_running_fold(spark):
    import random

    from parley.operators.ordered import scan_before

    rng = random.Random(2)
    rows = [(n, rng.randrange(100)) for n in rng.sample(range(-50, 400), 120)]
    df = spark.createDataFrame(rows, "n long, v long").repartition(3)
    for how, fold in (("sum", sum), ("min", min), ("max", max)):
        for levels in (0, 1, 2, 3):
            got = {r.n: r.x for r in scan_before(df, "n", "v", how, "x", span=7, levels=levels).collect()}
            assert got == {n: fold([v for m, v in rows if m < n]) if any(m < n for m, _ in rows) else None for n, _ in rows}


def test_documents_of_one_file_keep_apart(spark, tmp_path):
    from parley.sources.transcripts import read_transcripts

    doc = '{{{}"segments":[{{"speaker":{{"kind":"me"}},"start":1.0,"end":2.0,"text":"{}"}}]}}'
    (tmp_path / "calls.json").write_text("\n".join([doc.format('"recording_id":"r1",', "a"), doc.format("", "b"), doc.format("", "c"), ""]))
    got = read_transcripts(spark, str(tmp_path), multi_line=False).collect()
    assert len({r.recording_id for r in got}) == 3 and {r.text for r in got if r.recording_id == "r1"} == {"a"}
    assert all(r.recording_id == "r1" or r.recording_id.startswith("calls:") for r in got)
