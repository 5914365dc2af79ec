"""Queries over words, turns and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.adapters import duck as d
from parley.adapters.tables import Tables
from parley.catalog.registry import query
from parley.operators import transcripts as tr
from parley.operators.ordered import CHUNK_ROWS
from parley.plans import calls
from parley.session import dealt
from parley.sinks import notes
from parley.sources import transcripts as src

SEG = ["recording_id", "channel", "seq", "start", "end", "text", "n_words"]
# Small chunks make the test tables cross chunk edges.
CHUNK = 2_500


def _long(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


@query(
    "utterances",
    f"""WITH {d.WORDS},{d.MINE}
    SELECT recording_id, channel::BIGINT AS channel, seq, start, "end", text, n_words FROM utterances""",
)
def utterances(spark, sf):
    return _long(tr.utterances(Tables(spark, sf).words, chunk_rows=CHUNK).select(*SEG), "channel")


@query(
    "word_turn_attribution",
    f"""WITH {d.WORDS},{d.TURNS},{d.LABELLED}
    SELECT recording_id, channel::BIGINT AS channel, seq, text, label FROM labelled""",
)
def word_turn_attribution(spark, sf):
    t = Tables(spark, sf)
    far = t.words.filter("channel <> 0")
    return _long(tr.attribute(far, t.turns).select("recording_id", "channel", "seq", "text", "label"), "channel")


@query(
    "diarized_utterances",
    f"""WITH {d.WORDS},{d.TURNS},{d.LABELLED},{d.FAR}
    SELECT recording_id, channel::BIGINT AS channel, seq, start, "end", label, text, n_words FROM far_utterances""",
)
def diarized_utterances(spark, sf):
    t = Tables(spark, sf)
    out = tr.diarized_utterances(t.words.filter("channel <> 0"), t.turns, chunk_rows=CHUNK)
    return _long(out.withColumn("label", F.col("speaker.label")).select(*SEG[:5], "label", *SEG[5:]), "channel")


@query(
    "call_timeline",
    f"""WITH {d.CALL}
    SELECT recording_id, start, "end", kind, label, text FROM segments ORDER BY recording_id, start, channel, seq""",
)
def call_timeline(spark, sf):
    t = Tables(spark, sf)
    return tr.timeline(tr.call_segments(t.words, t.turns)).select(
        "recording_id", "start", "end", "speaker.kind", "speaker.label", "text"
    )


_WHO = "CASE WHEN kind = 'me' THEN 'Me' ELSE label END"
MARKDOWN = f"""
call_ids AS (SELECT DISTINCT 'c' || conv_id AS recording_id FROM conversations),
parts AS (
  SELECT recording_id, CAST(floor(greatest(start, 0) / 3600) AS BIGINT) AS part, count(*) AS n_segments,
         string_agg({d.line("start", _WHO, "text")}, '' ORDER BY start, channel, seq) AS markdown
  FROM segments GROUP BY ALL),
rendered AS (
  SELECT recording_id, coalesce(part, 0) AS part, coalesce(markdown, '_(no speech transcribed)_' || chr(10)) AS markdown,
         coalesce(n_segments, 0) AS n_segments FROM call_ids LEFT JOIN parts USING (recording_id))"""


@query("transcript_markdown", f"WITH {d.CALL},{MARKDOWN} SELECT * FROM rendered")
def transcript_markdown(spark, sf):
    t = Tables(spark, sf)
    return calls.rendered_calls(t.call_ids, t.words, t.turns)


_APP = f"""apps AS (SELECT DISTINCT 'c' || conv_id AS recording_id, {d.app_name(d.pick(d.BUNDLES, f"conv_id % {len(d.BUNDLES)}"))} AS app FROM conversations)"""
_HEAD = "'> Auto-captured by recorder from ' || app || '.' || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10)"


def _apps(t: Tables):
    from parley.adapters.tables import pick
    from parley.functions.text import app_name

    return (
        t.raw("conversations")
        .select(
            F.concat(F.lit("c"), "conv_id").alias("recording_id"),
            app_name(pick(d.BUNDLES, F.col("conv_id") % len(d.BUNDLES))).alias("app"),
        )
        .distinct()
    )


@query(
    "note_documents",
    f"""WITH {d.CALL},{MARKDOWN},{_APP}
    SELECT recording_id, -1::BIGINT AS part, 'State: transcribed ' || chr(10) || chr(10) || {_HEAD} AS body FROM apps
    UNION ALL SELECT recording_id, part, markdown FROM rendered""",
)
def note_documents(spark, sf):
    t = Tables(spark, sf)
    return notes.note_parts(calls.rendered_calls(t.call_ids, t.words, t.turns), _apps(t))


_WINDOWED = """
w_words AS (SELECT *, CAST(floor(start / 300) AS BIGINT) AS window_no FROM words),
w_mine AS (
  SELECT *, CASE WHEN start - lag("end") OVER w <= 1.5 THEN 0 ELSE 1 END AS brk FROM w_words
  WINDOW w AS (PARTITION BY recording_id, channel, window_no ORDER BY seq)),
w_runs AS (
  SELECT *, sum(brk) OVER (PARTITION BY recording_id, channel, window_no ORDER BY seq) AS run FROM w_mine),
w_segments AS (
  SELECT recording_id, window_no, channel, min(seq) AS seq, min(start) AS start, max("end") AS "end",
         string_agg(text, ' ' ORDER BY seq) AS text FROM w_runs GROUP BY recording_id, window_no, channel, run),
w_notes AS (
  SELECT recording_id, window_no,
         string_agg({line}, '' ORDER BY start, channel, seq) AS markdown, count(*) AS n_segments
  FROM w_segments GROUP BY ALL)""".replace(
    "{line}", d.line("start", "CASE WHEN channel = 0 THEN 'Me' ELSE 'Them' END", "text")
)


@query(
    "windowed_segments",
    f"""WITH {d.WORDS},{_WINDOWED}
    SELECT recording_id, window_no, channel::BIGINT AS channel, seq, start, "end", text FROM w_segments""",
)
def windowed_segments(spark, sf):
    out = calls.windowed_segments(Tables(spark, sf).words, 300.0)
    return _long(out.select("recording_id", "window_no", "channel", "seq", "start", "end", "text"), "channel")


@query(
    "live_notes",
    f"""WITH {d.WORDS},{_WINDOWED},{_APP}
    SELECT recording_id, -1::BIGINT AS part, 'State: transcribing' || chr(10) || chr(10) || {_HEAD} AS body
    FROM apps WHERE recording_id IN (SELECT recording_id FROM w_notes)
    UNION ALL SELECT recording_id, window_no, markdown FROM w_notes""",
)
def live_notes(spark, sf):
    t = Tables(spark, sf)
    return notes.live_note_parts(calls.window_markdown(calls.windowed_segments(t.words, 300.0)), _apps(t))


# Items: words split from their trailing punctuation; every 23rd has no times.
_ITEMS = r"""
stripped AS (
  SELECT recording_id, channel, seq, start, "end", regexp_replace(text, '[.,!?]+$', '') AS word,
         regexp_extract(text, '[.,!?]+$') AS punct FROM words),
items AS (
  SELECT recording_id, channel, seq * 2 AS seq, 'pronunciation' AS type, word AS content,
         CASE WHEN seq % 23 <> 5 THEN start END AS start, "end" FROM stripped
  UNION ALL
  SELECT recording_id, channel, seq * 2 + 1, 'punctuation', punct, NULL, NULL FROM stripped WHERE punct <> '')"""
_GLUED = """
kept AS (
  SELECT *, CASE WHEN type = 'pronunciation' THEN 1 ELSE 0 END AS is_word FROM items
  WHERE content <> '' AND (type = 'punctuation' OR (start IS NOT NULL AND "end" IS NOT NULL))),
grouped AS (SELECT *, sum(is_word) OVER (PARTITION BY recording_id, channel ORDER BY seq) AS g FROM kept),
glued AS (
  SELECT recording_id, channel, min(seq) AS seq, max(start) AS start, max("end") AS "end",
         string_agg(content, '' ORDER BY seq) AS text FROM grouped WHERE g > 0 GROUP BY recording_id, channel, g)"""


def service_items(words):
    tail = r"[.,!?]+$"
    word = words.select(
        "recording_id",
        "channel",
        (F.col("seq") * 2).alias("seq"),
        F.lit("pronunciation").alias("type"),
        F.regexp_replace("text", tail, "").alias("content"),
        F.when(F.col("seq") % 23 != 5, F.col("start")).alias("start"),
        "end",
    )
    punct = words.select(
        "recording_id",
        "channel",
        (F.col("seq") * 2 + 1).alias("seq"),
        F.lit("punctuation").alias("type"),
        F.regexp_extract("text", tail, 0).alias("content"),
        F.lit(None).cast("double").alias("start"),
        F.lit(None).cast("double").alias("end"),
    ).filter("content <> ''")
    return word.unionByName(punct)


@query(
    "punctuation_glue",
    f"""WITH {d.WORDS},{_ITEMS},{_GLUED}
    SELECT recording_id, channel::BIGINT AS channel, seq, start, "end", text FROM glued""",
)
def punctuation_glue(spark, sf):
    items = service_items(Tables(spark, sf).words)
    out = tr.glue_punctuation(items, ["recording_id", "channel"], CHUNK)
    return _long(out.select("recording_id", "channel", "seq", "start", "end", "text"), "channel")


def service_json(words, channels: bool):
    """Service result documents built from the words."""
    items = service_items(words).withColumn(
        "item",
        F.struct(
            F.col("start").cast("string").alias("start_time"),
            F.when(F.col("type") == "pronunciation", F.col("end")).cast("string").alias("end_time"),
            "type",
            F.array(F.struct("content")).alias("alternatives"),
        ),
    )
    items = dealt(items, "recording_id")
    ordered = lambda: F.sort_array(F.collect_list(F.struct("seq", "item")))["item"]
    if channels:
        chan = items.groupBy("recording_id", "channel").agg(ordered().alias("items"))
        doc = chan.groupBy("recording_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct(F.concat(F.lit("ch_"), "channel").alias("channel_label"), "items")
                )
            ).alias("channels")
        )
        body = F.struct(F.struct(F.struct("channels").alias("channel_labels")).alias("results"))
    else:
        doc = items.filter("channel <> 0").groupBy("recording_id").agg(ordered().alias("items"))
        body = F.struct(F.struct("items").alias("results"))
    return doc.select("recording_id", F.to_json(body).alias("json"))


_SERVICE_SEGMENTS = """
s_marked AS (
  SELECT *, CASE WHEN start - lag("end") OVER w <= 1.5 THEN 0 ELSE 1 END AS brk FROM glued
  WINDOW w AS (PARTITION BY recording_id, channel ORDER BY seq)),
s_runs AS (SELECT *, sum(brk) OVER (PARTITION BY recording_id, channel ORDER BY seq) AS run FROM s_marked),
s_segments AS (
  SELECT recording_id, channel, min(start) AS start, max("end") AS "end", string_agg(text, ' ' ORDER BY seq) AS text
  FROM s_runs GROUP BY recording_id, channel, run)"""


@query(
    "service_json_channels",
    f"""WITH {d.WORDS},{_ITEMS},{_GLUED},{_SERVICE_SEGMENTS}
    SELECT recording_id, CASE WHEN channel = 0 THEN 'me' ELSE 'other' END AS kind, start, "end", text FROM s_segments""",
)
def service_json_channels(spark, sf):
    segs, _ = src.service_segments(service_json(Tables(spark, sf).words, True))
    return segs.select("recording_id", "speaker.kind", "start", "end", "text")


@query(
    "service_json_flat",
    f"""WITH {d.WORDS},{_ITEMS},{_GLUED},{_SERVICE_SEGMENTS}
    SELECT recording_id, 'Them' AS label, start, "end", text FROM s_segments WHERE channel <> 0""",
)
def service_json_flat(spark, sf):
    segs = src.flat_service_segments(service_json(Tables(spark, sf).words, False))
    return segs.select("recording_id", "speaker.label", "start", "end", "text")


@query(
    "service_json_rejects",
    f"""WITH {d.WORDS} SELECT DISTINCT recording_id, 'result has no channel labels' AS error
    FROM words WHERE channel <> 0""",
)
def service_json_rejects(spark, sf):
    _, rejects = src.service_segments(service_json(Tables(spark, sf).words, False))
    return rejects


# Subwords: words cut every three characters, the first piece marked. Every
# ninth word of a channel lacks its mark.
@query(
    "subword_join",
    f"""WITH {d.WORDS},
    opened AS (SELECT *, CASE WHEN seq % 9 <> 4 THEN 1 ELSE 0 END AS opens FROM words),
    grouped AS (SELECT *, sum(opens) OVER (PARTITION BY recording_id, channel ORDER BY seq) AS g FROM opened)
    SELECT recording_id, channel::BIGINT AS channel, min(seq) * 1000 AS seq, round(min(start) + 10, 3) AS start,
           round(max_by(start + ((length(text) - 1) // 3) * 0.1::DOUBLE + 0.1::DOUBLE, seq) + 10, 3) AS "end",
           string_agg(text, '' ORDER BY seq) AS text
    FROM grouped GROUP BY recording_id, channel, g""",
)
def subword_join(spark, sf):
    w = Tables(spark, sf).words
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 3).cast("int")),
        lambda i: F.substr(F.col("text"), i * 3 + 1, F.lit(3)),
    )
    toks = w.select(
        "recording_id", "channel", F.col("seq").alias("word_seq"), "start", F.posexplode(pieces).alias("i", "p")
    )
    mark = F.when((F.col("i") == 0) & (F.col("word_seq") % 9 != 4), tr.WORD_MARK).otherwise("")
    toks = toks.select(
        "recording_id",
        "channel",
        (F.col("word_seq") * 1000 + F.col("i")).alias("seq"),
        F.concat(mark, "p").alias("token"),
        (F.col("start") + F.col("i") * 0.1).alias("timestamp"),
        F.lit(0.1).alias("duration"),
        F.lit(10.0).alias("offset"),
    )
    out = tr.join_subwords(toks, ["recording_id", "channel"], CHUNK_ROWS)
    return _long(
        out.select(
            "recording_id", "channel", "seq", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text"
        ),
        "channel",
    )


@query(
    "same_speaker_merge",
    """WITH t AS (SELECT 'c' || conv_id AS fixture, turn AS seq, role AS speaker, text FROM conversations),
    m AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS brk FROM t
          WINDOW w AS (PARTITION BY fixture ORDER BY seq)),
    r AS (SELECT *, sum(brk) OVER (PARTITION BY fixture ORDER BY seq) AS run FROM m)
    SELECT fixture, min(seq) AS seq, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY seq) AS text
    FROM r GROUP BY fixture, run""",
)
def same_speaker_merge(spark, sf):
    c = Tables(spark, sf).raw("conversations")
    t = c.select(
        F.concat(F.lit("c"), "conv_id").alias("fixture"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text"
    )
    # Two turns per chunk: runs cross chunk edges.
    return tr.merge_same_speaker(t, ["fixture"], 2).select("fixture", "seq", "speaker", "text")


@query(
    "timed_word_fallback",
    f"""WITH t AS (SELECT conv_id, turn, text, {d.TOKENS} AS toks FROM conversations),
    w AS (SELECT 'c' || conv_id || '-' || turn AS recording_id, i AS seq, turn + i * 300 / 1000.0::DOUBLE AS start,
                 turn + (i * 300 + 250) / 1000.0::DOUBLE AS "end", tok AS text
          FROM (SELECT conv_id, turn, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM t WHERE turn % 3 = 0)),
    s AS (SELECT 'c' || conv_id || '-' || turn AS recording_id, 0::BIGINT AS seq, turn + 0.0::DOUBLE AS start,
                 turn + len(toks) * 300 / 1000.0::DOUBLE AS "end", array_to_string(toks, ' ') AS text
          FROM t WHERE turn % 3 = 1 AND len(toks) > 0),
    x AS (SELECT 'c' || conv_id || '-' || turn AS recording_id, 0::BIGINT AS seq, turn + 0.0::DOUBLE AS start,
                 turn + 0.0::DOUBLE AS "end", array_to_string(toks, ' ') AS text FROM t WHERE turn % 3 = 2 AND len(toks) > 0)
    SELECT recording_id, seq, round(start, 4) AS start, round("end", 4) AS "end", text
    FROM (SELECT * FROM w UNION ALL SELECT * FROM s UNION ALL SELECT * FROM x)""",
)
def timed_word_fallback(spark, sf):
    from parley.adapters.tables import tokens

    c = Tables(spark, sf).raw("conversations")
    row = "array<struct<t0_ms:bigint,t1_ms:bigint,text:string>>"
    toks = tokens(F.col("text"))
    i64 = lambda c_: c_.cast("long")
    words = F.transform(
        toks,
        lambda w, i: F.struct(
            i64(i * 300).alias("t0_ms"), i64(i * 300 + 250).alias("t1_ms"), w.alias("text")
        ),
    )
    whole = F.array_join(toks, " ")
    seg = F.array(F.struct(F.lit(0).cast("long").alias("t0_ms"), i64(F.size(toks) * 300).alias("t1_ms"), whole.alias("text")))
    rows = c.select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("recording_id"),
        F.when(F.col("turn") % 3 == 0, words).otherwise(F.array().cast(row)).alias("words"),
        F.when(F.col("turn") % 3 == 1, seg).otherwise(F.array().cast(row)).alias("segments"),
        whole.alias("text"),
        F.col("turn").cast("double").alias("offset"),
    )
    return tr.best_timed_words(rows).select(
        "recording_id", "seq", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "text"
    )


@query(
    "channel_speakers",
    f"""WITH {d.WORDS} SELECT CASE WHEN channel = 0 THEN 'me' ELSE 'other' END AS kind,
    CASE WHEN channel <> 0 THEN 'Them' END AS label, count(*) AS words, count(DISTINCT recording_id) AS calls
    FROM words GROUP BY ALL""",
)
def channel_speakers(spark, sf):
    w = Tables(spark, sf).words.withColumn("s", tr.channel_speaker(F.col("channel")))
    return w.groupBy(F.col("s.kind").alias("kind"), F.col("s.label").alias("label")).agg(
        F.count(F.lit(1)).alias("words"), F.count_distinct("recording_id").alias("calls")
    )
