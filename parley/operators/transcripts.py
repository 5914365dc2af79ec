"""Timed words to speaker-attributed segments.

words:    recording_id, channel, seq, start, end, text   (channel 0 is the recorder)
turns:    recording_id, seq, start, end, label
segments: recording_id, channel, seq, start, end, speaker struct<kind,label>, text, n_words

``seq`` is the list order inside (recording_id, channel) and is unique there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ordered import (
    CHUNK_ROWS,
    first,
    islands,
    joined,
    last,
    row_chunk,
    rows,
)

# Fixed value: a pause longer than this starts a new utterance.
PAUSE_SECS = 1.5
FAR_END = "Them"
_TURN_BUCKET_SECS = 30.0


def speaker(kind: Column | str, label: Column | None = None) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    v = F.lit(None).cast("string") if label is None else label
    return F.struct(k.alias("kind"), v.alias("label"))


def channel_speaker(channel: Column, label: Column | None = None) -> Column:
    """Channel 0 is the recorder; any other channel is the far end."""
    far = F.lit(FAR_END) if label is None else label
    return speaker(
        F.when(channel == 0, "me").otherwise("other"), F.when(channel != 0, far)
    )


def display_name(spk: Column) -> Column:
    return F.when(spk["kind"] == "me", "Me").otherwise(spk["label"])


def utterances(words: DataFrame, gap: float = PAUSE_SECS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Split each channel's words into utterances on pauses."""
    folded = islands(
        words.filter(F.col("text") != ""),
        ["recording_id", "channel"],
        ["seq"],
        row_chunk("seq", chunk_rows),
        ["start", "end"],
        lambda prev, cur: cur("start") - prev("end") > gap,
        {
            "seq": first("seq"),
            "start": first("start"),
            "end": last("end"),
            "text": joined("text", " "),
            "n_words": rows(),
        },
    )
    return folded.withColumn("speaker", channel_speaker(F.col("channel")))


def attribute(
    words: DataFrame,
    turns: DataFrame,
    fallback: str = FAR_END,
    bucket_secs: float = _TURN_BUCKET_SECS,
) -> DataFrame:
    """Label each word with the turn it overlaps most.

    Equal overlaps go to the later turn. A word that overlaps no turn takes
    the turn nearest to its midpoint, equal distances to the earlier turn. A
    recording without turns takes ``fallback``.

    Words meet turns only inside a (recording, time bucket). The nearest turn
    outside a word's bucket comes from one carried row per bucket.
    """
    b = F.lit(bucket_secs)
    bucket = lambda c: F.floor(c / b)
    mid = (F.col("start") + F.col("end")) / 2

    spread = turns.select(
        "recording_id",
        F.struct(
            F.col("start").alias("s"), F.col("end").alias("e"), F.col("seq").alias("q"), F.col("label").alias("l")
        ).alias("t"),
    )
    near = spread.withColumn(
        "_b",
        F.explode(F.sequence(bucket(F.col("t.s")), bucket(F.greatest(F.col("t.s"), F.col("t.e"))))),
    )

    known = ["recording_id", "channel", "seq"]
    rest = [c for c in words.columns if c not in known]
    keyed = words.select(
        *known,
        "start",
        "end",
        F.struct(*rest).alias("_word"),
        mid.alias("_mid"),
        bucket(mid).alias("_mb"),
    )
    touched = F.array_distinct(
        F.concat(
            F.sequence(bucket(F.col("start")), bucket(F.greatest(F.col("start"), F.col("end")))),
            F.array(F.col("_mb")),
        )
    )
    cells = keyed.withColumn("_b", F.explode(touched))
    carried = _carried_turns(spread, words.select("recording_id", bucket(mid).alias("_mb")), bucket)
    t = F.col("t")
    overlap = F.greatest(
        F.least(F.col("end"), t["e"]) - F.greatest(F.col("start"), t["s"]), F.lit(0.0)
    )
    met = cells.join(near, ["recording_id", "_b"], "left").join(
        carried.withColumnRenamed("_mb", "_b"), ["recording_id", "_b"], "left"
    )
    # The carried turns hold for the midpoint's bucket only.
    at_mid = F.col("_b") == F.col("_mb")
    m = F.col("_mid")
    away = lambda c: F.when(m < c["s"], c["s"] - m).when(m > c["e"], m - c["e"]).otherwise(0.0)
    rank = lambda c, hit: F.struct(
        F.when(hit, 1).otherwise(0).alias("hit"),
        F.when(hit, overlap).otherwise(-away(c)).alias("fit"),
        F.when(hit, c["q"]).otherwise(-c["q"]).alias("tie"),
        c["l"].alias("label"),
    )
    no = F.lit(False)
    best = F.array_max(
        F.array(
            F.when(t.isNotNull(), rank(t, overlap > 0)),
            F.when(at_mid & F.col("_before").isNotNull(), rank(F.col("_before"), no)),
            F.when(at_mid & F.col("_after").isNotNull(), rank(F.col("_after"), no)),
        )
    )
    return (
        met.select(*known, "_word", best.alias("_best"))
        .groupBy(*known)
        .agg(F.any_value("_word").alias("_word"), F.max("_best").alias("_best"))
        .select(
            *[F.col(c) if c in known else F.col("_word")[c].alias(c) for c in words.columns],
            F.coalesce(F.col("_best.label"), F.lit(fallback)).alias("label"),
        )
    )


def _carried_turns(spread: DataFrame, wanted: DataFrame, bucket) -> DataFrame:
    """Per word bucket: the last turn ending before it, the first starting after it."""
    none = F.lit(None).cast(spread.schema["t"].dataType)
    marks = (
        spread.select("recording_id", bucket(F.col("t.e")).alias("_mb"), F.col("t").alias("_e"), none.alias("_s"))
        .unionByName(
            spread.select("recording_id", bucket(F.col("t.s")).alias("_mb"), none.alias("_e"), F.col("t").alias("_s"))
        )
        .unionByName(wanted.select("recording_id", "_mb", none.alias("_e"), none.alias("_s")))
        .groupBy("recording_id", "_mb")
        .agg(
            F.max_by("_e", F.when(F.col("_e").isNotNull(), F.struct(F.col("_e.e"), -F.col("_e.q")))).alias("_ended"),
            F.min_by("_s", F.when(F.col("_s").isNotNull(), F.struct(F.col("_s.s"), F.col("_s.q")))).alias("_began"),
        )
    )
    by_time = Window.partitionBy("recording_id").orderBy("_mb")
    # Ends grow with the bucket, so the last marked bucket before holds the
    # greatest end; starts likewise on the other side.
    return marks.select(
        "recording_id",
        "_mb",
        F.last("_ended", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_began", ignorenulls=True).over(by_time.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )


def diarized_utterances(
    words: DataFrame,
    turns: DataFrame,
    gap: float = PAUSE_SECS,
    fallback: str = FAR_END,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Utterances that also break where the attributed speaker changes."""
    return label_utterances(attribute(words.filter(F.col("text") != ""), turns, fallback), gap, chunk_rows)


def label_utterances(labelled: DataFrame, gap: float = PAUSE_SECS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Utterances of labelled words; the recorder's words have a NULL label."""
    folded = islands(
        labelled.filter(F.col("text") != ""),
        ["recording_id", "channel"],
        ["seq"],
        row_chunk("seq", chunk_rows),
        ["start", "end", "label"],
        lambda prev, cur: ~cur("label").eqNullSafe(prev("label")) | (cur("start") - prev("end") > gap),
        {
            "seq": first("seq"),
            "start": first("start"),
            "end": last("end"),
            "label": first("label"),
            "text": joined("text", " "),
            "n_words": rows(),
        },
    )
    return folded.withColumn("speaker", channel_speaker(F.col("channel"), F.col("label"))).drop("label")


def call_segments(words: DataFrame, turns: DataFrame | None = None, gap: float = PAUSE_SECS) -> DataFrame:
    """Both sides of each call: recorder by pause, far end by pause or speaker."""
    if turns is None:
        return utterances(words, gap)
    spoken = words.filter(F.col("text") != "")
    mine = spoken.filter(F.col("channel") == 0).withColumn("label", F.lit(None).cast("string"))
    theirs = attribute(spoken.filter(F.col("channel") != 0), turns)
    return label_utterances(mine.unionByName(theirs), gap)


def timeline(segments: DataFrame) -> DataFrame:
    """One timeline per recording, stable by start; a range sort, not a per-key one."""
    return segments.orderBy("recording_id", "start", "channel", "seq")


def glue_punctuation(items: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Append punctuation items to the last kept word.

    items: keys, seq, type, content, start, end. Words without content or
    times are skipped; punctuation before the first kept word is dropped.
    """
    known = items.filter((F.col("content").isNotNull()) & (F.col("content") != ""))
    word = (F.col("type") != "punctuation") & F.col("start").isNotNull() & F.col("end").isNotNull()
    kept = known.withColumn("is_word", word).filter(F.col("is_word") | (F.col("type") == "punctuation"))
    folded = islands(
        kept,
        keys,
        ["seq"],
        row_chunk("seq", chunk_rows),
        ["is_word"],
        lambda prev, cur: cur("is_word"),
        {
            "seq": first("seq"),
            "is_word": first("is_word"),
            "start": first("start"),
            "end": first("end"),
            "text": joined("content", ""),
        },
    )
    return folded.filter("is_word").drop("is_word")


WORD_MARK = "▁"


def join_subwords(tokens: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Subword tokens to words.

    tokens: keys, seq, token, timestamp, duration, offset. A marked token
    starts a word; the word ends with its last token.
    """
    at = F.coalesce(F.col("timestamp"), F.lit(0.0)) + F.col("offset")
    timed = tokens.withColumn("_at", at).withColumn(
        "_to", at + F.coalesce(F.col("duration"), F.lit(0.0))
    )
    timed = timed.withColumn("_opens", F.col("token").startswith(WORD_MARK)).withColumn(
        "_text", F.regexp_replace("token", WORD_MARK, " ")
    )
    folded = islands(
        timed,
        keys,
        ["seq"],
        row_chunk("seq", chunk_rows),
        ["_opens"],
        lambda prev, cur: cur("_opens"),
        {
            "seq": first("seq"),
            "start": first("_at"),
            "end": last("_to"),
            "text": joined("_text", ""),
        },
    )
    return folded.withColumn("text", F.trim("text")).filter(F.col("text") != "")


def merge_same_speaker(turns: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Join consecutive turns of one speaker. turns: keys, seq, speaker, text."""
    return islands(
        turns,
        keys,
        ["seq"],
        row_chunk("seq", chunk_rows),
        ["speaker"],
        lambda prev, cur: cur("speaker") != prev("speaker"),
        {"seq": first("seq"), "speaker": first("speaker"), "text": joined("text", " ")},
    )


def best_timed_words(rows_: DataFrame) -> DataFrame:
    """Finest timing a decoder gave: words, else segments, else the bare text.

    rows: recording_id, words/segments array<struct<t0_ms,t1_ms,text>>, text,
    offset seconds.
    """
    off = F.col("offset")
    as_words = lambda a: F.filter(
        F.transform(
            F.coalesce(a, F.array().cast("array<struct<t0_ms:bigint,t1_ms:bigint,text:string>>")),
            lambda w: F.struct(
                (off + w["t0_ms"] / 1000.0).alias("start"),
                (off + w["t1_ms"] / 1000.0).alias("end"),
                F.trim(w["text"]).alias("text"),
            ),
        ),
        lambda w: w["text"] != "",
    )
    words, segs = as_words(F.col("words")), as_words(F.col("segments"))
    whole = F.filter(
        F.array(F.struct(off.alias("start"), off.alias("end"), F.trim("text").alias("text"))),
        lambda w: w["text"] != "",
    )
    best = F.when(F.size(words) > 0, words).when(F.size(segs) > 0, segs).otherwise(whole)
    return rows_.select("recording_id", F.posexplode(best).alias("seq", "w")).select(
        "recording_id", F.col("seq").cast("long").alias("seq"), "w.start", "w.end", "w.text"
    )
