"""Queries with functions of the user's own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parley.adapters import duck as d
from parley.adapters.tables import Tables
from parley.catalog.registry import query
from parley.operators import hooks
from parley.operators import transcripts as tr
from parley.session import settle


def _length_gap(pairs: pd.DataFrame) -> pd.DataFrame:
    gap = (pairs["ref"].str.len() - pairs["hyp"].str.len()).abs()
    return pd.DataFrame({"gap": gap, "share": gap / pairs["ref"].str.len().clip(lower=1)})


@query(
    "scored_by_hook",
    f"""WITH {d.PAIRS} SELECT fixture, abs(length(ref) - length(hyp)) AS gap, round(abs(length(ref) - length(hyp)) / greatest(length(ref), 1), 6) AS share FROM pairs""",
)
def scored_by_hook(spark, sf):
    """A scorer of reference and hypothesis: by how many characters their lengths differ."""
    found = hooks.scored(Tables(spark, sf).pairs, hooks.Hook(_length_gap, ("ref", "hyp"), "gap long, share double"))
    return found.select("fixture", "gap", F.round("share", 6).alias("share"))


def _loudness(frames: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"score": [float(np.sqrt(np.mean(np.square(x)))) for x in frames["mic"]]})


@query(
    "frames_scored_by_hook",
    f"""WITH {d.FRAMES} SELECT recording_id, frame_no, round(sqrt(avg(mic * mic)), 6) AS score FROM frames GROUP BY recording_id, frame_no""",
)
def frames_scored_by_hook(spark, sf):
    """A frame scorer: the loudness of the microphone."""
    found = hooks.scored(Tables(spark, sf).frames, hooks.Hook(_loudness, ("mic",), "score double"))
    return found.select("recording_id", "frame_no", F.round("score", 6).alias("score"))


def _halves(words: pd.DataFrame) -> pd.DataFrame:
    """The first and the other words of a stretch as a turn each."""
    middle = len(words) // 2
    parts = [p for p in (words[:middle], words[middle:]) if len(p)]
    return pd.DataFrame({"start": [p["start"].min() for p in parts], "end": [p["end"].max() for p in parts], "label": [f"Them {n + 1}" for n in range(len(parts))]})


@query(
    "turns_by_hook",
    f"""WITH {d.WORDS},
    w AS (SELECT recording_id, start, "end", CAST(floor(start / 600) AS BIGINT) AS part, row_number() OVER (PARTITION BY recording_id, floor(start / 600) ORDER BY start) AS i,
                 count(*) OVER (PARTITION BY recording_id, floor(start / 600)) AS n FROM words WHERE channel = 1),
    t AS (SELECT recording_id, part, CASE WHEN i <= n // 2 THEN 0 ELSE 1 END AS half, any_value(n) AS n, min(start) AS start, max("end") AS "end", count(*) AS words FROM w GROUP BY ALL)
    SELECT recording_id, 'Them ' || CASE WHEN n = 1 THEN 1 ELSE half + 1 END AS label, start, "end", words FROM t""",
)
def turns_by_hook(spark, sf):
    """A turn provider over words of the far end, and how many words its turns are given."""
    far = Tables(spark, sf).words.filter("channel = 1")
    turns = settle(spark, hooks.provided_turns(far, hooks.Hook(_halves, ("start", "end"), "start double, end double, label string"), 600.0), "turns")
    words = tr.attribute(far, turns).groupBy("recording_id", "label", F.floor(F.col("start") / 600).alias("part")).agg(F.count("*").alias("words"))
    named = turns.withColumn("part", F.floor(F.col("start") / 600))
    return named.join(words, ["recording_id", "label", "part"]).select("recording_id", "label", "start", "end", "words")
