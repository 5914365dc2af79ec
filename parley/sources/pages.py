"""Labelled turns from transcript web pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parley.operators.transcripts import merge_same_speaker

# Words that end a sentence in capitals before a label.
GLUE_WORDS = ["OK", "NPR", "ISIS", "NSA", "AI", "FBI", "CIA", "US", "USA", "UK", "EU"]
# Fixed value: a label is capitals, digits, blank, dot, apostrophe, hyphen.
LABEL = r"[A-Z][A-Z0-9 .'\-]{1,40}?:"


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def body(page: Column, start_mark: str, end_mark: str) -> Column:
    """Text between two markers; NULL when either is missing."""
    begin = F.locate(start_mark, page)
    tail = F.substr(page, begin + len(start_mark))
    stop = F.locate(end_mark, tail)
    return F.when((begin > 0) & (stop > 0), F.substr(tail, F.lit(1), stop - 1))


def plain_text(markup: Column) -> Column:
    """Strip tags, resolve entities, drop bracketed cues."""
    bare = F.regexp_replace(markup, r"<[^>]+>", " ")
    text = F.when(F.contains(bare, F.lit("&")), unescape(F.when(F.contains(bare, F.lit("&")), bare))).otherwise(bare)
    return F.regexp_replace(text, r"\[[^\]]*\]", " ")


def labelled_turns(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Turns of plain page text: key, seq, speaker, text.

    A label that starts with a glued stop word gives that word back to the
    turn before it. The speaker is the label's last token. Turns without text
    are skipped and neighbours of one speaker are joined.
    """
    t = F.col(text)
    labels = F.regexp_extract_all(t, F.lit(f"({LABEL})"), 1)
    bodies = F.slice(F.split(t, LABEL), 2, F.greatest(F.size(F.split(t, LABEL)) - 1, F.lit(0)))
    rows = pages.select(key, F.posexplode(F.arrays_zip(labels.alias("label"), bodies.alias("body"))).alias("seq", "r"))
    raw = F.trim(F.regexp_replace(F.col("r.label"), ":$", ""))
    glue = r"^([A-Z]+)\.\s+(.+)$"
    word = F.regexp_extract(raw, glue, 1)
    glued = word.isin(*GLUE_WORDS)
    cut = rows.select(
        key,
        F.col("seq").cast("long").alias("seq"),
        F.when(glued, F.trim(F.regexp_extract(raw, glue, 2))).otherwise(raw).alias("_name"),
        F.when(glued, F.concat(word, F.lit("."))).alias("_give"),
        F.col("r.body").alias("_body"),
    )
    # One page is one document row, so its labels are few; the window is
    # bounded by the page it came from.
    page = Window.partitionBy(key).orderBy("seq")
    given = cut.withColumn("_got", F.lead("_give").over(page))
    whole = F.when(
        F.col("_got").isNotNull(), F.concat(F.regexp_replace("_body", r"(?U)\s+$", ""), F.lit(" "), "_got")
    ).otherwise(F.col("_body"))
    turns = given.select(
        key,
        "seq",
        F.element_at(F.split("_name", r"\s+"), -1).alias("speaker"),
        F.trim(F.regexp_replace(whole, r"(?U)\s+", " ")).alias("text"),
    ).filter(F.col("text") != "")
    return merge_same_speaker(turns, [key])
