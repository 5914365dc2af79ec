"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a column expression over the whole text, and every rule is a
share of two measures held against its limits, so the table becomes a single
projection without user functions: no shuffle, one pass over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.flow import let

SPACE = "[ \\t-\\r]"
WORD = "[^ \\t-\\r]+"

# Frequent function words of the four languages the rules are set for.
STOP_WORDS = {
    "en": "the of and to in is that for",
    "de": "der die und den von mit das ist",
    "fr": "la les et des une que du pour",
    "es": "que el los del las una se con",
}


@dataclass(frozen=True)
class Rule:
    """``part / whole`` must lie in [least, most]; texts of fewer words are not held to it."""

    name: str
    part: str
    whole: str
    least: float = 0.0
    most: float = float("inf")
    words: int = 10


RULES = (
    Rule("word_length", "word_chars", "n_words", least=2.0, most=12.0),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("exclamations", "n_exclamations", "n_words", most=0.3),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02, words=50),
    Rule("distinct_words", "n_distinct_words", "n_words", least=0.05, words=20),
    Rule("stutter", "n_stutters", "n_words", most=0.2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.4),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=0.9, words=50),
)


def _repeated(words: Column, window: int) -> Column:
    """Words that lie in a run of ``window`` words found twice or more.

    Runs are hashed. A text whose runs all differ, as of most texts, is done
    after that. For others the places of the repeated runs come from one sort
    of (hash, place), and each place covers up to ``window`` words not covered
    by the place before it.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - window)
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def cover(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(p, j)["h"] == F.get(p, i)["h"], F.lit(False))
            at = F.array_compact(F.transform(p, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])))
            return let(
                F.sort_array(at),
                lambda a: F.aggregate(
                    F.transform(a, lambda x, i: F.least(F.coalesce(F.get(a, i + 1) - x, F.lit(window)), F.lit(window))),
                    F.lit(0),
                    lambda s, x: s + x,
                ),
            )

        return let(pairs, places)

    return F.when(n < window + 1, F.lit(0)).otherwise(
        let(runs, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(cover(h)))
    )


def measures(text: str = "text", window: int = 5) -> Column:
    """All measures of a text as one struct; a NULL text measures as an empty one."""
    value = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    stop_pattern = "(?i)(?<![\\p{L}\\p{N}])(?:" + "|".join(stop) + ")(?![\\p{L}\\p{N}])"
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(WORD))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).alias("n_words"),
            F.char_length(F.array_join(words, "")).alias("word_chars"),
            F.size(F.array_distinct(words)).alias("n_distinct_words"),
            _repeated(words, window).alias("n_repeat_words"),
        )

    def of_lines(found: Column) -> Column:
        return F.struct(
            F.size(found).alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).alias("n_dup_lines"),
            F.size(F.filter(found, lambda line: line.rlike("^" + SPACE + "*[-*•+·]"))).alias("n_bullet_lines"),
        )

    words = F.array_remove(F.split(value, SPACE + "+"), "")
    return F.struct(
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(value, F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count(value, F.lit("!")).alias("n_exclamations"),
        F.regexp_count(value, F.lit(stop_pattern)).alias("n_stop_words"),
        F.regexp_count(value, F.lit("(?<!\\S)(\\S++)(?= +\\1(?!\\S))")).alias("n_stutters"),
    )


WORD_MEASURES = ("n_words", "word_chars", "n_distinct_words", "n_repeat_words")
LINE_MEASURES = ("n_lines", "n_dup_lines", "n_bullet_lines")
TEXT_MEASURES = ("n_symbols", "n_exclamations", "n_stop_words", "n_stutters")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of measures breaks."""

    def broken(rule: Rule) -> Column:
        share = F.col(rule.part) / F.col(rule.whole)
        outside = F.lit(False)
        if rule.least > 0:
            outside = outside | (share < rule.least)
        if rule.most != float("inf"):
            outside = outside | (share > rule.most)
        return F.when((F.col("n_words") >= rule.words) & (F.col(rule.whole) > 0) & outside, F.lit(rule.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """Add the measures, ``base_failed``, ``broken`` (rules that failed) and ``kept``.

    The base holds for every text: at least ``least_words`` words, and at most
    ``most_repeated`` percent of them in repeated runs. A NULL or empty text
    has no words and fails it. Columns of these names are replaced, others
    kept. Rows are judged one by one: nothing moves, equal rows get equal
    verdicts.
    """
    made = [*WORD_MEASURES, *LINE_MEASURES, *TEXT_MEASURES, "base_failed", "broken", "kept"]
    keep = [c for c in docs.columns if c not in made]
    # A generator of one element keeps Spark from writing the measures out once for each use.
    measured = docs.select(*keep, F.inline(F.array(F.struct(measures(text).alias("m")))))
    flat = measured.select(
        *keep,
        *[F.col(f"m.w.{c}").cast("long").alias(c) for c in WORD_MEASURES],
        *[F.col(f"m.l.{c}").cast("long").alias(c) for c in LINE_MEASURES],
        *[F.col(f"m.{c}").cast("long").alias(c) for c in TEXT_MEASURES],
    )
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return (
        flat.withColumn("base_failed", base)
        .withColumn("broken", compiled(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    )
