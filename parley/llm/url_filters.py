"""URL filters: address rules first, then a model over the words of host and path.

A host name is often several words in one. A unigram model splits each of its
labels into the likeliest words (Viterbi), and a multinomial naive Bayes model
scores the words of host and path together.

Words come from three places: taught ones, the parts of host names between
hyphens, and the words of the pages. Only stretches of letters that occur
inside some host name are looked up, by a join on the stretch, so the word list
is as large as the corpus makes it and is never sent anywhere whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that lists of unwanted sites and directories of plain ones are full of; each is a lesson of its class.
UNWANTED = (
    "adult porn porno sex sexcam xxx escort escorts nude nudes hookup erotic fetish milf "
    "casino poker slots jackpot roulette blackjack bet bets betting wager lottery gambling "
    "pills viagra cialis steroids pharma meds "
    "ads adserver adserv advert adverts tracker tracking doubleclick popup popups clicks telemetry banners "
    "spam spammer scam scams phishing malware spyware trojan warez torrent torrents cracks keygen serials "
    "replica payday loans clickbait linkfarm doorway"
).split()
PLAIN = (
    "news daily wiki library city university college school museum garden home cooking recipes travel guide weather "
    "health clinic hospital pharmacy science physics maths history art arts music theatre film books review poetry sports football "
    "cycling running village town council state government law court bank insurance shop store market bakery hotel "
    "restaurant photo photos design code developer docs help support forum mail video games chess church family kids children "
    "parents teacher student research journal press magazine radio weekly events calendar map maps energy water forest river "
    "mountain animals birds dogs cats horses cars bikes trains software data "
    "essex sussex middlesex betty alphabet"
).split()


@dataclass(frozen=True)
class Filters:
    """``rules`` are (verdict, host, path) in any order; the longest that fits decides.

    A taught word counts as ``taught_share`` of all words seen when names are
    split; letters that are no known word are as likely as ``unknown``
    words, ten times less for every letter; words have at most ``longest``
    letters. Each class has ``mass`` words: up to the share ``heard`` from the
    hosts of the table, the others from its taught words. What a class hears
    is smoothed by ``background`` words of both, and a table of so many words
    is heard half as much as one without end. ``smoothing`` is added
    to every word. A row is blocked from ``block_at`` on, the probability that
    it is unwanted; ``unwanted`` is the share expected.
    """

    rules: tuple[tuple[str, str, str], ...] = ()
    block_words: Sequence[str] = field(default=tuple(UNWANTED))
    allow_words: Sequence[str] = field(default=tuple(PLAIN))
    longest: int = 20
    taught_share: float = 1e-5
    unknown: float = 10.0
    mass: float = 1000.0
    heard: float = 0.5
    background: float = 2000.0
    smoothing: float = 0.2
    unwanted: float = 0.1
    block_at: float = 0.5


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A to Z in lower case; '' without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both NULL if none does.

    A rule fits its host and all hosts below it if the path begins with the
    rule's. Of two rules of one length that fit, the one with the longer host
    wins, then the one that blocks.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    name = verdict = F.lit(None).cast("string")
    for decision, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


#: Letters of a host label beyond which it is no name any more (a DNS label has at most 63 octets): such a label is read in stretches of that length.
LABEL = 63


def labels_of(host: Column) -> Column:
    """Runs of letters of a host, in stretches of at most LABEL."""
    return F.regexp_extract_all(host, F.lit(rf"([a-z]{{1,{LABEL}}})"), 1)


def path_words(path: Column) -> Column:
    """Runs of letters of a path, in lower case and sorted."""
    return F.array_sort(F.regexp_extract_all(F.translate(path, UPPER, LOWER), F.lit("([a-z]+)"), 1))


def text_words(pages: DataFrame, html: str) -> DataFrame:
    """How often each run of letters stands in the pages, markup left out: word, n."""
    text = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), UPPER, LOWER), "<[^>]*>", " ")
    return pages.select(F.explode(F.split(text, "[^a-z]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def segmented(labels: list[str], known: list[dict[str, int]], total: float, how: Filters) -> list[list[str]]:
    """Each label's likeliest words under the unigram model. Of equally likely splits the one with the longest last word is taken."""
    floor = math.log(how.unknown / total)
    shrink = math.log(10)
    out = []
    for label, counts in zip(labels, known):
        best, back = [0.0], [0]
        for end in range(1, len(label) + 1):
            top, at = -math.inf, 0
            for start in range(max(0, end - how.longest), end):
                seen = counts.get(label[start:end])
                p = best[start] + (math.log(seen / total) if seen else floor - shrink * (end - start))
                if p > top:
                    top, at = p, start
            best.append(top)
            back.append(at)
        words, end = [], len(label)
        while end:
            words.append(label[back[end] : end])
            end = back[end]
        out.append(words[::-1])
    return out


def host_words(hosts: DataFrame, counts: DataFrame, how: Filters) -> DataFrame:
    """The words of each distinct host: (host, words), one row a host with a letter.

    ``counts`` is (word, n). Every stretch of at most ``longest`` letters of a
    label meets the count of the word it spells by a join on the stretch; a
    label brings at most LABEL x ``longest`` stretches and gets no more back.
    """
    total = float((counts.agg(F.sum("n")).first()[0] or 0) + 1)
    parts = hosts.select("host", F.posexplode(labels_of(F.col("host"))).alias("at", "label"))
    labels = parts.select("label").distinct()
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length("label")),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(how.longest), F.length("label") - i + 1)), lambda n: F.substring(F.col("label"), i, n)),
        )
    )
    stretches = labels.select("label", F.explode(F.array_distinct(spans)).alias("word"))
    known = stretches.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, known: pd.Series) -> pd.Series:
        seen = [{r["word"]: int(r["n"]) for r in rows} if rows is not None else {} for rows in known]
        return pd.Series(segmented(label.tolist(), seen, total, how))

    words = labels.join(known, "label", "left").select("label", split("label", "known").alias("words"))
    whole = parts.join(words, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("w"))
    return whole.select("host", F.flatten(F.col("w.words")).alias("words"))


def naive_bayes(cells: DataFrame, how: Filters) -> DataFrame:
    """Word weights, log P(word | unwanted) - log P(word | plain), from (word, unwanted, n).

    Both classes have one size, so a word never seen weighs nothing, however
    many plain hosts there are.
    """
    bad, good = [F.sum(F.when(F.col("unwanted") == b, F.col("n")).otherwise(0.0)) + how.smoothing for b in (True, False)]
    return cells.groupBy("word").agg((F.log(bad) - F.log(good)).alias("weight"))


def scored(bags: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the weights of the ``words`` of each row of ``bags`` (distinct in ``by``): by, score."""
    words = bags.select(*by, F.explode_outer("words").alias("word")).groupBy(*by, "word").agg(F.count("word").alias("times"))
    return words.join(weights, "word", "left").groupBy(*by).agg(F.sum(F.col("times") * F.coalesce("weight", F.lit(0.0))).alias("score"))


def judge(pages: DataFrame, how: Filters = Filters(), url: str = "url", html: str | None = "html") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict``, ``host_words`` and ``p_unwanted`` to every row.

    ``verdict`` is that of the longest rule that fits, else ``block`` if the
    model's probability that the address is unwanted is at least
    ``how.block_at``, else ``allow``. A NULL url and one without ``://`` have
    an empty host and path, no rule, no words, and the share expected as their
    probability. Ports and user names are part of the host as they stand.
    Repeated rows are judged alike; columns of these names are replaced.

    The model is fitted on the taught words and then once more with all hosts
    of the table as it judged them, each host once, however many rows it has.
    Only distinct (host, path words) pairs are scored; counts are added up
    before they move. Rows meet their scores by a join; a host with a third of
    all rows is a skewed key of that join, which adaptive execution splits.
    """
    spark = pages.sparkSession
    made = ("host", "path", "rule", "verdict", "host_words", "p_unwanted")
    keep = [c for c in pages.columns if c not in made]
    split = pages.select(*keep, host_of(F.col(url)).alias("_url_host"), path_of(F.col(url)).alias("_url_path"))
    bag = split.select(F.col("_url_host").alias("host"), path_words(F.col("_url_path")).alias("tail")).distinct()
    bag = settle(spark, bag, "addresses")
    hosts = bag.select("host").distinct()
    lessons = spark.createDataFrame(
        [(w, True, how.mass / len(how.block_words)) for w in how.block_words] + [(w, False, how.mass / len(how.allow_words)) for w in how.allow_words],
        "word string, unwanted boolean, n double",
    )
    parted = F.filter(F.split("host", "[.]"), lambda label: F.contains(label, F.lit("-")))
    seen = hosts.select(F.explode(labels_of(F.array_join(parted, "."))).alias("word"), F.lit(1).cast("long").alias("n"))
    if html is not None and html in pages.columns:
        seen = seen.unionByName(text_words(pages, html))
    counts = settle(spark, seen.groupBy("word").agg(F.sum("n").alias("n")), "words")
    share = F.lit(max(1, int((counts.agg(F.sum("n")).first()[0] or 0) * how.taught_share)))
    counts = counts.unionByName(lessons.select("word").distinct().select("word", share.cast("long").alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))
    words = settle(spark, host_words(hosts, counts, how), "host_words")
    prior = math.log(how.unwanted) - math.log(1 - how.unwanted)
    chance = lambda score: 1 / (1 + F.exp(-(F.coalesce(score, F.lit(0.0)) + prior)))
    first = scored(words, naive_bayes(lessons, how), ["host"]).select("host", chance(F.col("score")).alias("p"))
    verdicts = first.select("host", (F.col("p") >= how.block_at).alias("unwanted"))
    tails = bag.select("host", F.explode("tail").alias("word")).distinct()  # each path word once a host
    heard = words.select("host", F.explode("words").alias("word")).unionByName(tails).join(verdicts, "host")
    word = heard.groupBy("word").agg(F.count_if("unwanted").alias("bad"), F.count_if(~F.col("unwanted")).alias("good"))
    word = settle(spark, word, "heard")
    bad, good = [float(x or 0) for x in word.agg(F.sum("bad"), F.sum("good")).first()]
    heard_part = how.heard * (bad + good) / (bad + good + how.background)
    cells = lessons.withColumn("n", F.col("n") * (1 - heard_part))
    for unwanted, own, size in ((True, "bad", bad), (False, "good", good)):
        share = (F.col(own) + how.background * (F.col("bad") + F.col("good")) / max(bad + good, 1.0)) / (size + how.background)
        cells = cells.unionByName(word.select("word", F.lit(unwanted).alias("unwanted"), (share * how.mass * heard_part).alias("n")))
    weights = settle(spark, naive_bayes(cells, how), "word_weights")
    both = bag.join(words, "host", "left").select("host", "tail", F.concat(F.coalesce("words", F.array().cast("array<string>")), "tail").alias("words"))
    scores = scored(both, weights, ["host", "tail"]).select("host", "tail", chance(F.col("score")).alias("p"))
    scores = scores.join(words.withColumnRenamed("words", "parts"), "host", "left")
    scores = settle(spark, scores.select(F.col("host").alias("_url_of"), F.col("tail").alias("_url_tail"), F.col("p").alias("_url_p"), F.col("parts").alias("_url_words")), "address_scores")
    name, verdict = rule_of(F.col("_url_host"), F.col("_url_path"), how.rules)
    met = split.withColumn("_url_words_of", path_words(F.col("_url_path"))).join(
        scores, (F.col("_url_host") == F.col("_url_of")) & (F.col("_url_words_of") == F.col("_url_tail")), "left"
    )
    by_model = F.when(F.col("_url_p") >= how.block_at, "block").otherwise("allow")
    return met.select(
        *keep,
        F.col("_url_host").alias("host"),
        F.col("_url_path").alias("path"),
        name.alias("rule"),
        F.coalesce(verdict, by_model).alias("verdict"),
        F.coalesce("_url_words", F.array().cast("array<string>")).alias("host_words"),
        F.col("_url_p").alias("p_unwanted"),
    )
