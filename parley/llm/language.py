"""Language identification by fusing evidence.

The text speaks through a letter-trigram model; beside it stand the language a
page or record declares, the suffix of its address and the languages its host
has published so far. All are put together by Bayes' rule. The host's prior is
smoothed towards its suffix and that towards the whole corpus; it and the
reliability of declarations and suffixes are grouped sums over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.flow import let
from parley.session import settle

#: Hashed trigrams of the text model, a power of two.
BINS = 1 << 15
#: Stands for every language the model does not know.
UNKNOWN = "und"
SPACE, APOSTROPHE = 32, 39
_LETTERS = bytes(
    b if b >= 128 or 97 <= b <= 122 or b == APOSTROPHE else b + 32 if 65 <= b <= 90 else SPACE for b in range(256)
)


@dataclass(frozen=True)
class Fusion:
    """Weights of the evidence.

    ``smoothing`` is how many rows of its parent a host or suffix counts as
    having seen; ``text_weight`` tempers the trigrams, which are not
    independent; ``unknown_prior`` is the share of rows in no known language;
    rows whose best posterior is below ``least`` are rejected.
    """

    smoothing: float = 20.0
    text_weight: float = 0.5
    unknown_prior: float = 1e-3
    least: float = 0.5


def _chunks(texts: pa.Array, bytes_each: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Trigram bins of consecutive texts, some at a time: first, last + 1, bins, text of each bin, letters of each text.

    Only letters count: case is folded for ASCII, all else but letters is one
    space, and trigrams of more than one space are left out. Texts are read
    from Arrow's memory one by one; what is held beside it is one chunk.
    """
    at = 0
    while at < len(texts):
        parts, owners, size, first = [], [], 0, at
        while at < len(texts) and (not parts or size < bytes_each):
            stored = texts[at].as_buffer()
            raw = b"" if stored is None else stored.to_pybytes()
            b = np.frombuffer(b" " + raw.translate(_LETTERS) + b" ", np.uint8)
            parts.append(b)
            owners.append(len(b))
            size += len(b)
            at += 1
        b = np.concatenate(parts).astype(np.uint32)
        owner = np.repeat(np.arange(at - first), owners)
        space = b == SPACE
        whole = (owner[:-2] == owner[2:]) & (space[:-2].astype(np.int8) + space[1:-1] + space[2:] < 2)
        bins = (((b[:-2] << np.uint32(16)) ^ (b[1:-1] << np.uint32(8)) ^ b[2:]) * np.uint32(2654435761)) >> np.uint32(17)
        yield first, at, bins[whole].astype(np.int64), owner[:-2][whole], np.bincount(owner[~space], minlength=at - first)


def fit_text_model(docs: DataFrame, languages: tuple[str, ...], text: str = "text", declared: str = "lang") -> np.ndarray:
    """Log-probabilities of the trigram bins, a row for each language.

    Counted over all rows that declare one of ``languages``: each task sums its
    rows, one grouped sum brings together at most languages x bins numbers.
    Every bin counts one row's trigram more than was seen.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BINS), np.int64)
        number = {name: n for n, name in enumerate(languages)}
        for batch in batches:
            row = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], int)
            for first, last, bins, owner, _ in _chunks(batch.column(0)):
                label = row[first:last][owner]
                known = label >= 0
                sums += np.bincount(label[known] * BINS + bins[known], minlength=sums.size).reshape(sums.shape)
        label, bins = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"label": label.astype("int32"), "bin": bins.astype("int32"), "n": sums[label, bins]})

    partial = docs.filter(F.col(declared).isin(*languages)).select(text, declared).mapInArrow(count, "label int, bin int, n long")
    sums = np.ones((len(languages), BINS))
    for label, b, n in partial.groupBy("label", "bin").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        sums[label, b] += n
    return np.log(sums / sums.sum(axis=1, keepdims=True))


def text_scores(model: np.ndarray, text: Column) -> Column:
    """Log-likelihood of a text under each language and, last, under none: an array.

    None is the even distribution over the bins. NULL if a text has no letters.
    """
    table = np.ascontiguousarray(np.vstack([model, np.full((1, BINS), -np.log(BINS))]).T)

    @F.arrow_udf("array<double>")
    def score(values: pa.Array) -> pa.Array:
        out: list = [None] * len(values)
        for first, last, bins, owner, letters in _chunks(values):
            sums = np.stack([np.bincount(owner, table[bins, k], last - first) for k in range(table.shape[1])], axis=1)
            for n in np.flatnonzero(letters):
                out[first + n] = sums[n].tolist()
        return pa.array(out, pa.list_(pa.float64()))

    return score(text)


def _softmax(values: Column) -> Column:
    def of(v: Column) -> Column:
        weights = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
        return let(weights, lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda s, y: s + y)))

    return let(values, of)


def identify(
    docs: DataFrame,
    languages: tuple[str, ...] = ("de", "en", "es", "fr"),
    text: str = "text",
    declared: str = "lang",
    host: str = "source",
    suffix: str | None = None,
    model: np.ndarray | None = None,
    fusion: Fusion = Fusion(),
) -> DataFrame:
    """Add ``language``, ``posterior``, ``text_language`` and ``accepted`` to every row.

    ``language`` is the one of the highest posterior, ``und`` if that is none of
    ``languages``; ``text_language`` is what the text alone says, NULL without
    letters. A row is accepted if its language is known, its posterior is at
    least ``fusion.least`` and its text has a letter. NULL, empty and letterless
    texts are rejected; a NULL declaration, suffix or host is one more value of
    its kind. Ties go to the language named first. Columns of these names are
    replaced, others kept.

    The evidence of a host, suffix and declaration is worked out once for each
    combination and joined back; rows of one host are added up before they
    move, and a host with a third of all rows is a skewed key that adaptive
    execution splits, as texts are joined only where the table of combinations
    is too large to be sent to all.
    """
    if model is None:
        model = fit_text_model(docs, languages, text, declared)
    k = len(languages) + 1
    keep = [c for c in docs.columns if c not in ("language", "posterior", "text_language", "accepted")]
    keys = {
        "_declared": F.coalesce(F.col(declared).cast("string"), F.lit("")),
        "_suffix": F.coalesce(F.col(suffix).cast("string"), F.lit("")) if suffix else F.lit(""),
        "_host": F.coalesce(F.col(host).cast("string"), F.lit("")),
    }
    scored = docs.select(*keep, *[v.alias(n) for n, v in keys.items()], text_scores(model, F.col(text)).alias("_scores"))
    each = range(k)
    own = _softmax(F.transform("_scores", lambda x: x * fusion.text_weight))
    soft = scored.filter("_scores is not null").select(*keys, own.alias("p"))
    cells = settle(docs.sparkSession, soft.groupBy(*keys).agg(*[F.sum(F.col("p")[i]).alias(f"c{i}") for i in each]), "languages")

    def sums(by: list[str], name: str) -> DataFrame:
        return cells.groupBy(*by).agg(F.array(*[F.sum(f"c{i}") for i in each]).alias(name))

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    overall = sums([], "_all").first()["_all"]
    base = np.array([x or 0.0 for x in (overall or [0.0] * k)])
    base = (base + 1.0) / (base.sum() + k)
    base = np.append(base[:-1] / base[:-1].sum() * (1 - fusion.unknown_prior), fusion.unknown_prior)
    corpus = F.array(*[F.lit(float(x)) for x in base])
    size = float(sum(x or 0.0 for x in (overall or [0.0])))

    def smoothed(counts: Column, parent: Column) -> Column:
        return F.zip_with(counts, parent, lambda n, p: (n + p * fusion.smoothing) / (total(counts) + fusion.smoothing))

    def reliability(counts: Column, kinds: int) -> Column:
        """log P(value | language): the value's share of each language's rows, one row added to every value."""
        per = F.array(*[F.lit(float(x * size)) for x in base])
        return F.zip_with(counts, per, lambda n, c: F.log((n + 1.0) / (c + float(max(kinds, 1)))))

    suffixes, declarations = sums(["_suffix"], "_s"), sums(["_declared"], "_d")
    kinds_s, kinds_d = suffixes.count(), declarations.count()
    suffix_says = reliability(F.col("_s"), kinds_s) if suffix else F.array_repeat(F.lit(0.0), k)
    priors = (
        cells.select(*keys)
        .join(sums(["_suffix", "_host"], "_h"), ["_suffix", "_host"])
        .join(suffixes, "_suffix")
        .join(declarations, "_declared")
        .select(
            *keys,
            F.zip_with(
                F.transform(smoothed(F.col("_h"), smoothed(F.col("_s"), corpus)), lambda x: F.log(x)),
                F.zip_with(suffix_says, reliability(F.col("_d"), kinds_d), lambda x, y: x + y),
                lambda x, y: x + y,
            ).alias("_prior"),
        )
    )
    names = F.array(*[F.lit(x) for x in (*languages, UNKNOWN)])
    at_most = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    fused = scored.join(priors, list(keys), "left").withColumn(
        "_p", _softmax(F.zip_with(F.transform("_scores", lambda x: x * fusion.text_weight), F.coalesce("_prior", F.transform(corpus, lambda x: F.log(x))), lambda x, y: x + y))
    )
    return fused.select(
        *keep,
        F.when(F.col("_scores").isNull(), F.lit(UNKNOWN)).otherwise(at_most(F.col("_p"))).alias("language"),
        F.when(F.col("_scores").isNull(), F.lit(0.0)).otherwise(F.array_max("_p")).alias("posterior"),
        at_most(F.col("_scores")).alias("text_language"),
    ).withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= fusion.least))


def page_evidence(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """The evidence a web page carries: ``declared`` (its markup's language), ``host``,
    ``suffix`` (the host's last label) and ``text`` (its markup taken out)."""
    html = F.coalesce(F.col(page), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return pages.select(
        "page_id",
        url,
        F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1), F.lit(""))).alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        text.alias("text"),
    )
