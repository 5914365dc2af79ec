"""Text expressions: normalizing, labels, names and byte caps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parley.functions.flow import let

# Typographic characters folded before scoring.
FOLD_FROM = "‘’‛“”–—− "
FOLD_TO = "'''\"\"--- "
# Fixed value: spoken forms that count as the same word.
WORD_MAP = {"ok": "okay"}
# Fixed value: bracketed sound cues, letters only.
CUE = r"[\[(][a-zA-Z][a-zA-Z \t]*[\])]"
# Known conferencing apps in match order, and the helper prefix.
KNOWN_APPS = [
    ("us.zoom.xos", "Zoom"),
    ("com.tinyspeck.slackmacgap", "Slack"),
    ("com.google.Chrome.canary", "Chrome Canary"),
    ("com.google.Chrome", "Chrome"),
    ("org.mozilla.firefox", "Firefox"),
    ("com.hnc.Discord", "Discord"),
    ("com.microsoft.teams2", "Microsoft Teams"),
    ("com.microsoft.teams", "Microsoft Teams"),
    ("com.apple.FaceTime", "FaceTime"),
    ("com.apple.Safari", "Safari"),
    ("com.cisco.webexmeetingsapp", "Webex"),
]
SYSTEM_PREFIX = "com.apple."
UNKNOWN_APP = "Unknown app"
WEBINAR = "Webinar"

_WORD = r"\p{L}\p{N}_"
_ALNUM = r"[\p{L}\p{N}]"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition. Only rows that may change leave the JVM."""
    risky = text.rlike(r"[\x{0300}-\x{10FFFF}]")
    return F.when(risky, _compose(F.when(risky, text))).otherwise(text)


def drop_cues(text: Column) -> Column:
    """Replace bracketed cues by a space until none is left, however nested."""
    def finish(once: Column) -> Column:
        openings = F.length(F.regexp_replace(once, r"[^\[(]", ""))
        rest = F.aggregate(
            F.sequence(F.lit(1), F.greatest(openings, F.lit(1))),
            once,
            lambda acc, _: F.when(acc.rlike(CUE), F.regexp_replace(acc, CUE, " ")).otherwise(acc),
        )
        return F.when(once.rlike(CUE), rest).otherwise(once)

    return let(F.regexp_replace(text, CUE, " "), finish)


def normal_tokens(text: Column, composed: bool = False) -> Column:
    """Scoring tokens of a text; NULL gives an empty array.

    ``composed`` says that the text is already in composed form, which keeps
    the whole expression inside the JVM.
    """
    t = F.coalesce(text, F.lit(""))
    t = t if composed else nfc(t)
    t = F.lower(F.translate(t, FOLD_FROM, FOLD_TO))
    t = drop_cues(t)
    t = F.regexp_replace(t, rf"[^{_WORD}'\-]+", " ")
    t = F.regexp_replace(t, rf"(?<!{_ALNUM})['\-]|['\-](?!{_ALNUM})", " ")
    tokens = F.filter(F.split(t, " "), lambda w: w != "")
    for spoken, canonical in WORD_MAP.items():
        tokens = F.transform(
            tokens, lambda w: F.when(w == spoken, F.lit(canonical)).otherwise(w)
        )
    return tokens


def normalize(text: Column, composed: bool = False) -> Column:
    return F.array_join(normal_tokens(text, composed), " ")


def raw_tokens(text: Column) -> Column:
    """Whitespace tokens, otherwise verbatim."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    return F.array_join(raw_tokens(text), " ")


def known_app(bundle: Column) -> Column:
    """Name of a known app by exact id or ``id.`` prefix; first listed wins."""
    hit = None
    for base, name in KNOWN_APPS:
        test = (bundle == base) | bundle.startswith(base + ".")
        hit = F.when(test, name) if hit is None else hit.when(test, name)
    return hit


def is_system_helper(bundle: Column) -> Column:
    return bundle.startswith(SYSTEM_PREFIX)


def is_call_owner(bundle: Column) -> Column:
    return known_app(bundle).isNotNull() | ~is_system_helper(bundle)


def _capitalized(words: Column) -> Column:
    words = F.filter(words, lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))),
        " ",
    )


def humanize(bundle: Column) -> Column:
    """Readable name from the last dotted part of a bundle id."""
    part = F.substring_index(bundle, ".", -1)
    return F.when(part == "", bundle).otherwise(_capitalized(F.split(part, "[-_]")))


def humanize_slug(slug: Column) -> Column:
    return _capitalized(F.split(slug, "-"))


def app_name(bundle: Column) -> Column:
    return F.coalesce(known_app(bundle), humanize(bundle), F.lit(UNKNOWN_APP))


def yaml_safe(name: Column) -> Column:
    """A one-line plain scalar for a note header."""
    t = collapse(name)
    t = F.regexp_replace(t, r":(?= |$)", "-")
    t = _drop_comment_marks(t)
    t = F.regexp_replace(F.trim(t), r"^[#&*!|>%@,\-?:\[\]{}]+", "")
    t = F.trim(t)
    return F.when(t == "", UNKNOWN_APP).otherwise(t)


def _drop_comment_marks(t: Column) -> Column:
    # Quotes vanish before the blank in front of a '#' is looked at, so a
    # quoted blank still counts; repeated marks after one blank all go.
    t = F.regexp_replace(t, "[\"'`]", "")
    return F.regexp_replace(t, r"(?<= )#+", "")


def slug(name: Column) -> Column:
    t = F.regexp_replace(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]", "-")
    t = F.regexp_replace(t, "^-+|-+$", "")
    return F.when(t == "", "app").otherwise(t)


def job_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9a-zA-Z._-]", "-")


def cap_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, cut at a character edge, with an ellipsis.

    A character is kept when its last byte still fits, found by halving over
    character counts, so a long text is measured a few times, not per character.
    """
    steps = max(limit, 1).bit_length()
    low = F.aggregate(
        F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)]),
        F.lit(0),
        lambda n, step: F.when(
            F.octet_length(F.substr(text, F.lit(1), n + step)) <= limit,
            F.least(n + step, F.length(text)),
        ).otherwise(n),
    )
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.concat(F.substr(text, F.lit(1), low), F.lit("…"))
    )


def flag_arguments(flags: Column) -> Column:
    """Command arguments of a flag map (string values as in JSON).

    true gives the bare flag; false and null give nothing.
    """
    parts = F.transform(
        F.map_entries(flags),
        lambda e: F.when(e["value"] == "true", F.array(F.concat(F.lit("--"), e["key"])))
        .when(e["value"].isNull() | (e["value"] == "false"), F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("--"), e["key"]), e["value"])),
    )
    return F.flatten(parts)
