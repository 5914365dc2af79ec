"""Queries over text normalizing, error rates, alignment and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.adapters import duck as d
from parley.adapters.tables import Tables, damaged
from parley.catalog.registry import query
from parley.functions import text
from parley.functions.flow import hold
from parley.operators import alignment, scoring, speakers
from parley.operators import transcripts as tr


@query(
    "normalized_documents",
    f"""SELECT doc_id, array_to_string(toks, ' ') AS normalized, len(toks)::BIGINT AS tokens
    FROM (SELECT doc_id, {d.normal_text("text")} AS toks FROM documents)""",
)
def normalized_documents(spark, sf):
    doc = Tables(spark, sf).raw("documents").select("doc_id", text.normal_tokens(F.col("text")).alias("t"))
    return hold(doc, "t").select("doc_id", F.array_join("t", " ").alias("normalized"), F.size("t").cast("long").alias("tokens"))


# Edit distance by dynamic programming over weights that count edits first and
# substitutions second.
def _weights(r: str, h: str) -> str:
    """Last cell of the weight table."""
    gap = f"(len({r}) + len({h}) + 1)"
    start = f"list_transform(range(len({h}) + 1), lambda j: j * {gap})"
    step = (
        "lambda row, tok: list_reduce("
        f"list_transform(range(1, len({h}) + 1), lambda j: [least(row[j + 1] + {gap}, row[j] + CASE WHEN {h}[j] = tok THEN 0 ELSE {gap} + 1 END)]), "
        f"lambda acc, c: list_append(acc, least(c[1], acc[len(acc)] + {gap})), [row[1] + {gap}])"
    )
    return f"list_reduce({r}, {step}, {start})[len({h}) + 1]"


_WER = f"""{d.PAIRS},
toks AS (SELECT fixture, damage, {d.normal_text("ref")} AS r, {d.normal_text("hyp")} AS h,
  list_filter(string_split_regex(ref, {d.WS}), lambda x: x <> '') AS rr,
  list_filter(string_split_regex(hyp, {d.WS}), lambda x: x <> '') AS rh FROM pairs),
dp AS (SELECT *, @NORM@ AS w, @RAW@ AS rw FROM toks),
scored AS (
  SELECT fixture, damage, len(r)::BIGINT AS ref_words, len(h)::BIGINT AS hyp_words,
         (w // (len(r) + len(h) + 1))::BIGINT AS errors, (w % (len(r) + len(h) + 1))::BIGINT AS substitutions,
         (rw // (len(rr) + len(rh) + 1))::BIGINT AS raw_errors, len(rr) AS raw_words FROM dp)""".replace(
    "@NORM@", _weights("r", "h")
).replace("@RAW@", _weights("rr", "rh"))


@query(
    "word_error_rates",
    f"""WITH {_WER}
    SELECT fixture, damage, ref_words, hyp_words, substitutions,
           (errors - substitutions + ref_words - hyp_words) // 2 AS deletions,
           (errors - substitutions - ref_words + hyp_words) // 2 AS insertions, errors, raw_errors,
           round(CASE WHEN ref_words > 0 THEN errors / ref_words END, 6) AS wer_normalized,
           round(CASE WHEN raw_words > 0 THEN raw_errors / raw_words END, 6) AS wer_raw FROM scored""",
)
def word_error_rates(spark, sf):
    out = scoring.word_error_rates(Tables(spark, sf).pairs)
    return out.select(
        "fixture", "damage", "ref_words", "hyp_words", "substitutions", "deletions", "insertions", "errors",
        "raw_errors", F.round("wer_normalized", 6).alias("wer_normalized"), F.round("wer_raw", 6).alias("wer_raw"),
    )


@query(
    "pooled_error_rates",
    f"""WITH {_WER}
    SELECT damage, round(avg(errors / ref_words), 6) AS mean_wer, round(sum(errors) / sum(ref_words), 6) AS pooled_wer,
           count(*) AS fixtures FROM scored WHERE ref_words > 0 GROUP BY damage""",
)
def pooled_error_rates(spark, sf):
    s = scoring.word_error_rates(Tables(spark, sf).pairs, details=False).filter("ref_words > 0")
    return scoring.pooled_error_rate(s, ["damage"]).select(
        "damage", F.round("mean_wer", 6).alias("mean_wer"), F.round("pooled_wer", 6).alias("pooled_wer"), "fixtures"
    )


@query("document_error_rates")
def document_error_rates(spark, sf):
    """Whole documents against damaged copies, with the kinds of edits; too long for the SQL table."""
    docs = Tables(spark, sf).raw("documents")
    pairs = docs.select("doc_id", F.col("text").alias("ref"), damaged(F.col("text"), F.col("doc_id") % 3).alias("hyp"))
    return scoring.word_error_rates(pairs).select(
        "doc_id", "ref_words", "hyp_words", "substitutions", "deletions", "insertions", "errors", "raw_errors", "wer_normalized", "wer_raw"
    )


@query(
    "transcript_text",
    f"""WITH {d.CALL} SELECT recording_id, string_agg(text, ' ' ORDER BY start, "end", channel * 1000000 + seq) AS text
    FROM segments GROUP BY recording_id""",
)
def transcript_text(spark, sf):
    return scoring.transcript_text(_segments(spark, sf), ["recording_id"])


def _segments(spark, sf):
    t = Tables(spark, sf)
    return tr.call_segments(t.words, t.turns).withColumn("seq", F.col("channel") * 1_000_000 + F.col("seq"))


_SPEAKER_KEY = "kind || ':' || coalesce(label, '')"


@query(
    "speaker_text",
    f"""WITH {d.CALL}, j AS (SELECT recording_id, {_SPEAKER_KEY} AS speaker_key,
         string_agg(text, ' ' ORDER BY start, "end", channel * 1000000 + seq) AS text FROM segments GROUP BY ALL)
    SELECT recording_id, speaker_key, array_to_string({d.normal_text("text")}, ' ') AS text FROM j""",
)
def speaker_text(spark, sf):
    return scoring.speaker_text(_segments(spark, sf), ["recording_id"])


def _speaker_sides(t: Tables):
    """Reference speakers by role, hypothesis speakers by a shifted labelling."""
    c = t.raw("conversations")
    call = F.concat(F.lit("c"), "conv_id").alias("recording_id")
    ref = c.select(call, F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text")
    label = F.concat(F.lit("Them "), F.when(F.col("turn") % 5 == 4, 9).otherwise(F.length("role")).cast("string"))
    hyp = c.select(
        call,
        F.col("turn").alias("seq"),
        (F.col("turn") * 10.0).alias("start"),
        (F.col("turn") * 10.0 + 5).alias("end"),
        tr.speaker("other", label).alias("speaker"),
        damaged(F.col("text"), F.col("turn") % 3).alias("text"),
    )
    keys = ["recording_id"]
    return scoring.reference_speaker_text(ref, keys), scoring.speaker_text(hyp, keys)


@query(
    "speaker_count_error",
    """WITH c AS (SELECT 'c' || conv_id AS recording_id, role,
         CASE WHEN turn % 5 = 4 THEN 9 ELSE length(role) END AS hyp FROM conversations)
    SELECT recording_id, count(DISTINCT role) AS ref_speakers, count(DISTINCT hyp) AS hyp_speakers,
           count(DISTINCT hyp) - count(DISTINCT role) AS speaker_count_error FROM c GROUP BY recording_id""",
)
def speaker_count_error(spark, sf):
    ref, hyp = _speaker_sides(Tables(spark, sf))
    return scoring.speaker_counts(ref, hyp, ["recording_id"])


# All distances of a recording's at most three speakers a side, and the cheapest
# of all ways to match them; who stays unmatched costs all of its words.
_SPEAKERS = f"""WITH
    hyp_turns AS (SELECT 'c' || conv_id AS id, turn, 'other:Them ' || CASE WHEN turn % 5 = 4 THEN 9 ELSE length(role) END AS who, {d.DAMAGED} AS text FROM conversations),
    refs AS (SELECT 'c' || conv_id AS id, role AS who, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY ALL),
    hyps AS (SELECT id, who, string_agg(text, ' ' ORDER BY turn) AS text FROM hyp_turns GROUP BY ALL),
    rt AS (SELECT id, who, {d.normal_text("text")} AS t, row_number() OVER (PARTITION BY id ORDER BY who) AS n FROM refs),
    ht AS (SELECT id, who, {d.normal_text("text")} AS t, row_number() OVER (PARTITION BY id ORDER BY who) AS n FROM hyps),
    counts AS (SELECT id, r.k AS ref_speakers, coalesce(h.k, 0) AS hyp_speakers, r.w AS ref_words, coalesce(h.w, 0) AS hyp_words
               FROM (SELECT id, count(*) AS k, sum(len(t)) AS w FROM rt GROUP BY id) r
               LEFT JOIN (SELECT id, count(*) AS k, sum(len(t)) AS w FROM ht GROUP BY id) h USING (id)),
    dist AS (SELECT id, rt.n AS a, ht.n AS b, @W@ // (len(rt.t) + len(ht.t) + 1) AS e FROM rt JOIN ht USING (id)),
    slots AS (SELECT id, a, b FROM counts CROSS JOIN (SELECT unnest([1, 2, 3]) AS a) CROSS JOIN (SELECT unnest([1, 2, 3]) AS b)),
    costs AS (SELECT s.id, s.a, s.b, coalesce(e, len(rt.t), len(ht.t), 0) AS e FROM slots s LEFT JOIN dist USING (id, a, b)
              LEFT JOIN rt ON rt.id = s.id AND rt.n = s.a LEFT JOIN ht ON ht.id = s.id AND ht.n = s.b),
    ways AS (SELECT * FROM (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) w(x, y, z)),
    best AS (SELECT p.id, min(p.e + q.e + r.e) AS errors FROM ways JOIN costs p ON p.a = 1 AND p.b = x
             JOIN costs q ON q.id = p.id AND q.a = 2 AND q.b = y JOIN costs r ON r.id = p.id AND r.a = 3 AND r.b = z GROUP BY p.id)
    SELECT id AS recording_id, ref_speakers, hyp_speakers, hyp_speakers - ref_speakers AS speaker_count_error,
           errors::BIGINT AS errors, ref_words::BIGINT AS ref_words, NULL::VARCHAR AS note,
           CASE WHEN ref_words > 0 THEN errors / ref_words END AS cpwer FROM counts JOIN best USING (id)""".replace("@W@", _weights("rt.t", "ht.t"))


@query("speaker_error_rates", _SPEAKERS)
def speaker_error_rates(spark, sf):
    ref, hyp = _speaker_sides(Tables(spark, sf))
    return scoring.speaker_error_rate(ref, hyp, ["recording_id"])


def _grams(text_col: str, key: str, table: str, n: int = 5) -> str:
    return f"""
{table}_toks AS (SELECT {key} AS key, {d.normal_text(text_col)} AS t FROM {table}),
{table}_grams AS (
  SELECT key, i - 1 AS pos, array_to_string(t[i:i + {n - 1}], ' ') AS gram
  FROM (SELECT key, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM {table}_toks WHERE len(t) >= {n}))"""


@query(
    "clip_alignment",
    f"""WITH {_grams("text", "item_id", "benchmark")},{_grams("text", "doc_id", "documents")},
    hits AS (SELECT b.key AS clip_id, r.key AS ref_id, b.pos AS cp, r.pos AS rp, r.pos - b.pos AS off
             FROM benchmark_grams b JOIN documents_grams r USING (gram)),
    isl AS (SELECT *, cp - row_number() OVER (PARTITION BY clip_id, ref_id, off ORDER BY cp) AS g FROM hits),
    runs AS (SELECT clip_id, ref_id, off, min(cp) AS clip_start, min(rp) AS ref_start, count(*) + 4 AS words
             FROM isl GROUP BY clip_id, ref_id, off, g)
    SELECT clip_id, ref_id, clip_start, ref_start, off AS "offset", words,
           count(*) OVER (PARTITION BY clip_id, ref_id) AS runs FROM runs
    QUALIFY row_number() OVER (PARTITION BY clip_id, ref_id ORDER BY words DESC, ref_start, clip_start) = 1""",
)
def clip_alignment(spark, sf):
    t = Tables(spark, sf)
    clips = alignment.shingles(
        t.raw("benchmark").withColumnRenamed("item_id", "clip_id"), "clip_id", text.normal_tokens(F.col("text"))
    )
    refs = alignment.shingles(
        t.raw("documents").withColumnRenamed("doc_id", "ref_id"), "ref_id", text.normal_tokens(F.col("text"))
    )
    return alignment.best_spans(alignment.clip_matches(clips, refs))


# Longest common run first, then left and right of it: each step takes the
# longest piece of a diagonal run inside an open rectangle.
_COVERAGE = f"""WITH RECURSIVE
    clips AS (SELECT item_id AS clip_id, {d.normal_text("text")} AS h FROM benchmark),
    refs AS (SELECT doc_id AS ref_id, text, {d.normal_text("text")} AS t FROM documents),
    clip_windows AS (SELECT clip_id, least(len(h), 5) AS n, unnest(range(1, len(h) - least(len(h), 5) + 2)) AS i, h FROM clips WHERE len(h) > 0),
    ref_windows AS (SELECT ref_id, n, unnest(range(1, len(t) - n + 2)) AS i, t
                    FROM refs CROSS JOIN (SELECT DISTINCT n FROM clip_windows) WHERE len(t) >= n),
    pairs AS (SELECT DISTINCT clip_id, ref_id
              FROM (SELECT clip_id, n, h[i:i + n - 1] AS gram FROM clip_windows)
              JOIN (SELECT ref_id, n, t[i:i + n - 1] AS gram FROM ref_windows) USING (n, gram)),
    raw AS (SELECT ref_id, list_filter(string_split_regex(text, {d.WS}), lambda x: x <> '') AS rr FROM refs
            WHERE ref_id IN (SELECT ref_id FROM pairs)),
    raw_words AS (SELECT ref_id, unnest(range(len(rr))) AS place, unnest(rr) AS raw_word FROM raw),
    raw_split AS (SELECT ref_id, place, {d.normal_text("raw_word")} AS ws FROM raw_words),
    raw_parts AS (SELECT ref_id, place, unnest(range(len(ws))) AS k, unnest(ws) AS w FROM raw_split),
    mapped AS (SELECT ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY place, k) - 1 AS p, place, w FROM raw_parts),
    hyp AS (SELECT clip_id, unnest(range(len(h))) AS p, unnest(h) AS w FROM clips),
    cells AS (SELECT clip_id, ref_id, m.p AS a, y.p AS b FROM pairs JOIN mapped m USING (ref_id) JOIN hyp y USING (clip_id) WHERE m.w = y.w),
    marked AS (SELECT *, a - row_number() OVER (PARTITION BY clip_id, ref_id, a - b ORDER BY a) AS g FROM cells),
    runs AS (SELECT clip_id, ref_id, a - b AS off, min(a) AS a, count(*) AS n FROM marked GROUP BY clip_id, ref_id, a - b, g),
    sizes AS (SELECT clip_id, ref_id, (SELECT count(*) FROM mapped m WHERE m.ref_id = pairs.ref_id) AS total, len(h) AS clip
              FROM pairs JOIN clips USING (clip_id)),
    rec AS (
      SELECT clip_id, ref_id, 0::BIGINT AS alo, total AS ahi, 0::BIGINT AS blo, clip::BIGINT AS bhi,
             0::BIGINT AS ba, 0::BIGINT AS bb, 0::BIGINT AS bn FROM sizes
      UNION ALL
      SELECT clip_id, ref_id, CASE side WHEN 0 THEN alo ELSE a + n END, CASE side WHEN 0 THEN a ELSE ahi END,
             CASE side WHEN 0 THEN blo ELSE b + n END, CASE side WHEN 0 THEN b ELSE bhi END,
             a, b, CASE side WHEN 0 THEN n ELSE 0 END
      FROM (SELECT clip_id, ref_id, alo, ahi, blo, bhi, best.n AS n, -best.a AS a, -best.b AS b
            FROM (SELECT clip_id, ref_id, alo, ahi, blo, bhi, max(struct_pack(n := e - s, a := -s, b := -(s - off))) AS best
                  FROM (SELECT r.clip_id, r.ref_id, alo, ahi, blo, bhi, u.off, greatest(u.a, alo, blo + u.off) AS s,
                               least(u.a + u.n, ahi, bhi + u.off) AS e
                        FROM rec r JOIN runs u ON u.clip_id = r.clip_id AND u.ref_id = r.ref_id WHERE ahi > alo AND bhi > blo)
                  WHERE e > s GROUP BY ALL))
      CROSS JOIN (SELECT unnest([0, 1]) AS side)),
    blocks AS (SELECT clip_id, ref_id, ba AS a, bb AS b, bn AS n FROM rec WHERE bn > 0),
    anchors AS (SELECT clip_id, ref_id, max(struct_pack(n := n, a := -a, shift := a - b)) AS m FROM blocks GROUP BY ALL),
    bounds AS (SELECT clip_id, ref_id, total, clip, greatest(m.shift, 0) AS low, least(total, greatest(m.shift, 0) + clip) AS high,
                      greatest(clip // 5, 50) AS margin FROM anchors JOIN sizes USING (clip_id, ref_id)),
    used AS (SELECT clip_id, ref_id, total, clip, min(a) AS a, max(a + n) AS z, sum(n) AS matched
             FROM blocks JOIN bounds USING (clip_id, ref_id) WHERE a >= low - margin AND a < high + margin GROUP BY ALL),
    spans AS (SELECT u.*, x.place AS raw_start, y.place AS raw_end FROM used u
              JOIN mapped x ON x.ref_id = u.ref_id AND x.p = u.a JOIN mapped y ON y.ref_id = u.ref_id AND y.p = u.z - 1)
    SELECT clip_id, ref_id, total AS ref_words_total, coalesce(clip, len(h))::BIGINT AS hyp_words, matched::BIGINT AS matched_words,
           round(matched / greatest(clip, 1), 4) AS coverage, raw_start, raw_end, raw_end - raw_start + 1 AS ref_span_words,
           array_to_string(rr[raw_start + 1:raw_end + 1], ' ') AS span_text,
           CASE WHEN matched IS NULL THEN 'no alignment between hypothesis and reference' END AS error,
           CASE WHEN matched IS NULL THEN 'unaligned' WHEN round(matched / greatest(clip, 1), 4) > 0.9 THEN 'clean'
                WHEN round(matched / greatest(clip, 1), 4) < 0.85 THEN 'suspect' ELSE 'borderline' END AS quality
    FROM clips LEFT JOIN spans USING (clip_id) LEFT JOIN raw USING (ref_id)"""


@query("clip_coverage", _COVERAGE)
def clip_coverage(spark, sf):
    """Exact span, coverage and class of each clip in every document that shares a window of it; a row with an error for other clips."""
    t = Tables(spark, sf)
    clips = t.raw("benchmark").select(F.col("item_id").alias("clip_id"), F.col("text").alias("hyp"))
    return alignment.located_clips(clips, t.raw("documents").select(F.col("doc_id").alias("ref_id"), F.col("text").alias("ref")))


@query(
    "coverage_classes",
    """WITH c AS (SELECT doc_id, (doc_id * 37 % 1001) / 1000.0::DOUBLE AS coverage FROM documents)
    SELECT CASE WHEN coverage > 0.9 THEN 'clean' WHEN coverage < 0.85 THEN 'suspect' ELSE 'borderline' END AS quality,
           count(*) AS clips FROM c GROUP BY ALL""",
)
def coverage_classes(spark, sf):
    c = Tables(spark, sf).raw("documents").select(((F.col("doc_id") * 37 % 1001) / 1000.0).alias("coverage"))
    return c.groupBy(alignment.coverage_class(F.col("coverage")).alias("quality")).agg(F.count(F.lit(1)).alias("clips"))


def _vectors(t: Tables):
    """Fifty voices a recording, each heard three times: whole, and twice with every fourth or fifth number missing."""
    e = t.raw("embeddings").select(F.col("vec_id").alias("voice"), "embedding", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("c"))
    hole = lambda i: (F.col("c") < 3) & ((i + F.col("voice")) % (F.col("c") + 3) == 0)
    return e.select(
        F.concat(F.lit("r"), F.floor(F.col("voice") / 50).cast("string")).alias("recording_id"),
        (F.col("voice") * 3 + F.col("c")).alias("vec_id"),
        F.transform("embedding", lambda x, i: F.when(hole(i), 0.0).otherwise(x.cast("double"))).alias("embedding"),
    )


@query(
    "speaker_clusters_by_threshold",
    """WITH RECURSIVE v AS (
      SELECT 'r' || vec_id // 50 AS recording_id, vec_id * 3 + c AS vec_id,
             list_transform(embedding, lambda x, i: CASE WHEN c < 3 AND (i - 1 + vec_id) % (c + 3) = 0 THEN 0::DOUBLE ELSE x::DOUBLE END) AS e
      FROM embeddings CROSS JOIN (SELECT unnest(range(1, 4)) AS c)),
    links AS (SELECT a.recording_id, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b USING (recording_id)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.5),
    reach AS (SELECT recording_id, vec_id AS a, vec_id AS b FROM v
      UNION SELECT r.recording_id, r.a, l.b FROM reach r JOIN links l ON l.recording_id = r.recording_id AND l.a = r.b),
    g AS (SELECT recording_id, a AS vec_id, min(b) AS comp FROM reach GROUP BY ALL)
    SELECT recording_id, vec_id, comp, 'Them ' || dense_rank() OVER (PARTITION BY recording_id ORDER BY comp) AS speaker FROM g""",
)
def speaker_clusters_by_threshold(spark, sf):
    v = _vectors(Tables(spark, sf))
    return speakers.by_threshold(spark, v, threshold=0.5).select("recording_id", "vec_id", "comp", "speaker")


@query("speaker_clusters_pinned")
def speaker_clusters_pinned(spark, sf):
    return speakers.pinned(spark, _vectors(Tables(spark, sf)), 10)


@query(
    "smoothed_turns",
    f"""WITH {d.TURNS},
    m AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY recording_id, label ORDER BY start, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 30
          THEN 0 ELSE 1 END AS brk FROM turns),
    r AS (SELECT *, sum(brk) OVER (PARTITION BY recording_id, label ORDER BY start, seq) AS run FROM m),
    g AS (SELECT recording_id, label, min(start) AS start, max("end") AS "end" FROM r GROUP BY recording_id, label, run)
    SELECT * FROM g WHERE "end" - start >= 10""",
)
def smoothed_turns(spark, sf):
    from parley.operators.sessions import smooth_turns

    return smooth_turns(Tables(spark, sf).turns, 10.0, 30.0, 1200.0).select("recording_id", "label", "start", "end")
