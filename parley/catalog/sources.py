"""Queries that go through the readers and writers.

Each one first lets Spark write files from a driver table into the shared
scratch folder, then reads them back with the library's reader.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.adapters import duck as d
from parley.adapters.tables import Tables, pick
from parley.catalog.registry import query
from parley.operators import provenance, reports
from parley.operators.ordered import in_order
from parley.session import scratch
from parley.sources import pages, sweeps, tables, transcripts, wav


def _segment_json(t: Tables, wrapped: bool):
    """One transcript document per conversation; every fifth turn lacks times."""
    c = t.raw("conversations")
    seg = F.struct(
        F.struct(F.when(F.col("role") == "user", "me").otherwise("other").alias("kind"), F.col("role").alias("label")).alias("speaker"),
        F.when(F.col("turn") % 5 != 3, F.col("turn") * 10.0).alias("start"),
        F.when(F.col("turn") % 5 != 3, F.col("turn") * 10.0 + 5).alias("end"),
        "text",
    )
    doc = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", seg.alias("s"))))["s"].alias("segments"))
    body = F.struct("segments")
    return doc.select("conv_id", F.to_json(F.struct(body.alias("transcript")) if wrapped else body).alias("json"))


_DOC_SQL = """SELECT {id} AS recording_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CASE WHEN role = 'user' THEN 'me' ELSE 'other' END AS kind,
  CASE WHEN turn % 5 <> 3 THEN turn * 10.0::DOUBLE ELSE 0 END AS start, CASE WHEN turn % 5 <> 3 THEN turn * 10.0::DOUBLE + 5 ELSE 0 END AS "end", text FROM conversations"""


@query("transcript_documents", _DOC_SQL.format(id="'c' || conv_id"))
def transcript_documents(spark, sf):
    """Bare and wrapped documents in one table."""
    t = Tables(spark, sf)
    both = _segment_json(t, False).filter("conv_id % 2 = 0").unionByName(_segment_json(t, True).filter("conv_id % 2 = 1"))
    segs = transcripts.parse_transcripts(both.select(F.concat(F.lit("c"), "conv_id").alias("recording_id"), "json"))
    return segs.select("recording_id", "seq", "speaker.kind", "start", "end", "text")


@query(
    "transcript_files",
    """SELECT 'c' || conv_id AS recording_id, CASE WHEN role = 'user' THEN 'me' ELSE 'other' END AS kind, CASE WHEN turn % 5 <> 3 THEN turn * 10.0::DOUBLE ELSE 0 END AS start, text FROM conversations""",
)
def transcript_files(spark, sf):
    """Document files, fifty documents a file, one per line."""
    path = scratch(spark, "transcripts")
    docs = _segment_json(Tables(spark, sf), True).withColumn("part", F.floor(F.col("conv_id") / 50))
    docs = docs.withColumn("json", F.concat(F.lit('{"recording_id":"c'), "conv_id", F.lit('",'), F.expr("substring(json, 2)")))
    docs.repartition("part").select("part", "json").write.partitionBy("part").text(path)
    segs = transcripts.read_transcripts(spark, f"{path}/*", multi_line=False)
    return segs.select("recording_id", "speaker.kind", "start", "text")


@query(
    "reference_texts",
    """SELECT doc_id // 100 AS part, md5(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents GROUP BY 1""",
)
def reference_texts(spark, sf):
    """Whole texts through files, a hundred documents a file."""
    path = scratch(spark, "texts")
    doc = Tables(spark, sf).raw("documents").withColumn("part", F.floor(F.col("doc_id") / 100))
    whole = doc.groupBy("part").agg(in_order(F.col("text"), F.col("doc_id")).alias("t"))
    whole.select("part", F.array_join("t", "\n").alias("value")).write.partitionBy("part").text(path)
    texts = transcripts.read_reference_text(spark, path)
    return texts.select(F.col("part").cast("long").alias("part"), F.md5("text").alias("digest"))


@query(
    "reference_turns",
    "SELECT 'c' || conv_id AS fixture, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role AS speaker, text FROM conversations",
)
def reference_turns(spark, sf):
    c = Tables(spark, sf).raw("conversations")
    turn = F.struct("turn", F.col("role").alias("speaker"), "text")
    doc = c.groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text")))).alias("json"))
    path = scratch(spark, "turns")
    named = doc.select(F.concat(F.lit("c"), "conv_id").alias("fixture"), F.col("json").alias("value"))
    named.repartition("fixture").write.partitionBy("fixture").text(path)
    return transcripts.read_reference_turns(spark, path)


_NAMES = ["ALEX STONE", "STONE", "OK.  MARIA DEL-RIO", "DR. O'NEIL"]


def _labelled_pages(t: Tables):
    """Conversations as web pages with capital labels, cues, tags and entities."""
    c = t.raw("conversations")
    line = F.concat(
        F.lit("<p> "), pick(_NAMES, F.col("turn") % 4), F.lit(": [MUSIC] "), F.lower("text"), F.lit(" &amp; <b>so</b> on</p>\n")
    )
    body = c.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", line.alias("l"))))["l"], "").alias("b"))
    return body.select(
        F.concat(F.lit("c"), "conv_id").alias("page_id"),
        F.concat(F.lit('<html><i>X: no</i><div class="transcript">'), "b", F.lit('<p class="disclaimer">OUT: no</p></html>')).alias("html"),
    )


_CLEAN_TURN = r"trim(regexp_replace(lower(text) || ' & so on', '\s+', ' ', 'g'))"


@query(
    "page_turns",
    rf"""WITH t AS (SELECT 'c' || conv_id AS page_id, turn, CASE turn % 4 WHEN 0 THEN 'STONE' WHEN 1 THEN 'STONE' WHEN 2 THEN 'DEL-RIO' ELSE 'O''NEIL' END AS speaker,
      {_CLEAN_TURN} || CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) % 4 = 2 THEN ' OK.' ELSE '' END AS text FROM conversations),
    m AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS brk FROM t WINDOW w AS (PARTITION BY page_id ORDER BY turn)),
    r AS (SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY turn) AS run FROM m)
    SELECT page_id, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY turn) AS text FROM r GROUP BY page_id, run""",
)
def page_turns(spark, sf):
    p = _labelled_pages(Tables(spark, sf))
    inner = pages.body(F.col("html"), '<div class="transcript">', '<p class="disclaimer">')
    plain = p.select("page_id", pages.plain_text(inner).alias("text"))
    return pages.labelled_turns(plain, "page_id", "text").select("page_id", "speaker", "text")


# The entities that the pages hold.
_PAGE_TEXT = r"""regexp_replace(html, '<[^>]+>', ' ', 'g')"""
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _PAGE_TEXT = f"replace({_PAGE_TEXT}, '{_entity}', '{_char}')"


@query("page_text", rf"""SELECT page_id, trim(regexp_replace(regexp_replace({_PAGE_TEXT}, '\[[^\]]*\]', ' ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, sf):
    """Visible text of the raw pages: tags out, entities resolved, cues dropped."""
    p = Tables(spark, sf).raw("pages")
    return p.select("page_id", F.trim(F.regexp_replace(pages.plain_text(F.col("html")), r"(?U)\s+", " ")).alias("text"))


@query(
    "sweep_result_files",
    f"WITH {d.RESULTS} SELECT run, fixture, ok, wer_norm, asr_ms, flags FROM results",
)
def sweep_result_files(spark, sf):
    """Rows appended in two rounds as JSON lines, read back with one schema."""
    path = scratch(spark, "results")
    r = Tables(spark, sf).results
    row = r.select("run", "fixture", "ok", "wer_norm", "asr_ms", "flags", "k")
    sweeps.append_results(row.filter("k % 2 = 0").drop("k"), path)
    done = sweeps.read_results(spark, path)
    todo = reports.pending_cells(r.select("run").distinct(), r.select("fixture").distinct(), done)
    sweeps.append_results(row.join(todo, ["run", "fixture"]).drop("k"), path)
    return sweeps.read_results(spark, path).select("run", "fixture", "ok", "wer_norm", "asr_ms", "flags")


@query(
    "sweep_specification",
    """SELECT 'run' || p_partkey AS run, '{"beam":' || p_size || '}' AS flags FROM part""",
)
def sweep_specification(spark, sf):
    path = scratch(spark, "spec")
    p = Tables(spark, sf).raw("part")
    run = F.struct(F.concat(F.lit("run"), "p_partkey").alias("name"), F.struct(F.col("p_size").alias("beam")).alias("flags"))
    # A specification of a hundred runs a file.
    spec = p.groupBy(F.floor(F.col("p_partkey") / 100).alias("g")).agg(F.collect_list(run).alias("runs"))
    spec.select("g", F.lit("asr").alias("mode"), "runs").repartition("g").write.partitionBy("g").json(path)
    runs, _ = sweeps.read_spec(spark, path)
    return runs.select("run", "flags")


@query(
    "corpus_manifest",
    """SELECT lang AS source, 'd' || doc_id AS id, n_chars / 10.0::DOUBLE AS duration_s, n_chars AS ref_word_count FROM documents""",
)
def corpus_manifest(spark, sf):
    path = scratch(spark, "manifest")
    doc = Tables(spark, sf).raw("documents")
    ep = F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), (F.col("n_chars") / 10.0).alias("duration_s"), F.col("n_chars").alias("ref_word_count"))
    # One manifest line per hundred documents of a language.
    doc.groupBy("lang", F.floor(F.col("doc_id") / 100).alias("g")).agg(F.collect_list(ep).alias("episodes")).select(
        F.col("lang").alias("source"), "episodes"
    ).write.json(path)
    return sweeps.read_manifest(spark, path, multi_line=False).select("source", "id", "duration_s", "ref_word_count")


@query(
    "state_tables",
    f"WITH {d.RECORDINGS} SELECT id, status, (epoch_us(started_at) // 1000) AS started_at, transcribe_secs FROM recordings",
)
def state_tables(spark, sf):
    path = scratch(spark, "recordings")
    Tables(spark, sf).recordings.drop("k", "_w").write.parquet(path)
    from parley.functions.clock import millis

    r = tables.read_recordings(spark, path)
    return r.select("id", "status", millis(F.col("started_at")).alias("started_at"), "transcribe_secs")


@query(
    "job_tables",
    f"WITH {d.JOBS} SELECT id, kind, state, attempts::BIGINT AS attempts, epoch_us(next_run_at) // 1000 AS next_run_at, period_secs::BIGINT AS period_secs, last_error FROM jobs",
)
def job_tables(spark, sf):
    from parley.functions.clock import millis

    path = scratch(spark, "jobs")
    Tables(spark, sf).jobs.write.parquet(path)
    j = tables.read_jobs(spark, path)
    return j.select("id", "kind", "state", F.col("attempts").cast("long").alias("attempts"), millis(F.col("next_run_at")).alias("next_run_at"), "period_secs", "last_error")


@query(
    "stats_feed",
    """SELECT 'user' || user_id AS backend, count(*) AS snapshots, round(max(value), 6) AS peak_rss, sum(2)::BIGINT AS threads FROM events GROUP BY 1""",
)
def stats_feed(spark, sf):
    path = scratch(spark, "stats")
    e = Tables(spark, sf).raw("events")
    thread = lambda n: F.struct(F.lit(n).alias("name"), F.col("value").alias("cpu_pct"))
    e.select(
        F.col("event_id").cast("string").alias("timestamp"), F.concat(F.lit("user"), "user_id").alias("backend"),
        F.col("value").alias("rss_mb"), F.array(thread("app-a"), thread("os-b")).alias("threads"),
    ).write.json(path)
    s = tables.read_stats(spark, path)
    return s.groupBy("backend").agg(
        F.count(F.lit(1)).alias("snapshots"), F.round(F.max("rss_mb"), 6).alias("peak_rss"), F.sum(F.size("threads")).alias("threads")
    )


@query(
    "place_dimension",
    """SELECT n_name AS name, r_name AS region, CASE WHEN n_nationkey % 3 = 0 THEN 'all-party' ELSE 'one-party' END AS consent FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def place_dimension(spark, sf):
    """A jurisdiction file written from the nations and read as a dimension."""
    path = scratch(spark, "places")
    t = Tables(spark, sf)
    place = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"),
        F.lit("country").alias("scope"), F.when(F.col("n_nationkey") % 3 == 0, "all-party").otherwise("one-party").alias("consent"),
    )
    # A dimension of a few dozen rows: one array document.
    place.agg(F.to_json(F.collect_list(F.struct(*place.columns))).alias("value")).write.text(path)
    return tables.read_jurisdictions(spark, path).select("name", "region", "consent")


@query(
    "file_listing",
    "SELECT lang, count(*) AS documents FROM documents GROUP BY lang",
)
def file_listing(spark, sf):
    """Files listed without reading them, checked against what was written."""
    path = scratch(spark, "listing")
    doc = Tables(spark, sf).raw("documents")
    doc.select("lang", "doc_id").write.partitionBy("lang").parquet(path)
    files = wav.listing(spark, path).filter("path LIKE '%.parquet' AND length > 0")
    langs = files.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).distinct()
    return spark.read.parquet(path).join(langs, "lang", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "provenance_header_lines",
    """SELECT conv_id, turn, 1::BIGINT AS lines FROM conversations""",
)
def provenance_header_lines(spark, sf):
    """Header lines stay one line whatever the configured text holds."""
    c = Tables(spark, sf).raw("conversations")
    conf = c.select(
        "conv_id", "turn", F.lit("batch").alias("mode"), F.concat(F.lit("x\n---\ny: "), "text").alias("backend"),
        F.lit(0.5).alias("threshold"), F.lit(2).alias("threads"), F.lit(False).alias("diarize"),
    )
    line = provenance.header_line(F.col("provenance"))
    one = provenance.build(conf, "1.0").withColumn("line", line)
    return one.select("conv_id", "turn", (F.size(F.split("line", "\n")) - 1).cast("long").alias("lines"))
