"""Queries over sweeps, consent and jurisdictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.adapters import duck as d
from parley.adapters.tables import Tables, pick
from parley.catalog.registry import query
from parley.functions import text
from parley.operators import consent, reports
from parley.sources.tables import jurisdictions

_MEANS = f"""{d.RESULTS},
means AS (
  SELECT run, avg(wer_norm) AS wer, avg(peak_rss_mb) AS rss_mb, avg(asr_ms) AS asr_ms, min_by(flags, fixture_ord) AS flags, count(*) AS fixtures
  FROM results WHERE coalesce(ok, FALSE) GROUP BY run)"""


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("ok_rows", f"WITH {d.RESULTS} SELECT run, fixture FROM results WHERE coalesce(ok, FALSE)")
def ok_rows(spark, sf):
    return reports.scored_rows(Tables(spark, sf).results).select("run", "fixture")


@query(
    "run_means",
    f"WITH {_MEANS} SELECT run, round(wer, 6) AS wer, round(rss_mb, 6) AS rss_mb, round(asr_ms, 6) AS asr_ms, flags, fixtures FROM means",
)
def run_means(spark, sf):
    return _r(reports.run_means(Tables(spark, sf).results), "wer", "rss_mb", "asr_ms")


@query(
    "baseline_deltas",
    f"""WITH {_MEANS} SELECT run, round(wer - coalesce((SELECT wer FROM means WHERE run = 'baseline'), 0), 6) AS delta_wer FROM means""",
)
def baseline_deltas(spark, sf):
    m = reports.run_means(Tables(spark, sf).results)
    return _r(reports.baseline_delta(m).select("run", "delta_wer"), "delta_wer")


@query(
    "pareto_front",
    f"""WITH {_MEANS} SELECT run, round(wer, 6) AS wer, round(rss_mb, 6) AS rss_mb FROM means m
    WHERE NOT EXISTS (SELECT 1 FROM means o WHERE o.wer <= m.wer AND o.rss_mb <= m.rss_mb AND (o.wer, o.rss_mb) <> (m.wer, m.rss_mb))""",
)
def pareto_front(spark, sf):
    m = reports.run_means(Tables(spark, sf).results)
    front = reports.pareto_front(m.select("run", "wer", "rss_mb"), "wer", "rss_mb", 0.05)
    return _r(front.select("run", "wer", "rss_mb"), "wer", "rss_mb")


@query(
    "pareto_front_events",
    """WITH p AS (SELECT event_id, value AS x, ((event_id * 7919) % 10007)::DOUBLE AS y FROM events),
    lo AS (SELECT *, min(y) OVER (ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS before,
                  min(y) OVER (PARTITION BY x) AS same FROM p)
    SELECT event_id, x, y FROM lo WHERE y = same AND (before IS NULL OR before > y)""",
)
def pareto_front_events(spark, sf):
    """The same operator over every event."""
    e = Tables(spark, sf).raw("events").select(
        "event_id", F.col("value").alias("x"), ((F.col("event_id") * 7919) % 10007).cast("double").alias("y")
    )
    return reports.pareto_front(e, "x", "y", 0.5).select("event_id", "x", "y")


@query(
    "pending_cells",
    f"""WITH {d.RESULTS}, runs AS (SELECT DISTINCT run FROM results),
    fx AS (SELECT DISTINCT event_type AS fixture FROM events), done AS (SELECT run, fixture FROM results WHERE k % 3 <> 0)
    SELECT run, fixture FROM runs CROSS JOIN fx EXCEPT SELECT run, fixture FROM done""",
)
def pending_cells(spark, sf):
    r = Tables(spark, sf).results
    return reports.pending_cells(
        r.select("run").distinct(), r.select("fixture").distinct(), r.filter("k % 3 <> 0")
    )


def _echo_results(t: Tables):
    """All fixtures of each run, two of them echo only, with some ratios missing or zero."""
    r = t.results
    k = F.col("k")
    erle = F.struct(
        F.when(k % 5 == 0, 0.0).when(k % 7 != 0, F.col("wer_norm") * 10).alias("erle_db"),
        (F.col("wer_raw") * 3).alias("near_seg_snr_db"),
        F.when(k % 4 != 0, F.col("wer_norm") / 2).alias("near_correlation"),
    )
    return r.select("run", F.when(F.col("fixture").isin("click", "error"), "echoonly").otherwise("doubletalk").alias("fixture"), "ok", erle.alias("erle"))


@query(
    "echo_run_table",
    f"""WITH {d.RESULTS}, e AS (SELECT run, CASE WHEN fixture IN ('click', 'error') THEN 'echoonly' ELSE 'doubletalk' END AS fixture,
      CASE WHEN k % 5 = 0 THEN 0 WHEN k % 7 <> 0 THEN wer_norm * 10 END AS erle, wer_raw * 3 AS snr, CASE WHEN k % 4 <> 0 THEN wer_norm / 2 END AS c
      FROM results WHERE coalesce(ok, FALSE)),
    g AS (SELECT run, max(erle) FILTER (fixture = 'echoonly') AS eo, max(erle) FILTER (fixture = 'doubletalk') AS dt,
          max(snr) FILTER (fixture = 'doubletalk') AS sn, max(c) FILTER (fixture = 'doubletalk') AS co FROM e GROUP BY run)
    SELECT run, round(eo, 6) AS echo_only_erle, round(dt, 6) AS double_talk_erle, round(sn, 6) AS double_talk_snr, round(co, 6) AS double_talk_corr,
           round(CASE WHEN eo IS NULL OR eo = 0 THEN -99 ELSE eo END, 6) AS rank_key FROM g""",
)
def echo_run_table(spark, sf):
    t = reports.echo_table(_echo_results(Tables(spark, sf)))
    return _r(t, "echo_only_erle", "double_talk_erle", "double_talk_snr", "double_talk_corr", "rank_key")


@query(
    "speaker_run_table",
    f"""WITH {d.RESULTS} SELECT run, fixture, CASE WHEN k % 3 <> 0 THEN wer_norm END AS cpwer, 7 AS ref_speakers, (k % 20)::INTEGER AS hyp_speakers,
    (k % 20 - 7)::INTEGER AS speaker_count_error, peak_rss_mb AS rss_mb, flags FROM results WHERE coalesce(ok, FALSE)""",
)
def speaker_run_table(spark, sf):
    k = F.col("k")
    r = Tables(spark, sf).results.withColumn(
        "cpwer",
        F.struct(
            F.when(k % 3 != 0, F.col("wer_norm")).alias("cpwer"),
            F.lit(7).alias("ref_speakers"),
            (k % 20).cast("int").alias("hyp_speakers"),
            (k % 20 - 7).cast("int").alias("speaker_count_error"),
        ),
    )
    return reports.speaker_table(r)


@query(
    "engine_comparison",
    """WITH x AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS engine, 'u' || user_id AS fixture, value * 1000 AS ms,
      1000 + event_id % 300 AS rss, (event_id % 10) / 100.0::DOUBLE AS wer FROM events),
    g AS (SELECT fixture, avg(ms) FILTER (engine = 'a') AS bm, avg(ms) FILTER (engine = 'b') AS cm, avg(rss) FILTER (engine = 'a') AS br,
          avg(rss) FILTER (engine = 'b') AS cr, avg(wer) FILTER (engine = 'a') AS bw, avg(wer) FILTER (engine = 'b') AS cw FROM x GROUP BY fixture)
    SELECT fixture, round(bm, 6) AS base_ms, round(cm, 6) AS cand_ms, round(CASE WHEN cm > 0 THEN bm / cm END, 6) AS speedup,
           round(CASE WHEN br > 0 THEN (cr - br) / br END, 6) AS rss_change, round(abs(bw - cw), 6) AS wer_gap FROM g""",
)
def engine_comparison(spark, sf):
    k = F.col("event_id")
    rows = Tables(spark, sf).raw("events").select(
        F.when(k % 2 == 0, "a").otherwise("b").alias("engine"),
        F.concat(F.lit("u"), "user_id").alias("fixture"),
        (F.col("value") * 1000).alias("asr_ms"),
        (1000 + k % 300).alias("peak_rss_bytes"),
        ((k % 10) / 100.0).alias("wer_normalized"),
    )
    return _r(reports.engine_comparison(rows, "a", "b"), "base_ms", "cand_ms", "speedup", "rss_change", "wer_gap")


@query(
    "engine_artifacts",
    """WITH c AS (SELECT DISTINCT p_partkey, 'm' || p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'gpu' END AS asr_engine, p_size % 5 = 0 AS emb FROM part)
    SELECT id, asr_engine FROM c WHERE (asr_engine IS NULL OR asr_engine = 'cpu') AND (NOT emb OR id = 'm10')""",
)
def engine_artifacts(spark, sf):
    s = F.col("p_size")
    cat = Tables(spark, sf).raw("part").select(
        F.concat(F.lit("m"), "p_partkey").alias("id"),
        F.when(s % 3 == 0, "cpu").when(s % 3 == 1, "gpu").alias("asr_engine"),
        (s % 5 == 0).alias("is_embedding"),
    )
    return reports.artifact_catalog(cat, "cpu", "m10").select("id", "asr_engine")


@query(
    "stage_timing",
    f"""WITH {d.STAGES} SELECT stage, backend, count(*) AS runs, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms FROM stages GROUP BY ALL""",
)
def stage_timing(spark, sf):
    return _r(reports.stage_timing(Tables(spark, sf).stages), "mean_ms").drop("median_ms")


_STAGE = d.pick(["recording", "cancelling_echo", "transcribing", "filing", "idle"], "event_id % 5")


@query(
    "active_boxes",
    f"""WITH e AS (SELECT {_STAGE} AS stage, event_id % 3 = 0 AS rec FROM events),
    b AS (SELECT stage, rec, concat_ws(',', CASE WHEN rec OR stage = 'recording' THEN 'detect,capture' END, CASE WHEN stage IN ('cancelling_echo', 'transcribing') THEN 'echo' END,
      CASE WHEN stage = 'transcribing' THEN 'transcribe' END, CASE WHEN stage = 'filing' THEN 'file' END) AS boxes FROM e)
    SELECT stage, rec, boxes, count(*) AS n FROM b GROUP BY ALL""",
)
def active_boxes(spark, sf):
    e = Tables(spark, sf).raw("events").select(
        pick(["recording", "cancelling_echo", "transcribing", "filing", "idle"], F.col("event_id") % 5).alias("stage"),
        (F.col("event_id") % 3 == 0).alias("rec"),
    )
    boxes = F.array_join(reports.active_boxes(F.col("stage"), F.col("rec")), ",")
    return e.groupBy("stage", "rec", boxes.alias("boxes")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flag_arguments",
    """WITH p AS (SELECT p_partkey, p_size, p_brand FROM part)
    SELECT p_partkey, concat_ws(' ', CASE WHEN p_size % 3 = 0 THEN '--diarize' END, '--brand', p_brand, CASE WHEN p_size % 2 = 0 THEN '--threads ' || p_size END) AS args FROM p""",
)
def flag_arguments(spark, sf):
    p = Tables(spark, sf).raw("part")
    flags = F.create_map(
        F.lit("diarize"), F.when(F.col("p_size") % 3 == 0, "true").otherwise("false"),
        F.lit("brand"), F.col("p_brand"),
        F.lit("threads"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")),
    )
    return p.select("p_partkey", F.array_join(text.flag_arguments(flags), " ").alias("args"))


_RESOLVED = f"""{d.PARTIES},
res AS (
  SELECT p.call_id, p.ord, p.medium, p.jurisdiction_id, coalesce(j.name, 'Somewhere else / not sure') AS name, coalesce(j.region, 'Unknown') AS region,
         coalesce(j.scope, 'country') AS scope, coalesce(j.consent, 'unknown') AS consent, coalesce(j.source_disagreement, FALSE) AS sd,
         CASE WHEN j.consent = 'mixed' THEN coalesce(CASE WHEN medium = 'phone' THEN j.phone_rule ELSE j.in_person_rule END, 'mixed') ELSE coalesce(j.consent, 'unknown') END AS rule
  FROM parties p LEFT JOIN jurisdictions j ON j.id = p.jurisdiction_id),
facts AS (
  SELECT call_id, count(DISTINCT CASE WHEN scope = 'country' THEN jurisdiction_id ELSE 'US' END) AS countries, bool_or(region = 'Europe') AS any_europe,
         bool_or(consent = 'unknown') AS any_unknown, bool_or(rule = 'all-party') AS any_all, bool_or(rule = 'mixed') AS any_mixed,
         bool_or(consent IN ('mixed', 'unknown') OR sd) AS doubt,
         string_agg(name || CASE WHEN ord = 0 THEN ' — where the recording is made' ELSE ' — a recorded party''s location' END, '; ' ORDER BY ord) AS law
  FROM res GROUP BY call_id)"""


@query(
    "party_jurisdictions",
    f"WITH {_RESOLVED} SELECT call_id, ord::INTEGER AS ord, jurisdiction_id, region, consent FROM res",
)
def party_jurisdictions(spark, sf):
    t = Tables(spark, sf)
    return consent.resolve_parties(t.parties, jurisdictions(spark)).select("call_id", "ord", "jurisdiction_id", "region", "consent")


@query(
    "consent_verdicts",
    f"""WITH {_RESOLVED}, v AS (SELECT *, CASE WHEN any_unknown THEN 'CONSULT_COUNSEL' WHEN countries > 1 OR any_europe OR any_all THEN 'ALL_PARTY_CONSENT_REQUIRED'
      WHEN any_mixed THEN 'CONSULT_COUNSEL' ELSE 'ONE_PARTY_SUFFICIENT_BUT_RECOMMEND_CONSENT' END AS verdict FROM facts)
    SELECT call_id, verdict, CASE WHEN any_unknown THEN 'unknown_location' WHEN countries > 1 THEN 'cross_border' WHEN any_europe THEN 'europe'
      WHEN any_all THEN 'all_party_jurisdiction' WHEN any_mixed THEN 'mixed_jurisdiction' ELSE 'one_party_everywhere' END AS reason,
      any_unknown OR doubt OR verdict = 'CONSULT_COUNSEL' AS verify_locally, law AS governing_law,
      CASE WHEN NOT any_unknown AND any_europe THEN 2 ELSE 1 END::BIGINT AS caveats FROM v""",
)
def consent_verdicts(spark, sf):
    t = Tables(spark, sf)
    v = consent.verdicts(t.parties, jurisdictions(spark))
    return v.select(
        "call_id", "verdict", "reason", "verify_locally", F.array_join("governing_law", "; ").alias("governing_law"),
        F.size("caveats").cast("long").alias("caveats"),
    )


@query(
    "call_consent_facts",
    f"WITH {_RESOLVED} SELECT call_id, countries, any_europe, any_unknown, any_mixed FROM facts",
)
def call_consent_facts(spark, sf):
    t = Tables(spark, sf)
    f = consent.call_facts(consent.resolve_parties(t.parties, jurisdictions(spark)))
    return f.select("call_id", "countries", "any_europe", "any_unknown", "any_mixed")


@query(
    "nations_by_region",
    """SELECT r_name AS region, min(n_nationkey) AS first_ord, count(*) AS members, string_agg(n_name, ',' ORDER BY n_nationkey) AS ids
    FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
)
def nations_by_region(spark, sf):
    t = Tables(spark, sf)
    places = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return consent.by_region(
        places.select(F.col("r_name").alias("region"), F.col("n_name").alias("id"), F.col("n_nationkey").alias("ord"))
    )


@query(
    "place_search",
    """SELECT c_name AS name, n_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey
    WHERE contains(lower(c_name), 'nation_1') OR contains(lower(n_name), 'nation_1')""",
)
def place_search(spark, sf):
    t = Tables(spark, sf)
    places = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return consent.search(places.select(F.col("c_name").alias("name"), F.col("n_name").alias("region")), " Nation_1 ")


@query(
    "data_violations",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
    r AS (
      SELECT 'priority_known' AS rule, o_orderkey::VARCHAR AS item, NULL::BIGINT AS found FROM o WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
      UNION ALL SELECT 'price_above_floor', o_orderkey::VARCHAR, NULL FROM o WHERE o_totalprice < 20000
      UNION ALL SELECT 'open_needs_price', o_orderkey::VARCHAR, NULL FROM o WHERE o_orderstatus = 'O' AND o_totalprice < 5000
      UNION ALL SELECT 'duplicate_id', l_orderkey::VARCHAR, count(*) FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
      UNION ALL SELECT 'rows_with_status_f', NULL, count(*) FROM o WHERE o_orderstatus = 'F' HAVING count(*) <> 10
      UNION ALL SELECT 'rows_with_status_p', NULL, count(*) FROM o WHERE o_orderstatus = 'P' HAVING count(*) < 1000000000)
    SELECT * FROM r""",
)
def data_violations(spark, sf):
    t = Tables(spark, sf)
    o = t.raw("orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rules = {
        "priority_known": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"),
        "price_above_floor": F.col("o_totalprice") >= 20_000,
        "date_shape": F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "open_needs_price": (F.col("o_orderstatus") != "O") | (F.col("o_totalprice") >= 5_000),
    }
    found = consent.violations(
        o,
        rules,
        "o_orderkey",
        exact={"rows_with_status_f": (F.col("o_orderstatus") == "F", 10)},
        minimum={"rows_with_status_p": (F.col("o_orderstatus") == "P", 1_000_000_000)},
    )
    dup = consent.violations(t.raw("lineitem"), {"has_part": F.col("l_partkey").isNotNull()}, "l_orderkey")
    return found.unionByName(dup)
