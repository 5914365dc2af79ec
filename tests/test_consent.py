"""Consent verdicts and data rules."""

import pytest
from pyspark.sql import functions as F

from parley.operators import consent, reports
from parley.sources.tables import jurisdictions

CASES = [
    (["us-ny", "us-tx"], "phone", consent.ONE_PARTY, False),
    (["us-ny", "us-ca"], "phone", consent.REQUIRED, False),
    (["us-ny", "nowhere"], "phone", consent.CONSULT, True),
    (["us-ny", "ca"], "phone", consent.REQUIRED, False),
    (["gb", "gb"], "phone", consent.REQUIRED, False),
    (["us-or", "us-tx"], "phone", consent.ONE_PARTY, True),
    (["us-or", "us-tx"], "inPerson", consent.REQUIRED, True),
    (["us-mi", "us-tx"], "phone", consent.CONSULT, True),
    (["us-mi", "us-ca"], "phone", consent.REQUIRED, True),
    (["jp", "jp"], "phone", consent.ONE_PARTY, False),
    (["au", "au"], "phone", consent.CONSULT, True),
    (["us-de", "us-tx"], "phone", consent.REQUIRED, True),
]


def test_verdicts(spark):
    rows = [(i, o, p, m) for i, (ps, m, _, _) in enumerate(CASES) for o, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "call_id int, ord int, jurisdiction_id string, medium string")
    got = {r.call_id: r for r in consent.verdicts(df, jurisdictions(spark)).collect()}
    for i, (_, _, verdict, verify) in enumerate(CASES):
        assert (got[i].verdict, got[i].verify_locally) == (verdict, verify), CASES[i]
    assert got[3].governing_law == ["New York — where the recording is made", "Canada — a recorded party's location"]
    assert len(got[4].caveats) == 2 and len(got[3].caveats) == 1


def test_dimension_counts(spark):
    j = jurisdictions(spark)
    by = {r.scope: r["count"] for r in j.groupBy("scope").count().collect()}
    rule = {r.consent: r["count"] for r in j.groupBy("consent").count().collect()}
    assert by == {"state": 50, "district": 1, "federal": 1, "country": 12}
    assert rule == {"one-party": 43, "all-party": 13, "mixed": 8}


def test_all_violations_are_listed(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1), (None, 5)], "id string, v int")
    got = consent.violations(
        df, {"has_id": F.col("id").isNotNull(), "positive": F.col("v") > 0}, "id",
        exact={"three": (F.lit(True), 4)}, minimum={"many": (F.lit(True), 2)},
    )
    assert sorted((r.rule, r.item, r.found) for r in got.collect()) == [
        ("duplicate_id", "a", 2), ("has_id", None, None), ("positive", "a", None), ("three", None, 3),
    ]


@pytest.mark.parametrize("cell", [0.01, 1.0, 100.0])
def test_pareto_equals_brute_force(spark, cell):
    import random

    rng = random.Random(cell)
    pts = [(i, rng.randrange(12) / 2, float(rng.randrange(12))) for i in range(60)]
    want = sorted(
        i for i, x, y in pts if not any(a <= x and b <= y and (a, b) != (x, y) for _, a, b in pts)
    )
    got = reports.pareto_front(spark.createDataFrame(pts, "i int, x double, y double"), "x", "y", cell)
    assert sorted(r.i for r in got.collect()) == want


def test_published_sweep_means(spark):
    """Three published fixtures of two runs: means, delta, first flags."""
    rows = [
        ("baseline", "dough", 0, True, 0.085, 1150.0, 1.0, "{}"), ("baseline", "trees", 1, True, 0.062, 990.0, 1.0, "{}"),
        ("baseline", "hackers", 2, True, 0.141, 1160.0, 1.0, "{}"), ("sil", "dough", 0, True, 0.06, 1000.0, 2.0, '{"a":1}'),
        ("sil", "trees", 1, None, 0.9, 1.0, 2.0, "{}"), ("bad", "dough", 0, False, None, None, None, "{}"),
    ]
    df = spark.createDataFrame(rows, "run string, fixture string, fixture_ord int, ok boolean, wer_norm double, peak_rss_mb double, asr_ms double, flags string")
    got = reports.baseline_delta(reports.run_means(df)).orderBy("wer").collect()
    assert [(r.run, round(r.wer, 3), round(r.delta_wer, 3), r.flags) for r in got] == [("sil", 0.06, -0.036, '{"a":1}'), ("baseline", 0.096, 0.0, "{}")]
