"""Registered queries against their SQL.

A few by default; all of them with PARLEY_ALL_QUERIES=1, or faster with
``python -m tests.compare /root/testdata/sf0.001``.
"""

import os

import pytest

from parley.catalog import ORACLES, QUERIES
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SOME = ["transcript_markdown", "word_error_rates", "recording_sessions", "queue_row_states", "consent_verdicts", "gated_echo_report"]
NAMES = list(QUERIES) if os.environ.get("PARLEY_ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    message, _, _, ok = compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
