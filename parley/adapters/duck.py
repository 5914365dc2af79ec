"""The adapter views as SQL common table expressions."""

from __future__ import annotations

from parley.adapters.tables import BUNDLES, NOW
from parley.functions.text import FOLD_FROM, FOLD_TO, KNOWN_APPS


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def pick(values: list[str], index: str) -> str:
    return "([" + ", ".join(text(v) for v in values) + f"])[({index}) + 1]"


WS = "'[ \\t\\n\\r]+'"
TOKENS = f"list_filter(string_split_regex(text, {WS}), lambda x: x <> '')"

WORDS = f"""
words AS (
  SELECT 'c' || conv_id AS recording_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS channel,
         turn * 1000 + i AS seq, at_ms / 1000.0::DOUBLE AS start, (at_ms + 350) / 1000.0::DOUBLE AS "end", text
  FROM (SELECT conv_id, turn, role, i, text, turn * 600000 + i * 400 + (i // 7) * 2000 AS at_ms
        FROM (SELECT conv_id, turn, role, unnest(toks) AS text, unnest(range(len(toks))) AS i
              FROM (SELECT conv_id, turn, role, {TOKENS} AS toks FROM conversations))))"""

TURNS = f"""
turn_base AS (
  SELECT 'c' || conv_id AS recording_id, turn, turn * 600000 AS at_ms, len({TOKENS}) * 400 AS len_ms
  FROM conversations WHERE role = 'assistant'),
turns AS (
  SELECT recording_id, turn * 2 AS seq, at_ms / 1000.0::DOUBLE AS start,
         (at_ms + len_ms * 55 // 100) / 1000.0::DOUBLE AS "end", 'Them ' || (turn % 3 + 1) AS label FROM turn_base
  UNION ALL
  SELECT recording_id, turn * 2 + 1, (at_ms + len_ms * 50 // 100) / 1000.0::DOUBLE,
         (at_ms + len_ms * 85 // 100) / 1000.0::DOUBLE, 'Them ' || ((turn + 1) % 3 + 1) FROM turn_base)"""

# Brute force: every word of a recording against every turn of it.
LABELLED = """
ranked AS (
  SELECT w.recording_id, w.channel, w.seq, w.start, w."end", w.text, t.label, t.seq AS tseq,
         greatest(least(w."end", t."end") - greatest(w.start, t.start), 0) AS ov,
         CASE WHEN t.start IS NULL THEN NULL
              WHEN (w.start + w."end") / 2 < t.start THEN t.start - (w.start + w."end") / 2
              WHEN (w.start + w."end") / 2 > t."end" THEN (w.start + w."end") / 2 - t."end" ELSE 0 END AS dist
  FROM words w LEFT JOIN turns t ON t.recording_id = w.recording_id WHERE w.channel <> 0),
labelled AS (
  SELECT recording_id, channel, seq, start, "end", text, coalesce(label, 'Them') AS label
  FROM ranked
  QUALIFY row_number() OVER (PARTITION BY recording_id, channel, seq ORDER BY
    (label IS NOT NULL AND ov > 0) DESC,
    CASE WHEN label IS NOT NULL AND ov > 0 THEN ov END DESC,
    CASE WHEN label IS NOT NULL AND ov > 0 THEN -tseq END,
    dist, tseq) = 1)"""

MINE = """
mine_marked AS (
  SELECT *, CASE WHEN start - lag("end") OVER w <= 1.5 THEN 0 ELSE 1 END AS brk
  FROM words WHERE text <> '' WINDOW w AS (PARTITION BY recording_id, channel ORDER BY seq)),
mine_runs AS (
  SELECT *, sum(brk) OVER (PARTITION BY recording_id, channel ORDER BY seq) AS run FROM mine_marked),
utterances AS (
  SELECT recording_id, channel, min(seq) AS seq, min(start) AS start, max("end") AS "end",
         string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS n_words
  FROM mine_runs GROUP BY recording_id, channel, run)"""

FAR = """
far_marked AS (
  SELECT *, CASE WHEN start - lag("end") OVER w <= 1.5 AND label = lag(label) OVER w THEN 0 ELSE 1 END AS brk
  FROM labelled WINDOW w AS (PARTITION BY recording_id, channel ORDER BY seq)),
far_runs AS (
  SELECT *, sum(brk) OVER (PARTITION BY recording_id, channel ORDER BY seq) AS run FROM far_marked),
far_utterances AS (
  SELECT recording_id, channel, min(seq) AS seq, min(start) AS start, max("end") AS "end", any_value(label) AS label,
         string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS n_words
  FROM far_runs GROUP BY recording_id, channel, run)"""

SEGMENTS = """
segments AS (
  SELECT recording_id, channel, seq, start, "end", 'me' AS kind, NULL AS label, text, n_words
  FROM utterances WHERE channel = 0
  UNION ALL
  SELECT recording_id, channel, seq, start, "end", 'other', label, text, n_words FROM far_utterances)"""

CALL = f"{WORDS},{TURNS},{LABELLED},{MINE},{FAR},{SEGMENTS}"


def stamp(secs: str) -> str:
    s = f"CAST(floor(greatest({secs}, 0)) AS BIGINT)"
    short = f"lpad(CAST(({s} % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0')"
    return f"CASE WHEN {s} >= 3600 THEN ({s} // 3600) || ':' || {short} ELSE {short} END"


def line(start: str, who: str, body: str) -> str:
    return f"'**[' || {stamp(start)} || '] ' || {who} || ':** ' || trim({body}) || chr(10) || chr(10)"


SIGNAL = """
signal AS (
  SELECT 'u' || user_id AS key, epoch_us(ts) // 1000 AS ts, event_id AS ord,
         event_type IN ('click', 'view', 'purchase') AS is_on FROM events)"""

HOLDERS = f"""
holders AS (
  SELECT 'u' || (user_id % 7) AS key, event_id // 5 AS snapshot_id, event_id // 5 AS ts, event_id AS ord,
         {pick(BUNDLES, f"user_id % {len(BUNDLES)}")} AS bundle_id, event_id % 13 AS pid FROM events)"""

_MS = "(epoch_us(o_orderdate) // 1000 + (o_orderkey % 86400) * 1000)"
_LEN = "(20 + (o_orderkey * 37) % 9000)"


def ts(ms: str) -> str:
    return f"make_timestamp(({ms}) * 1000)"


RECORDINGS = f"""
recordings AS (
  SELECT 'r' || o_orderkey AS id, {ts(_MS)} AS started_at,
         CASE WHEN o_orderkey % 9 <> 0 THEN {ts(f"{_MS} + {_LEN} * 1000")} END AS ended_at,
         CASE WHEN o_custkey % 12 < {len(BUNDLES)} THEN {pick(BUNDLES, "o_custkey % 12")} END AS bundle_id,
         '/rec/r' || o_orderkey || '.wav' AS audio_path,
         CASE o_orderstatus
           WHEN 'F' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'done' END
           WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'recording' ELSE 'pending_transcription' END
           ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'transcribing' ELSE 'pending_note' END END AS status,
         CASE WHEN o_orderkey % 5 < 3 THEN '/notes/r' || o_orderkey || '.md' END AS note_path,
         CASE WHEN o_orderkey % 7 < 3 THEN 'error ' || (o_orderkey % 11) END AS error,
         CASE WHEN o_orderkey % 6 <> 0 THEN ({_LEN} % 400) / 4.0::DOUBLE END AS transcribe_secs,
         {ts(f"{_MS} + (o_orderkey % 200) * 86400000")} AS updated_at, o_orderkey AS k
  FROM orders)"""


def known(col: str) -> str:
    cases = " ".join(
        f"WHEN {col} = {text(b)} OR starts_with({col}, {text(b + '.')}) THEN {text(n)}" for b, n in KNOWN_APPS
    )
    return f"CASE {cases} END"


def humanize(col: str, sep: str = "[-_]") -> str:
    part = f"split_part({col}, '.', -1)"
    words = f"list_filter(string_split_regex({part}, '{sep}'), lambda w: w <> '')"
    caps = f"array_to_string(list_transform({words}, lambda w: upper(w[1:1]) || w[2:]), ' ')"
    return f"CASE WHEN {part} = '' THEN {col} ELSE {caps} END"


def app_name(col: str) -> str:
    return f"CASE WHEN {col} IS NULL THEN 'Webinar' ELSE coalesce({known(col)}, {humanize(col)}) END"


CHECKPOINTS = """
checkpoints AS (
  SELECT id, CASE WHEN k % 8 = 2 THEN 2 ELSE 1 END AS version,
         CASE WHEN k % 3 < 2 THEN '/cp/' || id || '.md' END AS note_path, k % 16 < 3 AS note_canonical
  FROM recordings WHERE k % 8 < 3)"""

FILES = """
files AS (
  SELECT audio_path AS path, (k * 91) % 100000 + 44 AS length FROM recordings WHERE k % 3 < 2
  UNION ALL SELECT '/rec/' || id || '-clean.wav', (k * 17) % 50000 + 44 FROM recordings WHERE k % 10 = 2
  UNION ALL SELECT note_path, (k * 7) % 5000 FROM recordings WHERE k % 5 < 3 AND k % 2 = 0)"""

JOBS = f"""
job_base AS (
  SELECT l_orderkey, l_linenumber, l_orderkey * 16 + l_linenumber AS jid, min(l_shipdate) AS ship, min(l_returnflag) AS flag
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
jobs AS (
  SELECT jid AS id,
         CASE flag WHEN 'R' THEN 'sweep_expired' WHEN 'N' THEN 'cleanup_staging' ELSE 'retry_transcription' END AS kind,
         CASE WHEN jid % 3 = 0 THEN '{{"id":"r' || l_orderkey || '","preferred_note":"/job/r' || l_orderkey
              || '.md","note_canonical":' || CASE WHEN jid % 2 = 0 THEN 'true' ELSE 'false' END || '}}'
              ELSE '{{"id":"r' || l_orderkey || '"}}' END AS payload,
         CASE WHEN jid % 4 = 0 THEN 'running' WHEN jid % 4 = 1 THEN 'failed' ELSE 'pending' END AS state,
         l_linenumber AS attempts, 5 AS max_attempts,
         {ts("epoch_us(ship) // 1000 + (jid % 1000) * 1000")} AS next_run_at,
         CASE WHEN flag = 'R' THEN 3600 END AS period_secs,
         CASE WHEN jid % 5 = 0 THEN 'job error ' || (jid % 7) END AS last_error,
         ship AS updated_at, 'r' || l_orderkey AS rid,
         CASE WHEN jid % 3 = 0 THEN '/job/r' || l_orderkey || '.md' END AS pl_note, jid % 6 = 0 AS pl_canon
  FROM job_base)"""

FRAMES = """
frames AS (
  SELECT 'v' || a.vec_id AS recording_id, f AS frame_no, i AS pos,
         a.embedding[i + 1]::DOUBLE AS mic, b.embedding[i + 1]::DOUBLE AS far,
         a.embedding[i + 1]::DOUBLE * 0.75 - b.embedding[i + 1]::DOUBLE * 0.125 AS clean,
         a.embedding[i + 1]::DOUBLE * CASE WHEN f % 2 = 1 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS near
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings) a
  JOIN embeddings b ON b.vec_id = a.vec_id + 1
  CROSS JOIN LATERAL (SELECT a.i // 16 AS f))"""

LOGS = """
logs AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'DEBUG' ELSE 'INFO' END AS level,
         'parley::' || event_type AS target, 'user ' || user_id || ' ' || props AS message,
         epoch_us(ts) // 1000 AS at, event_id AS ord FROM events)"""

STAGES = """
stages AS (
  SELECT event_id AS ord, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
         CASE WHEN event_type = 'error' THEN 'file' ELSE 'transcribe' END AS stage,
         CASE WHEN user_id % 3 = 0 THEN 'cloud' ELSE 'local' END AS backend,
         CAST(round(value * 1000) AS BIGINT) AS duration_ms FROM events)"""

RESULTS = """
nth_events AS (
  SELECT user_id, event_type, event_id AS k, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
results AS (
  SELECT CASE WHEN user_id = 0 AND n = 1 THEN 'baseline' ELSE 'run' || user_id || '.' || n END AS run, event_type AS fixture,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS fixture_ord,
         CASE WHEN k % 11 <> 0 THEN TRUE END AS ok, round(value * 100) / 10000.0::DOUBLE AS wer_norm,
         round(value * 200) / 10000.0::DOUBLE AS wer_raw, (900 + k % 400)::DOUBLE AS peak_rss_mb,
         (5000 + (k * 13) % 20000)::DOUBLE AS asr_ms, '{"threads":' || (user_id % 8) || '}' AS flags, k
  FROM nth_events)"""

# Fixed values, written out once more so that they are compared and not shared.
JURISDICTIONS = """
jurisdictions(id, ord, name, region, scope, consent, phone_rule, in_person_rule, source_disagreement) AS (VALUES
  ('us-federal', 0, 'Federal (ECPA / Wiretap Act)', 'United States', 'federal', 'one-party', NULL, NULL, NULL),
  ('us-al', 1, 'Alabama', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ak', 2, 'Alaska', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-az', 3, 'Arizona', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ar', 4, 'Arkansas', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ca', 5, 'California', 'United States', 'state', 'all-party', NULL, NULL, NULL),
  ('us-co', 6, 'Colorado', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ct', 7, 'Connecticut', 'United States', 'state', 'mixed', 'all-party', 'one-party', TRUE),
  ('us-de', 8, 'Delaware', 'United States', 'state', 'all-party', NULL, NULL, TRUE),
  ('us-fl', 9, 'Florida', 'United States', 'state', 'all-party', NULL, NULL, NULL),
  ('us-ga', 10, 'Georgia', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-hi', 11, 'Hawaii', 'United States', 'state', 'mixed', 'one-party', 'one-party', TRUE),
  ('us-id', 12, 'Idaho', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-il', 13, 'Illinois', 'United States', 'state', 'all-party', NULL, NULL, NULL),
  ('us-in', 14, 'Indiana', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ia', 15, 'Iowa', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ks', 16, 'Kansas', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ky', 17, 'Kentucky', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-la', 18, 'Louisiana', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-me', 19, 'Maine', 'United States', 'state', 'mixed', 'one-party', 'all-party', NULL),
  ('us-md', 20, 'Maryland', 'United States', 'state', 'all-party', NULL, NULL, NULL),
  ('us-ma', 21, 'Massachusetts', 'United States', 'state', 'all-party', NULL, NULL, NULL),
  ('us-mi', 22, 'Michigan', 'United States', 'state', 'mixed', NULL, NULL, TRUE),
  ('us-mn', 23, 'Minnesota', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ms', 24, 'Mississippi', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-mo', 25, 'Missouri', 'United States', 'state', 'mixed', 'one-party', 'all-party', NULL),
  ('us-mt', 26, 'Montana', 'United States', 'state', 'all-party', NULL, NULL, NULL),
  ('us-ne', 27, 'Nebraska', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-nv', 28, 'Nevada', 'United States', 'state', 'mixed', 'all-party', 'one-party', TRUE),
  ('us-nh', 29, 'New Hampshire', 'United States', 'state', 'all-party', NULL, NULL, NULL),
  ('us-nj', 30, 'New Jersey', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-nm', 31, 'New Mexico', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ny', 32, 'New York', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-nc', 33, 'North Carolina', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-nd', 34, 'North Dakota', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-oh', 35, 'Ohio', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ok', 36, 'Oklahoma', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-or', 37, 'Oregon', 'United States', 'state', 'mixed', 'one-party', 'all-party', NULL),
  ('us-pa', 38, 'Pennsylvania', 'United States', 'state', 'all-party', NULL, NULL, NULL),
  ('us-ri', 39, 'Rhode Island', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-sc', 40, 'South Carolina', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-sd', 41, 'South Dakota', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-tn', 42, 'Tennessee', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-tx', 43, 'Texas', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-ut', 44, 'Utah', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-vt', 45, 'Vermont', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-va', 46, 'Virginia', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-wa', 47, 'Washington', 'United States', 'state', 'all-party', NULL, NULL, NULL),
  ('us-wv', 48, 'West Virginia', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-wi', 49, 'Wisconsin', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-wy', 50, 'Wyoming', 'United States', 'state', 'one-party', NULL, NULL, NULL),
  ('us-dc', 51, 'District of Columbia', 'United States', 'district', 'one-party', NULL, NULL, NULL),
  ('fr', 52, 'France', 'Europe', 'country', 'all-party', NULL, NULL, NULL),
  ('de', 53, 'Germany', 'Europe', 'country', 'all-party', NULL, NULL, NULL),
  ('gb', 54, 'United Kingdom', 'Europe', 'country', 'one-party', NULL, NULL, NULL),
  ('eu', 55, 'European Union / EEA (GDPR baseline)', 'Europe', 'country', 'all-party', NULL, NULL, NULL),
  ('es', 56, 'Spain', 'Europe', 'country', 'one-party', NULL, NULL, NULL),
  ('ca', 57, 'Canada', 'North America', 'country', 'one-party', NULL, NULL, NULL),
  ('au', 58, 'Australia', 'Asia-Pacific', 'country', 'mixed', NULL, NULL, TRUE),
  ('jp', 59, 'Japan', 'Asia-Pacific', 'country', 'one-party', NULL, NULL, NULL),
  ('in', 60, 'India', 'Asia-Pacific', 'country', 'one-party', NULL, NULL, NULL),
  ('sg', 61, 'Singapore', 'Asia-Pacific', 'country', 'one-party', NULL, NULL, NULL),
  ('br', 62, 'Brazil', 'Latin America', 'country', 'one-party', NULL, NULL, NULL),
  ('mx', 63, 'Mexico', 'Latin America', 'country', 'one-party', NULL, NULL, NULL))"""

PARTIES = f"""{JURISDICTIONS},
seats AS (
  SELECT 'k' || o_orderkey AS call_id, s.ord, o_orderkey,
         CASE WHEN o_orderkey % 6 = 0 THEN (o_orderkey * 7 + c_nationkey * 3 + s.ord * 11) % 66
              ELSE 1 + (o_orderkey * 7 + c_nationkey * 3 + s.ord * 11) % 51 END AS i
  FROM orders JOIN customer ON c_custkey = o_custkey CROSS JOIN (SELECT unnest(range(3)) AS ord) s),
parties AS (
  SELECT call_id, seats.ord, coalesce(j.id, 'unknown') AS jurisdiction_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'phone' ELSE 'inPerson' END AS medium
  FROM seats LEFT JOIN jurisdictions j ON j.ord = seats.i)"""

DAMAGED = f"""array_to_string(list_filter(list_transform({TOKENS}, lambda w, i:
    CASE WHEN turn % 3 = 0 AND (i - 1) % 7 = 3 THEN '' WHEN turn % 3 = 1 AND (i - 1) % 5 = 2 THEN 'zzz'
         WHEN turn % 3 = 2 AND (i - 1) % 6 = 1 THEN w || ' ' || w ELSE w END), lambda w: w <> ''), ' ')"""

PAIRS = f"""
pairs AS (
  SELECT 'c' || conv_id || '-' || turn AS fixture, turn % 3 AS damage, text AS ref, {DAMAGED} AS hyp FROM conversations)"""


def normal_text(col: str) -> str:
    """Scoring form of a text, character by character where RE2 lacks lookaround."""
    folded = f"lower(translate(nfc_normalize(coalesce({col}, '')), {text(FOLD_FROM)}, {text(FOLD_TO)}))"
    cue = r"'[\[(][a-zA-Z][a-zA-Z \t]*[\])]'"
    for _ in range(6):
        folded = f"regexp_replace({folded}, {cue}, ' ', 'g')"
    bare = rf"regexp_replace({folded}, '[^\p{{L}}\p{{N}}_''\-]+', ' ', 'g')"
    alnum = r"'[\p{L}\p{N}]'"
    chars = (
        f"list_transform(string_split({bare}, ''), lambda c: c)"
    )
    kept = (
        f"(SELECT array_to_string(list_transform(cs, lambda c, i: CASE WHEN c IN ('''', '-') AND NOT "
        f"(coalesce(regexp_matches(cs[i - 1], {alnum}), FALSE) AND i > 1 AND coalesce(regexp_matches(cs[i + 1], {alnum}), FALSE)) "
        f"THEN ' ' ELSE c END), '') FROM (SELECT {chars} AS cs))"
    )
    toks = f"list_transform(list_filter(string_split({kept}, ' '), lambda w: w <> ''), lambda w: CASE WHEN w = 'ok' THEN 'okay' ELSE w END)"
    return toks


NOW_SQL = f"TIMESTAMP '{NOW}'"
