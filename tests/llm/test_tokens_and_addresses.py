"""Tokenizer alignment, fill-in-the-middle forms and URL filters against brute-force versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
import numpy as np
import pytest

from parley.llm import fill_middle, tokenizer_alignment, url_filters
from parley.llm.queries.operators import URL_RULES

FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
#: Input columns that have the names of results, and of helpers.
CLASHES = "doc_id long, text string, n long, form string, output long, links string, n_a string, verdict int, a string, b string, _key int"


def odd_texts():
    rnd = random.Random(9)
    parts = [" ", "  ", "a", "the", "walking", "\n", "\t", "é", "中", "🙂", "\x00", ".", "<|endoftext|>", "</s>", "<0x41>", "1", "'s", "\u00a0", "ﬁ", "\u3000", "<P", ">", "▁"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(150)]
    texts += [None, "", " ", "one", "no<S>middle", "x" * 5000, "wörd and \n" * 2000, "the same text twice", "the same text twice"]
    return [(None if i == 3 else i % 140, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "f", 2, "x", "y", 3, "p", "q", 4) for i, t in odd_texts()]
    return spark.createDataFrame(rows, CLASHES).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHES)


# Alignment


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(FILES[0])
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=FILES[2])


def token_bytes(both):
    shown = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = (b for b in range(256) if b not in shown.values())
    letters = shown | {chr(256 + n): b for n, b in enumerate(list(rest))}
    a = lambda i: bytes(letters[c] for c in both[0].id_to_token(i))
    b = lambda i: bytes([int(both[1].id_to_piece(i)[3:5], 16)]) if both[1].is_byte(i) else both[1].id_to_piece(i).replace("▁", " ").encode()
    return a, b


def groups_by_brute(both, text):
    """Groups as pairs of id lists, by looking at every end of both."""
    if not text:
        return []
    ids = both[0].encode(" " + text, add_special_tokens=False).ids, both[1].encode(text)
    spelled = [[f(i) for i in x] for f, x in zip(token_bytes(both), ids)]
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return []
    ends = [[len(b"".join(s[: k + 1])) for k in range(len(s))] for s in spelled]
    out, i, j = [], 0, 0
    shared = [(m, ends[1].index(e)) for m, e in enumerate(ends[0]) if e in set(ends[1])]
    for m, n in shared:
        out.append((ids[0][i : m + 1], ids[1][j : n + 1]))
        i, j = m + 1, n + 1
    return out


def test_alignment_and_its_statistics(docs, empty, both):
    texts = [(i, t) for i, t in odd_texts() if t is None or len(t) < 6000]
    groups = [(i, groups_by_brute(both, t)) for i, t in texts]
    counts = Counter((a[-1], b[-1]) for _, found in groups for a, b in found)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for i, found in groups:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        links = [(a[-1], b[-1]) for a, b in found]
        digest = hashlib.sha256(shown.encode()).hexdigest() if found else ""
        n_best = sum(counts[x] == most[x[1]] for x in links)
        want[(i, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(links), n_best, sum(counts[x] for x in links), digest)] += 1
    short = docs.filter("text is null or length(text) < 6000")
    report = tokenizer_alignment.alignment_report(short, *FILES)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in report.collect()) == want
    assert {"verdict", "_key", "form"} <= set(report.columns)
    assert sum(want.values()) > 100 and any(k[1] == 0 for k in want)
    assert tokenizer_alignment.alignment_report(empty, *FILES).count() == 0


def test_long_texts_align_like_their_parts(both):
    pair = tokenizer_alignment.Pair(*FILES)
    text = "wörd and\tthing, " * 3000 + "x" * 3000
    [alone] = pair.aligned(["wörd and\tthing,"])
    before = len(pair.windows)
    [(a, b, groups, links)] = pair.aligned([text])
    assert (a, b) == (len(both[0].encode(" " + text, add_special_tokens=False).ids), len(both[1].encode(text)))
    assert groups.startswith(alone[2] + ";") and links.startswith(alone[3])
    assert len(pair.windows) <= before + 2


def test_windows_are_remembered_by_their_ids(monkeypatch):
    pair = tokenizer_alignment.Pair(*FILES)
    first = pair.aligned(["one two two one", "two one"])
    assert len(pair.windows) == 2
    monkeypatch.setattr(pair, "align_windows", None)
    assert pair.aligned(["two one", "one two two one"]) == first[::-1]


def test_forgetting_windows_changes_nothing(monkeypatch):
    texts = [t or "" for _, t in odd_texts() if t is None or len(t) < 6000]
    whole = tokenizer_alignment.Pair(*FILES).aligned(texts)
    monkeypatch.setattr(tokenizer_alignment, "REMEMBERED", 3)
    pair = tokenizer_alignment.Pair(*FILES)
    assert [x for t in texts for x in pair.aligned([t])] == whole
    assert len(pair.windows) <= 3


def test_a_window_is_one_key():
    """Ids of both sides in one byte string, which keeps them apart, and far smaller than two in a tuple."""
    pair = tokenizer_alignment.Pair(*FILES)
    pair.aligned(["one two three " * 20, "wörd " + "x" * 3000])
    first = len(pair.bytes[0])
    for key, (shown, codes) in pair.windows.items():
        ids = np.frombuffer(key, "<u4").tolist()
        assert ids == sorted(ids, key=lambda i: i >= first)
        groups = [g.split("|") for g in shown.split(";")]
        assert ids == [int(i) for a, _ in groups for i in a.split(",")] + [int(i) + first for _, b in groups for i in b.split(",")]
        assert len(codes) == 8 * len(groups)


# Fill in the middle


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled_by_brute(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, empty):
    found = fill_middle.fill_in_middle(docs)
    want = Counter((i, *filled_by_brute(i, t), t or "") for i, t in odd_texts())
    rows = found.collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert {"links", "verdict", "_key"} <= set(found.columns)
    assert fill_middle.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize("block", [1, 3, 16])
def test_cuts_in_blocks_of_any_size(block):
    """Every cut of texts of many blocks, also with characters across their edges."""
    rnd = random.Random(block)
    for _ in range(60):
        text = "".join(rnd.choice(" \nabé中🙂") for _ in range(rnd.randint(0, 40)))
        tree = fill_middle.BlockTree(text.encode(), block)
        units = UNIT.findall(text)
        assert tree.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


# URL filters


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_by_brute(host, path, rules):
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no address", "http://", "http://a.com", "http://A.Com/x", "https://x.example.com/en/1", "https://www.example.com/en/1?q=/es/", "https://m.www.example.com/en/",
    "http://example.com/en", "http://notexample.com/en/1", "http://b.net/es/1", "http://b.net/fr/#x", "http://b.net/FR/1", "http://net/es/", "http://b.net?/es/", "x://y://b.net/es/",
    "http://ÄB.net/es/", "http://user@b.net:80/es/", "http://line\nbreak.net/es/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    found = url_filters.judge(pages, url_filters.Filters(URL_RULES)).collect()
    assert len(found) == len(URLS)
    for r in found:
        host, path = parts_of(r.url)
        verdict, rule = rule_by_brute(host, path, URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))


def splits(label):
    for n in range(len(label)):
        for cuts in combinations(range(1, len(label)), n):
            edges = [0, *cuts, len(label)]
            yield [label[a:b] for a, b in zip(edges, edges[1:])]


def test_segmentation_is_the_likeliest_of_all():
    import math

    how = url_filters.Filters(longest=6)
    counts = {"the": 500, "car": 40, "cart": 9, "art": 30, "tart": 2, "he": 20, "rt": 1, "a": 90}
    likely = lambda w: math.log(counts[w] / 1000) if w in counts else math.log(how.unknown / 1000) - len(w) * math.log(10)
    for label in ("thecart", "cartart", "theaxx", "a", "zzzzzzz", "heart"):
        [found] = url_filters.segmented([label], [counts], 1000.0, how)
        score = sum(map(likely, found))
        assert score == pytest.approx(max(sum(map(likely, s)) for s in splits(label) if max(map(len, s)) <= 6))


def test_names_run_together_are_judged_by_their_words(spark):
    hosts = {
        "block": "onlinepokerslots.example.net www.casino-palace.example.org viagrapills.example.net m.pornotube.example.org torrentcracks.example.net",
        "allow": "citylibrary.example.net schoolgarden.example.org www.sussexnews.example.org essexhotel.example.net qwrtz.example.org alphabet.example.net",
    }
    rows = [(n, f"http://{h}/page/{n}", "<p>casino palace tube city</p>", v, "x", 1) for n, (v, h) in enumerate((v, h) for v, hs in hosts.items() for h in hs.split())]
    rows += [(90, "http://fine.example.net/poker/slots/casino", "", "block", "x", 1), (91, "http://" + "q" * 900 + "poker.example.net/x", "", None, "x", 1), (92, None, None, "allow", "x", 1)]
    rows += [rows[0], (None, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string, host string, score int")
    found = url_filters.judge(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.want in (None, r.verdict), r
    by = {r.page_id: r for r in found}
    assert by[0].host_words[:3] == ["online", "poker", "slots"] or by[0].host_words[1:3] == ["poker", "slots"]
    assert "".join(by[91].host_words) == "q" * 900 + "pokerexamplenet"


def test_url_filter_on_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.judge(none, url_filters.Filters(URL_RULES)).count() == 0


def test_word_weights_by_hand(spark):
    import math

    how = url_filters.Filters()
    cells = spark.createDataFrame([("x", True, 4.0), ("x", False, 1.0), ("y", False, 2.0), ("x", True, 1.0)], "word string, unwanted boolean, n double")
    found = {r.word: r.weight for r in url_filters.naive_bayes(cells, how).collect()}
    assert found["x"] == pytest.approx(math.log(5.2 / 1.2)) and found["y"] == pytest.approx(math.log(0.2 / 2.2))
