"""Collocations, lexical search and fingerprints against plain versions, and on odd rows."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vozmill.llm import collocations, consistent_parsing, lexical_search
from vozmill.llm.oracles import ORACLES
from vozmill.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "word other " * 30_000
SCHEMA = "doc_id long, text string, lang string, term string, block long, id long, part int, word string, n long, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF_DIR}/benchmark.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "One word", "en"), (5, LONG, "en"), (5, LONG, "en"),
        (6, "One word", "fr"), (None, "One word", "en"), (None, None, None), (7, "é ß 漢字 \U0001f600 ###", None),
        (8, "12 34", "de"), (9, "a" * 50_000, "de"), (10, "word\x00 other\x0bword, other word", "und"),
    ]
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y", 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Collocations


def plain_phrases(rows, max_words=3, least=10, held=50, top=2000):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            tokens = re.findall("[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                counts[lang or "und"].update(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        scored = []
        for p, a in frequent.items():
            if 100 * inside[p] >= held * a:
                continue
            s, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        for rank, (s, _, phrase, a, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), a, l, r, n, -s))
    return sorted(out)


def got_phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_equal_brute_force(spark, docs, odd):
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    want = plain_phrases(rows)
    assert len(want) > 100
    assert got_phrases(QUERIES["op11_collocations"](spark, SF_DIR)) == want
    strange = [(r["text"], r["lang"]) for r in odd.select("text", "lang").collect()]
    got = collocations.collocations(odd, min_count=2, max_words=4, top=5)
    assert got_phrases(got) == plain_phrases(strange, 4, 2, 50, 5)


def test_phrases_across_cut_blocks(docs):
    """Blocks of a few words cut most pieces; counts, cuts and longer phrases stay the same."""
    few = docs.where("doc_id < 24")
    rows = [(r["text"], r["lang"]) for r in few.select("text", "lang").collect()]
    for most, words in ((40, 4), (9, 2)):
        got = collocations.collocations(few, max_words=words, min_count=3, top=None, block_words=most)
        want = plain_phrases(rows, words, 3, 50, None)
        assert got_phrases(got) == want and len(want) > 20


def test_phrases_of_blocks_with_many_words(spark):
    """More different words than 16 bits number, beside a block of few."""
    many = " ".join(f"w{i % 70_000}" for i in range(140_000))
    rows = [(many, "xx"), ("a b c " * 40, "yy")]
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), min_count=2, top=50)
    assert got_phrases(got) == plain_phrases(rows, 3, 2, 50, 50)


def test_phrases_hold_one_block_at_a_time(spark, docs, monkeypatch):
    """However many blocks a task has, a row group holds one; a step's shuffle files go with it."""
    import time

    import pyarrow.dataset as ds

    folders, kept = [], collocations._kept

    def noted(df, **options):
        out = kept(df, **options)
        folders.append(os.path.dirname(out.inputFiles()[0].removeprefix("file://")))
        return out

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, setting = files.getAllFiles().size(), spark.conf.get(collocations._TIDY)
    monkeypatch.setattr(collocations, "_kept", noted)
    collocations.collocations(docs.coalesce(1), block_words=2000)
    parts = [f.metadata for f in ds.dataset(folders[0], format="parquet").get_fragments()]
    assert sum(p.num_rows for p in parts) > 20
    assert all(p.row_group(i).num_rows == 1 for p in parts for i in range(p.num_row_groups))
    assert len(folders) == 4 and spark.conf.get(collocations._TIDY) == setting
    until = time.time() + 20
    while files.getAllFiles().size() > before and time.time() < until:
        time.sleep(0.2)
    assert files.getAllFiles().size() <= before


def test_phrases_of_no_rows(none, odd):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(odd, min_count=10**6).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(odd, max_words=1)
    with pytest.raises(ValueError):
        collocations.collocations(odd, block_words=1 << 22)


def test_phrases_score_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 9_007_199_254_740, 9_007_199_254_747, 9_007_199_254_999
    got = spark.range(1).select(collocations._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()["s"]
    assert got == 10**6 * a * a // (left * right)


# Lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_search(docs, items, top=50):
    """(item, rank, id, score) with ids that may repeat or be null, by scoring every document."""
    tokens = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in tokens]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in tokens for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        scored = []
        for (doc, c), n in zip(tokens, sizes):
            m = 50 + 50 * n * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in terms if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if gone else d, -s) for rank, (s, gone, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def got_search(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_brute_force(spark, docs, items):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    want = plain_search(rows, asked)
    assert len(want) > 40 * 30
    assert got_search(QUERIES["op13_lexical_search"](spark, SF_DIR)) == want
    few = plain_search(rows, asked, 3)
    assert got_search(lexical_search.search(docs, items, top=3, shard_counts=200, block_pairs=100)) == few


def test_search_stops_early_and_stays_whole():
    """A list that decides alone: the search ends before the long lists are read."""
    rng = np.random.default_rng(5)
    rows = np.repeat(np.arange(4000), 3)
    terms = np.tile(np.arange(3), 4000)
    counts = rng.integers(1, 4, 12_000)
    counts[terms == 0] = np.where(np.arange(4000) < 40, 900, 1)
    lists = lexical_search.ImpactLists(np.full(4000, 60), rows, terms, counts, 3, 4000, 240_000)
    asked = [0]
    direct = lists.direct

    def counted(found, term):
        asked[0] += len(found)
        return direct(found, term)

    lists.direct = counted
    weights = np.array([9000, 3, 2])
    got, scores = lists.best(np.arange(3), weights, 10, 0)
    impact = np.zeros(4000, np.int64)
    for t in range(3):
        lo, hi = lists.bounds[t], lists.bounds[t + 1]
        impact[lists.rows[lo:hi]] += weights[t] * lists.impact[lo:hi]
    assert (impact[got] == scores).all()
    tenth = np.sort(impact)[-10]
    assert set(np.flatnonzero(impact >= tenth)) <= set(got)
    assert asked[0] < 12_000 / 4


def test_search_odd_rows(spark, odd, none):
    asked = spark.createDataFrame(
        [(1, "one word"), (1, "漢字 é 12"), (2, None), (3, "..."), (None, "other"), (None, "aaaa Word"), (4, LONG)],
        "item_id long, text string",
    ).selectExpr("*", "1 as doc_id", "2 as term", "3 as item")
    got = got_search(lexical_search.search(odd, asked))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got == plain_search(rows, [(r["item_id"], r["text"]) for r in asked.collect()])
    assert {r[0] for r in got} == {1, None, 4}
    assert lexical_search.search(none, asked).count() == 0
    assert lexical_search.search(odd, asked.limit(0)).count() == 0


# Fingerprints


def plain_parse(symbols, level):
    """Names of the next level of one text, symbol by symbol."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    label = [s for s, _ in runs]
    for _ in range(4 if level else 3):
        tossed = []
        for i, x in enumerate(label):
            differ = x ^ (label[i - 1] if i else x ^ 1)
            bit = (differ & -differ).bit_length() - 1 if differ else 0
            tossed.append(2 * bit + (x >> bit & 1))
        label = tossed
    starts = [i for i in range(len(label)) if i == 0 or i < len(label) - 1 and label[i - 1] < label[i] > label[i + 1]]
    out = []
    for lo, hi in zip(starts, [*starts[1:], len(label)]):
        total = sum(
            mix(s * 0x9E3779B97F4A7C15 + mix((n * 64 + j) + (level << 56)) & mask) for j, (s, n) in enumerate(runs[lo:hi])
        )
        out.append(mix(total + hi - lo & mask))
    return out


def plain_sketch(text, names=64):
    symbols, level, kept = list(text.encode()), 0, set()
    if not symbols:
        return ""
    while True:
        symbols = plain_parse(symbols, level)
        level += 1
        if level >= 2:
            kept |= {s >> 32 for s in symbols}
            if len(symbols) == 1:
                break
    return "".join(f"{v:08x}" for v in sorted(kept)[:names])


def plain_neighbours(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 4
        out[doc] = (len(text), text[: len(text) - cut] + after[:cut], text, after)
    return out


def shares(a, b, names=64):
    parts = [{x[i : i + 8] for i in range(0, len(x), 8)} for x in (a, b)]
    if not all(parts):
        return float(parts[0] == parts[1])
    lowest = sorted(parts[0] | parts[1])[:names]
    common = sum(x in parts[0] and x in parts[1] for x in lowest)
    return 2 * common / (len(lowest) + common)


def test_prints_equal_plain_parsing(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_neighbours(rows)
    got = {r["doc_id"]: r for r in QUERIES["op12_document_fingerprints"](spark, SF_DIR).collect()}
    assert set(got) == set(want) and len(got) == len(rows)
    for doc, (n, edited, text, after) in want.items():
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        if n < 3000:
            assert r["fingerprint"] == plain_sketch(text)
            assert r["edited_fingerprint"] == plain_sketch(edited)
        assert r["near_edited"] == shares(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == shares(r["fingerprint"], got_print(got, want, after))
    long = [r for r in got.values() if r["n_chars"] >= 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.6
    apart = [r["near_next"] for d, r in got.items() if r["n_chars"] >= 400 and want[d][2][:200] != want[d][3][:200]]
    assert np.median(apart) < 0.1


def got_print(got, want, text):
    return next(got[d]["fingerprint"] for d, w in want.items() if w[2] == text)


def test_equal_substrings_share_names():
    """Names inside a common part agree wherever it starts, but for a few at its ends."""
    rng = np.random.default_rng(3)
    common = bytes(rng.integers(97, 123, 4000, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, k, dtype=np.uint8)) + common + bytes(rng.integers(97, 123, k, dtype=np.uint8)) for k in (1, 37, 500)]
    for level in range(4):
        named = []
        for text in texts:
            symbols, first = np.frombuffer(text, np.uint8), np.zeros(len(text), bool)
            first[0] = True
            for below in range(level + 1):
                symbols, first = consistent_parsing.next_level(symbols, first, below)
            named.append(list(symbols))
        shared = set(named[0]) & set(named[1]) & set(named[2])
        assert len(set(named[0]) - shared) <= 12
    same, other = consistent_parsing.sketches([common * 2, common]), consistent_parsing.sketches([common, common])
    assert consistent_parsing.likeness(*same) > 0.85
    assert consistent_parsing.likeness(*other) == 1


def test_phrases_are_short():
    """Two to ten symbols each, runs of equal ones counted as one, on any input."""
    rng = np.random.default_rng(4)
    for data in (rng.integers(0, 256, 20_000), rng.integers(0, 2, 20_000), np.arange(20_000) % 256, np.zeros(20_000)):
        symbols, first = data.astype(np.uint8), np.zeros(20_000, bool)
        first[0] = True
        runs = 1 + np.count_nonzero(symbols[1:] != symbols[:-1])
        names, _ = consistent_parsing.next_level(symbols, first, 0)
        assert runs / 10 - 2 <= len(names) <= runs / 2 + 2


def test_prints_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for parts in (1, 3, 40):
        got = consistent_parsing.with_neighbours(odd, parts=parts).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
        by = defaultdict(set)
        for r in got:
            by[r["doc_id"]].add((r["fingerprint"], r["n_chars"]))
        assert by[1] == by[2] == {("", 0)} and by[4] == by[6] and len(by[5]) == 1
        nulls = {(r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is None}
        assert {n for n, _ in nulls} == {0, 8}
        seven = next(r for r in got if r["doc_id"] == 7)
        edited = "é ß 漢字 \U0001f600 ###"
        cut = len(edited) // 4
        assert seven["edited_sha256"] == hashlib.sha256((edited[:-cut] + "12 34"[:cut]).encode()).hexdigest()
    assert consistent_parsing.with_neighbours(none).count() == 0
    alone = consistent_parsing.with_neighbours(odd.where("doc_id = 4")).first()
    assert alone["near_next"] == 1 and alone["edited_sha256"] == hashlib.sha256(b"One wo" + b"On").hexdigest()
    short = consistent_parsing.fingerprints(odd)
    assert {(r["doc_id"], r["fingerprint"]) for r in short.collect()} == {(r["doc_id"], r["fingerprint"]) for r in got}


def test_prints_do_not_depend_on_parts(spark, docs):
    want = sorted(tuple(r) for r in consistent_parsing.with_neighbours(docs, parts=1).collect())
    for parts in (2, 57):
        assert sorted(tuple(r) for r in consistent_parsing.with_neighbours(docs, parts=parts).collect()) == want


@pytest.mark.parametrize("name", ["op11_collocations", "op13_lexical_search"])
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cursor.fetchall())
