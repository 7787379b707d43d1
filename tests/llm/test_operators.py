"""The operators against plain versions, on the smallest tables and on odd rows."""

import os
import re

import duckdb
import numpy as np
import pytest
import xxhash

import brute
from vozmill.llm import (
    decontamination, language_id, license_scan, line_dedup, quality_classifier, quality_rules, sampling, simhash_dedup,
    source_mixing, toxicity, url_reputation,
)
from vozmill.llm.components import components
from vozmill.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "word other " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, size string, fingerprint string, target string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "One word", "en", "a"),
        (5, LONG, "en", "b"), (5, LONG, "en", "b"), (6, "One word", "fr", "b"), (None, "One word", "en", "a"),
        (7, "é ß 漢字 \U0001f600 ###", None, "c"), (8, "12 34", "de", "c"),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def simhash_groups(texts, bits=4):
    prints = [brute.fingerprint(t) for t in texts]
    near = [
        (a, b) for a in range(len(prints)) for b in range(a + 1, len(prints))
        if (prints[a] ^ prints[b]).bit_count() <= bits
    ]
    return prints, brute.groups(len(prints), near)


def test_components(spark):
    pairs = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_simhash_links_are_all_pairs(spark, segments):
    rng = np.random.default_rng(segments)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in range(7)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    got = {frozenset((r["a"], r["b"])) for r in simhash_dedup.links(table, 4, segments).collect()}
    want = {
        frozenset((signed[i], signed[j])) for i in range(len(prints)) for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= 4
    }
    assert got == want


def test_simhash(spark, docs):
    source = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    prints, groups = simhash_groups([t for _, t in source])
    got = rows(QUERIES["op1_simhash_dedup"](spark, SF_DIR))
    assert len(got) == len(source)
    for (doc, _), p, g in zip(source, prints, groups):
        assert (got[doc]["fingerprint"], got[doc]["component_id"]) == (f"{p:016x}", source[g][0])
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {source[g][0] for g in groups}


def test_simhash_odd_rows(odd, none):
    got = simhash_dedup.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[3]["component_id"] == 1 and by[6]["component_id"] == 4 and by[None]["component_id"] is None
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.keep_one(none).count() == 0


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    flat = lambda t: " ".join(t.lower().split())
    want = {
        (d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench
        if " ".join(flat(b["text"]).split()[2:14]) in flat(d["text"])
    }
    got = QUERIES["op2_decontamination"](spark, SF_DIR).collect()
    assert {(r["doc_id"], i) for r in got for i in r["items"]} == want and want
    assert all(r["contaminated"] == bool(r["items"]) for r in got)


def test_decontamination_paraphrase_and_odd_rows(spark, docs, odd, none):
    item = docs.where("length(text) > 3000 and lang = 'en'").orderBy("doc_id").first()["text"].split()[20:60]
    changed = [("zzyx" if i % 8 == 3 and i < 32 else w) for i, w in enumerate(item)]
    rest = docs.where("lang = 'en'").orderBy("doc_id").limit(60).select("doc_id", "text")
    mine = spark.createDataFrame([(10_001, " ".join(["start"] + changed + ["end"])), (10_002, None)], rest.schema)
    asked = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string")
    got = rows(decontamination.find_contaminated(rest.where("doc_id % 100 != 0").union(mine), asked))
    assert got[10_001]["items"] == [1] and not got[10_002]["contaminated"]
    assert decontamination.find_contaminated(odd, asked).where("contaminated").count() == 0
    assert decontamination.find_contaminated(none, asked).count() == 0
    assert decontamination.find_contaminated(odd, asked.limit(0)).count() == 10
    two = decontamination.find_contaminated(mine, asked.union(asked.selectExpr("item_id + 10", "text")), block_items=1)
    assert rows(two)[10_001]["items"] == [1, 11]


@pytest.mark.parametrize("size, many", [(15, 1500), (59, 200), (200, 200)])
def test_decontamination_finds_every_copy(spark, docs, size, many):
    rng = np.random.default_rng(size)
    texts = [re.findall(r"[^\W_]+", d["text"].lower()) for d in docs.where("length(text) > 2500").orderBy("doc_id").collect()]
    cut = lambda: (lambda t: (lambda a: t[a : a + size])(rng.integers(len(t) - size)))(texts[rng.integers(len(texts))])
    items = [cut() for _ in range(many)]
    rest = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    planted = []
    for k in range(60):
        around, copy = texts[k % len(texts)][:150], list(items[k])
        for x in rng.permutation(size)[: size // 7 if k % 2 else 0]:
            copy[x] = "zzyx"
        at = rng.integers(len(around))
        planted.append((10_000 + k, " ".join(around[:at] + copy + around[at:])))
    got = rows(decontamination.find_contaminated(rest.union(spark.createDataFrame(planted, rest.schema)), asked))
    assert all(k in got[10_000 + k]["items"] for k in range(60))


def test_decontamination_finds_parts_of_an_item(spark):
    item = [f"w{k}" for k in range(59)]
    other = [f"v{k}" for k in range(80)]
    edited = [("zzyx" if k % 7 == 3 else w) for k, w in enumerate(item[5:45])]
    parts = [item[:34], item[:45], item[20:32], edited, item[20:31], item[::2]]
    texts = spark.createDataFrame([(k, " ".join(other[:40] + p + other[40:])) for k, p in enumerate(parts)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = rows(decontamination.find_contaminated(texts, asked))
    assert [got[k]["contaminated"] for k in range(6)] == [True, True, True, True, False, False]
    assert abs(got[0]["share"] - 34 / 59) < 1e-9


def test_decontamination_finds_short_items_and_scripts_without_spaces(spark):
    asked = spark.createDataFrame([
        (1, "Who wrote Faust?"), (2, "中国最长的河流是哪一条"), (3, "ประเทศไทยมีกี่จังหวัด"),
        (4, "日本で一番高い山は富士山で、二番目に高い山は北岳であると言われている。"), (5, "???"),
    ], "item_id long, text string")
    texts = [
        "asked: who wrote Faust", "who wrote a Faust", "他问：中国最长的河流是哪一条？我不知道。", "中国的河流最长", "ถามว่าประเทศไทยมีกี่จังหวัดครับ",
        "それでは日本で一番高い山は富士山で、二番目に高い岳は北岳であると言われている。そうです", "日本の山", "who wrote",
    ]
    rest = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(decontamination.find_contaminated(rest, asked))
    assert [got[k]["items"] for k in range(8)] == [[1], [], [2], [], [3], [4], [], []]


def test_words_of_scripts_without_spaces():
    split = decontamination.Words(["ab 中国、x日y ไทย 한국 é𠀀z".encode(), "本".encode()])
    parts = [w.decode() for w in split.slice(0, len(split.start))]
    assert parts == ["ab", "中", "国", "x", "日", "y", "ไ", "ท", "ย", "한국", "é", "𠀀", "z", "本"]
    assert split.bounds.tolist() == [0, 13, 14]


def test_decontamination_fit_is_not_one_task(spark, docs, monkeypatch):
    plans, fit = [], decontamination.latent_space
    monkeypatch.setattr(decontamination, "latent_space", lambda texts, *a: plans.append(texts._jdf.queryExecution().toString()) or fit(texts, *a))
    asked = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    decontamination.find_contaminated(docs, asked)
    assert plans and "Limit" not in plans[0]


def test_decontamination_does_not_depend_on_blocks(spark, docs, odd):
    """One pass or a pass per item: the same verdicts, for null and repeated ids too."""
    texts = [r["text"] for r in docs.where("doc_id < 40").orderBy("doc_id").collect()]
    items = [" ".join(t.split()[5:30]) for t in texts if len(t.split()) > 40][:4] + ["漢字", "One word"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    holders = [(None, f"before {items[0]} after"), (None, "nothing at all"), (1, items[1]), (1, "clean text"), (1, None)]
    table = docs.select("doc_id", "text").where("doc_id < 40").union(spark.createDataFrame(holders, "doc_id long, text string"))
    table = table.union(odd.select("doc_id", "text"))
    verdicts = [
        sorted(
            (str(r["doc_id"]), r["contaminated"], tuple(r["items"]))
            for r in decontamination.find_contaminated(table, bench, block_items=n).collect()
        )
        for n in (20_000, 2)
    ]
    assert verdicts[0] == verdicts[1]
    assert ("None", True, (0,)) in verdicts[0] and ("1", True, (1,)) in verdicts[0] and ("1", False, ()) in verdicts[0]
    kept = [r["text"] for r in decontamination.keep_clean(table, bench).collect()]
    assert "nothing at all" in kept and "clean text" in kept and items[1] not in kept and holders[0][1] not in kept


def test_rows_of_short_and_long_segments_are_summed():
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 40, 60), [1, 15, 16, 17, 256, 257, 5000]])
    starts = np.cumsum(sizes) - sizes
    table, rows = rng.integers(-9, 9, (50, 6)).astype(np.float32), rng.integers(0, 50, sizes.sum())
    expected = np.array([table[rows[a : a + n]].sum(axis=0) for a, n in zip(starts, sizes)])
    adds = []
    take = np.ndarray.take

    class Counted(np.ndarray):
        def take(self, *a, **k):
            adds.append(1)
            return take(self.view(np.ndarray), *a, **k)

    assert np.array_equal(decontamination._sums(table.view(Counted), rows, starts), expected)
    assert len(adds) <= decontamination.HALF  # not one for each segment and column
    none = np.zeros(0, np.int64)
    assert decontamination._sums(table, none, none).shape == (0, 6)


def test_latent_space_is_the_truncated_svd(spark, docs):
    """Against a plain SVD of the same weighted passages."""
    texts = docs.select("text").where("doc_id < 60")
    weight, _ = decontamination.feature_weights(texts)
    items = [b"one two three four five six seven eight"]
    space = decontamination.latent_space(texts, weight, items, rank=8)
    parts = [r["text"].lower().encode() for r in texts.collect()]
    words = decontamination.Words(parts)
    starts, _ = decontamination._halves(words.bounds)
    a = np.zeros((len(starts), decontamination.FEATURES))
    np.add.at(a, (np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words.feature)))), words.feature), 1)
    a *= weight
    held = np.linalg.norm(a @ (space / np.maximum(weight, 1e-9)[:, None])) / np.linalg.norm(a)
    best = np.linalg.svd(a, compute_uv=False)
    assert held > 0.8 * np.sqrt((best[:8] ** 2).sum() / (best**2).sum())


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = ([bytes([97 + x]) for x in rng.integers(0, 4, rng.integers(1, 14))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_subsequence(b, decontamination._places(a), len(a)) == table[-1, -1]


def test_language(spark, docs, odd, none):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = QUERIES["op3_language_id"](spark, SF_DIR).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    strange = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert [strange[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4 and len(strange) == 9
    assert language_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_codewords_are_apart():
    for classes in (2, 4, 9):
        code = language_id.codewords(classes, 20, 1)
        apart = min((code[i] != code[j]).sum() for i in range(classes) for j in range(i))
        assert apart >= 5 and (np.abs(code.sum(0)) < classes).all()


def test_every_name_of_a_kind_is_tried():
    kinds = (("a", "b", "c", "d", "e"), ("x", "y"))
    got = toxicity.swapped_sets("The a says x. Nothing.", kinds)
    assert len(got) == 4 and {w for s in got for w in s} >= {"b", "c", "d", "e", "y"}
    assert all("a" not in s and "nothing" in s for s in got)
    assert toxicity.swapped_sets("nothing here", kinds) == []
    assert all(len(set(kind)) == len(kind) > 1 for kind in toxicity.IDENTITY)


def test_one_text_per_id_teaches(spark):
    texts = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (None, "x")], "id long, text string")
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "id long, mark int")
    got = {r["id"]: r["text"] for r in sampling.sampled_texts(texts, sample, "mark").collect()}
    assert set(got) == {1, 2} and got[2] is None
    plan = sampling.sampled_texts(texts, sample, "mark")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "LocalTableScan" in plan


def test_toxicity_is_fair_to_names(spark, odd, none):
    bad, names = ["vile", "rotten", "nasty"], ["women", "men"]
    texts = []
    for i in range(400):  # one group's name goes along with abuse in most training texts
        toxic = i % 2
        name = names[0] if (i % 10 != 1) == bool(toxic) else names[1]
        texts.append((i, f"the {name} were {bad[i % 3] if toxic else 'calm'} again. number {i % 7}", toxic))
    docs = spark.createDataFrame([t[:2] for t in texts] + [(1001, "the women were seen"), (1002, "so vile")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, t) for i, _, t in texts], "doc_id long, toxic int")
    got = rows(toxicity.score_rows(docs, marks))
    free = rows(toxicity.score_rows(docs, marks, groups=()))
    assert got[1002]["predicted"] == 1 and got[1001]["score"] < free[1001]["score"]
    assert toxicity.swapped_sets("A man. No.", (("man", "woman"),))[0] == {"a", "woman", "no"}
    assert toxicity.score_rows(odd, marks).count() == 10 and toxicity.score_rows(none, marks).count() == 0
    assert {r["score"] for r in toxicity.score_rows(odd, marks.limit(0)).collect()} == {0.0}


def test_classifiers_on_given_rows(spark, docs):
    for name in ("op4_toxicity", "op8_quality_classifier"):
        got = QUERIES[name](spark, SF_DIR).collect()
        cut = 0.5 if name == "op4_toxicity" else 0.7
        assert len(got) == docs.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got)


def test_quality_classifier(spark, odd, none, labels):
    mid = os.path.join(os.path.dirname(SF_DIR), "sf0.01")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{mid}/labels.parquet").collect()}
    held = [r for r in QUERIES["op8_quality_classifier"](spark, mid).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert quality_classifier.score_rows(odd, labels).count() == 10
    assert quality_classifier.score_rows(none, labels).count() == 0
    assert quality_classifier.score_rows(odd, labels.limit(0)).count() == 10


def test_forest_walk_equals_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.random((200, 4))
    y = (x[:, 1] + 0.3 * x[:, 2] > 0.7).astype(float)
    forest = quality_classifier.grow(x, y, np.ones(200), trees=10)
    plain = []
    for row in x:
        total = forest.start
        for f, limit, leaf in zip(forest.feature, forest.limit, forest.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > limit[at])
            total += leaf[at - len(f)]
        plain.append(total)
    assert np.allclose(forest.margins(x), plain)
    assert ((forest.margins(x) > 0) == y).mean() > 0.95


def test_line_dedup(spark, docs):
    source = sorted((r["doc_id"], r["text"]) for r in docs.where("doc_id < 120").collect())
    lines = [
        (d, n, line_dedup.normal(x.encode())) for d, t in source for n, x in enumerate(t.split("\n")) if x.split()
    ]
    sets = [frozenset(x[i : i + 8] for i in range(max(len(x) - 7, 1))) for _, _, x in lines]
    near = []
    for i in range(len(lines)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if lines[i][2] == lines[j][2]:
                near.append((j, i))
            elif min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(lines[i][2]) >= 8 <= len(lines[j][2]):
                both = len(a & b)
                if both >= 0.8 * (len(a) + len(b) - both):
                    near.append((j, i))
    gone = {(lines[i][0], lines[i][1]) for i, g in enumerate(brute.groups(len(lines), near)) if g != i}
    got = rows(line_dedup.dedup_lines(docs.where("doc_id < 120")))
    for doc, text in source:
        assert got[doc]["text"] == "\n".join(x for n, x in enumerate(text.split("\n")) if (doc, n) not in gone)
    assert sum(r["n_removed"] for r in got.values()) == len(gone) > 0


def test_open_pairs_of_a_bucket_are_verified(spark, monkeypatch):
    base = ["".join(chr(97 + (i * k + i // 3) % 26) for i in range(120)) for k in (3, 5, 7)]
    texts = [b[:100] + t for b in base for t in ("", "x" * 9, "yz" * 5)]
    table = spark.createDataFrame([(i, bytes(t.encode())) for i, t in enumerate(texts)], "line long, folded binary")
    bands = line_dedup.band_values([t.encode() for t in texts]).view(np.int64)
    placed = spark.createDataFrame(
        [(int(v), i, i) for i, row in enumerate(bands.tolist()) for v in row], "band long, line long, component long"
    )
    monkeypatch.setattr(line_dedup, "BLOCK", 2)
    links = [(r["a"], r["b"]) for r in line_dedup.open_links(placed, table, 0.8, 8).collect()]
    assert brute.groups(len(texts), links) == [0, 0, 0, 3, 3, 3, 6, 6, 6]


def test_a_large_component_costs_no_square(spark, monkeypatch):
    """Many lines of one component beside a few others: four times the lines give about four times the rows."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rows = []
    for n in (200, 800):
        lines = [(1, i, 0) for i in range(n)] + [(1, n + i, n + i) for i in range(20)] + [(2, 0, 0), (2, 1, 0)]
        placed = spark.createDataFrame(lines, "band long, line long, component long")
        dealt = line_dedup.dealt_blocks(placed).collect()
        rows.append(len(dealt))
        meet = {}
        for r in dealt:
            meet.setdefault((r["x"], r["y"]), []).append(r)
        pairs = {
            frozenset((a["component"], b["line"])) for group in meet.values() for a in group for b in group
            if a["component"] == 0 and b["component"] != 0
        }
        together = {(a["line"], b["line"]) for group in meet.values() for a in group for b in group if a["line"] < b["line"]}
        assert {r["band"] for r in dealt} == {1} and len(pairs) == 20
        assert all((i, n + j) in together for i in range(n) for j in range(20))
        assert all((n + i, n + j) in together for j in range(20) for i in range(j))
    assert rows[1] < 5 * rows[0]


def test_line_dedup_odd_rows(spark, odd, none):
    got = line_dedup.dedup_lines(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[1]["text"] is None and by[2]["text"] == "" and by[None]["text"] == "One word"
    assert by[4]["text"] == "One word" and by[6]["text"] == "" and by[5]["text"] == LONG and by[3]["text"] == " \t\n"
    assert line_dedup.dedup_lines(none).count() == 0
    names = {c: f"__{n}" for c, n in zip(("source", "size", "fingerprint"), ("id", "gone", "lines"))}
    strange = odd.withColumnsRenamed(names).withColumnRenamed("target", "n_removed")
    cleaned = line_dedup.dedup_lines(strange, count_col=None)
    assert cleaned.columns == strange.columns and cleaned.count() == 10
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(strange)


def test_urls(spark, none):
    urls = ["http://WWW.Example.com/en/1?x#y", "a://h", "noscheme", None, "http://u@a.co.uk:80?q", "://", "x://y#z://w/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"))
    got = rows(url_reputation.judge(pages, spark.createDataFrame([], "page_id long, outcome long"), rules), "page_id")
    assert [(got[i]["host"], got[i]["path"]) for i in range(len(urls))] == [brute.address(u) for u in urls]
    assert got[0]["rule"] == "www.example.com/en/" and got[0]["verdict"] == "allow" and got[1]["rule"] is None
    empty = none.selectExpr("doc_id as page_id", "text as url")
    assert url_reputation.judge(empty, spark.createDataFrame([], "page_id long, outcome long"), rules).count() == 0


def test_reputation_blocks_bad_hosts_only(spark):
    pages = [(h * 100 + i, f"http://{'bad' if h == 3 else 'h' + str(h)}.site{h}.org/{i}") for h in range(8) for i in range(40)]
    marks = [(p, 1 if u.startswith("http://bad") else int(p % 20 == 0)) for p, u in pages]
    few = [(9001, "http://new.site99.org/1")]
    table = spark.createDataFrame(pages + few, "page_id long, url string")
    outcomes = spark.createDataFrame(marks + [(9001, 1)], "page_id long, outcome long")
    got = rows(url_reputation.judge(table, outcomes, ()), "page_id")
    assert {r["host"] for r in got.values() if r["verdict"] == "block"} == {"bad.site3.org"}


def test_beta_quantiles():
    for a, b, q in ((1, 1, 0.3), (2, 1, 0.25), (1, 3, 0.5)):  # closed forms
        want = {(1, 1): q, (2, 1): q**0.5, (1, 3): 1 - (1 - q) ** (1 / 3)}[a, b]
        assert abs(url_reputation.beta_quantile(q, np.array([a], float), np.array([b], float))[0] - want) < 1e-6


def test_license(spark, docs, odd, none):
    extra = [
        (9001, "x. Released under the MIT license, all rights  reserved. CC-BY cc by."),
        (9002, "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and "
               "associated documentation files the software to deal in the software without any restriction"),
    ]
    given = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = rows(license_scan.scan(given))
    for r in given.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute.phrases(r["text"])
    assert got[9001]["labels"] == "cc-by,mit,reserved" and got[9002]["labels"] == "mit"
    assert license_scan.scan(odd).count() == 10 and license_scan.scan(none).count() == 0


def test_license_spans_of_edited_and_repeated_notices(spark):
    mit = license_scan.TEMPLATES[5][1]
    scattered = mit.split()
    for at in (25, 19, 13, 8, 3):
        scattered.insert(at, "indeed")
    stray = "permission is hereby granted " * 3 + mit
    texts = ["x " + " ".join(scattered) + " y", stray, "permission is hereby granted free " * 40, f"{mit} " * 3]
    got = rows(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")))
    assert got[0]["labels"] == "mit" and got[0]["score"] >= 0.75 and got[0]["spans"][0]["start"] == 1
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0
    assert got[2]["labels"] == "" and 0 < got[2]["score"] < 0.75
    assert got[3]["labels"] == "mit" and len(got[3]["spans"]) == 3


def test_license_time_grows_with_the_text(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "some words of a long text and more all rights reserved " * (n // 10))], "doc_id int, text string")
        start = time.perf_counter()
        assert license_scan.scan(df).first()["n_base"] == n // 10
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(160_000) < 4 * max(seconds(40_000), 1.0)


def test_mixing(spark, docs, odd, none):
    got = QUERIES["op9_source_mixing"](spark, SF_DIR).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = brute.water_targets(sizes, weights, 1.5 * sum(sizes.values()))
    assert all(abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - want[s]) <= 16 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in source_mixing.mix(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert source_mixing.mix(odd).count() == 10 and source_mixing.mix(none).count() == 0


def test_highest_quotients(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    for n, seats in ((1, 5), (3, 0), (5, 7), (12, 100)):
        w = [float(x) for x in rng.integers(1, 1000, n)]
        table = spark.createDataFrame([(i, x, seats) for i, x in enumerate(w)], "p int, w double, seats long")
        got = {r["p"]: r["won"] for r in source_mixing.apportion(table, [], [F.col("p")], "w", "seats").collect()}
        want = [0] * n
        for _ in range(seats):
            want[max(range(n), key=lambda i: (w[i] / (2 * want[i] + 1), -i))] += 1
        assert [got[i] for i in range(n)] == want


def test_quality_rules(spark, docs, odd, none, labels):
    got = rows(QUERIES["op10_quality_rules"](spark, SF_DIR))
    for r in docs.collect():
        g = got[r["doc_id"]]
        want = brute.measures(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g["base_failed"] and g["kept"])
    strange = quality_rules.judge(odd, labels).collect()
    assert len(strange) == 10
    assert [brute.measures(LONG)[4]] == [r["n_repeat_words"] for r in strange if r["doc_id"] == 5][:1]
    assert quality_rules.judge(none, labels).count() == 0


def test_allowed_failures(spark):
    from math import comb

    from pyspark.sql import functions as F

    table = spark.createDataFrame([(n,) for n in (1, 50, 700, 1500)], "n long")
    got = {r["n"]: r["most"] for r in table.select("n", quality_rules._allowed(F.col("n"), 0.01, 0.002).alias("most")).collect()}
    for n, most in got.items():
        tail, want = 0.0, -1
        for k in range(n + 1):
            tail += comb(n, k) * 0.01**k * 0.99 ** (n - k)
            if tail > 0.002:
                break
            want = k
        assert most == want


def test_hash_is_the_public_one(spark):
    got = spark.sql("select xxhash64('a b c d') as h").first()["h"]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b c d", 42)


def test_sql_matches(spark):
    from vozmill.llm.oracles import ORACLES

    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF_DIR)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        got = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
        assert got == sorted(tuple(str(v) for v in r) for r in cursor.fetchall()), name


def test_decontamination_fit_reads_every_text(spark, docs, monkeypatch):
    """No filter stands between the texts and the fit, and its first pass is shared by the blocks of items."""
    plans, sketches, fit, sketch = [], [], decontamination.latent_space, decontamination.corpus_sketch
    monkeypatch.setattr(decontamination, "latent_space", lambda texts, *a: plans.append(texts._jdf.queryExecution().toString()) or fit(texts, *a))
    monkeypatch.setattr(decontamination, "corpus_sketch", lambda *a: sketches.append(1) or sketch(*a))
    asked = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(6)], "item_id long, text string")
    decontamination.find_contaminated(docs, asked, block_items=2)
    assert plans and not any("- Filter " in p or "Sample" in p for p in plans) and len(sketches) == 1


def test_hashed_lines_make_no_object_per_band_or_half(spark):
    docs = spark.createDataFrame(
        [(1, "A  long line\nshort\n\na long LINE"), (2, None), (None, "another long line"), (3, "\n \n")], "id long, text string"
    )
    rows = {(r.id, r.line_no): r for r in line_dedup.hashed_lines(docs, 8).collect()}
    assert sorted(rows, key=str) == sorted([(1, 0), (1, 1), (1, 3), (None, 0)], key=str)
    for key, line in {(1, 0): b"a long line", (1, 1): b"short", (1, 3): b"a long line", (None, 0): b"another long line"}.items():
        whole = xxhash.xxh3_128_intdigest(line)
        assert (rows[key].h1, rows[key].h2) == ((whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63))
    long, other = (line_dedup.band_values([x]).view(np.int64)[0].tolist() for x in (b"a long line", b"another long line"))
    assert [rows[k].bands for k in [(1, 0), (1, 1), (1, 3), (None, 0)]] == [long, None, None, other]
    assert line_dedup._signed([bytes(8), b"\xff" * 8]).tolist() == [-(1 << 63), (1 << 63) - 1]
