"""The pipeline's stages, each held against plain versions on its own input."""

import os

import brute
import corpus_pipeline
from vozmill.llm import line_dedup, quality_rules
from vozmill.llm.common import stored

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF_DIR))
        seen[name] = (before, docs)
        assert docs.columns[: len(columns)] == columns
    assert all(after.columns == columns for name, (_, after) in seen.items() if name != "source_mixing")

    before, after = seen["quality_rules"]
    judged = quality_rules.judge(before, spark.read.parquet(f"{SF_DIR}/labels.parquet")).where("kept").collect()
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in judged}

    before, after = seen["simhash_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    prints = [brute.fingerprint(t) for _, t in rows]
    near = [(a, b) for b in range(len(rows)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 4]
    first = {rows[g][0] for g in brute.groups(len(rows), near)}
    assert {r["doc_id"] for r in after.collect()} == first

    before, after = seen["decontamination"]
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in before.collect() if not any(i in " ".join(r["text"].lower().split()) for i in items)}
    left = {r["doc_id"] for r in after.collect()}
    assert left <= clean and len(left) >= 0.98 * len(clean)

    before, after = seen["source_mixing"]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    assert after.where("taken <= 0 or taken > 2 * size").count() == 0


ODD_COLUMNS = ("size", "source_size", "target", "taken", "n_removed", "row", "key", "digest", "__id", "__gone", "__dropped", "h", "stratum")
GOOD = " ".join(f"word{i} is here" for i in range(40))


def odd_documents(spark):
    """Nulls in every column, repeated and null ids, long texts, and columns named like inner ones."""
    texts = [
        (1, GOOD, "en", "a"), (1, GOOD, "en", "a"), (1, "short", "en", "a"), (None, GOOD + " tail", None, None),
        (None, None, None, None), (2, "", "fr", "b"), (3, "long text with many words " * 20_000, "en", "b"),
        (4, GOOD.upper(), "de", "c"), (None, " ".join(f"other{i} words stay" for i in range(60)), "en", "a"),
        (5, " ".join(f"third{i} text here" for i in range(60)), None, "c"),
        (5, " ".join(f"fourth{i} text here" for i in range(60)), "en", "c"),
    ]
    rows = [(i, t, lang, source, None if t is None else len(t), *["x"] * len(ODD_COLUMNS)) for i, t, lang, source in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in ODD_COLUMNS)
    return spark.createDataFrame(rows, schema)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF_DIR))
        seen[name] = (before.collect(), docs.collect())
        assert docs.columns[: len(columns)] == columns
    # Quality by row: short, empty and null texts go, whatever their ids; the others of those ids stay.
    kept = [r["text"] for r in seen["quality_rules"][1]]
    assert kept.count(GOOD) == 2 and GOOD + " tail" in kept and None not in kept and "" not in kept and "short" not in kept
    # One of each group: the two equal rows, the upper-case one and the longer one are near copies.
    prints = {}
    for r in seen["simhash_dedup"][0]:
        prints.setdefault(brute.fingerprint(r["text"]), []).append(r)
    fps = sorted(prints)
    near = [(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 4]
    groups = brute.groups(len(fps), near)
    after = seen["simhash_dedup"][1]
    assert len(after) == len(set(groups))
    assert {groups[fps.index(brute.fingerprint(r["text"]))] for r in after} == set(groups)
    assert len(seen["decontamination"][1]) == len(after)
    assert {"mix_size", "mix_source_size", "mix_target", "mix_taken"} <= set(docs.columns)
    assert all(0 < r["mix_taken"] <= 2 * r["mix_size"] for r in seen["source_mixing"][1])


def test_lines_of_the_pipeline(spark):
    """The line stage takes out exactly the lines that the operator removes, and none that stands once."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    after = {r["doc_id"]: r for r in corpus_pipeline.lines(spark, docs, SF_DIR).collect()}
    lines, owner = {}, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        for n, line in enumerate(r["text"].split("\n")):
            key = line_dedup.normal(line.encode())
            if line.split():
                owner.setdefault(key, (r["doc_id"], n))
                lines.setdefault(r["doc_id"], []).append((n, line, key))
    for doc, found in lines.items():
        left = after[doc]["text"].split("\n")
        repeated = [line for n, line, key in found if owner[key] != (doc, n)]
        assert all(left.count(line) <= [x for _, x, _ in found].count(line) - 1 for line in set(repeated))
        assert after[doc]["n_chars"] == len(after[doc]["text"])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR))
    assert docs.count() == 0
