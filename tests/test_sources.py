"""Files: CSV input, snapshots, typed re-read, and a whole run."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from vozmill.checks import runs
from vozmill.operators import dedupe
from vozmill.plans import batch
from vozmill.schemas import FEEDBACK_COLUMNS, MANUAL_COLUMNS
from vozmill.sources import readers, writers

AS_OF = "2024-12-31 00:00:00"


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


MANUAL_ROWS = [
    ["https://x/1/", "Atraso na entrega", 'linha um\ncom "aspas", virgula', "01/02/2024", "Não respondida", ""],
    ["", "Título", "Produto com defeito grave", "NaN", "Resolvida", "reclamacao"],
    ["https://x/3", "curto", "", "02/02/2024", "Respondida", ""],
    ["https://x/1", "Atraso de novo", "ainda sem entrega", "03/02/2024", "Em andamento", ""],
]


def test_manual_csv(spark, tmp_path):
    path = write_csv(tmp_path / "m.csv", MANUAL_COLUMNS, MANUAL_ROWS)
    rows = readers.read_manual(spark, path).orderBy("row_ord").collect()
    assert [r.raw_text for r in rows] == [
        'Atraso na entrega linha um\ncom "aspas", virgula', "Título Produto com defeito grave",
        "Atraso de novo ainda sem entrega",
    ]
    assert rows[1].feedback_date == "" and rows[0].initial_category == "reclamacao"
    assert rows[0].feedback_id == rows[2].feedback_id and rows[0].source == "site_manual"
    limited = readers.read_manual(spark, path, status_option="Resolvidas", limit=2).collect()
    assert [r.status for r in limited] == ["Resolvida"]
    assert readers.read_manual(spark, str(tmp_path / "none.csv")).count() == 0
    bad = write_csv(tmp_path / "bad.csv", ["title", "date"], [["a", "b"]])
    with pytest.raises(ValueError, match="source_url"):
        readers.read_manual(spark, bad)


def test_seed_csv(spark, tmp_path):
    rows = [["Ana", "01/02/2024", '"Produto muito bom mesmo"', ""], ["Ana", "01/02/2024", "Produto muito bom mesmo", ""],
            ["", "02/02/2024", "Entrega com muito atraso", "x"], ["Bia", "", "curto", ""]]
    path = write_csv(tmp_path / "s.csv", ["author", "feedback_date", "raw_text", "initial_category"], rows)
    got = readers.read_review_seed(spark, path).orderBy("row_ord").collect()
    assert [(r.author, r.initial_category) for r in got] == [("Ana", "elogio"), ("Anonimo", "x")]
    assert readers.read_review_seed(spark, str(tmp_path / "none.csv")).count() == 0


def test_lenient_csv_skips_malformed_rows(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text('a,b\n1,x\n2,y,z\n3,"p\nq"\n', encoding="utf-8")
    got = readers.read_lenient_csv(spark, str(path)).orderBy("row_ord").collect()
    assert [(r.a, r.b) for r in got] == [("1", "x"), ("3", "p\nq")]


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "p1.html").write_bytes("<p>ação</p>".encode("cp1252"))
    raw = readers.scan_pages(spark, str(tmp_path), "binaryFile")
    from vozmill.operators.extract import decode_pages

    assert [r.html for r in decode_pages(raw).collect()] == ["<p>ação</p>"]


def test_snapshots(spark, tmp_path):
    raw = readers.format_manual(
        spark.createDataFrame([(*r, i) for i, r in enumerate(MANUAL_ROWS)], ", ".join(f"{c} string" for c in MANUAL_COLUMNS) + ", row_ord bigint")
    ).withColumn("batch_seq", F.lit(0))
    first, added = writers.save_upsert(spark, None, raw, str(tmp_path / "v1"))
    assert added == 2 and first.count() == 2
    second, added = writers.save_upsert(spark, str(tmp_path / "v1"), raw, str(tmp_path / "v2"))
    assert added == 0
    assert sorted(r.raw_text for r in second.collect()) == sorted(r.raw_text for r in first.collect())
    assert {r.batch_seq for r in second.collect()} == {1}
    with pytest.raises(ValueError):
        writers.save_upsert(spark, str(tmp_path / "v2"), raw, str(tmp_path / "v2") + "/")
    full = dedupe.upsert_feedback(first, raw.withColumn("batch_seq", F.lit(1)))
    assert full.count() == second.count()


def test_whole_run(spark, tmp_path):
    path = write_csv(tmp_path / "m.csv", MANUAL_COLUMNS, MANUAL_ROWS)
    auto = spark.createDataFrame(
        [("a1", "site_auto", "https://x/9", "Consumidor RA", "2024-02-05", "Adorei, excelente qualidade", "", "c", "", 0),
         ("a2", "site_auto", "https://x/8", "", "2024-02-05", "Toda empresa tem problema", "", "c", "", 1)],
        ", ".join(f"{c} string" for c in FEEDBACK_COLUMNS) + ", row_ord bigint",
    )
    replies = spark.createDataFrame([("a1", '{"sentimento":"positivo","prioridade":1}')], "feedback_id string, reply string")
    out = str(tmp_path / "run1")
    result = batch.run_batch(spark, lambda: auto, lambda: readers.read_manual(spark, path), out, AS_OF, replies=replies)
    assert result.added == 3
    assert {r.source: r.n for r in result.source_breakdown.collect()} == {"site_auto": 1, "site_manual": 2}
    lines = [r.value for r in spark.read.text(result.report_path).collect()]
    assert lines[0].startswith("# Relatorio") and "- Total de feedbacks analisados: 3" in lines
    assert any("modelo=1 e regras=2" in x for x in lines)
    analyzed = readers.read_analyzed(spark, result.analyzed_path)
    assert analyzed.count() == 3 and dict(analyzed.dtypes)["priority"] == "int"
    text_copy = writers.save_table(analyzed, str(tmp_path / "copy"), "csv")
    again = readers.read_analyzed(spark, text_copy, "csv").orderBy("feedback_id")
    assert [r.response_guide for r in again.collect()] == [r.response_guide for r in analyzed.orderBy("feedback_id").collect()]
    assert readers.read_analyzed(spark, str(tmp_path / "nothing")).count() == 0

    def broken():
        return spark.read.parquet(str(tmp_path / "missing"))

    second = batch.run_batch(spark, broken, lambda: readers.read_manual(spark, path), str(tmp_path / "run2"), AS_OF, stored_path=result.merged_path)
    assert second.added == 0 and spark.read.parquet(second.merged_path).count() == 3


def test_modes(spark):
    rows = "a string, row_ord bigint"
    auto = spark.createDataFrame([("x", 0)], rows).withColumn("source", F.lit("site_auto"))
    manual = spark.createDataFrame([("y", 0)], rows).withColumn("source", F.lit("site_manual"))

    def sources(mode, first):
        return sorted(r.source for r in batch.collect(mode, first, manual).collect())

    assert sources("both", auto) == ["site_auto", "site_manual"]
    assert sources("auto", auto) == ["site_auto"] == sources("auto_or_manual", auto)
    assert sources("manual", auto) == ["site_manual"] == sources("auto_or_manual", auto.limit(0))
    with pytest.raises(ValueError):
        batch.collect("x", auto, manual)


def test_lenient_csv_keeps_short_rows(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,,12\n13,14,15,\n")
    got = readers.read_lenient_csv(spark, str(path)).select("a", "b", "c").collect()
    assert [tuple(r) for r in got] == [("1", "2", "3"), ("4", "5", None), ("10", None, "12"), ("13", "14", "15")]


@pytest.mark.parametrize("threads", [1, 4])
def test_rows_of_several_files_follow_their_names(spark, tmp_path, threads):
    """A small file before a large one: Spark reads the large one first, the order stays by name."""
    folder = tmp_path / "many files"
    folder.mkdir()

    def rows(name, n):
        return [[f"https://x/{name}{i}", f"Titulo {name} {i}", "descricao comprida\ncom duas linhas", "01/02/2024", "", ""] for i in range(n)]

    small, large = rows("a", 3), rows("b", 4000)
    write_csv(folder / "a 1.csv", MANUAL_COLUMNS, small)
    write_csv(folder / "b.csv", MANUAL_COLUMNS, large)
    write_csv(folder / "c.csv", MANUAL_COLUMNS, [[*small[0][:1], "Titulo final", "o ultimo vence", "", "", ""]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1g" if threads == 1 else "128m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if threads == 1 else "4194304")
    try:
        first = readers.read_manual(spark, str(folder), limit=5).orderBy("row_ord").collect()
        assert [r.source_url for r in first] == [r[0] for r in small + large[:2]]
        loaded = readers.read_manual(spark, str(folder))
        ordered = [r.source_url for r in loaded.orderBy("row_ord").collect()]
        assert ordered == [r[0] for r in small + large + small[:1]]
        merged, added = writers.load_and_upsert(spark, str(folder), None, str(tmp_path / f"out{threads}"))
        assert added == 4003
        assert merged.where("source_url = 'https://x/a0'").first().raw_text == "Titulo final o ultimo vence"
        lenient = readers.read_lenient_csv(spark, str(folder)).orderBy("row_ord").collect()
        assert [r.source_url for r in lenient] == ordered
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_reviews_of_several_files_keep_the_first(spark, tmp_path):
    header = ["author", "feedback_date", "raw_text", "initial_category"]
    review = ["Ana", "01/02/2024", "gostei muito do produto"]
    (tmp_path / "in").mkdir()
    write_csv(tmp_path / "in" / "a.csv", header, [[*review, "primeira"]])
    write_csv(tmp_path / "in" / "b.csv", header, [[*review, "segunda"]] * 2000)
    rows = readers.read_review_seed(spark, str(tmp_path / "in")).collect()
    assert [r.initial_category for r in rows] == ["primeira"]


def test_load_and_upsert_without_files_keeps_the_snapshot(spark, tmp_path):
    path = write_csv(tmp_path / "m.csv", MANUAL_COLUMNS, MANUAL_ROWS)
    before, added = writers.load_and_upsert(spark, path, None, str(tmp_path / "1"))
    assert added == before.count() == 2
    after, added = writers.load_and_upsert(spark, str(tmp_path / "none.csv"), str(tmp_path / "1"), str(tmp_path / "2"))
    assert added == 0 and sorted(after.collect()) == sorted(before.collect())


def test_csv_files_of_a_run_have_bounded_size(spark, tmp_path):
    """More rows make more files, not larger ones, and the rows keep their order over all of them."""
    texts = [f"line {i}\nsecond \"quoted\", {i}" for i in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "row_ord bigint, text string").write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    size = runs._stored_bytes(spark, table)
    path = runs._files(spark, table, "row_ord", file_bytes=-(-size // 10))
    assert len([n for n in os.listdir(path) if n.startswith("part-")]) == 10
    assert [r["text"] for r in readers.read_csv(spark, path).orderBy("row_ord").collect()] == texts
