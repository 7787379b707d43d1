"""Text, date and id expressions on hand-made values."""

import datetime as dt
import hashlib
import time
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vozmill.functions import dates, ids, text
from vozmill.functions.values import label_of, percent, resolve_column, title_label_of, to_bool, to_number, with_aliases

AS_OF = "2024-12-31 00:00:00"


def test_blanks_are_unicode_aware(values):
    texts = ["\ta  b\n c ", None, "", " \x1c "]
    assert values(text.collapse_spaces, texts) == ["a b c", "", "", ""]
    assert values(text.strip, [" \tx y ", None]) == ["x y", ""]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_collapse_equals_split_and_join(values, texts):
    texts = [t.replace("\x00", "") for t in texts]
    assert values(text.collapse_spaces, texts) == [" ".join(t.split()) for t in texts]


def test_fold(values):
    got = values(text.fold_text, ["  Reputação  de\tÉPOCA ", "ÀÉÎÕÜ ñ", "é", "Ａｂ"])
    assert got == ["reputacao de epoca", "aeiou n", "e", "ab"]


def test_boilerplate_and_cut(values):
    texts = [
        "Atraso no pedido - Empresa - Portal do Consumidor | mais",
        "Atraso - portal  do consumidor",
        "Ruim. PESQUISE REPUTAÇÃO de empresas antes de comprar agora",
        "Bom texto. Toda  empresa tem problema",
        "veja os Termos de Uso",
        None,
    ]
    assert values(text.strip_boilerplate, texts) == [
        "Atraso no pedido", "Atraso", "Ruim.", "Bom texto.", "", "",
    ]
    assert values(text.is_boilerplate, texts) == [False, False, True, True, True, False]


def test_loader_hints_keep_the_spaces(values):
    texts = ["TODA empresa tem problêma", "toda  empresa tem problema", None]
    assert values(text.has_loader_hint, texts) == [True, False, False]
    assert values(text.is_boilerplate, texts) == [True, True, False]


def test_samples(values):
    long = "abc " * 60
    assert values(lambda c: text.sample_text(c, 150), [long, "curto"]) == [
        " ".join(long.split())[:147] + "...", "curto",
    ]
    assert len(values(lambda c: text.cut_text(c, 140), [long])[0]) == 140


def test_status_negation_is_never_resolved(values):
    texts = ["Resolvida", "Não resolvida", "nao resolvido", "NÃO RESPONDIDA", "Respondida",
             "Em andamento", "sem resposta", "", None, "outra"]
    assert values(text.status_class, texts) == [
        "resolvida", "nao resolvida", "nao resolvida", "nao resolvida", "resolvida",
        "nao resolvida", "nao resolvida", "nao informada", "nao informada", "nao informada",
    ]


def test_case_reference(values):
    texts = [
        "meu PEDIDO: 12345.", "protocolo numero AB-77;", "id 9*9", "pedido nº 5512", "pedido urgente",
        "apedido 123", "ID: abc", "nada", None, "primeiro pedido sem, depois pedido 777",
    ]
    missing = "protocolo/pedido [informar]"
    assert values(text.case_reference, texts) == [
        "pedido 12345", "protocolo AB-77", "ID 9*9", "pedido 5512", missing, missing, missing,
        missing, missing, missing,
    ]


def test_authors_reviews_categories(values):
    assert values(text.clean_author, [" Ana ", "Cliente", "consumidor 7", "Anônimo", None]) == [
        "Ana", "", "", "", "",
    ]
    assert values(text.clean_review, [' "muito  bom" ', "'x'", '"\'y\'"']) == ["muito bom", "x", "y"]
    assert values(text.infer_category, ["Muita DEMORA", "gostei"]) == ["reclamacao", "elogio"]
    assert values(text.mojibake_hits, ["ÃÂâ Ã", "a", None]) == [4, 0, 0]
    assert values(text.looks_garbled, ["ÃÂâ Ã", "ÃÂâ"]) == [True, False]


def test_dates_are_decided_per_row(values):
    texts = ["01/02/2024", "2024-02-03", " 31/12/2024 ", "31/02/2024", "n/a", "", None]
    assert values(dates.parse_date, texts) == [
        dt.date(2024, 2, 1), dt.date(2024, 2, 3), dt.date(2024, 12, 31), None, None, None, None,
    ]
    texts = ["1/2/2024", "2024-2-3", "2024-02-03 10:00:00", "2024-02-03T10:00:00Z", "3/2/2024 9:05", "2024-02-03x", "1/2/24"]
    assert values(dates.parse_date, texts) == [
        dt.date(2024, 2, 1), dt.date(2024, 2, 3), dt.date(2024, 2, 3), dt.date(2024, 2, 3), dt.date(2024, 2, 3), None, None,
    ]
    assert values(dates.extract_date, ["em 05/06/2024 e 07/08/2024", "2024", "105/06/20241"]) == [
        "05/06/2024", "", "",
    ]


def test_relative_phrases(values):
    texts = ["Há 3 horas", "ha 2 dias, ontem", "Ontem", "hoje", "agora", "x"]
    assert values(dates.extract_relative, texts) == ["ha 3 hora", "ha 2 dia", "ontem", "hoje", "agora", ""]
    at = dt.datetime(2024, 12, 31)
    got = values(lambda c: dates.parse_relative(c, AS_OF), texts)
    assert got == [at - dt.timedelta(hours=3), at - dt.timedelta(days=1), at - dt.timedelta(days=1), at, at, None]


def test_ids(spark, values):
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()[:12]
    df = spark.createDataFrame(
        [(" ", "s", "2024-01-01", "olá", " https://x/y// ", "t"), ("abc", "s", None, "t", None, "t")],
        "id string, source string, day string, raw string, url string, title string",
    )
    rows = df.select(
        ids.stable_id(F.col("id"), F.col("source"), F.col("day"), F.col("raw")).alias("a"),
        ids.url_id(F.col("url"), F.col("title"), F.col("day")).alias("b"),
        ids.merge_key(F.col("url"), F.col("id")).alias("c"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (sha("s|2024-01-01|olá"), sha("https://x/y"), "url::https://x/y"),
        ("abc", sha("t||"), "id::abc"),
    ]


def test_values(spark, values):
    assert values(to_bool, ["Sim", " YES ", "0", None]) == [True, True, False, False]
    assert values(lambda c: to_number(c, 3, 1, 5), ["9", "x", None, "2.5"]) == [5.0, 3.0, 3.0, 2.5]
    labels = {"a": "A"}
    assert values(lambda c: label_of(c, labels), ["a", "b", None]) == ["A", "b", "-"]
    assert values(lambda c: title_label_of(c, labels), ["a", "tema_novo"]) == ["A", "Tema Novo"]
    pct = spark.createDataFrame([(1, 3), (1, 8), (0, 0), (5, 5)], "p bigint, t bigint")
    assert [r[0] for r in pct.select(percent(F.col("p"), F.col("t"))).collect()] == [33.3, 12.5, 0.0, 100.0]
    aliased = with_aliases(spark.createDataFrame([("x", 2)], "primary_theme string, priority int"))
    assert resolve_column(aliased, ["sentimento", "prioridade", "priority"]) == "prioridade"
    assert resolve_column(aliased, ["x"], "y") == "y"
    assert aliased.columns == ["primary_theme", "priority", "tema_principal", "prioridade"]


def test_folding_equals_the_standard_decomposition_of_every_character(spark):
    """Lower case is Spark's; all else is compared over all code points, alone and between letters."""
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "x" + chr(c) + "y" + chr(c)) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "i int, x string").repartition(8)
    got = df.select("i", F.lower("x").alias("low"), text.fold_accents(F.col("x")).alias("y")).collect()
    assert len(got) == len(codes)
    for r in got:
        want = "".join(c for c in unicodedata.normalize("NFKD", r["low"]) if not unicodedata.combining(c))
        assert r["y"] == want, hex(codes[r["i"]])


def test_fold_signs_of_several_letters(values):
    texts = ["ﬁm ﬄ", " ½  ㎏ №Ⅳ", "ĳ𝐀𝒷", "한국어 각", "ﷺ", "´x", "Ação ①℡", "ﬁ" * 500 + "各각" * 500]
    plain = [unicodedata.normalize("NFKD", t.strip().lower()) for t in texts]
    want = [" ".join("".join(c for c in t if not unicodedata.combining(c)).split()) for t in plain]
    assert values(text.fold_text, texts) == want
    assert want[0] == "fim ffl" and want[6] == "acao 1tel"[:5] + "1TEL"


def test_whole_numbers_keep_their_digits(values):
    texts = ["9007199254740993", " 4 ", "4.7", "-1e3", "x", None, "9223372036854775807", "1e30"]
    got = values(lambda c: to_number(c, 0, kind="bigint"), texts)
    assert got == [9007199254740993, 4, 4, -1000, 0, 0, 9223372036854775807, 0]


def _seconds(df) -> float:
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def test_words_that_are_no_numbers_cost_no_more_than_numbers(spark):
    """A failed cast raises an error inside the engine; words are told from numbers before it."""
    rows = spark.range(0, 400_000, 1, 4)
    numbers = rows.select(F.concat(F.lit("7"), F.col("id").cast("string")).alias("x"))
    words = rows.select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("x"))
    typed = lambda df: df.select(to_number(F.col("x"), 0), to_number(F.col("x"), 0, kind="bigint"))
    _seconds(typed(numbers))
    assert min(_seconds(typed(words)) for _ in range(3)) < 4 * min(_seconds(typed(numbers)) for _ in range(3))


def test_texts_at_the_border_of_numbers(spark, values):
    texts = [" 1e3\n", "\x7f5\x7f", "+.5", "5.", "0x1p3", "2d", "NaN", " -inf", "+INFINITY ", "true", "infos", "1 2", "--1", "."]
    plain = lambda c: F.coalesce(c.try_cast("double"), F.lit(-7.0))
    assert str(values(lambda c: to_number(c, -7), texts)) == str(values(plain, texts))
    assert spark.range(2).select(to_number(F.col("id") > 0)).collect() == [(0.0,), (1.0,)]


def test_signs_in_a_long_ascii_text_cost_little(spark):
    """One sign must not make every ASCII position a look-up in the class of all signs."""
    rows = spark.range(0, 400, 1, 4).withColumn("x", F.repeat(F.concat(F.lit("palavra "), F.col("id").cast("string")), 4000))
    folded = lambda mark: rows.select(text.fold_accents(F.concat("x", F.lit(mark))).alias("y"))
    _seconds(folded("ﬁ"))
    assert min(_seconds(folded("ﬁ")) for _ in range(3)) < 4 * min(_seconds(folded("ç")) for _ in range(3))


def test_collapsed_texts_pass_as_they_are(values):
    texts = ["a b", " a  b ", "a\u00a0b", "a \u2003 b", "\x1ca\x85b", "Reclamação é", "", None, "a\tb c"]
    assert values(text.collapse_again, texts) == [" ".join((t or "").split()) for t in texts]
    flat = [
        "Caso um - Empresa - Portal do Consumidor 2024", "Caso - PORTAL DO CONSUMIDOR", "portal sem - consumidor fim",
        "antes Toda Empresa tem problema depois", "toda a empresa", "pesquise reputaÇÃo de empresas antes de comprar x", "",
    ]
    assert values(text.cut_footer, flat) == ["Caso um", "Caso", flat[2], "antes", flat[4], "", ""]
    assert values(lambda c: text.cut_footer(c, "Loja", "Sítio"), ["Caso - Loja - sítio a", "toda empresa tem problema"]) == ["Caso", ""]
