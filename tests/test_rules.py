"""Rules, replies, enrichment."""

import pytest
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions import replies
from vozmill.operators import classify

LONG = "x" * 130


def labels(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    rows = classify.classify_rules(df, **options).orderBy("i").collect()
    return rows


def test_labels(spark):
    rows = labels(
        spark,
        [
            "Atraso na entrega e nao recebi", "Adorei, excelente", "Frete caro", "texto neutro", None,
            "qualidade ruim", "não recebi, péssimo", "urgente",
        ],
    )
    got = [(r.primary_theme, r.sentiment_label, r.sentiment_score, r.urgency, r.priority, r.escalation_required) for r in rows]
    assert got == [
        ("entrega", "negativo", -0.55, "alta", 5, True),
        ("outros", "positivo", 0.55, "baixa", 1, False),
        ("preco_frete", "negativo", -0.45, "media", 4, True),
        ("outros", "neutro", 0.0, "baixa", 1, False),
        ("outros", "neutro", 0.0, "baixa", 1, False),
        ("qualidade_produto", "neutro", 0.0, "baixa", 2, False),
        ("outros", "neutro", 0.0, "baixa", 1, False),
        ("outros", "neutro", 0.0, "alta", 3, True),
    ]
    assert all(1 <= r.priority <= 5 for r in rows)
    assert {r.provider for r in rows} == {"rules"} and {r.confidence for r in rows} == {0.62}


def test_theme_ties_go_to_the_declared_order(spark):
    rows = labels(spark, ["frete e prazo", "suporte e modelo"])
    assert [r.primary_theme for r in rows] == ["entrega", "atendimento"]


def test_scores_are_limited(spark):
    rows = labels(spark, [" ".join(lx.NEGATIVE_WORDS), " ".join(lx.POSITIVE_WORDS)])
    assert [r.sentiment_score for r in rows] == [-1.0, 1.0]


def test_accents_fold_only_when_asked(spark):
    texts = ["não recebi, péssimo"]
    assert labels(spark, texts)[0].sentiment_label == "neutro"
    assert labels(spark, texts, accents=True)[0].sentiment_label == "negativo"


def test_guide_text(spark):
    guide = labels(spark, ["Cupom com problema, pedido 123"])[0].response_guide
    assert guide == (
        "Guia para atendente (uso interno):\n"
        "- Dor principal a reconhecer: dificuldade para aplicar cupom e concluir compra.\n"
        "- Caso para conferir no CRM: pedido 123.\n"
        "- Proximo passo que precisa constar na resposta: validar regra promocional e ajustar oferta quando aplicavel.\n\n"
        "Checklist do atendimento:\n"
        "1. Validar status do caso no CRM/ticket.\n"
        "2. Confirmar politica aplicavel (troca, reembolso, garantia, logistica).\n"
        "3. Informar prazo de retorno ao cliente: ate 1 dia util.\n"
        "4. Registrar historico da tratativa para auditoria.\n\n"
        "Texto-base editavel (personalizar antes de enviar):\n"
        '"Ola! Sinto muito pelo ocorrido e entendo sua insatisfacao com dificuldade para aplicar cupom e concluir compra. '
        "Referente ao pedido 123, sua tratativa foi registrada com prioridade. "
        "Nosso proximo passo e validar regra promocional e ajustar oferta quando aplicavel. "
        'Retornaremos por este canal com atualizacoes objetivas."'
    )


REPLIES = [
    ('{"priority": 4.7}', 4), ('{"priority": "4"}', 4), ('{"priority": " 4 "}', 4), ('{"priority": true}', 1),
    ('{"priority": "4.7"}', 3), ('{"priority": null}', 3), ('{"priority": [5]}', 3), ("{}", 3),
    ('{"priority": 99999999999999999999}', 5), ('{"priority": -3}', 1), ('{"priority": null, "prioridade": 5}', 3),
    ('{"prioridade": 5}', 5), ('{"priority": "-99999999999999999999"}', 1),
]


@pytest.fixture(scope="module")
def reply_rows(spark):
    def run(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, reply string")
        return classify.reply_labels(df).orderBy("i").collect()

    return run


def test_priority_of_replies(reply_rows):
    rows = reply_rows([text for text, _ in REPLIES])
    assert [r.m_priority for r in rows] == [want for _, want in REPLIES]


def test_valid_and_invalid_replies(reply_rows):
    rows = reply_rows(["{}", "", None, "sem", "{x", 'a {"sentimento":"positivo"} b', "[1]", "  "])
    assert [r._valid for r in rows] == [True, True, True, False, False, True, False, False]
    assert rows[5].m_sentiment == "positivo" and rows[2].m_sentiment == "neutro"


def test_urgency_of_replies(reply_rows):
    rows = reply_rows(
        ['{"priority":9}', '{"priority":4}', '{"priority":2}', '{"priority":3}', '{"urgency":null,"priority":9}',
         '{"urgency":" ALTA "}', '{"urgencia":" ","priority":1}', '{"urgency":"x"}']
    )
    assert [r.m_urgency for r in rows] == ["critica", "alta", "baixa", "media", "media", "alta", "baixa", "media"]


def test_flags_scores_and_texts(reply_rows):
    rows = reply_rows(
        ['{"escalation_required":true}', '{"escalation_required":0}', '{"escalation_required":2}',
         '{"escalonamento_necessario":" Sim "}', '{"escalation_required":null}', "{}"]
    )
    assert [r.m_escalation for r in rows] == [True, False, True, True, False, False]
    rows = reply_rows(
        ['{"sentiment_score":-3}', '{"sentiment_score":"0.25"}', '{"sentiment_score":"1d"}', '{"sentiment_score":true}',
         '{"confidence":"x"}', '{"confianca":1.7}', "{}"]
    )
    assert [r.m_score for r in rows] == [-1.0, 0.25, 0.0, 1.0, 0.0, 0.0, 0.0]
    assert [r.m_confidence for r in rows[4:]] == [0.7, 1.0, 0.7]
    rows = reply_rows(
        ['{"internal_recommendation":"  "}', '{"internal_recommendation":"","actionable_recommendation":" b "}',
         '{"internal_recommendation":0,"actionable_recommendation":7}', "{}"]
    )
    default = "Revisar caso manualmente."
    assert [r.m_recommendation for r in rows] == [default, "b", "7", default]


def test_response_kinds(values):
    guide = "GUIA PARA ATENDENTE checklist texto-base"
    assert values(replies.is_generic, ["curto", LONG, LONG + " seguimos a disposicao retornaremos por este canal"]) == [True, False, True]
    assert values(replies.is_generic, [LONG + " seguimos a disposicao retornaremos por este canal pedido"]) == [False]
    assert values(replies.looks_customer_facing, ["Olá, tudo", "caro", "", "Prezada x"]) == [True, False, False, True]
    got = values(
        lambda c: replies.ensure_guide(c, F.lit("D"), F.lit("W")), ["", guide, "ola " + LONG, "curto", LONG]
    )
    assert got == ["D", guide, "D", "D", "W"]


def enrich(spark, feedback, answers, seq=False):
    rows = spark.createDataFrame(feedback, "feedback_id string, author string, raw_text string")
    schema = "feedback_id string, reply string" + (", reply_seq int" if seq else "")
    return {r.feedback_id: r for r in classify.enrich(rows, spark.createDataFrame(answers, schema)).collect()}


def test_enrich_uses_replies_then_rules(spark):
    feedback = [(k, "Ana", "Atraso no pedido 123") for k in ("good", "bad", "none", "null")]
    got = enrich(spark, feedback, [("good", '{"sentimento":"positivo","prioridade":2}'), ("bad", "{x"), ("null", None)])
    assert [got[k].provider for k in ("good", "bad", "none", "null")] == ["model", "rules", "rules", "model"]
    assert got["good"].sentiment_label == "positivo" and got["bad"].sentiment_label == "negativo"
    assert "Ola, Ana! Obrigado" in got["good"].response_guide
    assert got["bad"].analysis_notes == lx.NOTE_INVALID and got["none"].analysis_notes == lx.NOTE_MISSING
    assert got["null"].sentiment_label == "neutro" and got["null"].confidence == 0.7


def test_enrich_takes_the_last_reply(spark):
    got = enrich(
        spark, [("a", "", "texto qualquer")],
        [("a", '{"sentimento":"positivo"}', 1), ("a", '{"sentimento":"negativo"}', 2)], seq=True,
    )
    assert len(got) == 1 and got["a"].sentiment_label == "negativo"


def test_refresh_without_text_uses_the_static_guide(spark):
    df = spark.createDataFrame([(None,), ("guia para atendente e checklist",)], "response_guide string")
    got = [r[0] for r in classify.refresh_guides(df).collect()]
    assert got == [lx.STATIC_GUIDE, "guia para atendente e checklist"]


def test_equal_ids_get_the_replies_of_their_own_content(spark):
    rows = spark.createDataFrame(
        [("id", "a", "2024-01-01", f"Texto numero {i}", "Ana") for i in range(3)],
        "feedback_id string, source string, feedback_date string, raw_text string, author string",
    ).withColumn("feedback_date", F.col("feedback_date").cast("date"))
    asked = classify.reply_requests(rows)
    assert asked.select("content_key").distinct().count() == 3
    made = asked.where("raw_text <> 'Texto numero 2'").withColumn(
        "reply", F.when(F.col("raw_text") == "Texto numero 0", '{"tema_principal":"entrega"}').otherwise('{"tema_principal":"preco_frete"}')
    )
    for replies in (made, made.drop("source", "feedback_date", "raw_text")):
        got = {r.raw_text: (r.primary_theme, r.provider) for r in classify.enrich(rows, replies).collect()}
        assert got["Texto numero 0"] == ("entrega", "model") and got["Texto numero 1"] == ("preco_frete", "model")
        assert got["Texto numero 2"][1] == "rules"
    wrong = made.withColumn("raw_text", F.lit("another content with the same key"))
    assert {r.provider for r in classify.enrich(rows, wrong).collect()} == {"rules"}
    assert classify.enrich(rows, made).columns == classify.enrich(rows, made.select("feedback_id", "reply")).columns
