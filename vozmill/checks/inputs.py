"""Inputs of the registered queries, derived from the given tables.

Each input is a list of (column, expression) over one table; the expressions run
unchanged on Spark and, as a SELECT, in SQL (only "replace all" differs). All
rows and whole texts are used; phrases, keys, dates and statuses are added by
row number, because the given texts hold no customer feedback. Rows without a text
of their own come on top, with numbers from ``ADDED`` on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-12-31 00:00:00"
BASE_URL = "https://site.example.com"
PATH_REGEX = "^/loja/[^?#]+_[A-Za-z0-9-]+/?$"
NL = "chr(10)"
#: A multiple of all row number cycles below, so an added row has the keys of the row it follows.
ADDED = 720720 * 17 * 10**6
#: Row numbers of further rows that a query adds to an input.
EXTRA_ROWS = 10**16
_ADD_WHERE = "doc_id % 12 = 10 OR doc_id % 24 = 9 OR doc_id % 3 = 0"
_KIND = f"CASE WHEN doc_id >= {ADDED} THEN 3 WHEN doc_id % 5 = 3 THEN 0 ELSE doc_id % 5 END"


def _replace_all(text: str, pattern: str, by: str, engine: str) -> str:
    flag = ", 'g'" if engine == "sql" else ""
    return f"regexp_replace({text}, '{pattern}', '{by}'{flag})"


# Text without the characters that JSON strings must escape.
JSON_SAFE = "translate(text, concat('\"', chr(92), chr(10), chr(13), chr(9)), '     ')"


def _cases(number: str, options: list[str]) -> str:
    last = len(options) - 1
    arms = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options[:-1]))
    return f"CASE ({number}) {arms} ELSE {options[last]} END"


def _text(*options: str) -> list[str]:
    return ["'" + o + "'" for o in options]


def _ddmmyyyy(n: str) -> str:
    return (
        f"concat(lpad(CAST(1 + {n} % 28 AS STRING), 2, '0'), '/', "
        f"lpad(CAST(1 + {n} % 12 AS STRING), 2, '0'), '/2024')"
    )


def _iso(n: str) -> str:
    return (
        f"concat('2024-', lpad(CAST(1 + {n} % 12 AS STRING), 2, '0'), '-', "
        f"lpad(CAST(1 + {n} % 28 AS STRING), 2, '0'))"
    )


# Four rows share a key, two of the stored batch and two of the incoming one.
_KEY = "(CAST(floor(doc_id / 16) AS BIGINT) * 4 + doc_id % 4)"
_ID = f"substr(sha1(CAST({_KEY} AS STRING)), 1, 12)"
_PHRASES = _text(
    "Atraso na entrega e nao recebi o pedido 12345. ",
    "Produto com defeito, quebrou e ferrugem. Protocolo: AB-778. ",
    "Frete caro e juros na parcela. ",
    "Adorei, excelente qualidade, recomendo. ",
    "Chamado sem resposta do suporte, urgente. ",
    "Quero modelo personalizado com mais variedade. ",
    "Não recebi, atendimento péssimo, quero reembolso. ",
    "Cupom nao funciona, problema no prazo. ",
    "Troca recusada, id 9*9. ",
    "Toda empresa tem problema. ",
    "   curto ",
    "lindo e otimo mas demorou e problema  no   preco ",
)
_STATUS = _text("Resolvida", "Não respondida", "Em andamento", "nao resolvida", "")


def feedback(engine: str) -> list[tuple[str, str]]:
    """Collected feedback before normalization (base: documents).

    Every twelfth row holds only a short phrase, every 24th only a slogan, so
    equal texts occur in large groups; all others hold their whole document.
    """
    return [
        ("batch_seq", "CAST(CAST(floor(doc_id / 4) AS BIGINT) % 2 AS INT)"),
        ("row_ord", "doc_id"),
        ("feedback_id", f"CASE WHEN doc_id % 9 = 4 THEN '' ELSE {_ID} END"),
        (
            "source",
            "CASE WHEN doc_id % 7 < 3 THEN 'site_auto' WHEN doc_id % 7 = 3 THEN 'reviews' "
            "ELSE 'site_manual' END",
        ),
        (
            "source_url",
            "CASE WHEN doc_id % 10 = 7 THEN '' ELSE concat('https://site.example.com/c/', "
            f"CAST({_KEY} AS STRING), CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END) END",
        ),
        (
            "author",
            "CASE WHEN doc_id % 6 = 0 THEN 'Consumidor RA' WHEN doc_id % 6 = 1 THEN '' "
            "ELSE concat('Cliente ', CAST(doc_id % 50 AS STRING)) END",
        ),
        (
            "feedback_date",
            "CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 11 = 1 THEN 'n/a' "
            f"WHEN doc_id % 2 = 0 THEN {_ddmmyyyy('doc_id')} ELSE {_iso('doc_id')} END",
        ),
        ("status", _cases("doc_id % 5", _STATUS)),
        ("initial_category", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'reclamacao' END"),
        (
            "raw_text",
            f"concat({_cases('doc_id % 12', _PHRASES)}, "
            "text)",
        ),
    ]


def manual(engine: str) -> list[tuple[str, str]]:
    """Manual complaint table (base: documents)."""
    return [
        ("row_ord", "doc_id"),
        (
            "source_url",
            "CASE WHEN doc_id % 10 = 7 THEN '' ELSE concat(' https://site.example.com/c/', "
            "CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING), "
            "CASE WHEN doc_id % 3 = 0 THEN '/ ' ELSE '' END) END",
        ),
        ("title", f"CASE WHEN doc_id % 4 = 1 THEN '' ELSE {_cases('doc_id % 12', _PHRASES)} END"),
        ("description", "CASE WHEN text = '' THEN ' ' ELSE text END"),
        ("date", f"CASE WHEN doc_id % 11 = 0 THEN 'NaN' ELSE {_ddmmyyyy('doc_id')} END"),
        ("status", _cases("doc_id % 5", _STATUS)),
        ("initial_category", "CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'reclamacao' END"),
    ]


def seed(engine: str) -> list[tuple[str, str]]:
    """Review seed table (base: documents); the rows without text repeat each other's reviews."""
    return [
        ("row_ord", "doc_id"),
        ("author", "CASE WHEN doc_id % 6 = 1 THEN ' ' ELSE concat('Cliente ', CAST(CAST(floor(doc_id / 24) AS BIGINT) AS STRING)) END"),
        ("feedback_date", "'05/06/2024'"),
        (
            "raw_text",
            f"concat(' \"', {_cases('doc_id % 12', _PHRASES)}, text, '\" ')",
        ),
        ("initial_category", "CASE WHEN doc_id % 4 = 0 THEN 'elogio' ELSE '' END"),
        ("source_url", "CASE WHEN doc_id % 5 = 0 THEN 'https://reviews.example.com/loja' ELSE '' END"),
    ]


def replies(engine: str) -> list[tuple[str, str]]:
    """Raw model replies (base: documents); several per id, the last one counts."""
    plain = JSON_SAFE
    options = _text(
        '{"sentimento":"negativo","tema_principal":"entrega","prioridade":5,"internal_recommendation":"rastrear pedido","confianca":1.7}',
        'antes {"sentiment_label":" Positivo ","primary_theme":"atendimento","priority":"4","score_sentimento":-3} depois',
        "sem json",
        '{"sentimento":"feliz","tema_principal":"clima","prioridade":"alta","confianca":"x"}',
        '{"sentimento":"neutro","prioridade":9,"urgencia":null,"escalonamento_necessario":"sim"}',
        "{broken",
        "{}",
        '{"sentimento":"negativo","prioridade":2,"suggested_response":"Ola, sentimos muito pelo transtorno"}',
        '{"sentiment_label":null,"sentimento":"negativo","primary_theme":"PRECO_FRETE","priority":4.7,"urgency":" Alta ","confidence":"0.5"}',
        '{"sentimento":"positivo","priority":" 4 ","prioridade":1,"escalation_required":0,"score_sentimento":"0.25","internal_recommendation":"  "}',
        '{"sentimento":"negativo","priority":true,"escalation_required":true,"internal_recommendation":null,"actionable_recommendation":"ligar"}',
        '{"priority":"4.7","urgencia":"sem pressa","escalation_required":2,"confianca":null,"sentiment_score":0.125}',
        '{"tema_principal":"qualidade_produto","prioridade":-7,"resposta_sugerida_cliente":"GUIA PARA ATENDENTE: x. Checklist: y. Texto-base: z"}',
    )
    options += ["NULL", "''"]
    told = [
        "concat('{\"sentimento\":\"negativo\",\"tema_principal\":\"atendimento\",\"prioridade\":3,\"suggested_response\":\"', "
        + plain + ", '\"}')",
        "concat('{\"sentimento\":\"neutro\",\"suggested_response\":\"Prezado cliente ', " + plain + ", '\"}')",
    ]
    return [
        ("doc_id", "doc_id"),
        (
            "reply_seq",
            f"2 * (doc_id % {ADDED}) + CASE WHEN doc_id >= {ADDED} THEN doc_id % 2 ELSE 1 - doc_id % 2 END",
        ),
        ("feedback_id", _ID),
        (
            "reply",
            f"CASE WHEN doc_id >= {ADDED} THEN {_cases(f'doc_id % {len(options)}', options)} "
            f"ELSE {_cases('doc_id % 3', [told[0], told[1], told[0]])} END",
        ),
    ]


def relative(engine: str) -> list[tuple[str, str]]:
    """Relative time phrases, bare and before the whole document text (base: documents)."""
    phrase = _cases(
        "doc_id % 7",
        [
            "concat('Há ', CAST(1 + doc_id % 20 AS STRING), ' horas')",
            "concat('ha ', CAST(1 + doc_id % 9 AS STRING), ' dias')",
            "concat('ha ', CAST(1 + doc_id % 50 AS STRING), ' minutos')",
            "'Ontem'", "'hoje'", "'Agora'", "'sem data'",
        ],
    )
    return [
        ("doc_id", "doc_id"),
        ("phrase", phrase),
        ("context", f"concat(text, ' ', {phrase}, ' ', CASE WHEN doc_id % 3 = 0 THEN {_ddmmyyyy('doc_id')} ELSE '' END)"),
        ("date_str", f"CASE WHEN doc_id % 3 = 0 THEN {_ddmmyyyy('doc_id')} ELSE '' END"),
    ]


def review_pages(engine: str) -> list[tuple[str, str]]:
    """Text of review pages (base: documents): each line break of a text opens a review."""
    review = (
        f"concat({NL}, CASE WHEN doc_id % 3 = 0 THEN 'SOBRE' ELSE concat('Cliente ', CAST(doc_id % 9 AS STRING)) END, "
        f"{NL}, {_ddmmyyyy('doc_id')}, {NL}, 'TODOS', {NL})"
    )
    return [
        ("page_id", "doc_id"),
        ("url", "concat('https://reviews.example.com/', CAST(doc_id % 40 AS STRING))"),
        (
            "text",
            f"concat('Avaliacoes dos consumidores', {NL}, 'Autor ', CAST(doc_id % 50 AS STRING), {NL}, "
            f"'01/05/2024', {NL}, 'Elogios', {NL}, replace(text, {NL}, {review}))",
        ),
    ]


def embedded(engine: str) -> list[tuple[str, str]]:
    """Embedded JSON of complaint pages (base: documents)."""
    plain = JSON_SAFE
    return [
        ("page_id", "doc_id"),
        (
            "embedded_json",
            f"concat('{{\"props\":{{\"complaint\":{{\"description\":\"', {plain}, '\",\"id\":\"', "
            f"CAST(doc_id AS STRING), '\"}},\"list\":[\"', {plain}, ' fim\",7]}},\"footer\":\"termos de uso ', "
            f"{plain}, '\"}}')",
        ),
    ]


def _safe(engine: str) -> str:
    return _replace_all("text", "[<>&]", " ", engine)


_TITLE = "concat('Reclamacao ', CAST(doc_id % 97 AS STRING), ' sobre ', source, ' ', lang)"
_TAIL = "CASE WHEN doc_id % 3 = 0 THEN ' - Empresa - Portal do Consumidor' ELSE '' END"
_ENTRY_STATUS = _cases("doc_id % 5", _text("Resolvida", "Não respondida", "Em andamento", "Nao resolvida", "Nova"))
_ENTRY_REL = _cases(
    "doc_id % 4", ["concat('Há ', CAST(1 + doc_id % 20 AS STRING), ' horas')", "'ontem'", "'ha 2 dias'", "''"]
)


def listing_parts(engine: str) -> list[tuple[str, str]]:
    """The pieces of the listing pages (base: documents)."""
    return [
        ("page_id", "doc_id"),
        ("case_no", "CAST(floor(doc_id / 2) AS BIGINT)"),
        ("title", _TITLE),
        ("tail", _TAIL),
        ("status", _ENTRY_STATUS),
        ("rel", _ENTRY_REL),
        ("title2", "CASE WHEN doc_id % 2 = 0 THEN 'ver mais' ELSE concat('Outro caso ', CAST(doc_id % 31 AS STRING)) END"),
        ("body", _safe(engine)),
    ]


def listings(engine: str) -> list[tuple[str, str]]:
    """Listing pages as HTML (base: documents): two case links each, cases repeat over pages."""
    return [
        ("page_id", "doc_id"),
        ("url", "concat('https://site.example.com/loja/lista?pagina=', CAST(doc_id AS STRING))"),
        (
            "html",
            "concat('<html><head><title>Lista</title><style>p {x:1}</style></head><body><nav>"
            "<a href=\"/ajuda\">Central de ajuda da loja</a></nav>"
            "<article class=\"card\"><h3><a href=\"/loja/caso_', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING), '\">', "
            f"{_TITLE}, {_TAIL}, '</a></h3><span>', {_ENTRY_STATUS}, '</span> <em>', {_ENTRY_REL}, '</em><p>', {_safe(engine)}, "
            "'</p></article><ul><li><a href=\"/loja/outro_', CAST(doc_id AS STRING), '?ref=2\">', "
            "CASE WHEN doc_id % 2 = 0 THEN 'ver mais' ELSE concat('Outro caso ', CAST(doc_id % 31 AS STRING)) END, "
            "'</a></li></ul></body></html>')",
        ),
    ]


_H1 = "concat('Caso ', CAST(doc_id AS STRING), ' relatado por cliente')"
_DETAIL_STATUS = _cases("doc_id % 4", _text("Status: Resolvido", "Status: pendente", "Status novo", "Status: avaliada"))


def details(engine: str) -> list[tuple[str, str]]:
    """Complaint pages as HTML (base: documents): five kinds of pages."""
    plain = JSON_SAFE
    safe = _safe(engine)
    date = f"concat('<p>', {_ddmmyyyy('doc_id')}, '</p>')"
    kinds = [
        f"concat('<script id=\"__NEXT_DATA__\" type=\"application/json\">{{\"complaint\":{{\"text\":\"', {plain}, '\"}}}}</script>')",
        f"concat('<div id=\"complaint-description\">', {safe}, '</div>')",
        f"concat('<script type=\"application/ld+json\">{{\"@type\":\"Review\",\"reviewBody\":\"', {plain}, '\"}}</script>')",
        "'<p>sem texto</p>'",
        f"concat('<div class=\"box complaint-description\"><b>', {safe}, '</b></div>')",
    ]
    return [
        ("page_id", "doc_id"),
        ("url", "concat('https://site.example.com/loja/caso_', CAST(doc_id AS STRING))"),
        (
            "html",
            f"concat('<html><head><meta property=\"og:title\" content=\"Titulo social ', CAST(doc_id AS STRING), '\"></head><body>', "
            f"CASE WHEN doc_id % 6 = 5 THEN '' ELSE concat('<h1>', {_H1}, '</h1>') END, '<em>', {_DETAIL_STATUS}, '</em>', "
            f"CASE WHEN doc_id % 3 = 0 THEN {date} ELSE '' END, {_cases(_KIND, kinds)}, '</body></html>')",
        ),
    ]


def detail_parts(engine: str) -> list[tuple[str, str]]:
    """The pieces of the complaint pages (base: documents)."""
    plain = JSON_SAFE
    return [
        ("page_id", "doc_id"),
        ("url", "concat('https://site.example.com/loja/caso_', CAST(doc_id AS STRING))"),
        ("h1", f"CASE WHEN doc_id % 6 = 5 THEN '' ELSE {_H1} END"),
        ("og", "concat('Titulo social ', CAST(doc_id AS STRING))"),
        ("status_text", _DETAIL_STATUS),
        ("date_text", f"CASE WHEN doc_id % 3 = 0 THEN {_ddmmyyyy('doc_id')} ELSE '' END"),
        ("kind", _KIND),
        ("plain", plain),
        ("safe", _safe(engine)),
    ]


def raw_bytes(engine: str) -> list[tuple[str, str]]:
    """Page bytes in two encodings (base: pages)."""
    return [
        ("page_id", "page_id"),
        ("url", "url"),
        ("content", "CASE WHEN page_id % 2 = 0 THEN encode(html, 'UTF-8') ELSE encode(html, 'ISO-8859-1') END"),
    ]


#: Inputs that hold rows without text beside the documents with their whole texts.
WITH_ADDED = (feedback, manual, seed, replies, details, detail_parts)


def load(spark: SparkSession, sf_dir: str, make, table: str = "documents") -> DataFrame:
    """An input as a DataFrame."""
    scan = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    base = scan
    if make in WITH_ADDED:
        blank = scan.where(_ADD_WHERE).selectExpr(f"doc_id + {ADDED} AS doc_id", "'' AS text", "lang", "source", "n_chars")
        base = scan.select("doc_id", "text", "lang", "source", "n_chars").union(blank)
    return base.selectExpr(*[f"{expr} AS {name}" for name, expr in make("spark")])


def sql(make, table: str = "documents") -> str:
    """The same input as a SELECT."""
    if make in WITH_ADDED:
        table = (
            "(SELECT doc_id, text, lang, source, n_chars FROM documents UNION ALL "
            f"SELECT doc_id + {ADDED}, '', lang, source, n_chars FROM documents WHERE {_ADD_WHERE}) AS base"
        )
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in make("sql")) + f" FROM {table}"
