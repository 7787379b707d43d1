"""SQL of the registered queries, for an independent engine on the same tables.

Statements are put together from fragments: ``x`` is always an SQL expression.
Only fixed values (word lists, texts) are shared with the Spark side.
"""

from __future__ import annotations

import re

from vozmill import lexicon as lx
from vozmill.checks import inputs
from vozmill.checks.inputs import AS_OF, sql
from vozmill.schemas import ANALYSIS_COLUMNS, FEEDBACK_COLUMNS

ORACLES: dict[str, str] = {}

# -------------------------------------------------------------------- text fragments
_BLANK = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
NOW = f"TIMESTAMP '{AS_OF}'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_BLANK}', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{_BLANK}|{_BLANK}$', '', 'g')"


def fold(x: str) -> str:
    return collapse(f"strip_accents(lower(coalesce({x}, '')))")


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def all_of(x: str, words) -> str:
    return "(" + " AND ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def hits(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {lit(w)}) AS INT)" for w in words) + ")"


def boilerplate(x: str, hints=lx.BOILERPLATE_HINTS) -> str:
    return any_of(fold(x), hints)


def loader_hint(x: str) -> str:
    return any_of(f"strip_accents(lower(coalesce({x}, '')))", lx.BOILERPLATE_HINTS_LOADER)


def cut_site(x: str) -> str:
    patterns = [
        r"(?i)\s*-\s*empresa\s*-\s*portal\s*do\s*consumidor.*$",
        r"(?i)\s*-\s*portal\s*do\s*consumidor.*$",
        r"(?i)pesquise\s+reputa(?:cao|ção)\s+de\s+empresas\s+antes\s+de\s+comprar.*$",
        r"(?i)toda\s+empresa\s+tem\s+problema.*$",
    ]
    out = collapse(x)
    for pattern in patterns:
        out = f"regexp_replace({out}, {lit(pattern)}, '')"
    return collapse(out)


def clean(x: str) -> str:
    """strip_boilerplate"""
    cut = cut_site(x)
    return f"CASE WHEN {boilerplate(cut)} THEN '' ELSE {cut} END"


def sample(x: str, n: int) -> str:
    flat = collapse(x)
    return f"CASE WHEN length({flat}) > {n} THEN concat(substr({flat}, 1, {n - 3}), '...') ELSE {flat} END"


def status_of(x: str) -> str:
    folded = fold(x)
    return (
        f"CASE WHEN {any_of(folded, lx.UNRESOLVED_HINTS)} THEN 'nao resolvida' "
        f"WHEN {any_of(folded, lx.RESOLVED_HINTS)} THEN 'resolvida' ELSE 'nao informada' END"
    )


def short_hash(*parts: str) -> str:
    joined = " || '|' || ".join(f"coalesce({p}, '')" for p in parts)
    return f"substr(sha1({joined}), 1, 12)"


def bare(x: str) -> str:
    return f"rtrim({strip(x)}, '/')"


def day(x: str) -> str:
    text = strip(x)
    return (
        f"CASE WHEN regexp_full_match({text}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') "
        f"THEN CAST(try_strptime({text}, '%d/%m/%Y') AS DATE) "
        f"WHEN regexp_full_match({text}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
        f"THEN CAST(try_strptime({text}, '%Y-%m-%d') AS DATE) END"
    )


def reference_of(x: str) -> str:
    pattern = r"(?i)\b(protocolo|pedido|id)\b\s*(?:numero|n[º°o.]|#)?\s*[:#-]?\s*([A-Za-z0-9*._/-]{3,})"
    label = f"lower(regexp_extract({x}, {lit(pattern)}, 1))"
    code = f"trim(regexp_extract({x}, {lit(pattern)}, 2), '.,;:)')"
    return (
        f"CASE WHEN regexp_matches({code}, '[0-9*]') THEN CASE WHEN {label} = 'id' THEN 'ID ' "
        f"ELSE {label} || ' ' END || {code} ELSE {lit(lx.REFERENCE_PLACEHOLDER)} END"
    )


def author_of(x: str) -> str:
    name = strip(x)
    generic = ", ".join(lit(g) for g in lx.GENERIC_AUTHORS)
    return (
        f"CASE WHEN lower({name}) IN ({generic}) OR starts_with(lower({name}), 'consumidor') "
        f"THEN '' ELSE {name} END"
    )


def review_clean(x: str) -> str:
    return collapse(f"trim(trim({strip(x)}, '\"'), '''')")


def category(x: str) -> str:
    return f"CASE WHEN {any_of(f'lower({x})', lx.REVIEW_NEGATIVE_HINTS)} THEN 'reclamacao' ELSE 'elogio' END"


def relative_text(x: str) -> str:
    folded, pattern = fold(x), "ha\\s*([0-9]+)\\s*(hora|horas|dia|dias|minuto|minutos)"
    return (
        f"CASE WHEN regexp_matches({folded}, '{pattern}') THEN 'ha ' || regexp_extract({folded}, '{pattern}', 1) "
        f"|| ' ' || regexp_extract({folded}, '{pattern}', 2) "
        + " ".join(f"WHEN contains({folded}, '{w}') THEN '{w}'" for w in ("ontem", "hoje", "agora"))
        + " ELSE '' END"
    )


def relative_moment(x: str) -> str:
    folded, pattern = fold(x), "ha\\s*([0-9]+)\\s*(hora|horas|dia|dias|minuto|minutos)"
    amount = f"TRY_CAST(regexp_extract({folded}, '{pattern}', 1) AS INT)"
    unit = f"regexp_extract({folded}, '{pattern}', 2)"
    return (
        f"CASE WHEN contains({folded}, 'agora') OR contains({folded}, 'hoje') THEN {NOW} "
        f"WHEN contains({folded}, 'ontem') THEN {NOW} - INTERVAL 1 DAY "
        f"WHEN {unit} = 'hora' THEN {NOW} - to_hours({amount}) "
        f"WHEN {unit} = 'dia' THEN {NOW} - to_days({amount}) "
        f"WHEN {unit} = 'minuto' THEN {NOW} - to_minutes({amount}) END"
    )


def labels_of(x: str, labels: dict[str, str], other: str) -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in labels.items())
    return f"CASE {x} {arms} ELSE {other} END"


def label(x: str, labels: dict[str, str]) -> str:
    return f"coalesce({labels_of(x, labels, x)}, '-')"


def pct(part: str, total: str) -> str:
    return (
        f"CASE WHEN {total} = 0 THEN 0.0::DOUBLE ELSE "
        f"CAST((2000 * {part} + {total}) // (2 * {total}) AS DOUBLE) / 10 END"
    )


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# ----------------------------------------------------------------------- rule layers
def flag_columns(text: str, low: str) -> str:
    cols = [f"{hits(low, words)} AS h{i}" for i, words in enumerate(lx.THEME_KEYWORDS.values())]
    cols += [
        f"{hits(low, lx.NEGATIVE_WORDS)} AS neg",
        f"{hits(low, lx.POSITIVE_WORDS)} AS pos",
        f"{any_of(low, lx.URGENT_WORDS)} AS urgent",
    ]
    return ", ".join(cols)


def case_columns(text: str, low: str) -> str:
    return ", ".join(
        [
            f"contains({low}, 'cupom') AS coupon",
            f"{any_of(low, ['nao recebi', 'não recebi'])} AS not_received",
            f"{any_of(low, ['reembolso', 'estorno'])} AS refund",
            f"(contains({low}, 'troca') AND contains({low}, 'recus')) AS refused",
            f"{any_of(low, ['troca', 'devolu', 'cancel', 'arrependimento'])} AS exchange",
            f"{reference_of(text)} AS reference",
        ]
    )


THEME = (
    "CASE WHEN greatest(h0, h1, h2, h3, h4) = 0 THEN 'outros' "
    + " ".join(f"WHEN h{i} = greatest(h0, h1, h2, h3, h4) THEN {lit(t)}" for i, t in enumerate(lx.THEME_KEYWORDS))
    + " END"
)
SENTIMENT = "CASE WHEN neg > pos THEN 'negativo' WHEN pos > neg THEN 'positivo' ELSE 'neutro' END"
SCORE = (
    "CAST(CASE WHEN neg > pos THEN greatest(-100, -35 - 10 * neg) "
    "WHEN pos > neg THEN least(100, 35 + 10 * pos) ELSE 0 END AS DOUBLE) / 100"
)
URGENCY = "CASE WHEN urgent THEN 'alta' WHEN sentiment_label = 'negativo' THEN 'media' ELSE 'baixa' END"
PRIORITY = (
    "CAST(greatest(1, least(5, 1 + CASE WHEN sentiment_label = 'negativo' THEN 2 ELSE 0 END "
    "+ CASE urgency WHEN 'media' THEN 1 WHEN 'alta' THEN 2 ELSE 0 END "
    "+ CASE WHEN primary_theme IN ('entrega', 'qualidade_produto') THEN 1 ELSE 0 END)) AS INT)"
)
ESCALATION = "(priority >= 4 OR urgency = 'alta')"
RECOMMENDATION = (
    f"CASE WHEN sentiment_label = 'positivo' THEN {lit(lx.PRAISE_RECOMMENDATION)} ELSE "
    + labels_of("primary_theme", lx.RECOMMENDATIONS, lit(lx.RECOMMENDATIONS["outros"])) + " END"
)


def issue(w: str) -> str:
    return (
        f"CASE WHEN coupon THEN {lit(lx.ISSUE_COUPON[w])} WHEN not_received THEN {lit(lx.ISSUE_NOT_RECEIVED[w])} "
        f"WHEN refund THEN {lit(lx.ISSUE_REFUND[w])} WHEN refused THEN {lit(lx.ISSUE_EXCHANGE_REFUSED[w])} ELSE "
        + labels_of("primary_theme", lx.ISSUE_BY_THEME[w], lit(lx.ISSUE_BY_THEME[w]["outros"])) + " END"
    )


def step(w: str) -> str:
    exchange = f"WHEN exchange THEN {lit(lx.STEP_EXCHANGE)} " if w == "rules" else ""
    return (
        f"CASE WHEN coupon THEN {lit(lx.STEP_COUPON[w])} WHEN refund THEN {lit(lx.STEP_REFUND[w])} {exchange}ELSE "
        + labels_of("primary_theme", lx.STEP_BY_THEME[w], lit(lx.STEP_BY_THEME[w]["outros"])) + " END"
    )


def fill(template: str, **values: str) -> str:
    out = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if piece[:1] == "{":
            out.append(values[piece[1:-1]])
        elif piece:
            out.append(lit(piece))
    return "(" + " || ".join(out) + ")"


FAST = "urgency IN ('alta', 'critica')"
GREETING = f"CASE WHEN {author_of('author')} = '' THEN 'Ola' ELSE 'Ola, ' || {author_of('author')} END"


def reply(w: str) -> str:
    pace = f"CASE WHEN {FAST} THEN 'com prioridade maxima' ELSE 'com prioridade' END"
    return (
        f"CASE WHEN sentiment_label = 'positivo' THEN {fill(lx.PRAISE_TEXT[w], greeting=GREETING, brand=lit('Empresa'))} "
        f"ELSE {fill(lx.APOLOGY_TEXT[w], greeting=GREETING, issue=f'issue_{w}', reference='reference', priority=pace, step=f'step_{w}')} END"
    )


def guide(w: str) -> str:
    sla = f"CASE WHEN {FAST} THEN 'ate 4 horas' ELSE 'ate 1 dia util' END"
    given = (
        f"CASE WHEN internal_recommendation = '' THEN {lit(lx.VALIDATE_WITH_TEAM)} "
        f"ELSE {strip('internal_recommendation')} END"
    )
    return fill(
        lx.GUIDE_TEXT[w], issue=f"issue_{w}", reference="reference", step=f"step_{w}", sla=sla,
        text=f"text_{w}", recommendation=given,
    )


# ------------------------------------------------------------------------ CTE chains
def chain(*ctes: tuple[str, str], body: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({text})" for name, text in ctes) + " " + body


def normalized_ctes(raw: str, channel: str = "''") -> list[tuple[str, str]]:
    """Normalized feedback as ``norm`` from a SELECT of collected feedback."""
    texts = [f"{strip('raw_text')} AS raw_text" if c == "raw_text" else
             (f"{channel} AS channel" if c == "channel" else f"{c}") for c in FEEDBACK_COLUMNS]
    date_text = "coalesce(CAST(feedback_date AS VARCHAR), '')"
    return [
        ("raw_rows", raw),
        ("trimmed", f"SELECT {', '.join(texts)}, batch_seq, row_ord FROM raw_rows"),
        ("dated", f"SELECT * REPLACE ({day('feedback_date')} AS feedback_date) FROM trimmed WHERE length(raw_text) >= 10"),
        (
            "named",
            "SELECT * REPLACE (CASE WHEN trim(feedback_id) <> '' THEN feedback_id ELSE "
            f"{short_hash('source', date_text, 'raw_text')} END AS feedback_id) FROM dated",
        ),
        (
            "norm",
            f"SELECT {', '.join(FEEDBACK_COLUMNS)}, {NOW} AS ingested_at, batch_seq, row_ord FROM named "
            "QUALIFY row_number() OVER (PARTITION BY source, feedback_date, raw_text ORDER BY batch_seq, row_ord) = 1",
        ),
    ]


def label_ctes(source: str = "norm", low: str = "lower(raw_text)") -> list[tuple[str, str]]:
    """Rule labels as ``labelled``."""
    return [
        ("lowered", f"SELECT *, {low} AS low FROM {source}"),
        ("flagged", f"SELECT *, {flag_columns('raw_text', 'low')}, {case_columns('raw_text', 'low')} FROM lowered"),
        ("felt", f"SELECT *, {SENTIMENT} AS sentiment_label, {SCORE} AS sentiment_score, {THEME} AS primary_theme FROM flagged"),
        ("urged", f"SELECT *, {URGENCY} AS urgency FROM felt"),
        ("ranked", f"SELECT *, {PRIORITY} AS priority FROM urged"),
        ("labelled", f"SELECT *, {ESCALATION} AS escalation_required, {RECOMMENDATION} AS internal_recommendation FROM ranked"),
    ]


def text_ctes(source: str = "labelled") -> list[tuple[str, str]]:
    """Issue, step, reply text in both wordings as ``worded``."""
    return [
        ("cased", f"SELECT *, {issue('rules')} AS issue_rules, {step('rules')} AS step_rules, {issue('model')} AS issue_model, {step('model')} AS step_model FROM {source}"),
        ("worded", f"SELECT *, {reply('rules')} AS text_rules, {reply('model')} AS text_model FROM cased"),
    ]


NORM = normalized_ctes(sql(inputs.feedback))
LABELLED = NORM + label_ctes()
WORDED = LABELLED + text_ctes()
BASE_OUT = ", ".join([*FEEDBACK_COLUMNS, "ingested_at", "batch_seq", "row_ord"])
ANALYSIS_OUT = ", ".join(ANALYSIS_COLUMNS)
ANALYZED = WORDED + [
    (
        "analyzed",
        f"SELECT {BASE_OUT}, sentiment_label, sentiment_score, primary_theme, urgency, priority, internal_recommendation, "
        f"{guide('rules')} AS response_guide, escalation_required, 'rules' AS provider, "
        f"{lit(lx.RULES_MODEL)} AS model_used, CAST(0.62 AS DOUBLE) AS confidence, {lit(lx.NOTE_MISSING)} AS analysis_notes FROM worded",
    )
]


# ---------------------------------------------------------------------- reply layers
def kind(key: str) -> str:
    return f"json_type(j, '$.{key}')"


def first_present(keys: list[str], of: str) -> str:
    """``of`` is a template over a key, taken for the first key that is present."""
    arms = " ".join(f"WHEN {kind(k)} IS NOT NULL THEN {of.format(k=k)}" for k in keys)
    return f"CASE {arms} END"


def key_columns(name: str) -> str:
    keys = lx.REPLY_KEYS[name]
    return (
        f"{first_present(keys, chr(39).join(['json_extract_string(j, ', '$.{k}', ')']))} AS {name}_v, "
        f"{first_present(keys, chr(39).join(['json_type(j, ', '$.{k}', ')']))} AS {name}_t"
    )


NUMERIC = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')"


def shown(name: str) -> str:
    """Text of a picked value: null is "None", booleans are capitalized."""
    return (
        f"CASE {name}_t WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN "
        f"CASE {name}_v WHEN 'true' THEN 'True' ELSE 'False' END ELSE {name}_v END"
    )


def enum(name: str, allowed: list[str], default: str) -> str:
    value = f"lower({strip(shown(name))})"
    return f"CASE WHEN {name}_t IS NOT NULL AND {value} IN ({', '.join(map(lit, allowed))}) THEN {value} ELSE {lit(default)} END"


PRIORITY_RAW = (
    f"coalesce(CASE WHEN priority_t IN {NUMERIC} THEN CAST(trunc(CAST(priority_v AS DOUBLE)) AS BIGINT) "
    "WHEN priority_t = 'BOOLEAN' THEN CASE priority_v WHEN 'true' THEN 1 ELSE 0 END "
    f"WHEN priority_t = 'VARCHAR' AND regexp_full_match({strip('priority_v')}, '[+-]?[0-9]+') THEN CAST({strip('priority_v')} AS BIGINT) END, 3)"
)


def real(name: str, default: float) -> str:
    return (
        f"coalesce(CASE WHEN {name}_t IN {NUMERIC} THEN CAST({name}_v AS DOUBLE) "
        f"WHEN {name}_t = 'BOOLEAN' THEN CASE {name}_v WHEN 'true' THEN 1.0 ELSE 0.0 END "
        f"WHEN {name}_t = 'VARCHAR' THEN TRY_CAST({strip(f'{name}_v')} AS DOUBLE) END, CAST({default} AS DOUBLE))"
    )


REPLY_URGENCY = (
    f"CASE WHEN urgency_t IS NULL OR {strip(shown('urgency'))} = '' THEN "
    "CASE WHEN priority_raw >= 5 THEN 'critica' WHEN priority_raw >= 4 THEN 'alta' "
    "WHEN priority_raw <= 2 THEN 'baixa' ELSE 'media' END "
    f"ELSE {enum('urgency', lx.URGENCIES, 'media')} END"
)
REPLY_FLAG = (
    f"coalesce(CASE WHEN escalation_t IN {NUMERIC} THEN CAST(escalation_v AS DOUBLE) <> 0 "
    "WHEN escalation_t = 'BOOLEAN' THEN escalation_v = 'true' "
    f"WHEN escalation_t IS NOT NULL THEN lower({strip(shown('escalation'))}) IN ({', '.join(map(lit, lx.TRUE_WORDS))}) END, false)"
)


def nonblank(name: str, default: str) -> str:
    options = []
    for key in lx.REPLY_KEYS[name]:
        value = f"json_extract_string(j, '$.{key}')"
        options.append(
            f"CASE WHEN {kind(key)} IS NULL OR {kind(key)} = 'NULL' OR {value} IN ('', '[]', '{{}}') "
            f"OR ({kind(key)} = 'BOOLEAN' AND {value} = 'false') "
            f"OR ({kind(key)} IN {NUMERIC} AND TRY_CAST({value} AS DOUBLE) = 0) THEN NULL ELSE {value} END"
        )
    text = strip(f"coalesce({', '.join(options)}, {lit(default)})")
    return f"CASE WHEN {text} = '' THEN {lit(default)} ELSE {text} END"


_BLOCK = (
    "CASE WHEN reply IS NULL OR reply = '' THEN '{}' "
    "ELSE nullif(regexp_extract(reply, '(?s)\\{.*\\}'), '') END"
)


def reply_ctes(source: str) -> list[tuple[str, str]]:
    """Validated labels ``m_*`` as ``answers``, valid replies only; ``source`` has a reply column."""
    names = ("sentiment", "theme", "priority", "urgency", "score", "confidence", "escalation")
    return [
        ("blocks", f"SELECT *, {_BLOCK} AS block FROM {source}"),
        (
            "parsed",
            "SELECT *, coalesce(json_valid(block), false) AS valid, "
            "CASE WHEN json_valid(block) THEN CAST(block AS JSON) END AS j FROM blocks",
        ),
        ("picked", f"SELECT *, {', '.join(key_columns(n) for n in names)} FROM parsed"),
        ("numbered", f"SELECT *, {PRIORITY_RAW} AS priority_raw FROM picked"),
        (
            "answers",
            f"SELECT *, {enum('sentiment', lx.SENTIMENTS, 'neutro')} AS m_sentiment, "
            f"{enum('theme', lx.THEMES, 'outros')} AS m_theme, {REPLY_URGENCY} AS m_urgency, "
            "CAST(greatest(1, least(5, priority_raw)) AS INT) AS m_priority, "
            f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {real('score', 0.0)})) AS m_score, "
            f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {real('confidence', 0.7)})) AS m_confidence, "
            f"{REPLY_FLAG} AS m_escalation, {nonblank('recommendation', lx.REVIEW_MANUALLY)} AS m_recommendation, "
            f"{nonblank('response', '')} AS m_response FROM numbered WHERE valid",
        ),
    ]


def generic(x: str) -> str:
    flat = collapse(f"lower({x})")
    return (
        f"(length({flat}) < {lx.GENERIC_MIN_LENGTH} OR ({hits(flat, lx.GENERIC_MARKERS)} >= 2 "
        f"AND {hits(flat, lx.SPECIFIC_MARKERS)} = 0))"
    )


def facing(x: str) -> str:
    low = f"lower({strip(x)})"
    opens = " OR ".join(f"starts_with({low}, {lit(o)})" for o in lx.DIRECT_OPENERS)
    return f"(({opens}) AND NOT {all_of(low, lx.INTERNAL_LABELS)})"


def ensured(x: str, default: str, wrapped: str) -> str:
    return (
        f"CASE WHEN {strip(x)} = '' THEN {default} WHEN {all_of(f'lower({x})', lx.GUIDE_LABELS)} THEN {strip(x)} "
        f"WHEN {facing(x)} OR {generic(x)} THEN {default} ELSE {wrapped} END"
    )


WRAPPED = fill(
    lx.GUIDE_TEXT["wrapped"], issue="issue_model", reference="reference", step="step_model",
    text=strip("m_response"),
)
MODEL_GUIDE = ensured("m_response", guide("model"), WRAPPED)


def model_ctes(source: str) -> list[tuple[str, str]]:
    """Rows of ``source`` (with m_* labels, raw_text, author) with model labels and guide as ``by_model``."""
    return [
        (
            "m_named",
            f"SELECT * , {case_columns('raw_text', 'lower(raw_text)')}, m_sentiment AS sentiment_label, m_score AS sentiment_score, "
            "m_theme AS primary_theme, m_urgency AS urgency, m_priority AS priority, m_recommendation AS internal_recommendation, "
            f"m_escalation AS escalation_required FROM {source}",
        ),
        ("m_cased", f"SELECT *, {issue('model')} AS issue_model, {step('model')} AS step_model FROM m_named"),
        ("m_worded", f"SELECT *, {reply('model')} AS text_model FROM m_cased"),
        (
            "by_model",
            f"SELECT *, {MODEL_GUIDE} AS response_guide, 'model' AS provider, 'batch_model' AS model_used, "
            f"m_confidence AS confidence, {lit(lx.NOTE_MODEL)} AS analysis_notes FROM m_worded",
        ),
    ]


ENRICHED = (
    ANALYZED
    + [
        (
            "last_replies",
            f"SELECT feedback_id, reply FROM ({sql(inputs.replies)}) "
            "QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY reply_seq DESC) = 1",
        ),
        ("answered", "SELECT norm.*, last_replies.reply FROM norm JOIN last_replies USING (feedback_id)"),
    ]
    + reply_ctes("answered")
    + model_ctes("answers")
    + [
        (
            "enriched",
            f"SELECT {BASE_OUT}, {ANALYSIS_OUT} FROM by_model UNION ALL "
            f"SELECT {', '.join('a.' + c.strip() for c in BASE_OUT.split(','))}, "
            + ", ".join(
                f"CASE WHEN r.feedback_id IS NULL THEN a.analysis_notes ELSE {lit(lx.NOTE_INVALID)} END AS analysis_notes"
                if c == "analysis_notes" else f"a.{c}" for c in ANALYSIS_COLUMNS
            )
            + " FROM analyzed a LEFT JOIN last_replies r ON a.feedback_id = r.feedback_id "
            "WHERE NOT EXISTS (SELECT 1 FROM by_model m WHERE m.batch_seq = a.batch_seq AND m.row_ord = a.row_ord)",
        )
    ]
)


# ------------------------------------------------------------------- sources and sets
def _raw(body: str, *more: tuple[str, str]) -> str:
    return chain(("f", sql(inputs.feedback)), *more, body=body)


def _known(x: str) -> str:
    return f"CASE WHEN {x} = 'NaN' THEN '' ELSE {x} END"


MANUAL = [
    ("manual_raw", sql(inputs.manual)),
    (
        "manual_rows",
        f"SELECT {short_hash(bare('source_url'))} AS url_hash, {short_hash('title', _known('date'), 'source_url')} AS text_hash, "
        f"{bare('source_url')} AS bare_url, {strip('source_url')} AS source_url, {strip(_known('date'))} AS feedback_date, "
        f"{strip('title')} AS t, {strip('description')} AS d, coalesce(nullif({strip('initial_category')}, ''), 'reclamacao') AS initial_category, "
        f"{strip('status')} AS status, row_ord FROM manual_raw",
    ),
    (
        "manual_all",
        "SELECT CASE WHEN bare_url <> '' THEN url_hash ELSE text_hash END AS feedback_id, 'site_manual' AS source, source_url, "
        "'Consumidor RA' AS author, feedback_date, CASE WHEN t = '' THEN d WHEN d = '' THEN t ELSE t || ' ' || d END AS raw_text, "
        "initial_category, 'complaint_site' AS channel, status, row_ord FROM manual_rows",
    ),
]
ORACLES["manual_load"] = chain(
    *MANUAL, body=f"SELECT * FROM manual_all WHERE {status_of('status')} <> 'resolvida' AND length(raw_text) >= 10"
)
ORACLES["manual_load_limit"] = chain(
    *MANUAL,
    ("first_rows", f"SELECT * FROM manual_all WHERE {status_of('status')} <> 'resolvida' ORDER BY row_ord LIMIT 50"),
    body="SELECT * FROM first_rows WHERE length(raw_text) >= 10",
)
SEED = [
    ("seed_raw", sql(inputs.seed)),
    (
        "seed_rows",
        f"SELECT coalesce(nullif({strip('author')}, ''), 'Anonimo') AS author, {strip('feedback_date')} AS feedback_date, "
        f"{review_clean('raw_text')} AS raw_text, coalesce(nullif({strip('source_url')}, ''), 'https://reviews.example.com/') AS source_url, "
        "initial_category AS given, row_ord FROM seed_raw",
    ),
]
ORACLES["review_seed"] = chain(
    *SEED,
    body=f"SELECT {short_hash('author', 'feedback_date', 'raw_text', 'source_url')} AS feedback_id, 'reviews_seed' AS source, "
    f"source_url, author, feedback_date, raw_text, coalesce(nullif(given, ''), {category('raw_text')}) AS initial_category, "
    "'review_site_seed' AS channel, row_ord FROM seed_rows WHERE length(raw_text) >= 15 "
    "QUALIFY row_number() OVER (PARTITION BY author, feedback_date, raw_text, source_url ORDER BY row_ord) = 1",
)
ORACLES["scan_pages"] = "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages"
ORACLES["lenient_csv"] = _raw(
    f"SELECT row_ord, source, raw_text FROM f UNION ALL SELECT row_ord + {inputs.EXTRA_ROWS}, source, NULL FROM f WHERE row_ord % 7 = 3"
)
ORACLES["align_schema"] = chain(
    ("m", sql(inputs.manual)),
    body="SELECT '' AS feedback_id, '' AS source, source_url, '' AS author, '' AS feedback_date, '' AS raw_text, "
    "initial_category, '' AS channel, status, row_ord FROM m",
)
_ALIGNED = (
    "feedback_id, source, source_url, author, feedback_date, raw_text, initial_category, '' AS channel, status"
)
ORACLES["empty_input"] = _raw(f"SELECT {_ALIGNED} FROM f")


def merge_key() -> str:
    return (
        f"CASE WHEN {bare('source_url')} <> '' THEN 'url::' || {bare('source_url')} "
        f"WHEN {strip('feedback_id')} <> '' THEN 'id::' || {strip('feedback_id')} "
        "ELSE 'row::' || CAST(batch_seq AS VARCHAR) || ':' || CAST(row_ord AS VARCHAR) END"
    )


_BAD = f"(trim(source) = 'site_auto' AND {loader_hint('raw_text')})"
_DAY_TEXT = f"coalesce(CAST({day('feedback_date')} AS VARCHAR), '')"
_FILLED_ID = (
    f"CASE WHEN trim(feedback_id) <> '' THEN feedback_id ELSE {short_hash('source', _DAY_TEXT, strip('raw_text'))} END"
)
FILLED = [
    ("f", sql(inputs.feedback)),
    ("filled", f"SELECT {_FILLED_ID} AS feedback_id, {_ALIGNED.split(', ', 1)[1]}, batch_seq, row_ord FROM f"),
]


def upsert_ctes(stored: str, incoming: str) -> list[tuple[str, str]]:
    """Stepwise: dedupe and clean each side, union, dedupe and clean again."""

    def last(source: str) -> str:
        return (
            f"SELECT * FROM (SELECT *, {merge_key()} AS k FROM {source}) "
            "QUALIFY row_number() OVER (PARTITION BY k ORDER BY batch_seq DESC, row_ord DESC) = 1"
        )

    def cleaned(source: str) -> str:
        return f"SELECT * EXCLUDE (k) FROM {source} WHERE NOT {_BAD}"

    return [
        ("old_last", last(stored)), ("old_ok", cleaned("old_last")),
        ("new_last", last(incoming)), ("new_ok", cleaned("new_last")),
        ("both_sides", "SELECT * FROM old_ok UNION ALL BY NAME SELECT * FROM new_ok"),
        ("both_last", last("both_sides")), ("merged", cleaned("both_last")),
    ]


SIDES = FILLED + [
    ("stored", "SELECT * FROM filled WHERE batch_seq = 0"),
    ("incoming", "SELECT * FROM filled WHERE batch_seq = 1"),
]
UPSERT = SIDES + upsert_ctes("stored", "incoming")
ORACLES["upsert_merge"] = chain(*UPSERT, body="SELECT * FROM merged")
_COUNTS = (
    "SELECT (SELECT count(*) FROM old_ok) AS stored_rows, (SELECT count(*) FROM merged) AS merged_rows"
)
ORACLES["upsert_added"] = chain(
    *UPSERT, ("c", _COUNTS),
    body="SELECT *, greatest(0, merged_rows - stored_rows) AS added FROM c",
)
ORACLES["manual_upsert"] = chain(
    *SIDES, *MANUAL,
    ("loaded", "SELECT *, CAST(1 AS INT) AS batch_seq FROM manual_all WHERE length(raw_text) >= 10"),
    *upsert_ctes("stored", "loaded"),
    body="SELECT * FROM merged",
)
ORACLES["run_summary"] = chain(
    *UPSERT, ("c", _COUNTS),
    body="SELECT (SELECT count(*) FROM incoming WHERE source = 'site_auto') AS n_auto, "
    "(SELECT count(*) FROM incoming WHERE source = 'site_manual') AS n_manual, "
    "(SELECT count(*) FROM incoming) AS n_read, greatest(0, merged_rows - stored_rows) AS n_new, merged_rows AS n_total FROM c",
)
ORACLES["union_sources"] = chain(
    ("f", sql(inputs.feedback)), *MANUAL,
    body=f"SELECT {_ALIGNED}, CAST(0 AS INT) AS batch_seq, row_ord FROM f UNION ALL BY NAME "
    "SELECT *, CAST(1 AS INT) AS batch_seq FROM manual_all WHERE length(raw_text) >= 10",
)
ORACLES["fallback_source"] = _raw(
    "SELECT *, 'primary empty' AS run FROM g WHERE source = 'site_manual' UNION ALL "
    "SELECT *, 'primary present' AS run FROM g WHERE source = 'reviews'",
    ("g", f"SELECT {_ALIGNED} FROM f"),
)

# -------------------------------------------------------------------- scalar functions
ORACLES["collapse_spaces"] = _raw(f"SELECT row_ord, {collapse('raw_text')} AS flat FROM f")
ORACLES["fold_text"] = _raw(f"SELECT row_ord, {fold('raw_text')} AS folded FROM f")
ORACLES["boilerplate_flag"] = _raw(
    f"SELECT row_ord, {boilerplate('raw_text')} AS site_hints, "
    f"{loader_hint('raw_text')} AS loader_hints FROM f"
)
ORACLES["strip_boilerplate"] = _raw(
    f"SELECT row_ord, {clean('t')} AS clean FROM g",
    (
        "g",
        "SELECT row_ord, raw_text || CASE WHEN row_ord % 4 = 1 THEN ' - EMPRESA  - portal do Consumidor 2024' "
        "WHEN row_ord % 4 = 2 THEN ' Pesquise  reputação de empresas antes de comprar aqui' "
        "WHEN row_ord % 8 = 3 THEN ' Termos de Uso' ELSE '' END AS t FROM f",
    ),
)
ORACLES["sample_text"] = _raw(
    f"SELECT row_ord, {sample('raw_text', 150)} AS sample_150, {sample('raw_text', 240)} AS sample_240, "
    f"substr({collapse('raw_text')}, 1, 140) AS cut_140 FROM f"
)
ORACLES["stable_id"] = _raw(
    f"SELECT row_ord, CASE WHEN trim(feedback_id) <> '' THEN feedback_id ELSE {short_hash('source', _DAY_TEXT, 'raw_text')} END AS feedback_id FROM f"
)
ORACLES["url_id"] = chain(
    ("m", sql(inputs.manual)),
    body=f"SELECT row_ord, CASE WHEN {bare('source_url')} <> '' THEN {short_hash(bare('source_url'))} "
    f"ELSE {short_hash('title', 'date', 'source_url')} END AS feedback_id FROM m",
)
ORACLES["review_id"] = chain(
    ("s", sql(inputs.seed)),
    body=f"SELECT row_ord, {short_hash('author', 'feedback_date', 'raw_text', 'source_url')} AS feedback_id FROM s",
)
ORACLES["parse_date"] = _raw(f"SELECT row_ord, {day('feedback_date')} AS feedback_date FROM f")


def _rel(body: str) -> str:
    return chain(("r", sql(inputs.relative)), body=body)


ORACLES["extract_date"] = _rel(
    "SELECT doc_id, regexp_extract(context, '\\b([0-9]{2}/[0-9]{2}/[0-9]{4})\\b', 1) AS date_str FROM r"
)
ORACLES["extract_relative"] = _rel(
    f"SELECT doc_id, {relative_text('phrase')} AS of_phrase, {relative_text('context')} AS of_context FROM r"
)
ORACLES["parse_relative"] = _rel(f"SELECT doc_id, {relative_moment('phrase')} AS moment FROM r")
ORACLES["effective_date"] = _rel(
    f"SELECT doc_id, coalesce({day('date_str')}, CAST({relative_moment('phrase')} AS DATE)) AS day FROM r"
)
ORACLES["to_bool"] = chain(
    ("f", sql(inputs.feedback)), ("r", sql(inputs.replies)), *reply_ctes("r"),
    body="SELECT doc_id, 'label' AS kind, toxic <> 0 AS flag FROM labels UNION ALL "
    "SELECT row_ord, 'word', lower(trim(CASE WHEN row_ord % 2 = 0 THEN ' Sim ' ELSE status END)) IN ('1', 'true', 't', 'sim', 'yes', 'y') FROM f "
    "UNION ALL SELECT doc_id, 'reply', m_escalation FROM answers",
)
ORACLES["to_number"] = chain(
    (
        "w",
        "SELECT doc_id, list_concat(string_split(text, ' '), [' ' || CAST(doc_id % 13 - 3 AS VARCHAR) || "
        "CASE WHEN doc_id % 4 = 1 THEN '.5' ELSE '' END, CAST(doc_id + 9007199254740992 AS VARCHAR)]) AS words FROM documents",
    ),
    ("e", "SELECT doc_id, CAST(unnest(range(len(words))) AS INT) AS pos, unnest(words) AS word FROM w"),
    body="SELECT doc_id, pos, coalesce(TRY_CAST(trim(word) AS DOUBLE), 0.0::DOUBLE) AS plain, "
    "greatest(1.0::DOUBLE, least(5.0::DOUBLE, coalesce(TRY_CAST(trim(word) AS DOUBLE), 3.0::DOUBLE))) AS clamped, "
    "coalesce(CASE WHEN contains(word, '.') THEN CAST(trunc(TRY_CAST(trim(word) AS DOUBLE)) AS BIGINT) ELSE TRY_CAST(trim(word) AS BIGINT) END, 0) AS whole FROM e",
)
_TITLED = "CASE theme WHEN 'tema_novo' THEN 'Tema Novo' ELSE theme END"
ORACLES["theme_labels"] = chain(
    *LABELLED,
    (
        "odd",
        "SELECT row_ord, CASE WHEN row_ord % 10 = 0 THEN NULL WHEN row_ord % 10 = 1 THEN 'tema_novo' ELSE primary_theme END AS theme FROM labelled",
    ),
    body=f"SELECT row_ord, {label('theme', lx.THEME_LABELS)} AS screen_label, "
    f"{labels_of('theme', lx.REPORT_THEME_LABELS, _TITLED)} AS report_label FROM odd",
)
ORACLES["with_aliases"] = chain(
    *ANALYZED,
    body="SELECT row_ord, sentiment_label, primary_theme, priority, internal_recommendation, response_guide, "
    "internal_recommendation AS actionable_recommendation, response_guide AS resposta_sugerida_cliente, "
    "response_guide AS suggested_customer_response, response_guide AS guia_resposta_atendente, sentiment_label AS sentimento, "
    "primary_theme AS tema_principal, priority AS prioridade FROM analyzed",
)
ORACLES["status_class"] = _raw(f"SELECT row_ord, {status_of('status')} AS status_class FROM f")
ORACLES["case_reference"] = _raw(f"SELECT row_ord, {reference_of('raw_text')} AS reference FROM f")
ORACLES["clean_author"] = _raw(f"SELECT row_ord, {author_of('author')} AS author FROM f")
ORACLES["infer_category"] = _raw(f"SELECT row_ord, {category('raw_text')} AS category FROM f")
ORACLES["clean_review"] = chain(
    ("s", sql(inputs.seed)), body=f"SELECT row_ord, {review_clean('raw_text')} AS review FROM s"
)


def _marks(x: str) -> str:
    return f"CAST(length({x}) - length(translate({x}, 'ÃÂâ', '')) AS INT)"


ORACLES["mojibake_flag"] = chain(
    ("g", "SELECT doc_id, text, translate(text || regexp_replace(text, '[^é]', '', 'g') || 'Ã', 'é', 'Ã') AS garbled FROM documents"),
    body=f"SELECT doc_id, {_marks('text')} AS hits, {_marks('garbled')} AS garbled_hits, {_marks('garbled')} >= 4 AS garbled FROM g",
)


def display_columns() -> str:
    return (
        "row_ord, coalesce(strftime(feedback_date, '%d/%m/%Y'), '-') AS data, "
        f"{label('source', lx.SOURCE_LABELS)} AS fonte, {label('sentiment_label', lx.SENTIMENT_LABELS)} AS sentimento, "
        f"{label('primary_theme', lx.THEME_LABELS)} AS tema_principal, priority AS prioridade, "
        f"{label('urgency', lx.URGENCY_LABELS)} AS urgencia, CASE WHEN escalation_required THEN 'Sim' ELSE 'Nao' END AS escalacao_recomendada, "
        "internal_recommendation AS acao_recomendada, response_guide AS guia_resposta, raw_text AS feedback_original"
    )


ORACLES["display_rows"] = chain(*ANALYZED, body=f"SELECT {display_columns()} FROM analyzed")

# ------------------------------------------------------------------------- predicates
ORACLES["min_length"] = _raw(f"SELECT row_ord, raw_text FROM f WHERE length({strip('raw_text')}) >= 40")
ORACLES["status_filter"] = _raw(
    "SELECT row_ord, status, 'Todas' AS option FROM f UNION ALL "
    f"SELECT row_ord, status, 'Resolvidas' FROM f WHERE {status_of('status')} = 'resolvida' UNION ALL "
    f"SELECT row_ord, status, 'Nao Resolvidas' FROM f WHERE {status_of('status')} <> 'resolvida' UNION ALL "
    "SELECT row_ord, status, 'outra' FROM f"
)
ORACLES["time_window"] = _raw(
    f"SELECT * FROM g WHERE CAST(feedback_date AS TIMESTAMP) >= {NOW} - INTERVAL 2160 HOUR",
    ("g", f"SELECT row_ord, {day('feedback_date')} AS feedback_date FROM f"),
)
ORACLES["drop_low_quality"] = _raw(f"SELECT row_ord, source, raw_text FROM f WHERE NOT {_BAD}")
ORACLES["drop_boilerplate"] = _raw(f"SELECT row_ord, raw_text FROM f WHERE NOT {boilerplate('raw_text')}")
ORACLES["source_prefix"] = _raw("SELECT row_ord, source, raw_text FROM f WHERE starts_with(source, 'site_')")
ORACLES["multi_filter"] = chain(
    *LABELLED,
    body="SELECT row_ord, source, sentiment_label, primary_theme FROM labelled WHERE source IN ('site_auto', 'reviews') "
    "AND sentiment_label IN ('negativo', 'neutro') AND primary_theme IN ('entrega', 'atendimento', 'outros')",
)
ORACLES["high_priority"] = chain(*LABELLED, body="SELECT row_ord, priority FROM labelled WHERE priority >= 4")
ORACLES["complaint_text"] = _raw(
    f"SELECT row_ord, raw_text FROM f WHERE length({collapse('raw_text')}) >= 40 AND NOT {boilerplate(collapse('raw_text'))}"
)
ORACLES["url_pattern"] = chain(
    ("p", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"),
    body="SELECT page_id, path, regexp_matches(path, '^/(fr|de)/[0-9]+/?$') AS fits FROM p",
)

# --------------------------------------------------------------------- classification
for _name, _columns in {
    "theme": "primary_theme",
    "sentiment": "sentiment_label, sentiment_score",
    "urgency": "urgency",
    "priority": "priority",
    "escalation": "escalation_required",
    "recommendation": "internal_recommendation",
}.items():
    ORACLES[_name] = chain(*LABELLED, body=f"SELECT row_ord, {_columns} FROM labelled")
ORACLES["issue_summary"] = chain(
    *WORDED, body="SELECT row_ord, issue_rules AS rules_wording, issue_model AS model_wording FROM worded"
)
ORACLES["next_step"] = chain(
    *WORDED, body="SELECT row_ord, step_rules AS rules_wording, step_model AS model_wording FROM worded"
)
ORACLES["reply_text"] = chain(
    *WORDED, body="SELECT row_ord, text_rules AS rules_wording, text_model AS model_wording FROM worded"
)
ORACLES["response_guide"] = chain(
    *WORDED,
    body=f"SELECT row_ord, {guide('rules')} AS rules_layout, {guide('model')} AS model_layout FROM worded",
)
ORACLES["rules_classify"] = chain(*ANALYZED, body="SELECT * FROM analyzed")
ORACLES["rules_folded"] = chain(
    *NORM, *label_ctes(low="strip_accents(lower(raw_text))"),
    body="SELECT row_ord, primary_theme, sentiment_label, sentiment_score, urgency, priority FROM labelled",
)


# ---------------------------------------------------------------------- model replies
def _answers(body: str) -> str:
    return chain(("r", sql(inputs.replies)), *reply_ctes("r"), body=body)


ORACLES["json_block"] = _answers("SELECT doc_id, block, valid FROM parsed")
ORACLES["reply_fields"] = _answers(
    "SELECT doc_id, "
    + ", ".join(f"{shown(n)} AS {n}" for n in ("sentiment", "theme", "urgency", "escalation"))
    + " FROM answers"
)
ORACLES["reply_texts"] = _answers("SELECT doc_id, m_recommendation AS recommendation, m_response AS response FROM answers")
ORACLES["reply_enums"] = _answers("SELECT doc_id, m_sentiment AS sentiment, m_theme AS theme, m_urgency AS urgency FROM answers")
ORACLES["reply_numbers"] = _answers("SELECT doc_id, m_priority AS priority, m_score AS score, m_confidence AS confidence FROM answers")
ORACLES["reply_urgency"] = _answers("SELECT doc_id, m_urgency AS urgency, priority_raw AS raw_priority FROM answers")
ORACLES["generic_reply"] = _answers(f"SELECT doc_id, {generic('m_response')} AS generic FROM answers")
ORACLES["customer_facing"] = _answers(f"SELECT doc_id, {facing('m_response')} AS customer_facing FROM answers")
ORACLES["ensure_guide"] = _answers(
    f"SELECT doc_id, {ensured('m_response', lit('<default>'), lit('<wrapped>') + ' || m_response')} AS guide FROM answers"
)
ORACLES["validate_reply"] = chain(
    ("f", sql(inputs.feedback)), ("r", sql(inputs.replies)),
    ("joined", "SELECT r.doc_id, r.reply, f.raw_text, f.author FROM r JOIN f ON r.doc_id = f.row_ord"),
    *reply_ctes("joined"), *model_ctes("answers"),
    body=f"SELECT doc_id, raw_text, author, {ANALYSIS_OUT} FROM by_model",
)
ORACLES["enrich"] = chain(*ENRICHED, body="SELECT * FROM enriched")


def refreshed(x: str, rules_guide: str) -> str:
    low = f"lower({strip(x)})"
    return (
        f"CASE WHEN {strip(x)} = '' OR contains({low}, {lit(lx.OLD_GENERIC_PHRASE)}) OR NOT {all_of(low, lx.REFRESH_LABELS)} "
        f"THEN {rules_guide} ELSE {strip(x)} END"
    )


ORACLES["refresh_guides"] = chain(
    *ANALYZED,
    (
        "mixed",
        "SELECT row_ord, raw_text, response_guide AS g, CASE row_ord % 4 WHEN 1 THEN ' ' WHEN 2 THEN response_guide || "
        "'Ja acionamos o time responsavel para tratar seu caso com prioridade' WHEN 3 THEN raw_text ELSE response_guide END AS mixed_guide FROM analyzed",
    ),
    body=f"SELECT row_ord, raw_text, {refreshed('mixed_guide', 'g')} AS response_guide FROM mixed",
)
ORACLES["read_analyzed"] = chain(
    *ANALYZED,
    body="SELECT feedback_id, source, source_url, author, feedback_date, raw_text, initial_category, status, "
    f"{ANALYSIS_OUT}, batch_seq, row_ord FROM analyzed WHERE starts_with(source, 'site_')",
)

# ------------------------------------------------------------------------- extraction
ENTRIES = [
    ("parts", sql(inputs.listing_parts)),
    (
        "anchors",
        "SELECT page_id, CAST(1 AS INT) AS pos, 'https://site.example.com/loja/caso_' || CAST(case_no AS VARCHAR) AS source_url, "
        f"{clean('title || tail')} AS title, {collapse('title || tail')} || ' ' || concat_ws(' ', status, nullif(rel, ''), nullif({collapse('body')}, '')) AS block FROM parts "
        "UNION ALL SELECT page_id, CAST(2 AS INT), 'https://site.example.com/loja/outro_' || CAST(page_id AS VARCHAR) || '?ref=2', title2, title2 FROM parts",
    ),
    ("titled", f"SELECT page_id, pos, source_url, title, {collapse('block')} AS block FROM anchors WHERE length(title) >= 10"),
    (
        "snipped",
        f"SELECT *, {status_of('block')} AS status, {relative_text('block')} AS relative_text, "
        f"{clean('CASE WHEN contains(block, title) THEN substr(block, 1, strpos(block, title) - 1) || substr(block, strpos(block, title) + length(title)) ELSE block END')} AS rest FROM titled",
    ),
    (
        "entries",
        "SELECT page_id, pos, source_url, title, status, relative_text, CASE WHEN length(rest) < 20 THEN title ELSE rest END AS snippet FROM snipped",
    ),
    ("merged_entries", "SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY page_id, pos) = 1"),
]
ORACLES["link_entries"] = chain(
    *ENTRIES,
    body="SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY page_id, source_url ORDER BY pos) = 1",
)
# The entities that occur in the given pages.
_ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&#x27;": "''"}


def unescaped(x: str) -> str:
    for entity, char in _ENTITIES.items():
        x = f"replace({x}, '{entity}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


_ANCHOR = '<a href="([^"]*)">([^<]*)</a>'
ORACLES["link_entries_pages"] = chain(
    (
        "found",
        f"SELECT page_id, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS href, "
        f"unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS anchor, "
        f"unnest(range(len(regexp_extract_all(html, '{_ANCHOR}')))) AS pos FROM pages",
    ),
    ("named", f"SELECT page_id, pos, 'https://site.example.com' || href AS source_url, {clean('html_unescaped')} AS title FROM "
     f"(SELECT *, {unescaped('anchor')} AS html_unescaped FROM found)"),
    body=f"SELECT page_id, source_url, title, title AS snippet, {status_of('title')} AS status FROM named WHERE length(title) >= 10 "
    "QUALIFY row_number() OVER (PARTITION BY page_id, source_url ORDER BY pos) = 1",
)
_H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
ORACLES["page_headings"] = f"SELECT page_id, {collapse(unescaped(_H1))} AS heading FROM pages"
ORACLES["merge_entries"] = chain(*ENTRIES, body="SELECT * FROM merged_entries")
ORACLES["merge_entries_first"] = chain(
    *ENTRIES, body="SELECT * FROM merged_entries ORDER BY page_id, pos LIMIT 50"
)
# Path hints: "props.complaint.description" holds two; the other paths hold none.
JSON_CANDIDATES = [
    (
        "strings",
        f"SELECT doc_id AS page_id, CAST(0 AS INT) AS pos, {collapse(inputs.JSON_SAFE)} AS text, 2 AS hints FROM documents UNION ALL "
        "SELECT doc_id, 1, CAST(doc_id AS VARCHAR), 1 FROM documents UNION ALL "
        f"SELECT doc_id, 2, {collapse(inputs.JSON_SAFE + chr(32) + chr(124) * 2 + lit(' fim'))}, 0 FROM documents UNION ALL "
        f"SELECT doc_id, 3, {collapse(lit('termos de uso ') + chr(32) + chr(124) * 2 + chr(32) + inputs.JSON_SAFE)}, 0 FROM documents",
    ),
    (
        "candidates",
        "SELECT page_id, pos, CAST(length(text) + 60 * hints AS INT) AS score, text FROM strings "
        f"WHERE length(text) >= 40 AND NOT {boilerplate('text')}",
    ),
]
ORACLES["json_candidates"] = chain(*JSON_CANDIDATES, body="SELECT page_id, pos, score, text FROM candidates")
ORACLES["best_candidate"] = chain(
    *JSON_CANDIDATES,
    ("best", "SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1"),
    body="SELECT doc_id AS page_id, coalesce(best.text, '') AS text FROM documents LEFT JOIN best ON best.page_id = doc_id",
)


def _fitting(x: str) -> str:
    return f"(length({x}) >= 40 AND NOT {boilerplate(x)})"


DETAILS = [
    ("dp", sql(inputs.detail_parts)),
    (
        "dt",
        f"SELECT *, CASE WHEN kind IN (0, 2) THEN {collapse('plain')} WHEN kind IN (1, 4) THEN {collapse('safe')} ELSE '' END AS marked FROM dp",
    ),
    ("dx", f"SELECT *, CASE WHEN {_fitting('marked')} THEN marked ELSE '' END AS found FROM dt"),
]
# Selectors 0 and 2 match the element by id, 3 by class; position counts the selector hits.
ORACLES["block_candidates"] = chain(
    *DETAILS,
    body="SELECT page_id, CAST(p.pos AS INT) AS pos, CAST(length(found) + 200 AS INT) AS score, found AS text FROM dx, "
    "(VALUES (1, 0), (1, 1), (4, 0)) p(kind, pos) WHERE dx.kind = p.kind AND found <> ''",
)
ORACLES["ld_candidates"] = chain(
    *DETAILS,
    body="SELECT page_id, CAST(0 AS INT) AS pos, CAST(length(found) + 100 AS INT) AS score, found AS text FROM dx WHERE kind = 2 AND found <> ''",
)
ORACLES["text_cascade"] = chain(
    *DETAILS,
    body=f"SELECT page_id, {clean('CASE WHEN found <> %s THEN found ELSE %s END' % (lit(''), lit('trecho da lista de casos')))} AS description FROM dx",
)
_BODY = (
    "concat_ws(' ', nullif(h1, ''), status_text, nullif(date_text, ''), "
    f"CASE WHEN kind IN (1, 4) THEN nullif({strip('safe')}, '') WHEN kind = 3 THEN 'sem texto' END)"
)
DETAIL_ROWS = ENTRIES + DETAILS + [
    ("heads", f"SELECT url, found, h1, og, {_BODY} AS body FROM dx"),
    (
        "joined_detail",
        "SELECT e.*, h.url IS NOT NULL AS has_page, h.found, h.h1, h.og, h.body FROM merged_entries e LEFT JOIN heads h ON e.source_url = h.url",
    ),
    (
        "described",
        f"SELECT *, {clean('CASE WHEN coalesce(found, %s) <> %s THEN found ELSE snippet END' % (lit(''), lit('')))} AS page_text, "
        "CASE WHEN coalesce(h1, '') <> '' THEN h1 WHEN coalesce(og, '') <> '' THEN og ELSE title END AS page_title FROM joined_detail",
    ),
    ("context_rows", f"SELECT *, {collapse('concat_ws(%s, page_title, page_text, body)' % lit(' '))} AS context FROM described"),
    (
        "detail",
        "SELECT page_id, pos, source_url, relative_text, CASE WHEN has_page THEN page_title ELSE title END AS title, "
        f"CASE WHEN NOT has_page THEN snippet WHEN length(page_text) < 20 THEN {clean('snippet')} ELSE page_text END AS description, "
        "CASE WHEN has_page THEN regexp_extract(context, '\\b([0-9]{2}/[0-9]{2}/[0-9]{4})\\b', 1) ELSE '' END AS date_str, "
        f"CASE WHEN has_page AND {status_of('context')} <> 'nao informada' THEN {status_of('context')} ELSE status END AS status FROM context_rows",
    ),
]
ORACLES["page_detail"] = chain(*DETAIL_ROWS, body="SELECT * FROM detail")
ORACLES["complaint_records"] = chain(
    *DETAIL_ROWS,
    (
        "timed",
        f"SELECT *, coalesce({day('date_str')}, CAST({relative_moment('relative_text')} AS DATE)) AS fdate, "
        f"{collapse('title || %s || description' % lit(' '))} AS raw_text FROM detail WHERE {status_of('status')} <> 'resolvida'",
    ),
    (
        "recorded",
        f"SELECT {short_hash(bare('source_url'))} AS feedback_id, 'site_auto' AS source, source_url, 'Consumidor RA' AS author, "
        "CAST(fdate AS VARCHAR) AS feedback_date, raw_text, 'reclamacao' AS initial_category, 'complaint_site_auto' AS channel, status, page_id, pos "
        f"FROM timed WHERE CAST(fdate AS TIMESTAMP) >= {NOW} - INTERVAL 4800 HOUR AND length(raw_text) >= 20 AND NOT {boilerplate('raw_text')}",
    ),
    body="SELECT * FROM recorded QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY page_id DESC, pos DESC) = 1",
)
_LINE_END = "\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]"
_STOP = "upper(line) IN (" + ", ".join(map(lit, lx.REVIEW_STOP_LINES)) + ")"
_IS_DATE = "regexp_full_match(line, '[0-9]{2}/[0-9]{2}/[0-9]{4}')"
LINES = [
    ("rp", sql(inputs.review_pages)),
    ("pieces", f"SELECT page_id, url, regexp_split_to_array(text, '{_LINE_END}') AS a FROM rp"),
    ("numbered_lines", f"SELECT page_id, url, {collapse('unnest(a)')} AS line, unnest(range(len(a))) AS n FROM pieces"),
    (
        "page_lines",
        "SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS line_no, line FROM numbered_lines WHERE line <> ''",
    ),
    ("dated_lines", f"SELECT *, {_IS_DATE} AS is_date, {_STOP} AS is_stop FROM page_lines"),
    (
        "opened",
        "SELECT *, max(CASE WHEN is_date THEN line_no END) OVER (PARTITION BY page_id ORDER BY line_no) AS opener, "
        "last_value(CASE WHEN NOT is_date AND NOT is_stop AND length(line) <= 80 THEN line END IGNORE NULLS) OVER "
        "(PARTITION BY page_id ORDER BY line_no ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS near FROM dated_lines",
    ),
    (
        "segments",
        "SELECT page_id, any_value(url) AS url, opener AS line_no, max(CASE WHEN is_date THEN line END) AS feedback_date, "
        "coalesce(max(CASE WHEN is_date THEN near END), 'Anonimo') AS author, "
        "coalesce(string_agg(CASE WHEN NOT is_date AND NOT is_stop THEN line END, ' ' ORDER BY line_no), '') AS segment "
        "FROM opened WHERE opener IS NOT NULL GROUP BY page_id, opener",
    ),
]
ORACLES["page_lines"] = chain(*LINES, body="SELECT page_id, line_no, line FROM page_lines")
_UNTAGGED = "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
_VISIBLE = unescaped(f"regexp_replace(html, '{_UNTAGGED}', chr(10), 'g')")
ORACLES["page_lines_html"] = chain(
    ("pieces", f"SELECT page_id, regexp_split_to_array({_VISIBLE}, '{_LINE_END}') AS a FROM pages"),
    ("numbered_lines", f"SELECT page_id, {collapse('unnest(a)')} AS line, unnest(range(len(a))) AS n FROM pieces"),
    body="SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS line_no, line FROM numbered_lines WHERE line <> ''",
)
ORACLES["review_segments"] = chain(*LINES, body="SELECT page_id, line_no, feedback_date, segment FROM segments")
ORACLES["review_author"] = chain(*LINES, body="SELECT page_id, line_no, author FROM segments")
ORACLES["review_records"] = chain(
    *LINES,
    ("texts", f"SELECT *, {review_clean('segment')} AS raw_text FROM segments"),
    body=f"SELECT {short_hash('author', 'feedback_date', 'raw_text', 'url')} AS feedback_id, 'reviews' AS source, url AS source_url, author, "
    f"feedback_date, raw_text, {category('raw_text')} AS initial_category, 'review_site' AS channel, page_id, line_no FROM texts "
    "WHERE length(raw_text) >= 15 QUALIFY row_number() OVER (PARTITION BY author, feedback_date, raw_text, url ORDER BY page_id, line_no) = 1",
)

# ---------------------------------------------------------------------- deduplication
ORACLES["dedupe_url"] = _raw(
    "SELECT * EXCLUDE (k) FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY batch_seq DESC, row_ord DESC) = 1",
    ("g", f"SELECT *, {merge_key()} AS k FROM f"),
)
ORACLES["dedupe_id"] = _raw(
    "SELECT *, 'last' AS keep FROM f QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY batch_seq DESC, row_ord DESC) = 1 "
    "UNION ALL SELECT *, 'first' AS keep FROM f QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY batch_seq, row_ord) = 1"
)
ORACLES["dedupe_content"] = _raw(
    "SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source, feedback_date, raw_text ORDER BY batch_seq, row_ord) = 1"
)


# ----------------------------------------------------------------------- aggregations
def _enriched(body: str, *more: tuple[str, str]) -> str:
    return chain(*ENRICHED, *more, body=body)


_SENTIMENT_COUNTS = ", ".join(f"count(*) FILTER (sentiment_label = '{s}') AS n_{s}" for s in lx.SENTIMENTS)
ORACLES["sentiment_totals"] = _enriched(
    "SELECT *, " + ", ".join(f"{pct(f'n_{s}', 'total')} AS pct_{s}" for s in lx.SENTIMENTS) + " FROM c",
    ("c", f"SELECT count(*) AS total, {_SENTIMENT_COUNTS} FROM enriched"),
)
_THEME_TOP = "SELECT primary_theme, count(*) AS n FROM enriched GROUP BY 1 ORDER BY n DESC, primary_theme LIMIT 5"
ORACLES["theme_top"] = _enriched(_THEME_TOP)


def _top_other(where: str) -> str:
    return _enriched(
        f"SELECT primary_theme, n, {pct('n', 'total')} AS pct FROM folded, t",
        ("counts", f"SELECT primary_theme, count(*) AS n FROM enriched WHERE {where} GROUP BY 1"),
        ("placed", "SELECT *, row_number() OVER (ORDER BY n DESC, primary_theme) AS rn FROM counts"),
        ("folded", f"SELECT CASE WHEN rn <= 3 THEN primary_theme ELSE 'outros' END AS primary_theme, {big('sum(n)')} AS n FROM placed GROUP BY 1"),
        ("t", f"SELECT {big('sum(n)')} AS total FROM folded"),
    )


ORACLES["theme_top_other"] = _top_other("true")
ORACLES["theme_top_critical"] = _top_other("priority IN (4, 5)")
ORACLES["priority_share"] = _enriched(
    f"SELECT total, n_high, {pct('n_high', 'total')} AS pct_high FROM c",
    ("c", "SELECT count(*) AS total, count(*) FILTER (priority >= 4) AS n_high FROM enriched"),
)
ORACLES["escalation_count"] = _enriched("SELECT count(*) FILTER (escalation_required) AS n_escalations FROM enriched")
ORACLES["provider_coverage"] = _enriched("SELECT provider, count(*) AS n FROM enriched GROUP BY 1")
_TOP_THEME = ("top", "SELECT primary_theme AS top_theme, count(*) AS top_count FROM enriched GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
ORACLES["kpis"] = _enriched(
    f"SELECT total, {pct('negative', 'total')} AS pct_negative, top_theme, {label('top_theme', lx.THEME_LABELS)} AS top_theme_label, n_critical FROM c, top",
    ("c", "SELECT count(*) AS total, count(*) FILTER (sentiment_label = 'negativo') AS negative, count(*) FILTER (priority IN (4, 5)) AS n_critical FROM enriched"),
    _TOP_THEME,
)
_CROSS = "SELECT primary_theme, priority, count(*) AS n FROM labelled WHERE priority > 0 GROUP BY 1, 2"
ORACLES["theme_priority_cross"] = chain(*LABELLED, body=_CROSS)
ORACLES["theme_priority_pivot"] = chain(
    *LABELLED,
    body="SELECT primary_theme, " + ", ".join(f'nullif(count(*) FILTER (priority = {p}), 0) AS "{p}"' for p in range(1, 6))
    + " FROM labelled WHERE priority > 0 GROUP BY 1",
)
ORACLES["theme_order"] = _enriched(
    "SELECT *, CAST(row_number() OVER (ORDER BY n DESC, theme_label) AS INT) AS position FROM c",
    ("c", f"SELECT {label('primary_theme', lx.THEME_LABELS)} AS theme_label, count(*) AS n FROM enriched WHERE priority > 0 GROUP BY 1"),
)
ORACLES["theme_distribution"] = _enriched(
    f"SELECT primary_theme, n, {label('primary_theme', lx.THEME_LABELS)} AS theme_label FROM c",
    ("c", "SELECT coalesce(nullif(primary_theme, 'atendimento'), 'outros') AS primary_theme, count(*) AS n FROM enriched GROUP BY 1"),
)
ORACLES["filter_options"] = _enriched(
    "SELECT filter, label, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM o GROUP BY 1, 2",
    (
        "o",
        f"SELECT 'source' AS filter, source AS code, {label('source', lx.SOURCE_LABELS)} AS label FROM enriched UNION ALL "
        f"SELECT 'sentiment_label', sentiment_label, {label('sentiment_label', lx.SENTIMENT_LABELS)} FROM enriched UNION ALL "
        f"SELECT 'primary_theme', primary_theme, {label('primary_theme', lx.THEME_LABELS)} FROM enriched",
    ),
)
ORACLES["source_breakdown"] = chain(*NORM, body="SELECT source, count(*) AS n FROM norm GROUP BY 1")


def _insight_lines() -> list[str]:
    shown_label = labels_of("top_theme", lx.REPORT_THEME_LABELS, "top_theme")
    return [
        fill(lx.INSIGHT_TEXT["negative"], negative_pct=f"CAST({pct('negative', 'total')} AS VARCHAR)"),
        fill(lx.INSIGHT_TEXT["theme"], label=shown_label, count="CAST(top_count AS VARCHAR)"),
        fill(lx.INSIGHT_TEXT["priority"], high_pct=f"CAST({pct('high', 'total')} AS VARCHAR)"),
        fill(lx.INSIGHT_TEXT["coverage"], model_label=lit("modelo"), model="CAST(by_model AS VARCHAR)", rules="CAST(by_rules AS VARCHAR)"),
    ]


NUMBERS = [
    _TOP_THEME,
    (
        "numbers",
        "SELECT *, (SELECT top_theme FROM top) AS top_theme, (SELECT top_count FROM top) AS top_count FROM (SELECT count(*) AS total, "
        "count(*) FILTER (sentiment_label = 'positivo') AS positive, count(*) FILTER (sentiment_label = 'neutro') AS neutral, "
        "count(*) FILTER (sentiment_label = 'negativo') AS negative, count(*) FILTER (priority >= 4) AS high, "
        "count(*) FILTER (escalation_required) AS escalations, count(*) FILTER (provider = 'model') AS by_model, "
        "count(*) FILTER (provider = 'rules') AS by_rules FROM enriched)",
    ),
]
ORACLES["insights"] = _enriched(
    " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS line_no, {x} AS text FROM numbers" for i, x in enumerate(_insight_lines())),
    *NUMBERS,
)

# ------------------------------------------------------------------- orders and lists
_TABLE_ORDER = "feedback_date DESC NULLS LAST, source, batch_seq, row_ord"
ORACLES["normalized_order"] = chain(*NORM, body=f"SELECT row_ord, feedback_date, source, raw_text FROM norm ORDER BY {_TABLE_ORDER}")
LISTS = [
    (
        "samples",
        f"SELECT sentiment_label, position, {sample('raw_text', 150)} AS text FROM (SELECT sentiment_label, raw_text, "
        f"CAST(row_number() OVER (PARTITION BY sentiment_label ORDER BY {_TABLE_ORDER}) AS INT) AS position FROM enriched "
        "WHERE sentiment_label IN ('positivo', 'negativo')) WHERE position <= 5",
    ),
    (
        "actions",
        "SELECT position, priority, primary_theme, internal_recommendation FROM (SELECT *, "
        f"CAST(row_number() OVER (ORDER BY {_TABLE_ORDER}) AS INT) AS position FROM enriched WHERE priority >= 4) WHERE position <= 10",
    ),
    (
        "guides",
        f"SELECT position, primary_theme, {sample('response_guide', 240)} AS guide FROM (SELECT *, "
        f"CAST(row_number() OVER (ORDER BY {_TABLE_ORDER}) AS INT) AS position FROM enriched WHERE priority >= 4) WHERE position <= 10",
    ),
]
ORACLES["text_samples"] = _enriched("SELECT * FROM samples", *LISTS)
ORACLES["priority_actions"] = _enriched("SELECT * FROM actions", *LISTS)
ORACLES["priority_guides"] = _enriched("SELECT * FROM guides", *LISTS)
ORACLES["critical_cases"] = _enriched(
    f"SELECT row_number() OVER (ORDER BY priority DESC, {_TABLE_ORDER}) AS case_no, priority, "
    f"{labels_of('primary_theme', lx.REPORT_THEME_LABELS, 'primary_theme')} AS theme_label, raw_text, internal_recommendation, response_guide "
    "FROM enriched WHERE priority IN (4, 5)"
)
ORACLES["case_table"] = _enriched(f"SELECT {display_columns()} FROM enriched WHERE priority >= 4")
ORACLES["preview_rows"] = _raw(
    f"SELECT feedback_date, status, substr({collapse('raw_text')}, 1, 140) AS text FROM f ORDER BY batch_seq, row_ord LIMIT 30"
)


def report_sql(source: list[tuple[str, str]]) -> str:
    """The report over the table ``enriched`` that ``source`` makes."""

    def share(name: str, column: str) -> str:
        return f"'- {name}: ' || CAST({column} AS VARCHAR) || ' (' || CAST({pct(column, 'total')} AS VARCHAR) || '%)'"

    rows: list[str] = []

    def add(section: int, item: int, text: str, source: str = "numbers") -> None:
        rows.append(f"SELECT {section} AS section, {item} AS item, {text} AS text FROM {source}")

    for item, text in enumerate(
        [
            lit(lx.REPORT_TITLE), "''", lit(lx.REPORT_SECTIONS["summary"]),
            "'- Total de feedbacks analisados: ' || CAST(total AS VARCHAR)",
            share("Positivos", "positive"), share("Neutros", "neutral"), share("Negativos", "negative"),
            "'- Escalacoes recomendadas: ' || CAST(escalations AS VARCHAR)", "''",
        ]
    ):
        add(0, item, text)
    empty = {"positive": "positive", "negative": "negative", "themes": "total", "actions": "high", "guides": "high"}
    for section, name in enumerate(empty, start=1):
        add(section, 0, lit(lx.REPORT_SECTIONS[name]))
        add(section, 1, lit(lx.REPORT_EMPTY[name]), f"numbers WHERE {empty[name]} = 0")
        add(section, 1000, "''")
    add(6, 0, lit(lx.REPORT_SECTIONS["insights"]))
    for item, text in enumerate(_insight_lines(), start=1):
        add(6, item, f"'- ' || {text}")
    add(6, 1000, "''")
    add(7, 0, lit(lx.REPORT_SECTIONS["next"]))
    for item, text in enumerate(lx.REPORT_NEXT_STEPS, start=1):
        add(7, item, lit(text))
    rows += [
        "SELECT CASE sentiment_label WHEN 'positivo' THEN 1 ELSE 2 END, position, '- ' || text FROM samples",
        "SELECT 3, row_number() OVER (ORDER BY n DESC, primary_theme), '- ' || primary_theme || ': ' || CAST(n AS VARCHAR) FROM top5",
        "SELECT 4, position, '- Prioridade ' || CAST(priority AS VARCHAR) || ' | Tema: ' || primary_theme || ' | Acao: ' || internal_recommendation FROM actions",
        "SELECT 5, position, '- Tema: ' || primary_theme || ' | Guia sugerido: ' || guide FROM guides",
    ]
    return chain(
        *source, *NUMBERS, *LISTS, ("top5", _THEME_TOP), ("all_lines", " UNION ALL ".join(rows)),
        body="SELECT CAST(row_number() OVER (ORDER BY section, item) AS INT) AS line_no, text FROM all_lines",
    )


ORACLES["report_lines"] = report_sql(ENRICHED)

# ------------------------------------------------------------------------- composites
ORACLES["normalize_feedback"] = chain(*NORM, body="SELECT * FROM norm")
_FROM_MERGED = normalized_ctes("SELECT * FROM merged")
ORACLES["flagship"] = chain(*UPSERT, *_FROM_MERGED, *label_ctes(), body=_CROSS)
ORACLES["refresh_fallback"] = chain(
    *MANUAL,
    ("loaded", "SELECT *, CAST(0 AS INT) AS batch_seq FROM manual_all WHERE length(raw_text) >= 10"),
    ("nothing", "SELECT * FROM loaded WHERE false"),
    *upsert_ctes("nothing", "loaded"),
    *normalized_ctes("SELECT * FROM merged"),
    body="SELECT source, count(*) AS n FROM norm GROUP BY 1",
)

# Every other page is stored in a one-byte code, which holds no signs beyond it.
ORACLES["decode_pages"] = (
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html "
    "ELSE regexp_replace(html, '[^\\x{0000}-\\x{00FF}]', '?', 'g') END AS html FROM pages"
)
