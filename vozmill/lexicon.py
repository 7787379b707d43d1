"""Fixed values of the engine: word lists, labels, texts, status words.

Everything in this file is data. The values are fixed because results must
carry exactly these codes, keywords and sentences; callers who need another
vocabulary pass their own lists to the functions that take them.
"""

# --------------------------------------------------------------------------
# codes
# --------------------------------------------------------------------------
NEGATIVE, NEUTRAL, POSITIVE = "negativo", "neutro", "positivo"
SENTIMENTS = ["positivo", "neutro", "negativo"]
THEMES = [
    "entrega",
    "qualidade_produto",
    "preco_frete",
    "atendimento",
    "portfolio_personalizacao",
    "outros",
]
OTHER_THEME = "outros"
URGENCIES = ["baixa", "media", "alta", "critica"]
STATUS_RESOLVED, STATUS_UNRESOLVED, STATUS_UNKNOWN = "resolvida", "nao resolvida", "nao informada"

# --------------------------------------------------------------------------
# Keyword lists of the rules
# --------------------------------------------------------------------------
NEGATIVE_WORDS = [
    "atraso", "demora", "demorou", "defeito", "problema", "quebrou", "rasg",
    "ferrug", "ruim", "pessim", "caro", "juros", "nao recebi",
]
POSITIVE_WORDS = [
    "adorei", "amei", "excelente", "otima", "otimo", "qualidade", "recomendo",
    "satisfeita", "satisfeito", "lindo",
]
# Declared order is the rank that settles ties between themes.
THEME_KEYWORDS = {
    "entrega": ["atraso", "entrega", "prazo", "transportadora", "nao recebi"],
    "qualidade_produto": ["qualidade", "defeito", "descasc", "ferrug", "rasg", "quebrou"],
    "preco_frete": ["preco", "caro", "frete", "juros", "parcel"],
    "atendimento": ["atendimento", "chamado", "resposta", "suporte"],
    "portfolio_personalizacao": ["modelo", "personalizado", "opcao", "variedade"],
}
URGENT_WORDS = ["urgente", "nao recebi", "ferrug", "defeito", "rasgou"]
WEIGHTY_THEMES = ["entrega", "qualidade_produto"]

# --------------------------------------------------------------------------
# Status words, boilerplate hints, review words
# --------------------------------------------------------------------------
RESOLVED_HINTS = [
    "respondida", "respondido", "resolvida", "resolvido", "avaliada", "avaliado",
    "encerrada", "encerrado", "finalizada", "finalizado", "solucionada", "solucionado",
]
# "nao resolvida/o" are listed here so that a negated status is never read as resolved.
UNRESOLVED_HINTS = [
    "nao respondida", "nao respondido", "nao resolvida", "nao resolvido",
    "sem resposta", "pendente", "aberta", "em andamento",
]
# Patterns of the slogans that cut a text to its end.
SLOGAN_PATTERNS = [
    r"pesquise\s+reputa(?:cao|[çÇ][ãÃ]o)\s+de\s+empresas\s+antes\s+de\s+comprar",
    r"toda\s+empresa\s+tem\s+problema",
]
# Words that every match of each pattern holds.
SLOGAN_WORDS = [["pesquise", "empresas", "comprar"], ["toda", "empresa", "problema"]]
BOILERPLATE_HINTS_LOADER = [
    "pesquise reputacao de empresas antes de comprar",
    "toda empresa tem problema",
]
BOILERPLATE_HINTS = [
    "pesquise reputacao de empresas antes de comprar",
    "toda empresa tem problema",
    "reclamacoes parecidas",
    "termos de uso",
    "politica de privacidade",
    "central de ajuda",
    "para consumidor",
    "para empresas",
    "ra ads",
]
REVIEW_NEGATIVE_HINTS = [
    "atraso", "demor", "ruim", "pessim", "nunca", "defeito", "problema",
    "caro", "juros", "frete", "nao recebi",
]
REVIEW_STOP_LINES = [
    "TODOS", "ELOGIOS", "RECLAMACOES", "AVALIACOES DOS CONSUMIDORES", "SOBRE",
    "ADDITIONAL LINKS",
]
GENERIC_AUTHORS = [
    "consumidor", "consumidor ra", "cliente", "anonimo", "anônimo",
    "nao informado", "não informado",
]
GENERIC_AUTHOR_PREFIX = "consumidor"
ANONYMOUS = "Anonimo"
CATEGORY_COMPLAINT, CATEGORY_PRAISE = "reclamacao", "elogio"
MOJIBAKE_LETTERS = "ÃÂâ"
MOJIBAKE_THRESHOLD = 4

# --------------------------------------------------------------------------
# Hints and weights of page text candidates
# --------------------------------------------------------------------------
JSON_PATH_HINTS = [
    "complaint", "description", "message", "content", "body", "text", "problem",
    "question", "consumer",
]
JSON_HINT_WEIGHT = 60
BLOCK_WEIGHT = 200
LD_TEXT_KEYS = ["text", "description", "reviewBody", "articleBody"]
LD_TYPES = ["question", "review", "comment"]
LD_TYPE_WEIGHT = 100
EMBEDDED_JSON_ID = "__NEXT_DATA__"
COMPLAINT_BLOCK_NAME = "complaint-description"

# --------------------------------------------------------------------------
# recommendations
# --------------------------------------------------------------------------
RECOMMENDATIONS = {
    "entrega": "Revisar SLA de entrega e comunicar rastreio proativo para pedidos atrasados.",
    "qualidade_produto": "Priorizar investigacao de qualidade e abrir acao corretiva com fornecedor/fabrica.",
    "preco_frete": "Revisar politica de frete e comunicacao comercial para reduzir friccao na compra.",
    "atendimento": "Reforcar fila de suporte e reduzir tempo de primeira resposta em casos sensiveis.",
    "portfolio_personalizacao": "Mapear recorrencia de pedidos de personalizacao para alimentar backlog de portfolio.",
    "outros": "Realizar triagem manual para identificar causa raiz e proxima acao.",
}
PRAISE_RECOMMENDATION = "Registrar elogio como boa pratica e compartilhar aprendizados com a operacao."
REVIEW_MANUALLY = "Revisar caso manualmente."
VALIDATE_WITH_TEAM = "Validar tratamento com o time responsavel."

# --------------------------------------------------------------------------
# Issue summaries and next steps, in the two wordings
# ("rules" = used by the keyword classifier, "model" = used around model replies)
# --------------------------------------------------------------------------
ISSUE_COUPON = {
    "rules": "dificuldade para aplicar cupom e concluir compra",
    "model": "dificuldade com cupom e finalizacao da compra",
}
ISSUE_NOT_RECEIVED = {
    "rules": "divergencia de entrega e nao recebimento",
    "model": "divergencia de entrega e nao recebimento do pedido",
}
ISSUE_REFUND = {"rules": "solicitacao de reembolso", "model": "solicitacao de reembolso"}
ISSUE_EXCHANGE_REFUSED = {
    "rules": "recusa de troca relatada",
    "model": "recusa de troca no atendimento",
}
ISSUE_BY_THEME = {
    "rules": {
        "entrega": "atraso ou problema na entrega",
        "qualidade_produto": "defeito/avaria no produto",
        "preco_frete": "divergencia de preco, frete ou promocao",
        "atendimento": "experiencia de atendimento e retorno",
        "portfolio_personalizacao": "expectativa sobre personalizacao/modelo",
        "outros": "transtorno relatado no atendimento",
    },
    "model": {
        "entrega": "atraso ou problema de entrega",
        "qualidade_produto": "defeito ou avaria de produto",
        "preco_frete": "divergencia de preco/frete/promocao",
        "atendimento": "dificuldade de atendimento e retorno",
        "portfolio_personalizacao": "expectativa sobre personalizacao/modelo",
        "outros": "transtorno relatado pelo cliente",
    },
}
STEP_COUPON = {
    "rules": "validar regra promocional e ajustar oferta quando aplicavel",
    "model": "validar regra promocional com time comercial e retornar alternativa aplicavel",
}
STEP_REFUND = {
    "rules": "confirmar tratativa financeira na mesma forma de pagamento",
    "model": "confirmar tratativa financeira na mesma forma de pagamento",
}
# Only the rules wording knows this step.
STEP_EXCHANGE = "revisar elegibilidade e retornar opcao de troca/devolucao/reembolso conforme politica"
STEP_BY_THEME = {
    "rules": {
        "entrega": "fazer acareacao com transportadora e definir novo prazo ou reenvio",
        "qualidade_produto": "abrir tratativa de qualidade para troca, reembolso ou suporte",
        "preco_frete": "revisar condicoes aplicadas ao pedido e propor alternativa adequada",
        "atendimento": "priorizar retorno humano com explicacao clara dos proximos passos",
        "portfolio_personalizacao": "revisar fluxo de personalizacao e avaliar ajuste/troca",
        "outros": "fazer triagem com o time responsavel e registrar plano de resolucao",
    },
    "model": {
        "entrega": "fazer acareacao com transportadora e definir novo prazo ou reenvio",
        "qualidade_produto": "abrir tratativa de qualidade para troca/reembolso conforme politica",
        "preco_frete": "revisar condicoes comerciais aplicadas ao pedido",
        "atendimento": "priorizar retorno humano com orientacao clara",
        "portfolio_personalizacao": "revisar fluxo de personalizacao e opcao de ajuste/troca",
        "outros": "fazer triagem com time responsavel e registrar plano de resolucao",
    },
}
REFERENCE_PATTERN = (
    r"\b(protocolo|pedido|id)\b\s*(?:numero|n[º°o\.]|#)?\s*[:#-]?\s*([A-Za-z0-9*._\-/]{3,})"
)
REFERENCE_PLACEHOLDER = "protocolo/pedido [informar]"
SLA_FAST, SLA_NORMAL = "ate 4 horas", "ate 1 dia util"
PRIORITY_FAST, PRIORITY_NORMAL = "com prioridade maxima", "com prioridade"

# --------------------------------------------------------------------------
# Sentence templates. {braces} are filled per row.
# --------------------------------------------------------------------------
PRAISE_TEXT = {
    "rules": (
        "Ola! Obrigado por compartilhar sua experiencia positiva com a {brand}. "
        "Seu feedback foi registrado para reforcarmos os pontos fortes da operacao."
    ),
    "model": (
        "{greeting}! Obrigado por compartilhar sua experiencia positiva com a {brand}. "
        "Seu feedback foi registrado internamente para reforcarmos os pontos fortes do atendimento e do produto. "
        "Se precisar de qualquer suporte adicional, seguimos a disposicao."
    ),
}
APOLOGY_TEXT = {
    "rules": (
        "Ola! Sinto muito pelo ocorrido e entendo sua insatisfacao com {issue}. "
        "Referente ao {reference}, sua tratativa foi registrada {priority}. "
        "Nosso proximo passo e {step}. "
        "Retornaremos por este canal com atualizacoes objetivas."
    ),
    "model": (
        "{greeting}! Sinto muito pelo ocorrido e entendo sua insatisfacao com {issue}. "
        "Referente ao seu {reference}, sua tratativa foi registrada {priority}. "
        "Nosso proximo passo e {step}. "
        "Assim que tivermos atualizacao, retornaremos por este canal com os proximos passos."
    ),
}
GUIDE_TEXT = {
    "rules": (
        "Guia para atendente (uso interno):\n"
        "- Dor principal a reconhecer: {issue}.\n"
        "- Caso para conferir no CRM: {reference}.\n"
        "- Proximo passo que precisa constar na resposta: {step}.\n\n"
        "Checklist do atendimento:\n"
        "1. Validar status do caso no CRM/ticket.\n"
        "2. Confirmar politica aplicavel (troca, reembolso, garantia, logistica).\n"
        "3. Informar prazo de retorno ao cliente: {sla}.\n"
        "4. Registrar historico da tratativa para auditoria.\n\n"
        "Texto-base editavel (personalizar antes de enviar):\n"
        "\"{text}\""
    ),
    "model": (
        "Guia para atendente (uso interno):\n"
        "- Dor principal a reconhecer: {issue}.\n"
        "- Caso para conferir no CRM: {reference}.\n"
        "- Acao interna obrigatoria: {recommendation}.\n"
        "- Proximo passo para comunicar: {step}.\n\n"
        "Checklist do atendimento:\n"
        "1. Validar dados do pedido/protocolo e status atual da tratativa.\n"
        "2. Confirmar politica aplicavel ao caso (troca, reembolso, garantia, logistica).\n"
        "3. Informar prazo de retorno ao cliente: {sla}.\n"
        "4. Registrar no historico o compromisso assumido na resposta.\n\n"
        "Texto-base editavel (personalizar antes de enviar):\n"
        "\"{text}\""
    ),
    "wrapped": (
        "Guia para atendente (uso interno):\n"
        "- Dor principal a reconhecer: {issue}.\n"
        "- Caso para conferir no CRM: {reference}.\n"
        "- Proximo passo para comunicar: {step}.\n\n"
        "Checklist do atendimento:\n"
        "1. Validar numero do pedido/protocolo e status no sistema.\n"
        "2. Confirmar politica aplicavel antes de responder.\n"
        "3. Informar prazo e dono da tratativa.\n"
        "4. Registrar historico da acao.\n\n"
        "Texto-base editavel (personalizar antes de enviar):\n"
        "\"{text}\""
    ),
}
STATIC_GUIDE = (
    "Guia para atendente (uso interno):\n"
    "- Dor principal: validar manualmente no relato original.\n"
    "- Caso para CRM: protocolo/pedido [informar].\n"
    "- Acao interna: abrir tratativa e definir dono.\n\n"
    "Checklist do atendimento:\n"
    "1. Conferir dados do pedido/protocolo.\n"
    "2. Confirmar politica aplicavel.\n"
    "3. Definir prazo de retorno ao cliente.\n\n"
    "Texto-base editavel (personalizar antes de enviar):\n"
    "\"Ola! Recebemos seu relato e estamos tratando o caso com prioridade. "
    "Em breve retornaremos com os proximos passos.\""
)

# --------------------------------------------------------------------------
# Markers that tell guides, generic and customer-facing texts apart
# --------------------------------------------------------------------------
GENERIC_MARKERS = [
    "sentimos muito pelo transtorno", "seguimos a disposicao", "retornaremos por este canal",
]
SPECIFIC_MARKERS = [
    "protocolo", "pedido", "reembolso", "troca", "transportadora", "garantia", "cupom",
    "prazo", "devolucao", "estorno", "checklist", "guia para atendente",
]
GENERIC_MIN_LENGTH = 120
DIRECT_OPENERS = ["ola", "olá", "prezado", "prezada", "sentimos", "sinto muito", "lamentamos"]
INTERNAL_LABELS = ["guia para atendente", "checklist", "texto-base editavel"]
GUIDE_LABELS = ["guia para atendente", "checklist", "texto-base"]
OLD_GENERIC_PHRASE = "ja acionamos o time responsavel para tratar seu caso com prioridade"
REFRESH_LABELS = ["guia para atendente", "checklist"]

# --------------------------------------------------------------------------
# Keys of model replies, first present (or first non-blank) key wins
# --------------------------------------------------------------------------
REPLY_KEYS = {
    "sentiment": ["sentiment_label", "sentimento"],
    "theme": ["primary_theme", "tema_principal"],
    "priority": ["priority", "prioridade"],
    "urgency": ["urgency", "urgencia"],
    "score": ["sentiment_score", "score_sentimento"],
    "confidence": ["confidence", "confianca"],
    "escalation": ["escalation_required", "escalonamento_necessario"],
    "recommendation": ["internal_recommendation", "actionable_recommendation"],
    "response": ["resposta_sugerida_cliente", "suggested_response", "suggested_customer_response"],
}
DEFAULT_CONFIDENCE = 0.7
DEFAULT_PRIORITY = 3
TRUE_WORDS = ["1", "true", "t", "sim", "yes", "y"]
TRUE_WORDS_STORED = ["true", "1", "yes"]

RULES_CONFIDENCE = 0.62
RULES_MODEL = "deterministic_rules_v2"
PROVIDER_RULES, PROVIDER_MODEL = "rules", "model"
NOTE_MODEL = "Analisado pelo modelo"
NOTE_MISSING = "Resposta do modelo ausente. Fallback de regras aplicado."
NOTE_INVALID = "Fallback aplicado por erro: resposta sem JSON valido."

# --------------------------------------------------------------------------
# Display labels
# --------------------------------------------------------------------------
REPORT_THEME_LABELS = {
    "entrega": "Entrega",
    "qualidade_produto": "Qualidade",
    "preco_frete": "Preco/Frete",
    "atendimento": "Atendimento",
    "portfolio_personalizacao": "Portfolio",
    "outros": "Outros",
}
THEME_LABELS = {
    "entrega": "Entrega e prazo",
    "qualidade_produto": "Qualidade do produto",
    "preco_frete": "Preco e frete",
    "atendimento": "Atendimento",
    "portfolio_personalizacao": "Portfolio e personalizacao",
    "outros": "Outros",
}
SENTIMENT_LABELS = {"positivo": "Positivo", "neutro": "Neutro", "negativo": "Negativo"}
URGENCY_LABELS = {"baixa": "Baixa", "media": "Media", "alta": "Alta", "critica": "Critica"}
SOURCE_LABELS = {
    "site_auto": "Site (coleta automatica)",
    "site_manual": "Site (coleta manual)",
}

# --------------------------------------------------------------------------
# Sentences of the executive report
# --------------------------------------------------------------------------
REPORT_TITLE = "# Relatorio Executivo - Voz do Cliente (MVP)"
REPORT_SECTIONS = {
    "summary": "## Resumo Geral",
    "positive": "## WHAT WAS POSITIVE?",
    "negative": "## Criticas e Oportunidades",
    "themes": "## Temas Mais Frequentes",
    "actions": "## Acoes Prioritarias Recomendadas",
    "guides": "## Guia de Resposta para Atendente (SAC)",
    "insights": "## Insights Automaticos",
    "next": "## Proximos Passos",
}
REPORT_EMPTY = {
    "positive": "- Nao foram identificados feedbacks positivos na amostra atual.",
    "negative": "- Nao foram identificadas criticas relevantes na amostra atual.",
    "themes": "- Sem dados suficientes para ranking de temas.",
    "actions": "- Nenhuma acao urgente identificada (prioridade >= 4).",
    "guides": "- Sem guias de resposta de alta prioridade na amostra atual.",
    "guides_absent": "- Campo de guia de resposta ainda nao disponivel para esta base.",
}
REPORT_NEXT_STEPS = [
    "- Integrar fontes oficiais de feedback interno (NPS, tickets, CRM).",
    "- Evoluir taxonomia de temas por area de negocio.",
    "- Criar rotina semanal automatica com envio para liderancas.",
]
INSIGHTS_EMPTY = [
    "Sem dados suficientes para gerar tendencia de sentimento.",
    "Execute a extracao para atualizar a base com novas reclamacoes.",
    "Acompanhe diariamente o volume para identificar picos operacionais.",
]
INSIGHT_TEXT = {
    "negative": "{negative_pct}% dos feedbacks estao negativos; recomenda-se priorizar causas recorrentes de insatisfacao.",
    "theme": "Tema mais citado: {label} ({count} ocorrencias), indicando foco imediato para plano de acao.",
    "priority": "{high_pct}% da base esta em prioridade alta (>=4), exigindo acompanhamento operacional diario.",
    "coverage": "Cobertura da IA: {model_label}={model} e regras={rules}; monitorar fallback para manter qualidade analitica.",
}
