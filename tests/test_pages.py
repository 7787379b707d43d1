"""Pages, candidates and reviews against hand-made pages and brute force."""

import json
import random

from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.operators import extract, json_parts, reviews
from vozmill.operators.page_parts import PageParts

BASE = "https://site.example.com"
PATH = "^/loja/[^?#]+_[A-Za-z0-9-]+/?$"
LONG = "O produto chegou quebrado e ninguem responde ha semanas no suporte"


def pages(spark, *htmls, urls=None):
    rows = [(i, urls[i] if urls else f"{BASE}/p/{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_parts_of_a_page():
    page = PageParts(
        "<title>T</title><script>var a='<p>no</p>';</script><style>x</style><!-- c --><div><h1> Um <b>dois</b> </h1>"
        "<p>a<p>b<div>c</div></div>&amp; fim<template>t</template>"
    )
    assert " ".join(page.pieces) == "T Um dois a b c & fim"
    assert page.heading() == "Um dois"


def test_broken_markup_does_not_lose_text():
    page = PageParts("</div><p>um</b> dois<li>tres<li>quatro <a href='x'>cinco")
    assert " ".join(page.pieces) == "um dois tres quatro cinco"
    links = page.links(BASE)
    anchor = links["anchors"][0]
    assert anchor["title"] == "cinco"
    assert " ".join(links["pieces"][anchor["start"]:anchor["stop"]]) == "quatro cinco"


def test_many_links_in_one_block_stay_small(spark):
    """The parts of a page with many anchors in one block, and of tags that never close, grow with the page."""
    anchors = [f"<a href='/loja/caso_{i % 900}'>Titulo do caso numero {i}</a>" for i in range(1000)]
    html = "<div>" + "".join(anchors) + "</div>"
    assert len(json.dumps(PageParts(html).links(BASE))) < 8 * len(html)
    entries = extract.link_entries(pages(spark, html), PATH, BASE)
    assert "Exchange" not in entries._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pos for r in entries.select("pos").collect()) == list(range(900))
    assert len(PageParts("<p>" + "<b>x<div>" * 20_000).pieces) == 20_000


def test_link_entries(spark):
    html = (
        '<section><article><a href="/loja/caso_1">Pedido atrasado demais</a> <span>Não respondida</span> há 3 dias '
        f"{LONG}</article><a href='/loja/caso_2?x=1#y'>curto</a><a href='/outra/caso_3'>Titulo bem longo aqui</a>"
        "<div><a href='/loja/caso_1'>Outro titulo para o mesmo</a></div><p><a href='/loja/caso-x_4/'>Titulo sem bloco proprio</a></p></section>"
    )
    rows = extract.link_entries(pages(spark, html, "", None), PATH, BASE).orderBy("pos").collect()
    assert [(r.source_url, r.title, r.status, r.relative_text) for r in rows] == [
        (f"{BASE}/loja/caso_1", "Pedido atrasado demais", "nao resolvida", "ha 3 dia"),
        (f"{BASE}/loja/caso-x_4/", "Titulo sem bloco proprio", "nao resolvida", "ha 3 dia"),
    ]
    assert rows[0].snippet == f"Não respondida há 3 dias {LONG}"


def test_merge_keeps_the_first_page(spark):
    one = "<li><a href='/loja/caso_1'>Titulo da primeira pagina</a></li><li><a href='/loja/caso_2'>Titulo numero dois</a></li>"
    two = "<li><a href='/loja/caso_1'>Titulo da segunda pagina</a></li><li><a href='/loja/caso_3'>Titulo numero tres</a></li>"
    stored = pages(spark, one, two)
    got = extract.listing_entries(stored, PATH, BASE, 2).collect()
    assert sorted(r.title for r in got) == ["Titulo da primeira pagina", "Titulo numero dois"]
    per_page = extract.link_entries(stored, PATH, BASE)
    assert per_page.count() == 4 and extract.merge_entries(per_page).count() == 3
    assert extract.listing_entries(stored, PATH, BASE).count() == 3


def walk(node, path=""):
    """(number of hint words in the path, text) of all strings."""
    if isinstance(node, str):
        yield sum(hint in path.lower() for hint in lx.JSON_PATH_HINTS), node
    elif isinstance(node, dict):
        for k, v in node.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from walk(v, f"{path}[{i}]")


def linked(node):
    if isinstance(node, dict):
        kind = node.get("@type", "")
        for key in lx.LD_TEXT_KEYS:
            if isinstance(node.get(key), str):
                yield kind if isinstance(kind, str) else "", node[key]
        for value in node.values():
            yield from linked(value)
    elif isinstance(node, list):
        for value in node:
            yield from linked(value)


KEYS = ["a", "Text", "bodyMessage", "@type", "description", "question Body", "x.y", "reviewBody", ""]


def test_json_reader_against_recursion():
    rng = random.Random(7)

    def make(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return rng.choice(["s", '"q"\\n', "é\u2028", "", 1, -2.5e3, True, None, float("nan")])
        if kind < 0.7:
            return [make(depth - 1) for _ in range(rng.randrange(5))]
        return {rng.choice(KEYS): make(depth - 1) for _ in range(rng.randrange(6))}

    for _ in range(3000):
        tree = make(5)
        text = json.dumps(tree, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert json_parts.strings(text) == list(walk(tree))
        assert json_parts.linked_texts([text]) == list(linked(tree))
        cut = json_parts.strings(text[: rng.randrange(len(text) + 1)])
        assert len(cut) <= len(list(walk(tree)))


def test_json_reader_on_broken_and_deep_texts():
    assert json_parts.strings("{bad") == [] and json_parts.strings(None) == [] and json_parts.strings("") == []
    assert json_parts.strings('{"text":"kept","b":["also", oops, "lost"]}') == [(1, "kept"), (0, "also")]
    assert json_parts.strings('{"a":"1","b":"x","a":"2"}') == [(0, "x"), (0, "2")]
    assert json_parts.strings('["\\ud800"]') == [(0, "\ufffd")]
    deep = "[" * 20_000 + '"x"' + "]" * 20_000
    assert json_parts.strings(f'{{"a":{deep},"text":"y"}}') == [(0, "x"), (1, "y")]
    nested = '{"description":' * 20_000 + '"z"' + "}" * 20_000
    assert json_parts.strings(nested) == [(1, "z")] and json_parts.linked_texts([nested]) == [("", "z")]


def test_deep_lists_leave_the_other_strings(spark):
    deep = "[" * 20_000 + "]" * 20_000
    html = (
        f'<h1>Titulo da pagina</h1><script id="__NEXT_DATA__">{{"deep":{deep},"text":"{LONG}"}}</script>'
        f'<script type="application/ld+json">[{deep},{{"@type":"Review","text":"{LONG} ld"}}]</script>'
    )
    parsed = extract.parse_pages(pages(spark, html), extract.DETAIL_PARTS, BASE)
    row = extract.page_texts(parsed).first()
    assert (row.json_text, row.ld_text, row.heading) == (LONG, LONG + " ld", "Titulo da pagina")
    df = spark.createDataFrame([(0, f'{{"deep":{deep},"text":"{LONG}"}}')], "page_id int, embedded_json string")
    got = extract.with_json_candidates(df).select(extract.best_candidate(F.col("json_candidates")).alias("t"))
    assert got.first().t == LONG


def test_unclosed_anchors_and_nested_blocks_stay_small():
    html = "".join(f'<a href="/x/{i}">titulo do caso numero {i} ' for i in range(1000))
    page = PageParts(html)
    found = page.links(BASE)
    assert [x["title"] for x in found["anchors"][:2]] == ["titulo do caso numero 0", "titulo do caso numero 1"]
    assert sum(len(x["title"]) for x in found["anchors"]) + sum(map(len, found["pieces"])) < 2 * len(html)
    html = "".join(f'<div class="complaint-description">texto do nivel {i} ' for i in range(1000)) + "</div>" * 1000
    page = PageParts(html)
    assert len(page.blocks()) == 1000 and sum(map(len, page.pieces)) < len(html)
    assert all(
        b["n_chars"] == len(" ".join(page.pieces[b["start"] : b["stop"]])) for b in page.blocks()
    )
    closed = PageParts('<a href="/a">um <b>dois</a> tres <a href="/b">quatro</a> cinco')
    assert [x["title"] for x in closed.links(BASE)["anchors"]] == ["um dois", "quatro"]


def test_best_block_equals_the_best_candidate(spark):
    bad = "termos de uso " + LONG
    html = [
        f'<div id="complaint-description">{LONG}</div><p class="complaint-description">{LONG} mais longo</p>',
        f'<div class="complaint-description">{bad}<div class="complaint-description"> {LONG}  <b>e mais</b>\n texto </div></div>',
        '<div class="complaint-description">curto</div>', "<p>nada</p>",
        f'<div class="x complaint-description"><p class="complaint-description">{LONG}</p></div><div class="complaint-description">{LONG[::-1]}</div>',
    ]
    parsed = extract.parse_pages(pages(spark, *html), extract.DETAIL_PARTS, BASE)
    both = extract.with_block_candidates(parsed).select(
        extract.best_block().alias("fast"), extract.best_candidate(F.col("block_candidates")).alias("plain")
    )
    rows = both.collect()
    assert [r.fast for r in rows] == [r.plain for r in rows] and sum(r.fast != "" for r in rows) == 3


def test_details_need_one_python_pass(spark):
    parsed = extract.parse_pages(pages(spark, "<h1>x</h1>"), extract.DETAIL_PARTS, BASE)
    plan = extract.page_texts(parsed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Arrow") + plan.count("Python") + plan.count("Pandas") == 1


def test_best_json_candidate(spark):
    payload = json.dumps({"a": LONG + " mais texto sem chave", "props": {"complaint": {"description": LONG}}, "b": "termos de uso " + LONG})
    df = spark.createDataFrame([(0, payload), (1, None), (2, "x")], "page_id int, embedded_json string")
    got = extract.with_json_candidates(df).select("page_id", extract.best_candidate(F.col("json_candidates")).alias("t"))
    assert [r.t for r in got.orderBy("page_id").collect()] == [LONG, "", ""]


def test_linked_data(spark):
    html = (
        '<script type="application/ld+json">{"@type":"Thing","text":"%s!","x":[{"@type":"Review","reviewBody":"%s"}]}</script>'
        '<script type="application/ld+json">{broken</script>' % (LONG, LONG)
    )
    parsed = extract.parse_pages(pages(spark, html), extract.DETAIL_PARTS, BASE)
    rows = extract.explode_candidates(
        parsed.withColumn("ld_candidates", extract.ld_candidates(F.col("ld_strings"))), "ld_candidates"
    ).collect()
    assert sorted((r.pos, r.score) for r in rows) == [(0, len(LONG) + 1), (1, len(LONG) + 100)]
    assert extract.page_texts(parsed).first().ld_text == LONG


def test_cascade_and_detail(spark):
    html = [
        f'<h1>Titulo da pagina</h1><p>05/06/2024</p><div id="complaint-description">{LONG}</div><em>Resolvida</em>',
        '<meta property="og:title" content="Titulo social">sem nada util',
    ]
    stored = pages(spark, *html, urls=[f"{BASE}/loja/caso_1", f"{BASE}/loja/caso_2"])
    entries = spark.createDataFrame(
        [(0, i, f"{BASE}/loja/caso_{i}", f"Titulo da lista {i}", "nao resolvida", "ontem", f"Trecho da lista numero {i} {LONG}") for i in (1, 2, 3)],
        "page_id bigint, pos int, source_url string, title string, status string, relative_text string, snippet string",
    )
    rows = extract.page_detail(entries, stored, BASE).orderBy("pos").collect()
    assert [(r.title, r.date_str, r.status) for r in rows] == [
        ("Titulo da pagina", "05/06/2024", "resolvida"),
        ("Titulo social", "", "nao resolvida"),
        ("Titulo da lista 3", "", "nao resolvida"),
    ]
    assert [r.description for r in rows] == [LONG] + [f"Trecho da lista numero {i} {LONG}" for i in (2, 3)]
    records = extract.complaint_records(entries, stored, BASE, "2024-12-31 00:00:00", "Nao Resolvidas", 48)
    got = {r.source_url: r for r in records.collect()}
    assert sorted(got) == [f"{BASE}/loja/caso_2", f"{BASE}/loja/caso_3"]
    assert {r.feedback_date for r in got.values()} == {"2024-12-30"}


def test_decoding(spark):
    texts = ["ação “ok”", "só latin: é", "ÃÂâ garbled Ã", "plain"]
    raw = [texts[0].encode(), texts[1].encode("cp1252"), texts[2].encode(), b"\x81 \xe9"]
    want = [texts[0], texts[1], texts[2].encode().decode("latin-1"), "\x81 é"]
    want[2] = raw[2].decode("cp1252") if b"\x81" not in raw[2] else raw[2].decode("latin-1")
    df = spark.createDataFrame(list(enumerate(raw)), "page_id int, content binary")
    got = [r.html for r in extract.decode_pages(df).orderBy("page_id").collect()]
    assert got == want


STOP = {"TODOS", "ELOGIOS", "RECLAMACOES", "AVALIACOES DOS CONSUMIDORES", "SOBRE", "ADDITIONAL LINKS"}


def is_date(line):
    return len(line) == 10 and line[2] == line[5] == "/" and line.replace("/", "").isdigit()


def by_hand(text):
    lines = [x for x in (" ".join(raw.split()) for raw in text.splitlines()) if x]
    out = []
    for i, line in enumerate(lines):
        if is_date(line):
            end = next((j for j in range(i + 1, len(lines)) if is_date(lines[j])), len(lines))
            body = " ".join(x for x in lines[i + 1:end] if x.upper() not in STOP)
            names = [x for x in reversed(lines[max(0, i - 7):i]) if not is_date(x) and x.upper() not in STOP and len(x) <= 80]
            out.append((i, line, names[0] if names else "Anonimo", body))
    return out


def test_review_segments_by_brute_force(spark):
    rng = random.Random(3)
    parts = ["01/02/2024", "13/12/2023", "Todos", "sobre", "Ana", "x" * 81, "texto bom", " ", "a\tb", "1/2/2024"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id bigint, url string, text string")
    got = sorted((r.page_id, r.line_no, r.feedback_date, r.author, r.segment) for r in reviews.review_segments(df).collect())
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in by_hand(t))
    lines = reviews.page_lines(df).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in lines} == {
        i: n for i, t in enumerate(texts) if (n := len([x for x in t.splitlines() if x.strip()]))
    }


def test_review_records_keep_the_first_of_equals(spark):
    text = "Ana\n01/02/2024\ngostei muito do produto\n01/02/2024\nAna\n"
    df = spark.createDataFrame([(1, "u", text), (0, "u", text)], "page_id bigint, url string, text string")
    rows = reviews.review_records(df).collect()
    assert [(r.page_id, r.author, r.raw_text, r.initial_category) for r in rows] == [(0, "Ana", "gostei muito do produto", "elogio")]


def test_detail_does_not_clean_collapsed_texts_again(spark):
    html = [
        f'<h1>Titulo  um</h1><div id="complaint-description">{LONG}\n mais &nbsp; texto - Portal do Consumidor fim</div>',
        "<b>Status: pendente</b> &amp; <br/>05/06/2024",
    ]
    stored = pages(spark, *html, urls=[f"{BASE}/1", f"{BASE}/2"])
    entries = spark.createDataFrame(
        [(0, i, f"{BASE}/{i}", "Titulo  da lista", "nova", "", f" trecho  {i}\n da lista - portal do consumidor x") for i in (1, 2, 3)],
        "page_id bigint, pos int, source_url string, title string, status string, relative_text string, snippet string",
    )
    detail = extract.page_detail(entries, stored, BASE)
    rows = [tuple(r) for r in detail.orderBy("pos").select("title", "description", "date_str", "status").collect()]
    assert rows == [
        ("Titulo um", f"{LONG} mais texto", "", "nova"),
        ("Titulo da lista", "trecho 2 da lista", "05/06/2024", "nao resolvida"),
        ("Titulo  da lista", entries.collect()[2].snippet, "", "nova"),
    ]
    assert "concat_ws" not in detail._jdf.queryExecution().analyzed().toString()


def test_page_reader_does_not_count_lines(monkeypatch):
    monkeypatch.setattr("_markupbase.ParserBase.updatepos", lambda *_: 1 / 0)
    page = PageParts("<H1>um\n dois</H1><p>x<br/></p><style>p {}</style><li>a<li>b")
    assert page.pieces == ["um dois", "x", "a", "b"] and page.heading() == "um dois"
