"""The inner steps of the operators against plain versions: decoding, losses, splits, rules, shares, cutoffs."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import brute
from vozmill.llm import language_id, quality_classifier, quality_rules, toxicity, url_reputation
from vozmill.llm.queries import QUERIES, RULES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


# op3


def test_decoding_by_hand():
    rng = np.random.default_rng(2)
    code = language_id.codewords(5, 20, 1)
    coder = language_id.Coder(list("abcde"), code, rng.normal(size=(7, 20)).astype(np.float32), rng.normal(size=20), rng.random(20))
    x = rng.normal(size=(30, 7)).astype(np.float32)
    got = coder.losses(x)
    for i in range(30):
        margins = [sum(float(x[i, j]) * float(coder.weights[j, b]) for j in range(7)) + coder.bias[b] for b in range(20)]
        for k in range(5):
            want = sum(coder.trust[b] * math.log1p(math.exp(-margins[b] * code[k, b])) for b in range(20))
            assert got[i, k] == pytest.approx(want, rel=1e-4)


def test_bits_are_at_the_minimum_of_their_loss():
    rng = np.random.default_rng(3)
    x = rng.random((200, 6)).astype(np.float32)
    y = np.where(x @ rng.normal(size=(6, 3)) + rng.normal(size=(200, 3)) > 1, 1, -1).astype(np.float32)
    w, b = language_id.fit_bits(x, y, steps=3000)
    pull = -y / (1 + np.exp(y * (x @ w + b)))
    assert np.abs(x.T @ pull / 200 + 1e-4 * w).max() < 2e-3 and np.abs(pull.mean(0)).max() < 2e-3


def test_language_rows(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    learned = {r["lang"] for r in docs if r["lang"] is not None and fold(r["doc_id"], 5)}
    right = 0
    for r in docs:
        g = got[r["doc_id"]]
        assert g["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= g["score"] <= 1
        assert (g["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert g["lang_pred"] in learned | {"und"}
        right += g["held_out"] and g["lang_pred"] == r["lang"]
    assert right >= 0.9 * sum(g["held_out"] and g["lang_pred"] != "und" for g in got.values())


# op4


def test_toxicity_fit_is_at_the_minimum_of_its_loss():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)] + ["woman", "man"]
    sets = [{w for w in words if rng.random() < 0.3} for _ in range(300)]
    y = np.array([float(("w0" in s) or ("w1" in s and "woman" in s) or rng.random() < 0.05) for s in sets])
    weight = rng.random(300) + 0.5
    swaps = [(i, {{"woman": "man", "man": "woman"}.get(w, w) for w in s}) for i, s in enumerate(sets) if s & {"woman", "man"}]
    sparse, fairness = 1e-3, 5.0
    theta, b = toxicity.fit(sets, y, weight, swaps, sparse=sparse, fairness=fairness, steps=6000)
    weight = weight / weight.sum()
    score = [sum(theta.get(w, 0.0) for w in s) for s in sets]
    err = weight * (1 / (1 + np.exp(-(np.array(score) + b))) - y)
    assert abs(err.sum()) < 1e-3
    for w in words:
        grad = sum(e for e, s in zip(err, sets) if w in s)
        gaps = [(score[i] - sum(theta.get(x, 0.0) for x in s), (w in sets[i]) - (w in s)) for i, s in swaps]
        grad += 2 * fairness * sum(change * d for change, d in gaps) / len(swaps)
        if w in theta:
            assert abs(grad + sparse * np.sign(theta[w])) < 1e-3, w
        else:
            assert abs(grad) <= sparse + 1e-3, w
    free, _ = toxicity.fit(sets, y, weight, [], sparse=sparse, steps=3000)
    assert abs(free.get("woman", 0) - free.get("man", 0)) > 3 * abs(theta.get("woman", 0) - theta.get("man", 0))


def test_toxicity_rows(spark, docs, labels):
    got = {r["doc_id"]: r for r in QUERIES["op4_toxicity"](spark, SF_DIR).collect()}
    assert set(got) == {r["doc_id"] for r in docs}
    for doc, g in got.items():
        assert g["held_out"] == (fold(doc, 5) == 0) and g["predicted"] == (g["score"] >= 0.5) and 0 <= g["score"] <= 1


# op8


def test_first_split_by_hand():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 4)), 1)
    y = (x[:, 2] + 0.3 * rng.normal(size=120) > 0.2).astype(float)
    weight = rng.random(120) + 0.5
    forest = quality_classifier.grow(x, y, weight, trees=1, depth=1, least=5.0)
    w = weight / weight.mean()
    mean = (w * y).sum() / w.sum()
    g, h = w * (mean - y), w * mean * (1 - mean)
    best, at = 0.0, None
    for j in range(4):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
            left = x[:, j] <= cut
            if 5 <= left.sum() <= 115:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
                if gain > best + 1e-9:
                    best, at = gain, (j, cut)
    assert (forest.feature[0, 0], forest.limit[0, 0]) == at
    left = x[:, at[0]] <= at[1]
    for leaf, side in enumerate((left, ~left)):
        assert forest.leaf[0, leaf] == pytest.approx(-0.2 * g[side].sum() / (h[side].sum() + 1))


def test_trees_lower_the_loss_of_the_sample():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)

    def loss(forest):
        p = 1 / (1 + np.exp(-forest.margins(x)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    losses = [loss(quality_classifier.grow(x, y, np.ones(400), trees=n)) for n in (1, 5, 20, 60)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.3 * losses[0]


def test_quality_rows(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op8_quality_classifier"](spark, SF_DIR).collect()}
    assert set(got) == {r["doc_id"] for r in docs}
    for doc, g in got.items():
        assert g["held_out"] == (fold(doc, 4) == 2) and g["predicted"] == (g["score"] >= 0.7) and 0 <= g["score"] <= 1


# op6


def test_rules_and_reputation_of_the_given_pages(spark, labels):
    bad = defaultdict(int)
    for r in labels:
        bad[r["doc_id"]] = max(bad[r["doc_id"]], int(r["quality"] == 0 or r["toxic"] == 1))
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op6_url_reputation"](spark, SF_DIR).collect()}
    assert set(got) == set(pages)
    counts = defaultdict(lambda: [0, 0])
    for page, url in pages.items():
        host, path = brute.address(url)
        last = [p for p in path.removesuffix("/").removesuffix(".html").split("/")][-1:]
        if last and last[0].isdigit() and int(last[0]) in bad:
            counts[host][0] += 1
            counts[host][1] += bad[int(last[0])]
        else:
            counts[host]
    for page, url in pages.items():
        g, (host, path) = got[page], brute.address(url)
        assert (g["host"], g["path"]) == (host, path)
        fitting = [
            (len(h + p), said, h + p) for said, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        rule = max(fitting, default=None)
        assert g["rule"] == (rule[2] if rule else None)
        assert g["verdict"] == (rule[1] if rule else "block" if g["bound"] > 0.3 else "allow")
        assert g["n_labelled"] == counts[host][0]


def test_posterior_by_hand(spark):
    """Counts shrunk from host to domain to suffix, strengths by moments, quantile of the beta posterior."""
    rng = np.random.default_rng(7)
    hosts = [f"{s}.site{d}.{t}" for t in ("com", "org") for d in range(4) for s in ("a", "b", "c")]
    rows = [(h, int(rng.random() < (0.8 if "site1" in h else 0.1))) for h in hosts for _ in range(int(rng.integers(0, 9)))]
    rows += [(h, None) for h in hosts]
    table = spark.createDataFrame(rows, "host string, outcome long")
    got = {r["host"]: r for r in url_reputation.reputation(table, 0.1).collect()}

    def total(of):
        out = defaultdict(lambda: np.zeros(2))
        for h, o in rows:
            out[of(h)] += (o is not None, o or 0)
        return out

    by_host, by_domain, by_suffix = total(str), total(lambda h: h.split(".", 1)[1]), total(lambda h: h.rsplit(".", 1)[1])
    n, bad = sum(by_host.values())
    overall = (bad + 0.5) / (n + 1)

    def pull(children):
        s = sum((b - k * m) ** 2 for (k, b), m in children)
        a = sum(k * m * (1 - m) for (k, _), m in children)
        c = sum(k * (k - 1) * m * (1 - m) for (k, _), m in children)
        return 1 / min(max((s - a) / c, 1e-3), 0.5) - 1

    m_suffix = dict.fromkeys(by_suffix, overall)
    strength = pull([(v, m_suffix[k]) for k, v in by_suffix.items()])
    m_domain = {}
    for k, v in by_domain.items():
        up = by_suffix[k.split(".", 1)[1]]
        m_domain[k] = (up[1] - v[1] + strength * m_suffix[k.split(".", 1)[1]]) / (up[0] - v[0] + strength)
    strength = pull([(v, m_domain[k]) for k, v in by_domain.items()])
    m_host = {}
    for k, v in by_host.items():
        up = by_domain[k.split(".", 1)[1]]
        m_host[k] = (up[1] - v[1] + strength * m_domain[k.split(".", 1)[1]]) / (up[0] - v[0] + strength)
    strength = pull([(v, m_host[k]) for k, v in by_host.items()])
    grid = (np.arange(200_000) + 0.5) / 200_000
    for h, (k, b) in by_host.items():
        alpha, beta = b + strength * m_host[h], k - b + strength * (1 - m_host[h])
        assert (got[h]["alpha"], got[h]["beta"]) == (pytest.approx(alpha), pytest.approx(beta))
        log = (alpha - 1) * np.log(grid) + (beta - 1) * np.log1p(-grid)
        mass = np.cumsum(np.exp(log - log.max()))
        assert got[h]["bound"] == pytest.approx(grid[np.searchsorted(mass, 0.1 * mass[-1])], abs=2e-3)


# op9


def test_taken_words_by_hand(spark, docs):
    """Targets by filling up, blocks by highest quotients, runs in a seeded order."""
    got = {r["doc_id"]: r for r in QUERIES["op9_source_mixing"](spark, SF_DIR).collect()}
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in docs}
    held = defaultdict(list)
    for r in docs:
        held[r["source"]].append(r["doc_id"])
    order = sorted(held, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size[d] for d in held[s]) for s in order}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_ones, target = 1.5 * sum(sizes.values()), list(order), {}
    while open_ones:
        level = left / sum(weight[s] for s in open_ones)
        full = [s for s in open_ones if weight[s] * level >= 2 * sizes[s]]
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        if not full:
            target |= {s: weight[s] * level for s in open_ones}
            break
        open_ones = [s for s in open_ones if s not in full]
    blocks, won = round(sum(target.values()) / 16), Counter()
    for _ in range(blocks):
        won[max(order, key=lambda s: (target[s] / (2 * won[s] + 1), -order.index(s)))] += 1

    def seeded(seed, *parts):
        text = ":".join([str(seed), *("" if p is None else str(p) for p in parts)])
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)

    for s in order:
        ids = sorted(held[s], key=lambda d: (seeded(42, d, size[d]), d))
        quota = min(won[s] * 16, 2 * sizes[s])
        begin = seeded(44, s, 0) % max(1, math.ceil(sizes[s] / 16)) * 16
        words = [d for d in ids for _ in range(size[d])]
        taken = Counter(words[(begin + i) % len(words)] for i in range(quota)) if words else Counter()
        for d in ids:
            g = got[d]
            assert g["target"] == pytest.approx(target[s]) and g["source_size"] == sizes[s] and g["size"] == size[d]
            assert g["taken"] == taken[d]


# op10


def test_kept_by_hand(spark, docs, labels):
    """Cutoffs by exact binomial tests from loose to tight, per language."""
    good = defaultdict(list)
    for r in labels:
        if r["quality"] is not None:
            good[r["doc_id"]].append(r["quality"])
    good = {d for d, marks in good.items() if min(marks) == 1}

    def measured(text):
        text = text or ""
        n, chars, symbols, dup, repeat = brute.measures(text)
        dense = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        if not n:
            return n, repeat, None
        upper, shouts = sum("A" <= c <= "Z" for c in dense), dense.count("!")
        return n, repeat, dict(symbols=symbols / n, dup_lines=dup / len(lines), repeats=repeat / n, capitals=upper / chars, shouts=shouts / n)

    rows = [(r, *measured(r["text"])) for r in docs]
    strata = {r["lang"] for r in docs}
    alpha, delta = 0.05 / 5, 0.05 / (5 * len(strata))
    cutoff = {}
    for lang in strata:
        held = [m for r, n, _, m in rows if r["lang"] == lang and n and r["doc_id"] in good]
        for rule in quality_rules.RULES:
            for cut in quality_rules.CUTOFFS:
                k, n = sum(m[rule] > cut for m in held), len(held)
                if not n or sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) > delta:
                    break
                cutoff[lang, rule] = cut
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_rules"](spark, SF_DIR).collect()}
    for r, n, repeat, m in rows:
        base = n < 50 or 100 * repeat > 50 * n
        broken = m is not None and any(m[rule] > cutoff.get((r["lang"], rule), math.inf) for rule in m)
        assert got[r["doc_id"]]["kept"] == (not base and not broken), r["doc_id"]
