"""URL filter by empirical-Bayes host reputation.

Labelled pages give each host a number of bad pages out of n. Beta-binomial priors shrink these
down the tree of names: the corpus gives the prior of suffixes, a suffix that of its registered
domains, a domain that of its hosts, each without what the lower one holds itself. How strongly a level pulls is fitted from how much the
rates below it vary beyond chance (moments). A host is blocked if the lower posterior bound of
its rate of bad pages exceeds a limit, so few or mixed outcomes do not block. Explicit rules
come first; the longest that fits wins.

Pages are aggregated to hosts with map-side sums, so a host with a third of all pages costs one
row per task; only rows per host, domain and suffix are joined, and one row of sums per level
reaches the driver.

A null url, or one without ``://``, has an empty host and path; those pages share one reputation.
Null or missing outcomes do not count. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozmill.llm.common import stored

_C = F.col
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which anyone can register.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "co.za")
#: (verdict, host, path).
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def names(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; an address of digits is its own."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), F.lit(n)))
    double = last(2).isin(*DOUBLE_SUFFIXES)
    numeric = bare.rlike(r"^[\d.]+$")
    domain = F.when(numeric, bare).when(double, last(3)).otherwise(last(2))
    return domain, F.when(numeric, bare).when(double, last(2)).otherwise(last(1))


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, said).otherwise(verdict)
    return name, verdict


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 200) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, steps):
            for t in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d, c = 1 + t * d, 1 + t / c
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * d * c
        value = np.where(x <= 0, 0.0, front * f)
    return np.clip(np.where(flip, 1 - value, value), 0, 1)


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting small arguments up."""
    z = np.asarray(z, float).copy()
    shift = np.zeros_like(z)
    for _ in range(8):
        small = z < 8
        shift = shift - np.where(small, np.log(z), 0.0)
        z = np.where(small, z + 1, z)
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(40):
        middle = (low + high) / 2
        below = beta_cdf(middle, a, b) < q
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def _pull(children: DataFrame) -> float:
    """Strength of the prior above (n, bad) rows with the parent's rate ``m``, by moments."""
    v = _C("m") * (1 - _C("m"))
    s, a, b = children.agg(
        F.sum(F.pow(_C("bad") - _C("n") * _C("m"), 2)), F.sum(_C("n") * v), F.sum(_C("n") * (_C("n") - 1) * v)
    ).first()
    spread = min(max(((s or 0) - (a or 0)) / b, 1e-3), 0.5) if b else 0.1
    return 1 / spread - 1


def reputation(pages: DataFrame, low: float) -> DataFrame:
    """(host, domain, suffix, n, bad, alpha, beta, bound) from (host, outcome: 1 bad, 0 good, null)."""
    counts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
    domain, suffix = names(_C("host"))
    hosts = stored(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((bad or 0) + 0.5) / ((n or 0) + 1)

    def below(children: DataFrame, parents: DataFrame, name: str, pull: float) -> DataFrame:
        """Children with the rate ``m`` of their parent, shrunk, without what they hold themselves."""
        upper = parents.select(name, _C("n").alias("__n"), _C("bad").alias("__bad"), _C("m").alias("__m"))
        others = (_C("__bad") - _C("bad") + pull * _C("__m")) / (_C("__n") - _C("n") + pull)
        return children.join(upper, name).withColumn("m", others).drop("__n", "__bad", "__m")

    suffixes = suffixes.withColumn("m", F.lit(overall))
    domains = stored(below(domains, suffixes, "suffix", _pull(suffixes)))
    hosts = stored(below(hosts, domains.drop("suffix"), "domain", _pull(domains)))
    pull = _pull(hosts)
    posterior = hosts.withColumns({
        "alpha": _C("bad") + pull * _C("m"), "beta": _C("n") - _C("bad") + pull * (1 - _C("m")),
    })

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.maximum(batch.column(k).to_numpy(zero_copy_only=False).astype(float), 1e-6) for k in ("alpha", "beta"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(beta_quantile(low, a, b))], names=[*batch.schema.names, "bound"]
            )

    columns = ["host", "domain", "suffix", "n", "bad", "alpha", "beta"]
    rows = posterior.select(*columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("bound", T.DoubleType())])
    return rows.mapInArrow(bounded, schema)


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url",
    limit: float = 0.3, low: float = 0.1,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, bound, n_labelled) of every row.

    ``outcomes``: (id_col, outcome) of labelled pages, 1 bad and 0 good; of several the worst
    counts. A host is blocked if the ``low`` quantile of its posterior exceeds ``limit``.
    """
    host, path = host_and_path(_C(url_col))
    parsed = pages.select(_C(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = outcomes.groupBy(_C(id_col).alias("known_id")).agg(F.max("outcome").cast("long").alias("outcome"))
    labelled = parsed.join(known, parsed["id"] == known["known_id"], "left").select("host", "outcome")
    scores = reputation(labelled, low).select(_C("host").alias("of_host"), "bound", _C("n").alias("n_labelled"))
    rule, said = matched(_C("host"), _C("path"), rules)
    judged = parsed.join(stored(scores), parsed["host"] == _C("of_host"), "left")
    earned = F.when(_C("bound") > limit, "block").otherwise("allow")
    return judged.select(
        _C("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, earned).alias("verdict"),
        "bound", "n_labelled",
    )
