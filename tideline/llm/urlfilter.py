"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

The trees are boosted on the logistic loss with Newton steps over binned features: lengths,
depth, shares of digits and letters, entropy, parameter counts, and how often the labelled
URLs of the same host suffix and first path segment were blocked.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import map_batches

# The rules of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Labelled URLs of each verdict that the trees are fitted on, at most.
MAX_URLS = 4000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 4, 0.2, 32, 10.0
#: Labelled URLs a suffix must have to get a statistic of its own, and those it is smoothed with.
LEAST_SUFFIX, SMOOTH = 20, 10.0
THRESHOLD = 0.5


def host(url: str) -> Column:
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    upper = "".join(chr(c) for c in range(65, 91))
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: list[tuple[str, str]], own_host: str = "host", own_path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. Of rules alike in length the first wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = rule.partition("/")
        at = F.col(own_host)
        fits = ((at == domain) | at.endswith(f".{domain}")) & F.col(own_path).startswith(slash + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, judged).otherwise(verdict)
    return name, verdict


def parts(url: str) -> tuple[str, str, str]:
    """Host, path and what follows ``?``, as the columns have them."""
    before, found, rest = url.partition("://")
    if not found:
        return "", "", ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    own, rest = rest[:end].lower(), rest[end:].partition("#")[0]
    way, _, query = rest.partition("?")
    return own, way, query


def suffixes(url: str) -> list[str]:
    """Its last host label, its last two, and its first path segment."""
    own, way, _ = parts(url)
    labels = own.rsplit(".", 2)
    last, two = labels[-1], ".".join(labels[-2:])
    first = way.split("/", 2)[1] if way.startswith("/") else ""
    return [f"t:{last}", f"d:{two}", f"p:{first}"]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str) -> list[float]:
    own, way, query = parts(url)
    n = max(1, len(url))
    words = [w for w in unquote(way).replace("-", "/").replace("_", "/").split("/") if w]
    return [
        len(url), len(own), len(way), len(query), own.count("."), way.count("/"),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in own), sum(c in "aeiou" for c in own) / max(1, len(own)),
        own.count("-"), way.count("-"), entropy(url), entropy(own), query.count("&") + bool(query), query.count("="),
        max(map(len, words), default=0), max(map(len, own.split("."))), url.startswith("https"), url.count("%"), "@" in url,
        "#" in url,
    ]


@dataclass
class Trees:
    """Trees as arrays of nodes: feature, bin to go left up to, and value; node k has sons 2k + 1 and 2k + 2."""

    rates: dict[str, float] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = -1.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def features(self, urls: list[str | None]) -> np.ndarray:
        known = self.rates
        rows = [[*lexical(u or ""), *[known.get(s, known.get("", 0.5)) for s in suffixes(u or "")]] for u in urls]
        return np.array(rows, float).reshape(len(urls), -1)

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, k]) for k, e in enumerate(self.edges)], 1).astype(np.int32)

    def chance(self, urls: list[str | None]) -> np.ndarray:
        """By URL: the chance to be blocked. Without trees all are allowed or, if only blocked ones were seen, blocked."""
        logit = np.full(len(urls), self.base)
        if self.trees and len(urls):
            bins = self.binned(self.features(urls))
            for feature, upto, value in self.trees:
                node = np.zeros(len(urls), np.int64)
                for _ in range(DEPTH):
                    left = bins[np.arange(len(urls)), feature[node]] <= upto[node]
                    node = 2 * node + np.where(left, 1, 2)
                logit += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-logit))


def _grown(bins: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree by levels: each node splits where the gain of both sides' Newton steps is largest."""
    inner, width = 2**DEPTH - 1, BINS + 1
    feature, upto = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
    node = np.zeros(len(bins), np.int64)
    for level in range(DEPTH):
        start, nodes = 2**level - 1, 2**level
        best = np.full(nodes, 1e-9)
        for f in range(bins.shape[1]):
            cell = (node - start) * width + bins[:, f]
            g = np.bincount(cell, slope, nodes * width).reshape(nodes, width).cumsum(1)
            h = np.bincount(cell, curve, nodes * width).reshape(nodes, width).cumsum(1)
            g_all, h_all = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            gain[(h < LEAST_LEAF / 4) | (h_all - h < LEAST_LEAF / 4)] = 0
            at = gain.argmax(1)
            top = gain[np.arange(nodes), at]
            better = top > best
            best[better] = top[better]
            feature[start : start + nodes][better] = f
            upto[start : start + nodes][better] = at[better]
        left = bins[np.arange(len(bins)), feature[node]] <= upto[node]
        node = 2 * node + np.where(left, 1, 2)
    leaf = node - inner
    g, h = np.bincount(leaf, slope, 2**DEPTH), np.bincount(leaf, curve, 2**DEPTH)
    return feature, upto, -RATE * g / (h + 1)


def train(urls: list[str], blocked: list[int]) -> Trees:
    """Trees for labelled URLs. Without any all is allowed; with one verdict only, that verdict holds for all."""
    marks = np.array(blocked, float)
    if not len(marks) or marks.min() == marks.max():
        return Trees(base=4.0 if len(marks) and marks[0] else -4.0)
    share = float(marks.mean())
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for url, mark in zip(urls, marks, strict=True):
        for s in suffixes(url):
            seen[s][0] += 1
            seen[s][1] += mark
    rates = {s: (b + SMOOTH * share) / (n + SMOOTH) for s, (n, b) in seen.items() if n >= LEAST_SUFFIX}
    model = Trees(rates | {"": share})
    rows = model.features(urls)
    model.edges = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(rows.shape[1])]
    model.base = math.log(share / (1 - share))
    bins, logit = model.binned(rows), np.full(len(marks), model.base)
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-logit))
        tree = _grown(bins, chance - marks, chance * (1 - chance))
        model.trees.append(tree)
        feature, upto, value = tree
        node = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + np.where(bins[np.arange(len(bins)), feature[node]] <= upto[node], 1, 2)
        logit += value[node - (2**DEPTH - 1)]
    return model


def fit(labelled: DataFrame, url: str = "url", verdict: str = "verdict", most: int = MAX_URLS) -> Trees:
    """Trees of at most ``most`` distinct labelled URLs of each verdict, those of the smallest hashes. Nulls teach nothing."""
    rows = labelled.select(F.col(url).alias("_url"), F.col(verdict).alias("_verdict")).filter(F.col("_url").isNotNull())
    picked = []
    for own, mark in (("allow", 0), ("block", 1)):
        some = rows.filter(F.col("_verdict") == own).distinct().orderBy(F.xxhash64("_url"), "_url").limit(most).collect()
        picked += [(r["_url"], mark) for r in some]
    return train([u for u, _ in picked], [m for _, m in picked])


def judged(
    pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", model: Trees | None = None
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, ``chance`` of every URL.

    URLs that a rule fits have the rule's verdict; the others that of the trees, which, if not given, are fitted on
    those with a rule. ``chance`` is the trees' chance to be blocked. Null URLs and those without ``://``
    have an empty host and path, no rule, and the trees' verdict on the URL as it is, null as empty. Repeated
    rows are judged alike; other columns are not read.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).select(
        "_key", "_url", host("_url").alias("host"), path("_url").alias("path")
    )
    rule, verdict = ruled(rules)
    rows = rows.select("_key", "_url", "host", "path", rule.alias("rule"), verdict.alias("_verdict"))
    trees = model if model is not None else fit(rows, "_url", "_verdict")
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string, chance double"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = batch.column(5).to_pylist()
        chance = trees.chance(batch.column(1).to_pylist())
        verdicts = [g or ("block" if c >= THRESHOLD else "allow") for g, c in zip(given, chance, strict=True)]
        columns = [batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(verdicts), pa.array(chance)]
        return pa.RecordBatch.from_arrays(columns, names=[key, "host", "path", "rule", "verdict", "chance"])

    return map_batches(rows, schema, work)
