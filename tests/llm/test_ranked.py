"""Ranked search against scores of every document and item."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from tideline.llm import ranked

TERM = re.compile(ranked.TERM)


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _wanted(docs, items, k):
    bags = [(key, _terms(text)) for key, text in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    own: dict = {}
    for key, text in items:
        if key is not None:
            own.setdefault(key, set()).update(_terms(text))
    out = []
    for item, terms in own.items():
        scores = []
        for key, bag in bags:
            tf, m = Counter(bag), 10 + (90 * len(bag) * n_docs) // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in terms & tf.keys()
            )
            if score > 0 and key is not None:
                scores.append((-score, key))
        out += [(item, r, key, -s) for r, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def _found(frame):
    return sorted(tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)] + ["ÄÖ", "don't", "Émile", "x9"]
    chance = 1 / np.arange(1, len(words) + 1)
    chance /= chance.sum()
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 120), p=chance))) for i in range(600)]
    docs += [(700 + i, docs[5][1]) for i in range(60)] + [docs[9], docs[9], (None, docs[3][1]), (900, None), (901, ""), (902, "W3 " * 5000)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(40)]
    items += [(50, docs[5][1]), (51, "nowhere at all"), (52, None), (53, ""), (None, "w1 w2"), (54, "w7"), (54, "w8 w9")]
    make = spark.createDataFrame
    return (
        docs, items,
        make([(*d, "x", 1) for d in docs], "doc_id bigint, text string, score string, rank int"),
        make([(*i, 2.0) for i in items], "item_id bigint, text string, doc_id double"),
    )


@pytest.mark.parametrize("block_terms", [ranked.BLOCK_TERMS, 150])
def test_against_all_pairs(tables, monkeypatch, block_terms):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(ranked, "PIECE_IMPACTS", 2000)
    docs, items, doc_rows, item_rows = tables
    assert _found(ranked.search(doc_rows, item_rows, 10)) == _wanted(docs, items, 10)


def test_bounds_are_kept_in_small_buckets(tables):
    """Every bucket finds what belongs among the best, whatever was found before it."""
    docs, items, doc_rows, item_rows = tables
    terms = sorted({t for _, text in items for t in _terms(text)})
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(len(terms), rng.integers(1, 20), replace=False)) for _ in range(500)]
    impacts = [rng.integers(0, 2_000_000_000, len(r)) for r in rows]
    length = np.array([np.sqrt((i.astype(float) ** 2).sum()) for i in impacts])
    order = np.argsort(-length)
    asked = [rng.choice(len(terms), n, replace=False) for n in (1, 2, 5, 20, 40)]
    found = ranked.Items(asked, 7, np.zeros(5, np.int64))
    scratch = np.zeros(len(terms), bool)
    for part in np.array_split(order, 20):
        bucket = ranked.Bucket(
            part, length[part], np.concatenate([[0], np.cumsum([len(rows[i]) for i in part])]),
            np.concatenate([rows[i] for i in part]), np.concatenate([impacts[i] for i in part]), len(terms),
        )
        for item in range(len(asked)):
            bucket.search(found, item, scratch)
    for item, own in enumerate(asked):
        score = [int(impacts[i][np.isin(rows[i], own)].sum()) for i in range(500)]
        best = sorted((-s, i) for i, s in enumerate(score) if s > 0)[:7]
        assert list(zip((-found.scores[item]).tolist(), found.ids[item].tolist(), strict=True)) == best


def test_empty_tables(tables):
    _, _, docs, items = tables
    assert ranked.search(docs.limit(0), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0


def test_odd_rows(odd_docs):
    items = odd_docs.selectExpr("doc_id AS item_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert _found(ranked.search(odd_docs, items)) == _wanted(rows, rows, 10)
