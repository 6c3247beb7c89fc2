"""Quotas, flow and selection."""

from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import functions as F

from tideline.llm import mixing


def test_shares_stop_at_three_times_the_size():
    targets = mixing.shared_out(100, {"a": 2, "b": 90, None: 8}, {"a": 5, "b": 2, None: 1})
    assert targets["a"] == 6.0
    assert abs(sum(targets.values()) - 100) < 1e-9
    assert all(targets[s] <= 3 * n for s, n in {"a": 2, "b": 90, None: 8}.items())
    assert mixing.shared_out(0, {}, {}) == {}


def _cost(supply, sent):
    return sum(sum(max(0, sum(f) - k * s) for k in (1, 2)) for s, f in zip(supply, sent, strict=True))


def test_flow_is_largest_and_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        supply = [rng.randint(0, 2) for _ in range(3)]
        links = [sorted(rng.sample(range(2), rng.randint(1, 2))) for _ in supply]
        quotas = [rng.randint(0, 5) for _ in range(2)]
        flow = mixing.routed(supply, links, quotas)
        best = None
        choices = [
            [c for c in itertools.product(range(3 * s + 1), repeat=len(own)) if sum(c) <= 3 * s]
            for s, own in zip(supply, links, strict=True)
        ]
        for sent in itertools.product(*choices):
            got = [0, 0]
            for own, f in zip(links, sent, strict=True):
                for s, n in zip(own, f, strict=True):
                    got[s] += n
            if all(g <= q for g, q in zip(got, quotas, strict=True)):
                value = (-sum(got), _cost(supply, sent))
                best = value if best is None else min(best, value)
        assert (-sum(map(sum, flow)), _cost(supply, flow)) == best


def test_documents_of_several_sources(spark):
    rows = [(i, "w " * (1 + i % 4), ["a", "b"] if i % 5 == 0 else ["a"] if i % 2 else ["b"]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>")
    own = mixing.sized(docs, F.col("sources"), "doc_id", "text")
    mix = mixing.planned(own, lambda names: {s: 3 if s == "a" else 1 for s in names}, total=900)
    taken = mixing.applied(own, mix).agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert abs(taken - sum(mix.targets.values())) <= 20
    assert max(r["copies"] for r in mixing.applied(own, mix).collect()) <= 3


def test_reruns_agree_and_targets_are_met(docs):
    first = sorted(tuple(r) for r in mixing.mixed(docs).collect())
    assert first == sorted(tuple(r) for r in mixing.mixed(docs.repartition(7)).collect())
    texts = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()}
    taken: dict = {}
    for key, size, _, target, words in first:
        source, n = texts[key]
        assert size == n
        assert words <= 3 * size
        got = taken.setdefault(source, [0, target])
        got[0] += words
    largest = max(n for _, n in texts.values())
    assert all(abs(words - target) <= largest for words, target in taken.values())


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mixed(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mixed(no_docs).count() == 0
    again = mixing.repeated(odd_docs)
    assert again.columns == odd_docs.columns
    words = again.select(F.sum(mixing.word_count("text"))).first()[0]
    assert words == sum(r["taken"] for r in rows)
    assert mixing.repeated(no_docs).count() == 0
