"""Near duplicates, licence statements and language models by brute force."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter
from dataclasses import replace

import pytest

from tideline.llm import licenses, lm, neardup
from tideline.llm.components import components


def ascii_lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _groups(texts, percent):
    """Shingle set sizes and smallest reachable index, by the definition."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for i, own in enumerate(sets):
        for shingle in own:
            where.setdefault(shingle, []).append(i)
    for i, own in enumerate(sets):
        for j, both in Counter(j for s in own for j in where[s] if j < i).items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies_of_one_text(spark, percent):
    """A base, copies with edits of their own, copies of copies, and texts that share a passage only."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    passage = [word() for _ in range(60)]
    for _ in range(3):
        base = [word() for _ in range(rng.choice([60, 160]))]
        variants = [base]
        for _ in range(70):
            own = list(rng.choice(variants))
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                variants.append(own)
            texts.append(" ".join(own))
    texts += [" ".join([word() for _ in range(80)] + passage) for _ in range(30)]
    texts += ["", None, "one two", "ONE two", "x", " "]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.grouped(docs, percent).collect()}
    assert [got[i] for i in range(len(texts))] == _groups(texts, percent)


def test_documents_near(docs):
    rows = sorted(docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in neardup.grouped(docs, 85).collect()}
    for row, (n, root) in zip(rows, _groups([r["text"] for r in rows], 85), strict=True):
        own = got[row["doc_id"]]
        assert (own["n_shingles"], own["component_id"]) == (n, rows[root]["doc_id"])
        assert own["kept"] == (own["component_id"] == row["doc_id"])


def test_near_odd_rows(odd_docs, no_docs):
    rows = neardup.grouped(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["component_id"], r["kept"]) for r in rows if r["doc_id"] == 50} == {(3, False)}
    assert all(r["kept"] for r in rows if r["n_shingles"] == 0)
    left = neardup.one_of_each_group(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert neardup.grouped(no_docs).count() == 0


def test_one_row_of_each_repeated_key(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    other = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, words, 3, "c"), (1, words, 2, "b"), (1, words, 2, "a"), (2, words, 0, "d"), (2, words, 0, "d")]
    # Key 4 has a text of its own and a copy; two rows without a key are different documents.
    rows += [(4, other, 5, "e"), (4, words, 6, "f"), (None, other + " lambda mu", 1, "x"), (None, "short", 1, "y"), (5, None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `class` int, source string")
    for part in (docs, docs.repartition(7)):
        left = neardup.one_of_each_group(part)
        assert left.columns == docs.columns
        found = left.collect()
        assert [r["class"] for r in found if r["doc_id"] == 1] == [2]
        assert [r["source"] for r in found if r["doc_id"] == 1] == ["a"]
        assert [r for r in found if r["doc_id"] == 2] == []
        assert [r["text"] for r in found if r["doc_id"] == 4] == [other]
        assert sorted(r["source"] for r in found if r["doc_id"] is None) == ["x", "y"]
        assert len([r for r in found if r["doc_id"] == 5]) == 1


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 560)]
    root: dict = {}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    root = {x: find(x) for x in parent if find(x) != x}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["root"] for r in got.collect()} == root


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _base(text):
    words = WORDS.findall(ascii_lower(text))
    places = [
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def test_base_phrases(spark, docs, odd_docs):
    odd = [
        "Under the MIT license. under the mit-license; under the mİt license", "cc by nc cc by nc CC BY-NC 4.0", "ccbync cc  by\tnc",
        "apache license version 2.0, under the mit license", "xunder the mit license", "under the mit licensex Under\x00the\x1fMIT/license",
    ]
    own = spark.createDataFrame([(-k, t) for k, t in enumerate(odd, 1)], "doc_id bigint, text string")
    for table in (docs.select("doc_id", "text"), own, odd_docs):
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        for r in licenses.digests(table).collect():
            got = r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]
            assert got == _base(texts[r["doc_id"]])
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
            assert 0 <= r["score"] <= 1


def test_detections_by_brute_force(spark):
    texts = [
        "This work is licensed under the GNU General Public License, version 3 or any later version. All rights reserved.",
        "Licensed under the Apache License, Version 2.0; see the license. Released under the MIT License.",
        "SPDX-License-Identifier: MIT and in the public domain", "nothing to see about licensing here", "Licensed under CC BY-NC-SA 4.0.",
        "released into the  public  domain", "all rights reserved", "Redistribution and use in source and binary forms",
        "distributed under the GNU GPL v3", "Released under Apache 2.0", "made available under the WTFPL",
        "licensed under the Expat license", "licence: PSF", "under the FreeBSD license", "Creative Commons Zero license",
        "this work is published by MIT", "all rights reserved " * 50 + "under the MIT license all rights reserved under the MIT license",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: {(d["first"], d["words"], d["rule"]) for d in r["detections"]} for r in licenses.scanned(table).collect()}
    rules = licenses.rules()
    assert len(rules) > 300
    for key, text in enumerate(texts):
        normal = f" {' '.join(WORDS.findall(ascii_lower(text)))} "
        found = [
            (normal[: m.start() + 1].count(" ") - 1, m.group().count(" "), r.priority, k, r.name)
            for k, r in enumerate(rules)
            for m in re.finditer(r.pattern, normal)
        ]
        keep = {
            (a, n, name)
            for a, n, p, k, name in found
            if not any(
                b <= a and b + m >= a + n and (q > p or (q == p and (m > n or (m == n and j < k)))) for b, m, q, j, _ in found
            )
        }
        assert got[key] == keep
    assert got[3] == set() and all(got[k] for k in range(5, len(texts)))


def test_the_prefilter_changes_nothing(docs):
    """Every rule on every text, without keywords and needed words, finds the same."""
    free = [replace(r, keyword="", needs=()) for r in licenses.rules()]
    some = docs.select("doc_id", "text")
    gated = {r["doc_id"]: r["detections"] for r in licenses.scanned(some).collect()}
    assert any(gated.values())
    assert {r["doc_id"]: r["detections"] for r in licenses.scanned(some, own=free).collect()} == gated


def test_texts_full_of_statements_take_time_in_proportion(spark):
    texts = ["under the mit license of apache "[:32] * 4000, "all rights reserved " * 6000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    licenses.digests(table.limit(0)).count()
    start = time.perf_counter()
    rows = {r["doc_id"]: r for r in licenses.scanned(table).collect()}
    assert time.perf_counter() - start < 20
    assert len(rows[1]["detections"]) == 6000 and len(rows[0]["detections"]) == 4000


def test_licences_of_no_rows(no_docs):
    assert licenses.digests(no_docs).count() == 0


def _expected(rows):
    words = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(r["text"])), None] for r in rows}
    learnt = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    counts, trie = Counter(), lm.AdaptiveTrie()
    order = lm.ORDER

    def codes(text):
        data = bytes([lm.END]) * order + ascii_lower(text).encode() + bytes([lm.END])
        return [int.from_bytes(data[k : k + order + 1], "big") for k in range(len(data) - order)]

    for r in learnt:
        counts.update(words[r["doc_id"]])
        for code in codes(r["text"]):
            trie.add(code)
    n, v = sum(counts.values()), len(counts)
    return {
        r["doc_id"]: (
            len(words[r["doc_id"]]), sum(counts[w] > 0 for w in words[r["doc_id"]]), n,
            sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[r["doc_id"]]),
            sum(map(trie.log10, codes(r["text"]))),
        )
        for r in rows
    }


@pytest.mark.parametrize(("frequent", "frequent_windows"), [(0, 0), (50, 500), (200_000, 600_000)])
def test_language_models(docs, monkeypatch, frequent, frequent_windows):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "FREQUENT_WINDOWS", frequent_windows)
    want = _expected(docs.collect())
    rows = lm.scored(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        tokens, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, total)
        assert abs(r["base_score"] - base) < 1e-6
        assert abs(r["score"] - score) < 1e-6


def test_chances_add_up_and_adaptive_learns():
    trie = lm.AdaptiveTrie()
    first = lm.adaptive_log10("the cat and the hat", trie)
    assert lm.adaptive_log10("the cat and the hat", trie) > first
    code = int.from_bytes(b"d the", "big") << 8
    assert abs(sum(10 ** trie.log10(code | s) for s in range(256)) - 1) < 1e-9


def test_language_model_odd_rows(odd_docs, no_docs):
    rows = lm.scored(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)} == {1}
    assert lm.scored(no_docs).count() == 0
