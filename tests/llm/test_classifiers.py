"""Toxicity, language and URL verdicts: held-out rows, small cases, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import langid, queries, toxicity, urlfilter


def test_misspelt_insults_share_ngrams():
    good, bad = "a quiet letter about the garden and the rain", "you are a worthless idiot and a moron"
    model = toxicity.train([f"{good} {i}" for i in range(40)] + [f"{good} {bad} {i}" for i in range(40)], [0] * 40 + [1] * 40)
    raw, offsets = toxicity.text_bytes(toxicity.pa.array(["the garden and the rain", "what an idiott", "a " * 5000 + "moron"]))
    calm, misspelt, long = model.score(raw, offsets)
    assert calm < 0.5 < 0.7 <= misspelt
    assert long >= 0.7


def test_toxicity_on_held_out_documents(spark, sf_dir):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    known = [r for r in rows if r["doc_id"] in labels]
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in known])
    assert right >= 0.9


def test_toxicity_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    for docs, marks in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        model = toxicity.fit(docs, marks)
        assert toxicity.scored(docs, model).count() == docs.count()
        assert toxicity.without_toxic(docs, model).columns == docs.columns
    empty = toxicity.scored(odd_docs.filter("text is null or text = ''"), toxicity.fit(odd_docs, labels))
    assert {r["score"] for r in empty.collect()} == {0.0}


def test_language_on_held_out_documents(spark, sf_dir, docs):
    languages = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op7_language_id(spark, sf_dir).filter("held_out").collect()
    assert np.mean([r["lang_pred"] == languages[r["doc_id"]] for r in rows]) >= 0.95


def test_filters_answer_all_languages_and_correct_chance():
    words = {f"l{k}": np.random.default_rng(k).integers(0, 1 << 32, 4000, np.uint32) for k in range(70)}
    filters = langid.Filters.filled(words)
    for k, name in enumerate(filters.languages):
        masks = filters.claims(words[name])
        assert (masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).all()
    strange = np.random.default_rng(99).integers(0, 1 << 32, 50_000, np.uint32)
    claimed = (filters.claims(strange)[:, 0] & np.uint64(1)).mean()
    assert abs(claimed - filters.chance[0]) < 0.002


def test_language_odd_rows(odd_docs, no_docs):
    filters = langid.fit(odd_docs)
    rows = {r["doc_id"]: r for r in langid.identified(odd_docs, filters).collect()}
    assert all(rows[i]["lang_pred"] == langid.UNKNOWN and rows[i]["score"] == 0 for i in (0, 1, 2, 8))
    assert rows[3]["lang_pred"] == "en"
    kept = langid.in_known_language(odd_docs, filters)
    assert kept.columns == odd_docs.columns
    assert kept.filter(F.col("doc_id").isin(0, 1, 2, 8)).count() == 0
    assert langid.identified(no_docs, langid.fit(no_docs)).count() == 0
    assert {r["lang_pred"] for r in langid.identified(odd_docs, langid.fit(no_docs)).collect()} == {langid.UNKNOWN}


def test_language_of_a_repeated_key_is_learnt(spark):
    """Many rows of one key are one document, which any sample of keys may miss: all languages are learnt."""
    from zlib import crc32

    keys = [k for k in range(9000) if crc32(str(k).encode()) % 5]
    rows = [(k, f"alpha beta gamma number {k}", "aa") for k in keys[:3000]]
    for n, name in enumerate(("bb", "cc", "dd")):
        rows += [(keys[3000 + n], f"oui non peut etre {name} mot{n}", name)] * 1500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = langid.fit(docs)
    assert list(filters.languages) == ["aa", "bb", "cc", "dd"]
    assert langid.identified(docs, filters).filter("lang_pred is null").count() == 0


def _rule(url):
    own, way, _ = urlfilter.parts(url or "")
    fits = [
        (len(rule), rule, verdict)
        for verdict, rule in urlfilter.RULES
        if (own == rule.split("/")[0] or own.endswith("." + rule.split("/")[0])) and way.startswith(rule[rule.index("/") :])
    ]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_by_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.lit("x").alias("rule"))
    odd = [
        None, "", "no scheme", "http://", "HTTPS://A.Example.NET/EN/", "http://example.net/en/x?y=/de/", "ftp://net", "http://net/",
        "http://xnet/a", "http://a.b.example.com/de/#x", "http://user@example.org:80/fr/a://b/", "http://org?x", "a://b://c.net/", "http://x.net\n/y",
    ]
    pages = pages.unionByName(spark.createDataFrame([(-k, u, "r") for k, u in enumerate(odd, 1)], pages.schema))
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = urlfilter.judged(pages, urlfilter.RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        own, way, _ = urlfilter.parts(urls[r["page_id"]] or "")
        rule, verdict = _rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (own, way, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urlfilter.judged(pages.limit(0), urlfilter.RULES).count() == 0
    assert {r["verdict"] for r in urlfilter.judged(pages, []).collect()} == {"allow"}


def test_trees_learn_labelled_urls():
    rng = np.random.default_rng(2)
    urls = [f"http://h{rng.integers(99)}.example.{'xyz' if k % 2 else 'org'}/a/{rng.integers(10**6)}?q={k}" for k in range(2000)]
    marks = [k % 2 for k in range(2000)]
    model = urlfilter.train(urls[:1200], marks[:1200])
    assert ((model.chance(urls[1200:]) >= 0.5) == np.array(marks[1200:], bool)).mean() > 0.99
