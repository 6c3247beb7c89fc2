"""The stages on the small tables, and each of them by its operator's definition."""

from __future__ import annotations

import public_tokenizers
import sentencepiece as library

import corpus_pipeline
from tideline.llm import mixing, neardup, toxicity


def test_stages(spark, sf_dir, docs):
    seen = docs
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, seen, sf_dir)
        before = {r["doc_id"]: r for r in seen.collect()}
        if name == "pieces":
            assert made.columns == ["doc_id", "n_tokens", "ids"]
            model = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            rows = made.collect()
            assert len(rows) == seen.count()
            assert all(r["ids"] == model.encode(before[r["doc_id"]]["text"]) for r in rows)
            continue
        assert made.schema == seen.schema
        left = [r["doc_id"] for r in made.collect()]
        if name == "toxicity":
            gone = set(before) - set(left)
            clean = [k for k in before if labels.get(k) == 0]
            # The small tables have a handful of toxic documents to learn from.
            assert sum(k in gone for k in clean) <= 0.1 * len(clean)
            assert sum(k in gone for k in before if labels.get(k) == 1) >= 0.8 * sum(labels.get(k) == 1 for k in before)
            assert toxicity.without_toxic(docs, toxicity.Model(None, 0.0)).count() == docs.count()
        if name == "language":
            assert len(left) == len(before)
        if name == "near_duplicates":
            kept = neardup.grouped(seen, corpus_pipeline.NEAR).filter("kept").collect()
            assert sorted(left) == sorted(r["doc_id"] for r in kept)
        if name == "mixing":
            taken = mixing.mixed(seen).filter("size > 0").collect()
            want = sorted(r["doc_id"] for r in taken for _ in range(r["taken"] // r["size"]))
            assert sorted(left) == want
        seen = made


def test_pipeline_of_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.collect()
