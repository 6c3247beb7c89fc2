from __future__ import annotations

import pytest

ODD_TEXTS = [None, "", " \t\n", "one", "one two three four five", "A" * 40_000, "wort " * 20_000, "émigré ÄÖÜ 中文 😀", "!!!"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i else None, "x", 1.5, "y") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[3], (None, "no key here at all", None, None, None, None, None), (50, "one", "en", "s1", "x", 0.0, "z")]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, score string, size double, `class` string"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

