"""Language from Bloom filters of character n-grams, one bit of a row mask per language.

Each n-gram hashes to a few rows of one table. A row holds a bit per language, so that the
AND of the rows is the set of all languages whose filter contains the n-gram. A text's
n-grams are counted by language; what a filter answers wrongly by chance, known from its
fill, is taken off; the largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import fold, in_slices, map_batches, text_bytes

ROW_BITS = 18
HASHES = 3
#: Documents of one language that its filter is filled from, at most, and n-grams it takes, at most.
MAX_DOCS, MAX_NGRAMS = 400, 12_000
#: Share of a language's sampled documents that an n-gram must occur in.
LEAST_SHARE = 0.02
#: Share of the largest such share in any language that it must reach.
TYPICAL = 0.25
#: A text of which no language claims this share of n-grams is not prose of a learnt language.
LEAST_CLAIM = 0.1
UNKNOWN = "und"
SEED = 11

# Letters in lower case, bytes of other characters as they are, everything else a blank.
_FOLDED = np.array(
    [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8
)


def ngrams_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All four-byte n-grams without an inner blank, and the first one of each text (n + 1 entries)."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    text = np.full(len(raw) + 2 * n + 2, 32, np.uint8)
    own = np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, sizes)
    text[own] = _FOLDED[raw]
    wide = text.astype(np.uint32)
    code = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    inside = np.flatnonzero((text[1:-2] != 32) & (text[2:-1] != 32))
    return code[inside], np.searchsorted(inside, offsets + 2 * np.arange(n + 1))


def _rows(codes: np.ndarray) -> list[np.ndarray]:
    """The rows of each n-gram, one array per hash."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64((1 << ROW_BITS) - 1)
    return [((mixed >> np.uint64(k * ROW_BITS)) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """``bits``: a row of 64-bit masks per table row; ``chance``: by language, how often a strange n-gram is claimed."""

    languages: list[str] = field(default_factory=list)
    bits: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.uint64))
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @staticmethod
    def filled(ngrams: dict[str, np.ndarray]) -> Filters:
        languages = sorted(ngrams)
        bits = np.zeros((1 << ROW_BITS, -(-max(1, len(languages)) // 64)), np.uint64)
        for k, language in enumerate(languages):
            for rows in _rows(ngrams[language]):
                np.bitwise_or.at(bits[:, k // 64], rows, np.uint64(1 << (k % 64)))
        fill = np.array([(bits[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))])
        return Filters(languages, bits, fill**HASHES)

    def claims(self, codes: np.ndarray) -> np.ndarray:
        """The masks of the languages that contain each n-gram."""
        first, *rest = _rows(codes)
        out = self.bits[first]
        for rows in rest:
            out &= self.bits[rows]
        return out

    def judge(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: the index of the language (-1: none), its share of the corrected counts, its share of the n-grams."""
        n = len(offsets) - 1
        best, score, claim = np.full(n, -1), np.zeros(n), np.zeros(n)
        if not self.languages:
            return best, score, claim
        for a, b in in_slices(offsets):
            own = offsets[a : b + 1] - offsets[a]
            codes, starts = ngrams_of(raw[offsets[a] : offsets[b]], own)
            index, distinct = pd.factorize(codes)
            masks = self.claims(distinct)
            total = np.diff(starts)
            counts = np.zeros((b - a, len(self.languages)))
            for k in range(len(self.languages)):
                hit = (masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.int32)
                sums = np.concatenate([[0], np.cumsum(hit[index])])
                seen = sums[starts[1:]] - sums[starts[:-1]]
                counts[:, k] = np.clip((seen - total * self.chance[k]) / (1 - self.chance[k]), 0, None)
            top = counts.argmax(1)
            most, every = counts[np.arange(b - a), top], counts.sum(1)
            best[a:b] = top
            score[a:b] = np.where(every > 0, most / np.maximum(every, 1e-9), 0)
            claim[a:b] = np.where(total > 0, most / np.maximum(total, 1), 0)
        # Without a letter no language is given.
        letters = np.concatenate([[0], np.cumsum((_FOLDED[raw] != 32) & (raw < 128))])
        for i in np.flatnonzero(letters[offsets[1:]] == letters[offsets[:-1]]):
            if not any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace")):
                best[i], score[i], claim[i] = -1, 0, 0
        return best, score, claim


def train(texts: list[str | None], languages: list[str]) -> Filters:
    """Filters of the n-grams that occur in at least ``LEAST_SHARE`` of a language's texts, the commonest first.

    An n-gram far commoner in another language is not taken: it comes from quotations.
    """
    found: list[np.ndarray] = []
    shares: list[np.ndarray] = []
    marks, every = np.array(languages, object), sorted(set(languages))
    for language in every:
        own = [texts[i] for i in np.flatnonzero(marks == language)]
        raw, offsets = text_bytes(pa.array(own, pa.string()))
        parts = [
            np.unique(ngrams_of(raw[a:b], np.array([0, b - a]))[0])
            for a, b in zip(offsets[:-1], offsets[1:], strict=True)
        ]
        codes, docs = np.unique(np.concatenate(parts), return_counts=True)
        enough = docs >= max(1, LEAST_SHARE * len(own))
        found.append(codes[enough])
        shares.append(docs[enough] / len(own))
    if not every:
        return Filters()
    codes, inverse = np.unique(np.concatenate(found), return_inverse=True)
    most = np.zeros(len(codes))
    np.maximum.at(most, inverse, np.concatenate(shares))
    ngrams: dict[str, np.ndarray] = {}
    for language, own, share in zip(every, found, shares, strict=True):
        typical = share >= TYPICAL * most[np.searchsorted(codes, own)]
        own, share = own[typical], share[typical]
        ngrams[language] = own[np.lexsort((own, -share))][:MAX_NGRAMS]
    return Filters.filled(ngrams)


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = 5,
    held_out: int = 0,
    max_docs: int = MAX_DOCS,
) -> Filters:
    """Filters from at most ``max_docs`` documents of each language outside the held-out fold.

    They are those of the smallest hashes of their keys, each with one text: the smallest, where rows repeat a
    key. Rows with a null key, text or language teach nothing.
    """
    spark = docs.sparkSession
    known = docs.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")
    ).filter((fold(key, folds) != held_out) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # A key that many rows repeat is one draw, so keys are counted, not rows.
    known = known.withColumn("_drawn", F.xxhash64(F.lit(SEED), "_key"))
    sizes = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.approx_count_distinct("_drawn").alias("n")).collect()}
    if not sizes:
        return Filters()
    # One row per language: the share that gives somewhat more than enough documents.
    shares = spark.createDataFrame(
        [(k, min(1.0, 1.5 * max_docs / n + 50 / n)) for k, n in sizes.items()], "_lang string, _share double"
    )
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_drawn", "_key"))
    rows = (
        known.join(F.broadcast(shares), "_lang")
        .filter(F.pmod("_drawn", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
        .groupBy("_lang", "_drawn", "_key")
        .agg(F.min("_text").alias("_text"))
        .withColumn("_place", place)
        .filter(F.col("_place") <= max_docs)
        .select("_text", "_lang")
        .collect()
    )
    rows.sort(key=lambda r: (r["_lang"], r["_text"]))
    return train([r["_text"] for r in rows], [r["_lang"] for r in rows])


def identified(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (its share of all languages' corrected counts) of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as all are where nothing was learnt. A text
    that no filter claims gets the first language, with score 0. Repeated rows are judged alike.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double"
    names = np.array([*filters.languages, UNKNOWN], object)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, score, _ = filters.judge(*text_bytes(batch.column(1)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=[key, "lang_pred", "score"]
        )

    return map_batches(docs.select(key, text), schema, work)


def in_known_language(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text is in a learnt language.

    Null texts, texts without a letter and texts of which no language claims ``LEAST_CLAIM`` of the n-grams go.
    """
    place = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, _, claim = filters.judge(*text_bytes(batch.column(place)))
        return batch.filter(pa.array((best >= 0) & (claim >= LEAST_CLAIM)))

    return map_batches(docs, docs.schema, work)
