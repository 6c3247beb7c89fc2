"""Toxicity from bags of character n-grams.

A word is the bag of its character n-grams (with the blanks around it), each with an
embedding of its own; their average goes into a linear softmax over the two classes, and
embeddings and softmax are trained together. A misspelt word shares most n-grams with the
word meant. A text is scored by its words: training pools them with weights that move from
an even average to the worst word, scoring takes the worst word, so that one insult counts
the same in a long text as in a short one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fold, in_slices, lowered, map_batches, text_bytes

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 17
DIMENSIONS = 8
EPOCHS = 12
DOCS_PER_STEP = 64
SEED = 7
THRESHOLD = 0.7
#: Labelled documents of each class that a model is fitted on, at most.
MAX_TOXIC, MAX_CLEAN = 500, 1000


@dataclass
class Words:
    """Words of texts: ``starts`` has the first word of each text (n + 1 entries); ``buckets`` the n-grams word by word."""

    starts: np.ndarray
    buckets: list[np.ndarray]
    owners: list[np.ndarray]

    @property
    def count(self) -> int:
        return int(self.starts[-1])


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """All n-grams of all words of a run of texts, A-Z lower-cased, in buckets."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    text = np.full(len(raw) + n + 1, 32, np.uint8)
    own = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), sizes)
    text[own] = lowered(raw)
    blank = (text == 32) | ((text >= 9) & (text <= 13))
    text[blank] = 32
    first = ~blank[1:] & blank[:-1]
    word = np.concatenate([[0], np.cumsum(first)]).astype(np.int32) - 1
    begins = offsets + np.arange(n + 1)  # of each text's leading blank
    starts = np.concatenate([word[begins[:-1]] + 1, [word[-1] + 1]])
    blanks = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
    wide = text.astype(np.uint64)
    buckets, owners = [], []
    code = wide[:-1] | wide[1:] << np.uint64(8)
    for size in range(3, max(SIZES) + 1):
        if len(text) < size:
            break
        code = code[: len(text) - size + 1] | wide[size - 1 :] << np.uint64(8 * (size - 1))
        if size in SIZES:
            end = len(text) - size + 1
            inside = np.flatnonzero(blanks[size - 1 : size - 1 + end] == blanks[1 : 1 + end])
            mixed = (code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
            buckets.append(mixed.astype(np.int32))
            owners.append(word[inside + 1])
    return Words(starts.astype(np.int64), buckets, owners)


def word_means(words: Words, weights: np.ndarray) -> np.ndarray:
    """By word: the mean of its n-grams' weights."""
    total, parts = np.zeros(words.count), np.zeros(words.count)
    for buckets, owners in zip(words.buckets, words.owners, strict=True):
        total += np.bincount(owners, weights[buckets], words.count)
        parts += np.bincount(owners, minlength=words.count)
    return total / np.maximum(parts, 1)


def worst(words: Words, logits: np.ndarray) -> np.ndarray:
    """By text: the largest logit of its words; -inf without words."""
    out = np.full(len(words.starts) - 1, -np.inf)
    full = np.flatnonzero(np.diff(words.starts) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(logits, words.starts[:-1][full])
    return out


@dataclass
class Model:
    """``weights`` of the buckets for the logit of being toxic, and its ``bias``; None: nothing to learn from."""

    weights: np.ndarray | None
    bias: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        if self.weights is None:
            return out
        for a, b in in_slices(offsets):
            words = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            z = worst(words, word_means(words, self.weights) + self.bias)
            out[a:b] = np.where(np.isfinite(z), 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)
        return out


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """Fit embeddings and softmax to labelled texts. Without both classes nothing is learnt, and all scores are 0."""
    marks = np.array(toxic, float)
    if not len(marks) or marks.min() == marks.max():
        return Model(None, 0.0)
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    grown_e, grown_s, grown_b = (np.full(x.shape, 1e-6, np.float32) for x in (embedding, softmax, bias))
    parts = []
    order = rng.permutation(len(texts))
    step = int(np.clip(len(order) // 24, 4, DOCS_PER_STEP))
    for at in range(0, len(order), step):
        own = order[at : at + step]
        raw, offsets = text_bytes(pa.array([texts[i] for i in own], pa.string()))
        words = words_of(raw, offsets)
        if words.count:
            bucket, owner = np.concatenate(words.buckets), np.concatenate(words.owners)
            used, bucket = np.unique(bucket, return_inverse=True)
            doc = np.repeat(np.arange(len(own)), np.diff(words.starts))
            per_word = np.maximum(np.bincount(owner, minlength=words.count), 1)
            parts.append((used, bucket.astype(np.int32), owner, doc, per_word.astype(np.float32), words.starts, marks[own]))
    share = marks.mean()
    for epoch in range(EPOCHS):
        sharpness = 0.0 if epoch < 3 else min(4.0, 0.5 * (epoch - 2))
        for k in rng.permutation(len(parts)):
            used, bucket, owner, doc, per_word, starts, mark = parts[k]
            local = embedding[used]
            vectors = np.stack(
                [np.bincount(owner, local[bucket, d], len(per_word)) for d in range(DIMENSIONS)], 1
            ) / per_word[:, None]
            both = vectors @ softmax + bias
            logit = both[:, 1] - both[:, 0]
            top = np.zeros(len(mark))
            full = np.flatnonzero(np.diff(starts) > 0)
            top[full] = np.maximum.reduceat(logit, starts[:-1][full])
            pull = np.exp(sharpness * (logit - top[doc]))
            pull /= np.bincount(doc, pull, len(mark))[doc]
            pooled = np.bincount(doc, pull * logit, len(mark))
            chance = 1 / (1 + np.exp(-np.clip(pooled, -30, 30)))
            balance = np.where(mark == 1, 0.5 / share, 0.5 / (1 - share))
            slope = ((chance - mark) * balance)[doc] * pull / len(mark)
            side = np.array([-1.0, 1.0], np.float32)
            d_softmax = (vectors * slope[:, None]).sum(0)[:, None] * side
            d_bias = slope.sum() * side
            d_vectors = slope[:, None] * (softmax @ side) / per_word[:, None]
            d_local = np.stack(
                [np.bincount(bucket, d_vectors[owner, d], len(used)) for d in range(DIMENSIONS)], 1
            ).astype(np.float32)
            grown_e[used] += d_local**2
            grown_s += d_softmax**2
            grown_b += d_bias**2
            embedding[used] = local - 0.3 * d_local / np.sqrt(grown_e[used])
            softmax -= 0.05 * d_softmax / np.sqrt(grown_s)
            bias -= 0.05 * d_bias / np.sqrt(grown_b)
    weights = (embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    return Model(weights, float(bias[1] - bias[0]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    folds: int = 3,
    held_out: int = 1,
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
) -> Model:
    """A model of at most ``max_toxic`` and ``max_clean`` labelled documents outside the held-out fold.

    They are those of the smallest hashes of their keys, each with one text: the smallest, where rows repeat a
    key. A document with several labels is toxic if one of them says so; labels without a document, null labels and null keys are left out.
    """
    known = (
        labels.filter((fold(key, folds) != held_out) & F.col(toxic).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.col(toxic).cast("int")).alias("_mark"))
        .join(docs.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi")
    )
    picks = [
        known.filter(F.col("_mark") == mark).orderBy(F.xxhash64(F.lit(SEED), "_key"), "_key").limit(most)
        for mark, most in ((1, max_toxic), (0, max_clean))
    ]
    # At most max_toxic + max_clean keys.
    chosen = F.broadcast(picks[0].unionByName(picks[1]))
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key")
    rows = found.groupBy("_key", "_mark").agg(F.min("_text").alias("_text")).orderBy("_key").collect()
    return train([r["_text"] for r in rows], [r["_mark"] for r in rows])


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) of every whole text.

    Null and empty texts and texts of blanks score 0. Repeated rows are scored alike; other columns are not read.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(*text_bytes(batch.column(1)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
            names=[key, "score", "predicted"],
        )

    return map_batches(docs.select(key, text), schema, work)


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text is not predicted to be toxic. Null and empty texts stay."""
    place = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(*text_bytes(batch.column(place))) < THRESHOLD))

    return map_batches(docs, docs.schema, work)
