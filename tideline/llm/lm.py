"""Scores of a byte model by partial matching, and of a smoothed word model.

The byte model is a trie of contexts up to five bytes with the counts of the bytes that
followed. A byte takes its chance from the longest context that has been followed by it;
each context that has not passes on its escape chance, the number of its distinct followers
over all its followers and that number, and its followers are excluded in the shorter
contexts. Below the empty context all bytes left are alike. A text ends with a symbol of its own.

The trie is a table of windows, contexts with a follower, and as large as the texts make it. A window
that was learnt is found at its longest context; the others, each once, are joined with their contexts.
What a text has apart from the most frequent windows is looked up by a join, too.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fold, hashed_words, in_slices, kept, lowered, map_batches, small_batches, text_bytes

#: The end of a text, and what stands before it: a byte that UTF-8 never has.
END = 0xFF
#: Bytes of the longest context; a window of it and its follower fits a long.
ORDER = 5
#: The most frequent words and windows, at most, which tasks look up on the spot; all others are looked up by a join.
FREQUENT, FREQUENT_WINDOWS = 200_000, 600_000
#: The key of the end of a text among words.
END_KEY = np.int64(-1)


def shorter(code, order: int):
    """A window, or a column of them, with a context of ``order`` bytes only."""
    mask = (1 << 8 * (order + 1)) - 1
    return code.bitwiseAND(mask) if isinstance(code, Column) else code & mask


class AdaptiveTrie:
    """A trie that learns from each byte after it has coded it."""

    def __init__(self) -> None:
        self.followers: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)

    def add(self, code: int, count: int = 1) -> None:
        for order in range(ORDER + 1):
            own = self.followers[order, shorter(code, order) >> 8]
            own[code & 0xFF] = own.get(code & 0xFF, 0) + count

    def log10(self, code: int) -> float:
        symbol, excluded, chance = code & 0xFF, set(), 0.0
        for order in range(ORDER, -1, -1):
            own = self.followers.get((order, shorter(code, order) >> 8), {})
            left = {s: n for s, n in own.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return chance + math.log10(left[symbol] / total)
            chance += math.log10(len(left) / total)
            excluded |= left.keys()
        return chance - math.log10(256 - len(excluded))


def adaptive_log10(text: str | None, trie: AdaptiveTrie | None = None) -> float:
    """The log chance of a text under a trie that goes on learning; a new one, if none is given."""
    own = trie if trie is not None else AdaptiveTrie()
    score = 0.0
    for code in windows(*text_bytes(pa.array([text], pa.string())))[0].tolist():
        score += own.log10(code)
        own.add(code)
    return score


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One window per byte and one for the end of each text, A-Z lower-cased; and the first of each text (n + 1 entries)."""
    n = len(offsets) - 1
    starts = offsets + np.arange(n + 1)
    text = np.full(len(raw) + (ORDER + 1) * n, END, np.int64)
    text[np.arange(len(raw)) + np.repeat((ORDER + 1) * np.arange(n) + ORDER, np.diff(offsets))] = lowered(raw)
    code = np.zeros(max(0, len(text) - ORDER), np.int64)
    for k in range(ORDER + 1):
        code = code << 8 | text[k : len(text) - ORDER + k]
    at = np.arange(starts[-1]) + np.repeat(ORDER * np.arange(n), np.diff(starts))
    return code[at], starts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, index = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(index, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """``kind`` (0 words, 1 windows), ``key``, ``n``: counts over all rows, added up per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[], []]
        held, ends = [0, 0], 0

        def add(kind: int, codes: np.ndarray) -> None:
            index, keys = pd.factorize(codes)
            parts[kind].append((keys, np.bincount(index, minlength=len(keys))))
            held[kind] += len(keys)
            if held[kind] > 2_000_000:
                parts[kind] = [_merged(parts[kind])]
                held[kind] = len(parts[kind][0][0])

        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            ends += batch.num_rows
            for a, b in in_slices(offsets):
                own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                add(0, hashed_words(*own)[0].view(np.int64))
                add(1, windows(*own)[0])
        if ends:
            parts[0].append((np.array([END_KEY]), np.array([ends])))
        for kind in (0, 1):
            if parts[kind]:
                keys, n = _merged(parts[kind])
                for at in range(0, len(keys), 100_000):
                    k = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 100_000])],
                        names=["kind", "key", "n"],
                    )

    small_batches(docs.sparkSession)
    return (
        docs.select(text)
        .mapInArrow(run, "kind int, key bigint, n bigint")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"))
    )


def _most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the largest ``n``, as many classes of about equal ``n`` as keep them to ``most``."""
    size = F.floor(F.log2("n") * 16)
    left, least = most, None
    for r in rows.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["size"]
    return rows.filter(size >= least) if least is not None else rows.limit(0)


def _nodes(longest: DataFrame) -> DataFrame:
    """The trie: ``level``, ``code``, ``n``, the windows of each order of context and their counts."""
    own = F.array(*[
        F.struct(F.lit(k).alias("level"), shorter(F.col("key"), k).alias("code")) for k in range(ORDER + 1)
    ])
    rows = longest.select(F.explode(own).alias("own"), "n").select("own.level", "own.code", "n")
    return kept(rows.groupBy("level", "code").agg(F.sum("n").alias("n")))


def _contexts(nodes: DataFrame) -> DataFrame:
    """``level``, ``context``, ``followers``, ``total`` of their counts, and ``below``, the total in the next shorter context.

    A byte that follows a context also follows its shorter ones, so ``below`` is what the context excludes
    there. A shorter window belongs to 256 longer ones at most, so no key is hot.
    """
    lower = nodes.select((F.col("level") + 1).alias("level"), F.col("code").alias("lower"), F.col("n").alias("there"))
    own = F.lit(0).cast("bigint")
    for order in range(1, ORDER + 1):
        own = F.when(F.col("level") == order, shorter(F.col("code"), order - 1)).otherwise(own)
    return kept(
        nodes.withColumn("lower", own).join(lower, ["level", "lower"], "left")
        .groupBy("level", F.shiftright("code", 8).alias("context"))
        .agg(F.count("*").alias("followers"), F.sum("n").alias("total"), F.sum("there").alias("below"))
    )


def _learnt(longest: DataFrame, contexts: DataFrame) -> DataFrame:
    """``key``, ``n``, ``value``: the log chance of the windows that were learnt."""
    own = contexts.filter(F.col("level") == ORDER).select("context", "followers", "total")
    return longest.withColumn("context", F.shiftright("key", 8)).join(own, "context").select(
        "key", "n", F.log10(F.col("n") / (F.col("total") + F.col("followers"))).alias("value")
    )


def _escaped(novel: DataFrame, nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """``key``, ``value``: the log chance of distinct windows that were not learnt, down from their longest contexts.

    Contexts and windows of up to two bytes are 65,536 of a length at most: they are broadcast, for many windows
    ask for the same ones. What is longer is looked up in one join of all lengths.
    """
    key, zero = F.col("key"), F.lit(0).cast("bigint")
    contexts_at = [(k, True, F.shiftright(shorter(key, k), 8)) for k in range(ORDER + 1)]
    wanted = contexts_at + [(k, False, shorter(key, k)) for k in range(ORDER)]
    asks = F.array(*[
        F.struct(F.lit(k).alias("level"), F.lit(c).alias("is_context"), at.alias("at")) for k, c, at in wanted
    ])
    asked = novel.select("key", F.explode(asks).alias("ask")).select("key", "ask.*")
    facts = contexts.select(
        "level", F.lit(True).alias("is_context"), F.col("context").alias("at"), "followers", "total", "below"
    ).unionByName(
        nodes.filter(F.col("level") < ORDER).select(
            "level", F.lit(False).alias("is_context"), F.col("code").alias("at"), zero.alias("followers"),
            F.col("n").alias("total"), zero.alias("below"),
        )
    )
    short, by = F.col("level") <= F.when(F.col("is_context"), 2).otherwise(1), ["level", "is_context", "at"]
    answers = (
        asked.filter(short).join(F.broadcast(facts.filter(short)), by, "left")
        .unionByName(asked.filter(~short).join(facts.filter(~short), by, "left"))
    )
    found = answers.groupBy("key").agg(
        *[
            F.max(F.when((F.col("level") == k) & (F.col("is_context") == c), F.col(column))).alias(f"{name}{k}")
            for k, c, _ in wanted
            for name, column in ((("f", "followers"), ("t", "total"), ("b", "below")) if c else (("n", "total"),))
        ]
    )

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), zero)

    # From the shortest context on: the chance there, for a byte that no longer context was followed by.
    value = -F.log10(256 - known("f0"))
    for k in range(ORDER + 1):
        gone, gone_counts = (known(f"f{k + 1}"), known(f"b{k + 1}")) if k < ORDER else (zero, zero)
        kinds = F.when(F.col(f"f{k}").isNotNull(), F.col(f"f{k}") - gone).otherwise(zero)
        total = known(f"t{k}") - gone_counts + kinds
        value += F.when(kinds > 0, F.log10(kinds / total)).otherwise(0.0)
        if k < ORDER:
            value = F.when(F.col(f"n{k}").isNotNull(), F.log10(F.col(f"n{k}") / total)).otherwise(value)
    return found.select("key", value.alias("value"))


class Values:
    """What every task has at hand of the most frequent keys: a value each."""

    def __init__(self, rows: DataFrame):
        table = rows.toArrow()
        keys, values = table.column("key").to_numpy(), table.column("value").to_numpy()
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, nan for those that are not frequent."""
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.nan)


def _looked_up(values: Values, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """By text: the sum of the values of its keys, how many have one, and the keys that have none."""
    index, distinct = pd.factorize(keys)
    own = values.of(distinct)[index] if len(index) else np.zeros(0)
    none = np.isnan(own)
    sums = np.concatenate([[0.0], np.cumsum(np.where(none, 0.0, own))])
    rest = np.flatnonzero(none)
    cuts = np.searchsorted(rest, first)
    tails = [keys[rest[x:y]] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return sums[first[1:]] - sums[first[:-1]], np.diff(first) - np.diff(cuts), tails


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every whole text.

    Words and bytes are counted over all texts outside the held-out fold. ``base_score`` adds up log10((c + 1) / (N + V + 1)) of the
    words and one end; ``score`` is the byte model's log10 chance of the text, A-Z lower-cased, and its end. Null counts as
    empty: one token, the end. A null key is outside of all folds and in neither learns nor is held out (``held_out`` is
    null). Without rows to learn from c, N and V are 0 and bytes are alike. Repeated rows count as often as they are there.
    """
    spark = docs.sparkSession
    out = fold(key, folds) == held_out
    counts = kept(_counted(docs.filter(~out), text))
    words = counts.filter("kind = 0").select("key", "n", F.log10(F.col("n") + 1.0).alias("value"))
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    last = words.filter(F.col("key") == int(END_KEY)).first()
    ends = last["n"] if last else 0
    longest = counts.filter("kind = 1").select("key", "n")
    nodes = _nodes(longest)
    contexts = _contexts(nodes)
    learnt = kept(_learnt(longest, contexts))
    frequent = spark.sparkContext.broadcast(
        [
            Values(_most_frequent(rows, most).select("key", "value"))
            for rows, most in ((words, FREQUENT), (learnt, FREQUENT_WINDOWS))
        ]
    )
    base = math.log10(n + v + 1)
    kind = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of_words, of_windows = frequent.value
        raw, offsets = text_bytes(batch.column(1))
        for a, b in in_slices(offsets):
            part = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            score, _, rest = _looked_up(of_windows, *windows(*part))
            hashes, first = hashed_words(*part)
            sums, known, tail = _looked_up(of_words, hashes.view(np.int64), first)
            ids = [
                xxhash.xxh3_128_digest(f"{k}/".encode() + part[0][x:y].tobytes())
                for k, x, y in zip(batch.column(0).slice(a, b - a).to_pylist(), part[1][:-1], part[1][1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(np.diff(first) + 1),
                    pa.array(known + (ends > 0)), pa.array(sums + math.log10(ends + 1)), pa.array(score),
                    pa.array(tail, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.int64())),
                ],
                names=[key, "row", "n_tokens", "known", "sum", "score", "tail", "rest"],
            )

    schema = (
        f"`{key}` {kind}, row binary, n_tokens bigint, known bigint, sum double, score double, "
        "tail array<bigint>, rest array<bigint>"
    )
    rows = kept(map_batches(docs.select(key, text), schema, work))
    # Rows of one key and text have one id, and are looked up once.
    alike = rows.filter((F.size("tail") > 0) | (F.size("rest") > 0)).dropDuplicates(["row"])
    asked = kept(
        alike.select("row", F.lit(0).alias("kind"), F.explode("tail").alias("key"))
        .unionByName(alike.select("row", F.lit(1).alias("kind"), F.explode("rest").alias("key")))
        .groupBy("row", "kind", "key")
        .agg(F.count("*").alias("times"))
    )
    novel = kept(asked.filter("kind = 1").select("key").distinct().join(learnt.select("key"), "key", "left_anti"))
    values = (
        words.select(F.lit(0).alias("kind"), "key", "value")
        .unionByName(learnt.select(F.lit(1).alias("kind"), "key", "value"))
        .unionByName(_escaped(novel, nodes, contexts).select(F.lit(1).alias("kind"), "key", "value"))
    )
    more = F.col("times") * F.col("value")
    rare = asked.join(values, ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(F.col("kind") == 0, more)).alias("more"),
        F.sum(F.when(F.col("kind") == 0, F.col("times"))).alias("found"),
        F.sum(F.when(F.col("kind") == 1, more)).alias("chance"),
    )
    return rows.select(key, "row", "n_tokens", "known", "sum", "score").join(rare, "row", "left").select(
        key,
        out.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("sum") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * base).alias("base_score"),
        (F.col("score") + F.coalesce("chance", F.lit(0.0))).alias("score"),
    )
