"""Mixing sources to target weights, by a flow of words from membership patterns to quotas.

Documents are added up by the set of sources they belong to. A flow network leads the words
of each pattern to the quotas of its sources; a pattern gives its words once at no cost, a
second time at cost 1, a third time at cost 2, so that repetition is spread as evenly as the
quotas allow. Within a pattern, a seeded order of the documents decides which of them are
taken once more than the others.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh_name, kept

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "tideline-mix-"
#: Leading hex digits of the seeded hash that sizes are added up by, to find where the last round ends.
DIGITS = 3
#: Distinct membership patterns that the driver solves the flow for; more raise an error.
MAX_PATTERNS = 200_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def seeded(key: str, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def cyclic_weights(sources: Sequence[str | None]) -> dict[str | None, float]:
    """Weights 5, 2, 1 and so on over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode())
    ordered += [None] * (None in sources)
    return {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(ordered)}


def shared_out(total: int, sizes: dict, weights: dict, most: int = MAX_REPEATS) -> dict:
    """Targets by weight that add up to ``total``, none above ``most`` times its size; what is above goes to the others."""
    open_, capped = dict(weights), 0
    targets: dict = {}
    while open_:
        left, weight = total - capped, sum(open_.values())
        above = [s for s, w in open_.items() if w * left / weight > most * sizes[s]]
        if not above:
            targets |= {s: w * left / weight for s, w in open_.items()}
            break
        for s in above:
            targets[s] = float(most * sizes[s])
            capped += most * sizes[s]
            del open_[s]
    return targets


def routed(supply: list[int], links: list[list[int]], quotas: list[int], rounds: int = MAX_REPEATS) -> list[list[int]]:
    """Words from each pattern to each of its sources: a flow of least repetition cost among the largest ones.

    The cost of a way is that of the round its words come from, whatever sources it is led through. So the
    cheapest flow is found by giving each pattern its words once more per round and
    sending all that still fits, over shortest ways with re-routing.
    """
    flow = [[0] * len(own) for own in links]
    left = list(quotas)
    users: list[list[tuple[int, int]]] = [[] for _ in quotas]
    for p, own in enumerate(links):
        for k, s in enumerate(own):
            users[s].append((p, k))
    for _ in range(rounds):
        spare = list(supply)
        # Straight ways first; the search below then only has to re-route.
        for p, own in enumerate(links):
            for k, s in enumerate(own):
                sent = min(spare[p], left[s])
                flow[p][k] += sent
                spare[p] -= sent
                left[s] -= sent
        while True:
            came: dict[tuple[str, int], tuple] = {("p", p): () for p, rest in enumerate(spare) if rest}
            queue, end = deque(came), None
            while queue and end is None:
                kind, at = queue.popleft()
                if kind == "p":
                    for k, s in enumerate(links[at]):
                        if ("s", s) not in came:
                            came["s", s] = (at, k)
                            if left[s]:
                                end = s
                                break
                            queue.append(("s", s))
                else:
                    for p, k in users[at]:
                        if flow[p][k] and ("p", p) not in came:
                            came["p", p] = (at, k)
                            queue.append(("p", p))
            if end is None:
                break
            steps, node = [], ("s", end)
            while came[node]:
                steps.append((node, came[node]))
                node = ("p", came[node][0]) if node[0] == "s" else ("s", came[node][0])
            sent = min(left[end], spare[node[1]], *(flow[n[1]][c[1]] for n, c in steps if n[0] == "p"), left[end])
            for (kind, at), (before, k) in steps:
                if kind == "s":
                    flow[before][k] += sent
                else:
                    flow[at][k] -= sent
            left[end] -= sent
            spare[node[1]] -= sent
    return flow


@dataclass
class Mix:
    """``rows``: one row per pattern with what its documents get. ``targets``, ``sizes``: by source."""

    rows: DataFrame
    targets: dict
    sizes: dict


def sized(docs: DataFrame, sources: Column, key: str, text: str) -> DataFrame:
    """``key``, ``pattern``, ``size``, ``drawn``: what mixing has to know of a document."""
    return docs.select(
        key, F.to_json(F.array_sort(F.array_distinct(sources))).alias("pattern"),
        word_count(text).alias("size"), seeded(key).alias("drawn"),
    )


def planned(
    own: DataFrame,
    weigh: Callable[[Sequence], dict] = cyclic_weights,
    total: int | None = None,
    repeats: int = MAX_REPEATS,
) -> Mix:
    """Decide for a table as ``sized`` gives it how often each pattern's documents are taken.

    The sources share ``total`` words (all there are) by weight, none more than ``repeats`` times its size.
    """
    spark = own.sparkSession
    by = own.groupBy("pattern", F.substring("drawn", 1, DIGITS).alias("digits")).agg(F.sum("size").alias("size"))
    buckets = kept(by)
    patterns = buckets.groupBy("pattern").agg(F.sum("size").alias("size")).orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; raise MAX_PATTERNS if the driver can hold them")
    members = [json.loads(r["pattern"] or "[null]") for r in patterns]
    supply = [int(r["size"]) for r in patterns]
    sizes: dict = {}
    for own_sources, size in zip(members, supply, strict=True):
        for s in own_sources:
            sizes[s] = sizes.get(s, 0) + size
    targets = shared_out(sum(supply) if total is None else total, sizes, weigh(list(sizes)), repeats)
    names = list(sizes)
    place = {s: k for k, s in enumerate(names)}
    flow = routed(supply, [[place[s] for s in m] for m in members], [int(targets[s]) for s in names], repeats)
    full = {
        r["pattern"]: divmod(sum(sent), size) if size else (0, 0)
        for r, sent, size in zip(patterns, flow, supply, strict=True)
    }
    rounds = spark.createDataFrame(
        [(p, int(a), int(b)) for p, (a, b) in full.items()], "pattern string, rounds bigint, rest bigint"
    )
    # Where the words of the last round end: first the bucket, then the document. A bucket table has
    # at most 16 ** DIGITS rows per pattern, the bucket itself that share of the pattern's documents.
    before = "sum(size) OVER (PARTITION BY pattern ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    edge = (
        buckets.select("pattern", "digits", "size", F.coalesce(F.expr(before.format("digits")), F.lit(0)).alias("before"))
        .join(F.broadcast(rounds), "pattern")
        .filter("before < rest AND rest < before + size")
        .select("pattern", "digits", "before", "rest")
    )
    edges = edge.collect()  # one row per pattern at most
    cut: dict = {}
    if edges:
        edge = spark.createDataFrame([tuple(r) for r in edges], "pattern string, digits string, before bigint, rest bigint")
        first_out = (
            own.withColumn("digits", F.substring("drawn", 1, DIGITS))
            .join(F.broadcast(edge), ["pattern", "digits"])
            .withColumn("start", F.col("before") + F.coalesce(F.expr(before.format("drawn, size")), F.lit(0)))
            .filter("2 * start + size >= 2 * rest")
            .groupBy("pattern")
            .agg(F.min(F.struct("drawn", "size")).alias("cut"))
        )
        cut = {r["pattern"]: (r["cut"]["drawn"], r["cut"]["size"]) for r in first_out.collect()}
        # All documents of the bucket are in: the next bucket is out.
        for r in edges:
            cut.setdefault(r["pattern"], (f"{int(r['digits'], 16) + 1:0{DIGITS}x}" if r["digits"] != "f" * DIGITS else "g", 0))
    ends = {r["pattern"]: r for r in buckets.join(F.broadcast(rounds), "pattern").select(
        "pattern", "digits", "rest", F.coalesce(F.expr(before.format("digits")), F.lit(0)).alias("before")
    ).filter("before >= rest").groupBy("pattern").agg(F.min("digits").alias("digits")).collect()}
    rows = []
    for r, m, size in zip(patterns, members, supply, strict=True):
        p = r["pattern"]
        drawn, least = cut.get(p) or (ends[p]["digits"] if p in ends else "g", 0)
        one = m[0] if len(m) == 1 else None
        rows.append((p, *map(int, full[p][:1]), drawn, int(least), sizes[one] if len(m) == 1 else size,
                     targets[one] if len(m) == 1 else float(sum(full[p][:1]) * size + full[p][1])))
    schema = "pattern string, rounds bigint, cut string, cut_size bigint, source_size bigint, target double"
    return Mix(spark.createDataFrame(rows, schema), targets, sizes)


def applied(own: DataFrame, mix: Mix) -> DataFrame:
    """A table with ``pattern``, ``size`` and ``drawn``, and what it gets: ``copies``, ``source_size``, ``target``.

    ``source_size`` and ``target`` are those of the source, or of the pattern where documents have several.
    """
    once_more = (F.col("drawn") < F.col("cut")) | ((F.col("drawn") == F.col("cut")) & (F.col("size") < F.col("cut_size")))
    rows = F.broadcast(mix.rows.withColumnRenamed("pattern", "_pattern"))  # MAX_PATTERNS rows at most
    return own.join(rows, F.col("pattern").eqNullSafe(F.col("_pattern")), "left").select(
        *own.columns, (F.col("rounds") + once_more.cast("bigint")).alias("copies"), "source_size", "target"
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target``, ``taken``: how many words the mix takes of each document.

    Null and empty texts have size 0 and nothing taken. Null is a source of its own, the last. Rows with the
    same key and size are taken alike; a null key is a key. An empty table gives an empty one.
    """
    own = kept(sized(docs, F.array(F.col(source).cast("string")), key, text))
    return applied(own, planned(own)).select(
        key, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows, all columns as they are, each as often as the mix takes it."""
    columns = docs.columns
    own = sized(docs, F.array(F.col(source).cast("string")), key, text)
    mix = planned(kept(own))
    whole = fresh_name(columns, "_row")
    slim = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias(whole),
        F.to_json(F.array(F.col(source).cast("string"))).alias("pattern"),
        word_count(text).alias("size"), seeded(key).alias("drawn"),
    )
    again = applied(slim, mix).select(whole, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return again.select(*[F.col(f"{whole}.`{c}`").alias(c) for c in columns])
