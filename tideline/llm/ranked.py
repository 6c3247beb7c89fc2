"""Ranked lexical search over impact vectors in buckets of like length.

A document is a sparse vector of impacts (term weight times saturated frequency), an item a set of
terms, a score their inner product. Vectors are ordered by their length, longest first, and cut into
buckets. Cauchy-Schwarz drops a bucket for an item whose k-th best score so far its longest vector
cannot reach. Inside a bucket the item's heaviest coordinates alone are added up; what the others can
still give is bounded by the lengths that are left and by the largest impacts of the bucket, and only
documents whose bound reaches the k-th best score are scored exactly, in whole numbers.

The vectors are written once in the order of length and read in waves from the top; each wave starts
with the k-th best scores of those before it, and does not read what no item can need any more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import kept, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z to lower case; bytes that belong to no term to blanks.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Terms of items that are searched for together; more items go through in several blocks.
BLOCK_TERMS = 200_000
#: Impacts of a task, tasks at most (then a task has more impacts; it reads them batch by batch), vectors of a bucket.
PIECE_IMPACTS, PIECES, BUCKET_ROWS = 500_000, 50_000, 4096
#: Length classes per doubling of the length.
CLASSES = 4
#: Shares of the vectors, longest first, that are done by the end of each wave.
WAVES = (0.02, 0.25, 1.0)
#: Room for the rounding of bounds.
SLACK = 1e-9


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``term``: the distinct terms of each item. Items without a key have none."""
    terms = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return (
        items.filter(F.col(key).isNotNull())
        .select(F.col(key).cast("bigint").alias("item"), F.explode(F.array_distinct(terms)).alias("term"))
        .distinct()
    )


def counted(docs: DataFrame, numbers: dict[str, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``terms``, ``counts``: size of each text in terms, and how often it has the numbered ones."""
    number_of = {term.encode(): k for term, k in numbers.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for value in batch.column(1):
                words = (value.as_py() or "").encode().translate(FOLDED).split()
                found = [(number_of[w], c) for w, c in Counter(words).items() if w in number_of]
                sizes.append(len(words))
                terms.append([t for t, _ in found])
                counts.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text))
    return rows.mapInArrow(work, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def vectors(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``doc_id``, ``terms``, ``impacts``, ``length``, ``class``: documents that have an id and an item's term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            size = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            m = 10 + (90 * batch.column(1).to_numpy() * n_docs) // n_terms
            impacts = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size)))
            row = np.repeat(np.arange(len(size)), size)
            length = np.sqrt(np.bincount(row, impacts.astype(np.float64) ** 2, len(size)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(offsets, pa.array(terms)),
                    pa.ListArray.from_arrays(offsets, pa.array(impacts)),
                    pa.array(length),
                    pa.array(np.floor(CLASSES * np.log2(np.maximum(length, 1))).astype(np.int32)),
                ],
                names=["doc_id", "terms", "impacts", "length", "class"],
            )

    rows = counts.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
    schema = "doc_id bigint, terms array<int>, impacts array<bigint>, length double, class int"
    return rows.mapInArrow(work, schema).filter("length > 0")


def in_order(rows: DataFrame, classes: list) -> DataFrame:
    """The vectors by length class, longest first, in tasks of about ``PIECE_IMPACTS`` impacts."""
    first, table = 0, []
    size = max(PIECE_IMPACTS, sum(c["impacts"] for c in classes) // PIECES)
    for c in classes:
        pieces = -(-int(c["impacts"]) // size)
        table += [F.lit(c["class"]), F.struct(F.lit(first).alias("first"), F.lit(pieces).alias("pieces"))]
        first += pieces
    place = F.create_map(*table)[F.col("class")]
    part = place["first"] + F.pmod(F.xxhash64("doc_id", "impacts"), place["pieces"]).cast("int")
    return (
        rows.withColumn("part", part)
        .repartitionById(first, "part")
        .sortWithinPartitions(F.desc("length"))
        .drop("part")
    )


class Items:
    """The terms of a block of items, and the best scores found for each."""

    def __init__(self, terms: list[np.ndarray], k: int, least: np.ndarray):
        self.terms, self.k, self.least = terms, k, least.copy()
        self.root = np.sqrt([len(t) for t in terms])
        self.scores = [np.zeros(0, np.int64) for _ in terms]
        self.ids = [np.zeros(0, np.int64) for _ in terms]

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Keep the k best of those at hand and the new ones; equal scores by the smaller id."""
        ids, scores = np.concatenate([self.ids[item], ids]), np.concatenate([self.scores[item], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[item], self.scores[item] = ids[best], scores[best]
        if len(best) == self.k:
            self.least[item] = max(self.least[item], scores[best[-1]])


class Bucket:
    """Vectors of like length, by document and by coordinate."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n: int):
        self.ids, self.length, self.offsets, self.terms, self.impacts = ids, length, offsets, terms, impacts
        order = np.argsort(terms, kind="stable")
        self.row = np.repeat(np.arange(len(ids)), np.diff(offsets))[order]
        self.impact = impacts[order].astype(np.float64)
        self.start = np.searchsorted(terms[order], np.arange(n + 1))
        there = np.flatnonzero(np.diff(self.start))
        self.most = np.zeros(n)
        self.most[there] = np.maximum.reduceat(self.impact, self.start[there])

    def search(self, items: Items, item: int, asked: np.ndarray) -> None:
        """Add the documents that can be among the item's k best. ``asked`` is a scratch array of falses, per term."""
        least = items.least[item]
        terms = items.terms[item]
        if items.root[item] * self.length[0] * (1 + SLACK) < least:
            return
        most = self.most[terms]
        order = np.argsort(-most)
        order = order[: np.count_nonzero(most)]
        terms, most = terms[order], most[order]
        # What the terms from each place on can add at most; those before it are the focus.
        rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0.0]])
        if rest[0] * (1 + SLACK) < least or not len(terms):
            return
        focus = len(terms)
        if least > 0:
            # Enough of them that a document without any is out, and the better half, which narrows the bound.
            focus = max(int(np.searchsorted(-rest * (1 + SLACK), -least, side="right")), (len(terms) + 1) // 2)
        spans = [(self.start[t], self.start[t + 1]) for t in terms[:focus]]
        row = np.concatenate([self.row[a:b] for a, b in spans])
        impact = np.concatenate([self.impact[a:b] for a, b in spans])
        partial = np.bincount(row, impact, len(self.ids))
        left = len(terms) - focus
        bound = partial
        if left:
            beyond = np.maximum(self.length**2 * (1 + SLACK) - np.bincount(row, impact**2, len(self.ids)), 0)
            bound = partial + np.minimum(np.sqrt(left * beyond), rest[focus])
        if len(partial) >= items.k:
            sure = np.partition(partial, len(partial) - items.k)[len(partial) - items.k]
            least = max(least, int(sure * (1 - SLACK)))
        hits = np.flatnonzero((bound * (1 + SLACK) >= least) & (partial > 0))
        if not len(hits):
            return
        asked[terms] = True
        starts, size = self.offsets[hits], np.diff(self.offsets)[hits]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        given = np.where(asked[self.terms[at]], self.impacts[at], 0)
        asked[terms] = False
        score = np.add.reduceat(given, np.concatenate([[0], np.cumsum(size)[:-1]]))
        good = score >= least
        items.add(item, self.ids[hits][good], score[good])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to about ``BUCKET_ROWS`` vectors or ``PIECE_IMPACTS`` impacts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BUCKET_ROWS or sum(b.nbytes for b in held) >= 48 * PIECE_IMPACTS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _buckets(table: pa.Table, n: int) -> Iterator[Bucket]:
    """Runs of vectors in the order of length, longest first, none much shorter than the first of its run."""
    ids, length, kind = (table.column(c).to_numpy() for c in ("doc_id", "length", "class"))
    lists = [table.column(c).chunk(0) for c in ("terms", "impacts")]
    terms, impacts = (a.flatten().to_numpy() for a in lists)
    offsets = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())]).astype(np.int64)
    order = np.argsort(-length, kind="stable")
    size = np.diff(offsets)[order]
    new = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(offsets[order] - new[:-1], size) + np.arange(new[-1])
    ids, length, kind, terms, impacts = ids[order], length[order], kind[order], terms[at], impacts[at]
    ends = np.concatenate([np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(ids)]])
    first = 0
    for end in ends.tolist():
        for a in range(first, end, BUCKET_ROWS):
            b = min(a + BUCKET_ROWS, end)
            span = slice(new[a], new[b])
            yield Bucket(ids[a:b], length[a:b], new[a : b + 1] - new[a], terms[span], impacts[span], n)
        first = end


def found_in(rows: DataFrame, terms: list[np.ndarray], n: int, k: int, least: np.ndarray) -> DataFrame:
    """``at``, ``doc_id``, ``score``: of each task the items' best, at most ``k`` and none below ``least``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(terms, k, least)
        asked = np.zeros(n, bool)
        for table in _gathered(batches):
            for bucket in _buckets(table, n):
                for item in np.flatnonzero(items.root * bucket.length[0] * (1 + SLACK) >= items.least):
                    bucket.search(items, int(item), asked)
        size = [len(s) for s in items.scores]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(size)), size).astype(np.int32)),
                pa.array(np.concatenate([*items.ids, np.zeros(0, np.int64)])),
                pa.array(np.concatenate([*items.scores, np.zeros(0, np.int64)])),
            ],
            names=["at", "doc_id", "score"],
        )

    return rows.mapInArrow(work, "at int, doc_id bigint, score bigint")


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def _searched(docs: DataFrame, own: DataFrame, k: int, key: str, text: str) -> DataFrame | None:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of a block of items; None where no document has a term of them."""
    rows = own.groupBy("item").agg(F.collect_list("term").alias("terms")).orderBy("item").collect()
    numbers = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    counts = kept(counted(docs, numbers, key, text))
    totals = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"]
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    frequencies = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weights = np.zeros(len(numbers), np.int64)
    for row in frequencies.select("t", weight.alias("w")).collect():
        weights[row["t"]] = row["w"]

    made = vectors(counts, weights, n_docs, n_terms)
    classes = made.groupBy("class").agg(F.count("*").alias("rows"), F.sum(F.size("terms")).alias("impacts")).collect()
    classes.sort(key=lambda c: -c["class"])
    if not classes:
        return None
    ordered = kept(in_order(made, classes))
    share = np.cumsum([c["rows"] for c in classes]) / sum(c["rows"] for c in classes)
    terms = [np.array([numbers[t] for t in r["terms"]]) for r in rows]
    least = np.zeros(len(rows), np.int64)
    root = np.sqrt([len(t) for t in terms])
    hits, first = None, 0
    for wave in WAVES:
        last = min(int(np.searchsorted(share, wave)) + 1, len(classes))
        if first >= last:
            continue
        top, low = classes[first]["class"], classes[last - 1]["class"]
        first = last
        # The longest vector of a class is shorter than the next class's least.
        if (root * 2 ** ((top + 1) / CLASSES) * (1 + SLACK) < least).all():
            break
        found = found_in(ordered.filter(F.col("class").between(low, top)), terms, len(numbers), k, least)
        hits = kept(_best(found if hits is None else found.unionByName(hits), k).drop("rank"))
        if first < len(classes):
            full = hits.groupBy("at").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k)
            for row in full.collect():
                least[row["at"]] = row["s"]
    keys = docs.sparkSession.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], "at int, item_id bigint")
    named = _best(hits, k).join(keys, "at")
    return named.select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's ``k`` documents of the highest scores above 0.

    Every row of ``docs`` counts as a document, in the statistics and in the ranking; rows without a key count in
    the statistics only. Equal scores go by the smaller id; rows that repeat a document take a rank each. Rows that
    repeat an item's key are one item with all their terms; items without a key or a term have no result. Null
    and empty texts have no terms. A very long text is held a few times over by the task that counts its terms.
    """
    own = kept(item_terms(items, item_key, item_text))
    total = own.count()
    blocks = max(1, -(-total // BLOCK_TERMS))
    out = None
    for block in range(blocks if total else 0):
        # Items are dealt to blocks by a hash, so that the terms of a block stay few enough for every task.
        part = own if blocks == 1 else own.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = _searched(docs, part, k, key, text)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out
