"""Near duplicates by an inverted join on the coordinates of MinHash signatures.

Documents with the same set of word shingles are one class. Each class has a signature of
``coordinates`` minima; a coordinate with its value is a posting. Two classes of at least
the wanted similarity share at least ``matches`` of the postings (``match_threshold`` gives
the number, for a stated chance to miss a pair). Postings are ordered by how many classes have them, so
two such classes meet in the first ``coordinates - matches + 1`` postings of both: the
prefix. Only these are joined. Classes meet the most central class of each posting, the hub; pairs
that share too few postings go, and the rest are confirmed on their full shingle sets. Of the
classes that met one hub, those of one component are skipped; the others are joined on what sets them
apart from the hub.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import hashed_words, in_slices, kept, map_batches, mixed, text_bytes
from tideline.llm.components import components

SHINGLE = 5
COORDINATES = 64
#: Chance that a pair of exactly the wanted similarity shares fewer postings than asked for.
MISS = 1e-7
#: Ids of eight bytes that are broadcast at most.
BROADCAST_IDS = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of shared coordinates that a pair of ``percent`` similarity misses with chance ``miss`` at most."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of a run of texts, and the first of each text (n + 1 entries).

    Words are runs of other bytes than blanks, with A-Z lower-cased. A text of fewer words than
    ``size`` has its whole sequence as one shingle; one without words has none.
    """
    word, first = hashed_words(raw, offsets)
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    starts = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(first[:-1] - starts[:-1], made) + np.arange(starts[-1])
    hashes = np.zeros(len(at), np.uint64)
    length = np.repeat(np.minimum(count, size), made)
    with np.errstate(over="ignore"):
        for k in range(size):
            there = length > k
            own = word[np.where(there, at + k, 0)] if len(word) else hashes
            hashes = np.where(there, mixed(hashes * _ODD + own + _ODD), hashes)
    return hashes, starts


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """By coordinate: a 64-bit posting made of the coordinate and the least hash of the set."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            least = np.minimum(least, (shingles[None, at : at + 512] * factors[:, None]).min(1))
        return mixed(least + (np.arange(coordinates).astype(np.uint64) + np.uint64(1)) * _ODD).view(np.int64)


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``class`` (a 128-bit digest of the shingle set), ``postings``; the last two null without words."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_shingles bigint, class binary, postings array<bigint>"

    def work(batch: pa.RecordBatch):
        raw, offsets = text_bytes(batch.column(1))
        for a, b in in_slices(offsets):
            hashes, starts = shingle_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sizes, names, signatures = [], [], []
            for x, y in zip(starts[:-1], starts[1:], strict=True):
                own = np.unique(hashes[x:y])
                sizes.append(len(own))
                names.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                signatures.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array(signatures, pa.list_(pa.int64())),
                ],
                names=[key, "n_shingles", "class", "postings"],
            )

    return map_batches(docs.select(key, text), schema, work)


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``shingles``: the full shingle sets of the wanted documents.

    Up to ``BROADCAST_IDS`` wanted ids are broadcast, so that texts stay where they are read; more are joined by a shuffle.
    """

    def work(batch: pa.RecordBatch):
        raw, offsets = text_bytes(batch.column(1))
        for a, b in in_slices(offsets):
            hashes, starts = shingle_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sets = [np.unique(hashes[x:y]).view(np.int64) for x, y in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
            )

    wanted = kept(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).join(wanted, "id", "left_semi")
    # An id that comes with several texts stands for all of them: each of its sets is tried.
    return map_batches(rows, "id bigint, shingles array<bigint>", work)


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Of pairs ``a``, ``b``: those that share enough postings and whose full sets are similar enough."""
    own = classes.select("id", "n_shingles", "postings")
    side = {c: own.select(*[F.col(x).alias(f"{c}{'' if x == 'id' else '_' + x}") for x in own.columns]) for c in "ab"}
    close = kept(
        pairs.join(side["a"], "a")
        .join(side["b"], "b")
        .filter(100 * F.least("a_n_shingles", "b_n_shingles") >= percent * F.greatest("a_n_shingles", "b_n_shingles"))
        .filter(F.size(F.array_intersect("a_postings", "b_postings")) >= matches)
        .select("a", "b")
    )
    a, b = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return kept(
        close.join(a, "a")
        .join(b, "b")
        .select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set")).alias("sizes"))
        .filter(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both")))
        .select("a", "b")
        .distinct()
    )


def _others(met: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs ``a``, ``b`` of classes that met the same hub and are in different components.

    Let x, y stand for their differences from the hub: the shingles that only one of the two has. Classes are linked
    if the shingles in one of x, y only are at most t = (100 - percent) / (100 + percent) of their summed sizes. So x and y share
    at least (|x| + |y| - t) / 2 shingles, which is above 0 unless both are linked to the hub. With the differences
    in one order, the rarest among the hub's members first, the smaller one's first t / 2 + 1 and the larger one's
    first t + 1 shingles have one in common. Only those are joined, and positions tell which pairs cannot
    reach the number. Copies of one text that differ in places of their own do not meet here at all.
    """
    own = roots.select(F.col("node").alias("id"), "root")
    at = (
        met.join(own, "id", "left")
        .select("id", "hub", F.coalesce("root", "id").alias("root"))
        .join(own.select(F.col("id").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
        .select("id", "hub", "root", F.coalesce("hub_root", "hub").alias("hub_root"))
    )
    several = at.filter("root <> hub_root").select("hub").distinct()
    members = at.join(several, "hub", "left_semi").select("id", "hub", "root")
    differences = kept(
        members.join(sets.select("id", F.col("shingles").alias("own")), "id")
        .join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("theirs")), "hub")
        .select(
            "id", "hub", "root", F.size("own").alias("n"),
            F.concat(F.array_except("own", "theirs"), F.array_except("theirs", "own")).alias("apart"),
        )
        .withColumn("size", F.size("apart"))
    )
    room = F.col("n") * (100 - percent) / percent
    parts = differences.select("hub", "id", F.explode("apart").alias("shingle"))
    often = parts.groupBy("hub", "shingle").agg(F.count("*").alias("often")).filter("often > 1")
    own_place = Window.partitionBy("hub", "id")
    placed = (
        parts.join(often, ["hub", "shingle"])
        .select("hub", "id", "shingle", "often", F.count("*").over(own_place).alias("common"))
        .withColumn("place", F.row_number().over(own_place.orderBy("often", "shingle")))
        .join(differences.select("hub", "id", "root", "n", "size"), ["hub", "id"])
        # Shingles that no other member of the hub has come first; pos counts from 0.
        .withColumn("pos", F.col("size") - F.col("common") + F.col("place") - 1)
    )
    large = placed.filter(F.col("pos") <= room)
    small = placed.filter(F.col("pos") <= room / 2)
    x, y = (side.select("hub", "shingle", *[F.col(c).alias(f"{k}_{c}") for c in ("id", "root", "n", "size", "pos")])
            for k, side in (("x", small), ("y", large)))
    most = (F.col("x_n") + F.col("y_n")) * (100 - percent) / (100 + percent)
    pairs = (
        x.join(y, ["hub", "shingle"])
        .filter((F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_id") < F.col("y_id"))))
        .filter(F.col("x_root") != F.col("y_root"))
        .filter(
            2 * F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos"))
            >= F.col("x_size") + F.col("y_size") - most
        )
        .groupBy(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
        .agg(F.min("hub").alias("hub"))
    )
    a, b = (
        differences.select("hub", *[F.col(c).alias(o) for c, o in (("id", k), ("n", f"{k}_n"), ("apart", f"{k}_apart"))])
        for k in "ab"
    )
    one_only = F.size("a_apart") + F.size("b_apart") - 2 * F.size(F.array_intersect("a_apart", "b_apart"))
    return kept(
        pairs.join(a, ["hub", "a"])
        .join(b, ["hub", "b"])
        .filter((100 + percent) * one_only <= (100 - percent) * (F.col("a_n") + F.col("b_n")))
        .select("a", "b")
        .distinct()
    )


def grouped(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept``: one row per document.

    Documents are linked if 100 * |A and B| >= ``percent`` * |A or B| for their shingle sets;
    ``component_id`` is the smallest key that links reach, and ``kept`` marks its document. Texts
    without words (null, empty, blanks) have no shingles and are linked with nothing. Keys are bigint and
    expected to be unique: repeated rows get the same answer, rows of one key with different texts each
    their own; a null key is kept if no other document is in its component. Other columns are not read.
    """
    matches = match_threshold(percent)
    prefix = COORDINATES - matches + 1
    docs = docs.withColumn(key, F.col(key).cast("bigint"))
    own = kept(profiles(docs, key, text))
    classes = kept(
        own.filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.min(key).alias("id"), F.max("n_shingles").alias("n_shingles"), F.first("postings").alias("postings"))
    )
    named = classes.filter(F.col("id").isNotNull())
    postings = named.select("id", F.explode("postings").alias("posting"))
    often = postings.groupBy("posting").agg(F.count("*").alias("often")).filter("often > 1")
    by_id = Window.partitionBy("id")
    shared = (
        postings.join(often, "posting")
        .select("id", "posting", "often", F.count("*").over(by_id).alias("shared"))
        .filter(F.col("shared") >= matches)
        .withColumn("central", F.sum(F.log("often")).over(by_id))
        .withColumn("place", F.row_number().over(by_id.orderBy("often", "posting")))
        # The postings that no other class has come first in the prefix.
        .filter(F.col("place") <= prefix - (COORDINATES - F.col("shared")))
        .select("id", "posting", "central")
    )
    entries = kept(shared)
    hubs = entries.groupBy("posting").agg(F.max_by("id", "central").alias("hub"))
    met = kept(entries.join(hubs, "posting").filter(F.col("id") != F.col("hub")).select("id", "hub").distinct())
    stars = met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    sets = kept(_sets(docs, entries.select("id").distinct(), key, text))
    links = _confirmed(stars, classes, sets, percent, matches)
    roots = components(links)
    more = _others(met, roots, sets, percent)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    home = classes.select("class", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    home = home.select("class", F.coalesce("root", "id").alias("root"))
    component = F.coalesce("root", key)
    return own.join(home, "class", "left").select(
        key, "n_shingles", component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept")
    )


def one_of_each_group(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all columns as they are, of one document per group: the one of the smallest key.

    Texts without words all stay. A key goes where none of its rows is kept; of rows that repeat a key that
    stays one is left, the smallest by text and then by the other columns, which have to be comparable then.
    Rows without a key all stay. An empty table gives an empty one.
    """
    found = kept(grouped(docs, percent, key, text))
    keys = kept(
        found.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
        .filter(~F.col("stays") | (F.col("rows") > 1))
        .withColumn(key, F.col(key).cast(docs.schema[key].dataType))
    )
    again = keys.filter("stays").select(key)
    left = docs.join(keys.select(key), key, "left_anti").select(docs.columns)
    if again.isEmpty():
        return left
    # The least row, as an aggregate that is combined before the shuffle: a key may be that of many rows.
    ordered = [text, *(c for c in docs.columns if c != text)]
    repeated = docs.join(again, key, "left_semi").groupBy(F.col(key).alias("_key"))
    least = repeated.agg(F.min(F.struct(*ordered)).alias("_row")).select("_row.*")
    return left.unionByName(least.select(docs.columns))
