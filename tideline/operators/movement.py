"""Do individuals move less between years than members of their stock do?"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline import fixed_values as fv
from tideline.functions import draws, expr, file_arrays
from tideline.functions.bulk_draws import Draws, together
from tideline.operators import curate, ranktest
from tideline.operators.spread import _tasks, number_at_random, repeat

TRUTH, TEST = "truth", "test"
WHO = ["area", "individual_id", "year"]
#: Rows of a group that one array or one window holds; larger groups are cut into slices.
ROWS_PER_SLICE = 20_000
#: Rows of an individual that one task holds as arrays, about 150 bytes each.
ROWS_PER_TASK = 8_000_000
#: Replicates of an area that one task permutes.
REPLICATES_PER_TASK = 100
#: Distances computed at a time.
PAIRS_AT_ONCE = 16_384
#: Of an area that is permuted, the individuals' years that are arranged and the keys that are hashed at a time.
ENTRIES_AT_ONCE = 32_768
KEYS_AT_ONCE = 262_144


def positions(curated: DataFrame, stocks: list[str] = fv.STOCKS) -> DataFrame:
    """Located rows of the stocks."""
    return curated.filter(F.col("area").isin(stocks) & curate.located() & F.col("lat").isNotNull()).select(
        "area", "individual_id", "year", "row_seq", "lat", "lon"
    )


def yearly_positions(rows: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The positions of each area, individual and year as one array, in file order.

    Groups of more rows than ``rows_per_slice`` come in several rows, numbered by ``slice``, each with a part of
    the positions; there are at most (rows / ``rows_per_slice``) such groups, which are broadcast. ``slice`` is
    null for all others.
    """
    large = (
        rows.groupBy(*WHO)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > rows_per_slice)
        .select(*WHO, F.ceil(F.col("n") / rows_per_slice).alias("slices"))
    )
    dealt = rows.join(F.broadcast(large), WHO, "left").withColumn("slice", F.pmod(F.xxhash64("row_seq"), F.col("slices")))
    points = F.array_sort(F.collect_list(F.struct("row_seq", "lat", "lon")))
    return dealt.groupBy(*WHO, "slice").agg(points.alias("points"))


def sample_one_per_year(
    rows: DataFrame, replicates: int, seed: int = fv.SEED, first: int = 1, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """One position per individual, area, year and replicate, drawn at random.

    Rows are gathered once into arrays, and a replicate draws a place in one: work and rows grow with the
    replicates times the yearly groups, not times the rows. Of the slices of a large group one wins a race in
    which each runs as fast as it is long, so that every row has the same chance.
    """
    groups = yearly_positions(rows, rows_per_slice)

    def drawn(part: DataFrame, *more: str) -> DataFrame:
        repeated = repeat(part, "rep", first, replicates, *WHO, *more)
        u = draws.uniform(seed, "pick", F.col("rep"), *[F.col(c) for c in (*WHO, *more)])
        point = F.get("points", F.floor(u * F.size("points")).cast("int"))
        return repeated.withColumn("point", point)

    whole = drawn(groups.filter(F.col("slice").isNull())).select("area", "rep", "year", "individual_id", "point")
    speed = draws.uniform(seed, "race", *[F.col(c) for c in ("rep", *WHO, "slice")])
    sliced = drawn(groups.filter(F.col("slice").isNotNull()), "slice").withColumn(
        "race", -F.log(1 - speed) / F.size("points")
    )
    winners = sliced.groupBy("area", "rep", "year", "individual_id").agg(F.min_by("point", "race").alias("point"))
    return whole.unionByName(winners).select("area", "rep", "year", "individual_id", "point.*")


def permute_within_year(
    rows: DataFrame, replicates: int, seed: int = fv.SEED, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """One position per individual, year and replicate, with ``drawn_id``: an individual of the
    same area and year, drawn without replacement.

    The individuals of an area and year are put in a random order in every replicate and
    in one more, numbered 0. The individual at the same place of order 0 is the drawn one.
    """
    picks = sample_one_per_year(rows, replicates, seed, 0, rows_per_slice).drop("row_seq")
    members = rows.select(*WHO).distinct().groupBy("area", "year").agg(F.count("*").alias("n"))
    order = draws.order_key(seed, "place", *[F.col(c) for c in ("rep", "area", "year", "individual_id")])
    numbered = number_at_random(picks, ["area", "rep", "year"], order, members, rows_per_slice)
    same_place = Window.partitionBy("area", "year", "position")
    drawn = F.max(F.when(F.col("rep") == 0, F.col("individual_id"))).over(same_place)
    return numbered.withColumn("drawn_id", drawn).filter("rep > 0").drop("position")


def _mean_pairwise_km(points: Column, radius: float) -> Column:
    """Mean distance over all pairs of an array of positions (one per year) in radians."""
    distances = F.flatten(
        F.transform(
            points,
            lambda a, i: F.transform(
                F.slice(points, i + 2, F.size(points)),
                lambda b: expr.great_circle_km(a["lat"], a["lon"], b["lat"], b["lon"], radius),
            ),
        )
    )
    return F.aggregate(distances, F.lit(0.0), lambda total, d: total + d) / (
        F.size(points) * (F.size(points) - 1) / 2
    )


def individual_distance(points: DataFrame, groups: list[str], radius: float = fv.EARTH_RADIUS_KM) -> DataFrame:
    """Mean distance between the yearly positions of each individual seen in two years or more.

    An individual has one position per year, so its array is as short as the study has years.
    """
    point = F.struct("year", F.radians("lat").alias("lat"), F.radians("lon").alias("lon"))
    return (
        points.groupBy(*groups, "individual_id")
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
        .filter(F.size("points") > 1)
        .select(
            *groups,
            "individual_id",
            F.size("points").alias("n_years"),
            _mean_pairwise_km(F.col("points"), radius).alias("mean_km"),
        )
    )


class _Positions:
    """The positions of some individuals of an area, in arrays; an entry is an individual's year."""

    def __init__(self, table: pa.Table, seed: int, radius: float):
        individual = table["individual_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        year, row, lat, lon = (table[c].to_numpy() for c in ("year", "row_seq", "lat", "lon"))
        order = np.lexsort((lon, lat, row, year, individual))
        individual, year = individual[order], year[order]
        new = np.append(True, (individual[1:] != individual[:-1]) | (year[1:] != year[:-1]))
        self.radius = radius
        self.lat, self.lon = np.radians(lat[order]), np.radians(lon[order])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(order)))
        # The place of an only position is known without a draw.
        self.several = np.flatnonzero(self.size > 1)
        keys = table.select(["area", "individual_id", "year"]).take(order[self.start[self.several]])
        self.picks = Draws(seed, "pick", *keys.columns)
        who = individual[self.start]
        years = np.diff(np.append(np.flatnonzero(np.append(True, who[1:] != who[:-1])), len(who)))
        self.individuals = int((years > 1).sum())
        self.weight = np.repeat(2.0 / (years * np.maximum(years - 1, 1)), years)
        self.pairs = []
        for lag in range(1, int(years.max())):
            found = np.flatnonzero(who[lag:] == who[:-lag])
            self.pairs += [(found[i : i + PAIRS_AT_ONCE], lag) for i in range(0, len(found), PAIRS_AT_ONCE)]

    def drawn(self, reps: list[int]) -> np.ndarray:
        """The place of the position that each entry gives, a row per replicate."""
        places = np.repeat(self.start[None], len(reps), axis=0)
        if len(self.several):
            places[:, self.several] += np.floor(self.picks.uniform(reps) * self.size[self.several]).astype(places.dtype)
        return places

    def total_km(self, places: np.ndarray) -> np.ndarray:
        """Per replicate the sum over individuals of the mean distance between their yearly positions."""
        lat, lon = self.lat[places], self.lon[places]
        cos, total = np.cos(lat), np.zeros(len(places))
        for a, lag in self.pairs:
            b = a + lag
            h = np.sin((lat[:, b] - lat[:, a]) / 2) ** 2
            h += cos[:, a] * cos[:, b] * np.sin((lon[:, b] - lon[:, a]) / 2) ** 2
            total += 2 * self.radius * (np.arcsin(np.fmin(1.0, np.sqrt(h))) @ self.weight[a])
        return total


#: What tasks return: per area, replicate and type the sum of the individuals' mean distances, and their number.
SUMS = pa.schema({"area": pa.string(), "rep": pa.int32(), "type": pa.string(), "km": pa.float64(), "n": pa.int64()})
SUMS_DDL = "area string, rep int, type string, km double, n long"


def _sums(found: list[tuple]) -> list[pa.Array]:
    columns = zip(*found, strict=True) if found else [()] * len(SUMS)
    return [pa.array(c, f.type) for c, f in zip(columns, SUMS, strict=True)]


def _sums_in_tasks(rows: DataFrame, groups: list[str], tasks: int, replicates: int, seed: int, radius: float) -> DataFrame:
    """Per group and replicate the sum of its individuals' mean distances, and their number.

    A task has all positions of the individuals of a group and runs through the replicates.
    """

    def sums(table: pa.Table) -> pa.Table:
        area = table["area"][0].as_py()
        some, found = _Positions(table, seed, radius), []
        for reps in together(1, replicates if some.individuals else 0, len(some.start)):
            found += [(area, r, TRUTH, km, some.individuals) for r, km in zip(reps, some.total_km(some.drawn(reps)), strict=True)]
        return pa.table(_sums(found), SUMS)

    return rows.repartition(tasks, *groups).groupBy(*groups).applyInArrow(sums, SUMS_DDL)


def _blocks(rows: DataFrame) -> DataFrame:
    """The positions in blocks of one area, each an Arrow stream of an Arrow batch of rows at most.

    In the order of ``part`` and ``number`` the positions of an individual's year follow each other in file order,
    and the years of an individual.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            code = batch["area"].dictionary_encode().indices.to_numpy()
            for some in np.split(np.arange(len(code)), np.flatnonzero(np.diff(code)) + 1):
                if len(some):
                    block = batch.select(["individual_id", "year", "lat", "lon"]).slice(some[0], len(some))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, block.schema) as stream:
                        stream.write_batch(block)
                    row = {"area": batch["area"][some[0]].as_py(), "part": part, "number": number, "block": sink.getvalue().to_pybytes()}
                    yield pa.RecordBatch.from_pylist([row], schema)
                    number += 1

    schema = pa.schema({"area": pa.string(), "part": pa.int32(), "number": pa.int32(), "block": pa.binary()})
    return (
        rows.repartition(_tasks(rows), "area", "individual_id")
        .sortWithinPartitions("area", "individual_id", "year", F.asc_nulls_last("row_seq"), "lat", "lon")
        .mapInArrow(packed, "area string, part int, number int, block binary")
    )


class _Keyed:
    """Entries of an area, by their places in it, with the draws of their keys."""

    def __init__(self, seed: int, name: str, area: str, years_first: bool):
        self.seed, self.name, self.area, self.years_first = seed, name, area, years_first
        self.growing, self.sizes, self.draws = file_arrays.Growing(np.uint32), file_arrays.Growing(np.uint32), []
        self.waiting: list[tuple[np.ndarray, pa.Array]] = []

    def add(self, places: np.ndarray, sizes: np.ndarray, years: np.ndarray, individuals: pa.Array) -> None:
        self.growing.add(places)
        self.sizes.add(sizes)
        self.waiting.append((years, individuals))
        if sum(len(y) for y, _ in self.waiting) >= KEYS_AT_ONCE:
            self.hash()

    def hash(self) -> None:
        if self.waiting:
            years, individuals = zip(*self.waiting, strict=True)
            keys = [pa.array(np.concatenate(years)), pa.concat_arrays(individuals)]
            area = pa.repeat(pa.scalar(self.area), len(keys[0]))
            keys = keys if self.years_first else keys[::-1]
            self.draws.append(Draws(self.seed, self.name, area, *keys, empty=file_arrays.empty))
            self.waiting = []

    def close(self) -> None:
        self.hash()
        self.places, self.sizes = self.growing.array(), self.sizes.array()

    def order(self, reps: list[int]) -> np.ndarray:
        """The entries in a random order, a row per replicate."""
        return np.argsort(np.hstack([d.order_key(reps) for d in self.draws]), axis=1)


class _Area:
    """All positions of an area, in files; an entry is an individual's year.

    In memory are, for each replicate that is worked on, the number of a position for every entry, and
    the keys of the entries of one year. Entries are arranged in chunks of whole individuals; in a chunk those of
    individuals seen in equally many years stand together, first year by first year, then second by second.
    """

    def __init__(self, area: str, seed: int, radius: float):
        self.area, self.seed, self.radius = area, seed, radius
        self.growing, self.first = file_arrays.Growing(np.float64, 3), file_arrays.Growing(np.uint32)
        self.several = _Keyed(seed, "pick", area, years_first=False)
        self.years: dict[int, _Keyed] = {}
        self.chunks: list[tuple[int, int, int]] = []
        self.entries = self.individuals = 0
        self.last: tuple | None = None
        self.waiting: list[tuple] = []

    def add(self, block: pa.RecordBatch) -> None:
        """Positions in order; those of an entry may go on in the next block."""
        ids, year = block["individual_id"], block["year"].to_numpy()
        before = self.last or (ids.slice(0, 0), year[:0])
        who = pa.concat_arrays([before[0], ids]).dictionary_encode(null_encoding="encode").indices.to_numpy()
        when = np.concatenate([before[1], year])
        other = who[1:] != who[:-1]
        new = other | (when[1:] != when[:-1])
        if not self.last:
            other, new = np.append(True, other), np.append(True, new)
        begins = np.flatnonzero(new)
        self.waiting.append((begins + self.growing.rows, other[begins], year[begins], ids.take(pa.array(begins))))
        self.last = ids.take(pa.array([len(ids) - 1])), year[-1:].copy()
        lat, lon = np.radians(block["lat"].to_numpy()), np.radians(block["lon"].to_numpy())
        self.growing.add(np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]))
        if self.growing.rows >= 1 << 32:
            raise OverflowError(f"more than 2 ** 32 positions in {self.area}")
        if sum(len(w[0]) for w in self.waiting) >= ENTRIES_AT_ONCE:
            self.arrange(ended=False)

    def arrange(self, ended: bool) -> None:
        """A chunk of the entries so far, without the last individual unless all positions are there."""
        first, other, year = (np.concatenate(c) for c in list(zip(*self.waiting, strict=True))[:3])
        ids = pa.concat_arrays([w[3] for w in self.waiting])
        n = len(first) if ended else int(np.flatnonzero(other)[-1])
        self.waiting = [(first[n:], other[n:], year[n:], ids.slice(n))] if n < len(first) else []
        if n == 0:
            return
        size = np.diff(np.append(first, self.growing.rows))[:n]
        begins = np.flatnonzero(other[:n])
        who = np.cumsum(other[:n]) - 1
        years = np.diff(np.append(begins, n))
        order = np.lexsort((who, np.arange(n) - begins[who], years[who]))
        at = self.entries
        for k, m in zip(*np.unique(years, return_counts=True), strict=True):
            if k > 1:
                self.chunks.append((at, int(k), int(m)))
                self.individuals += int(m)
            at += int(k * m)
        size, year, ids = size[order], year[order], ids.take(pa.array(order))
        self.first.add(first[order])
        several = np.flatnonzero(size > 1)
        if len(several):
            self.several.add(several + self.entries, size[several], year[several], ids.take(pa.array(several)))
        for y in np.unique(year):
            some = np.flatnonzero(year == y)
            keyed = self.years.setdefault(int(y), _Keyed(self.seed, "place", self.area, years_first=True))
            keyed.add(some + self.entries, size[some], year[some], ids.take(pa.array(some)))
        self.entries += n

    def close(self) -> None:
        self.arrange(ended=True)
        self.points, self.first = self.growing.array(), self.first.array()
        for keyed in (self.several, *self.years.values()):
            keyed.close()
        self.owners = {}
        for y, keyed in self.years.items():
            self.owners[y] = file_arrays.empty(len(keyed.places), np.uint32)
            self.owners[y][:] = keyed.places[keyed.order([0])[0]]

    def drawn(self, reps: list[int]) -> np.ndarray:
        """The number of the position that each entry gives, a row per replicate."""
        held, at = np.repeat(self.first[None], len(reps), axis=0), 0
        # The only position of an entry is known without a draw.
        for some in self.several.draws:
            part = slice(at, at + some.size)
            held[:, self.several.places[part]] += np.floor(some.uniform(reps) * self.several.sizes[part]).astype(held.dtype)
            at += some.size
        return held

    def permuted(self, held: np.ndarray, reps: list[int]) -> np.ndarray:
        """The same after each year's individuals are permuted."""
        changed = np.empty_like(held)
        for y, keyed in self.years.items():
            changed[:, self.owners[y]] = np.take_along_axis(held[:, keyed.places], keyed.order(reps), axis=1)
        return changed

    def total_km(self, held: np.ndarray) -> np.ndarray:
        """Per replicate the sum over individuals of the mean distance between their yearly positions.

        The haversine of the angle between two points is a quarter of their squared distance, straight through a ball of radius 1.
        """
        total = np.zeros(len(held))
        for at, k, m in self.chunks:
            points = np.take(self.points, held[:, at : at + k * m], axis=0)
            points = np.ascontiguousarray(np.moveaxis(points, -1, 0)).reshape(3, len(held), k, m)
            for lag in range(1, k):
                apart = points[:, :, lag:] - points[:, :, :-lag]
                apart *= apart
                h = (apart[0] + apart[1] + apart[2]) / 4
                total += 2 * self.radius * np.arcsin(np.fmin(1.0, np.sqrt(h))).sum(axis=(1, 2)) * (2 / (k * (k - 1)))
        return total

    def sums(self, first: int, last: int, types: list[str]) -> Iterator[pa.RecordBatch]:
        for reps in together(first, last if self.individuals else 0, -(-self.entries // max(len(self.years), 1))):
            held = self.drawn(reps)
            for kind in types:
                km = self.total_km(held if kind == TRUTH else self.permuted(held, reps))
                found = [(self.area, r, kind, x, self.individuals) for r, x in zip(reps, km, strict=True)]
                yield pa.RecordBatch.from_arrays(_sums(found), schema=SUMS)


def _permuted_in_tasks(rows: DataFrame, replicates: int, types: list[str], seed: int, radius: float) -> DataFrame:
    """As ``_sums_in_tasks``, also for permuted individuals, for which a task has all positions of an area.

    Every run of ``REPLICATES_PER_TASK`` replicates of an area is a task of its own, which gets the blocks of the
    area in order and puts them into files.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area = None
        for batch in batches:
            area, first = area or _Area(batch["area"][0].as_py(), seed, radius), batch["first"][0].as_py()
            for packed in batch["block"]:
                for block in pa.ipc.open_stream(packed.as_buffer()):
                    area.add(block)
        # The last batch is not held while the area is worked on.
        batch = packed = block = None
        area.close()
        yield from area.sums(first, min(first + REPLICATES_PER_TASK - 1, replicates), types)

    step = F.sequence(F.lit(1), F.lit(replicates), F.lit(REPLICATES_PER_TASK))
    runs = math.ceil(replicates / REPLICATES_PER_TASK)
    nth = F.array_position(F.array(*map(F.lit, fv.STOCKS)), F.col("area")) - 1
    return (
        _blocks(rows)
        .withColumn("first", F.explode(step))
        .withColumn("task", (nth * runs + F.expr(f"(first - 1) div {REPLICATES_PER_TASK}")).cast("int"))
        .repartitionById(len(fv.STOCKS) * runs, "task")
        .sortWithinPartitions("task", "part", "number")
        .groupBy("task")
        .applyInArrow(sums, SUMS_DDL)
    )


def _split(rows: DataFrame, groups: list[str], rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups that fit a task, and the others; large groups are at most (rows / ``rows_per_task``)."""
    large = rows.groupBy(*groups).agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_task).select(*groups)
    return rows.join(F.broadcast(large), groups, "left_anti"), rows.join(F.broadcast(large), groups, "left_semi")


def _replicate_means(in_tasks: DataFrame, points: DataFrame | None, radius: float) -> DataFrame:
    """Mean over individuals per area, replicate and type: those summed in tasks and those that come as rows."""
    groups = ["area", "rep", "type"]
    if points is not None:
        from_rows = individual_distance(points, groups, radius).groupBy(*groups)
        in_tasks = in_tasks.unionByName(from_rows.agg(F.sum("mean_km").alias("km"), F.count("*").alias("n")))
    return in_tasks.groupBy(*groups).agg((F.sum("km") / F.sum("n")).alias("mean_km"))


def observed_distances(
    curated: DataFrame, replicates: int = fv.MOVEMENT_REPLICATES, seed: int = fv.SEED,
    radius: float = fv.EARTH_RADIUS_KM, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Mean distance between the yearly positions of individuals, per area and replicate.

    Individuals are dealt over tasks, each of which runs through the replicates and gives its sums: replicates
    of rows are neither made nor shuffled. Those of individuals above ``rows_per_task`` rows are, from slices.
    """
    whole, large = _split(positions(curated), ["area", "individual_id"], rows_per_task)
    parts = _tasks(curated)
    dealt = whole.withColumn("part", F.pmod(F.xxhash64("individual_id"), F.lit(parts)))
    in_tasks = _sums_in_tasks(dealt, ["area", "part"], parts, replicates, seed, radius)
    return _replicate_means(in_tasks, sample_one_per_year(large, replicates, seed).withColumn("type", F.lit(TRUTH)), radius)


def movement_distances(
    curated: DataFrame, replicates: int = fv.MOVEMENT_REPLICATES, seed: int = fv.SEED,
    radius: float = fv.EARTH_RADIUS_KM, rows_per_task: int | None = None, types: tuple[str, ...] = (TRUTH, TEST),
) -> DataFrame:
    """``observed_distances``, and the same after permuting the individuals of each year.

    Each position is counted for its own individual and for the drawn one, so the sample is computed once. An
    area's positions are sent once for every ``REPLICATES_PER_TASK`` replicates, which a task draws, orders and
    sums: what is shuffled grows with the rows and not with the replicates, and a task keeps the positions in files.
    Where ``rows_per_task`` is given, areas of more rows are permuted as rows, in slices (``permute_within_year``).
    """
    whole, points = positions(curated), None
    if rows_per_task is not None:
        whole, large = _split(whole, ["area"], rows_per_task)
        owners = {TRUTH: F.col("individual_id"), TEST: F.col("drawn_id")}
        owned = F.array(*[F.struct(F.lit(kind).alias("type"), owners[kind].alias("owner")) for kind in types])
        points = (
            permute_within_year(large, replicates, seed)
            .select("area", "rep", "year", "lat", "lon", F.inline(owned))
            .withColumnRenamed("owner", "individual_id")
        )
    return _replicate_means(_permuted_in_tasks(whole, replicates, [*types], seed, radius), points, radius)


def movement_test(distances: DataFrame) -> DataFrame:
    """Are the individuals' distances smaller than the permuted ones?"""
    frequencies = distances.select("area", "type", F.col("mean_km").alias("value"), F.lit(1).alias("n"))
    return ranktest.rank_sum(frequencies, "area", TRUTH, TEST, alternative="less")


def movement_histogram(distances: DataFrame) -> DataFrame:
    return ranktest.histogram(distances, ["area", "type"], "mean_km")
