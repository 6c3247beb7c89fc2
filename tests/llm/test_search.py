"""Top-k and neighbour search against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import forest, queries, topk


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).round(1).tolist(), "x") for i in range(300)]
    rows += [(300 + i, [0.5] * 8, "same") for i in range(60)]
    rows += [rows[7], (400, None, "n"), (401, [1.0, None] + [0.0] * 6, "n"), (402, [math.nan] * 8, "n"), (403, [math.inf] * 8, "n")]
    rows += [(450, [0.0] * 8, "z"), (None, [1.0] * 8, "k"), (500, [1.0, 2.0], "short"), (550, [2.0, 1.0], "short"), (600, [], "none")]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")


def _usable(vectors, zero):
    out = {}
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not (zero or any(v)):
            continue
        out[r["vec_id"]] = np.array(v, float)
    return out


def test_topk_is_exact(vectors, monkeypatch):
    monkeypatch.setattr("tideline.llm.blocks.ROWS_PER_BLOCK", 50)
    monkeypatch.setattr("tideline.llm.blocks.QUERIES_PER_BLOCK", 3)
    found = topk.search(vectors, F.col("id") % 50 == 0, 5).collect()
    own = {i: np.floor(256 * v) for i, v in _usable(vectors, True).items()}
    want = []
    for q in [i for i in own if i % 50 == 0]:
        scores = sorted((-int(own[q] @ v), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_topk_of_huge_components(spark):
    rows = [(i, [float(10.0**i), 1.0]) for i in range(0, 30)]
    found = topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") == 0, 2).collect()
    # From 10 ** 15 on the products are beyond a long: equal scores, the smaller ids first.
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found] == [(1, 15, topk.MOST), (2, 16, topk.MOST)]


def test_empty_tables(vectors):
    assert topk.search(vectors.limit(0), F.col("id") % 50 == 0, 5).count() == 0
    assert forest.search(vectors.limit(0), F.col("id") % 50 == 0, 5).count() == 0


def test_forest_on_odd_rows(vectors):
    found = forest.search(vectors, F.col("id") % 100 == 0, 10, least=1000).collect()
    own = _usable(vectors, False)
    want = []
    for q in [i for i in own if i % 100 == 0]:
        near = sorted((float(np.sqrt(((own[q] - v) ** 2).sum())), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
        want += [(q, k, i, d) for k, (d, i) in enumerate(near[:10], 1)]
    # A block is smaller here than the least number of candidates, so that all are compared.
    assert [tuple(r)[:3] for r in sorted(found)] == [w[:3] for w in sorted(want)]
    assert np.allclose([r["score"] for r in sorted(found)], [w[3] for w in sorted(want)])


def _recall(rows, enough):
    """Share of the true ten nearest among the candidates, and the share of rows compared."""
    index, hit, compared = forest.Forest(rows), 0, 0
    asked = rows[:: len(rows) // 50]
    for k, found in enumerate(index.candidates(asked, enough)):
        far = ((rows - asked[k]) ** 2).sum(1)
        hit += np.isin(np.argsort(far, kind="stable")[1:11], found).sum()
        compared += len(found)
    return hit / (10 * len(asked)), compared / (len(asked) * len(rows))


def test_forest_recall_on_a_tenth_of_the_rows():
    rows = np.random.default_rng(6).normal(size=(4000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    recall, compared = _recall(rows, 400)
    assert recall >= 0.9
    assert compared <= 0.15


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e200])
def test_forest_of_any_scale(scale):
    recall, _ = _recall(np.random.default_rng(2).normal(size=(2000, 6)) + 40, 200)
    assert recall >= 0.9
    rows = np.random.default_rng(2).normal(size=(500, 6)) * scale
    found = list(forest.Forest(rows, 32).candidates(rows[:5], 50))
    assert all(len(f) >= 50 and i in f for i, f in enumerate(found))


def test_candidates_share_a_prefix():
    """Against a slow climb: prefixes compared symbol by symbol, one step after the other."""
    rng = np.random.default_rng(8)
    rows = np.concatenate([rng.normal(size=(200, 12)), np.ones((30, 12))])
    index = forest.Forest(rows, 6)
    near = index._nearness(rows)
    way = np.argsort(-np.abs(near), axis=3, kind="stable")
    signed = 2 * way + (np.take_along_axis(near, way, 3) > 0)
    own = signed[..., 0]
    for enough in (1, 10, 60, 229):
        for q, found in zip((0, 7, 210), index.candidates(rows[[0, 7, 210]], enough), strict=True):
            want = np.ones(len(rows), bool)
            steps = [(n, p) for n in range(forest.SYMBOLS, 0, -1) for p in forest.PROBES[1:]]
            for length, probes in steps:
                same = (own[:, :, : length - 1] == own[q, :, : length - 1]).all(2)
                last = (own[:, :, length - 1, None] == signed[q, :, length - 1, :probes]).any(2)
                met = (same & last).any(1)
                if met.sum() >= enough:
                    want = met
                    break
            assert found.tolist() == np.flatnonzero(want).tolist()


def test_registered_forest_recall(spark):
    """Of the whole tables: each query's ten nearest found against all of its distances."""
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.1"
    table = pq.read_table(f"{folder}/embeddings.parquet")
    ids, rows = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    hit, found = 0, {}
    for r in queries.op9_forest(spark, folder).collect():
        found.setdefault(r["query_id"], []).append(r)
    asked = ids[ids % 100 == 0]
    assert sorted(found) == sorted(asked.tolist())
    for own in asked:
        far = np.sqrt(((rows - rows[ids == own][0]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, far)) if ids[i] != own][:10]
        got = sorted(found[own], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert np.allclose([r["score"] for r in got], [far[ids == r["vec_id"]][0] for r in got], rtol=0, atol=0)
        hit += len({r["vec_id"] for r in got} & set(ids[best].tolist()))
    assert hit / (10 * len(asked)) >= 0.9


def test_registered_search(spark, sf_dir):
    found = queries.op9_forest(spark, sf_dir)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = table.filter("vec_id % 100 = 0").count()
    assert found.count() == 10 * asked
