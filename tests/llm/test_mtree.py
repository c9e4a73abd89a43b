import math

import numpy as np
import pytest
from helpers import SF

from tallymart.llm import mtree, queries


def plain(rows, wanted, k=10):
    """(query_id, rank, vec_id, score) by sorting all rows for each query."""
    good = [(i, v) for i, v in rows if v is not None and None not in v]
    out = []
    for at, (i, v) in enumerate(good):
        if i is None or not wanted(i):
            continue
        scored = [
            (-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for other, (j, w) in enumerate(good) if other != at
        ]
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, rows, modulus, k=10):
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>").repartition(3)
    got = mtree.Tree(df, k).search(df.where(f"vec_id % {modulus} = 0")).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ints = [(r[0], [math.floor(1024 * float(x)) for x in r[1]]) for r in rows]
    got = queries.QUERIES["op11_exact_topk"](spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(ints, lambda i: i % 100 == 0)


@pytest.mark.parametrize("high", [3, 1000])
def test_many_roots_pages_and_parts(spark, monkeypatch, high):
    for name, small in (("PAGE", 4), ("SUBTREE", 20), ("QUERIES", 30), ("ROOTS_PER", 2)):
        monkeypatch.setattr(mtree, name, small)
    random = np.random.default_rng(high)
    centres = random.integers(-high, high, (12, 6))
    points = centres[random.integers(0, 12, 700)] + random.integers(-2, 3, (700, 6)) * random.integers(0, 2, (700, 1))
    rows = [(int(i), [int(x) for x in p]) for i, p in zip(random.permutation(700), points)]
    assert searched(spark, rows, 7) == plain(rows, lambda i: i % 7 == 0)


def test_copies_ties_nulls_and_repeated_ids(spark):
    rows = [(i, [3, -4, 0]) for i in range(60)] + [(i, [3, -4]) for i in (200, 200, 200, 7)] + [(300, [0, 0, 0]), (400, [])]
    rows += [(None, [3, -4]), (None, [9, 9, 9]), (500, None), (600, [1, None, 2]), (700, [5]), (700, [5, 1]), (-100, [-2, 2, 2])]
    rows += [(800, [1, 1, 2**29]), (900, [2**40, 0, 0])]  # the second is out of range
    inside = [r for r in rows if r[0] != 900]
    assert searched(spark, rows, 100) == plain(inside, lambda i: i % 100 == 0)
    assert searched(spark, rows[:3], 1, 2) == plain(rows[:3], lambda i: True, 2)
    assert searched(spark, [(5, [1, 2])], 1) == [] and searched(spark, rows[:1] * 2, 1) == [(0, 1, 0, 25)] * 2
    assert mtree.Tree(spark.createDataFrame([], "vec_id long, vec array<long>")).search(
        spark.createDataFrame([(1, [1])], "vec_id long, vec array<long>")
    ).count() == 0


def test_large_products_stay_exact(spark):
    random = np.random.default_rng(5)
    rows = [(i, [int(x) for x in random.integers(-(2**28), 2**28, 9)]) for i in range(200)]
    assert searched(spark, rows, 10) == plain(rows, lambda i: i % 10 == 0)


def test_awkward_table(spark, tmp_path):
    rows = [(i, [0.5, float(i)], 1, "x") for i in range(30)]
    rows += [(100, [float("nan"), 1.0], 1, "x"), (200, [float("-inf"), 1.0], 1, "x"), (300, None, 1, "x"), (400, [0.25, None], 1, "x"), (500, [1e-9, -1e-9], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, `root` string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    ints = [(i, None if v is None or None in v or not all(map(math.isfinite, v)) else [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows]
    got = queries.QUERIES["op11_exact_topk"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(ints, lambda i: i % 100 == 0)


def test_stored_bounds_spare_computations():
    random = np.random.default_rng(2)
    centres = random.normal(0, 2000, (40, 8))
    points = np.floor(centres[random.integers(0, 40, 4000)] + random.normal(0, 60, (4000, 8)))
    points *= np.sign(points[:, :1])  # more than one direction
    keys = [p.astype(np.int64).tobytes() for p in points]
    space = mtree.Space(8, int((points * points).sum(1).max()))
    vectors = space.matrix(keys)
    root = vectors[:1]
    to_root = space.apart(vectors, root)[:, 0]
    pages = mtree.grow(space, vectors, [[i] for i in range(len(keys))], to_root)
    assert max(len(p.vectors) for p in pages) <= mtree.PAGE
    computed = 0
    for q in vectors[::200]:
        distance = float(space.distance((q * q).sum(), root[0] @ q))
        found = mtree.best_first(space, pages, q, 11, distance, None)
        assert [-b[0] for b in found.best] == sorted((vectors @ q).astype(int).tolist(), reverse=True)[:11]
        computed += found.computed
    assert computed < 0.6 * 20 * len(vectors)
