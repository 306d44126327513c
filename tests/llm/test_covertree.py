"""Near duplicates by cover trees against brute force, in one block and in many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import covertree


def brute(rows, cosine):
    """id -> (links, component) of (id, label, vector) with distinct ids."""
    links = {i: set() for i, *_ in rows}
    for i, l, v in rows:
        for j, m, w in rows:
            if i < j and l is not None and l == m and v is not None and w is not None and len(v) == len(w) and all(
                x and all(c is not None and math.isfinite(c) for c in x) and any(x) for x in (v, w)
            ):
                a, b = (np.array(x, float) / max(map(abs, x)) for x in (v, w))
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def told(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def clustered(n, dims, clusters, spread, seed, labels=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dims))
    return [(i, int(rng.integers(0, labels)), [float(c) for c in x[i].astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("n, dims, clusters, spread", [(1, 3, 1, 1.0), (300, 8, 25, 0.2), (300, 16, 300, 1.0), (400, 32, 4, 0.25), (300, 2, 5, 0.5), (300, 64, 1, 0.1)])
def test_trees_against_brute_force(n, dims, clusters, spread):
    x = np.array([v for *_, v in clustered(n, dims, clusters, spread, n + dims)])
    copies = np.random.default_rng(0).integers(1, 4, n)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for cosine in (0.93, 0.3, 0.999):
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        got, first = covertree.linked(covertree.Tree(x), None, cosine, copies, None)
        assert (got == (near * copies).sum(axis=1)).all()
        label = np.arange(n)
        for _ in range(n):
            label = np.minimum(label, np.where(near, label, n).min(axis=1))
        assert (label == first).all()
        half = n // 2
        if half:
            got, _ = covertree.linked(covertree.Tree(x[:half]), covertree.Tree(x[half:]), cosine, copies[:half], copies[half:])
            across = near[:half, half:]
            assert (got == np.concatenate([(across * copies[half:]).sum(axis=1), (across.T * copies[:half]).sum(axis=1)])).all()


def test_levels_are_nested_and_cover(spark):
    x = np.array([v for *_, v in clustered(500, 12, 20, 0.3, 5)])
    tree = covertree.Tree(x)
    for number in range(covertree.LEVELS):
        nodes = np.flatnonzero(tree.level <= number)
        apart = np.linalg.norm(tree.unit[nodes, None] - tree.unit[None, nodes], axis=2)
        np.fill_diagonal(apart, 9)
        assert apart.min(initial=9) > 2 / 2**number - 1e-6
        assert np.linalg.norm(tree.unit[:, None] - tree.unit[None, nodes], axis=2).min(axis=1).max() <= 2 / 2**number + 1e-6
        assert set(tree.kin[number]) <= set(nodes)


def test_most_pairs_are_never_compared():
    """Bounds work: of 2,000 vectors in 100 clusters few pairs reach the points."""
    tree = covertree.Tree(np.array([v for *_, v in clustered(2000, 32, 100, 0.05, 8)]))
    looked = []
    covertree.traverse(tree, tree, math.sqrt(0.14), lambda p, q, _: looked.append(len(p)), lambda p, q, _: None)
    assert sum(looked) < 2000 * 2000 / 50


@pytest.mark.parametrize("spread", [0.15, 0.5])
def test_many_blocks_lose_no_link(spark, spread):
    rows = clustered(600, 16, 30, spread, 11)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    expected = brute(rows, 0.93)
    assert told(covertree.near_duplicates(df)) == expected
    # 25 to a block, at most 4 centres: cells of several blocks, upper trees, pairs of cells left out
    assert told(covertree.near_duplicates(df, block=25, centres=4)) == expected


def test_copies_and_near_copies_of_one_vector(spark):
    """A third of all rows are one vector and another third close to it; counts are whole."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, 0, [float(c) for c in (base if i % 3 == 0 else base + 0.02 * rng.normal(size=16) if i % 3 == 1 else rng.normal(size=16)).astype(np.float32)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert told(covertree.near_duplicates(df, block=20, centres=3)) == brute(rows, 0.93)


def test_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 1, [1.0, 0.0]), (4, 2, [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, None, [1.0, 0.0]),
        (7, 1, None), (8, 1, []), (9, 1, [0.0, 0.0]), (10, 1, [nan, 1.0]), (11, 1, [inf, 1.0]), (12, 1, [None, 1.0]), (13, 1, [1.0, 0.0, 0.0]),
        (14, 1, [1e300, 1e299]), (15, 1, [1e-300, 1e-301]), (16, 1, [-1.0, 0.0]), (17, 1, [0.93, math.sqrt(1 - 0.93**2)]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("fp", "n", "grp", "cell", "root", "size", "vector")})
    done = covertree.near_duplicates(df)
    assert told(done) == brute(rows, 0.93)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in done.collect())
    assert done.filter("vec_id = 14").first()["component_id"] == 1
    nameless = spark.createDataFrame([(None, 1, [1.0]), (3, 1, [1.0]), (3, 1, [1.0]), (5, 1, [2.0])], "vec_id long, label int, embedding array<double>")
    assert sorted(map(str, covertree.near_duplicates(nameless).collect())) == sorted([
        "Row(vec_id=None, n_links=0, component_id=None, kept=False)", *["Row(vec_id=3, n_links=1, component_id=3, kept=True)"] * 2,
        "Row(vec_id=5, n_links=1, component_id=3, kept=False)",
    ])
    assert covertree.near_duplicates(df.filter("false")).collect() == []
