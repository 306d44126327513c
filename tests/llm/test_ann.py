import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def exact(vectors, query, k):
    """(vec_id, distance) of the k nearest, ties by id; ``vectors`` by id."""
    rows = sorted((float(np.sqrt(((v - vectors[query]) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return [(i, d) for d, i in rows[:k]]


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    order = list(ann.walk(a, b))
    assert sorted(c for _, c in order) == list(range(63)) and [t for t, _ in order] == sorted(t for t, _ in order)
    assert all(abs(t - a[c // 7] - b[c % 7]) < 1e-12 for t, c in order)


def test_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    good = {i: rng.standard_normal(8).astype(np.float32) for i in range(60)}
    good |= {i: np.ones(8, dtype=np.float32) for i in range(100, 400)}
    bad = [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] + [1.0] * 7), (504, [float("inf")] + [1.0] * 7), (505, [1.0] * 7), (506, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows = [(i, v.tolist()) for i, v in good.items()]
    df = spark.createDataFrame(rows + rows[:5] + rows[100:110] + bad, SCHEMA).withColumns({"cell": F.lit("clash"), "reach": F.lit("clash")}).repartition(7)
    usable = ann.usable(df)
    queries = usable.filter("vec_id % 100 = 0 or vec_id = 55")
    got = {}
    for r in ann.search(usable, queries).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    vectors = {i: v.astype(float) for i, v in good.items()}
    assert set(got) == {0, 55, 100, 200, 300}
    for q, found in got.items():
        expected = exact(vectors, q, 10)
        assert [found[i][0] for i in range(1, 11)] == [i for i, _ in expected]
        assert np.allclose([found[i][1] for i in range(1, 11)], [d for _, d in expected], rtol=1e-12)


def test_few_and_no_vectors(spark):
    few = ann.usable(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [4.0, 3.0])], SCHEMA))
    assert [(r.vec_id, r["rank"]) for r in ann.search(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none = ann.usable(spark.createDataFrame([], SCHEMA))
    assert ann.search(none, none).collect() == []


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}
    got = {}
    for r in ann.op4_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries = [i for i in vectors if i % 100 == 0]
    hits = sum(len(got[q] & {i for i, _ in exact(vectors, q, 10)}) for q in queries)
    assert hits / (10 * len(queries)) >= 0.9


def test_recall_beyond_the_first_round(spark, monkeypatch):
    """More vectors than a first round reads: plain ones and clustered ones, against brute force, and how many cells are visited."""
    rng = np.random.default_rng(4)
    n, dims = 5000, 24
    monkeypatch.setattr(ann, "FIRST", 300)
    centres = rng.normal(size=(80, dims))
    for name, x in (("plain", rng.normal(size=(n, dims))), ("clustered", centres[rng.integers(0, 80, n)] + 0.1 * rng.normal(size=(n, dims)))):
        x = x.astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
        rows = ann.usable(df)
        got = {}
        for r in ann.search(rows, rows.filter("vec_id % 100 = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q, found in got.items():
            near = np.argsort(np.square(x.astype(float) - x[q]).sum(axis=1), kind="stable")
            hits += len(found & set(near[near != q][:10].tolist()))
        assert len(got) == 50 and hits / 500 >= 0.9, name
        books = ann.codebooks(rows)
        a, b = (np.square(x[:, None, part] - book[None]).sum(axis=2) for part, book in ((slice(0, dims // 2), books[0]), (slice(dims // 2, dims), books[1])))
        cells = a.argmin(axis=1) * len(books[1]) + b.argmin(axis=1)
        sizes = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
        visited = [sizes[ann.visits(sizes, np.zeros(len(sizes)), a[q], b[q], dims, None)].sum() for q in range(0, n, 100)]
        assert max(visited) < n / 4  # the first round is a part of the table


def test_cells_of_a_query_go_as_masks_of_patches():
    patches, masks = ann._patches([17, 3, 16, 0, 800])
    assert dict(zip(patches.tolist(), masks.tolist(), strict=True)) == {0: 0b1001, 2: 0b11, 100: 1}
    assert [len(x) for x in ann._patches([])] == [0, 0]


def test_a_query_is_sent_less_often_than_it_has_cells(spark, monkeypatch):
    """Rows that carry a query's vector: at most one for a patch."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    sent = []
    pack = ann._meet

    def meet(index, cells, k):
        sent.append((cells.count(), cells.select("query_id", "patch").distinct().count(), cells.selectExpr("sum(bit_count(cells))").first()[0]))
        return pack(index, cells, k)

    monkeypatch.setattr(ann, "_meet", meet)
    rows = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4))
    ann.search(rows, rows.filter("vec_id % 300 = 0")).collect()
    assert len(sent) == 2 and all(a == b < c for a, b, c in sent)
