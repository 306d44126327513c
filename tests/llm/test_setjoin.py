import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import HARD, empty, hard
from tidewatch.llm import setjoin
from tidewatch.session import DROP_SHUFFLES, scratch_dir, step


def shingles(text, size):
    w = re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    w = [x for x in w if x]
    return {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute(docs, size, percent):
    """(doc_id, set size, class) of each row; rows are nodes of their own."""
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                common = len(a & sets[j])
                if 100 * common >= percent * (len(a) + len(sets[j]) - common):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(docs)):
        members.setdefault(find(i), []).append(docs[i][0])
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return Counter((d, len(sets[i]), least[find(i)] if least[find(i)] is not None else d) for i, (d, _) in enumerate(docs))


def made(seed, groups):
    """Groups of chained copies with more and more words changed, around the border of linking."""
    rng = random.Random(seed)
    out, doc = [], 0
    for _ in range(groups):
        text = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 5, 9, 14, 30, 80, 200]))]
        for _ in range(rng.randint(1, 7)):
            out.append((doc, " ".join(text)))
            doc += 1
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = f"v{rng.randint(0, 300)}"
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_classes_equal_brute_force(spark, size, percent, seed):
    docs = made(seed, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in setjoin.linked_classes(df, shingle=size, percent=percent).collect())
    assert got == brute(docs, size, percent)


def test_linked_sets_share_a_block():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n, percent = int(rng.integers(1, 400)), int(rng.choice([70, 80, 85, 95]))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        apart = setjoin.most_apart(2 * len(a), 0, percent)
        gone = int(rng.integers(0, apart + 1))
        fresh = rng.integers(0, 2**63, int(rng.integers(0, apart - gone + 1))).astype(np.uint64)
        b = np.unique(np.concatenate([a[gone:] if rng.random() < 0.5 else rng.permutation(a)[gone:], fresh]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
            assert len(np.intersect1d(setjoin.block_keys(a, percent), setjoin.block_keys(b, percent)))


@pytest.mark.parametrize("percent", [70, 75, 80, 85, 95])
def test_few_sets_need_another_seed(percent):
    rng = np.random.default_rng(6)
    for n in (64, 130, 257, 1025, 4100):  # the low end of their bands
        blocks = sum(b for _, b, _ in setjoin.bands(n, percent))
        keys = [len(setjoin.block_keys(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), percent)) for _ in range(20)]
        assert np.mean(keys) < 1.8 * blocks


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, 300).astype(np.uint64) << np.uint64(30)) for _ in range(2))
        for words in (8, 1):
            x, y = (setjoin.folded(setjoin.parity(s), words) for s in (a, b))
            assert sum(bin(int(w) & (1 << 64) - 1).count("1") for w in x ^ y) <= len(np.setxor1d(a, b))
    big = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    assert len(setjoin.parity(big)) == 512 and np.array_equal(setjoin.folded(setjoin.parity(big), 64), setjoin.folded(setjoin.folded(setjoin.parity(big), 128), 64))


def test_hard_cases(spark):
    got = Counter(tuple(r) for r in setjoin.linked_classes(hard(spark)).collect())
    assert got == brute([(i, t) for i, t, _ in HARD], 4, 85)
    assert setjoin.linked_classes(empty(spark)).count() == 0


def test_a_block_of_one_shingle_hardly_ever_meets_another_by_chance():
    rng = np.random.default_rng(5)
    keys = [setjoin.block_keys(np.unique(rng.integers(0, 1 << 64, 24, dtype=np.uint64)), 85) for _ in range(20_000)]
    every = np.concatenate(keys)
    assert len(np.unique(every)) == len(every)


def stored(spark):
    """Names of the tables in the scratch folder."""
    folder = scratch_dir(spark).removeprefix("file:")
    return Counter(d.rsplit("-", 5)[0] for d in os.listdir(folder)) if os.path.isdir(folder) else Counter()


def test_tables_of_the_steps_go(spark):
    df = spark.createDataFrame(made(3, 30), "doc_id long, text string")
    before = stored(spark)
    out = setjoin.linked_classes(df)
    assert set(stored(spark) - before) == {"members", "classes", "labels"}
    assert Counter(map(tuple, out.collect())) == brute(made(3, 30), setjoin.SHINGLE, setjoin.PERCENT)


def test_shuffle_files_of_a_step_go(spark):
    kept = spark.conf.get(DROP_SHUFFLES)
    folders = [str(b) for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def files():
        return {f for top in folders for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before = files()
    step(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids")), "few")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(DROP_SHUFFLES) == kept


def test_long_sets_apart_are_told_by_their_sketch(spark, monkeypatch):
    """Sets that share words of a block, but are far apart, are not read again."""
    rng = random.Random(6)
    common = " ".join(f"c{i}" for i in range(3000))
    docs = [(i, common + " " + " ".join(f"w{rng.randint(0, 1 << 40)}" for _ in range(4000))) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked, verified = [], setjoin._verified
    monkeypatch.setattr(setjoin, "_verified", lambda pairs, *a: (asked.append(pairs.count()), verified(pairs, *a))[1])
    assert Counter(map(tuple, setjoin.linked_classes(df, shingle=5, percent=80).collect())) == brute(docs, 5, 80)
    assert sum(asked) == 0
