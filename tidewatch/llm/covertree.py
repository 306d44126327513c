"""Exact near duplicates among embeddings by a dual traversal of cover trees.

Two vectors of one label link when their cosine is at least a threshold, that is when the
points of their directions on the unit sphere are at most ``reach`` apart. A cover tree holds such points in
nested levels: the nodes of level l are more than 2 / 2**l apart from those they were compared with,
every node is a node of all later levels too, and each point is within the radius of a node of every
level. A dual traversal takes pairs of nodes, the roots first. With the covering radii measured in the tree,

* a pair further apart than reach and both radii holds no link and is dropped;
* a pair whose points are all within reach of each other is counted whole, without looking at them;
* any other pair is replaced by the pairs of its nodes' children; points are compared at the end.

On the cluster the points of a label come in blocks. A label of more than BLOCK vectors gets
an upper tree over about one sampled vector for each block it needs (at most CENTRES); every vector goes to
the cell of its nearest one, and the same traversal over these trees, with the radii measured
over all vectors, leaves the pairs of cells that may hold links. A cell too large for a block is split.
Each block has its own tree, built once, and each pair of blocks left is one group of a cogrouped
task. A task returns, for every vector, the number of its links and one edge to a representative of those it
reaches there: as many rows as vectors, however many links they have.

Equal vectors of a label are one point with a count. Nothing is sampled but the upper centres, which only
decide what is compared with what first: all links are found, and none below the threshold.
Where vectors have no structure at all the bounds drop no pair of cells, and the work grows with the square of
a label's vectors, as it must for an exact result; clustered ones need a small part of that.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label, link with nothing and are classes of their own; vectors of different lengths do not link; a row
without an id links with nothing, has no class and is not kept; rows repeated with the same id and vector are one vector and
get the same result each; ties in cosine with the threshold link; extra columns are ignored; an
empty table gives an empty table. Equality of vectors rests on a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.setjoin import components
from tidewatch.operators import skew
from tidewatch.plans.registry import query
from tidewatch.session import materialise, table

#: Least cosine of a link in the registered query.
COSINE = 0.93
#: Most vectors and numbers of a block, and most centres of an upper tree.
BLOCK, NUMBERS, CENTRES = 8192, 1 << 22, 256
#: Levels of a tree: radii 2, 1, 1/2 and so on; below the last all points are leaves.
LEVELS = 7
#: Distances are taken to be off by no more than MARGIN; a cosine this close to the threshold is
#: taken again from the vectors themselves; points looked at in one step of a build; pairs in one step.
MARGIN, ROUNDING, STEP, PAIRS = 1e-6, 1e-9, 256, 1 << 18


class Tree:
    """A cover tree over the rows of ``vectors``: ``level`` a row first is a node of, and its ``parent`` above that.

    ``far[l]`` has the covering radius of each node of level l, ``kin[l]`` the node of level l above each row.
    """

    def __init__(self, vectors: np.ndarray, level: np.ndarray | None = None, parent: np.ndarray | None = None):
        exponent = np.frexp(np.abs(vectors).max(axis=1))[1]
        self.raw = np.ldexp(vectors.astype(np.float64), -exponent[:, None])
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw))
        self.unit = self.raw / self.norm[:, None]
        self.level, self.parent = _plant(self.unit) if level is None else (level, parent)
        self.far, self.kin = np.zeros((LEVELS + 1, len(vectors))), [np.arange(len(vectors))]
        for number in range(LEVELS - 1, -1, -1):
            above = self.kin[0]
            self.kin.insert(0, np.where(self.level[above] > number, self.parent[above], above))
            off = self.unit - self.unit[self.kin[0]]
            np.maximum.at(self.far[number], self.kin[0], np.sqrt(np.einsum("ij,ij->i", off, off)))
        self.born, self.first = [], []
        for number in range(LEVELS + 1):
            new = np.flatnonzero(self.level == number)
            new = new[np.argsort(self.parent[new], kind="stable")]
            self.born.append(new)
            self.first.append(np.searchsorted(self.parent[new], np.arange(len(vectors) + 1)))

    def children(self, node: int, number: int) -> np.ndarray:
        """Nodes of level ``number`` below a node of the level before: itself and the new ones."""
        first = self.first[number]
        return np.concatenate([[node], self.born[number][first[node]:first[node + 1]]])

    def fan(self, nodes: np.ndarray, number: int) -> np.ndarray:
        """How many ``children`` each of the nodes has."""
        return self.first[number][nodes + 1] - self.first[number][nodes] + 1

    def nth_child(self, nodes: np.ndarray, nth: np.ndarray, number: int) -> np.ndarray:
        place = np.minimum(self.first[number][nodes] + nth - 1, max(len(self.born[number]) - 1, 0))
        return np.where(nth == 0, nodes, self.born[number][place] if len(self.born[number]) else nodes)


def _plant(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels and parents: level by level, a row further than the radius from all nodes becomes one."""
    n = len(unit)
    level, near = np.full(n, LEVELS), np.zeros(n, dtype=np.int64)
    level[0] = 0
    apart = 2 - 2 * (unit @ unit[0])
    parent = near.copy()
    for number in range(1, LEVELS):
        radius = 4.0 ** (1 - number)
        rest = np.flatnonzero(level == LEVELS)
        above = near.copy()
        wide = rest[apart[rest] > radius]
        while len(wide):
            some = wide[:STEP]
            between = 2 - 2 * (unit[some] @ unit[some].T)
            chosen = []
            for i in range(len(some)):
                if not chosen or between[i, chosen].min() > radius:
                    chosen.append(i)
            new = some[chosen]
            level[new], parent[new] = number, above[new]
            distances = 2 - 2 * (unit[rest] @ unit[new].T)
            closest = distances.argmin(axis=1)
            least = distances[np.arange(len(rest)), closest]
            closer = least < apart[rest]
            near[rest[closer]], apart[rest[closer]] = new[closest[closer]], least[closer]
            wide = wide[(apart[wide] > radius) & (level[wide] == LEVELS)]
    leaves = level == LEVELS
    parent[leaves] = near[leaves]
    return level, parent


def _expand(x: Tree, y: Tree, a: np.ndarray, b: np.ndarray, number: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, nodes, cosines) of level ``number`` below the pairs, without those too far apart, in steps of about PAIRS."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    wide = y.fan(b, number)
    many = x.fan(a, number) * wide
    dense = np.add.reduceat(many, starts) > PAIRS >> 6
    ends = np.append(starts[1:], len(a))

    def least(radii: np.ndarray) -> np.ndarray:
        return 1 - np.square(reach + MARGIN + radii) / 2

    # a node with much to compare: one matrix product with the children of all its partners
    for low, high in zip(starts[dense], ends[dense], strict=True):
        p = x.children(a[low], number)
        nth = np.arange(wide[low:high].sum()) - np.repeat(np.cumsum(wide[low:high]) - wide[low:high], wide[low:high])
        q = y.nth_child(np.repeat(b[low:high], wide[low:high]), nth, number)
        for left in range(0, len(q), PAIRS):
            some = q[left:left + PAIRS]
            other, radii = y.unit[some].T, y.far[number][some]
            step = max(1, PAIRS // len(some))
            for top in range(0, len(p), step):
                mine = p[top:top + step]
                cosines = x.unit[mine] @ other
                bound = least(radii + x.far[number][mine, None]) if number < LEVELS else least(0.0)
                i, j = np.nonzero(cosines >= bound)
                yield mine[i], some[j], cosines[i, j]

    few = np.repeat(~dense, ends - starts)
    a, b, many, wide = a[few], b[few], many[few], wide[few]
    ends = np.cumsum(many)
    low = 0
    while low < len(a):
        before = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, before + PAIRS // 8, side="right")), low + 1)
        at = np.repeat(np.arange(low, high), many[low:high])
        nth = np.arange(len(at)) - np.repeat(ends[low:high] - many[low:high] - before, many[low:high])
        p, q = x.nth_child(a[at], nth // wide[at], number), y.nth_child(b[at], nth % wide[at], number)
        cosines = np.einsum("ij,ij->i", x.unit[p], y.unit[q])
        kept = cosines >= least(x.far[number][p] + y.far[number][q])
        yield p[kept], q[kept], cosines[kept]
        low = high


def traverse(
    x: Tree, y: Tree, reach: float, points: Callable[[np.ndarray, np.ndarray, np.ndarray], None],
    whole: Callable[[np.ndarray, np.ndarray, int], None] | None = None,
) -> None:
    """Calls ``points`` with pairs of rows that may be within reach (and about their cosines), ``whole`` with pairs of nodes of a level that are so entirely."""

    def descend(a: np.ndarray, b: np.ndarray, number: int) -> None:
        for p, q, cosines in _expand(x, y, a, b, number, reach):
            if number == LEVELS:
                points(p, q, cosines)
                continue
            if whole is not None:
                apart = np.sqrt(np.maximum(2 - 2 * cosines, 0))
                inside = apart + x.far[number][p] + y.far[number][q] + MARGIN <= reach
                whole(p[inside], q[inside], number)
                p, q = p[~inside], q[~inside]
            if len(p):
                descend(p, q, number + 1)

    root = np.zeros(1, dtype=np.int64)
    descend(root, root, 1)


class _Sets:
    """Disjoint sets of numbers; the smallest represents its set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            top = self.up[x]
            if np.array_equal(top, self.up[top]):
                return top
            self.up = self.up[self.up]

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p, q = self.find(a), self.find(b)
            apart = p != q
            if not apart.any():
                return
            a, b = p[apart], q[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def linked(x: Tree, y: Tree | None, cosine: float, copies: np.ndarray, others: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row (those of ``x``, then of ``y``) and the row that represents all it reaches.

    Without ``y`` the rows of ``x`` are compared with each other. ``copies`` and ``others`` weigh the rows of each.
    """
    alone = y is None
    y, others = (x, copies) if alone else (y, others)
    n, shift = len(x.level), 0 if alone else len(x.level)
    sets = _Sets(n if alone else n + len(y.level))
    direct = [np.zeros(len(t.level), dtype=np.int64) for t in (x, y)]
    # what a node's pair adds to all rows below it, and nodes whose rows are of one set
    added = [np.zeros((LEVELS + 1, len(t.level)), dtype=np.int64) for t in (x, y)]
    glued = [np.zeros((LEVELS + 1, len(t.level)), dtype=bool) for t in (x, y)]
    weights = [[np.bincount(t.kin[number], w, len(t.level)).astype(np.int64) for number in range(LEVELS + 1)] for t, w in ((x, copies), (y, others))]

    def points(p: np.ndarray, q: np.ndarray, cosines: np.ndarray) -> None:
        hit = cosines >= cosine
        close = np.flatnonzero(np.abs(cosines - cosine) < ROUNDING)
        hit[close] = np.einsum("ij,ij->i", x.raw[p[close]], y.raw[q[close]]) / (x.norm[p[close]] * y.norm[q[close]]) >= cosine
        if alone:
            hit |= p == q
        p, q = p[hit], q[hit]
        direct[0] += np.bincount(p, others[q], n).astype(np.int64)
        if not alone:
            direct[1] += np.bincount(q, copies[p], len(others)).astype(np.int64)
        sets.unite(p, q + shift)

    def whole(p: np.ndarray, q: np.ndarray, number: int) -> None:
        np.add.at(added[0][number], p, weights[1][number][q])
        glued[0][number][p] = True
        (glued[0] if alone else glued[1])[number][q] = True
        if not alone:
            np.add.at(added[1][number], q, weights[0][number][p])
        sets.unite(p, q + shift)

    traverse(x, y, math.sqrt(max(2 - 2 * cosine, 0.0)), points, whole)
    totals = []
    for i, t in enumerate((x,) if alone else (x, y)):
        total = direct[i]
        for number in range(LEVELS + 1):
            above = t.kin[number]
            total = total + added[i][number][above]
            below = np.flatnonzero(glued[i][number][above])
            sets.unite(below + i * shift, above[below] + i * shift)
        totals.append(total)
    # a row was paired with itself once
    return (totals[0] - copies if alone else np.concatenate(totals)), sets.find(np.arange(len(sets.up)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([np.zeros(0), *[np.asarray(c.flatten()) for c in column.chunks]])
    return flat.reshape(len(column), -1)


def _row(schema: pa.Schema, *columns) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _upper(group: pa.Table) -> pa.Table:
    """The packed tree over a label's centres, those with the smallest marks of its sample."""
    group = group.take(pa.array(np.lexsort((np.asarray(group["fp"]), np.asarray(group["mark"])))[:group["cells"][0].as_py()]))
    tree = Tree(_matrix(group["vector"]))
    schema = pa.schema([("grp", pa.string()), *[(c, pa.binary()) for c in ("vectors", "levels", "parents")]])
    return _row(schema, [group["grp"][0].as_py()], [_matrix(group["vector"]).tobytes()], [tree.level.tobytes()], [tree.parent.tobytes()])


def _unpack(row: dict) -> Tree:
    level = np.frombuffer(row["levels"], np.int64)
    return Tree(np.frombuffer(row["vectors"], np.float64).reshape(len(level), -1), level, np.frombuffer(row["parents"], np.int64))


def _deal(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """Adds to a chunk of a label's rows the cell, and the distances to the nodes above it level by level."""
    cells, far = np.zeros(len(rows), dtype=np.int64), np.zeros((len(rows), LEVELS + 1))
    if len(centres) and len(rows):
        upper = _unpack(centres.to_pylist()[0])
        unit = Tree(_matrix(rows["vector"]), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)).unit
        for low in range(0, len(unit), PAIRS // CENTRES):
            cells[low:low + PAIRS // CENTRES] = (unit[low:low + PAIRS // CENTRES] @ upper.unit.T).argmax(axis=1)
        for number in range(LEVELS + 1):
            off = unit - upper.unit[upper.kin[number][cells]]
            far[:, number] = np.sqrt(np.einsum("ij,ij->i", off, off))
    out = rows.select(["grp", "fp", "n", "vector"])
    return out.append_column("cell", pa.array(cells)).append_column("far", pa.array(list(far), pa.list_(pa.float64())))


def _meeting_cells(reach: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs of a label's cells that may hold links, from the cells' radii and the upper tree."""
    schema = pa.schema([("grp", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def run(cells: pa.Table, centres: pa.Table) -> pa.Table:
        if not len(cells):
            return _row(schema, [], [], [])
        grp, at = cells["grp"][0].as_py(), np.asarray(cells["cell"])
        if not len(centres):
            return _row(schema, [grp], [0], [0])
        upper = _unpack(centres.to_pylist()[0])
        upper.far[:] = 0
        measured = np.array(cells["far"].to_pylist())
        for number in range(LEVELS + 1):
            np.maximum.at(upper.far[number], upper.kin[number][at], measured[:, number])
        held = np.zeros(len(upper.level), dtype=bool)
        held[at] = True
        found = []
        traverse(upper, upper, reach, lambda p, q, _: found.append(np.stack([p, q])[:, (p <= q) & held[p] & held[q]]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return _row(schema, [grp] * len(a), a, b)

    return run


def _planted(block: pa.Table) -> pa.Table:
    """A block's rows with their place in its tree."""
    block = block.take(pa.array(np.argsort(np.asarray(block["fp"]), kind="stable")))
    tree = Tree(_matrix(block["vector"]))
    out = block.select(["grp", "cell", "part", "fp", "n", "vector"])
    for name, values in (("at", np.arange(len(block))), ("level", tree.level), ("parent", tree.parent)):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out


def _compared(cosine: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links and a representative of every row of two blocks, or of one (the second is empty then)."""
    schema = pa.schema([("fp", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def loaded(block: pa.Table) -> tuple[Tree, np.ndarray, np.ndarray]:
        block = block.take(pa.array(np.argsort(np.asarray(block["at"]))))
        tree = Tree(_matrix(block["vector"]), np.asarray(block["level"]), np.asarray(block["parent"]))
        return tree, np.asarray(block["n"]), np.asarray(block["fp"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, copies, names = loaded(left)
        y, others = None, None
        if len(right):
            y, others, more = loaded(right)
            names = np.concatenate([names, more])
        links, first = linked(x, y, cosine, copies, others)
        kept = links > 0
        return _row(schema, names[kept], links[kept], names[first[kept]])

    return run


def links(points: DataFrame, cosine: float = COSINE, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """(fp, links, other) of every point and block pair it has links in.

    ``points``: (grp, fp, n, vector), a written table of distinct vectors by group, with their
    number of copies; vectors of a group have one length. Links are counted with the copies of the other
    point; ``other`` is a point reachable over links.
    """
    reach = math.sqrt(max(2 - 2 * cosine, 0.0))
    kind = points.schema["vector"].dataType.simpleString()
    room = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(NUMBERS) / F.max(F.size("vector"))))).cast("bigint").alias("room")
    sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), room)
    sizes = materialise(sizes.withColumn("blocks", F.expr("(size + room - 1) div room")), "sizes")
    sized = materialise(skew.attach(points, sizes.withColumn("of", F.col("size")), ["grp"], "size", ["of", "blocks"], ["fp"]), "points")

    # about four times as many vectors as centres, by hash, from which each large group takes its centres
    mark = F.pmod(F.xxhash64("fp", F.lit("centre")), F.lit(1 << 31))
    wanted = F.least(F.col("blocks"), F.lit(centres))
    large = sized.filter("blocks > 1").withColumns({"mark": mark, "cells": wanted.cast("bigint")})
    sample = large.filter(F.col("mark") * F.col("of") < (F.col("cells") * 4 + 16) * F.lit(1 << 31))
    sample = sample.select("grp", "fp", "mark", "cells", F.col("vector").cast("array<double>").alias("vector"))
    upper = sample.groupBy("grp").applyInArrow(_upper, "grp string, vectors binary, levels binary, parents binary")
    upper = materialise(upper, "upper")

    chunks = large.withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit("chunk")), "blocks"))
    trees = upper.join(sizes, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    keys = ["grp", "chunk"]
    dealt = chunks.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(
        _deal, f"grp string, fp long, n long, vector {kind}, cell long, far array<double>"
    )
    nothing = F.array(*[F.lit(0.0)] * (LEVELS + 1)).alias("far")
    small = sized.filter("blocks = 1").select("grp", "fp", "n", "vector", F.lit(0).cast("bigint").alias("cell"), nothing)
    dealt = materialise(dealt.unionByName(small), "dealt")

    far = F.array(*[F.max(F.get("far", F.lit(i))) for i in range(LEVELS + 1)]).alias("far")
    cells = dealt.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("size"), far).join(sizes.select("grp", "room"), "grp")
    cells = materialise(cells.withColumn("parts", F.expr("(size + room - 1) div room")), "cells")
    parted = skew.attach(dealt.drop("far"), cells, ["grp", "cell"], "size", ["parts"], ["fp"])
    parted = parted.withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), "parts"))
    tall = f"grp string, cell long, part long, fp long, n long, vector {kind}, at long, level long, parent long"
    blocks = materialise(parted.select("grp", "cell", "part", "fp", "n", "vector").groupBy("grp", "cell", "part").applyInArrow(_planted, tall), "blocks")

    met = cells.select("grp", "cell", "far").groupBy("grp").cogroup(upper.groupBy("grp")).applyInArrow(_meeting_cells(reach), "grp string, a long, b long")
    for end in "ab":
        parts = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
        met = met.join(cells.select("grp", F.col("cell").alias(end), parts.alias(f"parts_{end}")), ["grp", end])
    met = met.select("grp", "a", "b", "parts_b", F.explode("parts_a").alias("of_a")).select("grp", "a", "of_a", "b", F.explode("parts_b").alias("of_b"))
    met = materialise(met.filter("a < b OR of_a <= of_b"), "meetings")

    pair = ["grp", "a", "of_a", "b", "of_b"]
    sides = []
    for end, some in (("a", met), ("b", met.filter("a <> b OR of_a <> of_b"))):
        told = some.withColumns({"cell": F.col(end), "part": F.col(f"of_{end}")})
        rows = blocks.join(told, ["grp", "cell", "part"])
        # under new attributes: both sides come from the same table
        sides.append(rows.select(*[F.col(c).alias(c) for c in (*pair, "fp", "n", "vector", "at", "level", "parent")]))
    done = sides[0].groupBy(*pair).cogroup(sides[1].groupBy(*pair)).applyInArrow(_compared(cosine), "fp long, links long, other long")
    return materialise(done, "links")


def near_duplicates(
    df: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, centres: int = CENTRES,
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id (smallest id reachable), kept."""
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    if rows.schema["vector"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    plain = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(plain, F.lit(False))
    named = rows.filter(usable).select("vec_id", F.concat_ws(":", F.size("vector"), F.col("label").cast("string")).alias("grp"), "vector")
    named = named.withColumn("fp", F.xxhash64("grp", "vector"))

    points = named.groupBy("fp").agg(F.first("grp").alias("grp"), F.first("vector").alias("vector"))
    ids = materialise(named.select("fp", "vec_id"), "ids")
    copies = ids.distinct().groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
    points = materialise(points.join(copies, "fp"), "distinct")
    found = links(points.select("grp", "fp", "n", "vector"), cosine, block, centres)

    reached = components(found.filter("fp <> other").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    totals = found.groupBy("fp").agg(F.sum("links").alias("links"))
    told = points.select("fp", "n", "low").join(totals, "fp", "left").join(reached.withColumnRenamed("v", "fp"), "fp", "left")
    told = told.select("fp", "n", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "fp").alias("root"))
    told = materialise(told, "classes")
    # a class may hold a good part of all points, and a point a good part of all rows
    heads = told.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("low").alias("component_id"))
    told = skew.attach(told, heads, ["root"], "size", ["component_id"], ["fp"])
    done = skew.attach(ids, materialise(told, "told"), ["fp"], "n", ["n_links", "component_id"], ["vec_id"])
    rest = rows.filter(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = done.select("vec_id", "n_links", "component_id").unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT DISTINCT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT x AS v, x AS r FROM links UNION SELECT links.y, reach.r FROM reach JOIN links ON links.x = reach.v
), heads AS (SELECT v, min(r) AS r FROM reach GROUP BY v
), n AS (SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(r, vec_id) AS component_id, coalesce(coalesce(r, vec_id) = vec_id, false) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN heads ON heads.v = vec_id
"""


@query("op13_embedding_near_dedup", SQL)
def op13_embedding_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Links and class of every vector among those of its label."""
    return near_duplicates(table(spark, directory, "embeddings"))
