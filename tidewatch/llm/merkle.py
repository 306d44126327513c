"""Merkle manifest of a table: a hash tree per part, and one over the parts' roots.

Every row becomes a leaf, a hash of its fields. The leaves of a part, in order, are joined
FANOUT at a time to nodes of the next level (the last run may be shorter, even one node) until one
is left, the part's root; these, ordered by part, are joined the same way to the root.

Levels are built by a slot pivot. A node's number divided by FANOUT is its parent, the remainder its
slot, and conditional aggregates spread a parent's children into FANOUT columns. All columns
concatenated give the parent's hash; the columns before and after a child's own are its
siblings. Proofs are made from the root down: a family takes over what its parent has
already, adds a step for each child and passes it on, so a step is stored once for all
rows below it and the work of all levels together is about that of the last one.

Numbers in a part come from a range partitioning by part and order: a row's number is its place in
its partition plus what earlier partitions hold of the part. So a part of any size is spread over many tasks,
and no key of any level has more than FANOUT rows.

Digests enter a hash as lowercase hex text; a proof is an array of (left, right), the digests
before and after the node at each level, as bytes, leaf first.

Defined results: a null field hashes as ``-``, an empty one as ``0:``; null parts come first and are
not the part ''; rows of a part with equal order are ordered by leaf, and rows equal in that too are
leaves of their own, whose proofs go to them in any order; null order values come first; extra
columns are ignored; an empty table has no rows and no root. A very long text is hashed whole by the
task that reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.plans.registry import query
from tidewatch.session import materialise, table

#: Children of a node.
FANOUT = 3

STEP = "struct<left: binary, right: binary>"


def field(value: Column) -> Column:
    """A field as a leaf takes it: ``-`` if null, else the number of its UTF-8 bytes, ``:`` and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def text_of(digest: Column) -> Column:
    """A digest, or several one after the other, as a hash takes it."""
    return F.lower(F.hex(digest))


def folded(digest: Column, path: Column) -> Column:
    """Hex text of the root that a leaf's digest and its proof lead to."""
    return F.aggregate(path, text_of(digest), lambda h, step: F.sha2(F.concat(text_of(step["left"]), h, text_of(step["right"])), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a proof, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(text_of(step["left"]), text_of(step["right"]))), ""), 256)


def numbered(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the row's number in its part by ``order``, and ``left``, the rows of the part.

    ``rows`` is read more than once and should be a written table.
    """
    # rows equal in all else may come in any order, so what spreads them is arbitrary
    spread = rows.withColumn("__nth", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [part, *order, "__nth"]]
    placed = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__nth")
    # partition number and place in it, as one number
    placed = materialise(placed.withColumn("__at", F.monotonically_increasing_id()), "placed")
    task = F.shiftright(F.col("__at"), 33)
    held = placed.groupBy(part, task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    # one row per part and partition that holds some of it
    before = Window.partitionBy(part).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        F.col(part).alias("__part"), F.col("__task").alias("__t"), "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(part)).alias("left"),
    )
    told = placed.join(starts, (F.col(part) == F.col("__part")) & (task == F.col("__t")))
    pos = F.col("__before") + F.col("__at") - F.col("__first")
    return told.select(*[F.col(f"`{c}`") for c in rows.columns], pos.alias("pos"), "left")


@dataclass(frozen=True)
class Forest:
    """Hash trees of the groups of a table.

    ``nodes``: (grp, pos, left, digest, load) of the leaves; ``families`` by level: (grp, pos, left, s0..), the parents'
    number and children; ``tops``: (grp, level, digest) of each group's last node.
    """

    nodes: DataFrame
    families: list[DataFrame]
    tops: DataFrame
    fanout: int


def grow(nodes: DataFrame, fanout: int = FANOUT) -> Forest:
    """Trees over ``nodes``: (grp, pos, left, digest, load), a written table; load goes with the leaf."""
    most = nodes.agg(F.max("left")).first()[0]
    slots = [f"s{i}" for i in range(fanout)]
    families, tops, level = [], [], nodes
    while most is not None:
        tops.append(level.filter("left = 1").select("grp", F.lit(len(families)).alias("level"), "digest"))
        if most == 1:
            break
        child = F.struct("digest", "load") if not families else F.struct("digest")
        open_ = level.filter("left > 1").select("grp", F.expr(f"pos div {fanout}").alias("up"), (F.col("pos") % fanout).alias("slot"), "left", child.alias("child"))
        pivot = [F.max(F.when(F.col("slot") == i, F.col("child"))).alias(s) for i, s in enumerate(slots)]
        family = materialise(open_.groupBy("grp", F.col("up").alias("pos")).agg(F.max("left").alias("left"), *pivot), f"families-{len(families)}")
        families.append(family)
        whole = F.concat(*[F.coalesce(text_of(F.col(f"{s}.digest")), F.lit("")) for s in slots])
        level = family.select("grp", "pos", F.expr(f"(left + {fanout - 1}) div {fanout}").alias("left"), F.unhex(F.sha2(whole, 256)).alias("digest"))
        most = -(-most // fanout)
    if not tops:
        tops = [nodes.select("grp", F.lit(0).alias("level"), "digest")]
    found = tops[0]
    for one in tops[1:]:
        found = found.unionByName(one)
    return Forest(nodes, families, materialise(found, "tops"), fanout)


def proofs(forest: Forest, above: DataFrame, carried: list[str]) -> DataFrame:
    """(digest, load, path, carried...) of every leaf.

    ``above``: (grp, level, path, carried...) of each group's last node, the steps that follow in larger trees.
    """
    slots = [f"s{i}" for i in range(forest.fanout)]

    def joined(columns: list[str]) -> Column:
        parts = [F.coalesce(F.col(f"{s}.digest"), F.lit(b"")) for s in columns]
        return F.concat(*parts) if parts else F.lit(b"")

    above = materialise(above.select("grp", "level", "path", *carried), "above")
    down = None
    for number in range(len(forest.families) - 1, -1, -1):
        parents = above.filter(F.col("level") == number + 1).select("grp", F.lit(0).cast("bigint").alias("pos"), "path", *carried)
        if down is not None:
            parents = parents.unionByName(down)
        family = forest.families[number].join(parents, ["grp", "pos"])
        children = [
            F.when(F.col(s).isNotNull(), F.struct(
                (F.col("pos") * forest.fanout + i).alias("pos"), F.col(s).alias("node"),
                F.struct(joined(slots[:i]).alias("left"), joined(slots[i + 1:]).alias("right")).alias("step"),
            ))
            for i, s in enumerate(slots)
        ]
        family = family.withColumn("child", F.explode(F.array_compact(F.array(*children))))
        path = F.concat(F.array(F.col("child.step")).cast(f"array<{STEP}>"), F.col("path")).alias("path")
        if number:
            down = family.select("grp", F.col("child.pos").alias("pos"), path, *carried)
        else:
            down = family.select(F.col("child.node.digest").alias("digest"), F.col("child.node.load").alias("load"), path, *carried)
    single = forest.nodes.filter("left = 1").join(above.filter("level = 0"), "grp").select("digest", "load", "path", *carried)
    return single if down is None else down.unionByName(single)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the kept columns, leaf, path, subroot and root of every row; ``parts``: part and its root."""

    leaves: DataFrame
    parts: DataFrame


def manifest(rows: DataFrame, part: str, order: list[str], keep: list[str], fanout: int = FANOUT) -> Manifest:
    """The manifest of ``rows``, which have their digest in the column ``leaf``."""
    load = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep])
    # a null part comes first and is not the part ''
    named = F.coalesce(F.concat(F.lit(":"), F.col(f"`{part}`").cast("string")), F.lit(""))
    sort = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]
    rows = materialise(rows.select(named.alias("grp"), *sort, F.col("leaf").alias("digest"), load.alias("load")), "leaves")
    nodes = numbered(rows, "grp", [*[f"o{i}" for i in range(len(order))], "digest"]).select("grp", "pos", "left", "digest", "load")
    trees = grow(materialise(nodes, "nodes"), fanout)

    whole = trees.tops.select(F.lit("").alias("all"), "digest", F.struct("grp", "level").alias("load"))
    whole = numbered(whole, "all", ["load"]).withColumnRenamed("all", "grp")
    crown = grow(materialise(whole.select("grp", "pos", "left", "digest", "load"), "nodes"), fanout)
    ends = crown.tops.select("grp", "level", F.expr(f"cast(array() AS array<{STEP}>)").alias("path"), F.col("digest").alias("root"))
    parts = proofs(crown, ends, ["root"]).select(F.col("load.grp").alias("grp"), F.col("load.level").alias("level"), F.col("digest").alias("subroot"), "path", "root")
    parts = materialise(parts, "parts")
    leaves = proofs(trees, parts, ["subroot", "root"]).select(
        *[F.col("load")[c].alias(c) for c in keep], F.col("digest").alias("leaf"), "path", "subroot", "root"
    )
    told = parts.select(F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias(part), "subroot", "root")
    return Manifest(leaves, told)


def verified(leaves: DataFrame, leaf_of: str) -> DataFrame:
    """Adds ``folded_root``, what the digest in ``leaf_of`` leads to, and ``verified``, whether that is the root."""
    told = leaves.withColumn("folded_root", folded(F.col(leaf_of), F.col("path")))
    return told.withColumn("verified", F.col("folded_root") == text_of(F.col("root")))


SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda p: ascii(substr(doc_id::VARCHAR, p::BIGINT, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), steps
), f AS (
  SELECT doc_id, source, text, concat(
    CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END) AS head
  FROM documents
), leaves AS (
  SELECT f.doc_id, coalesce(':' || source, '') AS grp, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN xor(c, 4294967295) % 2 = 0 THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
      ELSE strlen(text) || ':' || text END) AS tampered
  FROM f LEFT JOIN crc USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), low AS (
  SELECT 0 AS lvl, grp, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT any_value(lvl) + 1, grp, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY grp, pos // 3
), subs AS (
  SELECT grp, h AS subroot, lvl AS height, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subs
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY pos // 3
), steps_low AS (
  SELECT p.grp, p.pos, l.lvl, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < l.pos), '') AS before, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > l.pos), '') AS after
  FROM placed p JOIN low l ON l.grp = p.grp AND l.n > 1 AND l.pos = p.pos // (3 ** l.lvl)::BIGINT
  JOIN low x ON x.grp = l.grp AND x.lvl = l.lvl AND x.pos // 3 = l.pos // 3
  GROUP BY p.grp, p.pos, l.lvl, l.pos
), steps_high AS (
  SELECT s.grp, s.height + l.lvl AS lvl, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < l.pos), '') AS before, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > l.pos), '') AS after
  FROM subs s JOIN high l ON l.n > 1 AND l.pos = s.pos // (3 ** l.lvl)::BIGINT
  JOIN high x ON x.lvl = l.lvl AND x.pos // 3 = l.pos // 3
  GROUP BY s.grp, s.height, l.lvl, l.pos
), path AS (
  SELECT * FROM steps_low UNION ALL SELECT p.grp, p.pos, s.lvl, s.before, s.after FROM placed p JOIN steps_high s ON s.grp = p.grp
), proof AS (SELECT grp, pos, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof_sha256, count(*) AS steps FROM path GROUP BY grp, pos
), fold AS (
  SELECT grp, pos, 0 AS lvl, tampered AS h FROM placed
  UNION ALL
  SELECT fold.grp, fold.pos, fold.lvl + 1, sha256(path.before || fold.h || path.after) FROM fold JOIN path ON path.grp = fold.grp AND path.pos = fold.pos AND path.lvl = fold.lvl
)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subs s ON s.grp = p.grp LEFT JOIN proof q ON q.grp = p.grp AND q.pos = p.pos
JOIN fold f ON f.grp = p.grp AND f.pos = p.pos AND f.lvl = coalesce(q.steps, 0), (SELECT h FROM high WHERE n = 1) r
"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """Proof of every document by source, checked against texts that lost their line breaks where crc32 of the id is even."""
    docs = table(spark, directory, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf(*fields, F.col("text")).alias("leaf"), leaf(*fields, changed).alias("tampered"))
    leaves = verified(manifest(rows, "source", ["doc_id"], ["doc_id", "tampered"]).leaves, "tampered")
    return leaves.select(
        "doc_id", *[text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )
