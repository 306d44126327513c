"""Filter interaction audit: what every filter does at every place of every order, and its Shapley share.

Each document fails a set of filters, its mask. Counts of documents by part and mask are all the
audit needs: the value of a coalition of filters is the number of documents it removes, those whose
mask meets it. In the removal game the potential of a coalition S is defined by recursion,

    P(empty) = 0,   P(S) = (value(S) + sum of P(S without i) over i in S) / |S|

and a filter's Shapley share is P(all) - P(all without it). Kept whole here are |S|! * P(S), which
are integers, so |all|! times the share, the sum over all orders, is exact. A filter that comes after
the filters of S removes value(S with it) - value(S): the steps of all orders are read off the same
coalition values.

Texts are read once; what is kept of a document is its id, part, mask and a digest of its text.
"Identical to a smaller id's text" is decided by the smallest id of each text, a mergeable
aggregate, and a join on text and id together, so however many copies a text has they stay spread out.

Defined results: a null text is an empty text, which is a text like any other (empty ones are
identical); a null part is the part ''; a document without an id is identical to no smaller
one, makes no other a copy and has no label; repeated rows count as often as they come and do not make each
other copies (their ids are equal); several labels of an id count as the most severe of each kind;
a part without a failing document has its rows of zeros; extra columns are ignored; an empty table
gives an empty table. Very long texts are one row of one task, as everywhere in Spark.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.registry import query
from tidewatch.session import materialise, table

#: Fails a filter whose text is identical to the text of a smaller id.
REPEATS = "repeats"


def words(text: Column) -> Column:
    """Maximal runs of characters other than the space and \\x09-\\x0D."""
    return F.array_remove(F.split(text, r"[\x09-\x0D ]+"), "")


def standard_filters(text: str = "text", words_of: str = "words") -> dict[str, Column | str]:
    """The failure conditions by filter letter, over a text that is not null and the column of its words."""
    body = F.col(text)
    n = F.size(words_of)
    capitals = F.regexp_count(body, F.lit("[A-Z]"))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words_of)) < 65 * n,
        "C": 100 * capitals > 5 * F.char_length(body),
        "D": body.rlike("[#$%&*|]"),
        "E": REPEATS,
    }


def failures(docs: DataFrame, filters: dict[str, Column | str], doc_id: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, part, mask) of every row; bit i of the mask is set where filter i fails.

    The conditions are over the columns ``text`` and ``words``.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", words(F.col("text")))
    plain = [F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(filters.values()) if condition is not REPEATS]
    repeat_bits = sum(1 << i for i, condition in enumerate(filters.values()) if condition is REPEATS)
    mask = reduce(lambda a, b: a.bitwiseOR(b), plain, F.lit(0))
    found = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    if not repeat_bits:
        return found.drop("digest")
    found = materialise(found, "failures")
    known = found.filter("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # the key holds the id too, so the rows of a frequent text do not meet in one task
    told = known.join(first, ["digest", "doc_id"], "left")
    told = told.withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(repeat_bits))))
    columns = ["doc_id", "part", "mask"]
    return told.select(columns).unionByName(found.filter("doc_id is null").select(columns))


def counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and those of them with quality 1 and toxic 1."""
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    # rows without an id have no label and stay out of the join, where they would share a key
    known = masks.filter("doc_id is not null").join(told, "doc_id", "left")
    known = known.select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    nameless = masks.filter("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    both = known.unionByName(nameless)
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def coalitions(counted: DataFrame, players: int) -> DataFrame:
    """One row per part: total, and by coalition (as a bit set) how many are removed, good and toxic among them.

    ``removed``, ``good`` and ``toxic`` are arrays of 2 ** players values; ``alone`` counts by exact mask.
    """
    subsets = range(1 << players)
    totals = [
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0)) for s in subsets]).alias(name)
        for c, name in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))
    ]
    alone = F.array(*[F.sum(F.when(F.col("mask") == s, F.col("n")).otherwise(0)) for s in subsets]).alias("alone")
    return counted.groupBy("part").agg(F.sum("n").alias("total"), alone, *totals)


def potentials(valued: DataFrame, players: int, value: str = "removed") -> DataFrame:
    """Adds ``potential``: by coalition S the integer |S|! * P(S) of the game ``value``.

    One level of the recursion per coalition size: |S|! P(S) = (|S| - 1)! value(S) + the sum of
    (|S| - 1)! P(S without i), whose terms are what the level before has kept.
    """
    by_size = [[s for s in range(1 << players) if s.bit_count() == size] for size in range(players + 1)]
    out = valued.withColumn("__p0", F.lit(0).cast("bigint"))
    for size in range(1, players + 1):
        level = {}
        for s in by_size[size]:
            without = [F.col(f"__p{s & ~(1 << i)}") for i in range(players) if s >> i & 1]
            level[f"__p{s}"] = F.get(F.col(value), F.lit(s)) * F.lit(factorial(size - 1)) + reduce(Column.__add__, without)
        out = out.withColumns(level)
    kept = F.array(*[F.col(f"__p{s}") for s in range(1 << players)]).alias("potential")
    return out.select(*[F.col(f"`{c}`") for c in valued.columns], kept)


def steps(names: list[str]) -> Column:
    """Array of all steps of all orders: order, step, own filter and filters before it as bit sets."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, player in enumerate(order, 1):
            rows.append({"filter_order": "".join(names[p] for p in order), "step": step, "own": 1 << player, "before": before})
            before |= 1 << player
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, own: int, before: int>>")


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str], doc_id: str = "doc_id", part: str = "source", text: str = "text",
) -> DataFrame:
    """One row per part, order of the filters and step.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (over all orders).
    Filter names are single letters or digits; the report has as many orders as their number's factorial.
    """
    names, players = list(filters), len(filters)
    if any(len(name) != 1 or not name.isalnum() for name in names):
        raise ValueError("filter names are single letters or digits")
    masks = failures(docs, filters, doc_id, part, text)
    parts = potentials(coalitions(counts(masks, labels), players), players)
    rows = parts.withColumn("s", F.explode(steps(names)))
    own, before = F.col("s.own"), F.col("s.before")
    after = before.bitwiseOR(own)
    everyone = (1 << players) - 1

    def gain(values: str) -> Column:
        return F.get(F.col(values), after) - F.get(F.col(values), before)

    removed = gain("removed")
    grand, rest = F.get("potential", F.lit(everyone)), F.get("potential", F.lit(everyone) - own)
    return rows.select(
        "part", "s.filter_order", "s.step",
        (F.col("total") - F.get("removed", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("removed", own) - removed).alias("redundant"),
        F.get("alone", own).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (grand - F.lit(players) * rest).alias("shapley"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), firsts AS (SELECT text, min(doc_id) AS low FROM d GROUP BY text
), w AS (
  SELECT d.doc_id, part, d.text, [x FOR x IN regexp_split_to_array(d.text, '[ \x09-\x0D]+') IF x <> ''] AS words, coalesce(d.doc_id > low, false) AS e
  FROM d JOIN firsts ON d.text = firsts.text
), m AS (
  SELECT doc_id, part,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails
  FROM w
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, f,
    regexp_matches(fails, f) AS failing, before <> '' AND regexp_matches(fails, '[' || before || '-]') AS gone, fails, n, good, toxic
  FROM c, s
), t AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (NOT failing AND NOT gone) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed, sum(n) FILTER (failing AND gone) AS redundant,
    sum(n) FILTER (fails = f) AS unique_fails, sum(good) FILTER (failing AND NOT gone) AS good_lost, sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM t
"""


@query("op11_filter_audit", SQL)
def op11_filter_audit(spark: SparkSession, directory: str) -> DataFrame:
    """The five standard filters over all documents, by source."""
    return audit(table(spark, directory, "documents"), table(spark, directory, "labels"), standard_filters())
