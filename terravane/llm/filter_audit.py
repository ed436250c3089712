"""Filter interaction audit: what five filters remove in each of their 120 orders, with duplicates found by partition refinement.

Rows are split by the length of their text in code points, then by the hash of
its first block, of its second, and of the rest; after each split the rows that
stand alone are dropped, so that few texts are left to be compared whole. Those
are grouped by their classes and texts, the smallest id of each text is found,
and every row with a larger one is marked.

With that mark a row is five bits, and all orders follow from the number of
rows of each part and bit pattern: 32 rows for each part, whatever the table
holds. No text but those of the last comparison is shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import WORD, Scratch

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Lengths in code points of the blocks that are hashed one after the other; what is left is the last block.
BLOCKS = (64, 1024)
_KEYS = ("n_chars", *(f"block{i}" for i in range(len(BLOCKS) + 1)))
#: Most classes of likely copies that are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_CLASSES = 200_000


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D, each of which judges a text on its own."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = (n < 50, distinct * 100 < n * 65, capitals * 100 > F.length(text) * 5, text.rlike("[#$%&*|]"))
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def _block_hashes(text: Column) -> list[Column]:
    starts = [1]
    for size in BLOCKS:
        starts.append(starts[-1] + size)
    sizes = [*BLOCKS, 2**31 - 1 - starts[-1]]
    return [F.xxhash64(F.substring(text, at, size)).alias(f"block{i}") for i, (at, size) in enumerate(zip(starts, sizes, strict=True))]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.select("*", F.length("text").alias("n_chars"), *_block_hashes(F.col("text")))


def refined(facts: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes (length and block hashes) that hold two rows or more, found split by split."""
    left, rows = None, facts.select(*_KEYS)
    for upto in range(1, len(_KEYS) + 1):
        keys = list(_KEYS[:upto])
        classes = rows.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").select(*keys)
        if upto == len(_KEYS):
            return scratch.keep(classes, "classes")
        kept = scratch.keep(rows.join(classes, keys, "left_semi").select(*_KEYS), "refined")
        if left is not None:
            scratch.drop(left)
        left = rows = kept
    raise AssertionError


def _marked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part and mask (five bits) of each row."""
    facts = scratch.keep(_rows(docs).select("doc_id", "part", own_failures(F.col("text")).alias("own"), *_KEYS), "facts")
    classes = refined(facts, scratch)
    few = F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes
    alone = facts.join(few, list(_KEYS), "left_anti").select("doc_id", "part", F.col("own").alias("mask"))
    alike = _rows(docs).join(few, list(_KEYS), "left_semi")
    alike = scratch.keep(alike.select("doc_id", "part", "text", own_failures(F.col("text")).alias("own"), *_KEYS), "alike")
    first = alike.groupBy(*_KEYS, "text").agg(F.min("doc_id").alias("first_id"))
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    compared = alike.join(first, [*_KEYS, "text"], "left").select("doc_id", "part", (F.col("own") + copy).alias("mask"))
    return scratch.keep(alone.unionByName(compared), "marked")


def _bit(letter: Column) -> Column:
    """The bit of a filter's letter."""
    return F.pow(F.lit(2), F.ascii(letter) - ord(FILTERS[0])).cast("int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for each part, order and step.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic.
    A null text is empty, so it is a copy of other null and empty texts. A null
    source and an empty one are the part "". A row with a null id is never a
    copy, and makes no other row one; rows that repeat an id and its text are
    no copies of each other, as neither id is smaller, but count each. Of
    several labels of an id one that says good or toxic is enough; null labels
    and labels of unknown or null ids say neither. Very long texts are hashed
    and compared whole; other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    marked = _marked(docs, scratch)
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    said = said.select(F.col("doc_id").alias("labelled"), "good", "toxic")
    counted = marked.join(said, F.col("doc_id") == F.col("labelled"), "left").groupBy("part", "mask")
    patterns = scratch.keep(counted.agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic")), "patterns")
    # each pattern in each order and step: what it fails there, and whether it went before
    steps = patterns.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    steps = steps.withColumn("bit", _bit(F.col("letter")))
    earlier = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda acc, i: acc + F.when(i <= F.col("at"), _bit(F.substr("filter_order", i, F.lit(1)))).otherwise(0))
    steps = steps.withColumn("earlier", earlier)
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    here = fails & ~gone

    def total(which: Column, n: str) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col(n))), F.lit(0)).cast("long")

    out = steps.groupBy("part", "filter_order", "letter", (F.col("at") + 1).alias("step")).agg(
        total(~fails & ~gone, "n").alias("kept"),
        total(here, "n").alias("removed"),
        total(fails & gone, "n").alias("redundant"),
        total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        total(here, "n_good").alias("good_lost"),
        total(here, "n_toxic").alias("toxic_lost"),
    )
    shares = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
ORACLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM docs),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(said.toxic, false) AS toxic,
         (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN coalesce(worded.doc_id > first_id, false) THEN 16 ELSE 0 END) AS mask
  FROM worded LEFT JOIN said ON worded.doc_id = said.doc_id),
patterns AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM marked GROUP BY part, mask),
letters(f, b) AS {_LETTERS},
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, p.b AS b1, q.b AS b2, r.b AS b3, s.b AS b4, t.b AS b5
  FROM letters p JOIN letters q ON q.b <> p.b JOIN letters r ON r.b NOT IN (p.b, q.b) JOIN letters s ON s.b NOT IN (p.b, q.b, r.b)
       JOIN letters t ON t.b NOT IN (p.b, q.b, r.b, s.b)),
steps AS (
  SELECT filter_order, 1 AS step, b1 AS bit, 0 AS earlier FROM orders UNION ALL SELECT filter_order, 2, b2, b1 FROM orders
  UNION ALL SELECT filter_order, 3, b3, b1 + b2 FROM orders UNION ALL SELECT filter_order, 4, b4, b1 + b2 + b3 FROM orders
  UNION ALL SELECT filter_order, 5, b5, b1 + b2 + b3 + b4 FROM orders),
summed AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE mask & (bit + earlier) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(n_good) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0) AS good_lost,
         coalesce(sum(n_toxic) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM patterns CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM summed
"""
