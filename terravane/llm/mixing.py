"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sizes are summed per source. Each source's target is its weight times a common
water level, but at most ``max_epochs`` times its size; the level is the one at
which the targets add up to the wanted total, so that what a clamped source
cannot take is shared by weight among the others until none is above its cap.

A target of 1.4 times a source's size becomes one whole repetition of every
document and a fractional one: documents fall into ``BINS`` bins by a seeded
hash, bins are filled in order while the target lasts, and the documents of the
one bin in which it ends give the same share of their words each. Only sums by
source and bin are gathered, so a source that holds a third of all rows is
never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.llm.common import WORD, Scratch, columns, free_name

BINS = 4096


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_bin(doc_id: Column, seed: int) -> Column:
    """A bin in [0, BINS) from the md5 of id and seed."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % BINS


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating. The windows
    hold one small row for each distinct source, never a row for each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ranked = ranked.withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("water", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything))
    target = F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


#: Most rows of the table of bins that are broadcast (about 60 bytes each).
BROADCAST_BINS = 500_000


def _cuts(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Whole repetitions and last share of each source and bin, from rows of (source, bin, size)."""
    bins = scratch.keep(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    targets = water_fill(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, max_epochs)
    cut = bins.withColumnRenamed("source", "bin_source").join(targets, F.col("bin_source").eqNullSafe(F.col("source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = (F.col("target") - F.col("epochs") * F.col("source_size") - before) / F.col("bin_size")
    part = F.when(F.col("bin_size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))).otherwise(F.lit(0.0))
    return cut.withColumn("epochs", epochs).select("bin_source", F.col("bin").alias("bin_no"), "source_size", "target", "epochs", part.alias("part"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of ``docs`` (doc_id, text, source).

    ``share`` is the wanted total over the sum of all sizes, ``max_epochs`` the
    cap of a source over its size. Null or empty texts have size 0 and take 0
    words; a null source is a source of its own, after all others; a null id
    hashes as empty text; repeated rows count each; very long texts count whole;
    sources of equal fill are taken by code point; other columns are ignored;
    an empty table gives an empty result; a source without words gets target 0.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), seeded_bin(F.col("doc_id"), seed).alias("bin")), "sized")
    cut = _cuts(sized, scratch, weights, share, max_epochs)
    out = sized.join(cut, F.col("source").eqNullSafe(F.col("bin_source")) & (F.col("bin") == F.col("bin_no")))
    taken = F.col("size") * F.col("epochs") + F.round(F.col("size") * F.col("part")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mixture itself: whole rows of ``docs``, each as often as the mix takes it.

    Nothing is cut within a document here: those of a source's last bin come in
    once more if at least half of the bin is wanted. Texts stay where they are
    read; what is joined to them is the table of sources and bins. Null and
    empty texts have no words and come as often as their bin does; a null
    source is a source of its own; null ids hash as empty text; repeated rows
    count each; very long texts count whole; other columns stay, whatever their
    names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    bin_, of, no, repeat, copy = (free_name(docs, f"_{n}") for n in ("bin", "bin_source", "bin_no", "repeats", "copy"))
    cut = _cuts(docs.select("source", seeded_bin(F.col("doc_id"), seed).alias("bin"), n_words(F.col("text")).alias("size")), scratch, weights, share, max_epochs)
    repeats = F.col("epochs") + F.when(F.col("part") >= 0.5, 1).otherwise(0)
    plan = scratch.keep(cut.select(F.col("bin_source").alias(of), F.col("bin_no").alias(no), repeats.cast("int").alias(repeat)).where(F.col(repeat) > 0), "plan")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_BINS else plan
    laid = docs.withColumn(bin_, seeded_bin(F.col("doc_id"), seed)).join(plan, F.col("source").eqNullSafe(F.col(of)) & (F.col(bin_) == F.col(no)))
    return laid.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(repeat)))).select(*columns(docs))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 8) AS BIGINT) % {BINS} AS bin
  FROM documents),
bins AS (SELECT source, bin, CAST(sum(size) AS BIGINT) AS bin_size FROM sized GROUP BY source, bin),
sources AS (SELECT source, CAST(sum(bin_size) AS BIGINT) AS source_size FROM bins GROUP BY source),
weighed AS (
  SELECT *, source_size * CAST(2.0 AS DOUBLE) AS cap,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM sources),
filled AS (SELECT *, cap / weight AS fill FROM weighed),
leveled AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled),
watered AS (SELECT *, max(CASE WHEN level <= fill THEN level END) OVER () AS water FROM leveled),
targets AS (SELECT source, source_size, coalesce(least(cap, water * weight), cap) AS target FROM watered),
cut AS (
  SELECT b.source, b.bin, b.bin_size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(b.bin_size) OVER (PARTITION BY b.source ORDER BY b.bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM bins b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT *, CASE WHEN bin_size > 0 THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE),
         (target - epochs * source_size - CAST(before AS BIGINT)) / bin_size)) ELSE 0 END AS part FROM cut)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * p.epochs + CAST(round(s.size * p.part) AS BIGINT) AS BIGINT) AS taken
FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source AND s.bin = p.bin
"""
