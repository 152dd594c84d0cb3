"""Mixing sources to target weights.

Words are counted per source, targets are shared out by weight without any source giving more
than ``most`` times its words, and each document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy with the fraction as its probability.

Cases: a null or empty text has size 0 and rides along at its source's rate; a null source is a
source of its own, the last; repeated rows share their doc_id's draw; a null doc_id draws as one
document; a source without words has target 0 and rate 0; an empty table gives no rows; further
columns, whatever their names, are carried by :func:`emit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.llm.columns import free
from docproof.llm.store import settled

WORD = r"[^\x20\x09-\x0D]+"

#: Up to so many sources their targets are sent to every task; beyond, a shuffle join is used.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on seed and key alone: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def ranked(rows: DataFrame, order: Column) -> DataFrame:
    """``rows`` with ``rank``: the place in ``order``, from 0. They are sorted by range; only the sizes
    of the ranges meet in one task."""
    placed = settled(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("at", 33))
    before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(sizes), "range").withColumn("rank", at).drop("at", "range", "before")  # a row for each range


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, from rows (source, size).

    Sources by code point, null last, take the weights in turn and share ``share`` of all words;
    what is above ``most`` times a source's words goes to the others by weight until none is above.
    In each round sources above their limit stop there and the level of the others rises, until no
    more stop; a round is one sum over a row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = ranked(per, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = settled(per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    whole = float(per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]) * share
    level, stopped = None, None
    while True:
        under = F.lit(False) if level is None else F.col("cap") / F.col("weight") < F.lit(level)
        sums = per.agg(F.count_if(under).alias("n"), F.coalesce(F.sum(F.when(under, F.col("cap"))), F.lit(0.0)).alias("cap"), F.coalesce(F.sum(F.when(~under, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if sums["n"] == stopped or not sums["weight"]:
            break
        stopped, level = sums["n"], (whole - sums["cap"]) / sums["weight"]
    target = F.col("cap") if level is None or not sums["weight"] else F.least("cap", F.col("weight") * F.lit(level))
    return per.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, rate, copies."""
    sizes = settled(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    per = targets(sizes, weights, share, most)
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    draw = uniform(F.col("doc_id"), seed)
    on = F.col("d.source").eqNullSafe(F.col("s.source"))
    out = sizes.alias("d").join(per.alias("s"), on).select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", rate.alias("rate"))
    extra = F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("copies", (F.floor("rate") + extra).cast("int"))


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; texts are not shuffled.

    The copies depend on source and doc_id alone, so the small table of rates is joined and the
    draw is made next to the text."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    per = targets(sizes, weights, share, most)
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    rate = F.coalesce(F.col("s.target") / F.nullif(F.col("s.source_size"), F.lit(0)), F.lit(0.0))
    draw = uniform(F.col("d.doc_id"), seed)
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    joined = docs.alias("d").join(per.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    many, one = free(docs.columns, "copies", "copy")
    taken = joined.select("d.*", copies.alias(many)).filter(F.col(many) > 0)
    return taken.select("*", F.explode(F.sequence(F.lit(1), F.col(many))).alias(one)).drop(many, one)
