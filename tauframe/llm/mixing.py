"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words. Each source's target is its share of all words the mix takes, by weight; no target
exceeds ``max_repeats`` times the source, and what is cut off is shared again by weight until no
target is above (found in one pass over the sources, sorted by where they fill up).

A source's documents form a queue in a fixed shuffled order (by a hash of the id); the mix reads the
queue, and reads it again where the target exceeds the source. Every source has a weight schedule
over training time 0..1 (straight lines between knots). Its integral, scaled to the target, is the
words demanded so far; inverting it at the words queued before a document gives the time at which
the document is read. Range-sorting by that position gives the training order.

Queue places are prefix sums. A source may hold any share of all rows, so a queue is cut into hash
ranges (about the square root of the number of rows): one sum per range, a running sum over ranges,
a running sum inside each. Only built-in functions run.

Defined results: a null text has size 0; a null source is a source (the last); documents of size 0
are never taken. Repeated rows are documents of their own; ties in the hash are ordered by the
text's hash. An empty table gives an empty mix. Extra columns travel along in ``carry`` only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tauframe.llm.text import table, whole, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
#: Schedules as (time, relative weight) knots, by place of the source like WEIGHTS: steady, fading
#: in, fading out.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.5)),
             ((0.0, 1.5), (0.5, 1.0), (1.0, 0.25)))


def integrated(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """``(time, weight, slope, integral so far)`` of each straight piece, the whole scaled to 1."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must rise from time 0 to time 1")
    if any(w < 0 for _, w in knots):
        raise ValueError("weights must not be negative")
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), done))
        done += (w0 + w1) / 2 * (t1 - t0)
    if done <= 0:
        raise ValueError("a schedule needs some weight")
    return [(t, w / done, s / done, c / done) for t, w, s, c in pieces]


def invert(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source has been asked for ``share`` (0..1) of its target."""
    def at(knots):
        pieces = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("twsc", p)])
                           for p in integrated(knots)])
        p = F.element_at(F.filter(pieces, lambda q: q["c"] <= share), -1)
        rest = share - p["c"]
        # w x + s x^2 / 2 = rest, in the form that is steady for small slopes
        under = F.sqrt(F.greatest(p["w"] * p["w"] + 2 * p["s"] * rest, F.lit(0.0)))
        return p["t"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / (p["w"] + under))
    out = at(schedules[-1])
    for k, knots in enumerate(schedules[:-1]):
        out = F.when(place % len(schedules) == k, at(knots)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, place, target``, one row per source."""
    if share > max_repeats:
        raise ValueError("the mix asks for more than all sources may give")
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row per source
    by = by.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", max_repeats * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    all_rows = Window.partitionBy()
    full_before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (share * F.sum("source_size").over(all_rows) - full_before) / left)
    # the first source in the order that does not fill up sets the level of all that follow
    by = by.withColumn("level", F.min(F.when(
        F.col("level") <= F.col("cap") / F.col("weight"), F.struct(
            (F.col("cap") / F.col("weight")).alias("o"), F.col("place"), F.col("level"))))
        .over(all_rows)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return by.select("source", "source_size", "place", target.alias("target"))


def assign(docs: DataFrame, carry: Sequence[str] = (), cut: bool = True, weights=WEIGHTS,
           share: float = SHARE, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, reads``, then
    ``carry``.

    ``reads`` lists the times the mix reads the document: ``pass, words, position``. With ``cut``
    the document at the end of the target is read up to it; without, it is read whole when half of
    it or more lies before the end, and else not.
    """
    digits = max(2, round(math.log(max(docs.count(), 1), 256)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # a source's name that is never null: rows stay where the window put them when offsets join
    name = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    sizes = docs.select("doc_id", "source", name.alias("_name"), word_count("text").alias("size"), key.alias("_key"),
                        F.xxhash64(whole("text")).alias("_tie"),
                        F.struct(*carry).alias("_carry") if carry else F.lit(0).alias("_carry"))
    sizes = sizes.withColumn("_range", F.substring("_key", 1, digits))
    narrow = docs.select("source", word_count("text").alias("size"), key.substr(1, digits).alias("_range"))
    ranges = narrow.groupBy("source", "_range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("_range")
    offsets = ranges.select("source", "_range", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    targets = source_targets(ranges.select("source", F.col("n").alias("size")), weights, share, max_repeats)
    offsets = offsets.alias("o").join(
        targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.concat(F.when(F.col("o.source").isNull(), "0").otherwise("1"), F.coalesce("o.source", F.lit("")))
        .alias("_name"), "_range", "offset", "source_size", "place", "target")
    inside = Window.partitionBy("_name", "_range").orderBy("_key", "_tie")
    queued = sizes.withColumn("_in", F.sum("size").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    rows = queued.join(offsets, ["_name", "_range"]).select(
        "doc_id", "source", "size", "source_size", "place", "target", "_carry",
        (F.col("_in") + F.col("offset")).alias("_at"))

    def read(k: int) -> Column:
        at = F.col("_at") + k * F.col("source_size")
        room = F.floor(F.round("target", 6)) - at
        if cut:
            n = F.greatest(F.lit(0), F.least(F.col("size"), room))
        else:
            n = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(F.lit(0))
        return F.struct(F.lit(k).alias("pass"), n.cast("long").alias("words"), F.round(invert(
            at / F.greatest(F.col("target"), F.lit(1.0)), F.col("place"), schedules), 9).alias("position"))

    rows = rows.withColumn("reads", F.filter(
        F.array(*[read(k) for k in range(max_repeats)]), lambda r: r["words"] > 0))
    return rows.select(
        "doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"),
        F.aggregate("reads", F.lit(0).cast("long"), lambda a, r: a + r["words"]).alias("taken"),
        "reads", *[F.col(f"_carry.{c}").alias(f"carry_{c}") for c in carry])


def _ranged(df: DataFrame, *by: Column) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def training_order(assigned: DataFrame) -> DataFrame:
    """One row per read, range-sorted by position."""
    rows = assigned.withColumn("read", F.explode("reads"))
    return _ranged(rows.drop("reads").select("*", "read.*").drop("read"), F.col("position"), F.col("doc_id"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` in training order, columns unchanged; a document read twice comes twice."""
    rows = training_order(assign(docs, carry=docs.columns, cut=False))
    return rows.select(*[F.col(f"carry_{c}").alias(c) for c in docs.columns])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    rows = _ranged(rows.withColumn("first_position", F.get("reads", 0)["position"])
                   .withColumn("second_position", F.get("reads", 1)["position"]),
                   F.col("first_position").asc_nulls_last(), F.col("doc_id"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_position",
                       "second_position")


_TIME = """CASE place % 3
  WHEN 0 THEN {y}
  WHEN 1 THEN CASE WHEN {y} * 0.9375 < 0.3125 THEN (sqrt(0.0625 + 3.0 * {y} * 0.9375) - 0.25) / 1.5
              ELSE 0.5 + (sqrt(1.0 + 2.0 * ({y} * 0.9375 - 0.3125)) - 1.0) / 1.0 END
  ELSE CASE WHEN {y} * 0.9375 < 0.625 THEN (1.5 - sqrt(2.25 - 2.0 * {y} * 0.9375)) / 1.0
       ELSE 0.5 + (1.0 - sqrt(greatest(1.0 - 3.0 * ({y} * 0.9375 - 0.625), 0))) / 1.5 END END"""
SQL = {"op5_source_mixing": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''),
        '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
-- give what is left by weight, hold what is above twice the source, again
fill AS (SELECT place, 0.0::DOUBLE AS got, 0 AS step FROM w
  UNION ALL
  SELECT w.place, least(f.got + CASE WHEN f.got < 2 * w.source_size THEN
      (1.5 * (SELECT sum(source_size) FROM w) - sum(f.got) OVER ()) * w.weight
      / nullif(sum(CASE WHEN f.got < 2 * w.source_size THEN w.weight ELSE 0 END) OVER (), 0)
      ELSE 0 END, 2 * w.source_size)::DOUBLE, f.step + 1
  FROM fill f JOIN w USING (place) WHERE f.step < 60),
t AS (SELECT w.*, f.got AS target FROM w JOIN fill f USING (place) WHERE f.step = 60),
q AS (SELECT d.doc_id, d.size, t.source_size, t.place, t.target,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')))
         - d.size)::BIGINT AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, greatest(0, least(size, floor(round(target, 6))::BIGINT - pos)) AS one,
        greatest(0, least(size, floor(round(target, 6))::BIGINT - pos - source_size)) AS two FROM q)
SELECT doc_id, size, source_size, round(target, 6) AS target, (one + two)::BIGINT AS taken,
  round(CASE WHEN one > 0 THEN {_TIME.format(y='(pos / target)')} END, 9) AS first_position,
  round(CASE WHEN two > 0 THEN {_TIME.format(y='((pos + source_size) / target)')} END, 9)
    AS second_position FROM r"""}
