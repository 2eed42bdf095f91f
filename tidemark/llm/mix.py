"""Mixing sources to target weights.

Words are summed per source, every source gets a target by weight (with a cap on
its repetition), and each document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy with the fraction as its probability.  Only the table
of source totals is ever gathered; documents never move for the decision.

Defined results: a null text has size 0; a null source is a source of its own, after
all others; a source without words has target 0 and no copies; rows that repeat a
doc_id are decided alike; an empty table gives an empty mix.  Other columns pass
through mix_documents() untouched, whatever their names, but for the reserved
prefix `_mix_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_unit, word_count

#: Up to so many sources (counted before the join) are broadcast: under 16 MB of names and numbers.
BROADCAST_SOURCES = 100_000
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Weights repeat over the sources in code-point order.  Sources take shares of
    share * all words by weight; none gets more than most * its own words, and the
    excess goes to the others by weight.  In closed form: with sources ordered by
    cap / weight, the first prefix that is full fixes the level of the rest.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.select(
        "source", "source_size", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1).alias("w"),
        (F.sum("source_size").over(everything).cast("double") * share).alias("goal"),
    ).withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onwards)).withColumn("pos", F.row_number().over(order))
    fits = F.col("level") <= F.col("cap") / F.col("w")
    t = t.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("pos"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return t.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def copies(rate: Column, doc_id: Column, text: Column, seed: int = 17) -> Column:
    """floor(rate) plus a Bernoulli copy; the coin is a hash of the id (of the text where the id is null)."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    coin = hash_unit(F.concat(F.lit(f"{seed}:"), key))
    return (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def with_targets(docs: DataFrame, source: str = "source", text: str = "text", **how) -> DataFrame:
    """docs with _mix_size, _mix_source_size, _mix_target and _mix_rate; one pass for the totals, one for the rows."""
    targets = cut(source_targets(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")), **how), "mix-targets")
    targets = targets.select(F.col("source").alias("_mix_source"), *[F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "rate")])
    small = targets.count() <= BROADCAST_SOURCES
    sized = docs.withColumn("_mix_size", word_count(F.col(text)))
    return sized.join(F.broadcast(targets) if small else targets, F.col(source).eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")


def mix_documents(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it."""
    n = copies(F.col("_mix_rate"), F.col("doc_id"), F.col("text"), seed)
    out = with_targets(docs, **how).withColumn("_mix_copies", n).filter("_mix_copies > 0")
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken and the copies behind it, one row per row of docs."""
    n = copies(F.col("_mix_rate"), F.col("doc_id"), F.col("text"), seed)
    return with_targets(docs.select("doc_id", "text", "source")).select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (n * F.col("_mix_size")).alias("taken"),
    )


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size::DOUBLE * 2.0 AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (sum(source_size) OVER ())::DOUBLE * 1.5 AS goal FROM t),
l AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos FROM w),
v AS (SELECT min_by(level, pos) AS level FROM l WHERE level <= cap / w),
g AS (SELECT l.source, l.source_size, least(l.cap, coalesce(v.level * l.w, l.cap)) AS target FROM l CROSS JOIN v),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'text:' || md5(coalesce(d.text, '')))), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS coin
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size AS taken FROM r
"""
