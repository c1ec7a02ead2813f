"""Operator 1: mixing sources to target weights along a time-varying curriculum.

Each source has a weight in each phase of training. The weights, integrated over
time, share a budget of words between the sources; a source is repeated
``max_epochs`` times at most and what it cannot take is shared anew (water
filling). Within a source the documents stand in a fixed pseudo-random order; the
running sum of their sizes is the demand at which each is reached, and inverting
the source's cumulative demand gives its position in training. Sorting by
position interleaves the sources as the schedule asks.

The running sums are two-level: sums per (source, bucket), a running sum over a
source's buckets, and one inside each bucket, so that a source with a third of
all rows is dealt over thousands of tasks and no task holds a whole source.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; an empty table gives an empty result; equal rows are taken in either
order, which gives the same rows; extra columns are ignored by ``mix`` and kept
by ``training_order``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, table

#: (end of the phase in training time, weights that repeat over the sources in order).
#: Early training leans on the heaviest sources, late training on the lightest; integrated, the weights are 5, 2 and 1.
PHASES = ((0.5, (7.0, 2.0, 0.5)), (1.0, (3.0, 2.0, 1.5)))
BUDGET = 1.5
MAX_EPOCHS = 2
#: Hex digits of the order key that make a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def _weight(rank, phases):
    """Weight of a source integrated over all phases; rank counts from 0."""
    total, begin = None, 0.0
    for end, cycle in phases:
        w = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (rank % len(cycle) + 1).cast("int"))
        part = w * F.lit(end - begin)
        total, begin = (part if total is None else total + part), end
    return total


def source_targets(sizes: DataFrame, phases=PHASES, budget=BUDGET, max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row per source of (source, size): rank, weight, source_size, target.

    target = min(max_epochs * size, weight * level) with the level at which the
    targets sum to ``budget`` times all sizes. Sources are taken by
    size / weight: those below the level are capped, the rest share what is left.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", _weight(F.col("rank"), phases)).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    ratio = F.col("cap") / F.col("weight")
    fill = Window.orderBy(F.col("ratio"), F.col("rank"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = (
        ranked.withColumn("ratio", ratio)
        .withColumn("wanted", F.lit(float(budget)) * F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("level_here", (F.col("wanted") - F.col("capped_before")) / F.col("weight_left"))
    )
    # The first source in this order whose cap the level does not reach sets the level.
    level = F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "rank", "level_here"))).over(everything)["level_here"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return leveled.withColumn("level", level).withColumn("target", F.coalesce(target, F.col("cap").cast("double"))).select("source", "rank", "weight", "source_size", "target")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with their size, the key of their order, and (skey, bucket) by which they are dealt; skey is never null."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    sized = docs.select("*", n_words(F.col("text")).alias("size"), key.alias("order_key"))
    return sized.withColumns({"bucket": F.substring("order_key", 1, BUCKET_DIGITS), "skey": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))})


def _placed(keyed: DataFrame, phases, budget, max_epochs) -> DataFrame:
    """keyed with each source's size and target and the words of the source before each document.

    The window inside a bucket and the join with what stands before it have the same
    keys, so rows move once.
    """
    sums = keyed.select("source", "skey", "bucket", "size").groupBy("source", "skey", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(sums, phases, budget, max_epochs).withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source")
    up_to = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "bucket", F.coalesce(F.sum("size").over(up_to), F.lit(0)).alias("bucket_from")).join(targets, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = keyed.withColumn("inside_from", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = ordered.join(offsets.hint("merge"), ["skey", "bucket"])
    return both.withColumn("words_before", F.col("bucket_from") + F.col("inside_from")).drop("bucket_from", "inside_from")


def _position(demand, phases):
    """Training time at which a source's cumulative demand, as a share of its target, reaches ``demand``.

    Within a phase demand grows in proportion to the source's weight there, so
    the inverse is linear between the ends of phases.
    """
    lengths = [end - begin for begin, end in zip([0.0, *[e for e, _ in phases]], [e for e, _ in phases], strict=False)]
    parts = [F.element_at(F.array(*[F.lit(float(x) * n) for x in c]), (F.col("rank") % len(c) + 1).cast("int")) for (_, c), n in zip(phases, lengths, strict=True)]
    total = sum(parts[1:], parts[0])
    out, begin, done = None, 0.0, F.lit(0.0)
    for part, n in zip(parts, lengths, strict=True):
        share = part / total
        here = F.lit(begin) + F.lit(n) * F.coalesce(F.try_divide(demand - done, share), F.lit(0.0))
        out = F.when(demand <= done + share, here) if out is None else out.when(demand <= done + share, here)
        done, begin = done + share, begin + n
    return F.least(out.otherwise(F.lit(1.0)), F.lit(1.0))


def _start(epoch):
    """Words of the source's repeated stream before this copy of the document."""
    return F.col("words_before") + F.lit(epoch) * F.col("source_size")


def _demand(start):
    """start as a share of the source's target."""
    return F.coalesce(F.try_divide(start.cast("double"), F.col("target")), F.lit(0.0))


def mix(docs: DataFrame, phases=PHASES, budget=BUDGET, max_epochs=MAX_EPOCHS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken words and the positions of its copies in training.

    A copy has the document's words before the source's target, so the copy at
    the target is cut; taken sums the words of the copies. The output is sorted
    by position over range partitions; documents without a copy come last.
    """
    placed = _placed(_keyed(docs.select("doc_id", "text", "source")).drop("text"), phases, budget, max_epochs)
    whole, none = F.round("target").cast("long"), F.lit(0).cast("long")
    copies = [F.struct(F.greatest(none, F.least(F.col("size"), whole - _start(e))).alias("words"), _position(_demand(_start(e)), phases).alias("position")) for e in range(max_epochs)]
    emitted = placed.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", none, lambda total, c: total + c["words"])
    out = emitted.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("copies.position").alias("positions"))
    return out.orderBy(F.size("positions") == 0, "positions", "doc_id")


def training_order(docs: DataFrame, phases=PHASES, budget=BUDGET, max_epochs=MAX_EPOCHS, marks: bool = True) -> DataFrame:
    """Every copy that training reads, in order: the columns of docs, with marks also mix_epoch and mix_position.

    A copy is taken whole if more than half of its words lie before its source's
    target, so each source is within half a document of it. The output is sorted
    by position over range partitions.
    """
    names = docs.columns
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("doc")
    base = docs.select(own, F.col("doc_id"), F.col("text"), F.col("source"))
    placed = _placed(_keyed(base).drop("text"), phases, budget, max_epochs)
    copies = placed.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
    start = F.col("words_before") + F.col("epoch") * F.col("source_size")
    copies = copies.withColumn("middle", start + F.col("size") / F.lit(2.0)).filter((F.col("middle") < F.col("target")) | ((F.col("size") == 0) & (F.col("epoch") == 0)))
    slim = copies.select("doc", "doc_id", "epoch", _position(_demand(start), phases).alias("position"))
    ordered = slim.orderBy("position", "doc_id", "epoch").select("doc.*", *(["epoch", "position"] if marks else []))
    return ordered.toDF(*names, *(["mix_epoch", "mix_position"] if marks else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first copies, with the training time of these (null without a copy)."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("first_position"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2 * source_size AS cap FROM r),
l AS (SELECT *, cap / weight AS ratio, CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM s) AS wanted FROM w),
m AS (SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here FROM l),
t AS (SELECT source, source_size,
        least(CAST(cap AS DOUBLE), weight * (SELECT level_here FROM m WHERE level_here <= ratio ORDER BY ratio, rank LIMIT 1)) AS target FROM m),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM sized),
c AS (
  SELECT p.doc_id, p.size, t.source_size, t.target,
    greatest(0, least(p.size, CAST(round(t.target) AS BIGINT) - p.b)) AS words0,
    greatest(0, least(p.size, CAST(round(t.target) AS BIGINT) - p.b - t.source_size)) AS words1,
    CAST(p.b AS DOUBLE) / t.target AS demand,
    CASE r.rank % 3 WHEN 0 THEN 3.5::DOUBLE / 5.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE / 2.0::DOUBLE ELSE 0.25::DOUBLE / 1.0::DOUBLE END AS early,
    CASE r.rank % 3 WHEN 0 THEN 1.5::DOUBLE / 5.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE / 2.0::DOUBLE ELSE 0.75::DOUBLE / 1.0::DOUBLE END AS late
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source JOIN r ON p.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(words0 + words1 AS BIGINT) AS taken,
  CASE WHEN words0 = 0 THEN NULL
       WHEN demand <= early THEN least(0.0::DOUBLE + 0.5::DOUBLE * (demand / early), 1.0::DOUBLE)
       WHEN demand <= early + late THEN least(0.5::DOUBLE + 0.5::DOUBLE * ((demand - early) / late), 1.0::DOUBLE)
       ELSE 1.0::DOUBLE END AS first_position
FROM c
"""
