"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size gives whole copies that every document
gets and a rest that a sample of its documents supplies.  For that sample each
document has an inclusion probability p that grows with the square root of its
size and is scaled so that the expected words are the rest; documents are ranked
by ``u / (1 - u)`` over ``p / (1 - p)`` with ``u`` from a hash of the id, and the
lowest ranks are taken until the rest is reached.

No source is sorted as a whole: two histograms of rank positions find the narrow
interval in which the cut lies, and only rows in there are put in order.  Rows
below the cut are taken by comparing numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.llm.common import SPACE_CLASS, broadcast_if_small, cut, documents, row_of, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
#: Intervals of each of the two histograms.
BINS = 4096


def count_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, null 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For rows (source, source_size): the target of each source.

    Sources are in code-point order with null last.  Shares follow the weights;
    a source stops at ``most`` times its size and what is over is shared anew, so a
    target is ``min(most * size, level * weight)`` for one level, which a running
    sum over sources by ``size / weight`` gives.  One row a source: the windows
    see as many rows as there are sources.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    by_need = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = W.partitionBy()
    s = s.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("before", F.sum("cap").over(by_need) - F.col("cap"))
    s = s.withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(by_need) + F.col("weight"))
    s = s.withColumn("own_level", (F.col("wanted") - F.col("before")) / F.col("open"))
    s = s.withColumn("full", F.col("cap") <= F.col("own_level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("own_level").alias("level")))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(level["level"] * F.col("weight"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the MD5 digest of the seed and the key; null keys share one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, bins: int = BINS, keep: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``; with ``keep`` all columns come along in the struct ``row``, and ``n_copies``.

    Null and empty texts have size 0 and give nothing; repeated rows are
    documents of their own and ties in rank go by id, then size; null is the
    last source; an empty table gives an empty result; all sizes 0 give targets 0.
    """
    rows = docs.select(
        *([row_of(docs)] if keep else []),
        F.col("doc_id").alias("doc_id"),
        F.col("source").alias("source"),
        count_words(F.col("text")).alias("size"),
    )
    # texts are read once; every step but the last reads three small columns
    rows = stored(rows)[0] if keep else cut(rows)
    root = F.floor(F.sqrt(F.col("size").cast("double")) * 1000).cast("long")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((root * F.col("size")).cast("decimal(38,0)")).alias("scale"))
    sums = cut(sums)
    plan = (
        targets(sums.select("source", "source_size"), weights, share, most)
        .alias("t")
        .join(sums.select(F.col("source").alias("s"), "scale"), F.col("source").eqNullSafe(F.col("s")))
        .select(
            F.col("source").alias("plan_source"),
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies"),
            F.col("scale").cast("double").alias("scale"),
        )
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    )
    plan = broadcast_if_small(cut(plan))
    at = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    p = F.when(F.col("scale") > 0, F.col("rest") * root / F.col("scale")).otherwise(0.0)
    u = uniform(F.col("doc_id"), seed)
    odds = lambda x: x / (1 - x)
    rank = F.when(p >= 1, 0.0).when(p <= 0, float("inf")).otherwise(odds(u) / odds(p))
    at = at.withColumn("rank", rank).withColumn("place", F.col("rank") / (1 + F.col("rank")))  # in 0..1, in rank order
    at = at.withColumn("place", F.when(F.col("rank") == float("inf"), 1.0).otherwise(F.col("place")))
    sampled = at.where((F.col("rest") > 0) & (F.col("size") > 0))

    first = F.least(F.floor(F.col("place") * bins), F.lit(bins - 1)).cast("int")
    second = F.least(F.floor((F.col("place") * bins - F.floor(F.col("place") * bins)) * bins), F.lit(bins - 1)).cast("int")
    coarse = _crossing(sampled.withColumn("bin", first), ["source"], F.lit(0).cast("long"), F.first("rest").alias("rest"))
    coarse = broadcast_if_small(cut(coarse))
    inside = _within(sampled.withColumn("bin", first), coarse, ["source"])
    fine = _crossing(inside.withColumn("bin2", second), ["source"], F.col("start"), F.first("rest").alias("rest"), F.first("start").alias("start"), column="bin2")
    edge = coarse.select(F.col("source").alias("e"), F.col("bin").alias("edge_bin")).join(
        fine.select(F.col("source").alias("e2"), F.col("bin2").alias("edge_bin2"), F.col("start").alias("edge_start")), F.col("e").eqNullSafe(F.col("e2"))
    )
    edge = broadcast_if_small(cut(edge.select("e", "edge_bin", "edge_bin2", "edge_start")))
    placed = at.withColumn("bin", first).withColumn("bin2", second).join(edge, F.col("source").eqNullSafe(F.col("e")), "left")
    low = (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & (F.col("bin2") < F.col("edge_bin2")))
    on_edge = (F.col("bin") == F.col("edge_bin")) & (F.col("bin2") == F.col("edge_bin2")) & (F.col("size") > 0)
    out = [*(["row"] if keep else []), "doc_id", "source", "size", "source_size", "target", "copies"]
    clear = placed.where(~F.coalesce(on_edge, F.lit(False)))
    # without an edge every sampled row of the source is taken
    sure = (F.col("rest") > 0) & (F.col("size") > 0) & F.coalesce(low, F.lit(True))
    clear = clear.select(*out, sure.cast("long").alias("extra"))
    order = W.partitionBy("source").orderBy("rank", F.col("doc_id").isNull(), "doc_id", "size")
    run = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("edge_start")
    close = placed.where(on_edge).withColumn("run", run)
    close = close.select(*out, (2 * F.col("run") - F.col("size") <= 2 * F.col("rest")).cast("long").alias("extra"))
    every = clear.unionByName(close)
    return every.select(*(["row", (F.col("copies") + F.col("extra")).alias("n_copies")] if keep else []), "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("extra"))).alias("taken"))


def taken_rows(docs: DataFrame) -> DataFrame:
    """Each row of ``docs``, whole, as often as ``mix`` takes it; see there for nulls, repeats and empty tables."""
    copies = F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))
    return mix(docs, keep=True).where("n_copies > 0").select("row", copies.alias("copy")).select("row.*")


def _crossing(rows: DataFrame, keys: list[str], start: Column, *carry: Column, column: str = "bin") -> DataFrame:
    """For each source, the first interval whose words reach the rest, with the words before it.  At most ``bins`` rows a source are windowed."""
    sums = rows.groupBy(*keys, column).agg(F.sum("size").alias("words"), *carry)
    run = F.sum("words").over(W.partitionBy(*keys).orderBy(column).rowsBetween(W.unboundedPreceding, 0)) + start
    crossed = sums.withColumn("run", run).where(F.col("run") >= F.col("rest"))
    best = F.min(F.struct(F.col(column), (F.col("run") - F.col("words")).alias("start"))).alias("b")
    return crossed.groupBy(*keys).agg(best).select(*keys, F.col(f"b.{column}").alias(column), F.col("b.start").alias("start"))


def _within(rows: DataFrame, edge: DataFrame, keys: list[str]) -> DataFrame:
    e = edge.select(F.col("source").alias("e"), F.col("bin").alias("e_bin"), "start")
    return rows.join(e, F.col("source").eqNullSafe(F.col("e")) & (F.col("bin") == F.col("e_bin")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
r AS (SELECT *, CAST(floor(sqrt(CAST(size AS DOUBLE)) * 1000) AS BIGINT) AS root FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CAST(root * size AS HUGEINT)) AS DOUBLE) AS scale FROM r GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
       source_size * CAST(2 AS DOUBLE) AS cap, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS wanted FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
       sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s1),
s3 AS (SELECT *, CAST(wanted - before AS DOUBLE) / CAST(open AS DOUBLE) AS own_level FROM s2),
s4 AS (SELECT *, cap <= own_level * weight AS filled FROM s3),
s5 AS (SELECT *, (SELECT first(own_level ORDER BY cap / weight) FROM s4 WHERE NOT filled) AS lev FROM s4),
t AS (SELECT *, CAST(CASE WHEN filled THEN cap ELSE lev * weight END AS DOUBLE) AS target FROM s5),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
q AS (SELECT *, target - copies * source_size AS rest FROM p),
j AS (SELECT r.doc_id, r.source, r.size, q.source_size, q.target, q.copies, q.rest,
             CASE WHEN scale > 0 THEN rest * root / scale ELSE 0.0 END AS p,
             (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u
      FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p <= 0 THEN CAST('inf' AS DOUBLE) ELSE (u / (1 - u)) / (p / (1 - p)) END AS rank FROM j),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id IS NULL, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN rest > 0 AND 2 * run - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
