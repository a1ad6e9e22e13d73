"""Mixing sources to target weights by capped water-filling [native].

Targets: every source asks for its weight's share of the mix; a source is
clamped at ``max_epochs`` times its size and the excess goes to the others by
weight until none is above. Sampling: a source whose rate is 1.4 takes each
document once and a seeded 0.4 of its words once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.words import n_words, unused, words
from twinweave.plans.scratch import Scratch

_DRAWS = 1 << 60


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) plus ``target``.

    Closed form of the repeated resharing: with sources in ascending order of
    cap/weight, source i is clamped iff cap of those before it plus its own
    cap/weight times the weight from it on does not exceed the total. One row a
    source; weights must be positive. If all caps together are below the total,
    every source is clamped.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    everything = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = sources.withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight")).withColumn("total", total)
    s = s.withColumn("clamped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)) + F.col("level") * F.sum("weight").over(after) <= F.col("total"))
    spent = F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything)
    rest = F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("weight"))).over(everything)
    share = (F.col("total") - spent) * F.col("weight") / rest
    return s.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(share)).drop("cap", "level", "total", "clamped")


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Weights from ``cycle``, repeating over sources in code point order, null last. One row a source."""
    pos = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(cycle)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (pos + 1).cast("int"))
    return sources.withColumn("weight", weight)


def plan_mix(sized: DataFrame, weigh=cycled_weights, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row a source: source, source_size, n_docs, weight, target, from rows (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    total = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    return water_fill(weigh(per), total, max_epochs)


def mix(
    docs: DataFrame,
    weigh=cycled_weights,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 11,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(id, source, size, source_size, target, taken) for every row; ``taken`` counts words, repeats included.

    Each source takes its whole repetitions of every document, then documents in
    seeded order until the target is met; the document at the edge gives its
    first words only, so a source misses its target by less than one word.
    The edge is found without sorting a source: sizes are summed over 1024
    ranges of the seeded draw, then over 1024 ranges of the range with the edge,
    and only what is left there is put in order. Null text has size 0. Null
    source is a source. Rows that share an id share their draw. ``max_epochs``
    bounds every document. Empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 15), 16, 10).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), draw.alias("draw"))
    sized = scratch.stash(sized.withColumn("key", _key("source")), "sizes")

    mixed_words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(mixed_words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan_mix(sized, weigh, share, max_epochs).withColumn("whole", whole)
    plan = plan.withColumn("extra", mixed_words - F.col("whole") * F.col("source_size")).withColumn("key", _key("source"))
    # The edge's range of draws [lo, hi) and the words ahead of it.
    plan = scratch.stash(plan.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(_DRAWS), "ahead": F.lit(0).cast("long")}), "plan")
    for bits in (50, 40):
        plan = scratch.stash(_narrow(sized, plan, bits), f"edge{bits}")

    rows = sized.drop("source").join(plan, "key")
    at_edge = (F.col("draw") >= F.col("lo")) & (F.col("draw") < F.col("hi"))
    order = Window.partitionBy("key").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("extra") - F.col("ahead") - F.coalesce(F.sum("size").over(order), F.lit(0))
    within = rows.filter(at_edge).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    others = rows.filter(~at_edge).withColumn("more", F.when(F.col("draw") < F.col("lo"), F.col("size")).otherwise(F.lit(0)))
    out = others.unionByName(within)
    taken = (F.col("whole") * F.col("size") + F.col("more")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))


def _narrow(sized: DataFrame, plan: DataFrame, bits: int) -> DataFrame:
    """``plan`` with [lo, hi) narrowed to the range of 2**bits draws in which a source's extra words run out."""
    inside = sized.select("key", "draw", "size").join(plan.select("key", "lo", "hi"), "key").filter("draw >= lo and draw < hi")
    bins = inside.groupBy("key", F.shiftright("draw", bits).alias("bin")).agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    edge = (
        bins.join(plan.select("key", "extra", "ahead"), "key")
        .withColumn("start", F.col("start") + F.col("ahead"))
        .filter("start < extra and extra <= start + bin_size")
        .select("key", F.shiftleft("bin", bits).alias("new_lo"), F.shiftleft(F.col("bin") + 1, bits).alias("new_hi"), F.col("start").alias("new_ahead"))
    )
    # Without an edge (nothing extra) the range is empty and below all draws.
    return plan.drop("lo", "hi", "ahead").join(edge, "key", "left").select(
        *[c for c in plan.columns if c not in ("lo", "hi", "ahead")],
        F.coalesce("new_lo", F.lit(0)).cast("long").alias("lo"),
        F.coalesce("new_hi", F.lit(0)).cast("long").alias("hi"),
        F.coalesce("new_ahead", F.lit(0)).cast("long").alias("ahead"),
    )


def _key(source: str) -> Column:
    """A join key in which null is a value."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def materialise(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed corpus: documents repeated as often as taken, the last repetition cut to the words left.

    ``taken`` has (id, size, taken) as ``mix`` gives them for ``docs``. Rows whose
    id has no entry or takes nothing are left out, and so are null texts and those
    without words, of which nothing can be taken. Rows that repeat an id and a
    size are taken alike, as often as the one of them that is taken most. A cut
    repetition is its first words with single spaces. Columns of any names are
    kept. An empty table gives an empty result.
    """
    own, size, n, part = unused(docs, "taken_id", "taken_size", "taken_words", "taken_part")
    t = taken.groupBy(F.col(id_col).alias(own), F.col("size").alias(size)).agg(F.max("taken").alias(n)).filter(F.col(n) > 0)
    whole = F.floor(F.col(n) / F.col(size)).cast("int")
    rest = (F.col(n) - whole * F.col(size)).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = docs.join(t, docs[id_col].eqNullSafe(t[own]) & (n_words(docs[text_col]) == t[size])).withColumn(part, F.explode(parts))
    cut = F.array_join(F.slice(words(text_col), 1, F.col(part)), " ")
    return rows.withColumn(text_col, F.when(F.col(part) > 0, cut).otherwise(F.col(text_col))).select(*docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents; weights 5, 2, 1 repeating; 150 % of all words; at most 2 epochs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('11:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS draw
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         sum(source_size) OVER () * 1.5::DOUBLE AS total, source_size * 2.0::DOUBLE AS cap
  FROM per),
c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + cap / weight * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= total AS clamped
  FROM w),
t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap ELSE (total - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) * weight / sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () END AS target
  FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
q AS (SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS extra FROM p)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, extra - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
