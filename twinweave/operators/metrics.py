"""Reports over logs, decisions and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.functions.fingerprints import size_category
from twinweave.operators.quantiles import exact_quantiles

_N = "*"


def hash_statistics(hashes: DataFrame, bits: int = 64) -> DataFrame:
    """Entries of each algorithm and the average distance over all pairs, from counts of ones a bit, in one pass.

    ``hashes`` is (algorithm, hash). Bit i differs in ones * (n - ones) pairs.
    """
    h = hashes.filter("hash is not null").groupBy("algorithm")
    ones = [F.sum(F.shiftrightunsigned("hash", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(bits)]
    c = h.agg(F.count(_N).alias("n"), *ones)
    n = F.col("n").cast("double")
    differing = sum((F.col(f"b{i}") * (n - F.col(f"b{i}")) for i in range(bits)), F.lit(0.0))
    return c.select("algorithm", F.col("n").alias("entries"), F.when(n > 1, differing / (n * (n - 1) / 2)).otherwise(0.0).alias("average_distance"))


def dataset_analysis(assets: DataFrame, optimise: str = "balanced") -> DataFrame:
    """Counts by media type, bytes, estimated buckets and the kind of index that would suit."""
    n = F.count(_N)
    kinds = {"memory": "memory", "speed": "disk", "size": "compressed"}
    index = F.lit(kinds[optimise]) if optimise in kinds else F.when(n > 50_000, "hybrid").otherwise("balanced")
    return assets.agg(
        n.alias("files"), *[F.count_if(F.col("media_type") == m).alias(f"{m}s") for m in ("photo", "video", "audio")], F.sum("file_size").alias("bytes"),
        F.floor(F.sum("file_size") / F.nullif(n, F.lit(0))).alias("average_bytes"),
        F.greatest(F.lit(10), F.least(F.lit(1000), F.floor(n / 100))).cast("long").alias("estimated_buckets"), index.alias("index_kind"),
    )


def coarse_buckets(assets: DataFrame) -> DataFrame:
    """Files of each media type and size category."""
    return assets.groupBy("media_type", size_category("file_size").alias("category")).agg(F.count(_N).alias("n"), F.sum("file_size").alias("bytes"))


def format_statistics(assets: DataFrame, ext: Column) -> DataFrame:
    """Files of each format and the total of its media type."""
    each = assets.groupBy(ext.alias("format"), "media_type").agg(F.count(_N).alias("n"))
    return each.withColumn("of_type", F.sum("n").over(Window.partitionBy("media_type")))


def log_counts(log: DataFrame) -> DataFrame:
    """Rows by level and by category in one pass; the other column is null."""
    sets = log.groupingSets([["level"], ["category"]], "level", "category")
    return sets.agg(F.count(_N).alias("n"))


def threshold_suggestion(decisions: DataFrame, keep: int = 1000) -> DataFrame:
    """From the newest decisions, 0.9 if over a fifth are sure but wrong, else 0.7 if over a fifth are unsure but right, else null."""
    recent = decisions.orderBy(F.desc("ts"), F.desc("group_id")).limit(keep)
    n = F.nullif(F.count(_N), F.lit(0))
    wrong = F.count_if(~F.col("accepted") & (F.col("confidence") > 0.8))
    missed = F.count_if(F.col("accepted") & (F.col("confidence") < 0.6))
    return recent.agg(
        F.count(_N).alias("decisions"), wrong.alias("false_positives"), missed.alias("false_negatives"),
        F.when(wrong / n > 0.2, 0.9).when(missed / n > 0.2, 0.7).alias("duplicate_threshold"),
    )


FEEDBACK_TYPES = ("correct", "false_positive", "near_duplicate", "not_duplicate", "preferred_keeper")  # fixed values


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """Rows with a confidence in 0..1 and a known type."""
    return feedback.filter(F.col("confidence").between(0, 1) & F.col("feedback_type").isin(*FEEDBACK_TYPES))


def feedback_metrics(feedback: DataFrame) -> DataFrame:
    """Rates over valid feedback, recommendations and the thresholds that follow."""
    n = F.nullif(F.count(_N), F.lit(0))
    m = valid_feedback(feedback).agg(
        F.count(_N).alias("feedback"), (F.count_if(F.col("feedback_type") == "false_positive") / n).alias("false_positive_rate"),
        (F.count_if(F.col("feedback_type") == "correct") / n).alias("correct_rate"), F.avg("confidence").alias("average_confidence"),
    )
    advice = F.concat_ws(
        "; ", F.when(F.col("false_positive_rate") > 0.1, "raise thresholds"), F.when(F.col("correct_rate") < 0.8, "lower thresholds"), F.when(F.col("average_confidence") < 0.7, "review detection")
    )
    strict = F.col("false_positive_rate") > 0.1
    return m.withColumns({"advice": advice, "image_threshold": F.when(strict, 0.85).otherwise(0.75), "video_threshold": F.when(strict, 0.9).otherwise(0.7)})


def per_operation(samples: DataFrame) -> DataFrame:
    """Runs of each operation, their throughput and durations."""
    rate = F.col("items") / F.nullif(F.col("duration_ms"), F.lit(0.0)) * 1000
    return samples.groupBy("operation").agg(
        F.count(_N).alias("runs"), F.avg(rate).alias("items_per_s"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("best_ms"), F.max("duration_ms").alias("worst_ms")
    )


def budget_issues(samples: DataFrame, items_per_s: float, max_ms: float, max_mb: float) -> DataFrame:
    """One row for each budget that a measurement breaks."""
    rate = F.col("items") / F.nullif(F.col("duration_ms"), F.lit(0.0)) * 1000
    issue = lambda test, kind, actual, limit: F.when(test, F.struct(F.lit(kind).alias("issue"), actual.alias("actual"), F.lit(limit).alias("budget")))
    found = F.array(
        issue(rate < items_per_s, "low_throughput", rate, items_per_s), issue(F.col("duration_ms") > max_ms, "excessive_duration", F.col("duration_ms"), max_ms),
        issue(F.col("memory_mb") > max_mb, "excessive_memory", F.col("memory_mb"), max_mb),
    )
    return samples.select("sample_id", "operation", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("sample_id", "operation", "i.*")


def performance_summary(samples: DataFrame, max_mb: float = 500.0, min_rate: float = 100.0) -> DataFrame:
    """Totals over all measurements and what they advise."""
    rate = F.sum("items") / F.nullif(F.sum("duration_ms"), F.lit(0.0)) * 1000
    m = samples.agg(F.count(_N).alias("operations"), F.avg("duration_ms").alias("avg_ms"), rate.alias("items_per_s"), F.avg("memory_mb").alias("avg_mb"))
    advice = F.concat_ws("; ", F.when(F.col("avg_mb") > max_mb, "memory"), F.when(F.col("items_per_s") < min_rate, "speed"))
    return m.withColumn("advice", advice)


def extraction_stats(assets: DataFrame, ms: Column, fields: Column, ext: Column, slow_ms: float = 10.0, top: int = 10) -> DataFrame:
    """One row a file format among the ``top`` most frequent, with times, slow files, efficiency and grade."""
    rows = assets.select(ext.alias("format"), ms.alias("ms"), fields.alias("fields"))
    each = rows.groupBy("format").agg(
        F.count(_N).alias("n"), F.avg("ms").alias("avg_ms"), F.count_if(F.col("ms") > slow_ms).alias("slow"), F.avg(F.coalesce(F.col("fields") / F.nullif(F.col("ms"), F.lit(0.0)), F.lit(0.0))).alias("efficiency")
    )
    return each.withColumn("grade", grade("avg_ms", "efficiency")).orderBy(F.desc("n"), "format").limit(top)


def extraction_summary(assets: DataFrame, ms: Column, fields: Column, at: Column, slow_ms: float = 10.0) -> DataFrame:
    """Operations, averages, slow ones and the time range in one row; without operations zeros and no range."""
    rows = assets.select(ms.alias("ms"), fields.alias("fields"), at.alias("at"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(
        F.count(_N).alias("operations"), zero(F.avg("ms")).alias("avg_ms"), zero(F.avg("fields")).alias("avg_fields"), zero(F.avg(zero(F.col("fields") / F.nullif(F.col("ms"), F.lit(0.0))))).alias("avg_efficiency"),
        F.count_if(F.col("ms") > slow_ms).alias("slow"), F.lit(slow_ms).alias("slow_ms"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )


def grade(ms: str, efficiency: str) -> Column:
    """C33."""
    out = None
    for most, least, name in ((2.0, 10.0, "excellent"), (5.0, 5.0, "good"), (10.0, 2.0, "acceptable")):  # fixed values
        test = (F.col(ms) <= most) & (F.col(efficiency) >= least)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("needs_optimization")


def size_histogram(assets: DataFrame) -> DataFrame:
    """Files in each of five size categories."""
    return assets.groupBy(size_category("file_size", with_tiny=True).alias("category")).agg(F.count(_N).alias("n"))


def advice_of(cpu: Column, memory: Column, query_ms: Column, hit_rate: Column) -> Column:
    """Names of the rules that a summary breaks."""
    return F.concat_ws("; ", F.when(cpu > 80, "high cpu"), F.when(memory > 1000, "high memory"), F.when(query_ms > 500, "slow queries"), F.when(hit_rate < 0.7, "low hit rate"))


def window_summary(samples: DataFrame, now_s: int, span_s: int = 3600, prefer: str = "detection", other: str = "index") -> DataFrame:
    """Averages of the span before now; query time and hit rate from ``prefer`` rows, from ``other`` rows if there are none."""
    recent = samples.filter((F.col("ts") >= now_s - span_s) & (F.col("ts") <= now_s))
    of = lambda c, kind: F.avg(F.when(F.col("kind") == kind, F.col(c)))
    m = recent.agg(
        F.coalesce(F.avg("cpu"), F.lit(0.0)).alias("cpu"), F.coalesce(F.avg("memory_mb"), F.lit(0.0)).alias("memory_mb"),
        F.coalesce(of("duration_ms", prefer), of("duration_ms", other), F.lit(0.0)).alias("query_ms"), F.coalesce(of("hit_rate", prefer), of("hit_rate", other), F.lit(0.0)).alias("hit_rate"),
    )
    return m.withColumn("advice", advice_of(F.col("cpu"), F.col("memory_mb"), F.col("query_ms"), F.col("hit_rate")))


def trends(samples: DataFrame, value: str, unit: str = "month", order: tuple[str, ...] = ("ts", "sample_id")) -> DataFrame:
    """Average in each hour, day, week (from Monday) or month and its direction.

    The first half of a period's rows is held against the second; the middle row
    of an odd number is in neither. No base, no direction. ``order`` begins with
    the seconds: rows are counted by second, and put in order within one only.
    """
    at = F.date_trunc(unit, F.timestamp_seconds("ts"))
    rows = samples.select(F.unix_timestamp(at).alias("period_s"), F.col(value).alias("v"), *order)
    w = Window.partitionBy("period_s")
    seconds = rows.groupBy("period_s", order[0]).agg(F.count(_N).alias("k"))
    seconds = seconds.withColumns({"before": F.sum("k").over(w.orderBy(order[0])) - F.col("k"), "n": F.sum("k").over(w)}).drop("k")
    rows = rows.join(seconds, ["period_s", order[0]])
    rows = rows.withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("period_s", order[0]).orderBy(*order)))
    half = F.expr("n div 2")
    m = rows.groupBy("period_s").agg(
        F.count(_N).alias("n"), F.avg("v").alias("average"), F.avg(F.when(F.col("r") <= half, F.col("v"))).alias("first"), F.avg(F.when(F.col("r") > F.col("n") - half, F.col("v"))).alias("second")
    )
    change = (F.col("second") - F.col("first")) / F.nullif(F.col("first"), F.lit(0.0))
    direction = F.when(F.col("n") < 2, "stable").when(change.isNull(), None).when(F.abs(change) < 0.05, "stable").when(change > 0.2, "increasing").when(change < -0.2, "decreasing").otherwise("volatile")
    return m.select("period_s", "n", "average", direction.alias("direction"))


def benchmark_statistics(samples: DataFrame) -> DataFrame:
    """Spread of the durations and means of memory and cpu of each configuration; the median is exact at any size (``exact_quantiles``)."""
    spread = samples.groupBy("operation").agg(
        F.count(_N).alias("runs"), F.avg("duration_ms").alias("mean_ms"), F.stddev_samp("duration_ms").alias("stddev_ms"),
        F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.avg("memory_mb").alias("mean_mb"), F.avg("cpu").alias("mean_cpu"),
    )
    middle = exact_quantiles(samples, ["operation"], "duration_ms").select(F.col("operation").alias("of"), F.col("value").alias("median_ms"))
    return spread.join(middle, F.col("operation").eqNullSafe(F.col("of")), "left").drop("of")


def compare_benchmarks(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Latest run of each operation against the latest baseline, improvements in percent."""
    latest = lambda df, p: df.groupBy("operation").agg(F.max(F.struct("ts", "sample_id", "duration_ms", "memory_mb")).alias("t")).select("operation", F.col("t.duration_ms").alias(f"{p}_ms"), F.col("t.memory_mb").alias(f"{p}_mb"))
    j = latest(current, "current").join(latest(baseline, "baseline"), "operation")
    gain = lambda c: (F.col(f"baseline_{c}") - F.col(f"current_{c}")) / F.nullif(F.col(f"baseline_{c}"), F.lit(0.0)) * 100
    return j.select("operation", "current_ms", "baseline_ms", gain("ms").alias("time_gain_pct"), gain("mb").alias("memory_gain_pct"))


_Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576, 0.999: 3.291}  # fixed values


def claims(samples: DataFrame, claim: float, level: float = 0.95, least: int = 1000, z_beta: float = 0.84) -> DataFrame:
    """Mean, spread, confidence interval, p-value, effect and power of each operation's durations against a claimed mean."""
    m = samples.groupBy("operation").agg(F.count(_N).alias("n"), F.avg("duration_ms").alias("mean"), F.coalesce(F.stddev_samp("duration_ms"), F.lit(0.0)).alias("stddev"))
    n, sd = F.col("n"), F.nullif(F.col("stddev"), F.lit(0.0))
    error = F.col("stddev") / F.sqrt(n)
    t = F.abs(F.col("mean") - claim) / (sd / F.sqrt(n))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (1 - F.least(F.lit(1.0), t / F.sqrt(F.nullif(n - 1.0, F.lit(0.0)))))))
    effect = F.abs(F.col("mean") - claim) / sd
    power = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.lit(z_beta) / F.sqrt(n) * (F.lit(_Z[0.95]) / F.nullif(effect, F.lit(0.0)))))
    return m.select(
        "operation", "n", "mean", "stddev", (F.col("mean") - _Z[level] * error).alias("low"), (F.col("mean") + _Z[level] * error).alias("high"), p.alias("p_value"), effect.alias("effect"),
        power.alias("power"), F.coalesce((p < 0.05) & (n >= least), F.lit(False)).alias("significant"),
    )


def claim_report(results: DataFrame, least: int = 1000) -> DataFrame:
    """G39."""
    return results.agg(
        F.count(_N).alias("claims"), F.count_if("significant").alias("significant"), F.count_if(F.col("n") >= least).alias("large_samples"), F.avg("power").alias("average_power"),
        F.bool_and("significant").alias("all_passed"),
    )


def detection_quality(predicted: DataFrame, truth: DataFrame, negatives: int) -> DataFrame:
    """Accuracy, precision, recall and F1 of predicted pairs (a, b); ``negatives`` is the number of pairs in neither."""
    p, t = predicted.select("a", "b").distinct().withColumn("p", F.lit(1)), truth.select("a", "b").distinct().withColumn("t", F.lit(1))
    m = p.join(t, ["a", "b"], "full_outer").agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.select("tp", "fp", "fn", over(tp + negatives, tp + fp + fn + negatives).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))


def threshold_sweep(decisions: DataFrame, low: float = 0.5, high: float = 0.95, step: float = 0.05) -> DataFrame:
    """Quality of "confidence reaches the threshold" as a prediction of accepted, at each threshold; the value is 0.7 F1 + 0.3 accuracy."""
    n = int(round((high - low) / step))
    steps = F.array(*[F.lit(round(low + i * step, 6)) for i in range(n + 1)])
    rows = decisions.groupBy("accepted", "confidence").agg(F.count(_N).alias("k")).withColumn("threshold", F.explode(steps))
    said = F.col("confidence") >= F.col("threshold")
    part = lambda test: F.sum(F.when(test, F.col("k")).otherwise(0))
    m = rows.groupBy("threshold").agg(part(said & F.col("accepted")).alias("tp"), part(said & ~F.col("accepted")).alias("fp"), part(~said & F.col("accepted")).alias("fn"), part(~said & ~F.col("accepted")).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    m = m.withColumns({"f1": f1, "accuracy": (F.col("tp") + F.col("tn")) / total})
    return m.withColumn("value", 0.7 * F.col("f1") + 0.3 * F.col("accuracy"))


def best_threshold(sweep: DataFrame, configured: float = 0.85) -> DataFrame:
    """The threshold of greatest value (the least of equals) and whether it differs from the configured one by over 0.05."""
    top = sweep.agg(F.max_by("threshold", F.struct(F.round("value", 9), -F.col("threshold"))).alias("threshold"))
    return top.withColumn("change", F.abs(F.col("threshold") - configured) > 0.05 + 1e-9)


def confidence_bands(rows: DataFrame) -> DataFrame:
    """Percent of rows in each of four bands of confidence."""
    c = F.col("confidence")
    band = F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").otherwise("very_low")
    n = rows.groupBy(band.alias("band")).agg(F.count(_N).alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


def compare_variants(rows: DataFrame, control: str, variant: str) -> DataFrame:
    """Groups, confidence and effect size of a variant against a control; ``rows`` is (variant, confidence)."""
    m = rows.groupBy("variant").agg(F.count(_N).alias("groups"), F.avg("confidence").alias("mean"), F.var_samp("confidence").alias("var"), F.count_if(F.col("confidence") >= 0.85).alias("high"), F.count_if(F.col("confidence") < 0.6).alias("low"))
    x = m.filter(F.col("variant") == control).select(F.lit(1).alias("k"), *[F.col(c).alias(f"control_{c}") for c in ("groups", "mean", "var", "high", "low")])
    y = m.filter(F.col("variant") == variant).select(F.lit(1).alias("k"), *[F.col(c).alias(f"variant_{c}") for c in ("groups", "mean", "var", "high", "low")])
    pooled = F.sqrt((F.col("control_var") + F.col("variant_var")) / 2)
    return x.join(y, "k").withColumn("effect", (F.col("variant_mean") - F.col("control_mean")) / F.nullif(pooled, F.lit(0.0))).drop("k", "control_var", "variant_var")


def variant_metrics(samples: DataFrame) -> DataFrame:
    """Mean and spread of each variant's durations; the winner is the fastest."""
    m = samples.groupBy("operation").agg(F.avg("duration_ms").alias("mean_ms"), F.stddev_samp("duration_ms").alias("stddev_ms"))
    first = m.agg(F.min(F.struct("mean_ms", "operation")).alias("top")).select(F.col("top.operation").alias("first"), F.lit(True).alias("won"))
    return m.join(first, F.col("operation").eqNullSafe(F.col("first")), "left").select(*m.columns, F.coalesce("won", F.lit(False)).alias("winner"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """G35."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(_N).alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def operation_breakdown(log: DataFrame) -> DataFrame:
    """Count, mean time and records, and success rate: over all, then of each operation."""
    m = log.rollup("operation").agg(F.count(_N).alias("n"), F.avg("duration_ms").alias("avg_ms"), F.avg("items").alias("avg_items"), (F.count_if("ok") / F.count(_N)).alias("success_rate"))
    return m.withColumn("operation", F.coalesce("operation", F.lit("all")))


def folder_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files below each folder, from every ancestor of every path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    own = F.when(F.size(parts) >= 3, above)
    return files.select(F.explode(own).alias("folder"), "size").groupBy("folder").agg(F.sum("size").alias("bytes"), F.count(_N).alias("files"))


def audit_score(violations: DataFrame, records: DataFrame, now_s: int, max_age_s: int = 90 * 86_400, max_uses: int = 1000, by: str = "owner") -> DataFrame:
    """Health of each owner: 1 less 0.1 a weighted violation, less 0.2 of the share of stale records; over 10 violations is flagged and costs 0.5."""
    weight = F.when(F.col("severity") == "critical", 5).when(F.col("severity") == "error", 1).otherwise(0)
    v = violations.groupBy(by).agg(F.sum(weight).alias("violations"))
    stale = (F.lit(now_s) - F.col("created_s") > max_age_s) | (F.col("uses") > max_uses)
    r = records.groupBy(by).agg(F.count(_N).alias("records"), F.count_if(stale).alias("stale"))
    j = r.join(v, by, "left").withColumn("violations", F.coalesce("violations", F.lit(0)).cast("long"))
    score = 1 - F.col("violations") * 0.1 - F.col("stale") / F.col("records") * 0.2 - F.when(F.col("violations") > 10, 0.5).otherwise(0.0)
    return j.withColumns({"flagged": F.col("violations") > 10, "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))})


def cache_statistics(events: DataFrame) -> DataFrame:
    """Hit rate of each tier and mean time of the misses; ``events`` is (tier, hit, ms)."""
    return events.groupBy("tier").agg((F.count_if("hit") / F.count(_N)).alias("hit_rate"), F.avg(F.when(~F.col("hit"), F.col("ms"))).alias("avg_generation_ms"))


def index_statistics(queries: DataFrame, builds: DataFrame, key: str = "index_id") -> DataFrame:
    """Queries, their mean time and candidates, and the mean build time, of each index."""
    q = queries.groupBy(key).agg(F.count(_N).alias("queries"), F.avg("ms").alias("avg_query_ms"), F.avg("candidates").alias("avg_candidates"))
    return q.join(builds.groupBy(key).agg(F.avg("ms").alias("avg_build_ms")), key, "full_outer")


def hot_items(accesses: DataFrame, by: str = "session_id", item: str = "path", order: tuple[str, ...] = ("us", "event_id"), keep: int = 10, least: int = 2, top: int = 5) -> DataFrame:
    """Of each stream's last ``keep`` accesses, the items seen ``least`` times or more, latest first, at most ``top``."""
    last = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    recent = accesses.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= keep)
    hot = recent.groupBy(by, item).agg(F.count(_N).alias("n"), F.min("r").alias("r")).filter(F.col("n") >= least)
    return hot.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("r"))).filter(F.col("rank") <= top).select(by, item, "n", "rank")


