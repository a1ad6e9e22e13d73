"""Queries of G7 and G12-G42: reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.functions.fingerprints import extension
from twinweave.operators import metrics as m
from twinweave.plans import views
from twinweave.plans.session import table
from twinweave.plans.views import rounded
from twinweave.queries import query

A, D, S, E = views.ASSETS, views.DECISIONS, views.SAMPLES, views.EVENTS


@query("g07_hash_statistics", f"WITH {A}, h AS (SELECT id, dhash FROM assets WHERE dhash IS NOT NULL) SELECT 'dHash' AS algorithm, (SELECT count(*) FROM h) AS entries, round(avg(bit_count(xor(x.dhash, y.dhash))), 6) AS average_distance FROM h x JOIN h y ON x.id < y.id")
def g07(spark, sf_dir):
    h = views.assets(spark, sf_dir).select(F.lit("dHash").alias("algorithm"), F.col("dhash").alias("hash"))
    return rounded(m.hash_statistics(h))


@query("g12_dataset_analysis", f"WITH {A} SELECT count(*) AS files, count(*) FILTER (media_type = 'photo') AS photos, count(*) FILTER (media_type = 'video') AS videos, count(*) FILTER (media_type = 'audio') AS audios, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(floor(sum(file_size) / count(*)) AS BIGINT) AS average_bytes, CAST(greatest(10, least(1000, count(*) // 100)) AS BIGINT) AS estimated_buckets, CASE WHEN count(*) > 50000 THEN 'hybrid' ELSE 'balanced' END AS index_kind FROM assets")
def g12(spark, sf_dir):
    return m.dataset_analysis(views.assets(spark, sf_dir))


_CAT = "CASE WHEN file_size < 1048576 THEN 'small' WHEN file_size < 10485760 THEN 'medium' WHEN file_size < 104857600 THEN 'large' ELSE 'xlarge' END"


@query("g13_coarse_buckets", f"WITH {A} SELECT media_type, {_CAT} AS category, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM (SELECT media_type, file_size * 2000 AS file_size FROM assets) GROUP BY ALL")
def g13(spark, sf_dir):
    return m.coarse_buckets(views.assets(spark, sf_dir).withColumn("file_size", F.col("file_size") * 2000))


@query("g14_format_statistics", f"WITH {A} SELECT ut_type AS format, media_type, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY media_type) AS BIGINT) AS of_type FROM assets GROUP BY ut_type, media_type")
def g14(spark, sf_dir):
    return m.format_statistics(views.assets(spark, sf_dir), extension("file_name"))


@query("g18_threshold_suggestion", f"WITH {D}, r AS (SELECT * FROM decisions ORDER BY ts DESC, group_id DESC LIMIT 1000), c AS (SELECT count(*) AS decisions, count(*) FILTER (NOT accepted AND confidence > 0.8) AS false_positives, count(*) FILTER (accepted AND confidence < 0.6) AS false_negatives FROM r) SELECT *, CASE WHEN false_positives / nullif(decisions, 0) > 0.2 THEN 0.9 WHEN false_negatives / nullif(decisions, 0) > 0.2 THEN 0.7 END::DOUBLE AS duplicate_threshold FROM c")
def g18(spark, sf_dir):
    return m.threshold_suggestion(views.decisions(spark, sf_dir))


_FB = "fb AS (SELECT doc_id AS id, CASE CAST(doc_id % 7 AS INTEGER) WHEN 0 THEN 'false_positive' WHEN 1 THEN 'near_duplicate' WHEN 2 THEN 'other' ELSE 'correct' END AS feedback_type, CAST(doc_id % 120 AS DOUBLE) / 100 AS confidence FROM labels)"


def _feedback(spark, sf_dir):
    d = F.col("doc_id") % 7
    kind = F.when(d == 0, "false_positive").when(d == 1, "near_duplicate").when(d == 2, "other").otherwise("correct")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), kind.alias("feedback_type"), ((F.col("doc_id") % 120) / 100.0).alias("confidence"))


@query("g19_feedback_metrics", f"WITH {_FB}, c AS (SELECT count(*) AS feedback, count(*) FILTER (feedback_type = 'false_positive') / count(*) AS false_positive_rate, count(*) FILTER (feedback_type = 'correct') / count(*) AS correct_rate, avg(confidence) AS average_confidence FROM fb WHERE confidence BETWEEN 0 AND 1 AND feedback_type <> 'other') SELECT feedback, round(false_positive_rate, 6) AS false_positive_rate, round(correct_rate, 6) AS correct_rate, round(average_confidence, 6) AS average_confidence, concat_ws('; ', CASE WHEN false_positive_rate > 0.1 THEN 'raise thresholds' END, CASE WHEN correct_rate < 0.8 THEN 'lower thresholds' END, CASE WHEN average_confidence < 0.7 THEN 'review detection' END) AS advice, CASE WHEN false_positive_rate > 0.1 THEN 0.85::DOUBLE ELSE 0.75 END AS image_threshold, CASE WHEN false_positive_rate > 0.1 THEN 0.9::DOUBLE ELSE 0.7 END AS video_threshold FROM c")
def g19(spark, sf_dir):
    return rounded(m.feedback_metrics(_feedback(spark, sf_dir)))


@query("g20_valid_feedback", f"WITH {_FB} SELECT id FROM fb WHERE confidence BETWEEN 0 AND 1 AND feedback_type <> 'other'")
def g20(spark, sf_dir):
    return m.valid_feedback(_feedback(spark, sf_dir)).select("id")


_RATE = "items / nullif(duration_ms, 0) * 1000"


@query("g21_per_operation", f"WITH {S} SELECT operation, count(*) AS runs, round(avg({_RATE}), 6) AS items_per_s, round(avg(duration_ms), 6) AS avg_ms, round(min(duration_ms), 6) AS best_ms, round(max(duration_ms), 6) AS worst_ms FROM samples GROUP BY operation")
def g21(spark, sf_dir):
    return rounded(m.per_operation(views.samples(spark, sf_dir)))


@query("g22_budget_issues", f"WITH {S} SELECT sample_id, 'low_throughput' AS issue FROM samples WHERE {_RATE} < 60 UNION ALL SELECT sample_id, 'excessive_duration' FROM samples WHERE duration_ms > 900 UNION ALL SELECT sample_id, 'excessive_memory' FROM samples WHERE memory_mb > 1800")
def g22(spark, sf_dir):
    return m.budget_issues(views.samples(spark, sf_dir), 60.0, 900.0, 1800.0).select("sample_id", "issue")


@query("g23_performance_summary", f"WITH {S}, c AS (SELECT count(*) AS operations, avg(duration_ms) AS avg_ms, sum(items) / nullif(sum(duration_ms), 0) * 1000 AS items_per_s, avg(memory_mb) AS avg_mb FROM samples) SELECT operations, round(avg_ms, 4) AS avg_ms, round(items_per_s, 4) AS items_per_s, round(avg_mb, 4) AS avg_mb, concat_ws('; ', CASE WHEN avg_mb > 500 THEN 'memory' END, CASE WHEN items_per_s < 100 THEN 'speed' END) AS advice FROM c")
def g23(spark, sf_dir):
    return rounded(m.performance_summary(views.samples(spark, sf_dir)), 4)


@query("g24_extraction_stats", f"WITH {A}, r AS (SELECT ut_type AS format, CAST(file_size % 20 AS DOUBLE) AS ms, CAST(id % 9 AS DOUBLE) AS fields FROM assets), g AS (SELECT format, count(*) AS n, avg(ms) AS avg_ms, count(*) FILTER (ms > 10) AS slow, avg(coalesce(fields / nullif(ms, 0), 0)) AS efficiency FROM r GROUP BY format) SELECT format, n, round(avg_ms, 6) AS avg_ms, slow, round(efficiency, 6) AS efficiency, CASE WHEN avg_ms <= 2 AND efficiency >= 10 THEN 'excellent' WHEN avg_ms <= 5 AND efficiency >= 5 THEN 'good' WHEN avg_ms <= 10 AND efficiency >= 2 THEN 'acceptable' ELSE 'needs_optimization' END AS grade FROM g ORDER BY n DESC, format LIMIT 10")
def g24(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    return rounded(m.extraction_stats(a, (F.col("file_size") % 20).cast("double"), (F.col("id") % 9).cast("double"), F.col("ut_type")))


@query("g24_extraction_summary", f"WITH {A}, r AS (SELECT CAST(file_size % 20 AS DOUBLE) AS ms, CAST(id % 9 AS DOUBLE) AS fields, modified_s FROM assets) SELECT count(*) AS operations, round(avg(ms), 6) AS avg_ms, round(avg(fields), 6) AS avg_fields, round(avg(coalesce(fields / nullif(ms, 0), 0)), 6) AS avg_efficiency, count(*) FILTER (ms > 10) AS slow, 10.0::DOUBLE AS slow_ms, min(modified_s) AS first_at, max(modified_s) AS last_at FROM r")
def g24c(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    return rounded(m.extraction_summary(a, (F.col("file_size") % 20).cast("double"), (F.col("id") % 9).cast("double"), F.col("modified_s")))


@query("g24_size_histogram", f"WITH {A} SELECT CASE WHEN file_size < 1024 THEN 'tiny' WHEN file_size < 1048576 THEN 'small' ELSE 'medium' END AS category, count(*) AS n FROM assets GROUP BY ALL")
def g24b(spark, sf_dir):
    return m.size_histogram(views.assets(spark, sf_dir))


@query("g25_window_summary", f"WITH {S}, w AS (SELECT *, CASE WHEN operation LIKE 'op-A%' THEN 'detection' WHEN operation LIKE 'op-N%' THEN 'index' ELSE 'system' END AS kind FROM samples WHERE ts BETWEEN 850000000 - 8640000 AND 850000000), c AS (SELECT coalesce(avg(cpu), 0) AS cpu, coalesce(avg(memory_mb), 0) AS memory_mb, coalesce(avg(duration_ms) FILTER (kind = 'detection'), avg(duration_ms) FILTER (kind = 'index'), 0) AS query_ms, coalesce(avg(hit_rate) FILTER (kind = 'detection'), avg(hit_rate) FILTER (kind = 'index'), 0) AS hit_rate FROM w) SELECT round(cpu, 4) AS cpu, round(memory_mb, 4) AS memory_mb, round(query_ms, 4) AS query_ms, round(hit_rate, 4) AS hit_rate, concat_ws('; ', CASE WHEN cpu > 80 THEN 'high cpu' END, CASE WHEN memory_mb > 1000 THEN 'high memory' END, CASE WHEN query_ms > 500 THEN 'slow queries' END, CASE WHEN hit_rate < 0.7 THEN 'low hit rate' END) AS advice FROM c")
def g25(spark, sf_dir):
    s = views.samples(spark, sf_dir).withColumn("kind", F.when(F.col("operation").startswith("op-A"), "detection").when(F.col("operation").startswith("op-N"), "index").otherwise("system"))
    return rounded(m.window_summary(s, 850_000_000, 8_640_000), 4)


@query(
    "g26_trends",
    f"""WITH {S}, r AS (SELECT CAST(epoch(date_trunc('month', to_timestamp(ts) AT TIME ZONE 'UTC')) AS BIGINT) AS period_s, duration_ms AS v, ts, sample_id FROM samples), o AS (SELECT *, row_number() OVER (PARTITION BY period_s ORDER BY ts, sample_id) AS k, count(*) OVER (PARTITION BY period_s) AS n FROM r),
        g AS (SELECT period_s, count(*) AS n, avg(v) AS average, avg(v) FILTER (k <= n // 2) AS f, avg(v) FILTER (k > n - n // 2) AS s FROM o GROUP BY period_s)
        SELECT period_s, n, round(average, 4) AS average, CASE WHEN n < 2 THEN 'stable' WHEN f IS NULL OR f = 0 THEN NULL WHEN abs((s - f) / f) < 0.05 THEN 'stable' WHEN (s - f) / f > 0.2 THEN 'increasing' WHEN (s - f) / f < -0.2 THEN 'decreasing' ELSE 'volatile' END AS direction FROM g""",
)
def g26(spark, sf_dir):
    return rounded(m.trends(views.samples(spark, sf_dir), "duration_ms", "month"), 4)


@query("g27_benchmark_statistics", f"WITH {S} SELECT operation, count(*) AS runs, round(avg(duration_ms), 4) AS mean_ms, round(median(duration_ms), 4) AS median_ms, round(stddev_samp(duration_ms), 4) AS stddev_ms, round(min(duration_ms), 4) AS min_ms, round(max(duration_ms), 4) AS max_ms, round(avg(memory_mb), 4) AS mean_mb, round(avg(cpu), 4) AS mean_cpu FROM samples GROUP BY operation")
def g27(spark, sf_dir):
    return rounded(m.benchmark_statistics(views.samples(spark, sf_dir)), 4)


@query("g28_benchmark_comparison", f"WITH {S}, l AS (SELECT operation, ts < 850000000 AS old, arg_max(duration_ms, (ts, sample_id)) AS ms, arg_max(memory_mb, (ts, sample_id)) AS mb FROM samples GROUP BY ALL) SELECT c.operation, round(c.ms, 4) AS current_ms, round(b.ms, 4) AS baseline_ms, round((b.ms - c.ms) / nullif(b.ms, 0) * 100, 4) AS time_gain_pct, round((b.mb - c.mb) / nullif(b.mb, 0) * 100, 4) AS memory_gain_pct FROM l c JOIN l b ON c.operation = b.operation AND NOT c.old AND b.old")
def g28(spark, sf_dir):
    s = views.samples(spark, sf_dir)
    return rounded(m.compare_benchmarks(s.filter("ts >= 850000000"), s.filter("ts < 850000000")), 4)


_CLAIMS = f"""c AS (SELECT operation, count(*) AS n, avg(duration_ms) AS mean, coalesce(stddev_samp(duration_ms), 0) AS sd FROM samples GROUP BY operation),
claims AS (SELECT operation, n, mean, sd AS stddev, mean - 1.96 * sd / sqrt(n) AS low, mean + 1.96 * sd / sqrt(n) AS high, least(1, greatest(0, 2 * (1 - least(1, abs(mean - 380) / (sd / sqrt(n)) / sqrt(n - 1.0::DOUBLE))))) AS p_value, abs(mean - 380) / sd AS effect, greatest(0, least(1, 1 - 0.84::DOUBLE / sqrt(n) * (1.96::DOUBLE / (abs(mean - 380) / sd)))) AS power FROM c)"""


@query("g29_claims", f"WITH {S}, {_CLAIMS} SELECT operation, n, round(mean, 4) AS mean, round(stddev, 4) AS stddev, round(low, 4) AS low, round(high, 4) AS high, round(p_value, 4) AS p_value, round(effect, 4) AS effect, round(power, 4) AS power, p_value < 0.05 AND n >= 1000 AS significant FROM claims")
def g29(spark, sf_dir):
    return rounded(m.claims(views.samples(spark, sf_dir), 380.0), 4)


@query("g39_claim_report", f"WITH {S}, {_CLAIMS} SELECT count(*) AS claims, count(*) FILTER (p_value < 0.05 AND n >= 1000) AS significant, count(*) FILTER (n >= 1000) AS large_samples, round(avg(power), 4) AS average_power, bool_and(p_value < 0.05 AND n >= 1000) AS all_passed FROM claims")
def g39(spark, sf_dir):
    return rounded(m.claim_report(m.claims(views.samples(spark, sf_dir), 380.0)), 4)


@query("g30_detection_quality", "WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linestatus = 'F'), c AS (SELECT count(*) FILTER (p.a IS NOT NULL AND t.a IS NOT NULL) AS tp, count(*) FILTER (t.a IS NULL) AS fp, count(*) FILTER (p.a IS NULL) AS fn FROM p FULL JOIN t ON p.a = t.a AND p.b = t.b) SELECT tp, fp, fn, round((tp + 1000) / (tp + fp + fn + 1000), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def g30(spark, sf_dir):
    pair = lambda df: df.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    li = table(spark, sf_dir, "lineitem")
    return rounded(m.detection_quality(pair(li.filter("l_returnflag = 'R'")), pair(li.filter("l_linestatus = 'F'")), 1000))


_SWEEP = f"{D}, k AS (SELECT round(0.5 + i * 0.05::DOUBLE, 6) AS threshold FROM (SELECT unnest(range(0, 10)) AS i)), c AS (SELECT threshold, count(*) FILTER (confidence >= threshold AND accepted) AS tp, count(*) FILTER (confidence >= threshold AND NOT accepted) AS fp, count(*) FILTER (confidence < threshold AND accepted) AS fn, count(*) FILTER (confidence < threshold AND NOT accepted) AS tn FROM decisions, k GROUP BY threshold), v AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c)"


@query("g31_threshold_sweep", f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, tn, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(0.7 * f1 + 0.3 * accuracy, 6) AS value FROM v")
def g31(spark, sf_dir):
    return rounded(m.threshold_sweep(views.decisions(spark, sf_dir)))


@query("g31_g37_best_threshold", f"WITH {_SWEEP}, b AS (SELECT threshold FROM v ORDER BY round(0.7 * f1 + 0.3 * accuracy, 9) DESC, threshold LIMIT 1) SELECT threshold, abs(threshold - 0.85) > 0.05 + 1e-9 AS change FROM b")
def g37(spark, sf_dir):
    return m.best_threshold(m.threshold_sweep(views.decisions(spark, sf_dir)))


@query("g32_confidence_bands", f"WITH {D} SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'very_low' END AS band, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM decisions GROUP BY ALL")
def g32(spark, sf_dir):
    return rounded(m.confidence_bands(views.decisions(spark, sf_dir)))


@query("g33_compared_variants", f"WITH {D}, v AS (SELECT CASE WHEN accepted THEN 'b' ELSE 'a' END AS variant, count(*) AS groups, avg(confidence) AS mean, var_samp(confidence) AS var, count(*) FILTER (confidence >= 0.85) AS high, count(*) FILTER (confidence < 0.6) AS low FROM decisions GROUP BY ALL) SELECT c.groups AS control_groups, round(c.mean, 6) AS control_mean, c.high AS control_high, c.low AS control_low, t.groups AS variant_groups, round(t.mean, 6) AS variant_mean, t.high AS variant_high, t.low AS variant_low, round((t.mean - c.mean) / nullif(sqrt((c.var + t.var) / 2), 0), 6) AS effect FROM v c JOIN v t ON c.variant = 'a' AND t.variant = 'b'")
def g33(spark, sf_dir):
    d = views.decisions(spark, sf_dir).select(F.when(F.col("accepted"), "b").otherwise("a").alias("variant"), "confidence")
    return rounded(m.compare_variants(d, "a", "b"))


@query("g34_variant_metrics", f"WITH {S}, g AS (SELECT operation, avg(duration_ms) AS mean_ms, stddev_samp(duration_ms) AS stddev_ms FROM samples GROUP BY operation) SELECT operation, round(mean_ms, 4) AS mean_ms, round(stddev_ms, 4) AS stddev_ms, row_number() OVER (ORDER BY mean_ms, operation) = 1 AS winner FROM g")
def g34(spark, sf_dir):
    return rounded(m.variant_metrics(views.samples(spark, sf_dir)), 4)


_TABLES = ("documents", "labels", "events", "orders", "lineitem")


@query("g35_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in _TABLES))
def g35(spark, sf_dir):
    return m.row_counts({t: table(spark, sf_dir, t) for t in _TABLES})


@query("g36_operation_breakdown", f"WITH {S} SELECT coalesce(operation, 'all') AS operation, count(*) AS n, round(avg(duration_ms), 4) AS avg_ms, round(avg(items), 4) AS avg_items, round(count(*) FILTER (duration_ms < 800) / count(*), 4) AS success_rate FROM samples GROUP BY ROLLUP (operation)")
def g36(spark, sf_dir):
    return rounded(m.operation_breakdown(views.samples(spark, sf_dir).withColumn("ok", F.col("duration_ms") < 800)), 4)


@query("g38_folder_sizes", f"WITH {A}, p AS (SELECT string_split(folder || '/' || file_name, '/') AS q, file_size AS size FROM assets), x AS (SELECT array_to_string(q[1:k], '/') AS folder, size FROM (SELECT q, size, unnest(range(2, len(q))) AS k FROM p)) SELECT folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM x GROUP BY folder")
def g38(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    return m.folder_sizes(a.select(F.concat("folder", F.lit("/"), "file_name").alias("path"), F.col("file_size").alias("size")))


@query("g40_audit_scores", "WITH v AS (SELECT user_id AS owner, CAST(sum(CASE WHEN event_type = 'error' THEN 5 WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM events GROUP BY user_id), r AS (SELECT o_custkey AS owner, count(*) AS records, count(*) FILTER (900000000 - epoch(o_orderdate) > 7776000 OR o_orderkey % 2000 > 1000) AS stale FROM orders GROUP BY o_custkey) SELECT owner, records, stale, coalesce(violations, 0) AS violations, coalesce(violations, 0) > 10 AS flagged, round(greatest(0, least(1, 1 - coalesce(violations, 0) * 0.1::DOUBLE - stale / records * 0.2::DOUBLE - CASE WHEN coalesce(violations, 0) > 10 THEN 0.5::DOUBLE ELSE 0 END)), 6) AS score FROM r LEFT JOIN v USING (owner)")
def g40(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "error").otherwise("info")
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), kind.alias("severity"))
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_s"), (F.col("o_orderkey") % 2000).alias("uses"))
    return rounded(m.audit_score(v, r, 900_000_000))


@query("g41_cache_statistics", "SELECT 'tier-' || CAST(user_id % 2 AS VARCHAR) AS tier, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate, round(avg(value) FILTER (event_type <> 'view'), 6) AS avg_generation_ms FROM events GROUP BY ALL")
def g41(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("tier-"), (F.col("user_id") % 2).cast("string")).alias("tier"), (F.col("event_type") == "view").alias("hit"), F.col("value").alias("ms"))
    return rounded(m.cache_statistics(e))


@query("g42_index_statistics", "WITH q AS (SELECT user_id % 10 AS index_id, count(*) AS queries, avg(value) AS q, avg(user_id) AS c FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT user_id % 10 AS index_id, avg(value) AS b FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT index_id, queries, round(q, 6) AS avg_query_ms, round(c, 6) AS avg_candidates, round(b, 6) AS avg_build_ms FROM q FULL JOIN b USING (index_id)")
def g42(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("index_id", F.col("user_id") % 10)
    q = e.filter("event_type = 'view'").select("index_id", F.col("value").alias("ms"), F.col("user_id").alias("candidates"))
    return rounded(m.index_statistics(q, e.filter("event_type = 'purchase'").select("index_id", F.col("value").alias("ms"))))
