"""Queries of section J and the history rows of E, G and H."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.operators import keepers, merge
from twinweave.plans import views
from twinweave.plans.scratch import Scratch
from twinweave.plans.session import table
from twinweave.queries import query
from twinweave.queries.lookups import _ORDERS
from twinweave.sources.keyed_store import KeyedStore

A, T = views.ASSETS, views.TRANSACTIONS
_KEPT = f"k AS (SELECT id // 7 AS group_id, first(id ORDER BY {_ORDERS['intelligent']}) AS keeper_id FROM assets GROUP BY id // 7), m AS (SELECT a.*, k.group_id, k.keeper_id, a.id = k.keeper_id AS own FROM assets a JOIN k ON k.group_id = a.id // 7)"
_MERGED = f"""{_KEPT}, g AS (
  SELECT group_id, keeper_id, max(capture_s) FILTER (own) AS keeper_capture_s, max(gps_lat) FILTER (own) AS keeper_gps_lat, max(gps_lon) FILTER (own) AS keeper_gps_lon, max(camera_model) FILTER (own) AS keeper_camera_model,
         max(array_to_string(keywords, ',')) FILTER (own) AS keeper_keywords, coalesce(max(capture_s) FILTER (own), min(capture_s) FILTER (NOT own)) AS capture_s,
         coalesce(max(gps_lat) FILTER (own), first(gps_lat ORDER BY id) FILTER (NOT own AND gps_lat IS NOT NULL)) AS gps_lat,
         coalesce(max(gps_lon) FILTER (own), first(gps_lon ORDER BY id) FILTER (NOT own AND gps_lon IS NOT NULL)) AS gps_lon,
         coalesce(max(camera_model) FILTER (own), first(camera_model ORDER BY id) FILTER (NOT own AND camera_model IS NOT NULL)) AS camera_model,
         nullif(array_to_string(list_sort(list_distinct(flatten(list(keywords) FILTER (keywords IS NOT NULL)))), ','), '') AS keywords, list_sort(list(id) FILTER (NOT own)) AS removed
  FROM m GROUP BY group_id, keeper_id)"""


def _merged(spark, sf_dir):
    members = views.assets(spark, sf_dir).withColumn("group_id", F.expr("id div 7"))
    return merge.merged_metadata(members, keepers.keepers(members, "intelligent"))


@query("i01_j01_merged_metadata", f"WITH {A}, {_MERGED} SELECT group_id, keeper_id, capture_s, round(gps_lat, 6) AS gps_lat, camera_model, keywords FROM g")
def j01(spark, sf_dir):
    return _merged(spark, sf_dir).select("group_id", "keeper_id", "capture_s", F.round("gps_lat", 6).alias("gps_lat"), "camera_model", "keywords")


def _chosen(spark, sf_dir):
    a = views.assets(spark, sf_dir).withColumn("group_id", F.expr("id div 7"))
    return a, keepers.keepers(a, "intelligent").select("group_id", "keeper_id")


@query("j01_merged_fields", f"WITH {A}, {_MERGED} SELECT group_id, keeper_id, capture_s, round(gps_lat, 6) AS gps_lat, camera_model, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed, true AS valid FROM g")
def j01_fields(spark, sf_dir):
    return merge.merged_fields(*_chosen(spark, sf_dir)).select("group_id", "keeper_id", "capture_s", F.round("gps_lat", 6).alias("gps_lat"), "camera_model", "n_removed", "valid")


@query("i01_merged_keywords", f"WITH {A}, {_KEPT} SELECT group_id, keyword, bool_or(own) AS in_keeper FROM (SELECT group_id, own, unnest(keywords) AS keyword FROM m) GROUP BY ALL")
def i01_rows(spark, sf_dir):
    return merge.merged_keywords(*_chosen(spark, sf_dir))


@query("j04_e12_removals", f"WITH {A}, {_KEPT} SELECT group_id, id, file_name AS name FROM m WHERE NOT own")
def j04_rows(spark, sf_dir):
    a, chosen = _chosen(spark, sf_dir)
    return merge.removed_names(merge.removals(a, chosen), a.select(F.col("id").alias("file_id"), F.col("file_name").alias("name")))


@query(
    "j02_c30_field_changes",
    f"WITH {A}, {_MERGED} SELECT group_id, 'capture_s' AS field, CASE WHEN coalesce(CAST(keeper_capture_s AS VARCHAR), '') <> coalesce(CAST(capture_s AS VARCHAR), '') THEN 'fill' ELSE 'keep' END AS change FROM g UNION ALL SELECT group_id, 'camera_model', CASE WHEN coalesce(keeper_camera_model, '') <> coalesce(camera_model, '') THEN 'fill' ELSE 'keep' END FROM g UNION ALL SELECT group_id, 'keywords', CASE WHEN coalesce(keeper_keywords, '') <> coalesce(keywords, '') THEN 'fill' ELSE 'keep' END FROM g UNION ALL SELECT group_id, 'gps_lat', CASE WHEN keeper_gps_lat IS NULL AND gps_lat IS NOT NULL THEN 'fill' ELSE 'keep' END FROM g UNION ALL SELECT group_id, 'gps_lon', CASE WHEN keeper_gps_lon IS NULL AND gps_lon IS NOT NULL THEN 'fill' ELSE 'keep' END FROM g",
)
def j02(spark, sf_dir):
    return merge.field_changes(_merged(spark, sf_dir)).select("group_id", "field", "change")


@query("j03_j05_merge_plans", f"WITH {A}, {_MERGED} SELECT group_id, keeper_id, coalesce(array_to_string(removed, ','), '') AS removed, CAST(coalesce(len(removed), 0) AS INTEGER) AS n_removed, CAST((keeper_capture_s IS NULL AND capture_s IS NOT NULL) AS INTEGER) + CAST((keeper_camera_model IS NULL AND camera_model IS NOT NULL) AS INTEGER) + CAST((keeper_keywords IS NULL AND keywords IS NOT NULL) AS INTEGER) + 2 * CAST((keeper_gps_lat IS NULL AND gps_lat IS NOT NULL) AS INTEGER) AS n_changed, true AS valid FROM g")
def j03(spark, sf_dir):
    p = merge.merge_plan(_merged(spark, sf_dir))
    return p.select("group_id", "keeper_id", F.array_join("removed", ",").alias("removed"), "n_removed", F.size("changed_fields").alias("n_changed"), "valid")


@query("j06_j11_j12_recorded", f"WITH {A}, {_MERGED} SELECT group_id AS id, keeper_id, 1700000000 + group_id AS created_s, 1700604800 + group_id AS undo_deadline_s, 'done' AS status FROM g")
def j06(spark, sf_dir):
    return merge.record(merge.merge_plan(_merged(spark, sf_dir)), 1_700_000_000 + F.col("group_id")).select("id", "keeper_id", "created_s", "undo_deadline_s", "status")


@query("h13_j07_undo_candidates", f"WITH {T} SELECT group_id, arg_max(id, (created_s, id)) AS id, max(created_s) AS created_s, count(*) AS open FROM transactions WHERE undone_s IS NULL AND status <> 'failed' GROUP BY group_id")
def h13(spark, sf_dir):
    return merge.undo_candidate(views.transactions(spark, sf_dir))


@query("j07_guarded_undo", f"WITH {T} SELECT group_id, arg_max(id, (created_s, id)) AS id FROM transactions WHERE undone_s IS NULL AND status <> 'failed' GROUP BY group_id HAVING count(*) <= 3")
def j07(spark, sf_dir):
    return merge.undo_candidate(views.transactions(spark, sf_dir), depth=3).select("group_id", "id")


@query("j07_apply_undo", f"WITH {T}, c AS (SELECT arg_max(id, (created_s, id)) AS id FROM transactions WHERE undone_s IS NULL AND status <> 'failed' GROUP BY group_id) SELECT t.id, CASE WHEN c.id IS NOT NULL THEN 1800000000 ELSE undone_s END AS undone_s FROM transactions t LEFT JOIN c USING (id)")
def j07b(spark, sf_dir):
    t = views.transactions(spark, sf_dir)
    return merge.apply_undo(t, merge.undo_candidate(t), 1_800_000_000).select("id", "undone_s")


@query("h13_j08_redo_candidates", f"WITH {T} SELECT group_id, arg_max(id, (undone_s, id)) AS id, max(undone_s) AS undone_s FROM transactions WHERE undone_s IS NOT NULL AND status <> 'failed' GROUP BY group_id")
def j08(spark, sf_dir):
    return merge.redo_candidate(views.transactions(spark, sf_dir))


@query("j09_mark_failed", f"WITH {T} SELECT id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'failed' ELSE status END AS status FROM transactions")
def j09(spark, sf_dir):
    return merge.mark_failed(views.transactions(spark, sf_dir), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))).select("id", "status")


@query("j07_j09_stored_transactions", f"WITH {T}, c AS (SELECT arg_max(id, (created_s, id)) AS id FROM transactions WHERE undone_s IS NULL AND status <> 'failed' GROUP BY group_id), r AS (SELECT arg_max(id, (undone_s, id)) AS id FROM (SELECT t.id, group_id, status, CASE WHEN c.id IS NOT NULL THEN 1800000000 ELSE undone_s END AS undone_s FROM transactions t LEFT JOIN c USING (id)) WHERE undone_s IS NOT NULL AND status <> 'failed' AND group_id % 2 = 0 GROUP BY group_id) SELECT t.id, CASE WHEN r.id IS NOT NULL THEN NULL WHEN c.id IS NOT NULL THEN 1800000000 ELSE undone_s END AS undone_s, CASE WHEN t.id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'failed' ELSE status END AS status FROM transactions t LEFT JOIN c USING (id) LEFT JOIN r USING (id)")
def j07_stored(spark, sf_dir):
    """J7-J9 as commits to a keyed store: undo of each owner's last, redo for every other owner, failures."""
    store = KeyedStore(spark, Scratch(spark, "transactions").root, "id long, group_id long, created_s long, undone_s long, status string", ["id"], 16)
    store.put(views.transactions(spark, sf_dir), "history", 0)
    undo = merge.undo_candidate(store.read()).select("id")
    store.change(undo, lambda before: merge.apply_undo(before, undo, 1_800_000_000), "history", 1)
    redo = merge.redo_candidate(store.read()).filter("group_id % 2 = 0").select("id")
    store.change(redo, lambda before: merge.apply_undo(before, redo, None), "history", 2)
    failed = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    store.change(failed, lambda before: merge.mark_failed(before, failed), "history", 3)
    return store.read().select("id", "undone_s", "status")


@query(
    "j10_reversion_check",
    f"WITH {A} SELECT a.id, (CAST(a.capture_s IS NOT DISTINCT FROM CASE WHEN a.id % 2 = 0 THEN a.capture_s END AS INTEGER) + 1 + 1 + CAST(a.camera_model IS NOT DISTINCT FROM CASE WHEN a.id % 3 = 0 THEN a.camera_model END AS INTEGER) + 1) / 5.0::DOUBLE AS matching FROM assets a",
)
def j10(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    now = a.withColumns({"capture_s": F.when(F.col("id") % 2 == 0, F.col("capture_s")), "camera_model": F.when(F.col("id") % 3 == 0, F.col("camera_model"))})
    return merge.reversion_check(a, now).select("id", "matching")


@query("j11_expired", f"WITH {T} SELECT id FROM transactions WHERE undone_s IS NULL AND created_s + 604800 < 900000000")
def j11(spark, sf_dir):
    return merge.expired(views.transactions(spark, sf_dir), 900_000_000).select("id")


@query(
    "e12_h15_history",
    f"WITH {T}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY created_s DESC, id DESC) AS r FROM transactions), x AS (SELECT id, unnest(removed) AS f, generate_subscripts(removed, 1) AS pos FROM r WHERE r <= 100) SELECT r.id, group_id, created_s, bytes_freed, coalesce(n.names, '') AS removed_names FROM r LEFT JOIN (SELECT id, string_agg(p_name, ',' ORDER BY pos, p_name) AS names FROM x JOIN part ON p_partkey = f GROUP BY id) n USING (id) WHERE r.r <= 100",
)
def e12(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"))
    return merge.history(views.transactions(spark, sf_dir), names)


@query(
    "e14_reconciliation",
    f"WITH {T}, x AS (SELECT id, unnest(removed) AS f, generate_subscripts(removed, 1) AS pos FROM transactions WHERE undone_s IS NULL), b AS (SELECT id, f, pos, CASE WHEN p_size % 10 = 0 THEN 'incomplete' WHEN p_size % 7 = 0 OR p_size IS NULL THEN 'mismatch' END AS bad FROM x LEFT JOIN part ON p_partkey = f) SELECT t.id, coalesce(first(bad ORDER BY pos) FILTER (bad IS NOT NULL), 'complete') AS state, first(f ORDER BY pos) FILTER (bad IS NOT NULL) AS offending_file FROM transactions t LEFT JOIN b USING (id) WHERE undone_s IS NULL GROUP BY t.id",
)
def e14(spark, sf_dir):
    states = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), (F.col("p_size") % 10 == 0).alias("exists"), (F.col("p_size") % 7 != 0).alias("in_trash"))
    return merge.reconcile(views.transactions(spark, sf_dir), states)


@query("g16_g17_operation_totals", f"WITH {T} SELECT count(*) AS operations, round(sum(CASE WHEN undone_s IS NULL AND status <> 'failed' THEN bytes_freed ELSE 0 END), 2) AS bytes_freed, count(*) FILTER (status <> 'failed') / count(*) AS success_rate, count(*) FILTER (undone_s IS NOT NULL) AS undone FROM transactions")
def g16(spark, sf_dir):
    return views.rounded(merge.operation_totals(views.transactions(spark, sf_dir)).withColumn("bytes_freed", F.round("bytes_freed", 2)), 12)


@query("h14_newest_sessions", f"WITH {T} SELECT id, group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY created_s DESC, id DESC) AS r FROM transactions) WHERE r <= 2")
def h14(spark, sf_dir):
    return merge.latest_per_key(views.transactions(spark, sf_dir), ["group_id"], [F.desc("created_s"), F.desc("id")], 2).select("id", "group_id")
