"""Merge plans and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("capture_s", "gps_lat", "gps_lon", "camera_model", "keywords")


def merged_metadata(members: DataFrame, chosen: DataFrame, group: str = "group_id") -> DataFrame:
    """One row a group: the keeper's fields, gaps filled from the others in order of id.

    ``chosen`` is (group, keeper_id). Capture time: the earliest of the others;
    GPS and camera: the first that is there; keywords: all, sorted, null if none.
    """
    m = members.join(chosen, group).withColumn("own", F.col("id") == F.col("keeper_id"))
    own = lambda c: F.max(F.when(F.col("own"), F.col(c)))
    first = lambda c, ok: F.min_by(F.when(ok & ~F.col("own"), F.col(c)), F.when(ok & ~F.col("own"), F.col("id")))
    known = lambda c: F.col(c).isNotNull()
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords"))))
    return m.groupBy(group, "keeper_id").agg(
        *[own(c).alias(f"keeper_{c}") for c in FIELDS if c != "keywords"],
        F.max(F.when(F.col("own"), F.array_join("keywords", ","))).alias("keeper_keywords"),
        F.coalesce(own("capture_s"), F.min(F.when(~F.col("own"), F.col("capture_s")))).alias("capture_s"),
        F.coalesce(own("gps_lat"), first("gps_lat", known("gps_lat"))).alias("gps_lat"),
        F.coalesce(own("gps_lon"), first("gps_lon", known("gps_lon"))).alias("gps_lon"),
        F.coalesce(own("camera_model"), first("camera_model", known("camera_model") & (F.col("camera_model") != ""))).alias("camera_model"),
        F.when(F.size(words) > 0, F.array_join(words, ",")).alias("keywords"),
        F.array_sort(F.collect_list(F.when(~F.col("own"), F.col("id")))).alias("removed"),
        F.max(F.col("own").cast("int")).alias("has_keeper"),
    )


def merged_fields(members: DataFrame, chosen: DataFrame, group: str = "group_id") -> DataFrame:
    """J1 without keywords, for groups of any size: one row a group, its fields as in ``merged_metadata``, with the number of files to remove.

    Everything is a partial aggregate of fixed size, so a group of a million
    copies is a few values a task. A group whose keeper isn't a member has
    ``valid`` false.
    """
    m = members.join(chosen, group).withColumn("own", F.col("id") == F.col("keeper_id"))
    out = []
    for c in (f for f in FIELDS if f != "keywords"):
        known = F.col(c).isNotNull() & (F.col(c) != "") if c == "camera_model" else F.col(c).isNotNull()
        own = F.max(F.when(F.col("own"), F.col(c)))
        others = F.min(F.when(~F.col("own"), F.col(c))) if c == "capture_s" else F.min(F.when(known & ~F.col("own"), F.struct("id", c)))[c]
        out += [own.alias(f"keeper_{c}"), F.coalesce(own, others).alias(c)]
    return m.groupBy(group, "keeper_id").agg(*out, F.count_if(~F.col("own")).alias("n_removed"), F.coalesce(F.bool_or("own"), F.lit(False)).alias("valid"))


def merged_keywords(members: DataFrame, chosen: DataFrame, group: str = "group_id") -> DataFrame:
    """I1 as rows: (group, keyword, in_keeper) for each different keyword of a group; nulls are no keywords."""
    m = members.join(chosen, group).select(group, (F.col("id") == F.col("keeper_id")).alias("own"), F.explode("keywords").alias("keyword"))
    return m.filter("keyword is not null").groupBy(group, "keyword").agg(F.bool_or("own").alias("in_keeper"))


def removals(members: DataFrame, chosen: DataFrame, group: str = "group_id") -> DataFrame:
    """J4 as rows: (group, keeper_id, id) for each file to remove of the groups whose keeper is a member."""
    m = members.select(group, "id").join(chosen, group)
    there = m.filter("id = keeper_id").select(group).distinct()
    return m.filter("id <> keeper_id").join(there, group, "left_semi").select(group, "keeper_id", "id")


def removed_names(removed: DataFrame, names: DataFrame, group: str = "group_id") -> DataFrame:
    """E12 as rows: (group, id, name) of the removed files that have a name; ``names`` is (file_id, name)."""
    return removed.join(names.withColumnRenamed("file_id", "id"), "id").select(group, "id", "name")


def field_changes(merged: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, field, old, new, change) for each of the five fields; change is fill or keep."""
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"keeper_{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new")) for c in FIELDS]
    long = merged.select(group, F.explode(F.array(*rows)).alias("f")).select(group, "f.field", "f.old", "f.new")
    differs = F.coalesce("old", F.lit("")) != F.coalesce("new", F.lit(""))
    return long.withColumn("change", F.when(differs, "fill").otherwise("keep"))


def merge_plan(merged: DataFrame, group: str = "group_id") -> DataFrame:
    """Keeper, files to remove, fields that a write would fill, and whether the keeper is a member."""
    writes = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.when(F.col(f"keeper_{c}").isNull(), F.col(c).cast("string"))) for c in FIELDS]))
    filled = F.map_filter(writes, lambda k, v: v.isNotNull())
    return merged.select(
        group, "keeper_id", F.col("removed"), F.size("removed").alias("n_removed"), F.array_sort(F.map_keys(filled)).alias("changed_fields"), (F.col("has_keeper") == 1).alias("valid")
    )


def record(plan: DataFrame, created_s, retention_days: int = 7) -> DataFrame:
    """Transactions of the valid plans with their undo deadline and a snapshot."""
    return plan.filter("valid").select(
        F.col("group_id").alias("id"), "group_id", "keeper_id", "removed", created_s.alias("created_s"), (created_s + retention_days * 86_400).alias("undo_deadline_s"),
        F.to_json(F.struct("keeper_id", "removed", "changed_fields")).alias("snapshot"), F.lit("done").alias("status"), F.lit(None).cast("long").alias("undone_s"),
    )


def undo_candidate(transactions: DataFrame, owner: str = "group_id", depth: int | None = None) -> DataFrame:
    """Latest transaction of each owner that isn't undone; with ``depth``, none for owners with more open ones."""
    open_ = transactions.filter("undone_s is null and status <> 'failed'").groupBy(owner)
    out = open_.agg(F.max(F.struct("created_s", "id")).alias("t"), F.count(F.lit(1)).alias("open"))
    if depth is not None:
        out = out.filter(F.col("open") <= max(1, min(10, depth)))
    return out.select(owner, F.col("t.id").alias("id"), F.col("t.created_s").alias("created_s"), "open")


def redo_candidate(transactions: DataFrame, owner: str = "group_id") -> DataFrame:
    """Transaction of each owner that was undone last; failed ones can't be redone."""
    done = transactions.filter("undone_s is not null and status <> 'failed'").groupBy(owner).agg(F.max(F.struct("undone_s", "id")).alias("t"))
    return done.select(owner, F.col("t.id").alias("id"), F.col("t.undone_s").alias("undone_s"))


def apply_undo(transactions: DataFrame, chosen: DataFrame, now_s: int | None) -> DataFrame:
    """The table with the chosen transactions marked undone at ``now_s``, or with the mark removed (None)."""
    mark = chosen.select(F.col("id").alias("__id")).withColumn("__hit", F.lit(True))
    new = F.when(F.col("__hit"), F.lit(now_s).cast("long")).otherwise(F.col("undone_s"))
    return transactions.join(mark, transactions["id"] == mark["__id"], "left").withColumn("undone_s", new).drop("__id", "__hit")


def mark_failed(transactions: DataFrame, failed: DataFrame) -> DataFrame:
    """Transactions named in ``failed`` get status failed."""
    mark = failed.select(F.col("id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    return transactions.join(mark, transactions["id"] == mark["__id"], "left").withColumn("status", F.when(F.col("__hit"), "failed").otherwise(F.col("status"))).drop("__id", "__hit")


def expired(transactions: DataFrame, now_s: int, retention_days: int = 7) -> DataFrame:
    """Open transactions whose undo deadline has passed."""
    return transactions.filter(F.col("undone_s").isNull() & (F.col("created_s") + retention_days * 86_400 < now_s))


def history(transactions: DataFrame, names: DataFrame, limit_each: int = 100, owner: str = "group_id") -> DataFrame:
    """Newest transactions of each owner with the names of removed files in order; unknown files are left out.

    ``names`` is (file_id, name).
    """
    newest = Window.partitionBy(owner).orderBy(F.desc("created_s"), F.desc("id"))
    recent = transactions.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= limit_each)
    each = recent.select("id", F.posexplode("removed").alias("pos", "file_id")).join(names, "file_id")
    listed = each.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("removed_names"))
    return recent.join(listed, "id", "left").select("id", owner, "created_s", "bytes_freed", F.coalesce(F.array_join("removed_names", ","), F.lit("")).alias("removed_names"))


def reconcile(transactions: DataFrame, states: DataFrame) -> DataFrame:
    """Complete, incomplete or mismatch for each open transaction, with its first offending file.

    ``states`` is (file_id, exists, in_trash). A removed file that still exists
    is incomplete; one that is neither there nor in the trash is a mismatch.
    """
    each = transactions.filter("undone_s is null").select("id", F.posexplode_outer("removed").alias("pos", "file_id")).join(states, "file_id", "left")
    bad = F.when(F.col("file_id").isNull(), None).when(F.col("exists"), "incomplete").when(~F.coalesce("in_trash", F.lit(False)), "mismatch")
    first = F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("pos")))
    out = each.withColumn("bad", bad).groupBy("id").agg(first.alias("state"), F.min_by("file_id", F.when(F.col("bad").isNotNull(), F.col("pos"))).alias("file"))
    return out.select("id", F.coalesce("state", F.lit("complete")).alias("state"), F.when(F.col("state").isNotNull(), F.col("file")).alias("offending_file"))


def reversion_check(original: DataFrame, current: DataFrame, share: float = 0.8) -> DataFrame:
    """Files at least ``share`` of whose fields are back to the original's."""
    both = original.select(F.col("id"), *[F.col(c).cast("string").alias(f"o_{c}") for c in FIELDS]).join(current.select("id", *[F.col(c).cast("string").alias(f"c_{c}") for c in FIELDS]), "id")
    same = sum((F.col(f"o_{c}").eqNullSafe(F.col(f"c_{c}")).cast("int") for c in FIELDS), F.lit(0))
    return both.select("id", (same / len(FIELDS)).alias("matching"), (same / len(FIELDS) >= share).alias("reverted"))


def operation_totals(transactions: DataFrame) -> DataFrame:
    """Operations, bytes freed by those that stand, and the share that succeeded."""
    stands = F.col("undone_s").isNull() & (F.col("status") != "failed")
    return transactions.agg(
        F.count(F.lit(1)).alias("operations"), F.sum(F.when(stands, F.col("bytes_freed")).otherwise(0.0)).alias("bytes_freed"),
        (F.count_if(F.col("status") != "failed") / F.count(F.lit(1))).alias("success_rate"), F.count_if(F.col("undone_s").isNotNull()).alias("undone"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list, keep: int = 1) -> DataFrame:
    """The newest ``keep`` rows of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= keep).drop("__r")
