"""The catalogue of files: upserts, incremental skips and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_scan(listing: DataFrame, catalog: DataFrame, now_s: int, lookback_s: int = 86_400) -> DataFrame:
    """Listed files that aren't in the catalogue, changed since, or were scanned too long ago."""
    c = catalog.select("path", F.col("size").alias("c_size"), F.col("modified_s").alias("c_modified"), "last_scanned_s")
    fresh = (F.col("modified_s") <= F.col("c_modified")) & (F.col("size") == F.col("c_size")) & (F.col("last_scanned_s") >= now_s - lookback_s)
    return listing.join(c, "path", "left").filter(~F.coalesce(fresh, F.lit(False))).select(*listing.columns)


def upsert(catalog: DataFrame, listing: DataFrame, now_s: int) -> DataFrame:
    """The catalogue after a scan; a known file whose size or time changed needs its derived data again."""
    old = catalog.select("path", F.col("size").alias("o_size"), F.col("modified_s").alias("o_modified"), F.col("last_scanned_s").alias("o_scanned"))
    new = listing.select("path", F.col("size").alias("n_size"), F.col("modified_s").alias("n_modified"))
    j = old.join(new, "path", "full_outer")
    changed = F.col("o_size").isNotNull() & F.col("n_size").isNotNull() & ((F.col("o_size") != F.col("n_size")) | (F.col("o_modified") != F.col("n_modified")))
    return j.select(
        "path", F.coalesce("n_size", "o_size").alias("size"), F.coalesce("n_modified", "o_modified").alias("modified_s"),
        F.when(F.col("n_size").isNotNull(), F.lit(now_s)).otherwise(F.col("o_scanned")).cast("long").alias("last_scanned_s"), changed.alias("needs_refresh"),
    )


def last_write_wins(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of the rows of a key, the one with the greatest ``at``."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("t"))
    return top.select(*keys, *[F.col(f"t.{c}").alias(c) for c in rest])


def replace_groups(store: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """A10: member rows after groups are written again: new members that are known files, and the groups that weren't."""
    known = new.join(files.select("id").distinct(), "id", "left_semi")
    return store.join(new.select("group_id").distinct(), "group_id", "left_anti").unionByName(known)


def records(assets: DataFrame, media_type: str | None = None) -> DataFrame:
    """File records, of one media type if given, by path."""
    out = assets if media_type is None else assets.filter(F.col("media_type") == media_type)
    return out.orderBy("folder", "file_name", "id")


def hard_links(files: DataFrame, inode: str = "inode") -> DataFrame:
    """(inode, path, links): the first path of each identity; null identities stand alone."""
    linked = files.filter(F.col(inode).isNotNull()).groupBy(inode).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("links"))
    alone = files.filter(F.col(inode).isNull()).select(F.col(inode), "path", F.lit(1).cast("long").alias("links"))
    return linked.unionByName(alone)


def by_range(assets: DataFrame, column: str, low=None, high=None, media_type: str | None = None, limit: int = 500) -> DataFrame:
    """Rows whose column is in the closed range, open where None, in order of id."""
    out = assets.filter(F.col(column).isNotNull())
    for bound, test in ((low, F.col(column) >= F.lit(low)), (high, F.col(column) <= F.lit(high))):
        out = out if bound is None else out.filter(test)
    out = out if media_type is None else out.filter(F.col("media_type") == media_type)
    return out.orderBy("id").limit(limit)


def by_dimensions(assets: DataFrame, width: int | None, height: int | None, media_type: str, limit: int = 500) -> DataFrame:
    """The first rows of the exact size, then those of the media type, as the limit comes first."""
    out = assets
    for v, c in ((width, "width"), (height, "height")):
        out = out if v is None else out.filter(F.col(c) == v)
    return out.orderBy("id").limit(limit).filter(F.col("media_type") == media_type)


def in_scope(assets: DataFrame, ids: DataFrame | None = None, folder: str | None = None, bucket: str | None = None) -> DataFrame:
    """All rows, or those of an id table, below a folder, or in a bucket."""
    if ids is not None:
        assets = assets.join(ids.select("id").distinct(), "id", "left_semi")
    if folder is not None:
        assets = assets.filter(F.col("folder").startswith(folder))
    return assets if bucket is None else assets.filter(F.col("bucket") == bucket)


def logs(log: DataFrame, low=None, high=None, levels: list[str] | None = None, text: str | None = None) -> DataFrame:
    """(ts, level, category, message) rows in the time range, of the levels, with the text in message or category."""
    out = log if low is None else log.filter(F.col("ts") >= low)
    out = out if high is None else out.filter(F.col("ts") <= high)
    out = out if levels is None else out.filter(F.col("level").isin(levels))
    return out if not text else out.filter(F.lower("message").contains(text.lower()) | F.lower("category").contains(text.lower()))


#: Spans in seconds and sort orders of the operations list (fixed values).
SPANS = {"1h": 3600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000}
SORTS = {"newest": ("created_s", False), "oldest": ("created_s", True), "largest": ("bytes_freed", False), "smallest": ("bytes_freed", True)}


def operations(transactions: DataFrame, now_s: int, span: str = "all", outcome: str | None = None, sort: str = "newest") -> DataFrame:
    """D9."""
    out = transactions if span == "all" else transactions.filter(F.col("created_s") >= now_s - SPANS[span])
    out = out if outcome is None else out.filter(F.col("status") == outcome)
    column, up = SORTS[sort]
    return out.orderBy(F.col(column).asc() if up else F.col(column).desc(), "id")


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``keys``: groups a user ignores, cache entries without a file."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def with_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def interrupted(sessions: DataFrame, owner: str = "user") -> DataFrame:
    """The newest failed or cancelled session of each owner."""
    bad = sessions.filter(F.col("phase").isin("failed", "cancelled"))
    return bad.groupBy(owner).agg(F.max(F.struct("started_s", "session_id")).alias("t")).select(owner, "t.session_id", "t.started_s")


def unsigned(assets: DataFrame, signatures: DataFrame) -> DataFrame:
    """Files without a signature of their path, size and time."""
    return assets.join(signatures.select("path", "size", "modified_s").distinct(), ["path", "size", "modified_s"], "left_anti")


def failure_stats(attempts: DataFrame, ok: Column) -> DataFrame:
    """Attempts, failures, their rate and a warning above 1 %."""
    failed = F.count_if(~ok)
    n = F.count(F.lit(1))
    rate = F.coalesce(failed / F.nullif(n, F.lit(0)), F.lit(0.0))
    return attempts.agg(n.alias("attempted"), failed.alias("failed"), rate.alias("failure_rate"), (rate > 0.01).alias("warn"))


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of an order."""
    return df.orderBy(*order).limit(n)


def ranked(df: DataFrame, keys: list[str], order: list, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def group_files(members: DataFrame, assets: DataFrame) -> DataFrame:
    """The files of each group: ``members`` (group_id, id) with the assets' columns; members without a file are left out."""
    return members.select("group_id", "id").join(assets, "id").select("group_id", *assets.columns)
