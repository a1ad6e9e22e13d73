"""Queries of section K: the stream operators over the events table as a bounded stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from twinweave.plans import views
from twinweave.plans.scratch import Scratch
from twinweave.plans.session import table
from twinweave.queries import query
from twinweave.sources import tree
from twinweave.sources.keyed_store import KeyedStore
from twinweave.streaming import events as ev

E = views.EVENTS
_US = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


@query("k01_k06_live_counters", f"WITH {E} SELECT us // 3600000000 * 3600000000 AS start_us, kind, count(*) AS n FROM scan_events GROUP BY ALL")
def k06(spark, sf_dir):
    out = ev.live_counters(views.scan_events(spark, sf_dir), "1 hour")
    return out.select(_US("start").alias("start_us"), "kind", "n")


@query(
    "k02_debounced_events",
    f"""WITH {E}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY path ORDER BY us, event_id) < 600000000 THEN 0 ELSE 1 END AS opens FROM scan_events), r AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY us, event_id) AS run FROM g)
        SELECT path, arg_max(kind, (us, event_id)) AS kind, max(us) AS last_us, count(*) AS merged FROM r GROUP BY path, run""",
)
def k02(spark, sf_dir):
    return ev.debounced(views.scan_events(spark, sf_dir), "600 seconds").select("path", "kind", _US("ts").alias("last_us"), "merged")


_CHANGES = """WITH RECURSIVE e AS (
         SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id, event_id % 2 AS q, CAST(floor(value) AS BIGINT) AS size,
                CASE event_type WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'renamed' ELSE 'put' END AS kind FROM events),
       c AS (SELECT c_custkey AS u, CAST(c_nationkey AS BIGINT) AS size FROM customer),
       s AS (
         SELECT coalesce(c.u, x.u) AS u, CAST(0 AS BIGINT) AS k, CAST(c.u AS BIGINT) AS id_p, c.size AS size_p, CAST(NULL AS BIGINT) AS id_q, CAST(NULL AS BIGINT) AS size_q
         FROM c FULL JOIN (SELECT DISTINCT u FROM e) x ON c.u = x.u
         UNION ALL
         SELECT u, k, CASE WHEN q = 0 THEN id_to ELSE id_from END, CASE WHEN q = 0 THEN size_to ELSE size_from END, CASE WHEN q = 0 THEN id_from ELSE id_to END, CASE WHEN q = 0 THEN size_from ELSE size_to END
         FROM (
           SELECT u, k, q, CASE WHEN kind = 'deleted' THEN NULL WHEN kind = 'renamed' AND other IS NOT NULL THEN other ELSE coalesce(own, -1 - event_id) END AS id_to,
                  CASE WHEN kind = 'deleted' THEN NULL ELSE coalesce(size, CASE WHEN kind = 'renamed' AND other IS NOT NULL THEN other_size ELSE own_size END) END AS size_to,
                  CASE WHEN kind = 'renamed' THEN NULL ELSE other END AS id_from, CASE WHEN kind = 'renamed' THEN NULL ELSE other_size END AS size_from
           FROM (SELECT e.*, CASE WHEN q = 0 THEN id_p ELSE id_q END AS own, CASE WHEN q = 0 THEN size_p ELSE size_q END AS own_size, CASE WHEN q = 0 THEN id_q ELSE id_p END AS other, CASE WHEN q = 0 THEN size_q ELSE size_p END AS other_size
                 FROM s JOIN e ON e.u = s.u AND e.k = s.k + 1))),
       l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY u ORDER BY k DESC) = 1)
       SELECT id_p AS id, 'p' || u AS path, size_p AS size FROM l WHERE id_p IS NOT NULL UNION ALL SELECT id_q, 'q' || u, size_q FROM l WHERE id_q IS NOT NULL"""


def _changes(spark, sf_dir):
    """(catalogue, events): customers as known files and events as changes at two paths a user."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "renamed").when(F.col("event_type") == "signup", "created").otherwise("modified")
    at = lambda side: F.concat(F.when(F.col("event_id") % 2 == side, "p").otherwise("q"), F.col("user_id").cast("string"))
    changes = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), at(0).alias("path"), kind.alias("kind"), at(1).alias("old_path"), F.floor("value").cast("long").alias("size"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_nationkey").cast("long").alias("size"))
    return known, changes


@query("k03_applied_changes", _CHANGES)
def k03(spark, sf_dir):
    return ev.apply_changes(*_changes(spark, sf_dir))


@query("k03_stored_changes", _CHANGES)
def k03_stored(spark, sf_dir):
    """K3 as commits to a keyed store: days before the middle of the time, then the others, with each event there twice and the last batch replayed."""
    known, changes = _changes(spark, sf_dir)
    store = KeyedStore(spark, Scratch(spark, "catalog").root, ev.CATALOG, ["path"], 16)
    store.put(known, "changes", 0)
    cut = changes.agg(F.timestamp_micros(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("long"))).first()[0]
    twice = changes.union(changes)
    for number, part in ((1, twice.filter(F.col("ts") < cut)), (2, twice.filter(F.col("ts") >= cut)), (2, twice.filter(F.col("ts") >= cut))):
        ev.commit_changes(store, part, "changes", number)
    return store.read()


@query(
    "k01_listing_changes",
    """WITH d AS (SELECT doc_id AS i, doc_id % 10 AS k, n_chars AS n FROM documents)
       SELECT 'q' || i AS path, 'renamed' AS kind, 'p' || i AS old_path, n AS size FROM d WHERE k = 1
       UNION ALL SELECT 'p' || (i - 4), 'renamed', 'p' || i, n FROM d WHERE k = 4
       UNION ALL SELECT 'p' || i, 'modified', NULL, n + 1 FROM d WHERE k IN (2, 5)
       UNION ALL SELECT 'n' || i, 'created', NULL, n FROM d WHERE k = 6
       UNION ALL SELECT 'p' || i, 'deleted', NULL, NULL FROM d WHERE k = 0 AND i + 4 NOT IN (SELECT i FROM d)
       UNION ALL SELECT 'p' || i, 'deleted', NULL, NULL FROM d WHERE k = 9""",
)
def k01_changes(spark, sf_dir):
    """K1: documents as the files of a folder in two listings: moved, moved onto a file that went, changed in place, saved anew, new and gone."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), (F.col("doc_id") % 10).alias("k"), F.col("n_chars").cast("long").alias("size"))
    name = lambda c, x: F.concat(F.lit(c), x.cast("string"))
    before = d.select(name("p", F.col("i")).alias("path"), name("i", F.col("i")).alias("inode"), "size", F.lit(1).cast("long").alias("modified_s"))
    path = F.when(F.col("k") == 1, name("q", F.col("i"))).when(F.col("k") == 4, name("p", F.col("i") - 4)).otherwise(name("p", F.col("i")))
    inode = F.when(F.col("k") == 5, name("s", F.col("i"))).otherwise(name("i", F.col("i")))
    size = F.col("size") + F.when(F.col("k").isin(2, 5), 1).otherwise(0)
    after = d.filter("k not in (0, 9)").select(path.alias("path"), inode.alias("inode"), size.alias("size"), F.lit(1).cast("long").alias("modified_s"))
    new = d.filter("k = 6").select(name("n", F.col("i")).alias("path"), name("n", F.col("i")).alias("inode"), "size", F.lit(2).cast("long").alias("modified_s"))
    return tree.listing_changes(before, after.unionByName(new), dt.datetime(2024, 1, 1)).select("path", "kind", "old_path", "size")


@query("k04_session_states", f"WITH {E} SELECT session_id, greatest(count(*) FILTER (kind = 'item'), coalesce(max(CAST(floor(value) AS BIGINT)) FILTER (kind = 'finished'), 0)) AS items, count(*) FILTER (kind = 'error') AS errors, arg_max(kind, (us, event_id)) AS phase, max(us) FILTER (kind = 'finished') AS completed_us FROM scan_events GROUP BY session_id")
def k04(spark, sf_dir):
    return ev.session_state(views.scan_events(spark, sf_dir)).select("session_id", "items", "errors", "phase", _US("completed_at").alias("completed_us"))


@query("k04_folder_states", f"WITH {E}, r AS (SELECT '/photos' AS root UNION ALL SELECT '/photos/f' || CAST(n_nationkey AS VARCHAR) FROM nation), h AS (SELECT event_id, kind, arg_max(root, length(root)) AS root FROM (SELECT event_id, kind, path || '/x' AS path FROM scan_events) JOIN r ON starts_with(path, root || '/') GROUP BY ALL) SELECT root, count(*) FILTER (kind = 'item') AS items, count(*) FILTER (kind = 'error') AS errors FROM h GROUP BY root")
def k04b(spark, sf_dir):
    roots = table(spark, sf_dir, "nation").select(F.concat(F.lit("/photos/f"), F.col("n_nationkey").cast("string")).alias("root"))
    roots = roots.union(roots.select(F.lit("/photos").alias("root")).distinct())
    e = views.scan_events(spark, sf_dir).withColumn("path", F.concat("path", F.lit("/x")))
    return ev.folder_state(e, roots)


@query("k04_folder_states_by_session", f"WITH {E}, r AS (SELECT '/photos' AS root UNION ALL SELECT '/photos/f' || CAST(n_nationkey AS VARCHAR) FROM nation), h AS (SELECT session_id, event_id, kind, arg_max(root, length(root)) AS root FROM (SELECT session_id, event_id, kind, path || '/x' AS path FROM scan_events WHERE kind IN ('item', 'error')) JOIN r ON starts_with(path, root || '/') GROUP BY ALL) SELECT session_id, root, count(*) FILTER (kind = 'item') AS items, count(*) FILTER (kind = 'error') AS errors FROM h GROUP BY session_id, root")
def k04c(spark, sf_dir):
    roots = table(spark, sf_dir, "nation").select(F.concat(F.lit("/photos/f"), F.col("n_nationkey").cast("string")).alias("root"))
    roots = roots.union(roots.select(F.lit("/photos").alias("root")).distinct())
    e = views.scan_events(spark, sf_dir).withColumn("path", F.concat("path", F.lit("/x")))
    return ev.folder_state(e, roots, by_session=True)


@query("k05_query_rate", f"WITH {E}, w AS (SELECT (us // 1800000000 - k) * 1800000000 AS start_us FROM scan_events, (SELECT unnest([0, 1]) AS k)) SELECT start_us, round(count(*) / 3600.0::DOUBLE, 9) AS per_second FROM w GROUP BY start_us")
def k05(spark, sf_dir):
    out = ev.query_rate(views.scan_events(spark, sf_dir), "3600 seconds", "1800 seconds", 3600.0)
    return out.select(_US("start").alias("start_us"), F.round("per_second", 9).alias("per_second"))


@query("k07_unchanged_dropped", "SELECT DISTINCT user_id AS path, event_type AS size FROM events")
def k07(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("size"), F.lit(0).alias("modified_s"), F.col("ts").cast("timestamp").alias("ts"))
    return ev.unchanged_dropped(e).select("path", "size")


@query("k08_alerts", f"WITH {views.SAMPLES}, w AS (SELECT ts // 86400 * 86400 AS start_s, avg(cpu) AS cpu, avg(memory_mb) AS memory_mb, avg(duration_ms) AS query_ms, avg(hit_rate) AS hit_rate FROM samples GROUP BY ALL), a AS (SELECT *, concat_ws('; ', CASE WHEN cpu > 80 THEN 'high cpu' END, CASE WHEN memory_mb > 1000 THEN 'high memory' END, CASE WHEN query_ms > 500 THEN 'slow queries' END, CASE WHEN hit_rate < 0.7 THEN 'low hit rate' END) AS advice FROM w) SELECT start_s, round(memory_mb, 2) AS memory_mb, advice FROM a WHERE advice <> ''")
def k08(spark, sf_dir):
    s = views.samples(spark, sf_dir).withColumn("ts", F.timestamp_seconds("ts"))
    return ev.alerts(s, "1 day").select(F.unix_timestamp("start").alias("start_s"), F.round("memory_mb", 2).alias("memory_mb"), "advice")


@query("k09_progress_health", f"WITH {E} SELECT us // 600000000 * 600000000 AS start_us, round(count(*) / 600.0::DOUBLE, 9) AS per_second, count(*) / 600.0::DOUBLE < 0.005 AS slow FROM scan_events WHERE kind = 'item' GROUP BY ALL")
def k09(spark, sf_dir):
    out = ev.progress_health(views.scan_events(spark, sf_dir), "600 seconds", 600.0, 0.005)
    return out.select(_US("start").alias("start_us"), F.round("per_second", 9).alias("per_second"), "slow")
