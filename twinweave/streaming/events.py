"""Operators on streams of scan and file-system events.

Each function takes a streaming or a batch DataFrame with an event-time column
``ts``. State is bounded by a watermark, but for the running totals of
``session_state``; rows later than it are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from twinweave.operators.metrics import advice_of
from twinweave.plans.scratch import Scratch
from twinweave.sources.keyed_store import KeyedStore
from twinweave.streaming.sessions import folder_stream


def _bounded(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def continuous_scan(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """K1: a folder of event files as one stream: what is there first, then what is added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def debounced(events: DataFrame, gap: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """K2: the last event of each path once it has been quiet for ``gap``."""
    e = _bounded(events, delay)
    return e.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("merged"))


def once(events: DataFrame) -> DataFrame:
    """Change events, each of them once: rows of one (ts, event_id) are one event, and of differing ones the least counts.

    An event without an id gets one from its content.
    """
    what = ("path", "kind", "old_path", "size")
    known = F.coalesce("event_id", F.pmod(F.xxhash64("ts", *what), F.lit(1 << 62)))
    return events.groupBy("ts", known.alias("event_id")).agg(F.min(F.struct(*what)).alias("e")).select("ts", "event_id", *(F.col(f"e.{c}").alias(c) for c in what))


def _timeline(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """What happens at each path in order: (path, at, kind, size, id, other, was), ``was`` is whether a file was there before.

    Kinds: init (in the catalogue), put, gone, in and away (the two ends of a
    rename). ``other`` is the old path of an arriving file.
    """
    at = F.struct(F.col("ts"), F.col("event_id"))
    moves = (F.col("kind") == "renamed") & F.col("old_path").isNotNull() & (F.col("old_path") != F.col("path"))
    kind = F.when(moves, "in").when(F.col("kind") == "deleted", "gone").otherwise("put")
    nothing = F.lit(None)
    here = events.select("path", at.alias("at"), kind.alias("kind"), F.col("size"), nothing.cast("long").alias("id"), F.when(moves, F.col("old_path")).alias("other"))
    left = events.filter(moves).select(F.col("old_path").alias("path"), at.alias("at"), F.lit("away").alias("kind"), nothing.cast("long").alias("size"), nothing.cast("long").alias("id"), nothing.cast("string").alias("other"))
    known = catalog.select("path", nothing.cast(events.select(at.alias("at")).schema["at"].dataType).alias("at"), F.lit("init").alias("kind"), "size", "id", nothing.cast("string").alias("other"))
    before = F.lag("kind").over(Window.partitionBy("path").orderBy("at"))
    return known.unionByName(here).unionByName(left).withColumn("was", F.coalesce(before.isin("init", "put", "in"), F.lit(False)))


def apply_changes(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """K3: the catalogue (id, path, size) after file events, in order of (ts, event_id), nulls first.

    Events are (path, kind, old_path, size, ts, event_id), and one that is there
    twice happened once (``once``). ``created`` and
    ``modified`` insert or update the file at a path, ``deleted`` drops it and
    ``renamed`` moves the file of ``old_path``, id and all, to ``path``, in place
    of a file that is there; if none is at ``old_path`` it is as ``modified``. An
    event without a size leaves the size. New files have the id -1 - event_id.

    The time of one file at one path is a stay. A rename links two stays, so a
    stay's id and size are those at the end of its chain, found by halving all
    chains at once; nothing is folded event by event.
    """
    scratch = Scratch(catalog.sparkSession, "changes")
    t = scratch.stash(_timeline(catalog, once(events.filter("path is not null"))), "timeline")
    source = t.filter("kind = 'away'").select(F.col("path").alias("other"), "at", F.col("was").alias("moved"))
    t = t.join(source, ["other", "at"], "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    new = (F.col("kind").isin("put", "in") & ~F.col("was") & ~F.col("moved")).cast("int")
    begins = (F.col("kind") == "init") | F.col("moved") | (new == 1)
    order = Window.partitionBy("path").orderBy("at")
    t = t.withColumn("stay", F.sum(begins.cast("int")).over(order)).withColumn("last", F.lead("kind").over(order).isNull() & F.col("kind").isin("init", "put", "in"))
    t = t.withColumn("id", F.when(new == 1, -1 - F.col("at.event_id")).otherwise(F.col("id")))
    begun = F.when(F.col("moved"), F.struct("other", "at"))
    stays = t.filter("kind <> 'gone' and (kind <> 'away' or was)").groupBy("path", "stay").agg(
        F.max("id").alias("id"), F.max_by("size", F.when(F.col("size").isNotNull(), F.struct(F.col("at").isNotNull(), "at"))).alias("size"),
        F.max(begun).alias("from"), F.max(F.when(F.col("kind") == "away", F.col("at"))).alias("to"), F.max("last").alias("open"),
    )
    stays = scratch.stash(stays, "stays")
    while True:
        # a stay that came from another takes what that one knows, and its origin
        prior = stays.filter("to is not null").select(F.struct(F.col("path").alias("other"), F.col("to").alias("at")).alias("from"), F.col("id").alias("prior_id"), F.col("size").alias("prior_size"), F.col("from").alias("prior_from"))
        joined = stays.join(prior, "from", "left")
        nxt = joined.select("path", "stay", F.coalesce("id", "prior_id").alias("id"), F.coalesce("size", "prior_size").alias("size"), F.col("prior_from").alias("from"), "to", "open")
        nxt = scratch.stash(nxt, "stays")
        scratch.drop(stays)
        stays = nxt
        if stays.filter("from is not null").isEmpty():
            scratch.drop(t)
            return stays.filter("open").select("id", "path", "size")


CATALOG = "id long, path string, size long"


def paths_of(events: DataFrame) -> DataFrame:
    """Paths that events name."""
    return events.select("path").union(events.select(F.col("old_path").alias("path"))).filter("path is not null").distinct()


def commit_changes(store: KeyedStore, events: DataFrame, source: str = "changes", number: int | None = None) -> bool:
    """K3: apply a batch of events to a stored catalogue (``CATALOG`` by path); only buckets of paths that events name are rewritten.

    False if the batch ``number`` of this source was committed before.
    """
    scratch = Scratch(store.spark, "changes")
    batch = scratch.stash(events.select("ts", "event_id", "path", "kind", "old_path", "size"), "events")
    done = store.change(paths_of(batch), lambda before: apply_changes(before, batch), source, number)
    scratch.drop_all()
    return done


def stream_changes(events: DataFrame, store: KeyedStore, checkpoint: str, delay: str = "10 minutes", source: str = "changes") -> DataStreamWriter:
    """K3 as a stream into a stored catalogue; start the writer it returns.

    An event that is delivered again is dropped for as long as the watermark
    remembers it, and one later than ``delay`` is dropped too. Each micro-batch
    is one commit, so a batch that is replayed after a restart changes nothing.
    """
    fresh = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return fresh.writeStream.foreachBatch(lambda df, number: commit_changes(store, df, source, number) and None).option("checkpointLocation", checkpoint)


def surviving(rows: DataFrame, catalog: DataFrame, id_col: str = "file_id") -> DataFrame:
    """K3's cascade: the rows (signatures, metadata) of files that are still in the catalogue. Rows with a null id go."""
    return rows.join(catalog.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")


def touched(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """The catalogue's rows at paths that an event names; the others stay as they are."""
    paths = events.select("path").union(events.select(F.col("old_path").alias("path"))).distinct()
    return catalog.join(paths, "path", "left_semi")


def run_changes(events: DataFrame, read_catalog: Callable[[], DataFrame], write_catalog: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """K3 as a stream: ``write_catalog(gone, put, number)`` for each micro-batch.

    ``gone`` are the rows that the batch's events touch, as they were, and ``put``
    the rows in their place, so that a keyed table is changed there only;
    ``number`` is the batch's, so a repeated batch can be told.
    """

    def batch(df: DataFrame, number: int) -> None:
        before = touched(read_catalog(), df)
        write_catalog(before, apply_changes(before, df), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def session_state(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """K4: items, errors, last phase and end of each session.

    On a stream these are running totals, in update or complete mode, of all
    sessions so far; ``session_stream`` gives each session once and forgets it.
    """
    e = _bounded(events, delay)
    finished = F.col("kind") == "finished"
    items = F.count_if(F.col("kind") == "item")
    total = F.max(F.when(finished, F.floor("value").cast("long")))
    return e.groupBy("session_id").agg(
        F.greatest(items, F.coalesce(total, F.lit(0))).alias("items"), F.count_if(F.col("kind") == "error").alias("errors"), F.max_by("kind", F.struct("ts", "event_id")).alias("phase"),
        F.max(F.when(finished, F.col("ts"))).alias("completed_at"),
    )


def _folders_above(path: str) -> Column:
    """Array of the folders above a path."""
    names = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))
    return F.when(F.size(names) > 1, above).otherwise(F.array().cast("array<string>"))


def folder_state(events: DataFrame, roots: DataFrame, delay: str = "1 hour", by_session: bool = False, silence_s: int = 86_400) -> DataFrame:
    """K4: items and errors below each root; a path belongs to the longest root that it is below.

    Every folder above a path is looked up among the roots by an equi-join. On a
    stream, and with ``by_session``, rows are (session_id, root, items, errors);
    on a stream a session's rows come once it is over (``folder_stream``).
    """
    if events.isStreaming:
        return folder_stream(events, roots, _folders_above("path"), delay, silence_s)
    each = ["session_id"] if by_session else []
    hit = events.filter(F.col("kind").isin("item", "error")) if by_session else events
    hit = hit.select("event_id", "kind", *each, F.explode(_folders_above("path")).alias("root")).join(roots.select("root").distinct(), "root")
    mine = hit.groupBy("event_id", "kind", *each).agg(F.max_by("root", F.length("root")).alias("root"))
    return mine.groupBy(*each, "root").agg(F.count_if(F.col("kind") == "item").alias("items"), F.count_if(F.col("kind") == "error").alias("errors"))


def query_rate(events: DataFrame, width: str = "60 seconds", slide: str = "30 seconds", seconds: float = 60.0, delay: str = "1 minute") -> DataFrame:
    """K5: queries a second in sliding windows."""
    e = _bounded(events, delay)
    return e.groupBy(F.window("ts", width, slide).alias("w")).agg((F.count(F.lit(1)) / seconds).alias("per_second")).select(F.col("w.start").alias("start"), "per_second")


def live_counters(events: DataFrame, width: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """K6: events of each kind in tumbling windows."""
    e = _bounded(events, delay)
    return e.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def unchanged_dropped(events: DataFrame, keys: tuple[str, ...] = ("path", "modified_s", "size"), delay: str = "10 minutes") -> DataFrame:
    """K7: one event for each state of a file, within the watermark on streams."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def alerts(samples: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """K8: windows whose averages break a rule."""
    e = _bounded(samples, delay)
    m = e.groupBy(F.window("ts", width).alias("w")).agg(F.avg("cpu").alias("cpu"), F.avg("memory_mb").alias("memory_mb"), F.avg("duration_ms").alias("query_ms"), F.avg("hit_rate").alias("hit_rate"))
    m = m.withColumn("advice", advice_of(F.col("cpu"), F.col("memory_mb"), F.col("query_ms"), F.col("hit_rate")))
    return m.filter("advice <> ''").select(F.col("w.start").alias("start"), "cpu", "memory_mb", "query_ms", "hit_rate", "advice")


def progress_health(events: DataFrame, width: str = "10 seconds", seconds: float = 10.0, least: float = 10.0, delay: str = "1 minute") -> DataFrame:
    """K9: items a second in each check interval, slow below ``least``."""
    e = _bounded(events.filter(F.col("kind") == "item"), delay)
    m = e.groupBy(F.window("ts", width).alias("w")).agg((F.count(F.lit(1)) / seconds).alias("per_second"))
    return m.select(F.col("w.start").alias("start"), "per_second", (F.col("per_second") < least).alias("slow"))
