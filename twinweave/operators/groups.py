"""Duplicate groups and their evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.operators import scoring
from twinweave.operators.components import connected_components
from twinweave.operators.keepers import keepers
from twinweave.operators.pairs import POLICIES, blocked_rows, bucketed, exact_edges, policy_edges, without_pairs
from twinweave.operators.scoring import label
from twinweave.plans.config import Limits, Thresholds, Weights
from twinweave.plans.scratch import Scratch

#: Names of signals for people (fixed values).
LABELS = {
    "checksum": "Checksum", "hash": "Hash Distance", "metadata": "Metadata", "name": "Name", "captureTime": "Capture Date", "fileSize": "File Size",
    "duration": "Duration", "hashMissing": "Hash Missing", "videoSignatureMissing": "Video Signature Missing",
}


def candidate_buckets(assets: DataFrame, t: Thresholds = Thresholds(), least: int = 2) -> DataFrame:
    """G1: buckets of ``least`` files or more with their size and number of pairs."""
    b = bucketed(assets, t).groupBy("media_type", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return b.filter(F.col("n") >= least).withColumn("comparisons", F.expr("n * (n - 1) div 2"))


#: What a bucket's files have in common, by media type (fixed values).
HEURISTICS = {"photo": "image.dimensions+size", "video": "video.duration+resolution", "audio": "audio.duration+size"}


def described_buckets(assets: DataFrame, ignored: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """G1: every bucket, of one file too, with its size, pairs, policy skips and heuristic, in order of bucket.

    A policy skip is a pair of ``ignored`` (a, b in either order) with both files
    in the bucket: the pairs meet the files' buckets at both ends, so no bucket's
    files are listed. A pair that is there twice is one skip.
    """
    b = bucketed(assets, t).select("id", "media_type", "bucket")
    key = ["media_type", "bucket"]
    out = b.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("comparisons", F.expr("n * (n - 1) div 2"))
    if ignored is None:
        out = out.withColumn("skipped_by_policy", F.lit(0).cast("long"))
    else:
        pairs = ignored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        both = pairs.join(b.withColumnRenamed("id", "a"), "a").join(b.withColumnRenamed("id", "b"), ["b", *key])
        out = out.join(both.groupBy(*key).agg(F.count(F.lit(1)).alias("skips")), key, "left").withColumn("skipped_by_policy", F.coalesce("skips", F.lit(0).cast("long")))
    names = F.create_map(*[F.lit(x) for kv in HEURISTICS.items() for x in kv])
    return out.select(*key, "n", "comparisons", "skipped_by_policy", names[F.col("media_type")].alias("heuristic")).orderBy("bucket", "media_type")


def bucket_members(assets: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """G1: (media_type, bucket, pos, id): the members of every bucket, of one file too, in order of (name, created, id)."""
    order = Window.partitionBy("media_type", "bucket").orderBy("file_name", F.col("created_s").asc_nulls_last(), "id")
    return bucketed(assets, t).select("media_type", "bucket", F.row_number().over(order).alias("pos"), "id")


def compared_members(assets: DataFrame, limits: Limits = Limits(), t: Thresholds = Thresholds()) -> DataFrame:
    """Member ids of each bucket that is compared, as an array: those of two files up to the size limit."""
    sized = candidate_buckets(assets, t).filter(F.col("n") <= limits.bucket_size).select("media_type", "bucket")
    members = F.sort_array(F.collect_list(F.struct("pos", "id")))
    return bucket_members(assets, t).join(sized, ["media_type", "bucket"]).groupBy("media_type", "bucket").agg(F.transform(members, lambda x: x["id"]).alias("members"))


#: Codes of the policies in order of text; an edge's rank is its contribution's, then its code's.
_CODES = sorted(code for code, *_ in POLICIES)


def measured_edges(assets: DataFrame, w: Weights = Weights(), t: Thresholds = Thresholds(), limits: Limits = Limits(), ignored: DataFrame | None = None) -> DataFrame:
    """I2 in numbers: checksum, compared and policy edges together, in the columns of ``scoring.EDGE`` and ``policy``, without texts of pairs.

    A policy edge's raw value and contribution are its score over the weight and
    its score; the weight is in ``f0``.
    """
    # read twice: as edges and as pairs that need no comparison
    policy = Scratch(assets.sparkSession, "policy").stash(policy_edges(assets, w), "edges")
    exact = exact_edges(assets)
    if ignored is not None:
        policy, exact = without_pairs(policy, ignored), without_pairs(exact, ignored)
    skip = policy.select("a", "b") if ignored is None else policy.select("a", "b").union(ignored.select("a", "b"))
    rows = blocked_rows(scoring.described(assets), limits, skip, t, carry=scoring.MEASURED)
    compared = scoring.measured(rows.withColumns({"a_media_type": F.col("media_type"), "b_media_type": F.col("media_type")}), w, t)
    compared = compared.select(*scoring.EDGE, F.lit(None).cast("string").alias("policy"))
    types = dict(compared.dtypes)
    other = lambda df, **own: df.select(*[own.get(c, F.lit(None)).cast(types[c]).alias(c) for c in compared.columns])
    one, none = F.lit(1.0), F.lit(0.0)
    e1 = other(exact, a=F.col("a"), b=F.col("b"), kind=F.lit(scoring.EXACT), score=one, penalty=none, r0=one, f0=one)
    e3 = other(policy, a=F.col("a"), b=F.col("b"), kind=F.lit(scoring.POLICY), score=F.col("contribution"), penalty=none, r0=F.col("contribution") / w.policy_bonus, f0=F.lit(w.policy_bonus), policy=F.col("policy"))
    return e1.unionByName(compared).unionByName(e3)


def detection_edges(assets: DataFrame, w: Weights = Weights(), t: Thresholds = Thresholds(), limits: Limits = Limits(), ignored: DataFrame | None = None) -> DataFrame:
    """Checksum, compared and policy edges together, with signals and rationale beside the columns of ``measured_edges``."""
    edges = measured_edges(assets, w, t, limits, ignored)
    signals, lines = scoring.explained(edges, w)
    sig = lambda key, weight, add, note: F.array(F.struct(F.lit(key).alias("key"), F.lit(weight).alias("weight"), F.col("r0").alias("raw"), add.alias("contribution"), note.alias("note")))
    exact, policy = F.col("kind") == scoring.EXACT, F.col("kind") == scoring.POLICY
    signals = F.when(exact, sig("checksum", w.checksum, F.lit(1.0), F.lit("checksum match"))).when(policy, sig("policy", w.policy_bonus, F.col("score"), F.col("policy"))).otherwise(signals)
    lines = F.when(exact, F.array(F.lit("checksum"))).when(policy, F.array("policy")).otherwise(lines)
    return edges.select("a", "b", "score", signals.alias("signals"), "penalty", lines.alias("rationale"), *[c for c in edges.columns if c not in ("a", "b", "score", "penalty")])


def group_members(edges: DataFrame, min_edge_score: float = 0.0) -> DataFrame:
    """(group_id, id) over edges of at least the score; the group's id is its least member."""
    found = connected_components(edges.filter(F.col("score") >= min_edge_score), "a", "b")
    return found.select(F.col("component").alias("group_id"), F.col("node").alias("id"))


def _hash_order(distance: Column, raw: Column) -> Column:
    """A number that is greater for the better hash: a higher raw value; of distances without one, the later text (9, 64, 6, 10)."""
    far = F.when(distance < 10, distance * 11).otherwise(F.floor(distance / 10) * 11 + distance % 10 + 1)
    return F.when(raw > 0, 1000 - distance).otherwise(far).cast("int")


def _distance_of(order: Column) -> Column:
    tens, ones = F.floor(order / 11), order % 11
    return F.when(order > 900, 1000 - order).when(ones == 0, tens).otherwise(tens * 10 + ones - 1).cast("int")


def member_evidence(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, id, confidence, signals): the best signal of each kind over a member's edges.

    confidence is the greater of the clamped sum of signals and penalties, and
    the best edge's score. Everything is one partial aggregate over edge ends
    in the numbers of ``measured_edges``; a factor is one for all edges of a
    kind, so the greatest raw value has the greatest contribution. Of equal ones
    the later note counts. Texts are made once a member.
    """
    places = range(len(scoring.PLACES))
    exact, policy = F.col("kind") == scoring.EXACT, F.col("kind") == scoring.POLICY
    compared = ~exact & ~policy
    # a delta of 2 s at most has the raw value 1 and is the later text if it is greater
    delta = F.when(F.col("delta") <= 2, F.col("delta")).otherwise(-F.col("delta"))
    rank = F.when(policy, F.round(F.col("score") * 1e9).cast("long") * len(_CODES) + F.array_position(F.array(*map(F.lit, _CODES)), F.col("policy")) - 1)
    ends = edges.select(
        F.explode(F.array("a", "b")).alias("id"), "score", "penalty", F.when(compared, F.col("kind")).alias("kind"),
        *[F.when(compared, F.col(f"{x}{i}")).alias(f"{x}{i}") for i in places for x in "rf"],
        F.when(F.col("r1").isNotNull(), _hash_order(F.col("distance"), F.col("r1"))).alias("hash"), F.when(F.col("r4").isNotNull(), delta).alias("delta"),
        F.when(exact, 1).alias("exact"), rank.alias("rank"), F.when(policy, F.col("score")).alias("bonus"), F.when(policy, F.col("r0")).alias("share"),
    )
    most = ["kind", *[f"{x}{i}" for i in places for x in "rf"], "hash", "delta", "exact", "rank", "bonus", "share"]
    best = ends.groupBy("id").agg(F.sum("penalty").alias("penalty"), F.max("score").alias("best_edge"), *[F.max(c).alias(c) for c in most])
    raws = [F.col(f"r{i}") for i in places]
    own = scoring.place_signals(F.col("kind"), raws, [F.col(f"f{i}") * r for i, r in enumerate(raws)], _distance_of(F.col("hash")), F.abs("delta"))
    sig = lambda key, raw, add, note: F.struct(F.lit(key).alias("key"), raw.alias("raw"), add.alias("contribution"), note.alias("note"))
    one = F.lit(1.0)
    own[0] = F.when(F.col("exact") == 1, sig("checksum", one, one, F.lit("checksum match"))).otherwise(own[0])
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("rank") % len(_CODES)).cast("int"))
    own.append(F.when(F.col("rank").isNotNull(), sig("policy", F.col("share"), F.col("bonus"), code)))
    signals = F.transform(F.filter(F.array(*own), lambda x: x.isNotNull()), lambda x: F.struct(x["key"].alias("key"), x["contribution"].alias("contribution"), x["raw"].alias("raw"), x["note"].alias("note")))
    found = members.join(best, "id").select("group_id", "id", "penalty", "best_edge", F.sort_array(signals).alias("signals"))
    adds = F.aggregate("signals", F.lit(0.0), lambda total, x: total + x["contribution"])
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), adds + F.col("penalty")))
    return found.select("group_id", "id", F.greatest(clamped, "best_edge").alias("confidence"), F.when(F.size("signals") > 0, F.col("signals")).alias("signals"))


#: A line's place comes before its contribution in hundredths; checksum and policies follow the places of pictures and of audio.
_PLACE = 10**12


def _group_lines(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, rationale): the different lines of a group's edges, in order; they are numbers until they are told apart."""
    n = len(scoring.PLACES)
    audio, exact, policy = (F.col("kind") == k for k in (scoring.AUDIO, scoring.EXACT, scoring.POLICY))
    line = lambda place, add: F.struct(place.cast("int").alias("place"), add.alias("add"))
    lines = [line(F.when(audio, F.lit(n + i)).otherwise(F.lit(i)), F.col(f"f{i}") * F.col(f"r{i}")) for i in range(n)]
    code = F.array_position(F.array(*map(F.lit, _CODES)), F.col("policy")) + 2 * n
    lines = F.when(exact, F.array(line(F.lit(2 * n), F.lit(0.0)))).when(policy, F.array(line(code, F.lit(0.0)))).otherwise(F.array(*lines))
    of = members.select(F.col("id").alias("a"), "group_id")
    told = edges.select("a", lines.alias("lines")).join(of, "a").select("group_id", F.explode("lines").alias("line")).select("group_id", "line.place", "line.add").filter("add is not null")
    # near a half only the digits as written tell which way it is rounded; that takes long
    x = F.col("add") * 100
    hundredths = F.when(F.abs(x - F.floor(x) - 0.5) < 1e-6, F.round(F.round("add", 2) * 100).cast("long")).otherwise(F.floor(x + 0.5))
    told = told.select("group_id", (F.col("place") * F.lit(_PLACE) + hundredths).alias("line")).distinct()
    keys = [seen for seen, _ in scoring.PLACES] + [heard or "" for _, heard in scoring.PLACES] + ["checksum", *_CODES]
    place = F.expr(f"line div {_PLACE}").cast("int")
    key = F.get(F.array(*map(F.lit, keys)), place)
    text = F.when(place < 2 * n, F.concat(key, F.lit(":"), F.format_string("%.2f", (F.col("line") % _PLACE) / 100.0))).otherwise(key)
    return told.select("group_id", text.alias("line")).groupBy("group_id").agg(F.sort_array(F.collect_list("line")).alias("rationale"))


def group_results(edges: DataFrame, members: DataFrame, evidence: DataFrame, assets: DataFrame, limits: Limits = Limits(), t: Thresholds = Thresholds()) -> DataFrame:
    """One row a group: size, confidence, keeper, rationale, bytes, and whether comparisons were left out."""
    lines = _group_lines(edges, members)
    full = members.join(assets, "id")
    over = candidate_buckets(assets, t).filter((F.col("n") > limits.bucket_size) | (F.col("comparisons") > limits.comparisons_per_bucket))
    partial = bucketed(full, t).join(over.select("media_type", "bucket"), ["media_type", "bucket"], "left_semi").select("group_id").distinct().withColumn("bucket_incomplete", F.lit(True))
    sizes = full.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"), F.sum("file_size").alias("bytes"))
    top = evidence.groupBy("group_id").agg(F.max("confidence").alias("confidence"))
    kept = keepers(full).join(assets.select(F.col("id").alias("keeper_id"), F.col("file_size").alias("keeper_size"), F.col("media_type")), "keeper_id")
    out = sizes.join(top, "group_id").join(lines, "group_id").join(kept, "group_id").join(partial, "group_id", "left")
    return out.select(
        "group_id", "n_members", "confidence", label("confidence", t).alias("label"), "keeper_id", "media_type", "rationale",
        (F.col("bytes") * (F.col("n_members") - 1)).alias("space_reference"), (F.col("bytes") - F.col("keeper_size")).alias("space_reclaimable"),
        F.coalesce("bucket_incomplete", F.lit(False)).alias("bucket_incomplete"),
    )


def with_parity(results: DataFrame, assets: DataFrame, limits: Limits = Limits(), t: Thresholds = Thresholds()) -> DataFrame:
    """Q3: the results with ``incomplete``, which is true of all groups as soon as H10's limits left comparisons out in any bucket.

    ``bucket_incomplete`` says whether it was in a bucket of the group's own files.
    """
    cut = (F.col("n") > limits.bucket_size) | (F.col("comparisons") > limits.comparisons_per_bucket)
    any_cut = not candidate_buckets(assets, t).filter(cut).isEmpty()
    return results.withColumn("incomplete", F.lit(any_cut))


def explained(results: DataFrame, evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row a member and signal of the groups in ``wanted`` (group_id), with the group's rationale and whether the member is kept."""
    of = results.join(wanted.select("group_id").distinct(), "group_id", "left_semi").select("group_id", "keeper_id", "rationale")
    rows = of.join(evidence.select("group_id", "id", "confidence", F.explode_outer("signals").alias("s")), "group_id")
    return rows.select("group_id", "id", (F.col("id") == F.col("keeper_id")).alias("is_keeper"), "confidence", "s.key", "s.contribution", "s.note", "rationale")


def evidence_text(key: Column, contribution: Column, raw: Column, note: Column, media: Column, t: Thresholds = Thresholds()) -> tuple[Column, Column, Column]:
    """(distance, threshold, verdict) of a signal for people."""
    verdict = F.when((contribution > 0.3) | (raw >= 1), "pass").when(contribution > 0.1, "warn").otherwise("fail")
    percent = F.concat(F.floor(raw * 100).cast("string"), F.lit("%"))
    limit = F.when(media == "video", F.lit(t.frame_distance)).otherwise(F.lit(t.image_distance))
    said = F.regexp_extract(F.lower(note), r"distance[=\s]+(\d+)", 1)
    hash_distance = F.when(said != "", said).otherwise(F.floor((1 - raw) * limit).cast("string"))
    seconds = F.regexp_extract(F.lower(note), r"delta[=\s]+([\d.]+)s", 1)
    distance = F.when(key == "checksum", F.when(raw >= 1, "0").otherwise("mismatch")).when(key == "hash", hash_distance)
    distance = distance.when((key == "captureTime") & (seconds != ""), F.concat(seconds, F.lit("s"))).otherwise(percent)
    threshold = F.when(key == "checksum", F.when(raw >= 1, "0").otherwise("match")).when(key == "hash", limit.cast("string"))
    threshold = threshold.when(key.isin("metadata", "name"), "50%").when(key == "captureTime", "5m").when(key == "fileSize", "10%")
    threshold = threshold.when(key == "duration", F.lit(f"{int(t.duration_share * 100)}%")).otherwise("N/A")
    return distance, threshold, verdict


def group_evidence(evidence: DataFrame, media: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Best signal of each kind in a group with C28's texts. ``media`` is (group_id, media_type)."""
    each = evidence.select("group_id", F.explode("signals").alias("s"))
    best = each.groupBy("group_id", F.col("s.key").alias("key")).agg(F.max(F.struct("s.contribution", "s.raw", "s.note")).alias("top")).join(media, "group_id")
    d, h, v = evidence_text(F.col("key"), F.col("top.contribution"), F.col("top.raw"), F.col("top.note"), F.col("media_type"), t)
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return best.select("group_id", "key", F.coalesce(names[F.col("key")], F.initcap("key")).alias("label"), F.col("top.contribution").alias("contribution"), d.alias("distance_text"), h.alias("threshold_text"), v.alias("verdict"))


def penalty_evidence(edges: DataFrame, members: DataFrame, assets: DataFrame) -> DataFrame:
    """A failing row once a group for each kind of penalty that an edge of its members has, in the columns of ``group_evidence``.

    Only a missing image hash and a missing video signature are penalties, so
    the media type of the edge's files says which.
    """
    media = assets.select(F.col("id").alias("a"), F.when(F.col("media_type") == "video", "videoSignatureMissing").otherwise("hashMissing").alias("missing"))
    hit = edges.filter("penalty < 0").select("a").distinct().join(media, "a").join(members.withColumnRenamed("id", "a"), "a").select("group_id", "missing").distinct()
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return hit.select(
        "group_id", F.concat(F.lit("penalty_"), F.col("missing")).alias("key"), names[F.col("missing")].alias("label"), F.lit(None).cast("double").alias("contribution"),
        F.lit("missing").alias("distance_text"), F.lit("required").alias("threshold_text"), F.lit("fail").alias("verdict"),
    )


def detection_metrics(assets: DataFrame, compared: DataFrame, buckets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Files, comparisons made, all possible pairs, reduction in percent, buckets and their average size.

    ``incomplete`` is whether H10's limits left comparisons out in any bucket.
    """
    cut = (F.col("n") > limits.bucket_size) | (F.col("comparisons") > limits.comparisons_per_bucket)
    found = {"assets": (assets, F.count(F.lit(1))), "comparisons": (compared, F.count(F.lit(1))), "buckets": (buckets, F.count(F.lit(1))), "average_bucket": (buckets, F.avg("n")), "cut": (buckets, F.count_if(cut))}
    parts = [df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "value") for name, (df, value) in found.items()]
    of = lambda name, kind="long": F.max(F.when(F.col("name") == name, F.col("value"))).cast(kind).alias(name)
    out = reduce(DataFrame.union, parts).agg(of("assets"), of("comparisons"), of("buckets"), of("average_bucket", "double"), of("cut"))
    out = out.withColumns({"naive": F.expr("assets * (assets - 1) div 2"), "incomplete": F.col("cut") > 0}).drop("cut")
    return out.withColumn("reduction_pct", F.when(F.col("naive") > 0, (1 - F.col("comparisons") / F.col("naive")) * 100).otherwise(0.0))


def calibration(groups: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Groups by label, spread of confidence and what the evidence is made of; rates from 10 groups on."""
    has = lambda key: F.count_if(F.exists("rationale", lambda x: x.startswith(key)))
    n = F.count(F.lit(1))
    return groups.agg(
        n.alias("groups"),
        F.count_if(F.col("confidence") >= t.duplicate).alias("duplicate"),
        F.count_if((F.col("confidence") >= t.similar) & (F.col("confidence") < t.duplicate)).alias("similar"),
        F.count_if(F.col("confidence") < t.similar).alias("different"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        has("checksum").alias("with_checksum"),
        has("hash").alias("with_hash"),
        has("policy").alias("with_policy"),
        has("metadata").alias("with_metadata"),
        F.when(n >= 10, F.count_if(F.col("confidence") >= t.duplicate) / n).alias("duplicate_rate"),
    )


def summary(groups: DataFrame) -> DataFrame:
    """Confidence classes, files and sizes over all groups."""
    c = F.col("confidence")
    return groups.agg(
        F.avg(c).alias("avg_confidence"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"),
        F.sum("n_members").alias("files"), F.avg("n_members").alias("average_size"), F.max("n_members").alias("largest"),
    )


def search_groups(groups: DataFrame, text: str = "", min_confidence: float = 0.0, media_type: str | None = None, enabled: tuple[str, ...] = ()) -> DataFrame:
    """Groups of at least the confidence whose rationale or id holds the text, best search score first."""
    hit = F.lower(F.array_join("rationale", " ")).contains(text.lower()) | F.col("group_id").cast("string").contains(text)
    holds = lambda key: F.exists("rationale", lambda x: x.startswith(key)).cast("int")
    named = sum((holds(k) for k in enabled), F.lit(0))
    out = groups.filter(hit & (F.col("confidence") >= min_confidence))
    if media_type:
        out = out.filter(F.col("media_type") == media_type)
    return out.withColumn("search_score", F.col("confidence") + 0.05 * named).orderBy(F.desc("search_score"), "group_id")
