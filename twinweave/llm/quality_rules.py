"""Document quality rules with cross-document line frequency [native].

Base counters are row-local array expressions. The corpus part hashes the
normalised lines of each document, counts documents for each (host, line),
removes lines above the limit and rejects documents that lose too much.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.words import WORD, bind, unused, words
from twinweave.plans.scratch import Scratch


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate of a host if the texts of more than ``min_texts`` of its documents hold it, however
    large the host is; documents with the same text all count. A document is depleted if fewer than ``keep_words`` words or less than
    ``keep_share`` of its words remain."""

    min_texts: int = 20
    keep_words: int = 20
    keep_share: float = 0.3


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, in O(n log n) for a text of n words."""

    def from_windows(h: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            last = F.size(s) - 1
            again = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"]))
            starts = F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))
            return bind(
                starts,
                # the next window's start or null, which least() skips
                lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.get(p, i + 1) - x, F.lit(3))), F.lit(0), lambda a, x: a + x),
            )

        entries = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(F.array_sort(entries), from_sorted))

    def from_words(v: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))
        return F.when(F.size(v) < 3, F.lit(0)).otherwise(bind(hashes, from_windows))

    return bind(w, from_words).cast("long")


def with_base_counters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for null or empty text.

    Windows are compared by a 64-bit hash within one text. The words are taken
    out of a text once, and all counters of words come from them.
    """
    (found,) = unused(docs, "found")
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    counters = {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": bind(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(found)),
    }
    return docs.withColumn(found, words(text_col)).withColumns(counters).drop(found)


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+|[0-9]+", " "))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col), F.lit("\x00null"))


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def line_verdicts(docs: DataFrame, host_col: str, text_col: str, limits: LineLimits, id_col: str | None = "doc_id") -> DataFrame:
    """(host, text_key, removed_words): words in boilerplate lines of each distinct text that has any.

    All documents of a host count, copies of a text too. Rows of one id are one
    document; a row without an id, or each row if ``id_col`` is None, is one of
    its own. Null host is a host of its own. Lines are hashed once, into a table
    of one row a row of ``docs``; a hot line is summed before it moves.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    per_line = F.transform(
        F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: x.rlike(WORD)),
        lambda x: F.struct(F.xxhash64(_normalised(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("w")),
    )
    own = F.lit(None).cast("long") if id_col is None else F.col(id_col)
    rows = scratch.stash(docs.select(_host(host_col).alias("host"), own.alias("id"), _text_key(text_col).alias("text_key"), per_line.alias("lines")), "rows")
    held = rows.select("host", "id", F.explode(F.array_distinct("lines.line")).alias("line"))
    documents = F.count_distinct("id") + F.count_if(F.col("id").isNull())
    common = held.groupBy("host", "line").agg(documents.alias("n")).filter(F.col("n") > limits.min_texts).select("host", "line")
    texts = rows.select("host", "text_key", "lines").dropDuplicates(["host", "text_key"])
    lines = texts.select("host", "text_key", F.explode("lines").alias("l")).select("host", "text_key", "l.line", "l.w")
    return lines.join(common, ["host", "line"]).groupBy("host", "text_key").agg(F.sum("w").cast("long").alias("removed_words"))


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", limits: LineLimits = LineLimits(), id_col: str | None = "doc_id") -> DataFrame:
    """``docs`` plus the base counters, ``base_failed``, ``removed_words`` and ``kept``.

    Null text counts as empty, and an empty text fails the base rules. A text of
    any length is counted whole. Output columns replace input columns of the same
    names; others of any names are kept. Repeated rows get equal verdicts. A line
    is removed wherever it stands in the document. Documents are told apart by
    ``id_col``; with None each row is a document. An empty table gives an empty
    result.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
    docs = docs.drop(*added)
    host, key = unused(docs, "own_host", "own_text")
    lost = line_verdicts(docs, host_col, text_col, limits, id_col).toDF(host, key, "removed_words")
    scored = with_base_counters(docs.withColumns({host: _host(host_col), key: _text_key(text_col)}), text_col)
    out = scored.join(lost, [host, key], "left")
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < limits.keep_words) | (left < limits.keep_share * F.col("n_words")))
    return (
        out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .select(*docs.columns, *added)
    )


OP10_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Rules over all documents; ``source`` is the host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs).select(*OP10_COLUMNS)


#: Counts a host's distinct texts where the query counts its documents; README has where they differ.
OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM again, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
lines AS (
  SELECT host, t, lower(l) AS raw, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+|[0-9]+', ' ', 'g')) AS line, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT host, t, unnest(lines) AS l FROM (SELECT DISTINCT host, t, lines FROM d))),
common AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT t) > 20),
lost AS (SELECT host, t, sum(w) AS removed FROM lines JOIN common USING (host, line) GROUP BY host, t),
v AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lost USING (host, t))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words)) AS kept
FROM v
"""
