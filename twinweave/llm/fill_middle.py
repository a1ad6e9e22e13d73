"""Fill-in-middle transformation by secondary sort.

Every text is cut at two places into prefix, middle and suffix. Chunks of its
units (code points) and the markers between the sections are records keyed by
document and place in the output; ``repartitionAndSortWithinPartitions`` brings
them into that order, and a stream of pieces is hashed or written as it passes.
The way back sorts the same pieces by their place in the text: the partitioning
stays, so nothing is shuffled a second time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_UNITS = 16_384
PARTITION_BYTES = 64 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Sections in the order of the output; psm begins with the prefix, spm with the suffix.
_ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Places of sections in the text.
_RANK = {PREFIX: 1, MIDDLE: 2, SUFFIX: 3}


@dataclass(frozen=True)
class Plan:
    """Where and how one text is cut."""

    n: int
    form: str
    first: int
    second: int


def plan_of(doc_id, text: str, seed: int, percent: int, spm_percent: int) -> Plan:
    """Cuts and form of a text from the sha256 of ``seed:doc_id``; a null id hashes as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in _MARKERS) or h3 % 100 >= percent:
        return Plan(n, "plain", n, n)
    return Plan(n, "spm" if h4 % 100 < spm_percent else "psm", first, second)


def _home(key: tuple) -> int:
    """All pieces of a row have one home, whatever their place."""
    return zlib.crc32(key[0].to_bytes(8, "little"))


def _chunks(text: str, start: int, stop: int) -> Iterator[bytes]:
    for k in range(start, stop, CHUNK_UNITS):
        yield text[k : min(k + CHUNK_UNITS, stop)].encode("utf-8", "replace")


def _numbered(index: int, rows: Iterator) -> Iterator[tuple[int, tuple]]:
    """Rows with a number of their own: equal rows stay apart."""
    for k, row in enumerate(rows):
        yield index << 36 | k, row


def _cut(seed: int, percent: int, spm_percent: int) -> Callable:
    def pieces(index: int, rows: Iterator) -> Iterator[tuple[tuple, object]]:
        for uid, (doc_id, text) in _numbered(index, rows):
            text = text or ""
            plan = plan_of(doc_id, text, seed, percent, spm_percent)
            if plan.form == "plain":
                yield (uid, 0, 0), (doc_id, plan.n, plan.form, None, None)
                for k, piece in enumerate(_chunks(text, 0, plan.n)):
                    yield (uid, 1, k), piece
                continue
            yield (uid, 0, 0), (doc_id, plan.n, plan.form, plan.first, plan.second - plan.first)
            spans = {PREFIX: (0, plan.first), MIDDLE: (plan.first, plan.second), SUFFIX: (plan.second, plan.n)}
            for place, marker in enumerate(_ORDERS[plan.form], 1):
                yield (uid, place, 0), marker
                for k, piece in enumerate(_chunks(text, *spans[marker]), 1):
                    yield (uid, place, k), piece

    return pieces


class _Hash:
    """Digest of a stream of pieces."""

    def __init__(self):
        self._sha = hashlib.sha256()
        self.add = self._sha.update

    def value(self) -> str:
        return self._sha.hexdigest()


class _Text:
    """The text that a stream of pieces makes."""

    def __init__(self):
        self._pieces: list[bytes] = []
        self.add = self._pieces.append

    def value(self) -> str:
        return b"".join(self._pieces).decode()


def _write_outputs(sink: type, restoring: bool) -> Callable:
    """Pieces in output order -> a row per document, and for restoring the pieces again, keyed by their place in the text.

    A piece's section is the last marker that passed, so only the output and its form are used.
    """

    def stream(records: Iterator[tuple[tuple, object]]) -> Iterator[tuple[tuple, object]]:
        uid = head = out = None
        for (now, place, k), value in records:
            if now != uid:
                if out is not None:
                    yield (uid, 0, 0), (*head, out.value())
                uid, head, out, section = now, value, sink(), 1
                continue
            if isinstance(value, str):
                section = _RANK[value]
                out.add(value.encode())
                continue
            out.add(value)
            if restoring:
                yield (uid, section, k), value
        if out is not None:
            yield (uid, 0, 0), (*head, out.value())

    return stream


def _write_restored(sink: type) -> Callable:
    """Pieces in the order of the text -> a row per document."""

    def stream(records: Iterator[tuple[tuple, object]]) -> Iterator[tuple]:
        head = out = None
        for (_, place, _), value in records:
            if place:
                out.add(value)
                continue
            if out is not None:
                yield (*head, out.value())
            head, out = value, sink()
        if out is not None:
            yield (*head, out.value())

    return stream


def _sorted(pieces: RDD, partitions: int) -> RDD:
    return pieces.repartitionAndSortWithinPartitions(partitions, _home)


def _partitions(docs: DataFrame, text_col: str) -> int:
    """As many as the session has for shuffles, and so many that each holds about ``PARTITION_BYTES`` of text."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def _in_output_order(docs: DataFrame, id_col: str, text_col: str, seed: int, percent: int, spm_percent: int) -> RDD:
    rows = docs.select(F.col(id_col), F.col(text_col)).rdd
    return _sorted(rows.mapPartitionsWithIndex(_cut(seed, percent, spm_percent)), _partitions(docs, text_col))


def _schema(docs: DataFrame, id_col: str, **last: T.DataType) -> T.StructType:
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
    fields += [T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]
    return T.StructType(fields + [T.StructField(k, v) for k, v in last.items()])


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): the training text of every document.

    ``percent`` of texts are rearranged, ``spm_percent`` of these with the suffix
    first; both lengths are null for plain ones. One row of the result for each
    row of ``docs``: repeated rows and ids aren't merged, and a null id is kept.
    Null texts count as empty and stay plain, as do texts that hold a marker.
    A text of any length passes as chunks of ``CHUNK_UNITS`` code points, and is
    whole only in its own output row. Other columns, of any names, aren't read.
    An empty table gives an empty result.
    """
    rows = _in_output_order(docs, id_col, text_col, seed, percent, spm_percent).mapPartitions(_write_outputs(_Text, False)).values()
    return docs.sparkSession.createDataFrame(rows, _schema(docs, id_col, output=T.StringType()), verifySchema=False)


def restore(outputs: DataFrame, id_col: str = "doc_id", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """(id, text): the texts that ``fill_in_middle`` rearranged, from their outputs and forms alone.

    Null outputs are empty texts. An output that isn't plain and lacks a marker is
    an error. Repeated rows give a row each; other columns aren't read.
    """

    def pieces(index: int, rows: Iterator) -> Iterator[tuple[tuple, object]]:
        for uid, (doc_id, output, form) in _numbered(index, rows):
            output = output or ""
            yield (uid, 0, 0), (doc_id,)
            spans = [(1, 0, len(output))]
            if form != "plain":
                starts = [output.index(m) for m in _ORDERS[form]]
                ends = [*starts[1:], len(output)]
                spans = [(_RANK[m], s + len(m), e) for m, s, e in zip(_ORDERS[form], starts, ends, strict=True)]
            for place, start, stop in spans:
                for k, piece in enumerate(_chunks(output, start, stop)):
                    yield (uid, place, k), piece

    rows = outputs.select(F.col(id_col), F.col(output_col), F.col(form_col)).rdd.mapPartitionsWithIndex(pieces)
    texts = _sorted(rows, _partitions(outputs, output_col)).mapPartitions(_write_restored(_Text))
    schema = T.StructType([T.StructField(id_col, outputs.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return outputs.sparkSession.createDataFrame(texts, schema, verifySchema=False)


def fill_in_middle_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20
) -> DataFrame:
    """``fill_in_middle`` and its way back with sha256 digests in place of texts: ``output_sha256`` and ``restored_sha256``.

    Neither text is ever whole: pieces are hashed in output order, sorted again by
    their place in the text in the same partitions, and hashed again. Nulls,
    repeated rows and other columns are treated as in ``fill_in_middle``.
    """
    pieces = _in_output_order(docs, id_col, text_col, seed, percent, spm_percent)
    again = pieces.mapPartitions(_write_outputs(_Hash, True), preservesPartitioning=True)
    rows = _sorted(again, pieces.getNumPartitions()).mapPartitions(_write_restored(_Hash))
    schema = _schema(docs, id_col, output_sha256=T.StringType(), restored_sha256=T.StringType())
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    """All documents rearranged and restored, as digests."""
    return fill_in_middle_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents
), u AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS y,
    ('0x' || substr(d, 17, 8))::BIGINT % 100 AS z, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS w FROM h
), f AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR z >= 90 THEN 'plain' WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), s AS (
  SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS q FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""
