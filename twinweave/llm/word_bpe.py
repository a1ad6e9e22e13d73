"""BPE encoding and decoding through a table of distinct words.

Texts are split into words where they lie, in blocks of consecutive documents
that number their own distinct words. The words of all blocks make one table, in
which each is encoded once; its ids go back by position to the blocks that have
it. A block's documents then follow its table through a sort and become ids, and
ids meet their pieces in a join with the vocabulary.

The vocabulary is a public one with byte characters and word ends; no tokenizer
is trained here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.plans.scratch import Scratch

DEFAULT_VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Characters of text and different words of a block: they bound what a task remembers of words.
BLOCK_CHARS = 32_000_000
BLOCK_WORDS = 500_000
_WINDOW = 1_000_000
_SLICE = 1 << 16
_ROW_WORDS = 1 << 18
#: The vocabulary's word pattern and word end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
_WORDS, _DOCS = range(2)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of merges, ids of pieces, and the strings that stand for one id wherever a text has them."""

    ranks: dict[tuple[str, str], int]
    ids: dict[str, int]
    added: dict[str, int]


def load_vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    """Read a tokenizer file, on the driver; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or model["continuing_subword_prefix"] or model["byte_fallback"]:
        raise ValueError("not a BPE vocabulary with word ends")
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
    return Vocabulary(ranks, model["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]})


# words


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin ones for themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()
_WORD = regex.compile(PATTERN)
#: Characters of Latin blocks: of one case mapping and one class in every version of Unicode, and not changed by NFC.
_LATIN = re.compile(r"[\x00-ɏ]*")
_GAP = re.compile(r"[ \n]")


def _library_words() -> Callable[[str], list[str]]:
    """Words by the rules of the tokenizer library's version of Unicode, for texts beyond Latin letters."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    split = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
    return lambda text: [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]


class Splitter:
    """Texts to words: NFC, lower case letter by letter, then the pattern; added strings stay whole."""

    def __init__(self, added: list[str]):
        self.added = re.compile("|".join(f"({re.escape(a)})" for a in sorted(added, key=len, reverse=True))) if added else None
        self.marks = tuple(a[:2] for a in added)
        self.other: Callable[[str], list[str]] | None = None

    def _plain(self, text: str) -> list[str]:
        if _LATIN.fullmatch(text):
            return _WORD.findall(text.lower())
        if self.other is None:
            self.other = _library_words()
        return self.other(text)

    def words(self, text: str) -> list[str]:
        if self.added is None or not any(m in text for m in self.marks):
            return self._plain(text)
        out = []
        for part in self.added.split(text):
            if part:
                out += [part] if self.added.fullmatch(part) else self._plain(part)
        return out

    def windows(self, text: str) -> Iterator[list[str]]:
        """The words of a text of any length, by parts that end at a space or line end, which no word crosses."""
        start = 0
        while start < len(text):
            gap = _GAP.search(text, start + _WINDOW)
            stop = gap.start() if gap else len(text)
            yield self.words(text[start:stop])
            start = stop


def merged(word: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word: pairs of neighbours are joined by rank, of equal ranks the leftmost first."""
    if word in vocabulary.added:
        return [vocabulary.added[word]]
    ranks = vocabulary.ranks
    parts = [_LETTERS[b] for b in word.encode()]
    parts[-1] += WORD_END
    n = len(parts)
    following = list(range(1, n + 1))
    leading = list(range(-1, n - 1))
    heap = [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        after = following[k]
        # a pair that has changed meanwhile has another rank or none
        if not parts[k] or after >= n or ranks.get((parts[k], parts[after])) != rank:
            continue
        parts[k] += parts[after]
        parts[after] = ""
        following[k] = following[after]
        if following[k] < n:
            leading[following[k]] = k
        for left in (leading[k], k):
            if left >= 0 and following[left] < n:
                found = ranks.get((parts[left], parts[following[left]]))
                if found is not None:
                    heapq.heappush(heap, (found, left))
    return [vocabulary.ids[p] for p in parts if p]


# blocks


def _block_number(seq: int) -> int:
    return TaskContext.get().partitionId() << 24 | seq


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32 by planes of their bytes: those of frequent words are small, so the upper planes are nearly empty."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=9).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


class _Numbers(dict):
    """Numbers of things in order of appearance."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def _split_type(id_type: T.DataType) -> T.StructType:
    fields = [("block", T.LongType()), ("kind", T.IntegerType()), ("place", T.LongType()), ("docs", T.ArrayType(id_type)), ("sizes", T.BinaryType()), ("refs", T.BinaryType()), ("words", T.ArrayType(T.StringType()))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _splitting(added: list[str], id_type: T.DataType, block_chars: int, block_words: int) -> Callable:
    """Documents -> packed rows of the numbers of their words, and after each block its words by number."""
    schema = _arrow(_split_type(id_type))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seq, held, place = Splitter(added), 0, 0, 0
        numbers, docs, sizes, refs = _Numbers(), [], [], array("I")

        def documents() -> pa.RecordBatch:
            return _batch(schema, 1, block=[_block_number(seq)], kind=[_DOCS], place=[place], docs=[docs], sizes=[_pack(np.array(sizes))], refs=[_pack(np.frombuffer(refs, np.uint32))])

        def words() -> Iterator[pa.RecordBatch]:
            known = list(numbers)
            for k in range(0, len(known), _SLICE):
                yield _batch(schema, 1, block=[_block_number(seq)], kind=[_WORDS], place=[k], words=[known[k : k + _SLICE]])

        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                text, before = text.as_py() or "", len(refs)
                for found in splitter.windows(text):
                    refs.extend(map(numbers.__getitem__, found))
                docs.append(doc_id.as_py())
                sizes.append(len(refs) - before)
                held += len(text)
                full = held >= block_chars or len(numbers) >= block_words
                if full or len(refs) + len(docs) >= _ROW_WORDS:
                    yield documents()
                    place, docs, sizes, refs = place + 1, [], [], array("I")
                if full:
                    yield from words()
                    numbers.clear()
                    held, seq = 0, seq + 1
        if docs:
            yield documents()
        yield from words()

    return blocks


def split_blocks(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, block_chars: int, scratch: Scratch, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The split, as a table: blocks are numbered where they are made, so they are made once."""
    kind = docs.schema[id_col].dataType
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_splitting(list(vocabulary.added), kind, block_chars, block_words), _split_type(kind))
    return scratch.stash(cut, "blocks", "zstd")


def words_of(blocks: DataFrame) -> DataFrame:
    """(block, place, word): the different words of each block."""
    each = blocks.filter(F.col("kind") == _WORDS).select("block", "place", F.posexplode("words").alias("k", "word"))
    return each.select("block", (F.col("place") + F.col("k")).alias("place"), "word")


_TABLE = "block long, places binary, counts binary, ids binary"


def word_ids(blocks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(block, places, counts, ids): ids of the words of each block, packed by their places.

    All blocks' words are grouped by a shuffle on the word, so each is encoded
    once, and its ids go back to every block and place that it came from.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary's file
    schema = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])

    def packed(block: list[int], place: list[int], ids: list[list[int]]) -> pa.RecordBatch:
        blocks, places = np.array(block), np.array(place)
        order = np.lexsort((places, blocks))
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        rows = []
        for part in np.split(order, cuts):
            rows.append((int(blocks[part[0]]), _pack(places[part]), _pack(np.array([len(ids[k]) for k in part])), _pack(np.array([i for k in part for i in ids[k]]))))
        return _batch(schema, len(rows), **{f.name: [r[k] for r in rows] for k, f in enumerate(schema)})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        block, place, ids = [], [], []
        for batch in batches:
            for word, b, p in _columns(batch, "word", "block", "place"):
                if word != now:
                    now, own = word, merged(word, shared.value)
                block.append(b)
                place.append(p)
                ids.append(own)
            if len(ids) >= _ROW_WORDS:
                yield packed(block, place, ids)
                block, place, ids = [], [], []
        if ids:
            yield packed(block, place, ids)

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = words_of(blocks)
    return words.repartition(n, "word").sortWithinPartitions("word").mapInArrow(encoded, _TABLE)


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(token, piece): one row for each id of the vocabulary."""
    return spark.createDataFrame([(i, p) for p, i in {**vocabulary.ids, **vocabulary.added}.items()], "token int, piece string")


def _in_blocks(*parts: tuple[int, DataFrame]) -> DataFrame:
    """Rows of a block together: its words, its pieces, then its documents in their order."""
    both = None
    for kind, part in parts:
        part = part.withColumn("kind", F.lit(kind))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "block").sortWithinPartitions("block", "kind", "place")


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch[x].to_pylist() for x in names), strict=True)


class _Table:
    """Ids of a block's words by number, from its packed rows."""

    def __init__(self):
        self._parts: list[tuple] = []

    def add(self, places: bytes, counts: bytes, ids: bytes) -> None:
        self._parts.append((_unpack(places), _unpack(counts), _unpack(ids)))

    def close(self) -> None:
        """All words are there: order them by number."""
        empty = np.empty(0, np.int64)
        places, counts, flat = (np.concatenate([empty, *(p[k] for p in self._parts)]).astype(np.int64) for k in range(3))
        starts = np.cumsum(counts) - counts
        order = np.argsort(places)
        if not np.array_equal(places[order], np.arange(len(places))):
            raise ValueError("a block without all of its words")
        self.sizes = counts[order]
        self.flat = flat[np.repeat(starts[order] - (np.cumsum(self.sizes) - self.sizes), self.sizes) + np.arange(len(flat))]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._parts = []

    def words(self) -> list[list[int]]:
        flat = self.flat.tolist()
        return [flat[a : a + n] for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)]

    def ids(self, refs: np.ndarray) -> np.ndarray:
        """Ids of a run of words, by position."""
        sizes = self.sizes[refs]
        return self.flat[np.repeat(self.starts[refs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def encode(
    docs: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(id, token_ids): the ids of every text, one row for each row of ``docs``.

    Null and empty texts and texts of white space have no ids. Repeated rows and
    ids and a null id are kept as they are. A text of any length is split whole;
    a block ends after it if it has ``block_chars`` characters or ``block_words``
    different words. Other columns, of any names, aren't read. An empty table
    gives an empty result.
    """
    vocabulary, scratch = load_vocabulary(vocabulary_path), Scratch(docs.sparkSession, "bpe")
    blocks = split_blocks(docs, vocabulary, id_col, text_col, block_chars, scratch, block_words)
    rows = _in_blocks((_WORDS, word_ids(blocks, vocabulary)), (_DOCS, blocks.filter(F.col("kind") == _DOCS).select("block", "place", "docs", "sizes", "refs")))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    schema = _arrow(out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, names, sizes, refs in _documents(batches):
            for name, part in zip(names, np.split(refs, np.cumsum(sizes)[:-1].astype(np.int64)), strict=True):
                yield _batch(schema, 1, id=[name], token_ids=[table.ids(part)])

    return rows.select("block", "kind", "places", "counts", "ids", "docs", "sizes", "refs").mapInArrow(stream, out).withColumnRenamed("id", id_col)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(table, ids of documents, their numbers of words, numbers of the words) for each row of documents, after its block's table."""
    now = table = None
    ready = False
    for batch in batches:
        for block, kind, places, counts, ids, docs, sizes, refs in _columns(batch, "block", "kind", "places", "counts", "ids", "docs", "sizes", "refs"):
            if block != now:
                now, table, ready = block, _Table(), False
            if kind == _WORDS:
                table.add(places, counts, ids)
                continue
            if not ready:
                table.close()
                ready = True
            yield table, docs, _unpack(sizes), _unpack(refs)


def decode(encoded: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded): pieces of the ids with a space between, as a vocabulary without decoder rules gives them.

    Every id is met with its piece by a join; ids that the vocabulary lacks and null ids have
    none and are left out. Null and empty lists decode to the empty text. Rows
    and other columns are treated as in ``encode``.
    """
    spark = encoded.sparkSession
    key = Scratch(spark, "bpe").stash(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).withColumn("row", F.monotonically_increasing_id()), "ids")
    # tokens of a part of a row meet their pieces as one group, so no list is longer than a slice
    tokens = key.select("row", F.posexplode("ids").alias("place", "token")).withColumn("slice", F.floor(F.col("place") / _SLICE))
    met = tokens.join(F.broadcast(piece_table(spark, load_vocabulary(vocabulary_path))), "token")  # bounded by the vocabulary
    slices = met.groupBy("row", "slice").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("own"))
    texts = slices.select("row", "slice", F.array_join(F.col("own.piece"), " ").alias("part")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slice", "part"))).alias("parts"))
    out = key.select("row", "id").join(texts, "row", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.array_join(F.col("parts.part"), " "), F.lit("")).alias("decoded"))


class _Stream:
    """Digest of parts with a space between."""

    def __init__(self):
        self._sha, self._first = hashlib.sha256(), True

    def add(self, parts: list[bytes]) -> None:
        if parts:
            self._sha.update(b" ".join(parts) if self._first else b" " + b" ".join(parts))
            self._first = False

    def value(self) -> str:
        return self._sha.hexdigest()


def round_trip_digests(
    docs: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``encode`` and of the decoding of its ids, without making either whole.

    Each block gets the ids of its words, so a document crosses the network once,
    as packed numbers of words. Ids meet their pieces where they are: the table
    of pieces is broadcast, as it is bounded by the vocabulary. Rows are treated
    as in ``encode``.
    """
    vocabulary, scratch = load_vocabulary(vocabulary_path), Scratch(docs.sparkSession, "bpe")
    blocks = split_blocks(docs, vocabulary, id_col, text_col, block_chars, scratch, block_words)
    ids = scratch.stash(word_ids(blocks, vocabulary), "ids")
    pieces = docs.sparkSession.sparkContext.broadcast({i: p.encode() for p, i in {**vocabulary.ids, **vocabulary.added}.items()})
    rows = _in_blocks((_WORDS, ids), (_DOCS, blocks.filter(F.col("kind") == _DOCS).select("block", "place", "docs", "sizes", "refs")))
    fields = [("id", docs.schema[id_col].dataType), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    out = T.StructType([T.StructField(n, t) for n, t in fields])
    schema = _arrow(out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, piece_of = None, pieces.value
        for table, names, sizes, refs in _documents(batches):
            if table is not of:
                of, words = table, table.words()
                numerals = [" ".join(map(str, x)).encode() for x in words]
                spelled = [b" ".join([piece_of[i] for i in x]) for x in words]
            done, start = [], 0
            tokens = np.concatenate(([0], np.cumsum(table.sizes[refs])))
            ends = np.cumsum(sizes).astype(np.int64)
            for name, stop in zip(names, ends.tolist(), strict=True):
                a, b = _Stream(), _Stream()
                for k in range(start, stop, _SLICE):
                    part = refs[k : min(k + _SLICE, stop)].tolist()
                    a.add([numerals[r] for r in part])
                    b.add([spelled[r] for r in part])
                done.append((name, int(tokens[stop] - tokens[start]), a.value(), b.value()))
                start = stop
            yield _batch(schema, len(done), **{f.name: [x[k] for x in done] for k, f in enumerate(schema)})

    return rows.select("block", "kind", "places", "counts", "ids", "docs", "sizes", "refs").mapInArrow(stream, out).withColumnRenamed("id", id_col)


def op13_word_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests."""
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
