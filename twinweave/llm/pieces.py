"""SentencePiece encoding and decoding over a public vocabulary.

An Aho-Corasick automaton over all pieces drives one Viterbi pass: at each
character the output links give every piece that ends there, and each relaxes
the best score of that place. The result is the segmentation with the greatest
sum of piece scores; of equal sums the one with the longer last piece.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
_CACHE = 350_000


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces with scores and ids, the ids of the 256 byte pieces, and the surface bytes of every id."""

    pieces: tuple[tuple[str, float, int], ...]
    byte_ids: tuple[int, ...]
    surfaces: tuple[bytes, ...]


def load_vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    """Read a SentencePiece model file, on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, surfaces = [], {}, []
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            surfaces.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            surfaces.append(b"")
        else:
            pieces.append((p, m.get_score(i), i))
            surfaces.append(p.replace(_SPACE, " ").encode())
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary has no byte pieces, so it can't encode every text")
    return Vocabulary(tuple(pieces), tuple(byte_ids[b] for b in range(256)), tuple(surfaces))


class Automaton:
    """Aho-Corasick over the pieces: transitions, failure links and, for each state, the pieces on its output links."""

    def __init__(self, vocabulary: Vocabulary):
        self.next: list[dict[str, int]] = [{}]
        self.out: list[tuple] = [()]
        for piece, score, pid in vocabulary.pieces:
            state = 0
            for ch in piece:
                if ch not in self.next[state]:
                    self.next[state][ch] = len(self.next)
                    self.next.append({})
                    self.out.append(())
                state = self.next[state][ch]
            self.out[state] = ((len(piece), score, pid),)
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            # own piece first, so longer pieces come before shorter ones
            self.out[state] += self.out[self.fail[state]]
            for ch, child in self.next[state].items():
                f = self.fail[state]
                while f and ch not in self.next[f]:
                    f = self.fail[f]
                self.fail[child] = self.next[f].get(ch, 0)
                queue.append(child)
        # worse than any piece, so bytes are used for characters without one only
        self.byte_score = min(s for _, s, _ in vocabulary.pieces) - 10.0
        self.byte_ids = vocabulary.byte_ids

    def viterbi(self, text: str) -> list[int]:
        nxt, fail, out = self.next, self.fail, self.out
        best, steps, pids = array("d", bytes(8 * len(text) + 8)), array("i", bytes(4 * len(text) + 4)), array("i", bytes(4 * len(text) + 4))
        state = 0
        for i, ch in enumerate(text, 1):
            while state and ch not in nxt[state]:
                state = fail[state]
            state = nxt[state].get(ch, 0)
            # the character's own bytes, unless it is a piece
            top, step, via = best[i - 1] + self.byte_score, 1, -1
            for length, score, pid in out[state]:
                s = best[i - length] + score
                if s > top:
                    top, step, via = s, length, pid
            best[i], steps[i], pids[i] = top, step, via
        ids: list[int] = []
        i = len(text)
        while i:
            pid = pids[i]
            if pid < 0:
                ids.extend(self.byte_ids[b] for b in reversed(text[i - 1].encode()))
            else:
                ids.append(pid)
            i -= steps[i]
        ids.reverse()
        return ids


class Encoder:
    """Whole texts to ids and back.

    No piece has a space mark after another character, nor the break characters
    at all, so the best segmentation of a text is that of its parts between such
    places; frequent parts are remembered up to a bound.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = Automaton(vocabulary)
        self.surfaces = vocabulary.surfaces
        self.byte_ids = vocabulary.byte_ids
        used = {ch for p, _, _ in vocabulary.pieces for ch in p}
        inner = any(_SPACE in p.lstrip(_SPACE) for p, _, _ in vocabulary.pieces)
        breaks = "".join(c for c in "\n\r\t" if c not in used)
        self.part = re.compile(".+" if inner else f" *[^ {breaks}{_SPACE}]+| +|[{breaks}{_SPACE}]", re.S)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_part(self, part: str) -> bytes:
        if part == _SPACE:  # the mark itself, as bytes, so that it isn't read as a space
            ids = [self.byte_ids[b] for b in _SPACE.encode()]
        else:
            ids = self.automaton.viterbi(part.replace(" ", _SPACE))
        packed = np.asarray(ids, "<i4").tobytes()
        return self._remember(part, packed)

    def _remember(self, part: str, packed: bytes) -> bytes:
        if len(part) <= 64:
            if len(self.cache) >= _CACHE:  # parts that nobody asks for again go with the older half
                self.older, self.cache = self.cache, {}
            self.cache[part] = packed
        return packed

    def _lookup(self, part: str) -> bytes:
        packed = self.older.get(part)
        return self._remember(part, packed) if packed else self._encode_part(part)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids; a space is put before the text, as the vocabulary's words begin with one."""
        if not text:
            return b""
        get = self.cache.get
        return b"".join([get(p) or self._lookup(p) for p in self.part.findall(" " + text)])

    def decode(self, ids) -> str:
        raw = b"".join(map(self.surfaces.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    key = hash(vocabulary.byte_ids + (len(vocabulary.pieces),) + vocabulary.pieces[:50] + vocabulary.pieces[-50:])
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _converter(spark, vocabulary: Vocabulary):
    shared = spark.sparkContext.broadcast(vocabulary)

    def convert(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value)
        for column in texts:
            packed = [encoder.encode(t.as_py() or "") for t in column]
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
            decoded = pa.array([encoder.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], pa.string())
            yield pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

    return F.arrow_udf(convert, "struct<ids: array<int>, decoded: string>")


def with_pieces(docs: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``piece_ids`` (array<int>) and ``decoded``, the text that the ids give back.

    Null text has no ids and decodes to the empty string, as empty text does.
    Every other text, with any characters and of any length, decodes to itself.
    Input columns of those names are replaced. Rows are independent: ties, copies
    and nulls elsewhere change nothing.
    """
    convert = _converter(docs.sparkSession, load_vocabulary(vocabulary_path))
    kept = [c for c in docs.columns if c not in ("piece_ids", "decoded")]
    out = docs.select(*kept, convert(F.col(text_col)).alias("__pieces"))
    return out.select(*kept, F.col("__pieces.ids").alias("piece_ids"), F.col("__pieces.decoded").alias("decoded"))


def pieces_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens, piece_ids, text_crc32, round_trip) from ``with_pieces``; ``text_crc32`` is of the decoded text."""
    out = with_pieces(docs.select(id_col, text_col), vocabulary_path, text_col)
    return out.select(
        id_col,
        F.size("piece_ids").cast("long").alias("n_tokens"),
        "piece_ids",
        F.crc32("decoded").alias("text_crc32"),
        (F.col("decoded") == F.coalesce(text_col, F.lit(""))).alias("round_trip"),
    )


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return pieces_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
