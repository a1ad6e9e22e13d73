"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words. Piece probabilities
come from expectation-maximisation over the same segmentations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.pieces import DEFAULT_VOCABULARY, load_vocabulary
from twinweave.llm.quality_model import held_out
from twinweave.plans.scratch import Scratch

_RUN = re.compile(r"[^\W\d_]+")
_START = "▁"
#: Longer runs of letters are scored with scaling, and counted in parts when the model learns.
_LONG = 32
_CACHE = 300_000
_DRAWS = 1 << 60
_UNSEEN = 1e-8


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _RUN.findall((text or "").lower())
    if not all(map(str.isalpha, found)):  # numbers that aren't decimal digits count as word characters, but aren't letters
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


class PieceIndex:
    """Letter-only pieces of the vocabulary, numbered; the last number is any character without a piece."""

    def __init__(self, pieces: tuple[str, ...]):
        self.of = {p: i for i, p in enumerate(pieces)}
        self.n = len(pieces)
        # every beginning of a piece too, so that a search ends where none goes on
        self.begins = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | self.of
        self.longest = max(map(len, pieces), default=1)

    def matches(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every piece occurrence in every word, ordered by end."""
        get, flat = self.begins.get, []
        put = flat.extend
        for w, word in enumerate(words):
            s = _START + word
            n = len(s)
            for i in range(n):
                if get(s[i], -1) < 0:
                    put((w, i, i + 1, self.n))
                for j in range(i + 1, n + 1):
                    p = get(s[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        put((w, i, j, p))
        m = np.fromiter(flat, np.int64, len(flat)).reshape(-1, 4)
        return tuple(m[np.argsort(m[:, 2], kind="stable")].T)

    def forward(self, words: list[str], prob: np.ndarray, m=None) -> tuple[np.ndarray, np.ndarray]:
        """alpha[word, place, language]; the probability of each word is at its last place."""
        word, start, end, piece = self.matches(words) if m is None else m
        length = np.array([len(w) + 1 for w in words], np.int64)
        alpha = np.zeros((len(words), int(length.max(initial=0)) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        bounds = np.searchsorted(end, np.arange(alpha.shape[1] + 1))
        for t in range(1, alpha.shape[1]):
            a, b = bounds[t], bounds[t + 1] if t + 1 < len(bounds) else len(end)
            if a < b:  # matches of one end are in order of words
                w = word[a:b]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                alpha[w[first], t] = np.add.reduceat(alpha[w, start[a:b]] * prob[piece[a:b]], first, axis=0)
        return alpha, alpha[np.arange(len(words)), length]

    def long_word(self, word: str, prob: np.ndarray) -> np.ndarray:
        """Log probability of a word of any length in every language: the last places only are held, and scaled as they fall."""
        get, s, width = self.begins.get, _START + word, max(2, self.longest + 1)
        alpha = np.zeros((width, prob.shape[1]))
        alpha[0] = 1
        log = np.zeros(prob.shape[1])
        for i in range(len(s)):
            if i % 8 == 0:
                top = alpha.max(0)
                alpha /= top
                log += np.log(top)
            now = alpha[i % width].copy()
            alpha[i % width] = 0
            if get(s[i], -1) < 0:
                alpha[(i + 1) % width] += now * prob[self.n]
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                p = get(s[i:j])
                if p is None:
                    break
                if p >= 0:
                    alpha[j % width] += now * prob[p]
        return log + np.log(alpha[len(s) % width])

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words under ``prob`` (one language)."""
        m = self.matches(words)
        word, start, end, piece = m
        alpha, total = self.forward(words, prob[:, None], m)
        length = np.array([len(w) + 1 for w in words], np.int64)
        beta = np.zeros(alpha.shape[:2])
        beta[np.arange(len(words)), length] = 1
        by_start = np.argsort(-start, kind="stable")
        bounds = np.searchsorted(-start[by_start], np.arange(-alpha.shape[1], 1))
        for t in range(alpha.shape[1] - 1, -1, -1):
            x = by_start[bounds[alpha.shape[1] - t] : bounds[alpha.shape[1] - t + 1] if alpha.shape[1] - t + 1 < len(bounds) else None]
            np.add.at(beta, (word[x], start[x]), beta[word[x], end[x]] * prob[piece[x]])
        weight = alpha[word, start, 0] * prob[piece] * beta[word, end] / total[word, 0] * counts[word]
        return np.bincount(piece, weight, self.n + 1)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    prob: np.ndarray  # (pieces + 1, languages)
    prior: np.ndarray


def _letter_pieces(path: str) -> tuple[str, ...]:
    return tuple(p for p, _, _ in load_vocabulary(path).pieces if p == _START or p.removeprefix(_START).isalpha() and p == p.lower())


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary_path: str = DEFAULT_VOCABULARY,
    sample_docs: int = 400,
    rounds: int = 3,
    smoothing: float = 0.05,
) -> LanguageModel:
    """Piece probabilities of every language of the training rows (id not held out, text and language known).

    About ``sample_docs`` documents a language, picked by a hash of the id, are
    counted into (language, word, n); executors compute the expected pieces of
    each round and the driver gets one number for each language and piece. The
    language's prior is its share of the training rows. Runs of over 32 letters
    are counted in parts of 32. Without training rows there are no languages.
    """
    spark = docs.sparkSession
    pieces = _letter_pieces(vocabulary_path)
    train = docs.filter(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(lang_col).count().orderBy(lang_col).collect()}
    if not sizes:
        return LanguageModel((), pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    languages = tuple(sizes)
    limit = F.element_at(F.create_map(*[F.lit(v) for k in languages for v in (k, int(min(1.0, sample_docs / sizes[k]) * _DRAWS))]), F.col(lang_col))
    picked = train.filter(F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(_DRAWS)) < limit)
    scratch = Scratch(spark, "language")
    counted = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count_words, "lang string, word string, n long")
    counted = scratch.stash(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    place = {k: i for i, k in enumerate(languages)}
    prob = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        prob[-1] = _UNSEEN
        shared = spark.sparkContext.broadcast((pieces, place, prob))
        sums = counted.mapInArrow(_expect(shared), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts = np.full(prob.shape, smoothing)
        for r in sums:
            counts[r["piece"], place[r["lang"]]] += r["n"]
        prob = counts / counts[:-1].sum(0)
    prob[-1] = _UNSEEN
    total = sum(sizes.values())
    return LanguageModel(languages, pieces, prob, np.array([sizes[k] / total for k in languages]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            by.setdefault(lang, Counter()).update(w[i : i + _LONG] for w in words_of(text.as_py()) for i in range(0, len(w), _LONG))
        rows = [(k, w, n) for k, c in by.items() for w, n in c.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, place, prob = shared.value
        index = PieceIndex(pieces)
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist())
            words, n = np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_numpy()
            for k in np.unique(langs) if len(langs) else ():
                own = langs == k
                got = index.expected(words[own].tolist(), n[own].astype(float), prob[:, place[k]])
                sums[k] = sums.get(k, 0) + got
        for k, v in sums.items():
            p = np.flatnonzero(v)
            yield pa.record_batch([pa.array([k] * len(p)), pa.array(p, pa.int32()), pa.array(v[p])], names=["lang", "piece", "n"])

    return run


class _Scores:
    """Log probabilities of words in every language, remembered up to a bound."""

    def __init__(self, model: LanguageModel):
        self.index = PieceIndex(model.pieces)
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.empty((1024, len(model.languages)))

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Sum over each text's words."""
        if len(self.place) > _CACHE:
            self.place.clear()
        place = self.place
        fresh = sorted(set().union(*texts) - place.keys())
        while len(self.table) < len(place) + len(fresh):
            self.table = np.concatenate((self.table, np.empty_like(self.table)))
        long = [w for w in fresh if len(w) > _LONG]
        fresh = [w for w in fresh if len(w) <= _LONG]
        for w in long:
            self.table[len(place)] = self.index.long_word(w, self.model.prob)
            place[w] = len(place)
        for i in range(0, len(fresh), 4000):
            part = sorted(fresh[i : i + 4000], key=len)
            _, p = self.index.forward(part, self.model.prob)
            at = len(place)
            self.table[at : at + len(part)] = np.log(p)
            place.update(zip(part, range(at, at + len(part)), strict=True))
        return [self.table[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(0) for ws in texts]


def predictor(model: LanguageModel, spark):
    """Column function: text to struct(lang, score); the score is the language's posterior."""
    shared = spark.sparkContext.broadcast(model)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        scores = _Scores(m)
        for column in texts:
            langs, posts = [], []
            for i in range(0, len(column), 500):
                split = [words_of(t.as_py()) for t in column[i : i + 500]]
                for ws, ll in zip(split, scores.of(split) if m.languages else split, strict=True):
                    if not ws or not m.languages:
                        langs.append("und")
                        posts.append(0.0)
                        continue
                    post = np.log(m.prior) + ll
                    post = np.exp(post - post.max())
                    langs.append(m.languages[int(post.argmax())])
                    posts.append(float(post.max() / post.sum()))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(posts, pa.float64())], names=["lang", "score"])

    return F.arrow_udf(predict, "struct<lang: string, score: double>")


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``.

    ``und`` with score 0 for a text that is null, empty or has no letter, and for
    every text if nothing could be learned. Ties go to the first language by code
    point. Columns of those names are replaced. Whole texts count at any length,
    and all segmentations of a run of letters at any length. Repeated rows get
    equal results; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*kept, predictor(model, docs.sparkSession)(F.col(text_col)).alias("__p"))
    return out.select(*kept, F.col("__p.lang").alias("lang_pred"), F.col("__p.score").alias("score"))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Predictions for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
