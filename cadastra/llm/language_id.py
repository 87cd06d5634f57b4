"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary.
The probability of a word is the sum, by a forward algorithm, over all its
segmentations into pieces; that of a text is the product over its words, which
are runs of letters in lower case, opened by the space mark. The predicted
language has the largest posterior, which is the score.

The probabilities are learned by expectation maximisation: a Spark pass over
the counted words of a sample of labelled rows sums expected piece counts. The
sample takes rows by a hash of their id, at the rate that gives sample_per_lang
rows of each language on average, or all if there are fewer.

Runs of letters are scored as wholes, whatever their length. Texts that are null or
have no letter get "und" and score 0. Without any labelled row every text gets
"und". Ties go to the first language by code point. Rows are judged one by one,
so repeated rows agree, and an empty table gives an empty result. Columns other
than doc_id, text and lang are not read. fit is by how much the mean
log-probability of a text's letters exceeds that of its language's own words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm import lattice
from cadastra.llm.common import bucket_of, let_go, slices, stored, tidied

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_WORDS = re.compile(r"[^\W\d_]+")
_FLOOR = 1e-7
_KNOWN = 100_000


@dataclass
class Model:
    """pieces: the vocabulary's; p: pieces (and one row more for unknown characters) by languages; level: the mean log-probability of a letter (or word's beginning) in each language's own words."""

    pieces: list[str]
    langs: list[str]
    prior: np.ndarray
    p: np.ndarray
    level: np.ndarray


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the space mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in found if p.lower() == p and (p == lattice.SPACE or p.removeprefix(lattice.SPACE).isalpha())})


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORDS.findall(text.lower())


def _lattices(words: list[str], vocabulary: lattice.Pieces) -> Iterator[tuple[np.ndarray, lattice.Lattice]]:
    """The places of some words and their lattice; those of long words, which run in logarithms, apart."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    short, long = np.flatnonzero(size < lattice.SHORT), np.flatnonzero(size >= lattice.SHORT)
    for own, block in ((short, 8_000), (long, 200)):
        for at in range(0, len(own), block):
            some = own[at : at + block]
            yield some, lattice.build([lattice.SPACE + words[i] for i in some.tolist()], vocabulary)


def _log_p(words: list[str], vocabulary: lattice.Pieces, log_p: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), log_p.shape[1]))
    for own, lat in _lattices(words, vocabulary):
        out[own] = lattice.backward(lat, log_p)[lat.node]
    return out


def train(docs: DataFrame, vocabulary: str = VOCABULARY, sample_per_lang: int = 2000, rounds: int = 4) -> Model:
    """The model, from rows with a lang and a text whose id isn't held out."""
    pieces = load_pieces(vocabulary)
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), 3) != 1))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    prior = np.log(np.array([sizes[x] for x in langs], float) / max(1, sum(sizes.values())))
    p = np.full((len(pieces) + 1, len(langs)), 1 / len(pieces))
    p[-1] = _FLOOR
    if not langs:
        return Model(pieces, langs, prior, p, np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*[F.lit(v) for x in langs for v in (x, sample_per_lang / sizes[x])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seen: Counter = Counter()
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for word, n in Counter(words_of(text)).items():
                        seen[lang, word] += n
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    words = rows.filter(draw < rates[F.col("lang")]).select("lang", "text").mapInArrow(tidied(count), "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    shared = spark.sparkContext.broadcast(pieces)  # the size of the vocabulary's file
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            let_go()
            known = lattice.Pieces(shared.value)
            total = np.zeros_like(now.value)
            for batch in batches:
                lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
                text, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
                for i in np.unique(lang):
                    own = np.flatnonzero(lang == i)
                    for some, lat in _lattices(text[own].tolist(), known):
                        total[:, i] += lattice.expected_counts(lat, np.log(now.value[:, i : i + 1]), n[own[some]])
            at = np.argwhere(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(total[at[:, 0], at[:, 1]])], ["piece", "lang", "n"])

        got = words.mapInArrow(tidied(expect), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(p.shape, 0.02)
        counts[got["piece"], got["lang"]] += got["n"]
        p = counts / counts.sum(0)
        p[-1] = _FLOOR
        now.unpersist()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known, log_p = lattice.Pieces(shared.value), np.log(p)
        total = np.zeros((2, len(langs)))
        for batch in batches:
            lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            text, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            own = _log_p(text, known, log_p)[np.arange(len(lang)), lang]
            np.add.at(total, (0, lang), own * n)
            np.add.at(total, (1, lang), n * np.fromiter((len(w) + 1 for w in text), np.int64, len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(langs))), pa.array(total[0]), pa.array(total[1])], ["lang", "log_p", "letters"])

    got = words.mapInArrow(tidied(rate), "lang long, log_p double, letters double").groupBy("lang").agg(F.sum("log_p").alias("log_p"), F.sum("letters").alias("letters")).toPandas().sort_values("lang")
    level = np.zeros(len(langs))
    level[got["lang"]] = got["log_p"] / np.maximum(1, got["letters"])
    return Model(pieces, langs, prior, p, level)


class Judge:
    """The model at work on one machine; remembers the words that it has scored, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.vocabulary, self.log_p = model, lattice.Pieces(model.pieces), np.log(model.p)
        self.number: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, len(model.langs))), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """lang, score, number of words, number of letters of each text, and by how much the mean log-probability of its letters exceeds that of its language's own words."""
        m = self.model
        per_text = [words_of(t) if isinstance(t, str) else [] for t in texts]
        n = np.array([len(ws) for ws in per_text], np.int64)
        lang, score, letters, fit = np.full(len(n), "und", object), np.zeros(len(n)), np.zeros(len(n), np.int64), np.zeros(len(n))
        some = np.flatnonzero(n)
        if not len(some) or not m.langs:
            return lang, score, n, letters, fit
        if len(self.number) > _KNOWN:
            self.number, self.scores, self.letters = {}, self.scores[:0], self.letters[:0]
        number, old = self.number, len(self.number)
        ids = np.array([number.setdefault(w, len(number)) for ws in per_text for w in ws], np.int64)
        new = list(number)[old:]
        self.scores = np.concatenate([self.scores, _log_p(new, self.vocabulary, self.log_p)])
        self.letters = np.concatenate([self.letters, np.fromiter((len(w) + 1 for w in new), np.int64, len(new))])
        opens = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        summed = np.add.reduceat(self.scores[ids], opens)
        total = m.prior + summed
        best = total.argmax(1)
        lang[some] = np.array(m.langs, object)[best]
        score[some] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        letters[some] = np.add.reduceat(self.letters[ids], opens)
        fit[some] = summed[np.arange(len(some)), best] / letters[some] - m.level[best]
        return lang, score, n, letters, fit


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_words and fit of each row; only the text is looked at."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # pieces by languages: the vocabulary's size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        judge = Judge(known.value)
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score, n, _, fit = judge(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(n), pa.array(fit)], ["doc_id", "lang_pred", "score", "n_words", "fit"])

    return docs.select("doc_id", "text").mapInArrow(tidied(each), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_words long, fit double")


def identify_held_out(docs: DataFrame, **options) -> DataFrame:
    """Trains on rows that aren't held out and judges all: doc_id, held_out, lang_pred, score."""
    found = identify(docs, train(docs, **options))
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "n_words", "fit")


def keep_identified(docs: DataFrame, least: float = 0.5, margin: float = 2.5, letters: int = 20, **options) -> DataFrame:
    """The rows of docs in a learned language, with all their columns, whatever their names.

    The posterior is among the learned languages only, so it has to be at least least, and a text of at least so many
    letters has to fit its language as well: its letters' mean log-probability may be below that of the language's own
    words by margin at most. Text of another language or of random letters isn't kept; without a learned language
    nothing is.
    """
    model = train(docs, **options)
    known = docs.sparkSession.sparkContext.broadcast(model)

    # The judgement is a column beside the row's own, so rows aren't joined back.
    @F.pandas_udf("boolean")
    def clear(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(known.value)
        for texts in batches:
            kept = []
            for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text"):
                lang, score, _, n, fit = judge(part.column("text").to_pylist())
                kept.append((lang != "und") & (score >= least) & ((n < letters) | (fit >= -margin)))
            yield pd.Series(np.concatenate(kept)) if kept else pd.Series([], dtype=bool)

    return docs.filter(clear("text"))
