"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are pairs of character classes that follow each other (runs of
one class count once), pairs of letters, and its form: lengths and shares of
distinct words, distinct lines, capitals, digits and symbols, each spread over
a few neighbouring ranges. Term counts are damped and weighted by rarity; a
truncated singular value decomposition of the labelled texts gives the latent
space. The labelled vectors are broadcast, every text's cosine with each of
them is computed exactly, in blocks, and the nearest vote with the power of
their similarity.

The labelled texts are a sample of at most about max_labelled rows, drawn by a
hash of the id, so the broadcast has a fixed size. Null quality is no label;
several labels of one id count as their mean. Null texts are empty texts, and
those have a form as others do. Without labels every score is 0.5. Rows are
judged one by one: repeated rows agree; an empty table gives an empty result. A
text of any length is read whole and held as a whole. Columns of documents other
than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import Rolling, bucket_of, runs, slices, text_bytes

_KINDS = 40  # classes of bytes: lower case, capital, digit, space, line end, other, 33 signs
_PAIRS = _KINDS * _KINDS
_LETTERS = 27 * 27
_RANGES = 16
#: (lowest, highest) of each number that describes a text's form.
_FORM = {"words": (0.0, 10.0), "distinct": (0.0, 1.0), "heaps": (0.5, 1.0), "lines": (0.0, 1.0), "capitals": (0.0, 0.3), "digits": (0.0, 0.3), "signs": (0.0, 0.3), "length": (2.0, 10.0), "per_line": (0.0, 6.0)}
DIMS = _PAIRS + _LETTERS + _RANGES * len(_FORM)
_FORM_WEIGHT = 3.0


def _kinds() -> np.ndarray:
    out = np.full(256, 5, np.int64)
    out[97:123], out[65:91], out[48:58], out[32], out[10], out[128:] = 0, 1, 2, 3, 4, 0
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[signs] = 6 + np.arange(len(signs))
    return out


_KIND = _kinds()


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each row has."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]) if len(row) else np.zeros(0, bool)
    return np.bincount(row[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts by DIMS: counts of pairs, damped, and the form."""
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kind = _KIND[data]
    rolling = Rolling(data)
    out = np.zeros((n, DIMS), np.float32)
    run = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])])) if len(data) else np.zeros(0, np.int64)
    a, o = kind[run], owner[run]
    same = o[1:] == o[:-1]
    out[:, :_PAIRS] = np.bincount((o[:-1] * _PAIRS + a[:-1] * _KINDS + a[1:])[same], minlength=n * _PAIRS).reshape(n, _PAIRS)
    letter = np.where(kind == 0, (data & 31) % 27, np.where(kind == 1, (data & 31) % 27, 0))
    same = (owner[1:] == owner[:-1]) & (letter[1:] + letter[:-1] > 0)
    out[:, _PAIRS : _PAIRS + _LETTERS] = np.bincount((owner[:-1] * _LETTERS + letter[:-1] * 27 + letter[1:])[same], minlength=n * _LETTERS).reshape(n, _LETTERS)
    np.log1p(out, out=out)
    word, start, end = runs(data, (kind == 3) | (kind == 4), owner)
    word_hash = rolling.spans(start, end)
    line, start, end = runs(data, kind == 4, owner)
    line_hash = rolling.spans(start, end)
    words, lines = np.bincount(word, minlength=n), np.bincount(line, minlength=n)
    share = lambda x, of: x / np.maximum(of, 1)
    count = lambda k: np.bincount(owner[k], minlength=n)
    unlike = _distinct(word, word_hash, n)
    form = {
        "words": np.log1p(words), "distinct": share(unlike, words), "heaps": np.where(words > 1, np.log(np.maximum(unlike, 1)) / np.log(np.maximum(words, 2)), 1.0), "lines": share(_distinct(line, line_hash, n), lines),
        "capitals": share(count(kind == 1), size), "digits": share(count(kind == 2), size), "signs": share(count(kind > 5), size), "length": share(size - words, words), "per_line": np.log1p(share(words, lines)),
    }
    for i, (name, (low, high)) in enumerate(_FORM.items()):
        at = np.clip((form[name] - low) / (high - low), 0, 1) * (_RANGES - 1)
        spread = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(_RANGES)) / 2)
        out[:, _PAIRS + _LETTERS + i * _RANGES :][:, :_RANGES] = spread
    return out


@dataclass
class Model:
    """weight: of each dimension; axes: dimensions by latent; vectors: labelled by latent, of length 1; quality: their labels."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    quality: np.ndarray


def _weighted(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each group of terms scaled to length 1, the form to its weight, rare terms more."""
    x = x * weight
    for a, b, w in ((0, _PAIRS, 1.0), (_PAIRS, _PAIRS + _LETTERS, 0.5), (_PAIRS + _LETTERS, DIMS, _FORM_WEIGHT)):
        x[:, a:b] *= w / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


def fit(x: np.ndarray, quality: np.ndarray, latent: int = 48) -> Model:
    """By subspace iteration, from a fixed start."""
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    weight[_PAIRS + _LETTERS :] = 1
    x = _weighted(x, weight)
    axes = np.linalg.qr(np.random.default_rng(5).standard_normal((DIMS, min(latent, len(x)))))[0].astype(np.float32)
    for _ in range(8):
        axes = np.linalg.qr(x.T @ (x @ axes))[0]
    z = x @ axes
    return Model(weight, axes, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), quality)


def vote(model: Model, x: np.ndarray, k: int = 25, sharp: float = 20.0, block: int = 512) -> np.ndarray:
    """Scores of texts from their k nearest labelled ones; all that are as near as the last of them vote too."""
    z = _weighted(x, model.weight) @ model.axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    k, out = min(k, len(model.quality)), np.zeros(len(z))
    for at in range(0, len(z), block):
        near = z[at : at + block] @ model.vectors.T
        row, own = np.nonzero(near >= np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None])
        w = np.maximum(near[row, own], 1e-6).astype(np.float64) ** sharp
        out[at : at + block] = np.bincount(row, w * model.quality[own], minlength=len(near)) / np.maximum(np.bincount(row, w, minlength=len(near)), 1e-300)
    return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 4096, latent: int = 48) -> Model | None:
    """From labelled rows that aren't held out; None without any."""
    one = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    n = one.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    drawn = one.filter(draw < max_labelled / max(n, 1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(*text_bytes(part.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([r.tobytes() for r in x])], ["doc_id", "quality", "x"])

    # The drawn labels have a bound, so they go to the texts.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")
    got = rows.mapInArrow(each, "doc_id long, quality double, x binary").toPandas().sort_values("doc_id")
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, DIMS).astype(np.float32)
    return fit(x, got["quality"].to_numpy(np.float64), latent)


def judge(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; only the text is looked at."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # max_labelled + DIMS rows of latent numbers

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                score = np.full(part.num_rows, 0.5)
                if known.value is not None:
                    data, offsets = text_bytes(part.column("text"))
                    for at in range(0, len(score), 1024):  # many short texts
                        cut = offsets[at : at + 1025]
                        score[at : at + 1024] = vote(known.value, features(data[cut[0] : cut[-1]], cut - cut[0]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
