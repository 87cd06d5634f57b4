"""BPE encoding and decoding with a vocabulary file of byte pairs and word ends.

A text is cut at the file's special tokens, which are ids of their own. What
lies between is normalised (NFC, white space to spaces, lower case) and cut into
words as the file says; a word's bytes are symbols, the last of them marked as
the word's end. Merging: the symbols are a doubly linked list, and a priority
queue holds every pair of neighbours that the vocabulary can merge, by rank and
then by place. The best is taken out; if one of its symbols has changed since,
the entry is stale and skipped, else the two become one and its new pairs with
both neighbours enter the queue. A word of n bytes takes n log n steps, so a
word may be of any length.

Decoding puts the vocabulary's strings one after another, with what the file
asks between them: a space, as it names no decoder. plain=True gives the text
again that the tokens stand for (words apart by one space each). An id that the
vocabulary lacks is an error.

encode() returns doc_id and ids, one row for each row; decode() adds decoded.
Null texts are empty, and an empty text has no ids. Null ids (of rows), rows
that repeat and other columns make no difference: only doc_id and text are read
and every row is encoded alone. An empty table gives an empty result. Memory is that of the longest text.

The rules for words are those of the tokenizers library. It and Python follow
different versions of Unicode; texts with characters outside the ranges on
which both agree go through the library's own normaliser and cutter, and then
through the same merging.
"""

from __future__ import annotations

import array
import functools
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import held, slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Runs of characters between white space that a worker remembers, and the length up to which it does.
_KNOWN, _SHORT = 200_000, 48
#: Beyond these characters the versions of Unicode differ here and there.
_OTHER = re.compile("[^\x00-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u21ff\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
#: White space to Python, but not to the vocabulary's file.
_NOT_WHITE = re.compile("[\x1c-\x1f]")
#: Fixed: what the file's patterns call white space.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Known(dict):
    """Remembers find(key) for short keys. When it is full it keeps those used since it was full last."""

    def __init__(self, find):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= _SHORT:
            if len(self) >= _KNOWN:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one of those from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Bpe:
    """One vocabulary file: how it cuts, merges and decodes."""

    def __init__(self, spec: str):
        read = json.loads(spec)
        self.spec = spec
        model = read["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.left, self.right = [self.vocab[a] for a, _ in pairs], [self.vocab[b] for _, b in pairs]
        self.made = [self.vocab[a + b] for a, b in pairs]
        #: The rank of a pair of ids, times 2^32; of a pair that the file has twice, its first.
        self.ranks = {(self.left[r], self.right[r]): r << 32 for r in reversed(range(len(pairs)))}
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        by_id = {i: s for s, i in (self.vocab | self.special).items()}
        self.strings = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())
        self.symbols = byte_symbols()
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.words = regex.compile(read["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.word, self.run = _Known(self.merge), _Known(self.encode_run)
        self.ascii = {s: bytes([b]) for b, s in enumerate(self.symbols)}

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    def split(self, run: str) -> list[str]:
        """The words of a run of characters other than white space, as symbols of bytes."""
        if run.isascii() and run.isprintable():  # such characters stand for themselves
            return [run.lower()] if run.isalpha() else self.words.findall(run.lower())
        if _OTHER.search(run):
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))]
        run = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()  # a sigma ends no word in the file's lower case
        return ["".join([self.symbols[b] for b in w.encode()]) for w in ([run] if run.isalpha() else self.words.findall(run))]

    def merge(self, word: str) -> bytes:
        """The ids of one word, given as symbols; as 32-bit numbers, like all ids here."""
        vocab, ranks, left, right, made = self.vocab, self.ranks, self.left, self.right, self.made
        ids = [vocab[c] for c in word]
        ids[-1] = vocab[word[-1] + self.suffix]
        n = len(ids)
        # An entry is rank * 2^32 + place; the rank tells which two ids it means.
        queue = [ranks[pair] + i for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] != left[rank] or j < 0 or ids[j] != right[rank]:
                continue  # stale: one of the two has been merged since
            new = ids[i] = made[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (pair := (new, ids[k])) in ranks:
                    heappush(queue, ranks[pair] + i)
            h = before[i]
            if h >= 0 and (pair := (ids[h], new)) in ranks:
                heappush(queue, ranks[pair] + h)
        return array.array("i", [x for x in ids if x >= 0]).tobytes()

    def encode_run(self, run: str) -> bytes:
        words = self.split(run)
        return self.word[words[0]] if len(words) == 1 else b"".join(map(self.word.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """No word, normalisation or merge reaches over white space, so a text is its runs of other characters."""
        out = []
        for part in self.cut.split(text) if any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(array.array("i", [self.special[part]]).tobytes())
                continue
            runs = _WHITE.split(part) if _NOT_WHITE.search(part) else part.split()
            out += map(self.run.__getitem__, runs)
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        found = [self.encode(t) if t else b"" for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The vocabulary's strings of each list one after another, a space between two."""
        return pc.binary_join(pa.ListArray.from_arrays(_offsets(ids), self.strings.take(ids.flatten())), " ")

    def plain(self, ids: list[int]) -> str:
        """The text that the tokens stand for."""
        raw = {s: bytes([b]) for b, s in enumerate(self.symbols)}
        out = b""
        for special, group in itertools.groupby((self.strings[i].as_py() for i in ids), self.special.__contains__):
            if special:
                out += "".join(group).encode()
            else:
                words = "".join(group).split(self.suffix) if self.suffix else ["".join(group)]
                out += b" ".join(b"".join(raw[c] for c in w) for w in words)
        return out.decode("utf-8", "replace").rstrip(" ")


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Where each list begins in what flatten() gives; null lists are empty."""
    return pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int32))


def _spec(frame: DataFrame, path: str):
    """The vocabulary's file, sent to the workers: a few MB whatever the input is."""
    with open(path, encoding="utf-8") as file:
        return frame.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str = VOCABULARY, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every text; with decoded also what decode() makes of them, in the same task."""
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(f"bpe {path}", lambda: Bpe(spec.value))
        for batch in batches:
            for piece in slices(batch, "text"):
                ids = bpe.encode_all(piece.column("text").to_pylist())
                out = {"doc_id": piece.column("doc_id"), "ids": ids} | ({"decoded": bpe.decode_all(ids)} if decoded else {})
                yield pa.RecordBatch.from_pydict(out)

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>{', decoded string' if decoded else ''}")


def decode(encoded: DataFrame, path: str = VOCABULARY, plain: bool = False) -> DataFrame:
    """doc_id, ids and decoded (string); null ids are none."""
    spec = _spec(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(f"bpe {path}", lambda: Bpe(spec.value))
        for batch in batches:
            ids = batch.column("ids")
            texts = pa.array([bpe.plain(i or []) for i in ids.to_pylist()], pa.string()) if plain else bpe.decode_all(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, texts], names=["doc_id", "ids", "decoded"])

    encoded = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame) -> DataFrame:
    """What a text was encoded to and decoded to again, as counts and digests."""
    return encode(docs, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
