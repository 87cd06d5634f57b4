"""Lattices of words over a fixed piece vocabulary, many words at a time in numpy.

The nodes of a word of n characters are n + 1 places, those of all words are
numbered in a row. An edge is a piece (or a character that is no piece) from one
node to a later one. Words may have any length: sums over long ones run in
logarithms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = "▁"
#: Characters of a word up to which its sums don't underflow.
SHORT = 32
_C = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.uint64(2**64 - 1)
_CHARACTER = np.uint64(21)  # bits of a code point


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words, where each begins, and their lengths."""
    data = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    return data, np.cumsum(size) - size, size


class Pieces:
    """A vocabulary as a trie: an open-addressed table leads from (state, character) to the next state; state 0 is the root."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.ids = {p: i for i, p in enumerate(pieces)}
        data, first, size = codes(pieces)
        state, n_states = np.zeros(len(pieces), np.int64), 1
        keys, act, n = [np.zeros(0, np.uint64)], np.flatnonzero(size), 0
        while len(act):
            own, at = np.unique(self._key(state[act], data[first[act] + n]), return_inverse=True)
            keys.append(own)
            state[act], n_states, n = n_states + at, n_states + len(own), n + 1
            act = act[size[act] > n]
        self.piece = np.full(n_states, -1, np.int32)
        self.piece[state[size > 0]] = np.flatnonzero(size)
        self._fill(np.concatenate(keys))

    @staticmethod
    def _key(state: np.ndarray, character: np.ndarray) -> np.ndarray:
        return (state.astype(np.uint64) << _CHARACTER) | character.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _C) >> self.shift).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.table, self.next = np.uint64(64 - bits), np.full(1 << bits, _FREE), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.table[s] == _FREE
            self.table[s[free]] = keys[left[free]]
            done = self.table[s] == keys[left]
            self.next[s[done]] = left[done] + 1  # states are numbered as their keys come
            left = left[~done]
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)

    def step(self, state: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The next states, -1 where no piece goes on so."""
        key = self._key(state, character)
        slot = self._slot(key)
        got = self.table[slot]
        out = np.where(got == key, self.next[slot], -1)
        more = np.flatnonzero((got != key) & (got != _FREE))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.table) - 1)
            got = self.table[slot[more]]
            hit = got == key[more]
            out[more[hit]] = self.next[slot[more[hit]]]
            more = more[~hit & (got != _FREE)]
        return out


@dataclass
class Lattice:
    """length and node (the first one) of each word; first: of each node's edges; start, end, piece of each edge, and unknown: the code point of a character without a piece, else -1."""

    length: np.ndarray
    node: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    unknown: np.ndarray

    @property
    def last(self) -> np.ndarray:
        """The last node of each word."""
        return self.node + self.length


def build(words: list[str], vocabulary: Pieces) -> Lattice:
    return build_from(*codes(words), vocabulary)


def build_from(data: np.ndarray, first: np.ndarray, size: np.ndarray, vocabulary: Pieces) -> Lattice:
    """All edges of each word. A character that is no piece gets an edge with piece len(vocabulary.pieces)."""
    total = int(size.sum())
    owner = np.repeat(np.arange(len(size)), size)
    base = np.cumsum(size) - size
    at = np.arange(total) + (first - base)[owner]
    stop = (first + size)[owner]
    place, state, count, found, n = np.arange(total), np.zeros(total, np.int64), np.zeros(total, np.int64), [], 1
    while len(place):
        state = vocabulary.step(state, data[at[place] + n - 1])
        piece = np.where(state >= 0, vocabulary.piece[state], -1)
        own = np.arange(len(place)) if n == 1 else np.flatnonzero(piece >= 0)
        edge = place[own]
        found.append((edge, count[edge], np.full(len(edge), n), piece[own]))
        count[edge] += 1
        on = (state >= 0) & (at[place] + n < stop[place])
        place, state, n = place[on], state[on], n + 1
    ends = np.cumsum(count)
    place, rank, length, piece = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
    order = np.empty(len(place), np.int64)
    order[(ends - count)[place] + rank if len(place) else place] = np.arange(len(place))
    place, length, piece = place[order], length[order], piece[order].astype(np.int64)
    unknown = np.where(piece < 0, data[at[place]].astype(np.int64), -1) if len(place) else place
    piece = np.where(piece < 0, len(vocabulary.pieces), piece)
    start = place + owner[place] if len(place) else place
    edges = np.zeros(total + len(size) + 1, np.int64)
    edges[np.arange(total) + owner + 1] = count
    return Lattice(size.astype(np.int64), base + np.arange(len(size)), np.cumsum(edges), start, start + length, piece, unknown)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _swept(level: np.ndarray, first: np.ndarray, other: np.ndarray, log_w: np.ndarray, in_logs: bool) -> np.ndarray:
    """The logarithm, for each node, of the sum over its edges of exp(log_w) times the value at the other node; 1 at level 0. Level by level."""
    order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level, kind="stable")
    cut = np.cumsum(np.bincount(level)) if len(level) else np.zeros(0, np.int64)
    count = (first[1:] - first[:-1])[order]
    edge = _ranges(first[:-1][order], count)
    opens = np.cumsum(count) - count
    other, log_w = other[edge], log_w[edge]
    value = np.zeros((len(level), log_w.shape[1])) if in_logs else np.ones((len(level), log_w.shape[1]))
    w = log_w if in_logs else np.exp(log_w)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        x, y = opens[a], opens[b] if b < len(opens) else len(edge)
        runs = opens[a:b] - x
        if in_logs:
            add = w[x:y] + value[other[x:y]]
            most = np.maximum.reduceat(add, runs)
            value[order[a:b]] = most + np.log(np.add.reduceat(np.exp(add - np.repeat(most, count[a:b], axis=0)), runs))
        else:
            value[order[a:b]] = np.add.reduceat(w[x:y] * value[other[x:y]], runs)
    return value if in_logs else np.log(value)


def _place(lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Each node's place in its word, and how far it is from the word's end."""
    word = np.repeat(np.arange(len(lat.length)), lat.length + 1)
    at = np.arange(len(word)) - lat.node[word]
    return at, lat.length[word] - at


def backward(lat: Lattice, log_p: np.ndarray) -> np.ndarray:
    """The logarithm of the sum over all segmentations from each node to its word's end: (nodes, columns of log_p). log_p: pieces by columns, the last row for an unknown character."""
    return _swept(_place(lat)[1], lat.first, lat.end, log_p[lat.piece], lat.length.max(initial=0) > SHORT)


def forward(lat: Lattice, log_p: np.ndarray) -> np.ndarray:
    """As backward(), from the word's beginning to each node."""
    order = np.argsort(lat.end, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(lat.end, minlength=len(lat.first) - 1))])
    return _swept(_place(lat)[0], first, lat.start[order], log_p[lat.piece[order]], lat.length.max(initial=0) > SHORT)


def expected_counts(lat: Lattice, log_p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of all words by their probability; log_p has one column."""
    alpha, beta = forward(lat, log_p)[:, 0], backward(lat, log_p)[:, 0]
    word = np.repeat(np.arange(len(lat.length)), lat.length + 1)[lat.start]
    use = np.exp(alpha[lat.start] + log_p[lat.piece, 0] + beta[lat.end] - beta[lat.node[word]]) * weight[word]
    return np.bincount(lat.piece, use, minlength=len(log_p))
