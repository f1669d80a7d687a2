"""A compact n-gram trie: Elias-Fano pointers, packed successors told relative to their context, quantised probabilities.

Level k has the n-grams of k words in order; a node's children are a range of the next level. The first two levels hold words as
places in the sorted vocabulary; from the third on, a word is its place among the successors of the context without its first
word, a far smaller number. All levels are flat arrays that can be memory-mapped; queries take arrays and search each range."""

from __future__ import annotations

from pathlib import Path

import numpy as np

#: A level is decoded for a query of more than 1 / MANY as many rows.
MANY = 8
#: Steps of a quantised log10 probability, and the largest.
STEPS, MOST = 2048, 65535


def quantise(p: np.ndarray) -> np.ndarray:
    """-log10 p in steps, rounded up, so that what sums to at most 1 still does."""
    return np.minimum(np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEPS - 1e-9), MOST).astype(np.uint16)


def dequantise(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(np.float64) / STEPS)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of x in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _places(vocab: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each number of x is in the sorted vocab, -1 if it isn't."""
    top = int(vocab[-1])
    if vocab[0] >= 0 and top < 16 * x.size + (1 << 16):
        table = np.full(top + 2, -1, np.int64)
        table[vocab] = np.arange(len(vocab))
        return table[np.where((x >= 0) & (x <= top), x, top + 1)]
    at = np.minimum(np.searchsorted(vocab, x), len(vocab) - 1)
    return np.where(vocab[at] == x, at, -1)


class Packed:
    """Unsigned numbers of one width in 64-bit words."""

    def __init__(self, words: np.ndarray, width: int):
        self.words, self.width = words, width

    @classmethod
    def of(cls, values: np.ndarray, width: int | None = None) -> Packed:
        values = values.astype(np.uint64)
        width = int(values.max()).bit_length() if width is None and len(values) else width or 0
        words = np.zeros(len(values) * width // 64 + 2, np.uint64)
        if width:
            at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.add.at(words, word, values << shift)
            over = np.flatnonzero(shift + np.uint64(width) > 64)
            np.add.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
        return cls(words, width)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(np.shape(i), np.uint64)
        at = np.asarray(i).astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        high = np.where(shift > 0, self.words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.words[word] >> shift) | high) & np.uint64((1 << self.width) - 1)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, found by select."""

    def __init__(self, low: Packed, high: np.ndarray, ranks: np.ndarray, n: int):
        self.low, self.high, self.ranks, self.n = low, high, ranks, n

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        ones = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(((int(ones[-1]) >> 6) + 1 if n else 1) * 64, np.uint8)
        bits[ones.astype(np.int64)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(Packed.of(values & np.uint64((1 << width) - 1), width), high, ranks, n)

    def all(self) -> np.ndarray:
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little"))
        return ((ones - i) << self.low.width) | self.low[i].astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ranks, i, "right") - 1
        left, bits, at = (i - self.ranks[word]).astype(np.uint64), self.high[word].copy(), np.zeros(i.shape, np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.uint64)
            skip = left >= below
            left = np.where(skip, left - below, left)
            at = np.where(skip, at + np.uint64(half), at)
            bits = np.where(skip, bits >> np.uint64(half), bits)
        one = word.astype(np.uint64) * np.uint64(64) + at
        return (((one - i.astype(np.uint64)) << np.uint64(self.low.width)) | self.low[i]).astype(np.int64)


class Trie:
    """n-grams of 1 to `order` words with a probability each, the last but one level with back-off weights too, if given; what an
    absent n-gram has is the caller's to say (find gives -1)."""

    def __init__(self, vocab: np.ndarray, pointers: list[EliasFano], successors: list[Packed], q: list[np.ndarray], backoff: np.ndarray | None = None):
        self.vocab, self.pointers, self.successors, self.q, self.backoff = vocab, pointers, successors, q, backoff
        self._kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, grams: list[np.ndarray], probabilities: list[np.ndarray], backoff: np.ndarray | None = None) -> Trie:
        """grams[k - 1]: rows of k word ids in order, each row's first k - 1 words a row of the level above; at order 3 and more
        also its last k - 1 words a row of the level above, as in counts of running text."""
        vocab = distinct(np.concatenate([g.ravel() for g in grams]))
        places = [_places(vocab, g) for g in grams]
        made = cls(vocab, [], [], [quantise(p) for p in probabilities], None if backoff is None else quantise(backoff))
        for k, rows in enumerate(places):
            if k == 0:
                made.successors.append(Packed.of(rows[:, 0]))
                continue
            parent = made._node(rows[:, :-1])
            starts = np.cumsum(np.bincount(parent, minlength=len(places[k - 1])))
            made.pointers.append(EliasFano.of(np.concatenate([[0], starts])))
            made.successors.append(Packed.of(made._relative(rows)))
        return made

    def _relative(self, rows: np.ndarray) -> np.ndarray:
        """The last word of each row as its level stores it, -1 if its shorter context doesn't have it."""
        if rows.shape[1] < 3:
            return rows[:, -1]
        context = self._node(rows[:, 1:-1])
        node = self._child(context, rows[:, 1:], rows.shape[1] - 2)
        level = rows.shape[1] - 2
        starts, at = self.pointers[level - 1], np.maximum(context, 0)
        starts = self._decoded(level)[0][at] if len(rows) * MANY > len(self.q[level]) > 0 else starts[at]
        return np.where((context >= 0) & (node >= 0), node - starts, -1)

    def _child(self, parent: np.ndarray, rows: np.ndarray, level: int) -> np.ndarray:
        """The node at `level` under each parent for the last word of each row: a search of the parent's range."""
        wanted = self._relative(rows)
        known = (parent >= 0) & (wanted >= 0)
        if len(rows) * MANY > len(self.q[level]) > 0:
            return self._look_up(self._decoded(level)[1], np.where(known, parent * len(self.vocab) + wanted, -1))
        safe = np.maximum(parent, 0)
        lo, end = self.pointers[level - 1][safe], self.pointers[level - 1][safe + 1]
        return self._search(level, np.where(known, lo, 0), np.where(known, end, 0), wanted)

    def _decoded(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each parent's range begins, and all (parent, successor) of a level in order, as numbers; kept for further queries."""
        if level not in self._kept:
            starts, values = np.zeros(2, np.int64), self.successors[level][np.arange(len(self.q[level]))].astype(np.int64)
            if level:
                starts = self.pointers[level - 1].all()
                values += np.repeat(np.arange(len(starts) - 1) * len(self.vocab), np.diff(starts))
            self._kept[level] = starts, values
        return self._kept[level]

    def _look_up(self, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if (wanted[1:] >= wanted[:-1]).all():
            at = np.searchsorted(keys, wanted)
        else:
            # Searches in order stay near each other.
            order, at = np.argsort(wanted), np.empty(len(wanted), np.int64)
            at[order] = np.searchsorted(keys, wanted[order])
        at = np.minimum(at, len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def _search(self, level: int, lo: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        hi, values = end.copy(), self.successors[level]
        lo = lo.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = values[mid].astype(np.int64) < wanted[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        inside = lo < end
        hit = inside & (values[np.where(inside, lo, 0)].astype(np.int64) == wanted)
        return np.where(hit, lo, -1)

    def _node(self, rows: np.ndarray) -> np.ndarray:
        """The node of each row of vocabulary places, -1 if there is none."""
        n = len(self.q[0])
        if len(rows) * MANY > n > 0:
            node = self._look_up(self._decoded(0)[1], rows[:, 0])
        else:
            node = self._search(0, np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64), rows[:, 0].astype(np.int64))
        for k in range(1, rows.shape[1]):
            node = self._child(node, rows[:, : k + 1], k)
        return node

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The node of each row of word ids at the level of its length, -1 if absent."""
        at = _places(self.vocab, grams)
        known = (at >= 0).all(1)
        return np.where(known, self._node(np.where(known[:, None], at, 0)), -1)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """The dequantised probability of each row, 0 if absent."""
        node = self.find(grams)
        return np.where(node >= 0, dequantise(self.q[grams.shape[1] - 1][np.maximum(node, 0)]), 0.0)

    def save(self, folder: str | Path) -> None:
        folder = Path(folder)
        np.save(folder / "vocab.npy", self.vocab)
        for k, (s, q) in enumerate(zip(self.successors, self.q)):
            np.save(folder / f"successors{k}.{s.width}.npy", s.words)
            np.save(folder / f"q{k}.npy", q)
        if self.backoff is not None:
            np.save(folder / "backoff.npy", self.backoff)
        for k, p in enumerate(self.pointers):
            np.save(folder / f"low{k}.{p.low.width}.{p.n}.npy", p.low.words)
            np.save(folder / f"high{k}.npy", p.high)
            np.save(folder / f"ranks{k}.npy", p.ranks)

    @classmethod
    def mapped(cls, folder: str | Path) -> Trie:
        """The trie with every level memory-mapped from where save() put it."""
        folder = Path(folder)
        load = lambda name: np.load(folder / name, mmap_mode="r")
        one = lambda start: next(folder.glob(start + ".*npy"))
        order = len(list(folder.glob("q*.npy")))
        successors = [Packed(load(p.name), int(p.name.split(".")[1])) for p in (one(f"successors{k}") for k in range(order))]
        pointers = []
        for k in range(order - 1):
            low = one(f"low{k}")
            width, n = map(int, low.name.split(".")[1:3])
            pointers.append(EliasFano(Packed(load(low.name), width), load(f"high{k}.npy"), load(f"ranks{k}.npy"), n))
        return cls(load("vocab.npy"), pointers, successors, [load(f"q{k}.npy") for k in range(order)], load("backoff.npy") if (folder / "backoff.npy").exists() else None)
