"""A BK-tree under the Levenshtein distance that searches whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

WORD = 64
CELLS = 4_000_000  # (text, key) cells that are bounded by their letters at a time


def _codes(texts: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x longest) matrix of character codes, and the lengths. Characters outside ``alphabet`` get one common code."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    other = len(alphabet)
    kinds, back = np.unique(flat, return_inverse=True)
    table = np.array([alphabet.get(chr(k), other) for k in kinds], np.int16) if len(kinds) else np.zeros(0, np.int16)
    out = np.full((len(texts), int(lengths.max(initial=0))), other, np.int16)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = table[back] if len(flat) else 0
    return out, lengths


class _Keys:
    """Keys as bit masks per character, for distances of many (text, key) pairs at once."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, size: int):
        self.lengths, self.symbols = lengths, size + 1
        self.blocks = max(1, -(-int(lengths.max(initial=0)) // WORD))
        self.masks = np.zeros((self.blocks, len(lengths) * self.symbols), np.uint64)
        rows = np.arange(len(lengths))
        for i in range(codes.shape[1]):
            own = rows[lengths > i]
            self.masks[i // WORD][own * self.symbols + codes[own, i]] |= np.uint64(1 << (i % WORD))

    def distances(self, codes: np.ndarray, lengths: np.ndarray, text: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Levenshtein distance of each pair (row of ``codes``, key): bit-parallel down the key, vectorised over the pairs."""
        order = np.argsort(-lengths[text], kind="stable")
        text, key = text[order], key[order]
        size, own = lengths[text], self.lengths[key]
        n, one, high = len(text), np.uint64(1), np.uint64(WORD - 1)
        base = key * self.symbols
        last = np.maximum(own - 1, 0)
        top, block = (last % WORD).astype(np.uint64), last // WORD
        plus = [np.full(n, ~np.uint64(0)) for _ in range(self.blocks)]
        minus = [np.zeros(n, np.uint64) for _ in range(self.blocks)]
        score = own.astype(np.int64).copy()
        left = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # pairs whose text goes on at a column
        for j, live in enumerate(left.tolist()):
            at = base[:live] + codes[text[:live], j]
            carry_plus, carry_minus = one, np.uint64(0)
            for b in range(self.blocks):
                eq, pv, mv = self.masks[b][at], plus[b][:live], minus[b][:live]
                xv = eq | mv
                if b:
                    eq = eq | carry_minus
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph = mv | ~(xh | pv)
                mh = pv & xh
                step = ((ph >> top[:live]) & one).astype(np.int64) - ((mh >> top[:live]) & one).astype(np.int64)
                score[:live] += step if self.blocks == 1 else np.where(block[:live] == b, step, 0)
                next_plus, next_minus = (ph >> high, mh >> high) if b + 1 < self.blocks else (one, one)
                ph = (ph << one) | carry_plus
                mh = (mh << one) | carry_minus
                plus[b][:live] = mh | ~(xv | ph)
                minus[b][:live] = ph & xv
                carry_plus, carry_minus = next_plus, next_minus
        score[own == 0] = size[own == 0]
        out = np.empty(n, np.int64)
        out[order] = score
        return out


class BKTree:
    """Built over distinct keys; ``search`` returns every (text, key, distance) within the text's and the key's own radius.

    The distance is a metric, so with a text at distance d from a node only the child edges from d - radius to d + radius can hold a match.
    Two more bounds cut whole subtrees: the greatest radius of a subtree's keys, and their letters: a text and a key differ by at least as
    many edits as letters that only one of them has (the bag distance, for all keys at once by one matrix product). Keys lie in preorder,
    so a subtree is a stretch of them. All texts descend together, level by level, and every level is one vectorised computation.

    ``radius``: greatest distance of interest per key (none: any); ``classes``: texts and keys meet only within one class.
    """

    def __init__(self, keys: Sequence[str], radius: dict[str, int] | None = None, classes: dict[str, Hashable] | None = None):
        names = sorted(set(keys))
        self.alphabet = {c: i for i, c in enumerate(sorted({c for k in names for c in k}))}
        codes, lengths = _codes(names, self.alphabet)
        n = len(names)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        masks = _Keys(codes, lengths, len(self.alphabet))
        rest, node = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(rest):  # every key still on its way goes down one level
            d = masks.distances(codes, lengths, rest, node)
            order = np.lexsort((rest, d, node))
            rest, node, d = rest[order], node[order], d[order]
            first = np.ones(len(rest), bool)
            first[1:] = (node[1:] != node[:-1]) | (d[1:] != d[:-1])
            parent[rest[first]], edge[rest[first]] = node[first], d[first]
            node = rest[np.maximum.accumulate(np.where(first, np.arange(len(rest)), 0))]
            rest, node = rest[~first], node[~first]
        self._arrange(names, parent, edge)
        codes, lengths = _codes(self.keys, self.alphabet)
        self._masks = _Keys(codes, lengths, len(self.alphabet))
        own = np.array([radius[k] for k in self.keys] if radius is not None else [np.iinfo(np.int32).max] * n, np.int64)
        self.radius, self.reach = own, own.copy()
        for i in range(n - 1, 0, -1):
            self.reach[self._parent[i]] = max(self.reach[self._parent[i]], self.reach[i])
        self._class_ids = {c: i for i, c in enumerate(dict.fromkeys(classes[k] for k in self.keys))} if classes is not None else None
        kind = np.array([self._class_ids[classes[k]] for k in self.keys], np.int64) if classes is not None else np.zeros(n, np.int64)
        counts = self._counts(codes, lengths)
        self._caps = counts.max(axis=0, initial=0)
        # rotations of the same words have the same letters: one bound for all
        bags, self._bag = np.unique(np.column_stack([kind, own, lengths, counts]), axis=0, return_inverse=True) if n else (np.zeros((0, 3 + len(self.alphabet)), np.int64), np.zeros(0, np.int64))
        self._bag = self._bag.ravel()
        self._bag_kind, self._bag_radius, self._bag_length = bags[:, 0], bags[:, 1], bags[:, 2]
        self._bag_letters = self._unary(bags[:, 3:]).T.copy()

    def _arrange(self, names: list[str], parent: np.ndarray, edge: np.ndarray) -> None:
        """Keys in preorder, with the end of each subtree and the children of each node."""
        n = len(names)
        below: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            below[parent[i]].append(i)
        order, todo = [], [0] if n else []
        while todo:
            i = todo.pop()
            order.append(i)
            todo.extend(reversed(below[i]))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.keys = [names[i] for i in order]
        self._parent = np.array([place[parent[i]] if parent[i] >= 0 else -1 for i in order], np.int64)
        self._edge = edge[order]
        size = np.ones(n, np.int64)
        for i in range(n - 1, 0, -1):
            size[self._parent[i]] += size[i]
        self._end = np.arange(n) + size
        by = np.argsort(self._parent[1:], kind="stable") + 1 if n else np.zeros(0, np.int64)
        self._child, self._n_children = by, np.bincount(self._parent[1:], minlength=n) if n else np.zeros(0, np.int64)
        self._child_at = np.cumsum(self._n_children) - self._n_children

    def _counts(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(texts x letters) how often each letter of the alphabet occurs."""
        size = len(self.alphabet) + 1
        inside = np.arange(codes.shape[1])[None, :] < lengths[:, None]
        flat = (np.arange(len(lengths))[:, None] * size + codes)[inside]
        return np.bincount(flat, minlength=len(lengths) * size).reshape(len(lengths), size)[:, :-1]

    def _unary(self, counts: np.ndarray) -> np.ndarray:
        """A letter that occurs k times as k ones: the product of two such rows is the number of letters they share."""
        return np.concatenate([np.zeros((len(counts), 0), np.float32), *[(counts[:, [c]] > np.arange(cap)[None, :]).astype(np.float32) for c, cap in enumerate(self._caps)]], axis=1)

    def search(self, texts: list[str], radius: np.ndarray, classes: list[Hashable] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays (text index, key index, distance). A text much longer than every key can't match and costs nothing."""
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        radius = np.asarray(radius, np.int64)
        if self.keys and texts:
            longest = max(map(len, self.keys))
            able = np.flatnonzero(np.fromiter((len(t) for t in texts), np.int64, len(texts)) <= longest + radius)
            kind = np.zeros(len(texts), np.int64) if self._class_ids is None else np.array([self._class_ids.get(c, -1) for c in classes], np.int64)
            block = max(1, CELLS // len(self.keys))
            for begin in range(0, len(able), block):
                own = able[begin : begin + block]
                found.append(self._descend(own, [texts[i] for i in own], radius[own], kind[own]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _descend(self, ids: np.ndarray, texts: list[str], radius: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, lengths = _codes(texts, self.alphabet)
        shared = self._unary(self._counts(codes, lengths)) @ self._bag_letters
        apart = np.maximum(lengths[:, None], self._bag_length[None, :]) - shared
        near = (apart <= np.minimum(radius[:, None], self._bag_radius[None, :]) + 0.5) & (kind[:, None] == self._bag_kind[None, :])
        before = np.zeros((len(texts), len(self.keys) + 1), np.int32)  # near keys before each place
        np.cumsum(near[:, self._bag], axis=1, out=before[:, 1:])
        text = np.flatnonzero(before[:, -1])
        node = np.zeros(len(text), np.int64)
        out = []
        while len(text):
            d = self._masks.distances(codes, lengths, text, node)
            hit = d <= np.minimum(radius[text], self.radius[node])
            out.append((ids[text[hit]], node[hit], d[hit]))
            n = self._n_children[node]
            pair = np.repeat(np.arange(len(text)), n)
            child = self._child[np.repeat(self._child_at[node], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
            text, d = text[pair], d[pair]
            go = np.abs(d - self._edge[child]) <= np.minimum(radius[text], self.reach[child])
            go &= before[text, self._end[child]] > before[text, child]
            text, node = text[go], child[go]
        kept = out or [(np.zeros(0, np.int64),) * 3]
        at, key, d = (np.concatenate(x) for x in zip(*kept))
        # a hit may come from another class by way of a node
        same = kind[np.searchsorted(ids, at)] == self._bag_kind[self._bag[key]]
        return at[same], key[same], d[same]


def distance(a: str, b: str) -> int:
    """Levenshtein distance of two texts, bit-parallel over one long integer."""
    if a == b or not a or not b:
        return 0 if a == b else len(a) + len(b)
    match: dict[str, int] = {}
    for i, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = whole, 0, len(a)
    for c in b:
        eq = match.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & whole
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 | 1
        mh <<= 1
        plus = (mh | ~(xv | ph)) & whole
        minus = ph & xv & whole
    return score
