"""Evaluation passages that turn up in corpus pages, found with a broadcast set of normalised test n-grams and verified by alignment."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import once

# Letter pairs that scanners take for one letter, and letters they take for one another; both sides are folded alike.
PAIRS = [("rn", "m"), ("in", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ri", "n"), ("lc", "k")]
LETTER_GROUPS = ["eco0anupd(", "iltrjfsvy15!|", "hbk68", "gq9"]

AROUND = 16
MAX_ITEM_WORDS = 400_000  # words of all passages that may be broadcast as n-grams: some 140 MB in each Python worker
TOGETHER = 2_000_000  # cells that are aligned together, counted by whole pages; a byte each


_TABLE = {ord(c): g[0] for g in LETTER_GROUPS for c in g}
_ASCII = bytes(ord(_TABLE.get(b, chr(b))) for b in range(128)) + bytes(range(128, 256))
_DROPPED = bytes(b for b in range(128) if not (chr(b).isalnum() or chr(b).isspace() or b in _TABLE))
_MARKS = re.compile("[\u0300-\u036f]+")
_FOREIGN = re.compile(r"[^\W\d_a-zA-Z]")


class _Fold(dict):
    """Character table for texts with letters beyond ASCII: grouped letters to the group's first, punctuation dropped."""

    def __missing__(self, code: int):
        c = chr(code)
        self[code] = out = _TABLE.get(code, c if c.isalnum() or c.isspace() else None)
        return out


_FOLD = _Fold()


def plain(text: str) -> str:
    """Lower case, old letter shapes and accents made plain."""
    text = text.lower()
    if not text.isascii():  # compatibility forms also make the long s a plain one
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.replace("ß", "ss")))
    return text


def fold(text: str) -> str:
    """``plain`` text with look-alike shapes folded and punctuation dropped; white space stays."""
    for pair, one in PAIRS:
        text = text.replace(pair, one)
    if text.isascii() or not _FOREIGN.search(text):
        return text.replace("\xa0", " ").encode("ascii", "ignore").translate(_ASCII, _DROPPED).decode("ascii")
    return text.translate(_FOLD)


def reading_order(lines: list[str], boxes: list[tuple | None] | None) -> list[int]:
    """Line numbers column by column. Lines without a box stay behind the line they follow; without boxes the order stays."""
    n = len(lines)
    if not boxes or len(boxes) != n or not any(boxes):
        return list(range(n))
    x0 = sorted(b[0] for b in boxes if b)
    widths = sorted(b[2] - b[0] for b in boxes if b)
    gap = max(40, 0.45 * widths[len(widths) // 2])
    starts = [x0[0]]
    for a, b in zip(x0, x0[1:]):
        if b - a > gap:
            starts.append(b)
    keys, last = [], (0, -1.0)
    for i, b in enumerate(boxes):
        if b:
            column = sum(b[0] >= s for s in starts) - 1
            last = (column, float(b[1]))
        keys.append((*last, i))
    return [k[-1] for k in sorted(keys)]


@dataclass(frozen=True)
class Rules:
    """``n``: words of an n-gram; ``window``: passage words among which hits are counted; ``cover``: words in a window that hits must cover
    before a page is put in order; ``chain``: words that hits in passage order must add up to before it is aligned;
    ``run``: passage words in a row that make a case; ``clear``: share of them that must be read."""

    n: int = 3
    window: int = 24
    cover: int = 12
    chain: int = 13
    run: int = 20
    clear: float = 0.88


def page_tokens(lines: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(folded tokens, line number of each, position in its line): words broken at a line end are joined."""
    tokens: list[str] = []
    sizes: list[int] = []
    carried = ""
    folded = fold(plain("\n".join(lines))).split("\n")
    for line, text in zip(lines, folded):
        own = text.split()
        if carried and own:
            tokens[-1] = carried + own.pop(0)
        tokens.extend(own)
        sizes.append(len(own))
        line = line.rstrip()
        carried = tokens[-1] if own and len(line) > 1 and line[-1] in "-¬" and line[-2].isalpha() else ""
    counts = np.array(sizes, np.int64)
    at = np.repeat(np.arange(len(counts)), counts)
    return tokens, at, np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)


def fold_words(line: str) -> list[str]:
    return [w for w in fold(plain(line)).split() if w]


def _near(a: str) -> set[str]:
    """A folded word and, if long, the word with any one letter left out: two words that share one are a misreading apart."""
    return {a, *(a[:i] + a[i + 1 :] for i in range(len(a)))} if len(a) >= 5 else {a}


class Item:
    """A passage prepared for alignment."""

    def __init__(self, passage: str):
        self.words = fold_words(passage)
        self.near: dict[str, set[int]] = defaultdict(set)
        for i, w in enumerate(self.words):
            for x in _near(w):
                self.near[x].add(i)
        self.pairs = {a + b: i for i, (a, b) in enumerate(zip(self.words, self.words[1:]))}


#: how a cell of the alignment is reached
_NEXT, _STRAY, _MISSING, _HALVES, _GLUED, _ENTER, _READ = 1, 2, 3, 4, 5, 6, 8


def align(item: Item, tokens: list[str], line: np.ndarray, pos: np.ndarray, rules: Rules | None = None, hits: list[tuple[int, int]] | None = None) -> tuple[int, int, list[int]]:
    """(passage words in the best stretch, how many of them are read on the page, lines of the page that hold any stretch).

    A run follows the passage word by word. A word of the page may be misread (no match, at a cost), broken in two or
    glued to the next; between two lines of the page any number of lines may stand that don't belong to the article. Anything else ends
    the run, so the same words in another order don't add up. A run may go on through badly read text, so each of its stretches is judged:
    one of ``rules.run`` or more passage words, from a read word to a read word, of which the share ``rules.clear`` is read. With
    ``hits`` (passage place, page place) only their neighbourhood is looked at.
    """
    rules = rules or Rules()
    sheet = Sheet.of(item, tokens, line, pos, rules, hits)
    return settle([sheet], rules)[0][:3] if sheet else (0, 0, [])


@dataclass(frozen=True)
class Sheet:
    """The cells of one alignment: a row per passage word, a column per token of the page."""

    rows: int
    at: np.ndarray  # token of each column; -1: between two neighbourhoods
    ends: np.ndarray
    starts: np.ndarray
    equal: tuple[list[int], list[int]]  # rows and columns
    halves: tuple[list[int], list[int]]  # the row's word is this token and the one before
    glued: tuple[list[int], list[int]]  # the row's word and the one before are this token
    line: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, item: Item, tokens: list[str], line: np.ndarray, pos: np.ndarray, rules: Rules, hits: list[tuple[int, int]] | None) -> Sheet | None:
        """None if no stretch can make a case."""
        m = len(item.words)
        if not len(tokens) or not m:
            return None
        lengths = np.bincount(line)
        low, high = (max(0, min(k for k, _ in hits) - AROUND), min(m, max(k for k, _ in hits) + AROUND)) if hits else (0, m)
        at = _around([j for _, j in hits], len(tokens)) if hits else np.arange(len(tokens))
        equal, halves, glued = ([], []), ([], []), ([], [])
        # two bits a token, so that two glued words come one after the other
        places = [0] * (high - low)
        known: dict[str, list[int]] = {}
        near, pairs = item.near, item.pairs
        last = ""
        for j, a in enumerate(at.tolist()):
            t = tokens[a] if a >= 0 else ""
            if t:
                own = known.get(t)
                if own is None:
                    own = known[t] = [i - low for i in set().union(*(near[x] for x in _near(t) if x in near)) if low <= i < high]
                for i in own:
                    equal[0].append(i)
                    equal[1].append(j)
                    places[i] |= 2 << 2 * j
                if last and (joined := last + t) in near:
                    for i in near[joined]:
                        if low <= i < high:
                            halves[0].append(i - low)
                            halves[1].append(j)
                            places[i - low] |= 2 << 2 * j
                if (i := pairs.get(t)) is not None:
                    if low <= i + 1 < high:
                        glued[0].append(i + 1 - low)
                        glued[1].append(j)
                        places[i + 1 - low] |= 2 << 2 * j
                    if low <= i < high:
                        places[i - low] |= 1 << 2 * j
            last = t
        if not in_order(places, 2 * len(at), rules):
            return None
        outside = at < 0
        return cls(high - low, at, (pos >= lengths[line] - 2)[at] & ~outside, (pos <= 1)[at] & ~outside, equal, halves, glued, line, lengths)


_LOW = -(1 << 29)
_BACK = np.array([0, 1, 2, 0])  # columns back to where a cell comes from, by how it is reached


def settle(sheets: list[Sheet], rules: Rules) -> list[tuple[int, int, list[int], np.ndarray]]:
    """``align`` for each sheet, and which tokens of its page the stretches take up.

    Sheets lie side by side, those with most rows first and two empty columns before each, and are filled together row by row: a row takes
    the same array operations however many sheets it has. Scores are doubled and so whole.
    """
    order = sorted(range(len(sheets)), key=lambda k: -sheets[k].rows)
    own = [sheets[k] for k in order]
    bounds = np.cumsum([0, *(len(s.at) + 2 for s in own)])
    gap = np.array([-1, -1])
    at = np.concatenate([x for s in own for x in (gap, s.at)])
    sheet_of = np.repeat(np.arange(len(own)), np.diff(bounds))
    ends, starts = (np.concatenate([x for s in own for x in (gap < -1, getattr(s, side))]) for side in ("ends", "starts"))
    outside = np.flatnonzero(at < 0)
    n_rows = own[0].rows
    heights = np.array([s.rows for s in own])
    widths = [int(bounds[np.searchsorted(-heights, -r, "left")]) for r in range(n_rows)]  # of the sheets that have this row

    def by_row(kind: str) -> list[np.ndarray]:
        rows = np.concatenate([np.array(getattr(s, kind)[0], np.int64) for s in own])
        columns = np.concatenate([np.array(getattr(s, kind)[1], np.int64) + (b + 2) for s, b in zip(own, bounds)])
        by = np.argsort(rows, kind="stable")
        return np.split(columns[by], np.searchsorted(rows[by], np.arange(1, n_rows)))

    one_bit = np.uint64(1)
    least = np.uint64(1 << (rules.run - 1) if rules.run <= 40 else 1)
    # score of each cell of a row, and which of the last 64 passage words are read; what the latter says of a cell without a score is left open
    prev = prev2 = np.full(len(at), _LOW, np.int32)
    read = read2 = np.zeros(len(at), np.uint64)
    live = np.zeros(0, np.int64)
    moves: list[bytes] = []
    jumps: dict[tuple[int, int], int] = {}
    met: list[tuple[np.ndarray, ...]] = []  # (passage word, column, score, words read) of cells that may end a stretch
    for r, (w, equal, halves, glued) in enumerate(zip(widths, by_row("equal"), by_row("halves"), by_row("glued"))):
        one, two, none = prev[1 : w - 1], prev[: w - 2] - 2, prev[2:w]  # the next token, one after a stray token, a word that isn't there
        step = np.maximum(one, two)
        score = np.full(w, _LOW, np.int32)
        np.maximum(step, none, out=score[2:])
        score[2:] -= 4
        e = equal - 2
        here = step[e]
        ahead, missed = np.maximum(here, 0) + 2, none[e] - 4
        score[equal] = np.maximum(ahead, missed)
        score[outside[: np.searchsorted(outside, w)]] = _LOW
        changed: list[tuple[np.ndarray, int, np.ndarray]] = []

        def offer(cells, source, scores, gain, bits, words, new, code):
            s = scores[source] + gain
            better = (s > score[cells]) & (s > 0)
            if better.any():
                cells, source = cells[better], source[better]
                score[cells] = s[better]
                changed.append((cells, code, bits[source] << np.uint64(words) | np.uint64(new)))
                if code == _ENTER:
                    jumps.update(zip(((r, c) for c in cells.tolist()), source.tolist()))

        if len(halves):
            offer(halves, halves - 2, prev, 2, read, 1, 1, _HALVES)
        if len(glued):
            offer(glued, glued - 1, prev2, 4, read2, 2, 3, _GLUED)
        enter = equal[starts[equal]]
        if len(enter) and len(leave := live[ends[live]]):  # over lines that don't belong: from a line end to any later line start
            value = prev[leave] + (sheet_of[leave] << 32)
            top = np.maximum.accumulate(value)
            where_top = np.maximum.accumulate(np.where(value >= top, np.arange(len(leave)), 0))
            x = np.searchsorted(leave, enter - 2, "right") - 1
            same = (x >= 0) & (sheet_of[leave[x]] == sheet_of[enter])
            offer(enter[same], leave[where_top[x[same]]], prev, -3, read, 1, 1, _ENTER)
        live = np.flatnonzero(score > 0)
        c = live - 2
        move = np.zeros(w, np.int8)
        move[live] = np.where(none[c] > step[c], _MISSING, np.where(two[c] > one[c], _STRAY, _NEXT))
        code = np.where(missed > ahead, _MISSING, np.where(here <= 0, 0, np.where(two[e] > one[e], _STRAY, _NEXT)))
        move[equal] = code
        now = np.zeros(w, np.uint64)
        now[live] = read[live - _BACK[move[live]]] << one_bit
        now[equal] = np.where(code == 0, one_bit, now[equal] | (code != _MISSING))
        move[equal] |= _READ
        for cells, how, bits in changed:
            move[cells] = how
            now[cells] = bits
        words = now[live]
        if len(found := np.flatnonzero((words >= least) & ((words & one_bit) == 1))):
            cells = live[found]
            met.append((np.full(len(cells), r), cells, score[cells], words[found]))
        moves.append(move.tobytes())
        score[score <= 0] = _LOW
        prev2, read2, prev, read = prev, read, score, now
    out = [(0, 0, [], np.zeros(len(s.line), bool)) for s in sheets]
    if not met:
        return out
    rows, cells, scores, reads = (np.concatenate(x) for x in zip(*met))
    if rules.run <= 40:  # a longer stretch holds one of up to 64 words; beyond, every path is followed
        good = np.zeros(len(rows), bool)
        for k in range(rules.run, 65):
            window = reads & np.uint64((1 << k) - 1)
            good |= (np.bitwise_count(window) >= rules.clear * k) & (window >> np.uint64(k - 1) == 1)
        rows, cells, scores = rows[good], cells[good], scores[good]
    by = np.lexsort((-scores, sheet_of[cells]))
    rows, cells = rows[by], cells[by]
    for k, own_rows, own_cells in zip(order, *(np.split(x, np.searchsorted(sheet_of[cells], np.arange(1, len(own)))) for x in (rows, cells))):
        if len(own_rows):
            out[k] = _judged(sheets[k], moves, jumps, at, zip(own_rows.tolist(), own_cells.tolist()), rules)
    return out


def _judged(sheet: Sheet, moves: list[bytes], jumps: dict[tuple[int, int], int], at: np.ndarray, ends: Iterator[tuple[int, int]], rules: Rules) -> tuple[int, int, list[int], np.ndarray]:
    """What ``settle`` gives for a sheet of which the runs that end at ``ends`` are to be judged, those with the highest scores first."""
    best, used = (0, 0, 0), np.zeros(len(sheet.line), bool)
    visited: set[tuple[int, int]] = set()
    for end in ends:
        if end in visited:
            continue
        path = _path(moves, jumps, *end, visited)
        new = at[[j for _, js in path for j in js]]
        if sum(p[0] for p in path) <= best[0] and (~used[new]).sum() < rules.clear * rules.run:
            continue  # neither better nor anywhere else
        for a, b in stretches(np.array([p[0] for p in path]), rules):
            own = sorted({int(at[j]) for _, js in path[a:b] for j in js})
            seen = sum(p[0] for p in path[a:b])
            worth = (3 * seen - 2 * (b - a), b - a, seen)  # as scored: a word read, less two for one that isn't
            if worth > best:
                best = worth
            if (~used[own]).sum() >= rules.clear * rules.run:  # not the stretch before by another way
                used[own] = True
    share = np.bincount(sheet.line[used], minlength=len(sheet.lengths)) / np.maximum(sheet.lengths, 1)
    return best[1], best[2], np.flatnonzero(share >= 0.5).tolist(), used


def _around(places: list[int], n: int) -> np.ndarray:
    """Places up to 4 * AROUND from one of ``places``, in order; two cells of -1 where some are left out, so that no step leads across."""
    near = np.zeros(n + 1, np.int64)
    for j in places:
        near[max(0, j - 4 * AROUND)] += 1
        near[min(n, j + 4 * AROUND)] -= 1
    kept = np.flatnonzero(np.cumsum(near[:n]) > 0)
    breaks = np.flatnonzero(np.diff(kept) > 1) + 1
    return np.insert(kept, np.repeat(breaks, 2), -1)


def _path(moves: list[bytes], jumps: dict[tuple[int, int], int], i: int, j: int, visited: set[tuple[int, int]]) -> list[tuple[bool, tuple[int, ...]]]:
    """(read, columns) per passage word of the run that ends at row ``i`` and column ``j``."""
    out: list[tuple[bool, tuple[int, ...]]] = []
    while True:
        visited.add((i, j))
        code = moves[i][j]
        read, code = bool(code & _READ), code & ~_READ
        if code == _MISSING:
            out.append((False, ()))
            i -= 1
        elif code == _HALVES:
            out.append((True, (j - 1, j)))
            i, j = i - 1, j - 2
        elif code == _GLUED:
            out += [(True, (j,)), (True, ())]
            i, j = i - 2, j - 1
        elif code == _ENTER:
            out.append((True, (j,)))
            i, j = i - 1, jumps[i, j]
        else:
            out.append((read, (j,)))
            if not code:
                return out[::-1]
            i, j = i - 1, j - code


def stretches(read: np.ndarray, rules: Rules) -> list[tuple[int, int]]:
    """The stretches [a, b) of a run that make a case: the best one, then the best of what is left on both sides of it."""
    sums = np.concatenate([[0], np.cumsum(read)])
    out, todo = [], [(0, len(read))]
    while todo:
        low, high = todo.pop()
        best = None
        begins = np.flatnonzero(read[low:high]) + low
        b = begins + 1
        for block in range(0, len(begins), 256):
            a = begins[block : block + 256, None]
            seen = sums[b] - sums[a]
            worth = np.where((b - a >= rules.run) & (seen >= rules.clear * (b - a)), 3 * seen - 2 * (b - a), -(10**9))
            x, y = np.unravel_index(int(worth.argmax()), worth.shape)
            if worth[x, y] > (best[0] if best else -(10**9)):
                best = (int(worth[x, y]), int(a[x, 0]), int(b[y]))
        if best:
            out.append(best[1:])
            todo += [x for x in ((low, best[1]), (best[2], high)) if x[1] - x[0] >= rules.run]
    return out


def in_order(places: list[int], width: int, rules: Rules) -> bool:
    """Whether a stretch that makes a case is possible: a bound that costs a hundredth of the alignment.

    ``places``: per passage word the bits of the page places where it is read. The words of a run are read in page order, so no stretch reads more
    of them than the longest common subsequence (bit-parallel over one integer). A stretch with at most (1 - clear) of its words unread has
    ``rules.run`` words in a row with less than twice that share of them unread: without such words there is no case.
    """
    run, whole = rules.run, (1 << width) - 1
    need = run - (math.ceil(2 * (1 - rules.clear) * run - 1e-9) - 1)
    known = np.concatenate([[0], np.cumsum([bool(p) for p in places])])
    for a in range(len(places) - run + 1):
        if known[a + run] - known[a] >= need:
            free = whole
            for p in places[a : a + run]:
                met = free & p
                free = (free + met | free - met) & whole
            if width - free.bit_count() >= need:
                return True
    return False


def in_window(starts: set[int], n: int, window: int) -> int:
    """Most passage words that n-grams beginning at ``starts`` cover within ``window`` words."""
    covered = sorted({s + k for s in starts for k in range(n)})
    most = low = 0
    for high, value in enumerate(covered):
        while value - covered[low] >= window:
            low += 1
        most = max(most, high - low + 1)
    return most


def chained(hits: list[tuple[int, int]], n: int, least: int) -> list[tuple[int, int]]:
    """The hits (passage place, page place) of every chain in the order of both, and what branches off it, that covers ``least`` or more
    passage words; leaving the diagonal costs two words."""
    hits = sorted(hits)
    value = [n] * len(hits)
    first = list(range(len(hits)))
    # per passage place: its hits, their page places, and the best of them so far in page order
    places: dict[int, tuple[int, list[int], list[int]]] = {}
    start = 0
    while start < len(hits):
        k, end = hits[start][0], start
        while end < len(hits) and hits[end][0] == k:
            j = hits[end][1]
            for dk in range(1, 5 * n + 1):
                if k - dk not in places:
                    continue
                begin, js, top = places[k - dk]
                here = bisect_left(js, j)
                for b in range(bisect_left(js, j - dk - 2), min(here, bisect_left(js, j - dk + 3))):
                    if (worth := value[begin + b] + min(dk, n)) > value[end]:
                        value[end], first[end] = worth, first[begin + b]
                if here and (worth := value[top[here - 1]] + min(dk, n) - 2) > value[end]:
                    value[end], first[end] = worth, first[top[here - 1]]
            end += 1
        top = []
        for x in range(start, end):
            top.append(x if not top or value[x] >= value[top[-1]] else top[-1])
        places[k] = (start, [j for _, j in hits[start:end]], top)
        start = end
    enough = {first[a] for a, v in enumerate(value) if v >= least}
    return [h for h, f in zip(hits, first) if f in enough]


def diagonals(hits: list[tuple[int, int]], n: int, least: int) -> list[list[tuple[int, int]]]:
    """The hits of each unbroken copy that covers ``least`` or more passage words: places on the page go with those in the passage."""
    runs: list[list[tuple[int, int]]] = []
    worth: list[int] = []
    last: dict[int, int] = {}  # by page place less passage place
    for k, j in sorted(hits):
        near = [last[d] for d in range(j - k - 2, j - k + 3) if d in last and 0 < k - runs[last[d]][-1][0] <= 5 * n and j > runs[last[d]][-1][1]]
        if near:
            r = max(near, key=worth.__getitem__)
            worth[r] += min(k - runs[r][-1][0], n)
            runs[r].append((k, j))
        else:
            r = len(runs)
            runs.append([(k, j)])
            worth.append(n)
        last[j - k] = r
    return [r for r, w in zip(runs, worth) if w >= least]


class Passages:
    """The n-grams of all passages, each with the places (item, word number) where it begins."""

    def __init__(self, items: list[tuple[int, str]], rules: Rules):
        self.rules = rules
        self.texts = dict(items)
        self.grams: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, passage in items:
            ws = fold_words(passage)
            for k in range(len(ws) - rules.n + 1):
                self.grams[" ".join(ws[k : k + rules.n])].append((i, k))
        self._keys = frozenset(self.grams)
        self._items: dict[int, Item] = {}

    def candidates(self, text: str) -> list[int]:
        """Items whose n-grams cover enough of a window, the page's lines taken as they come."""
        n, grams = self.rules.n, self.grams
        hits: dict[int, set[int]] = {}
        ws = fold(plain(text)).split()
        for gram in self._keys.intersection(map(" ".join, zip(*(ws[k:] for k in range(n))))):
            for i, k in grams[gram]:
                hits.setdefault(i, set()).add(k)
        return [i for i, starts in hits.items() if n * len(starts) >= self.rules.cover and in_window(starts, n, self.rules.window) >= self.rules.cover]

    def verify(self, text: str, boxes: list[tuple | None] | None, items: list[int]) -> list[tuple[int, int, int, list[int]]]:
        """(item, run, words read, line numbers) of the cases among ``items``."""
        return [(i, *case) for i, _, *case in self.verify_all([(None, text, boxes, items)])]

    def verify_all(self, pages: Iterable[tuple]) -> Iterator[tuple]:
        """(item, key, run, words read, line numbers) of the cases on ``pages`` (key, text, boxes, items): many pages are aligned together."""
        held: list[tuple] = []
        size = 0
        for key, text, boxes, items in pages:
            lines = text.split("\n")
            order = reading_order(lines, boxes)
            page = page_tokens([lines[i] for i in order])
            for i, hits in self._chains(page[0], items):
                if i not in self._items:
                    self._items[i] = Item(self.texts[i])
                sheet = Sheet.of(self._items[i], *page, self.rules, hits)
                if sheet:
                    held.append((key, i, order, page, hits, sheet))
                    size += sheet.rows * (len(page[0]) + len(sheet.at))
                    if size >= TOGETHER:
                        yield from self._cases(held)
                        held, size = [], 0
        if held:
            yield from self._cases(held)

    def _chains(self, tokens: list[str], items: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Items whose hits on the page follow the passage, with these hits."""
        n = self.rules.n
        hits: dict[int, list[tuple[int, int]]] = {i: [] for i in items}
        for j in range(len(tokens) - n + 1):
            for i, k in self.grams.get(" ".join(tokens[j : j + n]), ()):
                if i in hits:
                    hits[i].append((k, j))
        for i, own in hits.items():
            if own := chained(own, n, self.rules.chain):
                yield i, own

    def _cases(self, held: list[tuple]) -> Iterator[tuple]:
        rules = self.rules
        for (key, i, order, page, hits, _), (*whole, used) in zip(held, settle([h[-1] for h in held], rules)):
            # all together, as a run may go on over foreign lines; a copy that this leaves out also alone, as a run may leave it for a longer but worse one
            cases = [whole]
            copies = diagonals(hits, rules.n, rules.chain)
            if len(copies) > 1:
                cases += [align(self._items[i], *page, rules, copy) for copy in copies if not used[[j for _, j in copy]].all()]
            run, seen, _ = max(cases, key=lambda c: (3 * c[1] - 2 * c[0], c[0]))
            if run:
                yield i, key, run, seen, sorted({order[x] for _, _, at in cases for x in at})


_LEAKS = "item_id bigint, doc_id bigint, run int, words_read int, lines array<int>"


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", boxes: str | None = "line_boxes", item_id: str = "item_id", passage: str = "passage", rules: Rules | None = None, max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """(item_id, doc_id, run, words_read, lines): pages that hold ``rules.run`` or more words in a row of an item's passage.
    Of several runs of an item on a page the best is given, with the lines of all.

    One scan of the documents without a shuffle: the passages' n-grams are broadcast as a hash set, built once per Python worker; a page whose lines hit
    enough of one passage is put in reading order, and if the hits then follow the passage, aligned word by word. ``lines`` are the
    numbers of the page's lines that hold a run. Passages are counted first: beyond ``max_words`` words they are split by a hash
    of the id and the documents scanned once per part. Null or empty texts and passages, and null ids, give no rows; lines without a
    box are read after the line before them; a repeated page gives a row each time. Other columns aren't read.
    """
    rules = rules or Rules()
    spark = documents.sparkSession
    listed = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).alias("p")).where("i IS NOT NULL AND p IS NOT NULL").distinct()
    size = listed.agg(F.sum(F.size(F.split("p", r"\s+")))).first()[0] or 0
    parts = max(1, -(-size // max_words))
    frame = [F.col(f"{boxes}.{c}").alias(c) if boxes else F.lit(None).cast("array<int>").alias(c) for c in ("x0", "y0", "x1")]
    pages = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"), *frame).where("d IS NOT NULL AND t IS NOT NULL")
    out = None
    for part in range(parts):
        own = listed if parts == 1 else listed.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([(r.i, r.p) for r in own.collect()])  # counted above

        def suspects(columns: dict[str, pa.Array], passages: Passages) -> Iterator[tuple]:
            for k, page in enumerate(columns["t"].to_pylist()):
                near = passages.candidates(page)
                if near:
                    xs = [columns[c][k].as_py() for c in ("x0", "y0", "x1")]
                    frames = [None if None in b else b for b in zip(*xs)] if None not in xs else None
                    yield columns["d"][k].as_py(), page, frames, near

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = once(shared, lambda own: Passages(own, rules))
            for batch in batches:
                columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                rows = list(passages.verify_all(suspects(columns, passages)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())))],
                    ["item_id", "doc_id", "run", "words_read", "lines"],
                )

        found = pages.mapInArrow(scan, _LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(documents: DataFrame, leaks: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spans_only: bool = False) -> DataFrame:
    """``documents`` without the leaking pages, or, if ``spans_only``, with the leaking lines cut out of their text.

    Pages with a null id or text can't leak and stay.
    """
    hit = leaks.select(F.col("doc_id").alias("_d"), F.explode("lines").alias("_l")).groupBy("_d").agg(F.collect_set("_l").alias("_lines"))
    if not spans_only:
        return documents.join(leaks.select(F.col("doc_id").alias("_d")).distinct(), F.col(doc_id) == F.col("_d"), "left_anti")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_lines", i)), "\n")
    joined = documents.join(hit, F.col(doc_id) == F.col("_d"), "left")
    return joined.select(*[F.when(F.col("_lines").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in documents.columns])
