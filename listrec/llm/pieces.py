"""SentencePiece encoding and decoding with sampled segmentations.

A text's lattice has an edge for every piece of the vocabulary that matches at a
position, and exact backward sums give the probability of each edge there.  No
piece goes on past the end of a word, so the lattices of a batch's distinct words
are built together, position by position in arrays.  A perturbed A-star search
walks this lattice: every set of paths carries the greatest Gumbel-perturbed
log-probability of its members, the set with the greatest value is opened next,
and opening it fixes its best path and leaves the sets that branch off along it.
Paths therefore come out in perturbed order, all distinct, as a sample without
replacement; with the next value as threshold each gets its inclusion score.  The
noise is a hash of the row's key and the place in its text, so a row gives the
same sample wherever it runs.
"""

from __future__ import annotations

import gc
import math
import os
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
TEMPER = 0.35
#: Bytes of the vocabulary as characters that no piece holds.
BYTES = 0xF0000
WORD = re.compile(f"{BLANK}+[^{BLANK}\U000F0000-\U000F00FF]*|[^{BLANK}\U000F0000-\U000F00FF]+|[\U000F0000-\U000F00FF]")
#: Characters of texts that are worked on together; a longer text goes alone.
TOGETHER = 2_000_000
#: Characters of words whose lattices are built together.
BUILD = 100_000
#: Characters of the words that are known at most when a batch begins; beyond it they are forgotten and met anew.
KNOWN = 2_000_000
#: Foreign characters of a batch that are replaced one after the other; more are replaced by the pattern.
FEW = 8
#: Sets this far (in log-probability) below the first of a path are drawn as one, and split if they are ever opened.
DEPTH = 20.0
#: Random numbers drawn ahead for each path of a text.
AHEAD = 64
#: Longest rest of a word whose sums are plain: they stay far above the least double.
PLAIN = 150
# Multipliers of the 64-bit mixing function and its increment.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 from hashes."""
    return ((mixed(h) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


@dataclass
class Vocabulary:
    """The processor and its pieces.

    ``ids`` names the pieces that text is spelled with, bytes as single characters
    from ``BYTES`` on.  ``weight`` is the log of a piece's weight.  The prefixes of
    the pieces are numbered; ``slot_key`` and ``slot_child`` are a hash table from a
    prefix and a character to the longer prefix, and ``piece`` is the piece that a
    prefix is, or -1.  ``single`` is the prefix of one character.  ``foreign`` matches characters that are spelled in bytes.
    """

    processor: sentencepiece.SentencePieceProcessor
    ids: dict[str, int]
    weight: np.ndarray
    bytes: np.ndarray
    slot_key: np.ndarray
    slot_child: np.ndarray
    piece: np.ndarray
    single: np.ndarray
    foreign: re.Pattern

    def child(self, prefix: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The prefixes longer by one character, -1 where no piece begins so."""
        key = (prefix.astype(np.int64) << 21) | char
        slot = place(key, len(self.slot_key))
        found = self.slot_key[slot]
        look = np.nonzero((found != key) & (found >= 0))[0]
        while len(look):
            slot[look] = (slot[look] + 1) % len(self.slot_key)
            found[look] = self.slot_key[slot[look]]
            look = look[(found[look] != key[look]) & (found[look] >= 0)]
        return np.where(found == key, self.slot_child[slot], -1)


def place(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * STEP) >> np.uint64(65 - size.bit_length())).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(model: str = MODEL, temper: float = TEMPER) -> Vocabulary:
    """Load a model file, by its path or as a file shipped with the application (``--files``).

    The model ranks its pieces but has no probabilities, so a piece's log weight is
    taken as -log(10 + rank), flattened by ``temper``.
    """
    p = sentencepiece.SentencePieceProcessor(model_file=model if os.path.exists(model) else SparkFiles.get(os.path.basename(model)))
    n = p.get_piece_size()
    byte_ids = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    ids = {p.id_to_piece(i): i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
    single = {w for w in ids if len(w) == 1}
    if "\n" in single or any(not set(w) <= single or len(WORD.findall(w)) > 1 for w in ids):
        raise ValueError("a piece of the model goes past a word or holds a character that is no piece")
    ids |= {chr(BYTES + b): i for b, i in enumerate(byte_ids.tolist())}
    longer: dict[tuple[int, int], int] = {}
    piece = [-1]
    for name, i in ids.items():
        at = 0
        for c in map(ord, name):
            if (at, c) not in longer:
                longer[at, c] = len(piece)
                piece.append(-1)
            at = longer[at, c]
        piece[at] = i
    size = 1 << (4 * len(longer)).bit_length()
    slot_key, slot_child = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
    keys = np.array([a << 21 | c for a, c in longer], np.int64)
    for key, at, child in zip(keys.tolist(), place(keys, size).tolist(), longer.values(), strict=True):
        while slot_key[at] >= 0:
            at = (at + 1) % size
        slot_key[at], slot_child[at] = key, child
    one = np.full(0x110000, -1, np.int32)
    for (at, c), child in longer.items():
        if not at:
            one[c] = child
    weight = np.array([-temper * math.log(10 + max(0.0, -p.get_score(i))) for i in range(n)])
    foreign = re.compile(f"[^{re.escape(''.join(sorted(single - {BLANK} | {' '})))}]+")
    return Vocabulary(p, ids, weight, byte_ids, slot_key, slot_child, np.array(piece, np.int32), one, foreign)


def spelled(chars: str) -> str:
    """The bytes of foreign characters, each as a word of its own."""
    return "\n" + "\n".join([chr(BYTES + b) for b in chars.encode("utf-8", "replace")]) + "\n"


def split(texts: list[str | None], v: Vocabulary) -> Iterator[list[str]]:
    """The words of each text as it is spelled: blanks marked, one in front, foreign characters as bytes.

    A literal U+2581 is foreign, so that decoding returns it.  No piece holds a line
    break, so line breaks part the words meanwhile.
    """
    seen = np.zeros(0x110000, bool)
    for t in texts:
        if t:
            seen[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] = True
    found = [c for c in map(chr, np.nonzero(seen)[0].tolist()) if v.foreign.match(c)]
    few = None
    if len(found) <= FEW and not any(BYTES <= ord(c) < BYTES + 256 for c in found):
        few = [(c, spelled(c)) for c in sorted(found, key="\n".__ne__)]  # line breaks first, as the others bring some
    for t in texts:
        if not t:
            yield []
            continue
        if few is None:
            t = v.foreign.sub(lambda m: spelled(m[0]), t)
        else:
            for c, instead in few:
                t = t.replace(c, instead)
        t = f" {t}".replace(" ", f"\n{BLANK}")
        while f"{BLANK}\n{BLANK}" in t:  # a run of blanks is one mark
            t = t.replace(f"{BLANK}\n{BLANK}", BLANK * 2)
        yield list(filter(None, t.split("\n")))


def best_pieces(words: list[str], v: Vocabulary) -> list[list[int]]:
    """Best segmentation of each word by the processor, which puts a mark before every text."""
    inner = [w[1:].replace(BLANK, " ") if w[0] == BLANK else "\n" + w for w in words]  # no mark goes on after a line break
    collects = gc.isenabled()
    gc.disable()  # so many new lists would set off collections, and none of them is in a cycle
    try:
        found = v.processor.encode(inner, num_threads=1) if inner else []  # the executor has tasks for its other cores
    finally:
        if collects:
            gc.enable()
    for i, w in enumerate(words):
        if w[0] != BLANK:
            found[i] = [v.ids[w]] if BYTES <= ord(w[0]) < BYTES + 256 else found[i][2:]
        elif len(w) == 1:
            found[i] = [v.ids[w]]
    return found


def encode(text: str | None, v: Vocabulary) -> list[int]:
    """Best segmentation of one text."""
    return [i for ids in best_pieces(next(split([text], v)), v) for i in ids]


def decode(ids: Sequence[int], v: Vocabulary) -> str:
    """The text of a segmentation."""
    return v.processor.decode([int(i) for i in ids]) if len(ids) else ""


def weigh(pieces: np.ndarray, then: np.ndarray, first: np.ndarray, last: np.ndarray, weight: np.ndarray, at_distance: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probabilities of the edges by backward sums, all states at one distance from their word's end together.

    Near the end they are plain sums of products, further off sums of logarithms.
    """
    n, linear = len(first), len(at_distance) <= PLAIN or int(at_distance[:PLAIN].sum())
    near = n if linear is True else linear
    plain, beta, w = np.exp(weight)[pieces], np.ones(n + 1), None
    states = np.cumsum(at_distance)
    for d, (a, b) in enumerate(zip(states[:-1].tolist(), states[1:].tolist(), strict=True), 1):
        if a == b:
            continue
        lo, hi = int(first[a]), int(last[b - 1]) + 1
        firsts = first[a:b] - lo
        if b <= near:
            beta[a:b] = np.add.reduceat(plain[lo:hi] * beta[then[lo:hi]], firsts)
            continue
        if w is None:
            w, logs = weight[pieces], np.log(beta)
        x = w[lo:hi] + logs[then[lo:hi]]
        top = np.maximum.reduceat(x, firsts)
        logs[a:b] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count[a:b])), firsts))
    cut = int(first[near]) if near < n else len(plain)
    p = plain[:cut] * beta[then[:cut]] / np.repeat(beta[:near], count[:near])
    if near < n:
        far = np.exp(w[cut:] + logs[then[cut:]] - np.repeat(logs[near:n], count[near:]))
        p = np.concatenate((p, far))
    p = np.minimum(p, 1 - 2.0**-53)
    p[first[count == 1]] = 1.0  # where there is no other edge, and only there
    return p


def longer(a: np.ndarray, parts: Sequence[np.ndarray]) -> np.ndarray:
    """An array with others behind it; where they are put there is room for more, so that few are copied."""
    n, room = len(a) + sum(map(len, parts)), a.base
    if room is None or len(room) < n:
        room = np.empty(n + n // 2, a.dtype)
        room[: len(a)] = a
    np.concatenate(parts, out=room[len(a) : n])
    return room[:n]


class Lattice:
    """Lattices of words: a state is a position in a word, an edge a piece that matches there.

    A word's first state is in ``start``, and all words end in the state ``end``, the
    first of all; words that are added get the numbers after those there.  The edges
    of a state begin in ``first`` and end where those of the next state begin, shortest piece first.  ``p`` is an edge's
    probability among all ways to spell the rest of the word.
    """

    end = 0

    def __init__(self, words: list[str], v: Vocabulary) -> None:
        self.start, self.first = np.empty(0, np.int64), np.zeros(2, np.int32)
        self.piece, self.then, self.p = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)
        self.add(words, v)

    def add(self, words: list[str], v: Vocabulary) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, size.sum(), BUILD))).tolist()
        built, state, edge = [], len(self.first) - 1, len(self.p)
        for a, b in zip(cuts, [*cuts, len(words)][1:], strict=True):
            built.append(self.build(words[a:b], size[a:b], v, state, edge))
            state, edge = state + len(built[-1][1]), edge + len(built[-1][2])
        for name, parts in zip(("start", "first", "piece", "then", "p"), zip(*built, strict=True), strict=bool(built)):
            setattr(self, name, longer(getattr(self, name), parts))

    def build(self, words: list[str], size: np.ndarray, v: Vocabulary, state: int, edge: int) -> tuple[np.ndarray, ...]:
        """The lattices of some words, whose states and edges are numbered from ``state`` and ``edge`` on.

        States come by their distance from the end of their word.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(codes)
        begins = np.cumsum(size) - size
        word_end = np.repeat(begins + size, size)
        left = word_end - np.arange(n)
        order = np.argsort(left.astype(np.int16) if n and left.max() < 1 << 15 else left, kind="stable")  # short keys sort faster
        number = np.empty(n + 1, np.int64)
        number[order] = np.arange(n)
        number[n] = n
        count = np.zeros(n, np.int64)
        found, at, length, prefix = [], np.arange(n), 1, v.single[codes]
        while len(at):
            there = v.piece[prefix]
            hit = np.nonzero(there >= 0)[0]
            of = at[hit]
            to = of + length
            from_state = number[of]
            found.append((from_state, there[hit], np.where(to == word_end[of], n, number[to])))
            count[from_state] += 1
            on = np.nonzero(at + length < word_end[at])[0]
            at = at[on]
            prefix = v.child(prefix[on], codes[at + length])
            on, length = np.nonzero(prefix >= 0)[0], length + 1
            at, prefix = at[on], prefix[on]
        ends = np.cumsum(count)
        first, last = ends - count, ends - 1
        edges = int(ends[-1]) if n else 0
        pieces, then = np.empty(edges, np.int32), np.empty(edges, np.int32)
        filled = first.copy()
        for from_state, piece, to in found:
            e = filled[from_state]
            pieces[e], then[e] = piece, to
            filled[from_state] += 1
        p = weigh(pieces, then, first, last, v.weight, np.bincount(left), count)
        then = np.where(then == n, self.end, then + state).astype(np.int32)
        return number[begins] + state, (ends + edge).astype(np.int32), pieces, then, p

    def walk(self, state: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a random path from each state to its word's end, path after path, and where each begins."""
        who, count, steps = np.arange(len(state)), np.zeros(len(state), np.int64), []
        while len(state):
            u, e, last = uniform(seed), self.first[state].astype(np.int64), self.first[state + 1] - 1
            u -= self.p[e]
            on = np.nonzero((u > 0) & (e < last))[0]
            while len(on):
                e[on] += 1
                u[on] -= self.p[e[on]]
                on = on[(u[on] > 0) & (e[on] < last[on])]
            steps.append((who, e))
            count[who] += 1
            state = self.then[e]
            on = np.nonzero(state != self.end)[0]
            state, who, seed = state[on], who[on], seed[on] + STEP
        begins = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(begins[-1], np.int64)
        for j, (who, e) in enumerate(steps):
            out[begins[who] + j] = e
        return out, begins

    def left(self, edge: int, out: set[int]) -> np.ndarray:
        """The edges of an edge's state less those in ``out``."""
        state = int(np.searchsorted(self.first, np.int32(edge), side="right")) - 1
        return np.array([e for e in range(self.first[state], self.first[state + 1]) if e not in out], np.int64)

    def others(self, edges: np.ndarray) -> np.ndarray:
        """Log-probability of the other edges of each edge's state."""
        p = self.p[edges]
        with np.errstate(divide="ignore"):
            out = np.log1p(-p)
            for i in np.nonzero((p > 1 - 1e-6) & (p < 1))[0].tolist():  # summed, as 1 - p has few digits
                out[i] = np.log(self.p[self.left(edges[i], {int(edges[i])})].sum())
        return out


@dataclass
class Opened:
    """A path of edges, their log-probabilities, the step at which each word begins, and the sets that branch off.

    ``before`` is the log-probability up to each step.  From step ``start`` on, the
    paths that leave at step ``start + j`` are a set with the untruncated perturbed
    value ``branch[j]``; the last value stands for all later steps if ``tail``.
    """

    edges: np.ndarray
    logs: np.ndarray
    begins: np.ndarray
    before: np.ndarray
    top: float
    start: int
    barred: set[int]
    branch: np.ndarray
    tail: bool


class Search:
    """The perturbed A-star search of one text."""

    def __init__(self, lattice: Lattice, key: int) -> None:
        self.t, self.key = lattice, key
        self.opened: list[Opened] = []
        self.threshold = -math.inf
        self.drawn, self.draws = 0, np.empty(0)

    def uniform(self, n: int) -> np.ndarray:
        """The next ``n`` numbers of the text; ``draws`` holds those drawn ahead, from number ``drawn`` on."""
        if len(self.draws) < n:
            self.draws = np.concatenate((self.draws, ahead([self.key], self.drawn + len(self.draws), n)[0]))
        out, self.draws, self.drawn = self.draws[:n], self.draws[n:], self.drawn + n
        return out

    def exponential(self, n: int) -> np.ndarray:
        return -np.log(self.uniform(n))

    def masses(self, o: Opened, first: int, stop: int) -> np.ndarray:
        """Log-probabilities of the sets that leave a path at steps from ``first`` on."""
        return o.before[first:stop] + self.t.others(o.edges[first:stop])

    def open(self, edges: np.ndarray, logs: np.ndarray, begins: np.ndarray, start: int, top: float, barred: set[int]) -> None:
        n, barred = len(edges), barred | {int(edges[start])}
        before = np.zeros(n + 1)
        np.cumsum(logs, out=before[1:])
        stop = start + max(1, int(np.searchsorted(-before[start:n], DEPTH - before[start], side="right")))
        o = Opened(edges, logs, begins, before, top, start, barred, before[:0], stop < n)
        mass = self.masses(o, start, stop)
        if len(barred) > 1:
            rest = self.t.p[self.t.left(edges[start], barred)].sum()
            mass[0] = before[start] + math.log(rest) if rest else -math.inf
        if o.tail:
            gone = before[n] - before[stop]
            late = before[stop] + math.log1p(-math.exp(gone)) if gone < -1e-6 else np.logaddexp.reduce(self.masses(o, stop, n))
            mass = np.append(mass, late)
        o.branch = mass - np.log(self.exponential(len(mass)))
        self.opened.append(o)

    def split_tail(self, o: Opened) -> None:
        """Values of the single later steps, given that of the best of them."""
        value, n = o.branch[-1], len(o.edges)
        mass = self.masses(o, o.start + len(o.branch) - 1, n)
        g = mass - np.log(self.exponential(len(mass)))
        with np.errstate(divide="ignore", invalid="ignore"):
            x = value - g + np.log(-np.expm1(g - g.max()))
        single = value - np.maximum(0, x) - np.log1p(np.exp(-np.abs(x)))
        single[mass == -np.inf] = -np.inf
        o.branch, o.tail = np.concatenate((o.branch[:-1], single)), False

    def next(self, k: int) -> tuple[Opened, int, int, float, set[int]] | None:
        """The path, step and edge at which the next path leaves, its value and the edges barred there; None at the end."""
        while True:
            best = [int(o.branch.argmax()) for o in self.opened]
            values = [-float(np.logaddexp(-o.top, -o.branch[i])) for o, i in zip(self.opened, best, strict=True)]
            which = max(range(len(values)), key=values.__getitem__)
            top = values[which]
            if len(self.opened) == k or top == -math.inf:
                self.threshold = top
                return None
            o, at = self.opened[which], best[which]
            if not (o.tail and at == len(o.branch) - 1):
                break
            self.split_tail(o)
        step = o.start + at
        out = o.barred if at == 0 else {int(o.edges[step])}
        o.branch[at] = -np.inf
        rest = self.t.left(o.edges[step], out)
        sums = self.t.p[rest].cumsum()
        new = rest[min(int(np.searchsorted(sums, self.uniform(1)[0] * sums[-1], side="right")), len(rest) - 1)]
        return o, step, int(new), top, out

    def inclusion(self, o: Opened) -> float:
        z = float(o.before[-1]) - self.threshold
        return 1.0 if z > 5 else -math.expm1(-math.exp(z))


def ahead(keys: list[int], first: int, n: int) -> np.ndarray:
    """Numbers ``first`` to ``first + n`` of the texts with these keys."""
    at = np.arange(first, first + n).astype(np.uint64) * STEP
    return uniform(mixed(np.array(keys, np.uint64) ^ MIX[1])[:, None] + at)


def sample(words: np.ndarray, bounds: np.ndarray, keys: list[int], k: int, t: Lattice) -> list[Search]:
    """Up to ``k`` distinct paths of every text, in perturbed order.

    ``words`` are the numbers of all texts' words in the lattice, text by text;
    ``bounds`` say where each text begins.  The walks of all texts go together.
    """
    starts, counts = t.start[words], np.diff(bounds)
    seeds = np.repeat(np.array(keys, np.uint64), counts) + (np.arange(len(words)) - np.repeat(bounds[:-1], counts)).astype(np.uint64) * MIX[0]
    found = [Search(t, key) for key in keys]
    wanted, at = [], 0
    for i, (s, draws) in enumerate(zip(found, ahead(keys, 0, AHEAD * k), strict=True)):
        s.draws = draws
        if counts[i]:
            wanted.append((i, None, 0, 0, at, at + counts[i]))
            at += counts[i]
    states, seed_parts = [starts], [seeds]
    for r in range(k + 1):
        if not wanted:
            break
        edges, begins = t.walk(np.concatenate(states), mixed(np.concatenate(seed_parts) + np.array([r], np.uint64) * STEP))
        logs = np.log(t.p[edges])
        for i, leaves, word, inside, a, b in wanted:
            x, y = begins[a], begins[b]
            if leaves is None:
                found[i].open(edges[x:y], logs[x:y], begins[a:b] - x, 0, -math.log(found[i].exponential(1)[0]), set())
                continue
            o, step, new, top, out = leaves
            later = begins[a + inside : b] - x + step + 1
            path, path_logs = np.concatenate((o.edges[:step], [new], edges[x:y])), np.concatenate((o.logs[:step], np.log(t.p[[new]]), logs[x:y]))
            found[i].open(path, path_logs, np.concatenate((o.begins[: word + 1], later)), step, top, out)
        going, wanted, states, seed_parts, at = [w[0] for w in wanted], [], [], [], 0
        for i in going:
            leaves = found[i].next(k)
            if leaves is None:
                continue
            o, step, new = leaves[:3]
            word, inside = int(np.searchsorted(o.begins, step, side="right")) - 1, int(t.then[new] != t.end)
            a, b = int(bounds[i]) + word, int(bounds[i + 1])
            if inside:
                states.append(t.then[new : new + 1])
            states.append(starts[a + 1 : b])
            seed_parts.append(seeds[a + 1 - inside : b])
            wanted.append((i, leaves, word, inside, at, at + inside + b - a - 1))
            at = wanted[-1][-1]
    return found


def key_of(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), seed)


class Known:
    """The words met so far: their numbers, best ids (those of a word begin in ``begins``, and ``size`` says how many) and lattices."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__  # words are numbered as they come up
        self.ids, self.begins, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.lattice = Lattice([], self.v)

    def meet(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's words; new ones are segmented and get their lattices."""
        if len(self.lattice.first) > KNOWN:
            self.forget()
        old = len(self.numbers)
        per = [np.array([*map(self.numbers.__getitem__, words)], np.int64) for words in split(texts, self.v)]
        new = list(islice(self.numbers, old, None))
        best = best_pieces(new, self.v)
        size = np.fromiter(map(len, best), np.int64, len(best))
        self.begins = np.concatenate((self.begins, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(best), np.int32, size.sum())))
        self.lattice.add(new, self.v)
        return per


def segment(texts: list[str | None], keys: list[int], k: int, v: Vocabulary, known: Known | None = None) -> tuple[np.ndarray, np.ndarray, list[Search]]:
    """Best ids of all texts end to end, where each text's begin, and the searches with their paths.

    ``known`` has the words of earlier texts and gets those of these; the results are the same without it.
    """
    known = known or Known(v)
    per = known.meet(texts)
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in per]))).astype(np.int64)
    words = np.concatenate(per)
    own = known.size[words]
    ends = np.cumsum(own)
    ids = known.ids[np.repeat(known.begins[words] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]
    return ids, np.concatenate(([0], ends))[bounds], sample(words, bounds, keys, k, known.lattice)


def encode_documents(documents: DataFrame, k: int = 2, seed: int = 42, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), together: int = TOGETHER) -> DataFrame:
    """Per row: the ``keep`` columns, ``ids`` (best segmentation), ``samples`` and their figures.

    ``samples`` holds up to ``k`` distinct sampled segmentations, ``log_probs`` and
    ``inclusion`` go with them, ``round_trip`` says that the best one decodes to the
    text (the splits of a piece spell that piece).  Null and empty texts have no
    ids and one empty sample.  The noise comes from doc_id and ``seed``: repeated
    rows give repeated results, an empty table an empty result.  Very long texts
    are encoded whole, one at a time; texts of ``together`` characters go at once, fewer
    take less memory and more time, and the results are the same.  A column of ``keep`` must not have the name of
    a result.
    """
    if "doc_id" not in keep:
        raise ValueError("keep must hold doc_id, the key of the noise")
    source = documents.select(*dict.fromkeys((*keep, "text")))
    fields = ["ids", "samples", "log_probs", "inclusion", "round_trip"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        known = Known(v)
        for b in batches:
            at, size = 0, 0
            texts, docs = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for end in range(b.num_rows):
                size += len(texts[end] or "")
                if size > together or end + 1 == b.num_rows:
                    yield part(b.slice(at, end + 1 - at), texts[at : end + 1], docs[at : end + 1], known)
                    at, size = end + 1, 0

    def part(b: pa.RecordBatch, texts: list[str | None], docs: list[int | None], known: Known) -> pa.RecordBatch:
        ids, bounds, found = segment(texts, [key_of(d, seed) for d in docs], k, known.v, known)
        flat, cuts = ids.tolist(), bounds.tolist()
        back = known.v.processor.decode([flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], num_threads=1)
        same = [x == (t or "") for x, t in zip(back, texts, strict=True)]
        empty = np.empty(0, np.int64)
        paths = [p for s in found for p in ([(o.edges, float(o.before[-1]), s.inclusion(o)) for o in s.opened] or [(empty, 0.0, 1.0)])]
        per_row = offsets([len(s.opened) or 1 for s in found])
        pieces = found[0].t.piece[np.concatenate([p[0] for p in paths])]
        inner = pa.ListArray.from_arrays(offsets([len(p[0]) for p in paths]), pa.array(pieces))
        figures = [pa.ListArray.from_arrays(per_row, pa.array([p[j] for p in paths], pa.float64())) for j in (1, 2)]
        columns = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.ListArray.from_arrays(per_row, inner), *figures, pa.array(same)]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], [*keep, *fields])

    def offsets(sizes: list[int]) -> pa.Array:
        return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))

    types = "ids array<int>, samples array<array<int>>, log_probs array<double>, inclusion array<double>, round_trip boolean"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    return source.mapInArrow(work, f"{schema}, {types}")


def decode_documents(encoded: DataFrame, column: str = "ids", model: str = MODEL) -> DataFrame:
    """Add ``text``, decoded from the ids in ``column``; null ids give null."""

    @F.pandas_udf("string")
    def spell(ids):
        import pandas as pd

        v = vocabulary(model)
        return pd.Series([None if i is None else decode(i, v) for i in ids], dtype=object)

    return encoded.withColumn("text", spell(column))
