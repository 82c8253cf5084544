"""Binary decisions predicted from hashed contexts and mixed: the model that lm_score uses for words and for bytes.

A symbol is coded by its path in a Huffman tree, in which both ways of a step are about as likely when nothing is known
of what is before. Each step is a decision that is predicted from counts of zeros and ones in two or three hashed
contexts of the text before the symbol, the longest last. Their stretched probabilities are added with the weights of a
set that the counts of the two longest contexts choose, and the sum is refined by a table of what came of such sums.
Both bits of a decision have probabilities that sum to one, so all symbols' have, too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Counts of a slot go up to this, beyond it both are scaled, so that a slot takes two bytes.
TOP = 255
#: Counts are bounded from below by this much, stretched probabilities and their sum by these either way.
PRIOR, REACH, LIMIT = 0.03, 8.0, 12.0
#: Buckets of a context's counts; weight sets; each context's first weight; a constant's value, whose weight is 0 at first.
DEPTHS, SETS, FIRST, CONSTANT = 8, 64, 0.35, 0.3
#: Levels of the refinement in each unit of the sum, and all; how many outcomes the unrefined probability counts for.
UNIT, LEVELS, TRUST = 32, int(2 * LIMIT * 32) + 1, 30.0
#: Decisions of a learning step, first and later ones, each twice the one before; how much of past curvature stays, its least, the
#: largest step, and of how many decisions one is taken for the curvature; slopes are of all.
START, BATCH, PAST, LEAST, STEP, SPARSE = 1 << 12, 1 << 15, 0.97, 20.0, 0.3, 8
#: Decisions predicted at a time; cells that a set's sum is made in.
AT_ONCE, LANES = 1 << 15, 4

_NODE, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def mix32(x: np.ndarray) -> np.ndarray:
    """Spread 32-bit values."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


class Code:
    """Paths of symbols 0, 1, ... in a Huffman tree for these weights: step 2 * node + bit for each decision."""

    def __init__(self, weights: np.ndarray):
        count = len(weights)
        heap = [(float(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        above = np.zeros(2 * count, np.int64)
        fresh = count
        while len(heap) > 1:
            (v, a), (w, b) = heapq.heappop(heap), heapq.heappop(heap)
            above[a], above[b] = 2 * (fresh - count), 2 * (fresh - count) + 1
            heapq.heappush(heap, (v + w, fresh))
            fresh += 1
        self.nodes = max(1, fresh - count)
        root = fresh - 1
        depth = np.zeros(fresh, np.int64)
        for i in range(root - 1, count - 1, -1):  # a node's parent comes after it
            depth[i] = depth[(above[i] >> 1) + count] + 1
        if count > 1:
            depth[:count] = depth[(above[:count] >> 1) + count] + 1
        self.size = depth[:count].copy()
        self.start = np.cumsum(self.size) - self.size
        self.steps = np.zeros(int(self.size.sum()), np.int32)
        at, place = np.arange(count), self.start + self.size - 1
        for _ in range(int(self.size.max(initial=0))):
            live = at != root
            at, place = at[live], place[live]
            self.steps[place] = above[at]
            at, place = (above[at] >> 1) + count, place - 1


@dataclass
class Shape:
    """A code and, for each context, the base-2 logarithm of its slots."""

    code: Code
    bits: tuple[int, ...]

    def parts(self, symbols: np.ndarray, most: int) -> Iterator[slice]:
        """Slices of the symbols with about so many decisions."""
        done = np.cumsum(self.code.size[symbols])
        lo = 0
        while lo < len(symbols):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + most, "right")))
            yield slice(lo, hi)
            lo = hi

    def decisions(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each decision of the symbols' paths its slots by context and its bit; and where each symbol's start."""
        size = self.code.size[symbols]
        first = np.cumsum(size) - size
        step = self.code.steps.take(np.arange(int(size.sum())) + np.repeat(self.code.start[symbols] - first, size))
        node = (step >> 1).astype(np.uint32) * _NODE
        found = []
        for context, bits in zip(contexts, self.bits):
            at = np.repeat(context, size)
            at ^= node
            at *= _SPREAD
            at >>= np.uint32(32 - bits)
            found.append(at.astype(np.intp))
        return found, step & 1, first


def tallied(shape: Shape, tables: list[np.ndarray], symbols: np.ndarray, contexts: list[np.ndarray]) -> None:
    """Count the symbols' decisions in tables of zeros and ones by slot (2 * slot + bit)."""
    for part in shape.parts(symbols, AT_ONCE):
        found, bit, _ = shape.decisions(symbols[part], [c[part] for c in contexts])
        for table, at in zip(tables, found):
            at <<= 1
            at += bit
            np.add.at(table, at, np.uint32(1))


def packed(table: np.ndarray) -> np.ndarray:
    """Zeros and ones of each slot in one 16-bit value, scaled down where one passes TOP."""
    pairs = table.reshape(-1, 2)
    top = np.maximum(1.0, pairs.max(axis=1) / TOP)
    zeros, ones = (np.rint(pairs[:, k] / top).astype(np.uint16) for k in (0, 1))
    return zeros | ones << np.uint16(8)


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))), -REACH, REACH)


def depth(total: np.ndarray) -> np.ndarray:
    """The bucket of counts, as floats: how many bits the number has, to a limit."""
    return np.clip((np.ascontiguousarray(total, np.float32).view(np.int32) >> 23) - 126, 0, DEPTHS - 1)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def level(total: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """The refinement's row for a sum and the longest context's bucket."""
    total = np.clip(total, -LIMIT, LIMIT)
    total += np.float32(LIMIT)
    total *= np.float32(UNIT)
    return total.astype(np.int32) + np.multiply(longest, LEVELS, dtype=np.int32)


def without_own() -> tuple[np.ndarray, np.ndarray]:
    """Stretched probability and bucket by 2 * counts + bit, where the bit's own count is taken off the slot's counts."""
    both, bit = np.arange(1 << 16)[:, None], np.arange(2)
    zeros = np.maximum((both & TOP) - (1 - bit), 0).astype(np.float32)
    ones = np.maximum((both >> 8) - bit, 0).astype(np.float32)
    return stretched(zeros, ones).reshape(-1), depth(zeros + ones).astype(np.uint8).reshape(-1)


def first_weights(contexts: int) -> np.ndarray:
    return np.tile(np.append(np.full(contexts, FIRST), 0.0), (SETS, 1))


class Learner:
    """Weights by set and outcomes by level, learned in the order of the symbols, each without its own count."""

    def __init__(self, shape: Shape, tables: list[np.ndarray]):
        self.shape, self.tables = shape, [t.copy() for t in tables]  # numpy's own memory is in large pages, what was sent isn't
        self.weights = first_weights(len(shape.bits))
        self.curve = np.zeros((SETS, len(shape.bits) + 1, len(shape.bits) + 1))
        self.outcomes = np.zeros(2 * LEVELS * DEPTHS)
        self.known, self.deep = without_own()
        self.seen = 0

    def learn(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> None:
        done, lo = np.cumsum(self.shape.code.size[symbols]), 0
        while lo < len(symbols):
            most = (done[lo - 1] if lo else 0) + max(START, min(BATCH, self.seen))
            part = slice(lo, max(lo + 1, int(np.searchsorted(done, most, "right"))))
            found, bit, _ = self.shape.decisions(symbols[part], [c[part] for c in contexts])
            self.step(found, bit)
            lo = part.stop

    def step(self, found: list[np.ndarray], bit: np.ndarray) -> None:
        x, near, far = [], None, None
        for table, at in zip(self.tables, found):
            at = table.take(at).astype(np.intp)
            at <<= 1
            at += bit
            x.append(self.known.take(at))
            near, far = far, self.deep.take(at)
        gate = (near * np.uint8(DEPTHS) + far).astype(np.intp)
        weights = np.ascontiguousarray(self.weights.T, np.float32)
        total = weights[-1].take(gate)
        total *= np.float32(CONSTANT)
        for w, v in zip(weights, x):
            w = w.take(gate)
            w *= v
            total += w
        np.clip(total, -LIMIT, LIMIT, out=total)
        chance = squash(total)
        wrong = bit.astype(np.float32)
        wrong -= chance
        lane = (np.arange(len(gate)) & (LANES - 1)) * SETS  # neighbours are added to different cells, which don't wait for each other
        lane += gate
        by_set = lambda v: np.bincount(lane, v, LANES * SETS).reshape(LANES, SETS).sum(axis=0)
        slope = np.stack([*(by_set(wrong * v) for v in x), CONSTANT * by_set(wrong)], axis=1)
        some = slice(self.seen % SPARSE, None, SPARSE)
        sets, spread = gate[some], (chance[some] * (1 - chance[some])) * np.float32(SPARSE)
        few = [*(v[some] for v in x), np.float32(CONSTANT)]
        self.curve *= PAST
        for i, v in enumerate(few):
            here = spread * v
            for j in range(i + 1):
                fresh = np.bincount(sets, here * few[j], SETS)
                self.curve[:, i, j] += fresh
                if j < i:
                    self.curve[:, j, i] += fresh
        self.weights += np.clip(np.linalg.solve(self.curve + LEAST * np.eye(len(few)), slope[:, :, None])[:, :, 0], -STEP, STEP)
        self.outcomes += np.bincount(2 * level(total, far) + bit, minlength=len(self.outcomes))
        self.seen += len(bit)


class Predictor:
    """What was learned, laid out for scoring: a stretched probability a slot in 13 bits, with its bucket in the lowest 3."""

    GRAIN = 8191 / (2 * REACH)

    def __init__(self, shape: Shape, tables: list[np.ndarray], weights: np.ndarray, outcomes: np.ndarray):
        self.shape = shape
        self.values = []
        for table in tables:
            zeros, ones = (table & np.uint16(TOP)).astype(np.float32), (table >> np.uint16(8)).astype(np.float32)
            values = np.rint((stretched(zeros, ones) + REACH) * self.GRAIN).astype(np.uint16)
            self.values.append(values << np.uint16(3) | depth(zeros + ones).astype(np.uint16))
        self.weights = [np.ascontiguousarray(w, np.float32) for w in weights.T]
        seen = outcomes.reshape(DEPTHS, LEVELS, 2)
        plain = squash(np.arange(LEVELS) / UNIT - LIMIT + 0.5 / UNIT)
        ones = (seen[:, :, 1] + TRUST * plain) / (seen.sum(axis=2) + TRUST)
        ones = np.clip(ones, 1e-7, 1 - 1e-7)
        self.logs = np.log10(np.stack([1 - ones, ones], axis=2)).reshape(-1).astype(np.float32)

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"values": [v.copy() for v in state["values"]]}  # into large pages, as in Learner

    def scores(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """log10 of each symbol's probability."""
        out = np.zeros(len(symbols))
        for part in self.shape.parts(symbols, AT_ONCE):
            found, bit, first = self.shape.decisions(symbols[part], [c[part] for c in contexts])
            if not len(bit):
                continue
            codes = [values.take(at) for values, at in zip(self.values, found)]
            near, far = (v & np.uint16(7) for v in codes[-2:])
            gate = (near * np.uint16(DEPTHS) + far).astype(np.intp)
            total = self.weights[-1].take(gate)
            total *= np.float32(CONSTANT)
            for weights, code in zip(self.weights, codes):
                code >>= np.uint16(3)
                v = code.astype(np.float32)
                v *= np.float32(1 / self.GRAIN)
                v -= np.float32(REACH)
                v *= weights.take(gate)
                total += v
            each = self.logs.take(2 * level(total, far) + bit)
            sums = np.add.reduceat(each, np.minimum(first, len(each) - 1), dtype=np.float64)
            out[part] = np.where(self.shape.code.size[symbols[part]] > 0, sums, 0)
        return out
