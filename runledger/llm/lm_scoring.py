"""Language-model scores by online logistic context mixing.

Tokens are coded bit by bit. The ``CODED`` most frequent words of the training texts,
the end of a text and an escape have a Huffman code; each bit of a code is predicted
from the node of the code alone, the node with the last function word before it, and
the node with the word before it, both hashed. The log-odds of the predictors are
combined by weights that a gate picks (how often the contexts were met), trained
online, and the result is refined by an adaptive table. An escaped word has its
count's probability among the escaped ones, or is new, by the Good-Turing estimate,
and spelled: again bit by bit, from hashed contexts of 1, 2, 3, 4 and 6 bytes, with
a mixer of its own. As a spelling stands for a new word, its counts take every
distinct word once.

Above the words are passages (up to a full stop, 32 words at most). A passage is
either made of words, or is one that training texts hold already; the two
probabilities are added, weighed by how often training passages are repeated.

Everything is counted over all training texts: words and passages in tables that
grow with them, hashed predictors in tables of a fixed size. Training texts are
scored with the token's or passage's own occurrence left out, so that their
scores are comparable with those of held-out texts. Weights are learned by one
pass over every training text: each partition learns online, and its weights are
averaged by the bits that each gate met. White space isn't scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import materialize, mix64, prepare, word_slices, words_of

#: Words with a code of their own; others are escaped, so this is a size of the model and leaves no word out.
CODED = 1 << 13
#: Words that count as function words for the context.
FUNCTION = 64
CONTEXT_BITS = 20
WORD_SLOTS = CODED + 2 + 2 * (1 << CONTEXT_BITS)
LEVELS = 4
WORD_GATES = LEVELS * LEVELS
WORD_WEIGHTS = (0.3, 0.4, 0.3, 0.0)
TOKEN_PIECE = 1 << 14
SCORED_PIECE = 1 << 12
#: Contexts keep their upper 50 bits, so that a symbol and the context before it are one number.
SYMBOL_BITS = 14
#: Equal tokens in equal contexts are counted together among so many tokens, equal letters among so many bytes.
COUNTED_TOKENS, COUNTED_BYTES = 1 << 20, 1 << 20
#: Distinct letters are answered in parts that stay in a core's cache.
ANSWERED_BYTES = 1 << 11
PASSAGE = 32
#: Bits of the filter that tells passages which may be repeated. Its size is fixed; a full filter lets every passage through.
FILTER_BITS = 24
BITMAP = 1 << 15

ORDERS = (1, 2, 3, 4, 6)
SLOT_BITS = (16, 19, 19, 19, 19)
BASES = np.concatenate(([0], np.cumsum([1 << b for b in SLOT_BITS])))
SLOTS = int(BASES[-1])
CHUNK = 1 << 15
WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)
FAN_IN = 64
END = 32
#: Words that are looked up without a join; the rest are joined, so this bounds the broadcast only.
MOST_FREQUENT = 1 << 18
CONFIDENCES = 3
#: How often a context was met, by these bounds, is its level.
WORD_MET, LETTERS_MET = (0, 3, 30), (0, 2, 12)
GATES = CONFIDENCES * (len(ORDERS) + 1)
SPELLING_WEIGHTS = (0.05, 0.15, 0.25, 0.3, 0.3, 0.0)
PASSES = 1
RATE = 0.25
BUCKETS = 33
PIECE = 1 << 16

_STOPS = np.zeros(256, bool)
_STOPS[[ord(x) for x in ".!?:"]] = True
#: By byte: its nodes, and those within its halves.
_NODES = (256 | np.arange(256))[:, None] >> (8 - np.arange(8))
_HALF_NODES = (16 | np.stack([np.arange(256) >> 4, np.arange(256) & 15], axis=1))[:, :, None] >> (4 - np.arange(4))
#: By the place in a word: the bytes up to there, 7 at most.
_EARLIER = np.array([(1 << 8 * n) - 1 for n in range(1, max(ORDERS) + 2)], np.uint64)
_PLACES = mix64(np.arange(1, PASSAGE + 1, dtype=np.uint64)) | np.uint64(1)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every word with its end mark: the byte below its up to 6 earlier bytes, and the word's number."""
    buf = np.frombuffer(bytes([END]).join(words) + bytes([END]), np.uint8)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(buf)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = buf.astype(np.uint64)
    for back in (1, 2, 4):
        key[back:] |= key[:-back] << np.uint64(8 * back)
    key &= np.take(_EARLIER, place, mode="clip")
    return key, word


def letter_slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every bit of every byte of ``letters``: slots of the predictors, and the bit."""
    bits = (key.astype(np.uint8)[:, None] >> (7 - np.arange(8, dtype=np.uint8))) & 1
    slots = np.empty((len(ORDERS), len(key), 8), np.int64)
    for k in range(len(ORDERS)):
        _order_slots(key, k, slots[k])
    return slots.reshape(len(ORDERS), -1), bits.ravel()


def _order_slots(key: np.ndarray, k: int, out: np.ndarray) -> None:
    """Slots of a predictor. Those of the four bits of half a byte are near each other: they differ in their last four bits."""
    order, size, byte = ORDERS[k], SLOT_BITS[k], (key & np.uint64(255)).view(np.int64)
    context = key >> np.uint64(8) & np.uint64((1 << 8 * order) - 1)
    if order == 1:
        np.bitwise_or((context.view(np.int64) << 8)[:, None], np.take(_NODES, byte, axis=0), out=out)
    else:
        hashed = np.repeat(context << np.uint64(5) | np.uint64(1 << 62), 2).reshape(-1, 2)
        hashed[:, 1] |= byte.view(np.uint64) >> np.uint64(4) | np.uint64(16)
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        hashed >>= np.uint64(64 - size)
        np.bitwise_xor(hashed.view(np.int64)[:, :, None], np.take(_HALF_NODES, byte, axis=0), out=out.reshape(-1, 2, 4))
    out += BASES[k]


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every bit of every word with its end mark: slots of the predictors, the bit, and the word's number."""
    key, word = letters(words)
    return *letter_slots(key), np.repeat(word, 8)


def _pieces(words: list[bytes], size: int = PIECE) -> Iterator[slice]:
    at, total = 0, 0
    for i, w in enumerate(words):
        total += len(w) + 1
        if total >= size:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(words):
        yield slice(at, len(words))


def spelling_inputs(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = n0 + n1
    known = (seen > 0).sum(axis=0)
    # a longer context is seen only where the shorter ones are, but for collisions
    deepest = seen[np.maximum(known - 1, 0), np.arange(n0.shape[1])]
    return _log_odds(n0, n1), CONFIDENCES * known + (deepest > 2) + (deepest > 12)


def word_inputs(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = n0[1:] + n1[1:]
    level = (seen > 0).astype(np.int8) + (seen > 3) + (seen > 30)
    return _log_odds(n0, n1), (LEVELS * level[0] + level[1]).astype(np.int64)


def _log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    x = np.empty((len(n0) + 1, n0.shape[1]), np.float32)
    own = x[:-1]
    np.add(n1, np.float32(0.2), out=own)
    own /= n0 + np.float32(0.2)
    np.log(own, out=own)
    x[-1] = 0.3
    return x


class Answers:
    """What each slot says: log-odds and level, in row 0 or 1 without one 0 or 1 of its own, in row 2 by all its bits. Each is worked out once a slot instead of once a bit."""

    def __init__(self, counts: np.ndarray, met: tuple[int, ...]):
        self.slots = counts.shape[1]
        self.odds, self.level = np.empty((3, self.slots), np.float32), np.zeros((3, self.slots), np.uint8)
        for column, own in enumerate(((1, 0), (0, 1), (0, 0))):
            n0, n1 = (np.maximum(n - np.float32(x), 0) for n, x in zip(counts, own, strict=True))
            self.odds[column] = _log_odds(n0[None], n1[None])[0]
            n0 += n1
            for least in met:
                self.level[column] += n0 > least

    def of(self, slots: np.ndarray | slice, times: int = 1) -> np.ndarray:
        """Those of some slots, one row after the other: log-odds and so many ``times`` the level side by side in memory, so that one look-up finds both."""
        return np.stack([self.odds[:, slots].ravel(), self.level[:, slots].ravel() * np.float32(times)], axis=1).view(np.complex64).ravel()


class LetterAnswers(Answers):
    def __init__(self, counts: np.ndarray):
        super().__init__(counts, LETTERS_MET)

    def inputs(self, slots: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``spelling_inputs``."""
        odds, levels = self.odds.ravel(), self.level.ravel()
        x, level = np.empty((len(slots) + 1, slots.shape[1]), np.float32), np.empty(slots.shape, np.uint8)
        row = np.multiply(column, self.slots, dtype=np.int64)
        for k, own in enumerate(slots):
            at = own + row
            np.take(odds, at, out=x[k], mode="clip")
            np.take(levels, at, out=level[k], mode="clip")
        x[-1] = 0.3
        known = np.zeros(slots.shape[1], np.int64)
        for own in level:
            known += own > 0
        # the level of the last known one, in the row before it
        at = np.maximum(known - 1, 0)
        at *= slots.shape[1]
        at += np.arange(slots.shape[1])
        deepest = np.take(level.ravel(), at, mode="clip")
        known *= CONFIDENCES
        known += deepest > 1
        known += deepest > 2
        return x, known


class WordAnswers:
    """Answers by node, by function word and node, and by slot of the word before."""

    def __init__(self, codes: Codes, counts: np.ndarray):
        every, self.codes, self.nodes = Answers(counts, WORD_MET), codes, int(codes.nodes.max()) + 1
        first = codes.context_slots(mix64(np.arange(FUNCTION + 1, dtype=np.uint64) + np.uint64(1))[:, None], np.arange(self.nodes)[None], 1).ravel()
        self.node = every.odds[:, : self.nodes].ravel()
        self.function = every.of(first, LEVELS)
        self.before = every.of(slice(CODED + 2 + (1 << CONTEXT_BITS), None))
        # by place in the codes: rows for the bit without its own occurrence, behind them those by all bits
        nodes, row = np.tile(codes.nodes, 2), np.concatenate((codes.bits.astype(np.int64), np.full(len(codes.bits), 2)))
        self.of_node, self.of_function, self.of_before = nodes + self.nodes * row, nodes + (FUNCTION + 1) * self.nodes * row, codes.inner[nodes] | row << CONTEXT_BITS
        self.marks = codes.node_marks(codes.nodes)

    def bits(self, symbol: np.ndarray, function: np.ndarray, before: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every bit of every token, as ``word_inputs`` gives them: inputs, gate, and the bit; and how many bits each token has. Bits of tokens that aren't ``held`` are left out of the counts."""
        codes = self.codes
        sizes = np.take(codes.sizes, symbol)
        at = np.repeat(codes.firsts(symbol, sizes), sizes)
        at += np.arange(len(at))
        key, bits = np.take(self.marks, at, mode="clip"), np.take(codes.bits, at, mode="clip")
        if held is not None:
            at += np.repeat(np.where(held, len(codes.bits), 0), sizes)
        x = np.empty((4, len(at)), np.float32)
        np.take(self.node, np.take(self.of_node, at, mode="clip"), out=x[0], mode="clip")
        place = np.take(self.of_function, at, mode="clip")
        place += np.repeat(self.nodes * function, sizes)
        both = np.take(self.function, place, mode="clip")
        x[1] = both.real
        gate = both.imag.copy()
        key ^= np.repeat(before, sizes)
        place = codes.slots(key)
        place ^= np.take(self.of_before, at, mode="clip")
        both = np.take(self.before, place, mode="clip")
        x[2] = both.real
        gate += both.imag
        x[3] = 0.3
        return x, gate.astype(np.int64), bits, sizes

    def inputs(self, symbol: np.ndarray, function: np.ndarray, before: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``bits``, with every bit's token instead of the sizes."""
        *found, sizes = self.bits(symbol, function, before, held)
        return *found, np.repeat(np.arange(len(symbol)), sizes)


class Mixer:
    """What is learned on the training texts: gated weights and the refinement table."""

    inputs = staticmethod(spelling_inputs)

    def __init__(self, weights: tuple[float, ...] = SPELLING_WEIGHTS, gates: int = GATES):
        self.gates = gates
        self.weights = np.tile(np.array(weights), (gates, 1))
        self.refined = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS))), (gates, 1))

    def copy(self) -> Mixer:
        other = Mixer(gates=self.gates)
        other.weights, other.refined = self.weights.copy(), self.refined.copy()
        return other

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        first, *others = self.weights.T.astype(np.float32)
        z = np.take(first, gate, mode="clip")
        z *= x[0]
        one = np.empty_like(z)
        for row, own in zip(x[1:], others, strict=True):
            np.take(own, gate, out=one, mode="clip")
            one *= row
            z += one
        return np.clip(z, -12, 12, out=z)

    def probability(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a 1."""
        z = self.mixed(x, gate)
        at = (z + 8) * np.float32((BUCKETS - 1) / 16)
        np.clip(at, 0, np.float32(BUCKETS - 1.001), out=at)
        low = at.astype(np.int32)
        at -= low
        known, place = self.refined.astype(np.float32).ravel(), gate * BUCKETS
        place += low
        table, rise = np.take(known, place, mode="clip"), np.take(np.diff(known, append=known[-1:]), place, mode="clip")
        rise *= at
        table += rise
        np.exp(np.negative(z, out=z), out=z)
        z += 1
        table += np.divide(1, z, out=z)
        table /= 2
        return np.clip(table, 1e-6, 1 - 1e-6, out=table)

    def logs(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Logarithms (base 10) of the bits' probabilities."""
        p = self.probability(x, gate)
        p -= bit == 0
        return np.log10(np.abs(p, out=p), out=p)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, rate: float, step: int = 8192) -> None:
        """Online: each step predicts, then moves the weights of the gates it met by its errors."""
        for at in range(0, len(bit), step):
            own, g, b = x[:, at : at + step], gate[at : at + step], bit[at : at + step]
            error = self.mixed(own, g)
            np.exp(np.negative(error, out=error), out=error)
            error += 1
            np.subtract(b, np.divide(1, error, out=error), out=error)
            moved = np.array([np.bincount(g, row * error, self.gates) for row in own])
            self.weights += (rate * moved / np.maximum(np.bincount(g, minlength=self.gates), 32)).T

    def outcomes(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """Bits (each so many ``times``) and ones by gate and bucket of the mixed log-odds."""
        near = self.mixed(x, gate)
        near += 8
        near *= np.float32((BUCKETS - 1) / 16)
        np.rint(np.clip(near, 0, BUCKETS - 1, out=near), out=near)
        key = gate * BUCKETS
        key += near.astype(np.int64)
        key *= 2
        key += bit
        by_bit = np.bincount(key, times, 2 * self.gates * BUCKETS).reshape(-1, 2)
        return np.stack([by_bit.sum(axis=1), by_bit[:, 1]])

    def refine(self, n: np.ndarray, ones: np.ndarray) -> None:
        self.refined = (ones.reshape(self.gates, BUCKETS) + 30 * self.refined) / (n.reshape(self.gates, BUCKETS) + 30)


def _equal(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hashes lie together, and where each one's first stands in it."""
    order = np.argsort(h)
    ranked = h[order]
    return order, np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        hashes, all_, learned, words = [], [], [], []
        for first, count, buf, starts, ends, h, bounds in word_slices(batch.column(1)):
            if not len(h):
                continue
            order, own = _equal(h)
            at = order[own]
            data = buf.tobytes()
            hashes.append(h[at])
            all_.append(np.diff(own, append=len(h)))
            learned.append(np.add.reduceat(np.repeat(train[first : first + count], np.diff(bounds))[order], own, dtype=np.int64))
            words += [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if not words:
            continue
        order, own = _equal(np.concatenate(hashes))
        sums = [np.add.reduceat(np.concatenate(x)[order], own) for x in (all_, learned)]
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in order[own].tolist()], pa.binary()), pa.array(sums[0]), pa.array(sums[1])], names=["word", "n_all", "n"])


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of at least two symbols: where each one's begins, and for every bit its node (0: the root) and its value."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    weight = np.concatenate((counts[order], np.zeros(n - 1, np.int64))).tolist()
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
    leaf, inner = 0, n
    for new in range(n, 2 * n - 1):
        for bit in (0, 1):
            if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                child, leaf = leaf, leaf + 1
            else:
                child, inner = inner, inner + 1
            parent[child], side[child] = new, bit
            weight[new] += weight[child]
    root, steps, at, who = 2 * n - 2, [], np.arange(n), np.arange(n)
    while len(at):
        steps.append((who, parent[at], side[at]))
        left = parent[at] != root
        who, at = who[left], parent[at][left]
    sizes = np.zeros(n, np.int64)
    for own, _, _ in steps:
        sizes[own] += 1
    begins = np.cumsum(sizes) - sizes
    nodes, bits = np.zeros(sizes.sum(), np.int64), np.zeros(sizes.sum(), np.int8)
    for k, (own, node, bit) in enumerate(steps):
        place = begins[own] + sizes[own] - 1 - k
        nodes[place], bits[place] = root - node, bit
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    whole = np.concatenate((begins, [len(nodes)]))
    sizes, begins = sizes[back], begins[back]
    take = np.repeat(begins, sizes) + np.arange(whole[-1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(([0], np.cumsum(sizes))), nodes[take], bits[take]


class Places:
    """Where hashes stand among sorted distinct ones: their leading bits give the first place to look at."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, bits = hashes, max((4 * len(hashes)).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.append(np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(hashes))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place for each, and whether the hash is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        lead = (h >> self.shift).astype(np.int64)
        at, end = np.take(self.first, lead), np.take(self.first, lead + 1)
        found = np.take(self.hashes, at, mode="clip") == h
        left = np.flatnonzero(~found & (end - at > 1))
        while len(left):
            at[left] += 1
            hit = self.hashes[at[left]] == h[left]
            found[left] = hit
            left = left[~hit & (end[left] - at[left] > 1)]
        return np.minimum(at, len(self.hashes) - 1), found


class Codes:
    """Codes of the frequent words (by their hashes, most frequent first), of the end and of the escape."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, escaped: int):
        self.begins, self.nodes, self.bits = huffman(np.concatenate((counts, [max(ends, 1), max(escaped, 1)])).astype(np.int64))
        self.end, self.escape = len(hashes), len(hashes) + 1
        self.order = np.argsort(hashes)
        self.known = Places(hashes[self.order])
        self.sizes = np.diff(self.begins)
        # nodes of four levels are a block, as those of half a byte are
        place = np.arange(len(self.nodes)) - np.repeat(self.begins[:-1], self.sizes)
        within, inner = place % 4, np.ones(len(self.nodes), np.int64)
        for back in (3, 2, 1):
            below = np.flatnonzero(within >= back)
            inner[below] = 2 * inner[below] + self.bits[below - back]
        self.inner, self.block = np.zeros(int(self.nodes.max()) + 1, np.int64), np.zeros(int(self.nodes.max()) + 1, np.int64)
        self.inner[self.nodes], self.block[self.nodes] = inner, self.nodes[np.arange(len(self.nodes)) - within]

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not len(self.order):
            return np.full(len(h), self.escape)
        at, found = self.known.find(h)
        return np.where(found, np.take(self.order, at), self.escape)

    def tokens(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words of some texts and of their ends, hashes of their two contexts, and the text of each."""
        symbol, function, before, text = self.marked(h, bounds)
        return symbol, mix64(function.astype(np.uint64) + np.uint64(1)), before, text

    def marked(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``tokens``, with the number of the function word (0: none) instead of its hash."""
        count = len(bounds) - 1
        sizes = np.diff(bounds) + 1
        text = np.repeat(np.arange(count), sizes)
        starts = np.cumsum(sizes) - sizes
        n = len(text)
        word = np.ones(n, bool)
        word[starts + sizes - 1] = False
        symbol, before = np.full(n, self.end), np.zeros(n, np.uint64)
        symbol[word] = self.symbols(h)
        before[word] = h
        before = np.concatenate((np.zeros(1, np.uint64), before[:-1]))
        before[starts] = 0
        last = np.maximum.accumulate(np.where(symbol < min(FUNCTION, self.end), np.arange(n), -1))
        last = np.concatenate(([-1], last[:-1]))
        function = np.where(last >= starts[text], symbol[np.maximum(last, 0)] + 1, 0)
        return symbol, function, mix64(before + np.uint64(7)) >> np.uint64(SYMBOL_BITS) << np.uint64(SYMBOL_BITS), text

    def places(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every bit of every token: its place in the codes, and the token's number."""
        sizes = np.take(self.sizes, symbol)
        at = np.repeat(self.firsts(symbol, sizes), sizes)
        at += np.arange(len(at))
        return at, np.repeat(np.arange(len(symbol)), sizes)

    def firsts(self, symbol: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For every token what its bits' numbers lack to their places in the codes."""
        first = np.take(self.begins, symbol)
        first -= np.cumsum(sizes)
        first += sizes
        return first

    def node_marks(self, node: np.ndarray) -> np.ndarray:
        return (np.take(self.block, node).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def slots(key: np.ndarray) -> np.ndarray:
        """Slots, from 0, of blocks of nodes from contexts with their marks; the keys are overwritten."""
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0x94D049BB133111EB)
        key >>= np.uint64(64 - CONTEXT_BITS)
        return key.view(np.int64)

    def context_slots(self, context: np.ndarray, node: np.ndarray, base: int) -> np.ndarray:
        """Slots of nodes in contexts, as those of predictor number ``base``. Those of a block's nodes are near each other: they differ in their last four bits."""
        return (self.slots(context ^ self.node_marks(node)) ^ np.take(self.inner, node)) + (CODED + 2 + (base - 1) * (1 << CONTEXT_BITS))

    def spread(self, symbol: np.ndarray, function: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every bit of every token: slots of the predictors, the bit, and the token's number."""
        at, token = self.places(symbol)
        node = np.take(self.nodes, at)
        slots = np.stack([node, *(self.context_slots(context[token], node, k) for k, context in ((1, function), (2, before)))])
        return slots, np.take(self.bits, at), token


def passages(buf: np.ndarray, ends: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the passages of some texts: they end with a word's full stop, with the text, or after PASSAGE words."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.zeros(len(h), bool)
    first[1:] = _STOPS[buf[ends[:-1] - 1]]
    first[bounds[:-1][bounds[:-1] < len(h)]] = True
    place = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    starts = np.flatnonzero(place % PASSAGE == 0)
    sums = np.add.reduceat(h * _PLACES[place % PASSAGE], starts)
    return starts, mix64(sums + np.diff(np.concatenate((starts, [len(h)]))).astype(np.uint64))


def _passage_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for first, _, buf, _, ends, h, bounds in word_slices(batch.column(1)):
            starts, own = passages(buf, ends, h, bounds)
            if not len(starts):
                continue
            learned = train[first + np.searchsorted(bounds, starts, side="right") - 1]
            unique, back, n = np.unique(own, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n), pa.array(np.bincount(back, learned, len(unique)).astype(np.int64))], names=["h", "n_all", "n"])


def _packed(counts: np.ndarray) -> bytes:
    """A chunk of counts in the narrowest type that holds the largest; its size tells the type."""
    return counts.astype(next(t for t in WIDTHS if counts.max() <= np.iinfo(t).max)).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, next(t for t in WIDTHS if len(packed) == CHUNK * np.dtype(t).itemsize))


def _chunked(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if counts.any():
        rows = np.concatenate((counts, np.zeros(-len(counts) % CHUNK, counts.dtype))).reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), TaskContext.get().partitionId()), pa.int32()), pa.array([_packed(r) for r in rows], pa.binary())], names=["chunk", "task", "counts"])


def _long_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Words of several batches, of COUNTED_BYTES or a little more."""
    held, total = [], 0
    for batch in batches:
        words = batch.column(0).to_pylist()
        for part in _pieces(words, COUNTED_BYTES):
            held += words[part]
            total += sum(map(len, words[part])) + part.stop - part.start
            if total >= COUNTED_BYTES:
                yield held
                held, total = [], 0
    if held:
        yield held


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, shifts = np.zeros(2 * SLOTS, np.int32), np.arange(8, dtype=np.uint64)
    for words in _long_pieces(batches):
        # the last byte leads and the one before it follows, so that equal bytes after equal contexts of any order lie together
        key, n = np.unique(letters(words)[0].byteswap(), return_counts=True)
        for k in range(len(ORDERS) - 1, -1, -1):
            lead = key >> np.uint64(8 * (7 - ORDERS[k]))
            first = np.flatnonzero(np.concatenate(([True], lead[1:] != lead[:-1])))
            key, n = key[first], np.add.reduceat(n, first)
            for at in range(0, len(key), PIECE):
                own = key[at : at + PIECE].byteswap()
                slots = np.empty((len(own), 8), np.int64)
                _order_slots(own, k, slots)
                slots *= 2
                slots += (own[:, None] >> (np.uint64(7) - shifts) & np.uint64(1)).view(np.int64)
                np.add.at(counts, slots.ravel(), np.repeat(n[at : at + PIECE].astype(np.int32), 8))
    yield from _chunked(counts)


def _word_pieces(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, function words and contexts of some tokens."""
    for batch in batches:
        for _, _, _, _, _, h, bounds in word_slices(batch.column(0)):
            symbol, function, before, _ = codes.marked(h, bounds)
            for at in range(0, len(symbol), TOKEN_PIECE):
                part = slice(at, at + TOKEN_PIECE)
                yield symbol[part], function[part], before[part]


def _word_counts(codes_b):
    """Equal symbols after equal contexts are counted first, and then their bits as often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codes_b.value
        counts = np.zeros(2 * WORD_SLOTS, np.int32)
        symbols, mask = len(codes.sizes), np.uint64((1 << SYMBOL_BITS) - 1)
        by_function = np.zeros((FUNCTION + 1) * symbols, np.int64)

        def add(symbol, n, slots_of):
            for at in range(0, len(symbol), TOKEN_PIECE):
                part = slice(at, at + TOKEN_PIECE)
                places, token = codes.places(symbol[part])
                slots = slots_of(part, np.take(codes.nodes, places), token)
                slots *= 2
                slots += np.take(codes.bits, places)
                np.add.at(counts, slots, np.take(n[part], token).astype(np.int32))

        def add_pairs(pairs):
            if pairs:
                pairs = np.concatenate(pairs)
                pairs.sort()
                first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
                n, pairs = np.diff(first, append=len(pairs)), pairs[first]
                add((pairs & mask).astype(np.int64), n, lambda part, node, token: codes.context_slots(np.take(pairs[part] & ~mask, token), node, 2))

        held, total = [], 0
        for symbol, function, before in _word_pieces(batches, codes):
            np.add.at(by_function, function * symbols + symbol, 1)
            held.append(before | symbol.astype(np.uint64))
            total += len(symbol)
            if total >= COUNTED_TOKENS:
                add_pairs(held)
                held, total = [], 0
        add_pairs(held)
        met = np.flatnonzero(by_function)
        hashes = mix64((met // symbols).astype(np.uint64) + np.uint64(1))
        add(met % symbols, by_function[met], lambda part, node, token: codes.context_slots(np.take(hashes[part], token), node, 1))
        alone = by_function.reshape(-1, symbols).sum(axis=0)
        add(np.arange(symbols), alone, lambda part, node, token: node)
        yield from _chunked(counts)

    return run


def _added(key, rows):
    total = np.zeros(CHUNK, np.int64)
    for x in rows["counts"]:
        total += _unpacked(x)
    return pd.DataFrame({"chunk": [key[0]], "task": [key[1] if len(key) > 1 else 0], "counts": [_packed(total)]})


def _summed(chunks: DataFrame, slots: int) -> np.ndarray:
    """Counts of zeros and ones by slot, side by side in memory, added up in a tree; what reaches the driver has a fixed size."""
    for key in ((F.col("chunk"), F.pmod(F.shiftright("task", 2), F.lit(FAN_IN))), (F.col("chunk"),)):
        chunks = chunks.groupBy(*key).applyInPandas(_added, "chunk int, task int, counts binary")
    counts = np.zeros((-(-2 * slots // CHUNK), CHUNK), np.float32)
    for r in chunks.select("chunk", "counts").toLocalIterator():
        counts[r["chunk"]] = _unpacked(r["counts"])
    return counts.ravel()[: 2 * slots].reshape(-1, 2).T


def left_out(counts: np.ndarray, slots: np.ndarray, bits: np.ndarray, own: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones by slot without the bit's own occurrence, where it has one; what ``Answers`` are held against."""
    ones = bits == 1
    # both counts of a slot lie together, so that one look-up finds them
    both = np.take(np.ascontiguousarray(counts.T).view(np.complex64).ravel(), slots, mode="clip")
    n0 = both.real - (own & ~ones).astype(np.float32)
    n1 = both.imag - (own & ones).astype(np.float32)
    return np.maximum(n0, 0, out=n0), np.maximum(n1, 0, out=n1)


def _answered(answers: LetterAnswers, key: np.ndarray, column=lambda _, bits: bits) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, gates and bits of the letters of a part."""
    for at in range(0, len(key), ANSWERED_BYTES):
        part = slice(at, at + ANSWERED_BYTES)
        slots, bits = letter_slots(key[part])
        yield part, *answers.inputs(slots, column(part, bits)), bits


def _spelling_inputs(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    answers = LetterAnswers(counts)
    for batch in batches:
        words = batch.column(0).to_pylist()
        for part in _pieces(words):
            # equal bytes after equal bytes have equal inputs
            key, back = np.unique(letters(words[part])[0], return_inverse=True)
            x, gate, bits = np.empty((len(ORDERS) + 1, len(key), 8), np.float32), np.empty((len(key), 8), np.int64), np.empty((len(key), 8), np.uint8)
            for own, *found in _answered(answers, key):
                x[:, own], gate[own], bits[own] = (v.reshape(*v.shape[:-1], -1, 8) for v in found)
            for at in range(0, len(back), ANSWERED_BYTES):
                own = back[at : at + ANSWERED_BYTES]
                yield np.take(x, own, axis=1).reshape(len(x), -1), np.take(gate, own, axis=0).ravel(), np.take(bits, own, axis=0).ravel()


def _spelling_outcomes(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_spelling_inputs``, each distinct letter and context once, and how often it is met."""
    answers = LetterAnswers(counts)
    for words in _long_pieces(batches):
        key, n = np.unique(letters(words)[0], return_counts=True)
        for part, *found in _answered(answers, key):
            yield *found, np.repeat(n[part], 8)


def _fitted(mixer: Mixer, inputs, shared, rate: float | None, last: bool = True):
    """One row a partition: its learned weights times the bits met by gate, those bits, and in the ``last`` round the outcomes; without a rate nothing is learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, own = shared.value, mixer.copy()
        met, found = np.zeros(own.gates), np.zeros((2, own.gates * BUCKETS))
        for x, gate, bits, *times in inputs(batches, counts):
            if rate is not None:
                own.learn(x, gate, bits.astype(np.float32), rate)
            if last:
                found += own.outcomes(x, gate, bits, *times)
            else:
                met += np.bincount(gate, *times, minlength=own.gates)
        if last:
            met = found[0].reshape(own.gates, BUCKETS).sum(axis=1)
        if met.any():
            sums = np.concatenate([(own.weights * met[:, None]).ravel(), met, found.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["task", "sums"])

    return run


def _joined(rows):
    # in the order of the partitions, as sums of fractions depend on it
    total = sum(np.frombuffer(x) for x in rows.sort_values("task")["sums"])
    return pd.DataFrame({"task": [int(rows["task"].min())], "sums": [total.tobytes()]})


def learn(rows: DataFrame, mixer: Mixer, inputs, shared, passes: int, anew=None) -> Mixer:
    """``inputs`` gives those of some batches and the bits. Weights by ``passes`` rounds over all partitions; the refinement by the last round's outcomes, or by those of the final weights over what ``anew`` gives.

    FAN_IN rows of a fixed size reach the driver each time.
    """
    rates = [RATE / (1 + 4 * n / passes) for n in range(passes)]
    outcomes = np.zeros((2, mixer.gates * BUCKETS))
    rounds = [*rates, None] if anew else rates
    for number, rate in enumerate(rounds, 1):
        found = rows.mapInArrow(_fitted(mixer, anew if rate is None else inputs, shared, rate, number == len(rounds)), "task int, sums binary")
        found = found.groupBy(F.pmod("task", F.lit(FAN_IN))).applyInPandas(_joined, "task int, sums binary")
        sums = sum((np.frombuffer(r["sums"]) for r in sorted(found.collect())), np.zeros(mixer.weights.size + mixer.gates + outcomes.size))
        weights, met, outcomes = np.split(sums, [mixer.weights.size, mixer.weights.size + mixer.gates])
        if rate is not None:
            mixer.weights = np.where(met[:, None] > 0, weights.reshape(mixer.gates, -1) / np.maximum(met, 1)[:, None], mixer.weights)
    mixer.refine(*outcomes.reshape(2, -1))
    return mixer


def _long_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words put together to COUNTED_BYTES or a little more."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column(0).nbytes
        if total >= COUNTED_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if total:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _spelled(mixer: Mixer, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = LetterAnswers(shared.value)
        for batch in _long_batches(batches):
            words = batch.column(0).to_pylist()
            learned = batch.column(2).to_numpy(zero_copy_only=False) > 0
            logs = np.zeros(len(words))
            hashes = np.zeros(len(words), np.uint64)
            for part in _pieces(words, COUNTED_BYTES):
                own = words[part]
                key, word = letters(own)
                # the top byte is free: whether the word's own occurrence is left out
                key, back = np.unique(key | learned[part][word].astype(np.uint64) << np.uint64(56), return_inverse=True)
                kept, found = np.repeat(key >> np.uint64(56) == 1, 8).reshape(-1, 8), np.empty(len(key))
                for at, x, gate, bits in _answered(answers, key, lambda at, bits: np.where(kept[at].ravel(), bits, 2)):  # noqa: B023
                    found[at] = mixer.logs(x, gate, bits).reshape(-1, 8).sum(axis=1, dtype=float)
                logs[part] = np.bincount(word, found[back], len(own))
                hashes[part] = words_of(np.frombuffer(b" ".join(own), np.uint8))[2]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(1), batch.column(2), pa.array(logs)], names=["h", "n_all", "n", "spelled"])

    return run


PARTS = "key long, doc_id long, held_out boolean, seq int, h long, n_tokens long, n_known long, base double, score double, bytes long"


def _scored(lexicon_b, codes_b, counts_b, mixer: Mixer, repeated_b, made: float):
    """Rows of each text. Its sums have ``n_tokens``; a passage that may be repeated has ``seq`` and ``h``; a word to be joined has ``h`` and no ``score``.

    ``made`` is the logarithm of the share of passages that are made of words.
    """
    names = [x.split()[0] for x in PARTS.split(", ")]

    def rows(key, ids, held, seq=None, h=None, tokens=None, known=None, base=None, score=None, size=None):
        n = len(key)
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        columns = (key, ids, held, seq, h, tokens, known, base, score, size)
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coded_base, known_h, known, base, trained, unseen = lexicon_b.value
        codes, repeated = codes_b.value, repeated_b.value
        answers, known_places = WordAnswers(codes, counts_b.value), Places(known_h)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).cast(pa.int64()).fill_null(0)
            for first, count, buf, _, ends, h, bounds in word_slices(batch.column(1)):
                key = number + np.arange(count)
                number += count
                ids = batch.column(0).slice(first, count)
                held = batch.column(2).slice(first, count).to_numpy(zero_copy_only=False).astype(bool)
                symbol, function, before, text = codes.marked(h, bounds)
                logs = np.zeros(len(symbol))
                for at in range(0, len(symbol), SCORED_PIECE):
                    part = slice(at, at + SCORED_PIECE)
                    x, gate, bits, sizes = answers.bits(symbol[part], function[part], before[part], held[text[part]])
                    logs[part] = np.add.reduceat(mixer.logs(x, gate, bits).astype(float), np.cumsum(sizes) - sizes)
                is_word = symbol != codes.end
                total = np.bincount(text[~is_word], logs[~is_word], count)
                symbol, logs, text = symbol[is_word], logs[is_word], text[is_word]
                # words with a code are known by their symbols; only the others are looked up
                escaped = symbol == codes.escape
                other = np.flatnonzero(escaped)
                at, found = known_places.find(h[other])
                at, met, missed = at[found], other[found], other[~found]
                logs[met] += np.where(held[text[met]], unseen[at], trained[at])
                n_known = np.bincount(text, ~escaped, count) + np.bincount(text[met], known[at], count)
                n_base = np.bincount(text, np.take(coded_base, symbol), count) + np.bincount(text[met], base[at], count)
                starts, own = passages(buf, ends, h, bounds)
                sums = np.add.reduceat(logs, starts) if len(starts) else np.zeros(0)
                of = text[starts] if len(starts) else np.zeros(0, np.int64)
                bit = own >> np.uint64(64 - FILTER_BITS)
                maybe = (repeated[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                total += np.bincount(of[~maybe], sums[~maybe] + made, count)
                yield rows(key, ids, held, tokens=np.diff(bounds) + 1, known=n_known.astype(np.int64), base=n_base, score=total, size=lengths.slice(first, count))
                seq = np.arange(len(starts))
                if maybe.any():
                    yield rows(key[of[maybe]], None, held[of[maybe]], seq[maybe], own[maybe].view(np.int64), score=sums[maybe])
                if len(missed):
                    place, of = np.searchsorted(starts, missed, side="right") - 1, text[missed]
                    yield rows(key[of], None, held[of], np.where(maybe[place], seq[place], -1), h[missed].view(np.int64))

    return run


def fit_spelling(lexicon: DataFrame):
    """The mixer and the broadcast slot counts of spellings over all words with a count."""
    known = lexicon.where("n > 0").select("word")
    shared = lexicon.sparkSession.sparkContext.broadcast(_summed(known.mapInArrow(_slot_counts, "chunk int, task int, counts binary"), SLOTS))
    return learn(known, Mixer(), _spelling_inputs, shared, PASSES, _spelling_outcomes), shared


def fit_words(texts: DataFrame, codes: Codes):
    """The codes, slot counts and mixer of words over all training texts (a column of texts)."""
    spread = texts.sparkSession.sparkContext.broadcast
    codes_b = spread(codes)
    shared = spread(_summed(texts.mapInArrow(_word_counts(codes_b), "chunk int, task int, counts binary"), WORD_SLOTS))

    def inputs(batches, counts):
        answers = WordAnswers(codes_b.value, counts)
        for symbol, function, before in _word_pieces(batches, codes_b.value):
            for at in range(0, len(symbol), SCORED_PIECE):
                part = slice(at, at + SCORED_PIECE)
                yield answers.bits(symbol[part], function[part], before[part])[:3]

    mixer = learn(texts, Mixer(WORD_WEIGHTS, WORD_GATES), inputs, shared, 1)
    return codes_b, shared, mixer


def _plus(a, b):
    """log10(10 ** a + 10 ** b)."""
    return F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b)))


def score_texts(docs: DataFrame, held_out: F.Column, text: str = "text") -> DataFrame:
    """Log probabilities (base 10) of all texts under the model and under smoothed word counts.

    ``docs`` has ``doc_id`` (long) and ``text``; rows where ``held_out`` isn't
    true are learned from. Returns ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, bits_per_byte``, one row for each of ``docs``, be
    its id null or repeated. A null text is empty: only the end is scored. Without any
    training text all bits are even. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    spread = spark.sparkContext.broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = rows.where("not held_out").select("text")
    words = rows.select(~F.col("held_out"), "text").mapInArrow(_counted, "word binary, n_all long, n long").groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"))
    lexicon = materialize(words, "lm-words")
    repeats = materialize(rows.select(~F.col("held_out"), "text").mapInArrow(_passage_counts, "h long, n_all long, n long").groupBy("h").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n")).select("h", F.when((F.col("n") > 0) & (F.col("n_all") > 1), F.col("n")).alias("n"), F.col("n").alias("all")).groupBy(F.when(F.col("n").isNotNull(), F.col("h")).alias("h")).agg(F.sum("n").alias("n"), F.sum("all").alias("all")), "lm-passages")
    ends = training.count()
    total = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    bottom = np.log10(tokens + 0.1 * (distinct + 1))

    coded = lexicon.where("n > 0").orderBy(F.desc("n"), "word").limit(CODED).toPandas()
    hashes = words_of(np.frombuffer(b" ".join(bytes(w) for w in coded["word"]), np.uint8))[2]
    counts = coded["n"].to_numpy(np.int64)
    escaped = total["n"] - int(counts.sum())
    # words counted once: those with a code are all above any that have none, or as frequent
    once = total["once"] - int((counts == 1).sum())
    codes_b, shared, word_mixer = fit_words(training, Codes(hashes, counts, ends, escaped))

    mixer, letters = fit_spelling(lexicon)
    fresh = (once + 1) / (escaped + 2)
    n = F.col("n").cast("double")
    spelled = F.lit(float(np.log10(fresh))) + F.col("spelled")

    def among_escaped(n):
        # a new word may be so long that its probability underflows: only logarithms are used
        return F.when(n <= 0, spelled).otherwise(_plus(F.log10(n * ((1 - fresh) / max(escaped, 1))), spelled))

    scored = materialize(lexicon.select("word", "n_all", "n").mapInArrow(_spelled(mixer, letters), "h long, n_all long, n long, spelled double").select("h", "n_all", F.when(F.col("n") > 0, 1).otherwise(0).cast("long").alias("known"), (F.log10(n + 0.1) - F.lit(float(bottom))).alias("base"), among_escaped(n - 1).alias("trained"), among_escaped(n).alias("unseen")), "lm-lexicon")

    sizes = scored.groupBy(F.least("n_all", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, held = 100_001, 0
    for r in sizes:
        held += r["count"]
        if held > MOST_FREQUENT:
            break
        least = r["n"]
    top = scored.where(F.col("n_all") >= least).select("h", "known", "base", "trained", "unseen").toPandas()
    top["h"] = top["h"].to_numpy(np.int64).view(np.uint64)
    top = top[~top["h"].isin(hashes)].drop_duplicates("h").sort_values("h")
    # nothing for the end, which all texts have, and for the escape
    coded_base = np.concatenate((np.log10(counts + 0.1) - bottom, [0.0, 0.0]))
    frequent = spread((coded_base, top["h"].to_numpy(np.uint64), *(top[c].to_numpy(float) for c in ("known", "base", "trained", "unseen"))))
    del top, coded

    seen = repeats.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("again")).first()
    copied = (seen["again"] + 0.5) / (seen["n"] + 1)
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in repeats.where("h is not null").groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).toLocalIterator():
        bitmap[(r["b"] - 1) * BITMAP // 8 : r["b"] * BITMAP // 8] = np.frombuffer(r["m"], np.uint8)
    parts = materialize(rows.mapInArrow(_scored(frequent, codes_b, shared, word_mixer, spread(bitmap), float(np.log10(1 - copied))), PARTS), "lm-parts")

    rare = parts.where("n_tokens is null and score is null").select("key", "held_out", "seq", "h").join(scored.where(F.col("n_all") < least).select("h", "known", "base", "trained", "unseen"), "h")
    rare = rare.groupBy("key", "seq").agg(F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.sum(F.when(F.col("held_out"), F.col("unseen")).otherwise(F.col("trained"))).alias("more"))
    rare = materialize(rare, "lm-rare")
    again = parts.where("seq is not null and score is not null").select("key", "held_out", "seq", "h", "score")
    again = again.join(rare.where("seq >= 0").select("key", "seq", "more"), ["key", "seq"], "left").join(repeats.where("h is not null").select("h", "n"), "h", "left")
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("held_out"), 0).otherwise(1)
    made = F.col("score") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(1 - copied)))
    passage = F.when(others <= 0, made).otherwise(_plus(made, F.log10(others * (copied / max(seen["n"], 1)))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held_out", "boolean"), ("n_tokens", "long"))]
    zero = F.lit(0).cast("long")
    sums = parts.where("n_tokens is not null").select("key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bytes")
    sums = sums.unionByName(rare.select("key", *none, "n_known", "base", F.when(F.col("seq") < 0, F.col("more")).otherwise(0.0).alias("score"), zero.alias("bytes")))
    sums = sums.unionByName(again.groupBy("key").agg(F.sum(passage).alias("score")).select("key", *none, zero.alias("n_known"), F.lit(0.0).alias("base"), "score", zero.alias("bytes")))
    sums = sums.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "bytes")))
    end_base = float(np.log10(ends + 0.1) - bottom)
    return sums.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + (1 if ends else 0)).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + end_base).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"))
