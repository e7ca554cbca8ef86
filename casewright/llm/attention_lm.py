"""Language-model scores from a causal self-attention model over subword ids.

The model predicts the class of the next subword (classes come from the company that
subwords keep in all training texts) with one layer of masked self-attention.
Its weights start from a sample and are then trained on every subword of every training
text: tasks go through shards of the texts from the same start, and their weights are
averaged. The subword within its class follows its counts over all training texts, alone and
after the subword before it in the word. Frequent pairs are looked up in every task, all
others meet their counts in a join. A text is scored in windows that overlap, so that every subword has context, and
each is counted once. Beside it stands a smoothed word unigram, whose counts cover all
training texts: frequent words are looked up in a bounded dictionary that every task
holds, all others meet their counts in a join. Texts are taken apart once: all later steps
know a word by its subword ids, which no two words share.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casewright.llm.common import fold, table
from casewright.session import cut_lineage

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Subwords of the vocabulary, and the free id that ends a text (and stands before it).
END = 50_256
SIZE = END + 1
ADD = 0.1

#: The sample that the weights start from: documents (the least seeded hashes), at least so many and one of so many of
#: the training texts, and at most so many windows of each.
SAMPLE_DOCS = 1500
TEXTS_PER_SAMPLE = 100
SAMPLE_WINDOWS = 16
SEED = 17
WINDOW = 32
#: Every window but the first scores its last STEP subwords and has the others as context.
STEP = 24
WIDTH = 16
CLASSES = 64
#: Subwords with an own embedding, the most frequent of the training texts.
EMBEDDED = 4096
#: Steps on the sample.
STEPS = 300
BATCH = 192
RATE = 0.02
#: Tokens of the training texts to a shard, and subwords that a task holds and trains on together.
SHARD_TOKENS = 1_000_000
SHARD_SUBWORDS = 4_000_000
#: First step size on a shard. Weights travel in blocks of so many.
SHARD_RATE = 0.01
WEIGHTS = 8192
#: Attention scores and logits are held under this, which keeps exp() in range.
HIGHEST = 30.0

#: Words in the dictionary of every task, and the bytes that the ids of such a word have at most: under 32 MB.
DICTIONARY = 400_000
WORD_BYTES = 64
#: Distinct words that a worker keeps the ids of. A worker that holds that many keeps the half that was met most often.
REMEMBERED = 200_000
#: Words, and pairs of subwords from word to word, that are counted before they are sent on.
COUNTED = 400_000
#: White space of other scripts may stand in a word.
SPACE = re.compile(r"\s")
#: Letters of a word that are encoded at once; a longer word is encoded in parts.
PART = 1000
#: Pairs of neighbouring subwords that every task holds, the most frequent: under 5 MB. The others are joined.
PAIRS = 300_000
#: A pair's share is mixed with so many draws from the class alone.
DRAWS = 5.0
#: Rows of a long and narrow matrix that are multiplied together.
ROWS = 128
#: Windows that go through the model together (their logits fit a cache), and bytes of the texts that are taken together.
WINDOWS = 256
TOGETHER = 4_000_000


@dataclass
class Lists:
    """Lists of numbers end to end, the k-th from ``start[k]`` on."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, size: np.ndarray) -> Lists:
        return cls(flat, np.cumsum(size) - size, size)

    def take(self, at: np.ndarray) -> Lists:
        size = self.size[at]
        begin = np.cumsum(size) - size
        places = np.repeat(self.start[at] - begin, size)
        places += np.arange(len(places))
        return Lists(self.flat.take(places), begin, size)

    @classmethod
    def read(cls, lists: pa.Array) -> Lists:
        """From ids as bytes, a value to a list."""
        lists = lists.cast(pa.binary())
        offsets = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, 4 * lists.offset) if len(lists) else np.zeros(1, np.int32)
        flat = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view("<u2")
        return cls.of(flat, np.diff(offsets) // 2)

    def written(self) -> pa.Array:
        """Ids as bytes, a value to a list, if the lists lie end to end."""
        offsets = 2 * np.append(self.start, len(self.flat))
        return pa.Array.from_buffers(pa.binary(), len(self.size), [None, pa.py_buffer(offsets.astype(np.int32)),
                                                                   pa.py_buffer(np.ascontiguousarray(self.flat, "<u2"))])

    def then(self, other: Lists) -> Lists:
        return Lists(np.concatenate([self.flat, other.flat]), np.concatenate([self.start, other.start + len(self.flat)]),
                     np.concatenate([self.size, other.size]))


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts end to end (dictionary-encoded, A-Z in lower case, as ``words_of``), and
    how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, size = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty word
    if not pc.all(full).as_py():
        upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        size, flat = np.diff(upto[np.concatenate([[0], np.cumsum(size)])]), flat.filter(full)
    return flat.dictionary_encode(), size


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of ``texts`` of about ``TOGETHER`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // TOGETHER
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(texts)]]).tolist()
    yield from ((a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def ranks_of(vocabulary: str) -> dict[bytes, int]:
    import public_tokenizers

    at = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    with open(at, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def beginnings(vocabulary: str = VOCABULARY) -> np.ndarray:
    """By subword: whether it starts a word or is the end of a text. No word has a space but the one before it."""
    out, ranks = np.zeros(SIZE, bool), ranks_of(vocabulary)
    out[list(ranks.values())] = [piece.startswith(b" ") for piece in ranks]
    out[END] = True
    return out


class Subwords:
    """Ids of words, each with the space before it. Words that were met have a number; number 0 is
    the end of a text."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        ranks = ranks_of(vocabulary)
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(SIZE, np.int64)
        self.bytes_of[list(ranks.values())] = [len(piece) for piece in ranks]
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(itertools.count(1).__next__)
        self.ids = Lists.of(np.array([END], np.uint16), np.array([1]))
        self.met = np.zeros(1, np.int32)

    def trim(self) -> np.ndarray | None:
        """If too many words are held, keeps the half that was met most often, with new numbers; by number
        the one it had."""
        if len(self.number) <= REMEMBERED:
            return None
        kept = np.concatenate([[0], 1 + np.sort(np.argsort(-self.met[1:], kind="stable")[:REMEMBERED // 2])])
        words = list(self.number)  # in the order of their numbers
        self.number = defaultdict(itertools.count(len(kept)).__next__, zip([words[k - 1] for k in kept[1:].tolist()], range(1, len(kept)), strict=True))
        self.ids, self.met = self.ids.take(kept), self.met[kept] // 2
        return kept

    def _word(self, word: str) -> list[int]:
        text = " " + word
        return [i for a in range(0, len(text), PART) for i in self.encoding.encode_ordinary(text[a:a + PART])]

    def encode(self, words: list[str]) -> Lists:
        """Ids of each word. No piece of the pattern crosses a space before a visible character, so
        words without white space are encoded together; all others alone."""
        alone = {k for k, w in enumerate(words) if len(w) >= PART} if max(map(len, words), default=0) >= PART else set()
        if SPACE.search("".join(words)):
            alone.update(k for k, w in enumerate(words) if SPACE.search(w))
        if alone:
            coded = {k: self._word(words[k]) for k in alone}
            rest = self.encode([w for k, w in enumerate(words) if k not in alone]) if len(alone) < len(words) else None
            size = np.zeros(len(words), np.int64)
            size[list(coded)] = [len(c) for c in coded.values()]
            others = np.array([k not in alone for k in range(len(words))])
            if rest:
                size[others] = rest.size
            out = Lists.of(np.zeros(int(size.sum()), np.uint16), size)
            if rest:
                out.flat[np.repeat(others, size)] = rest.flat
            for k, ids in coded.items():
                out.flat[out.start[k]:out.start[k] + len(ids)] = ids
            return out
        if not words:
            return Lists.of(np.zeros(0, np.uint16), np.zeros(0, np.int64))
        text = " " + " ".join(words)
        ids, written = self.encoding.encode_to_numpy(text), np.frombuffer(text.encode(), np.uint8)
        ends = np.append(np.flatnonzero(written == ord(" "))[1:], len(written))
        upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        return Lists.of(ids.astype(np.uint16), np.diff(upto, prepend=0))

    def learn(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The number of each of ``words``, no two of them equal, and those that had none, in the order of theirs."""
        first = len(self.ids.size)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = [words[k] for k in np.flatnonzero(numbers >= first).tolist()]
        if new:
            self.ids = self.ids.then(self.encode(new))
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.met[numbers] += 1
        return numbers, new


def with_ends(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of the words of texts end to end, with the end after each text."""
    out = np.zeros(len(words) + len(size), np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(size + 1) - 1] = False
    out[inside] = words
    return out


_SUBWORDS: dict[str, Subwords] = {}


def subwords() -> Subwords:
    """One per worker process; tasks that follow each other share what is known."""
    if VOCABULARY not in _SUBWORDS:
        _SUBWORDS[VOCABULARY] = Subwords()
    return _SUBWORDS[VOCABULARY]


def forget() -> None:
    """Frees what the worker process keeps for texts; later steps have ids only."""
    _SUBWORDS.clear()
    pa.default_memory_pool().release_unused()


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left.T @ right`` of many rows and few columns, in blocks of rows that fit a cache."""
    full = len(left) // ROWS * ROWS
    blocks = lambda m: m[:full].reshape(-1, ROWS, m.shape[1])
    return (blocks(left).swapaxes(1, 2) @ blocks(right)).sum(0) + left[full:].T @ right[full:]


def mapped(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``rows @ by`` for many rows and a small ``by``, in blocks of rows if they come out even."""
    if len(rows) % ROWS:
        return rows @ by
    return (rows.reshape(-1, ROWS, rows.shape[1]) @ np.ascontiguousarray(by)).reshape(len(rows), by.shape[1])


@dataclass
class Model:
    row: np.ndarray          # by subword: its embedding
    group: np.ndarray        # by subword: its class
    within: np.ndarray       # by subword: log10 probability within its class
    weights: dict[str, np.ndarray]
    pairs: np.ndarray        # sorted: subword before * SIZE + subword
    change: np.ndarray       # by pair: log10 of its probability within the class against ``within``
    groups: np.ndarray       # sorted: subword before * CLASSES + class
    other: np.ndarray        # by group: the same for all subwords without a pair

    def looked_up(self, words: Lists) -> tuple[np.ndarray, Lists]:
        """By word (its subword ids): what its pairs add to the log10 probability, and those that are not among ``pairs``."""
        words = words.take(np.arange(len(words.size)))
        flat, begin = words.flat.astype(np.int64), words.start
        inside = np.ones(len(flat), bool)
        inside[begin] = False  # a word's first subword has no pair
        right = np.flatnonzero(inside)
        before, after = flat[right - 1], flat[right]
        pair, added, missing = before * SIZE + after, np.zeros(len(right)), np.ones(len(right), bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            missing = self.pairs[at] != pair
            added = np.where(missing, 0, self.change[at])
        if len(self.groups) and missing.any():
            group = before[missing] * CLASSES + self.group[after[missing]]
            at = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
            added[missing] = np.where(self.groups[at] == group, self.other[at], 0)
        out, lacks = np.zeros(len(flat)), np.zeros(len(flat), np.int64)
        out[right], lacks[right] = added, missing
        return np.add.reduceat(out, begin), Lists.of(pair[missing], np.add.reduceat(lacks, begin))

    def changes(self, words: list[np.ndarray]) -> np.ndarray:
        return self.looked_up(Lists.of(np.concatenate(words), np.array([len(w) for w in words])))[0]

    def loss_and_gradients(self, ids: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the classes after each of ``ids`` (batch, time), and all gradients."""
        w, (n, time), width = self.weights, ids.shape, self.weights["q"].shape[0]
        rows, scale, kind = self.row.take(ids).ravel(), 1 / float(np.sqrt(width)), w["e"].dtype
        deep = lambda m: m.reshape(n, time, -1)
        flat = lambda m: m.reshape(n * time, -1)
        turned = lambda m: np.ascontiguousarray(deep(m).swapaxes(1, 2))
        both = self.projections()
        x = w["e"].take(rows, axis=0)
        deep(x)[:] += w["p"][:time]
        made = deep(mapped(x, both))
        q, u = made[..., :width], made[..., width:]
        a = q @ turned(x)
        high = a >= HIGHEST if a.max(initial=0) >= HIGHEST else None
        if high is not None:
            np.minimum(a, HIGHEST, out=a)
        np.exp(a, out=a)
        a *= np.tri(time, dtype=kind)
        share = 1 / (a @ np.ones(time, kind)).reshape(-1, 1)
        o = flat(a @ u)
        o *= share
        h, last = np.empty((n * time, width + 1), kind), np.concatenate([w["c"], w["b"][None]])
        np.add(x, o, out=h[:, :width])
        h[:, width] = 1
        # p and a are not divided by their sums: what is made of them has fewer columns to divide.
        p = mapped(h, last)
        with np.errstate(over="ignore"):
            np.exp(p, out=p)
            total = p @ np.ones(p.shape[1], kind)
        if not (1e-30 < total.min(initial=1) and total.max(initial=1) < 1e30):
            p = h @ last
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            total = p @ np.ones(p.shape[1], kind)
        own = np.arange(0, p.size, p.shape[1]) + targets.ravel()
        right = p.ravel().take(own)
        loss = float(-np.log(np.maximum(right / total, 1e-12)).mean())
        p.ravel()[own] = right - total
        part = (1 / (total * targets.size)).astype(kind)[:, None]
        dh = mapped(p, w["c"].T)
        dh *= part
        h *= part
        dlast = product(h, p)
        do = dh * share
        ds = deep(do) @ turned(u)
        ds -= deep((do * o) @ np.ones(width, kind))
        ds *= a
        if high is not None:
            ds[high] = 0
        dmade = np.empty_like(made)
        np.matmul(ds, deep(x), out=dmade[..., :width])
        np.matmul(a.swapaxes(1, 2), deep(do), out=dmade[..., width:])
        dboth = product(x, flat(dmade))
        dx = mapped(flat(dmade), both.T)
        dx += dh
        dx += flat(ds.swapaxes(1, 2) @ q)
        de = np.zeros_like(w["e"])
        np.add.at(de.reshape(-1), np.arange(de.size).reshape(de.shape).take(rows, axis=0).ravel(), dx.ravel())
        dp = np.zeros_like(w["p"])
        dp[:time] = deep(dx).sum(0)
        dmatch, dcarry = dboth[:, :width] * scale, dboth[:, width:]
        return loss, {"e": de, "p": dp, "q": dmatch @ w["k"], "k": dmatch.T @ w["q"], "v": dcarry @ w["o"].T, "o": w["v"].T @ dcarry,
                      "c": dlast[:width], "b": dlast[width]}

    def projections(self) -> np.ndarray:
        """What a subword asks of those before it, and what it hands on to the classes, side by side. With
        one head, queries and keys meet in one matrix only, and so do values and outputs."""
        w = self.weights
        return np.concatenate([w["q"] @ w["k"].T * (1 / float(np.sqrt(w["q"].shape[0]))), w["v"] @ w["o"]], axis=1)

    def learn(self, batches: Iterator[np.ndarray], steps: int, rate: float) -> None:
        """Adam over ``batches`` of windows, with a step size that falls to zero."""
        names = list(self.weights)
        every = np.concatenate([self.weights[k].ravel() for k in names])
        cuts = np.cumsum([self.weights[k].size for k in names])[:-1]
        self.weights = {k: part.reshape(self.weights[k].shape) for k, part in zip(names, np.split(every, cuts), strict=True)}  # views
        first, second, change = np.zeros_like(every), np.zeros_like(every), np.empty_like(every)
        for step, batch in enumerate(batches, 1):
            _, gradients = self.loss_and_gradients(batch[:, :-1], self.group.take(batch[:, 1:]))
            g = np.concatenate([gradients[k].ravel() for k in names])
            now = float(rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step))
            # The moments are kept without their factors of 0.1 and 0.01.
            first *= 0.9
            first += g
            second *= 0.99
            second += np.multiply(g, g, out=g)
            np.sqrt(second, out=change)
            change += 1e-7
            np.divide(first, change, out=change)
            change *= now
            every -= change

    def log10(self, inputs: np.ndarray, targets: np.ndarray, scored: int) -> np.ndarray:
        """log10 probability of the last ``scored`` of ``targets`` (batch, time), which follow ``inputs``."""
        w, (n, time), width = self.weights, inputs.shape, self.weights["q"].shape[0]
        both = self.projections()
        x = w["e"].take(self.row.take(inputs), axis=0)
        x += w["p"][:time]
        last = np.ascontiguousarray(x[:, time - scored:]).reshape(-1, width)
        u = mapped(x.reshape(-1, width), both[:, width:]).reshape(n, time, width)
        a = mapped(last, both[:, :width]).reshape(n, scored, width) @ np.ascontiguousarray(x.swapaxes(1, 2))
        if a.max(initial=0) > HIGHEST:
            np.minimum(a, HIGHEST, out=a)
        np.exp(a, out=a)
        a *= np.tri(scored, time, time - scored, dtype=a.dtype)
        o = (a @ u).reshape(-1, width)
        o *= (1 / (a.reshape(-1, time) @ np.ones(time, a.dtype)))[:, None]
        h = np.empty((len(last), width + 1), last.dtype)
        np.add(last, o, out=h[:, :width])
        h[:, width] = 1
        z = mapped(h, np.concatenate([w["c"], w["b"][None]]))
        if z.max(initial=0) > HIGHEST:
            np.minimum(z, HIGHEST, out=z)
        goal = targets[:, time - scored:].ravel()
        own = z.ravel().take(np.arange(0, z.size, z.shape[1]) + self.group.take(goal))
        np.exp(z, out=z)
        total = np.log(z @ np.ones(z.shape[1], z.dtype))
        return ((own - total) / np.float32(np.log(10)) + self.within.take(goal)).reshape(n, scored)

    def score(self, texts: list[np.ndarray]) -> list[float]:
        """log10 probability of each text (subword ids with the end): every subword once."""
        return self.score_flat(np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts])).tolist()

    def score_flat(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for texts end to end."""
        begin = np.cumsum(sizes) - sizes
        # What stands after a text does not reach back into it.
        follow = np.full(len(flat) + WINDOW, END, flat.dtype)
        follow[:len(flat)] = flat
        before = np.full(len(follow), END, flat.dtype)
        before[1:] = follow[:-1]
        before[begin] = END
        inputs, targets = (np.lib.stride_tricks.sliding_window_view(ids, WINDOW) for ids in (before, follow))
        more = np.maximum(0, -(-(sizes - WINDOW) // STEP))  # windows after the first
        out = np.zeros(len(sizes))
        owner = np.repeat(np.arange(len(sizes)), more)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
        for who, start, scored in ((np.arange(len(sizes)), np.zeros(len(sizes), int), WINDOW), (owner, (at + 1) * STEP, STEP)):
            for a in range(0, len(who), WINDOWS):
                rows, first = who[a:a + WINDOWS], start[a:a + WINDOWS]
                place = first + begin[rows]
                got = self.log10(inputs[place], targets[place], scored)
                got[np.arange(WINDOW - scored, WINDOW) >= (sizes[rows] - first)[:, None]] = 0
                np.add.at(out, rows, got.sum(1, dtype=np.float64))
        return out


def embedding_rows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(frequent subwords, embedding row of every subword, how many columns neighbours have)."""
    counts = counts.copy()
    counts[END] = 0
    frequent = np.argsort(-counts, kind="stable")[:EMBEDDED]
    frequent = frequent[counts[frequent] > 1]
    row = np.zeros(SIZE, np.int32)
    row[frequent], row[END] = np.arange(len(frequent)) + 1, len(frequent) + 1
    return frequent, row, min(256, len(frequent)) + 2


def neighbour_cells(row: np.ndarray, near: int, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, sum) of ``times`` over pairs: a cell is an embedding row * 2 * near + the neighbour's column
    (of the subword before, or near + of the one after; the last stands for all that are less frequent,
    the first for those without a row and the end)."""
    small = np.minimum(row, near - 1)
    small[END] = 0
    left, right = pairs // SIZE, pairs % SIZE
    cells = np.concatenate([row[right].astype(np.int64) * 2 * near + small[left], row[left].astype(np.int64) * 2 * near + near + small[right]])
    cells, which = np.unique(cells, return_inverse=True)
    return cells, np.bincount(which, np.concatenate([times, times]), minlength=len(cells))


def classes(counts: np.ndarray, pairs: np.ndarray, times: np.ndarray,
            cells: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(embedding row, class) of every subword. Class 0 holds the rare ones, the last the end; the
    frequent ones are clustered by what stands before and after them. ``cells`` sums all neighbours
    by cell; without it ``pairs`` are all."""
    frequent, row, near = embedding_rows(counts)
    group = np.zeros(SIZE, np.int32)
    group[END] = CLASSES - 1
    if not len(frequent):
        return row, group
    features = np.zeros((len(frequent) + 2, 2 * near))
    cell, sums = cells(row, near) if cells else neighbour_cells(row, near, pairs, times)
    features.ravel()[cell] = sums
    features = features[1:-1]
    weight = counts[frequent].astype(float)
    features = np.sqrt((features + 0.01) / (features.sum(1, keepdims=True) + 0.01 * features.shape[1]))
    features -= np.average(features, axis=0, weights=weight)
    _, vectors = np.linalg.eigh((features * weight[:, None]).T @ features)
    features = features @ vectors[:, -24:]
    k, rng = min(CLASSES - 2, len(frequent)), np.random.default_rng(SEED)
    centre = features[rng.choice(len(frequent), k, replace=False, p=weight / weight.sum())]
    for _ in range(15):
        nearest = ((centre ** 2).sum(1) - 2 * features @ centre.T).argmin(1)
        mass = np.bincount(nearest, weight, minlength=k)
        sums = np.stack([np.bincount(nearest, weight * f, minlength=k) for f in features.T], axis=1)
        centre = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centre)
    group[frequent] = nearest + 1
    return row, group


def trained(windows: np.ndarray, counts: np.ndarray, pairs: np.ndarray, times: np.ndarray, steps: int = STEPS,
            totals: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None,
            cells: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]] | None = None) -> Model:
    """A model from sample windows (batch, WINDOW + 1) of ids, which the weights of the attention
    start from, and from the counts of subwords and of pairs (before * SIZE + subword, sorted) in
    all training texts.

    Within a class and after subword a: p(b) = (n(a, b) + DRAWS p(b | class)) / (n(a, class) + DRAWS),
    where n(a, class) sums all pairs, so that the probabilities add up to one. ``totals`` gives
    these sums (sorted a * CLASSES + class, sum) for the class of every subword, ``cells`` those
    that make the classes; without them ``pairs`` are all pairs.
    """
    rng = np.random.default_rng(SEED)
    row, group = classes(counts, pairs, times, cells)
    mass = np.bincount(group, counts + ADD, minlength=CLASSES)
    within = (np.log10(counts + ADD) - np.log10(mass[group])).astype(np.float32)
    shape = {"e": (row.max() + 1, WIDTH), "p": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH),
             "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "c": (WIDTH, CLASSES), "b": (CLASSES,)}
    weights = {k: (rng.normal(0, 1, s) / np.sqrt(WIDTH) * (0.1 if k == "p" else k != "b")).astype(np.float32) for k, s in shape.items()}
    after = pairs // SIZE * CLASSES + group[pairs % SIZE]
    if totals:
        groups, total = totals(group)
        of_pair, total = np.searchsorted(groups, after), total + DRAWS
    else:
        groups, of_pair = np.unique(after, return_inverse=True)
        total = np.bincount(of_pair, times, minlength=len(groups)) + DRAWS
    alone = 10.0 ** within[pairs % SIZE].astype(float)
    change = np.log10((times + DRAWS * alone) / total[of_pair]) - np.log10(alone)
    model = Model(row, group, within, weights, pairs, change, groups, np.log10(DRAWS / total))
    if len(windows):
        model.learn((windows[rng.integers(0, len(windows), BATCH)] for _ in range(steps)), steps, RATE)
    return model


READ = "word binary, key long, n long, h long, doc_id long, ids binary"
_READ_ARROW = pa.schema([("word", pa.binary()), ("key", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()),
                         ("ids", pa.binary())])


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over texts (h, text and other columns to keep), those to learn from with an h. Rows of three
    kinds: (word, n), the ids of words to learn from and how often they were met; (key, n), pairs of subwords
    from word to word or from or to an end there (before * SIZE + subword); (h, others, ids), the ids of each
    text with its end."""
    coder, words, edges = subwords(), [], []

    def rows(length: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(length, f.type) for f in _READ_ARROW],
                                          schema=_READ_ARROW)

    def merged(tables: list[pa.Table], name: str) -> list[pa.Table]:
        return [pa.concat_tables(tables).group_by(name).aggregate([("n", "sum")]).rename_columns([name, "n"])]

    def sent(tables: list[pa.Table], name: str) -> Iterator[pa.RecordBatch]:
        for batch in merged(tables, name)[0].combine_chunks().to_batches() if tables else ():
            yield rows(batch.num_rows, **{name: batch[name], "n": batch["n"]})

    for part in parts:
        kept = [name for name in part.schema.names if name != "text"]
        for at, length in pieces(part["text"]):
            found, size = words_in(part["text"].slice(at, length))
            distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            coder.trim()
            numbers, _ = coder.learn(distinct)
            codes = found.indices.to_numpy()
            coded = coder.ids.take(with_ends(numbers[codes], size))
            texts = Lists.of(coded.flat, np.add.reduceat(coded.size, np.cumsum(size + 1) - size - 1))
            yield rows(length, ids=texts.written(), **{name: part[name].slice(at, length) for name in kept})
            use = part["h"].slice(at, length).is_valid().to_numpy(zero_copy_only=False)
            n = np.bincount(codes[np.repeat(use, size)], minlength=len(distinct))
            met = np.flatnonzero(n)
            words.append(pa.table({"word": coder.ids.take(numbers[met]).written(), "n": pa.array(n[met], pa.int64())}))
            before = np.concatenate([[END], coded.flat[coded.start + coded.size - 1][:-1]]).astype(np.int64)
            keys = pc.value_counts(pa.array((before * SIZE + coded.flat[coded.start])[np.repeat(use, size + 1)]))
            edges.append(pa.table({"key": keys.field("values"), "n": keys.field("counts")}))
            if sum(map(len, words)) > 2 * COUNTED:
                words = merged(words, "word")
                if len(words[0]) > COUNTED:
                    yield from sent(words, "word")
                    words = []
            if sum(map(len, edges)) > 2 * COUNTED:
                edges = merged(edges, "key")
                if len(edges[0]) > COUNTED:
                    yield from sent(edges, "key")
                    edges = []
        pa.default_memory_pool().release_unused()
    yield from sent(words, "word")
    yield from sent(edges, "key")


def _subword_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): subwords (key: the id) and pairs in words (key: (id before + 1) * SIZE + id)."""
    forget()
    keys, times = [], []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, np.bincount(which, np.concatenate(times)).astype(np.int64)

    for part in parts:
        coded = Lists.read(part["word"])
        ids, n = coded.flat.astype(np.int64), np.repeat(part["c"].to_numpy(), coded.size)
        inside = np.ones(len(ids), bool)
        inside[coded.start] = False
        inside = np.flatnonzero(inside)
        keys += [ids, (ids[inside - 1] + 1) * SIZE + ids[inside]]
        times += [n, n[inside]]
        distinct, n = merged()
        keys, times = [distinct], [n]
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(times[0])], names=["key", "n"])


def coded_texts(coder: Subwords, texts: pa.Array) -> Lists:
    """Ids of each text, with its end."""
    words, size = words_in(texts)
    coder.trim()
    numbers, _ = coder.learn(words.dictionary.to_numpy(zero_copy_only=False).tolist())
    of_words = coder.ids.take(with_ends(numbers[words.indices.to_numpy()], size))
    return Lists.of(of_words.flat, np.add.reduceat(of_words.size, np.cumsum(size + 1) - size - 1))


def _sampled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``SAMPLE_WINDOWS`` windows of WINDOW + 1 ids of each text, at even distances."""
    coder = subwords()
    for part in parts:
        rows = []
        for first, length in pieces(part["text"]):
            coded = coded_texts(coder, part["text"].slice(first, length))
            for h, text in zip(part["h"].slice(first, length).to_pylist(), np.split(coded.flat, coded.start[1:]), strict=True):
                ids = np.concatenate([[END], text]).astype("<u2")
                n = min(SAMPLE_WINDOWS, -(-len(ids) // WINDOW))
                for k in range(n):
                    window = ids[k * len(ids) // n:][:WINDOW + 1]
                    rows.append((h, k, np.pad(window, (0, WINDOW + 1 - len(window)), constant_values=END).tobytes()))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)],
                                         names=["h", "k", "window"])


def sample(docs: DataFrame, training: Column, size: int = SAMPLE_DOCS) -> np.ndarray:
    """Windows of the training documents with the least hashes; the hashes are found on narrow rows."""
    rows = docs.select("text", F.xxhash64(F.lit(SEED), "doc_id").alias("h"), training.alias("use")).filter("use")
    least = rows.select("h").orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if least is None:
        return np.zeros((0, WINDOW + 1), np.int64)
    chosen = rows.filter(F.col("h") <= F.lit(least))
    if chosen.select("h").count() > 2 * size:  # ids that repeat share a hash
        chosen = chosen.orderBy("h").limit(2 * size)
    found = chosen.select("h", "text").mapInArrow(_sampled, "h long, k int, window binary").toArrow()
    found = found.sort_by([("h", "ascending"), ("k", "ascending"), ("window", "ascending")])
    return np.frombuffer(b"".join(w.as_py() for w in found["window"]), "<u2").reshape(-1, WINDOW + 1)


def trained_on_all(texts: DataFrame, tokens: int, model: Model) -> Model:
    """``model`` with weights trained on every subword of every training text (h, ids).

    Texts are dealt to shards by hash and ordered by it, so that weights do not follow the
    partitions of the input. A task reads its shard as one stream of texts and ends, cut into
    windows, and makes one pass from the weights of ``model``; weights are averaged by the
    subwords they saw. ``tokens`` is the number of training tokens.
    """
    shapes = {k: w.shape for k, w in model.weights.items()}
    start = replace(model, within=None, pairs=None, change=None, groups=None, other=None)

    def learned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shard, kept, size, number = TaskContext.get().partitionId(), [], 0, 0

        def passed() -> pa.RecordBatch:
            stream = np.concatenate([np.array([END], np.uint16), *kept])
            own = replace(start, weights={k: w.copy() for k, w in start.weights.items()})
            full = (len(stream) - 1) // WINDOW
            windows = np.lib.stride_tricks.sliding_window_view(stream, WINDOW + 1)[::WINDOW] if full else np.zeros((0, WINDOW + 1), np.uint16)
            order = np.random.default_rng([SEED, shard, number]).permutation(full)
            batches = [windows[order[a:a + BATCH]] for a in range(0, full, BATCH)]
            if len(stream) > full * WINDOW + 1:
                batches.append(stream[None, full * WINDOW:])
            own.learn(iter(batches), len(batches), SHARD_RATE)
            every = np.concatenate([own.weights[k].ravel() for k in shapes])
            blocks = [every[a:a + WEIGHTS].tobytes() for a in range(0, len(every), WEIGHTS)]
            return pa.RecordBatch.from_arrays([
                pa.array(range(len(blocks)), pa.int32()), pa.array([shard] * len(blocks), pa.int32()), pa.array([number] * len(blocks), pa.int32()),
                pa.array([len(stream) - 1] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())],
                names=["block", "shard", "number", "n", "weights"])

        for part in parts:
            for ids in part["ids"]:
                kept.append(np.frombuffer(ids.as_py(), "<u2"))
                size += len(kept[-1])
                if size >= SHARD_SUBWORDS:
                    yield passed()
                    kept, size, number = [], 0, number + 1
        if size:
            yield passed()

    def averaged(found: pa.Table) -> pa.Table:
        found = found.sort_by([("shard", "ascending"), ("number", "ascending")])
        n, total = found["n"].to_numpy(), 0.0
        for share, weights in zip(n / n.sum(), found["weights"], strict=True):
            total = total + share * np.frombuffer(weights.as_py(), np.float32)
        return pa.table([found["block"].slice(0, 1).cast(pa.int32()), pa.array([np.float32(total).tobytes()], pa.binary())], names=["block", "weights"])

    dealt = texts.select("h", "ids").repartition(tokens // SHARD_TOKENS + 1, "h").sortWithinPartitions("h", "ids").select("ids")
    found = dealt.mapInArrow(learned, "block int, shard int, number int, n long, weights binary").groupBy("block").applyInArrow(
        averaged, "block int, weights binary").toArrow().sort_by("block")
    if not found.num_rows:
        return model
    every = np.frombuffer(b"".join(w.as_py() for w in found["weights"]), np.float32)
    cuts = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
    return replace(model, weights={k: w.reshape(s) for (k, s), w in zip(shapes.items(), np.split(every, cuts), strict=True)})


@dataclass
class Unigram:
    """Word counts of all training texts: a stored table, totals, and the most frequent words (word, c); and the
    stored rows of ``_read``, whose ids the weights are trained on and all texts are scored by."""

    counts: DataFrame
    tokens: int
    distinct: int
    ends: int
    frequent: pa.Table
    read: DataFrame

    def log10(self, count):
        return np.log10((count + ADD) / (self.tokens + ADD * (self.distinct + 1)))


def unigram(docs: DataFrame, training: Column) -> Unigram:
    texts = docs.select(F.when(training, F.xxhash64(F.lit(SEED), "doc_id", "text")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    read = cut_lineage(texts.mapInArrow(_read, READ))
    # Every task has summed its words already, so they are dealt before they are summed again.
    counts = cut_lineage(read.filter("word IS NOT NULL").select("word", "n").repartition("word").groupBy("word").agg(F.sum("n").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = read.filter("h IS NOT NULL").count()
    frequent = most_frequent(counts.filter(F.length("word") <= WORD_BYTES), "c", DICTIONARY).toArrow()
    return Unigram(counts, total.n + ends, total.v + (ends > 0), ends, frequent, read)


def most_frequent(rows: DataFrame, count: str, room: int) -> DataFrame:
    """Rows from that order of magnitude of ``count`` on from which all of them fit in ``room`` rows."""
    order, least = F.floor(F.log2(count) * 4), None
    for r in sorted(rows.groupBy(order.alias("o")).count().collect(), key=lambda r: -r.o):
        if r["count"] > room:
            break
        room, least = room - r["count"], r.o
    return rows.filter(order >= least) if least is not None else rows.limit(0)


@dataclass
class Subcounts:
    """Counts of all subwords, the most frequent pairs (sorted) with theirs, and the table of all the
    other pairs (key, n), or None if there are no others; all pairs in words, and all from word to word."""

    alone: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    rest: DataFrame | None
    every: DataFrame
    across: DataFrame

    def totals(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all pairs by subword before and class; as many as the vocabulary allows at most."""
        def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                key = part["key"].to_numpy() - SIZE
                after, which = np.unique(key // SIZE * CLASSES + group[key % SIZE], return_inverse=True)
                n = np.bincount(which, part["n"].to_numpy(), minlength=len(after)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(after), pa.array(n)], names=["after", "n"])

        sums = self.every.mapInArrow(summed, "after long, n long").groupBy("after").agg(F.sum("n").alias("n")).toArrow()
        after, n = sums["after"].to_numpy(), sums["n"].to_numpy().astype(float)
        order = np.argsort(after)
        return after[order], n[order]

    def cells(self, row: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all neighbours, in words and from word to word, by ``neighbour_cells``; at most two columns of ``near`` to an embedding row."""
        def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, times = [], []

            def sums() -> pa.RecordBatch:
                cell, n = neighbour_cells(row, near, np.concatenate(keys), np.concatenate(times))
                return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

            for part in parts:
                keys.append(part["key"].to_numpy())
                times.append(part["n"].to_numpy())
                if sum(map(len, keys)) >= COUNTED:
                    yield sums()
                    keys, times = [], []
            if keys:
                yield sums()

        pairs = self.every.select(F.col("key") - SIZE, "n").union(self.across.select("key", "n")).toDF("key", "n")
        sums = pairs.mapInArrow(summed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        return sums["cell"].to_numpy(), sums["n"].to_numpy().astype(float)

    def added(self, model: Model) -> DataFrame:
        """(key, added): what a pair outside ``pairs`` adds to the log10 probability of a pair never seen."""
        within = model.within

        def valued(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                key = part["key"].to_numpy() - SIZE
                value = np.log10(1 + part["n"].to_numpy() / (DRAWS * 10.0 ** within[key % SIZE].astype(float)))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value)], names=["key", "added"])

        return self.rest.mapInArrow(valued, "key long, added double")


def subword_statistics(words: Unigram) -> Subcounts:
    found = cut_lineage(words.counts.mapInArrow(_subword_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    alone = found.filter(F.col("key") < SIZE).toArrow()  # a row per subword of the vocabulary at most
    counts = np.zeros(SIZE, np.int64)
    counts[alone["key"].to_numpy()] = alone["n"].to_numpy()
    counts[END] = words.ends
    every = found.filter(F.col("key") >= SIZE)
    kept = most_frequent(every, "n", PAIRS).orderBy("key").toArrow()
    times, rest = kept["n"].to_numpy(), None
    if every.count() > len(times):
        # Counts are kept by whole magnitudes, so the least one kept parts the table.
        rest = every.filter(F.col("n") < int(times.min())) if len(times) else every
    return Subcounts(counts, kept["key"].to_numpy() - SIZE, times.astype(float), rest, every, words.read.filter("key IS NOT NULL"))


SCORED = "uid long, doc_id long, held_out boolean, n_words long, n_found long, base double, score double, rest array<binary>, " \
    "pairs array<long>"


def scored(texts: DataFrame, held_out: Column, words: Unigram, model: Model, more: bool) -> DataFrame:
    """Score of every text (doc_id, ids); words outside the dictionary are left in ``rest``, and if there are
    ``more`` pairs than the model holds, those it lacks in ``pairs``, to be looked up by joins."""
    frequent = words.frequent["word"].combine_chunks().cast(pa.binary())
    base, begins = words.log10(words.frequent["c"].to_numpy()).astype(float), beginnings()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        uid = TaskContext.get().partitionId() << 33
        for part in parts:
            for first, n in pieces(part["ids"]):
                ids = Lists.read(part["ids"].slice(first, n))
                begin = np.flatnonzero(begins[ids.flat])  # of words, and of the end of each text
                found = Lists(ids.flat, begin, np.diff(begin, append=len(ids.flat))).written().dictionary_encode()
                distinct, numbers = Lists.read(found.dictionary), found.indices.to_numpy()
                at = pc.index_in(found.dictionary, value_set=frequent)
                own = np.full(len(distinct.size), np.nan)
                own[at.is_valid().to_numpy(zero_copy_only=False)] = base[at.drop_null().to_numpy()]
                own[distinct.flat[distinct.start] == END] = 0
                change, lacking = model.looked_up(distinct)
                start, value = np.searchsorted(begin, ids.start), own[numbers]
                size, rest = np.diff(start, append=len(begin)) - 1, np.isnan(value)
                n_rest = np.add.reduceat(rest.astype(np.int64), start)
                words_of_rest = found.dictionary.take(found.indices.filter(pa.array(rest)))
                scores = model.score_flat(ids.flat, ids.size)
                if more:
                    n_lacking = lacking.size[numbers]
                    absent, n_absent = lacking.take(numbers[n_lacking > 0]), np.add.reduceat(n_lacking, start)
                listed = lambda sizes, values: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(uid, uid + n)), part["doc_id"].slice(first, n), part["held_out"].slice(first, n),
                    pa.array(size, pa.int64()), pa.array(size - n_rest, pa.int64()),
                    pa.array(np.add.reduceat(np.where(rest, 0, value), start)),
                    pa.array(scores + np.add.reduceat(change[numbers], start)), listed(n_rest, words_of_rest),
                    listed(n_absent, pa.array(absent.flat)) if more else pa.nulls(n, pa.list_(pa.int64()))],
                    names=["uid", "doc_id", "held_out", "n_words", "n_found", "base", "score", "rest", "pairs"])
                uid += n

    return texts.select("doc_id", held_out.alias("held_out"), "ids").mapInArrow(batches, SCORED)


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): sizes, unigram score and model score.

    Learns from rows where ``held_out`` is false. A null text is empty and has its end
    only; every row is a document, also where ids repeat; other columns are not read.
    """
    words = unigram(docs, ~held_out)
    windows = sample(docs, ~held_out, max(SAMPLE_DOCS, words.ends // TEXTS_PER_SAMPLE))
    found = subword_statistics(words)
    more = found.rest is not None
    model = trained(windows, found.alone, found.pairs, found.times, STEPS, found.totals if more else None, found.cells)
    model = trained_on_all(words.read.filter("h IS NOT NULL"), words.tokens, model)
    rows = cut_lineage(scored(words.read.filter("ids IS NOT NULL"), F.col("h").isNull(), words, model, more))
    total = float(words.tokens + ADD * (words.distinct + 1))
    rare = rows.select("uid", F.explode("rest").alias("word")).join(words.counts, "word", "left")
    per_row = rare.groupBy("uid").agg(F.count("c").alias("known"), F.sum(
        F.log10((F.coalesce("c", F.lit(0)) + ADD) / total)).alias("rare"))
    end, score = float(words.log10(words.ends)), F.col("score")
    if more:
        lacking = rows.select("uid", F.explode("pairs").alias("key")).join(found.added(model), "key")
        per_row = per_row.join(lacking.groupBy("uid").agg(F.sum("added").alias("added")), "uid", "full")
        score += F.coalesce("added", F.lit(0.0))
    return rows.drop("rest", "pairs").join(per_row, "uid", "left").select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_found") + F.coalesce("known", F.lit(0)) + F.lit(int(words.ends > 0))).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0)) + end).alias("base_score"), score.alias("score"))


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of every document; a tenth of the documents is held out."""
    return score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)
