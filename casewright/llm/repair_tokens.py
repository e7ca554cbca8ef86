"""Token ids in Re-Pair compressed shards with random access.

Documents are put in id order by a range shuffle and every task writes shards of about
``SHARD_TOKENS`` ids. In a shard, the most frequent pairs of neighbouring symbols are
replaced by nonterminals, again and again, until no pair is frequent or the numbers of
16 bits are used up. A shard keeps its rules, the length of every rule's expansion and
where each document begins, so that one document, or a part of one, is decoded alone.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Timer

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casewright.llm.common import table
from casewright.session import cut_lineage

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SHARD_TOKENS = 2_000_000
#: Symbols have 16 bits: ids of the tokenizer first, nonterminals after them.
SYMBOLS = 65_536
#: A pair must be this frequent to become a rule, and so many become rules at once.
FREQUENT = 16
AT_ONCE = 2048
#: Expansions up to this length are looked up; longer rules are first replaced by their parts.
FLAT = 64
#: Distinct words that a worker keeps the ids of (about 100 MB); later ones are encoded where they are met.
#: Marks after a word are kept apart from it, so that it is there once, whatever follows it.
REMEMBERED = 500_000
#: Runs of marks that are kept beside them.
MARKS = 10_000
#: After so long without a task of this kind they are forgotten.
IDLE_SECONDS = 5.0
#: Bytes of text whose new units are encoded together.
TOGETHER = 4_000_000
MAGIC = 0x31475052
#: Key of a line feed between two lines; no unit looks like it.
LINE_FEED = "  "

SHARDS = "part int, number int, n_tokens long, doc_ids array<long>, shard binary"
_SHARDS_ARROW = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_tokens", pa.int64()),
                           ("doc_ids", pa.list_(pa.int64())), ("shard", pa.binary())])


class Encoder:
    """Ids of the tokenizer, remembered per unit of text.

    The tokenizer's pattern begins a new piece at every space that follows a visible
    character or is followed by one, so the text between such spaces (each with the
    space before it) can be encoded alone. Texts with a space that is neither are
    given to the tokenizer whole.
    """

    SIMPLE = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@[-`{-~]*)")
    LINES = re.compile(r"\n(?:\s|\Z|(?<=\s\n))|\A\n")
    WHOLE = re.compile(r" (?<=\s )(?:\s|\Z)")

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        import public_tokenizers
        from tokenizers import Tokenizer

        at = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(at)
        self.terminals = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.terminals + AT_ONCE > SYMBOLS:
            raise ValueError("the vocabulary leaves no numbers of 16 bits for nonterminals")
        self.merge = self.tokenizer.model.tokenize
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.known = {LINE_FEED: self._alone(["\n"])[0]}
        self.marks: dict[str, bytes] = {}
        # How the tokenizer writes the bytes of a letter.
        letters = [chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7)]
        self.written = str.maketrans({c: "".join(self.tokenizer.encode(c, add_special_tokens=False).tokens) for c in letters})
        self.space = space

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units that are not remembered. A word of Latin letters, with ASCII marks after
        it or without, is one or two pieces of the pattern: its merges can be asked for directly,
        and the word is remembered alone. A key that begins with a space is a line's first unit,
        which has none before it."""
        done: dict[str, bytes] = {}
        simple, space, merge, known, marks = self.SIMPLE.fullmatch, self.space, self.merge, self.known, self.marks
        met: dict[str, bytes] = {}
        rest = []
        for unit in units:
            if not (m := simple(unit)):
                rest.append(unit)
                continue
            word, mark = m.groups()
            ids = known.get(word) or met.get(word)
            if ids is None:
                written = word if word.isascii() else word.translate(self.written)
                written = written[1:] if word[0] == " " else space + written
                ids = met[word] = array("H", [t.id for t in merge(written)]).tobytes()
            if mark:
                if mark not in marks:
                    if len(marks) > MARKS:
                        marks.clear()
                    marks[mark] = array("H", [t.id for t in merge(mark)]).tobytes()
                ids += marks[mark]
            done[unit] = ids
        met.update(zip(rest, self._alone([u[1:] if u.startswith(" ") else " " + u for u in rest]), strict=True))
        if len(known) < REMEMBERED:  # the first words met hold the frequent ones
            known.update(met)
        done.update(met)
        return done

    def forget(self) -> None:
        self.known = {LINE_FEED: self.known[LINE_FEED]}

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text, and the end id. The units of all texts are numbered by Arrow, so that each
        is asked for once, and ids are copied by these numbers."""
        if not len(texts):
            return []
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        end, lists = np.array([END_ID], "<u2").tobytes(), pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        units, codes = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy().astype(np.int64)
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        suspect = np.flatnonzero(np.logical_or.reduceat(self._bare(units)[codes], start)).tolist()
        if whole := [k for k in suspect if self.WHOLE.search(texts[k].as_py())]:
            alone = dict(zip(whole, self._alone([texts[k].as_py() for k in whole]), strict=True))
            others = iter(self.encode(texts.take(pa.array([k for k in range(len(texts)) if k not in alone], pa.int64()))))
            return [np.frombuffer(alone[k] + end, "<u2") if k in alone else next(others) for k in range(len(texts))]
        ids = self._ids([*units, *(" " + units[k] for k in codes[start].tolist())])
        codes[start] = len(units) + np.arange(len(texts))  # a text's first unit has no space before it
        numbers = np.insert(codes, start + size, len(ids))  # the end after each text
        ids.append(end)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        every, begin, of_unit = np.frombuffer(b"".join(ids), "<u2"), np.cumsum(length) - length, length[numbers]
        upto = np.cumsum(of_unit)
        coded = every[np.repeat(begin[numbers] - upto + of_unit, of_unit) + np.arange(int(upto[-1]))]
        return np.split(coded, upto[np.cumsum(size + 1) - 1][:-1])

    @staticmethod
    def _bare(units: list[str]) -> np.ndarray:
        """By unit: whether it is empty or has white space at an end; only a space beside such a unit may not begin a piece."""
        out = np.zeros(len(units), bool)
        out[[k for k, u in enumerate(units) if not u or not u.isprintable() and (u[0].isspace() or u[-1].isspace())]] = True
        return out

    def _ids(self, keys: list[str]) -> list[bytes]:
        """Ids of each of ``keys``. A line feed with visible characters on both sides is a piece alone, so units
        are taken apart there."""
        known = self.known
        ids, apart, new = list(map(known.get, keys)), {}, set()
        lacking = [k for k, i in enumerate(ids) if i is None]
        for k in lacking:
            key = keys[k]
            if "\n" in key and not self.LINES.search(key):
                first, *rest = key.split("\n")
                apart[k] = [first, *(part for line in rest for part in (LINE_FEED, " " + line))]
                new.update(part for part in apart[k] if part not in known)
            else:
                new.add(key)
        met = self._units(new)
        for k in lacking:
            ids[k] = b"".join([known.get(part) or met[part] for part in apart[k]]) if k in apart else met[keys[k]]
        return ids


_ENCODERS: dict[str, Encoder] = {}
_TIMERS: dict[str, Timer] = {}


@contextmanager
def encoder_of(vocabulary: str) -> Iterator[Encoder]:
    """One per worker process: the tasks that follow each other share what it remembers.
    A worker that does other work for a while gives that memory back."""
    if vocabulary in _TIMERS:
        _TIMERS.pop(vocabulary).cancel()
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    encoder = _ENCODERS[vocabulary]
    try:
        yield encoder
    finally:
        _TIMERS[vocabulary] = timer = Timer(IDLE_SECONDS, encoder.forget)
        timer.daemon = True
        timer.start()


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, rules): Re-Pair of ``ids``; ``ends`` marks the last id of each
    document, which joins no pair. Rule k expands symbol terminals + k to its two parts."""
    symbols, ends, rules = ids.astype(np.uint32), ends.copy(), np.zeros((0, 2), np.uint32)
    while terminals + len(rules) < SYMBOLS:
        keys = symbols[:-1] << 16 | symbols[1:]
        free = ~(ends[:-1] | ends[1:])
        # In sorted keys, a frequent pair is met again FREQUENT - 1 places on; the others need no counting.
        in_order = np.sort(keys[free])
        again = in_order[:max(0, len(in_order) - FREQUENT + 1)]
        again = again[again == in_order[FREQUENT - 1:]]
        if not len(again):
            break
        first = np.flatnonzero(np.concatenate([[True], again[1:] != again[:-1]]))
        pairs, counts = again[first], np.diff(first, append=len(again)) + FREQUENT - 1
        best = np.argsort(-counts, kind="stable")[:min(AT_ONCE, SYMBOLS - terminals - len(rules))]
        # Slots by hash; of two pairs in one slot the more frequent is kept, the other waits for the next round.
        slots = np.full(1 << 18, -1, np.int16)
        slot = (pairs[best] * np.uint32(2654435761)) >> np.uint32(14)
        slots[slot[::-1]] = np.arange(len(best), dtype=np.int16)[::-1]
        chosen = np.unique(slots[slot])
        number = np.full(len(best) + 1, 0, np.int32)
        number[chosen] = np.arange(len(chosen))
        at = slots[(keys * np.uint32(2654435761)) >> np.uint32(14)]
        place = np.flatnonzero(free & (at >= 0))
        place = place[pairs[best[at[place]]] == keys[place]]
        order = np.arange(len(place))
        run = np.maximum.accumulate(np.where(np.diff(place, prepend=-2) != 1, order, 0))
        place = place[(order - run) % 2 == 0]  # of pairs that overlap, every second one
        symbols[place] = terminals + len(rules) + number[at[place]]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, ends = symbols[keep], ends[keep]
        made = pairs[best[chosen]]
        rules = np.concatenate([rules, np.stack([made >> 16, made & 0xFFFF], axis=1)])
    return symbols.astype("<u2"), ends, rules.astype("<u2")


def pack(documents: list[np.ndarray], terminals: int) -> bytes:
    """A shard: header, rules, lengths of expansions, first symbol of each document, symbols."""
    sizes = np.array([len(d) for d in documents])
    ends = np.zeros(int(sizes.sum()), bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, ends, rules = compress(np.concatenate(documents), ends, terminals)
    lengths = np.ones(terminals + len(rules), "<u4")
    for k, (left, right) in enumerate(rules.tolist()):
        lengths[terminals + k] = lengths[left] + lengths[right]
    first = np.concatenate([[0], np.flatnonzero(ends) + 1]).astype("<u4")
    header = np.array([MAGIC, terminals, len(rules), len(documents), len(symbols)], "<u4")
    return b"".join(x.tobytes() for x in (header, rules, lengths[terminals:], first, symbols))


class Shard:
    """Random access to the documents of a packed shard."""

    def __init__(self, data: bytes):
        magic, self.terminals, n_rules, self.n_docs, n_symbols = np.frombuffer(data, "<u4", 5).tolist()
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = 20
        self.rules = np.frombuffer(data, "<u2", 2 * n_rules, at).reshape(-1, 2)
        at += self.rules.nbytes
        own = np.frombuffer(data, "<u4", n_rules, at)
        at += own.nbytes
        self.first = np.frombuffer(data, "<u4", self.n_docs + 1, at)
        self.symbols = np.frombuffer(data, "<u2", n_symbols, at + self.first.nbytes)
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), own.astype(np.int64)])
        short = self.terminals + np.flatnonzero(own <= FLAT)
        self.flat_at = np.arange(self.terminals + n_rules)
        self.flat_at[short] = self.terminals + np.concatenate([[0], np.cumsum(self.lengths[short])[:-1]]) if len(short) else []
        self.flat = np.concatenate([np.arange(self.terminals, dtype="<u2"), self._unroll(short.astype("<u2"), 1)])

    def _unroll(self, symbols: np.ndarray, longest: int) -> np.ndarray:
        """``symbols`` with every one of a longer expansion replaced by its parts."""
        while (long := self.lengths[symbols] > longest).any():
            times = 1 + long
            out = np.repeat(symbols, times)
            at = (np.cumsum(times) - times)[long]
            parts = self.rules[symbols[long].astype(np.int64) - self.terminals]
            out[at], out[at + 1] = parts[:, 0], parts[:, 1]
            symbols = out
        return symbols

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = self._unroll(symbols, FLAT)
        sizes = self.lengths[symbols]
        begin = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.flat_at[symbols] - begin, sizes) + np.arange(int(sizes.sum()))]

    def documents(self) -> list[np.ndarray]:
        ids = self._expand(self.symbols)
        upto = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])[self.first[1:-1]]
        return np.split(ids, upto)

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.first[k]:self.first[k + 1]])

    def span(self, k: int, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of document ``k``; only symbols that reach into the span are expanded."""
        symbols = self.symbols[self.first[k]:self.first[k + 1]]
        upto = np.cumsum(self.lengths[symbols])
        a, b = np.searchsorted(upto, [start, end - 1], "right")
        before = int(upto[a - 1]) if a else 0
        return self._expand(symbols[a:b + 1])[start - before:end - before]


def write_shards(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards of ``docs`` (doc_id, text) in id order, null ids first: part, number, n_tokens, doc_ids, shard.

    Null texts are empty; every row is a document, also where ids repeat (then in the
    order of a hash of the text, so that equal ids spread). Other columns are not read.
    """
    def packed_parts(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, documents, tokens, number = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([tokens]),
                pa.array([ids], pa.list_(pa.int64())), pa.array([pack(documents, encoder.terminals)])], schema=_SHARDS_ARROW)

        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), batch["text"]
            piece = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(names)]
            for at, after in zip(cuts, cuts[1:], strict=False):
                for name, coded in zip(names[at:after], encoder.encode(texts.slice(at, after - at)), strict=True):
                    ids.append(name)
                    documents.append(coded)
                    tokens += len(coded)
                    if tokens >= shard_tokens:
                        yield shard()
                        ids, documents, tokens, number = [], [], 0, number + 1
        if documents:
            yield shard()

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder_of(vocabulary) as encoder:
            yield from packed_parts(batches, encoder)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return ordered.mapInArrow(pack_part, SHARDS)


def starts(shards: DataFrame) -> DataFrame:
    """(part, number, before): ids of all shards before each; totals of tasks first, then within a task."""
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_part.select("part", F.coalesce(F.sum("all").over(by_part), F.lit(0)).alias("earlier"))
    own = shards.select("part", "number", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("own"))
    return own.join(earlier, "part").select("part", "number", (F.col("earlier") + F.col("own")).alias("before"))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from stored shards."""
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, sizes, sums = Shard(batch["shard"][row].as_py()), [], []
                for ids in shard.documents():
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4")))
                n = shard.n_docs
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch["part"][row].as_py()), pa.int32()),
                    pa.array(np.full(n, batch["number"][row].as_py()), pa.int32()), batch["doc_ids"][row].values,
                    pa.array(np.cumsum([0, *sizes[:-1]]), pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    names=["part", "number", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "number", "doc_ids", "shard").mapInArrow(
        decoded, "part int, number int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts(shards), ["part", "number"]).select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and decode every document from them."""
    return read_shards(cut_lineage(write_shards(docs)))


def op9_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of the ids of every document."""
    return written_and_read(table(spark, sf_dir, "documents"))
