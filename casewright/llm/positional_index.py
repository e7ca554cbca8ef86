"""Benchmark decontamination with a distributed positional inverted index.

Documents are cut into segments of a bounded number of words. Each segment is a row
group of its own: one row per term with its sorted positions, and one row with the
documents. Nothing is shuffled to build it and no term gathers its postings of the
whole corpus in one place. A search walks the test items in blocks of a bounded size:
the block's terms are broadcast, the postings that are left go to their segment, and
there the offset-adjusted lists of every window are intersected, rarest term first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from casewright.llm.common import packed, table
from casewright.session import cut_lineage

#: Words of a segment; one document is never cut, so a longer one is a segment alone.
SEGMENT_WORDS = 2_000_000
#: Words of a block of test items: about 1 MB of ids and, at most, as many terms to broadcast.
BLOCK_WORDS = 200_000
WINDOW = 13
#: Free positions between documents, more than any slop.
GAP = 64
#: Candidates that are intersected at once.
CANDIDATES = 2_000_000
#: The row that holds a segment's documents; no term is empty.
DOCUMENTS = b""

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = T.StructType([
    T.StructField("segment", T.LongType()), T.StructField("term", T.BinaryType()),
    T.StructField("positions", T.ArrayType(T.IntegerType(), False)),
    T.StructField("docs", T.ArrayType(T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()),
        T.StructField("start", T.IntegerType()), T.StructField("n_words", T.LongType())])))])
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()),
                            ("n_words", pa.int64())]))
_INDEX_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("positions", pa.list_(pa.int32())),
                          ("docs", _DOCS)])


def words(text: str | None) -> list[bytes]:
    """Words of the contract: ASCII letters (folded), digits and everything outside ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Segment:
    """Words of some documents, as numbers in order of first appearance."""

    def __init__(self, number: int):
        self.number, self.terms, self.ids, self.docs, self.next = number, {}, [], [], 0
        self.size = 0

    def add(self, doc_id, text_hash, tokens: list[bytes]) -> None:
        terms = self.terms
        self.ids.append(np.fromiter((terms.setdefault(w, len(terms)) for w in tokens), np.int32, len(tokens)))
        start = self.docs[-1]["start"] + self.docs[-1]["n_words"] + GAP if self.docs else GAP
        self.docs.append({"doc_id": doc_id, "text_hash": text_hash, "start": start, "n_words": len(tokens)})
        self.size += len(tokens)

    def rows(self) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(self.ids)
        positions = np.concatenate([np.arange(d["start"], d["start"] + d["n_words"], dtype=np.int32) for d in self.docs])
        order = np.argsort(ids, kind="stable")
        ends = np.cumsum(np.bincount(ids, minlength=len(self.terms)))
        positions, terms = positions[order], list(self.terms)
        yield pa.RecordBatch.from_arrays([
            pa.array([self.number], pa.int64()), pa.array([DOCUMENTS], pa.binary()),
            pa.array([[]], pa.list_(pa.int32())), pa.array([self.docs], _DOCS)], schema=_INDEX_ARROW)
        step = 20_000
        for at in range(0, len(terms), step):
            upto = min(at + step, len(terms))
            first = ends[at - 1] if at else 0
            offsets = np.concatenate([[0], ends[at:upto] - first]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(upto - at, self.number)), pa.array(terms[at:upto], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions[first:ends[upto - 1]])),
                pa.nulls(upto - at, _DOCS)], schema=_INDEX_ARROW)


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Postings of every word of ``docs`` (doc_id, text), one row per segment and term.

    Null and empty texts are documents without words; every row is a document of its
    own, also where ids repeat. Other columns are not read.
    """
    def segments(batches):
        number = TaskContext.get().partitionId() << 24
        segment = _Segment(number)
        for batch in batches:
            for doc_id, text_hash, text in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"],
                                               strict=True):
                tokens = words(text.as_py())
                if segment.docs and segment.size + len(tokens) > segment_words:
                    yield from segment.rows()
                    number += 1
                    segment = _Segment(number)
                segment.add(doc_id, text_hash, tokens)
        if segment.docs:
            yield from segment.rows()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return read.mapInArrow(segments, INDEX)


@dataclass
class Block:
    """A bounded part of the test items: terms, and each piece as term numbers."""

    terms: list[bytes]
    pieces: list[tuple[str, np.ndarray]]  # item id, term numbers


def blocks(items: Iterator[tuple[object, str | None]], window: int = WINDOW, size: int = BLOCK_WORDS) -> Iterator[Block]:
    """Items (id, text) in blocks of at most ``size`` words. A longer item is cut into
    pieces that overlap by a window less one word, so every window is in one piece."""
    terms, pieces, used = {}, [], 0
    for item_id, text in items:
        tokens, name = words(text), "" if item_id is None else str(item_id)
        step = size - window + 1
        for at in range(0, max(1, len(tokens) - window + 1), step):
            piece = tokens[at:at + size]
            if not piece:
                continue
            if pieces and used + len(piece) > size:
                yield Block(list(terms), pieces)
                terms, pieces, used = {}, [], 0
            pieces.append((name, np.array([terms.setdefault(w, len(terms)) for w in piece], np.int32)))
            used += len(piece)
    if pieces:
        yield Block(list(terms), pieces)


def _windows(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct windows (short ones padded with -1), their lengths, and each one's items (numbers of pieces)."""
    rows, owners = [], []
    for k, (_, ids) in enumerate(block.pieces):
        if len(ids) < window:
            rows.append(np.pad(ids, (0, window - len(ids)), constant_values=-1)[None])
        else:
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
        owners.append(np.full(len(rows[-1]), k))
    distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    counts = np.bincount(which.ravel(), minlength=len(distinct))
    return distinct, (distinct >= 0).sum(1), np.split(np.concatenate(owners)[order], np.cumsum(counts)[:-1])


def intersect(windows: np.ndarray, postings: list[np.ndarray], slop: int
              ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, posting, exact): from ``start`` on, every term of the window has a
    posting within ``slop`` of its place; ``posting`` is one of them.

    Each window starts from the postings of its rarest term here, shifted by that
    term's place in the window; the other lists follow from rare to frequent.
    """
    counts = np.array([len(p) for p in postings])
    span = int(max((p[-1] for p in postings if len(p)), default=0)) + 4 * GAP
    keys = np.concatenate([p.astype(np.int64) + k * span for k, p in enumerate(postings)] or [np.zeros(0, np.int64)])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    of_window = np.where(windows >= 0, counts[windows], np.iinfo(np.int64).max)  # padding comes last
    alive = np.flatnonzero(of_window.min(1) > 0)
    order = np.argsort(of_window[alive], axis=1, kind="stable")
    rarest = windows[alive, order[:, 0]]
    load, moves = counts[rarest], np.arange(-slop, slop + 1)
    total = np.cumsum(load) * len(moves)
    begin = 0
    while begin < len(alive):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + CANDIDATES, "right")))
        rows = np.repeat(np.arange(begin, end), load[begin:end])
        within = np.arange(len(rows)) - np.repeat(np.cumsum(load[begin:end]) - load[begin:end], load[begin:end])
        posting = keys[first[rarest[rows]] + within] - rarest[rows].astype(np.int64) * span
        rows, posting, move = np.repeat(rows, len(moves)), np.repeat(posting, len(moves)), np.tile(moves, len(rows))
        start, exact = posting - order[rows, 0] + move, move == 0
        for j in range(1, windows.shape[1]):
            term = windows[alive[rows], order[rows, j]]
            used = np.flatnonzero(term >= 0)
            want = term[used].astype(np.int64) * span + start[used] + order[rows[used], j]
            near = np.minimum(np.searchsorted(keys, want - slop), len(keys) - 1)
            ok = np.ones(len(rows), bool)
            ok[used] = (keys[near] >= want - slop) & (keys[near] <= want + slop)
            if slop:
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                exact[used] &= keys[at] == want
            rows, start, posting, exact = rows[ok], start[ok], posting[ok], exact[ok]
        yield alive[rows], start, posting, exact
        begin = end


MATCHES = "segment long, doc int, item_id string, start int, end int, exact boolean"
_MATCHES_ARROW = pa.schema([("segment", pa.int64()), ("doc", pa.int32()), ("item_id", pa.string()),
                            ("start", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())])


def _search_segment(rows: pa.Table, block: Block, window: int, slop: int) -> pa.Table:
    """Matches of one block in one segment; windows of an item that overlap or touch become one span."""
    at = {term: k for k, term in enumerate(block.terms)}
    postings, docs, number = [np.zeros(0, np.int32)] * len(at), [], rows["segment"][0].as_py()
    for chunk in rows.to_batches():
        lists, offsets = chunk["positions"], chunk["positions"].offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        for k, term in enumerate(chunk["term"].to_pylist()):
            if term == DOCUMENTS:
                docs = chunk["docs"][k].as_py()
                starts = np.array([d["start"] for d in docs], np.int64)
            else:
                postings[at[term]] = values[offsets[k]:offsets[k + 1]]
    windows, sizes, owners = _windows(block, window)
    found = []
    for which, start, posting, exact in intersect(windows, postings, slop):
        times = np.array([len(owners[w]) for w in which], int)
        piece = np.concatenate([owners[w] for w in which]) if len(which) else np.zeros(0, int)
        start, posting, exact, which = (np.repeat(x, times) for x in (start, posting, exact, which))
        found.append(np.stack([piece, start, start + sizes[which], exact.astype(np.int64), posting]))
    piece, start, end, exact, posting = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    doc = np.searchsorted(starts, posting, "right") - 1
    lengths = np.array([d["n_words"] for d in docs], np.int64)
    start, end = np.maximum(start, starts[doc]), np.minimum(end, (starts + lengths)[doc])
    order = np.lexsort((start, exact, piece, doc))
    piece, start, end, exact, doc = (x[order] for x in (piece, start, end, exact, doc))
    fresh = np.ones(len(doc), bool)
    if len(doc):
        fresh[1:] = ((doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1]) | (exact[1:] != exact[:-1])
                     | (start[1:] > end[:-1]))
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(doc) - 1) if len(doc) else np.zeros(0, int)
    begin, shift = start[fresh], starts[doc[fresh]]
    return pa.table([
        pa.array(np.full(len(begin), number), pa.int64()), pa.array(doc[fresh], pa.int32()),
        pa.array([block.pieces[p][0] for p in piece[fresh]], pa.string()), pa.array(begin - shift, pa.int32()),
        pa.array(end[last] - shift, pa.int32()), pa.array(exact[fresh] > 0)], schema=_MATCHES_ARROW)


def _searcher(block: Block, window: int, slop: int):
    def searched(rows: pa.Table) -> pa.Table:
        return _search_segment(rows, block, window, slop)
    return searched


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Matches of ``items`` (item_id, text) in a stored index: segment, doc (number in the
    segment), item_id, start, end (words, end exclusive), exact (else within ``slop``).

    One pass over the index per block of items. Items without words match nothing; a
    null item id is the empty string; rows with one id are one item.
    """
    if slop >= GAP // 4:
        raise ValueError(f"slop must be under {GAP // 4}")
    spark = index.sparkSession
    rows = ((r.item_id, r.text) for r in items.select("item_id", "text").toLocalIterator())
    found = []
    for block in blocks(rows, window):
        terms = spark.createDataFrame([(bytearray(t),) for t in (DOCUMENTS, *block.terms)], "term binary")
        wanted = index.join(F.broadcast(terms), "term", "left_semi")  # at most BLOCK_WORDS terms
        found.append(cut_lineage(wanted.select("segment", "term", "positions", "docs").groupBy("segment").applyInArrow(
            _searcher(block, window, slop), MATCHES)))
    matches = spark.createDataFrame([], MATCHES)
    for part in found:
        matches = matches.union(part)
    return matches


def judge(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = index.filter(F.col("term") == F.lit(DOCUMENTS)).select("segment", F.posexplode("docs").alias("doc", "d"))
    by_start = Window.partitionBy("segment", "doc").orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = matches.filter("exact").withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(
        F.col("start"), F.coalesce(reached, F.col("start")))))
    hits = spans.groupBy("segment", "doc").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return docs.join(hits, ["segment", "doc"], "left").select(
        "d.doc_id", "d.text_hash", "d.n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("d.n_words"))).alias("contaminated"))


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Build the index of ``docs``, search ``items``, and judge every document."""
    index = cut_lineage(build_index(docs))
    return judge(index, search(index, items))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept. A row is known by id and text."""
    bad = decontamination(docs, items).filter("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = packed(docs, F.xxhash64("text").alias("h"), F.col("doc_id").alias("i"))
    return rows.join(bad.hint("shuffle_hash"), (F.col("h") == F.col("bad_hash")) & F.col("i").cast("long").eqNullSafe(
        F.col("bad_id")), "left_anti").select("row.*")


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items."""
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_SQL_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SQL_WORDS} AS ws FROM benchmark),
p AS (SELECT item, ws, least(len(ws), 13) AS size, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i
      FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM p),
g AS (SELECT n, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i
      FROM d, (SELECT DISTINCT size FROM w) WHERE len(ws) >= size),
h AS (SELECT n, item, i, g.size FROM g JOIN w ON w.size = g.size AND phrase = array_to_string(ws[i:i + g.size - 1], ' ')),
k AS (SELECT n, count(DISTINCT place) AS hit FROM (SELECT n, unnest(generate_series(i, i + size - 1)) AS place FROM h) GROUP BY n),
s AS (SELECT n, count(*) AS items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT n, item FROM h) GROUP BY n)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN k USING (n) LEFT JOIN s USING (n)
"""
