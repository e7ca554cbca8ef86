"""SimHash near-duplicates, found with fuzzy hashing by the binary Golay code.

The 23-bit Golay code is perfect: every word lies within three bits of one codeword,
whose 12 information bits are the word's index. The indices of a word and of its 23
neighbours are one or six numbers, and two words that differ in at most two bits share
one of them: the index of a word between them.

A fingerprint is cut into three segments. Two differing bits leave one segment alone
(pigeonhole), so equal bits there and a shared index of the next segment are a key that
every linked pair has in common: 3 to 18 keys per fingerprint, each 33 bits wide.
Pairs under a key are verified. Keys that many fingerprints share are not paired:
their fingerprints link through the words one bit around them, which is exact too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from casewright.llm.common import packed, table, words_of
from casewright.session import cut_lineage

SEED = 42
SHINGLE = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
#: A key of more fingerprints links them by neighbours (65 rows each) instead of by pairs.
PAIRED = 16
#: Shingles counted at once; 64 bytes each.
COUNTED = 65_536
#: Fixed value: the generator polynomial of the Golay code.
GENERATOR = 0b101011100011


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles, repeats included; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    spans = zip(starts, ends[size - 1:].tolist(), strict=False)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at:at + COUNTED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of ``docs``; other columns are not read.

    Null and empty texts and those without a word have fingerprint 0, a text of one or two
    words that of its whole sequence. Rows that repeat give equal rows; a null id stays null.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = [fingerprint(text.as_py()) for text in part["text"]]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_hash"], pa.array(fps, pa.int64())],
                                             names=["doc_id", "text_hash", "fp"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return read.mapInArrow(batches, "doc_id long, text_hash long, fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


def _errors() -> np.ndarray:
    """By remainder, the pattern of at most three bits that leaves it."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)])
    table_ = np.zeros(2048, np.int64)
    table_[_remainder(patterns)] = patterns
    return table_


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    return (words ^ _errors()[_remainder(words)]) >> 11


def indices(words: np.ndarray) -> np.ndarray:
    """Indices of each word and of its 23 neighbours, one row per word, sorted."""
    around = np.concatenate([[0], 1 << np.arange(23)])
    return np.sort(decode((words[:, None] ^ around).ravel()).reshape(len(words), 24), axis=1)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of fingerprints."""
    bits = fps.astype("<i8").view("<u8")
    parts = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, out = [], []
    for k, exact in enumerate(parts):
        several = indices(parts[(k + 1) % 3])
        fresh = np.ones(several.shape, bool)
        fresh[:, 1:] = several[:, 1:] != several[:, :-1]
        row, column = np.nonzero(fresh)
        rows.append(row)
        out.append(k << 40 | exact[row] << 12 | several[row, column])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        fps = part["fp"].to_numpy(zero_copy_only=False)
        row, key = keys(fps)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b), a < b, that connect exactly the distinct fingerprints ``fps`` (fp)
    that chains of pairs with at most two differing bits connect."""
    keyed = cut_lineage(fps.select("fp").mapInArrow(_keyed, "key long, fp long"))
    shared = keyed.groupBy("key").count().filter("count > 1")
    members = cut_lineage(keyed.join(shared, "key"))
    few, many = members.filter(F.col("count") <= paired), members.filter(F.col("count") > paired)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter(
        (F.col("a") < F.col("b")) & near).select("a", "b")
    around = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(np.int64(np.uint64(1) << np.uint64(b)).item()))
                                              for b in range(64))))
    hubs = many.select("fp").distinct().select("fp", around.alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = hubs.join(least, "hub").filter(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component, for every node of ``edges`` but the roots.

    Large and small stars in turn, until nothing changes. Each step groups edges by a
    node's minimum, which combines before the shuffle, and joins it back; each step is
    written to the shared folder, so nothing is ever recomputed from the start.
    """
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut_lineage(both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        linked = large.join(least, "b")
        small = linked.select(F.col("m").alias("a"), "b").union(
            linked.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = cut_lineage(small.distinct())
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprint rows, and (fp, component_id, keeper) of every distinct fingerprint.

    component_id is the least id reachable (null where all ids of the component are);
    keeper is the row to keep: least id (nulls last), then text. Equal rows are alike.
    """
    rows = cut_lineage(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), first.alias("first")))
    roots = components(links(nodes))
    labelled = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", "first", F.coalesce("root", "fp").alias("root"))
    groups = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("keeper"))
    return rows, labelled.select("fp", "root").join(groups, "root").select("fp", "component_id", "keeper")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns kept."""
    rows, groups = near_duplicates(docs)
    keeper = groups.select(F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.text_hash").alias("keep_hash"))
    times = rows.groupBy("doc_id", "text_hash").count()
    keeper = cut_lineage(keeper.join(times, F.col("keep_id").eqNullSafe(F.col("doc_id")) & (
        F.col("keep_hash") == F.col("text_hash"))).select("keep_id", "keep_hash", "count"))
    all_rows = packed(docs, F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("i"))

    def kept(which: DataFrame) -> DataFrame:  # both uses read one shuffle of the rows
        return all_rows.join(which.hint("shuffle_hash"), F.col("i").eqNullSafe(F.col("keep_id")) & (
            F.col("h") == F.col("keep_hash")), "left_semi")

    once, repeated = keeper.filter("count = 1"), keeper.filter("count > 1")
    return kept(once).select("row.*").union(kept(repeated).dropDuplicates(["i", "h"]).select("row.*"))


def op5_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows, groups = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                          "component_id")
