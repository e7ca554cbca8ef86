"""A retrieval index that takes changes without being built again.

The index is a folder of segments that are written once and never altered. A change
writes one segment: the rows of new or changed documents, marks of the sources whose
earlier rows no longer count, and what it adds to the corpus figures, which for removed
rows is negative. Only new text is tokenised; figures of removed rows are counted from
the words they were stored with. Term figures are the sum over segments, so reading them
never touches a text.

A segment is live once its number stands in ``commits``, which is written last: a job that
dies half-way leaves a folder that no one reads. Segments of similar size are merged, so
their number grows with the logarithm of the rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casewright.operators import retrieval

#: Segments of one size class that are merged into one; the next class is so much larger.
FAN_IN = 4

_ROWS = ("chunk_id", "source", "text", "words", "n_words", "norm")
_COMMIT = "segment string, change long, replaces array<string>, row_count long, mark_count long"


class SegmentedIndex:
    """An index in ``folder``, which is made if it is not there.

    Documents are (source, text): a source names a document, and a change replaces all
    earlier rows of its sources. One writer at a time; readers see the commits that stand
    when they ask.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], _COMMIT).write.parquet(f"{folder}/commits")

    # --- what is there ---

    def commits(self) -> list:
        """One entry per live segment, oldest change first: a small list, as merging keeps it."""
        found = self.spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits").collect()
        gone = {name for row in found for name in row.replaces}
        return sorted((row for row in found if row.segment not in gone), key=lambda row: (row.change, row.segment))

    def _all(self, table: str, segments: list, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{row.segment}/{table}" for row in segments]
        return self.spark.read.schema(schema).parquet(*paths) if paths else empty

    def _stored(self, segments: list) -> DataFrame:
        return self._all("rows", segments, "change long, chunk_id string, source string, text string, words array<string>, n_words int, norm double")

    def _marks(self, segments: list) -> DataFrame:
        return self._all("marks", segments, "source string, before long")

    @staticmethod
    def _unmarked(rows: DataFrame, marks: DataFrame) -> DataFrame:
        """Rows that no later change has removed or replaced."""
        latest = marks.groupBy("source").agg(F.max("before").alias("before"))
        return rows.join(latest, "source", "left").filter("before IS NULL OR change >= before").drop("before")

    def live(self) -> DataFrame:
        """The rows that count, as ``retrieval`` takes them."""
        segments = self.commits()
        return self._unmarked(self._stored(segments), self._marks(segments)).select(*_ROWS)

    def term_statistics(self) -> DataFrame:
        """(term, chunk_count, term_count) over live rows, from stored figures alone."""
        figures = self._all("figures", self.commits(), "term string, chunk_count long, term_count long")
        return (
            figures.filter("term IS NOT NULL").groupBy("term")
            .agg(F.sum("chunk_count").alias("chunk_count"), F.sum("term_count").alias("term_count"))
            .filter("chunk_count > 0"))

    def sizes(self) -> DataFrame:
        """(chunk_count, term_count) of all live rows, in one row."""
        figures = self._all("figures", self.commits(), "term string, chunk_count long, term_count long")
        whole = figures.filter("term IS NULL")
        return whole.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunk_count", "term_count")))

    # --- changes ---

    def change(self, documents: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Put ``documents`` (source, text) in the place of earlier documents of these
        sources, and take away the sources ``removed`` (source).

        A source that occurs in both is replaced. A document without any words or with a
        null text leaves no rows, so it only removes. Rows of one source in one change all
        count. Rows without a source can never be removed again.
        """
        segments = self.commits()
        number = max((row.change for row in segments), default=0) + 1
        name = f"segment-{number}-{uuid.uuid4().hex}"
        at = f"{self.folder}/{name}"
        sources = [part.select(F.col("source").cast("string").alias("source")) for part in (documents, removed) if part is not None]
        if not sources:
            return
        marks = reduce(DataFrame.union, sources).filter("source IS NOT NULL").distinct()
        marks.select("source", F.lit(number).cast("long").alias("before")).write.parquet(f"{at}/marks")

        rows = self._stored([])
        if documents is not None:
            chunks = retrieval.chunk_documents(documents.select(F.col("source").cast("string").alias("source"), "text"))
            rows = retrieval.with_norm(retrieval.index_rows(chunks)).select(F.lit(number).cast("long").alias("change"), *_ROWS)
        rows.write.parquet(f"{at}/rows")

        written = self.spark.read.parquet(f"{at}/marks").select("source")
        before = self._unmarked(self._stored(segments), self._marks(segments))
        taken = before.join(written, "source", "left_semi")
        added = self.spark.read.parquet(f"{at}/rows")
        self._figures(added, 1).unionByName(self._figures(taken, -1)).groupBy("term").agg(
            *(F.sum(c).alias(c) for c in ("chunk_count", "term_count"))).write.parquet(f"{at}/figures")
        self._commit(name, number, [])
        self.merge()

    @staticmethod
    def _figures(rows: DataFrame, sign: int) -> DataFrame:
        """Counts per term, and one row without a term for all."""
        per_term = retrieval.term_statistics(rows)
        whole = rows.agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("term_count"))
        both = per_term.unionByName(whole.withColumn("term", F.lit(None).cast("string")))
        return both.select("term", *((sign * F.col(c)).cast("long").alias(c) for c in ("chunk_count", "term_count")))

    def _commit(self, name: str, number: int, replaces: list[str]) -> None:
        count = lambda table: self.spark.read.parquet(f"{self.folder}/{name}/{table}").count()
        row = [(name, number, replaces, count("rows"), count("marks"))]
        self.spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def merge(self, fan_in: int = FAN_IN) -> None:
        """Merge segments of a size class while ``fan_in`` of them are there.

        Rows keep the number of the change they came with, so any segments can be merged.
        A removed row leaves at the first merge; a mark stays while another segment may
        hold a row it removes.
        """
        while True:
            segments = self.commits()
            classes = defaultdict(list)
            for row in segments:
                classes[_size_class(row.row_count + row.mark_count, fan_in)].append(row)
            full = [some for _, some in sorted(classes.items()) if len(some) >= fan_in]
            if not full:
                return
            some, number = full[0], max(row.change for row in full[0])
            name = f"merged-{number}-{uuid.uuid4().hex}"
            at = f"{self.folder}/{name}"
            self._unmarked(self._stored(some), self._marks(segments)).select("change", *_ROWS).write.parquet(f"{at}/rows")
            marks = self._marks(some).groupBy("source").agg(F.max("before").alias("before"))
            others = self._stored([row for row in segments if row not in some]).select("source", "change")
            older = others.groupBy("source").agg(F.min("change").alias("change"))
            marks.join(older, "source").filter("change < before").select("source", "before").write.parquet(f"{at}/marks")
            figures = self._all("figures", some, "term string, chunk_count long, term_count long")
            figures.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("chunk_count", "term_count"))).filter(
                "chunk_count <> 0 OR term_count <> 0").write.parquet(f"{at}/figures")
            self._commit(name, number, [row.segment for row in some])


def _size_class(rows: int, fan_in: int) -> int:
    size = 0
    while rows >= fan_in:
        rows //= fan_in
        size += 1
    return size
