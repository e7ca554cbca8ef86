"""How far each source's wording lies from the other sources of its language.

Terms that occur in few documents of a language are left out. Every (language, source)
group gives each kept term a share, which depends on nothing but the term's count there,
its *level*, and on the group's totals. So two groups are compared by their joint table:
how many terms have level a in the one and level b in the other.

All joint tables come from one product. In a block of terms, X holds an indicator column
for every (group, level) that occurs and a row for every term; the product of X's
transpose and X counts the terms of every pair of columns. Blocks are small, so that the
product is exact in single precision, and terms of similar frequency share a block, so
that few levels occur in it. A block's tables are priced where they are made, cell by cell
in whole numbers, and only the prices are added up.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casewright.llm.common import table
from casewright.session import cut_lineage

#: A term is kept if so many documents of its language hold it.
LEAST_DOCS = 3
#: Ranks of the part ``term``.
TOP = 200
SHARES = 1_000_000_000
#: Terms per block and groups per side of a block, on average; terms per product.
BLOCK_TERMS = 1024
SIDE_GROUPS = 32
PRODUCT_TERMS = 64
#: Counts that a task holds before it hands them on.
HELD = 200_000

# Whatever is no term character becomes a space; A-Z become small letters.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()),
                     ("n_docs", pa.int64())])
_VALUES = "lang string, source string, part string, item string, value long"
_VALUES_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()),
                           ("value", pa.int64())])


def _counted(batches):
    """Counts of a task's documents by group and term, handed on whenever many are held.
    A row without a term stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def held():
        for (lang, source), (n, n_docs) in groups.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *(n_docs[t] for t in n)], pa.int64())], schema=_COUNTS)
        groups.clear()

    size = 0
    for batch in batches:
        langs, sources = batch["lang"].to_pylist(), batch["source"].to_pylist()
        for lang, source, text in zip(langs, sources, batch["text"].cast(pa.binary()), strict=True):
            n, n_docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            words = text.as_py().translate(_TERMS).split()
            n.update(words)
            n_docs.update(set(words))
            size += len(n) - before
            if size >= HELD:
                yield from held()
                size = 0
    yield from held()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences and documents of every term of every
    group, and one row with a null term for every group."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*text).mapInArrow(_counted, "lang string, source string, term binary, n long, n_docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, source, n, total, magnitude, lead): counts of the terms that enough of
    a language's documents hold. ``total`` is the language's count, ``magnitude`` its
    number of binary digits, and ``lead`` marks one row per term of a language."""
    term = Window.partitionBy("lang", "term")
    whole = counts.filter(F.col("term").isNotNull()).select(
        "lang", "term", "source", "n", F.sum("n").over(term).alias("total"), F.sum("n_docs").over(term).alias("n_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("lead"))
    return whole.filter(F.col("n_docs") >= least_docs).drop("n_docs").withColumn(
        "magnitude", F.length(F.bin("total")))


def _parts(size: Column, each: int) -> Column:
    return F.greatest(F.ceil(size / each), F.lit(1))


def _part_of(value: Column, parts: str) -> Column:
    return F.pmod(F.xxhash64(value), F.col(parts))


def share(counts: np.ndarray, n: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (n + terms)), by long division in three steps of a
    thousand, so that nothing exceeds a long."""
    whole = np.asarray(n, np.int64) + terms
    result, rest = np.divmod(np.asarray(counts, np.int64) + 1, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        result = result * 1000 + more
    return 1 + result


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def joint_tables(levels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ``levels`` (terms x groups): the group and the level of every indicator column,
    the column of every entry, and the number of terms that each two columns share.

    A row of weight w stands for w terms of the same levels.
    """
    n_groups = levels.shape[1]
    keys, column = np.unique(levels * n_groups + np.arange(n_groups), return_inverse=True)
    column = column.reshape(levels.shape)
    x = np.zeros((len(levels), len(keys)), np.float32)
    np.put_along_axis(x, column, 1, axis=1)
    return keys % n_groups, keys // n_groups, column, (x * weights[:, None].astype(np.float32)).T @ x


def priced(counts: np.ndarray, totals: np.ndarray, unused: int, sizes: np.ndarray, total_size: int, terms: int):
    """Prices of one block: summed over its terms for every ordered pair of groups, and
    for every term and group against the language (-1 where its share is not above).

    ``counts`` is terms x groups, ``totals`` the language's counts; ``unused`` terms of the
    block occur in none of the groups. ``sizes`` and ``total_size`` are sums of counts over
    all kept terms, of which there are ``terms``.
    """
    n_groups = len(sizes)
    pairs = np.zeros((n_groups, n_groups), np.int64)
    against = np.full(counts.shape, -1, np.int64)
    order = np.argsort(totals, kind="stable")
    n = np.append(sizes, total_size)
    levels = np.column_stack([counts, totals])[order]
    weights = np.ones(len(levels), np.int64)
    if unused:  # the language's level of these rows is never asked for
        levels, weights = np.vstack([np.zeros_like(levels, shape=(1, n_groups + 1)), levels]), np.append(unused, weights)
        order = np.append(-1, order)
    for at in range(0, len(levels), PRODUCT_TERMS):
        some = levels[at:at + PRODUCT_TERMS]
        group, level, column, shared = joint_tables(some, weights[at:at + PRODUCT_TERMS])
        p = share(level, n[group], terms)
        i, j = np.nonzero(shared)
        worth = price(p[i], p[j])
        of_groups = (group[i] < n_groups) & (group[j] < n_groups)
        np.add.at(pairs, (group[i][of_groups], group[j][of_groups]),
                  shared[i, j].astype(np.int64)[of_groups] * worth[of_groups])
        # Cells of a group and the language: what each of their terms is worth.
        above = (group[i] < n_groups) & (level[i] > 0) & (group[j] == n_groups) & (p[i] > p[j])
        cell = np.full((len(p), len(p)), -1, np.int64)
        cell[i[above], j[above]] = worth[above]
        rows = order[at:at + PRODUCT_TERMS]
        real = rows >= 0
        against[rows[real]] = cell[column[real, :-1], column[real, -1:]]
    return pairs, against


def _block(top: int):
    def values(key, cells: pa.Table, tasks: pa.Table) -> pa.Table:
        if not tasks.num_rows:  # no source fell into the other side
            return _VALUES_ARROW.empty_table()
        task = tasks.to_pylist()[0]
        left = [(g["source"], g["n"]) for g in task["left"]]
        right = [] if task["side"] == task["other"] else [(g["source"], g["n"]) for g in task["right"]]
        sources = [source for source, _ in left + right]
        number = {source: i for i, source in enumerate(sources)}
        terms = sorted(set(cells["term"].to_pylist()), key=lambda t: t.encode())
        place = {term: i for i, term in enumerate(terms)}
        rows = np.array([place[t] for t in cells["term"].to_pylist()], np.int64)
        columns = np.array([number[s] for s in cells["source"].to_pylist()], np.int64)
        counts, totals = np.zeros((len(terms), len(sources)), np.int64), np.zeros(len(terms), np.int64)
        counts[rows, columns], totals[rows] = cells["n"].to_numpy(), cells["total"].to_numpy()
        if not task["n_terms"]:
            pairs, against = np.zeros((len(sources), len(sources)), np.int64), counts
        else:
            pairs, against = priced(counts, totals, task["n_block"] - len(terms), np.array([n for _, n in left + right], np.int64),
                                    task["size"], task["n_terms"])
        out = []
        for i, source in enumerate(sources):
            for j, item in enumerate(sources):
                if i != j and (not right or (i < len(left)) != (j < len(left))):
                    out.append((task["lang"], source, "pair", item, int(pairs[i, j])))
            if not right:
                found = np.nonzero(against[:, i] >= 0)[0] if len(terms) else []
                # Rows are in the order of their bytes, which the stable sort keeps.
                best = sorted(found, key=lambda t: -against[t, i])[:top]
                out += [(task["lang"], source, "term", terms[t], int(against[t, i])) for t in best]
        columns = list(zip(*out, strict=True)) or [[] for _ in _VALUES_ARROW]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _VALUES_ARROW, strict=True)], schema=_VALUES_ARROW)
    return values


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for every group, how far each other source of
    its language lies from it (part ``pair``), and the terms that it uses more than the
    language does (part ``term``, ``top`` ranks).

    Null text, lang and source are empty texts, other columns are never read. Every row is
    a document, also where ids or whole rows repeat. A group without any kept term has
    count 0 for all of them; where a language keeps no term, all values are 0. A language
    with one source has no pairs; an empty table gives no rows. Ties go to the least item
    in the order of its bytes.
    """
    counts = cut_lineage(term_counts(docs))
    kept = cut_lineage(kept_terms(counts, least_docs))
    lead = kept.filter("lead")
    # One row per language, per group and per (language, magnitude).
    sources = counts.filter(F.col("term").isNull()).select("lang", "source")
    langs = cut_lineage(
        sources.groupBy("lang").agg(_parts(F.count("*"), SIDE_GROUPS).alias("sides"))
        .join(lead.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("size")), "lang", "left")
        .fillna(0))
    groups = (sources.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
              .fillna(0, "n").join(langs.select("lang", "sides"), "lang"))
    side = groups.groupBy("lang", _part_of(F.col("source"), "sides").alias("side")).agg(
        F.collect_list(F.struct("source", "n")).alias("members"))
    shapes = lead.groupBy("lang", "magnitude").agg(_parts(F.count("*"), BLOCK_TERMS).alias("blocks"))
    placed = kept.join(shapes, ["lang", "magnitude"]).withColumn("block", _part_of(F.col("term"), "blocks"))

    blocks = placed.filter("lead").groupBy("lang", "magnitude", "block").agg(F.count("*").alias("n_block"))
    none = langs.filter("n_terms = 0").select("lang", F.lit(0).alias("magnitude"), F.lit(0).cast("long").alias("block"),
                                              F.lit(0).cast("long").alias("n_block"))
    tasks = cut_lineage(
        blocks.unionByName(none).join(langs.drop("sides"), "lang")
        .join(side.select("lang", "side", F.col("members").alias("left")), "lang")
        .join(side.select("lang", F.col("side").alias("other"), F.col("members").alias("right")), "lang")
        .filter(F.col("side") <= F.col("other")))
    own = _part_of(F.col("source"), "sides")
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    cells = (placed.join(langs.select("lang", "sides"), "lang")
             .select("lang", "magnitude", "block", "source", "term", "n", "total", own.alias("own"), met.alias("met"))
             .withColumn("side", F.least("own", "met")).withColumn("other", F.greatest("own", "met")))
    key = ["lang", "magnitude", "block", "side", "other"]
    values = cut_lineage(cells.groupBy(*key).cogroup(tasks.groupBy(*key)).applyInArrow(_block(top), _VALUES))

    pairs = values.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = values.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)


def op11_level_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all sources of ``documents``, and their first 200 terms."""
    return divergences(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT n, lang, source, unnest(w) AS term FROM d),
l AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM l GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT g.lang, g.source, l.term, coalesce(k.c, 0) AS c, l.c AS lc
      FROM g JOIN l USING (lang)
      LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM t GROUP BY lang, source, term) k USING (lang, source, term)),
s AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.c, 1 + (1000000000::HUGEINT * (c.c + 1)) // (s.n + v.v) AS p,
             1 + (1000000000::HUGEINT * (c.lc + 1)) // (v.n + v.v) AS q
      FROM c JOIN s USING (lang, source) JOIN v USING (lang)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p)::BIGINT AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value
         FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
         LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
         FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
