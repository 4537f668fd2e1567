"""How the sources of a language differ in their use of frequent terms: iceberg refinement of byte prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import dimension
from ..session import stored_table
from .common import picked, read_table

#: Documents of a language that must hold a term.
THRESHOLD = 30
#: Length in bytes of the first prefixes; every level doubles it. Longer ones need fewer readings of the texts and more counts.
FIRST = 8
#: Terms of a language that a report lists per source.
TOP = 50
#: Bytes of text whose terms a worker counts at once; small enough for its caches.
UNIT = 1 << 20
#: Bits of the filter of kept terms that workers get, whatever their number: 4 MB.
BITS = 1 << 25
#: Terms and sources of a cell in which shares are compared.
TERM_BLOCK = 4096
SOURCE_BLOCK = 128
#: Bytes of terms, A-Z lower-cased: ASCII letters and all bytes of characters beyond ASCII; others are 0.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
MASK = (1 << 32) - 1
BILLION = 1_000_000_000


def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``UNIT`` bytes of text, or one longer row."""
    for batch in batches:
        sizes = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64)
        unit = np.cumsum(sizes) // UNIT
        edges = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(sizes)]
        for at, end in zip(edges, edges[1:], strict=False):
            if end > at:
                yield batch.slice(at, end - at)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every term of the texts, and the distinct terms in UTF-8 by code.

    All bytes of a character beyond ASCII are >= 0x80, so bytes tell terms apart as code points do.
    """
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = LETTERS[np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]]] if raw is not None else np.zeros(0, np.uint8)
    inside = data != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][np.diff(ends) > 0] - ends[0]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    letters = data[inside]
    offsets = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    row = np.searchsorted(ends - ends[0], starts, side="right") - 1
    return row, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary


def prefixes(batches: Iterable[pa.RecordBatch], shorter: int, length: int) -> Iterator[pa.RecordBatch]:
    """Documents per (lang, prefix) of the terms longer than ``shorter`` bytes; a term of up to ``length`` bytes is complete."""
    for unit in units(batches):
        row, code, terms = terms_of(unit["text"])
        lang = unit["lang"].dictionary_encode()
        size = pc.binary_length(terms).to_numpy(zero_copy_only=False)
        heads = pc.binary_slice(terms, 0, length).dictionary_encode()
        head = heads.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + (size <= length)
        wanted = size[code] > shorter
        pairs = np.unique(row[wanted] << 32 | head[code[wanted]])
        key, n = np.unique(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[pairs >> 32] << 32 | pairs & MASK, return_counts=True)
        yield pa.record_batch([
            lang.dictionary.take(pa.array(key >> 32)), heads.dictionary.take(pa.array((key & MASK) >> 1)), pa.array((key & 1).astype(bool)), pa.array(n)],
            names=["lang", "prefix", "complete", "n"])


def term_filter(kept: DataFrame) -> np.ndarray:
    """A bit for the hash of every kept term; a set bit lets other terms through as well, never keeps one out."""
    at = F.pmod(F.xxhash64("term"), F.lit(BITS))
    words = kept.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def occurrences(batches: Iterable[pa.RecordBatch], passing: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each term that passes the filter occurs in a group of (lang, source)."""
    for unit in units(batches):
        row, code, terms = terms_of(unit["text"])
        # seed 42 is that of Spark's xxhash64
        at = np.fromiter((xxhash.xxh64_intdigest(t, 42) % BITS for t in terms.to_pylist()), np.uint64, len(terms))
        passed = (passing[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)[code]
        row, code = row[passed], code[passed]
        lang, source = unit["lang"].dictionary_encode(), unit["source"].dictionary_encode()
        of_row = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
        groups, group = np.unique(of_row, return_inverse=True)
        key, n = np.unique(group.reshape(-1)[row] << 32 | code, return_counts=True)
        named = groups[key >> 32]
        yield pa.record_batch([
            lang.dictionary.take(pa.array(named // len(source.dictionary))), source.dictionary.take(pa.array(named % len(source.dictionary))), terms.take(pa.array(key & MASK)), pa.array(n)],
            names=["lang", "source", "term", "n"])


def frequent_terms(docs: DataFrame, threshold: int = THRESHOLD, first: int = FIRST) -> DataFrame:
    """(lang, term) in at least ``threshold`` documents of the language; ``docs`` has lang and text without NULL.

    Prefixes of 8, 16, 32, ... bytes: at every level the distinct documents of each prefix are counted, but
    only of prefixes whose shorter prefix reached the threshold, as a term cannot be in more documents
    than its prefix. Complete terms that reach it are kept, other prefixes that do are extended.
    Workers count a megabyte of text at a time; the join drops what cannot be kept before anything is shuffled.
    """
    schema = "lang string, prefix binary, complete boolean, n long"
    kept, alive, length = [], None, first
    while True:
        shorter = 0 if alive is None else length // 2
        counts = docs.select("lang", "text").mapInArrow(lambda b, s=shorter, n=length: prefixes(b, s, n), schema)
        if alive is not None:
            parent = F.substring("prefix", 1, length // 2).alias("parent")
            counts = counts.select("*", parent).join(dimension(alive), ["lang", "parent"], "left_semi")
        reached = counts.groupBy("lang", "prefix", "complete").agg(F.sum("n").alias("n")).where(F.col("n") >= threshold)
        reached = stored_table(reached)
        kept.append(reached.where("complete").select("lang", F.col("prefix").alias("term")))
        alive = reached.where("NOT complete").select("lang", F.col("prefix").alias("parent"))
        if alive.isEmpty():
            break
        length *= 2
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kinds)) in whole numbers."""
    exact = lambda c: c.cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", exact(count + 5) * F.lit(BILLION).cast("decimal(10,0)"), exact(total + 5 * kinds)).cast("long")


def compared(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sum over the terms of a cell of the differences of shares, for every source of one block against every one of another."""
    lang, _, left, right = (k.as_py() for k in key)
    names, block = sources["source"].combine_chunks(), sources["at"].to_numpy()
    column = terms["term"].combine_chunks().dictionary_encode()
    table = np.repeat(sources["unseen"].to_numpy()[:, None], len(column.dictionary), axis=1)
    place = pc.index_in(terms["source"], names).to_numpy()
    table[place, column.indices.to_numpy()] = terms["p"].to_numpy()
    rows, others = np.flatnonzero(block == left), np.flatnonzero(block == right)
    # terms of this part that no source of either block has: all of their shares are those of unseen terms
    unseen, lacking = sources["unseen"].to_numpy(), sources["held"][0].as_py() - len(column.dictionary)
    sums = np.array([np.abs(table[i] - table[others]).sum(axis=1) + lacking * np.abs(unseen[i] - unseen[others]) for i in rows], dtype=np.int64).reshape(len(rows), len(others))
    i, j = np.nonzero(rows[:, None] != others[None, :])
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": names.take(pa.array(rows[i])), "item": names.take(pa.array(others[j])), "value": pa.array(sums[i, j], pa.int64())})


def source_divergence(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far the shares of frequent terms of a source are from those of others.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` kept terms that a source uses more than
    its language does. NULL text, lang and source are ''. Every row is a document, so repeated rows and ids
    count each time. Ranks go by value, then by the item's bytes. A language without kept terms has pairs
    of value 0 and no terms; one with a single source has no pairs. An empty table gives an empty result.

    Counts are summed per worker and then by key, however many rows one group has. Terms are dealt to blocks, sources
    to blocks of ``SOURCE_BLOCK``; a task holds the shares of two blocks of sources for one block of terms. The
    pairs of a language are as many as the result asks for.
    """
    rows = picked(docs, text, lang, source).toDF("text", "lang", "source")
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    kept = stored_table(frequent_terms(rows, threshold))
    passing = rows.sparkSession.sparkContext.broadcast(term_filter(kept))
    found = rows.mapInArrow(lambda b: occurrences(b, passing.value), "lang string, source string, term binary, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = stored_table(found.join(dimension(kept), ["lang", "term"], "left_semi"))
    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).drop("docs")
    groups = groups.join(sums, ["lang", "source"], "left").join(kinds, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds"))
    groups = stored_table(groups.withColumn("unseen", F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(0).cast("long")))
    shares = stored_table(counts.join(dimension(groups), ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # the limit on ranks also runs before the shuffle, so a source hands on ``top`` terms per task
    terms = _terms(groups, shares, kinds, top).withColumn("rank", rank).where(F.col("rank") <= top)
    return _pairs(groups, shares, kept, kinds).withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def _pairs(groups: DataFrame, shares: DataFrame, kept: DataFrame, kinds: DataFrame) -> DataFrame:
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCE_BLOCK).cast("int").alias("blocks")).join(kinds, "lang", "left")
    langs = dimension(langs.select("lang", "blocks", F.greatest(F.lit(1), F.ceil(F.coalesce("kinds", F.lit(0)) / TERM_BLOCK)).cast("int").alias("parts")))
    at = F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("at")
    placed = lambda df: df.join(langs, "lang").withColumn("at", at)

    def cells(df: DataFrame) -> DataFrame:
        """Every row once for each cell that its block of sources is the left or the right side of."""
        other = F.sequence(F.lit(0), F.col("blocks") - 1)
        sides = F.array_distinct(F.concat(F.transform(other, lambda o: F.struct(F.col("at").alias("i"), o.alias("j"))), F.transform(other, lambda o: F.struct(o.alias("i"), F.col("at").alias("j")))))
        return df.withColumn("side", F.explode(sides)).select("*", "side.i", "side.j").drop("side", "blocks", "parts")

    part_no = F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part_no")
    terms = cells(placed(shares.select("lang", "source", "term", "p")).withColumn("part_no", part_no))
    held = dimension(kept.join(langs, "lang").groupBy("lang", part_no).agg(F.count(F.lit(1)).alias("held")))
    sources = placed(groups.select("lang", "source", "unseen")).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sources = cells(sources.join(held, ["lang", "part_no"], "left").fillna(0, "held"))
    cell = ["lang", "part_no", "i", "j"]
    sums = terms.groupBy(*cell).cogroup(sources.groupBy(*cell)).applyInArrow(compared, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))


def _terms(groups: DataFrame, shares: DataFrame, kinds: DataFrame, top: int) -> DataFrame:
    totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kinds").alias("kinds"))
    whole = shares.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(dimension(totals), "lang")
    whole = whole.select("lang", "term", share(F.col("n"), F.col("total"), F.col("kinds")).alias("q"))
    above = shares.join(dimension(whole), ["lang", "term"]).where("p > q")
    return above.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def query(spark, folder: str) -> DataFrame:
    """Divergence of the sources of all documents."""
    return source_divergence(read_table(spark, folder, "documents"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
per_doc AS (SELECT d, lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM per_doc GROUP BY lang, term HAVING count(*) >= 30),
counts AS (SELECT lang, source, term, sum(n) AS n FROM per_doc JOIN kept USING (lang, term) GROUP BY ALL),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(s.t, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS t FROM counts GROUP BY ALL) s USING (lang, source) LEFT JOIN kinds USING (lang)),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(t) + 5 * any_value(v)) AS q
  FROM counts JOIN (SELECT lang, sum(total) AS t, max(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term),
rows_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM dense x JOIN dense y USING (lang, term) GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
