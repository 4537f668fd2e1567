"""Lines shared by documents: the first holder keeps them, other documents get a keep bitmap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import dimension
from ..session import stored_table
from .common import bundled, lines_of, partitions, picked, unbundled

#: The ASCII white-space characters of a key's ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines per bitmap word.
BITS = 62


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(h1, h2, doc_id, th, pos) for every line with a long enough key.

    Two 64-bit hashes stand for the key; th, a hash of the text, tells rows of one doc_id apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keys = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "th", "pos")


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, th, pos) of every line whose key occurs in a document with a smaller id.

    Key hashes are range-partitioned together with document and position, so the lines of one hot key
    spread over as many partitions as they fill. Every partition streams its sorted rows and carries
    the first document of the key at hand. A key that goes over a partition's end is the last key of
    that partition, so one row a partition settles all of them.
    """
    n = partitions(docs.sparkSession)
    order = ["h1", "h2", "doc_id", "th", "pos"]
    ranged = keyed_lines(docs.where("doc_id IS NOT NULL"), min_chars).repartitionByRange(n, *order)
    placed = ranged.withColumn("part", F.spark_partition_id()).repartitionById(n, F.col("part"))
    inside = Window.partitionBy("part").orderBy(*order)
    new_key = ~(F.col("h1").eqNullSafe(F.lag("h1").over(inside)) & F.col("h2").eqNullSafe(F.lag("h2").over(inside)))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    streamed = placed.withColumns({"head": F.when(new_key, F.col("doc_id")), "is_last": F.lead("h1").over(inside).isNull()}).withColumns({
        "first_doc": F.last("head", ignorenulls=True).over(upto), "keys": F.count("head").over(upto)})
    # what a partition drops by itself, what its first key may have to drop, and its last row
    told = stored_table(streamed.where("doc_id > first_doc OR keys = 1 OR is_last").select(*order, "first_doc", "is_last"))
    # at most one row for each partition
    carried = told.where("is_last").groupBy("h1", "h2").agg(F.min("first_doc").alias("carried"))
    first = F.least("first_doc", "carried")
    return told.join(F.broadcast(carried), ["h1", "h2"], "left").where(F.col("doc_id") > first).select("doc_id", "th", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, th, words): bitmaps of dropped lines; documents that keep everything have no row.

    ``words`` maps the number of a group of 62 lines to its bits; groups without a dropped line are
    left out. Line p is dropped if bit p % 62 of words[p div 62] is set, and kept otherwise.
    """
    words = dropped_lines(docs, min_chars).withColumn("word", F.expr(f"cast(pos div {BITS} as int)")).groupBy("doc_id", "th", "word").agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("bits"))
    return words.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """All columns of ``docs`` with the kept text, and n_lines and n_dropped.

    A key of at least ``min_chars`` code points that occurs in at least two documents keeps its lines
    in the document with the smallest id only. NULL and empty texts are one empty line. Rows of one
    doc_id are one document. Rows without doc_id keep all lines and are nobody's first document.
    Columns named n_lines or n_dropped are replaced, all others are kept, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    maps = stored_table(drop_bitmaps(picked(docs, "doc_id", "text"), min_chars))
    marked = bundled(docs, "doc_id", "text").withColumn("th", F.xxhash64(text)).join(dimension(maps).hint("shuffle_hash"), ["doc_id", "th"], "left")
    lines = marked.withColumn("lines", lines_of(F.col("text")))
    dense = F.expr(f"transform(sequence(0, (size(lines) - 1) div {BITS}), w -> coalesce(element_at(words, cast(w as int)), 0L))")
    kept = F.expr(f"filter(lines, (x, i) -> dense is null or (shiftright(get(dense, i div {BITS}), i % {BITS}) & 1) = 0)")
    cut = lines.withColumn("dense", F.when(F.col("words").isNotNull(), dense)).withColumn("kept", kept)
    counts = {"n_lines": F.size("lines").cast("long"), "n_dropped": (F.size("lines") - F.size("kept")).cast("long")}
    return unbundled(cut.withColumns(counts), docs.columns, list(counts), doc_id=F.col("doc_id"), text=F.array_join("kept", "\n"))


def query(spark, folder: str) -> DataFrame:
    """Line counts and the digest of the kept text of all documents."""
    from .common import read_table

    out = dedup_lines(read_table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
marked AS (SELECT doc_id, pos, line, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
