"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ..session import stored_table
from .common import WORD, bundled, picked, unbundled

#: Words of a block, and about how many words a shard holds.
BLOCK = 16
SHARD = 1 << 20


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, limit: float = 3.0) -> DataFrame:
    """(src, source_size, target) from (src, source_size).

    Sources by code point, NULL last, weigh 1, 2, 3, repeating, and share all words. A target stops at
    ``limit`` times its source; the excess is shared by weight among the others until none is above.
    Every round is one aggregate over the sources; a round fixes at least one more source.
    """
    ranked = stored_table(global_rank(sizes, [F.col("src").isNull(), "src"], "rank").withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double")))
    top = F.col("source_size") * F.lit(float(limit))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = None, 0
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level >= top
        fixed, weight, count = ranked.agg(
            F.coalesce(F.sum(F.when(capped, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(capped, 1)), F.lit(0))).first()
        if level is not None and (count == full or not weight):
            break
        level, full = (total - fixed) / weight if weight else 0.0, count
    share = F.col("weight") * F.lit(level)
    return ranked.select("src", "source_size", F.least(share, top).alias("target"))


def apportion(parties: DataFrame, key: str, weight: str, seats: str, within: str) -> DataFrame:
    """(key, quota): Sainte-Laguë seats for every party of a group ``within``.

    The seats go to the highest quotients weight / (2 k + 1), ties by key. Only quotients near the
    proportional share can decide: with S parties the quotas lie within share * S / 2 + 1 of it, so
    about 5 S quotients are ranked, however many seats there are.
    """
    whole = Window.partitionBy(within)
    ready = parties.withColumns({"_total": F.sum(weight).over(whole), "_n": F.count(F.lit(1)).over(whole)})
    share = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(F.lit(0.0))
    ready = ready.withColumns({"_share": share * F.col(seats), "_reach": F.ceil(share * F.col("_n") / 2.0).cast("long") + 1})
    ready = ready.withColumn("_low", F.greatest(F.lit(0).cast("long"), F.floor("_share").cast("long") - F.col("_reach")))
    ready = ready.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    steps = ready.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.floor("_share").cast("long") + F.col("_reach") + 1)))
    best = Window.partitionBy(within).orderBy(F.desc("_quotient"), key, "_k")
    won = steps.withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1)).withColumn("_r", F.row_number().over(best)).where(
        (F.col("_r") <= F.col("_left")) & (F.col(weight) > 0))
    gained = won.groupBy(within, key).agg(F.count(F.lit(1)).alias("_gain"))
    return ready.join(gained, [within, key], "left").select(within, key, (F.col("_low") + F.coalesce("_gain", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, limit: float = 3.0, seed: int = 42) -> DataFrame:
    """(doc_id, th, src, shard, size, source_size, target, taken) for every row; th is a hash of the text.

    Blocks of ``block`` words are apportioned to the sources by their targets, then to the shards of a
    source by their size. A shard strings its documents in seeded order; its blocks are consecutive
    stretches of that string (the last one takes the rest). With a quota of q blocks out of n, every
    block is taken q div n times and a seeded choice of q mod n blocks once more, at most ``limit``
    times. ``taken`` counts the words of a document inside taken blocks, so it never exceeds ``limit``
    times its size. Shards are filled by a hash, so a hot source only has more shards, and all seeded
    choices depend on ids and texts alone: reruns agree.

    NULL or wordless texts have size 0 and take 0. Repeated rows are separate documents. A source
    without words has target 0.
    """
    sized = stored_table(picked(docs, "doc_id", "text", "source").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"),
        F.col("source").cast("string").alias("src"), words_in(F.col("text")).alias("size")))
    sources = source_targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), limit)
    sources = sources.withColumns({"all": F.lit(0), "sid": F.xxhash64(F.col("src").isNull(), "src")})
    blocks = F.round(F.sum("target").over(Window.partitionBy("all")) / block).cast("long")
    quotas = apportion(sources.withColumn("blocks", blocks), "sid", "target", "blocks", "all")
    sources = stored_table(sources.join(quotas, ["all", "sid"]).withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("int")).drop("all"))
    known = sources.select("sid", "source_size", "target", "quota", "shards")
    placed = sized.withColumn("sid", F.xxhash64(F.col("src").isNull(), "src")).join(known, "sid").withColumns({
        "luck": F.xxhash64(F.lit(seed), "doc_id", "th")}).withColumn("shard", F.pmod(F.xxhash64("luck"), F.col("shards")).cast("int"))
    per_shard = placed.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    shards = apportion(per_shard, "shard", "words", "quota", "sid").join(per_shard.drop("quota"), ["sid", "shard"])
    n_blocks = F.greatest(F.lit(1).cast("long"), F.floor(F.col("words") / block))
    shards = stored_table(shards.withColumn("n", n_blocks))
    return _take(placed, shards, block, limit, seed).select("doc_id", "th", "src", "shard", "size", "source_size", "target", "taken")


def _take(placed: DataFrame, shards: DataFrame, block: int, limit: float, seed: int) -> DataFrame:
    string = Window.partitionBy("sid", "shard").orderBy("luck", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    strung = placed.drop("quota").withColumn("end", F.sum("size").over(string)).join(shards, ["sid", "shard"])
    strung = strung.withColumns({
        "start": F.col("end") - F.col("size"), "times": F.expr("quota div n"), "more": F.expr("quota % n"),
        "turn": F.pmod(F.xxhash64(F.lit(seed), "sid", "shard"), F.col("n"))})
    # a seeded rotation followed by an even spread: exactly `more` of the n blocks are chosen
    chosen = "((b + turn) % n + 1) * more div n > ((b + turn) % n) * more div n"
    words = f"greatest(0L, least(end, if(b = n - 1, words, (b + 1) * {block})) - greatest(start, b * {block}))"
    times = f"least({int(limit)}L, times + if({chosen}, 1L, 0L))"
    taken = F.expr(f"""if(size = 0, 0L, aggregate(
        sequence(least(start div {block}, n - 1), least((end - 1) div {block}, n - 1)), 0L, (acc, b) -> acc + {words} * {times}))""")
    return strung.withColumn("taken", taken)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in whole documents.

    A document appears taken / size times, rounded down or up. In a shard, from the longest document to
    the shortest, one is rounded up whenever the running sum of the fractions passes a whole number, so
    a shard's words differ from those taken by about one document. Extra columns are kept.
    """
    plan = stored_table(mix(docs, **settings)).where("taken > 0")
    ratio = F.col("taken") / F.col("size")
    falling = Window.partitionBy("src", "shard").orderBy(F.desc("size"), "doc_id", "th", "taken").rowsBetween(Window.unboundedPreceding, 0)
    part = F.round(ratio - F.floor(ratio), 9)
    running = plan.withColumns({"_part": part, "_upto": F.round(F.sum(part).over(falling) + 0.5, 6)})
    extra = F.floor("_upto") - F.floor(F.round(F.col("_upto") - F.col("_part"), 6))
    copies = running.select("doc_id", "th", (F.floor(ratio) + extra).cast("int").alias("_times")).groupBy("doc_id", "th").agg(F.max("_times").alias("_times"))
    marked = bundled(docs, "doc_id", "text").withColumn("_th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = (marked["doc_id"].eqNullSafe(copies["doc_id"])) & (marked["_th"] == copies["th"])
    found = marked.join(copies.where("_times > 0").hint("shuffle_hash"), same).select(marked["doc_id"], "text", "_rest", "_times")
    again = found.withColumn("_again", F.explode(F.sequence(F.lit(1), "_times")))
    return unbundled(again, docs.columns, doc_id=F.col("doc_id"), text=F.col("text"))


def query(spark, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from .common import read_table

    return mix(read_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
