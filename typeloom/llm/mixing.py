"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources by code point, null last, weigh WEIGHTS in turn and share TOTAL of all words; no target is above MOST times
its source's size, and what is above is shared again by weight. The mix is a sequence of slots, 2^k of them, so that a slot
has about BLOCK words whatever the size of the mix. Slot i has the van der Corput point of base 2, i with its k bits
reversed over 2^k. The targets lie side by side on the unit interval, and a point belongs to the source that it falls in; so
a source's slots are the reversed numbers of a range and need no lookup. A source that no point falls in has one slot
beside the next point's. A source's slots are ranked, its documents are shuffled and cut into as many blocks of equally
many words, around the end, and the r-th slot takes the r-th block: `schedule` puts out the mix in order, piece by piece.
The blocks of a source make up its target exactly, however small it is. A block may begin and end within a document.

Null and empty texts have size 0, and nothing of them is taken; without any words all targets are 0. Repeated rows are
rows of their own. An empty table gives an empty result. The shuffle is by a hash of the row, so reruns agree.
Only ids, sources and sizes are shuffled, never texts. Sources may be many: their order is taken over ranges of them, the
level of the targets by sums over all, and they meet documents by a broadcast only if they are counted to be few.
Running sums are taken over buckets of the shuffled order and then within them, ranks over chunks of slots and then within
them, so that a source with a third of all rows is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, with_group, written

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2
#: Words of a slot, at most, on average; slots of a chunk in which ranks are counted.
BLOCK, CHUNK = 1024, 4096
#: Rows of one bucket of the shuffled order, and sources of one range of them, about.
BUCKET_ROWS, RANGE_ROWS = 2_000, 50_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(sizes: DataFrame) -> DataFrame:
    """sizes(source, ..) with part and sid, written: sid numbers the sources by code point, null last, from 0; part is the range
    of sources that a row is in. Only the number of rows of each range goes through one task."""
    spark = sizes.sparkSession
    parts = max(1, -(-sizes.count() // RANGE_ROWS))
    by = [F.col("source").isNull(), F.col("source")]
    dealt = sizes.repartitionByRange(parts, *by) if parts > 1 else sizes.coalesce(1)
    dealt = written(spark, dealt.withColumn("part", F.spark_partition_id()), "ranges")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    return dealt.withColumn("own", own).join(before(dealt, F.count("*").alias("v")), "part").withColumn("sid", F.col("own") + F.col("before")).drop("own", "before")


def before(rows: DataFrame, total: Column) -> DataFrame:
    """part, before: the total (named v) over all ranges before each; a row for each range."""
    sums = rows.groupBy("part").agg(total)
    return sums.select("part", F.coalesce(F.sum("v").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size, ..) with sid, part, weight and target. What the saturated sources leave is shared again
    among the others until no source is above its bound; each step is two sums over the sources."""
    rows = in_order(sizes)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")).cast("double")
    rows = written(sizes.sparkSession, rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST)), "weights")
    total = TOTAL * (rows.agg(F.sum("source_size")).collect()[0][0] or 0)
    level, found = 0.0, None
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        now = rows.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).collect()[0]
        if now[2] == found or not now[1]:
            break
        level, found = (total - (now[0] or 0.0)) / now[1], now[2]
    return rows.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def planned(sizes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """sid, source, source_size, target, take (the target in whole words), first, n (the points that fall in the source) and
    extra (no point does) of each source, and the number of bits of a slot."""
    rows = targets(sizes).withColumn("take", F.least(F.round("target").cast("long"), F.col("source_size") * MOST))
    total = rows.agg(F.sum("take")).collect()[0][0] or 0
    bits = max(0, (-(-total // block) - 1).bit_length())
    inside = F.coalesce(F.sum("take").over(Window.partitionBy("part").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("inside", inside).join(before(rows, F.sum("take").alias("v")), "part").withColumn("low", F.col("inside") + F.col("before"))
    # the points that are at least low / total: from ceil(low * 2^bits / total) on
    point = lambda words: F.ceil(words * float(1 << bits) / F.lit(float(max(1, total)))).cast("long")
    rows = rows.withColumn("first", F.least(point(F.col("low")), F.lit((1 << bits) - 1))).withColumn("points", F.greatest(point(F.col("low") + F.col("take")) - point(F.col("low")), F.lit(0)))
    rows = rows.withColumn("extra", (F.col("points") == 0) & (F.col("take") > 0)).withColumn("n", F.when(F.col("take") > 0, F.greatest("points", F.lit(1))).otherwise(0))
    return written(sizes.sparkSession, rows.select("sid", "source", "source_size", "rows", "target", "take", "first", "n", "extra"), "plan"), bits


def reversed_bits(n: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(n), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def ranked_slots(plan: DataFrame, bits: int) -> DataFrame:
    """slot, sid, rank of every slot. A source's points are listed chunk by chunk, so that a large source is dealt over tasks;
    ranks are counts of the chunks before and the place within the chunk."""
    wide = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK).cast("long"))
    chunks = plan.where("n > 0").select("sid", "first", "n", F.explode(wide).alias("c")).repartition("sid", "c")
    points = chunks.select("sid", F.explode(F.sequence(F.col("first") + F.col("c") * CHUNK, F.col("first") + F.least(F.col("n"), (F.col("c") + 1) * CHUNK) - 1)).alias("point"))
    slots = points.select("sid", reversed_bits(F.col("point"), bits).alias("slot")).withColumn("chunk", F.floor(F.col("slot") / CHUNK).cast("long"))
    counts = slots.groupBy("sid", "chunk").agg(F.count("*").alias("k"))
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("k").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return slots.withColumn("own", own).join(counts, ["sid", "chunk"]).select("slot", "sid", (F.col("own") + F.col("earlier")).cast("long").alias("rank"))


def identity() -> list[Column]:
    """doc_id, source, size, place of a document; the place in the shuffle is a hash of the id, of the text without one."""
    key, text = F.col("doc_id"), F.col("text").cast("string")
    return [key.cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(text).alias("size"), F.xxhash64(F.lit("shuffle"), key.cast("string"), F.when(key.isNull(), text)).alias("place")]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, place of every document."""
    return docs.select(*identity())


def pieces(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The pieces of the mix (doc_id, source, size, place, source_size, target, start, slot, rank, at, begin, words), and
    the rows of which nothing is taken. rows(doc_id, source, size, place); begin counts words of the document from 0, at
    those of the source's part of the mix."""
    spark = rows.sparkSession
    rows = written(spark, rows, "sizes")
    sizes = written(spark, rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("rows")), "sources")
    plan, bits = planned(sizes, block)
    dealt = with_group(rows, plan.select("sid", "source", "source_size", "rows", "target", "take", "n"), "source", "place")
    # buckets of the shuffled order, as many as the source has rows for
    dealt = dealt.withColumn("bucket", F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("rows") / BUCKET_ROWS)))
    each = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    each = each.select("sid", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).join(each, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("inside"))
    # pass p covers the words from p * source_size on; what lies beyond the words taken is cut off
    spans = F.array(*[F.struct((F.col("start") + p * F.col("source_size")).alias("a"), F.least(F.col("start") + p * F.col("source_size") + F.col("size"), F.col("take")).alias("b")) for p in range(MOST)])
    dealt = dealt.withColumn("spans", F.filter(spans, lambda s: s["b"] > s["a"])).select("doc_id", "source", "size", "place", "source_size", "target", "sid", "start", "take", "n", "spans")
    block_of = lambda word: F.floor(word * F.col("n").cast("double") / F.col("take")).cast("long")
    cut = dealt.where(F.size("spans") > 0).withColumn("span", F.explode("spans")).withColumn("rank", F.explode(F.sequence(block_of(F.col("span.a")), block_of(F.col("span.b") - 1))))
    edge = lambda rank: F.ceil(rank * F.col("take").cast("double") / F.col("n")).cast("long")
    a, b = F.greatest(F.col("span.a"), edge(F.col("rank"))), F.least(F.col("span.b"), edge(F.col("rank") + 1))
    cut = cut.withColumn("a", F.when(F.col("rank") == block_of(F.col("span.a")), F.col("span.a")).otherwise(a)).withColumn("b", F.when(F.col("rank") == block_of(F.col("span.b") - 1), F.col("span.b")).otherwise(b))
    joined = cut.withColumn("at", F.col("a")).withColumn("begin", F.pmod(F.col("a"), F.col("source_size")) - F.col("start")).withColumn("words", F.col("b") - F.col("a")).join(ranked_slots(plan, bits), ["sid", "rank"])
    return joined.select("doc_id", "source", "size", "place", "source_size", "target", "start", "slot", "rank", "at", "begin", "words"), dealt.where(F.size("spans") == 0)


def schedule(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source, rank, at, doc_id, begin, words: the mix piece by piece; in order of slot, source and at it is the mix. A
    slot takes one block, and a block is pieces of successive documents of the shuffled source."""
    taken, _ = pieces(measured(docs), block)
    return taken.select("slot", "source", "rank", "at", "doc_id", "begin", "words")


def mixed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, place, source_size, target, taken of rows(doc_id, source, size, place)."""
    key = ["doc_id", "source", "size", "place", "source_size", "target"]
    taken, rest = pieces(rows, block)
    # rows alike in all columns differ in their start, since rows with pieces have words
    found = taken.groupBy(*key, "start").agg(F.sum("words").cast("long").alias("taken"))
    return found.select(*key, "taken").unionByName(rest.select(*key, F.lit(0).cast("long").alias("taken")))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixed(measured(docs), block).select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents of the mix, with their columns: each as often as its share of words taken, rounded, says. Documents
    that the mix takes less than half of, and those without words, are left out. Rows without doc_id or source are kept
    apart from all others as any value is; rows alike in id, source, size and (without an id) text share their copies."""
    names = docs.columns
    key = ("doc_id", "source", "size", "place")
    counts = mixed(measured(docs), block).where("size > 0").select(*[F.col(c).alias(f"_{c}") for c in key], F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_times")).where("_times > 0")
    counts = counts.groupBy(*[f"_{c}" for c in key]).agg(F.sum("_times").alias("_sum"), F.count("*").alias("_n"))
    sized = docs.select("*", *[c.alias(f"_own_{k}") for k, c in zip(key, identity())])
    kept = sized.join(counts, (F.col("_own_place") == F.col("_place")) & (F.col("_own_size") == F.col("_size")) & F.col("_own_doc_id").eqNullSafe(F.col("_doc_id")) & F.col("_own_source").eqNullSafe(F.col("_source")))
    times = F.greatest(F.lit(1), F.round(F.col("_sum") / F.col("_n"))).cast("int")
    return kept.withColumn("_k", F.explode(F.sequence(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in names])
