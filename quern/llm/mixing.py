"""Mixing sources to target weights by weighted fair queueing; DataFrame operations only.

Every source is a queue of its documents in a fixed shuffled order (by a digest of id, size and the number among rows that agree in
both), repeated up to MAX_COPIES times. A copy's virtual finish time is its source's words up to and including it, divided by the source's target. All copies are
sorted by it and the mix is cut where the words reach the total budget, so every queue is served in proportion to its target.

Nothing is sorted in one task: the words before a document are the sum over the BUCKETS digest ranges before its own plus a
window within (source, range), and the cut is found by two histograms of the finish time, the second within the one range of the first that
holds the cut, with an exact sort only inside one range of the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NUMBERED, discard, fresh, numbered, shared_table, word_count

MAX_COPIES = 3
#: Ranges of the digest (three hexadecimal digits).
BUCKETS = 4096
#: Ranges of the finish time per unit, first and second histogram. The cut is near 1; finish times beyond 4 share a range.
COARSE, FINE = 1 << 12, 1 << 24


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_rank, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Sorted by size over weight, a source is at its
    limit of MAX_COPIES times its size if an equal share of what is left would exceed it; the others share the rest by weight. This is
    the fixed point of resharing the excess again and again, in integers up to the last division.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name)).withColumn("w", (F.col("source_rank") - 1) % 3 + 1)
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.expr("source_size * 6 div w"), "source_rank")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.withColumn("budget", F.sum("source_size").over(every)).withColumn(
        "rest", F.col("budget") - F.coalesce(F.sum(F.col("source_size") * MAX_COPIES).over(earlier), F.lit(0))
    ).withColumn("rest_w", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    full = left.withColumn("full", F.col("source_size") * MAX_COPIES * F.col("rest_w") <= F.col("w") * F.col("rest"))
    shared = full.withColumn("free", F.col("budget") - F.sum(F.when(F.col("full"), F.col("source_size") * MAX_COPIES).otherwise(0)).over(every)).withColumn(
        "free_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every)
    )
    return shared.select(
        "source", "source_rank", "source_size", "budget",
        F.when(F.col("full"), (F.col("source_size") * MAX_COPIES).cast("double")).otherwise((F.col("w") * F.col("free")).cast("double") / F.col("free_w").cast("double")).alias("target"),
    )


def _before_cut(copies: DataFrame, width: int, start, budget: int) -> tuple[int | None, int]:
    """The range of finish times (1 / width each) in which the words reach the budget, and the words before it."""
    at = F.floor(F.least(F.col("finish"), F.lit(4.0)) * width)
    sums = copies.groupBy(at.alias("at")).agg(F.sum("size").alias("words"))
    w = Window.orderBy("at")
    row = sums.withColumn("upto", F.sum("words").over(w)).filter(F.col("upto") + start > budget).orderBy("at").first()
    return (None, 0) if row is None else (row["at"], int(row["upto"] - row["words"]) + start)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken (size times the copies taken), source, copies.

    Null texts and texts without words have size 0 and take 0 words; a source without words has target 0 and gives no
    copies. A null source is a source. Texts of any length count whole. Rows that agree in id, source and size are numbered and queue
    one by one, so repeated rows and null ids have places of their own; which of them has which is open, as the result
    does not tell them apart. Ties of the finish time go by source, digest and number. Reruns agree. An empty table gives an empty result.
    """
    return _mixed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))


def _mixed(rows: DataFrame) -> DataFrame:
    """`mix` of rows (doc_id, source, size)."""
    spark = rows.sparkSession
    rows = numbered(rows, "nth").withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("nth").cast("string"))))
    rows = shared_table(spark, rows.withColumn("bucket", F.substring("key", 1, 3)), "mix-rows")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).alias("o")
        .join(goal.alias("g"), F.expr("o.source <=> g.source"))
        .select("o.source", "o.bucket", "offset", "source_rank", "source_size", "budget", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        rows.withColumn("upto", F.sum("size").over(inside)).alias("r")
        .join(offsets.alias("f"), F.expr("r.source <=> f.source and r.bucket = f.bucket"))
        .select("r.doc_id", "r.source", "r.size", "r.nth", "r.key", "source_rank", "source_size", "budget", "target", (F.col("upto") + F.col("offset")).alias("upto"))
    )
    queued = shared_table(spark, queued, "mix-queued")
    copies = queued.select("*", F.explode(F.array(*[F.lit(i) for i in range(MAX_COPIES)])).alias("copy")).withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("copy") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))
    ).filter("finish is not null")
    budget = queued.agg(F.max("budget")).first()[0] or 0
    last, start = _before_cut(copies, COARSE, 0, budget)
    fine = None
    if last is not None:
        in_range = copies.filter(F.floor(F.least(F.col("finish"), F.lit(4.0)) * COARSE) == last)
        fine, start = _before_cut(in_range, FINE, start, budget)
    taken = F.lit(0)
    for i in range(MAX_COPIES):
        finish = (F.lit(i) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
        whole = F.lit(True) if fine is None else F.floor(F.least(finish, F.lit(4.0)) * FINE) < fine
        taken = taken + F.when((F.col("target") > 0) & whole, 1).otherwise(0)
    whole = queued.withColumn("copies", taken)
    if fine is not None:
        order = Window.orderBy("finish", "source_rank", "key", "doc_id", "size", "nth", "copy").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.filter(F.floor(F.least(F.col("finish"), F.lit(4.0)) * FINE) == fine).withColumn("served", F.sum("size").over(order) + start)
        extra = edge.filter(F.col("served") <= budget).groupBy("doc_id", "source", "size", "nth").agg(F.count("*").alias("extra"))
        whole = whole.alias("q").join(extra.alias("e"), F.expr("q.doc_id <=> e.doc_id and q.source <=> e.source and q.size = e.size and q.nth = e.nth"), "left").select("q.*", F.coalesce("extra", F.lit(0)).alias("extra")).withColumn("copies", F.col("copies") + F.col("extra"))
    out = whole.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", F.col("copies").cast("int").alias("copies"))
    out.held = rows, queued  # the tables that it reads
    return out


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents in the mix, with the input's columns, each as many times as it is taken.

    Null texts and texts without words have size 0 and are in the mix as often as their place in the queue says. Rows that agree in id,
    source and size share what the mix takes of them evenly, in the order of a hash of the whole row. See `mix` for the
    rest. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tag, twin, times, block, copy = fresh(docs, "_tag", "_twin", "_copies", "_block", "_copy")
    names = [F.col(f"`{c}`") for c in docs.columns]
    # Two hashes of the whole row stand for it, so that sizes are counted once and everything but the last join goes without texts.
    tags = (F.xxhash64(*names), F.xxhash64(F.lit(1), *names))
    slim = shared_table(spark, docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tags[0].alias("tag"), tags[1].alias("twin")), "mix-slim")
    queue = _mixed(slim.select("doc_id", "source", "size"))
    mixed = queue.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("c"), F.count("*").alias("n")).filter("c > 0")
    same = slim.groupBy("doc_id", "source", "size", "tag", "twin").agg(F.count("*").alias("rows"))
    found = same.alias("s").join(mixed.alias("m"), F.expr("s.doc_id <=> m.doc_id and s.source <=> m.source and s.size = m.size")).select("s.*", "c", "n")
    earlier = Window.partitionBy("doc_id", "source", "size").orderBy("tag", "twin").rowsBetween(Window.unboundedPreceding, -1)
    left = F.expr("c % n") - F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    share = F.expr("rows * (c div n)") + F.greatest(F.lit(0), F.least("rows", left))
    whole = found.filter("rows = n").select("tag", "twin", "rows", F.col("c").alias("times"))
    parts = found.filter("rows < n").select("tag", "twin", "rows", share.alias("times"))
    shares = shared_table(spark, whole.unionByName(parts).filter("times > 0"), "mix-shares")
    discard(slim, *queue.held)
    marked = docs.withColumn(tag, tags[0]).withColumn(twin, tags[1])

    def taken(some: DataFrame) -> DataFrame:
        some = some.select(F.col("tag").alias(tag), F.col("twin").alias(twin), F.col("times").alias(times))
        return marked.join(some, [tag, twin])

    single = taken(shares.filter("rows = 1")).select(*names, times)
    # Rows that are the same throughout are one row with a number of copies, made in blocks that are dealt anew, as it can stand for any
    # share of the table.
    one = taken(shares.filter("rows > 1")).dropDuplicates([tag, twin])
    blocks = one.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {NUMBERED}")))).repartition(tag, block)
    blocks = blocks.select(*names, F.least(F.lit(NUMBERED), F.col(times) - F.col(block) * NUMBERED).alias(times))
    every = single.unionByName(blocks)
    return every.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*names)
