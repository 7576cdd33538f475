"""SimHash near-duplicates: popcounts per segment as an embedding, a grid join under the Manhattan distance, exact verification.

A 64-bit fingerprint is cut into 32 segments of two bits. The vector of the segments' popcounts embeds it: one
differing bit moves one coordinate by at most one, so the Manhattan distance of two vectors is a lower bound of the
Hamming distance of the fingerprints. The coordinates form GROUPS groups; if the Manhattan distance is at most t, at least
GROUPS - t groups agree in every coordinate. Each choice of that many groups is a grid whose cell is the coordinates of these
groups, and the range join is an equality join on the cell, per choice. Pairs of a cell are
filtered by the Manhattan bound and then by the exact Hamming distance.

A cell with more than CELL_LIMIT distinct fingerprints would give a quadratic number of pairs. Its members are linked exactly
another way, linear in their number: every pair within t bits agrees once some t bits are cleared, so equal cleared
fingerprints are linked in a star.

Copies collapse first: everything after the fingerprints works on distinct fingerprints.

Near copies of a lower similarity differ in more of these bits than any grid of counts can span without missing pairs: at a Jaccard
similarity of 0.8 about 39 of 256 bits differ. `similar_components` takes as fingerprint the set of five-word shingles itself: one bit for each
64-bit hash. Its segments are HISTOGRAM ranges of hashes, and their popcounts embed it: the Manhattan distance of two vectors is a lower bound
of the number of shingles that only one text has, which is the Hamming distance, and the similarity bounds that number. The parities of
finer ranges' popcounts bound it too, closely for texts of up to about a thousand words. The cells of the
join are not ranges of counts but prefixes: in one order of all shingles, two sets of a similarity of t or more share one of the first
n - ceil(t n) + 1 of each, so no pair is missed, at any table size. Shingles that are frequent in a bounded sample come last in the
order; the sample decides the cells only, never the result. Cells that share most of their members become one. A large cell's members are compared
with a few centres, links contract, the centres leave, and rounds go on until no cell holds members of two components. Pairs within the
bound, and within 256 SimHash bits with a wide margin, are accepted by the exact similarity of the sets.
"""

from __future__ import annotations

import math
from itertools import chain, combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_offsets, discard, fresh, gram_hashes, hash_words, hold, mix64, prepare, shared_table, slices

SHINGLE = 3
GROUPS = 4
CELL_LIMIT = 4032
_CHUNK = 1 << 16
#: Documents sampled for the order of shingles, times a shingle occurs there to count as frequent, and frequent shingles held at most.
ORDER_ROWS, ORDER_LEAST, ORDER_LIMIT = 4096, 3, 1 << 16
#: Rounds before the whole ones: cells that a set takes part in, centres of a cell besides one, and members up to which all are centres.
FIRST_ROUNDS = ((1, 0, 4), (2, 16, 64))
#: Centres of a cell in the first whole round, how many times as many in each further one, and members up to which all are.
CENTRES, CENTRES_GROW, SMALL_CELL = 256, 64, 1024
#: Segments of the set's fingerprint, and the popcount of one that still counts (more count as that many, which keeps the bound).
HISTOGRAM, HIGHEST = 128, 8
#: Ranges of shingle hashes whose counts' parities are kept, a bit each.
PARITY = 2048
#: Bits of 256 allowed beyond those expected before the sets are compared: over seven standard deviations of large sets, over five of
#: sets of a few shingles, whose ties move more bits.
MARGIN_BITS = 46
#: Half a standard deviation of the bits, for comparisons by fingerprints alone.
NOISE_BITS = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text; 0 for null and texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        off = byte_offsets(words)
        first, last = off[: n - shingle + 1].tolist(), (off[shingle:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _majority(hashes: np.ndarray, words: int) -> list[int]:
    """Fingerprints of 64 bits each: bit by bit what more than half of the hashes have, after `words` different mixings."""
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        mixed = mix64(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for i in range(0, len(mixed), _CHUNK):
            ones += np.unpackbits(mixed[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits((2 * ones > len(mixed)).astype(np.uint8), bitorder="little").view("<i8")[0]))
    return out


def wide_fingerprint(text: str | None) -> list[int]:
    """Six signed words: 128 bits over three-word shingles, 256 over five-word ones; zeros without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * 6
    h = hash_words(words)
    return _majority(gram_hashes(h, min(3, len(h))), 2) + _majority(gram_hashes(h, min(5, len(h))), 4)


def similar_bits(similarity: float) -> int:
    """Bits of 256 that differ at a Jaccard similarity: the angle of the shingles' vectors over pi."""
    return int(256 * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(gram_hashes(hash_words(words), min(shingle, len(words)))) if words else np.zeros(0, np.uint64)


def _set_key(grams: np.ndarray) -> int:
    """A signed hash of a set; 0 for the empty one."""
    return _long(xxhash.xxh3_64_intdigest(grams.tobytes())) if len(grams) else 0


def _prefix(grams: np.ndarray, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(similarity n) + 1 of a set's hashes in the order, those not frequent (by value) and those frequent (by rank,
    after the others)."""
    n = len(grams)
    want = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not len(frequent):
        return grams[:want], grams[:0]
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    known = frequent[at] == grams
    first = grams[~known][:want]
    return first, grams[known][np.argsort(rank[at[known]], kind="stable")][: want - len(first)]


def _frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in several documents of a bounded sample, sorted, and the rank of each, the most frequent last."""

    def grams(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["gram"])

    sampled = docs.select(text_col).sample(min(1.0, ORDER_ROWS / max(1, docs.count())), 9)
    counts = sampled.mapInArrow(grams, "gram long").groupBy("gram").count().filter(F.col("count") >= ORDER_LEAST)
    found = counts.orderBy(F.col("count").desc(), "gram").limit(ORDER_LIMIT).collect()
    values = np.array([r.gram for r in found], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(values) - np.arange(len(values)))[order]


_WIDE = [f"w{i}" for i in range(4)]
_COUNTS = [f"h{i}" for i in range(HISTOGRAM * HIGHEST // 64)]
_PARITY = [f"p{i}" for i in range(PARITY // 64)]
#: What a member brings to be compared.
_OWN = ["n", *_WIDE, *_COUNTS, *_PARITY]
_UNARY = np.array([(1 << k) - 1 for k in range(HIGHEST + 1)], np.uint8)


def set_counts(grams: np.ndarray) -> np.ndarray:
    """Popcounts of the segments of a set's fingerprint in unary, a byte each, as signed words: the number of differing bits of two such
    vectors is the Manhattan distance of the counts."""
    counts = np.bincount((grams >> np.uint64(57)).astype(np.int64), minlength=HISTOGRAM)
    return _UNARY[np.minimum(counts, HIGHEST)].view("<i8")


def set_parity(grams: np.ndarray) -> np.ndarray:
    """Whether each of PARITY ranges of a set's fingerprint has an odd popcount, a bit each, as signed words: a differing bit of the
    fingerprint changes one of them, so the number of differing bits of two such vectors is a lower bound of the differing shingles, and
    close to it while these are few beside PARITY."""
    odd = np.bincount((grams & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrays of unsigned hashes as a list<long> column."""
    off = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """Per row: id, fp (a hash of its set of five-word shingles) and component_id, the smallest id reachable over links of texts whose
    sets have a Jaccard similarity as asked or more.

    Every such pair is found and compared or already connected, up to collisions of 64-bit hashes and pairs beyond MARGIN_BITS. Texts
    of fewer than five words are one shingle; null texts and texts without words have the empty set and are one component. Rows
    with a null id are returned, join components and never name one. Copies and repeated rows are all returned and compared once.
    Texts of any length count whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    frequent, rank = _frequent(docs, text_col)

    def run(batches):
        hold("simhash")
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            bits = [_majority(s, 4) for s in sets]
            prefixes = [_prefix(s, similarity, frequent, rank) for s in sets]
            keys, sizes = pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            words = [pa.array([r[i] for r in bits], pa.int64()) for i in range(4)]
            counts = [pa.array(c) for c in np.array([set_counts(s) for s in sets], np.int64).reshape(len(sets), len(_COUNTS)).T.copy()]
            odd = [pa.array(c) for c in np.array([set_parity(s) for s in sets], np.int64).reshape(len(sets), len(_PARITY)).T.copy()]
            cells = [_lists([p[i] for p in prefixes]) for i in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), keys, sizes, *words, *counts, *odd, *cells], ["id", "place", "fp", *_OWN, "cells", "common"])

    longs = [T.StructField(n, T.LongType()) for n in ("place", "fp", *_OWN)]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("cells", "common")]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *longs, *lists])
    # A row's place is a hash of its id and text: of each set one place tells where its text is read again.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    fps = shared_table(spark, texts.mapInArrow(run, schema), "set-fps")
    per_set = fps.groupBy("fp").agg(
        F.min(_present("id", fps)).alias("rep"), F.min("place").alias("place"), *[F.first(c).alias(c) for c in (*_OWN, "cells", "common")]
    )
    distinct = shared_table(spark, per_set, "set-distinct")
    linked = _linked_sets(spark, _set_cells(distinct), distinct, texts.select("text", "place"), similarity)
    return _named(fps.select("id", "fp"), distinct.select("fp", "rep"), linked, id_col)


def _least(seed: int):
    """What a cell is merged by: the least of its members in the order of a hash."""
    return F.min(F.xxhash64("fp", F.lit(seed)))


def _merged(members: DataFrame, seed: int) -> DataFrame:
    """(cell, fp) with the cells of one least member made one; the least ones are combined before the shuffle."""
    return members.join(members.groupBy("cell").agg(_least(seed).alias("least")), "cell").select(F.col("least").alias("cell"), "fp").distinct()


def _set_cells(distinct: DataFrame) -> DataFrame:
    """(cell, fp, pick) of the cells to compare in; pick numbers a set's cells in the order of a hash.

    Near copies share their cells by the dozen, with members that differ a little, and a pair would be met in each. So cells with the same
    least member, in the order of a hash, become one that has the members of all: two cells agree in it with a chance equal to the share of
    members that they have in common, so those of one group merge and those of strangers do not. Merged cells merge once more by
    another hash. No pair that shared a cell is lost. A cell that is not frequent is small, which the sample shows, and a window sees it
    whole; those of one member go. Frequent cells can hold any share of the rows.
    """
    of_cell = Window.partitionBy("cell")
    rare = distinct.select("fp", F.explode("cells").alias("cell"))
    rare = rare.select("fp", F.min("fp").over(of_cell).alias("low"), F.max("fp").over(of_cell).alias("high"), _least(0).over(of_cell).alias("cell"))
    rare = rare.filter("low < high").select("cell", "fp").distinct()
    members = _merged(rare.union(_merged(distinct.select(F.explode("common").alias("cell"), "fp"), 0)).distinct(), 1)
    return members.withColumn("pick", F.row_number().over(Window.partitionBy("fp").orderBy(F.xxhash64("cell"), "cell")))


def _linked_sets(spark: SparkSession, cells: DataFrame, distinct: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the components of sets.

    A round compares the centres of each cell with all its members of other components. In small cells all are centres, larger ones have
    a few, chosen by a hash. In the first rounds a set takes part in one or two of its cells: near copies share most of
    theirs, so large groups contract before their members meet in all of them. In whole rounds centres then leave their cells, and the rounds
    go on until no cell holds two components. What a cell needs (its size, whether it holds two components) comes from
    aggregates that are combined before the shuffle, and members meet centres in a join that can be split, so no task sees a whole
    cell. The conditions stand in the join, which gives few pairs but links.
    """
    cells = first = shared_table(spark, cells, "set-cells")
    live = roots = None
    own = distinct.select(F.col("fp").alias("_fp"), *_OWN)
    rounds = chain(FIRST_ROUNDS, ((None, CENTRES * CENTRES_GROW**i, SMALL_CELL) for i in count()))
    for turn, (picks, wanted, small) in enumerate(rounds):
        part = cells if picks is None else cells.filter(F.col("pick") <= picks)
        named = part.withColumn("root", F.col("fp")) if roots is None else part.join(roots, part.fp == roots.node, "left").select("cell", "fp", F.coalesce("root", "fp").alias("root"))
        draw = F.xxhash64("fp", F.lit(turn))
        facts = named.groupBy("cell").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.min(F.struct(draw.alias("draw"), "fp")).alias("first")
        ).filter("low < high")
        chosen = (F.col("members") <= small) | (F.col("fp") == F.col("first.fp")) | (F.pmod(draw, F.col("members")) < wanted)
        open_ = named.join(facts, "cell").select("cell", "fp", "root", chosen.alias("centre"))
        last, live = live, shared_table(spark, open_.join(own, F.col("fp") == F.col("_fp")).drop("_fp"), "set-members")
        discard(last)
        if live.isEmpty():
            if picks is None:
                break
            continue
        x, y = live.filter("centre").alias("x"), live.alias("y")
        differing = lambda names: sum((F.bit_count(F.col(f"x.{n}").bitwiseXOR(F.col(f"y.{n}"))) for n in names), F.lit(0))
        most = (1 - similarity) / (1 + similarity) * (F.col("x.n") + F.col("y.n")) + 1e-9
        asked = x.join(y, F.col("x.cell") == F.col("y.cell")).filter(
            (F.col("x.root") != F.col("y.root")) & (~F.col("y.centre") | (F.col("x.fp") < F.col("y.fp")))
            & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9)
            & (differing(_WIDE) <= similar_bits(similarity) + MARGIN_BITS)
            & (differing(_COUNTS) <= most) & (differing(_PARITY) <= most)
        )
        near = shared_table(spark, asked.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct(), "set-near")
        if not near.isEmpty():
            found, sets = _similar_pairs(spark, near, distinct, texts, similarity)
            old, roots = roots, components(spark, found if roots is None else found.union(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
            discard(old, sets)
        discard(near)
        if picks is None:
            cells = live.filter("not centre").select("cell", "fp")
    discard(live, first)
    return spark.createDataFrame([], "node long, root long") if roots is None else roots


def _similar_pairs(spark: SparkSession, near: DataFrame, distinct: DataFrame, texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) whose sets are as similar as asked, and the table of sets that they are verified on, made again from the texts."""
    asked = near.select(F.col("a").alias("fp")).union(near.select("b")).distinct().join(distinct.select("fp", "place"), "fp")

    def run(batches):
        hold("simhash")
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            keep = [i for i, (s, fp) in enumerate(zip(sets, b.column(0).to_pylist())) if _set_key(s) == fp]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), _lists([sets[i] for i in keep])], ["fp", "grams"])

    sets = texts.join(asked, "place").select("fp", "text").mapInArrow(run, "fp long, grams array<long>")
    sets = shared_table(spark, sets.groupBy("fp").agg(F.first("grams").alias("grams")), "sets")
    both = near.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.filter(F.col("common") / (F.col("n") + F.col("m") - F.col("common")) >= similarity).select("a", "b"), sets


def _named(fps: DataFrame, distinct: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    """Every row's id and fp with the smallest id of its component."""
    rooted = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_fp = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(per_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed long. One pass, no shuffle."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _embedded(fp):
    """Popcounts of the 32 two-bit segments in unary, two bits each: the number of differing bits of two
    such words is the Manhattan distance of the vectors."""
    even = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def links(distinct: DataFrame, max_bits: int = 2, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(a, b) with a < b: pairs of distinct fingerprints within max_bits bits.

    Within cells of more than cell_limit members the pairs are a star per cleared pattern instead of all pairs;
    the connected components are the same.
    """
    if not 0 <= max_bits < GROUPS:
        raise ValueError(f"max_bits is 0 to {GROUPS - 1}")
    width = 64 // GROUPS
    masks = [_long(sum(((1 << width) - 1) << (width * g) for g in choice)) for choice in combinations(range(GROUPS), GROUPS - max_bits)]
    cells = distinct.select("fp", _embedded(F.col("fp")).alias("u")).select(
        "fp", "u", F.posexplode(F.array(*[F.col("u").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell")
    )
    hot = cells.groupBy("grid", "cell").agg(F.count("*").alias("members")).filter(F.col("members") > cell_limit).drop("members")
    cold = cells.join(hot, ["grid", "cell"], "left_anti")
    x = cold.select("grid", "cell", F.col("fp").alias("a"), F.col("u").alias("ua"))
    y = cold.select("grid", "cell", F.col("fp").alias("b"), F.col("u").alias("ub"))
    pairs = x.join(y, ["grid", "cell"]).filter(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("ua").bitwiseXOR(F.col("ub"))) <= max_bits)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    ).select("a", "b")
    clears = [_long(~sum(1 << i for i in bits) & ((1 << 64) - 1)) for bits in combinations(range(64), max_bits)]
    crowded = (
        cells.join(hot, ["grid", "cell"], "left_semi").select("fp").distinct()
        .select("fp", F.posexplode(F.array(*[F.lit(m) for m in clears])).alias("pattern", "mask"))
        .select("fp", "pattern", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    )
    stars = crowded.join(crowded.groupBy("pattern", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1"), ["pattern", "rest"]).filter("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of the edges (a < b).

    Alternates large-star and small-star steps until the edges stay the same; each round is a
    min aggregation (combined before the shuffle) and a join, and is written to the shared folder.
    """
    edges = shared_table(spark, edges.select("a", "b").distinct(), "edges")

    def signature(e):
        r = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.sum(F.expr("xxhash64(b, a) & 1048575")).alias("s")).first()
        return tuple(r)

    seen = signature(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        old, edges = edges, shared_table(spark, small, "edges")
        discard(old)
        now = signature(edges)
        if now == seen:
            break
        seen = now
    found = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    found.shared_path = edges.shared_path
    return found


def _present(name: str, df: DataFrame):
    """The column, null where it is a struct whose first field is null (min skips nulls)."""
    kind = df.schema[name].dataType
    return F.when(F.col(f"{name}.{kind.names[0]}").isNotNull(), F.col(name)) if hasattr(kind, "names") else F.col(name)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Per row: id, fp (signed long) and component_id, the smallest id reachable over links of at most max_bits bits.

    Null texts and texts without words have fingerprint 0 and are linked like any other. Rows with a null id are
    returned, join components, and never name one (component_id is null if a component has no id at all).
    Repeated rows are all returned. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    fps = shared_table(spark, fingerprints(docs, id_col, text_col), "fps")
    distinct = fps.groupBy("fp").agg(F.min(_present("id", fps)).alias("rep"))
    linked = components(spark, links(distinct, max_bits, cell_limit))
    return _named(fps, distinct, linked, id_col)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouped=simhash_components) -> DataFrame:
    """One row of each component, with the input's columns: that of the smallest id, one of its repetitions. grouped:
    `simhash_components` or `similar_components`.

    Rows without an id stay only where their component has no id at all.
    """
    key, place = fresh(docs, "_key", "_place")
    found = grouped(docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))), key, text_col)
    stays = found.filter(F.col("component_id").isNull() | (F.col(key) == F.col("component_id")))
    stays = stays.select(F.xxhash64(f"{key}.id", f"{key}.hash").alias(place)).distinct()
    # One key of 64 bits, so that the join and the removal of repetitions share one shuffle of the texts.
    marked = docs.withColumn(place, F.xxhash64(F.col(id_col), F.xxhash64(text_col)))
    return marked.join(stays, place).dropDuplicates([place]).select(*docs.columns)
