"""Substring dedup with suffix automata of reference shards.

Words are the symbols. A suffix automaton accepts every run of words of its reference texts, and each state carries the smallest
document in which its runs occur. A document is streamed through: the automaton's state after each word is the longest
run ending there that the reference holds (the matching statistic). Where it reaches the threshold and the state's smallest
document is before the streamed one, the words of the run are removed; adjoining runs make maximal spans.

A reference of bounded size is broadcast whole, as one automaton per shard (`remove_reference_spans`). A corpus as its own
reference has no such bound, so its shards are cut by content and what needs a shard is sent to it (`dedup`):

* Each window of `threshold` words has a key, the smallest hash of the GRAM-word runs inside it, so equal windows have equal keys. A
  maximal run of windows of one key is a segment. Segments go to the shard of their key; equal segments of a block
  of documents go once, with their smallest document.
* A shard drops keys that only one document has, builds the automaton of the other segments and streams these through it. It answers each
  block with the smallest document of each window.
* The block's documents, which wait in the same shuffle, meet the answers. Nothing is joined by document or by key, so
  a passage in every document costs one entry a block.
* Keys that are common in a bounded sample would gather many different segments in one shard. Their windows are sent one by one,
  by a hash of the whole window. The sample decides the route only, for all blocks alike; any choice gives the same result.

Blocks and shards grow in number, not in size, with the input's bytes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_offsets, fresh, gram_hashes, hash_words, hold, prepare, release, sliding_min

THRESHOLD = 13
GRAM = 5
#: Text bytes of a block of documents, and blocks per shard.
BLOCK_BYTES = 4 << 20
SHARDS_PER_BLOCK = 2
#: Documents in the sample that chooses routes, and different segments of a key in it from which its windows go one by one.
ROUTE_SAMPLE = 2000
ROUTE_SEGMENTS = 12
#: Bytes of a reference that may be broadcast, and words of one of its shards.
BROADCAST_BYTES = 32 << 20
SHARD_WORDS = 200_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """Suffix automaton of many sequences of integers; each state knows the smallest owner of its runs."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner: list[int] = [1 << 62]

    def add(self, symbols: list[int], owner: int) -> None:
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        last = 0
        for c in symbols:
            to = nxt[last].get(c)
            if to is not None:
                if length[to] != length[last] + 1:
                    to = self._split(last, c, to)
                if owner < own[to]:
                    own[to] = owner
                last = to
                continue
            new = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            own.append(owner)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the runs that reach it through p, which are shorter than its longest."""
        nxt, link = self.next, self.link
        new = len(self.length)
        nxt.append(nxt[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.owner.append(1 << 62)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def close(self) -> None:
        """Give every state the smallest owner of the states whose suffixes it holds, longest first."""
        link, own = self.link, self.owner
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if own[v] < own[link[v]]:
                own[link[v]] = own[v]

    def stream(self, symbols: list[int], threshold: int) -> list[int]:
        """For each window of `threshold` symbols the smallest owner that holds it, 1 << 62 if none.

        The match is cut to the threshold as soon as it is longer, so the state is the window's own.
        """
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        out: list[int] = []
        state = matched = 0
        for i, c in enumerate(symbols):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(c)
            if to is not None:
                state = to
                matched += 1
                if matched >= threshold:
                    matched = threshold
                    while length[link[state]] >= threshold:
                        state = link[state]
            if i >= threshold - 1:
                out.append(own[state] if matched == threshold else 1 << 62)
        return out


def _wrap(batches):
    """The rows of each block in a batch as one compressed value: a shuffle then moves a few large rows."""
    for b in batches:
        block = b.column(b.num_columns - 1).to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        parts = np.split(order, cuts) if len(order) else []
        values = []
        for part in parts:
            sink = pa.BufferOutputStream()
            rows = b.take(pa.array(part))
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
                writer.write_batch(rows)
            values.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_pydict({"_block": pa.array([int(block[p[0]]) for p in parts], pa.int32()), "rows": pa.array(values, pa.binary())})


def _unwrap(column) -> pa.Table:
    """The rows of wrapped values. Whoever numbers them sorts first: the values' order is that of a shuffle."""
    return pa.concat_tables([pa.ipc.open_stream(v.as_buffer()).read_all() for v in column])


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _window_keys(words: list[bytes], threshold: int, hot: np.ndarray) -> np.ndarray:
    h = hash_words(words)
    gram = min(GRAM, threshold)
    keys = sliding_min(gram_hashes(h, gram), threshold - gram + 1)
    if len(hot):
        common = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
        if common.any():
            keys = np.where(common, gram_hashes(h, threshold), keys)
    return keys


class Block:
    """Segments of some documents, numbered in the order of (id, text), which no shuffle changes."""

    def __init__(self, ids: list, texts: list, threshold: int, hot: np.ndarray):
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        order = sorted((i for i in range(len(ids)) if ids[i] is not None and len(self.words[i]) >= threshold), key=lambda i: (ids[i], texts[i]))
        index: dict[bytes, int] = {}
        keys: list[np.ndarray] = []
        first: list[int] = []
        several: list[bool] = []
        counts: list[int] = []
        self.placed: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i in order:
            words, doc = self.words[i], ids[i]
            k = _window_keys(words, threshold, hot)
            start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            end = np.append(start[1:], len(k)) + threshold - 1
            off = byte_offsets(words)
            text = b" ".join(words)
            a, b = off[start].tolist(), (off[end] - 1).tolist()
            at = []
            fresh = []
            for j in range(len(a)):
                seg = text[a[j] : b[j]]
                n = index.setdefault(seg, len(index))
                if n == len(first):
                    first.append(doc)
                    several.append(False)
                    fresh.append(j)
                elif first[n] != doc:
                    several[n] = True
                at.append(n)
            if fresh:
                keys.append(k[start[fresh]])
                counts += (end - start - threshold + 1)[fresh].tolist()
            self.placed.append((i, np.array(at, np.int64), start))
        self.segments = list(index)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.first = np.array(first, np.int64)
        self.several = np.array(several, bool)
        self.counts = np.array(counts, np.int64)

    def by_shard(self, shards: int):
        """(shard, its segments' numbers in ascending order)."""
        shard = (self.keys % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            yield int(shard[part[0]]), part


def _send(block: Block, number: int, shards: int) -> pa.Table:
    rows = []
    for shard, part in block.by_shard(shards):
        tags = ((block.keys[part] >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)) | block.several[part].astype(np.uint32)
        meta = tags.tobytes() + block.first[part].tobytes()
        rows.append((shard, number, len(part), _pack(meta), _pack(b"\n".join([block.segments[j] for j in part.tolist()]))))
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "block", "n", "meta", "segments"])


def _answer(table: pa.Table, threshold: int) -> pa.Table:
    """One shard: which segments hold windows of more than one document, and the smallest document of their windows."""
    sizes = np.array(table["n"].to_pylist(), np.int64)
    tags, docs = [], []
    for n, meta in zip(sizes.tolist(), table["meta"]):
        raw = _unpack(meta.as_py())
        tags.append(np.frombuffer(raw, np.uint32, n))
        docs.append(np.frombuffer(raw, np.int64, n, 4 * n))
    tags, docs = np.concatenate(tags), np.concatenate(docs)
    keys, several = tags >> np.uint32(1), (tags & np.uint32(1)).astype(bool)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
    shared = (np.minimum.reduceat(docs[order], starts) != np.maximum.reduceat(docs[order], starts)) | np.logical_or.reduceat(several[order], starts)
    wanted = np.empty(len(keys), bool)
    wanted[order] = np.repeat(shared, np.diff(np.append(starts, len(keys))))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    entries: list[tuple[int, np.ndarray, list[bytes]]] = []
    owners: dict[bytes, int] = {}
    for r in range(len(sizes)):
        at = np.flatnonzero(wanted[bounds[r] : bounds[r + 1]])
        if not len(at):
            continue
        every = _unpack(table["segments"][r].as_py()).split(b"\n")
        picked = [every[j] for j in at.tolist()]
        for seg, doc in zip(picked, docs[bounds[r] + at].tolist()):
            if doc < owners.get(seg, 1 << 62):
                owners[seg] = doc
        entries.append((r, at, picked))
    symbols: dict[bytes, int] = {}
    coded = {seg: [symbols.setdefault(w, len(symbols)) for w in seg.split()] for seg in owners}
    automaton = SuffixAutomaton()
    for seg, doc in owners.items():
        automaton.add(coded[seg], doc)
    automaton.close()
    found = {seg: automaton.stream(s, threshold) for seg, s in coded.items()}
    lowest = {seg: min(x) for seg, x in found.items()}
    rows = []
    for r, at, picked in entries:
        base = bounds[r]
        keep = [(j, seg) for j, seg in zip(at.tolist(), picked) if several[base + j] or lowest[seg] < docs[base + j]]
        if keep:
            where = np.array([j for j, _ in keep], np.int32)
            least = np.array([x for _, seg in keep for x in found[seg]], np.int64)
            rows.append((table["block"][r].as_py(), table["shard"][r].as_py(), _pack(where.tobytes()), _pack(least.tobytes())))
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "shard", "places", "least"])


def _covered(block: Block, ids: list, answers: pa.Table, threshold: int, shards: int) -> dict[int, np.ndarray]:
    """Per document with something to remove: a flag for each of its words."""
    ends = np.concatenate(([0], np.cumsum(block.counts)))
    least = np.full(ends[-1], 1 << 62, np.int64)
    answered = np.zeros(len(block.counts), bool)
    parts = dict(block.by_shard(shards)) if answers.num_rows else {}
    for r in range(answers.num_rows):
        segs = parts[answers["shard"][r].as_py()][np.frombuffer(_unpack(answers["places"][r].as_py()), np.int32)]
        values = np.frombuffer(_unpack(answers["least"][r].as_py()), np.int64)
        answered[segs] = True
        n = block.counts[segs]
        at = np.repeat(ends[segs] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        least[at] = values
    out = {}
    for i, segs, starts in block.placed:
        hit = np.flatnonzero(answered[segs])
        if not len(hit):
            continue
        n = block.counts[segs[hit]]
        within = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        at = np.repeat(ends[segs[hit]], n) + within
        windows = (np.repeat(starts[hit], n) + within)[least[at] < ids[i]]
        if len(windows):
            steps = np.zeros(len(block.words[i]) + 1, np.int64)
            np.add.at(steps, windows, 1)
            np.add.at(steps, windows + threshold, -1)
            out[i] = np.cumsum(steps[:-1]) > 0
    return out


def cut(text: str, removed: np.ndarray) -> str:
    """The text without the removed words; each removed span goes with the white space after it."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(data)]
    out = [data[: spans[0][0]]] if spans else [data]
    for i, (a, _) in enumerate(spans):
        if not removed[i]:
            out.append(data[a : spans[i + 1][0] if i + 1 < len(spans) else len(data)])
    return b"".join(out).decode("utf-8", "surrogatepass").rstrip("\x20\t\n\x0b\x0c\r") if removed.any() else text


def _routes(docs: DataFrame, rows: int, threshold: int) -> np.ndarray:
    """Keys whose windows go one by one, from about ROUTE_SAMPLE documents chosen by a hash of the id."""
    every = max(1, rows // ROUTE_SAMPLE)

    def run(batches):
        for b in batches:
            block = Block(b.column(0).to_pylist(), b.column(1).to_pylist(), threshold, np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(block.keys.view(np.int64))], ["key"])

    sample = docs.select(F.col("_id"), F.col("_text")).filter(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(every)) == 0)
    common = sample.mapInArrow(run, "key long").groupBy("key").count().filter(F.col("count") >= ROUTE_SEGMENTS)
    keys = [r["key"] for r in common.orderBy(F.col("count").desc(), "key").limit(100_000).collect()]
    return np.sort(np.array(keys, np.int64).view(np.uint64))


def _blocks(docs: DataFrame, id_col: str, text_col: str, threshold: int, schema, finish) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    names = docs.columns
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    blocks = max(1, -(-(size["b"] or 0) // BLOCK_BYTES))
    shards = SHARDS_PER_BLOCK * blocks
    hot = _routes(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), size["n"], threshold)
    (number,) = fresh(docs, "_block")
    numbered = docs.withColumn(number, F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int"))
    waiting = numbered.mapInArrow(_wrap, "_block int, rows binary").repartition("_block")

    def send(t: pa.Table) -> pa.Table:
        hold("substring")
        release()
        rows = _unwrap(t["rows"])
        return _send(Block(rows[id_col].to_pylist(), rows[text_col].to_pylist(), threshold, hot), t["_block"][0].as_py(), shards)

    def answer(t: pa.Table) -> pa.Table:
        release()
        return _answer(t, threshold)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        left = _unwrap(left["rows"]).select(names)
        ids = left[id_col].to_pylist()
        block = Block(ids, left[text_col].to_pylist(), threshold, hot)
        return finish(left, block, _covered(block, ids, right, threshold, shards))

    sent = waiting.groupBy("_block").applyInArrow(send, "shard int, block int, n int, meta binary, segments binary")
    answers = sent.groupBy("shard").applyInArrow(answer, "block int, shard int, places binary, least binary")
    return waiting.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a window of `threshold` words over it also starts in a document of a smaller id; windows are judged on the input.
    Null texts have no words. Rows with a null id are not in the order of ids: they lose nothing and take nothing from
    others. Rows of one id take nothing from each other. An empty table gives an empty result.
    """

    def finish(left: pa.Table, block: Block, covered: dict[int, np.ndarray]) -> pa.Table:
        n, removed, digest = [], [], []
        for i, words in enumerate(block.words):
            gone = covered.get(i)
            kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
            n.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table([left[id_col].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _blocks(docs.select(id_col, text_col), id_col, text_col, threshold, "doc_id long, n_words long, n_removed long, kept_sha256 string", finish)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows with repeated spans cut from their texts. Texts without such spans stay as they are; rows that had words and
    have none left are not returned. See `dedup_digests` for nulls and ties."""
    columns = docs.columns
    schema = docs.schema

    def finish(left: pa.Table, block: Block, covered: dict[int, np.ndarray]) -> pa.Table:
        texts = left[text_col].to_pylist()
        keep = np.ones(len(texts), bool)
        for i, gone in covered.items():
            keep[i] = not gone.all()
            texts[i] = cut(texts[i], gone)
        where = left.schema.get_field_index(text_col)
        t = left.select(columns).set_column(where, text_col, pa.array(texts, left.schema.field(text_col).type))
        return t.filter(pa.array(keep))

    return _blocks(docs, id_col, text_col, threshold, schema, finish)


def remove_reference_spans(docs: DataFrame, references: DataFrame, text_col: str = "text", ref_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows with all spans cut that also stand in the references, a table of at most BROADCAST_BYTES of text.

    The references become one automaton per shard of SHARD_WORDS words, broadcast; documents stream through all of them. A larger
    reference raises ValueError: use `dedup` on the union, with the references' ids first. Null texts, on either side, hold no spans; ties
    and repeated rows are cut alike, texts of any length whole, and other columns pass through. Empty tables give the documents as they are.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = references.agg(F.sum(F.octet_length(ref_col))).first()[0] or 0
    if size > BROADCAST_BYTES:
        raise ValueError(f"the references have {size} bytes of text; {BROADCAST_BYTES} can be broadcast")
    texts = sorted(r[0].encode("utf-8", "surrogatepass").split() for r in references.select(ref_col).filter(F.col(ref_col).isNotNull()).collect())
    shared = spark.sparkContext.broadcast(texts)
    schema = docs.schema

    def run(batches):
        symbols: dict[bytes, int] = {}
        shards = [SuffixAutomaton()]
        held = 0
        for words in shared.value:
            if held > SHARD_WORDS:
                shards.append(SuffixAutomaton())
                held = 0
            shards[-1].add([symbols.setdefault(w, len(symbols)) for w in words], -1)
            held += len(words)
        for s in shards:
            s.close()
        for b in batches:
            where = b.schema.get_field_index(text_col)
            out = []
            for text in b.column(where).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                coded = [symbols.get(w, -1) for w in words]
                steps = np.zeros(len(words) + 1, np.int64)
                for s in shards:
                    hit = np.flatnonzero(np.array(s.stream(coded, threshold), np.int64) < 1 << 62)
                    np.add.at(steps, hit, 1)
                    np.add.at(steps, hit + threshold, -1)
                gone = np.cumsum(steps[:-1]) > 0
                out.append(cut(text, gone) if gone.any() else text)
            columns = list(b.columns)
            columns[where] = pa.array(out, b.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, schema)
