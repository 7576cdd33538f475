"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled rows. Its entries are whole words or stems (a prefix of longer words), each with a
weight. Words near an entry that clean texts of the sample use are not taken for misspellings. A word of a text is matched by walking the trie and a Levenshtein automaton of the word together: a state of the
automaton is the row of edit distances, and a branch of the trie is left once the whole row is beyond the limit.
So misspelled terms are caught without comparing a word with every entry.

A hit counts in full in a plain context and for less in a context of quotation: quotation marks around it, or words of
reporting, within CONTEXT words. A document's score is a logistic function of its hits' weights and their share.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, gram_hashes, hash_words, hold, prepare, shared_table

#: Labelled rows that the lexicon and the score are fitted on, at most (half of each label where there are as many).
SAMPLE_ROWS = 4000
#: Entries of the lexicon, at most.
LEXICON = 400
#: Words of clean texts near an entry that are kept as correctly spelled, at most.
SPELLED = 5000
#: Lengths of stems, in characters.
STEMS = (4, 5, 6)
#: Toxic documents of the sample that an entry occurs in, at least: this many, and this share of them. Copies count once.
SUPPORT, SUPPORT_SHARE = 4, 0.02
#: Smoothed log-odds of an entry, at least.
LOG_ODDS = 3.0
#: From this length on a term may have one wrong letter.
FUZZY_FROM = 5
#: Words to each side that make a hit's context, and what a hit counts there if it is quoted.
CONTEXT = 6
QUOTED = 0.25
#: Distinct words whose matches a worker remembers.
CACHE_WORDS = 200_000
#: Quotation marks, and words of reporting in the four languages.
_MARKS = "\"'`«»‘’‚“”„"
_REPORTING = {"said", "says", "quote", "quoted", "called", "wrote", "term", "word", "sagte", "zitat", "wort", "dit", "cite", "mot", "dijo", "cita", "palabra"}
_TRIM = _MARKS + ".,;:!?()[]{}<>|/\\*_-"


@dataclass(frozen=True)
class Entry:
    text: str
    stem: bool
    weight: float


class Trie:
    def __init__(self, entries: list[Entry]):
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        for e in entries:
            node = 0
            for c in e.text:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.whole):
                    self.children.append({})
                    self.whole.append(0.0)
                    self.stem.append(0.0)
            kind = self.stem if e.stem else self.whole
            kind[node] = max(kind[node], e.weight)
        # One edit leaves the first or the second half of an entry as it is.
        halves = [(e.text[: len(e.text) // 2], e.text[len(e.text) // 2 :]) for e in entries if not e.stem]
        self.heads, self.tails = {a for a, _ in halves}, {b for _, b in halves}
        self.head_sizes, self.tail_sizes = sorted({len(a) for a in self.heads}), sorted({len(b) for b in self.tails})

    def match(self, word: str, fuzzy_from: int = FUZZY_FROM) -> float:
        """The highest weight of an entry that accepts the word, 0 if none."""
        return self.exact(word) or self.fuzzy(word, fuzzy_from)

    def exact(self, word: str) -> float:
        """As `match`, for words as they are: a whole entry accepts itself, a stem words that begin with it."""
        best = 0.0
        node = 0
        for c in word:
            node = self.children[node].get(c, -1)
            if node < 0:
                break
            best = max(best, self.stem[node])
        else:
            best = max(best, self.whole[node])
        return best

    def fuzzy(self, word: str, fuzzy_from: int = FUZZY_FROM) -> float:
        """As `match`, for misspellings: a whole entry of fuzzy_from characters or more accepts words within one edit, which
        costs a fifth of its weight."""
        best = 0.0
        n = len(word)
        if n < fuzzy_from - 1 or not (any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes)):
            return best
        # Rows of edit distances, cut to the band of one edit: positions depth - 1, depth and depth + 1 of the word.
        walk = [(0, 0, (2, 0, 1))]
        while walk:
            node, depth, (_, same, more) = walk.pop()
            low, mid, high = walk_row = (_, same, more)
            if depth >= fuzzy_from and self.whole[node] and -1 <= n - depth <= 1 and walk_row[n - depth + 1] <= 1:
                best = max(best, 0.8 * self.whole[node])
            for c, to in self.children[node].items():
                # The new row's positions are depth, depth + 1 and depth + 2 of the word.
                a = min(mid + 1, low + (depth < 1 or depth > n or word[depth - 1] != c))
                b = min(high + 1, a + 1, mid + (depth >= n or word[depth] != c))
                d = min(b + 1, high + (depth + 1 >= n or word[depth + 1] != c))
                if min(a, b, d) <= 1:
                    walk.append((to, depth + 1, (a, b, d)))
        return best


def tokens(text: str) -> list[str]:
    return text.lower().split()


def bare(token: str) -> str:
    return token.strip(_TRIM)


def features(words: list[str], weights: dict[str, float]) -> tuple[float, float, float]:
    """Weight of the hits in plain context, weight of those in quotation (both with less for each repetition), hits per 100 words."""
    hits = [(i, weights[w]) for i, w in enumerate(words) if weights[w]]
    plain = quoted = 0.0
    seen: dict[str, int] = {}
    for i, weight in hits:
        w = bare(words[i])
        seen[w] = seen.get(w, 0) + 1
        around = words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]
        before = any(t[:1] in _MARKS for t in [*words[max(0, i - CONTEXT) : i], words[i]] if t)
        after = any(t.rstrip(".,;:!?")[-1:] in _MARKS for t in words[i : i + 1 + CONTEXT] if t.rstrip(".,;:!?"))
        if (before and after) or any(bare(t) in _REPORTING for t in around):
            quoted += weight / seen[w]
        else:
            plain += weight / seen[w]
    return plain, quoted, 100.0 * len(hits) / max(1, len(words))


class Scorer:
    def __init__(self, entries: list[Entry], coefficients: tuple[float, ...], spelled: frozenset[str] = frozenset()):
        """spelled: words near an entry that clean texts use, which are no misspellings."""
        self.trie = Trie(entries)
        self.coefficients = coefficients
        self.spelled = spelled
        self.cache: dict[str, float] = {}

    def weigh(self, words: list[str]) -> dict[str, float]:
        distinct = set(words)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in distinct.difference(cache):
            plain = bare(w)
            cache[w] = self.trie.exact(plain) or (0.0 if plain in self.spelled else self.trie.fuzzy(plain))
        return cache

    def features(self, text: str | None) -> tuple[float, float, float]:
        words = tokens(text or "")
        return features(words, self.weigh(words))

    def score(self, text: str | None) -> float:
        plain, quoted, share = self.features(text)
        return _logistic(self.coefficients, plain + QUOTED * quoted, share)


def _logistic(c: tuple[float, ...], weight: float, share: float) -> float:
    z = c[0] + c[1] * math.log1p(weight) + c[2] * math.log1p(share)
    return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def held_out(id_col):
    """True for rows whose crc32 of the id as text is divisible by 5: never learned from."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most SAMPLE_ROWS labelled rows that are not held out: per label the rows of the smallest hashes.
    Of texts with the same smallest hash of five words, which near copies mostly have, one stays."""
    ids = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("_id")))
    ids = ids.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    half = SAMPLE_ROWS // 2
    chosen = None
    for label in (0, 1):
        part = ids.filter(F.col("toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(half)
        chosen = part if chosen is None else chosen.union(part)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")

    def sign(batches):
        for b in batches:
            keys = []
            for text in b.column(1).to_pylist():
                h = gram_hashes(hash_words((text or "").encode("utf-8", "surrogatepass").split()), 5)
                keys.append(int(h.min() >> np.uint64(1)) if len(h) else zlib.crc32((text or "").encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), b.column(1), b.column(2)], ["id", "sign", "text", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    signed = found.select("_id", "text", "toxic").mapInArrow(sign, f"id {kind}, sign long, text string, toxic int")
    return signed.groupBy("sign", "toxic").agg(F.min(F.struct("id", "text")).alias("one")).select("one.text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[Entry], tuple[float, ...], frozenset[str]]:
    """The lexicon, the score's coefficients and the words that only look misspelled, from the labelled sample.
    Without labels of both kinds the lexicon is empty."""
    spark = docs.sparkSession
    prepare(spark)
    sample = shared_table(spark, _sample(docs, labels, id_col, text_col), "toxicity-sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    good, bad = totals.get(0, 0), totals.get(1, 0)
    if not good or not bad:
        return [], (-2.0, 0.0, 0.0), frozenset()

    def count(batches):
        found: dict[tuple[str, bool], list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = {bare(w) for w in tokens(text or "")}
                keys = {(w, False) for w in words if 3 <= len(w) <= 24}
                keys |= {(w[:n], True) for w in words for n in STEMS if len(w) > n}
                for k in keys:
                    found.setdefault(k, [0, 0])[toxic] += 1
        items = list(found.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"term": [k[0] for k, _ in part], "stem": [k[1] for k, _ in part], "good": pa.array([v[0] for _, v in part], pa.int64()), "bad": pa.array([v[1] for _, v in part], pa.int64())})

    counted = sample.mapInArrow(count, "term string, stem boolean, good long, bad long").groupBy("term", "stem").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    support = max(SUPPORT, int(SUPPORT_SHARE * bad))
    best = counted.filter(F.col("bad") >= support).withColumn("odds", odds).filter(F.col("odds") >= LOG_ODDS)
    rows = best.orderBy((F.col("odds") * F.sqrt(F.col("bad"))).desc(), "term", "stem").limit(4 * LEXICON).collect()
    entries: list[Entry] = []
    stems: set[str] = set()
    for r in rows:
        covered = r["stem"] and any(r["term"][:n] in stems for n in STEMS if n <= len(r["term"]))
        if len(entries) < LEXICON and not covered:  # whole words stay beside their stems: they alone take misspellings
            entries.append(Entry(r["term"], r["stem"], float(r["odds"])))
            if r["stem"]:
                stems.add(r["term"])

    def look_alikes(batches):
        trie = Trie(entries)
        for b in batches:
            seen = {bare(w) for text in b.column(0).to_pylist() for w in set(tokens(text or ""))}
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w in seen if not trie.exact(w) and trie.fuzzy(w)], pa.string())})

    words = sample.filter("toxic = 0").select("text").mapInArrow(look_alikes, "word string").groupBy("word").count()
    spelled = frozenset(r["word"] for r in words.orderBy(F.col("count").desc(), "word").limit(SPELLED).collect())

    def describe(batches):
        s = Scorer(entries, (0.0, 0.0, 0.0), spelled)
        for b in batches:
            f = [s.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"w": pa.array([math.log1p(p + QUOTED * q) for p, q, _ in f], pa.float64()), "s": pa.array([math.log1p(x) for _, _, x in f], pa.float64()), "y": b.column(1)})

    fitted = sample.mapInArrow(describe, "w double, s double, y int").collect()
    data = np.array(sorted(tuple(r) for r in fitted))
    return entries, _fit(data[:, :2], data[:, 2], good, bad), spelled


def _fit(x: np.ndarray, y: np.ndarray, good: int, bad: int) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; both labels weigh the same."""
    design = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, 0.5 / bad, 0.5 / good) * len(y)
    c = np.zeros(design.shape[1])
    ridge = np.diag([1e-3] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ c, -30, 30)))
        step = np.linalg.solve((design * (share * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (share * (y - p)) - ridge @ c)
        c = c + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(round(v, 9)) for v in c)


def _scored(docs: DataFrame, model, text_col: str) -> tuple[DataFrame, str]:
    """The rows with their score, and the name of its column."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    text, name = fresh(docs, "_scored_text", "_score")

    def run(batches):
        hold("toxicity")
        s = Scorer(*shared.value)
        for b in batches:
            scores = pa.array([s.score(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], [*b.schema.names[:-1], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.withColumn(text, F.col(text_col)).mapInArrow(run, schema), name


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if the score is at least 0.5).

    One pass over the whole texts after learning; no shuffle. Null and empty texts get the score of a text without hits. A null
    id counts as the empty text in held_out. Of repeated labels of an id the toxic one counts. Without labels every score
    is the same and below 0.5. An empty table gives an empty result.
    """
    model = learn(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored, name = _scored(rows, model, "text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with the input's columns. Null and empty texts score as texts without hits; null ids, repeated
    rows and extra columns change nothing. Without labels, and on an empty table, nothing goes."""
    scored, name = _scored(docs, learn(docs, labels), "text")
    return scored.filter(F.col(name) < 0.5).drop(name)
