"""Training-data operators against brute force, with nulls, ties, repeated rows, empty tables and odd columns."""

import hashlib
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import bpe, exact_topk, license, lsh_forest, mixing, queries, sharding, simhash, substring, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return (t or "").encode().split()


def corpus(n=120, seed=1):
    """Documents with copies, near copies, shared passages, nulls, empty texts, repeated rows and one long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(60)]
    make = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passages = [make(r.randint(13, 60)) for _ in range(4)]
    texts = [None, "", "  \n ", "one", "same words here", "same words here"]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.25 and len(texts) > 8:
            t = r.choice(texts[6:])
            parts = t.split()
            if parts and kind > 0.1:
                parts[r.randrange(len(parts))] = r.choice(vocabulary)
                t = " ".join(parts)
            texts.append(t)
        elif kind < 0.6:
            texts.append(make(r.randint(0, 30)) + "\n" + r.choice(passages) + "\t" + make(r.randint(0, 30)))
        else:
            texts.append(make(r.randint(1, 80)))
    texts.append(make(4000) + " " + passages[0])
    return [(i, t, "en", r.choice(["s1", "s2", "s2", "s2", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- 1: substring dedup


def brute_substring(rows, threshold=13):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - threshold + 1):
            g = tuple(w[k : k + threshold])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - threshold + 1):
            if first[tuple(w[k : k + threshold])] < i:
                gone[k : k + threshold] = [True] * threshold
        out[i] = (len(w), [x for x, g in zip(w, gone) if not g])
    return out


@pytest.mark.parametrize("block,route", [(4 << 20, 12), (2000, 12), (2000, 1)])
def test_substring_equals_brute_force(docs, rows, monkeypatch, block, route):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "ROUTE_SEGMENTS", route)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_digests(docs).collect()}
    want = {i: (n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, (n, k) in brute_substring(rows).items()}
    assert got == want


def test_substring_texts(docs, rows, empty):
    kept = {r.doc_id: r.text for r in substring.dedup(docs).collect()}
    for i, (n, k) in brute_substring(rows).items():
        if n and not k:
            assert i not in kept
        elif n == len(k):
            assert kept[i] == rows[i][1]
        else:
            assert words(kept[i]) == k
    assert substring.dedup_digests(empty).count() == 0 and substring.dedup(empty).columns == empty.columns


def test_substring_null_and_repeated_ids(spark):
    t = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (9, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring.dedup_digests(df).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (9, 20)]


def test_reference_spans(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 10)
    ref = spark.createDataFrame([(" ".join(map(str, range(30))),), (" ".join(map(str, range(100, 120))),), (None,)], "text string")
    df = spark.createDataFrame([(1, "x " + " ".join(map(str, range(5, 25))) + " y"), (2, "a b\nc"), (3, None), (4, " ".join(map(str, range(12))))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.remove_reference_spans(df, ref).collect()}
    assert got == {1: "x y", 2: "a b\nc", 3: None, 4: " ".join(map(str, range(12)))}


def test_automaton_statistics():
    r = random.Random(2)
    for _ in range(30):
        refs = [([r.randrange(3) for _ in range(r.randint(1, 25))], d) for d in range(6)]
        a = substring.SuffixAutomaton()
        for s, d in refs:
            a.add(s, d)
        a.close()
        text = [r.randrange(4) for _ in range(60)]
        for k in (1, 3, 5):
            want = [min((d for s, d in refs if any(s[j : j + k] == text[i : i + k] for j in range(len(s) - k + 1))), default=1 << 62) for i in range(len(text) - k + 1)]
            assert a.stream(text, k) == want


# ---- 2: mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    budget, full = sum(sizes.values()), set()
    while True:
        rest = budget - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * rest > 3 * sizes[s] * total]
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * rest / total for s in names}
        full |= set(over)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    by = {r[0]: r for r in rows}
    taken = {}
    for r in got:
        assert r["size"] == len(words(by[r.doc_id][1])) and r.source_size == sizes[by[r.doc_id][3]]
        assert r.target == pytest.approx(want[by[r.doc_id][3]]) and r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[by[r.doc_id][3]] = taken.get(by[r.doc_id][3], 0) + r.taken
    longest = max(len(words(t)) for _, t, *_ in rows)
    assert sum(taken.values()) <= sum(sizes.values()) and sum(taken.values()) > sum(sizes.values()) - longest
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def brute_mix(rows):
    """(doc_id, size, taken) of each row of (doc_id, size, source), by sorting all copies by their finish time in one list."""
    sizes, numbers, queues = {}, {}, {}
    for i, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
        nth = numbers[i, s, n] = numbers.get((i, s, n), -1) + 1
        key = hashlib.md5(f"{'' if i is None else i}:{n}:{nth}".encode()).hexdigest()
        queues.setdefault(s, []).append((key, -1 if i is None else i, n, nth))
    goal, budget = brute_targets(sizes), sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    served = []
    for rank, s in enumerate(names):
        queue = sorted(queues[s])
        for copy in range(3):
            upto = copy * sizes[s]
            for entry in queue:
                upto += entry[2]
                if goal[s]:
                    served.append((upto / goal[s], rank, *entry, copy, s))
    taken = {(s, *entry): 0 for s in queues for entry in queues[s]}
    total = 0
    for x in sorted(served, key=lambda x: x[:-1]):
        total += x[4]
        if total > budget:
            break
        taken[x[-1], x[2], x[3], x[4], x[5]] += x[4]
    return sorted((k[2], k[3], v) for k, v in taken.items())


@pytest.mark.parametrize("ranges", [1 << 12, 2])
def test_mixing_equals_brute_force(spark, docs, rows, monkeypatch, ranges):
    """All rows of a source together, then wide ranges of the finish time, so that many rows meet at the cut. One row stands thousands of
    times, null ids, null and empty texts among them."""
    from quern.llm import common

    monkeypatch.setattr(mixing, "COARSE", ranges)
    monkeypatch.setattr(mixing, "FINE", 8 * ranges if ranges == 2 else 1 << 24)
    monkeypatch.setattr(common, "NUMBERED", 512)
    monkeypatch.setattr(mixing, "NUMBERED", 512)
    more = [(7, "a b c", "en", "s1", 0)] * 1500 + [(1, "", "en", "a", 0)] * 700 + [(None, None, "en", None, 0)] * 500 + [(None, "x y", "en", "s2", 0)] * 300
    every = rows + more
    df = spark.createDataFrame(every, DOC).repartition(4)
    got = mixing.mix(df).collect()
    assert all(0 <= r["copies"] <= 3 for r in got)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.taken) for r in got) == brute_mix([(i, len(words(t)), s) for i, t, _, s, _ in every])
    out = mixing.mixed_documents(df)
    want = {}
    for r in got:
        want[r.doc_id, r["size"], r.source] = want.get((r.doc_id, r["size"], r.source), 0) + r["copies"]
    seen = {}
    for r in out.collect():
        seen[r.doc_id, len(words(r.text)), r.source] = seen.get((r.doc_id, len(words(r.text)), r.source), 0) + 1
    assert seen == {k: n for k, n in want.items() if n}


def test_mixing_near_targets(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), "en", f"s{i % 4}", 0) for i in range(2000)], DOC)
    by = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 10 for r in by)


def test_mixed_documents(docs, rows):
    copies = {r.doc_id: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        assert r.text == rows[r.doc_id][1]
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: n for i, n in copies.items() if n}


def test_mixing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "x", 0)] * 3 + [(None, "a", "en", None, 0)] * 2, DOC)
    got = mixing.mix(df).collect()
    assert len(got) == 5 and mixing.mixed_documents(df).count() == sum(r["copies"] for r in got)


# ---- 3: BPE


@pytest.fixture(scope="module")
def both():
    library = pytest.importorskip("tokenizers")
    path = tokenizers.path("word_bpe_49k.json")
    return library.Tokenizer.from_file(path), bpe.WordBpe(open(path, encoding="utf-8").read())


def test_bpe_equals_the_library(both):
    theirs, ours = both
    r = random.Random(3)
    alphabet = list("abcdefghi tonesrTHE'sdrem12 ,.!?éüßΣςİ<|>_-\n\t\x0b\x1c\x85\xa0 　日क्षि👍Ⅷﬁ²") + ["<|endoftext|>", "<|startoftext|>", "'re", "'LL", "é"]
    for _ in range(4000):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 25)))
        ids = theirs.encode(s, add_special_tokens=False).ids
        assert ours.encode(s) == ids, s
        text = theirs.decode(ids, skip_special_tokens=False)
        assert ours.decode(ids) == text
        assert ours.digests(s) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_equals_the_library_for_every_character(both):
    """Letters, numbers, spaces, lower case: all assigned code points; composition and order of marks: random runs of all planes."""
    theirs, ours = both
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    spare = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"][::499]
    texts = ["".join(f"a{c}b " for c in (every + spare)[i : i + 32]) for i in range(0, len(every) + len(spare), 32)]
    r = random.Random(23)
    marks = [c for c in every if unicodedata.combining(c)]
    texts += ["".join(r.choice(r.choice((every, spare, marks, marks))) for _ in range(r.randint(1, 12))) for _ in range(8000)]
    for s, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert ours.encode(s) == e.ids, ascii(s)


def test_bpe_replaces_columns_of_its_names(spark):
    path = tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, None, None, "z"), (2, "word " * 60_000, "x", "y")], "doc_id long, text string, ids string, decoded string")
    coded = bpe.encode_documents(df, path)
    assert sorted(coded.columns) == ["decoded", "doc_id", "ids", "text"]
    got = bpe.decode_documents(coded, path)
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "text"]
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded[:12]) for r in got.collect()) == [(0, 0, ""), (1, 2, "a</w> b</w>"), (1, 2, "a</w> b</w>"), (2, 60_000, "word</w> wor")]


def test_bpe_cache_has_no_influence(both, monkeypatch, rows):
    _, ours = both
    whole = [ours.digests(t) for _, t, *_ in rows]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    assert [ours.digests(t) for _, t, *_ in rows] == whole


def test_merges_leftmost_lowest():
    pairs = {1 << 20 | 2: 5 << 20 | 9, 2 << 20 | 1: 4 << 20 | 8, 8 << 20 | 2: 1 << 20 | 7}
    assert bpe.merge_ranks([1, 2, 1, 2], pairs) == [1, 7]
    assert bpe.merge_ranks([1], pairs) == [1] and bpe.merge_ranks([], pairs) == []
    assert bpe.merge_ranks([1, 1, 1], {1 << 20 | 1: 3}) == [3, 1]


def test_bpe_tables(docs, rows, empty, both):
    path = tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.document_digests(docs, path).collect()}
    assert got == {i: both[1].digests(t) for i, t, *_ in rows}
    back = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: both[1].decode(both[1].encode(t)) for i, t, *_ in rows}
    assert bpe.document_digests(empty, path).count() == 0


# ---- 4: licenses


def brute_licenses(text):
    w = license.words(text)
    shingles = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for name, t in license.TEMPLATES.items():
        x = license.words(t)
        own = {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
        n = len(x) - 4
        held = [i for i, s in enumerate(shingles) if s in own]
        best = max((len(own & set(shingles[i : i + n])) / len(own) for i in held), default=0)
        if best >= license.CONTAINED:
            out[name] = best
    return out


def test_licenses_equal_brute_force(spark, empty):
    """Whole licences and notices, some with changed words, in other text; very long texts too."""
    r = random.Random(4)
    fill = lambda k: " ".join(r.choice("alpha beta gamma licensed under the of this work software".split()) for _ in range(k))
    texts = [None, "", "Licensed under", *license.TEMPLATES.values()]
    for _ in range(150):
        t = r.choice(list(license.TEMPLATES.values())).split()
        for _ in range(r.choice([0, 1, 1, len(t) // 30, len(t) // 20])):
            t[r.randrange(len(t))] = "changed"
        texts.append(fill(r.randint(0, 40)) + "\n" + " ".join(t) + " " + fill(r.randint(0, 40)))
    texts.append(fill(60_000) + " Released under the (MIT) License. " + fill(30_000) + license.TEMPLATES["BSD-3-Clause#text"].upper())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_licenses, x.licenses, x.containment) for x in license.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        want = brute_licenses(t)
        names = sorted({n.partition("#")[0] for n in want})
        assert got[i] == (len(names), ",".join(names), max(want.values(), default=0.0)), t
    assert license.scan_licenses(empty).count() == 0


def test_license_library():
    """Every licence is found in its own texts; clauses tell two- and three-clause texts apart."""
    library = license.Library(license.TEMPLATES)
    names = list(license.TEMPLATES)
    for name, found in zip(names, library.scan([license.words(license.TEMPLATES[n]) for n in names])):
        assert found[name] == 1.0
    two, three = library.scan([license.words(license.TEMPLATES[f"BSD-{k}-Clause#text"]) for k in (2, 3)])
    assert two["BSD-2-Clause#text"] == 1.0 and "BSD-3-Clause#text" not in two or two["BSD-3-Clause#text"] < 1.0
    assert {n.partition("#")[0] for n in names} >= {"MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2", "GPL-3", "LGPL-2.1", "AGPL-3", "MPL-2.0", "CC0-1.0", "Unlicense", "CC-BY-NC-ND-4.0"}


# ---- 5: toxicity


def test_levenshtein_trie_equals_distances():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(5)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(3, 8))) for _ in range(60)})
    trie = toxicity.Trie([toxicity.Entry(t, False, 1.0) for t in terms])
    for _ in range(4000):
        w = "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        assert trie.match(w) == (1.0 if w in terms else 0.8 if any(len(t) >= 5 and distance(w, t) <= 1 for t in terms) else 0.0)
    stem = toxicity.Trie([toxicity.Entry("lowe", True, 2.0)])
    assert stem.match("lowe") == stem.match("loweis") == 2.0 and stem.match("low") == 0.0


def toxic_rows(n=600):
    r = random.Random(6)
    fill = ["".join(r.choice("abdeghinortu") for _ in range(r.randint(2, 7))) for _ in range(300)]
    bad = ["idiot", "moron", "scumbag"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [r.choice(fill) for _ in range(r.randint(20, 60))]
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = toxic_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(df, lab).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == t for i, _, t in labels) >= 0.97 * len(labels)
    # Held-out labels have no influence.
    turned = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score_documents(df, turned).collect()}
    assert again == {i: r.score for i, r in got.items()}
    entries, _, spelled = toxicity.learn(df, lab)
    assert {e.text for e in entries if not e.stem} >= {"idiot", "moron"} and not any(w.startswith("idio") for w in spelled)
    filler = docs[1][1].split()
    wrong = spark.createDataFrame([(10_000, " ".join([*filler[:9], "idlot", *filler[9:15], "morron", "ldiot"])), (10_001, docs[1][1])], "doc_id long, text string")
    both = {r.doc_id: r.predicted for r in toxicity.score_documents(df.union(wrong), lab).collect()}
    assert both[10_000] == 1 and both[10_001] == 0
    kept = {r.doc_id for r in toxicity.clean_documents(df, lab).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_quotation_weighs_less():
    s = toxicity.Scorer([toxicity.Entry("idiot", False, 5.0)], (-5.0, 3.0, 1.0))
    assert s.features("you are an idiot now")[0] == 5.0
    assert s.features('he "you idiot" now')[1] == 5.0 and s.features("the word idiot is old")[1] == 5.0
    assert s.score("you are an idiot now") > s.score('they said "you idiot" to them')
    assert s.features("what an idiott")[0] == 4.0


def test_toxicity_without_labels_or_rows(spark, empty):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, None), (None, ""), (2, "x")], "doc_id long, text string")
    rows = toxicity.score_documents(df, lab).collect()
    assert len(rows) == 3 and {r.predicted for r in rows} == {0}
    assert toxicity.score_documents(empty, lab).count() == 0


# ---- 6 and 8: vector searches


def vectors(spark, n=900, d=16, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[5] = x[6]
    rows = [(i, x[i].tolist()) for i in range(n)]
    odd = [(n, None), (n + 1, [float("nan")] * d), (n + 2, [float("inf")] + [0.0] * (d - 1)), (n + 3, [None] * d), (None, x[0].tolist()), (2 * n - n % 100 + 100, [0.0] * d)]
    return x, rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(6)


def test_exact_topk_equals_brute_force(spark, monkeypatch):
    from quern.llm import vectors as v

    x, rows, df = vectors(spark)
    zero = max(r.vec_id for r in df.filter("vec_id is not null").select("vec_id").collect())
    for block in (16384, 250):
        monkeypatch.setattr(v.search_blocks, "__defaults__", (block,))
        got = {}
        for r in exact_topk.exact_topk(df).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        q = np.floor(1024 * x.astype(float)).astype(int)
        ids = np.array([*range(len(x)), zero])
        q = np.concatenate([q, np.zeros((1, x.shape[1]), int)])
        for i in np.flatnonzero(ids % 100 == 0):
            s = q @ q[i]
            order = [j for j in np.lexsort((ids, -s)) if j != i][:10]
            assert sorted(got[ids[i]]) == [(k + 1, ids[j], s[j]) for k, j in enumerate(order)]


def test_lsh_forest_recall(spark):
    x, rows, df = vectors(spark, 3000, 32)
    got = {}
    for r in lsh_forest.nearest(df, block_rows=1500).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for i in range(0, len(x), 20):
        s = x.astype(float) @ x[i].astype(float)
        best = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:20]
        found = sorted(got[i], key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(r.score == pytest.approx(s[r.vec_id], abs=1e-9) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hit += len(set(best) & {r.vec_id for r in found})
        total += 20
    assert hit / total >= 0.9


def test_lsh_forest_is_exact_on_small_tables(spark):
    x, _, df = vectors(spark, 41, 8)
    got = {}
    for r in lsh_forest.nearest(df.filter("vec_id < 41")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for i in (0, 20, 40):
        s = x.astype(float) @ x[i].astype(float)
        assert sorted(got[i]) == [(k + 1, j) for k, j in enumerate([j for j in np.lexsort((np.arange(41), -s)) if j != i][:20])]


def test_vector_searches_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (7, [2.0, 0.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in lsh_forest.nearest(few).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 7, 2.0), (0, 2, 100, 1.0), (0, 3, 20, 0.5)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lsh_forest.nearest(none).count() == 0 and exact_topk.exact_topk(none).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in exact_topk.exact_topk(twice).orderBy("rank").collect()] == [(1, 1 << 20), (2, 1 << 20)]


# ---- 7: web archives


def test_arc_versions_and_errors():
    for version in (1, 2):
        block = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nURL 1 2 3 4\n"
        data = warc.arc_version_block(version) + b"".join(warc.arc_record(warc.ArcRecord(u, "1.2.3.4", "19990203040506", "text/html", b, {"result-code": "200"}), version) for u, b in (("http://a/b c", block), ("dns:x", b"")))
        a, b = list(warc.read_arc(data))
        assert (a.url, a.date, a.block) == ("http://a/b%20c", "19990203040506", block) and b.block == b""
        w = warc.to_warc(a)
        assert w.headers["WARC-Type"] == "response" and w.headers["WARC-Date"] == "1999-02-03T04:05:06Z" and w.payload.startswith(b"body")
        assert warc.to_warc(b).headers["WARC-Type"] == "resource"
        back = list(warc.read_warc(warc.write_warc(w) + warc.write_warc(warc.to_revisit(w, w))))
        assert back[0].block == block and back[0].headers == w.headers and back[1].payload == b"" and back[1].headers["WARC-Type"] == "revisit"
        assert back[1].headers["WARC-Refers-To"] == w.headers["WARC-Record-ID"] != back[1].headers["WARC-Record-ID"]
        assert back[1].headers["WARC-Refers-To-Date"] == w.headers["WARC-Date"] and back[1].headers["WARC-Refers-To-Target-URI"] == w.headers["WARC-Target-URI"]
        with pytest.raises(warc.ArchiveError):
            list(warc.read_arc(data[:-20] if version == 1 else data[:120]))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_arc(b"http://x 1 2 3 4\n"))


def test_archive_dates():
    assert warc.iso_date("1997") == "1997-01-01T00:00:00Z" and warc.iso_date("19970312") == "1997-03-12T00:00:00Z" and warc.iso_date("19990203040506") == "1999-02-03T04:05:06Z"
    for bad in ("", "97", "199x", "19990", "199902030405060"):
        with pytest.raises(warc.ArchiveError):
            warc.iso_date(bad)


def test_revisits_name_records_that_are_there(spark):
    """Archives of pages with repeated payloads: each revisit's target is a response in them, of the same payload, URI and date."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(60)], "page_id long, url string, html string").repartition(4)
    records = [w for r in warc.write_archives(pages, part_bytes=300).collect() for w in warc.read_warc(r.content)]
    held = {w.headers["WARC-Record-ID"]: w for w in records}
    assert len(held) == len(records) == 60
    revisits = [w for w in records if w.headers["WARC-Type"] == "revisit"]
    assert len(revisits) == 39
    for w in revisits:
        target = held[w.headers["WARC-Refers-To"]]
        assert target.headers["WARC-Type"] == "response" and target.payload == b"same" and target.headers["WARC-Target-URI"] == w.headers["WARC-Refers-To-Target-URI"] == "http://h/1"


def test_large_members_are_read_in_pieces():
    r = random.Random(40)
    blocks = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 100_000, 5, 70_000)]
    data = b"".join(warc.write_warc(warc.WarcRecord({"WARC-Type": "resource"}, b)) for b in blocks)
    assert [w.block for w in warc.read_warc(data)] == blocks
    with pytest.raises(warc.ArchiveError):
        list(warc.read_warc(data[:-10]))


def test_archive_round_trip(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 300_000, "HTTP/1.1 9\r\n\r\n", "<p>é</p>"]
    pages = spark.createDataFrame([(i * 10, f"http://h/{i} z", h, 1) for i, h in enumerate(html)] + [(None, None, "only", 2), (None, "u", "x" * 300_000, 2)], "page_id long, url string, html string, digest int").repartition(3)
    got = sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()))
    enc = lambda h: (h or "").encode()
    want = []
    for i, h in enumerate(html):
        first = next(j for j, g in enumerate(html) if enc(g) == enc(h)) * 10
        want.append((i * 10, len(enc(h)), warc.base32_sha1(enc(h)), "response" if first == i * 10 else "revisit", None if first == i * 10 else first))
    want += [(-1, 4, warc.base32_sha1(b"only"), "response", None), (-1, 300_000, warc.base32_sha1(b"x" * 300_000), "revisit", 40)]
    assert got == sorted(want, key=lambda r: r[:4])
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


# ---- 9: SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=2):
    ids, root = list(fps), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(docs, rows, empty):
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = brute_components(fps)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert kept == set(want.values())
    assert simhash.simhash_components(empty).count() == 0 and simhash.representatives(empty).count() == 0


@pytest.mark.parametrize("limit", [simhash.CELL_LIMIT, 3])
def test_simhash_links_dense_and_sparse(spark, limit):
    r = random.Random(8)
    fps = {}
    for i in range(150):
        base = r.choice([0, (1 << 64) - 1, 0x123456789ABCDEF0]) if i % 3 else r.getrandbits(64)
        for _ in range(r.randint(0, 4)):
            base ^= 1 << r.randrange(64)
        fps[i] = base
    distinct = sorted(set(fps.values()))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in distinct], "fp long")
    found = simhash.components(spark, simhash.links(df, 2, limit))
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in found.collect()}
    want = brute_components({k: k for k in distinct})
    groups = lambda m: sorted(sorted(k for k in distinct if m.get(k, k) == v) for v in {m.get(k, k) for k in distinct})
    assert groups(root) == groups(want)


def test_similar_components_catch_near_copies(spark, docs, empty):
    r = random.Random(9)
    fill = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [[r.choice(fill) for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        for k in range(4):  # each changed word touches five shingles: similarities of 0.97 to 0.88
            v = list(w)
            for at in r.sample(range(0, 300, 10), k + 1):
                v[at] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(v)))
    rows += [(5000, " ".join(base[0])), (5001, None), (5002, ""), (5003, "short text"), (5004, "other text")]
    got = {x.doc_id: x.component_id for x in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i] == i for i in range(40)) and got[5000] == 0 and got[5001] == got[5002] == 5001 and got[5003] == 5003 and got[5004] == 5004
    copies = [got[1000 + 10 * i + k] == i for i in range(40) for k in range(4)]
    assert sum(copies) >= 0.97 * len(copies)
    wide = {i: sum((w % (1 << 64)) << (64 * k) for k, w in enumerate(simhash.wide_fingerprint(t)[2:])) for i, t, *_ in docs.collect()}
    coarse = brute_components(wide, simhash.similar_bits(0.8) + simhash.NOISE_BITS)
    assert all(coarse[x.doc_id] == coarse[x.component_id] for x in simhash.similar_components(docs).collect())
    assert simhash.similar_components(empty).count() == 0


def test_simhash_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "zz yy xx ww vv")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.simhash_components(df).collect())
    assert got == [(0, 0), (0, 7), (7, 7), (7, 7)]
    assert sorted(r.doc_id or 0 for r in simhash.representatives(df).collect()) == [0, 7]


# ---- 10: sharding


def test_sharding(docs, rows, empty):
    got = {r.doc_id: r for r in sharding.shard(docs).collect()}
    for i, t, *_ in rows:
        data = (t or "").encode()
        digest = hashlib.md5(f"{i}:{zlib.crc32(data)}:0".encode()).hexdigest()
        assert (got[i]["size"], got[i].text_crc32, got[i].law, got[i].grown_shard, got[i].virtual_slot) == (len(data) + 1, zlib.crc32(data), "bytes", None, int(digest[:3], 16))
    by = {}
    for r in got.values():
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values()) and set(by) <= set(range(16))
    assert all(r.map_version == 1 for r in got.values())
    assert sharding.shard(empty).count() == 0


def brute_shards(rows, shards=16):
    """(doc_id, size, crc, shard) of rows of (doc_id, text): slots by digest, then visited from the heaviest on."""
    slots, numbers, out = {}, {}, []
    for i, t in rows:
        data = (t or "").encode()
        crc = zlib.crc32(data)
        nth = numbers[i, crc, len(data)] = numbers.get((i, crc, len(data)), -1) + 1
        slot = int(hashlib.md5(f"{'' if i is None else i}:{crc}:{nth}".encode()).hexdigest()[:3], 16)
        slots[slot] = slots.get(slot, 0) + len(data) + 1
        out.append((-1 if i is None else i, len(data) + 1, crc, slot))
    mean, loads, place = -(-sum(slots.values()) // shards), [0] * shards, {}
    for slot in sorted(range(4096), key=lambda s: (-slots.get(s, 0), s)):
        own, size = slot % shards, slots.get(slot, 0)
        to = own if loads[own] + size <= mean else loads.index(min(loads))
        loads[to] += size
        place[slot] = to
    return sorted((i, n, crc, place[slot]) for i, n, crc, slot in out)


def test_sharding_equals_brute_force_on_repeated_rows(spark, docs, rows, monkeypatch):
    from quern.llm import common

    monkeypatch.setattr(common, "NUMBERED", 300)
    pairs = [(i, "x" * (i % 50)) for i in range(2000)] + [(7, "one row again and again")] * 2000 + [(None, None)] * 2000
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = sharding.shard(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == brute_shards(pairs)
    loads, places = {}, {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 16
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard) for r in sharding.shard(docs).collect()) == brute_shards([(i, t) for i, t, *_ in rows])


def test_sharding_balances_and_moves_little(spark):
    df = spark.createDataFrame([(i, "x" * (i * 7919 % 997)) for i in range(6000)], "doc_id long, text string")
    loads = [r.b for r in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) <= 0.01 * sum(loads) / 16
    slots = sharding.slotted(df).groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    first = sharding.initial_map(spark)
    second = sharding.rebalance(first, slots)
    third = sharding.rebalance(first.unionByName(second), slots)
    moved = lambda a, b: a.alias("a").join(b.alias("b"), "virtual_slot").filter("a.shard <> b.shard").count()
    assert moved(first, second) < 1500 and third.first().version == 2 and moved(second, third) <= moved(first, second)


# ---- queries and pipeline


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    got = sorted(map(str, map(tuple, queries.QUERIES[name](spark, SF).select(*columns).collect())))
    assert got == sorted(map(str, cursor.fetchall()))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = toxic_rows(300)
    long = " ".join(f"p{i}" for i in range(60))
    docs = [(i, t) for i, t in docs] + [(1000 + i, docs[1][1]) for i in range(5)] + [(2000 + i, f"{t} {long}") for i, (_, t) in enumerate(docs[1:12:4])]
    full = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs]
    spark.createDataFrame(full, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, state = state, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = state.collect()
        if name != "bpe":
            assert state.columns == before.columns
    toxic = {i for i, _, t in labels if t}
    clean = {r.doc_id for r in kept["toxicity"]}
    assert len(clean & toxic) <= 0.05 * len(toxic) and len([i for i, _ in docs if i not in clean and i not in toxic]) <= 5
    near = {r.doc_id: r.text for r in kept["simhash near-dedup"]}
    wide = {r.doc_id: sum((w % (1 << 64)) << (64 * k) for k, w in enumerate(simhash.wide_fingerprint(r.text)[2:])) for r in kept["toxicity"]}
    assert set(near) == set(brute_components(wide, simhash.similar_bits(0.8) + simhash.NOISE_BITS).values()) and not any(1000 <= i < 1005 for i in near)
    want = brute_substring(sorted((i, t) for i, t in near.items()))
    spans = {r.doc_id: r for r in kept["substring dedup"]}
    assert {i: words(r.text) for i, r in spans.items()} == {i: k for i, (n, k) in want.items() if k or not n}
    assert all(r.n_chars == len(r.text) for r in spans.values())
    mixed = kept["mixing"]
    assert sum(len(words(r.text)) for r in mixed) <= sum(len(words(r.text)) for r in spans.values())
    model = bpe.WordBpe(open(tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert sorted((r.doc_id, r.ids_sha256) for r in kept["bpe"]) == sorted((r.doc_id, model.digests(r.text)[1]) for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)


def test_clashing_columns(spark, rows):
    """Extra columns named like the operators' own ones pass through untouched."""
    names = ["id", "c", "n", "size", "rows", "fp", "key", "copies", "_size", "_copies", "_score", "_block", "_text_hash", "_key", "_bpe_text", "block", "rank", "hash", "component_id"]
    docs = spark.createDataFrame(rows, DOC)
    wide = docs.select("*", *[F.concat_ws("-", F.lit(n), "doc_id").alias(n) for n in names])
    lab = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    path = tokenizers.path("word_bpe_49k.json")
    for run in (lambda d: toxicity.clean_documents(d, lab), simhash.representatives, substring.dedup, mixing.mixed_documents, lambda d: bpe.encode_documents(d, path).drop("ids")):
        got = run(wide)
        assert got.columns == wide.columns
        assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, run(docs).collect()))
        assert got.filter(F.col("fp") != F.concat_ws("-", F.lit("fp"), "doc_id")).count() == 0
    digest = lambda d: sorted(map(str, substring.dedup_digests(d).collect() + simhash.simhash_components(d).collect() + mixing.mix(d).collect() + sharding.shard(d).collect() + license.scan_licenses(d).collect()))
    assert digest(wide) == digest(docs)


# ---- 9 in the pipeline: sets of shingles


def brute_similar(texts, similarity=0.8):
    """Components by the exact Jaccard similarity of five-word shingles, written apart from the operator."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= similarity):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_set_counts_bound_the_differing_shingles():
    """The Manhattan distance of the segments' popcounts, from both representations, against the sets; sizes beyond HIGHEST too."""
    r = np.random.default_rng(30)
    for n in (0, 3, 50, 400, 5000):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[r.random(len(a)) < share], r.integers(0, 1 << 64, int(n * (1 - share)), dtype=np.uint64)]))
            x, y = simhash.set_counts(a), simhash.set_counts(b)
            distance = sum(bin((int(p) ^ int(q)) % (1 << 64)).count("1") for p, q in zip(x, y))
            counts = [np.minimum(np.histogram((s >> np.uint64(57)).astype(int), np.arange(129))[0], 8) for s in (a, b)]
            assert distance == np.abs(counts[0] - counts[1]).sum() <= len(np.setxor1d(a, b))


def similar(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()}


def test_similar_components_find_every_pair_at_the_limit(spark):
    """Similarities of 0.79 to 0.83, which sampled grids find in part only."""
    r = random.Random(31)
    texts = {}
    for i in range(80):
        base = [f"w{r.randrange(5000)}" for _ in range(300)]
        copy = list(base)
        for at in r.sample(range(0, 300, 6), r.choice([5, 6, 6, 7])):
            copy[at] = "changed"
        texts |= {i: " ".join(base), 1000 + i: " ".join(copy)}
    want = brute_similar(texts)
    assert 20 < sum(want[1000 + i] == i for i in range(80)) < 80
    assert similar(spark, texts) == want


def test_similar_components_verify_the_sets(spark):
    """Documents of one template at similarities of about 0.7 to 0.78: the bits of many are within the limit, the sets of none."""
    r = random.Random(32)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(60):
        copy = list(base)
        for k, at in enumerate(r.sample(range(0, 300, 5), 5)):
            copy[at + r.randrange(5)] = f"only{i}x{k}"
        texts[i] = " ".join(copy)
    want = brute_similar(texts)
    assert len(set(want.values())) > 50
    assert similar(spark, texts) == want


def test_similar_components_compare_strangers_of_a_cell(spark):
    """Near copies whose cells also hold many half-similar documents, more than the centres of two rounds."""
    r = random.Random(33)
    page = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(45):
        own = [f"own{i}x{k}" for k in range(60)]
        copy = page + own
        copy[r.randrange(200)] = "changed"
        texts |= {i: " ".join(page + own), 1000 + i: " ".join(copy)}
    want = brute_similar(texts)
    assert len(set(want.values())) > 30
    assert similar(spark, texts) == want
    few = simhash.FIRST_ROUNDS, simhash.CENTRES, simhash.CENTRES_GROW, simhash.SMALL_CELL
    try:
        simhash.FIRST_ROUNDS, simhash.CENTRES, simhash.CENTRES_GROW, simhash.SMALL_CELL = ((1, 0, 2),), 3, 4, 2
        assert similar(spark, texts) == want
    finally:
        simhash.FIRST_ROUNDS, simhash.CENTRES, simhash.CENTRES_GROW, simhash.SMALL_CELL = few


def test_set_parity_bounds_the_differing_shingles():
    """Never more than the sets differ by, and near it where that is few."""
    r = np.random.default_rng(34)
    for n in (0, 3, 400, 5000):
        for share in (0.0, 0.9, 1.0):
            a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[r.random(len(a)) < share], r.integers(0, 1 << 64, int(n * (1 - share)), dtype=np.uint64)]))
            distance = sum(bin((int(p) ^ int(q)) % (1 << 64)).count("1") for p, q in zip(simhash.set_parity(a), simhash.set_parity(b)))
            differing = len(np.setxor1d(a, b))
            assert distance <= differing and (differing > 100 or distance >= 0.8 * differing)


def test_similar_components_hand_on_few_pairs(spark, monkeypatch):
    """A group of one template just below the limit: its pairs share few cells, and few that are no links are handed on."""
    r = random.Random(34)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(80):
        copy = list(base)
        for k, at in enumerate(r.sample(range(0, 400, 5), 6)):
            copy[at] = f"only{i}x{k}"
        texts[i] = " ".join(copy)
    met, handed = [], []
    linked, verified = simhash._linked_sets, simhash._similar_pairs

    def with_cells(spark, cells, *rest):
        met.extend(x["count"] for x in cells.groupBy("cell").count().collect())
        return linked(spark, cells, *rest)

    def with_pairs(spark, near, *rest):
        handed.append(near.count())
        return verified(spark, near, *rest)

    monkeypatch.setattr(simhash, "_linked_sets", with_cells)
    monkeypatch.setattr(simhash, "_similar_pairs", with_pairs)
    assert similar(spark, texts) == brute_similar(texts)
    pairs = 80 * 79 / 2
    assert sum(n * (n - 1) / 2 for n in met) <= 4 * pairs and sum(handed) <= 0.15 * pairs


# ---- 6: distinct candidates


def forest_recall(x, k=20):
    """Recall of the scores of the k best against brute force, in one block."""
    top = float(np.sqrt((x * x).sum(1).max()))
    asked = np.arange(0, len(x), 20)
    search = lsh_forest._forest(k, top, lsh_forest.TREES, lsh_forest.BITS, lsh_forest.SHARE)
    hit = 0
    for i, at, _ in search(asked, x[asked], np.arange(len(x)), x):
        s = np.delete(x @ x[asked[i]], asked[i])
        hit += (x[at] @ x[asked[i]] >= np.sort(s)[-k] - 1e-9).sum()
    return hit / (k * len(asked))


@pytest.mark.parametrize("n, copies", [(500, 1), (1000, 1), (1000, 11)])
def test_lsh_forest_counts_distinct_candidates(n, copies):
    r = np.random.default_rng(5)
    x = r.standard_normal((n // copies, 64))
    assert forest_recall(np.repeat(x / np.linalg.norm(x, axis=1)[:, None], copies, axis=0)) >= 0.95
