"""BPE encoding and decoding, with a segment tree over the ranks of adjacent pairs.

The leaves hold the rank of each adjacent pair of symbols, inner nodes the smaller of their children, and the root the
lowest rank, ties to the left. The tree is walked from the root to the leftmost lowest pair; a merge is three point updates
of logarithmic cost. It ends when the root holds no rank.

The tokenizer file is public and of fixed size; the driver reads it and sends it to the workers. Words repeat, so a
worker keeps the ids of words it has met; the memory for them is bounded and has no influence on results.

Which characters are letters, numbers or white space, their lower case and their composition depend on a version of Unicode. The driver
asks the tokenizers library for all of them once (`Characters.of_library`), so that neither Python's tables nor another package's count.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, hold, prepare

#: Runs without white space whose ids a worker remembers: half of them new or met again since the other half was new.
CACHE_WORDS = 800_000
_NONE = 1 << 60
#: Code points that a version of Unicode can give a class, a lower case or a composition: planes 0 to 3 without surrogates, and tags. All
#: others are unassigned or private.
_CODE_POINTS = (range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE1000))


@dataclass(frozen=True)
class Characters:
    """Character tables: classes as the inside of a bracket expression, the lower case of each character that has another one, and
    the characters that take no part in composition although Python's tables compose or reorder them."""

    classes: dict[str, str]
    lower: dict[int, str]
    inert: frozenset[int]

    @staticmethod
    @functools.lru_cache(1)
    def of_library() -> Characters:
        """The tables of the installed tokenizers library, by probing every code point that can be in them."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        text = "".join(map(chr, chain(*_CODE_POINTS)))

        def ranges(pattern: str) -> str:
            runs = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(text)
            return "".join(f"\\U{ord(r[0]):08X}-\\U{ord(r[-1]):08X}" for r, _ in runs)

        small, composed, apart = normalizers.Lowercase().normalize_str, normalizers.NFC().normalize_str, normalizers.NFD().normalize_str
        lower = {}
        for i in range(0, len(text), 1024):
            part = text[i : i + 1024]
            if small(part) != part:
                lower |= {ord(c): low for c in part if (low := small(c)) != c}
        inert, known = set(), set()
        for x in text:
            c = ord(x)
            if unicodedata.combining(x):
                # A mark that sorts after U+0323 or before U+0345 shows its class by moving there.
                if any(composed(t) != unicodedata.normalize("NFC", t) for t in (f"a{x}\u0323", f"a\u0345{x}")):
                    inert.add(c)
            if (parts := unicodedata.decomposition(x)) and not parts.startswith("<"):
                members = {int(p, 16) for p in parts.split()}
                if apart(x) == unicodedata.normalize("NFD", x):
                    known |= members
                else:
                    inert |= {c, *members}
        return Characters({k: ranges(k) for k in (r"\p{L}", r"\p{N}", r"\s")}, lower, frozenset(inert - known))


def byte_symbols() -> list[str]:
    """The printable symbol of each byte, as byte-level tokenizers define it: printable Latin-1 stands for itself, the
    rest is numbered from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[b] = chr(256 + i)
    return out


def merge_ranks(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Apply merges, always the leftmost of the lowest rank, until none is left.

    pairs: left << 20 | right to rank << 20 | merged. The tree holds these values; they order as the ranks do.
    """
    n = len(symbols)
    get = pairs.get
    tree = [get(a << 20 | b, _NONE) for a, b in zip(symbols, symbols[1:])]
    if n < 2 or min(tree) == _NONE:
        return symbols
    size = 1 << (n - 2).bit_length()
    leaves = tree + [_NONE] * (size - n + 1)
    levels = [leaves]
    while len(leaves) > 1:
        leaves = list(map(min, leaves[::2], leaves[1::2]))
        levels.append(leaves)
    tree = [0]
    for level in reversed(levels):
        tree += level
    after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    symbols = list(symbols)
    root = tree[1]
    while root != _NONE:
        p = 1
        while p < size:
            p *= 2
            if tree[p] != root:
                p += 1
        i = p - size
        j = after[i]
        k = after[i] = after[j]
        symbols[i] = root & 0xFFFFF
        merged[j] = True
        h = before[i]
        changed = [(i, get(symbols[i] << 20 | symbols[k], _NONE) if k < n else _NONE)]
        if k < n:
            before[k] = i
            changed.append((j, _NONE))
        if h >= 0:
            changed.append((h, get(symbols[h] << 20 | symbols[i], _NONE)))
        for leaf, value in changed:
            p = size + leaf
            tree[p] = value
            while p > 1:
                other = tree[p ^ 1]
                p >>= 1
                if other < value:
                    value = other
                if tree[p] == value:
                    break
                tree[p] = value
        root = tree[1]
    return [s for s, gone in zip(symbols, merged) if not gone]


class WordBpe:
    """The tokenizer of a `tokenizer.json` with word ends: NFC, white space to one space (which no word can hold, so that
    it needs no step here), lower case per character, words by pattern, byte-level symbols, BPE with an end-of-word suffix, no
    decoder."""

    def __init__(self, definition: str, characters: Characters | None = None):
        characters = characters or Characters.of_library()
        j = json.loads(definition)
        model = j["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE model")
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        parts = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.pairs = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in reversed(list(enumerate(parts)))}
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.last = [self.vocab.get(s + suffix) for s in symbols]
        self.tokens = {i: t for t, i in self.vocab.items()}
        added = {t["content"]: t["id"] for t in j.get("added_tokens") or ()}
        self.added = added
        self.tokens |= {i: t for t, i in added.items()}
        self.special = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        kinds = [x["type"] for x in j["normalizer"]["normalizers"]]
        split = next(x for x in j["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("not the normalizer and pattern that this class is for")
        pattern = split["pattern"]["Regex"]
        for name, inside in characters.classes.items():
            pattern = pattern.replace(name, inside)
        self.pattern = re.compile(pattern)
        self.spaces = re.compile(f"[{characters.classes[r'\s']}]+")
        self.lower = characters.lower
        self.inert = re.compile("([" + "".join(map(re.escape, map(chr, sorted(characters.inert)))) + "])") if characters.inert else None
        # str.split() and str.lower() are faster, and the same unless a text has one of these.
        self.odd_space = [chr(c) for c in chain(*_CODE_POINTS) if chr(c).isspace() != bool(self.spaces.match(chr(c)))]
        odd_case = [chr(c) for c in chain(*_CODE_POINTS) if chr(c).lower() != self.lower.get(c, chr(c))] + ["Σ"]
        self.odd_case = re.compile("[" + "".join(map(re.escape, odd_case)) + "]")
        self.plain_latin = min(map(ord, odd_case)) > 255 and min(characters.inert, default=256) > 255
        self.texts: dict[int, str] = {i: str(i) for i in self.tokens}
        self.same = {i: i for i in self.tokens}  # one object for each id, however many words hold it
        self.runs: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> list[int]:
        data = w.encode("utf-8", "replace")
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return [self.same[i] for i in merge_ranks([i for i in ids if i is not None], self.pairs)]

    def _pieces(self, text: str):
        """(is an added token, its id or the normalized segment)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield False, self.normalize(text[at : m.start()])
            yield True, self.added[m[0]]
            at = m.end()
        if at < len(text):
            yield False, self.normalize(text[at:])

    def normalize(self, s: str) -> str:
        if s.isascii():
            return s.lower()
        if self.plain_latin:
            try:
                s.encode("latin-1")
                return unicodedata.normalize("NFC", s).lower()
            except UnicodeEncodeError:
                pass
        parts = self.inert.split(s) if self.inert and self.inert.search(s) else [s]
        s = "".join([unicodedata.normalize("NFC", p) for p in parts])
        return s.translate(self.lower) if self.odd_case.search(s) else s.lower()

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text. No word spans white space, so a run without white space is encoded once and remembered."""
        out: list[int] = []
        for special, x in self._pieces(text or ""):
            if special:
                out.append(x)
                continue
            runs = [r for r in self.spaces.split(x) if r] if any(c in x for c in self.odd_space) else x.split()
            if 2 * len(self.runs) >= CACHE_WORDS:
                self.before, self.runs = self.runs, {}
            known = self.runs
            for r in set(runs).difference(known):
                ids = self.before.get(r)
                if ids is None:
                    ids = ()
                    for w in (r,) if r.isascii() and r.isalpha() else self.pattern.findall(r):
                        got = known.get(w) or self.before.get(w)
                        if got is None:
                            got = known[w] = tuple(self.word(w))
                        ids = ids + got
                known[r] = tuple(ids)
            out.extend(chain.from_iterable(map(known.__getitem__, runs)))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does; unknown ids are left out."""
        tokens = self.tokens
        try:
            return " ".join(map(tokens.__getitem__, ids))
        except KeyError:
            return " ".join([tokens[i] for i in ids if i in tokens])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids (decimal, joined by a space) and of the text that they decode to."""
        ids = self.encode(text)
        shown = " ".join(map(self.texts.__getitem__, ids))
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


_loaded: dict[str, WordBpe] = {}


def _tokenizer(model: tuple[str, Characters]) -> WordBpe:
    hold("bpe", _loaded.clear)
    key = hashlib.sha256(model[0].encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(*model)
    return _loaded[key]


def _broadcast(docs: DataFrame, path: str):
    """The tokenizer's definition and character tables: of fixed size, whatever the input."""
    prepare(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast((Path(path).read_text(encoding="utf-8"), Characters.of_library()))


def _replaced(rows: DataFrame, source_col: str, out_col: str, kind: T.DataType, one, path: str) -> DataFrame:
    """The rows with out_col, in place of a column of that name, made of source_col by `one(tokenizer, value)`."""
    model = _broadcast(rows, path)
    (source,) = fresh(rows, "_bpe_source")
    rest = [f for f in rows.schema.fields if f.name.lower() != out_col.lower()]

    def run(batches):
        t = _tokenizer(model.value)
        for b in batches:
            made = pa.array([one(t, x) for x in b.column(b.num_columns - 1).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], out_col])

    arrow = pa.string() if kind == T.StringType() else pa.list_(pa.int32())
    picked = rows.select(*[F.col(f"`{f.name}`") for f in rest], F.col(source_col).alias(source))
    return picked.mapInArrow(run, T.StructType([*rest, T.StructField(out_col, kind)]))


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Every row with the ids of its whole text in out_col; a column of that name is replaced.

    Null and empty texts have no ids; a text of any length is encoded whole. Repeated rows stay, other columns
    pass through. An empty table gives an empty result.
    """
    return _replaced(docs, text_col, out_col, T.ArrayType(T.IntegerType()), lambda t, x: t.encode(x), path)


def decode_documents(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every row with the text of its ids in out_col; a column of that name is replaced.

    Null and empty lists give the empty text, unknown and null ids are left out. Repeated rows stay, other columns pass through. An
    empty table gives an empty result.
    """
    return _replaced(rows, ids_col, out_col, T.StringType(), lambda t, x: t.decode(x or []), path)


def document_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text; one pass, no shuffle.

    Null and empty texts have no tokens and the digests of the empty string; a text of any length is encoded whole. Null ids, repeated
    rows and extra columns change nothing. An empty table gives an empty result.
    """
    model = _broadcast(docs, path)

    def run(batches):
        t = _tokenizer(model.value)
        for b in batches:
            rows = [t.digests(x) for x in b.column(1).to_pylist()]
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
