"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are lower-cased and lose punctuation at their ends; shingles are five words. A template of s shingles is looked for in every window of s
consecutive shingles of a document, so windows overlap in all but one. A window and a template that share the part CONTAINED of the template's
shingles have a Jaccard similarity of at least CONTAINED / (2 - CONTAINED) = 2/3; with BANDS bands of one row the chance that no band
agrees is at most (1/3) ** BANDS, under 1e-7. Per length and band, the templates' values are a sorted index in which every window looks its own
up; templates retrieved by any band are verified exactly.

Documents without any shingle of the library have no window with a containment above zero and are passed over. The sliding minima of all
windows are made by doubling, over many documents at once. The library of templates is part of the code, so what is sent to the
workers is of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, hash_words, prepare
from .license_texts import templates as known_templates

SHINGLE = 5
CONTAINED = 0.8
BANDS = 16
#: Words whose shingles are hashed together.
BATCH_WORDS = 1 << 18
_TRIM = b".,;:!?()[]{}<>\"'`*#/|\\-_"
TEMPLATES = known_templates()


def words(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(_TRIM) for x in (text or "").lower().encode("utf-8", "surrogatepass").split()) if w]


class Library:
    """Templates by their number of shingles, and per length and band the sorted index of their minima."""

    def __init__(self, templates: dict[str, str], contained: float = CONTAINED, bands: int = BANDS):
        self.contained = contained
        rng = np.random.default_rng(5)
        self.factors = (rng.integers(1, 1 << 62, bands, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.by_length: dict[int, list[tuple[str, frozenset[int]]]] = {}
        for name, text in sorted(templates.items()):
            h = gram_hashes(hash_words(words(text)), SHINGLE)
            if not len(h):
                raise ValueError(f"{name} has fewer than {SHINGLE} words")
            self.by_length.setdefault(len(h), []).append((name, frozenset(h.tolist())))
        self.longest = max(self.by_length, default=1)
        self.index: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for n, held in self.by_length.items():
            for band, factor in enumerate(self.factors):
                minima = np.array([(np.fromiter(s, np.uint64) * factor).min() for _, s in held], np.uint64)
                order = np.argsort(minima, kind="stable")
                self.index[n, band] = minima[order], order
        every = [s for held in self.by_length.values() for _, s in held]
        self.shingles = np.unique(np.fromiter(frozenset().union(*every), np.uint64)) if every else np.zeros(0, np.uint64)
        self.starts = np.zeros(1 << 16, bool)
        self.starts[(self.shingles >> np.uint64(48)).astype(np.int64)] = True

    def touched(self, h: np.ndarray) -> bool:
        """Whether any of the hashes is a template's."""
        near = h[self.starts[(h >> np.uint64(48)).astype(np.int64)]]
        return bool(len(near)) and bool((self.shingles[np.minimum(np.searchsorted(self.shingles, near), len(self.shingles) - 1)] == near).any())

    def scan(self, documents: list[list[bytes]]) -> list[dict[str, float]]:
        """Per document the templates found, with the highest containment."""
        out: list[dict[str, float]] = [{} for _ in documents]
        if not len(self.shingles):
            return out
        hashes = [(d, h) for d, h in enumerate(gram_hashes(hash_words(w), SHINGLE) for w in documents) if self.touched(h)]
        if not hashes:
            return out
        # Documents stand in one array with gaps as long as the longest template, whose minima match nothing.
        sizes = np.array([len(h) for _, h in hashes], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + self.longest)))
        flat = np.zeros(starts[-1], np.uint64)
        blank = np.ones(starts[-1], bool)
        for (_, h), at in zip(hashes, starts.tolist()):
            flat[at : at + len(h)] = h
            blank[at : at + len(h)] = False
        hits: dict[tuple[int, int], list[np.ndarray]] = {}
        for band, factor in enumerate(self.factors):
            least = flat * factor
            least[blank] = np.uint64(0xFFFFFFFFFFFFFFFF)
            have = 1
            for n in sorted(self.by_length):
                while have * 2 <= n:
                    least = np.minimum(least[:-have], least[have:])
                    have *= 2
                window = least if have == n else np.minimum(least[: len(least) - (n - have)], least[n - have :])
                minima, templates = self.index[n, band]
                low, high = np.searchsorted(minima, window, "left"), np.searchsorted(minima, window, "right")
                for at in np.flatnonzero(low < high).tolist():
                    for t in templates[low[at] : high[at]].tolist():
                        hits.setdefault((n, t), []).append(at)
        for (n, t), places in hits.items():
            name, shingles = self.by_length[n][t]
            at = np.unique(places)
            for p, k in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
                end = min(p + n, starts[k] + sizes[k])
                share = len(shingles.intersection(flat[p:end].tolist())) / len(shingles)
                found = out[hashes[k][0]]
                if share >= self.contained and share > found.get(name, 0.0):
                    found[name] = share
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, n_licenses, licenses (names in order, joined by a comma, empty if none), containment (the highest, 0 if none).

    A licence's name is that of its templates up to `#`; it is found if one of them is. One pass over the whole texts, whatever their
    length, no shuffle. Null, empty and short texts match nothing. Equal containments all count. Null ids, repeated rows and extra
    columns change nothing. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    given = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        library = Library(given, contained, bands)
        for b in batches:
            found: list[dict[str, float]] = []
            part: list[list[bytes]] = []
            held = 0
            for text in b.column(1).to_pylist():
                part.append(words(text))
                held += len(part[-1])
                if held >= BATCH_WORDS:
                    found += library.scan(part)
                    part, held = [], 0
            found += library.scan(part)
            names = [sorted({n.partition("#")[0] for n in f}) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(n) for n in names], pa.int32()), pa.array([",".join(n) for n in names], pa.string()), pa.array([max(f.values(), default=0.0) for f in found], pa.float64())],
                ["doc_id", "n_licenses", "licenses", "containment"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_licenses int, licenses string, containment double")
