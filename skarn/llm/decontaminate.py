"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact verification.

Texts are lower-case runs of letters and digits. For each length that items have, a window of that length
slides over a document; its fingerprint is the SimHash of its word shingles. The fingerprints of the items
of one length lie in tables by eight blocks of eight bits: two fingerprints within 23 bits differ by at
most two bits in some block, so looking up each block of a window within two bits gives every item within
that radius. These (window, item) pairs are the candidates, verified by the weighted Jaccard similarity of
shingle counts. A window that shares no shingle with any item of the length has similarity 0 to all, so
windows slide only where some such shingle stands; this loses nothing.

The items are a table that is small beside the corpus. They are sent to the executors in groups of at most
``group`` items and GROUP_BYTES of text, one pass over the documents for each group, so what is broadcast
stays bounded.

Defined results: null and empty texts and items match nothing; an item of fewer words than a shingle is
one shingle; a text shorter than an item is one window; texts of any length are read whole; of windows
equally similar to an item the first is given; repeated rows each give their rows; ids keep their types;
empty tables give an empty result; extra columns are ignored, whatever their names, and clean() keeps them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map, ship

RADIUS = 23
#: Text of the items that are sent out at once.
GROUP_BYTES = 32 << 20
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LIGHT = np.array([[bin(a ^ b).count("1") <= RADIUS // 8 for b in range(256)] for a in range(256)])


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words, from hashes of the words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return _mixed(words[k : k + n] for k in range(width))


def _mixed(rows) -> np.ndarray:
    """One hash of the word hashes that stand in the same place of each row."""
    h = np.uint64(0)
    for row in rows:
        h = (h ^ row) * _ODD
        h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def simhash(bits: np.ndarray) -> np.ndarray:
    """Fingerprints of sums of shingle bits scaled to -1 and 1: (n, 64) sums to n words."""
    return np.packbits(bits > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def signs(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


class Tables:
    """The items of one length and shingle width, by the blocks of their fingerprints."""

    def __init__(self, size: int, width: int, members: list[int], fps: np.ndarray) -> None:
        self.size, self.width, self.members, self.fps = size, width, np.array(members), fps
        blocks = fps.astype(">u8").view(np.uint8).reshape(-1, 8)
        # near[b][v]: the items whose block b is within two bits of v, as bits
        self.near = [np.packbits(_LIGHT[:, blocks[:, b]], axis=1) for b in range(8)]

    def candidates(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius: looked up block by block, then held to the whole distance."""
        blocks = fps.astype(">u8").view(np.uint8).reshape(-1, 8)
        found = np.bitwise_or.reduce([self.near[b][blocks[:, b]] for b in range(8)], axis=0)
        row, k = np.nonzero(np.unpackbits(found, axis=1)[:, : len(self.fps)])
        close = np.bitwise_count(fps[row] ^ self.fps[k]) <= RADIUS
        return row[close], self.members[k[close]]


class Items:
    """A group of benchmark items, ready to be looked up."""

    def __init__(self, rows: list[tuple[object, str]], width: int = 5, threshold: float = 0.8) -> None:
        self.threshold = threshold
        self.ids, self.fps, self.counts = [], [], []
        self.word: dict[str, int] = {}
        classes: dict[tuple[int, int], list[int]] = {}
        holders: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for item, text in rows:
            words = words_of(text or "")
            if not words:
                continue
            k = min(width, len(words))
            hashes = shingle_hashes(np.array([self._hash(w) for w in words], np.uint64), k)
            of = (k, len(words))
            for h in set(hashes.tolist()):
                holders.setdefault((k, h), set()).add(of)
            classes.setdefault(of, []).append(len(self.ids))
            self.ids.append(item)
            self.counts.append(Counter(hashes.tolist()))
            self.fps.append(simhash(signs(hashes).sum(axis=0)[None, :])[0])
        self.hash = np.array([xxhash.xxh64_intdigest(w.encode()) for w in self.word], np.uint64)
        self.tables = {of: Tables(of[1], of[0], m, np.array([self.fps[i] for i in m], np.uint64)) for of, m in classes.items()}
        # of each shingle width: the known shingles, and the lengths of the items that hold each
        self.holders = {k: {h: v for (j, h), v in holders.items() if j == k} for k, _ in classes}
        self.known = {k: np.array(sorted(v), np.uint64) for k, v in self.holders.items()}

    def _hash(self, word: str) -> int:
        if word not in self.word:
            self.word[word] = len(self.word)
        return xxhash.xxh64_intdigest(word.encode())

    def matches(self, text: str) -> list[tuple[object, int, int, float, int]]:
        """(item, start word, words, similarity, differing bits) of the best window for each item found."""
        words = words_of(text)
        get = self.word.get
        local = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, tuple] = {}
        for width, known in self.known.items():
            if len(words) < width:
                continue
            inside = np.r_[0, np.cumsum(local < 0)]
            at = np.flatnonzero(inside[width:] == inside[:-width])  # runs of known words only
            if not len(at):
                continue
            h = _mixed(self.hash[local[at + k]] for k in range(width))
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[k] == h
            seen: dict[tuple[int, int], list[int]] = {}
            for p, v in zip(at[hit].tolist(), h[hit].tolist()):
                for of in self.holders[width][v]:
                    seen.setdefault(of, []).append(p)
            for of in sorted(seen):
                self._slide(words, self.tables[of], seen[of], best)
        return [best[k] for k in sorted(best)]

    def _slide(self, words: list[str], table: Tables, places: list[int], best: dict[int, tuple]) -> None:
        size, width = min(table.size, len(words)), table.width
        spans: list[list[int]] = []  # ranges of window starts around known shingles
        for p in places:
            low, high = max(0, p - size + width), min(p, len(words) - size)
            low = min(low, high)
            if spans and low <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        m = size - width + 1
        for low, high in spans:
            for first in range(low, high + 1, 4096):  # pieces, so that a long run of matches stays small in memory
                last = min(first + 4095, high)
                hashes = shingle_hashes(np.array([xxhash.xxh64_intdigest(w.encode()) for w in words[first : last + size]], np.uint64), width)
                sums = np.r_[np.zeros((1, 64), np.int32), np.cumsum(signs(hashes), axis=0, dtype=np.int32)]
                fps = simhash(sums[m:] - sums[:-m])
                at, window = -1, Counter()
                for k, item in zip(*(v.tolist() for v in table.candidates(fps))):
                    if k != at:
                        at, window = k, Counter(hashes[k : k + m].tolist())
                    want = self.counts[item]
                    both = sum(min(c, want[h]) for h, c in window.items() if h in want)
                    similarity = both / (m + sum(want.values()) - both)
                    if similarity >= self.threshold and (item not in best or similarity > best[item][3]):
                        best[item] = (self.ids[item], first + k, size, similarity, int(np.bitwise_count(fps[k] ^ self.fps[item])))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, group: int = 5000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, bits): the best window of each document for each item found in it."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, item_id {dict(benchmark.dtypes)[item_col]}, start_word long, n_words long, similarity double, bits int"
    out = None
    for rows in _groups(items, group):
        found = arrow_map(slim, _matcher(rows, width, threshold), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _groups(items: DataFrame, group: int) -> Iterator[list[tuple]]:
    """The items in lists of about ``group`` and GROUP_BYTES, by a hash; one empty list if there are none."""
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(1, -(-n // group), -(-size // GROUP_BYTES))
    for k in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield sorted(((r.item_id, r.text) for r in some.collect()), key=lambda r: (r[0] is None, str(r[0]), r[1]))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, group: int = 5000) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns; nothing is shuffled."""
    ship(docs.sparkSession)
    for rows in _groups(benchmark.select("item_id", "text").where("text IS NOT NULL"), group):
        docs = docs.mapInArrow(_keeper(rows, width, threshold), docs.schema)
    return docs


def _keeper(rows: list[tuple], width: int, threshold: float):
    held: list[Items] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not held:
                held.append(Items(rows, width, threshold))
            if batch.num_rows:
                yield batch.filter(pa.array([not (held[0].ids and held[0].matches(t or "")) for t in batch.column("text").to_pylist()]))

    return run


def _matcher(rows: list[tuple], width: int, threshold: float):
    held: list[Items] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Items(rows, width, threshold))
        out: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "start_word", "n_words", "similarity", "bits")}
        if held[0].ids:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for match in held[0].matches(text or ""):
                    for c, v in zip(out, (doc, *match)):
                        out[c].append(v)
        return out

    return run
