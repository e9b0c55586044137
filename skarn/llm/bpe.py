"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved down to short leaves, each encoded on its own, and neighbours join by re-encoding a
window around the seam. The window grows on either side until it ends at a cut which no match of the
pre-tokenizing pattern can cross, whatever stands around it: a lone space between two characters that
are not white space (the space can only lead a match). Tokens outside the window are then those of the
whole text. A window that finds no cut is split into its matches, and matches of many bytes are
encoded by the same reduction over their bytes: there, a token sequence is the encoding of its bytes
exactly when each adjacent pair of its tokens encodes to itself, because until the first merge across
some token boundary, merging inside any two neighbours runs as it would on those two alone. So once a
re-encoded window starts and ends with the tokens it had before, nothing outside it can change. This
asks that each token of the vocabulary encodes to itself, which ``Vocabulary.sound`` verifies.
Leaves and windows, a few dozen characters each, are encoded by the tiktoken library's core.

Defined results: null and empty texts have no tokens; one word of megabytes takes logarithmic depth;
of pairs of one rank the leftmost merges first; repeated rows each get a row; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import sys
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map

_LITTLE = sys.byteorder == "little"
_KEPT: dict[tuple[str, str], Coder] = {}


class Vocabulary:
    """Ranks of byte strings, from a file of base64 tokens and ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.windows: dict[tuple[int, ...], list[int]] = {}
        self.parts: dict[bytes, list[int]] = {}

    def merged(self, parts: list[bytes]) -> list[int]:
        """Plain BPE: the pair of lowest rank, leftmost first, merges until none can."""
        if len(parts) > 256:
            return self.merged_by_heap(parts)
        rank = self.rank
        none = len(self.token)
        costs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < none:
            k = costs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = rank.get(parts[k - 1] + parts[k], none)
            if k < len(costs):
                costs[k] = rank.get(parts[k] + parts[k + 1], none)
        return [rank[x] for x in parts]

    def merged_by_heap(self, parts: list[bytes]) -> list[int]:
        """The same for many parts, in n log n steps: a window that never settles (a run of one letter) grows long."""
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        cost = [rank.get(a + b) for a, b in zip(parts, parts[1:])] + [None]  # of each part with the next one
        heap = [(c, k) for k, c in enumerate(cost) if c is not None]
        heapify(heap)
        while heap:
            c, k = heappop(heap)
            if cost[k] != c:  # one of the two has merged meanwhile
                continue
            gone = after[k]
            parts[k] += parts[gone]
            cost[gone], parts[gone] = None, b""
            after[k] = end = after[gone]
            if end < n:
                before[end] = k
            for left, right in ((before[k], k), (k, end)):
                if left >= 0:
                    cost[left] = c = rank.get(parts[left] + parts[right]) if right < n else None
                    if c is not None:
                        heappush(heap, (c, left))
        return [rank[x] for x in parts if x]

    def from_bytes(self, raw: bytes) -> list[int]:
        return self.merged([raw[k : k + 1] for k in range(len(raw))])

    def sound(self) -> bool:
        """Whether each token encodes to itself, which the joins and the whole-token leaves rest on."""
        return all(self.from_bytes(token) == [rank] for token, rank in self.rank.items())

    def window(self, tokens: tuple[int, ...]) -> list[int]:
        """The encoding of the bytes of a few neighbouring tokens; short windows are remembered."""
        got = self.windows.get(tokens)
        if got is None:
            got = self.from_bytes(b"".join([self.token[t] for t in tokens]))
            if len(tokens) <= 4:
                if len(self.windows) > 50_000:
                    self.windows.clear()
                self.windows[tokens] = got
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            old = (*left[-i:], *right[:j])
            new = self.window(old)
            left_done = i >= len(left) or new[0] == old[0] and len(new) > 1
            right_done = j >= len(right) or new[-1] == old[-1] and len(new) > 1
            if left_done and right_done:
                return left[:-i] + new + right[j:]
            i, j = i if left_done else min(i + i, len(left)), j if right_done else min(j + j, len(right))

    def encode(self, raw: bytes) -> list[int]:
        rank = self.rank.get(raw)
        if rank is not None:
            return [rank]
        got = self.parts.get(raw)
        if got is not None:
            return got
        n = len(raw)
        if not n:
            return []
        got = self.join(self.encode(raw[: n // 2]), self.encode(raw[n // 2 :]))
        if n <= 24:
            if len(self.parts) > 50_000:
                self.parts.clear()
            self.parts[raw] = got
        return got

    def decode(self, ids: list[int], leaf: int = 512) -> bytes:
        """Bytes of the ids, concatenated up a tree with leaves of so many ids."""
        level = [b"".join([self.token[t] for t in ids[k : k + leaf]]) for k in range(0, len(ids), leaf)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


class Coder:
    """A vocabulary with a pre-tokenizing pattern; leaf: characters encoded at once, most: of a window so encoded."""

    def __init__(self, path: str, pattern: str, leaf: int = 512, most: int = 4096) -> None:
        self.words, self.find, self.leaf, self.most = Vocabulary(path), regex.compile(pattern).findall, leaf, most
        self.core = tiktoken.Encoding("leaves", pat_str=pattern, mergeable_ranks=self.words.rank, special_tokens={}).encode_ordinary

    def short(self, text: str) -> list[int]:
        """The ids of a leaf or window."""
        if len(text) <= self.most:
            return self.core(text)
        out: list[int] = []
        for match in self.find(text):
            out += self.core(match) if len(match) <= 64 else self.words.encode(match.encode())
        return out

    @staticmethod
    def cut_before(text: str, low: int, high: int) -> int:
        """The last cut strictly inside text[low:high], else low."""
        k = text.rfind(" ", low + 1, high - 1)
        while k >= 0 and (text[k - 1].isspace() or text[k + 1].isspace()):
            k = text.rfind(" ", low + 1, k)
        return k if k >= 0 else low

    @staticmethod
    def cut_after(text: str, low: int, high: int) -> int:
        """The first cut strictly inside text[low:high], else high."""
        k = text.find(" ", low + 1, high - 1)
        while k >= 0 and (text[k - 1].isspace() or text[k + 1].isspace()):
            k = text.find(" ", k + 1, high - 1)
        return k if k >= 0 else high

    def part(self, text: str, low: int, high: int) -> list[int]:
        """The ids of text[low:high]."""
        if high - low <= self.leaf:
            return self.core(text[low:high])
        if self.cut_before(text, low, high) == low:  # no cut at all: every window would be the whole
            return self.short(text[low:high])
        mid = (low + high) // 2
        left, right = self.part(text, low, mid), self.part(text, mid, high)
        a, b = self.cut_before(text, low, mid), self.cut_after(text, mid, high)
        gone = len(left) if a == low else len(self.short(text[a:mid]))
        lost = len(right) if b == high else len(self.short(text[mid:b]))
        return left[: len(left) - gone] + self.short(text[a:b]) + right[lost:]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        ids = self.part(text, 0, len(text))
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()


def coder(path: str, pattern: str) -> Coder:
    """One coder a Python worker and vocabulary."""
    if (path, pattern) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, pattern] = Coder(path, pattern)
    return _KEPT[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text as little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch) -> dict:
        c = coder(vocabulary, pattern)
        return {"doc_id": batch.column("doc_id"), "ids": [c.encode(x or "") for x in batch.column("text").to_pylist()]}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {dict(docs.dtypes)[id_col]}, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for."""

    def run(batch: pa.RecordBatch) -> dict:
        words = coder(vocabulary, pattern).words
        return {n: batch.column(n) for n in ("doc_id", "ids")} | {"decoded": [words.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]}

    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the result of decode()."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
