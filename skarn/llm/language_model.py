"""A word language model by deleted interpolation, counted and applied without shuffling single tokens.

P(w | v) = a(b) c(v w) / c(v) + u(b) c(w) / N + z(b) / (V + 1), where b is the bucket of the logarithm
of c(v), the frequency of the context. Contexts are the word before, or the start of the text. The
weights of each bucket are learned by expectation-maximisation: one part of the training texts is
deleted from the counts and its n-grams are the held-out counts; the final counts take it in again.

Texts are dealt into groups of a few megabytes by a hash of their id. Each group sends the sorted
64-bit keys of its distinct words and pairs, with its own counts, to the shard of each key; a shard
sums the counts of a key over all groups and answers each group in the order in which it asked. So a
word that stands everywhere costs one entry a group, no group or shard depends on single keys, and what
is gathered grows with the input. Numbers of groups and shards follow the input's size. Keys are whole
64-bit hashes: of a thousand million distinct words some 3 in 100 runs would hold one collision.

Defined results: null and empty texts are one end token; a null id counts as the id of empty text;
texts of any length are counted whole; repeated rows each get a row and count each; equal texts get equal
scores; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map, crc_mod, materialise, ship

END, START = b" end", b" start"  # no word holds a space
BUCKETS = 26
_STEP = 4  # quarters of a power of two in which probabilities are binned for the weights
_LOW = -100  # smallest binned exponent, in steps


def pack(values: np.ndarray) -> bytes:
    """Sorted words as compressed differences, most significant bytes first apart."""
    d = np.diff(values, prepend=values[:1] * 0).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(b).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    v = values.astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(b).view("<u8").ravel().astype(np.int64)


class Coded:
    """The texts of a group as numbers: one entry a token with the numbers of its word and of its pair."""

    def __init__(self, texts: list[bytes]) -> None:
        number: dict[bytes, int] = {END: 0, START: 1}
        rows = []
        for raw in texts:
            words = raw.lower().split()
            row = np.empty(len(words) + 2, np.int64)
            row[0], row[-1] = 1, 0
            row[1:-1] = [number.setdefault(w, len(number)) for w in words]
            rows.append(row)
        self.sizes = np.array([len(r) - 1 for r in rows], np.int64)
        every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        last = np.cumsum(self.sizes + 1) - 1
        first = last - self.sizes
        word, context = np.delete(every, first), np.delete(every, last)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)
        self.keys, rank = np.unique(hashes, return_inverse=True)
        self.word, self.context = rank[word], rank[context]
        mixed = (hashes[context] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[word] + np.uint64(0xD6E8FEB86659FD93))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        self.pairs, self.pair = np.unique(mixed, return_inverse=True)
        self.text = np.repeat(np.arange(len(rows)), self.sizes)


def asks(group: int, texts: list[bytes], train: np.ndarray, kept: np.ndarray, shards: int) -> pd.DataFrame:
    """A group's keys and counts for each shard; train, kept: the texts that count at last, and while learning weights."""
    c = Coded(texts)
    rows = []
    t, k = train[c.text], kept[c.text]
    starts = np.searchsorted(c.keys, np.uint64(xxhash.xxh64_intdigest(START)))
    for pair, keys, at in ((0, c.keys, c.word), (1, c.pairs, c.pair)):
        counts = [np.bincount(at[m], minlength=len(keys)) for m in (t, k)]
        if not pair and len(keys):
            counts[0][starts], counts[1][starts] = train.sum(), kept.sum()  # how often the start is a context
        shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if b > a:
                rows.append((s, group, pair, pack(keys[a:b]), pack_counts(counts[0][a:b]), pack_counts(counts[1][a:b])))
    return pd.DataFrame(rows, columns=["shard", "g", "pair", "keys", "train", "kept"])


def answers(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's sums for each group that asked, and (g = -1) its part of N and V."""
    start = np.uint64(xxhash.xxh64_intdigest(START))
    out = []
    for pair, some in rows.groupby("pair", sort=True):
        keys = [unpack(x) for x in some["keys"]]
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.bincount(at, np.concatenate([unpack_counts(x) for x in some[c]]), len(known)).astype(np.int64) for c in ("train", "kept")]
        edge = np.cumsum([0, *map(len, keys)])
        for g, a, b in zip(some["g"].tolist(), edge[:-1], edge[1:]):
            out.append((int(some["shard"].iloc[0]), g, int(pair), *(pack_counts(v[at[a:b]]) for v in totals), 0, 0, 0, 0))
        if not pair:
            words = [np.where(known == start, 0, v) for v in totals]
            out.append((int(some["shard"].iloc[0]), -1, 0, b"", b"", *(int(f(v)) for v in words for f in (np.sum, np.count_nonzero))))
    return pd.DataFrame(out, columns=["shard", "g", "pair", "train", "kept", "n_train", "v_train", "n_kept", "v_kept"])


ANSWER = "shard long, g long, pair int, train binary, kept binary, n_train long, v_train long, n_kept long, v_kept long"


def _looked_up(c: Coded, got: pd.DataFrame, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(w), c(v) and c(v w) at each token of a group."""
    sums = []
    for pair, keys in ((0, c.keys), (1, c.pairs)):
        some = got[got["pair"] == pair].sort_values("shard", kind="stable")
        v = np.concatenate([unpack_counts(x) for x in some[which]]) if len(some) else np.zeros(0, np.int64)
        if len(v) != len(keys):
            raise RuntimeError(f"asked for {len(keys)} keys, {len(v)} came back")
        sums.append(v)
    return sums[0][c.word], sums[0][c.context], sums[1][c.pair]


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def learn(bins: pd.DataFrame, v: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, 3) by expectation-maximisation; bins: b, n and the mean pair and word probabilities."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    for b, some in bins.groupby("b"):
        n, p = some["n"].to_numpy(float), np.stack([some["p2"].to_numpy(float), some["p1"].to_numpy(float), np.full(len(some), 1.0 / (v + 1))], axis=1)
        w = weights[int(b)].copy()
        if not p[:, 0].any():
            w = np.array([0.0, 0.8, 0.2])
        for _ in range(rounds):
            part = w * p
            part /= part.sum(axis=1, keepdims=True)
            w = (n[:, None] * part).sum(axis=0)
            w = (w + np.array([0.0, 1e-3, 1e-3]) * n.sum()) / (n.sum() * 1.002)  # no text gets probability 0
        weights[int(b)] = w
    weights[0] = [0.0, *(weights[0][1:] / weights[0][1:].sum())]
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 1, deleted: int = 4, group_bytes: int = 12 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Training texts are those whose crc32(id) mod ``modulus`` is not ``held``; of them those of remainder
    ``deleted`` are kept from the counts while the weights are learned. group_bytes: text of a group, about.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), crc_mod(F.col(id_col), modulus).cast("int").alias("r"))
    size = slim.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.lit(1))).first()
    groups = max(1, math.ceil(((size[0] or 0) + 64 * size[1]) / group_bytes))
    shards = max(1, math.ceil(groups / 2))
    # the deleted part has groups of its own, so that learning the weights reads no other text
    apart, rest = max(1, groups // modulus), max(1, groups - groups // modulus)
    h = F.xxhash64("doc_id", "text")
    dealt = slim.withColumn("g", F.when(F.col("r") == deleted, F.pmod(h, F.lit(apart))).otherwise(apart + F.pmod(h, F.lit(rest))))

    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows["r"].to_numpy()
        return asks(int(key[0]), [x.encode("utf-8", "surrogatepass") for x in rows["text"]], r != held, (r != held) & (r != deleted), shards)

    asked = dealt.select("g", "r", "text").groupBy("g").applyInPandas(ask, "shard long, g long, pair int, keys binary, train binary, kept binary")
    answered = materialise(asked.groupBy("shard").applyInPandas(answers, ANSWER), "counts")
    totals = answered.where("g = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "v_train", "n_kept", "v_kept")]).first()
    replies = answered.where("g >= 0").select("shard", "g", "pair", "train", "kept")

    # the weights: held-out pairs in bins of (bucket, pair probability, word probability), a table of fixed size
    n_kept = max(1, totals.n_kept)

    def events(key: tuple, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({k: [] for k in ("b", "i", "j", "n", "p2", "p1")})
        w, v, vw = _looked_up(Coded([x.encode("utf-8", "surrogatepass") for x in rows["text"]]), got, "kept")
        p1, p2 = w / n_kept, vw / np.maximum(v, 1)
        i, j = (np.where(p > 0, np.maximum(np.rint(_STEP * np.log2(np.maximum(p, 1e-30))), _LOW), _LOW - 1).astype(np.int64) for p in (p2, p1))
        f = pd.DataFrame({"b": bucket(v), "i": i, "j": j, "n": 1, "p2": p2, "p1": p1})
        return f.groupby(["b", "i", "j"], as_index=False).sum()

    binned = dealt.where(F.col("r") == deleted).groupBy("g").cogroup(replies.where(F.col("g") < apart).groupBy("g")).applyInPandas(events, "b long, i long, j long, n long, p2 double, p1 double")
    bins = binned.groupBy("b", "i", "j").agg(F.sum("n").alias("n"), (F.sum("p2") / F.sum("n")).alias("p2"), (F.sum("p1") / F.sum("n")).alias("p1")).toPandas()
    weights = learn(bins.sort_values(["b", "i", "j"]), totals.v_kept)
    n_train, v_train = totals.n_train, totals.v_train

    def scored(key: tuple, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        c = Coded([x.encode("utf-8", "surrogatepass") for x in rows["text"]])
        w, v, vw = _looked_up(c, got, "train")
        base = np.log10((w + 0.5) / (n_train + 0.5 * (v_train + 1)))
        a = weights[bucket(v)]
        p = a[:, 0] * vw / np.maximum(v, 1) + a[:, 1] * w / max(1, n_train) + a[:, 2] / (v_train + 1)
        first = np.cumsum(c.sizes) - c.sizes
        add = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame({
            "doc_id": rows["doc_id"].to_numpy(), "held_out": rows["r"].to_numpy() == held, "n_tokens": c.sizes, "n_known": add((w > 0).astype(np.int64)),
            "train_tokens": n_train, "base_score": add(base), "score": add(np.log10(p)),
        })

    out = dealt.groupBy("g").cogroup(replies.groupBy("g")).applyInPandas(scored, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
