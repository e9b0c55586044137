"""Toxicity by boosted trees over dense features, calibrated by isotonic regression.

The lexicon is a short fixed seed and what a bounded sample of labelled texts teaches: words, and word
beginnings of four to six letters, that occur in toxic texts far more than in others. Of the sample,
two parts in five teach the lexicon and three the trees, so that no text judges words that it brought up
itself. Isotonic calibration is fitted at every size on cross-fitted scores: each of the three parts is
scored by trees that have seen the other two only; the final trees have seen all three. Features: lexicon
densities, second-person proximity, capitals, punctuation and obfuscation rates. Every whole text is
scored; labels are used for fitting only. The model is the same however its input is dealt.

Defined results: null and empty texts score as texts without words; texts of any length are read whole;
ids labelled more than once count as toxic if any label says so, and so do equal texts (that of the
smallest id stands for them, so repeated rows count once); null labels are ignored; without both kinds of
label among the trees' texts every score is the share of toxic labels (0.5 without any); equal texts get
equal scores; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.boosting import Isotonic, Trees
from skarn.llm.common import arrow_map, discard, materialise, ship

SEED = frozenset("idiot idiots moron morons stupid trash scum loser losers pathetic worthless disgusting clown dumb garbage".split())
YOU = frozenset("you your yours youre u ur du dein deine dich dir ihr tu te toi ton ta vous votre tú usted ustedes vosotros".split())
_WORD = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W\d_]+[*@$#!0-9]+[^\W\d_]+|[^\W\d_]\*{2,}")
_LEET = str.maketrans("013457@$!", "oieastasi")
# classes of bytes: 1 capital, 2 exclamation or question mark, 3 other punctuation, 4 digit
_CLASS = np.zeros(256, np.uint8)
for _bytes, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"!?", 2), (b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~", 3), (b"0123456789", 4)):
    _CLASS[list(_bytes)] = _k
# bytes that mask letters, and bytes of letters (every byte of a letter beyond ASCII is one)
_SIGN, _LETTER = np.zeros(256, np.int8), np.zeros(256, bool)
_SIGN[list(b"*@$#!0123456789")] = 1
_LETTER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = True
STEMS = (4, 5, 6)


def stems(word: str) -> list[str]:
    return ["^" + word[:k] for k in STEMS if len(word) > k]


class Words:
    """A lexicon with what it says of each word; words met before are remembered, up to a bound."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.roots = lexicon, roots_of(lexicon)
        self.met: dict[str, tuple | None] = {}

    def judge(self, w: str) -> tuple | None:
        """(weight, is a seed, is in the lexicon, has a stem in it) of a word that any of these holds for."""
        word, seed = self.lexicon.get(w), w in SEED
        stem = [self.lexicon[s] for s in stems(w) if s in self.lexicon] if w[:4] in self.roots else []
        value = word if word is not None else 3.0 if seed else None
        got = (max(value or 0.0, *stem) if stem else value, seed, word is not None, bool(stem)) if value is not None or stem else None
        if len(self.met) > 200_000:
            self.met.clear()
        self.met[w] = got
        return got

    def hits(self, words: set[str]) -> dict[str, tuple]:
        met, out = self.met, {}
        for w in words:
            got = met.get(w, 0)
            if got == 0:
                got = self.judge(w)
            if got:
                out[w] = got
        return out


def long_runs(text: str) -> int:
    """Runs of three or more of one letter."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = cp[1:] == cp[:-1]
    three = same[1:] & same[:-1]
    first = np.flatnonzero(three & ~np.r_[False, three[:-1]])
    return sum(c.isalnum() and not c.isdecimal() for c in map(text.__getitem__, first.tolist()))


def may_mask(raw: np.ndarray, text: str) -> bool:
    """Whether some run of masking signs stands between letters, or two stars; other texts need not be searched."""
    sign = _SIGN[raw]
    edge = np.diff(sign, prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # last: one past the run
    inner = (first > 0) & (last < len(raw))
    return bool((_LETTER[raw[first[inner] - 1]] & _LETTER[raw[last[inner]]]).any()) or "**" in text


def features(text: str, known: Words) -> list[float]:
    """Dense features of a text."""
    words = _WORD.findall(text.lower())
    n = len(words)
    each = set(words)
    hits = known.hits(each)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    masked = _MASKED.findall(text) if len(raw) and may_mask(raw, text) else []
    unmasked = sum(1 for m in masked if (plain := m.lower().translate(_LEET)) in SEED or plain in known.lexicon)
    n_seed = n_word = n_stem = near = 0
    weight = top = 0.0
    if hits:
        you = last = -100
        told = hits.keys() | (YOU & each)
        for k, w in [(k, w) for k, w in enumerate(words) if w in told]:
            if w in YOU:
                near += k - last <= 6
                you = k
            got = hits.get(w)
            if got is not None:
                v, seed, word, stem = got
                n_seed += seed
                n_word += word
                n_stem += stem
                weight += v
                top = max(top, v)
                near += k - you <= 6
                last = k
    kinds = np.bincount(_CLASS[raw], minlength=5) if len(raw) else np.zeros(5, np.int64)
    per, chars = n + 20.0, len(raw) + 100.0
    return [
        math.log1p(n), math.log1p(n_seed), math.log1p(n_word), math.log1p(n_stem), n_seed / per, n_word / per, n_stem / per, math.log1p(weight), weight / per, top,
        len(hits), near, near / per, kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, len(masked) / per, unmasked, long_runs(text) / per,
    ]


def roots_of(lexicon: dict[str, float]) -> frozenset[str]:
    return frozenset(s[1:5] for s in lexicon if s[0] == "^")


def featurise(docs: DataFrame, lexicon: dict[str, float], carry: str = "") -> DataFrame:
    """(doc_id, carried columns, x) of docs with doc_id and text."""
    known = Words(lexicon)
    names = [c.split()[0] for c in carry.split(",") if c.strip()]

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in ("doc_id", *names)} | {"x": [features(t or "", known) for t in batch.column("text").to_pylist()]}

    return arrow_map(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, {carry + ', ' if carry else ''}x array<double>")


def learn_lexicon(sample: DataFrame, least: int = 4, odds: float = 2.0) -> dict[str, float]:
    """Words and stems with their log odds, from a bounded sample (text, label): all that ``least`` toxic texts hold and that reach the odds."""

    def run(batch: pa.RecordBatch) -> dict:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = {w for w in _WORD.findall((text or "").lower()) if len(w) > 2}
            counts[label].update(words | {s for w in words for s in stems(w)})
        tokens = list(counts[1])  # tokens of other texts matter only where some toxic text has them too
        rest = [t for t in counts[0] if t not in counts[1]]
        return {"token": tokens + rest, "toxic": [counts[1][t] for t in tokens] + [0] * len(rest), "other": [counts[0][t] for t in tokens + rest]}

    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return {}
    each = arrow_map(sample.select("text", "label"), run, "token string, toxic long, other long")
    log_odds = F.log((F.col("toxic") + 0.1) / (sizes[1] + 0.2)) - F.log((F.col("other") + 0.1) / (sizes[0] + 0.2))
    total = each.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") >= least)
    rows = total.withColumn("v", log_odds).where(F.col("v") >= odds).collect()  # bounded as the sample is
    return {r.token: float(r.v) for r in sorted(rows, key=lambda r: r.token)}


def sample_labels(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled ids (doc_id, label), in the order of a hash of the id."""
    one = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


class Model:
    """Trees and the calibration of their scores; without both kinds of label, the share of toxic ones."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, calibrate: Isotonic | None, share: float) -> None:
        self.lexicon, self.trees, self.calibrate, self.share = lexicon, trees, calibrate, share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.trees is None else self.calibrate(self.trees.score(x))


def cross_fitted(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> tuple[Trees, Isotonic]:
    """Trees over all rows, and their calibration on scores of each part by trees over the others."""

    def grown(rows: np.ndarray) -> Trees:
        return Trees(rounds=60, least=max(3, min(10, int(rows.sum() // 50)))).fit(x[rows], y[rows])

    apart = np.zeros(len(y))
    for p in np.unique(part):
        others = part != p
        if others.any():
            apart[~others] = grown(others).score(x[~others])
    return grown(np.ones(len(y), bool)), Isotonic().fit(apart, y)


def fit(docs: DataFrame, labels: DataFrame, most: int = 30_000) -> Model:
    """Fit on at most ``most`` labelled rows. docs: doc_id, text; labels: doc_id, label (0 or 1)."""
    ids = sample_labels(labels, most)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    kept = materialise(texts.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)).cast("int")), "sample")
    sizes = {r.label: r["count"] for r in kept.groupBy("label").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    if len(sizes) < 2:
        discard(kept)
        return Model({}, None, None, share)
    lexicon = learn_lexicon(kept.where("part < 2"))
    rows = featurise(kept.where("part >= 2").select("doc_id", "text", "label", "part"), lexicon, "label int, part int").toPandas()
    discard(kept)
    rows = rows.sort_values(["part", "doc_id"], kind="stable")
    x, y, part = np.array(rows["x"].tolist(), float).reshape(len(rows), -1), rows["label"].to_numpy(float), rows["part"].to_numpy()
    if len(set(y)) < 2:
        return Model(lexicon, None, None, share)
    return Model(lexicon, *cross_fitted(x, y, part), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    known = Words(model.lexicon)
    ship(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array([features(t or "", known) for t in batch.column("text").to_pylist()], float)
        return {"doc_id": batch.column("doc_id"), "score": model.score(x)}

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; nothing is shuffled."""
    from collections.abc import Iterator

    ship(docs.sparkSession)
    known = Words(model.lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t or "", known) for t in batch.column("text").to_pylist()], float)
                yield batch.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
