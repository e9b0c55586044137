"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance; covariances shrink towards the pooled one and towards its
diagonal. The score is the logistic of the difference of log densities plus log priors, computed from
Mahalanobis distances with Cholesky factors that are taken once when the model is fitted. Sums of the
statistics and of their products are gathered over all labelled training rows in one aggregation whose
result has a fixed size.

Defined results: null and empty texts score as texts without words; texts of any length are read whole;
ids labelled more than once take the lowest label; null labels are ignored; without both labels every
score is the share of label 1 (0.5 without any); equal texts get equal scores; repeated rows each get a row
and, if labelled, count each; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map, materialise

_SIGN = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 sign of #*$%&|<>, 4 ! or ?, 5 other punctuation, 6 lower case
for _bytes, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"#*$%&|<>", 3), (b"!?", 4), (b"\"'()+,-./:;=@[\\]^_`{}~", 5), (b"abcdefghijklmnopqrstuvwxyz", 6)):
    _SIGN[list(_bytes)] = _k
_ODD = re.compile(r"[^\w\s.,;:'\"()-]+(?:\s|$)")
NAMES = ("log_words", "word_length", "capitals", "digits", "signs", "exclaims", "punctuation", "odd_ends", "repeats", "distinct", "top_share", "lines", "dup_lines", "entropy")
D = len(NAMES)


def statistics(text: str) -> list[float]:
    """Transformed statistics; rates are drawn to usual values by a few words, so that short texts don't stand out."""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_SIGN[raw], minlength=7) if len(raw) else np.zeros(7, np.int64)
    counts = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    top = counts.most_common(1)[0][1] if n else 0
    lines = [x for x in text.split("\n") if x.strip()]
    letters = kinds[1] + kinds[6] + 60.0
    chars = len(raw) + 60.0
    values = np.fromiter(counts.values(), float, len(counts))
    p = values / n if n else values
    spread = -float((p * np.log(p)).sum()) / math.log(n + 2) if n else 0.0

    def rate(x: float, of: float, usual: float, floor: float = 0.002) -> float:
        return math.log((x + usual * 10) / (of + 10) + floor)

    return [
        math.log1p(n), math.log((sum(map(len, words)) + 50) / (n + 10)), math.log((kinds[1] + 2) / letters), rate(kinds[2], chars, 0.002), rate(kinds[3], chars, 0.0), rate(kinds[4], chars, 0.0),
        rate(kinds[5], chars, 0.02), rate(len(_ODD.findall(text)), n, 0.0), rate(repeats, n, 0.01, 0.005), math.log((len(counts) + 10) / (n + 10)), rate(top, n, 0.06, 0.01),
        rate(len(lines), n, 0.03), rate(len(lines) - len(set(lines)), len(lines), 0.0, 0.02), spread,
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row, written once: fitting and scoring share it."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "x": [statistics(t or "") for t in batch.column("text").to_pylist()]}

    return materialise(arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {dict(docs.dtypes)[id_col]}, x array<double>"), "statistics")


class Model:
    def __init__(self, share: float, classes: list[tuple[float, np.ndarray, np.ndarray, float]]) -> None:
        self.share, self.classes = share, classes  # log prior, mean, inverse Cholesky factor, half log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.share)
        logs = []
        for prior, mean, inverse, half in self.classes:
            z = (x - mean) @ inverse.T
            logs.append(prior - half - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -35, 35)))


def fit(measured: DataFrame, labels: DataFrame, pooled: float = 0.1, ridge: float = 0.05) -> Model:
    """Fit on all rows of measured that labels (doc_id, label) names.

    pooled: weight of the pooled covariance; ridge: of the diagonal of the pooled one.
    """
    one = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    pairs = [(i, j) for i in range(D) for j in range(i, D)]

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, D)
        y = batch.column("label").to_numpy(zero_copy_only=False)
        out: dict[str, list] = {"label": [], "k": [], "v": []}
        for c in (0, 1):
            s = x[y == c]
            sums = [float(len(s)), *s.sum(axis=0), *(s.T @ s)[tuple(zip(*pairs))]]
            out["label"] += [c] * len(sums)
            out["k"] += range(len(sums))
            out["v"] += sums
        return out

    parts = arrow_map(measured.join(one, "doc_id").select("x", "label"), run, "label int, k int, v double")
    rows = parts.groupBy("label", "k").agg(F.sum("v").alias("v")).collect()  # 2 (1 + D + D (D + 1) / 2) rows
    sums = np.zeros((2, 1 + D + len(pairs)))
    for r in rows:
        sums[r.label, r.k] = r.v
    n = sums[:, 0]
    share = n[1] / n.sum() if n.sum() else 0.5
    if min(n) < 2:
        return Model(float(share), [])
    means = sums[:, 1 : D + 1] / n[:, None]
    covs = np.zeros((2, D, D))
    for c in (0, 1):
        for (i, j), v in zip(pairs, sums[c, D + 1 :]):
            covs[c, i, j] = covs[c, j, i] = v / n[c] - means[c, i] * means[c, j]
    both = (n[:, None, None] * covs).sum(axis=0) / n.sum()
    base = np.diag(np.diag(both) + 1e-6)
    classes = []
    for c in (0, 1):
        few = D / (D + n[c])  # small classes lean on the pooled covariance
        a = pooled + (1 - pooled) * few
        cov = (1 - ridge) * ((1 - a) * covs[c] + a * both) + ridge * base
        factor = np.linalg.cholesky(cov)
        classes.append((math.log(n[c] / n.sum()), means[c], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Model(float(share), classes)


def score(measured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of measured."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": model.score(np.array(batch.column("x").to_pylist(), float).reshape(-1, D))}

    return arrow_map(measured.select("doc_id", "x"), run, f"doc_id {dict(measured.dtypes)['doc_id']}, score double")
