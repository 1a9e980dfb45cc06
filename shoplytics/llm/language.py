"""Language identification by nearest centroid.

A text becomes a vector of its letter n-grams (1 to 3 letters, case folded, a
blank at word edges), hashed to ``DIM`` places, with log(1 + count) weights
times the inverse document frequency of the training texts, scaled to length 1.
Every language has up to ``CLUSTERS`` centroids: spherical k-means over its
training vectors, so that a language may look several ways.  A text gets the
language of the centroid with the largest cosine.

Rejection: a text whose largest cosine lies below what ``REJECT`` of the winner's
own training texts had is marked ``rejected`` - the nearest language is still
named.  The score is (1 + cosine) / 2 scaled by the lead over the next language.

Fit: on at most about ``FIT_ROWS`` labelled rows per language (documented bound),
chosen by a hash of doc_id, so any partitioning chooses the same rows; the counts
per language that set the share come from all labelled rows.  The model is a few
MB whatever the input; prediction reads whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
text of a single letter is classified like any other; ties go to the language
that sorts first; rows that repeat give the same answer; null doc_id: held_out false,
never trained on; an empty table gives no rows; without any labelled row every text is
``und``; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytics.llm.common import pick

DIM = 4096
CLUSTERS = 3
FIT_ROWS = 600
REJECT = 0.005
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point: 1 if it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


_IS_LETTER = _letters()


def grams(text: str) -> np.ndarray | None:
    """Counts of hashed letter n-grams; None without a letter.  Emoji and other signs
    beyond the basic plane are no letters, letters there are."""
    units = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _IS_LETTER[units]
    if not letter.any():
        return None
    u = np.where(letter, units, 32).astype(np.uint64)
    keep = np.ones(len(u), dtype=bool)
    keep[1:] = (u[1:] != 32) | (u[:-1] != 32)  # one blank between words
    u = np.concatenate(([32], u[keep], [32])).astype(np.uint64)

    def place(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)  # 12 bits

    two = (u[:-1] << np.uint64(21)) | u[1:]
    three = (two[:-1] << np.uint64(21)) | u[2:]
    out = np.bincount(place(u[u != 32]), minlength=DIM) + np.bincount(place(two), minlength=DIM)
    return out + np.bincount(place(three), minlength=DIM)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts at the mean's farthest points, so no random choice."""
    centre = x.mean(0)
    first = int(np.argmin(x @ centre))
    picked = [first]
    while len(picked) < min(k, len(x)):
        nearest = (x @ x[picked].T).max(1)
        nearest[picked] = np.inf
        picked.append(int(np.argmin(nearest)))
    c = x[picked]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[at == j].sum(0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Centroids:
    """Languages (sorted), centroids with the language of each, idf, and rejection limits."""

    def __init__(self, texts: list[str], langs: list[str], clusters: int = CLUSTERS):
        got = [(grams(t), lang) for t, lang in zip(texts, langs)]
        got = [(g, lang) for g, lang in got if g is not None]
        self.langs = sorted({lang for _, lang in got})
        if not got:
            return
        counts = np.stack([g for g, _ in got])
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.1)
        x, y = _weigh(counts, self.idf), np.array([self.langs.index(lang) for _, lang in got])
        parts = [_clusters(x[y == i], clusters) for i in range(len(self.langs))]
        self.of = np.concatenate([np.full(len(p), i) for i, p in enumerate(parts)])
        self.centroids = np.concatenate(parts).astype(np.float32)
        best = (x @ self.centroids.T).max(1)
        self.least = [float(np.quantile(best[y == i], REJECT)) - 1e-5 for i in range(len(self.langs))]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        counts = grams(text) if isinstance(text, str) and self.langs else None
        if counts is None:
            return UNKNOWN, 0.0, True
        cos = self.centroids @ _weigh(counts, self.idf)
        by = np.full(len(self.langs), -1.0)
        np.maximum.at(by, self.of, cos)
        i = int(np.argmax(by))
        rest = np.delete(by, i)
        lead = by[i] - rest.max() if len(rest) else 1.0
        score = float(np.clip((1 + by[i]) / 2 * (0.5 + 0.5 * min(1.0, max(0.0, lead) * 10)), 0, 1))
        return self.langs[i], score, bool(by[i] < self.least[i])


def sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label (all, if fewer), by a hash of doc_id.
    The labels' counts come from all rows; one row per label goes to the driver."""
    share = rows.groupBy(label).count().select(
        F.col(label).alias("_label"), (F.lit(float(per_label)) / F.col("count")).alias("_share"))
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(share), F.col(label) == F.col("_label")).filter(at < F.col("_share")).drop("_label", "_share")


def fit(labelled: DataFrame, per_label: int = FIT_ROWS) -> Centroids:
    """From rows (doc_id, text, lang); those without text or lang are left out."""
    rows = sample(labelled.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL"), "lang", per_label)
    got = rows.select("doc_id", "text", "lang").orderBy("doc_id").collect()  # about per_label rows a language
    return Centroids([r.text for r in got], [r.lang for r in got])


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no label is learned from: crc32 of the id mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats per centroid: under 1 MB a language

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    d = pick(docs, "doc_id", "text")
    return d.select("doc_id", held_out().alias("held_out"), classify("text").alias("_p")).select("doc_id", "held_out", "_p.*")


def predict_languages(docs: DataFrame, per_label: int = FIT_ROWS) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row."""
    return identify(docs, fit(pick(docs, "doc_id", "text", "lang").filter(~held_out()), per_label))
