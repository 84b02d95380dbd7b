"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's evidence is a linear score of its own features and of
those of the lines before and after it; a transition matrix ties neighbouring labels. Forward and
backward passes give each line's marginal, and the mean of the marginals of good, weighted by line
length, is the document's score. The field is fitted on the driver, by gradient ascent on the
likelihood, to a bounded sample of labelled documents whose lines all carry the document's label; of a
document with many lines the sample holds a stretch of neighbouring ones, wherever a hash of its id says.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bounds of the sample that the field is fitted to: documents, and neighbouring lines of one of them.
SAMPLE_DOCS, SAMPLE_LINES = 2500, 128
FOLDS = 5
THRESHOLD = 0.3
ROUNDS, RATE, RIDGE = 120, 0.08, 1e-4
#: Lines whose marginals are computed at a time.
CELLS = 1 << 18

_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_UPPERS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SENTENCE = b".,;:'\"-()?"
_SPACE = b" \t\r\x0b\x0c"
_WIDE_UPPER = re.compile(r"[À-ÖØ-Þ]")
N_OWN = 16


def line_features(line: str) -> list[float]:
    """Features of one line; none depends on the language or on single words."""
    raw = line.encode()
    n = len(raw)
    if not raw.strip():
        return [0.0] * (N_OWN - 1) + [1.0]
    words = raw.split()
    n_words = len(words)
    letters = n - len(raw.translate(None, _LETTERS))
    upper = n - len(raw.translate(None, _UPPERS)) + (2 * len(_WIDE_UPPER.findall(line)) if not line.isascii() else 0)
    digits = n - len(raw.translate(None, _DIGITS))
    usual = n - len(raw.translate(None, _SENTENCE))
    spaces = n - len(raw.translate(None, _SPACE))
    odd = max(0, n - letters - digits - usual - spaces)
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    short = sum(len(w) <= 3 for w in words)
    return [
        min(np.log1p(n) / 6, 3.0),
        letters / n,
        upper / max(1, letters),
        digits / n,
        usual / n,
        odd / n,
        np.sqrt(odd / n_words),
        distinct / n_words,
        same / n_words,
        min(n / n_words / 10, 3.0),
        short / n_words,
        float(raw[-1] in b".!?"),
        float(n_words < 4),
        min(np.log1p(n_words) / 5, 3.0),
        float(upper / max(1, letters) > 0.5),
        0.0,
    ]


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def chain_features(lines: list[str]) -> np.ndarray:
    """(lines, features): bias, the line's own features, those of its neighbours (nothing beyond the ends)."""
    own = np.array([line_features(x) for x in lines], dtype=np.float32).reshape(len(lines), N_OWN)
    out = np.zeros((len(lines), 1 + 3 * N_OWN + 2), dtype=np.float32)
    out[:, 0] = 1
    out[:, 1 : 1 + N_OWN] = own
    out[1:, 1 + N_OWN : 1 + 2 * N_OWN] = own[:-1]
    out[:-1, 1 + 2 * N_OWN : 1 + 3 * N_OWN] = own[1:]
    out[:1, -2] = 1
    out[-1:, -1] = 1
    return out


def forward_backward(evidence: np.ndarray, there: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains in rows, filled from the left and the longest first: log forward and backward tables (chains, lines, 2) and log Z.

    evidence: score of label 1 for every line (label 0 has 0); step: (2, 2) transition scores. A step works on the chains that
    are still going on, so the work is that of the lines that are there.
    """
    chains, length = evidence.shape
    going, sizes = there.sum(axis=0), there.sum(axis=1)
    ahead, behind = np.zeros((chains, length, 2)), np.zeros((chains, length, 2))
    ahead[:, 0, 1] = evidence[:, 0]
    for t in range(1, length):
        n = going[t]
        a, b = ahead[:n, t - 1, 0], ahead[:n, t - 1, 1]
        ahead[:n, t, 0] = np.logaddexp(a + step[0, 0], b + step[1, 0])
        ahead[:n, t, 1] = np.logaddexp(a + step[0, 1], b + step[1, 1]) + evidence[:n, t]
    for t in range(length - 2, -1, -1):
        n = going[t + 1]
        a, b = behind[:n, t + 1, 0], behind[:n, t + 1, 1] + evidence[:n, t + 1]
        behind[:n, t, 0] = np.logaddexp(a + step[0, 0], b + step[0, 1])
        behind[:n, t, 1] = np.logaddexp(a + step[1, 0], b + step[1, 1])
    end = ahead[np.arange(chains), sizes - 1]
    return ahead, behind, np.logaddexp(end[:, 0], end[:, 1])


def likelihood(theta, x, row, col, there, gold, steps) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold paths for each line, less the ridge, and its gradient.

    theta: weights of the features and the four transition scores; x: features of all lines, which stand at
    (row, col) of the chains; gold: their labels; steps: transitions from each label to itself on gold paths.
    """
    w, step = theta[:-4], theta[-4:].reshape(2, 2)
    e = np.zeros(there.shape)
    e[row, col] = x @ w
    ahead, behind, z = forward_backward(e, there, step)
    p1 = np.exp(ahead[..., 1] + behind[..., 1] - z[:, None])[row, col]
    r, c = row[col > 0], col[col > 0]
    after = behind[r, c] + np.stack([np.zeros(len(r)), e[r, c]], axis=1)
    expected = np.exp(ahead[r, c - 1][:, :, None] + step + after[:, None, :] - z[r, None, None]).sum(axis=0)
    value = (gold * e[row, col]).sum() + (np.diag(steps) * step).sum() - z.sum()
    gradient = np.concatenate([x.T @ (gold - p1), (np.diag(steps) - expected).ravel()])
    return value / len(x) - RIDGE / 2 * (theta**2).sum(), gradient / len(x) - RIDGE * theta


class LineField:
    """The fitted field."""

    def __init__(self, mean, scale, weights, step, prior):
        self.mean, self.scale, self.weights, self.step, self.prior = mean, scale, weights, step, prior

    @classmethod
    def fit(cls, chains: list[np.ndarray], labels: list[int]) -> LineField:
        """chains: features of the lines of each document; labels: 0 or 1 for each document."""
        prior = float(np.mean(labels)) if labels else 0.5
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        chains, labels = [chains[i] for i in order], [labels[i] for i in order]
        x = np.concatenate(chains) if chains else np.zeros((0, 3 + 3 * N_OWN), dtype=np.float32)
        if len(set(labels)) < 2:
            return cls(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), np.zeros((2, 2)), prior)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        mean[0], scale[0] = 0, 1
        x = ((x - mean) / scale).astype(np.float64)
        sizes = np.array([len(c) for c in chains])
        row = np.repeat(np.arange(len(chains)), sizes)
        col = np.concatenate([np.arange(n) for n in sizes])
        there = np.zeros((len(chains), sizes.max()), dtype=bool)
        there[row, col] = True
        y = np.array(labels)
        # the gold path stays on the document's label
        gold = np.where(there, y[:, None], 0)[row, col]
        steps = np.bincount(y, weights=sizes - 1, minlength=2)
        theta = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, ROUNDS + 1):
            _, g = likelihood(theta, x, row, col, there, gold, steps)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return cls(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), prior)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean marginal of good for each text; the prior where a text has no characters."""
        out = np.full(len(texts), self.prior)
        evidence, weights = [], []
        for text in texts:
            lines = lines_of(text)
            f = chain_features(lines) if lines else np.zeros((0, len(self.mean)), dtype=np.float32)
            evidence.append(((f - self.mean) / self.scale) @ self.weights)
            weights.append(np.array([len(x) for x in lines], dtype=np.float64))
        order = sorted((i for i in range(len(texts)) if weights[i].sum() > 0), key=lambda i: -len(evidence[i]))
        at = 0
        while at < len(order):
            end = at + 1  # chains of like length together, as many as fit
            while end < len(order) and (end - at + 1) * len(evidence[order[at]]) <= CELLS:
                end += 1
            group = order[at:end]
            e = np.zeros((len(group), len(evidence[group[0]])))
            there = np.zeros(e.shape, dtype=bool)
            w = np.zeros(e.shape)
            for k, i in enumerate(group):
                n = len(evidence[i])
                e[k, :n], w[k, :n], there[k, :n] = evidence[i], weights[i], True
            ahead, behind, z = forward_backward(e, there, self.step)
            good = np.exp(np.minimum(ahead[..., 1] + behind[..., 1] - z[:, None], 0.0))
            out[group] = (good * w).sum(axis=1) / w.sum(axis=1)
            at = end
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is a multiple of FOLDS; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> LineField:
    """The field fitted to at most `sample` labelled documents that are not held out, chosen by a hash of their ids.

    A document of more than SAMPLE_LINES lines, however long, teaches by a stretch of so many, with the neighbours they have in
    the whole text. Documents whose labels disagree or are null, or without doc_id or text, teach nothing. If
    both classes are not there, every text scores the share of good ones. doc_id may be of any type that both tables share. Other columns are not
    read, whatever their names.
    """
    agreed = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
    # a bounded number of ids: the only thing that is broadcast
    ids = agreed.where("y = y2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).select(F.col("doc_id").alias("id"), "y")
    texts = docs.where("text is not null and text <> ''").select("doc_id", "text")
    picked = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "y", "text")
    first = picked.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text"))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "y": f["y"], "x": [stretch(chain_features(lines_of(t)), i).tobytes() for i, t in zip(f["id"], f["text"], strict=True)]})

    found = first.orderBy(F.xxhash64("id"), "id").limit(sample).mapInPandas(features, f"id {ids.schema['id'].dataType.simpleString()}, y int, x binary").collect()
    rows = sorted(found, key=lambda r: r.id)
    width = 3 + 3 * N_OWN
    return LineField.fit([np.frombuffer(r.x, dtype=np.float32).reshape(-1, width) for r in rows], [r.y for r in rows])


def stretch(features: np.ndarray, doc_id: int, most: int = SAMPLE_LINES) -> np.ndarray:
    """The rows of `most` neighbouring lines, beginning where a hash of the id says; all rows if there are no more."""
    start = zlib.crc32(str(doc_id).encode()) % max(1, len(features) - most + 1)
    return features[start : start + most]


def score_column(spark: SparkSession, field: LineField, text: str = "text") -> Column:
    shipped = pickle.dumps(field)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = pickle.loads(shipped)
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series(np.concatenate([fitted.scores(texts[i : i + 512]) for i in range(0, len(texts), 512)]) if texts else [], dtype="float64")

    return of(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts score the share of good documents in the sample; a very long text is scored whole, all its lines in one
    chain. Repeated rows and null doc_ids give a row each; an empty table gives none; labels, lang, source and doc_id are no
    inputs of a score. Other columns are not read, whatever their names.
    """
    field = fit(docs, labels)
    out = docs.select("doc_id", held_out().alias("held_out"), score_column(docs.sparkSession, field).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_crf": query}
