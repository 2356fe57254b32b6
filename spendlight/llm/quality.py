"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One narrow pass turns every whole text into a few statistics (counts of bytes, words and lines,
logged or as shares). Per class the mean and the covariance of the labelled rows are summed up by
the tasks; each covariance is shrunk towards the pooled one and towards its own mean variance, and its
Cholesky factor is kept. A document's score comes from the difference of the two log densities,
each a Mahalanobis distance solved with the cached factor plus the log determinant. Labels of the
held-out third are never joined; lang, source and doc_id never reach the statistics.

Nulls: a null text counts as empty; an empty text has all statistics zero and gets a score like any
other. Labels other than 0 and 1, null ids and null labels teach nothing; a doc_id with several
labels teaches each. Without both classes among the labels every score is the share of label 1 (0.5
without labels). Repeated and equal rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.llm.tables import held_out, table, text_key, without_texts
from spendlight.storage import cut

NAMES = (
    "log_words", "word_bytes", "upper", "marks", "bars", "symbols", "digits", "other_bytes", "stops", "lines",
    "variety", "repeat_next", "repeat_near", "longest_run", "top_word", "marked_words", "title_words", "repeat_lines",
)
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05
#: Divides the log density difference, so that scores stay apart from 0 and 1.
TEMPERATURE = 4.0
#: Added to every denominator of a share.
PADDING = 12

_CLASS = np.zeros(256, np.int64)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"!?", 3), (b"|", 4), (b"#$%&*@~^_=+<>{}[]\\/", 5), (b"0123456789", 6), (b".,;:", 7), (b" \t\r\x0b\x0c", 8), (b"\n", 9)):
    _CLASS[list(_chars)] = _kind
_MARKS = b"!?|#$%&*@~^_=+<>{}[]\\/"


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of one whole text, in the order of NAMES."""
    text = text or b""
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10) if text else np.zeros(10)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(text)
    letters = max(1, kinds[1] + kinds[2] + kinds[0])
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    nexts = sum(map(bytes.__eq__, words, words[1:]))
    near = sum(map(bytes.__eq__, words, words[2:])) + sum(map(bytes.__eq__, words, words[3:]))
    run = longest = 1
    if nexts:
        for a, b in zip(words, words[1:], strict=False):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    marked = sum(w[-1] in _MARKS for w in words)
    title = sum(65 <= w[0] <= 90 for w in words)
    lines = text.split(b"\n")
    # a few clean words are added to every count, so that a very short text is not judged by one word
    rate = lambda x, of: float(np.log1p(100.0 * x / (of + PADDING)))
    return [
        float(np.log1p(n)), float(np.log1p((size - kinds[8] - kinds[9]) / n)),
        rate(kinds[2], letters), rate(kinds[3], n), rate(kinds[4], n), rate(kinds[5], n), rate(kinds[6], size), rate(kinds[0], size), rate(kinds[7], n), rate(kinds[9], n),
        float(np.log(len(counts)) - 0.8 * np.log(n)), rate(nexts, n), rate(near, n), float(np.log(longest)), rate(max(counts.values()) if n > 20 else 0, n), rate(marked, n), rate(title, n), rate(len(lines) - len(set(lines)), len(lines)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, x array<float>)``, one row per document; key names its text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            x = np.array([statistics(t) for t in texts], np.float32).reshape(-1)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(x))], ["doc_id", "key", "x"])

    slim = docs.select("doc_id", text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, key string, x array<float>")


def class_sums(labelled: DataFrame) -> DataFrame:
    """``(label, i, value)``: per class the count, the sums and the sums of products of the statistics."""
    d = len(NAMES)

    def run(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().astype(np.float64).reshape(-1, d)
                label = batch.column(1).to_numpy()
                for c in (0, 1):
                    own = x[label == c]
                    sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
        c, i = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(sums[c, i])], ["label", "i", "value"])

    return labelled.select("x", F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, i int, value double").groupBy("label", "i").agg(F.sum("value").alias("value"))


def fit(labelled: DataFrame) -> dict:
    """The two classes' means, inverse Cholesky factors and log determinants, from rows ``(x, label)``."""
    d = len(NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    for r in class_sums(labelled).collect():  # 2 classes x 343 sums at most, whatever the input
        sums[r["label"], r["i"]] = r["value"]
    n = sums[:, 0]
    if n.min() < 2:
        return {"constant": float((n[1] + 1) / (n.sum() + 2))}
    mean = sums[:, 1 : 1 + d] / n[:, None]
    cov = np.stack([sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled) + np.diag(np.cov(mean.T)), 1e-6))
    model = {"scale": scale, "prior": float(np.log(n[1] / n[0]))}
    for c in (0, 1):
        own, both = cov[c] / np.outer(scale, scale), pooled / np.outer(scale, scale)
        own = (1 - SHRINK_POOLED) * own + SHRINK_POOLED * both
        own = (1 - SHRINK_DIAGONAL) * own + SHRINK_DIAGONAL * np.eye(d) * max(np.trace(own) / d, 1e-3)
        factor = np.linalg.cholesky(own)
        model[c] = (mean[c] / scale, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()))
    return model


def score(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    z = x / model["scale"]
    density = []
    for c in (0, 1):
        mean, inverse, log_det = model[c]
        density.append(-0.5 * ((((z - mean) @ inverse.T) ** 2).sum(axis=1) + log_det))
    return 1 / (1 + np.exp(-np.clip((density[1] - density[0] + model["prior"]) / TEMPERATURE, -700, 700)))


def with_labels(marked: DataFrame, labels: DataFrame, column: str, fold: int, folds: int) -> DataFrame:
    """Rows of ``marked`` outside the held-out fold with their 0/1 label."""
    own = labels.where(~held_out(fold, folds) & F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("label"))
    return marked.hint("merge").join(own.hint("merge"), "doc_id")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, key, score)`` for every document; key names its text."""
    marked = cut(document_statistics(docs))
    model = fit(with_labels(marked, labels, "quality", 1, 3))

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().astype(np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score(x, model))], ["doc_id", "key", "score"])

    return marked.mapInArrow(run, f"doc_id {dict(marked.dtypes)['doc_id']}, key string, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    return scores(docs, labels).select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text scores under 0.5, each row by its own text."""
    return without_texts(docs, cut(scores(docs, labels).where("score < 0.5").select("key").distinct()), "key")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher is better), predicted (1 if score >= 0.5)."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
