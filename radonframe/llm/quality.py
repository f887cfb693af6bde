"""Quality classifier: a generalised additive model with pairwise interactions over features of the text alone.

At most ``TRAIN_ROWS`` labelled documents outside of the held-out fold, those first by a hash of the id, get their features (``FEATURES``), which
the driver fits the lookup tables to. The model has a fixed size and goes to the tasks with their code; one pass over all
whole texts takes their features and adds up table entries over Arrow batches.

Defined cases: null text counts as empty; a null id is never held out and never a training row; a null label is no label; several labels of one
document, or repeated documents, are training rows of their own; without training rows of both labels all scores
are alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gam
from .storage import stage

TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
FEATURES = (
    "log_words", "mean_word", "longest_word", "short_words", "distinct_words", "top_word", "repeated_triples", "upper", "digits", "non_ascii", "white", "commas", "stops", "exclamations", "pipes",
    "marks", "other_punctuation", "log_lines", "words_per_line", "repeated_lines", "lines_ended", "capital_words", "upper_words", "marked_words", "words_per_stop",
)
_MARKS = b"*#$%&@^~_=+<>{}[]\\/"
_SETS = {"upper": range(65, 91), "digits": range(48, 58), "non_ascii": range(128, 256), "white": b" \t\n\r\x0b\x0c", "commas": b",;:", "stops": b".", "exclamations": b"!", "pipes": b"|", "marks": _MARKS}
_CLASS = np.full(256, len(_SETS) + 1, np.int64)
for _k, _chars in enumerate(_SETS.values()):
    _CLASS[list(_chars)] = _k
_CLASS[list(range(97, 123))] = len(_SETS)


def features(text: str | None) -> list[float]:
    """The numbers of ``FEATURES`` for one text."""
    raw = (text or "").encode()
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(_SETS) + 2) / max(len(raw), 1)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    triples = set(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(len(words)), sizes.mean(), sizes.max(), (sizes <= 3).mean(), len(counts) / n, max(counts.values(), default=0) / n, 1 - len(triples) / max(len(words) - 2, 1) if len(words) > 2 else 0.0,
        *kinds[: len(_SETS)], kinds[-1],
        np.log1p(len(lines)), n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(len(lines), 1),
        sum(w[:1].isupper() for w in words) / n, sum(w.isupper() and len(w) > 1 for w in words) / n, sum(w[-1:] in _MARKS or w[:1] in _MARKS for w in words) / n, len(words) / (raw.count(b".") + 1),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([features(x.as_py()) for x in b.column(1)], np.float32).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(rows), pa.list_(pa.float32()))], ["doc_id", "x"])


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> gam.Gam:
    """Fit on at most ``limit`` labelled rows outside of the held-out fold, those first by a hash of the id; only their texts get features."""
    known = labels.filter("quality is not null").select(F.col("doc_id").cast("long"), "quality")
    ids = docs.select(F.col("doc_id").cast("long")).filter(~held_out(F.col("doc_id"))).join(known.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    chosen = stage(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "train-ids")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id", "left_semi")  # at most ``limit`` numbers
    x = texts.mapInArrow(_features, "doc_id long, x array<float>")
    rows = x.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(limit).select("x", "quality").toArrow()
    return gam.fit(matrix(rows.column("x").combine_chunks()) if rows.num_rows else np.empty((0, len(FEATURES))), rows.column("quality").to_numpy().astype(float))


def _scores(model: gam.Gam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(x.as_py()) for x in b.column(1)], np.float32).astype(np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(rows))], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scores(train(docs, labels)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t) for t in texts], np.float32).astype(np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(rows))

    return docs.filter(score(F.col("text").cast("string")) >= threshold)
