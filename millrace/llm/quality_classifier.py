"""Compression classifier for quality.

Raw-content zstandard dictionaries are built from texts labelled good and bad, for three views of a text: its bytes,
its form (letters, capitals, digits and other scripts as classes) and its form with runs of letters as one sign.  A
text is compressed with both dictionaries of each view; the normalised size differences (good minus bad over their
sum: mean, largest and smallest over pieces) and the sizes a byte go through a logistic curve fitted on other labelled
rows, which makes the score a probability.

Training takes about ``sample`` labelled rows outside the held-out fold, half for the dictionaries and half for the
curve.  Defined cases: null and empty texts are scored like any other (an empty piece); without labels of both kinds
every score is the share of good labels (1/2 without any).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotate, label_fold
from millrace.llm.compression import Compressor, piece_sizes, pieces, raw_dictionary
from millrace.llm.toxicity import labelled_sample, logistic_fit

_FORM = bytes(
    ord("a") if 97 <= b <= 122 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("e") if b >= 128 else b
    for b in range(256)
)
_SMALL, _CAPITALS = re.compile(rb"[ae]+"), re.compile(rb"AA+")


def views(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    form = data.translate(_FORM)
    return [data, form, _SMALL.sub(b"a", _CAPITALS.sub(b"B", form))]


@dataclass(frozen=True)
class QualitySettings:
    folds: int = 5
    sample: int = 6_000
    dictionary_bytes: int = 64 << 10
    ridge: float = 0.01
    threshold: float = 0.3


@dataclass
class QualityModel:
    """(good, bad) dictionary content per view, and the curve over the features."""

    contents: list[tuple[bytes, bytes]]
    curve: list[float] | None
    prior: float

    def scorer(self):
        pairs = [(Compressor(good), Compressor(bad)) for good, bad in self.contents]

        def features(text: str) -> list[float]:
            out = []
            for view, pair in zip(views(text), pairs, strict=True):
                parts = pieces(view)
                lengths = np.array([len(p) + 1 for p in parts], dtype=np.float64)
                good, bad = piece_sizes(pair, parts)
                gap, rate = (good - bad) / (good + bad), np.minimum(good, bad) / lengths
                share = lengths / lengths.sum()
                out += [float(gap @ share), gap.max(), gap.min(), np.log(rate @ share), np.log(rate.min())]
            return [*out, 1.0]

        return features


def train_quality(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> QualityModel:
    sample = labelled_sample(docs, labels, "quality", settings.folds, settings.sample).filter("text is not null")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    excerpt = F.substring("text", 1, 1 << 14)
    rows = sample.filter(half == 0).select(excerpt.alias("text"), "label", F.xxhash64("doc_id").alias("o")).orderBy("o").collect()
    shown = {k: [views(r.text) for r in rows if (r.label > 0) == k] for k in (True, False)}
    contents = [tuple(raw_dictionary([v[i] for v in shown[k]], settings.dictionary_bytes) for k in (True, False)) for i in range(3)]
    model = QualityModel(contents, None, sum(r.label > 0 for r in rows) / len(rows) if rows else 0.5)

    def features():
        measure = model.scorer()
        return lambda texts: [[measure(t) for t in texts.to_pylist()]]

    measured = annotate(sample.filter(half == 1), features, "features array<double>").select("features", "label").collect()
    if len({r.label > 0 for r in measured}) == 2 and all(shown.values()):
        x, y = np.array([r.features for r in measured]), np.array([float(r.label > 0) for r in measured])
        model.curve = logistic_fit(x, y, settings.ridge).tolist()
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (higher: better) and predicted (1: good)."""

    def make():
        measure = model.scorer()

        def one(text: str) -> float:
            if model.curve is None:
                return model.prior
            return float(1 / (1 + np.exp(-np.clip(np.dot(measure(text), model.curve), -30, 30))))

        def work(texts: pa.Array) -> list:
            scores = [one(t) for t in texts.to_pylist()]
            return [scores, [int(s >= threshold) for s in scores]]

        return work

    return annotate(docs, make, "score double, predicted int")


def quality_digest(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    model = train_quality(docs, labels, settings)
    scored = score_quality(docs.select("doc_id", "text"), model, settings.threshold)
    return scored.select("doc_id", (label_fold(F.col("doc_id"), settings.folds) == 0).alias("held_out"), "score", "predicted")
