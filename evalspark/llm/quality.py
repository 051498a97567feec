"""Quality scores learned from preference pairs (Bradley-Terry).

Of a labelled document of quality 1 and one of quality 0 the first is preferred. The score of a document is
linear in features of its text, and the probability of a preference is the logistic function of the
difference of two scores; so the loss is logistic in feature differences. The weights are fitted to a
bounded sample of labelled documents, whatever the order of the rows. The threshold is the quantile of the scores of
all labelled documents that cuts off their share of quality 0. All documents are scored in their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import output_schema, replaced, saved, slices, utf8
from evalspark.operators.ranks import values_at_ranks
from evalspark.session import scratch_path

# bounds of what training collects: labelled documents of either quality, and pairs of them
SAMPLE_PER_CLASS = 2000
PAIRS = 10_000
RIDGE = 1e-3
STEPS = 30
SPREAD_LIMIT = 6.0
# a text of so many bytes counts half by its own features, half by those of a typical good document
HALF_BYTES = 30

_BYTES = np.arange(256)
_GROUPS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "blank": (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)),
    "wide": _BYTES >= 128,
    "control": (_BYTES < 32) & ~((_BYTES >= 9) & (_BYTES <= 13)),
}
_GROUPS["mark"] = ~np.any(list(_GROUPS.values()), axis=0)
_GROUP_MATRIX = np.array(list(_GROUPS.values()), dtype=float).T
# the marks and capitals one by one, and the letters as a group: what tells text from junk, not topics
_SINGLE = np.flatnonzero(_GROUPS["mark"])


def features(text: bytes) -> np.ndarray:
    """Features of a text: shares of kinds of characters, of words and lines that recur, and lengths.

    The last number is the text's size in bytes, by which a model weighs the others.
    """
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    words = text.split()
    lines = [x for x in (line.strip() for line in text.split(b"\n")) if x]
    kinds = counts @ _GROUP_MATRIX / size
    total = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:])))
    shape = [
        np.log1p(len(words)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(lengths.max()),
        len(set(words)) / np.sqrt(total),
        len(set(words)) / total,
        pairs / max(1, total - 1),
        sum(w.isupper() for w in words) / total,
        sum(w[:1].isalpha() or w[0] > 127 for w in words) / total,
        sum(w[-1:].isalpha() or w[-1] > 127 for w in words) / total,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        sum(x.endswith((b".", b"!", b"?", b":", b'"')) for x in lines) / max(1, len(lines)),
    ]
    return np.concatenate([kinds, np.sqrt(counts[_SINGLE] / size), shape, [len(text)]])


def _weighed(rows: np.ndarray, typical: np.ndarray) -> np.ndarray:
    own = rows[:, -1:] / (rows[:, -1:] + HALF_BYTES)
    return typical + own * (rows[:, :-1] - typical)


@dataclass(frozen=True)
class Model:
    """Weights of the standardized features and the threshold; ``score`` is in [0, 1]."""

    typical: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def rank(self, rows: np.ndarray) -> np.ndarray:
        own = _weighed(rows, self.typical)
        scaled = np.clip((own - self.mean) / self.spread, -SPREAD_LIMIT, SPREAD_LIMIT)
        # a matrix product would round by the place of a row in its batch
        return (scaled * self.weights).sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability that the document would be preferred to one at the threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.threshold - self.rank(rows), -500, 500)))


def fit_preferences(rows: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Fits the weights by Newton steps on pairs drawn from both qualities.

    Where one quality is missing there is nothing to prefer: all weights are 0 and all scores 0.5.
    """
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    width = rows.shape[1] - 1
    if not len(good) or not len(bad):
        none = np.zeros(width)
        return Model(none, none, np.ones(width), none, 0.0)
    typical = np.median(rows[good, :-1], axis=0)
    rows = _weighed(rows, typical)
    mean, spread = rows.mean(axis=0), rows.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    scaled = np.clip((rows - mean) / spread, -SPREAD_LIMIT, SPREAD_LIMIT)
    random = np.random.default_rng(seed)
    differences = scaled[random.choice(good, PAIRS)] - scaled[random.choice(bad, PAIRS)]
    weights = np.zeros(width)
    for _ in range(STEPS):
        doubt = 1.0 / (1.0 + np.exp(np.clip(differences @ weights, -500, 500)))
        gradient = RIDGE * weights - differences.T @ doubt / PAIRS
        curve = (differences.T * (doubt * (1 - doubt))) @ differences / PAIRS
        step = np.linalg.solve(curve + RIDGE * np.eye(width), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    ordered = np.sort(scaled @ weights)
    cut = len(bad)
    return Model(typical, mean, spread, weights, float((ordered[cut - 1] + ordered[cut]) / 2))


def _ranked(model: Model):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = np.array([features(t) for t in utf8(part, "text")])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(model.rank(rows))], names=["doc_id", "rank"]
                )

    return rank


def cut_off(docs: DataFrame, open_: DataFrame, model: Model) -> float:
    """The rank that as many labelled documents stay below as have quality 0.

    It lies halfway between two ranks of documents of ``open_`` (doc_id, quality). Documents are ranked in their tasks, only ids and ranks
    meet the labels. Where fewer than two labels find a document or all have one quality, it is the model's own.
    """
    ranks = (
        docs.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .select("doc_id", "text")
        .mapInArrow(_ranked(model), "doc_id bigint, rank double")
        .join(open_, "doc_id")
    )
    ranks = saved(ranks.select("quality", "rank"), scratch_path(docs.sparkSession, "label-ranks"))
    total, bad = ranks.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 0)).first()
    if not 0 < bad < total:
        return model.threshold
    # a row for each of the two wanted ranks
    both = values_at_ranks(ranks, [], "rank", [F.lit(bad - 1).cast("bigint"), F.lit(bad).cast("bigint")])
    return float(both.agg(F.avg("value")).first()[0])


def is_held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [features(t).tolist() for t in utf8(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("place"), part.column("quality"), pa.array(rows, pa.list_(pa.float64()))],
                names=["place", "quality", "features"],
            )


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, seed: int = 7) -> Model:
    """Fits the model to at most ``per_class`` labelled documents of either quality.

    Only documents that aren't held out are taken; which ones follows from the hash of their id. Of rows with the same id
    the least text is taken. Labels other than 0 and 1 and rows without an id play no part. The threshold comes from all
    labelled documents that aren't held out.
    """
    open_ = (
        labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .where(F.col("quality").isin(0, 1))
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
        .distinct()
    )
    place = F.xxhash64("doc_id", F.lit(seed)).alias("place")
    drawn = [
        open_.where(F.col("quality") == q).select("doc_id", "quality", place)
        .orderBy("place", "doc_id").limit(per_class)
        for q in (0, 1)
    ]
    sample = drawn[0].unionByName(drawn[1])
    # at most a row for each of the 2 * per_class rows of the sample
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "quality", "place")
        .agg(F.min("text").alias("text"))
        .mapInArrow(_features_of, "place long, quality int, features array<double>")
        .toArrow()
        .sort_by([("quality", "ascending"), ("place", "ascending")])
    )
    width = len(features(b""))
    matrix = np.array(rows.column("features").to_pylist(), dtype=float).reshape(-1, width)
    model = fit_preferences(matrix, np.array(rows.column("quality").to_pylist(), dtype=int), seed)
    if not model.weights.any():
        return model
    return replace(model, threshold=cut_off(docs, open_, model))


def _scored(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = np.array([features(t) for t in utf8(part, "text")])
                yield replaced(part, {"score": pa.array(model.score(rows))})

    return score


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5, else 0).

    The columns take the place of columns of these names. A null text is scored as the empty text. Without
    labels of both qualities every score is 0.5. Only the text counts for the score; equal texts have equal
    scores. An empty table gives an empty table.
    """
    model = train(docs, labels, per_class)
    scored = docs.mapInArrow(_scored(model), output_schema(docs, {"score": "double"}))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
