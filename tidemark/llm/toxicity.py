"""Toxicity: cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put_on_path, text_blocks

#: Labelled rows that a model is fitted on, at most: those whose hashed doc_id is smallest.
FIT_ROWS = 5_000
#: Characters of the word beginnings that are features beside the words themselves.
BEGINNINGS = (4, 5, 6)
#: A feature takes part when its G statistic against some threshold of the grades is at least this.
LEAST_G = 12.0
#: Rounds of the two fits that only rank toxic rows.
HELD_OUT_ROUNDS = 200
#: A document is rejected when grade 1 or more is likelier than this.
REJECT = 0.5

#: ASCII without letters and digits as spaces; other bytes stay.
_SPACES = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def words(text: str) -> set[bytes]:
    return set(text.encode().translate(_SPACES).lower().split())


def features(word: bytes) -> list[int]:
    """64-bit hashes of the word and of its longer beginnings; so many bits that features don't meet."""
    return [xxhash.xxh3_64_intdigest(word, 1) >> 1, *(xxhash.xxh3_64_intdigest(word[:n], 2 + n) >> 1 for n in BEGINNINGS if len(word) >= n)]


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - cut[k]) with ascending cuts: one weight per feature for every threshold.

    x counts a document's distinct words with the feature.
    """

    weights: dict[int, float]
    cuts: np.ndarray

    def word_score(self, word: bytes) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def above(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.cuts[None, :], -40, 40)))


def g_statistic(with_feature: np.ndarray, of_them: np.ndarray, rows: int, positive: int) -> np.ndarray:
    """The G statistic of features that ``with_feature`` of ``rows`` rows have, ``of_them`` of these positive."""
    total = np.zeros(len(with_feature))
    for n, k in ((with_feature, of_them), (rows - with_feature, positive - of_them)):
        for part, share in ((k, positive / rows), (n - k, 1 - positive / rows)):
            expected = np.maximum(n * share, 1e-12)
            total += np.where(part > 0, 2 * part * np.log(np.maximum(part, 1e-12) / expected), 0.0)
    return total


def screened(rows: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The features whose G statistic reaches LEAST_G against some column of ``target``: their hashes, and row, place and count of each use."""
    lengths = np.array([len(r) for r in rows], np.int64)
    flat, code = np.unique(np.concatenate(rows) if rows else np.empty(0, np.int64), return_inverse=True)
    width = max(1, len(flat))
    pair, count = np.unique(np.repeat(np.arange(len(rows)), lengths) * width + code, return_counts=True)
    row, col = pair // width, pair % width
    have = np.bincount(col, minlength=len(flat))
    used = np.zeros(len(flat), bool)
    for j in range(target.shape[1]):
        positive = int(target[:, j].sum())
        if 0 < positive < len(rows):
            used |= g_statistic(have, np.bincount(col, weights=target[row, j], minlength=len(flat)), len(rows), positive) >= LEAST_G
    place, keep = np.cumsum(used) - 1, used[col]
    return flat[used], row[keep], place[col[keep]], count[keep].astype(float)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 600, ridge: float = 0.5) -> OrdinalModel:
    """Fits a model of rows of feature hashes (repeats count) and their grades.

    Features are screened by their G statistic against each threshold. Then the summed log losses of
    the thresholds, with a ridge on the weights, are lowered by Adam on all rows at once, in shrinking
    steps. Cuts are the first one plus exponentials, so that they ascend. A threshold that no row
    lies above has no loss; its cut lies far out. With no rows, or all of one grade, no feature has
    a weight and the cuts follow the shares.
    """
    n, wanted = max(1, len(rows)), n_grades - 1
    k = max(1, int((grades[:, None] > np.arange(wanted)[None, :]).any(axis=0).sum())) if rows else wanted
    target = (grades[:, None] > np.arange(k)[None, :]).astype(float)
    names, row, col, value = screened(rows, target)
    share = np.clip(target.mean(axis=0) if rows else np.full(k, 0.5), 1e-3, 1 - 1e-3)
    base = -np.log(share / (1 - share))
    f = len(names)
    theta = np.concatenate([np.zeros(f), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1 if rows else 1):
        steps = np.exp(theta[f + 1 :])
        cuts = theta[f] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(row, weights=theta[:f][col] * value, minlength=n)
        error = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -40, 40))) - target
        by_row, by_cut = error.sum(axis=1) / n, -error.sum(axis=0) / n
        weights = np.bincount(col, weights=by_row[row] * value, minlength=f) + ridge * theta[:f] / n
        grad = np.concatenate([weights, [by_cut.sum()], [by_cut[i + 1 :].sum() * steps[i] for i in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cuts = theta[f] + np.concatenate([[0.0], np.cumsum(np.exp(theta[f + 1 :]))])
    return OrdinalModel(dict(zip(names.tolist(), theta[:f].tolist(), strict=True)), np.concatenate([cuts, cuts[-1] + 20.0 * np.arange(1, wanted - k + 1)]))


def held_out_grades(rows: list[np.ndarray], toxic: np.ndarray, n_grades: int) -> np.ndarray:
    """Severity grades where labels say only toxic or not: 0, or 1 and up by even parts of the toxic rows' held-out ranks.

    Each half of the rows is scored by a model of toxic or not that is fitted on the other half, so no row's
    grade is made by a fit that has seen it. A half without toxic or without clean rows ranks the other's all alike.
    """
    if not toxic.any():
        return np.zeros(len(rows), np.int64)
    half, scores = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for side in (0, 1):
        own, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
        model = fit_ordinal([rows[i] for i in other.tolist()], toxic[other].astype(np.int64), 2, rounds=HELD_OUT_ROUNDS)
        names = np.array(sorted(model.weights), np.int64)
        weights = np.array([model.weights[x] for x in names.tolist()])
        for i in own.tolist():
            at = np.searchsorted(names, rows[i])
            known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == rows[i]) if len(names) else np.zeros(len(rows[i]), bool)
            scores[i] = weights[at[known]].sum() - model.cuts[0]
    edges = np.quantile(scores[toxic], np.arange(1, n_grades - 1) / (n_grades - 1))
    return np.where(toxic, 1 + np.searchsorted(edges, scores, "left"), 0)


def toxic_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) from labels (doc_id, toxic): rows without either take no part; of rows that repeat a doc_id the severest counts."""
    return labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, n_grades: int = 4, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """A model of ``docs`` labelled toxic or not, on the ``fit_rows`` labelled rows whose hashed doc_id is smallest.

    The sample is bounded by ``fit_rows``, so it is broadcast; features are made where the texts are,
    and only their hashes come to the driver, which grades the toxic rows and fits. Of rows that repeat a
    doc_id one text is taken; labels without a document, and documents without a label, take no part. A null
    text has no features; without labelled rows no feature has a weight.
    """
    put_on_path(docs.sparkSession)
    sample = toxic_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in text_blocks(batches, 1):
            found = [np.array(sorted(f for w in words(t) for f in features(w)), np.int64).tobytes() for t in block]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int32()), pa.array(found, pa.binary())], ["toxic", "features"])

    got = texts.mapInArrow(run, "toxic int, features binary").toArrow().to_pydict()
    order = sorted(range(len(got["toxic"])), key=lambda i: (got["features"][i], got["toxic"][i]))
    rows = [np.frombuffer(got["features"][i], np.int64) for i in order]
    toxic = np.array([got["toxic"][i] > 0 for i in order], bool)
    return fit_ordinal(rows, held_out_grades(rows, toxic, n_grades), n_grades)


class _WordScores(dict):
    def __init__(self, model: OrdinalModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = self.model.word_score(word)
        return value


def _above(model: OrdinalModel, known: _WordScores, texts: list[str]) -> np.ndarray:
    return model.above(np.array([sum(sorted(map(known.__getitem__, words(t)))) for t in texts], float))


def score_toxicity(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, severity (expected grade), grade (the likeliest), p_toxic (of grade 1 or more), toxic.

    A null or empty text has no features and gets what the cuts alone say; a null doc_id stays null;
    repeated rows are scored each; an empty table gives no rows; further columns are ignored. The
    model holds the screened features of at most FIT_ROWS documents and travels with the task.
    """
    put_on_path(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordScores(model)
        for rows, texts in text_blocks(batches, 1):
            above = _above(model, known, texts)
            each = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1)
            arrays = [rows.column(0), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] > reject)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, scored in place: no row is shuffled.

    A null or empty text gets what the cuts alone say; rows without a doc_id and repeated rows are judged
    each; an empty table gives no rows; all columns stay.
    """
    put_on_path(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordScores(model)
        for rows, texts in text_blocks(batches, at):
            yield rows.filter(pa.array(_above(model, known, texts)[:, 0] <= reject))

    return docs.mapInArrow(run, docs.schema)
