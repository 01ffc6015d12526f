"""Quality classifier: Bradley-Terry pairwise ranking.

Each document gets a score from its text alone.  Weights are learnt from preference pairs (a
document labelled 1 beats one labelled 0) by logistic loss on the difference of their features,
with ridge penalty; the threshold is the score's quantile at the share of label 0, and the
reported score maps that quantile to ``CUT``.

The fit sees every labelled row of the learning folds, and the loss is the mean over all pairs of
one row of each label.  Rows meet only through their scores, so a pass over the rows counts the
scores in steps of ``STEP``, the pairs of counts give each step its share of the slope and
curvature, and a second pass sums the features by them: a Newton round.  The driver holds counts,
sums and weights, never rows.  Features are computed once and kept in a table that the fit and the
scoring read.

Edge cases: a null or empty text is scored like a text without words; a document with several
labels counts by its lowest; without labels of both kinds every score is 0.5; an empty table gives
no rows; only doc_id and text are read, and doc_id is no feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kvloom.llm import quality_rules
from kvloom.llm.shipping import materialise, release, ship
from kvloom.llm.textops import Chunk, chunks, words

FOLDS = 5
CUT = 0.3
BUCKETS = 192
RIDGE = 1e-3
ROUNDS = 50
ENOUGH = 1e-6  # the fit ends when a round promises a smaller gain in loss
STEP = 1 / 256  # scores of the fit are counted in steps of this width
FINE = 1 << 16  # parts of a step, for the threshold
COARSE = 256  # groups of scores, for the part of the curvature that concerns pairs
TASKS = 64  # partial sums that reach the driver at once


def _share(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    return counts / np.maximum(of, 1)


def features(chunk: Chunk) -> np.ndarray:
    """A row per text: lengths, shares of character classes, repetition, word shapes and the shares
    of hashed words."""
    stats = quality_rules.measure(chunk)
    n = len(stats["n_words"])
    hashes, bounds, starts, ends = words(chunk)
    of = np.repeat(np.arange(n), stats["n_words"])
    per = lambda mask: np.bincount(of[mask], minlength=n)
    last, first, length = chunk.data[ends - 1], chunk.data[starts], ends - starts
    caps = np.zeros(len(starts), bool)
    if len(starts):
        capital = np.zeros(len(chunk.data) + 1, np.int64)
        np.cumsum((chunk.data >= 65) & (chunk.data <= 90), out=capital[1:])
        small = np.zeros(len(chunk.data) + 1, np.int64)
        np.cumsum((chunk.data >= 97) & (chunk.data <= 122), out=small[1:])
        caps = (capital[ends] - capital[starts] > 0) & (small[ends] == small[starts])
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    key = hashes ^ (of.astype(np.uint64) << np.uint64(32))
    distinct = np.bincount(of[np.unique(key, return_index=True)[1]], minlength=n) if len(key) else np.zeros(n)
    total = stats["n_words"]
    lines = quality_rules._per_text(chunk.data == 10, chunk.bounds) + 1
    classes = stats["classes"]
    chars = classes.sum(axis=1)
    dense = [
        np.log1p(total), np.log1p(chars), _share(stats["word_chars"], total), np.log1p(lines), np.log1p(_share(total, lines)),
        _share(stats["n_repeat_words"], total), _share(stats["n_dup_lines"], lines), _share(per(same), total), _share(distinct, total),
        _share(per(caps), total), _share(per(length <= 3), total), _share(per(length == 1), total), _share(per(length >= 9), total),
        _share(per((first >= 48) & (first <= 57)), total), _share(per((last == 33) | (last == 63)), total), _share(per((last == 46) | (last == 44)), total),
        _share(per(np.isin(last, list(quality_rules.SYMBOLS))), total), (total < 10).astype(float), (total < 30).astype(float), (100 * stats["n_repeat_words"] > 20 * total).astype(float),
    ]
    spread = np.bincount(of * BUCKETS + (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=n * BUCKETS).reshape(n, BUCKETS)
    shares = classes / np.maximum(chars, 1)[:, None]
    return np.column_stack([*dense, shares, np.sqrt(shares), np.sqrt(spread / np.maximum(total, 1)[:, None])]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        worth = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(worth - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a batch of the learning table."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32)
    return x.reshape(batch.num_rows, -1).astype(np.float64), np.asarray(batch.column("y"))


def _sums(rows: DataFrame, part) -> np.ndarray | None:
    """The sum over all rows of the array that ``part`` gives for a batch's features and labels."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                mine = part(*_rows(batch))
                total = mine if total is None else total + mine
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = rows.coalesce(TASKS).mapInArrow(run, "total binary").toArrow().column("total").to_pylist()
    return sum(np.frombuffer(p, np.float64) for p in parts) if parts else None


def _counts(rows: DataFrame, places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, place and number of rows, for the labels and places that ``places`` gives for a batch."""

    def run(batches):
        for batch in batches:
            y, place = places(*_rows(batch))
            for label in (0, 1):
                found, count = np.unique(place[y == label], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), label, np.int32)), pa.array(found.astype(np.int64)), pa.array(count.astype(np.int64))], names=["y", "place", "count"])

    table = rows.mapInArrow(run, "y int, place long, count long").groupBy("y", "place").agg(F.sum("count").alias("count")).toArrow()
    return tuple(np.asarray(table.column(c)) for c in ("y", "place", "count"))


def _over(kernel, shares: np.ndarray) -> np.ndarray:
    """For each step, the sum of ``kernel(its score - a score)`` over all steps' shares."""
    m = len(shares)
    n = 1 << (3 * m).bit_length()
    return np.fft.irfft(np.fft.rfft(kernel(np.arange(1 - m, m) * STEP), n) * np.fft.rfft(shares, n), n)[m - 1 : 2 * m - 1]


def _logistic(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


class Steps:
    """How many rows of each label have which score, by steps, under some weights."""

    def __init__(self, rows: DataFrame, standard, weights: np.ndarray):
        y, place, count = _counts(rows, lambda x, y: (y, np.rint(standard(x) @ weights / STEP).astype(np.int64)))
        self.low = int(place.min())
        self.numbers = np.zeros((2, int(place.max()) - self.low + 1), np.int64)
        self.numbers[y, place - self.low] = count
        self.shares = self.numbers / self.numbers.sum(axis=1, keepdims=True)
        #: Mean loss of all pairs.
        self.loss = float(self.shares[1] @ _over(lambda d: np.logaddexp(0, -d), self.shares[0]))

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each label and step, the mean slope and curvature of a row's pairs."""
        bad, good = self.shares
        bend = lambda d: _logistic(d) * _logistic(-d)
        return np.stack([_over(_logistic, good), -_over(lambda d: _logistic(-d), bad)]), np.stack([_over(bend, good), _over(bend, bad)])


def _newton(rows: DataFrame, standard, weights: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """The slope of the loss, ridge included, and the step that Newton's rule takes."""
    slopes, bends = steps.slopes()
    size, low, width = len(weights), steps.low, steps.numbers.shape[1]
    sizes = steps.numbers.sum(axis=1)
    per = -(-width // COARSE)
    groups = -(-width // per)

    def part(x, y):
        z = standard(x)
        place = np.clip(np.rint(z @ weights / STEP).astype(np.int64) - low, 0, width - 1)
        share = 1 / sizes[y]
        sums = np.zeros((2 * groups, size))
        np.add.at(sums, y * groups + place // per, z * share[:, None])
        return np.concatenate([z.T @ (slopes[y, place] * share), (z.T @ (z * (bends[y, place] * share)[:, None])).ravel(), sums.ravel()])

    total = _sums(rows, part)
    slope = total[:size] + RIDGE * weights
    alone = total[size : size + size * size].reshape(size, size) + RIDGE * np.eye(size)
    bad, good = total[size + size * size :].reshape(2, groups, size)
    apart = np.subtract.outer(np.arange(groups), np.arange(groups)) * per * STEP
    both = good.T @ (_logistic(apart) * _logistic(-apart)) @ bad
    move = np.linalg.solve(alone - both - both.T, -slope)
    # The groups are coarse; without them the curvature is too large by a factor of 2 at most.
    return slope, move if slope @ move < 0 else np.linalg.solve(alone, -slope)


def _ranked(rows: DataFrame, standard, weights: np.ndarray, steps: Steps, rank: int) -> float:
    """The score of a rank (from 1, lowest first), to a part of a step."""
    upto = np.cumsum(steps.numbers.sum(axis=0))
    step = int(np.searchsorted(upto, rank))
    rank -= int(upto[step - 1]) if step else 0
    edge = step + steps.low - 0.5

    def places(x, y):
        score = standard(x) @ weights / STEP
        inside = np.rint(score) == step + steps.low
        return y[inside], np.floor((score[inside] - edge) * FINE)

    _, place, count = _counts(rows, places)
    order = np.argsort(place)
    found = min(np.searchsorted(np.cumsum(count[order]), rank), len(order) - 1)
    return float((edge + (place[order[found]] + 0.5) / FINE) * STEP)


def fit(rows: DataFrame) -> Model | None:
    """Weights of least loss over all pairs of rows (x, y) of each label, then the threshold."""

    def moments(x, y):
        return np.concatenate([[len(y), (y == 1).sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    total = _sums(rows, moments)
    if total is None or not 0 < total[1] < total[0]:
        return None
    mean, square = total[2:].reshape(2, -1) / total[0]
    scale = np.sqrt(np.maximum(square - mean**2, 0)) + 1e-6
    standard = lambda x: ((x - mean) / scale).clip(-8, 8)
    weights = np.zeros(len(mean))
    steps = Steps(rows, standard, weights)
    for _ in range(ROUNDS):
        slope, move = _newton(rows, standard, weights, steps)
        gain = -(slope @ move) / 2
        if gain < ENOUGH:
            break
        loss, far = steps.loss + RIDGE / 2 * weights @ weights, 1.0
        while far > 1e-3:
            nearer = weights + far * move
            found = Steps(rows, standard, nearer)
            if found.loss + RIDGE / 2 * nearer @ nearer < loss - 1e-3 * far * gain:
                break
            far /= 2
        else:
            break
        weights, steps = nearer, found
    bad = int(steps.numbers[0].sum())
    return Model(mean, scale, weights, sum(_ranked(rows, standard, weights, steps, rank) for rank in (bad, bad + 1)) / 2)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the features ``x`` of every document, as a table."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                x = pa.array([r.tobytes() for r in features(chunk)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(x)), x], names=["doc_id", "x"])

    return materialise(docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], StructField("x", BinaryType())])))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Features ``x`` and label ``y`` of all documents that the learning folds label, as a table."""
    learn = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    return materialise(rows.join(learn, "doc_id").select("x", "y"))


def held_out(doc_id):
    """The fold that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    rows = featured(docs)
    learning = labelled(rows, labels)
    model = fit(learning)
    release(learning)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(n, -1) if n else np.zeros((0, 0))
            values = np.full(n, 0.5) if model is None or not n else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(values.astype(np.float64)), pa.array((values >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
