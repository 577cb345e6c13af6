"""Quality classifier by co-training (operator 4).

Two views of a document: its text content (hashed words, their beginnings, and the marks that follow them) and its page
metadata and layout (language, source, lengths, character shares). Two targets: low quality and toxic. Each
view has a logistic model for each target, of the features whose log-odds over all labels are significant.

Rounds: each view scores all documents without a label; where a view is confident (calibrated on held-out
labels), its pseudo-label trains the other view, beside the true labels. A fit uses a sample of about
MAX_TRAINING labelled and as many pseudo-labelled documents, chosen by a hash; scoring, confidence and
calibration cover all documents, and only these samples and tables of fixed size reach the driver. At the
end the calibrated log-odds of both views are added, less the prior, and all documents scored.

A document is rejected if either probability is over its limit in REJECT. Rows of labels with one id count once (least
quality, greatest toxicity); null labels are unlabelled; without labels nothing is rejected. Null or empty
text: no content features. A null doc_id has no label.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column_bytes, stored

ROUNDS, CONFIDENT = 2, 0.98
SIGNIFICANT = {"content": 4.0, "metadata": 1.0}  # standard errors
REJECT = np.array([0.5, 0.3])  # probabilities of low quality and of toxic content above which a document goes
MAX_TRAINING = 6000  # labelled documents that a fit uses at most, and as many pseudo-labelled ones
SLICE = 500  # documents of a batch that a worker handles at once; no result depends on it
VIEWS, TARGETS = ("content", "metadata"), ("low_quality", "toxic")
SIZE = {"content": 1 << 16, "metadata": 1 << 12}
FOLDS = 5  # one fold of the labelled documents calibrates, the others train
_BINS, _REACH = 128, 64.0

_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORDY = bytes(c for c in range(256) if chr(c).isalnum() and c < 128 or c >= 128)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))


def _ids(features, size: int) -> bytes:
    return np.fromiter(sorted({zlib.crc32(x) % size for x in features}), np.uint16).tobytes()


def content(text: bytes) -> bytes:
    words = set(text.split())
    plain = {w.lower().strip(_EDGE) for w in words}
    return _ids(plain | {b"^" + w[:5] for w in plain} | {b"~" + w.lstrip(_WORDY) for w in words}, SIZE["content"])


def metadata(text: bytes, lang: str | None, source: str | None) -> bytes:
    words = text.split()
    n, m = len(words), max(1, len(text))
    share = lambda chars: int(20 * (len(text) - len(text.translate(None, chars))) / m)
    found = {
        "lang": lang, "source": source, "size": m.bit_length(), "words": n.bit_length(), "distinct": 10 * len(set(words)) // max(1, n),
        "length": min(20, m // max(1, n)), "twice": 20 * sum(map(operator.eq, words, words[1:])) // max(1, n), "upper": share(_UPPER), "digit": share(_DIGIT), "marks": share(_EDGE), "lines": (1000 * text.count(b"\n") // max(1, n)).bit_length(),
    }
    return _ids((f"{k}={v}".encode() for k, v in found.items()), SIZE["metadata"])


def _slices(batches):
    """Small slices of Spark's batches: lists and arrays of all features of a batch of 10,000 documents take 100 MB and more."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in _slices(batches):
            texts = column_bytes(batch["text"])
            rows = zip(texts, batch["lang"].to_pylist(), batch["source"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([content(t) for t in texts], pa.binary()), pa.array([metadata(*r) for r in rows], pa.binary())], ["doc_id", *VIEWS])

    columns = ("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(source as string) source", "cast(text as string) text")
    return docs.selectExpr(*columns).mapInArrow(run, "doc_id long, content binary, metadata binary")


@dataclass
class Model:
    """Weights by view for each target; by (view, target) the calibration's slope and offset; the targets' prior log-odds."""

    weights: dict[str, np.ndarray]
    calibration: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)
    prior: np.ndarray = field(default_factory=lambda: np.zeros(len(TARGETS)))

    def raw(self, view: str, column) -> np.ndarray:
        """Sums of the weights of each document's features: (documents, targets)."""
        ids, cuts = _flat(column)
        own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        each = [np.bincount(own, weights=w[ids], minlength=len(cuts) - 1) + w[-1] for w in self.weights[view].T]
        return np.stack(each, 1)

    def logits(self, view: str, column) -> np.ndarray:
        raw = self.raw(view, column)
        slope = np.array([self.calibration[view, k] for k in range(len(TARGETS))])
        return raw * slope[:, 0] + slope[:, 1]


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column of uint16 arrays, and the borders between documents."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint16), np.concatenate([[0], np.cumsum([len(x) // 2 for x in values])]).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _truth(batch) -> tuple[np.ndarray, np.ndarray]:
    """(documents, targets): 1 bad, 0 good, -1 unknown; and which documents calibrate."""
    known = [np.asarray(batch[t].fill_null(-1)).astype(np.int64) for t in TARGETS]
    held = np.array([zlib.crc32(str(i).encode()) % FOLDS == 0 for i in batch["doc_id"].to_pylist()], bool)
    return np.stack(known, 1), held


def _rows(slots: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(slots)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(slots[at], pa.int64())], ["slot", "n"])


def _sums(data: DataFrame, run, size: int) -> np.ndarray:
    """The sums over all partitions of arrays of a fixed size."""
    found = data.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _telling(data: DataFrame) -> dict[str, np.ndarray]:
    """By view: (targets, features), whether a feature's log-odds over all training labels are significant."""
    start, size = {}, 0
    for v in VIEWS:
        start[v], size = size, size + len(TARGETS) * 2 * (SIZE[v] + 1)  # the last place counts documents

    def run(batches):
        slots = np.zeros(size, np.int64)
        for batch in _slices(batches):
            truth, held = _truth(batch)
            truth[held] = -1
            for v in VIEWS:
                ids, cuts = _flat(batch[v])
                of = np.repeat(np.arange(len(held)), np.diff(cuts))
                for k in range(len(TARGETS)):
                    for c in (0, 1):
                        a = start[v] + (2 * k + c) * (SIZE[v] + 1)
                        slots[a : a + SIZE[v]] += np.bincount(ids[truth[of, k] == c], minlength=SIZE[v])
                        slots[a + SIZE[v]] += (truth[:, k] == c).sum()
        yield _rows(slots)

    sums, out = _sums(data, run, size), {}
    for v in VIEWS:
        counts = sums[start[v] :][: len(TARGETS) * 2 * (SIZE[v] + 1)].reshape(len(TARGETS), 2, -1) + 0.5
        odds = np.log(counts[:, 1, :-1] / counts[:, 1, -1:]) - np.log(counts[:, 0, :-1] / counts[:, 0, -1:])
        out[v] = np.abs(odds) > SIGNIFICANT[v] * np.sqrt(1 / counts[:, 1, :-1] + 1 / counts[:, 0, :-1])
    return out


def _sample(data: DataFrame, most: int):
    """About `most` rows at most, chosen by a hash of the id: the same rows in every run."""
    share = min(1.0, most / max(1, data.count()))
    return data.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("doc_id", *VIEWS, *TARGETS).orderBy("doc_id", *VIEWS).toArrow()


def logistic(column, label: np.ndarray, use: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.3) -> np.ndarray:
    """Weights of a logistic model of presence features, and its offset as the last weight: AdaGrad over small batches."""
    ids, cuts = _flat(column)
    on, size = use[ids], len(use)
    ids, cuts = ids[on], np.concatenate([[0], np.cumsum(on)])[cuts]
    weights, power = np.zeros(size + 1), np.full(size + 1, 1e-3)
    known = np.flatnonzero(label >= 0)
    if not len(known):
        return weights
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for rows in np.array_split(order.permutation(known), -(-len(known) // batch)):
            n = cuts[rows + 1] - cuts[rows]
            own = np.repeat(np.arange(len(rows)), n)
            at = ids[np.repeat(cuts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            error = _sigmoid(np.bincount(own, weights=weights[at], minlength=len(rows)) + weights[-1]) - label[rows]
            slope = np.bincount(at, weights=error[own], minlength=size + 1)
            slope[-1] = error.sum()
            power += slope * slope
            weights -= rate * slope / np.sqrt(power)
    return weights


def _train(data: DataFrame, model: Model | None, most: int, use: dict[str, np.ndarray]) -> Model:
    """Logistic models from a bounded sample of true labels and, with a model, of the other view's confident labels."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0
    labelled = _sample(data.filter(~held & F.greatest(*TARGETS).isNotNull()), most)
    sure = _sample(pseudo(data.filter(~held & F.greatest(*TARGETS).isNull()), model), most) if model else None
    weights = {}
    for view, other in zip(VIEWS, VIEWS[::-1]):
        column, truth = labelled[view].combine_chunks(), _truth(labelled)[0]
        if sure and len(sure):
            logits = model.logits(other, sure[other].combine_chunks())
            guess = np.where(_sigmoid(logits) >= CONFIDENT, 1, np.where(_sigmoid(logits) <= 1 - CONFIDENT, 0, -1))
            column, truth = pa.concat_arrays([column, sure[view].combine_chunks()]), np.concatenate([truth, guess])
        weights[view] = np.stack([logistic(column, truth[:, k], use[view][k]) for k in range(len(TARGETS))], 1)
    return Model(weights)


def pseudo(data: DataFrame, model: Model) -> DataFrame:
    """The documents, out of all given, on which at least one view is confident of at least one target."""

    def run(batches):
        for batch in _slices(batches):
            p = np.concatenate([_sigmoid(model.logits(v, batch[v])) for v in VIEWS], 1)
            yield batch.filter(pa.array(((p >= CONFIDENT) | (p <= 1 - CONFIDENT)).any(1)))

    return data.mapInArrow(run, data.schema)


def _calibrate(data: DataFrame, model: Model) -> Model:
    """Platt scaling of each view and target on the held-out labels, from a histogram of scores."""
    shape = (len(VIEWS), len(TARGETS), 2, _BINS)

    def run(batches):
        slots = np.zeros(shape, np.int64)
        for batch in _slices(batches):
            truth, held = _truth(batch)
            for v, view in enumerate(VIEWS):
                raw = model.raw(view, batch[view])
                place = np.clip((raw + _REACH) * (_BINS / (2 * _REACH)), 0, _BINS - 1).astype(np.int64)
                for k in range(len(TARGETS)):
                    for c in (0, 1):
                        slots[v, k, c] += np.bincount(place[held & (truth[:, k] == c), k], minlength=_BINS)
        yield _rows(slots.reshape(-1))

    sums = _sums(data, run, int(np.prod(shape))).reshape(shape)
    middle = (np.arange(_BINS) + 0.5) * (2 * _REACH / _BINS) - _REACH
    calibration = {(view, k): platt(middle, sums[v, k, 0], sums[v, k, 1]) for v, view in enumerate(VIEWS) for k in range(len(TARGETS))}
    count = sums[0].sum(axis=2) + 0.5
    return Model(model.weights, calibration, np.log(count[:, 1] / count[:, 0]))


def platt(score: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through binned labels, by Newton steps with a slight penalty."""
    n, target = good + bad, (bad + 0.5) / (good + bad + 1)
    w = np.zeros(2)
    x = np.stack([score, np.ones_like(score)], 1)
    if not n.sum():  # nothing is known, so nothing is rejected
        return 0.0, -30.0
    penalty = np.diag([1.0, 1e-3])
    for _ in range(100):
        p = _sigmoid(x @ w)
        slope = x.T @ (n * (target - p)) - penalty @ w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, slope)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def prepare(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Both views of each document with its labels, written once: a few hundred bytes a document."""
    own = labels.select(
        F.col("doc_id").cast("long").alias("__id"), (1 - F.col("quality").cast("int")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic")
    ).groupBy("__id").agg(*(F.max(t).alias(t) for t in TARGETS))
    found = features(docs)
    # labels grow with the documents: the same join at every size, never a broadcast
    return stored(found.join(own.hint("merge"), found.doc_id == F.col("__id"), "left").drop("__id"))


def fit(data: DataFrame, rounds: int = ROUNDS, most: int = MAX_TRAINING) -> Model:
    """The model after the exchange rounds, from a table that prepare() made."""
    use = _telling(data)
    model = _calibrate(data, _train(data, None, most, use))
    for _ in range(rounds):
        model = _calibrate(data, _train(data, model, most, use))
    return model


def score(data: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, the views' own probabilities, score, kept."""
    schema = "doc_id long, p_low_quality double, p_toxic double, " + ", ".join(f"{v}_{t} double" for v in VIEWS for t in TARGETS) + ", score double, kept boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in _slices(batches):
            logits = {v: model.logits(v, batch[v]) for v in VIEWS}
            both = _sigmoid(sum(logits.values()) - model.prior)
            each = [pa.array(_sigmoid(logits[v][:, k])) for v in VIEWS for k in range(len(TARGETS))]
            value = (1 - both).prod(1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(both[:, 0]), pa.array(both[:, 1]), *each, pa.array(value), pa.array((both <= REJECT).all(1))], names)

    return data.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    data = prepare(docs, labels)
    return score(data, fit(data, rounds))


def keep_good(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; they are filtered where they are read."""
    model = fit(prepare(docs, labels), rounds)

    def run(batches):
        for batch in _slices(batches):
            rows = list(zip(column_bytes(batch["text"]), batch["lang"].to_pylist(), batch["source"].to_pylist()))
            logits = model.logits("content", pa.array([content(r[0]) for r in rows], pa.binary())) + model.logits("metadata", pa.array([metadata(*r) for r in rows], pa.binary()))
            yield batch.filter(pa.array((_sigmoid(logits - model.prior) <= REJECT).all(1)))

    return docs.mapInArrow(run, docs.schema)
