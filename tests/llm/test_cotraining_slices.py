"""Workers of the quality classifier handle slices of Spark's batches: memory follows the slice, results are those of whole batches."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import cotrain


class Captured:
    """A DataFrame that only keeps what it is to run in its workers."""

    schema = None

    def selectExpr(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def whole(batches) -> list:
    return pa.Table.from_batches(list(batches)).combine_chunks().to_pylist()


@pytest.fixture(scope="module")
def documents() -> pa.RecordBatch:
    random = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in random.zipf(1.3, 40) % 5000) for _ in range(4000)] + [None, "", "Word, word."]
    n = len(texts)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1, n)], pa.int64()), "lang": ["en"] * n, "source": [None, "web"] * (n // 2) + ["web"] * (n % 2), "text": texts})


@pytest.fixture(scope="module")
def model() -> cotrain.Model:
    random = np.random.default_rng(6)
    weights = {v: random.normal(0, 0.3, (cotrain.SIZE[v] + 1, 2)) for v in cotrain.VIEWS}
    return cotrain.Model(weights, {(v, k): (1.0, 0.5 * k) for v in cotrain.VIEWS for k in (0, 1)})


@pytest.fixture(scope="module")
def prepared(documents) -> pa.RecordBatch:
    cotrain.features(data := Captured())
    out = pa.Table.from_batches(list(data.run([documents]))).combine_chunks().to_batches()[0]
    label = pa.array([None if i % 3 == 0 else i % 2 for i in range(len(out))], pa.int32())
    return pa.RecordBatch.from_arrays([*out.columns, label, label], [*out.schema.names, *cotrain.TARGETS])


def runs(model, monkeypatch):
    """By name: what a worker runs, and whether on texts."""
    out = {}
    for name, over_texts, make in (
        ("features", True, cotrain.features),
        ("keep_good", True, lambda d: cotrain.keep_good(d, None)),
        ("score", False, lambda d: cotrain.score(d, model)),
        ("pseudo", False, lambda d: cotrain.pseudo(d, model)),
    ):
        monkeypatch.setattr(cotrain, "prepare", lambda *_: None)
        monkeypatch.setattr(cotrain, "fit", lambda *_: model)
        make(data := Captured())
        out[name] = (data.run, over_texts)
    sums = lambda data, run, size: out.update({data: (run, False)}) or np.zeros(size, np.int64)
    monkeypatch.setattr(cotrain, "_sums", sums)
    cotrain._telling("telling")
    cotrain._calibrate("calibrate", model)
    return out


def test_rows_are_those_of_whole_batches(documents, prepared, model, monkeypatch):
    for name, (run, over_texts) in runs(model, monkeypatch).items():
        batch = documents if over_texts else prepared
        sliced = whole(run([batch, batch.slice(0, 0), batch.slice(7, 600)]))
        with monkeypatch.context() as m:
            m.setattr(cotrain, "SLICE", 1 << 30, raising=False)
            assert whole(run([batch, batch.slice(7, 600)])) == sliced, name
        assert sliced, name


def test_memory_follows_the_slice(documents, prepared, model, monkeypatch):
    for name, (run, over_texts) in runs(model, monkeypatch).items():
        peak = []
        for batch in (b := documents if over_texts else prepared).slice(0, 500), b:
            for _ in run([batch]):  # what is loaded once doesn't count
                pass
            tracemalloc.start()
            for _ in run([batch]):
                pass
            peak.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peak[1] < 1.5 * peak[0] + 500_000, (name, peak)
