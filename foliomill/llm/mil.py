"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of `PASSAGE_WORDS` words. Every passage is encoded (a tanh layer over its measures), gated attention
(tanh and sigmoid branches) weighs the passages of a document against each other, and the weighted sum of their encodings
is scored. Only documents carry labels: the weights of passages are learnt through them, by gradient descent over
the bags of a sample of at most about `SAMPLE_DOCUMENTS` labelled documents and `SAMPLE_PASSAGES` passages, both drawn by a hash of the id
as whole documents: each is learnt from with all its passages or not at all, and one of more passages than that is not drawn. Measuring and
scoring are narrow stages over whole texts; only the sample's measures and the small model pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import words as W
from foliomill.llm.tables import written

PASSAGE_WORDS = 50
SAMPLE_DOCUMENTS = 6000
SAMPLE_PASSAGES = 300_000
HIDDEN = 16
GATE = 8
EPOCHS = 300
RATE = 0.02
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:",
    "mark": b"!?",
    "symbol": b"#*$%&|<>@^~=_+\\/{}[]",
    "quote": b"'\"()-`",
    "line": b"\n",
    "high": range(128, 256),
}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _k
N_MEASURES = len(_CLASSES) + 9


def passage_measures(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages, measures) of a slice of texts, and each text's number of passages; a text without words has one of zeros."""
    begin, end, before = W.word_bounds(data, starts)
    n_words = np.diff(before)
    n_passages = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    owner = np.repeat(np.arange(len(n_words)), n_passages)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
    low = before[:-1][owner] + place * PASSAGE_WORDS
    high = np.minimum(low + PASSAGE_WORDS, before[1:][owner])
    out = np.zeros((len(owner), N_MEASURES))
    full = np.flatnonzero(high > low)
    out[:, -1] = 1.0
    if not len(full):
        return out, n_passages
    low, high = low[full], high[full]
    a, b = begin[low], end[high - 1]
    size = (b - a).astype(float)
    kinds = _CLASS_OF[data]
    m = np.zeros((len(full), N_MEASURES))
    for k in range(len(_CLASSES)):
        total = np.append(0, np.cumsum(kinds == k))
        m[:, k] = (total[b] - total[a]) / size
    k = len(_CLASSES)
    count = (high - low).astype(float)
    length = (end - begin).astype(float)
    total, squares = np.append(0, np.cumsum(length)), np.append(0, np.cumsum(length * length))
    mean = (total[high] - total[low]) / count
    m[:, k] = mean
    m[:, k + 1] = np.sqrt(np.maximum((squares[high] - squares[low]) / count - mean * mean, 0))
    short = np.append(0, np.cumsum(length <= 3))
    m[:, k + 2] = (short[high] - short[low]) / count
    single = np.append(0, np.cumsum(length == 1))
    m[:, k + 3] = (single[high] - single[low]) / count
    words = W.word_hashes(data, begin, end)
    same = np.append(0, np.cumsum(np.append(False, words[1:] == words[:-1])))
    m[:, k + 4] = (same[high] - same[np.minimum(low + 1, high)]) / count
    passage = np.repeat(np.arange(len(full)), high - low)
    order = np.lexsort((words, passage))
    again = (words[order][1:] == words[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    m[:, k + 5] = np.bincount(passage[order][1:][again], minlength=len(full)) / count
    marked = np.append(0, np.cumsum(_CLASS_OF[data[end - 1]] == list(_CLASSES).index("symbol")))
    m[:, k + 6] = (marked[high] - marked[low]) / count
    m[:, k + 7] = np.log1p(count)
    out[full] = m
    return out, n_passages


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, counts = [np.zeros((0, N_MEASURES))], []
        for _, data, starts in W.text_slices(batch.column(1)):
            x, n = passage_measures(data, starts)
            found.append(x)
            counts.extend(n)
        flat = np.concatenate(found)
        lists = W.list_array(flat.ravel(), np.array(counts, dtype=np.int64) * N_MEASURES, pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["id", "label", "measures"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, n_passages: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for bags that lie one after the other; `x` is standardised."""
        w, first = self.weights, np.cumsum(n_passages) - n_passages
        bag = np.repeat(np.arange(len(n_passages)), n_passages)
        h = np.tanh(x @ w["encode"] + w["encode0"])
        t, s = np.tanh(h @ w["tanh"] + w["tanh0"]), _sigmoid(h @ w["gate"] + w["gate0"])
        e = (t * s) @ w["attend"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "first": first, "score": _sigmoid(z @ w["out"] + w["out0"])}

    def standardised(self, measures: np.ndarray) -> np.ndarray:
        return np.clip((measures - self.mean) / self.spread, -8, 8)


def _gradients(model: Model, x: np.ndarray, f: dict, error: np.ndarray) -> dict[str, np.ndarray]:
    w, bag = model.weights, f["bag"]
    dz = error[:, None] * w["out"]
    dh = f["a"][:, None] * dz[bag]
    da = (f["h"] * dz[bag]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[bag])
    gated = de[:, None] * w["attend"]
    dt = gated * f["s"] * (1 - f["t"] ** 2)
    ds = gated * f["t"] * f["s"] * (1 - f["s"])
    dh += dt @ w["tanh"].T + ds @ w["gate"].T
    dp = dh * (1 - f["h"] ** 2)
    return {
        "out": f["z"].T @ error, "out0": error.sum(keepdims=True), "attend": (f["t"] * f["s"]).T @ de,
        "tanh": f["h"].T @ dt, "tanh0": dt.sum(axis=0), "gate": f["h"].T @ ds, "gate0": ds.sum(axis=0),
        "encode": x.T @ dp, "encode0": dp.sum(axis=0),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Trained on bags (passages, measures) with labels 0 and 1, both classes weighing the same."""
    x, n = np.concatenate(bags), np.array([len(b) for b in bags])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {
        "encode": draw(x.shape[1], HIDDEN), "encode0": np.zeros(HIDDEN), "tanh": draw(HIDDEN, GATE), "tanh0": np.zeros(GATE),
        "gate": draw(HIDDEN, GATE), "gate0": np.zeros(GATE), "attend": draw(GATE), "out": draw(HIDDEN), "out0": np.zeros(1),
    }
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), weights)
    x = model.standardised(x)
    positive = labels == 1
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        f = model.forward(x, n)
        for k, g in _gradients(model, x, f, (f["score"] - labels) * share).items():
            g = g + 1e-5 * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(labelled: DataFrame, sample: int = SAMPLE_DOCUMENTS, epochs: int = EPOCHS, passages: int = SAMPLE_PASSAGES) -> Model | None:
    """A model from `labelled` (id, text, label); null ids or labels other than 0 and 1 are left out. None without any row.

    Of more than `sample` documents a share is drawn; of these, in the order of their hash, as many as have `passages` passages in all.
    """
    labelled = labelled.where("id is not null and label in (0, 1)")
    total = labelled.count()
    if not total:
        return None
    if total > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("id", F.lit("quality sample")), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    kind = labelled.schema["id"].dataType.simpleString()
    measured = labelled.select("id", "text", F.col("label").cast("int")).mapInArrow(_measured, f"id {kind}, label int, measures array<double>")
    measured = written(measured.withColumn("order", F.xxhash64("id", F.lit("quality order"))), "quality-sample")
    n = F.size("measures") / N_MEASURES
    measured = measured.where(n <= passages)
    sizes = measured.select("id", "order", n.cast("long").alias("n")).toPandas().sort_values(["order", "id"], kind="stable")  # at most about `sample` rows
    limit = sizes["order"][sizes["n"].cumsum() <= passages].max() if len(sizes) else None
    if limit is None or limit != limit:
        return None
    rows = measured.where(F.col("order") <= int(limit)).drop("order").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("id", kind="stable")
    bags = [np.asarray(m).reshape(-1, N_MEASURES) for m in rows["measures"]]
    return fit(bags, rows["label"].to_numpy(), epochs)


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, data, starts in W.text_slices(batch.column(0)):
                x, n = passage_measures(data, starts)
                scores.append(model.forward(model.standardised(x), n)["score"] if model else np.full(len(n), 0.5))
            score = np.concatenate(scores)
            columns = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The other columns of `docs` with score (0 to 1, label 1 likelier above 0.5) and predicted, from whole texts.

    Null texts count as empty and are scored too; without a model every score is 0.5. Columns named score or predicted
    are replaced.
    """
    others = [c for c in docs.columns if c not in (text, "score", "predicted")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "score double", "predicted int"])
    return docs.select(text, *others).mapInArrow(_scored(model), schema)
