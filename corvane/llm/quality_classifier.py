"""Operator 4: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded; gated attention, learned
from the document labels, weighs the passages; the weighted mean of their encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import id_bucket, read_table, released, row_groups, span_hashes, text_buffers, word_spans

PASSAGE_WORDS = 40
GROUP_BYTES = 1 << 20
MAX_LABELS = 5000  # labelled documents that the model is fitted on (in expectation)
MAX_PASSAGES = 256  # of each of these, evenly spread over the text
HIDDEN, GATE, STEPS, RATE = 16, 12, 250, 0.03
LIMIT = 0.7

# Byte classes that a passage's shares are taken of.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?", b"\n", bytes(range(128, 256))]


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (a run of ``PASSAGE_WORDS`` words, at least one a text), and each text's number of passages."""
    rows = len(offsets) - 1
    starts, ends, at = word_spans(data, offsets)
    n = np.diff(at)
    bags = np.maximum(-(-n // PASSAGE_WORDS), 1)
    first = np.cumsum(bags) - bags
    row = np.repeat(np.arange(rows), n)
    place = np.arange(len(starts)) - at[row]
    passage = first[row] + place // PASSAGE_WORDS
    total = int(bags.sum())
    words = np.bincount(passage, minlength=total).astype(np.float64)
    some = np.maximum(words, 1)
    size = (ends - starts).astype(np.float64)
    hashes = span_hashes(data, starts, ends)
    # A passage's bytes go from its first word to the next passage's.
    begin = np.full(total, -1)
    begin[passage[::-1]] = starts[::-1]
    empty = begin < 0
    begin[empty] = offsets[:-1][n == 0]
    limit = np.append(begin[1:], len(data))
    last = np.zeros(total, bool)
    last[first + bags - 1] = True
    limit[last] = offsets[1:]
    length = np.maximum(limit - begin, 1).astype(np.float64)
    out = []
    for members in CLASSES:
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        run = np.concatenate([[0], np.cumsum(table[data])])
        out.append((run[limit] - run[begin]) / length)
    mean = np.bincount(passage, weights=size, minlength=total) / some
    out.append(mean / 10)
    out.append(np.sqrt(np.maximum(np.bincount(passage, weights=size**2, minlength=total) / some - mean**2, 0)) / 5)
    twin = np.zeros(len(starts))
    twin[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out.append(np.bincount(passage, weights=twin, minlength=total) / some)
    # Words seen before in the passage, and elsewhere in the text.
    order = np.lexsort((hashes, passage))
    again = np.zeros(len(starts))
    again[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    out.append(np.bincount(passage, weights=again, minlength=total) / some)
    # Word triples found again in the text.
    if len(hashes) > 2:
        triple = (hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + hashes[2:]
        inside = row[2:] == row[:-2]
        triple, owner, where = triple[inside], row[:-2][inside], passage[:-2][inside]
        order = np.lexsort((triple, owner))
        same = (triple[order][1:] == triple[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        repeated = np.zeros(len(triple))
        repeated[order[1:]] += same
        repeated[order[:-1]] += same
        out.append(np.bincount(where, weights=repeated > 0, minlength=total) / some)
    else:
        out.append(np.zeros(total))
    ending = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0)
    out.append(np.bincount(passage, weights=ending, minlength=total) / some)
    heads = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0)
    out.append(np.bincount(passage, weights=heads, minlength=total) / some)
    out.append(np.bincount(passage, weights=size == 1, minlength=total) / some)
    out.append(words / PASSAGE_WORDS)
    out.append(np.log1p(n)[np.repeat(np.arange(rows), bags)] / 5)
    return np.stack(out, 1), bags


FEATURES = len(CLASSES) + 10


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """encode: h = tanh(x W + b); attend: a = softmax(w . (tanh(h V) * sigmoid(h U))); score: sigmoid(c . sum(a h) + d)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        f = len(mean)
        self.p = {"W": rng.normal(0, f**-0.5, (f, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.25, (HIDDEN, GATE)), "U": rng.normal(0, 0.25, (HIDDEN, GATE)), "w": rng.normal(0, 0.25, GATE), "c": rng.normal(0, 0.25, HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(bags)), bags)
        first = np.cumsum(bags) - bags
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "bag": bag, "first": first, "h": h, "t": t, "g": g, "a": a, "z": z, "score": sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, s = self.p, self.forward(x, bags)
        bag, first, h, a = s["bag"], s["first"], s["h"], s["a"]
        out = (s["score"] - y) / len(y)
        dz = out[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, dg = de[:, None] * p["w"] * s["g"] * (1 - s["t"] ** 2), de[:, None] * p["w"] * s["t"] * s["g"] * (1 - s["g"])
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        g = {"W": s["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ out, "d": out.sum(keepdims=True)}
        return {k: v + 1e-4 * p[k] for k, v in g.items()}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> AttentionModel:
        """Adam on all bags together."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            for k, g in self.gradient(x, bags, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def fit_quality_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labels: int = MAX_LABELS) -> AttentionModel:
    """Fit on labelled rows: ``labels`` holds doc_id and quality (0 or 1).

    Sampled by hash of doc_id to ``max_labels`` documents at most, in expectation, and to ``MAX_PASSAGES`` passages of each, evenly
    spread: at most 76 bytes times both come to the driver, however long the texts. Rows
    of null id or quality are left out; of several labels of one id the lowest counts. With no labels the model scores
    1/2 always.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    count = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, max_labels / max(count, 1)) * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for a, b in row_groups(offsets, GROUP_BYTES):
                x, bags = passage_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                edges = np.cumsum(bags)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[e - k + np.unique(np.linspace(0, k - 1, min(k, MAX_PASSAGES)).astype(np.int64))].astype(np.float32).tobytes() for e, k in zip(edges, bags)], pa.binary())], names=["doc_id", "quality", "x"])

    # The sample is bounded by max_labels, so it is broadcast.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    key = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {key}, quality int, x binary").orderBy("doc_id").toArrow()
    if not got.num_rows:
        model = AttentionModel(np.zeros(FEATURES), np.ones(FEATURES))
        model.p["c"][:] = 0
        return model
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES).astype(np.float64) for b in got.column("x").to_pylist()]
    flat, bags = np.concatenate(x), np.array([len(b) for b in x])
    model = AttentionModel(flat.mean(0), np.maximum(flat.std(0), 1e-3))
    return model.fit(flat, bags, got.column("quality").to_numpy().astype(np.float64))


def score_quality(df: DataFrame, model: AttentionModel, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= 0.7).

    A null, empty or blank text is one passage without words. Columns of the added names are replaced, all others kept; repeated
    rows get equal scores. Every passage of a text counts, however many: a very long text is held by one task, with about 100
    bytes a word. An empty table gives an empty one.
    """
    kept = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            for a, b in row_groups(offsets, GROUP_BYTES):
                x, bags = passage_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                score = model.forward(x.astype(np.float32).astype(np.float64), bags)["score"]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(score), pa.array((score >= LIMIT).astype(np.int32))], names=[*names, "score", "predicted"])

    return df.mapInArrow(released(run), schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    model = fit_quality_model(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
