"""Operator 1: language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams; each language has several centroids, found by
spherical k-means. The language of the centroid of highest cosine is predicted, and a text that is farther from all
centroids than texts of its length are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import id_bucket, read_table, released, row_groups, text_buffers

BUCKETS = 2048
GROUP_ROWS = 256
GROUP_BYTES = 1 << 20  # of text at a time; also of a longer text's n-grams
MAX_SAMPLE = 4000  # texts the centroids are fitted on, over all languages (in expectation)
CENTROIDS = 4
REJECT_SHARE = 0.3  # of the lowest cosine that fitted texts of that length have

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)]


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (rows x buckets) of the byte bigrams and trigrams of the texts, A-Z folded and runs of other ASCII made one space."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    x = _FOLD[data]
    keep = np.append(True, (x[1:] != 32) | (x[:-1] != 32) | (row[1:] != row[:-1])) if len(x) else np.zeros(0, bool)
    x, row = x[keep], row[keep]
    out = np.zeros((rows, BUCKETS), np.int64)
    for n in (2, 3):
        for at in range(0, len(x) - n + 1, GROUP_BYTES):
            some = min(GROUP_BYTES, len(x) - n + 1 - at)
            h = np.full(some, n, np.uint32)
            for k in range(n):
                h = (h ^ x[at + k : at + k + some]) * np.uint32(0x01000193) + np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            first = row[at : at + some]
            same = first == row[at + n - 1 : at + n - 1 + some]
            place = first[same].astype(np.int64) * BUCKETS + (h[same] % np.uint32(BUCKETS))
            out += np.bincount(place, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    return out.astype(np.float32)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def size_band(counts: np.ndarray) -> np.ndarray:
    return np.log2(counts.sum(1) + 1).astype(np.int64)


def spherical_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(1)
        sums = np.stack([x[nearest == i].sum(0) if (nearest == i).any() else centers[i] for i in range(k)])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


class LanguageModel:
    """Inverse document frequencies, centroids with their languages, and the lowest cosine accepted by size."""

    def __init__(self, idf: np.ndarray, langs: list[str], counts: np.ndarray, seed: int = 7) -> None:
        self.idf = idf.astype(np.float32)
        x = tfidf(counts, self.idf)
        names = sorted(set(langs))
        groups = [np.flatnonzero(np.array(langs) == name) for name in names]
        centers = [spherical_means(x[g], CENTROIDS, seed + i) for i, g in enumerate(groups)]
        self.centers = np.concatenate(centers).astype(np.float32) if centers else np.zeros((0, BUCKETS), np.float32)
        self.names = [name for name, c in zip(names, centers) for _ in range(len(c))]
        self.floor = np.zeros(64)
        if len(x):
            best, band = (x @ self.centers.T).max(1), size_band(counts)
            for b in range(1, 64):
                own = best[band == b]
                self.floor[b] = REJECT_SHARE * own.min() if len(own) else self.floor[b - 1]

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid, its cosine, and whether that is too low."""
        cosine = tfidf(counts, self.idf) @ self.centers.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return best, score, score < self.floor[np.minimum(size_band(counts), 63)]


def fit_language_model(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_sample: int = MAX_SAMPLE) -> LanguageModel:
    """Fit on the rows of ``df`` with text and lang.

    Document frequencies cover all of them. The centroids are fitted on a sample by hash of doc_id that has, in
    expectation, at most ``max_sample`` rows, as many of each language.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            n += batch.num_rows
            for a, b in row_groups(offsets, GROUP_BYTES, GROUP_ROWS):
                held += (ngram_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(held, n))], names=["bucket", "n"])

    df_rows = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(BUCKETS + 1)
    for r in df_rows:
        seen[r["bucket"]] = r["n"]
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel(idf, [], np.zeros((0, BUCKETS), np.float32))
    each = max_sample / len(sizes)
    chance = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, each / n))]), F.col("lang"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in row_groups(offsets, GROUP_BYTES, GROUP_ROWS):
                counts = ngram_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([c.astype(np.uint32).tobytes() for c in counts], pa.binary())], names=["lang", "counts"])

    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < chance * 1_000_003)
    got = drawn.select("text", "lang").mapInArrow(sampled, "lang string, counts binary").orderBy("lang", F.xxhash64("counts")).toArrow()
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), np.uint32).reshape(-1, BUCKETS).astype(np.float32)
    return LanguageModel(idf, got.column("lang").to_pylist(), counts)


def identify_languages(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred (a learned language; ``und`` if the text is null or has no letter), score (the cosine, 0 to 1) and rejected.

    rejected: ``und``, or farther from every centroid than texts of its size are. Without learned languages all is
    ``und``. Columns of the added names are replaced, all others kept; repeated rows get equal results; of equal cosines the first
    language by name wins. Whole texts are read; a very long one takes about 12 bytes of memory a byte. An empty table gives
    an empty one.
    """
    kept = [f for f in df.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = text_buffers(column)
            for a, b in row_groups(offsets, GROUP_BYTES, GROUP_ROWS):
                known = np.array([has_letter(t) for t in column.slice(a, b - a).to_pylist()])
                if len(model.names):
                    best, score, far = model.predict(ngram_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                else:
                    known[:] = False
                    best, score, far = np.zeros(b - a, np.int64), np.zeros(b - a), np.ones(b - a, bool)
                lang = [model.names[i] if k else "und" for i, k in zip(best, known)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(far | ~known)], names=[*names, "lang_pred", "score", "rejected"])

    return df.mapInArrow(released(run), schema)


def held_out_of(doc_id: str = "doc_id") -> Column:
    return id_bucket(F.col(doc_id), 5) == 0


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out_of()))
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out_of().alias("held_out"), "lang_pred", "score", "rejected")
