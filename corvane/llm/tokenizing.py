"""Operator 6: byte-pair encoding and decoding of a text column (see ``bpe`` for the method)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.bpe import encoder
from corvane.llm.common import read_table, released, row_groups, text_buffers

GROUP_BYTES = 1 << 20


def encode_texts(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add each row's token ids (little-endian unsigned 32-bit, as binary) and the text decoded from them.

    A null text counts as empty and gives no ids and an empty decoded text. Rows keep their other columns;
    ``ids`` and ``decoded`` replace columns of the same names. Repeated rows are encoded each. Texts are encoded whole,
    however long; an empty table gives an empty table.
    """
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            for a, b in row_groups(offsets, GROUP_BYTES):
                got, at = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = [got[at[i] : at[i + 1]] for i in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in names), pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary()), pa.array([enc.model.decode(r.astype(np.int64)) for r in rows], pa.binary()).cast(pa.string())],
                    names=[*names, ids, decoded],
                )

    return df.mapInArrow(released(run, lambda: encoder(tokenizer_path).forget()), schema)


def op6_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
