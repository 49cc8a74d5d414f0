"""SentencePiece encoding and decoding with source offsets.

Each text is normalised by the longest prefixes of the model's compiled character map,
recording where in the source each normalised character began; the pieces of the
normalised text are then projected to byte spans of the source. The model file's bytes
(under a few MB whatever the data) are broadcast; every text is encoded whole in its task.

Defined cases. A null text counts as empty, and an empty text has the begin and end ids
only. Ids of rows may be null or repeated. An empty table gives an empty result. A text
that the model cannot spell falls back to byte pieces, of which the last one of a
character spans it and the others span nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import documents, text_of
from bibloom.llm.piece_model import PieceModel

AT_ONCE = 1 << 16  # characters of texts that are encoded at once
MODEL = "piece_bpe_32k.model"
_MODELS: dict[str, PieceModel] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def model_of(data: bytes) -> PieceModel:
    """One model a worker process, kept between its tasks."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def together(texts: pd.Series) -> Iterator[list[str]]:
    """Texts in lists that are encoded at once."""
    some: list[str] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _shared(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, begins, ends): piece ids and the source bytes that each piece covers."""
    shared = _shared(docs, path or default_model())

    @F.pandas_udf("struct<ids:array<int>,begins:array<int>,ends:array<int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = model_of(shared.value)
        for texts in parts:
            rows = [e for some in together(texts) for e in model.encode_all(some)]
            yield pd.DataFrame({n: pd.Series([r[k].astype(np.int32) for r in rows], dtype=object) for k, n in enumerate(("ids", "begins", "ends"))})

    return docs.select(F.col(id_col).alias(id_col), run(text_of(text_col)).alias("e")).select(id_col, "e.*")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of any table of piece ids; null ids give a null text."""
    shared = _shared(encoded, path or default_model())

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_of(shared.value)
        for ids in parts:
            yield pd.Series([None if x is None else model.decode(np.asarray(x, dtype=np.int64)) for x in ids], dtype=object)

    return encoded.select(F.col(id_col), run(ids_col).alias("text"))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of each text, encoded and decoded again.

    The same encoding as encode(); only digests leave the task, the spans' as
    little-endian unsigned 32-bit begin, end pairs.
    """
    shared = _shared(docs, path or default_model())

    @F.pandas_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,spans_sha256:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = model_of(shared.value)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for texts in parts:
            rows = []
            for ids, begins, ends in (e for some in together(texts) for e in model.encode_all(some)):
                spans = np.stack([begins, ends], axis=1).astype("<u4")
                rows.append((len(ids), digest(ids.tobytes()), digest(model.decode(ids).encode()), digest(spans.tobytes())))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return docs.select(F.col(id_col), run(text_of(text_col)).alias("e")).select(id_col, "e.*")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
