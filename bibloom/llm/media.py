"""A media column of lossless WebP images, written and read back.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, become images
of 144 pixels a row, four bytes a pixel; a payload beyond 16,384 rows goes on in the next
image. An image that repeats few colours is written with a palette where that is smaller.
Images are stored as binary columns, and reading one decodes prefix codes,
back-references and colour cache and inverts the predictor, cross-colour, subtract-green
and palette transforms, giving pixel arrays.

Defined cases. A null text counts as empty: 576 bytes of 255. Equal texts give equal
files. Ids may be null or repeated. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm import webp_lossless as webp
from bibloom.llm.common import documents, text_of

UNIT = 576
WIDTH = 144
ROW = 4 * WIDTH
MOST = webp.MAX_SIDE * ROW
AT_ONCE = 1 << 20  # bytes of text that are written side by side
FEW = 10  # pixels a colour from which on a palette is tried


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def written(image: np.ndarray, plan: dict) -> bytes:
    """The image's file as planned; where it repeats few colours often, the smaller one of that and one with a palette."""
    planned = webp.encode(image, **plan)
    packed = np.ascontiguousarray(image).view("<u4").ravel()
    most = min(256, len(packed) // FEW)
    if len(set(packed[: 2 * most].tolist())) > most or len(np.unique(packed)) > most:
        return planned
    return min(planned, webp.encode(image, palette=True), key=len)


def store_all(payloads: list[bytes]) -> list[list[bytes]]:
    """The images of each payload."""
    parts = [[p[i : i + MOST] for i in range(0, len(p), MOST)] for p in payloads]
    images = [np.frombuffer(x, np.uint8).reshape(-1, WIDTH, 4) for p in parts for x in p]
    files = iter([written(image, plan) for image, plan in zip(images, webp.plans(images))])
    return [[next(files) for _ in p] for p in parts]


def store(payload: bytes) -> list[bytes]:
    """The payload's images."""
    return store_all([payload])[0]


def together(texts: pd.Series) -> Iterator[list[bytes]]:
    """Texts' UTF-8 bytes, as many at once as are written side by side."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        some.append(text.encode())
        size += len(some[-1])
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def pixels(images: list[bytes]) -> np.ndarray:
    """Rows of all images, one below another."""
    return np.concatenate([webp.decode(x) for x in images]) if len(images) > 1 else webp.decode(images[0])


def feature(image: np.ndarray) -> str:
    """Rows, the mean of each channel, its mean step along a row, and distinct byte values."""
    flat = image.reshape(-1, 4)
    mean = flat.mean(axis=0, dtype=np.float64)
    step = np.abs(np.diff(image.astype(np.int16), axis=1)).mean(axis=(0, 1), dtype=np.float64)
    kinds = np.count_nonzero(np.bincount(flat.ravel(), minlength=256))
    return ";".join([str(len(image)), *(f"{v:.3f}" for v in (*mean, *step)), str(kinds)])


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the stored form of each text, an array of image files."""

    @F.pandas_udf("array<binary>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([files for some in together(texts) for files in store_all([payload_of(raw) for raw in some])], dtype=object)

    text = text_of(text_col)
    return docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), run(text).alias("media"))


def read_column(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, pixels, rows, feature): the decoded bytes, four a pixel, 144 pixels a row. Null media give nulls."""

    @F.pandas_udf("struct<pixels:binary,rows:int,feature:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in parts:
            images = [pixels(list(x)) if x is not None and len(x) else None for x in files]
            rows = [(None, None, None) if x is None else (x.tobytes(), len(x), feature(x)) for x in images]
            frame = pd.DataFrame(rows, columns=["pixels", "rows", "feature"])
            yield frame.astype({"rows": "Int32"})

    return media.select(F.col(id_col), run(media_col).alias("m")).select(id_col, "m.*")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's stored form and of the payload read back from it, in one pass."""

    @F.pandas_udf(
        "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"
    )
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for texts in parts:
            rows = []
            for some in together(texts):
                for raw, media in zip(some, store_all([payload_of(raw) for raw in some])):
                    image = pixels(media)
                    back, stored = image.tobytes(), b"".join(media)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image)))
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(id_col), run(text_of(text_col)).alias("m")).select(id_col, "m.*")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
