"""Media columns: payloads kept in progressive JPEG files, and files turned into RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import without

BLOCK = 64


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes with zeros up to a positive multiple of 64; null as empty."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % BLOCK or BLOCK * (not data))


def to_media(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``media``, a progressive JPEG that holds the whole text, in place of ``text``.

    Equal texts give equal files. Null and empty texts give a file of 64 zero bytes. Other columns
    pass through; the new ones take the place of columns with their names. An empty table stays so.
    """
    docs = without(docs, "n_bytes", "media")
    rest = [(n, t) for n, t in docs.dtypes if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                done = [(n, jpeg.encode(data)) for n, data in map(padded, part.column("text").to_pylist())]
                more = [pa.array([n for n, _ in done], pa.int64()), pa.array([m for _, m in done], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n, _ in rest], *more], names=[*[n for n, _ in rest], "n_bytes", "media"])

    return docs.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in rest], "n_bytes long, media binary"]))


def feature(tensor: np.ndarray) -> str:
    """Size, means of the three channels and shares of four brightness ranges, in whole thousandths."""
    pixels = tensor.shape[0] * tensor.shape[1]
    means = tensor.sum((0, 1), dtype=np.int64) * 1000 // (pixels or 1)
    light = np.bincount((tensor[:, :, 1] >> 6).ravel(), minlength=4) * 1000 // (pixels or 1)
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{','.join(map(str, means))}:{','.join(map(str, light))}"


def tensors(stored: DataFrame, rgb: bool = True) -> DataFrame:
    """``stored`` with what its ``media`` holds.

    height, width, rgb (row by row, three bytes a pixel; left out unless asked for), feature,
    error; and of files made by ``to_media`` payload_bytes, payload_sha256 and tail_crc32. A
    file that cannot be read, or null, gives nulls and says why in ``error``; one bad file stops nothing.
    """
    names = ["height", "width", *(["rgb"] if rgb else []), "feature", "payload_bytes", "payload_sha256", "tail_crc32", "error"]
    stored = without(stored, *names)
    kinds = {"rgb": pa.binary(), "feature": pa.string(), "payload_sha256": pa.string(), "error": pa.string()}

    def look(media: bytes | None) -> dict:
        try:
            if media is None:
                raise ValueError("null")
            image = jpeg.read(media)
            tensor = jpeg.rgb(image)
            data = jpeg.payload(image) if any(c.startswith(b"payload ") for c in image.comments) else None
        except ValueError as e:
            return {"error": str(e) or type(e).__name__}
        out = {"height": tensor.shape[0], "width": tensor.shape[1], "feature": feature(tensor)} | ({"rgb": tensor.tobytes()} if rgb else {})
        if data is not None:
            out |= {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-BLOCK:])}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [look(m) for m in part.column("media").to_pylist()]
                more = [pa.array([d.get(n) for d in done], kinds.get(n, pa.int64())) for n in names]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *names])

    spark_kinds = {pa.binary(): "binary", pa.string(): "string"}
    schema = [f"`{n}` {t}" for n, t in stored.dtypes] + [f"{n} {spark_kinds.get(kinds.get(n), 'long')}" for n in names]
    return stored.mapInArrow(run, ", ".join(schema))
