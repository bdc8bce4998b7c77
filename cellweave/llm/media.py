"""Media columns: payloads stored as progressive JPEG and read back into RGB tensors."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.llm import jpeg
from cellweave.llm.arrow import map_batches

_FLUSH = 4 << 20


def padded(text: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of 576."""
    short = -len(text) % jpeg.PAYLOAD_UNIT
    return text + b"\xff" * (short if text else jpeg.PAYLOAD_UNIT)


def store_text(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text (null: empty) as a progressive JPEG. Repeated rows repeat; no rows give none."""

    def work(b: pa.RecordBatch):
        ids, texts, kept, size = [], b.column(1).cast(pa.large_binary()), [], 0
        for i, t in enumerate(texts):
            raw = t.as_py() or b""
            ids.append((i, len(raw)))
            kept.append(jpeg.encode_payload(padded(raw)))
            size += len(kept[-1])
            if size > _FLUSH or i == len(texts) - 1:
                yield {"doc_id": b.column(0).take(pa.array([x for x, _ in ids])), "n_bytes": [n for _, n in ids], "media": kept}
                ids, kept, size = [], [], 0

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_bytes long, media binary")


def read_tensors(stored: DataFrame) -> DataFrame:
    """(doc_id, height, width, tensor): the full-resolution RGB tensor of each media value, row-major uint8; null media give null."""

    def work(b: pa.RecordBatch):
        for i in range(b.num_rows):
            data = b.column(1)[i].as_py()
            image = None if data is None else jpeg.decode(data)
            yield {
                "doc_id": b.column(0).slice(i, 1), "height": [None if image is None else image.shape[0]],
                "width": [None if image is None else image.shape[1]], "tensor": [None if image is None else image.tobytes()],
            }

    return map_batches(stored.select("doc_id", "media"), work, "doc_id long, height int, width int, tensor binary")


def read_features(stored: DataFrame) -> DataFrame:
    """Digests of what is read back from media, and a feature of its RGB tensor: shape, channel means and variance."""

    def work(b: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for v in b.column(2):
            data = v.as_py()
            height, width, parts, quant, comments = jpeg.coefficients(data)
            payload = jpeg._payload(parts, int(next(c for c in comments if c.startswith(b"payload ")).split()[1]))
            image = jpeg.tensor(height, width, parts, quant)
            n = height * width
            sums = image.reshape(-1, 3).sum(0, dtype=np.int64)
            square = int((image.astype(np.int32) ** 2).sum(dtype=np.int64))
            variance = square / (3 * n) - (int(sums.sum()) / (3 * n)) ** 2
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-32:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["feature"].append(f"{height}x{width}x3 rgb={sums[0] / n:.3f},{sums[1] / n:.3f},{sums[2] / n:.3f} var={variance:.3f}")
        return out | {"doc_id": b.column(0), "n_bytes": b.column(1)}

    return map_batches(
        stored.select("doc_id", "n_bytes", "media"), work,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return read_features(store_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))
