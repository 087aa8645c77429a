"""Writers: tables in several formats, single files of small artifacts, canonical JSON."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import tempfile
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> str:
    """A distributed write; Spark's commit makes the whole job visible or nothing of it."""
    if kind not in ("parquet", "orc", "json", "csv"):
        raise ValueError(f"unknown format {kind}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if kind == "csv":
        # Outer blanks are part of a text; without these options they are lost.
        w = w.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.format(kind).save(path)
    return path


def _replace(path: str, text: str) -> str:
    """Writes beside the file first and renames, so that a reader sees the old or the new file."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise
    return path


def write_small_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], most: int = 1_000_000) -> str:
    """One CSV file with fixed columns, order and line ends, for artifacts of at most `most` rows; larger ones raise."""
    import io

    rows = df.select(*columns).orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table instead")
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows(["" if v is None else v for v in r] for r in rows)
    return _replace(path, out.getvalue())


def canonical_json(value: object) -> str:
    """JSON with sorted keys, no blanks and plain Unicode; equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_digest(value: dict, without: Sequence[str] = ()) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in value.items() if k not in without}).encode()).hexdigest()


def write_json(value: object, path: str) -> str:
    """One JSON file with sorted keys and a last line end; nothing in it depends on the time of writing."""
    return _replace(path, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def read_json(path: str, known: Sequence[str] | None = None) -> dict:
    """A JSON object, reduced to the known keys if they are given."""
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    return value if known is None else {k: v for k, v in value.items() if k in known}


def write_bytes(spark: SparkSession, path: str, content: bytes) -> str:
    """One small file on any file system that Spark knows, replacing an older one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def png(pixels: np.ndarray) -> bytes:
    """RGB or grey pixels as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    h, w = pixels.shape[:2]
    rows = b"".join(b"\0" + np.ascontiguousarray(r, dtype=np.uint8).tobytes() for r in pixels)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2 if pixels.ndim == 3 else 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
