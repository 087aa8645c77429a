"""Readers: image folders, delimited tables of strings, manifests, scores, nested results, text listings.

Readers declare what they need and fail on missing columns; they never infer types from the data unless asked.
"""

from __future__ import annotations

import io
import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File name extensions of images. Fixed values.
IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,tif,tiff,gif,webp,JPG,JPEG,PNG,BMP,TIF,TIFF,GIF,WEBP}"

MANIFEST = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("dataset", T.StringType()), ("split", T.StringType()), ("class_label", T.StringType()), ("relpath", T.StringType()), ("sha256", T.StringType()),
        ("width", T.IntegerType()), ("height", T.IntegerType()), ("mode", T.StringType()), ("n_bytes", T.LongType()), ("is_corrupt", T.BooleanType()),
        ("source_url", T.StringType()), ("acquired_at_utc", T.TimestampType()),
    )]
)


def image_files(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """(path, length, modificationTime, content) of all images under a folder; without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(root)
    return files if with_content else files.drop("content")


def relative(path: Column, root: str) -> Column:
    """The part of a file's address after the root."""
    bare = root.split("://", 1)[-1].rstrip("/")
    return F.regexp_replace(F.regexp_replace(path, r"^file:/*", "/"), "^.*?" + "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in bare) + "/", "")


_SHAPE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("mode", T.StringType()), T.StructField("is_corrupt", T.BooleanType())])


def _png(b: bytes) -> tuple[int, int, str]:
    """Every chunk's checksum is proved, and the pixels unpacked to their full length."""
    at, packed, head = 8, [], None
    while True:
        size, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        body = b[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(b[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    w, h, depth, colour, lace = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if not lace and len(zlib.decompress(b"".join(packed))) != h * (1 + -(-w * per * depth // 8)):
        raise ValueError("too few pixels")
    mode = {0: "1" if depth == 1 else "I;16" if depth == 16 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour]
    return w, h, mode


def _jpeg(b: bytes) -> tuple[int, int, str]:
    """The frame's size; a file is whole if its scan begins and an end marker follows it."""
    at, size = 2, None
    while True:
        if b[at] != 0xFF:
            raise ValueError("no marker")
        marker, n = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            size = int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big"), {1: "L", 3: "RGB", 4: "CMYK"}[b[at + 9]]
        if marker == 0xDA:
            if size is None or b.find(b"\xff\xd9", at) < 0:
                raise ValueError("no end")
            return size
        at += 2 + n


def _gif(b: bytes) -> tuple[int, int, str]:
    if b.rstrip(b"\0")[-1:] != b";":
        raise ValueError("no end")
    return int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little"), "P"


def _bmp(b: bytes) -> tuple[int, int, str]:
    w, h, depth = int.from_bytes(b[18:22], "little"), abs(int.from_bytes(b[22:26], "little", signed=True)), int.from_bytes(b[28:30], "little")
    if int.from_bytes(b[30:34], "little") == 0 and len(b) < int.from_bytes(b[10:14], "little") + h * (-(-w * depth // 32) * 4):
        raise ValueError("too few pixels")
    return w, h, {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGBA"}[depth]


def _webp(b: bytes) -> tuple[int, int, str]:
    """The three kinds of first chunk: lossy, lossless, extended."""
    if len(b) < 8 + int.from_bytes(b[4:8], "little"):
        raise ValueError("too short")
    kind, body = b[12:16], b[20:]
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        return int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF, "RGB"
    if kind == b"VP8L" and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB"
    if kind == b"VP8X":
        return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1, "RGBA" if body[0] & 16 else "RGB"
    raise ValueError("no picture")


def _tiff(b: bytes) -> tuple[int, int, str]:
    """The first directory; every strip or tile of pixels has to lie within the file."""
    order = "little" if b[:2] == b"II" else "big"
    at = int.from_bytes(b[4:8], order)
    tags: dict[int, list[int]] = {}
    for k in range(int.from_bytes(b[at : at + 2], order)):
        e = b[at + 2 + 12 * k : at + 14 + 12 * k]
        width, n = {1: 1, 3: 2, 4: 4}.get(int.from_bytes(e[2:4], order)), int.from_bytes(e[4:8], order)
        if width:
            held = e[8:12] if width * n <= 4 else b[int.from_bytes(e[8:12], order) :][: width * n]
            tags[int.from_bytes(e[:2], order)] = [int.from_bytes(held[width * i : width * i + width], order) for i in range(n)]
    for where, length in ((273, 279), (324, 325)):
        if any(x + y > len(b) for x, y in zip(tags.get(where, ()), tags.get(length, ()))):
            raise ValueError("too short")
    if 273 not in tags and 324 not in tags:
        raise ValueError("no pixels")
    per, kind, depth = tags.get(277, [1])[0], tags.get(262, [1])[0], tags.get(258, [1])[0]
    mode = "P" if kind == 3 else "CMYK" if kind == 5 else {1: "1" if depth == 1 else "I;16" if depth == 16 else "L", 2: "LA", 3: "RGB", 4: "RGBA"}[per]
    return tags[256][0], tags[257][0], mode


#: First bytes of a file, and what reads the rest.
FORMATS = ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8", _jpeg), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"BM", _bmp), (b"II*\0", _tiff), (b"MM\0*", _tiff))


@F.pandas_udf(_SHAPE)
def image_shape(content: pd.Series) -> pd.DataFrame:
    """Size and mode of PNG, JPEG, GIF, BMP, TIFF and WebP bytes; anything else, cut off or broken is corrupt."""

    def one(b: bytes | None) -> tuple:
        try:
            for head, read in FORMATS:
                if b.startswith(head):
                    return *read(b), False
            if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
                return *_webp(b), False
        except (IndexError, KeyError, TypeError, ValueError, AttributeError, zlib.error):
            pass
        return None, None, None, True

    return pd.DataFrame([one(b) for b in content], columns=["width", "height", "mode", "is_corrupt"]).astype({"width": "Int32", "height": "Int32"})


def scan_images(spark: SparkSession, root: str, dataset: str, source_url: str, acquired_at: str | None = None) -> DataFrame:
    """A manifest from root/<split>/<class>/<image>: one row per image; corrupt files are marked, never dropped.

    Images not under a split and class folder get the split 'all'. An empty folder gives no rows.
    """
    files = image_files(spark, root)
    rel = relative(F.col("path"), root)
    parts = F.split(rel, "/")
    deep = F.size(parts) >= 3
    rows = files.select(
        F.lit(dataset).alias("dataset"),
        F.when(deep, parts[0]).otherwise("all").alias("split"),
        F.when(deep, parts[1]).when(F.size(parts) == 2, parts[0]).alias("class_label"),
        rel.alias("relpath"),
        F.sha2("content", 256).alias("sha256"),
        image_shape("content").alias("i"),
        F.col("length").alias("n_bytes"),
        F.lit(source_url).alias("source_url"),
        F.lit(acquired_at).cast("timestamp").alias("acquired_at_utc"),
    )
    return rows.select("dataset", "split", "class_label", "relpath", "sha256", "i.width", "i.height", "i.mode", "n_bytes", "i.is_corrupt", "source_url", "acquired_at_utc")


def file_digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(relpath, n_bytes, sha256) of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(relative(F.col("path"), root).alias("relpath"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def digest_breaks(found: DataFrame, bound: DataFrame) -> DataFrame:
    """(relpath, problem): bound files that are absent or whose digest is another."""
    j = bound.select("relpath", F.col("sha256").alias("_b")).join(found.select("relpath", F.col("sha256").alias("_f")), "relpath", "left")
    return j.select("relpath", F.when(F.col("_f").isNull(), "absent").when(F.col("_f") != F.col("_b"), "changed").alias("problem")).where("problem is not null")


def need(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_strings(spark: SparkSession, path: str, columns: Sequence[str] = (), multi_line: bool = True) -> DataFrame:
    """A CSV file with a header as texts only: empty cells stay empty texts. Wanted columns that it lacks come as empty
    texts, further ones are kept after them."""
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns], *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns if c not in columns])


def read_manifest(spark: SparkSession, path: str, needed: Sequence[str] = ("split", "class_label", "relpath", "sha256")) -> DataFrame:
    """A manifest in CSV, typed by the contract's columns; further columns stay texts. Missing needed columns raise."""
    raw = need(read_strings(spark, path), needed)
    kinds = {f.name: f.dataType for f in MANIFEST.fields}
    return raw.select(*[F.nullif(F.col(c), F.lit("")).try_cast(kinds[c]).alias(c) if c in kinds and not isinstance(kinds[c], T.StringType) else F.col(c) for c in raw.columns])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def listing_classes(lines: DataFrame) -> DataFrame:
    """(split, class_label, n) of a listing of split/class/file paths; other lines are left out."""
    p = F.split("line", "/")
    return lines.where(F.size(p) >= 3).groupBy(p[0].alias("split"), p[1].alias("class_label")).agg(F.count(F.lit(1)).alias("n"))


def read_nested(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON documents, one per file, with the file's stem as `run`; a schema spares the pass that infers one."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("run", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", ""))


def read_scores(spark: SparkSession, path: str, scores: str = "logits", labels: str = "labels") -> DataFrame:
    """(run, item_id, y_true, scores) from NPZ archives of labels and a matrix of scores, one archive per run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content)) as z:
                    y, m = z[labels], z[scores]
                if len(y) != len(m):
                    raise ValueError(f"{name}: {len(y)} labels and {len(m)} rows of scores")
                stem = os.path.splitext(os.path.basename(name))[0]
                yield pd.DataFrame({"run": stem, "item_id": np.arange(len(y), dtype=np.int64), "y_true": y.astype(np.int32), "scores": list(m.astype(np.float64))})

    return files.mapInPandas(unpack, "run string, item_id long, y_true int, scores array<double>")


def read_settings(path: str) -> dict:
    """A YAML or JSON document of settings (taxonomies, scopes, cost tables), small by nature; a missing file is empty."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package") from e
        return yaml.safe_load(f) or {}


def cost_rows(spark: SparkSession, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(true_action, pred_action, cost) from nested settings; a missing cell is left out for the cost rules to find."""
    return spark.createDataFrame([(a, b, float(c)) for a, row in weights.items() for b, c in row.items() if c is not None] or [], "true_action string, pred_action string, cost double")


def scope_rows(spark: SparkSession, entries: list[dict], keys: Sequence[str], layers: Sequence[str]) -> DataFrame:
    """Scope entries as rows; a layer flag that is no boolean is refused, a repeated key too."""
    seen = set()
    for e in entries:
        key = tuple(e.get(k) for k in keys)
        if key in seen:
            raise ValueError(f"repeated scope entry {key}")
        seen.add(key)
        for layer in layers:
            if e.get(layer) is not None and not isinstance(e[layer], bool):
                raise ValueError(f"{key}: {layer} must be true or false")
    kinds = ", ".join([*(f"{k} string" for k in keys), *(f"{x} boolean" for x in layers)])
    return spark.createDataFrame([tuple(e.get(c) for c in (*keys, *layers)) for e in entries], kinds)


def settings_differences(source: dict, derived: dict, may_differ: Sequence[str] = ()) -> list[tuple[str, str, str | None, str | None]]:
    """(key, outcome, source, derived) of nested settings by dotted keys: added, removed or changed ones.

    Keys that may differ, and those below them, are left out. Values are compared as canonical JSON.
    """

    def flat(value: object, at: str) -> dict[str, str]:
        if isinstance(value, dict) and value:
            return {k: v for name, x in value.items() for k, v in flat(x, f"{at}.{name}" if at else str(name)).items()}
        return {at: json.dumps(value, sort_keys=True, ensure_ascii=False)}

    a, b = flat(source, ""), flat(derived, "")
    free = lambda k: any(k == m or k.startswith(m + ".") for m in may_differ)
    out = [(k, "removed" if k not in b else "added" if k not in a else "changed", a.get(k), b.get(k)) for k in sorted({*a, *b}) if a.get(k) != b.get(k)]
    return [x for x in out if not free(x[0])]


def load_or_build(spark: SparkSession, path: str, build, complete: Column | None = None) -> DataFrame:
    """The table persisted at `path`, or what build() gives, persisted there first.

    `complete` has to hold for every row, else nothing is persisted and an error raised: an index with holes would pass
    for one without.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df = build()
        if complete is not None and (bad := df.where(~F.coalesce(complete, F.lit(False))).count()):
            raise ValueError(f"{bad} rows are not complete")
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
