"""Readers and writers on generated files: images, delimited texts, scores, nested results; streams run to their end."""

import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mullion.operators import locks
from mullion.sources import fetch, images, scans, sinks
from mullion.streaming import windows


def png(w, h, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = (128 + 100 * np.sin(x / 5 + seed) * np.cos(y / 7)).astype(np.uint8)
    rgb = np.stack([base, base, base], -1) + rng.integers(0, 3, (h, w, 3)).astype(np.uint8)
    raw = b"".join(b"\0" + rgb[i].tobytes() for i in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for rel, data in {"train/a/one.png": png(40, 32, 1), "train/a/two.png": png(40, 32, 1), "test/b c/three.png": png(64, 64, 5), "test/b c/broken.png": b"\x89PNG no", "top.png": png(8, 8), "notes.txt": b"x"}.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def test_scan_images(spark, folder):
    got = {r.relpath: r for r in scans.scan_images(spark, folder, "set", "url", "2026-01-01 00:00:00").collect()}
    assert set(got) == {"train/a/one.png", "train/a/two.png", "test/b c/three.png", "test/b c/broken.png", "top.png"}
    one, broken = got["train/a/one.png"], got["test/b c/broken.png"]
    assert (one.split, one.class_label, one.width, one.height, one.mode, one.is_corrupt) == ("train", "a", 40, 32, "RGB", False)
    assert broken.is_corrupt and broken.width is None and len(broken.sha256) == 64
    assert got["top.png"].split == "all" and one.sha256 == got["train/a/two.png"].sha256
    assert [f.name for f in scans.scan_images(spark, folder, "s", "u").schema] == [f.name for f in scans.MANIFEST]


def test_hash_images(spark, folder):
    got = {r.relpath: r for r in images.hash_images(spark, folder).collect()}
    assert got["train/a/one.png"].phash == got["train/a/two.png"].phash and len(got["train/a/one.png"].phash) == 16
    assert got["test/b c/broken.png"].phash is None
    d = bin(int(got["train/a/one.png"].phash, 16) ^ int(got["test/b c/three.png"].phash, 16)).count("1")
    assert d > 6


def test_hash_bits_survive_noise():
    scene = np.random.default_rng(4).integers(0, 256, (8, 8)).repeat(8, 0).repeat(8, 1)
    a = np.stack([scene] * 3, -1).astype(np.uint8)
    b = np.clip(a.astype(int) + np.random.default_rng(0).integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    assert bin(images.hash_bits(a) ^ images.hash_bits(b)).count("1") <= 6


def test_digest_breaks(spark, folder):
    now = scans.file_digests(spark, folder)
    bound = spark.createDataFrame([(r.relpath, r.sha256 if r.relpath != "top.png" else "0") for r in now.collect()] + [("gone.png", "1")], "relpath string, sha256 string")
    assert sorted((r.relpath, r.problem) for r in scans.digest_breaks(now, bound).collect()) == [("gone.png", "absent"), ("top.png", "changed")]


def test_delimited_texts(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('split,class_label,relpath,sha256,width,note\ntrain,"a, b",x/1.png,abc,10,"two\nlines"\ntest,,x/2.png,,bad,\n', encoding="utf-8")
    s = scans.read_strings(spark, str(p), ["relpath", "extra"])
    assert s.columns == ["relpath", "extra", "split", "class_label", "sha256", "width", "note"]
    assert [tuple(r) for r in s.orderBy("relpath").collect()] == [("x/1.png", "", "train", "a, b", "abc", "10", "two\nlines"), ("x/2.png", "", "test", "", "", "bad", "")]
    m = scans.read_manifest(spark, str(p))
    assert [r.width for r in m.orderBy("relpath").collect()] == [10, None]
    with pytest.raises(ValueError, match="missing columns: nothing"):
        scans.need(m, ["nothing"])


def test_scores_and_results(spark, tmp_path):
    for run in ("r1", "r2"):
        buf = io.BytesIO()
        np.savez(buf, labels=np.array([0, 1]), logits=np.array([[1.0, 2.0], [3.0, 4.0]], dtype=np.float32))
        (tmp_path / f"{run}.npz").write_bytes(buf.getvalue())
        (tmp_path / f"{run}.json").write_text(json.dumps({"metrics": {"acc": 0.5}, "per_class": [{"f1": 1.0}]}))
    got = [tuple(r) for r in scans.read_scores(spark, str(tmp_path)).orderBy("run", "item_id").collect()]
    assert got[1] == ("r1", 1, 1, [3.0, 4.0]) and len(got) == 4
    j = scans.read_nested(spark, str(tmp_path / "*.json"), "metrics struct<acc:double>, per_class array<struct<f1:double>>")
    assert sorted((r.run, r.metrics.acc) for r in j.collect()) == [("r1", 0.5), ("r2", 0.5)]


def test_listing_and_settings(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_text("train/a/1.jpg\n\ntrain/a/2.jpg\ntest/b/3.jpg\nREADME\n")
    assert sorted(tuple(r) for r in scans.listing_classes(scans.read_lines(spark, str(p))).collect()) == [("test", "b", 1), ("train", "a", 2)]
    assert scans.read_settings(str(tmp_path / "none.yaml")) == {}
    (tmp_path / "c.json").write_text('{"a": {"a": 0, "b": null}}')
    assert scans.cost_rows(spark, scans.read_settings(str(tmp_path / "c.json"))).count() == 1
    with pytest.raises(ValueError):
        scans.scope_rows(spark, [{"k": "x", "on": "yes"}], ["k"], ["on"])
    with pytest.raises(ValueError):
        scans.scope_rows(spark, [{"k": "x"}, {"k": "x"}], ["k"], ["on"])


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_table_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", 1, "p"), ("b\"x", 2, "q")], "k string, n int, part string")
    path = sinks.write_table(df, str(tmp_path / kind), kind, ["part"])
    reader = spark.read.option("header", True).option("escape", '"')
    back = reader.format(kind).load(path).select("k", F.col("n").cast("int"), "part")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception):
        sinks.write_table(df, path, kind)


def test_small_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", "x,y")], "k string, v string")
    p = sinks.write_small_csv(df, str(tmp_path / "a.csv"), ["k", "v"], ["k"])
    assert open(p, newline="").read() == 'k,v\na,"x,y"\nb,\n'
    with pytest.raises(ValueError):
        sinks.write_small_csv(df, p, ["k", "v"], ["k"], most=1)
    a, b = {"x": 1, "y": ["ü"], "d": "q"}, {"y": ["ü"], "d": "other", "x": 1}
    assert sinks.canonical_json({"b": 1, "a": "ü"}) == '{"a":"ü","b":1}'
    assert sinks.json_digest(a, ["d"]) == sinks.json_digest(b, ["d"]) != sinks.json_digest(a)
    assert sinks.read_json(sinks.write_json(a, str(tmp_path / "g.json")), ["x"]) == {"x": 1}


def test_stream_deduplication(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:10:00"), (2, "2026-01-01 00:20:00")]
    spark.createDataFrame(rows, "k int, t string").select("k", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in"))
    q = windows.deduplicated(stream, "k", "t").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.table("once").collect()) == [1, 2]


def naive_resized(plane, n, support, shape):
    """The two passes of a fixed-point filter, one value at a time."""
    for axis in (1, 0):
        m = plane.shape[axis]
        if m == n:
            continue
        scale = m / n
        wide = max(scale, 1.0)
        lines = plane if axis == 1 else plane.T
        out = np.zeros((lines.shape[0], n), int)
        for k in range(n):
            centre = (k + 0.5) * scale
            at = range(max(0, int(centre - support * wide + 0.5)), min(m, int(centre + support * wide + 0.5)))
            w = [shape((i - centre + 0.5) / wide) for i in at]
            fixed = [int(x / sum(w) * 2**22 + (0.5 if x >= 0 else -0.5)) for x in w]
            for y in range(lines.shape[0]):
                v = ((1 << 21) + sum(int(lines[y, i]) * f for i, f in zip(at, fixed))) >> 22
                out[y, k] = min(255, max(0, v))
        plane = out if axis == 1 else out.T
    return plane


def test_reductions_against_one_value_at_a_time():
    import math

    def lobes(x):
        return 0.0 if abs(x) >= 3 else 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)

    plane = np.random.default_rng(2).integers(0, 256, (37, 50))
    assert (images.resized(plane, 32, "sinc3") == naive_resized(plane, 32, 3.0, lobes)).all()
    assert (images.resized(plane[:20, :20], 32, "sinc3") == naive_resized(plane[:20, :20], 32, 3.0, lobes)).all()
    flat = np.full((9, 70), 45)
    assert (images.resized(flat, 32, "cubic") == 45).all()


def test_hash_of_a_gradient():
    """Brightness that only rises to the right has no energy in lower rows, so their bits follow the median alone."""
    x = np.tile(np.arange(0, 256, 4, dtype=np.uint8), (64, 1))
    bits = f"{images.hash_bits(np.stack([x] * 3, -1)):064b}"
    assert bits[0] == "1" and bits[1] == "0"
    assert images.hash_bits(np.stack([x[:, ::-1]] * 3, -1)) != images.hash_bits(np.stack([x] * 3, -1))


def test_image_measures(spark, tmp_path):
    a = np.zeros((40, 40, 3), np.uint8)
    for name, p in {"a": a, "b": a + 45, "c": a + 105, "wide": np.zeros((40, 60, 3), np.uint8)}.items():
        (tmp_path / f"{name}.png").write_bytes(sinks.png(p))
    m = images.image_measures(spark, str(tmp_path))
    pairs = spark.createDataFrame([("a.png", x) for x in ("a.png", "b.png", "c.png", "wide.png", "none.png")], "a string, b string")
    got = {r.b[:-4]: (r.similarity, r.aspect_close) for r in images.likeness(pairs, m).collect()}
    assert got == {"a": ("high", True), "b": ("moderate", True), "c": ("low", True), "wide": ("high", False), "none": (None, None)}
    h = images.histogram(a + 45)
    assert len(h) == 48 and h[45 // 16] == 1.0 and sum(h) == pytest.approx(3)
    scene, mask = np.full((4, 4, 3), 200, np.uint8), np.zeros((4, 4, 3), np.uint8)
    scene[0], mask[0, :2], mask[1, 0] = 20, 255, 255
    assert images.covered_share(scene, mask) == 3 / 5
    assert images.covered_share(np.zeros((0, 0, 3), np.uint8), np.zeros((0, 0, 3), np.uint8)) is None


def test_shapes_of_all_formats(spark):
    pixels = png(6, 4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x04\x00\x06\x03\x01\x02\x03\xff\xda\x00\x02" + b"x" * 9 + b"\xff\xd9"
    lossless = b"RIFF" + (22).to_bytes(4, "little") + b"WEBPVP8L" + (10).to_bytes(4, "little") + b"\x2f" + (5 | 3 << 14 | 1 << 28).to_bytes(4, "little") + b"\0" * 5
    entry = lambda tag, kind, n, v: struct.pack("<HHII", tag, kind, n, v)
    tags = [entry(256, 3, 1, 6), entry(257, 3, 1, 4), entry(258, 3, 1, 8), entry(262, 3, 1, 2), entry(273, 4, 1, 8), entry(277, 3, 1, 3), entry(279, 4, 1, 72)]
    tiff = b"II*\0" + struct.pack("<I", 80) + b"\0" * 72 + struct.pack("<H", len(tags)) + b"".join(tags) + b"\0" * 4
    bmp = b"BM" + struct.pack("<IHHI", 54 + 80, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 4, 1, 24, 0, 80, 0, 0, 0, 0) + b"\0" * 80
    gif = b"GIF89a" + struct.pack("<HH", 6, 4) + b"\0" * 9 + b";"
    whole = {"png": (pixels, "RGB"), "jpeg": (jpeg, "RGB"), "webp": (lossless, "RGBA"), "tiff": (tiff, "RGB"), "bmp": (bmp, "RGB"), "gif": (gif, "P")}
    broken = {"png cut": pixels[:-20], "png bit": pixels[:45] + b"?" + pixels[46:], "jpeg cut": jpeg[:-2], "webp cut": lossless[:-3], "tiff cut": tiff[:70], "bmp cut": bmp[:-9], "gif cut": gif[:-1], "text": b"hello", "none": None, "empty": b""}
    rows = spark.createDataFrame([*((n, bytearray(b)) for n, (b, _) in whole.items()), *((n, None if b is None else bytearray(b)) for n, b in broken.items())], "name string, content binary")
    got = {r.name: tuple(r.s) for r in rows.select("name", scans.image_shape("content").alias("s")).collect()}
    assert got == {n: (6, 4, mode, False) for n, (_, mode) in whole.items()} | {n: (None, None, None, True) for n in broken}


def test_index_with_holes_is_not_persisted(spark, tmp_path):
    holes = lambda: spark.createDataFrame([("a", "1"), ("b", None)], "relpath string, phash string")
    with pytest.raises(ValueError):
        scans.load_or_build(spark, str(tmp_path / "index"), holes, F.col("phash").isNotNull())
    assert not (tmp_path / "index").exists()


def test_locks_that_do_not_hold(spark):
    facts = {"t": spark.sql("select 3 as n, 'x' as name")}
    lock = locks.build_lock(facts, spark.createDataFrame([("in", "d1")], "name string, sha256 string"))
    assert locks.lock_problems(lock, locks.build_lock(facts, spark.createDataFrame([("in", "d1")], "name string, sha256 string"))) == []
    assert locks.lock_problems(lock | {"facts": {}}, lock) == ["lock_digest", "facts.t"]
    assert locks.lock_problems(lock, locks.build_lock(facts)) == ["inputs.in"]
    with pytest.raises(ValueError):
        locks.require_lock(lock, lock, ["u"])
    with pytest.raises(ValueError):
        locks.build_lock({"t": spark.range(2)})
    with pytest.raises(PermissionError):
        locks.guarded(spark.sql("select 'pass' as status").limit(0), lambda: None)


def test_fetching_over_http(tmp_path):
    """A server that can and one that can't go on from a byte; parts, changed digests and missing files."""
    import hashlib
    import http.server
    import threading

    data = bytes(range(256)) * 500

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            at = int(self.headers["Range"][6:-1]) if "Range" in self.headers and self.path == "/ranged" else 0
            if self.path == "/gone":
                return self.send_error(404)
            if at >= len(data):
                return self.send_error(416)
            self.send_response(206 if at else 200)
            self.end_headers()
            self.wfile.write(data[at:])

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, sha = f"http://127.0.0.1:{server.server_port}", hashlib.sha256(data).hexdigest()
    one = lambda path, at, want=sha: fetch.fetch_one(base + path, str(tmp_path / at), want, 2, 0.0)
    assert one("/ranged", "a") == "fetched" and one("/ranged", "a") == "kept" and (tmp_path / "a").read_bytes() == data
    for path in ("/ranged", "/plain"):
        (tmp_path / "b.part").write_bytes(data[:1000])
        assert one(path, "b") == "resumed" and (tmp_path / "b").read_bytes() == data
        (tmp_path / "b").unlink()
    (tmp_path / "c.part").write_bytes(b"?" * len(data))
    assert one("/ranged", "c") == "fetched"
    assert one("/ranged", "d", "0" * 64) == "mismatch" and not (tmp_path / "d").exists() and not (tmp_path / "d.part").exists()
    assert one("/gone", "e") == "failed"
    server.shutdown()


def test_fetching_stays_in_its_folder(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"x")
    rows = spark.createDataFrame([(f"file://{tmp_path}/x", "../out", None), (None, "a", None), (f"file://{tmp_path}/x", None, None), (f"file://{tmp_path}/x", "in/x", None)], "url string, relpath string, sha256 string")
    got = {r.relpath: r.outcome for r in fetch.fetch_files(rows, str(tmp_path / "to"), 1, 0.0).collect()}
    assert got == {"../out": "failed", "a": "failed", None: "failed", "in/x": "fetched"}
