import hashlib
import struct
import zipfile
import zlib

import pytest

from foldcast.llm import media
from foldcast.llm.common import Workspace

TEXTS = [(1, "abc"), (2, None), (3, ""), (4, "é漢" * 5000), (5, "x" * 192), (6, "x" * 193), (None, "no id"), (7, "abc"), (7, "abc"), (-8, "y" * 300000)]


def test_round_trip_and_query(spark, tmp_path):
    spark.createDataFrame([(*r, 0) for r in TEXTS], "doc_id long, text string, payload int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in media.op2(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t in TEXTS:
        raw = (t or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        m = media.png(p)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(p)))
    assert got == sorted(want, key=str)


def test_ranges_cover_every_member_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (i % 70)) for i in range(500)], "doc_id long, text string").repartition(2)
    ws = Workspace(spark, "m")
    ws.save(media.write_archives(docs, ws.path("a")), "manifest")
    rows = media.load(spark, ws.path("a"), ws.path("manifest"), rangeBytes="700").collect()
    assert sorted(r.doc_id for r in rows) == list(range(500))
    assert len({r.offset for r in rows}) > 100
    assert all(bytes(r.payload) == media.padded(b"word " * (r.doc_id % 70)) for r in rows)


def test_a_member_is_tried_again_alone(spark, tmp_path, monkeypatch):
    out = media._Archives(f"file://{tmp_path}")
    for i in range(5):
        out.add(f"{i}_3", media.png(media.padded(b"abc")))
    out.close()
    reader = media.MediaReader({"path": f"file://{tmp_path}", "manifest": ""})
    whole, fails = media.samples, [True, True]

    def flaky(image):
        if fails:
            fails.pop()
            raise ValueError("a passing fault")
        return whole(image)

    monkeypatch.setattr(media, "samples", flaky)
    part = media._Range(out.done[0][0], 0, 1 << 30)
    assert sum(b.num_rows for b in reader.read(part)) == 5
    path = tmp_path / out.done[0][0]
    raw = bytearray(path.read_bytes())
    raw[60] ^= 255
    path.write_bytes(raw)
    with pytest.raises(ValueError):
        list(reader.read(part))
    keep = media.MediaReader({"path": f"file://{tmp_path}", "manifest": "", "damaged": "keep"})
    rows = [r for b in keep.read(part) for r in b.to_pylist()]
    assert [r["error"] is None for r in rows] == [False, True, True, True, True]
    assert rows[0]["payload"] is None and rows[0]["media"] is None and rows[0]["doc_id"] == 0


def test_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_png(image):
    """Width, height and samples by the published format: chunks, one zlib stream, a filter type before each line."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data, head = 8, b"", None
    while at < len(image):
        n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body, check = image[at + 8 : at + 8 + n], int.from_bytes(image[at + 8 + n : at + 12 + n], "big")
        assert zlib.crc32(kind + body) == check
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    assert kind == b"IEND" and head[2:] == (8, 0, 0, 0, 0)
    width, height, raw, out, above = head[0], head[1], zlib.decompress(data), bytearray(), bytes(head[0])
    for y in range(height):
        how, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = line[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = min((a, b, c), key=lambda v: abs(a + b - c - v))
            line[x] = (line[x] + (0, a, b, (a + b) // 2, p)[how]) & 255
        out += line
        above = bytes(line)
    return width, height, bytes(out)


def plain_feature(p):
    n, mean = len(p), sum(p) / len(p)
    cuts = [i * n // 65 for i in range(66)]
    means = [sum(p[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:])]
    bits = "".join("1" if y > x else "0" for x, y in zip(means, means[1:]))
    return int(mean * 1000), int(sum((x - mean) ** 2 for x in p) / n * 1000), f"{int(bits, 2):016x}"


def test_stored_form_by_an_independent_reader(spark, tmp_path):
    """The archives as the standard library reads them, images by a decoder of their own, features by plain loops."""
    docs = spark.createDataFrame([t for t in TEXTS if t[0] != -8], "doc_id long, text string").repartition(2)
    ws = Workspace(spark, "m")
    ws.save(media.write_archives(docs, ws.path("a")), "manifest")
    rows = {(r.archive, r.offset): r for r in media.features(media.load(spark, ws.path("a"), ws.path("manifest"))).collect()}
    seen, folder = 0, ws.path("a").removeprefix("file://")
    for name in {a for a, _ in rows}:
        with zipfile.ZipFile(f"{folder}/{name}") as z:
            assert z.testzip() is None
            for info in z.infolist():
                row, image = rows[(name, info.header_offset)], z.read(info)
                width, height, samples = plain_png(image)
                text = (dict(TEXTS)[row.doc_id] or "").encode()
                assert (width, width * height) == (192, len(samples)) and samples == bytes(row.payload) == text.ljust(len(samples)) and bytes(row.media) == image
                mean, var, bits = plain_feature(samples)
                got = dict(x.split("=") for x in row.feature.split(";"))
                assert abs(int(got["mean"]) - mean) <= 1 and abs(int(got["var"]) - var) <= 1 and got["dhash"] == bits and row.error is None
                seen += 1
    assert seen == len(TEXTS) - 1
