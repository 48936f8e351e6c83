from __future__ import annotations

import hashlib
import io
import struct
from pathlib import Path

import zstandard

from pressline.llm import warc

SCHEMA = "page_id long, url string, html string, payload_key string, response_id int, n int"
LONG, OTHER = "<p>ä</p>" * 300, "x" * 999


def pages(spark):
    table = [(1, "http://a/", LONG), (5, "http://b/\r\nX: y", LONG), (3, None, LONG), (2, "http://c/", OTHER), (9, "http://d/", OTHER), (4, "http://e/", None),
             (6, "http://f/", ""), (5, "http://g/", LONG), (None, "http://h/", LONG), (7, "http://i/", "\r\n\r\nWARC/1.1\r\n" + "z" * 5000), (8, "http://j/", "é" * 200_000)]
    return spark.createDataFrame([(*t, "k", 1, 1) for t in table], SCHEMA)


def test_round_trip(spark, tmp_path):
    frame = pages(spark).coalesce(2)
    folder = f"file://{tmp_path}/w"
    written = warc.write(frame, folder)
    assert written.agg({"n_records": "sum"}).first()[0] == frame.count()
    got = warc.read(written, folder).collect()
    assert len(got) == frame.count()
    want = {(r["page_id"], r["url"]): r["html"] or "" for r in frame.collect()}
    revisits = set()
    for r in got:
        html = next(h for (i, u), h in want.items() if i == r["page_id"] and " ".join((u or "").split()) == r["url"])
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        if r["record_type"] == "revisit":
            revisits.add((r["page_id"], r["refers_to"]))
            assert r["payload"] is None
        else:
            assert r["payload"] == html and r["refers_to"] is None
    assert revisits == {(1, 5), (3, 5), (None, 5)}
    assert not [p for p in Path(tmp_path, "w").iterdir() if p.name.startswith("_")]


def test_an_archive_is_a_dictionary_and_one_frame_per_record(spark, tmp_path):
    folder = f"{tmp_path}/w"
    path = warc.write(pages(spark).coalesce(1), folder).first()["path"]
    data = Path(path).read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest, frames = data[8 + size :], []
    while rest:
        one = reader.decompressobj()
        frames.append(one.decompress(rest))
        rest = one.unused_data
    assert len(frames) == pages(spark).count() and all(f.startswith(b"WARC/1.1\r\n") and f.endswith(b"\r\n\r\n") for f in frames)


def test_small_archives_roll_over(spark, tmp_path, monkeypatch):
    records = [warc.Record(i, f"http://x/{i}", 3000, "", bytes([i % 251]) * 3000, None, False) for i in range(50)]
    stream = io.BytesIO()
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 20_000)
    writer = warc.ArchiveWriter(stream, "2025-01-01T00:00:00Z")
    for r in records:
        writer.add(warc.Record(r.page_id, r.url, 3000, hashlib.sha1(r.payload).hexdigest(), r.payload, None, False))
    writer.close()
    stream.seek(0)
    assert [(r.page_id, r.payload) for r in warc.read_archive(stream)] == [(r.page_id, r.payload) for r in records]
    many = spark.createDataFrame([(i, "u", str(i) * 4000) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 2 << 20)
    written = warc.write(many, f"{tmp_path}/r", archive_bytes=1)
    assert warc.read(written, f"{tmp_path}/r").count() == 20


def test_dictionary_of_many_records_is_trained():
    records = [f"<html><head><title>{i}</title></head><body><p>text {i * 7919 % 1000} of page {i}</p></body></html>".encode() * 3 for i in range(2000)]
    made = warc.dictionary(records)
    assert made[:4] == struct.pack("<I", 0xEC30A437)
    with_it = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(made)).compress(records[7])
    assert len(with_it) < len(zstandard.ZstdCompressor().compress(records[7]))


def test_empty_table(spark, tmp_path):
    written = warc.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e")
    assert written.count() == 0 and warc.read(written, f"{tmp_path}/e").collect() == []
