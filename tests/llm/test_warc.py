import base64
import hashlib
import os
import struct

import pytest
import zstandard

from stationspark.llm import warc

ROWS = [(1, "http://a b\r\nX: y", "<p>one</p>", "x"), (2, None, "<p>one</p>", "x"), (9, "u", "<p>one</p>", "x"), (9, "v", "<p>one</p>", "x"), (3, "u", None, "x"), (4, "u", "", "x"), (2**62 + 1, "é", "é\r\n\r\n😀" * 1000, "x"), (None, "u", "alone", "x"), (None, "u", "both", "x"), (None, "u", "both", "x"), (5, "u", "<p>one</p>\r\n", "x"), (-3, "u", "long " * 400_000, "x")]


def plain(rows):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    top, out = {}, []
    for k, (page, _, html, _) in enumerate(rows):
        data = (html or "").encode()
        if data not in top or (page is not None, page or 0) >= (top[data][0] is not None, top[data][0] or 0):
            top[data] = (page, k)
    for k, (page, _, html, _) in enumerate(rows):
        data = (html or "").encode()
        revisit = top[data][1] != k
        out.append((page, len(data), digest(data), "revisit" if revisit else "response", top[data][0] if revisit else None))
    return sorted(map(str, out))


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string").coalesce(1)
    assert sorted(map(str, map(tuple, warc.archive_digests(pages).collect()))) == plain(ROWS)
    warc.write_archives(pages.repartition(3), str(tmp_path / "a"))
    back = warc.read_archives(spark, str(tmp_path / "a"), payload=True).collect()
    assert {r.payload.decode() for r in back if r.record_type == "response"} == {r[2] or "" for r in ROWS}
    assert {r.url for r in back} >= {"http://a%20b%0D%0AX:%20y", None, "é"}
    none = pages.limit(0)
    assert warc.archive_digests(none).count() == 0


def test_pages(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    warc.write_archives(pages.repartition(2), str(tmp_path / "a"))
    files = [str(tmp_path / "a" / f) for f in os.listdir(tmp_path / "a") if f.startswith("part")]
    held = [open(f, "rb").read() for f in files]
    for data in held:  # each archive begins with its dictionary and is a plain stream of frames
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_FRAME and data[8:12] == struct.pack("<I", warc.DICTIONARY)
        own = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        whole = zstandard.ZstdDecompressor(dict_data=own).stream_reader(data, read_across_frames=True).read()
        assert whole == b"".join(warc.frames(data)) and whole.count(b"WARC/1.1\r\n") >= 10
        with pytest.raises(warc.BadArchive):
            list(warc.frames(data[:-20]))
        with pytest.raises(warc.BadArchive):
            list(warc.frames(b"junk" + data))
        with pytest.raises(warc.BadArchive):  # the dictionary is needed
            list(warc.frames(data[8 + size :]))
    assert len(held) == 2 and warc.read_archives(spark, str(tmp_path / "a")).count() == pages.count()


def test_compressed_dictionary():
    samples = [f"<html><p>{k} some page of words {k * 7}</p></html>".encode() * 9 for k in range(200)]
    own = zstandard.train_dictionary(4096, samples)
    frame = zstandard.ZstdCompressor(dict_data=own).compress(samples[3])
    packed = zstandard.ZstdCompressor().compress(own.as_bytes())
    assert list(warc.frames(warc.dictionary_frame(packed) + frame)) == [samples[3]]
    with pytest.raises(warc.BadArchive):
        list(warc.frames(warc.dictionary_frame(b"no dictionary") + frame))


def test_bad_records_are_errors():
    good = warc.record(1, "u", b"abc", warc.base32_sha1(b"abc"), None, False)
    assert warc.read_record(good)["payload"] == b"abc"
    again = warc.record(1, "u", b"abc", warc.base32_sha1(b"abc"), 7, True)
    assert (warc.read_record(again)["refers_to"], warc.read_record(again)["payload_bytes"]) == (7, 3)
    for bad in [
        good[:-1], good + b"x", good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC/1.1", b"WORC/1.1"),
        good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"\r\nWARC-Date", b"\r\nWARC-Type: response\r\nWARC-Date"),
        good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"x-page:1", b"y-page:1"), again.replace(b"WARC-Refers-To", b"WARC-Refers"), b"",
    ]:
        with pytest.raises(warc.BadArchive):
            warc.read_record(bad)
