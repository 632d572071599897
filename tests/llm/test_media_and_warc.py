import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import media, warc


def png(rows, kinds, colour=0):
    """An encoder written the plain way, for all five filters."""
    step = media.SAMPLES[colour]
    before = [0] * len(rows[0])
    raw = b""
    for row, kind in zip(rows, kinds):
        out = []
        for x, v in enumerate(row):
            a = row[x - step] if x >= step else 0
            b, c = before[x], before[x - step] if x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        raw += bytes([kind, *out])
        before = row

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", len(rows[0]) // step, len(rows), 8, colour, 0, 0, 0)
    packed = zlib.compress(raw)
    return media.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"k\0v") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_all_filters_are_undone(colour):
    rng = random.Random(colour)
    rows = [[rng.randrange(256) for _ in range(12 * media.SAMPLES[colour])] for _ in range(40)]
    kinds = [rng.randrange(5) for _ in rows]
    assert media.decode_png(png(rows, kinds, colour)).tolist() == rows


def test_round_trip_and_checks():
    rng = np.random.default_rng(0)
    for data in (b"", b"x" * 64, b"y" * 65, rng.bytes(5000), bytes(range(256)) * 40):
        payload = media.padded(data)
        assert len(payload) % 64 == 0 and payload and payload[: len(data)] == data
        stored = media.encode_png(payload)
        assert media.decode_png(stored).tobytes() == payload
        for at in range(0, len(stored), max(1, len(stored) // 60)):
            broken = bytearray(stored)
            broken[at] ^= 1
            with pytest.raises(media.MediaError):
                media.decode_png(bytes(broken))
        for cut in (stored[:-1], stored + b"x", stored[:40], b""):
            with pytest.raises(media.MediaError):
                media.decode_png(cut)


def test_hash_is_of_the_low_cosines():
    image = np.random.default_rng(1).integers(0, 256, (37, 64), dtype=np.uint8)
    want = np.array([[sum(image[y, x] * np.cos(np.pi / 37 * (y + 0.5) * u) * np.cos(np.pi / 64 * (x + 0.5) * v) for y in range(37) for x in range(64)) for v in range(8)] for u in range(8)]).ravel()
    assert media.cosine_hash(image) == np.packbits(want > np.median(want[1:])).tobytes() == media.cosine_hash(image, block=7)


def test_media_documents(odd, none, odd_rows):
    got = media.media_features(media.to_media(odd), payload=True).collect()
    want = Counter()
    for i, t in odd_rows:
        p = media.padded((t or "").encode())
        want[(i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), p)] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], bytes(r["payload"])) for r in got) == want
    assert all(r["error"] is None and len(r["hash"]) == 8 for r in got)
    assert media.media_round_trip(none).count() == 0


def test_broken_media_are_told(spark):
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(media.encode_png(bytes(64))))], "k int, media binary")
    assert {r["k"]: r["error"] is None for r in media.media_features(df).collect()} == {1: False, 2: False, 3: True}


def archive(n=6, packed=True):
    parts = []
    for i in range(n):
        body = f"<p>{i} WARC/1.1 \x1f\x8b\x08</p>".encode() * (i + 1)
        r = warc.record({"WARC-Type": "response", "X-Page-Id": str(i), "WARC-Target-URI": f"http://x/{i}\r\ny%", "WARC-Payload-Digest": f"sha1:{warc._b32(body)}"}, body, len(body), True)
        if packed:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            r = z.compress(r) + z.flush()
        parts.append(r)
    return parts


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    parts = archive(packed=packed)
    whole = b"".join(parts)
    ids = lambda data: [f.fields["x-page-id"] for f in warc.salvage(data) if f.reason is None]
    gaps = lambda data: [(f.start, f.end) for f in warc.salvage(data) if f.reason]
    assert ids(whole) == list("012345") and gaps(whole) == []
    assert next(warc.salvage(whole)).fields["warc-target-uri"] == "http://x/0\r\ny%"
    at = len(parts[0]) + len(parts[1])
    broken = bytearray(whole)
    broken[at + len(parts[2]) - 20] ^= 0xFF  # in the block: headers have no checksum of their own
    assert ids(bytes(broken)) == list("01345") and gaps(bytes(broken)) == [(at, at + len(parts[2]))]
    junk = b"junk WARC/1. junk" + whole[:at] + b"\x1f\x8b\x08zzz" * 3 + whole[at:-3]
    assert ids(junk)[:5] == list("01234") and gaps(junk)[0] == (0, 17) and gaps(junk)[-1][1] == len(junk)
    spans = sorted([(f.start, f.end) for f in warc.salvage(junk)])
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(junk)


def test_records_in_one_member_and_empty_archives():
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = z.compress(b"".join(archive(3, packed=False))) + z.flush()
    assert [f.fields["x-page-id"] for f in warc.salvage(data)] == ["0", "1", "2"]
    assert list(warc.salvage(b"")) == [] and [f.reason is not None for f in warc.salvage(b"abc")] == [True]


PAGES = [(1, "u1", "<p>é</p>"), (2, "u2", "<p>é</p>"), (2, "u2", "<p>é</p>"), (3, None, None), (4, "u4", ""), (None, "u5", "<p>é</p>"), (6, "bad\r\nurl", "z" * 100_000)]


def test_archive_pages(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string")
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(PAGES)
    for body, largest, n in (("<p>é</p>", 2, 4), ("", 4, 2), ("z" * 100_000, 6, 1)):
        data = body.encode()
        own = [r for r in got if r["payload_digest"] == warc._b32(data)]
        assert len(own) == n and all(r["payload_bytes"] == len(data) for r in own)
        response = [r for r in own if r["record_type"] == "response"]
        assert [r["page_id"] for r in response] == [largest] and response[0]["refers_to"] is None
        assert all(r["refers_to"] == largest for r in own if r["record_type"] == "revisit")
    assert warc.archive_pages(pages.where("false")).count() == 0
    assert warc.archive_pages(pages, least=9).where("record_type = 'revisit'").count() == 3, "empty payloads are under the least size"


def test_warc_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(archive(3)) + b"tail")
    rows = warc.read_warc_files(spark, f"{tmp_path}/*.warc.gz", payload=True).collect()
    assert [r["page_id"] for r in rows if r["quarantined"] is None] == ["0", "1", "2"]
    assert [r["end"] - r["start"] for r in rows if r["quarantined"]] == [4]


def test_damage_in_own_archives_is_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "a" * 500 + str(i)) for i in range(5)], "page_id long, url string, html string")
    real = warc.write_archives
    data = F.concat(F.expr("substring(data, 1, 400)"), F.lit(b"x"), F.expr("substring(data, 402)"))
    assert warc.archive_pages(pages).count() == 5
    monkeypatch.setattr(warc, "write_archives", lambda *a: real(*a).select("archive", data.alias("data")))
    with pytest.raises(Exception, match="damaged archive"):
        warc.archive_pages(pages).collect()


def test_no_response_changes_with_the_way_files_are_split(spark, tmp_path):
    """The row keys of two scans agree however the scans are cut."""
    rows = [(i % 40 if i % 9 else None, f"u{i}", f"text {i % 25} " * 50) for i in range(600)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7).write.parquet(f"{tmp_path}/pages")
    found = []
    for size in ("2k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            pages = spark.read.parquet(f"{tmp_path}/pages")
            keys = {(r["url"], r["rid"]) for r in warc.with_row_key(pages.select("url")).collect()}
            assert len({k for _, k in keys}) == 600
            plan = warc.decided(pages)
            # the second scan of the join is made under another split than the first
            spark.conf.set("spark.sql.files.maxPartitionBytes", "3k" if size == "64m" else "64m")
            found.append((keys, sorted(map(str, plan.drop("_body").collect()))))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1]
    by_text = Counter(rows[int(u[1:])][2] for u in [r.split("_url='")[1].split("'")[0] for r in found[0][1] if "_again=False" in r])
    assert len(by_text) == 25 and set(by_text.values()) == {1}
