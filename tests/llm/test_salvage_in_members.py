import random
import zlib

from assayer.llm import warc


def packed(data, level=6):
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(n=5):
    rng = random.Random(1)
    bodies = [bytes(rng.randrange(33, 127) for _ in range(4000)) for _ in range(n)]
    return [warc.record({"WARC-Type": "response", "X-Page-Id": str(i)}, b, len(b), True) for i, b in enumerate(bodies)]


def ids(data):
    return [f.fields["x-page-id"] for f in warc.salvage(data) if f.reason is None]


def test_one_bad_record_in_a_member_of_five():
    parts = records()
    broken = bytearray(parts[2])
    broken[-300] ^= 0xFF
    data = packed(b"".join([*parts[:2], bytes(broken), *parts[3:]]))
    assert ids(data) == ["0", "1", "3", "4"] and sum(f.reason is not None for f in warc.salvage(data)) == 1


def test_a_member_with_a_bad_checksum_or_a_cut_end():
    for level in (0, 6):
        whole = packed(b"".join(records()), level)
        wrong = whole[:-8] + bytes([whole[-8] ^ 0xFF]) + whole[-7:]
        assert ids(wrong + whole) == list("01234") * 2
        assert [f.end for f in warc.salvage(wrong) if f.reason] == [len(wrong)]
        assert ids(whole[: len(whole) * 7 // 10]) == ["0", "1", "2"]


def test_a_header_longer_than_64_kib():
    one = warc.record({"WARC-Type": "response", "X-Page-Id": "0", "WARC-Target-URI": "http://x/" + "u" * 100_000}, b"x", 1, True)
    assert ids(packed(one)) == ids(one) == ["0"]
