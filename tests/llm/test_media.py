import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import flac
from textquarry.llm.media import feature_of, media_digests, padded, pcm_blocks, to_flac


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    assert flac.payloads(flac.streams([padded(data)])) == [padded(data)]


def test_many_frames_and_seek():
    data = padded(bytes(random.Random(1).randbytes(700_000)) + b"some text " * 90_000)
    stored = flac.streams([data])[0]
    assert flac.payloads([stored]) == [data]
    assert flac.seek(stored, 123_456, 2000) == data[123_456 : 125_456]
    assert flac.seek(stored, len(data) - 5, 50) == data[-5:] and flac.seek(stored, len(data), 5) == b""


def test_frames_are_found_without_seek_table():
    data = padded(b"abc def " * 40_000)
    stored = flac.streams([data])[0]
    s = flac.Stream(stored)
    s.points = None
    assert (s.starts() == flac.Stream(stored).starts()).all()


@pytest.mark.parametrize("where", [-10, -300, 30])
def test_damage_is_noticed(where):
    stored = bytearray(flac.streams([padded(b"words and more words " * 200)])[0])
    stored[where] ^= 0x10
    with pytest.raises(ValueError):
        flac.payloads([bytes(stored)])


def test_header_of_the_format():
    stored = flac.streams([padded(b"x")])[0]
    info = int.from_bytes(stored[18:26], "big")
    assert stored[:4] == b"fLaC" and info & (1 << 36) - 1 == 576 and (info >> 36 & 31) + 1 == 8 and (info >> 41 & 7) == 0


class Bits:
    """Bits of a byte string, read or written one after the other."""

    def __init__(self, data=b""):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self):
        n = self.bits.index("1", self.at) - self.at
        self.at += n + 1
        return n

    def put(self, v, n):
        self.bits += f"{v & ((1 << n) - 1):0{n}b}" if n else ""

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return c


def plain_decode(stored):
    """A decoder by the letter of the public format, bit by bit, for 8-bit mono; it shares nothing with the operator."""
    assert stored[:4] == b"fLaC"
    at, last, out = 4, False, b""
    while not last:
        last, size = bool(stored[at] & 128), int.from_bytes(stored[at + 1 : at + 4], "big")
        if stored[at] & 127 == 0:
            digest = stored[at + 22 : at + 38]
        at += 4 + size
    while at < len(stored):
        b = Bits(stored[at:])
        assert b.take(14) == 0x3FFE and b.take(1) == 0
        b.take(1)
        code, rate = b.take(4), b.take(4)
        assert b.take(4) == 0 and b.take(3) in (0, 1) and b.take(1) == 0
        first = b.take(8)
        for _ in range(f"{first:08b}".index("0") - 1 if first & 128 else 0):
            assert b.take(2) == 2
            b.take(6)
        n = 576 if code == 2 else b.take(8) + 1 if code == 6 else b.take(16) + 1 if code == 7 else 256 << (code - 8)
        b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        assert crc(stored[at : at + b.at // 8], 0x07, 8) == b.take(8)
        assert b.take(1) == 0
        kind = b.take(6)
        wasted = b.unary() + 1 if b.take(1) else 0
        bits = 8 - wasted
        if kind == 0:
            x = [b.signed(bits)] * n
        elif kind == 1:
            x = [b.signed(bits) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [b.signed(bits) for _ in range(order)]
            coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None, 0
            if kind >= 32:
                width = b.take(4) + 1
                shift = b.signed(5)
                coef = [b.signed(width) for _ in range(order)]
            wide, parts = b.take(2), 1 << b.take(4)
            for i in range(parts):
                k = b.take(4 + wide)
                escape = b.take(5) if k == (31 if wide else 15) else None
                for _ in range(n // parts - (order if i == 0 else 0)):
                    if escape is not None:
                        r = b.signed(escape)
                    else:
                        u = b.unary() << k | b.take(k)
                        r = u >> 1 ^ -(u & 1)
                    x.append(r + (sum(c * v for c, v in zip(coef, reversed(x))) >> shift))
        b.at += -b.at % 8
        assert crc(stored[at : at + b.at // 8], 0x8005, 16) == b.take(16)
        out += bytes((v << wasted) + 128 for v in x)
        at += b.at // 8
    assert hashlib.md5(bytes(v ^ 128 for v in out)).digest() == digest
    return out


@pytest.mark.parametrize("data", [b"", b"a", b"plain words and more words " * 90, bytes(range(256)) * 9, random.Random(2).randbytes(1500), b"\x00\xff" * 600, b"zzzz" * 400])
def test_streams_are_read_by_a_plain_decoder(data):
    assert plain_decode(flac.streams([padded(data)])[0]) == padded(data)


def test_a_stream_written_by_hand_is_read():
    """Three frames of 576 samples: constant, fixed prediction of order 1 with two Rice partitions, and escaped residuals."""
    ramp = [i % 7 - 3 for i in range(576)]
    frames, samples = b"", b""
    for number, kind in enumerate(("constant", "rice", "escape")):
        b = Bits()
        for v, n in ((0x3FFE, 14), (0, 2), (2, 4), (0, 4), (0, 4), (1, 3), (0, 1), (number, 8)):
            b.put(v, n)
        b.put(crc(b.bytes(), 0x07, 8), 8)
        if kind == "constant":
            b.put(0, 8)
            b.put(-5, 8)
            samples += bytes([123] * 576)
        else:
            b.put(9 << 1, 8)  # fixed, order 1
            b.put(ramp[0], 8)
            b.put(0, 2)
            parts = 2 if kind == "rice" else 1
            b.put(parts.bit_length() - 1, 4)
            diff = [y - x for x, y in zip(ramp, ramp[1:])]
            for i in range(parts):
                own = diff[: 287] if parts == 2 and i == 0 else diff[287:] if parts == 2 else diff
                if kind == "rice":
                    b.put(2 + i, 4)
                else:
                    b.put(15, 4)
                    b.put(4, 5)
                for r in own:
                    if kind == "rice":
                        u = r << 1 if r >= 0 else -2 * r - 1
                        b.put(1, (u >> (2 + i)) + 1)
                        b.put(u, 2 + i)
                    else:
                        b.put(r, 4)
            samples += bytes(v + 128 for v in ramp)
        body = b.bytes()
        frames += body + crc(body, 0x8005, 16).to_bytes(2, "big")
    info = Bits()
    for v, n in ((576, 16), (576, 16), (0, 24), (0, 24), (8000, 20), (0, 3), (7, 5), (len(samples), 36)):
        info.put(v, n)
    stored = b"fLaC" + bytes([128, 0, 0, 34]) + info.bytes() + hashlib.md5(bytes(v ^ 128 for v in samples)).digest() + frames
    assert plain_decode(stored) == samples and flac.payloads([stored]) == [samples]


def test_digests(frame, odd):
    got = media_digests(frame(odd, clash=True)).collect()
    assert len(got) == len(odd)
    want = sorted((str(r[0]), len((r[1] or "").encode()), hashlib.sha256(padded((r[1] or "").encode())).hexdigest(), zlib.crc32(padded((r[1] or "").encode())[-32:]), feature_of(padded((r[1] or "").encode()))) for r in odd)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) for r in got) == want
    assert media_digests(frame([])).count() == 0


def test_blocks(frame):
    rows = [(1, "hello " * 500, None, None, None), (2, None, None, None, None)]
    blocks = pcm_blocks(to_flac(frame(rows))).orderBy("doc_id", "block").collect()
    assert b"".join(r["pcm"] for r in blocks if r["doc_id"] == 1) == padded(b"hello " * 500)
    assert [r["sample_offset"] for r in blocks if r["doc_id"] == 1] == [576 * i for i in range(6)]
    assert len([r for r in blocks if r["doc_id"] == 2]) == 1
