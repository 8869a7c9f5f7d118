"""Codecs of formats 2.0 and 2.9: a published packed text, round trips, solid chains, audio, refusals."""

import hashlib
import random

import pytest

from stowage.functions import lzold as Z

# Two repeated lines as packed by each format's own packer
PACKED_29 = bytes.fromhex("09101093e4ce7fa2ba8046168263e99a19e410e0413d16fc4dfa6ff25cae3286c9959df104a4e8928f12d7e7bacb26f197ac7c5ffda0001f7750")
PACKED_20 = bytes.fromhex("09140c940000000000cef81fc1e605fc39c35065084194c41df3cd0d8e20f59d8e761dc519de165b52b88e75cdaf1ffc9ef70001be90")


def test_packed_text():
    text = Z.Decoder(Z.V29).decode(PACKED_29, 2400)
    assert hashlib.sha256(text).hexdigest() == "2397d3a533cf0ff3bacf43ada6bf304d7d0711f60bfea36bfa9b9e9fc6d937f3"
    assert Z.Decoder(Z.V20).decode(PACKED_20, 2300) == b"Hello text not audio.\r\n" * 100


@pytest.mark.parametrize("layout", [Z.V20, Z.V29])
def test_round_trips(layout):
    r = random.Random(2)
    for k in range(25):
        words = [r.randbytes(r.randrange(1, 9)) for _ in range(20)]
        data = b"".join(r.choice(words) for _ in range(r.randrange(300))) + b"ab" * r.randrange(400) * (k % 3)
        assert Z.Decoder(layout).decode(Z.encode(data, layout), len(data)) == data
    far = r.randbytes(70000) + b"0123456789" + r.randbytes(9000)
    data = far + far[:40000]
    assert Z.Decoder(layout).decode(Z.encode(data, layout), len(data)) == data
    chain = Z.Decoder(layout)
    for text in (b"one member " * 30, b"", b"another member " * 20):
        assert chain.decode(Z.encode(text, layout), len(text)) == text
    with pytest.raises(ValueError):
        Z.Decoder(layout).decode(Z.encode(b"short", layout), 5000)


def test_audio():
    r = random.Random(3)
    for channels in (1, 2, 4):
        wave, v = bytearray(), 0
        for _ in range(3000):
            v = max(0, min(255, v + r.randrange(-6, 7)))
            wave.append(v)
        packed = Z.encode_audio(bytes(wave), channels)
        assert Z.Decoder(Z.V20).decode(packed, len(wave)) == wave
        assert Z.audio_filter(Z.audio_filter(bytes(wave), channels, False), channels) == wave


def test_refusals():
    with pytest.raises(ValueError):
        Z.Decoder(Z.V29).decode(b"\x80" + bytes(20), 10)  # a text-model block
    with pytest.raises(ValueError):
        Z.Decoder(Z.V20).decode(bytes(3), 10)
