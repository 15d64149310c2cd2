"""Layers of the secret scan that are large, damaged or cut."""

import base64
import gzip
import zlib

import numpy as np
import pytest

from tilewright.llm import secrets

SECRET = b"password=hunter2secret"


def b64(data):
    return base64.b64encode(data).decode()


def raw_deflate(data):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def assigned(stretch):
    text = f"x {stretch} y"
    return ("assign", 2, 2 + len(stretch)) in secrets.find_all(text)[1]


@pytest.mark.parametrize(
    "data",
    [
        raw_deflate(b"lorem ipsum " * 600_000 + SECRET),  # more than a piece
        raw_deflate(b"lorem ipsum dolor " + SECRET) + b"Z",
        raw_deflate(raw_deflate(b"lorem ipsum dolor " * 3 + SECRET)),
        raw_deflate(gzip.compress(b"lorem ipsum dolor " + SECRET)),
        b"caf\xe9 " + SECRET,
        b"\xff\xfe\x00 " + SECRET + b" \xc3\x28",
        gzip.compress(b"caf\xe9 " + SECRET + b"\xe9"),
        gzip.compress(b"lorem ipsum, " * 40 + SECRET + b" dolor, " * 4000)[:-40],
    ],
)
def test_what_isnt_whole_or_isnt_text_is_scanned(data):
    assert assigned(b64(data))


@pytest.mark.parametrize("before", [0, 4_000_000, 4_100_000, 4_194_200])
def test_an_encoded_stretch_across_a_cut_is_found(before):
    inner = b64(b"some words, " + np.random.default_rng(1).bytes(70_000).hex().encode() + b" " + SECRET + b" after")
    assert assigned(b64(gzip.compress(b"lorem, ipsum. " * (before // 14) + b" " + inner.encode() + b" tail", 1)))


@pytest.mark.parametrize("before", [0, 300_000])
def test_a_stretch_larger_than_is_held_is_decoded_as_it_comes(monkeypatch, before):
    monkeypatch.setattr(secrets, "PIECE", 1 << 17)
    monkeypatch.setattr(secrets, "STRETCH", 1 << 19)
    for inner in (b"words. " * 120_000 + SECRET, gzip.compress(np.random.default_rng(2).bytes(600_000) + SECRET, 0)):
        whole = b64(inner)
        lines = "\n".join(whole[i : i + 76] for i in range(0, len(whole), 76))
        for stretch in (whole, lines):
            assert assigned(b64(gzip.compress(b"lorem, ipsum. " * (before // 14) + b" " + stretch.encode() + b" tail, and more. " * 9, 1)))


def test_any_depth_and_data_that_inflates_to_itself(monkeypatch):
    data = SECRET
    for i in range(1500):
        data = gzip.compress(data, 1) if i % 2 else zlib.compress(data)
    assert assigned(b64(data))
    opened = []
    monkeypatch.setattr(secrets._Level, "inflated", lambda self, blocks: opened.append(1) or iter(blocks if self.kind else ()))
    assert list(secrets._texts(gzip.compress(b"any data")))  # each level gives what it got
    assert len(opened) <= 4
