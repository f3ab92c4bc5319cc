"""Bytes by the name of their codec."""

import pytest

from larkspur.functions.encodings import decode_bytes
from larkspur.operators.analysis import facts


@pytest.mark.parametrize(
    ("data", "name", "text"),
    [
        (b"abc", "utf-8", "abc"),
        (b"abc", "UTF8", "abc"),
        (b"a\xff", "utf_8", "a�"),
        (b"\x80\x81", "latin1", "€\x81"),
        (b"\x80", "ISO-8859-1", "€"),
        ("ж".encode("koi8-r"), "KOI8-R", "ж"),
        ("abc".encode("cp1026"), "cp1026", "abc"),
        ("abc".encode("utf-16-le"), "utf-16le", "abc"),
        (b"abc", "rot13", None),
        (b"abc", "no such codec", None),
        (b"abc", "a\0b", None),
        (b"abc", "cp037", None),
        (b"abcd", "utf-32", None),
        (b"abc", None, None),
        (None, "utf-8", None),
    ],
)
def test_decode_bytes(data, name, text):
    assert decode_bytes(data, name) == text


def test_payloads_are_decoded_by_name():
    payload = "import os\nos.system('ls')\n".encode("cp1026")
    assert ("exec", "os.system") in [(f["kind"], f["name"]) for f in facts(f"exec({payload!r}.decode('cp1026'))\n", "a.py")]
