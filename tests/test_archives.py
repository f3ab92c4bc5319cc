"""Archives by member, their limits and ciphers, and the order of a scan."""

import hashlib
import hmac
import io
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.functions import aes
from larkspur.functions import catalogue as C
from larkspur.operators.order import with_sequence
from larkspur.sources import archives, scan

#: The examples of the standard, one key length each.
PLAIN = "00112233445566778899aabbccddeeff"
EXAMPLES = {
    "000102030405060708090a0b0c0d0e0f": "69c4e0d86a7b0430d8cdb78070b4c55a",
    "000102030405060708090a0b0c0d0e0f1011121314151617": "dda97ca4864cdfe06eaf70a0ec0d7191",
    "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f": "8ea2b7ca516745bfeafc49904b496089",
}


@pytest.mark.parametrize("key", EXAMPLES)
def test_cipher(key):
    import numpy as np

    block = np.frombuffer(bytes.fromhex(PLAIN), np.uint8).reshape(1, 16)
    assert aes.encrypt_blocks(aes._round_keys(bytes.fromhex(key)), block).tobytes().hex() == EXAMPLES[key]


def test_counter_mode_over_steps(monkeypatch):
    data = bytes(range(256)) * 3 + b"x"
    whole = aes.counter_mode(b"k" * 16, data)
    monkeypatch.setattr(aes, "STEP", 2)
    assert aes.counter_mode(b"k" * 16, data) == whole and aes.counter_mode(b"k" * 16, whole) == data
    assert aes.counter_mode(b"k" * 16, b"") == b""


def aes_zip(content, strength, version=2, password=C.ARCHIVE_PASSWORD, method=8, spoil=False):
    """A zip of one enciphered source, written by hand."""
    n = 8 + 8 * strength
    salt = bytes(range(n // 2))
    keys = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * n + 2)
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = packer.compress(content) + packer.flush() if method == 8 else content
    body = aes.counter_mode(keys[:n], packed)
    code = hmac.new(keys[n : 2 * n], body, "sha1").digest()[:10]
    data = salt + keys[-2:] + (bytes([body[0] ^ 1]) + body[1:] if spoil else body) + code
    extra = struct.pack("<HHH2sBH", 0x9901, 7, version, b"AE", strength, method)
    common = struct.pack("<HHHHHIIIHH", 51, 0x1, 99, 0, 0, zlib.crc32(content) if version == 1 else 0, len(data), len(content), 4, len(extra))
    local = b"PK\x03\x04" + common + b"a.py" + extra
    central = b"PK\x01\x02" + struct.pack("<H", 51) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0) + b"a.py" + extra
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local) + len(data), 0)
    return local + data + central + end


@pytest.mark.parametrize("strength", [1, 2, 3])
@pytest.mark.parametrize("version, method", [(1, 8), (2, 8), (2, 0)])
def test_enciphered_members(strength, version, method):
    content = b"import os\n" * 500
    assert list(scan.members("p.zip", aes_zip(content, strength, version, method=method))) == [("p.zip", "a.py", content.decode(), None)]


def test_enciphered_members_that_cannot_be_read():
    error = lambda data: list(scan.members("p.zip", data))[0][3]
    assert error(aes_zip(b"x = 1\n", 3, password=b"other")) == "Unreadable: wrong password"
    assert error(aes_zip(b"x = 1\n", 3, spoil=True)) == "Unreadable: the authentication code does not fit"
    assert error(aes_zip(b"x = 1\n", 4)) == "Unreadable: no AES strength"
    assert error(aes_zip(b"x = 1\n", 3)[:-60] + aes_zip(b"x = 1\n", 3)[-22:]) is not None


def packed(contents, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in contents:
            z.writestr(name, content)
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_members_inflate_up_to_a_size(monkeypatch, method):
    data = packed([("small.py", b"x = 1\n" * 100), ("bomb.py", b"\n" * 1_000_000), ("after.py", b"y = 2\n"), ("no source", b"")], method)
    monkeypatch.setattr(archives, "MEMBER_BYTES", 100_000)
    monkeypatch.setattr(archives.unpacked, "__defaults__", (C.ARCHIVE_PASSWORD, 100_000))
    got = list(scan.members("p.zip", data))
    assert [(n, e) for _, n, _, e in got] == [("small.py", None), ("bomb.py", "Unreadable: more than 100000 bytes"), ("after.py", None)]
    assert got[0][2] == "x = 1\n" * 100


def test_tar_members_are_bounded(monkeypatch):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, content in (("a.py", b"x = 1\n"), ("bomb.py", b"\n" * 300_000), ("b.py", b"y = 2\n")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    monkeypatch.setattr(archives, "MEMBER_BYTES", 100_000)
    assert [(n, e) for _, n, _, e in scan.members("p.tar.gz", out.getvalue())] == [("a.py", None), ("bomb.py", "Unreadable: more than 100000 bytes"), ("b.py", None)]


def test_wrong_checksums_and_cut_archives():
    data = packed([("a.py", b"value = 12345\n")], zipfile.ZIP_STORED)
    assert "BadZipFile" in list(scan.members("p.zip", data.replace(b"12345", b"54321")))[0][3]
    assert list(scan.members("p.zip", data[:40]))[0][2] is None


def test_one_archive_is_unpacked_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "PART_BYTES", 2000)
    names = [f"d/{i:05}.py" for i in range(3000)]
    (tmp_path / "big.zip").write_bytes(packed([(n, f"# {n}\n") for n in names]))
    rows = scan.scan(spark, str(tmp_path))
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) > 4 and max(sizes) < 1500
    got = scan.in_walk_order(rows).orderBy("seq").collect()
    assert [r.file_path for r in got] == names and [r.seq for r in got] == list(range(3000))
    assert all(r.content == f"# {r.file_path}\n" for r in got)


def test_walk_order(spark, tmp_path):
    for name in ("b/x.py", "b.py", "b-c/y.py", "a.zip", "c.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(packed([("z.py", b""), ("a.py", b"")]) if name.endswith("zip") else b"x = 1\n")
    got = scan.in_walk_order(scan.scan(spark, str(tmp_path))).orderBy("seq").collect()
    assert [r.file_path.removeprefix(f"file:{tmp_path}/") for r in got] == ["z.py", "a.py", "b/x.py", "b-c/y.py", "b.py", "c.py"]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_sequence(spark, n):
    rows = spark.range(n).select((F.col("id") * 7919 % 1000 % 10).alias("k"), "id").repartition(7)
    got = with_sequence(rows, [F.desc("k"), F.col("id")], first=5).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(5, 5 + n))
    assert [(r.k, r.id) for r in got] == sorted(((i * 7919 % 1000 % 10, i) for i in range(n)), key=lambda x: (-x[0], x[1]))


def test_sequence_of_equal_keys_fills_several_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        rows = with_sequence(spark.range(10_000).select(F.lit(1).alias("k")), [F.col("k")])
        assert sorted(r.seq for r in rows.collect()) == list(range(10_000))
        assert rows.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset(name)
