"""Members of archives: found in one step, unpacked in another, so that the members of one archive go to many tasks.

The first step reads the index of a zip, or the headers of a tar, and gives the
bytes of each Python source as they are stored.  The second one deciphers and
inflates them.  No member is unpacked beyond ``MEMBER_BYTES``, and nothing is
extracted to disk.
"""

from __future__ import annotations

import hashlib
import hmac
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from larkspur.functions import catalogue as C
from larkspur.functions.aes import counter_mode

#: Most bytes of one source, unpacked; a larger one is a row with an error.
MEMBER_BYTES = 50 << 20
_AES, _AES_FIELD, _LOCAL, _LOCAL_SIZE, _CODE_SIZE = 99, 0x9901, b"PK\x03\x04", 30, 10


@dataclass
class Stored:
    """A source as it is stored: ``method`` is null for plain bytes, else the zip's; ``key_bytes`` is 0 without AES, ``crc`` null where there is none."""

    name: str
    data: bytes | None
    error: str | None = None
    method: int | None = None
    flags: int = 0
    crc: int | None = 0
    time: int = 0
    key_bytes: int = 0


class Unreadable(ValueError):
    pass


class TooMany(ValueError):
    """An archive with more entries than are read."""


def _is_source(name: str) -> bool:
    return name.lower().endswith(".py")


def zip_members(data: bytes) -> Iterator[Stored]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        entries = archive.infolist()
    if len(entries) > C.MAX_ARCHIVE_ENTRIES:
        raise TooMany(f"more than {C.MAX_ARCHIVE_ENTRIES} entries")
    for info in entries:
        if info.is_dir() or not _is_source(info.filename):
            continue
        head = data[info.header_offset : info.header_offset + _LOCAL_SIZE]
        if len(head) < _LOCAL_SIZE or head[:4] != _LOCAL:
            yield Stored(info.filename, None, "Unreadable: no header where the index says")
            continue
        at = info.header_offset + _LOCAL_SIZE + sum(struct.unpack("<HH", head[26:30]))
        stored = data[at : at + info.compress_size]
        if len(stored) < info.compress_size:
            yield Stored(info.filename, None, "Unreadable: the archive ends within it")
            continue
        member = Stored(info.filename, stored, None, info.compress_type, info.flag_bits, info.CRC, info._raw_time)
        if info.compress_type == _AES:
            kind = _aes_kind(info.extra)
            if kind is None:
                member.data, member.error = None, "Unreadable: no AES strength"
            else:
                version, member.key_bytes, member.method = kind
                member.crc = None if version == 2 else member.crc  # the second version has no checksum beside its code
        yield member


def _aes_kind(extra: bytes) -> tuple[int, int, int] | None:
    """Version, bytes of the key and method within, from the extra field of an entry."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack("<HH", extra[at : at + 4])
        if tag == _AES_FIELD and size >= 7:
            version, _, strength, method = struct.unpack("<H2sBH", extra[at + 4 : at + 11])
            return (version, 8 + 8 * strength, method) if strength in (1, 2, 3) else None
        at += 4 + size
    return None


def _each_entry(data: bytes) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz", ignore_zeros=True) as archive:
        while (member := archive.next()) is not None:
            yield archive, member
            archive.members = []  # entries that were seen are not needed again


_BROKEN = (tarfile.TarError, OSError, EOFError, zlib.error)


def tar_members(data: bytes) -> Iterator[Stored]:
    """All sources, or an exception before the first of them: an archive with too many entries gives none.

    So it is gone through twice, once to count; one member is held at a time.
    """
    n, broken = 0, None
    try:
        for _ in _each_entry(data):
            n += 1
            if n > C.MAX_ARCHIVE_ENTRIES:
                raise TooMany(f"more than {C.MAX_ARCHIVE_ENTRIES} entries")
    except _BROKEN as error:
        if not n:
            raise
        broken = f"{type(error).__name__}: {error}"  # what comes after cannot be found
    try:
        for archive, member in _each_entry(data):
            if not member.isfile() or not _is_source(member.name):
                continue
            try:
                content = archive.extractfile(member).read(MEMBER_BYTES + 1) if member.size <= MEMBER_BYTES else None
            except Exception as error:
                yield Stored(member.name, None, f"{type(error).__name__}: {error}")
                continue
            if content is None or len(content) > MEMBER_BYTES:
                yield Stored(member.name, None, f"Unreadable: more than {MEMBER_BYTES} bytes")
            else:
                yield Stored(member.name, content)
    except _BROKEN:
        pass
    if broken:
        yield Stored("", None, broken)


def _deciphered(member: Stored, password: bytes) -> bytes:
    salt_bytes = member.key_bytes // 2
    salt, check, body = member.data[:salt_bytes], member.data[salt_bytes : salt_bytes + 2], member.data[salt_bytes + 2 : -_CODE_SIZE]
    if len(member.data) < salt_bytes + 2 + _CODE_SIZE:
        raise Unreadable("too short for AES")
    keys = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * member.key_bytes + 2)
    if keys[-2:] != check:
        raise Unreadable("wrong password")
    code = hmac.new(keys[member.key_bytes : 2 * member.key_bytes], body, "sha1").digest()[:_CODE_SIZE]
    if not hmac.compare_digest(code, member.data[-_CODE_SIZE:]):
        raise Unreadable("the authentication code does not fit")
    return counter_mode(keys[: member.key_bytes], body)


def unpacked(member: Stored, password: bytes = C.ARCHIVE_PASSWORD, most: int = MEMBER_BYTES) -> bytes:
    """The bytes of a source, at most ``most`` of them; raises where they cannot be had."""
    if member.method is None:
        return member.data
    info = zipfile.ZipInfo(member.name)
    data, info.flag_bits = member.data, member.flags
    if member.key_bytes:
        data, info.flag_bits = _deciphered(member, password), member.flags & ~0x1
    info.compress_type, info.compress_size, info._raw_time = member.method, len(data), member.time
    info.file_size = 1 << 62  # what the index says of the size is not trusted
    if member.crc is not None:
        info.CRC = member.crc
    # bz2 and lzma inflate all they are given, so they are given little
    step, out = 1 << 16 if member.method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) else 1 << 10, io.BytesIO()
    with zipfile.ZipExtFile(io.BytesIO(data), "r", info, password if info.flag_bits & 0x1 else None) as stream:
        while part := stream.read(step):
            out.write(part)
            if out.tell() > most:
                raise Unreadable(f"more than {most} bytes")
    return out.getvalue()
