"""Bytes decoded by the name of a codec, as the audit reads payloads.

Names are those of the standard codecs in any spelling.  Bytes that do not fit
become replacement characters; the Latin-1 family is read as browsers read it,
as Windows-1252.  Names of no text codec give null.
"""

from __future__ import annotations

import codecs
import re

# Codecs read as Windows-1252, and codecs that are not read.
AS_WINDOWS_1252 = ["ascii", "iso8859-1", "latin-1", "cp1252"]
NOT_READ = ["cp037", "utf-32", "utf-32-be", "utf-32-le", "utf-7", "idna", "punycode", "raw-unicode-escape", "unicode-escape", "mbcs", "oem", "undefined"]


def codec_name(name: str | None) -> str | None:
    """The codec's own name; null for a name that is no text codec."""
    plain = re.sub(r"[^a-z0-9]+", "_", (name or "").strip().lower()).strip("_")
    try:
        info = codecs.lookup(plain)
    except (LookupError, ValueError):
        return None
    return info.name if getattr(info, "_is_text_encoding", True) else None


def _windows_1252(data: bytes) -> str:
    """Windows-1252; its five free places are control characters."""
    return "".join(c if c != "�" else chr(b) for b, c in zip(data, data.decode("cp1252", "replace")))


def decode_bytes(data: bytes | None, name: str | None) -> str | None:
    """The text of bytes in the codec of that name; null for null bytes or a name that is not read."""
    codec = codec_name(name)
    if data is None or codec is None or codec in NOT_READ:
        return None
    if codec in AS_WINDOWS_1252:
        return _windows_1252(data)
    return data.decode(codec, "replace")
