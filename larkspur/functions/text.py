"""Scalar functions on text, as Catalyst expressions; the entropy and the unescaping of a text are vectorised Python."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from larkspur.functions import catalogue as C


def ends_with_any(text: Column, endings: list[str]) -> Column:
    """False for null."""
    low = F.lower(text)
    out = F.lit(False)
    for e in endings:
        out |= low.endswith(e)
    return F.coalesce(out, F.lit(False))


def bare_url(url: Column) -> Column:
    """A url without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def normal_slashes(text: Column) -> Column:
    """Backslashes, escaped or not, as single slashes."""
    return F.regexp_replace(text, r"\\{1,2}", "/")


def preview(text: Column, most: int = 16) -> Column:
    """The first and the last characters of a longer text."""
    half = F.lit(most // 2)
    return F.when(F.length(text) > most, F.concat(F.left(text, half), F.lit("..."), F.right(text, half))).otherwise(text)


def is_base64(text: Column) -> Column:
    """Standard alphabet, whole groups of four with at most two marks of padding; false for empty text."""
    return (text != "") & (F.octet_length(text) % 4 == 0) & text.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z")


def base64_candidate(text: Column) -> Column:
    return is_base64(text) & (F.octet_length(text) >= C.BASE64_LEAST)


def long_base64(text: Column) -> Column:
    return is_base64(text) & (F.octet_length(text) >= C.BASE64_LONG)


def hex_escapes(text: Column) -> Column:
    """Nothing but hexadecimal escapes, one at least."""
    return text.rlike(r"\A(\\x[0-9a-fA-F]{2})+\z")


def long_hex(text: Column) -> Column:
    return hex_escapes(text) & (F.octet_length(text) >= C.HEX_LONG)


def hex_to_escaped(text: Column) -> Column:
    """Hexadecimal digits, white space aside, as escapes; null for any other text."""
    plain = F.lower(F.regexp_replace(text, r"[ \t\n\x0B\f\r]", ""))
    return F.when((F.length(plain) % 2 == 0) & plain.rlike(r"\A[0-9a-f]*\z"), F.regexp_replace(plain, "(..)", r"\\x$1"))


def bytes_to_escaped(data: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(data)), "(..)", r"\\x$1")


_ESCAPES = {"n": b"\n", "r": b"\r", "t": b"\t", "\\": b"\\", "'": b"'", '"': b'"'}


def _unescaped(text: str | None) -> bytes | None:
    out = bytearray()
    if text is None:
        return None
    for plain, escape in re.findall(r"([^\\]+)|\\(x[0-9a-fA-F]{2}|.|\Z)", text, re.S):
        if plain:
            out += plain.encode("utf-8", "surrogatepass")
        elif len(escape) == 3:
            out.append(int(escape[1:], 16))
        elif escape in _ESCAPES:
            out += _ESCAPES[escape]
        else:
            return None
    return bytes(out)


def unescaped(text: Column) -> Column:
    """The bytes of a text with escapes; null where an escape is not known."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_unescaped)

    return F.pandas_udf(run, BinaryType())(text)


def base64_decoded(text: Column, url_safe: bool = False) -> Column:
    """Bytes of strictly padded text, outer white space aside; null for any other."""
    plain = F.trim(text)
    plain = F.when(~plain.rlike(r"[+/]"), F.translate(plain, "-_", "+/")) if url_safe else plain
    return F.when(is_base64(plain), F.unbase64(plain)).when(plain == "", F.lit(b""))


def contains_url(text: Column) -> Column:
    return F.contains(text, F.lit("http://")) | F.contains(text, F.lit("https://"))


def is_ipv4(text: Column) -> Column:
    """Four groups of one to three digits up to 255, with any leading zeros."""
    return text.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z") & F.forall(F.split(text, r"\."), lambda x: x.cast("int") <= 255)


def suspicious_extension(text: Column) -> Column:
    return ends_with_any(text, C.LITERAL_EXTENSIONS)


def doc_like(text: Column) -> Column:
    """Whether a text reads like documentation; false for null."""
    out = F.lit(False)
    for mark in C.DOC_MARKS:
        out |= F.contains(F.lower(text), F.lit(mark))
    return F.coalesce(out, F.lit(False))


def has_extension(url: Column) -> Column:
    """Whether the last part of a path has a dot with a plain suffix."""
    return F.element_at(F.split(url, "/"), -1).rlike(r"\.[^/\\]*\z")


def python_command(text: Column) -> Column:
    """Whether a program's base name begins with ``python``."""
    return F.lower(F.regexp_extract(text, r"([^/\\]*)\z", 1)).startswith("python")


def dotted_name(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*\z")


def ratio(n: Column, d: Column) -> Column:
    """n / d, or 0."""
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return (F.lit(1) / (F.lit(1) + F.exp(-x.cast("float")))).cast("float")


def telegram_token(text: Column) -> Column:
    return text.rlike(r"^[0-9]{8,10}:[A-Za-z0-9_-]{35}$")


def dangerous_command(text: Column, program: bool = True) -> Column:
    """Whether a command line runs one of the dangerous commands; false for null.

    A command runs where the line begins, or after a character that begins a
    command and white space, and where its word ends.  A lone ``base64`` runs
    nothing; in other places than a program's (``program`` false) neither does
    any command alone.
    """
    out, alone = F.lit(False), F.trim(text)
    for command in C.DANGEROUS_COMMANDS:
        word = re.sub(r"([/.])", r"\\\1", command)
        runs = text.rlike(rf"(?:\A\s*|[|&;()<>`\n]\s*){word}(?=\s|[|&;()<>$`\n]|\z)")
        out |= runs & (alone != command) if command == "base64" or not program else runs
    return F.coalesce(out, F.lit(False))


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one does not count."""
    all_ = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(all_, -1) == "", F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_)


def _entropy(text: str | None) -> float | None:
    if text is None:
        return None
    if not text:
        return 0.0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(codes) if codes.max() < 4096 else np.unique(codes, return_counts=True)[1]
    p = n[n > 0] / len(codes)
    return float(-(p * np.log2(p)).sum()) + 0.0


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits, summed in the characters' order; 0 for empty text, null for null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_entropy)

    return F.pandas_udf(run, DoubleType())(text)
