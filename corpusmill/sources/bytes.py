"""Bytes to text: binary tests and encodings."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions.udf import vectorized

#: First bytes of formats that aren't text.
MAGIC = tuple(
    bytes.fromhex(h)
    for h in (
        "7f454c46 4d5a 89504e47 ffd8ff 25504446 504b0304 1f8b 425a cafebabe cffaedfe feedfacf feedface "
        "52494646 47494638 00000100 53514c69746520666f726d61742033 fd377a585a00 526172211a07 0061736d"
    ).split()
)
_PRINTABLE = bytes([9, 10, 13, *range(32, 127), *range(128, 256)])
_CONTROL = bytes([*range(1, 9), *range(14, 32)])
_HIGH = bytes(range(128, 256))
SNIFF, LONG_LINE = 8192, 1000


def is_binary(head: bytes) -> bool:
    """Whether bytes are no text: a known format, over a twentieth NUL, or under 85 % printable."""
    if not head:
        return False
    n = len(head)
    return head.startswith(MAGIC) or head.count(0) > n // 20 or n - len(head.translate(None, _PRINTABLE)) < n * 85 // 100


def sniffs_as_text(content: bytes) -> bool:
    """Whether a file's first bytes look like text."""
    head = content[:SNIFF]
    if not head:
        return True
    n = len(head)
    control, high = n - len(head.translate(None, _CONTROL)), n - len(head.translate(None, _HIGH))
    return not (is_binary(head) or control * 100 > n * 10 or high * 100 > n * 40 or max(map(len, head.split(b"\n"))) > LONG_LINE)


def decode(content: bytes) -> tuple[str, str | None]:
    """(text, note): by byte order mark, as UTF-8, else as windows-1252, and what that can't read as replacement characters."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), f"decoded from {name} with a byte order mark"
    try:
        return content.decode(), None
    except UnicodeDecodeError:
        pass
    try:
        return content.decode("windows-1252"), "decoded from windows-1252"
    except UnicodeDecodeError:
        return content.decode("utf-8", "replace"), "invalid bytes replaced"


@vectorized("struct<text:string,note:string>")
def decoded(content: pd.Series) -> pd.DataFrame:
    """``decode`` over a column."""
    return pd.DataFrame([(None, None) if c is None else decode(bytes(c)) for c in content], columns=["text", "note"])


@vectorized("boolean")
def text_like(content: pd.Series) -> pd.Series:
    """``sniffs_as_text`` over a column."""
    return content.map(lambda c: None if c is None else sniffs_as_text(bytes(c)))


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h
