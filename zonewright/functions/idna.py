"""Encoded (xn--) labels and look-alike letters. ASCII labels never need Python: their rows reach the workers as null."""

from __future__ import annotations

import functools
import stringprep
import unicodedata
from encodings.idna import dots, nameprep

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L

# Letters beyond ASCII and the letters that they look like (Cyrillic, Greek, dotless i, barred l).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "ο": "o", "α": "a", "ε": "e", "ι": "i", "ı": "i", "ł": "l",
}
_TABLE = str.maketrans(dict(zip(*L.LOOKALIKES, strict=True)) | LOOKALIKES)


@functools.lru_cache(1 << 16)
def _plain(c: str) -> bool:
    """Whether a character stays as it is when a label is prepared, and asks for no check of its neighbours but normal form."""
    try:
        return nameprep(c) == stringprep.map_table_b2(c) == c and not stringprep.in_table_d1(c) and not dots.match(c)
    except UnicodeError:
        return False


def _encode(label: str) -> str:
    # What the codec makes of most labels, without preparing each character anew; it does the others.
    if not label.isascii() and not label.startswith("xn--") and all(map(_plain, label)) and unicodedata.ucd_3_2_0.normalize("NFKC", label) == label:
        encoded = "xn--" + label.encode("punycode").decode("ascii")
        return encoded if len(encoded) < 64 else ""
    try:
        return label.encode("idna").decode("ascii")
    except UnicodeError:
        return ""


def _decode(label: str) -> str:
    try:
        return label.encode("ascii").decode("idna")
    except UnicodeError:
        return label


def plain_letters(label: str) -> str:
    """Without accents, look-alikes replaced: what homograph_normalize does, for one label at hand."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c))
    return bare.lower().translate(_TABLE)


def _column(work):
    @F.pandas_udf("string")
    def each(x: pd.Series) -> pd.Series:
        return x.map(work, na_action="ignore")

    return each


def _is_ascii(x: Column) -> Column:
    return F.length(x) == F.octet_length(x)


def idna_encode(label: Column) -> Column:
    """The label in ASCII; empty where it can't be encoded."""
    x = F.lower(F.trim(label))
    return F.when(_is_ascii(x), x).otherwise(_column(_encode)(F.when(~_is_ascii(x), x)))


def idna_decode(label: Column) -> Column:
    """An xn-- label in Unicode; any other, and one that can't be decoded, as it is."""
    x = F.lower(F.trim(label))
    encoded = F.startswith(x, F.lit("xn--"))
    return F.when(encoded, _column(_decode)(F.when(encoded, x))).otherwise(x)


def homograph_normalize(label: Column) -> Column:
    """Without accents, in lower case, look-alikes replaced by the letters they stand for."""
    return F.when(_is_ascii(label), L.unmasked(label)).otherwise(_column(plain_letters)(F.when(~_is_ascii(label), label)))
