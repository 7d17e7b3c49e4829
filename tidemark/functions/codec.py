"""Base58 and canonical JSON: the two things that built-in functions can't express."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the alphabet of the code, without 0, O, I and l.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_VALUES = {c: i for i, c in enumerate(ALPHABET)}


def encode58(data: bytes) -> str:
    number, zeros = int.from_bytes(data, "big"), len(data) - len(data.lstrip(b"\0"))
    digits = []
    while number:
        number, rest = divmod(number, 58)
        digits.append(ALPHABET[rest])
    return ALPHABET[0] * zeros + "".join(reversed(digits))


def decode58(text: str) -> bytes | None:
    """None for text outside the alphabet."""
    number = 0
    for c in text:
        if c not in _VALUES:
            return None
        number = number * 58 + _VALUES[c]
    zeros = len(text) - len(text.lstrip(ALPHABET[0]))
    return b"\0" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")


@F.pandas_udf(T.StringType())
def base58(data: pd.Series) -> pd.Series:
    """Base58 of binary values; null stays null."""
    return data.map(lambda x: None if x is None else encode58(bytes(x)))


@F.pandas_udf(T.BinaryType())
def unbase58(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else decode58(x))


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; non-finite numbers are refused."""

    def refuse(x):
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("not finite")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            refuse(y)

    refuse(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text in canonical form; null for what isn't JSON or holds non-finite numbers."""

    def one(x):
        try:
            return None if x is None else canonical(json.loads(x))
        except ValueError:
            return None

    return text.map(one)
