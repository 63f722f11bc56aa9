"""Canonical JSON, content hashes, and the deterministic mock embedder.

Canonical JSON sorts keys at every level, has no white space and the fewest
escapes; whole floats print without a fraction and large ones in plain
decimals; what is not finite becomes null.
"""

from __future__ import annotations

import hashlib
import json
import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(x: float) -> str:
    if not math.isfinite(x):
        return "null"
    text = format(Decimal(repr(x)), "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "-0" if text in ("-0", "-") else text


def canonical(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def canonical_json(text: Column | str) -> Column:
    """Canonical form of JSON texts; null for what is not JSON.

    Plain ASCII texts without escapes or fractions are parsed and written by
    Spark, whose order of keys is the same; others, and those that Spark does
    not parse, go through Python.
    """
    text = F.col(text) if isinstance(text, str) else text
    plain = F.to_json(F.try_parse_json(F.when(~text.rlike(r"[^\x20-\x7e\s]|\\|[0-9][.eE]"), text)))

    @F.pandas_udf("string")
    def canonical_of(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else canonical(json.loads(t))
            except ValueError:
                return None

        return texts.map(one)

    return F.coalesce(plain, canonical_of(F.when(plain.isNull(), text)))


def envelope(schema: Column, namespace: Column, created_by: Column, created_at_ms: Column, data: Column, previous_version: Column) -> Column:
    """The canonical envelope that a record's id is the hash of; ``data`` must be canonical."""
    q = lambda c: F.to_json(F.struct(c.alias("x")))
    text = lambda c: F.regexp_extract(q(c), r"(?s)^\{\"x\":(.*)\}$", 1)
    previous = F.when(previous_version.isNull(), F.lit("null")).otherwise(text(previous_version))
    return F.concat(
        F.lit('{"created_at_ms":'), created_at_ms.cast("string"), F.lit(',"created_by":'), text(created_by), F.lit(',"data":'), data, F.lit(',"namespace":'), text(namespace),
        F.lit(',"previous_version":'), previous, F.lit(',"schema":'), text(schema), F.lit("}"),
    )


def content_hash(text: Column, algorithm: str = "sha256") -> Column:
    """64 hex digits; ``blake3`` is the reference implementation's hash, in Python."""
    if algorithm == "sha256":
        return F.sha2(text.cast("binary"), 256)
    if algorithm == "blake3":
        return _blake3_column(text)
    raise ValueError(algorithm)


# The hash's initial words and message permutation.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF


def _compress(chain: tuple[int, ...], block: bytes, counter: int, size: int, flags: int) -> list[int]:
    m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, size, flags]

    def g(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for word, first, second in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + word) & _MASK
            t = v[d] ^ v[a]
            v[d] = (t >> first | t << (32 - first)) & _MASK
            v[c] = (v[c] + v[d]) & _MASK
            t = v[b] ^ v[c]
            v[b] = (t >> second | t << (32 - second)) & _MASK

    for _ in range(7):
        for i in range(4):
            g(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            g(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[j] for j in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ chain[i] for i in range(8)]


def blake3(data: bytes) -> str:
    """BLAKE3 of bytes, in hex, after the public specification."""

    def chunk(part: bytes, index: int) -> tuple:
        chain, blocks = _IV, [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for i, b in enumerate(blocks):
            flags = _START * (i == 0) | _END * (i == len(blocks) - 1)
            args = (chain, b.ljust(64, b"\0"), index, len(b), flags)
            if i < len(blocks) - 1:
                chain = tuple(_compress(*args)[:8])
        return args

    def value(args: tuple) -> tuple[int, ...]:
        return tuple(_compress(*args)[:8])

    def parent(left: tuple, right: tuple) -> tuple:
        both = b"".join(w.to_bytes(4, "little") for w in (*value(left), *value(right)))
        return _IV, both, 0, 64, _PARENT

    def tree(parts: list[tuple]) -> tuple:
        if len(parts) == 1:
            return parts[0]
        half = 1 << (len(parts) - 1).bit_length() - 1
        return parent(tree(parts[:half]), tree(parts[half:]))

    args = tree([chunk(data[i : i + 1024], i // 1024) for i in range(0, max(len(data), 1), 1024)])
    return b"".join(w.to_bytes(4, "little") for w in _compress(*args[:4], args[4] | _ROOT)[:8]).hex()


def _blake3_column(text: Column) -> Column:
    """Row by row in Python: for checking records of the original, not for writing many."""

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else blake3(t.encode()))

    return hashed(text)


def truncate_strings(most: int):
    """A function column: JSON text with every string of more than ``most`` characters cut, at any depth."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def short(v):
            if isinstance(v, str):
                return "" if most == 0 else v if len(v) <= most else v[:most] + "…"
            if isinstance(v, list):
                return [short(x) for x in v]
            return {k: short(x) for k, x in v.items()} if isinstance(v, dict) else v

        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(short(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return cut


def mock_embedding(text: str, dim: int) -> np.ndarray:
    """A unit vector that depends on the text alone: FNV-1a seeds a linear congruential generator."""
    # Offset basis and prime of FNV-1a; multiplier and increment of the generator.
    h, prime, a, c, mask = 0xCBF29CE484222325, 0x100000001B3, 6364136223846793005, 1442695040888963407, (1 << 64) - 1
    for b in text.encode():
        h = (h ^ b) * prime & mask
    state, out = h | 1, np.empty(dim, np.float32)
    for i in range(dim):
        state = (state * a + c) & mask
        out[i] = np.float32(state >> 32) / np.float32(0xFFFFFFFF) * np.float32(2) - np.float32(1)
    n = np.sqrt(np.sum(out * out, dtype=np.float32))
    return out / n if n > 0 else out


def mock_embed(dim: int = 384):
    """``mock_embedding`` as a function column."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mock_embedding(t, dim).tolist())

    return embed
