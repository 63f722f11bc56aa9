"""Keys, sealing and signing with what Python and Spark bring along.

Sealing is AES-GCM where the original uses another authenticated cipher: the
contract (seal, open, tamper fails) is the same, the bytes are not.  Signing
is an HMAC; a public-key signer can be plugged in.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def derive_key(master: bytes, context: str) -> bytes:
    """HKDF-SHA256 (extract and expand) to 32 bytes."""
    strong = hmac.new(b"\0" * 32, master, hashlib.sha256).digest()
    return hmac.new(strong, context.encode() + b"\x01", hashlib.sha256).digest()


def namespace_key(master: bytes, namespace: str) -> bytes:
    return derive_key(master, f"namespace:{namespace}")


def vector_key(master: bytes, namespace: str) -> bytes:
    return derive_key(master, f"vectors:{namespace}")


def seal(plain: Column, key: bytes, bound_to: Column | None = None) -> Column:
    """Nonce, ciphertext and tag; a fresh nonce each time."""
    args = [plain.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT")]
    return F.aes_encrypt(*args) if bound_to is None else F.aes_encrypt(*args, F.lit(b""), bound_to.cast("binary"))


def open_sealed(sealed: Column, key: bytes, bound_to: Column | None = None) -> Column:
    """The plain bytes, or null if anything was changed."""
    args = [sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")]
    return F.try_aes_decrypt(*args) if bound_to is None else F.try_aes_decrypt(*args, bound_to.cast("binary"))


class Signer(Protocol):
    def sign(self, message: bytes) -> str: ...

    def verify(self, message: bytes, sig: str) -> bool: ...


class HmacSigner:
    def __init__(self, key: bytes):
        self.key = key

    def sign(self, message: bytes) -> str:
        return base64.urlsafe_b64encode(hmac.new(self.key, message, hashlib.sha256).digest()).decode().rstrip("=")

    def verify(self, message: bytes, sig: str) -> bool:
        return same_token(self.sign(message), sig)


def same_token(a: str, b: str) -> bool:
    """In constant time."""
    return hmac.compare_digest(a.encode(), b.encode())


def bearer(header: str | None) -> str | None:
    """The token of an authorisation header."""
    kind, _, token = (header or "").partition(" ")
    return token.strip() or None if kind.lower() == "bearer" else None


def signature(message: Column, signer: Signer) -> Column:
    @F.pandas_udf("string")
    def sign(m: pd.Series) -> pd.Series:
        return m.map(lambda x: None if x is None else signer.sign(x.encode()))

    return sign(message)


def signature_ok(message: Column, sig: Column, signer: Signer) -> Column:
    @F.pandas_udf("boolean")
    def check(m: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and signer.verify(x.encode(), y) for x, y in zip(m, s)])

    return check(message, sig)
