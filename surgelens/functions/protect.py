"""Ids, tokens, column protection and redaction with built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

# Names of secret fields, and runs of 13-19 digits that look like card numbers.
SECRET_NAMES = r"(?i)(pass(word)?|secret|token|api[_-]?key|authorization|cvv|otp|pan|card[_-]?number)"
CARD_RUN = r"\b(?:\d[ -]*?){13,19}\b"


def stable_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed hash (hex) from two SHA-256 passes with constant pads."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def instrument_token(value: Column, pepper: str, scope: str = "global") -> Column:
    """Blind token of an instrument; empty stays empty."""
    key = hashlib.sha256(f"{pepper}:{scope}".encode()).digest()
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(
        F.concat(F.lit("ins_tok_"), F.substring(hmac_sha256(key, value), 1, 24)))


def encrypt(value: Column, secret: str) -> Column:
    """AES-256-GCM with a random IV, base64 text."""
    return F.base64(F.aes_encrypt(value, F.lit(bytearray(hashlib.sha256(secret.encode()).digest())), F.lit("GCM")))


def decrypt(value: Column, secret: str) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(bytearray(hashlib.sha256(secret.encode()).digest())), F.lit("GCM")).cast("string")


def redact_text(text: Column, limit: int | None = None) -> Column:
    """Mask card-like digit runs; with ``limit``, text without one is cut to that length."""
    plain = text if limit is None else F.substring(text, 1, limit)
    return F.when(text.rlike(CARD_RUN), F.regexp_replace(text, CARD_RUN, "<redacted-number>")).otherwise(plain)


def redact_map(fields: Column) -> Column:
    """Redact a string map: secret-named fields are dropped to a mark, the rest masked."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(SECRET_NAMES), F.lit("<redacted>")).otherwise(redact_text(v)))
