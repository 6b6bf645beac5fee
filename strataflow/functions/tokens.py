"""Signed tokens as columns: JSON Web Tokens with HMAC over SHA-256, issued and checked without leaving the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = '{"alg":"HS256","typ":"JWT"}'
_BLOCK = 64


def _pads(key: bytes) -> tuple[bytes, bytes]:
    """The key of one block, under the inner mask and the outer one."""
    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The digest of a message under a key, as binary."""
    inner, outer = _pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(F.lit(outer), first), 256))


def url_base64(value: Column) -> Column:
    """Base 64 with the alphabet for URLs, without padding or line ends."""
    return F.translate(F.base64(value.cast("binary")), "+/=\r\n", "-_")


def from_url_base64(text: Column) -> Column:
    """What was encoded, or null where the text isn't base 64 in that alphabet."""
    plain = F.translate(text, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    return F.when(text.rlike("^[A-Za-z0-9_-]*$") & (F.length(text) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))


def issue(claims: Column, key: bytes) -> Column:
    """The token of claims that are given as JSON text."""
    body = F.concat(url_base64(F.lit(HEADER)), F.lit("."), url_base64(claims))
    return F.concat(body, F.lit("."), url_base64(hmac_sha256(body, key)))


def claims(token: Column, key: bytes) -> Column:
    """The claims of a token as JSON text; null unless it has three parts, this header and a signature under the key.

    Defined cases: a null token has no claims, and neither has one with another algorithm in its header, whatever its signature."""
    parts = F.split(token, r"\.", -1)
    body = F.concat_ws(".", parts[0], F.try_element_at(parts, F.lit(2)))
    signed = F.try_element_at(parts, F.lit(3)) == url_base64(hmac_sha256(body, key))
    return F.when((F.size(parts) == 3) & (parts[0] == url_base64(F.lit(HEADER))) & signed, from_url_base64(F.try_element_at(parts, F.lit(2))).cast("string"))


def state(token: Column, key: bytes, now: Column) -> Column:
    """valid, expired (its `exp`, in seconds, is not after now) or refused."""
    found = claims(token, key)
    until = F.get_json_object(found, "$.exp").cast("long")
    return F.when(found.isNull() | until.isNull(), "refused").when(until <= now, "expired").otherwise("valid")
