"""Column encryption: AES-256-GCM, random nonce first, URL-safe Base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAILED = "[Decryption Failed]"


def _key(secret: str) -> Column:
    return F.unhex(F.sha2(F.lit(secret), 256))


def encrypt_col(text: Column, secret: str) -> Column:
    """Encrypted text; empty and NULL stay as they are."""
    sealed = F.base64(F.aes_encrypt(text.cast("binary"), _key(secret), F.lit("GCM")))
    plain_base64 = F.regexp_replace(sealed, "[\\r\\n]", "")
    return F.when(F.length(text) > 0, F.translate(plain_base64, "+/", "-_")).otherwise(text)


def decrypt_col(text: Column, secret: str) -> Column:
    """Inverse of `encrypt_col`; text that cannot be decrypted becomes a fixed marker."""
    raw = F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))
    opened = F.try_aes_decrypt(raw, _key(secret), F.lit("GCM"))
    return F.when(F.length(text) > 0, F.coalesce(F.try_validate_utf8(opened.cast("string")), F.lit(FAILED))).otherwise(text)
