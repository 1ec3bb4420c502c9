"""Field encryption: base64(nonce, ciphertext, tag) by AES-256-GCM with fixed associated data.

The key is a base64 text in the session setting ``spark.matchlake.health.key``. It is a literal of the query plan, so
keep plans of such jobs out of shared logs (``spark.sql.redaction.string.regex`` hides it in explain output and the UI).
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

AAD = "soccer-health-v1"  # fixed value: part of the stored format
KEY_CONF = "spark.matchlake.health.key"


def key_column(spark: SparkSession) -> Column:
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        raise RuntimeError(f"set {KEY_CONF} to a base64 text of 32 bytes")
    return F.unbase64(F.lit(key))


def encrypt(value: Column, key: Column) -> Column:
    """Encrypted text of a string column; null stays null."""
    return _sealed(F.encode(value, "UTF-8"), key)


def _sealed(data: Column, key: Column) -> Column:
    # the first 12 digits of a UUID are random throughout; its version and variant bits come later
    part = lambda: F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
    nonce = F.unhex(F.concat(part(), part()))
    return F.base64(F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.lit(AAD)))


def decrypt(text: Column, key: Column) -> Column:
    """Decrypted string, null when the text was changed or the key is wrong."""
    return F.decode(_opened(text, key), "UTF-8")


def _opened(text: Column, key: Column) -> Column:
    return F.try_aes_decrypt(F.unbase64(text), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(AAD))


def encrypt_number(value: Column, key: Column) -> Column:
    return encrypt(value.cast("string"), key)


def decrypt_number(text: Column, key: Column) -> Column:
    return decrypt(text, key).try_cast("double")


def encrypt_json(value: Column, key: Column) -> Column:
    """Encrypted JSON text of a struct, array or map; null stays null."""
    return encrypt(F.to_json(value), key)


def decrypt_json(text: Column, key: Column, schema: T.DataType) -> Column:
    """Value of an encrypted JSON text, null when the text was changed or the key is wrong."""
    return F.from_json(decrypt(text, key), schema)


# ---- packed texts -----------------------------------------------------------------------------------------------
# Ciphertext can't be compressed, so repeated names are taken out of a JSON text before it is encrypted: a packed text is
# PACKED and the raw deflate stream with a preset dictionary. No JSON text begins with that byte, so plain ones stay readable.
PACKED = b"\x01"


def encrypt_packed(text: Column, key: Column, words: str) -> Column:
    """Encrypted text of a string column, packed by ``words`` (a text like those to come); null stays null."""
    known, mark = words.encode(), PACKED

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        empty = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_DEFAULT_STRATEGY, known)

        def one(text):
            c = empty.copy()
            return mark + c.compress(text.encode()) + c.flush()

        return pd.Series([None if t is None else one(t) for t in texts], index=texts.index, dtype=object)

    return _sealed(pack(text), key)


def decrypt_packed(text: Column, key: Column, words: str) -> Column:
    """The string of a packed or plain encrypted text, null when the text was changed or the key is wrong; ``words`` as it was packed."""
    known, mark = words.encode(), PACKED

    @F.pandas_udf("string")
    def unpack(data: pd.Series) -> pd.Series:
        def one(raw):
            if raw[:1] != mark:
                return raw.decode()
            d = zlib.decompressobj(-15, known)
            return (d.decompress(raw[1:]) + d.flush()).decode()

        return pd.Series([None if raw is None else one(bytes(raw)) for raw in data], index=data.index, dtype=object)

    return unpack(_opened(text, key))
