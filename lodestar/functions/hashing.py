"""Digests and encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.strings import col


def hex_(c: Column | str) -> Column:
    return F.lower(F.hex(col(c)))


def unhex(c: Column | str) -> Column:
    return F.unhex(col(c))


def base64(c: Column | str) -> Column:
    return F.regexp_replace(F.base64(col(c).cast("binary")), r"[\r\n]", "")


def unbase64(c: Column | str) -> Column:
    return F.unbase64(col(c))


def base64_url(c: Column | str) -> Column:
    return F.translate(base64(c), "+/", "-_")


def unbase64_url(c: Column | str) -> Column:
    return F.unbase64(F.translate(col(c), "-_", "+/"))


def sha(c: Column | str, bits: int) -> Column:
    return F.sha1(col(c)) if bits == 1 else F.sha2(col(c), bits)


def to_base(c: Column | str, base: int) -> Column:
    return F.lower(F.conv(col(c).cast("string"), 10, base))


def from_base(c: Column | str, base: int) -> Column:
    return F.conv(col(c), base, 10).cast("bigint")


def digest(kind: str, c: Column | str, key: str | None = None) -> Column:
    """sha3_256, sha3_512, blake2b_256, blake2b_512, adler32, hmac_sha1, hmac_sha256, hmac_sha512: in Arrow batches."""
    import hashlib
    import hmac
    import zlib

    make = {
        "sha3_256": lambda b: hashlib.sha3_256(b).hexdigest(),
        "sha3_512": lambda b: hashlib.sha3_512(b).hexdigest(),
        "blake2b_256": lambda b: hashlib.blake2b(b, digest_size=32).hexdigest(),
        "blake2b_512": lambda b: hashlib.blake2b(b).hexdigest(),
        "adler32": lambda b: f"{zlib.adler32(b):08x}",
        "hmac_sha1": lambda b: hmac.new(key.encode(), b, "sha1").hexdigest(),
        "hmac_sha256": lambda b: hmac.new(key.encode(), b, "sha256").hexdigest(),
        "hmac_sha512": lambda b: hmac.new(key.encode(), b, "sha512").hexdigest(),
    }[kind]

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else make(v.encode() if isinstance(v, str) else bytes(v)))

    return run(col(c))


def packed(kind: str, c: Column | str) -> Column:
    """gzip, gunzip, zlib, unzlib, base32, unbase32, quoted_printable, unquoted_printable over bytes."""
    import base64 as b64
    import gzip
    import quopri
    import zlib

    make = {
        "gzip": lambda b: gzip.compress(b, mtime=0), "gunzip": gzip.decompress, "zlib": zlib.compress, "unzlib": zlib.decompress, "base32": b64.b32encode,
        "unbase32": b64.b32decode, "quoted_printable": quopri.encodestring, "unquoted_printable": quopri.decodestring,
    }[kind]

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else make(bytes(v))
            except (ValueError, OSError, EOFError, zlib.error):
                return None  # one bad value is NULL, not the end of the job

        return x.map(one)

    return run(col(c).cast("binary"))


def encrypt(c: Column | str, key: str) -> Column:
    """AES in GCM mode under a key of 16, 24 or 32 bytes, as base64."""
    return F.base64(F.aes_encrypt(col(c), F.lit(key), F.lit("GCM")))


def decrypt(c: Column | str, key: str) -> Column:
    """NULL for what the key doesn't open."""
    return F.decode(F.try_aes_decrypt(F.unbase64(col(c)), F.lit(key), F.lit("GCM")), "UTF-8")


def uuid() -> Column:
    return F.uuid()


# Morse signs.
MORSE = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ".- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. ----- .---- ..--- ...-- ....- ..... -.... --... ---.. ----.".split(), strict=True))


def text_code(kind: str, c: Column | str) -> Column:
    """uuencode, uudecode, punycode, unpunycode, unicode_escape, unicode_unescape, js_escape, js_unescape, morse, unmorse over texts;
    NULL for what cannot be decoded."""
    import binascii
    import json
    import re

    back = {v: k for k, v in MORSE.items()}
    make = {
        "uuencode": lambda s: "".join(binascii.b2a_uu(s.encode()[i : i + 45]).decode() for i in range(0, len(s.encode()), 45)),
        "uudecode": lambda s: b"".join(binascii.a2b_uu(x) for x in s.split("\n") if x).decode(),
        "punycode": lambda s: s.encode("punycode").decode(),
        "unpunycode": lambda s: s.encode().decode("punycode"),
        "unicode_escape": lambda s: "".join(ch if ord(ch) < 128 else f"\\u{ord(ch):04x}" for ch in s),
        "unicode_unescape": lambda s: re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s),
        "js_escape": lambda s: json.dumps(s, ensure_ascii=False)[1:-1].replace("'", "\\'"),
        "js_unescape": lambda s: json.loads('"' + s.replace("\\'", "'") + '"'),
        "morse": lambda s: " ".join("/" if ch == " " else MORSE.get(ch, ch) for ch in s.upper()),
        "unmorse": lambda s: "".join(" " if x == "/" else back.get(x, x) for x in s.split()),
    }[kind]

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else make(v)
            except (ValueError, binascii.Error):
                return None

        return x.map(one)

    return run(col(c))
