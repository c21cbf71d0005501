"""Signed job tokens: base64url(canonical JSON) "." base64url(HMAC-SHA-256)."""

from __future__ import annotations

import base64
import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

MIN_SECRET_BYTES = 32
SKEW_SECONDS = 60
CLAIMS = "struct<exp:bigint,filename:string,job_id:string,result_path:string,source_path:string,source_size:bigint>"
NAMES = ("exp", "filename", "job_id", "result_path", "source_path", "source_size")


def base64url(raw: Column) -> Column:
    """base64url without padding, on one line."""
    return F.rtrim(F.translate(F.replace(F.base64(raw), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.try_to_binary(F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))


def signature(secret: bytes, payload: str) -> str:
    return base64.urlsafe_b64encode(hmac.digest(secret, payload.encode(), hashlib.sha256)).decode().rstrip("=")


def signer(secret: bytes):
    """A function of a column: each payload with its signature. Built-in functions have no HMAC."""
    enough(secret)

    @F.pandas_udf("string")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: None if s is None else f"{s}.{signature(secret, s)}")

    return sign


def opener(secret: bytes):
    """A function of a column: the claims' text of each token whose signature is right, else null."""
    enough(secret)

    def opened(token: str | None) -> str | None:
        payload, dot, given = (token or "").partition(".")
        if not dot or not hmac.compare_digest(signature(secret, payload).encode(), given.encode()):
            return None
        try:
            return base64.b64decode(payload + "=" * (-len(payload) % 4), b"-_", validate=True).decode()
        except ValueError:
            return None

    @F.pandas_udf("string")
    def read(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in tokens:
            yield part.map(opened)

    return read


def enough(secret: bytes) -> None:
    if len(secret) < MIN_SECRET_BYTES:
        raise ValueError("SERVICE_UNAVAILABLE: the signing secret is missing or too short")


def canonical(claims: dict[str, Column]) -> Column:
    """The claims as JSON: keys sorted, no spaces, characters outside ASCII as they are."""
    return F.to_json(F.struct(*[claims[n].alias(n) for n in NAMES]))


def mint(claims: dict[str, Column], secret: bytes) -> Column:
    return signer(secret)(base64url(canonical(claims).cast("binary")))


def verify(token: Column, now: Column, secret: bytes, skew: int = SKEW_SECONDS) -> Column:
    """struct<claims, code>: code is null for a token that holds; the signature is tested before the expiry."""

    def judged(read: Column) -> Column:
        claims, whole = read["claims"], read["claims"].isNotNull()
        for n in NAMES:
            whole = whole & claims[n].isNotNull()
        code = F.when(~F.coalesce(whole, F.lit(False)), "JOB_TOKEN_INVALID").when(claims["exp"] + skew < read["now"], "JOB_TOKEN_EXPIRED")
        return let(code, lambda code: F.struct(F.when(code.isNull(), claims).alias("claims"), code.alias("code")))

    # the token is opened by one pass in Python and parsed once, however many claims are asked for
    return let(F.struct(F.from_json(opener(secret)(token), CLAIMS).alias("claims"), now.alias("now")), judged)
