"""Text codecs as columns: base64 with and without padding, hex, lossy UTF-8, folder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_text(value: Column) -> Column:
    """Unpadded and without the line ends that the built-in function inserts."""
    return F.translate(F.base64(value), "=\r\n", "")


def base64url_text(value: Column) -> Column:
    return F.translate(base64_text(value), "+/", "-_")


def base64_bytes(text: Column) -> Column:
    """Null for anything but one base64 text with at most two trailing `=`."""
    body = F.regexp_replace(text, "={1,2}$", "")
    ok = body.rlike("^[A-Za-z0-9+/]*$") & (F.length(body) % 4 != 1)
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(ok, F.try_to_binary(padded, F.lit("base64")))


def base64url_bytes(text: Column) -> Column:
    return F.when(~text.rlike("[+/]"), base64_bytes(F.translate(text, "-_", "+/")))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def text(value: Column) -> Column:
    """Bytes as text, with the replacement character for what is not UTF-8."""
    return F.make_valid_utf8(value.cast("string"))


def namespace_folder(ns: Column) -> Column:
    """Hex digits of the name's hex length, an underscore, the name in hex."""
    name = hex_text(ns.cast("binary"))
    return F.concat(F.lower(F.hex(F.length(name))), F.lit("_"), name)
