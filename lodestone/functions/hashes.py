"""Hashes that Spark has no function for: keyed digests of tokens, and the key of a graph's layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64
_MASK = 0xFFFFFFFF


def hmac_sha256(text: Column, key: bytes | str) -> Column:
    """HMAC-SHA256 in lower-case hexadecimal, of the UTF-8 bytes; by built-in functions, as RFC 2104 composes them. A null stays null."""
    import hashlib

    raw = key.encode() if isinstance(key, str) else key
    raw = (hashlib.sha256(raw).digest() if len(raw) > _BLOCK else raw).ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    own = F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(outer, own), 256)


def _wrapped(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def layout_key(ids: Column, width: Column, height: Column, bucket: int = 40) -> Column:
    """``number of ids:hash in base 36:size in buckets`` of a graph's node ids, in any order, and the canvas.

    The hash runs over the sorted ids: h * 33 + character from 5381 on, and a constant after each id, in 32 bits.
    """
    chars = lambda t: F.transform(F.filter(F.split(t, ""), lambda c: c != ""), F.ascii)
    of_id = lambda h, t: _wrapped(F.aggregate(chars(t), h, lambda a, c: _wrapped(a * 33 + c)) + F.lit(0x9E3779B1))
    h = F.aggregate(F.array_sort(ids), F.lit(5381).cast("long"), of_id)
    size = [F.floor(F.coalesce(x, F.lit(0)) / bucket + 0.5).cast("string") for x in (width, height)]
    return F.concat_ws(":", F.size(ids).cast("string"), F.lower(F.conv(h.cast("string"), 10, 36)), F.concat(size[0], F.lit("x"), size[1]))
