"""Content hashes, digests of row sets and revisions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS_DOMAIN = "equivalence-class"


def content_hash(depth: Column, channels: Column, frames: Column, payload: Column, domain: str = "sample") -> Column:
    """SHA-256 over a header of the layout, a NUL and the binary payload."""
    head = F.concat_ws(":", F.lit(domain), depth, channels, frames)
    return F.sha2(F.concat(head.cast("binary"), F.unhex(F.lit("00")), payload), 256)


def class_hash(members: Column, domain: str = CLASS_DOMAIN) -> Column:
    """SHA-256 naming a set of members, whatever their order."""
    nul = F.unhex(F.lit("00"))
    joined = F.array_join(F.sort_array(F.array_distinct(members)), "\u0000")
    return F.sha2(F.concat(F.lit(domain).cast("binary"), nul, joined.cast("binary")), 256)


def hash64(*columns: Column) -> Column:
    """The first 60 bits of an MD5 over the columns as text: the same number in other SQL engines."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def advisory_key(name: Column) -> Column:
    """The first eight bytes of a SHA-256 as a signed 64-bit number."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, -10).cast("long")


def row_line(*columns: Column) -> Column:
    """A row as one compact JSON array of texts and nulls."""
    return F.to_json(F.array(*[c.cast("string") for c in columns]))


def revision(df: DataFrame, *columns: str) -> DataFrame:
    """``(n, mark)``: row count and sum of row hashes; no order, and any change of a row moves it."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(hash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("mark"))


def ordered_digest(df: DataFrame, key: str, line: Column, parts: int = 64) -> DataFrame:
    """``digest``: SHA-256 over the digests of ``parts`` key ranges, each over its newline-ended lines in key order.

    With ``parts=1`` it is the plain SHA-256 over all lines; more parts keep the lines off a single task.
    """
    lines = df.select(F.col(key).alias("k"), line.alias("line"), F.lit(0).alias("part") if parts == 1 else F.pmod(hash64(F.col(key)), F.lit(parts)).alias("part"))
    each = lines.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("rows"))
    each = each.select("part", F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.lit("\n"))), "").alias("text"))
    if parts == 1:
        return each.select(F.sha2("text", 256).alias("digest"))
    marks = each.select("part", F.sha2("text", 256).alias("mark"))
    return marks.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "mark"))), lambda r: r["mark"]), "\n"), 256).alias("digest"))


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)


def laid_out(digits: np.ndarray, start: int) -> list[np.ndarray | int]:
    """Rows of bytes as the sixteen words of an MD5 block, beginning at byte ``start``; words that they do not reach are 0."""
    n, size = digits.shape
    block = np.zeros((n, 4 * -(-(start + size) // 4)), np.uint8)
    block[:, start : start + size] = digits
    words = np.ascontiguousarray(block.view("<u4").T)
    return [*[w if k >= start // 4 else 0 for k, w in enumerate(words)], *[0] * (16 - len(words))]


def md5_heads(before: bytes, middle: list[np.ndarray | int], size: int, after: bytes) -> np.ndarray:
    """The first eight bytes of the MD5 of texts that differ in the middle only, as numbers in the order of the hex digits.

    ``middle``: rows of ``size`` bytes, :func:`laid_out` behind ``before``; a text has 55 bytes at most. For many short texts at
    once inside a task, where a call for each would take most of the time.
    """
    whole = len(before) + size + len(after)
    if whole > 55:
        raise ValueError("texts of one block only")
    block = np.frombuffer((before + bytes(size) + after + b"\x80").ljust(56, b"\0") + (8 * whole).to_bytes(8, "little"), "<u4")
    words = [m + f if np.ndim(m) else int(f) for m, f in zip(middle, block)]
    n = max(np.size(m) for m in middle)
    a, b, c, d = (np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    start = a[0], b[0]
    mix, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind < 2:  # d ^ (b & (c ^ d)), then the same with the roles moved on
            x, y, z = (b, c, d) if kind == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=mix)
            np.bitwise_and(mix, x, out=mix)
            np.bitwise_xor(mix, z, out=mix)
        elif kind == 2:
            np.bitwise_xor(b, c, out=mix)
            np.bitwise_xor(mix, d, out=mix)
        else:
            np.bitwise_not(d, out=mix)
            np.bitwise_or(mix, b, out=mix)
            np.bitwise_xor(mix, c, out=mix)
        mix += a
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        if np.ndim(word):
            mix += word
            mix += _SINES[i]
        else:
            mix += np.uint32((int(word) + int(_SINES[i])) % 2**32)
        turn = int(_TURNS[kind, i % 4])
        np.left_shift(mix, turn, out=high)
        np.right_shift(mix, 32 - turn, out=mix)
        np.bitwise_or(mix, high, out=mix)
        mix += b
        a, d, c, b, mix = d, c, b, mix, a
    a, b = a + start[0], b + start[1]
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap().astype(np.uint64)
