"""Fill-in-middle transformation with a sparse exception index.

In UTF-8 a code point's place is its byte's place less the excess bytes of the multibyte characters before it. So only those
characters are recorded: where they stand, in bytes and in code points, and the excess bytes up to them. A cut is converted
either way by one ``searchsorted`` over these exceptions and a subtraction or an addition; a text of ASCII only has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import bound, small_batches, whole_text

#: The marks of prefix, suffix and middle, the remainder of 100 from which a text stays plain, and that below
#: which the suffix comes first.
PREFIX, SUFFIX, MIDDLE, PLAIN_FROM, SPM_BELOW = "<P>", "<S>", "<M>", 90, 20
_CUT = "n bigint, prefix_chars bigint, middle_chars bigint, output binary"


class Exceptions:
    """The multibyte characters of a UTF-8 text and their excess bytes."""

    def __init__(self, data: np.ndarray):
        self.bytes_at = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes_at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.chars_at = self.bytes_at - self.before[:-1]

    def to_chars(self, at: int) -> int:
        """The code points before a byte that begins a character (or the end)."""
        return int(at - self.before[np.searchsorted(self.bytes_at, at)])

    def to_bytes(self, at: int) -> int:
        """The bytes before a code point."""
        return int(at + self.before[np.searchsorted(self.chars_at, at)])


def token_starts(data: np.ndarray) -> np.ndarray:
    """The bytes at which tokens begin: runs of A-Z and a-z, and each other character."""
    low = data | 0x20
    letter = (low >= 0x61) & (low <= 0x7A) & (data < 0x80)
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def split_at(text: bytes, h1: int, h2: int, unit: str = "token") -> tuple[int, int, int, int, int]:
    """(units, bytes and code points before the middle, bytes and code points before the suffix)."""
    data = np.frombuffer(text, dtype=np.uint8)
    index = Exceptions(data)
    if unit == "token":
        starts = token_starts(data)
        n = len(starts)
        to_byte = lambda k: int(starts[k]) if k < n else len(data)
    else:
        n = index.to_chars(len(data))
        to_byte = index.to_bytes
    a, b = (to_byte(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, a, index.to_chars(a), b, index.to_chars(b)


def arranged(text: bytes, a: int, b: int, form: str) -> bytes:
    """The output for a middle from byte ``a`` to ``b``."""
    if form == "plain":
        return text
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    first, last = (p, text[:a]), (s, text[b:])
    return b"".join([*(first + last if form == "psm" else last + first), m, text[a:b]])


def fill_middle(docs: DataFrame, column: str = "fim", unit: str = "token", salt: str = "1", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with a struct ``column``: n, form, prefix_chars, middle_chars and output.

    A text is cut twice, by the hash of ``salt`` and the row's ``key``, after so many tokens (``unit`` "token": runs of A-Z and
    a-z, each other character alone) or code points ("char"). Form is plain (the text as it is; null lengths) for empty texts,
    those that hold a mark, and a tenth of the others; psm puts prefix, suffix, middle, spm suffix, prefix, middle, each behind its
    mark. Null texts count as empty, a null key as an empty one. Repeated rows have equal results; other columns pass (one
    named as ``column`` is replaced); an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    whole = whole_text(text)
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((whole == "") | marked | (h(3) % 100 >= PLAIN_FROM), "plain").when(h(4) % 100 < SPM_BELOW, "spm").otherwise("psm")

    @F.pandas_udf(_CUT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ones, twos, forms in batches:
            rows = []
            for x, h1, h2, f in zip(texts, ones, twos, forms):
                n, a, chars, b, upto = split_at(x, h1, h2, unit)
                rows.append((n, *((None, None) if f == "plain" else (chars, upto - chars)), arranged(x, a, b, f)))
            found = pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars", "output"])
            yield found.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    got, shape = "fim__cut", "fim__form"
    cuts = docs.withColumn(shape, form).withColumn(got, cut(whole.cast("binary"), h(1), h(2), F.col(shape)))
    part = F.col(got)
    fields = F.struct(part["n"].alias("n"), F.col(shape).alias("form"), part["prefix_chars"].alias("prefix_chars"), part["middle_chars"].alias("middle_chars"), part["output"].cast("string").alias("output"))
    return cuts.withColumn(column, fields).drop(got, shape)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone. No text that is not plain holds a mark, so marks split the output into its parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    order = lambda *k: bound(parts, lambda x: F.concat(*(F.get(x, i) for i in k)))
    return F.when(form == "plain", output).when(form == "psm", order(1, 3, 2)).otherwise(order(2, 3, 1))
