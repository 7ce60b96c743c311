"""Fill-in-the-middle: texts cut at two ranks of their units and put together anew with the middle last.

A unit is a word with the white space before it, or white space at a text's end. The units of a text stand in an indexable skip list: every
express lane holds, for each of its links, how many units and how many code points the link passes over, so going down the lanes by their
summed widths reaches the code point where a rank ends in a number of steps that grows with the logarithm of the units.

The draws are the first four 8-digit groups of sha256("42:" + doc_id): two ranks, whether the text changes at all, and in which form.

Defined cases: a null or empty text has no units and stays plain, as does a text with a marker in it; a null doc_id draws as the empty
id; a rank of 0 leaves that part empty, and so do equal ranks; repeated rows get the same result each; bytes that are no UTF-8 come back as
they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The markers before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One unit in so many of a lane goes on to the lane above.
SPARSE = 4


def unit_ends(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit of the text ends, in bytes, and how many code points each has."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(text, np.uint8)
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    if blank[-1]:
        ends = np.append(ends, len(raw))
    points = np.cumsum((raw & 0xC0) != 0x80)
    return ends, np.diff(points[ends - 1], prepend=0)


@dataclass(frozen=True)
class SkipList:
    """Lanes from the lowest, which links every unit, to the highest.

    Link k of a lane passes over units[k] units and points[k] code points; below[k] is the place of its end among the links of the lane below.
    """

    units: list[np.ndarray]
    points: list[np.ndarray]
    below: list[np.ndarray]

    @staticmethod
    def of(widths: np.ndarray) -> SkipList:
        """Of units with these widths. A unit's height comes from a hash of its rank, so a list is always the same."""
        units, points, below = [np.ones(len(widths), np.int64)], [widths.astype(np.int64)], [np.zeros(0, np.int64)]
        mixed = np.arange(1, len(widths) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        while len(at := np.flatnonzero(mixed % np.uint64(SPARSE) == 0)):
            mixed = mixed[at] // np.uint64(SPARSE)
            units.append(np.diff(np.cumsum(units[-1])[at], prepend=0))
            points.append(np.diff(np.cumsum(points[-1])[at], prepend=0))
            below.append(at)
        return SkipList(units, points, below)

    def reach(self, rank: int) -> int:
        """The code points before the end of the first `rank` units."""
        link, left, passed = -1, rank, 0
        for lane in range(len(self.units) - 1, -1, -1):
            units, points = self.units[lane], self.points[lane]
            while link + 1 < len(units) and units[link + 1] <= left:
                link += 1
                left -= int(units[link])
                passed += int(points[link])
            if lane and link >= 0:
                link = int(self.below[lane][link])
        return passed


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(b"42:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def infilled(doc_id: int | None, text: bytes, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output."""
    _, widths = unit_ends(text)
    h = draws(doc_id)
    if not text or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= percent:
        return len(widths), "plain", None, None, text
    lanes = SkipList.of(widths)
    first, last = (lanes.reach(r) for r in sorted(x % (len(widths) + 1) for x in h[:2]))
    chars = text.decode("utf-8", "surrogateescape")
    prefix, middle, suffix = chars[:first], chars[first:last], chars[last:]
    if spm := h[3] % 100 < spm_percent:
        out = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        out = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return len(widths), "spm" if spm else "psm", first, last - first, out.encode("utf-8", "surrogateescape")


def fill_in_middle(docs: DataFrame, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: `percent` of the texts changed, of those `spm_percent` with the suffix first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = [infilled(d, t, percent, spm_percent) for d, t in zip(part.column(0).to_pylist(), texts, strict=True)]
            n, form, prefix, middle, out = zip(*found, strict=True)
            output = pa.Array.from_buffers(pa.large_string(), len(out), pa.array(out, pa.large_binary()).buffers())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), output.cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from the output and its form alone. No marker is in the text, so the first of each is the real one."""

    def before(text: Column, marker: str) -> Column:
        return F.substring_index(text, marker, 1)

    def after(text: Column, marker: str) -> Column:
        return F.substring(text, F.length(before(text, marker)) + len(marker) + 1, F.length(text))

    rest = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    psm = F.concat(before(rest, SUFFIX), after(after(rest, SUFFIX), MIDDLE), before(after(rest, SUFFIX), MIDDLE))
    spm = F.concat(before(after(rest, PREFIX), MIDDLE), after(after(rest, PREFIX), MIDDLE), before(rest, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
