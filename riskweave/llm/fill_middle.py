"""Fill-in-the-middle: whole texts cut at two token ends into prefix, middle and suffix, and put together anew."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.flat import row_chunks, text_buffers
from riskweave.llm.scratch import fresh_name

#: A word with the white space before it, or white space at the end of the text.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULTS = ("output", "form", "n", "prefix_chars", "middle_chars")


@dataclass(frozen=True)
class Markers:
    """What stands before the prefix, the suffix and the middle. A text that holds one of them stays as it is."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = [self.prefix, self.suffix, self.middle]
        overlap = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b)))
        if not all(marks) or len(set(marks)) < 3 or overlap or any(a in b for a in marks for b in marks if a != b):
            raise ValueError(f"markers must be three texts, none of which is in or overlaps another: {marks}")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four integers under 2**32: the first digit groups of the sha256 of ``seed:id``; a null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


class UnitCutter:
    """The ends of all units of a text from one match that keeps every repetition of its group."""

    def __init__(self, unit: str = UNIT):
        self.pattern = regex.compile(f"({unit})*+")

    def cut(self, text: str, first: int, second: int) -> tuple[int, int, int]:
        """Number of units n, and where the prefix and the middle end: after ``draw % (n + 1)`` units, smaller first."""
        match = self.pattern.fullmatch(text)
        if match is None:
            raise ValueError("the units do not cover a text")
        ends = match.ends(1)
        n = len(ends)
        low, high = sorted((first % (n + 1), second % (n + 1)))
        return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def with_fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, share: int = 50, spm_share: int = 80,
    markers: Markers = Markers(), unit: str = UNIT,
) -> DataFrame:
    """``docs`` without its text, with ``output`` (the text to train on), ``form``, ``n``, ``prefix_chars``, ``middle_chars``.

    Both cuts, whether a text is rearranged at all (``share`` percent are) and whether the suffix comes first
    (``spm_share`` percent of those) follow from the id and ``seed`` alone, so a recomputed task gives the same rows.
    Form is plain, with the text as output and null lengths, if the text is empty, holds a marker, or is not drawn. A null
    text is the empty text; a null id draws like an empty one; rows that share an id share their draws. Repeated rows
    stay, an empty table gives an empty result, columns named like a result are replaced. Whole texts are cut, a very long
    one stands alone in its batch.
    """
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), *RESULTS)]
    names = [fresh_name(docs, f"draw_{i}") for i in range(4)]
    body = fresh_name(docs, "body")
    out = T.StructType([docs.schema[c] for c in kept])
    out = out.add("output", T.StringType(), False).add("form", T.StringType(), False).add("n", T.LongType(), False)
    out = out.add("prefix_chars", T.LongType()).add("middle_chars", T.LongType())
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    marks = (markers.prefix, markers.suffix, markers.middle)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = UnitCutter(unit)
        for part in parts:
            data, offsets = text_buffers(part.column(body))
            for first, last in row_chunks(offsets):
                drawn = [part.column(n).slice(first, last - first).to_pylist() for n in names]
                rows = []
                for i, h1, h2, h3, h4 in zip(range(first, last), *drawn):
                    whole = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    n, a, b = cutter.cut(whole, h1, h2)
                    if not whole or h3 % 100 >= share or any(mark in whole for mark in marks):
                        rows.append((whole, PLAIN, n, None, None))
                    elif h4 % 100 < spm_share:
                        rows.append(("".join((marks[1], whole[b:], marks[0], whole[:a], marks[2], whole[a:b])), SPM, n, a, b - a))
                    else:
                        rows.append(("".join((marks[0], whole[:a], marks[1], whole[b:], marks[2], whole[a:b])), PSM, n, a, b - a))
                made = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                rest = [part.column(c).slice(first, last - first) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=out.names)

    chosen = [F.col(f"`{c}`") for c in kept]
    numbers = [d.alias(n) for d, n in zip(draws(F.col(f"`{doc_id}`"), seed), names)]
    return docs.select(*chosen, *numbers, F.col(f"`{text}`").alias(body)).mapInArrow(batches, out)


def restored_text(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that ``output`` was made from, by its form; null for a form that is none of the three."""
    marks = [markers.prefix, markers.suffix, markers.middle]
    pieces = F.split(output, "|".join(r"\Q" + mark + r"\E" for mark in marks), -1)
    return (
        F.when(form == PLAIN, output)
        .when(form == PSM, F.concat(pieces[1], pieces[3], pieces[2]))
        .when(form == SPM, F.concat(pieces[2], pieces[3], pieces[1]))
    )


def fill_in_middle_digests(df: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """Digests of ``output`` and of the text rebuilt from it, in place of ``output``."""
    restored = restored_text(F.col("output"), F.col("form"), markers)
    return df.withColumns({
        "output_sha256": F.sha2(F.col("output").cast("binary"), 256),
        "restored_sha256": F.sha2(restored.cast("binary"), 256),
    }).drop("output")
