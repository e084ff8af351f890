"""Fill-in-the-middle: cut a text at two line ranks, found in an indexable skip list.

The lines of a text (each with its line feed; the last may lack one) are the bottom lane of a skip
list. Every lane above keeps about one link in LINK of the lane below and skips what lies between.
Each link carries two widths: its units (lines) and its code points. A cut rank is found from the
top lane down: follow a link while the units gathered stay within the rank, else go down a lane.
The code points gathered on the way are where the text is cut, so no line before the cut is looked
at one by one, and both cuts are exact.

Where a text is cut, which form it takes and whether it stays plain depend on sha256 of
``seed:doc_id``, which Spark computes; Python workers only cut and join. Digests of outputs and the
way back (``restored``) are Spark expressions.

Defined results: a null text counts as empty, and an empty text and one that has any of the marks
stays plain. A null id draws from ``seed:``. Rows with one id draw alike, repeated rows give
repeated results, other columns are not read, and the empty table gives no rows. Texts are handled
in blocks of bounded bytes; a longer text is a block of its own and takes a few times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cotflow.llm.batches import BLOCK_BYTES, arrow_schema, give_back, mix

MARKS = ("<P>", "<S>", "<M>")
LINK = 4
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class LineSkipList:
    """The lines of one text by their code points, with lanes that skip over LINK links on average."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        # Per lane: units and code points of each link, and the link of the lane below where it begins.
        self.lanes = [(np.ones(self.n, np.int64), np.asarray(points, np.int64), None)]
        while len(self.lanes[-1][0]) > LINK:
            units, below, _ = self.lanes[-1]
            drawn = mix(np.arange(len(units), dtype=np.uint64) + np.uint64(len(self.lanes) << 48))
            stays = drawn % np.uint64(LINK) == 0
            stays[0] = True
            starts = np.flatnonzero(stays)
            self.lanes.append((np.add.reduceat(units, starts), np.add.reduceat(below, starts), starts))

    def points_before(self, rank: int) -> int:
        """The code points of the first ``rank`` lines."""
        link, units, points = 0, 0, 0
        for unit_widths, point_widths, below in reversed(self.lanes):
            while link < len(unit_widths) and units + unit_widths[link] <= rank:
                units += int(unit_widths[link])
                points += int(point_widths[link])
                link += 1
            if below is None or units == rank:
                break
            link = int(below[link])
        return points


def line_points(data: np.ndarray) -> np.ndarray:
    """Code points of every line of a text given as UTF-8 bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(data[:-1] == 10) + 1
    heads = (data & 0xC0) != 0x80
    return np.add.reduceat(heads, np.concatenate([[0], starts]), dtype=np.int64)


def joined(form: str, prefix: str, middle: str, suffix: str, marks=MARKS) -> str:
    p, s, m = marks
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def _cutter(marks, percent: int, spm_percent: int):
    def cut(text: str, h: list[int]):
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        points = line_points(data)
        n = len(points)
        if not n or any(mark in text for mark in marks) or h[2] % 100 >= percent:
            return n, "plain", None, None, text
        first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        lines = LineSkipList(points)
        a, b = lines.points_before(first), lines.points_before(second)
        form = "spm" if h[3] % 100 < spm_percent else "psm"
        return n, form, a, b - a, joined(form, text[:a], text[a:b], text[b:], marks)

    def run(batches):
        schema = arrow_schema(CUT)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            units = np.cumsum(sizes, dtype=np.int64) // BLOCK_BYTES
            edges = np.append(np.flatnonzero(np.diff(units, prepend=-1)), batch.num_rows)
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(start, stop - start)
                draws = zip(*[part.column(c).to_pylist() for c in range(2, 6)], strict=True)
                rows = [cut(text or "", h) for text, h in zip(part.column(1).to_pylist(), draws, strict=True)]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)
            give_back()

    return run


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of sha256 of ``seed:doc_id``, as numbers."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    ``percent`` of the documents are cut, the others stay plain; of those that are cut,
    ``spm_percent`` have the suffix first.
    """
    doc_id = docs[id_col].cast("long").alias("doc_id")
    rows = docs.select(doc_id, docs[text_col].cast("string").alias("text"), *draws(docs[id_col].cast("long"), seed))
    return rows.mapInArrow(_cutter(marks, percent, spm_percent), CUT)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A text that is cut has no mark, so marks part it."""
    parts = F.split(output, "|".join(rf"\Q{mark}\E" for mark in marks), -1)
    at = [F.get(parts, F.lit(k)) for k in range(4)]
    return (
        F.when(form == "psm", F.concat(at[1], at[3], at[2]))
        .when(form == "spm", F.concat(at[2], at[3], at[1]))
        .otherwise(output)
    )
