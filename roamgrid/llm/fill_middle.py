"""Fill-in-the-middle: a text's middle moves behind its prefix and suffix.

A text is cut by the matches of a unit pattern, one code point by default.  The first pass counts the
matches; with their number the two ranks are known, and the second pass advances a lazy iterator of
matches to the smaller rank, then on to the larger.  Neither pass keeps a unit, so memory is the text
and what is made of it, whatever the number of units.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
#: Of a hundred texts, those that stay plain, and those of the others that begin with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Characters of output that are passed on at once.
BATCH_CHARS = 4_000_000


def count_units(unit: re.Pattern, text: str) -> int:
    """Matches of the pattern, one at a time."""
    passed = count()
    deque(zip(unit.finditer(text), passed), maxlen=0)
    return next(passed)


def ends_of(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the matches of two ranks end, ``low`` not above ``high``; rank 0 is the text's begin."""
    matches = unit.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    return first, next(islice(matches, high - low - 1, None)).end() if high > low else first


def rearrange(text: str, draws: tuple[int, int, int, int], unit: re.Pattern) -> tuple:
    """``n``, ``form``, length of prefix and of middle (None if plain), and the output of one text.

    ``draws``: four numbers, of which two choose the ranks and two the form.
    """
    n = count_units(unit, text)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, text
    low, high = sorted(draw % (n + 1) for draw in draws[:2])
    a, b = ends_of(unit, text, low, high)
    if draws[3] % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def transform(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """One row for each row: ``doc_id``, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    The draws are the first four groups of eight hexadecimal digits of SHA-256 of ``1:`` and the decimal
    doc_id (nothing for null), so rows of one doc_id are drawn alike.  A null text counts as empty and stays
    plain, as does a text that holds a mark.  Repeated rows stay repeated, an empty table gives an empty
    table, other columns are left out whatever their names.  No shuffle; no text is cut short.
    """
    pattern = re.compile(unit)

    def run(batches):
        for b in batches:
            rows, chars = [], 0
            for doc_id, text, drawn in zip(*b.columns):
                draw = drawn.as_py()
                rows.append((doc_id.as_py(), *rearrange(text.as_py(), tuple(int(draw[i : i + 8], 16) for i in (0, 8, 16, 24)), pattern)))
                chars += len(rows[-1][-1])
                if chars >= BATCH_CHARS:
                    yield _batch(rows)
                    rows, chars = [], 0
            if rows:
                yield _batch(rows)

    doc_id = F.col("doc_id").cast("long")
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), drawn.alias("drawn"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of.

    No mark can begin inside a part and end in another, as none begins as it ends, so the first mark of
    each kind is the one that was set.
    """
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    between = F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    one = F.when(form == "spm", F.substring_index(body, PREFIX, 1)).otherwise(F.substring_index(body, SUFFIX, 1))
    rest = F.substr(body, F.char_length(one) + F.char_length(between) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.char_length(two) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def round_trip(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """``transform`` with digests of the output and of the text rebuilt from it, in place of the output."""
    rows = transform(docs, unit)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )
