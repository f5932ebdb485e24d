"""Places of matches in texts, which the built-in functions don't give: every occurrence, by Arrow batches."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Written ranges whose starts are nearer than this many letters are one range, read by the form that comes first.
NEAR = 15
DASH, OPEN = "[-–—]", "[Pp]resent|[Cc]urrent|[Oo]ngoing"
# The short names of months.
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[.]?"
#: The forms in order of trust: years with or without months, two digits in brackets, two digits behind a tab, an open end.
FORMS = (
    rf"(?:{MONTH}\s+)?([0-9]{{4}})\s*{DASH}\s*(?:{MONTH}\s+)?([0-9]{{4}}|{OPEN})",
    rf"[(]\s*([0-9]{{4}})\s*{DASH}\s*([0-9]{{2}})\s*[)]",
    rf"\t\s*([0-9]{{4}})\s*{DASH}\s*([0-9]{{2}})(?![0-9])",
    rf"([0-9]{{4}})\s*{DASH}\s*({OPEN})",
)
RANGE_TYPE = T.ArrayType(
    T.StructType([T.StructField(c, T.IntegerType()) for c in ("at", "stop", "form", "low", "high")] + [T.StructField("range", T.StringType())])
)
_RANGE = pa.list_(pa.struct([(c, pa.int32()) for c in ("at", "stop", "form", "low", "high")] + [("range", pa.string())]))


def spans(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int, tuple]]:
    """Start, end and groups of each match, in letters from 0."""
    return ((m.start(), m.end(), m.groups()) for m in pattern.finditer(text))


def written_ranges(forms: list[re.Pattern], now: int, near: int = NEAR) -> Callable[[str], list[dict]]:
    """A function from a text to its ranges of years, in order of place.

    The first form counts everywhere; another only where no range counts that starts within ``near`` letters.
    Two digits are of the start's century, and such a range must not end before it starts or after the year
    that follows ``now``. An open end is ``now``.
    """

    def find(text: str) -> list[dict]:
        starts: list[int] = []
        out = []
        for form, pattern in enumerate(forms):
            for at, stop, (first, last) in spans(pattern, text):
                low = int(first)
                high = now if not last.isdigit() else int(last) if len(last) == 4 else low // 100 * 100 + int(last)
                if form:
                    i = bisect.bisect_left(starts, at - near + 1)
                    if (i < len(starts) and starts[i] < at + near) or (len(last) == 2 and not low <= high <= now + 1):
                        continue
                bisect.insort(starts, at)
                out.append({"at": at, "stop": stop, "form": form + 1, "low": low, "high": high, "range": text[at:stop].strip()})
        return sorted(out, key=lambda r: r["at"])

    return find


def with_ranges(rows: DataFrame, text: str, now: int, out: str = "ranges") -> DataFrame:
    """The rows with the array of their text's written ranges; a null text has none."""
    names = [*rows.columns, out]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = written_ranges([re.compile(p, re.ASCII) for p in FORMS], now)
        for batch in batches:
            found = [find(x or "") for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _RANGE)], names)

    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields, T.StructField(out, RANGE_TYPE)]))
