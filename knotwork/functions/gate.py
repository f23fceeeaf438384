"""Gate before a batch of findings: none may hold a marker phrase, however it is disguised.

Text is folded (NFKD, no combining marks, lookalike letters, case); a marker counts where it stands
as a word of its own, unless that place lies in an innocent word that is allowed.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marker phrases, allowed words, and letters that look like others.
MARKERS = (
    "ersetzt", "statt", "anstelle", "keine", "kein", "nicht", "sondern", "falsch", "basiert auf", "aufbauend",
    "weiterentwickelt", "verfeinert", "erweitert um", "uebersetzt", "ersetzbar", "verfeinerung",
)
ALLOWED = ("stattet", "stätte", "Nichtabstreitbarkeit", "Unabstreitbarkeit")
LOOKALIKES = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ɡ": "g", "ⅼ": "l",
    "ν": "v", "ｎ": "n", "ｋ": "k", "ｔ": "t", "０": "0", "１": "1", "３": "3", "５": "5",
})


def fold(text: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return plain.translate(LOOKALIKES).casefold()


_ALLOWED = [fold(word) for word in ALLOWED]
_FOLDED = [(marker, re.compile(rf"(?={re.escape(fold(marker))})")) for marker in MARKERS]


def markers_in(text: str | None) -> list[str]:
    """The markers of a finding, in their order."""
    folded, out = fold(text), []
    spans = [(m.start(), m.start() + len(word)) for word in _ALLOWED for m in re.finditer(f"(?={re.escape(word)})", folded)]
    for marker, pattern in _FOLDED:
        size = len(fold(marker))
        for m in pattern.finditer(folded):
            a, b = m.start(), m.start() + size
            alone = not (folded[a - 1 : a].isalnum() if a else False) and not folded[b : b + 1].isalnum()
            if alone and not any(x <= a and b <= y for x, y in spans):
                out.append(marker)
                break
    return out


def marker_scan(findings: DataFrame, text: str = "finding") -> DataFrame:
    """One row (all columns, marker) for each marker that a finding holds."""
    keep = findings.columns

    def run(it):
        for batch in it:
            found = [markers_in(t) for t in batch.column(text).to_pylist()]
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array([m for f in found for m in f], pa.string())], names=[*keep, "marker"])

    return findings.mapInArrow(run, findings.withColumn("marker", F.lit("")).schema)


def passed(findings: DataFrame, text: str = "finding") -> DataFrame:
    """The findings without a marker."""
    keep = findings.columns

    def run(it):
        for batch in it:
            clean = [not markers_in(t) for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return findings.select(*keep).mapInArrow(run, findings.schema)
