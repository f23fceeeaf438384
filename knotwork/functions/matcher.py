"""Many keywords at once: one automaton reads each text once, whatever the number of keywords."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keywords in an automaton (a broadcast); a larger taxonomy is matched in as many passes as it has such blocks.
BLOCK = 100_000


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at] == "_" or text[at].isalnum())


def areas_in(text: str, automaton, whole_words: bool) -> set[str]:
    """The areas of all keywords in ``text``; as whole words only where these are asked for."""
    found: set[str] = set()
    for end, (size, areas) in automaton.iter(text):
        if not areas <= found and not (whole_words and (_in_word(text, end - size) or _in_word(text, end + 1))):
            found |= areas
    return found


def automaton_of(keywords: list[tuple[str, str]]):
    by_word: dict[str, set[str]] = {}
    for area, word in keywords:
        by_word.setdefault(word, set()).add(area)
    out = ahocorasick.Automaton()
    for word, areas in by_word.items():
        out.add_word(word, (len(word), areas))
    out.make_automaton()
    return out


def matched(bodies: DataFrame, keywords: DataFrame, whole_words: bool) -> DataFrame:
    """(id, area): the areas whose ``keywords(area, keyword)`` stand in each of ``bodies(id, body)``, both folded alike.
    Null and empty keywords and bodies match nothing."""
    spark, blocks, held = bodies.sparkSession, [], []
    for row in keywords.where("area is not null and keyword <> ''").select("area", "keyword").distinct().toLocalIterator():
        held.append((row.area, row.keyword))
        if len(held) == BLOCK:
            blocks.append(held)
            held = []
    if held:
        blocks.append(held)

    def part(block: list[tuple[str, str]]) -> DataFrame:
        known = spark.sparkContext.broadcast(block)

        def run(it):
            automaton = automaton_of(known.value)
            for batch in it:
                ids, areas = [], []
                for node, body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist()):
                    mine = areas_in(body, automaton, whole_words) if body else ()
                    ids.extend([node] * len(mine))
                    areas.extend(sorted(mine))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(areas, pa.string())], names=["id", "area"])

        return bodies.select("id", "body").mapInArrow(run, "id string, area string")

    if not blocks:
        return spark.createDataFrame([], "id string, area string")
    parts = [part(block) for block in blocks]
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).distinct()
