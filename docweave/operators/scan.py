"""Very many names looked for in texts at once, by an automaton that each task builds of them once.

The cost of a text is its length and its hits, not the number of names.
"""
from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names up to so many are sent to every task.
NAMES = 1_000_000


@lru_cache(2)
def _automaton(names: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    if names:
        made.make_automaton()
    return made


def sent(names: DataFrame) -> Broadcast:
    """The distinct names(name) that are not empty, sent to the tasks; more than NAMES are refused."""
    some = names.where("name <> ''").select("name").distinct().limit(NAMES + 1).collect()
    if len(some) > NAMES:
        raise ValueError(f"more than {NAMES} names")
    return names.sparkSession.sparkContext.broadcast(tuple(sorted(r.name for r in some)))


def names_in(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, n): which of names(name) a text contains and how often, overlapping ones included.  Null texts contain none."""
    given = sent(names)

    def run(batches):
        for batch in batches:
            keys, found, counts = [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                seen: dict[str, int] = {}
                for _, name in _automaton(given.value).iter(t) if given.value and t else ():
                    seen[name] = seen.get(name, 0) + 1
                keys += [i] * len(seen)
                found += seen
                counts += seen.values()
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(keys, pa.int64())), pa.array(found, pa.string()), pa.array(counts, pa.int64())], [key, "name", "n"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, name string, n long")


def followed(text: str, automaton, then: re.Pattern) -> list[str]:
    """The parts of a text that are a name with a match of `then` right behind it, from left to right, the longest name first, none twice."""
    starts: dict[int, list[int]] = {}
    for end, name in automaton.iter(text):
        starts.setdefault(end + 1 - len(name), []).append(end + 1)
    out, free = [], 0
    for start in sorted(starts):
        if start < free:
            continue
        for end in sorted(starts[start], reverse=True):
            m = then.match(text, end)
            if m:
                out.append(text[start : m.end()])
                free = m.end()
                break
    return out


def followed_names(rows: DataFrame, names: DataFrame, then: str, text: str = "text") -> DataFrame:
    """rows with `raw`, one for each name in the text that a match of the pattern `then` follows."""
    given = sent(names)

    def run(batches):
        pattern = re.compile(then)
        for batch in batches:
            found = [followed(t, _automaton(given.value), pattern) if given.value and t else [] for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.string()))], ["row", "raws"])

    kind = rows.schema.simpleString()
    made = rows.select(F.struct(*rows.columns).alias("row"), F.col(text).alias("t")).mapInArrow(run, f"row {kind}, raws array<string>")
    return made.select("row.*", F.explode("raws").alias("raw"))
