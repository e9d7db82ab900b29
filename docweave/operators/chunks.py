"""Sections packed into chunks: by structure, then by sentences, never inside a sentence.

The packing is a fold over offsets: its state is the ranges of the open chunk, and no text is copied before a chunk
is finished.  Ranges meet the section's lines by the running sums of their lengths, so a chunk has spans of its own.  It runs on the
rows of a task as they are, without a shuffle.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.intake import spans_key
from docweave.functions.text import normalise, stable_id

from .segment import SPAN

CHUNKING = "chunk-1.0"
#: Characters up to which fragments are packed, and beyond which one is cut into sentences.
TARGET, CAP = 800, 1200
#: How a paragraph or a point starts, and where sentences end.
MARK = r"^(?:\d+|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\([一二三四五六七八九十]+\))"
ENDS = "。！？；"


#: Unicode white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
Range = tuple[int, int]


class Packer:
    """Cuts texts into chunks, each a list of ranges whose texts end to end are the chunk."""

    def __init__(self, mark: str = MARK, ends: str = ENDS):
        self.mark = re.compile(f"^[{SPACE}]*" + mark.removeprefix("^"))
        self.sentence = re.compile(f"[^{ends}]*[{ends}]|[^{ends}]+")
        self.said = re.compile(f"[^{SPACE}]")

    def __call__(self, text: str) -> list[list[Range]]:
        """The text itself up to TARGET characters; else its fragments packed, sentences of those beyond CAP.

        A sentence beyond CAP stays whole.  A blank open chunk stays open across a long fragment.
        """
        if len(text) <= TARGET:
            return [[(0, len(text))]]
        out: list[list[Range]] = []
        kept: list[Range] = []
        for a, b in self._fragments(text):
            if b - a > CAP:
                kept = self._closed(text, kept, out)
                out += self._sentences(text, a, b)
            elif self._size(kept) + b - a > TARGET and self._any(text, kept):
                out.append(kept)
                kept = [(a, b)]
            else:
                kept = self._below(kept, (a, b)) if self._size(kept) else [(a, b)]
        self._closed(text, kept, out)
        return out

    def _fragments(self, text: str) -> list[Range]:
        """Lines in groups: each line that starts a paragraph opens one."""
        starts, at = [0], 0
        for line in text.split("\n"):
            if at and self.mark.search(line):
                starts.append(at)
            at += len(line) + 1
        return [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(text) + 1], strict=True)]

    def _sentences(self, text: str, a: int, b: int) -> list[list[Range]]:
        """The sentences of a range packed; blank ones are left out."""
        out: list[list[Range]] = []
        kept: list[Range] = []
        for m in self.sentence.finditer(text, a, b):
            if not self.said.search(text, m.start(), m.end()):
                continue
            if self._size(kept) + m.end() - m.start() > TARGET and self._any(text, kept):
                out.append(kept)
                kept = []
            kept = self._with(kept, m.span())
        self._closed(text, kept, out)
        return out

    def _with(self, kept: list[Range], more: Range) -> list[Range]:
        """The ranges with one more right behind them."""
        a, b = more
        if kept and kept[-1][1] == a:
            return [*kept[:-1], (kept[-1][0], b)]
        return [*kept, (a, b)]

    def _below(self, kept: list[Range], more: Range) -> list[Range]:
        """The ranges with one more and a line end before it, the one that stands behind the open chunk."""
        x, y = kept[-1]
        return self._with([*kept[:-1], (x, y + 1)], more)

    def _size(self, kept: list[Range]) -> int:
        return sum(b - a for a, b in kept)

    def _any(self, text: str, kept: list[Range]) -> bool:
        return any(self.said.search(text, a, b) for a, b in kept)

    def _closed(self, text: str, kept: list[Range], out: list[list[Range]]) -> list[Range]:
        """What stays open once a chunk is finished: nothing, unless it is blank."""
        if self._any(text, kept):
            out.append(kept)
            return []
        return kept


def own_spans(ranges: list[Range], lengths: list[int]) -> list[tuple[int, int, int, bool]]:
    """(line, start, end, new) of ranges over lines of such lengths joined by line ends; new: a line end stands before the part."""
    starts = [0, *accumulate(n + 1 for n in lengths)]
    out = []
    for a, b in ranges:
        k, new = bisect_right(starts, a) - 1, False
        while True:
            end = min(b - starts[k], lengths[k])
            out.append((k, a - starts[k], end, new))
            if b <= starts[k] + lengths[k]:
                break
            k, new = k + 1, True
            a = starts[k]
    return out


#: Rows cut at once: pieces and their parts are Python objects, many times the size of the text.
ROWS = 64
PIECE = "array<struct<piece:string,parts:array<struct<line:int,start:int,end:int,new:boolean>>>>"
_PART = pa.struct([("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("new", pa.bool_())])
_PIECES = pa.list_(pa.struct([("piece", pa.string()), ("parts", pa.list_(_PART))]))


def pieces(rows: DataFrame, text: str = "text", mark: str = MARK, ends: str = ENDS) -> DataFrame:
    """rows with chunk_no from 0, piece, and parts: where the piece stands in the lines of the text.  Rows without a text have none."""

    known = {c.lower() for c in rows.columns}
    all_, one = (next(n for n in (name + "_" * k for k in range(len(known) + 1)) if n not in known) for name in ("made", "one"))

    def run(batches):
        pack = Packer(mark, ends)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, out = whole.slice(at, ROWS), []
                for t in batch.column(text).to_pylist():
                    lengths = list(map(len, t.split("\n"))) if t is not None else []
                    out.append(None if t is None else [{"piece": "".join(t[a:b] for a, b in r), "parts": [dict(zip(("line", "start", "end", "new"), p, strict=True)) for p in own_spans(r, lengths)]} for r in pack(t)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _PIECES)], [*batch.schema.names, all_])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    made = rows.mapInArrow(run, f"{schema}, {all_} {PIECE}")
    return made.select("*", F.posexplode(all_).alias("chunk_no", one)).select(*rows.columns, "chunk_no", f"{one}.piece", f"{one}.parts")


def make_chunks(sections: DataFrame, mark: str = MARK, ends: str = ENDS) -> DataFrame:
    """The chunks of sections(section_id, document_id, section_type, quote_text, source_spans).

    The past outcome of decisions is no search text: such chunks are flagged and not eligible.  Every
    chunk has the spans of its section, its own place among the section's chunks, and own_spans: the parts of lines that it is made of,
    each with `new`, whether a line end stands before it, so the quote is rebuilt from them exactly.
    """
    rows = pieces(sections.select("section_id", "document_id", "section_type", "quote_text", "source_spans"), "quote_text", mark, ends)
    excluded = F.col("section_type") == "decision_main_text"
    n = F.length("piece")
    flags = F.array_compact(F.array(F.when(excluded, "historical_outcome_excluded"), F.when(n > CAP, "oversize_atomic")))
    key = F.concat(spans_key(F.col("source_spans"), list(SPAN)), F.lit("|"), F.col("chunk_no").cast("string"))
    chunk_id = stable_id("chk_", F.col("section_id"), F.lit(CHUNKING), key, F.sha2("piece", 256))

    def own(p):
        line = F.get("source_spans", p["line"])
        moved = line.withField("char_start", line["char_start"] + p["start"]).withField("char_end", line["char_start"] + p["end"])
        return moved.withField("new", p["new"])

    return rows.select(
        chunk_id.alias("chunk_id"), "section_id", "document_id", F.col("piece").alias("quote_text"), normalise(F.col("piece")).alias("search_text"), "source_spans", F.transform("parts", own).alias("own_spans"), "chunk_no",
        F.array().cast("array<string>").alias("context_section_ids"), (~excluded).alias("index_eligible"), flags.alias("quality_flags"), n.alias("char_count"),
    )


def rebuilt(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """(chunk_id, text): chunks put together from their own_spans and lines(document_id, page, line, text); null where a line is missing."""
    at = chunks.select("chunk_id", F.posexplode("own_spans").alias("k", "s")).select("chunk_id", "k", "s.*")
    met = at.join(lines.select("document_id", "page", "line", "text"), ["document_id", "page", "line"], "left")
    part = F.concat(F.when(F.col("new"), "\n").otherwise(""), F.expr("substring(text, char_start + 1, char_end - char_start)"))
    parts = met.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("k", part.alias("part")))).alias("p"), F.count_if(F.col("text").isNull()).alias("lost"))
    return parts.select("chunk_id", F.when(F.col("lost") == 0, F.array_join(F.transform("p", lambda x: x["part"]), "")).alias("text"))
