"""Pages and lines of files, by an extractor that is a plain function of a file's bytes.

An extractor returns pages: (width, height, rotation, lines), each line (text, x0, y0, x1, y1).  `plain` reads
UTF-8 text with form feeds between pages; one for PDF can be passed where a library for it is installed.
"""
from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = pa.struct([("line", pa.int32()), ("text", pa.string()), ("bbox", pa.list_(pa.float64())), ("char_start", pa.int32()), ("char_end", pa.int32())])
PAGES = "path string, page int, width double, height double, rotation int, raw_text string, lines array<struct<line:int,text:string,bbox:array<double>,char_start:int,char_end:int>>, error string"


def plain(content: bytes) -> list:
    """Pages of a text file; a line's box is its column and row."""
    pages = content.decode("utf-8").split("\f")
    return [(0.0, 0.0, 0, [(t, 0.0, float(i), float(len(t)), i + 1.0) for i, t in enumerate(p.split("\n"))]) for p in pages]


def pages(found: DataFrame, extractor: Callable[[bytes], list] = plain) -> DataFrame:
    """Rows of PAGES for found(path, content): numbered pages, and their lines that are not empty, numbered from 1.

    A file that the extractor fails on is one row with the error and no page; the others go on.
    """
    names = [c.split()[0] for c in ("path s", "page s", "width s", "height s", "rotation s", "raw_text s", "lines s", "error s")]
    types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.list_(LINE), pa.string()]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows = []
                    for n, (width, height, rotation, lines) in enumerate(extractor(content.as_py()), 1):
                        kept = [x for x in lines if x[0].strip()]
                        boxed = [{"line": k, "text": t, "bbox": [round(v, 2) for v in box], "char_start": 0, "char_end": len(t)} for k, (t, *box) in enumerate(kept, 1)]
                        rows.append((path, n, width, height, rotation, "\n".join(x[0] for x in kept), boxed, None))
                except Exception as e:  # a file of any kind of damage; it is reported in its row
                    rows = [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)

    return found.select("path", "content").mapInArrow(run, PAGES)


def lines(paged: DataFrame, key: str = "path") -> DataFrame:
    """(key, idx, page, line, text, char_start, char_end): all lines of a document, numbered from 0 over its pages."""
    rows = paged.where("error is null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "lines"))).alias("all"))
    flat = F.flatten(F.transform("all", lambda p: F.transform(p["lines"], lambda x: F.struct(p["page"].alias("page"), x["line"].alias("line"), x["text"].alias("text"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end")))))
    return rows.select(key, F.posexplode(flat).alias("idx", "x")).select(key, "idx", "x.*")
