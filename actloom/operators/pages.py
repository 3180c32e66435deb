"""Clean-up of paged texts: repeated headers and footers, page numbers, broken words and lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions import markers
from actloom.functions.text import normalize_text, prepare_pages, strip

EDGE = 6
STAMP = r"^\[[A-Z0-9_:-]{6,}\]$"
_STRUCTURAL = re.compile("|".join(f"(?:{p})" for p in (markers.HEADING, markers.TEXTUAL_MARKER, markers.DECIMAL, markers.BRACKET, markers.LETTER, markers.LIST_ITEM)), re.IGNORECASE)
_GOES_ON = re.compile(r"^[a-zа-яё(\[«\"']")


def page_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_no, line_no, from_end, line): the lines of the pages of each text that are not blank.
    Empty pages have no number."""
    filled = F.filter(F.split(prepare_pages(F.col(text)), "\f"), lambda x: F.length(strip(x)) > 0)
    pages = df.where(F.col(text).isNotNull()).select(key, F.posexplode(filled).alias("page_no", "page"))
    lines = F.filter(F.transform(F.split("page", "\n"), lambda x: strip(x)), lambda x: F.length(x) > 0)
    return pages.select(key, "page_no", lines.alias("_l")).select(key, "page_no", F.size("_l").alias("_n"), F.posexplode("_l").alias("line_no", "line")).select(key, "page_no", "line_no", (F.col("_n") - F.col("line_no")).alias("from_end"), "line")


def repeated_edges(lines: DataFrame, key: str) -> DataFrame:
    """B04. (key, edge, line, n_pages): lines that stand near the same edge of two pages or more."""
    edges = F.explode(F.array_compact(F.array(F.when(F.col("line_no") < EDGE, "top"), F.when(F.col("from_end") <= EDGE, "bottom"))))
    near = lines.where((F.length("line") >= 3) & (F.length("line") <= 160) & ~F.col("line").rlike(STAMP)).select(key, "page_no", "line", edges.alias("edge"))
    return near.groupBy(key, "edge", "line").agg(F.countDistinct("page_no").alias("n_pages")).where("n_pages >= 2")


def without_noise(lines: DataFrame, key: str) -> DataFrame:
    """B05. lines without stamps, repeated edge lines near their edge, and page numbers."""
    edges = repeated_edges(lines, key)
    number = F.col("line").rlike(r"(?iu)^(?:(?:стр(?:аница)?\.?|page|p\.)\s*)?[0-9]+$") & (F.regexp_extract("line", r"([0-9]+)$", 1).cast("int") == F.col("page_no") + 1)
    near = (F.col("line_no") < EDGE) | (F.col("from_end") <= EDGE)
    kept = lines.where(~F.col("line").rlike(STAMP) & ~(near & F.coalesce(number, F.lit(False))))
    for edge, there in (("top", F.col("line_no") < EDGE), ("bottom", F.col("from_end") <= EDGE)):
        drop = edges.where(F.col("edge") == edge).select(key, "line", F.lit(True).alias("_drop"))
        kept = kept.join(drop, [key, "line"], "left").where(~(there & F.coalesce("_drop", F.lit(False)))).drop("_drop")
    return kept


def dehyphenate(c: Column) -> Column:
    """B06. A word broken by a hyphen at a line's end, put together."""
    return F.regexp_replace(c, r"(?<=[\p{L}\p{N}])-\n(?=\p{Ll})", "")


def unwrap(text: str) -> str:
    """B07. Lines that go on with the one before, joined to it."""
    out: list[str] = []
    for line in (x.strip() for x in text.split("\n")):
        last = out[-1] if out else ""
        if not line:
            if last:
                out.append("")
        elif last and not _STRUCTURAL.match(line) and _GOES_ON.match(line) and not last.endswith((".", ";", "!", "?", "-")) and (len(last) >= 35 or last.endswith((",", ":", "(", "/"))):
            out[-1] = f"{last} {line}"
        else:
            out.append(line)
    return "\n".join(out)


def clean_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """B03. (key, normalized_text): noise dropped, pages joined, words and lines put together."""
    kept = without_noise(page_lines(df, key, text), key)
    joined = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "line"))), lambda x: x["line"]), "\n").alias("_t"))

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_t=[unwrap(t) for t in pdf["_t"]])

    kinds = dict(df.dtypes)
    whole = joined.select(key, dehyphenate(F.col("_t")).alias("_t")).mapInPandas(lines_of, f"`{key}` {kinds[key]}, _t string")
    return whole.select(key, normalize_text(F.col("_t")).alias("normalized_text"))
