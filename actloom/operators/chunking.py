"""Cutting of normalised texts into structural fragments.

`line_context` gives the carry-forward of headings as windows, for questions about lines.
`chunk_documents` runs a small state machine over the lines of each text where it is read: the
thresholds on what has been gathered so far make it order-dependent, and this way a corpus is
chunked without a single shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actloom.functions import markers
from actloom.functions.text import strip

LONGEST, SOFT, SHORT = 2200, 1400, 80
CHUNKS = (
    "chunk_index int, fragment_type string, structure_level int, raw_label string, canonical_label string, "
    "path_key string, heading string, section_path string, text string, text_hash string"
)
#: How the kinds are called in labels.
TITLES = {"section": "Раздел", "chapter": "Глава", "article": "Статья", "point": "Пункт", "subpoint": "Подпункт", "paragraph": "Абзац"}
OUTER = ("section", "chapter", "article")

_HEADING, _TEXTUAL, _DECIMAL, _BRACKET, _LETTER, _ITEM = (
    re.compile(p, re.IGNORECASE) for p in (markers.HEADING, markers.TEXTUAL_MARKER, markers.DECIMAL, markers.BRACKET, markers.LETTER, markers.LIST_ITEM)
)
_BLANK = re.compile(r"\n\s*\n")


@dataclass(frozen=True)
class Label:
    kind: str
    raw: str
    name: str
    shown: str
    path: str


@dataclass
class Fragment:
    label: Label
    heading: str
    section_path: str
    path_key: str
    lines: list[str]

    def size(self) -> int:
        return len("\n".join(x for x in self.lines if x.strip()).strip())


def _path(value: str) -> str:
    value = re.sub(r"[^\w.]+", "-", value.lower().replace("№", "no"))
    return re.sub(r"-+", "-", value).strip("-.")


def _label(kind: str, number: str, raw: str | None = None, title: str = "") -> Label:
    name = f"{TITLES[kind]} {number}".strip()
    title = title.strip()
    return Label(kind, name if raw is None else raw, name, f"{name}: {title}" if title else name, f"{kind}:{_path(number)}")


def _special(kind: str, index: int) -> Label:
    name, path = {"title": ("Заголовок документа", "title"), "preamble": (f"Преамбула {index}", f"preamble:{index}"), "fallback_block": (f"Fallback block {index}", f"fallback:{index}"), "paragraph": (f"Абзац {index}", f"paragraph:{index}")}[kind]
    return Label(kind, name, name, name, path)


def _marker(line: str, in_point: bool) -> tuple[Label, str] | None:
    if m := _TEXTUAL.match(line):
        return _label(markers.TEXTUAL[m[1].lower()], m[2]), m[3]
    if m := _DECIMAL.match(line):
        return _label("subpoint" if "." in m[1] else "point", m[1], m[1] + "."), m[2]
    if m := _BRACKET.match(line):
        return _label("subpoint" if in_point else "point", m[1], m[1] + ")"), m[2]
    if m := _LETTER.match(line):
        return _label("subpoint", m[1].lower(), m[1].lower() + ")"), m[2]
    return None


class Parser:
    """The open headings, the open fragment and the finished ones of one text."""

    def __init__(self) -> None:
        self.outer: dict[str, Label] = {}
        self.point: Label | None = None
        self.open: Fragment | None = None
        self.done: list[Fragment] = []
        self.leading: list[str] = []
        self.structured = False

    def close(self) -> None:
        if self.open and self.open.size():
            self.done.append(self.open)
        self.open = None

    def structure(self) -> None:
        """A heading or marker begins: what stood before the first one is title and preamble."""
        self.close()
        self.structured = True
        self.lead()

    def lead(self) -> None:
        blocks = [b.strip() for b in _BLANK.split("\n".join(self.leading)) if b.strip()]
        self.leading = []
        titled = bool(blocks) and self.structured and title_like(blocks[0])
        for i, block in enumerate(blocks):
            label = _special("title", 1) if titled and i == 0 else _special("preamble", i + 1 - titled)
            self.done.append(Fragment(label, label.shown, label.shown, label.path, [block]))

    def begin(self, label: Label, point: Label | None) -> Fragment:
        context = [self.outer[k] for k in OUTER if k in self.outer]
        if label.kind in OUTER:
            return Fragment(label, context[-1].shown, " > ".join(x.shown for x in context), "/".join(x.path for x in context), [])
        shown = [x.shown for x in context] + ([point.name] if point else []) + [label.name]
        paths = [x.path for x in context] + ([point.path] if point else []) + [label.path]
        article = self.outer.get("article")
        if label.kind == "subpoint":
            heading = " · ".join([x for x in (article and article.shown, point and point.name, label.name) if x])
        elif article:
            heading = f"{article.shown} · {label.name}"
        else:
            near = point or (context[-1] if context else None)
            heading = f"{near.shown} · {label.name}" if near else label.shown
        return Fragment(label, heading, " > ".join(shown), "/".join(paths), [])

    def feed(self, line: str) -> None:
        bare = line.strip()
        if not bare:
            if self.open:
                self.open.lines.append("")
            elif not self.structured:
                self.leading.append("")
        elif m := _HEADING.match(bare):
            self.structure()
            kind = markers.HEADINGS[m[1].lower()]
            for inner in OUTER[OUTER.index(kind) :]:
                self.outer.pop(inner, None)
            self.point = None
            self.outer[kind] = _label(kind, m[2], title=m[3])
        elif found := _marker(bare, self.point is not None):
            self.structure()
            label, rest = found
            if label.kind == "point":
                self.point = label
            self.open = self.begin(label, None if label.kind == "point" else self.point)
            self.open.lines = [rest.strip()] if rest.strip() else []
        elif not self.structured:
            self.leading.append(line)
        else:
            if self.open is None:
                inner = next((self.outer[k] for k in reversed(OUTER) if k in self.outer), None)
                self.open = self.begin(inner or _special("paragraph", 1), None)
            self.open.lines.append(line)
            if self.open.label.kind in OUTER and _ITEM.match(bare.lower()) and self.open.size() >= SOFT:
                self.close()


def title_like(block: str) -> bool:
    lines = [x for x in block.splitlines() if x.strip()]
    return 0 < len(lines) <= 3 and len(block) <= 220 and not (block.endswith((".", ";", ":")) and len(block) > 120)


def pack(parts: list[str], joint: str, longest: int) -> list[str]:
    """C09. Neighbours joined while they fit; a part that is too long by itself stays whole."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(joint) + len(part) <= longest:
            out[-1] += joint + part
        else:
            out.append(part)
    return out


def pieces(text: str, longest: int = LONGEST) -> list[str]:
    text = text.strip()
    if len(text) <= longest:
        return [text] if text else []
    blocks = [b.strip() for b in _BLANK.split(text) if b.strip()]
    if len(blocks) > 1:
        return pack(blocks, "\n\n", longest)
    return pack([x.strip() for x in text.split("\n") if x.strip()], "\n", longest)


def fallback(text: str, short: int = SHORT) -> list[Fragment]:
    """C11. Blank-line blocks; a short one is joined to the one before."""
    out: list[Fragment] = []
    for block in (b.strip() for b in _BLANK.split(text)):
        if block and len(block) < short and out:
            out[-1].lines.append("\n" + block)
        elif block:
            label = _special("fallback_block", len(out) + 1)
            out.append(Fragment(label, label.shown, label.shown, label.path, [block]))
    return out


def chunk(text: str) -> list[tuple]:
    """C01. The chunks of one normalised text, in the order of CHUNKS. Null, empty and blank texts have none."""
    parser = Parser()
    for line in text.split("\n"):
        parser.feed(line.rstrip())
    parser.lead()
    parser.close()
    structured = parser.structured and parser.done
    out = []
    for f in parser.done if structured else fallback(text):
        body = "\n".join(x for x in f.lines if x.strip()) if structured else "\n".join(f.lines)
        parts = pieces(body) if structured or len(f.lines) == 1 else [body.strip()]
        for k, part in enumerate(parts, 1):
            more = len(parts) > 1
            tail = f" (часть {k})" if more else ""
            out.append((len(out) + 1, f.label.kind, markers.LEVELS[f.label.kind], f.label.raw, f.label.name + tail, f.path_key + (f"#part-{k}" if more else ""), f.heading + tail, f.section_path, part, hashlib.sha256(part.encode()).hexdigest()))
    return out


def paragraphs(text: str) -> list[tuple]:
    """C14. Baseline: blank-line blocks."""
    return [(i, "paragraph", 6, "", f"Абзац {i}", f"paragraph:{i}", "", "", b, hashlib.sha256(b.encode()).hexdigest()) for i, b in enumerate((b.strip() for b in _BLANK.split(text) if b.strip()), 1)]


def headed(text: str) -> list[tuple]:
    """C15. Baseline: a line with a heading or number begins a chunk; letters do not."""
    groups: list[list[str]] = []
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        if not groups or _HEADING.match(line) or _TEXTUAL.match(line) or _DECIMAL.match(line) or _BRACKET.match(line):
            groups.append([])
        groups[-1].append(line)
    return [(i, "paragraph", 6, "", g[0], f"heading:{i}", g[0], "", b := "\n".join(g), hashlib.sha256(b.encode()).hexdigest()) for i, g in enumerate(groups, 1)]


def chunk_documents(df: DataFrame, keys: list[str], text: str, cut: Callable[[str], list[tuple]] = chunk) -> DataFrame:
    """Keys and CHUNKS for every row of df. Rows with null or blank text have none; nothing is shuffled."""
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.length(strip(F.col("_text"))) > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", " + CHUNKS
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int32() if c.endswith("int") else pa.string() for c in CHUNKS.split(", ")]

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found = [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                one = cut(t)
                take.extend([i] * len(one))
                found.extend(one)
            columns = [batch.column(k).take(pa.array(take, pa.int64())) for k in keys]
            columns += [pa.array([r[j] for r in found], kinds[j]) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

    return rows.mapInArrow(cut_all, schema)


def line_context(df: DataFrame, key: str, text: str) -> DataFrame:
    """C02-C04. (key, line_no, line, kind, section, chapter, article, point): each line with the
    headings it stands under. An outer heading ends the inner ones; a bracketed number is a point
    where no point is open. One shuffle, on key; a text is the unit of the windows."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", strip(F.col("line"))).withColumn("_kind", markers.line_kind(F.col("line")))
    w = Window.partitionBy(key).orderBy("line_no")
    at = lambda name: F.max(F.when(F.col("_kind") == name, F.col("line_no"))).over(w)
    lines = lines.withColumns({f"_{k}": at(k) for k in OUTER})
    opened = lambda k, *above: F.when(F.col(f"_{k}") > F.coalesce(F.greatest(*[F.coalesce(F.col(f"_{a}"), F.lit(-1)) for a in (*above, above[0])]), F.lit(-1)), F.col(f"_{k}"))
    lines = lines.withColumns({"section_line": F.col("_section"), "chapter_line": opened("chapter", "section"), "article_line": opened("article", "section", "chapter")})
    reset = F.greatest(*[F.coalesce(F.col(f"_{k}"), F.lit(-1)) for k in OUTER])
    lines = lines.withColumn("_reset", reset)
    inner = Window.partitionBy(key, "_reset").orderBy("line_no")
    pointed = F.max(F.when(F.col("_kind").isin("point", "bracket"), 1)).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(F.col("_kind") != "bracket", F.col("_kind")).when(pointed == 1, "subpoint").otherwise("point")
    lines = lines.withColumn("kind", kind)
    point = F.max(F.when(F.col("kind") == "point", F.col("line_no"))).over(inner)
    return lines.withColumn("point_line", point).select(key, "line_no", "line", "kind", "section_line", "chapter_line", "article_line", "point_line")
