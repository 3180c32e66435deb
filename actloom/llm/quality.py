"""Per-document text statistics, and telling prose from lists, tables and junk.

Each line is given a kind by its layout: a delimiter that stands as often in the lines around it
and columns of blanks that stand under one another (vertical alignment), marks and indentation
that come back line after line or level after level (indentation periodicity), and line classes
and lengths that repeat with a period (autocorrelation). The share of the characters in lines of each kind,
together with the ratios of words, symbols, punctuation and common words, decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = "n_words bigint, mean_word_length double, symbol_share double, punctuated_line_share double, common_word_share double, text_kind string"

#: Accents, vowel signs and characters without width belong to the word they stand in.
MARKS = "\u00ad\u0300-\u036f\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u180e\u200b-\u200f\u2060\u3099\ufeff"
WORD = re.compile(rf"[^\W_][^\W_{MARKS}]*(?:[{MARKS}]+[^\W_]*)*")
SYMBOL = re.compile(rf"[^{MARKS}\w\s.,;:!?…。！？、，；：।॥؟،؛\"'«»“”„‘’「」『』()\[\]（）\-–—№%/]")
LINE_MARKS = frozenset(".!?…。！？।॥؟;:；：，,、")
LINE_CLOSERS = "\"'»”“』」)）"
SENTENCE_END = re.compile(r"[.!?…。！？।॥؟](?=[\"'»”“』」)）\]\s]|$)|[。！？।]")
MARKED = re.compile(r"(?:[-–—*•·▪◦●○■□‣➢►✓+]|\(?(?:\d{1,4}(?:\.\d{1,3}){0,4}|[^\W\d_]|[ivxlcIVXLC]{1,6})[.)])[ \t]+(?=\S)|[•·▪◦●■‣]")
LEADER = re.compile(r"(?:\.{3,}|(?:\. ){3,}|_{3,}|·{3,})\s*\d*\s*$|…{2,}\s*\d+$|\s{2,}\d{1,4}$|[^\W\d_],\s*\d{1,4}(?:[-–, ]+\d{1,4})*$")
RULE = re.compile(r"[\s\-+=|_:~*#.─━│┃┼├┤┬┴┌┐└┘╔╗╚╝═║╠╣╦╩╬]+$")
HTML_CELL = re.compile(r"</?t[dhr]\b", re.I)
WIDE_GAP = re.compile(r"(?<=\S)[  ]{2,}(?=\S)")
HEX = re.compile(r"(?:[0-9a-fA-F]{2}[\s:]?){8,}$")
HEX_DUMP = re.compile(r"^[0-9a-fA-F]{4,}[:\s]\s*(?:[0-9a-fA-F]{2,4}\s+){4,}")
DIGITS, NO_DIGITS = re.compile(r"\d+"), re.compile(r"\D{8}")
JSON_KEY = re.compile(r"\"[^\"]{1,40}\":\s*(?:[\"\d\[{]|true|false|null|-)")
BRACKETS = re.compile(r"[{}\[\],;\s]+$")
CODE = re.compile(r"(?:\bfunction\b|\bvar\b|=>|\);|\{\s*$|^\s*\}|</?(?:div|span|a|li|ul|script|p|br|img|nav)\b|&(?:amp|quot|nbsp|lt|gt);|https?://|%[23][0-9A-F]%)")
CODE_SIGNS = ("{", "}", "<", "=>", ");", "http", "function", "var", "%2", "%3", "amp;", "quot;", "nbsp;", "&lt;", "&gt;")  # one is in any text with two matches of CODE
LONG_TOKEN = re.compile(r"[A-Za-z0-9+/=_\-]{28,}")
CRUMB = re.compile(r"(?<=\S)[ \t]+(?:>+|»|›|/|\||·|•|::|<+)(?=\s|$)")
LATIN1 = re.compile("[\u0080-\u009f¡-¿ÂÃÐÑ�]")
DOUBLE_READ = re.compile("(?<=[^\\W\\d_])[ђѓќћљњџ‹›€†‡‰™®©¬µ¶·¤¦§¨±¸¹»¼½¾¿ґЃЉЊЌЋЏ°№\u0080-\u009f](?=[^\\W\\d_])")
LAYOUT = re.compile(r"</?t[dhr][^>]*>|[|│¦]|[-–—=+_─━]{3,}|\.{3,}|(?:\. ){3,}|·{3,}|…{2,}")
DIGIT_CELL = re.compile(r"^[\s\d.,:/%\-–—€$₽]*$|^(?:n/?a|н/д|k\.?A\.?|s\.o\.|—|-)$", re.I)


@dataclass(frozen=True)
class CommonWords:
    """Common words by language: as words for scripts with spaces, as substrings for those without."""

    by_lang: Mapping[str, frozenset[str]]
    unspaced: Mapping[str, tuple[str, ...]]

    @classmethod
    def of(cls, rows: list[tuple[str, str]], unspaced: tuple[str, ...] = ("zh", "ja", "th")) -> CommonWords:
        langs: dict[str, set[str]] = {}
        for lang, word in rows:
            if lang and word:
                langs.setdefault(lang.lower(), set()).add(word.lower())
        return cls({k: frozenset(v) for k, v in langs.items() if k not in unspaced}, {k: tuple(sorted(v)) for k, v in langs.items() if k in unspaced})

    def share(self, low: str, words: Counter[str], n_words: int, letters: int) -> float:
        """The largest share that any language's common words have in the text."""
        best = 0.0
        if n_words:
            for common in self.by_lang.values():
                best = max(best, sum(words[w] for w in common if w in words) / n_words)
        if letters and not low.isascii():
            for common in self.unspaced.values():
                best = max(best, sum(low.count(w) * len(w) for w in common) / letters)
        return min(best, 1.0)


def period(flags: np.ndarray, most: int = 12) -> float:
    """The largest autocorrelation of a 0/1 or length series at a lag of 2 to `most`."""
    n = len(flags)
    x = flags - flags.mean()
    power = float(x @ x)
    if n < 8 or power <= 1e-9:
        return 0.0
    return max((float(x[:-k] @ x[k:]) / power * n / (n - k) for k in range(2, min(most, n // 3) + 1)), default=0.0)


def returns(series: np.ndarray, least: float) -> bool:
    """Whether a series has a period: an autocorrelation of `least` that is also beyond chance for its length."""
    return period(series) > max(least, 3 / np.sqrt(max(1, len(series))))


def columns(lengths: np.ndarray, most: int = 12) -> bool:
    """Whether lines come as rows of cells: lengths with a period, and alike in each place of it."""
    n = len(lengths)
    if not returns(lengths, 0.5):
        return False
    spread = lengths.var() * n / (n - 1)
    for k in range(2, min(most, n // 4) + 1):
        within = sum(float(((c := lengths[i::k]) - c.mean()) @ (c - c.mean())) for i in range(k)) / (n - k)
        if within < 0.3 * spread:
            return True
    return False


def indent_widths(lines: list[str]) -> np.ndarray:
    return np.array([len(x) - len(x.lstrip()) for x in (x.expandtabs(4) for x in lines)], float)


def nested(widths: np.ndarray) -> bool:
    """Whether indentation comes back: with a period, or at least three times to its least width."""
    deep = widths > widths.min()
    return returns(widths, 0.35) or int(np.sum(deep[:-1] & ~deep[1:])) + bool(deep[-1]) >= 3


def delimiter_rows(lines: list[str]) -> list[bool]:
    """Lines in which a delimiter stands as often as in a line near by, or that are cells by mark-up."""
    n = len(lines)
    rows = [False] * n
    for mark, least in (("\t", 1), ("|", 2), (";", 2), (",", 3), ("│", 1), ("¦", 1), ("  ", 0)):
        if mark == "  ":
            continue
        counts = [x.count(mark) for x in lines]
        if sum(c >= least for c in counts) < 3:
            continue
        modes = Counter(c for c in counts if c >= least)
        for i, c in enumerate(counts):
            if c < least or rows[i]:
                continue
            near = modes[c] >= 3 and (modes[c] >= 0.3 * sum(modes.values()))
            if not near and mark in "\t|":
                near = True
            if near and mark in ";,":
                # a delimiter of cells stands mostly without a blank after it, in lines without sentences
                tight = len(re.findall(rf"{mark}(?=\S)|{mark}$", lines[i]))
                near = tight >= 0.6 * c and not lines[i].rstrip().endswith(".")
            rows[i] = rows[i] or near
    for i, x in enumerate(lines):
        if "<" in x and HTML_CELL.search(x):
            rows[i] = True
    return rows


def aligned_rows(lines: list[str]) -> list[bool]:
    """Lines with columns of blanks that begin or end under those of a line next to it."""
    edges = [{p for m in WIDE_GAP.finditer(x) for p in (m.end(), -m.start())} if "  " in x or "  " in x else set() for x in lines]
    out = [False] * len(lines)
    for i, e in enumerate(edges):
        if not e:
            continue
        for j in (i - 1, i + 1, i - 2, i + 2):
            if 0 <= j < len(lines) and edges[j] and len(e & edges[j]) >= 1 and (len(e) >= 4 or len(e & edges[j]) >= 1 and len(lines[i].split()) <= 12):
                out[i] = True
                break
    return out


def junk_lines(text: str, lines: list[str]) -> list[bool]:
    """Lines of dumps, codes and mark-up. What is in no line of the text is not looked for in each."""
    keyed, long, code = '":' in text, bool(LONG_TOKEN.search(text)), any(x in text for x in CODE_SIGNS) and len(CODE.findall(text)) >= 2

    def junk(x: str) -> bool:
        body = x.strip()
        n = len(body)
        if n >= 8 and (HEX.match(body) or HEX_DUMP.match(body)) and any(map(str.isdigit, body)):
            return True
        if keyed and JSON_KEY.search(body) or BRACKETS.match(body) or n >= 60 and " " not in body and body.isascii():
            return True
        # eight signs in a row that are no digits are more than the rest of a line of under 53 may hold
        if n >= 12 and not (n < 53 and NO_DIGITS.search(body)) and sum(map(len, DIGITS.findall(body))) > 0.85 * n:
            return True
        if long and (tokens := LONG_TOKEN.findall(body)) and sum(map(len, tokens)) > 0.5 * n and not set(body) <= set("-=_+ "):
            return True
        return code and n >= 15 and len(CODE.findall(body)) >= 2

    return [junk(x) for x in lines]


def classify(text: str, stats: tuple[int, float, float, float, float], words: Counter[str]) -> str:
    """prose, list, table or junk."""
    n_words, mean_length, symbols, punctuated, common = stats
    lines = [x for x in text.splitlines() if x.strip()]
    solid = len("".join(text.split()))
    if not lines or solid == 0:
        return "prose"
    # one thing over and over, or nothing that can be read
    if symbols > 0.08 or common < 0.1 or n_words < 12 or len(words) < 0.2 * n_words:
        bare = "".join(LAYOUT.sub("", text).split())
        if solid >= 20 and (not bare or Counter(bare).most_common(1)[0][1] > 0.5 * len(bare)):
            return "junk"
        symbols = len(SYMBOL.findall(bare)) / max(1, len(bare))
        if symbols > 0.25 and (common < 0.15 or mean_length < 2.2) or symbols > 0.4:
            return "junk"
        if not text.isascii() and (len(LATIN1.findall(bare)) > 0.2 * len(bare) or len(DOUBLE_READ.findall(bare)) > 0.04 * len(bare)):
            return "junk"
    if n_words >= 12 and words.most_common(1)[0][1] > 0.4 * n_words and len(words) <= max(3, 0.12 * n_words):
        return "junk"
    if len(lines) >= 5:
        line, times = Counter(x.strip() for x in lines).most_common(1)[0]
        if times > 0.5 * len(lines) and times * len(line) > 0.4 * solid and not RULE.match(line):
            return "junk"
    crumbs = len(CRUMB.findall(text)) if punctuated < 0.3 and len(words) < 0.6 * n_words else 0
    if n_words >= 8 and crumbs >= 0.35 * n_words and punctuated < 0.3 and crumbs >= 6 and len(words) < 0.6 * n_words and text.count("|") < 0.3 * crumbs + 2:
        return "junk"

    weight = [max(1, len(x.strip())) for x in lines]
    total = sum(weight)
    rows = [a or b for a, b in zip(delimiter_rows(lines), aligned_rows(lines))]
    if '":' in text:
        rows = [r and not JSON_KEY.search(x) for r, x in zip(rows, lines)]
    rule = [bool(RULE.match(x)) and len(x.strip()) >= 3 for x in lines]
    junk = [j and not r for j, r in zip(junk_lines(text, lines), rule)]
    ends = [len(SENTENCE_END.findall(x)) for x in lines]
    marked = [bool(MARKED.match(x.lstrip())) for x in lines]
    full = [len(x.strip()) >= (60 if "ก" <= x.strip()[-1] <= "๎" else 100) for x in lines]  # Thai sentences have no end mark
    items, unmarked = [], []
    for x, m, e, f in zip(lines, marked, ends, full):
        body = x.strip()
        leads = len(body) < 160 and (body[-1].isdigit() or body[-1] in "._…·") and bool(LEADER.search(body))
        closes = bool(SENTENCE_END.search(body[-3:])) and not leads
        inner = e - (1 if closes else 0) - (1 if m else 0)
        items.append((m and not f and inner <= 0 and not closes) or leads)
        unmarked.append(not m and len(body) < 70 and e == 0 and not closes)
    part = lambda flags: sum(w for w, f in zip(weight, flags) if f) / total
    table = part([r or (u and not j) for r, u, j in zip(rows, rule, junk)]) if any(rows) else 0.0
    if junk_share := part([j and not r for j, r in zip(junk, rows)]):
        if junk_share > 0.5:
            return "junk"
    if table > 0.5:
        return "table"
    letters = mean_length * n_words
    if solid >= 40 and letters < 0.45 * solid and common < 0.1 and table < 0.2 and part(items) < 0.3:
        return "junk"
    # cells that stand one to a line
    if len(lines) >= 9:
        numeric = np.array([1.0 if DIGIT_CELL.match(x.strip()) else 0.0 for x in lines])
        if 0.2 < numeric.mean() < 0.95 and sum(ends) <= 0.2 * len(lines) + sum(numeric) and max(weight) < 70 and (period(numeric) > 0.35 or numeric.mean() > 0.4):
            return "table"
    listed = part(items)
    if listed > 0.5:
        return "list"
    widths = indent_widths(lines)
    indented = len(lines) >= 6 and widths.any() and nested(widths)
    sizes = np.array([len(x.strip()) for x in lines], float)
    # cells of text that stand one to a line: as many lines to a row, of lengths that come back
    if len(lines) >= 12 and not indented and listed < 0.3 and max(weight) < 70 and sum(ends) <= 0.2 * len(lines) and columns(np.log(sizes)):
        return "table"
    # items without marks on levels of indentation that come back, longer than lines without levels may be
    if indented and max(weight) < 160 and sum(ends) < 0.25 * len(lines) and part([i or not m and e == 0 for i, m, e in zip(items, marked, ends)]) > 0.6:
        return "list"
    # items without marks: short lines, no sentences, and not the broken lines of a paragraph
    if len(lines) >= 4:
        loose = [u or i for u, i in zip(unmarked, items)]
        if part(loose) > 0.6 and sum(loose) >= 0.7 * len(lines):
            wrapped = sizes[:-1].min() > 0.75 * sizes.max() if len(sizes) > 2 else False
            starts = np.mean([x.strip()[:1].isupper() or not x.strip()[:1].islower() for x in lines])
            if not wrapped and (common < 0.3 or starts > 0.3) and sum(ends) < 0.25 * len(lines):
                return "list"
    if len(lines) == 1 and n_words >= 15:  # items in one line
        cells = [c for c in re.split(r"[;•|]|,\s|\s[-–]\s", text) if c.strip()]
        if len(cells) >= 8 and sum(ends) <= 1 and np.mean([len(c) for c in cells]) < 45 and common < 0.12:
            return "list"
    if n_words >= 40 and len(words) < 0.1 * n_words:
        return "junk"
    return "prose"


def describe(text: str, common: CommonWords) -> tuple[int, float, float, float, float, str]:
    """The statistics and the kind of one text that is not empty."""
    low = text.lower()
    found = WORD.findall(low)
    words, n_words = Counter(found), len(found)
    letters = sum(map(len, found))
    solid = len("".join(text.split()))
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    stats = (
        n_words,
        letters / n_words if n_words else 0.0,
        len(SYMBOL.findall(text)) / solid if solid else 0.0,
        sum(1 for x in lines if x.rstrip(LINE_CLOSERS)[-1:] in LINE_MARKS) / len(lines) if lines else 0.0,
        common.share(low, words, n_words, letters),
    )
    return (*stats, classify(text, stats, words))


def text_stats(text: Column, common: CommonWords) -> Column:
    """STRUCT of STATS for a text. Of a null or blank text the counts and shares are 0 and the kind is null."""

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ': ', 1) for x in STATS.split(', '))}>")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [x.split()[0] for x in STATS.split(", ")]
        kinds = [pa.int64(), *[pa.float64()] * 4, pa.string()]
        for batch in batches:
            rows = [describe(t, common) if t and not t.isspace() else (0, 0.0, 0.0, 0.0, 0.0, None) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)

    return stats(text)


def document_stats(docs: DataFrame, common: CommonWords, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics, text_kind) of every row of docs, where it is read; nothing is shuffled."""
    return docs.select(id_col, text_stats(F.col(text_col), common).alias("s")).select(id_col, "s.*")
