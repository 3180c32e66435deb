"""Scalar text functions as Column expressions.

All but NFC are JVM expressions that stay inside whole-stage code generation.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are brought to a plain space or hyphen, and those that are dropped.
SPACES = "      "
DASHES = "—–‒−‑"
DROPPED = r"[­​‌‍⁠﻿]"
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f]"
CONTROLS_BUT_PAGE = r"[\x00-\x08\x0b\x0e-\x1f\x7f]"


@F.arrow_udf(T.StringType())
def nfc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Canonical composition; there is no built-in for it."""
    for batch in texts:
        yield pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in batch.to_pylist()], pa.string())


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; trim() takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _plain(c: Column, controls: str) -> Column:
    c = F.translate(nfc(c), SPACES + DASHES, " " * len(SPACES) + "-" * len(DASHES))
    c = F.regexp_replace(F.regexp_replace(c, r"[  ]|\r\n|\r", "\n"), DROPPED, "")
    return F.regexp_replace(c, controls, "")


def normalize_text(c: Column) -> Column:
    """B01. Composed text with plain spaces, hyphens and line ends, at most one blank line in a row. Null gives ''."""
    c = F.regexp_replace(c, "\f", "\n\n")
    c = _plain(c, CONTROLS)
    for pattern, to in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.coalesce(strip(c), F.lit(""))


def prepare_pages(c: Column) -> Column:
    """The same for paged text, with page breaks kept as single form feeds."""
    c = _plain(F.regexp_replace(c, "\f", ""), CONTROLS)
    return strip(F.regexp_replace(F.regexp_replace(c, "", "\f"), "\n*\f\n*", "\f"))


def content_hash(c: Column) -> Column:
    """B08. Hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(c, 256)


def heading_label(kind: Column, number: Column, title: Column) -> Column:
    """B09. 'Kind number: title', without the part that is missing."""
    label = strip(F.concat_ws(" ", F.initcap(strip(kind)), number))
    return F.when(F.length(strip(title)) > 0, F.concat(label, F.lit(": "), strip(title))).otherwise(label)


def path_marker(c: Column) -> Column:
    """B10. A marker as part of a path: lower case, runs of other characters as one hyphen."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "№", "no"), r"[^\p{L}\p{N}_.]+", "-")
    return F.regexp_replace(F.regexp_replace(c, "-+", "-"), r"^[-.]+|[-.]+$", "")


def collapse(c: Column) -> Column:
    """B11. Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """B12. Form for matching: lower case, ё as е, collapsed."""
    return collapse(F.translate(F.lower(c), "ё", "е"))


def editorial_form(c: Column) -> Column:
    """B13, B14. Folded, with everything but letters and digits as space: what stays if only punctuation changes."""
    return strip(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_]+", " "))


def match_form(c: Column) -> Column:
    """B15. Folded, without a leading list marker; ; and : count as full stops."""
    c = F.regexp_replace(collapse(c), r"^(?:[-•–—*]\s+|\(?[\p{N}]+(?:\.[\p{N}]+)*[.)]\s*|\p{L}\)\s*)", "")
    return F.lower(F.translate(c, ";:", ".."))


def topic_form(c: Column) -> Column:
    """B16. Lower case letters and digits of the two alphabets, one space between words."""
    return strip(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), "[^0-9a-zа-я]+", " "))


def words(c: Column) -> Column:
    """B17. Words in order."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def content_words(c: Column, stop_words: Iterable[str]) -> Column:
    """B18. Words of more than two characters, or numbers, that are no stop words."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(words(topic_form(c)), lambda w: ((F.length(w) > 2) | w.rlike("^[0-9]+$")) & ~F.array_contains(stop, w))


def truncate(c: Column, limit: int, mark: str = "…") -> Column:
    """B19. Collapsed and cut to `limit` characters, the mark included."""
    c = collapse(c)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit - len(mark)), r"\s+$", ""), F.lit(mark)))


def snippet(c: Column, limit: int) -> Column:
    """B20. Truncated, without dots at the end."""
    return F.regexp_replace(truncate(c, limit), r"[.\s]+$", "")


def human_join(c: Column, last: str = " и ") -> Column:
    """B21. 'a', 'a и b', 'a, b и c' of an array, each entry once."""
    c = F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))
    n = F.size(c)
    head = F.array_join(F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(c, 1)).otherwise(F.concat(head, F.lit(last), F.element_at(c, -1)))


def family_key(*parts: Column) -> Column:
    """B22. Cleaned lower-case parts joined by ' | ', at most 255 characters."""
    cleaned = [F.when(F.length(collapse(p)) > 0, F.lower(collapse(p))) for p in parts]
    return F.substring(F.concat_ws(" | ", *cleaned), 1, 255)


def parse_date(c: Column) -> Column:
    """B23. ISO, reversed dotted or day-first dotted dates; null for anything else."""
    c = strip(c)
    return F.coalesce(*[F.try_to_date(c, f) for f in ("yyyy-MM-dd", "yyyy.MM.dd", "d.M.yyyy")])


def base_name(c: Column) -> Column:
    """B24. The last part of a path."""
    return F.regexp_extract(strip(c), r"([^/\\]*)$", 1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r"(\.[^.]*)$", 1))


def safe_divide(a: Column, b: Column, digits: int | None = None) -> Column:
    """B25, B26. 0 where the divisor is 0 or null; half-even rounding."""
    q = F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return q if digits is None else F.bround(q, digits)


def first_filled(*candidates: Column) -> Column:
    """B27, B28. The first candidate that is neither null nor blank."""
    return F.coalesce(*[F.when(F.length(strip(c)) > 0, c) for c in candidates])


def mapped(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """B29. A label by a small fixed table."""
    out = functools.reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit("")))
    return out.otherwise(F.lit(default))


def flags(c: Column, patterns: dict[str, str]) -> list[Column]:
    """B32, B35, B37. One 0/1 column for each named pattern."""
    c = collapse(c)
    return [F.coalesce(c.rlike(p), F.lit(False)).cast("int").alias(name) for name, p in patterns.items()]


def length_bucket(c: Column, short: int = 120, medium: int = 260) -> Column:
    """B33."""
    n = F.coalesce(F.length(c), F.lit(0))
    return F.when(n < short, "short").when(n < medium, "medium").otherwise("long")


def looks_like_title(c: Column) -> Column:
    """B34. At most three lines and 220 characters, and no long sentence."""
    n = F.size(F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(x)) > 0))
    return (n >= 1) & (n <= 3) & (F.length(c) <= 220) & ~((F.length(c) > 120) & c.rlike("[.;:]$"))


def parse_bool(c: Column, strict: bool = False) -> Column:
    """B36. 1, true and yes are true; with strict, only 0, false and no are false, the rest null."""
    c = F.lower(strip(c))
    yes = c.isin("1", "true", "yes")
    return F.when(yes, True).when(c.isin("0", "false", "no"), False) if strict else F.coalesce(yes, F.lit(False))
