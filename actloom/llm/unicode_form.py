"""One form for text that looks the same.

The form is compatibility-composed (NFKC) text with mapped white space and hyphens, without
default-ignorable characters, with letters of the same shape brought to one alphabet and, if
wanted, full case folding. It is worked out once per distinct value of an Arrow batch.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.core.session import cut_lineage

# Ranges of Default_Ignorable_Code_Point.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Letters of other alphabets and the Latin letter of the same shape and case.
SAME_SHAPE = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ",
    "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵ",
    "w": "ԝ", "x": "х", "y": "уү",
    "æ": "ӕ", "Æ": "Ӕ", "Ә": "Ə", "ә": "ə", "Г": "Γ", "П": "Π", "Ф": "Φ", "к": "κĸ",
}

# Hyphens and single spaces that are no compatibility forms of U+002D and U+0020.
HYPHENS = "‐‑⁃˗֊"
SPACES = " "

#: With case folded, a letter is also the same as those that its capital looks like: в as b, н as h.
FOLDED = {ord(x.casefold()): to.casefold() for to, same in SAME_SHAPE.items() for x in same if x.casefold() != x}

#: Compatibility forms with these tags look different from their letters and digits: they stay.
VISIBLE = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")


@functools.cache
def _tables(shapes: bool) -> tuple[dict[int, str | None], dict[int, str], re.Pattern[str]]:
    """Maps before and after decomposition, and the compatibility forms that stay as they are."""
    before: dict[int, str | None] = {c: None for a, b in IGNORABLE for c in range(a, b + 1)}
    before |= dict.fromkeys(map(ord, HYPHENS), "-") | dict.fromkeys(map(ord, SPACES), " ")
    after = {ord(x): to for to, same in SAME_SHAPE.items() for x in same} if shapes else {}
    stay = [chr(c) for c in [*range(0x80, 0x2E80), *range(0x3000, 0x3400), *range(0xFE00, 0x10000), *range(0x1D400, 0x1F300)] if unicodedata.decomposition(chr(c)).startswith(VISIBLE)]
    return before, after, re.compile(f"([{''.join(stay)}])")


def one_form(text: str, fold_case: bool = True, shapes: bool = True) -> str:
    """The form of a text. Empty stays empty; applying it twice changes nothing more."""
    if text.isascii():
        return text.casefold() if fold_case else text
    before, after, stay = _tables(shapes)

    def part(t: str) -> str:
        out = unicodedata.normalize("NFKD", t.translate(before)).translate(after)
        if fold_case:
            out = unicodedata.normalize("NFKD", out.casefold()).translate(after)
            out = out.translate(FOLDED) if shapes else out
        return unicodedata.normalize("NFC", out)

    return "".join(t if i % 2 else part(t) for i, t in enumerate(stay.split(text)))


DROP, EXPANDS, MARK, LATIN_MARK = 1, 2, 3, 4


@functools.cache
def _lookup(fold_case: bool, shapes: bool) -> tuple[np.ndarray, np.ndarray, re.Pattern[str]]:
    """The form of every single code point: what it becomes, what kind it is, and those that become several."""
    to = np.arange(0x110000, dtype=np.uint32)
    kind = np.zeros(0x110000, np.uint8)
    several = []
    for c in [*range(0x41, 0x5B), *range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)]:
        ch = chr(c)
        form = one_form(ch, fold_case, shapes)
        if not form:
            kind[c] = DROP
        elif len(form) > 1:
            kind[c] = EXPANDS
            several.append(ch)
        else:
            to[c] = ord(form)
            if unicodedata.combining(ch) or 0x1100 <= c < 0x1200:
                kind[c] = LATIN_MARK if 0x300 <= c < 0x370 else MARK
    return to, kind, re.compile("[" + "".join(several) + "]")


def form_points(text: str, fold_case: bool = False, shapes: bool = True) -> np.ndarray:
    """The code points of one_form, by table look-up; only texts with marks or ligatures are composed again."""
    to, kind, several = _lookup(fold_case, shapes)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kind[points]
    top = int(kinds.max(initial=0))
    if not top:
        return to[points]
    dropped = kinds == DROP
    if dropped.any():
        points = points[~dropped]
    if top == DROP:
        return to[points]
    text = unicodedata.normalize("NFC", points.tobytes().decode("utf-32-le", "surrogatepass"))
    if several.search(text):  # what a ligature becomes may compose with a mark after it
        text = unicodedata.normalize("NFC", several.sub(lambda m: one_form(m.group(), fold_case, shapes), text))
    out = to[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if top == LATIN_MARK:  # a letter that changed its alphabet may now compose with its accent
        text = unicodedata.normalize("NFC", out.tobytes().decode("utf-32-le", "surrogatepass"))
        out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def per_distinct(fn: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """A Column function that works fn out once per distinct value of a batch; null stays null."""

    @F.arrow_udf(kind)
    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            coded = pc.dictionary_encode(batch)
            values = [fn(x) for x in coded.dictionary.to_pylist()]
            yield pa.array(values, pa.binary() if kind == "binary" else pa.string()).take(coded.indices)

    return mapped


def _form(text: str, fold_case: bool, shapes: bool) -> str:
    return text if text.isascii() and not fold_case else form_points(text, fold_case, shapes).tobytes().decode("utf-32-le", "surrogatepass")


def _digest(text: str, fold_case: bool, shapes: bool) -> bytes:
    return xxhash.xxh3_128_digest(form_points(text, fold_case, shapes).tobytes())


def form(text: Column, fold_case: bool = True, shapes: bool = True) -> Column:
    """STRING one_form of a column."""
    return per_distinct(functools.partial(_form, fold_case=fold_case, shapes=shapes), "string")(text)


def form_key(text: Column, fold_case: bool = False, shapes: bool = True) -> Column:
    """BINARY 128-bit digest of one_form: what to join and compare instead of long texts."""
    return per_distinct(functools.partial(_digest, fold_case=fold_case, shapes=shapes), "binary")(text)


def same_look(df: DataFrame, a: str, b: str) -> DataFrame:
    """The rows whose texts a and b are both present, differ, and have one form; case is kept.

    Equal texts and rows with a null are left out before the form is worked out.
    """
    cand = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return cand.where(form_key(F.col(a)) == form_key(F.col(b)))


def same_look_as_previous(df: DataFrame, group: str, number: str, text: str, id_col: str) -> DataFrame:
    """(id) of the rows whose text differs from that of the row of the same group with a number
    lower by one, yet has one form. Each text is read and brought to its form once and its digests
    written; only they are shuffled. Several texts under one number become one row a form before
    the join, so no two rows of a number are paired. Repeated rows count once; rows with a null
    group, number or text are no case, nor are rows after a gap."""
    keys = df.where(F.col(group).isNotNull() & F.col(number).isNotNull() & F.col(text).isNotNull())
    keys = cut_lineage(keys.select(F.col(id_col).alias("_id"), F.col(group).alias("_g"), F.col(number).cast("bigint").alias("_n"), F.unhex(F.sha2(text, 256)).alias("_raw"), form_key(F.col(text)).alias("_form")))
    old = keys.groupBy("_g", (F.col("_n") + 1).alias("_n"), "_form").agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    return keys.join(old, ["_g", "_n", "_form"]).where("_lo <> _raw or _hi <> _raw").select(F.col("_id").alias(id_col)).distinct()
