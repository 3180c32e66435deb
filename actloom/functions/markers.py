"""Structural markers of regulatory texts, as patterns that Java, Python and RE2 read alike."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that open a section, chapter, article, point, subpoint or paragraph.
HEADINGS = {"раздел": "section", "глава": "chapter", "статья": "article"}
TEXTUAL = {"пункт": "point", "подпункт": "subpoint", "абзац": "paragraph"}
LEVELS = {"title": 0, "preamble": 0, "section": 1, "chapter": 2, "article": 3, "point": 4, "subpoint": 5, "paragraph": 6, "fallback_block": 0}

HEADING = r"^(раздел|глава|статья)\s+([0-9ivxlcа-яёa-z]+(?:\.[0-9]+)*)[.)]?\s*(.*)$"
TEXTUAL_MARKER = r"^(пункт|подпункт|абзац)\s+([0-9а-яёa-z-]+(?:\.[0-9]+)*)[.)]?\s*(.*)$"
DECIMAL = r"^([0-9]+(?:\.[0-9]+)*)\.\s*(.*)$"
BRACKET = r"^([0-9]+)\)\s*(.*)$"
LETTER = r"^([а-яёa-z])\)\s*(.*)$"
LIST_ITEM = r"^(?:[0-9]+[.)]|-\s+|•\s+|[а-я]\))"


DEEP_DECIMAL = r"^[0-9]+(?:\.[0-9]+)+\."


def line_kind(line: Column) -> Column:
    """C02. The kind of a stripped line: the first marker that fits, in this order."""
    low = F.lower(line)
    kind = F.when(F.length(line) == 0, "blank")
    for words, pattern in ((HEADINGS, HEADING), (TEXTUAL, TEXTUAL_MARKER)):
        for word, name in words.items():
            kind = kind.when(low.rlike(pattern) & low.startswith(word), name)
    kind = kind.when(low.rlike(DEEP_DECIMAL), "subpoint").when(low.rlike(DECIMAL), "point")
    return kind.when(low.rlike(BRACKET), "bracket").when(low.rlike(LETTER), "subpoint").otherwise("body")


def line_kind_sql(line: str) -> str:
    """The same for DuckDB."""
    low = f"lower({line})"
    fits = lambda p: f"regexp_matches({low}, '{p}')"
    out = f"CASE WHEN length({line}) = 0 THEN 'blank' "
    for words, pattern in ((HEADINGS, HEADING), (TEXTUAL, TEXTUAL_MARKER)):
        for word, name in words.items():
            out += f"WHEN {fits(pattern)} AND starts_with({low}, '{word}') THEN '{name}' "
    for pattern, name in ((DEEP_DECIMAL, "subpoint"), (DECIMAL, "point"), (BRACKET, "bracket"), (LETTER, "subpoint")):
        out += f"WHEN {fits(pattern)} THEN '{name}' "
    return out + "ELSE 'body' END"
