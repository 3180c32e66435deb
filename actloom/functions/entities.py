"""Table-generating extraction of entities with their places in the text.

A pack names types by patterns; all of its matches come out of one Arrow pass over a batch, with
code-point offsets, which no built-in function gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTITY = "entity_type string, value string, normalized_value string, start_char int, end_char int, confidence double, extraction_method string"


@dataclass(frozen=True)
class Pattern:
    entity_type: str
    pattern: str
    normal: Callable[[regex.Match], str]
    confidence: float


def _period(m: regex.Match) -> str:
    unit = m.group("unit").lower()
    name = next((n for n, starts in UNITS.items() if unit.startswith(starts)), "DAY")
    working = "WORKING_" if m.group("work") else ""
    return f"P{m.group('n')}_{working}{name}"


# How the units of periods begin.
UNITS = {"HOUR": ("час", "hour", "stunde", "heure", "小时", "時間"), "MINUTE": ("мин", "minute"), "WEEK": ("недел", "week", "woche", "semaine"), "MONTH": ("месяц", "month", "monat", "mois"), "DAY": ("дн", "ден", "сут", "day", "tag", "jour", "日", "天")}

RULES = (
    Pattern("deadline", r"(?i)(?P<n>\d{1,4})\s*(?:-?\s*)(?P<work>(?:рабочих|working|ouvrés|工作)\s*)?(?P<unit>дн\p{L}*|день|час\p{L}*|минут\p{L}*|недел\p{L}*|месяц\p{L}*|сут\p{L}*|days?|hours?|weeks?|months?|tage?n?|stunden?|wochen?|monate?n?|jours?|heures?|semaines?|mois|日|小时|天)", _period, 0.97),
    Pattern("condition", r"(?i)(?:в случае|при условии|если|provided that|if |wenn |falls |si |若|场合)[^.;\n]{3,}", lambda m: m.group().strip().lower(), 0.90),
    Pattern("obligation", r"(?i)(?:обязан\p{L}*|должен|должн[аы]|shall|must|muss|müssen|doit|doivent|应当)\s*(?P<what>[^.;\n]{3,})", lambda m: m.group("what").strip().lower(), 0.94),
    Pattern("reference", r"(?i)(?:ст|п|ч|гл|art|sec|para|abs|nr|kap|chap)\.\s*\d+(?:\.\d+)*", lambda m: " ".join(m.group().lower().split()), 0.92),
    Pattern("amount", r"(?i)\d[\d\s,.]*\d?\s*(?:тыс\.\s*)?(?:руб|eur\b|euro|€|円|元|บาท)|EUR\s*\d[\d,.]*", lambda m: "".join(m.group().split()).lower(), 0.90),
    Pattern("authority", r"(?i)(?:лицензирующая инспекция|комиссия по \p{L}+|уполномоченный орган|competent authority|licensing office|review board|zuständige behörde|registerstelle|autorité compétente|主管部门|許可機関)", lambda m: m.group().lower(), 0.92),
)


def extract(df: DataFrame, keys: list[str], text: str, rules: tuple[Pattern, ...] = RULES) -> DataFrame:
    """F01-F09. Keys and ENTITY for every match in every text, ordered within a text by place, type
    and value. A null or empty text has none; nothing is shuffled."""
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.length("_text") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", " + ENTITY
    names = [c.split()[0] for c in ENTITY.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
    compiled = [(r, r.pattern) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(r, regex.compile(p)) for r, p in compiled]
        for batch in batches:
            take, found = [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                hits = sorted({(m.start(), r.entity_type, m.group(), r.normal(m), m.end(), r.confidence) for r, p in ready for m in p.finditer(t)})
                take.extend([i] * len(hits))
                found.extend((kind, value, normal, start, end, sure, "rules") for start, kind, value, normal, end, sure in hits)
            columns = [batch.column(k).take(pa.array(take, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([r[j] for r in found], kinds[j]) for j in range(7)], names=[*keys, *names])

    return rows.mapInArrow(run, schema)


def merge(rules: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """F11, F15. One entity per type, normalised value and value; of two methods the surer, of equals the other method's."""
    both = rules.withColumn("_m", F.lit(0)).unionByName(other.withColumn("_m", F.lit(1)))
    w = Window.partitionBy(*keys, "entity_type", "normalized_value", "value").orderBy(F.desc("confidence"), F.desc("_m"), "start_char", "end_char")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_m", "_r")


def compare_methods(found: DataFrame) -> DataFrame:
    """F17. (entity_type, extraction_method, n, n_distinct) of all methods."""
    return found.groupBy("entity_type", "extraction_method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("normalized_value").alias("n_distinct"))
