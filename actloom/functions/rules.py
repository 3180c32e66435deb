"""Rule packs: labels, their words or patterns, and their priority, compiled into one expression.

Packs are data. A pack is turned into literal expressions instead of a rule table to join with,
so scoring stays in one projection.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lexicon:
    """E02, E03. Labels by words that a text contains; priority breaks ties, the first label wins."""

    entries: Mapping[str, tuple[str, ...]]
    default: str

    @property
    def priority(self) -> list[str]:
        return list(self.entries)

    def scores(self, *texts: Column) -> dict[str, Column]:
        """One count for each label: its words contained in each of the texts, any letter case."""
        low = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]
        return {label: functools.reduce(operator.add, [F.contains(t, F.lit(w)).cast("int") for t in low for w in words]) for label, words in self.entries.items()}

    def label(self, *texts: Column) -> Column:
        """The label of the highest score. The scores are bound once, by a transform over one element,
        so they are not worked out again for each branch."""
        scores = F.array(F.array(*self.scores(*texts).values()))
        names = F.array(*[F.lit(x) for x in self.entries])
        pick = F.transform(scores, lambda s: F.when(F.array_max(s) == 0, self.default).otherwise(F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))))
        return F.element_at(pick, 1)

    def sql(self, *texts: str) -> tuple[dict[str, str], str]:
        """The same for DuckDB: scores by label, and the CASE of the label."""
        scores = {label: " + ".join(f"contains(lower(coalesce({t}, '')), '{w}')::INT" for t in texts for w in words) for label, words in self.entries.items()}
        best = f"greatest({', '.join(scores.values())})"
        return scores, f"CASE WHEN {best} = 0 THEN '{self.default}' " + " ".join(f"WHEN {s} = {best} THEN '{label}'" for label, s in scores.items()) + " END"


@dataclass(frozen=True)
class Ladder:
    """E08, E10. Labels by the first pattern that fits, with a score for each rung."""

    rungs: tuple[tuple[str, str, int], ...]  # label, pattern over lower-case text, score
    default: str

    def label(self, text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        out = F.when(F.lit(False), F.lit(""))
        for label, pattern, _ in self.rungs:
            out = out.when(low.rlike(pattern), label)
        return out.otherwise(self.default)

    def best(self, text: Column) -> Column:
        """STRUCT label, score, reasons: the label of the highest score, and all that fit, in order."""
        low = F.lower(F.coalesce(text, F.lit("")))
        hits = F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.lit(s).alias("score"), F.lit(-i).alias("rank"), F.lit(label).alias("label"))) for i, (label, p, s) in enumerate(self.rungs)]))
        top = F.array_max(hits)
        return F.struct(
            F.coalesce(top["label"], F.lit(self.default)).alias("label"),
            F.bround(F.coalesce(top["score"], F.lit(0)) / 100, 2).alias("confidence"),
            F.transform(hits, lambda h: h["label"]).alias("reasons"),
        )


#: A small pack over the languages of the corpus: what a change is about.
TOPICS = Lexicon(
    {
        "deadline": ("срок", "дней", "days", "month", "tage", "woche", "délai", "jours", "工作日", "日以内", "يوم", "วัน", "दिन"),
        "document": ("справк", "протокол", "копи", "copy", "register", "kopie", "copie", "副本", "写し", "نسخة", "สำเนา", "प्रति"),
        "authority": ("орган", "комисси", "authority", "panel", "behörde", "ausschuss", "autorité", "commission", "机关", "委員会", "لجنة", "คณะกรรมการ", "प्राधिकारी"),
        "payment": ("сбор", "руб", "fee", "eur", "gebühr", "redevance", "费用", "手数料", "الرسم", "ค่าธรรมเนียม", "शुल्क"),
        "refusal": ("отказ", "refusal", "ablehnung", "refus", "拒绝", "拒否", "رفض", "ปฏิเสธ", "अस्वीकृति"),
    },
    "other",
)

SIGNIFICANCE = Ladder(
    (
        ("critical", r"(отказ|refus|ablehn|拒)", 90),
        ("important", r"([0-9]+ (?:рабочих |working |jours |tage)?(?:дн|day|jour|tag|мес|month|mois|monat))", 90),
        ("informational", r"(см\.|see |vgl\.|cf\.|www\.|тел\.)", 85),
    ),
    "not_evaluated",
)


def any_fits(text: Column, patterns: Iterable[str]) -> Column:
    """S10. Whether any pattern is found."""
    return functools.reduce(operator.or_, [text.rlike(p) for p in patterns], F.lit(False))


def zero_filled(label: Column, labels: Iterable[str], prefix: str = "n_") -> list[Column]:
    """E07, E15. One conditional count for each label, 0 where none is met."""
    return [F.count_if(label == x).alias(prefix + x) for x in labels]
