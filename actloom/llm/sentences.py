"""Sentence units of texts in any script, by trained linear chains.

Every character is a boundary or inside. All but a few are inside by rule, so the first chain is run
over the candidates only (end marks with their closers, line breaks, spaces between letters of a
script that writes none between words), which is the same as running it over all characters with the
others clamped. What TESTDATA.md states of units is clamped too: a blank line cuts, a line break cuts
after a sentence end, colon or semicolon only, nothing cuts inside an open quotation or a label, a
question or exclamation mark and the end marks of other scripts cut. What is left is a period, and
its score is a sum of trained weights of features: the word before it, the one before that, their
shapes, what follows, how both are met in all texts, and whether the word is on one of the lists.

Weights come from an averaged structured perceptron over a bounded sample of texts, decoded with
Viterbi. Its labels are taken from layout (see `labels`): a paragraph's end is a boundary, what goes on in lower
case is none, and a word that is often met before a period but never at a paragraph's end is an
abbreviation. A second chain, over characters, is trained on sentences of scripts without spaces
with their punctuation stripped, and cuts stretches of such scripts that have none.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.core.session import cut_lineage

# Abbreviations that what they belong to follows (titles, references, units before a number).
LEADING = {
    "en": "no nos art arts sec secs cf para paras dr mr mrs ms prof messrs st fig figs tab vol vols approx cl ch chap reg eq ed eds rev hon gen col capt lt sgt vs viz al pt nr app ca resp",
    "ru": "ст п пп подп см ср ч гл гр прил акад проф ул д стр разд доц тыс млн млрд г-н г-жа им о обл р-н пос просп пер корп кв тел рис табл вкл напр т с кн изд ред",
    "de": "nr art abs vgl kap dr prof ca bzw z d h b s anl ziff buchst str bd hr fr hrn i v m a u tsd mio mrd lit inkl zzgl ggf evtl sog st tel hrsg abb tab einschl gem o",
    "fr": "art par p pp vol av bd al chap let cf mm m mme mlle dr pr c ex c.-à-d l'art d'art n no env tél fig éd st ste par.ex sect ann",
    "hi": "रु डॉ दि अनु सं श्री प्रो",
    "ar": "د أ م ص ج",
}
# Abbreviations that may also end a sentence.
ENDING = "jr sr inc ltd co corp etc a.m p.m e.g i.e др пр руб коп г гг д.р т.д т.п usw ff f ag kg gmbh pers uhr suiv etc bros plc dept est сл мин час сек кг км"

# Those of them that end a sentence after a number only.
NUMBERED = "г гг f ff kg кг км"

# Letters of the same shape, so that a word in which some are swapped is still known.
SHAPES = str.maketrans("аеорсухіјѕАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsABEKMHOPCTYXIJSABEZHIKMNOPTYXo")


@functools.lru_cache(100_000)
def plain(word: str) -> str:
    return word.translate(SHAPES).lower()


LETTER_ABBREVIATIONS = frozenset(plain(w) for ws in LEADING.values() for w in ws.split())
MAY_END = frozenset(plain(w) for w in ENDING.split())
AFTER_NUMBER = frozenset(plain(w) for w in NUMBERED.split())

OPEN = "«“„「『‹‘《〈"
CLOSE = "»”」』›’》〉"
INVISIBLE = regex.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]+")
BLANK = regex.compile(r"\n[^\S\n]*\n\s*|\x0c\s*")
THAI = "ก-ฯะ-ฺเ-๎"
EVENT = re.compile(
    r"(?P<end>(?:[!?…。！？।॥۔؟]|\.(?!\d|[^\S\n]*[a-zа-яё]))+(?:[»”」』›’》〉\"')\]）】]|[   ]»)*)"
    r"|(?P<nl>\n)"
    rf"|(?<=[{THAI}])(?P<th>[^\S\n]+)(?=[{THAI}])"
    r"|(?P<q>[«“„「『‹《〈»”」』›》〉\"])"
)
END = re.compile(r"(?:[!?…。！？।॥۔؟]|\.(?!\d|[^\S\n]*[a-zа-яё]))+(?:[»”」』›’》〉\"')\]）】]|[   ]»)*")
STOP = re.compile(r"[.!?…。！？।॥۔؟\n«“„「『‹《〈»”」』›》〉\"]")
THAI_ANY = re.compile(f"[{THAI}]")
LABEL = regex.compile(r"(?m)^[^\S\n]*(?:(?:§+|№|[^\W\d_]{1,12}\.?)[^\S\n]*)?(?:№|No\.|Nr\.|n°)?[^\S\n]*(?:\p{N}+(?:\.\p{N}+)*|[IVXLCDM]{1,6}|[^\W\d_])(?:[.)](?=\s|$)|\.(?=[^\W\d_]))")
ITEM = regex.compile(r"(?:[-–—•*·▪◦]\s|\(?(?:\p{N}{1,3}(?:\.\p{N}+)*|[^\W\d_]{1,2})[.)])")
NEXT = regex.compile(r"[\"“„«‘‹「『(\[]?\s?([^\W_]+)")
BARE_LABEL = regex.compile(r"[^\w]*(?:\p{N}+(?:\.\p{N}+)*|[IVXLC]+|[^\W\d_])?[^\w]*")
ENDED = re.compile(r"(?:[.!?…。！？।॥۔؟:;：；][»”」』\")\]]*|\n)\s*$")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]+")
UNPUNCTUATED = regex.compile(r"\s*[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]+\s*")
PUNCTUATION = regex.compile(r"[\p{P}\s]+")
PERIOD = re.compile(r"(?<=[\w\u0900-\u0963\u064b-\u0652\u0e31-\u0e4e])\.(?:\s+([^\s])|\s*\Z)")
FIRST = regex.compile(r"(?:[^\w\n]*(?:\p{N}[\p{N}.]*|[^\W\d_])[.)]\s+)?[^\w\n]*(\p{Lu}[^\W\d_]*)")
INNER = re.compile(r"[a-zäöüß,]\s+([A-ZÄÖÜ][^\W\d_]*)")
HAS_LETTER = regex.compile(r"\p{L}")
STRONG = frozenset("!?。！？।॥؟۔")
GERMAN = regex.compile(r"\b(?:der|die|das|und|den|dem|für|nicht)\b")

NEVER, ALWAYS = -30.0, 30.0
BARE = -25.0  # of a boundary after a unit that is no more than a label: that belongs to the unit it opens
RARE = 4  # words met less often before a period have no features of their own
OFTEN = 20  # a word met so often before a period, but at no paragraph's end, is no sentence's last

def events(p: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of end marks, line breaks, quotation marks and Thai spaces. Without Thai letters a
    class of characters is searched for, which is several times as fast as alternatives are."""
    if THAI_ANY.search(p):
        for m in EVENT.finditer(p):
            yield m.lastgroup, m.start(), m.end()
        return
    m = STOP.search(p)
    while m:
        i = m.start()
        ch = p[i]
        end = i + 1
        if ch == "\n":
            yield "nl", i, end
        elif mark := END.match(p, i):
            end = mark.end()
            yield "end", i, end
        elif ch != ".":
            yield "q", i, end
        m = STOP.search(p, end)


def is_thai(ch: str) -> bool:
    return "ก" <= ch <= "๎" and ch not in "ฯ฿"


def viterbi(scores: list[float], chained: list[bool], again: float) -> list[bool]:
    """The best labelling of a chain in which "inside" scores 0, a boundary its score, and two boundaries
    in a row `again` more where `chained`. A chain starts after a boundary."""
    prev_in, prev_cut = -math.inf, 0.0
    back: list[tuple[bool, bool]] = []
    for score, tied in zip(scores, chained):
        from_cut = prev_cut + (again if tied else 0.0)
        back.append((prev_cut > prev_in, from_cut > prev_in))
        prev_in, prev_cut = max(prev_in, prev_cut), max(prev_in, from_cut) + score
    state, out = prev_cut > prev_in, []
    for in_from, cut_from in reversed(back):
        out.append(state)
        state = cut_from if state else in_from
    return out[::-1]


@functools.lru_cache(None)
def in_word(ch: str) -> bool:
    return ch.isalnum() or ch in "'’.-_" or unicodedata.category(ch)[0] == "M"


def word_before(p: str, i: int) -> str:
    """The word that ends right before i."""
    k = i
    while k and in_word(p[k - 1]):
        k -= 1
    return p[k:i].strip("'’.-_") if k < i and p[i - 1] not in "'’.-_" else ""


def context(p: str, i: int) -> tuple[str, str]:
    """The word right before i, and its name in counts: numbers by their length, initials as one, and a
    letter or two with the word before them. A small letter is another word than a capital."""
    w = word_before(p, i)
    if not w or len(w) > 2 and not w[-1].isdigit():
        return w, plain(w)
    if w[-1].isdigit() and not HAS_LETTER.search(w):
        return w, "#." if "." in w else f"#{min(len(w), 3)}"
    k = i - len(w)
    while k and p[k - 1] in " \n\t\u00a0\u202f":
        k -= 1
    dot = k > 0 and p[k - 1] == "."
    before = word_before(p, k - 1 if dot else k)
    if len(w) == 1 and w.isupper() and w not in "IVX":
        return w, "A. A" if dot and len(before) == 1 else "A"
    short = "#" if before[:1].isdigit() else plain(before) if len(before) <= 4 else "_"
    return w, f"{short}{'.' if dot else ''} {w.translate(SHAPES) if len(w) == 1 else plain(w)}"


def level(a: float, b: float) -> int:
    """A log-odds in steps of one, -4 to 4."""
    return max(-4, min(4, round(math.log((a + 0.5) / (b + 0.5)))))


@dataclass
class Model:
    """What is known of words, and the trained weights.

    words: how often each is met before a period that what follows shows to be no boundary, one at a
    paragraph's end, and one that is followed by neither; starters: how often a capitalised word
    begins a paragraph, and how often it follows a small letter or comma.
    """

    words: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    starters: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    unspaced: CharacterChain = field(default_factory=lambda: CharacterChain())  # noqa: PLW0108

    def seed(self, name: str, w: str, nxt: str, follow: str, german: bool) -> bool | None:
        """A label of a period by counts; by the lists alone where its word is rare. None: unknown."""
        if name[:1] == "#" and w[-1:].isdigit():
            if not german or "." in w:
                return True
            begins, inside = self.starters.get(follow, (0, 0))
            return begins > inside if begins + inside >= 4 else len(w) > 2
        no, end, open_ = self.words.get(name, (0, 0, 0))
        low = plain(w)
        if name[:1] == "A" and w.isupper() or nxt in "№§%&":
            return False
        if nxt.isdigit():  # sentences seldom begin with a number, references always
            return None if end > no else False
        if end and end >= no / 20 and end >= open_ / 100:
            return True if end > no else None
        if no + open_ >= OFTEN or no and not end:
            return False
        return low in MAY_END and (low not in AFTER_NUMBER or name[:1] == "#") or not (low in MAY_END or low in LETTER_ABBREVIATIONS or len(w) == 1 and w.isalpha() or "." in w or low.endswith("str"))

    def features(self, w: str, name: str, gap: str, nxt: str, follow: str, german: bool, marks: str) -> list[str]:
        """Names of what is there; each has a weight. Words that are hardly met have weights of their own,
        without their name."""
        low = plain(w)
        n = "U" if nxt.isupper() else "d" if nxt.isdigit() else "№" if nxt in "№§%&" else "o" if nxt.isalpha() else "p"
        if not w:
            kind = "none"
        elif w[-1].isdigit() and not HAS_LETTER.search(w):
            kind = ("#." if "." in w else "#" if len(w) > 2 else "##") + ("g" if german else "")
        elif len(w) == 1:
            kind = "R" if w in "IVX" else "I" if w.isupper() else "i" if w.islower() else "o1"
        elif "." in w:
            kind = "a.b" if all(len(x) <= 2 for x in w.split(".")) else "a.bc"
        else:
            kind = ("Aa" if w[:1].isupper() else "aa" if w[:1].islower() else "oo") + str(min(len(w), 5))
        no, end, open_ = self.words.get(name, (0, 0, 0))
        begins, inside = self.starters.get(follow, (0, 0))
        listed = "lead" if low in LETTER_ABBREVIATIONS or low.endswith("str") else "end" if low in MAY_END else "-"
        initial = "1" if len(follow) == 1 and nxt.isupper() else "w"
        start = level(begins, inside) if begins + inside else "?"
        found = [f"{gap}{n}", f"k={kind}{gap}{n}", f"l={listed}{gap}{n}", f"s={start}{n}", f"ks={kind}{start}{n}", f"i={kind}{initial}{n}", f"m={marks[:4]}{gap}{n}", f"kl={kind}{listed}{n}"]
        if no + end + open_ < RARE:
            return ["rare " + f for f in found]
        return [*found, f"w={name}", f"f={follow}", f"no={level(no, end)}", f"no={level(no, end)}{n}", f"open={level(no + open_, end)}{gap}{n}"]

    def score(self, w: str, name: str, gap: str, nxt: str, follow: str, german: bool, marks: str) -> float:
        """The trained score of a boundary; without weights that of the seed label."""
        if not self.weights:
            return {True: 5.0, None: 0.0, False: -5.0}[self.seed(name, w, nxt, follow, german)]
        return sum(self.weights.get(f, 0.0) for f in self.features(w, name, gap, nxt, follow, german, marks))


@dataclass
class CharacterChain:
    """Boundary or inside for every character of a stretch without punctuation, by the characters around it."""

    weights: dict[str, float] = field(default_factory=dict)
    longest: int = 0  # of the units it was trained on, all but one in a thousand are shorter

    @staticmethod
    def features(text: str, i: int) -> tuple[str, ...]:
        """What stands around the place before character i."""
        a, b, c, d = text[i - 2 : i - 1], text[i - 1 : i], text[i : i + 1], text[i + 1 : i + 2]
        return (f"b{b}", f"c{c}", f"ab{a}{b}", f"bc{b}{c}", f"cd{c}{d}", f"abc{a}{b}{c}", f"bcd{b}{c}{d}", f"3{text[max(0, i - 3) : i]}", f"4{text[i : i + 3]}", "bias")

    def decode(self, text: str) -> list[int]:
        """Places of boundaries."""
        get = self.weights.get
        scores = [sum(get(f, 0.0) for f in self.features(text, i)) for i in range(1, len(text))]
        return [i + 1 for i, cut in enumerate(viterbi(scores, [True] * len(scores), get("again", 0.0))) if cut]

    @classmethod
    def fit(cls, sentences: list[list[str]], epochs: int = 3) -> CharacterChain:
        """Averaged perceptron on stretches: lists of sentences that follow one another, their punctuation stripped."""
        chain, total, step = cls(), {}, 0
        lengths = sorted(len(x) for run in sentences for x in run)
        chain.longest = lengths[min(len(lengths) - 1, int(len(lengths) * 0.999))] if lengths else 0
        for _ in range(epochs):
            for run in sentences:
                text, want, at = "".join(run), set(), 0
                for x in run[:-1]:
                    at += len(x)
                    want.add(at)
                step += 1
                got = set(chain.decode(text))
                change = Counter({"again": sum(i + 1 in want for i in want) - sum(i + 1 in got for i in got)})
                for i in want ^ got:
                    change.update(dict.fromkeys(chain.features(text, i), 1 if i in want else 0))
                    change.subtract(dict.fromkeys(chain.features(text, i), 0 if i in want else 1))
                for f, by in change.items():
                    chain.weights[f] = chain.weights.get(f, 0.0) + by
                    total[f] = total.get(f, 0.0) + by * step
        chain.weights = {f: w - total[f] / (step + 1) for f, w in chain.weights.items()}
        return chain


@dataclass
class Candidate:
    at: int  # a boundary lies before this character
    score: float
    bare: bool  # the text since the candidate before is no more than a label
    found: tuple = ()  # what features() takes, where the score is trained


class Segmenter:
    def __init__(self, model: Model | None = None):
        self.model = model or Model()
        self.known: dict[tuple, float] = {}

    def units(self, text: str) -> list[tuple[int, int]]:
        """Starts and ends of the units; they cover all of the text but white space."""
        places = None
        if INVISIBLE.search(text):
            kept, places = [], []
            at = 0
            for m in INVISIBLE.finditer(text):
                kept.append(text[at : m.start()])
                places.extend(range(at, m.start()))
                at = m.end()
            kept.append(text[at:])
            places.extend(range(at, len(text)))
            places.append(len(text))
            shown = "".join(kept)
        else:
            shown = text
        cuts: list[int] = [0]
        at = 0
        for m in BLANK.finditer(shown):
            if m.start() > at:
                cuts.extend(self.paragraph(shown, at, m.start()))
            cuts.append(m.end())
            at = m.end()
        if at < len(shown):
            cuts.extend(self.paragraph(shown, at, len(shown)))
        cuts.append(len(shown))
        if places is not None:
            cuts = [0, *(places[c] for c in cuts[1:-1]), len(text)]
            for k in range(1, len(cuts) - 1):  # a character without width belongs to the word it touches
                while cuts[k] > cuts[k - 1] and INVISIBLE.match(text[cuts[k] - 1]):
                    cuts[k] -= 1
        out = []
        for a, b in zip(cuts, cuts[1:]):
            piece = text[a:b]
            left = piece.lstrip()
            if left:
                start = b - len(left)
                out.append((start, start + len(left.rstrip())))
        return out

    def paragraph(self, s: str, a: int, b: int) -> list[int]:
        p = s[a:b]
        cands = self.candidates(p)
        if not cands:
            chain = self.model.unspaced
            if b - a > chain.longest > 0 and UNPUNCTUATED.fullmatch(p):
                return [a + i for i in chain.decode(p)]
            return []
        cuts = viterbi([self.value(c) for c in cands], [c.bare for c in cands], BARE)
        return [a + c.at for c, cut in zip(cands, cuts) if cut]

    def value(self, c: Candidate) -> float:
        """A candidate's score; trained ones stay within what is clamped, and are kept by what they depend on."""
        if not c.found:
            return c.score
        if c.found not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[c.found] = max(-20.0, min(20.0, self.model.score(*c.found)))
        return self.known[c.found]

    def candidates(self, p: str) -> list[Candidate]:
        out: list[Candidate] = []
        quotes: list[tuple[str, bool]] = []  # open quotations: closing mark, opened after a colon
        closers: dict[str, int] = {}  # where each closing mark stands last
        # a label opens a line that no sentence runs on to
        labels = []
        if "." in p or ")" in p:
            line = 0
            while True:
                if (not line or ENDED.search(p, max(0, line - 8), line)) and (m := LABEL.match(p, line)):
                    labels.append(m.end())
                line = p.find("\n", line) + 1
                if not line:
                    break
        n_label = 0
        german = None
        last, n = 0, len(p)
        done = -1
        for kind, i, e in events(p):
            if kind == "q":
                self.quote(p, i, quotes, closers)
                continue
            if kind == "th":
                out.append(Candidate(e, ALWAYS, False))
                last = e
                continue
            if kind == "nl":
                if i < done or quotes:
                    continue
                before = p[last:i].rstrip()
                if before and (before[-1] in ":;：；" or before[-1] in "»”\")" and before[-2:-1] in (":", ";")):
                    out.append(Candidate(e, ALWAYS, False))
                    last = e
                elif before and is_thai(before[-1]) and is_thai(p[e : e + 1] or " "):
                    out.append(Candidate(e, ALWAYS, False))
                    last = e
                continue
            closed, after_colon = False, False
            for k in range(i, e):
                if p[k] in "»”」』›》〉\"":
                    was = len(quotes)
                    pair = self.quote(p, k, quotes, closers)
                    if len(quotes) < was:
                        closed, after_colon = True, pair
                    elif len(quotes) > was:  # it opens the next quotation
                        quotes.pop()
                        e = k
                        break
            if e < n and p[e] == "“" and quotes and quotes[-1][0] == "“":
                after_colon, closed = quotes.pop()[1], True
                e += 1
            at = e
            while at < n and p[at].isspace():
                at += 1
            if at >= n:
                break
            done = at
            if quotes or p[at].islower() and "\n" not in p[e:at]:
                continue
            while n_label < len(labels) and labels[n_label] < e:
                n_label += 1
            if n_label < len(labels) and labels[n_label] == e:
                continue  # inside a label
            if german is None:
                german = bool(GERMAN.search(p))
            score, found = self.judge(p, i, e, at, closed, after_colon, german)
            if score > NEVER:
                bare = i - last <= 12 and BARE_LABEL.fullmatch(p, last, i) is not None
                out.append(Candidate(at, score, bare, found))
                last = at
        return out

    @staticmethod
    def quote(p: str, k: int, quotes: list[tuple[str, bool]], closers: dict[str, int]) -> bool:
        """Opens or closes a quotation at k; of one that is closed, whether a colon opened it.
        It opens only if its closing mark follows somewhere in the paragraph."""
        ch = p[k]
        if quotes and ch == quotes[-1][0]:
            return quotes.pop()[1]
        if ch == "”" and quotes and quotes[-1][0] in "“”":
            return quotes.pop()[1]
        close = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "‹": "›", "《": "》", "〈": "〉", '"': '"'}.get(ch)
        for c in (close, "”") if ch == "„" else (close,) if close else ():
            if c not in closers:
                closers[c] = p.rfind(c)
        if close and (closers[close] > k or ch == "„" and closers["”"] > k):
            quotes.append((close, p[max(0, k - 3) : k].rstrip()[-1:] in (":", "：")))
        return False

    def judge(self, p: str, i: int, e: int, at: int, closed: bool, after_colon: bool, german: bool) -> tuple[float, tuple]:
        """(ALWAYS or NEVER, ()) where it is stated what a unit is; else what the trained score depends on."""
        marks, nxt, gap = p[i:e], p[at], p[e:at]
        if "\n" in gap and ITEM.match(p, at):
            return ALWAYS, ()
        if nxt.islower() or nxt in ".!?…,;:)]}、，；：）】%/" or nxt in "-–—" and "\n" not in gap:
            return NEVER, ()
        follow = NEXT.match(p, at)
        word = follow.group(1) if follow else ""
        if (nxt in OPEN or nxt in "\"'([（") and word[:1].islower():
            return NEVER, ()
        cased, digit = word[:1].isupper(), word[:1].isdigit()
        if closed:  # a quotation inside a sentence does not end the sentence
            return (ALWAYS if cased or after_colon else NEVER), ()
        if not STRONG.isdisjoint(marks) or ("…" in marks or ".." in marks) and not digit:
            return ALWAYS, ()
        w, name = context(p, i)
        if w and w[-1].isdigit() and nxt.isdigit() and not gap:
            return NEVER, ()
        if not w:
            name = p[i - 1 : i]
        return 0.0, (w, name, "n" if "\n" in gap else "g" if gap else "0", nxt, word, german, marks)


def observe(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, word, which count) seen in one text: what its layout tells of words around periods."""
    for par in BLANK.split(INVISIBLE.sub("", text)):
        par = par.strip()
        if not par:
            continue
        for m in PERIOD.finditer(par):
            nxt = m.group(1) or ""
            name = context(par, m.start())[1]
            if name:
                yield "word", name[:60], 1 if not nxt else 0 if nxt.islower() or nxt.isdigit() or nxt in ",;:)№§(–-" else 2
        first = FIRST.match(par)
        if first:
            yield "starter", first.group(1), 0
        if GERMAN.search(par):
            for m in INNER.finditer(par):
                yield "starter", m.group(1), 1


def labelled(texts: list[str], model: Model, frequent: int = 3000) -> list[tuple[list[Candidate], list[bool | None]]]:
    """Chains of candidates with their labels. Paragraphs that end with a period are joined by a space to the
    next one, without its label, so that their ends are boundaries of known place inside a chain. The
    words of the texts and the `frequent` ones that are met most are chains of their own."""
    cut, out = Segmenter(model), []

    def add(chain: str, joins: set[int]) -> None:
        cands = cut.candidates(chain)
        german = bool(GERMAN.search(chain))
        labels: list[bool | None] = []
        for c in cands:
            if c.at in joins:
                labels.append(True)
            elif c.found:
                w, name, _, nxt, follow, _, _ = c.found
                labels.append(model.seed(name, w, nxt, follow, german))
            else:
                labels.append(c.score > 0)
        if any(c.found for c in cands):
            out.append((cands, labels))

    for text in texts:
        chain, joins = "", set()
        for par in map(str.strip, BLANK.split(INVISIBLE.sub("", text))):
            if not par:
                continue
            if chain and len(joins) < 8:
                label = LABEL.match(par)
                par = par[label.end() :].lstrip() if label else par
                chain += " "
                joins.add(len(chain))
                chain += par
            else:
                if chain:
                    add(chain, joins)
                chain, joins = par, set()
            if not par.endswith("."):
                add(chain, joins)
                chain, joins = "", set()
        if chain:
            add(chain, joins)
    # what is known of a word holds before a capital as well, where it has not been met
    known = [(name.rpartition(" ")[2], name, False) for name in heapq.nlargest(frequent, model.words, key=lambda name: (sum(model.words[name]), name))]
    met = [(c.found[0], c.found[1], c.found[5]) for cands, _ in out for c in cands if c.found]
    for w, name, german in dict.fromkeys(met + known):
        if name[:1] not in "#A" and (label := model.seed(name, w, "X", "", german)) is not None:
            out += 3 * [([Candidate(0, 0.0, False, (w, name, "g", "X", "", german, "."))], [label])]
    return out


def fit(chains: list[tuple[list[Candidate], list[bool | None]]], model: Model, epochs: int = 3) -> None:
    """Sets model.weights: an averaged structured perceptron. Where a label is unknown, the chain's own
    best labelling among those that agree with the known ones stands for it."""
    # what is known of words that are hardly met before anything is fitted: the lists
    weights = {f"rare l={listed}{gap}{n}": by for listed, by in (("-", 3.0), ("end", 2.0), ("lead", -3.0)) for gap in "gn" for n in "Uop"}
    total, step = {}, 0
    unknown = Model(starters=model.starters)  # the same chains once more as if no word of theirs had been met
    features: dict[tuple, tuple[list[str], list[str]]] = {}
    for cands, _ in chains:
        for c in cands:
            if c.found and c.found not in features:
                features[c.found] = (model.features(*c.found), unknown.features(*c.found))
    for epoch in range(2 * epochs):
        for cands, labels in chains:
            own = [features[c.found][epoch % 2] if c.found else () for c in cands]
            scores = [max(-20.0, min(20.0, sum(weights.get(f, 0.0) for f in names))) if names else c.score for c, names in zip(cands, own)]
            bare = [c.bare for c in cands]
            got = viterbi(scores, bare, BARE)
            want = viterbi([s if y is None else 1000.0 if y else -1000.0 for s, y in zip(scores, labels)], bare, BARE)
            step += 1
            for names, x, y, s in zip(own, got, want, scores):
                if names and (x != y or abs(s) < 1):  # a margin of 1: what is right by little is moved as well
                    by = 1.0 if y else -1.0
                    for f in names:
                        weights[f] = weights.get(f, 0.0) + by
                        total[f] = total.get(f, 0.0) + by * step
    model.weights = {f: w - total.get(f, 0.0) / (step + 1) for f, w in weights.items()}


def stripped_runs(texts: list[str], model: Model, most: int = 400) -> list[list[str]]:
    """Stretches of scripts without spaces as lists of their sentences without punctuation."""
    cut, out = Segmenter(model), []
    for text in texts:
        if len(out) == most:
            break
        run: list[str] = []
        for a, b in cut.units(text):
            bare = PUNCTUATION.sub("", text[a:b])
            if len(bare) >= 4 and UNSPACED.fullmatch(bare):
                run.append(bare)
            if run and (len(run) == 8 or bare != run[-1]):
                out.append(run)
                run = []
        if len(run) > 1:
            out.append(run)
    return out[:most]


def train(texts: DataFrame, text_col: str, rows: int = 1000, least: int = 4, share: float = 1e-6) -> Model:
    """A model of texts; no texts give the fixed lists alone.

    Words are counted over all texts, where they are read; only counts are shuffled, so a repeat counts
    as often as it stands. What comes to the driver of them is one row per word met at least `least`
    times and in at least `share` of all that was seen: at most 1 / share rows. The weights are fitted
    on at most `rows` texts, the first ones in the order of a hash among about twice as many.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, int]] = Counter()

        def counts() -> pa.RecordBatch:
            keys = list(seen)
            batch = pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _, _ in keys], pa.string()), "word": pa.array([w for _, w, _ in keys], pa.string()), "which": pa.array([i for _, _, i in keys], pa.int32()), "n": pa.array([seen[k] for k in keys], pa.int64())})
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(observe(text or ""))
            if len(seen) > 200_000:
                yield counts()
        yield counts()

    given = texts.select(F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    seen = given.mapInArrow(counted, "kind string, word string, which int, n bigint").groupBy("kind", "word").agg(*[F.sum(F.when(F.col("which") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(3)], F.sum("n").alias("n"))
    seen = cut_lineage(seen)
    total = seen.agg(F.sum("n").alias("n")).first()["n"] or 0
    model = Model()
    for r in seen.where(F.col("n") >= max(least, share * total)).collect():
        if r["kind"] == "word":
            model.words[r["word"]] = (r["n0"], r["n1"], r["n2"])
        else:
            model.starters[r["word"]] = (r["n0"], r["n1"])
    n = given.count()
    if n:
        chosen = given.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 40)) < math.ceil(min(1.0, 2 * rows / n) * (1 << 40)))  # bounded before texts move
        sample = [r["_text"] for r in chosen.limit(rows).collect()]
        fit(labelled(sample, model), model)
        model.unspaced = CharacterChain.fit(stripped_runs(sample, model))
    return model


def unit_spans(text: Column, model: Model) -> Column:
    """ARRAY<INT> start, end, start, end, ... of the units of a text; empty for a null or blank one."""

    @F.arrow_udf("array<int>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut = Segmenter(model)
        for batch in batches:
            values, offsets = [], [0]
            for t in batch.to_pylist():
                if t:
                    for u in cut.units(t):
                        values.extend(u)
                offsets.append(len(values))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return spans(text)


def split_sentences(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, char_start, char_end): one row for each unit of each id. Repeated rows of an id count
    once, a null or blank text has no units. Whole texts stay where they are read; only the
    places of the units are shuffled."""
    marked = df.select(id_col, unit_spans(F.col(text_col), model).alias("_s"))
    once = marked.groupBy(id_col).agg(F.any_value("_s").alias("_s"))
    pairs = F.explode(F.expr("transform(sequence(0, size(_s) div 2 - 1), i -> struct(_s[2 * i] AS char_start, _s[2 * i + 1] AS char_end))"))
    return once.where("size(_s) > 0").select(id_col, pairs.alias("u")).select(id_col, "u.char_start", "u.char_end")
