"""Cutting items that are too long into pieces, at valleys of lexical cohesion.

Words are counted per stretch between two sentence ends, and weighted by how few stretches of the
text they stand in and how narrowly these lie. The cosine of the counts of the blocks before and after a sentence end is its
cohesion; how far that lies below the peaks to either side is the depth of its valley. Each piece ends at the deepest valley
of its size window, where the text pauses at all: at a blank line or sentence end if there is
one, else at a line end, clause or space, and inside a word only if a run without any of these
is longer than the limit. The next piece begins up to `overlap` characters earlier, at a pause.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 10  # stretches to either side that are compared
SENTENCE_MARKS = ".!?…。！？।۔؟"
WIDE_MARKS = "。！？।۔؟…"
CLAUSE_MARKS = ",;:，、；：،؛"
WIDE_CLAUSE_MARKS = "，、；："  # no blank follows
CLOSERS = "\"'»”’」』)）]】“"

# ranks of a pause
RUN_END, SPLIT_MARK, SPACE, CLAUSE, LINE, SENTENCE, PARAGRAPH = 1, 2, 3, 4, 5, 6, 7


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    """Per code point: letter or digit, white space, sentence mark, and so on; the lower-case form."""
    n = 0x110000
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x30000)]
    flag = lambda test: np.concatenate([np.fromiter(map(test, chars), bool, len(chars)), np.zeros(n - len(chars), bool)])
    of = lambda marks: np.isin(np.arange(n), np.array([ord(c) for c in marks]))
    word, space = flag(str.isalnum), flag(str.isspace)
    space[0xD800:0xE000] = False
    lower = np.arange(n, dtype=np.uint64)
    lower[: len(chars)] = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars]
    unspaced = np.zeros(n, bool)
    for a, b in ((0xE00, 0xE80), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000)):
        unspaced[a:b] = True
    joins = flag(lambda c: unicodedata.category(c)[0] == "M" or c == "‍")
    return {"word": word, "space": space, "mark": of(SENTENCE_MARKS), "wide": of(WIDE_MARKS), "clause": of(CLAUSE_MARKS), "wide_clause": of(WIDE_CLAUSE_MARKS), "closer": of(CLOSERS), "lower": lower, "unspaced": unspaced, "joins": joins}


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    fresh: int  # where the characters begin that the piece before does not have
    hard: bool  # it ends inside a run without white space or end marks that is longer than the limit


def pauses(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places a cut may have (before which character) and their ranks."""
    t = _tables()
    n = len(points)
    space, mark = t["space"][points], t["mark"][points]
    rank = np.zeros(n + 1, np.uint8)
    pause = space | mark
    rank[np.flatnonzero(pause[1:] & ~pause[:-1]) + 1] = RUN_END
    rank[np.flatnonzero(t["wide_clause"][points]) + 1] = CLAUSE
    rank[np.flatnonzero(mark) + 1] = SPLIT_MARK
    rank[np.flatnonzero(t["wide"][points]) + 1] = SENTENCE
    # a run of white space: the cut lies after it
    ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    starts = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]))
    starts = starts[: len(ends)] if not (n and space[-1]) else starts[:-1][: len(ends)]
    if len(ends):
        newlines = np.concatenate([[0], np.cumsum((points == 10) | (points == 0x2028) | (points == 0x2029) | (points == 12))])
        breaks = newlines[ends] - newlines[starts]
        last = np.maximum(starts - 1, 0)
        for _ in range(3):  # closing quotes and brackets after the mark
            last = np.where(t["closer"][points[last]] & (last > 0), last - 1, last)
        level = np.full(len(ends), SPACE, np.uint8)
        level[t["clause"][points[last]]] = CLAUSE
        level[breaks == 1] = LINE
        level[t["mark"][points[last]]] = SENTENCE
        level[breaks > 1] = PARAGRAPH
        rank[ends] = level
    # closers stay with the mark before them, marks that follow one another are one end
    closer = t["closer"][points] | mark
    for _ in range(4):
        at = np.flatnonzero((rank[:-1] > 0) & (rank[:-1] != PARAGRAPH) & closer)
        at = at[(at > 0) & mark[np.maximum(at - 1, 0)] | (at > 1) & t["closer"][points[np.maximum(at - 1, 0)]] & mark[np.maximum(at - 2, 0)]]
        at = at[~space[np.maximum(at - 1, 0)]]
        if not len(at):
            break
        rank[at + 1] = np.maximum(rank[at + 1], rank[at])
        rank[at] = np.minimum(rank[at], SPLIT_MARK)
    places = np.flatnonzero(rank[1:n] > 0) + 1
    return places, rank[places]


def word_codes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, 64-bit hash) of every word; a character of a script without spaces is a word."""
    t = _tables()
    word = t["word"][points]
    begins = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | t["unspaced"][points]))
    if not len(begins):
        return begins, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        values = np.where(word, t["lower"][points] + np.uint64(1), np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15)
        rolled = values ^ (values >> np.uint64(29))
        first = begins[0]
        place = np.arange(len(points) - first) - np.repeat(begins - first, np.diff(np.append(begins, len(points))))
        total = np.add.reduceat(rolled[first:] * (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(3)), begins - first)
    return begins, total


def cohesion(points: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """At each gap the cosine of the word counts of the BLOCK stretches before it and after it.

    Counts are exact and weighted by how few stretches of the text a word stands in and how near
    together these lie, so words that stand everywhere say nothing; nor does a word of one stretch.
    """
    begins, codes = word_codes(points)
    stretches = len(gaps) + 1
    order = np.lexsort((begins, codes))
    codes, at = codes[order], np.searchsorted(gaps, begins[order], "right")
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(codes)))
    codes, at = codes[first], at[first]  # one entry a word and stretch, by word and then by stretch
    new_word = np.concatenate([[True], codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, bool)
    word = np.cumsum(new_word) - 1
    starts = np.flatnonzero(new_word)
    times = np.diff(np.append(starts, len(word)))
    span = (at[starts + times - 1] - at[starts]) / stretches if len(word) else at
    rarity = np.where(times > 1, np.log((stretches + 1) / np.maximum(times, 1)) * (1 - span), 0.0)
    weight = np.log1p(count) * rarity[word]
    # products of the stretches that lie less than two blocks apart: band[j, d] is that of j and j + d
    reach = 2 * BLOCK
    band = np.zeros((stretches + 2 * reach, reach))
    band[reach : reach + stretches, 0] = np.bincount(at, weight * weight, stretches)
    for d in range(1, reach):
        apart = at[d:] - at[:-d]
        near = np.flatnonzero((word[d:] == word[:-d]) & (apart < reach))
        if not len(near):
            break
        band[reach : reach + stretches] += np.bincount(at[near] * reach + apart[near], weight[near] * weight[near + d], stretches * reach).reshape(stretches, reach)
    i = np.arange(1, stretches) + reach
    both = sum(band[i - a, a + b] for a in range(1, BLOCK + 1) for b in range(BLOCK))
    own = sum((1 if d == 0 else 2) * band[i - a, d] for a in range(1, BLOCK + 1) for d in range(a))
    other = sum((1 if d == 0 else 2) * band[i + b, d] for b in range(BLOCK) for d in range(BLOCK - b))
    return both / np.maximum(np.sqrt(own * other), 1e-9)


def depths(points: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The depth of the cohesion valley at each gap, 0 to 2."""
    if len(gaps) < 3:
        return np.zeros(len(gaps))
    level = cohesion(points, gaps)
    # peaks: the highest cohesion within a block to either side
    reach = 2 * BLOCK
    views = np.lib.stride_tricks.sliding_window_view(np.pad(level, reach, mode="edge"), reach + 1)
    return np.maximum(views[: len(gaps)].max(1) - level, 0) + np.maximum(views[reach : reach + len(gaps)].max(1) - level, 0)


def cut(text: str, limit: int, overlap: int) -> list[Piece]:
    """The pieces of a text, each of at most `limit` characters; one piece if it is not longer.

    The fresh parts of the pieces, put together, are the text. An empty text has no pieces.
    """
    n = len(text)
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if n <= limit:
        return [Piece(0, n, 0, False)] if n else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    places, ranks = pauses(points)
    by_rank = {r: places[ranks >= r] for r in (RUN_END, SPLIT_MARK, SPACE, CLAUSE, LINE, SENTENCE)}
    ends = by_rank[SENTENCE]
    depth = depths(points, ends) + 0.1 * (ranks[ranks >= SENTENCE] == PARAGRAPH)
    joins = _tables()["joins"]
    stops = np.flatnonzero(_tables()["space"][points] | _tables()["mark"][points])

    def in_long_run(end: int) -> bool:
        """Whether a cut lies inside a run without white space or end marks that is longer than the limit."""
        k = int(np.searchsorted(stops, end, "left"))
        first = int(stops[k - 1]) + 1 if k else 0
        return first < end and (int(stops[k]) if k < len(stops) else n) - first > limit and (k == len(stops) or stops[k] != end)

    out: list[Piece] = []
    at, start = 0, 0
    while n - start > limit:
        most = start + limit
        roomy = max(at + 1, min(most, at + limit - overlap))
        half = at + (roomy - at) // 2
        hard = False
        for low, high in ((half, roomy), (at, half), (roomy, most)):
            a, b = np.searchsorted(ends, (low, high), "right")
            if b > a:
                end = int(ends[a + int(np.argmax(depth[a:b]))])
                break
        else:
            end = 0
            for rank in (LINE, CLAUSE, SPACE, SPLIT_MARK, RUN_END):
                for high in (roomy, most, at + limit):
                    k = int(np.searchsorted(by_rank[rank], high, "right")) - 1
                    if k >= 0 and by_rank[rank][k] > at:
                        end = int(by_rank[rank][k])
                        break
                if end:
                    break
            if not end:
                if n - at <= limit:  # with less of an overlap the rest is one piece
                    start = max(start, n - limit) if in_long_run(at) else at
                    break
                end = start + limit
                while end > at + 1 and joins[points[end]]:
                    end -= 1
            elif end - start > limit:
                start = at  # a long run is kept whole without an overlap before it
            hard = in_long_run(end)
        out.append(Piece(start, end, at, hard))
        at = start = end
        if overlap and n - at > 0:
            least = max(end - overlap, out[-1].fresh)
            for rank in (SENTENCE, LINE, CLAUSE, SPACE):
                k = int(np.searchsorted(by_rank[rank], least, "left"))
                if k < len(by_rank[rank]) and by_rank[rank][k] < end:
                    start = int(by_rank[rank][k])
                    break
            else:
                start = least if hard else end
    out.append(Piece(start, n, at, False))
    return out


PIECES = "piece_index int, char_start int, char_end int, fresh_start int, hard_cut int, piece string"


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: str, overlap: str, with_text: bool = True) -> DataFrame:
    """The pieces of the rows of df whose text is longer than its limit: keys and PIECES.

    Rows with a null text or limit have none. Only rows that are too long reach Python, and
    pieces are made where a row is read; nothing is shuffled. A row that comes twice has its
    pieces twice. Without `with_text` the column piece is left out.
    """
    rows = df.where(F.length(text) > F.col(limit)).select(*keys, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("_overlap"))
    kept = PIECES if with_text else PIECES.rpartition(",")[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", " + kept

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found, texts = [], [], []
            for i, (t, most, over) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_text", "_limit", "_overlap")))):
                for k, p in enumerate(cut(t, most, min(over, most - 1))):
                    take.append(i)
                    found.append((k + 1, p.start, p.end, p.fresh, int(p.hard)))
                    if with_text:
                        texts.append(t[p.start : p.end])
            columns = [batch.column(c).take(pa.array(take, pa.int64())) for c in keys]
            numbers = np.array(found, np.int32).reshape(-1, 5)
            columns += [pa.array(numbers[:, j]) for j in range(5)] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *[x.split()[0] for x in kept.split(", ")]])

    return rows.mapInArrow(cut_all, schema)
