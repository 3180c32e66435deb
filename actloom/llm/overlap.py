"""Records of evaluation splits that stand, wholly or nearly, in the training split.

Texts with the same set of words are one class. The classes of the evaluation side are cut into
shards of bounded size, and of each a full-text index over words is made: the rows of the sorted
suffixes by the word before them, which is all that backward search needs, and the text each row
belongs to. The classes of the training side stream through it. From every word of a training
text the match is extended to the left until it is rare in the shard, until it is long, or until
it is maximal; where it then stands, its text and the shard's may overlap. What ends maximal while
it is still frequent is not looked up, so pairs that share frequent words only are found by their
sets instead: of its frequent words, rarest first, each text has a prefix in which such a partner
must meet it. Matches of a pair are merged into one candidate, and the word sets of each candidate
are compared exactly.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.core.session import cut_lineage

SHARD_WORDS = 2_000_000  # words of the evaluation side in one index
SLICE_TEXTS = 100_000  # training texts that one task streams through one index
RARE = 16  # a match that stands at most so often in a shard is looked up
LONG = 20  # a match of so many words is looked up however often it stands
BLOCK = 2_000_000  # candidates or words of candidates that are held at once
LEVELS = 1 << 20  # buckets of words for which it is known how often they stand
LEAST_WORDS = 5
SIMILARITY = 0.8

RUN = re.compile(r"[^\W_]+")
# Characters without width.
WIDTHLESS = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe0e\ufe0f\ufeff]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case and compatibility form, without characters of no width."""
    return RUN.findall(unicodedata.normalize("NFKC", WIDTHLESS.sub("", text)).lower() if not text.isascii() else text.lower())


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order. (A sort: np.unique keeps a hash table, many times as slow.)"""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def hashed(text: Column) -> Column:
    """STRUCT words: 64-bit hashes of the words in order; n: how many differ; key: a digest of their set.
    Null for a null text; the key of a text of fewer than LEAST_WORDS different words is null."""

    @F.arrow_udf("struct<words: array<bigint>, n: int, key: binary>")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 1_000_000:
                known.clear()
            runs = [words_of(t) if t else [] for t in batch.to_pylist()]
            for w in {w for run in runs for w in run}.difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            lengths = np.fromiter(map(len, runs), np.int64, len(runs))
            flat = np.fromiter((known[w] for run in runs for w in run), np.uint64, int(lengths.sum()))
            members, owner, bounds = word_sets(flat, np.repeat(np.arange(len(runs)), lengths), len(runs))
            sizes = np.diff(bounds)
            keys = [xxhash.xxh3_128_digest(members[bounds[i] : bounds[i + 1]].tobytes()) if n >= LEAST_WORDS else None for i, n in enumerate(sizes.tolist())]
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))), pa.array(sizes.astype(np.int32)), pa.array(keys, pa.binary())], ["words", "n", "key"])

    return hashes(text)


def word_sets(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of each owner in order, their owners, and where each owner's begin."""
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    words, owner = words[fresh], owner[fresh]
    return words, owner, np.searchsorted(owner, np.arange(n + 1))


def sketches(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, 4) 256-bit sketches of word sets. Two sets that differ in d words have sketches that differ in at most d bits."""
    out = np.zeros((n, 4), np.uint64)
    with np.errstate(over="ignore"):
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bit = np.left_shift(np.uint64(1), (mixed >> np.uint64(58)))
    np.bitwise_or.at(out, (owner, ((mixed >> np.uint64(50)) & np.uint64(3)).astype(np.int64)), bit)
    return out


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a sequence by their first `depth` codes or more, by doubling of sorted prefixes.

    That is enough for matches shorter than `depth`: a step from a match to one that is longer by a
    code counts rows of an interval, and both intervals are told apart by the codes of the match.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(codes.max() + 1).bit_length())
    step = max(1, 62 // bits)  # so many codes fit into the first key
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: n - k] += codes[k:].astype(np.int64) + 1 if k < n else 0
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if step >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: max(0, n - step)] += rank[step:] + 1
        step *= 2


@dataclass
class WordIndex:
    """A full-text index over words for backward search.

    What is written is the transformed sequence (the word before each sorted suffix), the text each
    suffix lies in and the vocabulary: 8 bytes a word. All else follows from it.
    """

    vocabulary: np.ndarray  # sorted hashes
    before: np.ndarray  # the code before the suffix of each row; codes below `texts` are ends of texts
    text_of: np.ndarray  # which text the suffix of a row lies in
    keys: list[bytes]

    def __post_init__(self) -> None:
        texts, n, width = len(self.keys), len(self.before), len(self.vocabulary) + 1
        # sorted (word before, row): a search in it is one backward step
        self.steps = np.sort(self.before.astype(np.int64) * (n + 1) + np.arange(n))
        first = np.sort(self.before)  # the first word of each row's suffix
        self.starts = np.searchsorted(first, np.arange(texts + width))  # where the rows of each word begin
        real = first >= texts
        self.sets = distinct(self.text_of[real].astype(np.int64) * width + (first[real] - texts))
        owner = self.sets // width
        self.sizes = np.bincount(owner, minlength=texts).astype(np.int32)
        self.bits = sketches(self.vocabulary[self.sets % width], owner, texts)
        self.by_spread = np.empty(width, np.int64)  # place of each word when those in the fewest texts come first
        self.by_spread[np.argsort(np.bincount(self.sets % width, minlength=width), kind="stable")] = np.arange(width)

    @classmethod
    def build(cls, words: np.ndarray, offsets: np.ndarray, keys: list[bytes]) -> WordIndex:
        texts = len(offsets) - 1
        vocabulary = distinct(words)
        code = np.searchsorted(vocabulary, words)
        lengths = np.diff(offsets)
        # every text is followed by an end of its own, which sorts before all words
        sequence = np.empty(len(words) + texts, np.int32)
        sequence[np.arange(len(words)) + np.repeat(np.arange(texts), lengths)] = code + texts
        sequence[offsets[1:] + np.arange(texts)] = np.arange(texts)
        order = suffix_order(sequence, LONG + 1)
        return cls(vocabulary, sequence[order - 1], np.repeat(np.arange(texts, dtype=np.int32), lengths + 1)[order], keys)

    def code(self, words: np.ndarray) -> np.ndarray:
        """Codes of hashed words, -1 for those the index doesn't have."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def matches(self, code: np.ndarray, starts: np.ndarray, rare: int, long: int) -> tuple[np.ndarray, np.ndarray]:
        """Backward search from every word at once: (end of a match in the stream, text it stands in)."""
        texts, n = len(self.sizes), len(self.text_of)
        ends = np.flatnonzero(code >= 0)
        symbol = code[ends] + texts
        low, high = self.starts[symbol], self.starts[symbol + 1]  # the step from the empty match
        found_end, found_low, found_high = [], [], []
        for depth in range(1, long + 1):
            done = (high - low <= rare) | (depth == long)
            found_end.append(ends[done])
            found_low.append(low[done])
            found_high.append(high[done])
            at = ends - depth
            symbol = np.where((at >= starts[ends]) & ~done, code[np.maximum(at, 0)], -1)
            alive = symbol >= 0
            ends, low, high = ends[alive], low[alive], high[alive]
            if not len(ends):
                break
            base = (symbol[alive] + texts) * (n + 1)
            order = np.argsort(base + low)  # searches in order find their way much faster
            ends, base = ends[order], base[order]
            low, high = np.searchsorted(self.steps, base + low[order]), np.searchsorted(self.steps, base + high[order])
            alive = high > low
            ends, low, high = ends[alive], low[alive], high[alive]
        end, low, high = np.concatenate(found_end), np.concatenate(found_low), np.concatenate(found_high)
        count = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.repeat(end, count), self.text_of[rows]

    def prefixes(self, owner: np.ndarray, code: np.ndarray, sizes: np.ndarray, similarity: float, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, how many frequent words of the text from this one on) of sets given as (text, code).

        A pair that shares a word of at most `rare` places is found by its match. Any other pair that
        is similar enough shares frequent words only, and the rarest of them is in the prefix of both.
        """
        frequent = np.diff(self.starts)[len(self.sizes) :][code] > rare
        owner, code = owner[frequent], code[frequent]
        order = np.lexsort((self.by_spread[code], owner))
        owner, code = owner[order], code[order]
        first = np.searchsorted(owner, np.arange(len(sizes) + 1))
        left = first[owner + 1] - np.arange(len(owner))
        kept = left >= similarity * sizes[owner] - 1e-9
        return owner[kept], code[kept], left[kept]

    def postings(self, similarity: float, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word and size as one sorted key, text, frequent words left) of the prefixes of all texts."""
        width = len(self.vocabulary) + 1
        text, code, left = self.prefixes(self.sets // width, self.sets % width, self.sizes, similarity, rare)
        key = code * (int(self.sizes.max(initial=0)) + 2) + self.sizes[text]
        order = np.argsort(key, kind="stable")
        return key[order], text[order], left[order]

    def frequent_pairs(self, postings: tuple[np.ndarray, np.ndarray, np.ndarray], owner: np.ndarray, code: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float, rare: int) -> Iterator[np.ndarray]:
        """Candidates (streamed text * texts + text of the index) that share frequent words only, each once."""
        keys, text_of, left_of = postings
        base = int(self.sizes.max(initial=0)) + 2
        here, code, left = self.prefixes(owner, code, sizes, similarity, rare)
        # sizes that can be similar, and of which the words that are left are enough
        least = np.ceil(similarity * sizes[here] - 1e-9)
        most = np.minimum(sizes[here] / similarity, left * (1 + similarity) / similarity - sizes[here])
        low = np.searchsorted(keys, code * base + np.minimum(least, base - 1).astype(np.int64))
        high = np.searchsorted(keys, code * base + np.clip(np.floor(most + 1e-9), -1, base - 2).astype(np.int64), side="right")
        count = np.maximum(high - low, 0)
        total = np.concatenate([[0], np.cumsum(count)])
        ends = np.searchsorted(here, np.arange(len(sizes) + 1))  # a text's entries stay in one block
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(total[ends], total[ends[a]] + BLOCK, side="right")) - 1)
            part = slice(ends[a], ends[b])
            n = count[part]
            rows = np.repeat(low[part] - (total[part] - total[ends[a]]), n) + np.arange(n.sum())
            one, other = np.repeat(here[part], n), text_of[rows]
            common = similarity / (1 + similarity) * (sizes[one] + self.sizes[other]) - 1e-9
            near = left_of[rows] >= common
            one, other = one[near], other[near]
            near = np.bitwise_count(bits[one] ^ self.bits[other]).sum(1) <= np.minimum(sizes[one], self.sizes[other]) * (1 - similarity) / similarity + 1e-9
            yield distinct(one[near].astype(np.int64) * len(self.sizes) + other[near])
            a = b

    def overlaps(self, words: np.ndarray, offsets: np.ndarray, similarity: float, rare: int = RARE, long: int = LONG, at_once: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(streamed text, text of the index) of all pairs found whose word sets are similar enough."""
        postings = self.postings(similarity, rare)
        for a in range(0, len(offsets) - 1, at_once):
            b = min(a + at_once, len(offsets) - 1)
            part, bounds = words[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            owner = np.repeat(np.arange(b - a), np.diff(bounds))
            code = self.code(part)
            end, there = self.matches(code, bounds[:-1][owner], rare, long)
            here = owner[end]
            # the sets of the streamed texts: words the index doesn't have count for the size only
            order = np.lexsort((part, owner))
            fresh = np.ones(len(part), bool)
            fresh[1:] = (part[order][1:] != part[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            members = order[fresh]
            sizes = np.bincount(owner[members], minlength=b - a)
            bits = sketches(part[members], owner[members], b - a)
            least, most = np.minimum(sizes[here], self.sizes[there]), np.maximum(sizes[here], self.sizes[there])
            near = least >= similarity * most - 1e-9
            here, there, least = here[near], there[near], least[near]
            differ = np.bitwise_count(bits[here] ^ self.bits[there]).sum(1)
            near = differ <= least * (1 - similarity) / similarity + 1e-9
            merged = distinct(here[near].astype(np.int64) * len(self.sizes) + there[near])
            known = members[code[members] >= 0]
            known_owner, known_code = owner[known], code[known]
            yield from ((i + a, j) for i, j in self.exact(merged, known_owner, known_code, sizes, similarity))
            for more in self.frequent_pairs(postings, known_owner, known_code, sizes, bits, similarity, rare):
                more = np.setdiff1d(more, merged, assume_unique=True)
                yield from ((i + a, j) for i, j in self.exact(more, known_owner, known_code, sizes, similarity))

    def exact(self, merged: np.ndarray, owner: np.ndarray, code: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of candidates, those whose sets are similar enough: how many words of the streamed set are in the other."""
        width = len(self.vocabulary) + 1
        first = np.searchsorted(owner, np.arange(len(sizes) + 1))
        total = np.cumsum(np.diff(first)[merged // len(self.sizes)])
        a = 0
        while a < len(merged):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK, side="right")))
            here, there = merged[a:b] // len(self.sizes), merged[a:b] % len(self.sizes)
            count = first[here + 1] - first[here]
            pair = np.repeat(np.arange(len(here)), count)
            item = np.repeat(first[here] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            wanted = there[pair] * width + code[item]
            at = np.minimum(np.searchsorted(self.sets, wanted), len(self.sets) - 1)
            common = np.bincount(pair[self.sets[at] == wanted], minlength=len(here))
            union = sizes[here] + self.sizes[there] - common
            good = common >= similarity * union - 1e-9
            yield here[good], there[good]
            a = b


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


INDEX = "shard int, piece int, vocabulary binary, before binary, text_of binary, keys binary"


def _build(table: pa.Table) -> pa.Table:
    words, offsets = _lists(table["words"])
    ix = WordIndex.build(words, offsets, table["key"].to_pylist())
    row = [pa.array([table[c][0].as_py()], pa.int32()) for c in ("shard", "piece")]
    row += [*[pa.array([x.tobytes()], pa.binary()) for x in (ix.vocabulary, ix.before, ix.text_of)], pa.array([b"".join(ix.keys)], pa.binary())]
    return pa.table(row, names=[x.split()[0] for x in INDEX.split(", ")])


def _search(index: pa.Table, stream: pa.Table, similarity: float) -> pa.Table:
    a, b = [], []
    if index.num_rows and stream.num_rows:
        raw = {c: index[c][0].as_py() for c in ("vocabulary", "before", "text_of", "keys")}
        keys = [raw["keys"][i : i + 16] for i in range(0, len(raw["keys"]), 16)]
        ix = WordIndex(np.frombuffer(raw["vocabulary"], np.uint64), np.frombuffer(raw["before"], np.int32), np.frombuffer(raw["text_of"], np.int32), keys)
        words, offsets = _lists(stream["words"])
        own = stream["key"].to_pylist()
        for here, there in ix.overlaps(words, offsets, similarity):
            for i, j in zip(here.tolist(), there.tolist()):
                if own[i] != ix.keys[j]:
                    a.append(min(own[i], ix.keys[j]))
                    b.append(max(own[i], ix.keys[j]))
    return pa.table({"key_a": pa.array(a, pa.binary()), "key_b": pa.array(b, pa.binary())})


def word_levels(classes: DataFrame) -> np.ndarray:
    """How often words stand on the evaluation side, as a level for each of LEVELS buckets of words; 0 for none.
    What comes to the driver is a row for a bucket, however many words and texts there are."""
    words = classes.where("is_eval").select(F.explode("words").alias("word"))
    counts = words.groupBy(F.pmod("word", F.lit(LEVELS)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(LEVELS, np.uint8)
    out[counts["bucket"].to_numpy()] = 1 + np.floor(np.log2(counts["n"].to_numpy())).astype(np.uint8)
    return out


def routes(words: Column, levels: np.ndarray, shards: int, similarity: float) -> Column:
    """ARRAY<INT> the shards that a text meets its partners in. Words stand in one order for all texts,
    the rarest first; the first word that two similar texts share is then among the first
    n - similarity * n + 1 of either's n words, so those name the shards. Words that the evaluation
    side doesn't have name none."""

    @F.arrow_udf("array<int>")
    def routed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, offsets = _lists(pa.chunked_array([batch]))
            n = len(offsets) - 1
            flat, owner, bounds = word_sets(flat, np.repeat(np.arange(n), np.diff(offsets)), n)
            level = levels[(flat.view(np.int64) % LEVELS)]
            order = np.lexsort((flat, level, owner))
            sizes = np.diff(bounds)
            place = np.arange(len(flat)) - np.repeat(bounds[:-1], sizes)
            first = place < np.repeat(sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, sizes)
            order = order[first]
            order = order[level[order] > 0]
            with np.errstate(over="ignore"):
                shard = ((flat[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(shards)
            named = distinct(owner[order] * shards + shard.astype(np.int64))
            yield pa.ListArray.from_arrays(pa.array(np.searchsorted(named // shards, np.arange(n + 1)).astype(np.int32)), pa.array((named % shards).astype(np.int32)))

    return routed(words)


def class_pairs(classes: DataFrame, similarity: float = SIMILARITY, shard_words: int = SHARD_WORDS, slice_texts: int = SLICE_TEXTS) -> DataFrame:
    """(key_a, key_b), key_a < key_b: classes of (key, words, n, is_train, is_eval), one of them on
    each side, that overlap. classes is read several times: hand in a written table.

    While the evaluation side fills fewer shards than a text has words that could name one, a
    training text meets all of them; beyond that both sides go to the shards that their rarest words
    name, so a text is copied by its own length at most and not by the size of the other side. A
    shard that a word of many texts fills is cut into pieces, each an index of its own, and the
    training texts that meet it into slices.
    """
    spark = classes.sparkSession
    names = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    n = classes.agg(F.sum(F.when(F.col("is_eval"), F.size("words"))).alias("words"), F.count_if("is_train").alias("texts"), F.avg(names).alias("names")).first()
    shards, copies = max(1, -(-(n["words"] or 0) // shard_words)), math.ceil(n["names"] or 1)
    hashed_to = lambda salt, of: F.pmod(F.xxhash64("key", F.lit(salt)), of).cast("int")
    if shards <= copies:
        met = {"is_eval": F.array(hashed_to("shard", F.lit(shards))), "is_train": F.sequence(F.lit(0), F.lit(shards - 1))}
    else:
        shards *= copies
        classes = cut_lineage(classes.withColumn("named", routes(F.col("words"), word_levels(classes), shards, similarity)))
        met = dict.fromkeys(("is_eval", "is_train"), F.col("named"))
    side = lambda flag: classes.where(flag).select("key", "words", F.explode(met[flag]).alias("shard"))
    fill = min(-(-n["texts"] // 2000), -(-spark.sparkContext.defaultParallelism // shards))
    load = side("is_eval").groupBy("shard").agg(F.sum(F.size("words")).alias("w")).join(side("is_train").groupBy("shard").agg(F.count(F.lit(1)).alias("t")), "shard")
    load = cut_lineage(load.select("shard", F.ceil(F.col("w") / (1.5 * shard_words)).cast("int").alias("pieces"), F.greatest(F.ceil(F.col("t") / slice_texts).cast("int"), F.lit(fill)).alias("slices")))
    built = side("is_eval").join(load, "shard").withColumn("piece", hashed_to("piece", F.col("pieces"))).select("shard", "piece", "key", "words").groupBy("shard", "piece").applyInArrow(_build, INDEX)
    index = cut_lineage(built).join(load.select("shard", "slices"), "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    stream = side("is_train").join(load, "shard").select("key", "words", "shard", hashed_to("slice", F.col("slices")).alias("slice"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    at = ["shard", "piece", "slice"]
    found = index.groupBy(at).cogroup(stream.groupBy(at)).applyInArrow(lambda i, s: _search(i, s, similarity), "key_a binary, key_b binary")
    return found.distinct()


def cross_split_overlaps(records: DataFrame, ns: str, id_col: str, text: str, split: str, train: str = "train", similarity: float = SIMILARITY) -> DataFrame:
    """(ns, id_a, id_b), id_a < id_b: records of one ns of which exactly one is in train and whose
    word sets are similar enough. records may hold a record many times. Null and short texts
    overlap with nothing; a null split counts as not in train."""
    rows = records.select(ns, F.col(id_col).alias("_id"), F.col(text).alias("_text"), (F.coalesce(F.col(split), F.lit("")) == train).alias("_train"))
    texts = rows.groupBy("_id").agg(F.max("_text").alias("_text"), F.bool_or("_train").alias("is_train"), F.bool_or(~F.col("_train")).alias("is_eval"))
    coded = cut_lineage(texts.select("_id", hashed(F.col("_text")).alias("h"), "is_train", "is_eval").where("h.key is not null").select("_id", "h.*", "is_train", "is_eval"))
    classes = cut_lineage(coded.groupBy("key").agg(F.min_by("words", "_id").alias("words"), F.any_value("n").alias("n"), F.bool_or("is_train").alias("is_train"), F.bool_or("is_eval").alias("is_eval")))
    members = cut_lineage(rows.groupBy(ns, "_id").agg(F.bool_or("_train").alias("_train")).join(coded.select("_id", "key"), "_id"))
    near = class_pairs(classes, similarity)
    a = members.select(ns, F.col("_id").alias("id_a"), F.col("_train").alias("train_a"), F.col("key").alias("key_a"))
    b = members.select(ns, F.col("_id").alias("id_b"), F.col("_train").alias("train_b"), F.col("key").alias("key_b"))
    across = near.join(a, "key_a").join(b, [ns, "key_b"]).where("train_a <> train_b").select(ns, "id_a", "id_b")
    same = a.where("train_a").join(b.where("not train_b").withColumnRenamed("key_b", "key_a"), [ns, "key_a"]).select(ns, "id_a", "id_b")
    return across.unionByName(same).select(ns, F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def overlap_report(pairs: DataFrame, records: DataFrame, ns: str, id_col: str, split: str, source: str, train: str = "train") -> DataFrame:
    """(ns, split, source, n_records, n_overlapping) for the splits other than train."""
    one = records.groupBy(ns, id_col).agg(F.min(split).alias(split), F.min(source).alias(source)).where(F.coalesce(F.col(split), F.lit("")) != train)
    hit = pairs.select(ns, F.explode(F.array("id_a", "id_b")).alias(id_col)).distinct().withColumn("_hit", F.lit(1))
    return one.join(hit, [ns, id_col], "left").groupBy(ns, split, source).agg(F.count(F.lit(1)).alias("n_records"), F.count("_hit").alias("n_overlapping"))
