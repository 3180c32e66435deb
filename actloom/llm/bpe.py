"""Corpus encoding with a public byte-level BPE vocabulary, by traversal of a trie of distinct words.

A byte-level BPE has the property that the encoding of a prefix is known from one token: the
last one. So each trie node needs only that token as its state:

    last[0] is empty
    last[d] = the token t that ends at depth d such that t may follow last[d - len(t)]

where "may follow" means that merging the bytes of the pair gives just the pair. Words are
visited in sorted order, which is the depth-first order of their trie; the states of the prefix
shared with the word before are on the stack already, so every shared prefix is encoded once.
The word's ids are read off backwards from the last state.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"

# Fixed value: the word pattern published with the byte-level vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TrieEncoder:
    """Word to ids, with a bounded memo of words.

    `memo_bytes` bounds what the memo holds; when it is full it starts anew, so a stream of
    ever new words costs time but no memory.
    """

    def __init__(self, path: str, memo_bytes: int = 48 << 20):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.follows: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_bytes, self.held = memo_bytes, 0
        self.find = regex.compile(WORD_PATTERN).findall

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: the lowest-ranked adjacent pair is joined until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = min((rank(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            known = self.follows[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words by one depth-first pass over their trie."""
        out: dict[str, tuple[int, ...]] = {}
        ranks, follows, may_follow, longest = self.ranks, self.follows, self.may_follow, self.longest
        last: list[int] = [-1]  # last[d]: the token that ends the encoding of the first d bytes
        size: list[int] = [0]
        before = b""
        todo = []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            if (i := ranks.get(data)) is not None:
                out[w] = (i,)
            else:
                todo.append((data, w))
        todo.sort()
        for data, w in todo:
            shared = len(os.path.commonprefix((before, data)))
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                for start in range(max(0, end - longest), end):
                    t = ranks.get(data[start:end])
                    if t is None:
                        continue
                    if start == 0:
                        break
                    p = last[start]
                    ok = follows.get((p, t))
                    if ok or ok is None and may_follow(p, t):
                        break
                last.append(t)
                size.append(end - start)
            ids, at = [], len(data)
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[w] = tuple(ids)
            before = data
        return out

    def learn(self, words: set[str]) -> None:
        """Puts the ids of all words into the memo."""
        memo = self.memo
        new = words.difference(memo)
        if not new:
            return
        weight = sum(map(len, new)) * 4 + 120 * len(new)
        if self.held + weight > self.memo_bytes:
            memo.clear()
            new, self.held = words, sum(map(len, words)) * 4 + 120 * len(words)
        else:
            self.held += weight
        memo.update(self.encode_words(new))

    def encode(self, texts: list[str | None], block_chars: int = 400_000) -> Iterator[list[tuple[int, ...]]]:
        """For each text the ids of its words; null and empty texts have none. Words of a block of texts make one trie."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < block_chars):
                chars += len(texts[end] or "")
                end += 1
            split = [self.find(t) if t else [] for t in texts[at:end]]
            self.learn(set(itertools.chain.from_iterable(split)))
            memo = self.memo
            for words in split:
                yield [memo[w] for w in words]
            at = end


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder per worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode_text(text: Column, tokenizer_dir: str = TOKENIZER_DIR, file: str = BYTE_BPE) -> Column:
    """ARRAY<INT> of the ids of a text, without special tokens; strings that look like special
    tokens are plain text; a null or empty text has the empty list. No shuffle: each batch is
    encoded where it was read."""
    path = os.path.join(tokenizer_dir, file)

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        chain = itertools.chain.from_iterable
        for batch in texts:
            values, counts = [], np.zeros(len(batch) + 1, np.int64)
            for i, words in enumerate(enc.encode(batch.to_pylist())):
                flat = np.fromiter(chain(words), np.int32)
                counts[i + 1] = len(flat)
                values.append(flat)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))

    return ids(text)


def token_count(text: Column, tokenizer_dir: str = TOKENIZER_DIR, file: str = BYTE_BPE) -> Column:
    """BIGINT number of ids of a text; 0 for a null or empty one."""
    path = os.path.join(tokenizer_dir, file)

    @F.arrow_udf("bigint")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for batch in texts:
            yield pa.array([sum(map(len, words)) for words in enc.encode(batch.to_pylist())], pa.int64())

    return count(text)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, file: str = BYTE_BPE) -> DataFrame:
    """(id, ids): one row for each row of df, repeated rows too. Other columns never reach the scan."""
    return df.select(F.col(id_col), encode_text(F.col(text_col), tokenizer_dir, file).alias("ids"))
