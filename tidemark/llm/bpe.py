"""Encoding of a corpus with a byte-level BPE vocabulary given as ranks.

Merging uses a rank queue: a bucket per merge rank holds positions of a linked list of symbols, and a hierarchical
bitmap over the ranks finds the least non-empty bucket by find-first-set. Entries that later merges made stale are
skipped when popped. So a pre-token of n bytes takes about n steps however long it is, without a scan for the next
merge. All new pre-tokens of a batch share one queue: their lists lie side by side, and a bucket is merged at once.

A merge can, in a vocabulary that wasn't trained by merging, make a pair of lower rank than its own; only then does the
order within one bucket matter, and the pre-tokens concerned are encoded again one merge at a time.

Text is cut at single spaces between non-spaces, where no pre-token can continue, and each distinct piece is split by
the pattern and merged once for each worker.

Defined cases: a null and an empty text have the empty list; special tokens in a text are ordinary text; texts are
never cut; extra columns are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: Pieces and pre-tokens that a worker remembers before it starts afresh; this bounds its memory, not what it encodes.
REMEMBERED = 400_000


class RankQueue:
    """Buckets by rank; three levels of 64-bit words say which are filled."""

    def __init__(self, ranks: int):
        n0 = ranks // 64 + 1
        n1 = n0 // 64 + 1
        self.low, self.mid, self.top = [0] * n0, [0] * n1, 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, item) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [item]
            w, v = rank >> 6, rank >> 12
            self.low[w] |= 1 << (rank & 63)
            self.mid[v] |= 1 << (w & 63)
            self.top |= 1 << v
        else:
            bucket.append(item)

    def first(self) -> int:
        """The least rank with a filled bucket, or -1."""
        if not self.top:
            return -1
        v = (self.top & -self.top).bit_length() - 1
        m = self.mid[v]
        w = (v << 6) + (m & -m).bit_length() - 1
        x = self.low[w]
        return (w << 6) + (x & -x).bit_length() - 1

    def take(self, rank: int) -> list:
        items = self.buckets.pop(rank)
        w, v = rank >> 6, rank >> 12
        self.low[w] &= ~(1 << (rank & 63))
        if not self.low[w]:
            self.mid[v] &= ~(1 << (w & 63))
            if not self.mid[v]:
                self.top &= ~(1 << v)
        return items


class Vocabulary:
    """Ranks of byte strings, and the rank of each pair of tokens that joins to one."""

    def __init__(self, text: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)}
        self.size = max(self.ranks.values()) + 1
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        get = self.ranks.get
        keys, values = [], []
        for word, rank in self.ranks.items():
            for k in range(1, len(word)):
                left, right = get(word[:k]), get(word[k:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(values, dtype=np.int32)[order]
        self.pairs = dict(zip(keys, values))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it doesn't join."""
        keys = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_one(self, word: bytes) -> list[int]:
        """One merge at a time: least rank first, then leftmost."""
        sym = [int(x) for x in self.of_byte[np.frombuffer(word, np.uint8)]]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [-1] * n
        queue, get = RankQueue(self.size), self.pairs.get

        def look(i: int) -> None:
            j = after[i]
            rank[i] = get(sym[i] << 20 | sym[j], -1) if j < n else -1
            if rank[i] >= 0:
                bucket = queue.buckets.get(rank[i])
                if bucket is None:
                    queue.push(rank[i], i)
                else:
                    heapq.heappush(bucket, i)

        for i in range(n - 1):
            look(i)
        while (r := queue.first()) >= 0:
            bucket = queue.buckets[r]
            i = heapq.heappop(bucket)
            if not bucket:
                queue.take(r)
            if rank[i] != r:
                continue
            j = after[i]
            sym[i], rank[j], after[i] = r, -1, after[j]
            sym[j] = -1
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [s for s in sym if s >= 0]

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word); words aren't empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)].copy()
        n = len(sym)
        word_of = np.repeat(np.arange(len(words)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(size)
        after[ends - 1] = -1
        before[ends - size] = -1
        rank = np.full(n, NONE, dtype=np.int32)
        queue = RankQueue(self.size)

        def look(at: np.ndarray) -> np.ndarray:
            """Rank the pairs that start at these positions, and queue them."""
            found = self.pair(sym[at], sym[after[at]])
            rank[at] = found
            some = found != NONE
            at, found = at[some], found[some]
            if len(found) == 1:
                queue.push(int(found[0]), at)
            elif len(found):
                order = np.argsort(found, kind="stable")
                at, found = at[order], found[order]
                cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
                for r, part in zip(found[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                    queue.push(r, part)
            return found

        irregular: list[np.ndarray] = []
        look(np.flatnonzero(after >= 0))
        while (r := queue.first()) >= 0:
            parts = queue.take(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank[at] == r]
            if len(at) == 0:
                continue
            if len(at) > 1:
                at = np.sort(at)
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # of a chain of overlapping pairs every other one merges, from the left
                    index = np.arange(len(at))
                    start = np.r_[True, ~chained]
                    at = at[(index - np.maximum.accumulate(np.where(start, index, 0))) % 2 == 0]
            gone = after[at]
            sym[at] = r
            sym[gone] = -1
            rank[gone] = NONE
            rank[at] = NONE
            then = after[gone]
            after[at] = then
            follows = then >= 0
            before[then[follows]] = at[follows]
            left = before[at]
            touched = np.concatenate((at[follows], left[left >= 0]))
            if len(touched):
                touched = np.unique(touched) if len(touched) > 1 else touched
                found = look(touched)
                if len(found) and found.min() < r:
                    irregular.append(word_of[touched[rank[touched] < r]])
        kept = sym >= 0
        ids, counts = sym[kept], np.bincount(word_of[kept], minlength=len(words))
        if irregular:
            again = set(np.concatenate(irregular).tolist())
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in again:
                parts[k] = np.array(self.encode_one(words[k]), dtype=np.int32)
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, counts


@cache
def _splitters() -> tuple:
    """The pattern for ``re``, with its classes spelled out for the basic plane (much faster), and for ``regex``."""

    def ranges(wanted) -> str:
        out, start = [], None
        for c in range(0x10001):
            inside = c < 0x10000 and wanted(chr(c))
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                out.append(f"\\u{start:04x}" + (f"-\\u{c - 1:04x}" if c - 1 > start else ""))
                start = None
        return "".join(out)

    full = regex.compile(PATTERN)
    letter, number, space = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")
    L, N, S = (ranges(lambda ch, p=p: p.match(ch) is not None) for p in (letter, number, space))
    fast = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{S}{L}{N}]").replace(r"\p{L}", f"[{L}]").replace(r"\p{N}", f"[{N}]").replace(r"\S", f"[^{S}]").replace(r"\s", f"[{S}]"))
    return fast, full


def split(text: str) -> list[str]:
    fast, full = _splitters()
    if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
        return fast.findall(text)
    return full.findall(text)


class _Codes(dict):
    """Numbers its keys in order of appearance and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        self.new.append(key)
        return code


class _Pieces(dict):
    """Codes of pieces, which stand for a space and themselves, and of chunks, which stand for themselves only.

    A piece that is empty or has white space at an end is -1: it belongs to its neighbours.
    """

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.count = 0
        self.chunks: dict[str, int] = {}

    def _add(self, text: str) -> int:
        self.new.append(text)
        self.count += 1
        return self.count - 1

    def __missing__(self, key: str) -> int:
        self[key] = code = -1 if not key or key[0].isspace() or key[-1].isspace() else self._add(" " + key)
        return code

    def chunk(self, text: str) -> int:
        if (code := self.chunks.get(text)) is None:
            self.chunks[text] = code = self._add(text)
        return code


class _Store:
    """Lists of ids by code."""

    def __init__(self):
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def gather(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.size[codes]
        total = int(sizes.sum())
        shift = self.start[codes] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(total)]


class Encoder:
    """Encodes batches of texts; remembers the pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.pieces, self.words = _Pieces(), _Codes()
        self.piece_ids, self.word_ids = _Store(), _Store()

    def _learn_words(self) -> None:
        new, self.words.new = self.words.new, []
        if new:
            self.word_ids.add(*self.vocabulary.encode_all([w.encode("utf-8", "replace") for w in new]))

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the pieces of all texts in a row, number of pieces of each text)."""
        parts: list[str] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                own = text.split(" ")
                sizes[k] = len(own)
                parts += own
        if not parts:
            return np.empty(0, np.int64), sizes
        codes = np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts))
        starts = np.zeros(len(parts), dtype=bool)
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        # a piece that isn't whole goes with its neighbours in the text; the first has no space before it
        odd = codes < 0
        joined = odd | starts
        joined[1:] |= odd[:-1] & ~starts[1:]
        joined[:-1] |= odd[1:] & ~starts[1:]
        begins = joined & starts
        begins[1:] |= joined[1:] & ~joined[:-1]
        first = np.flatnonzero(begins)
        last = np.flatnonzero(joined & np.r_[~joined[1:] | starts[1:], True])
        chunk = self.pieces.chunk
        for a, b, top in zip(first.tolist(), last.tolist(), starts[first].tolist()):
            codes[a] = chunk(("" if top else " ") + " ".join(parts[a : b + 1]))
        kept = ~joined | begins
        text_of = np.repeat(np.arange(len(texts)), sizes)[kept]
        return codes[kept], np.bincount(text_of, minlength=len(texts))

    def encode(self, texts: list[str | None], count_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); the ids are left out with ``count_only``."""
        if self.pieces.count > REMEMBERED or len(self.words) > REMEMBERED:
            self.forget()
        codes, pieces = self._codes(texts)
        word = self.words.__getitem__
        new, self.pieces.new = self.pieces.new, []
        if new:
            split_new = [list(map(word, split(p))) for p in new]
            self._learn_words()
            flat = np.array([x for s in split_new for x in s], dtype=np.int64)
            sizes = np.add.reduceat(self.word_ids.size[flat], np.cumsum([0, *map(len, split_new)])[:-1])
            self.piece_ids.add(self.word_ids.gather(flat), sizes)
        total = np.concatenate(([0], np.cumsum(self.piece_ids.size[codes])))
        ends = np.cumsum(pieces)
        counts = total[ends] - total[ends - pieces]
        return None if count_only else self.piece_ids.gather(codes), counts


_encoders: dict[int, Encoder] = {}


def encoder_for(ranks: bytes) -> Encoder:
    """This worker's encoder."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(ranks))
    return _encoders[key]


#: Texts that are encoded at a time.
STEP = 1024


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file: a path with a scheme is read through the cluster's file systems, any other from the driver's disk."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def encode_documents(documents: DataFrame, ranks_path: str = DEFAULT_RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each text. The vocabulary file (some MB, whatever the corpus) is read here and broadcast."""
    spark = documents.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                ids, counts = encoder.encode(part.column(1).to_pylist())
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], ranks_path: str = DEFAULT_RANKS, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of token ids of each text."""
    spark = documents.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks.value)
        for batch in batches:
            texts = batch.column(len(keep))
            counts = [encoder.encode(texts.slice(at, STEP).to_pylist(), count_only=True)[1] for at in range(0, batch.num_rows, STEP)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=[*keep, "tokens"])

    columns = [documents.schema[c] for c in keep]
    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in columns), "tokens bigint"])
    return documents.select(*keep, text).mapInArrow(run, schema)
