"""Packing of tokenized documents into sequences: best fit, then a swap-based local search.

Documents are tokenized where they lie; only the pieces' lengths are shuffled. Blocks of pieces, dealt by hash
and of a bounded size whatever the input, are packed one by one: best-fit decreasing gives the start, then the
search fills underfull bins from emptier ones by moves and by exchanges one for one, two for one or one for two,
as long as the sum of squared fills grows, until bins run empty and nothing is left to exchange.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import kept, slices, table
from orebed.storage import materialize

#: Tokens of a sequence, the id that ends a document, and the tokenizer's file by its public name.
CAPACITY, END_ID, TOKENIZER = 2048, 0, "byte_bpe_50k.json"

#: Pieces of a block on average.
BLOCK = 8192

#: Pre-tokens whose ids a worker keeps.
CACHED = 1 << 19

#: Letters of Western European texts. For texts of these, ASCII and line breaks alone, PLAIN cuts as
#: the tokenizer's own pattern does, and faster.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
OTHER = re.compile(rf"[^\n\t\x20-\x7E{LATIN}]")
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class _Ids(dict):
    """Pre-token to ids, packed as little-endian 32-bit words, by the tokenizer at the first sight of each."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def __missing__(self, token: str) -> bytes:
        ids = _packed(self.tokenizer.encode(token, add_special_tokens=False).ids)
        if len(self) < CACHED:
            self[token] = ids
        return ids


class Encoder:
    """The ids of whole texts by one tokenizer file.

    Byte-level BPE never merges across pre-tokens, so for a file of that kind the ids of a text are those of its
    pre-tokens in a row and are remembered by pre-token. Texts that hold an added token, and files of any other
    kind, go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_parts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.ids = _Ids(self.tokenizer)

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit words."""
        if not self.by_parts or any(a in text for a in self.added):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.ids.__getitem__, self.split(text) if OTHER.search(text) else PLAIN.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()


def encoder(path: str) -> Encoder:
    return kept(f"encoder {path}", lambda: Encoder(path))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full ones, the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every document: its ids and END_ID, cut where they exceed `capacity`. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path or tokenizer_path()), _packed([END_ID])
        for b in slices(batches):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode_packed(text or "") + end
                rows += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: sizes in decreasing order, each into the fullest bin that it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - n].append(b)
        some |= 1 << (room - n)
    return bins


class _BySize:
    """Documents, or pairs of one bin, by size: the largest of at most some size whose bin has not been dropped."""

    def __init__(self, entries: list[tuple[int, tuple[int, ...], int]]) -> None:
        self.entries = sorted(entries)
        self.sizes = [e[0] for e in self.entries]
        self.below = list(range(len(entries) + 1))  # each place's next one downwards that is left; 0 is none
        self.places: dict[int, list[int]] = {}
        for k, (_, _, b) in enumerate(self.entries, 1):
            self.places.setdefault(b, []).append(k)

    def at_most(self, size: int) -> tuple[int, tuple[int, ...], int] | None:
        k = bisect_right(self.sizes, size)
        top = k
        while self.below[top] != top:
            top = self.below[top]
        while self.below[k] != top:
            self.below[k], k = top, self.below[k]
        return self.entries[top - 1] if top else None

    def drop(self, b: int) -> None:
        for k in self.places.pop(b, ()):
            self.below[k] = k - 1


def _ones(b: list[int], sizes: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(size, documents) of a bin's documents, one of each size, as equal ones can stand for each other."""
    return [(n, (i,)) for n, i in {sizes[i]: i for i in b}.items()]


def _pairs(b: list[int], sizes: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(size, documents) of a bin's pairs, one of each two sizes: a bin of many small documents has few sizes."""
    of: dict[int, list[int]] = {}
    for i in b:
        if len(held := of.setdefault(sizes[i], [])) < 2:
            held.append(i)
    some = sorted(of.items())
    return [(2 * n, tuple(held)) for n, held in some if len(held) == 2] + [(n + m, (x[0], y[0])) for k, (n, x) in enumerate(some) for m, y in some[k + 1 :]]


def _best_exchange(b: list[int], room: int, sizes: list[int], ones: _BySize, twos: _BySize) -> tuple[int, tuple[int, ...], tuple[int, ...], int] | None:
    """(gain, what b gives, what it takes, from which bin) of the move or exchange that fills b most; None if there is none.

    Tried: nothing for one, one for one, two for one, and one for two.
    """
    best = None
    for lost, give in [(0, ()), *_ones(b, sizes), *_pairs(b, sizes)]:
        for pool in (ones, twos) if len(give) == 1 else (ones,):
            found = pool.at_most(lost + room)
            if found and found[0] - lost > (best[0] if best else 0):
                best = (found[0] - lost, give, found[1], found[2])
                if best[0] == room:
                    return best
    return best


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewer bins, if moves and exchanges between underfull ones empty any; every index stays in one bin.

    A pass takes the underfull bins from the fullest on and fills each from emptier ones that the pass has not
    changed yet, by the exchange that leaves least room. Every exchange makes the fuller of two bins fuller, so
    the sum of squared fills grows and the passes come to an end: that in which nothing can be exchanged, or
    in which no fewer bins could hold the sizes.
    """
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    moved = True
    while moved and sum(f > 0 for f in fill) > least:
        moved, gave = False, set()
        underfull = sorted((k for k, f in enumerate(fill) if 0 < f < capacity), key=lambda k: -fill[k])
        ones = _BySize([(n, one, k) for k in underfull for n, one in _ones(bins[k], sizes)])
        twos = _BySize([(n, pair, k) for k in underfull for n, pair in _pairs(bins[k], sizes)])
        for b in underfull:
            if b in gave:
                continue
            ones.drop(b)
            twos.drop(b)
            while step := _best_exchange(bins[b], capacity - fill[b], sizes, ones, twos):
                gain, give, take, a = step
                bins[b] = [i for i in bins[b] if i not in give] + list(take)
                bins[a] = [i for i in bins[a] if i not in take] + list(give)
                fill[b], fill[a], moved = fill[b] + gain, fill[a] - gain, True
                gave.add(a)
                ones.drop(a)
                twos.drop(a)
                if fill[b] == capacity:
                    break
    return [b for b in bins if b]


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (numbered from 0) and offset of one block's pieces, in the block's own order."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, b in enumerate(local_search(best_fit(sizes, capacity), sizes, capacity)):
        at = 0
        for i in sorted(b):
            sequence[i], offset[i] = k, at
            at += sizes[i]
    return sequence, offset


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PLACED rows: each piece's sequence and its offset there; sequences are gapless from offset 0.

    A null or empty text is the one id END_ID; an empty table gives no rows; rows with a repeated or null doc_id
    are documents of their own and their pieces are placed apart. Other columns are ignored. Only documents
    longer than a sequence are cut.
    """
    found = materialize(pieces(docs, path, capacity), "pieces")
    n = -(-max(1, found.count()) // BLOCK)
    dealt = found.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack_block(rows.column("length").to_pylist(), capacity)
        sequence += rows.column("block")[0].as_py() << 24
        return rows.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("block").applyInArrow(run, PLACED)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
