"""Byte-level BPE by padded matrices.

Words that a worker hasn't met are bucketed by length into padded matrices of token ids. In each round every row
merges its leftmost pair of minimum rank: ranks of all pairs come from an open-addressing hash table, the row's
first minimum is merged, the row closes up by one, and rows without a mergeable pair leave the matrix. Texts are
cut before spaces that a character follows, where the pattern always splits too, and cuts of plain letters, digits
and marks into their runs, which are the pattern's matches; the regular expression itself is asked about other cuts.
Equal pieces of a block are found by two 64-bit hashes, each different one is encoded once, and the texts' ids are
gathered from these.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import blocks, tidy, utf8
from .shingles import span_hashes

#: Rows of more bytes than this would cost their length squared in a matrix; a heap merges them in the same order.
WIDEST = 256
# Fixed value: the pattern whose matches are runs of letters, digits and marks with a space before them or not. Texts
# are cut into runs for this one alone; others are asked about each text.
RUNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker forgets the cuts that it asked the pattern about when it remembers so many.
REMEMBERED = 50_000
#: Bytes that come first in a character that may be white space: no cut before a space that one of them follows.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
NONE = np.int32(2**31 - 1)
#: Bytes of text that are encoded at once.
BLOCK = 1 << 19
#: Kinds of bytes: space, letter (with the Latin-1 letters beyond ASCII), digit, mark; ODD for all others.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[0x20] = SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = LETTER
_KIND[48:58] = DIGIT
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = MARK
_WIDTHS = [*range(2, 17), 20, 24, 32, 48, 64, 96, 128, WIDEST]


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines "<base64 of the token> <rank>"."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class PairTable:
    """Rank of the token that two adjacent tokens make; linear probing in arrays of a power of two."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank))
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = np.array([k for k, _ in pairs], np.uint64)
        values = np.array([v for _, v in pairs], np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] == np.uint64(2**64 - 1)
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]  # of rivals the last stays
            again = self.keys[at] != keys
            keys, values, at = keys[again], values[again], (at[again] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, NONE for pairs that don't merge; padding is -1 on either side."""
        keys = (a.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (b.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        shape, keys = keys.shape, keys.ravel()
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        out = out.reshape(shape)
        out[(a < 0) | (b < 0)] = NONE
        return out


class Codec:
    """Encodes and decodes with one rank table and one splitting pattern."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = parse_ranks(data)
        self.pair = PairTable(self.ranks)
        self.split, self.runs = regex.compile(pattern), pattern == RUNS
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.letters = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cuts: dict[bytes, np.ndarray] = {}

    def merge(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the rows of a matrix of ids, padded with -1, to the end: how many ids each row has, and all ids."""
        many, left = np.zeros(len(matrix), np.int64), []

        def leave(rows: np.ndarray, matrix: np.ndarray) -> None:
            held = matrix >= 0
            many[rows] = held.sum(axis=1)
            left.append((rows, matrix[held]))

        rows = np.arange(len(matrix))
        rank = self.pair(matrix[:, :-1], matrix[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                leave(rows[done], matrix[done])
                rows, matrix, rank, at, best = rows[~done], matrix[~done], rank[~done], at[~done], best[~done]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            matrix[each, at] = best
            close = np.arange(matrix.shape[1] - 1)
            matrix = np.take_along_axis(matrix, close + (close > at[:, None]), axis=1)
            if matrix.shape[1] == 1:
                leave(rows, matrix)
                break
            close = close[:-1]
            rank = np.take_along_axis(rank, close + (close >= at[:, None]), axis=1)
            left_of = at > 0
            rank[each[left_of], at[left_of] - 1] = self.pair(matrix[each[left_of], at[left_of] - 1], matrix[each[left_of], at[left_of]])
            right_of = at < matrix.shape[1] - 1
            rank[each[right_of], at[right_of]] = self.pair(matrix[each[right_of], at[right_of]], matrix[each[right_of], at[right_of] + 1])
        starts = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.int32)
        for rows, ids in left:
            own = many[rows]
            out[np.repeat(starts[rows] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return many, out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same order of merges for one long row, by a heap over a linked list."""
        n, ids = len(ids), ids.tolist()
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        table = self.ranks
        part = [self.tokens[i] for i in ids]
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := table.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, token = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != len(token):
                continue  # one of the two has merged with another since
            part[i], part[j], ids[i] = token, None, r
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (x := table.get(token + part[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, token + part[after[i]]))
            if before[i] >= 0 and (x := table.get(part[before[i]] + token)) is not None:
                heapq.heappush(heap, (x, before[i], part[before[i]] + token))
        return np.array([x for x, p in zip(ids, part, strict=True) if p is not None], np.int32)

    def words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each span of bytes has as one piece, and all ids; spans are bucketed by length."""
        sizes, many, left = end - begin, np.zeros(len(begin), np.int64), []
        for i in np.flatnonzero(sizes > WIDEST).tolist():
            ids = self.merge_long(self.byte[data[begin[i] : end[i]]])
            many[i] = len(ids)
            left.append((np.array([i]), ids))
        one = np.flatnonzero(sizes == 1)
        many[one] = 1
        left.append((one, self.byte[data[begin[one]]]))
        low = 1
        for width in _WIDTHS:
            held = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            step = max(1, (1 << 19) // width)
            for k in range(0, len(held), step):
                some = held[k : k + step]
                place = np.arange(width)
                matrix = self.byte[data[np.minimum(begin[some, None] + place, len(data) - 1)]]
                matrix[place >= sizes[some, None]] = -1
                own, ids = self.merge(matrix)
                many[some] = own
                left.append((some, ids))
        starts = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.int32)
        for rows, ids in left:
            own = many[rows]
            out[np.repeat(starts[rows] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return many, out

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts as the pattern splits them."""
        parts = [[m.group().encode() for m in self.split.finditer(t.decode())] for t in texts]
        own = {p: i for i, p in enumerate(dict.fromkeys(p for some in parts for p in some if p))}
        if not own:
            return [np.zeros(0, np.int32) for _ in texts]
        ends = np.cumsum([len(p) for p in own])
        many, ids = self.words(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        each = np.split(ids, np.cumsum(many)[:-1])
        return [np.concatenate([np.zeros(0, np.int32), *(each[own[p]] for p in some if p)]) for some in parts]

    def odd(self, cuts: list[bytes]) -> list[np.ndarray]:
        """whole() of cuts, many of which come again."""
        if len(self.cuts) > REMEMBERED:
            self.cuts.clear()
        if new := list(set(cuts) - self.cuts.keys()):
            self.cuts.update(zip(new, self.whole(new), strict=True))
        return [self.cuts[c] for c in cuts]

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a block of UTF-8 text, one after the other, and where each row's begin and end."""
        rows, n = len(offsets) - 1, len(data)
        if not n:
            return np.zeros(rows + 1, np.int64), np.zeros(0, np.int32)
        if not self.runs:
            ids = self.whole([data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.concatenate([[0], np.cumsum([len(x) for x in ids])]), np.concatenate(ids)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        cut = cut[:n]
        cut[:-1] |= (data[:-1] == 0x20) & ~_MAY_BE_SPACE[data[1:]]
        begin = np.flatnonzero(cut)
        sizes = np.diff(np.append(begin, n))
        kind = _KIND[data]
        odd = (kind == ODD) | (kind == SPACE) & ~cut
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs among Latin letters
        odd = np.logical_or.reduceat(odd, begin) | (kind[begin] == SPACE) & (sizes == 1)
        inside = np.repeat(~odd, sizes)
        run = cut.copy()
        run[1:] |= inside[1:] & (kind[1:] != kind[:-1]) & ~(cut[:-1] & (kind[:-1] == SPACE))
        begin = np.flatnonzero(run)
        end = np.append(begin[1:], n)
        one, two = span_hashes(data, begin, end)
        _, at, back = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[at][back]).any():  # a collision of the first hash: every piece for itself
            at = back = np.arange(len(begin))
        plain = np.flatnonzero(inside[begin[at]])
        strange = np.flatnonzero(~inside[begin[at]])
        many = np.zeros(len(at), np.int64)
        many[plain], ids = self.words(data, begin[at[plain]], end[at[plain]])
        starts = np.zeros(len(at), np.int64)
        starts[plain] = np.cumsum(many[plain]) - many[plain]
        if len(strange):
            more = self.odd([data[a:b].tobytes() for a, b in zip(begin[at[strange]].tolist(), end[at[strange]].tolist(), strict=True)])
            many[strange] = [len(x) for x in more]
            starts[strange] = len(ids) + np.cumsum(many[strange]) - many[strange]
            ids = np.concatenate([ids, *more])
        own = many[back]
        out = np.concatenate([[0], np.cumsum(own)])
        gathered = ids[np.repeat(starts[back] - out[:-1], own) + np.arange(out[-1])]
        return out[np.searchsorted(begin, offsets)], gathered

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each id's begin and end."""
        sizes = self.sizes[ids]
        out = np.concatenate([[0], np.cumsum(sizes)])
        return out, self.letters[np.repeat(self.starts[ids] - out[:-1], sizes) + np.arange(out[-1])]


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec a worker for each vocabulary."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def _ranks(df: DataFrame, path: str):
    """The rank file (under 2 MB for 50,000 tokens), read by the driver and broadcast: executors need no local copy."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256) for each row: the ids of the whole text without special tokens.

    Null and empty texts have no ids. Rows aren't joined or grouped, so repeated and null doc_ids pass through;
    other columns aren't read. ids_sha256 is of the ids as little-endian unsigned 32-bit integers.
    """
    file = _ranks(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for batch in batches:
            offsets, data = utf8(batch["text"])
            for a, b in blocks(offsets, BLOCK):
                ends, ids = own.encode(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                raw, at = ids.astype("<u4").tobytes(), (4 * ends).tolist()
                hashes = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
                columns = [batch["doc_id"].slice(a, b - a), pa.ListArray.from_arrays(ends.astype(np.int32), ids), pa.array(np.diff(ends).astype(np.int64)), pa.array(hashes, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "ids_sha256"])

    own = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    return own.mapInArrow(tidy(run), "doc_id long, ids array<int>, n_tokens long, ids_sha256 string")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded): the bytes that the ids of encode()'s rows stand for."""
    file = _ranks(encoded, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for batch in batches:
            ids = batch["ids"]
            ends = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.values.to_numpy()
            for a, b in blocks(ends, BLOCK // 4):
                out, letters = own.decode(flat[ends[a] : ends[b]])
                cuts = out[ends[a : b + 1] - ends[a]]
                decoded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["n_tokens"].slice(a, b - a), batch["ids_sha256"].slice(a, b - a), decoded], names=["doc_id", "n_tokens", "ids_sha256", "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens", "ids_sha256").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")
