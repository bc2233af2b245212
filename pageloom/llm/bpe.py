"""Byte-level BPE encoding and decoding, with offsets.

Pre-tokenisation knows no regex. Every code point has a class; every class is a transition function of a small automaton
over what precedes; composition of such functions is associative, so all prefixes come from a blocked scan over arrays
(the functions' closure under composition is a table). Whether a token starts at a character follows from the state
before it, its class and the next class. The slices feed cached pair merging.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, per_document

L, STMD, RV, E, EL, N, SP, WS, O, AP, END = range(11)
_CLASSES = 11
BEG, S_L, S_N, S_SP, S_WS, S_O, S_AP, S_APE, S_APL, S_DONE = range(10)
_STATES = 10
_BLOCK = 64
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _class_table() -> np.ndarray:
    kinds = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = L
        elif k == "N":
            kinds[c] = N
    kinds[_WHITE] = WS
    for chars, k in ((" ", SP), ("'", AP), ("stmd", STMD), ("rv", RV), ("e", E), ("l", EL)):
        for ch in chars:
            kinds[ord(ch)] = k
    return kinds


def _step(s: int, c: int) -> int:
    """State after a character of class c in state s."""
    if c == END:
        return BEG
    if c == N:
        return S_N
    if c == SP:
        return S_SP
    if c == WS:
        return S_WS
    if c == O:
        return S_O
    if c == AP:  # an apostrophe opens a contraction unless it goes on with a space or a run of symbols
        return S_O if s in (S_SP, S_O, S_AP) else S_AP
    if s == S_AP:
        return {STMD: S_DONE, RV: S_APE, EL: S_APL}.get(c, S_L)
    if s == S_APE and c == E or s == S_APL and c == EL:
        return S_DONE
    return S_L


def _starts(s: int, c: int, following: int) -> bool:
    """Whether a token starts at a character of class c in state s when a character of class `following` comes next."""
    if c == END:
        return True
    if c in (SP, WS):
        return s not in (S_SP, S_WS) or following not in (SP, WS, END)
    if c == N:
        return s not in (S_N, S_SP)
    if c in (O, AP):
        return s not in (S_O, S_SP, S_AP)
    if s == S_AP:
        return not (c == STMD or c == RV and following == E or c == EL and following == EL)
    return s in (BEG, S_N, S_WS, S_O, S_DONE)


class _Scanner:
    """The tables of the automaton, made once a process."""

    def __init__(self) -> None:
        self.kinds = _class_table()
        gens = [tuple(_step(s, c) for s in range(_STATES)) for c in range(_CLASSES)]
        elements = list(dict.fromkeys([tuple(range(_STATES)), *gens]))
        known = {f: i for i, f in enumerate(elements)}
        for f in elements:  # grows while it runs: the closure
            for g in gens:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(elements)
                    elements.append(h)
        k = self.k = len(elements)
        self.gen = np.array([known[g] for g in gens], np.uint16)
        self.then = np.array([[known[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint16).ravel()
        self.apply = np.array(elements, np.uint8).ravel()
        self.start = np.array([[[_starts(s, c, n) for n in range(_CLASSES)] for c in range(_CLASSES)] for s in range(_STATES)], bool).ravel()

    def scan(self, f: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions of f, a blocked scan."""
        if len(f) <= _BLOCK:
            return np.array(list(accumulate(f.tolist(), lambda a, b: int(self.then[a * self.k + b]))), np.uint16)
        rows = -(-len(f) // _BLOCK)
        g = np.zeros(rows * _BLOCK, np.uint16)  # 0 is the identity
        g[: len(f)] = f
        g = np.ascontiguousarray(g.reshape(rows, _BLOCK).T)
        for j in range(1, _BLOCK):
            g[j] = self.then[g[j - 1].astype(np.int32) * self.k + g[j]]
        before = np.zeros(rows, np.int32)
        before[1:] = self.scan(g[-1])[:-1]
        return self.then[before[None, :] * self.k + g].T.ravel()[: len(f)]

    def boundaries(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where tokens start in code points of texts that each have one more code point at its end, at `ends`; those count too."""
        c = self.kinds[codes]
        c[ends] = END
        after = self.apply[self.scan(self.gen[c]).astype(np.int32) * _STATES + BEG]
        at = np.empty(len(c), np.int32)
        at[0] = BEG
        at[1:] = after[:-1]
        at *= _CLASSES
        at += c
        at *= _CLASSES
        at[:-1] += c[1:]
        at[-1] += END
        return np.flatnonzero(self.start[at])


class Codec:
    """Encodes and decodes by a tiktoken rank file's content. Not special-token aware: their strings are ordinary text."""

    CACHE = 200_000  # pieces; then the older half goes

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)
        self.first_byte = np.cumsum(self.lengths) - self.lengths  # where each token's bytes begin in all_bytes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(self.lengths))), np.uint8)
        self.pairs = {}
        for b, i in self.ranks.items():
            for k in range(1, len(b)):
                x, y = self.ranks.get(b[:k]), self.ranks.get(b[k:])
                if x is not None and y is not None:
                    self.pairs[x << 20 | y] = i
        self.single = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        self.scanner = _Scanner()
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank merges first, the leftmost of equals."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ids, get, none = [self.single[b] for b in piece], self.pairs.get, 1 << 40
        if len(ids) > 400:
            return self._merge_long(ids)
        rank = [get(x << 20 | y, none) for x, y in zip(ids, ids[1:])]
        while rank and (least := min(rank)) < none:
            i = rank.index(least)
            ids[i] = least
            del ids[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(least << 20 | ids[i + 1], none)
            if i:
                rank[i - 1] = get(ids[i - 1] << 20 | least, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n."""
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y or ids[i] != x:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := get(r << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            if (h := before[i]) >= 0 and (q := get(ids[h] << 20 | r)) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        out = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.cache) >= self.CACHE:
                for k in list(self.cache)[: self.CACHE // 2]:
                    del self.cache[k]
            self.cache[piece] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cuts = self.scanner.boundaries(codes, ends)
        places = np.searchsorted(cuts, ends).tolist()
        cuts = cuts.tolist()
        get, packed, out, at = self.cache.get, self._packed, [], 0
        for end in places:
            out.append(b"".join([get(p := joined[a:b]) or packed(p) for a, b in zip(cuts[at:end], cuts[at + 1 : end + 1])]))
            at = end + 1
        return out

    def byte_ends(self, packed: bytes) -> np.ndarray:
        """Where each token ends in the text's UTF-8 bytes."""
        return np.cumsum(self.lengths[np.frombuffer(packed, "<u4")])

    def decode(self, packed: bytes, byte_ends: np.ndarray | None = None, begin: int = 0, end: int | None = None) -> bytes:
        """The bytes [begin, end) of the text. The offsets retained from encoding place each token; only tokens in the range are touched."""
        ids = np.frombuffer(packed, "<u4")
        ends = self.byte_ends(packed) if byte_ends is None else byte_ends
        size = int(ends[-1]) if len(ends) else 0
        end = size if end is None else min(end, size)
        if begin >= end:
            return b""
        first, last = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, end - 1, "right")) + 1
        ids, ends = ids[first:last], ends[first:last]
        n = self.lengths[ids]
        starts = ends - n
        at = np.repeat(self.first_byte[ids] - starts, n) + np.arange(int(starts[0]), int(ends[-1]))
        return self.all_bytes[at[begin - int(starts[0]) : end - int(starts[0])]].tobytes()


_codecs: dict[str, Codec] = {}


def codec(rank_file: bytes) -> Codec:
    """One codec a process and vocabulary."""
    key = hashlib.sha256(rank_file).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(rank_file)
    return _codecs[key]


def vocabulary(path: str | None = None) -> bytes:
    """A rank file's content, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, byte_ends array<int> (a token's end in the UTF-8 bytes), decoded (string).

    One row per row of docs; a null text is empty and has no tokens; no other column is read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def compute(texts):
        c = codec(ranks.value)
        packed = c.encode(texts)
        ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
        ends = [c.byte_ends(p) for p in packed]
        return [ids, [e.astype(np.int32) for e in ends], [c.decode(p, e).decode("utf-8", "replace") for p, e in zip(packed, ends)]]

    return per_document(docs, compute, "ids array<int>, byte_ends array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and offsets_sha256 (of the tokens' ends in UTF-8 bytes, as little-endian
    unsigned 64-bit integers), of the same encoding and decoding; ids never leave the worker. A row per row of docs."""
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def compute(texts):
        c = codec(ranks.value)
        packed = c.encode(texts)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        ends = [c.byte_ends(p) for p in packed]
        return [[len(p) // 4 for p in packed], [sha(p) for p in packed], [sha(c.decode(p, e)) for p, e in zip(packed, ends)], [sha(e.astype("<u8").tobytes()) for e in ends]]

    return per_document(docs, compute, "n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens as digests. Null texts are empty; repeated rows are encoded each; an empty table gives no rows;
    further columns are not read."""
    return digest_documents(documents(spark, sf_dir))
