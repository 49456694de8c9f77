"""Byte-pair encoding and decoding.

A text is cut into added tokens and pieces; each piece's bytes are merged by rank. A short piece keeps a contiguous
array of part boundaries with the rank of each adjacent pair: the least rank is found by a scan, its boundary deleted
and the two neighbouring ranks refreshed. A long piece (LONG bytes or more) does the same with a heap over linked
parts, which gives the same merges in n log n time.

Null and empty texts have no ids; any other text, however long, is encoded whole. Equal rows give equal results,
extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_columns, map_arrow, texts

LONG = 192
#: Entries that a worker keeps; beyond them its memory of pieces starts anew.
MEMORY = 300_000
#: The byte-level pre-tokenizer's published pattern (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAR = 1 << 60


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level vocabulary file of the tokenizers library's JSON format, with its added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = model["vocab"]
        self.table: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        self.ids = {}
        for token, i in vocab.items():
            if token not in self.added:
                self.table[i] = as_bytes(token)
                self.ids[self.table[i]] = i
        for content, i in self.added.items():
            self.table[i] = content.encode()
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            self.pairs[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        if len(piece) >= LONG:
            return self.merged_long(piece)
        first, pairs = self.first, self.pairs
        parts = [first[b] for b in piece]
        none = (FAR, -1)
        ranks = [pairs.get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least[0] == FAR:
                break
            k = ranks.index(least)
            parts[k] = least[1]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = pairs.get((parts[k], parts[k + 1]), none)
            if k:
                ranks[k - 1] = pairs.get((parts[k - 1], parts[k]), none)
        return parts

    def merged_long(self, piece: bytes) -> list[int]:
        parts: list[int | None] = [self.first[b] for b in piece]
        n, pairs = len(parts), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, parts[k], parts[k + 1], m[1]) for k in range(n - 1) if (m := pairs.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, whole = heapq.heappop(heap)
            r = after[k]
            if parts[k] != a or r >= n or parts[r] != b:
                continue
            parts[k], parts[r] = whole, None
            after[k] = after[r]
            if after[r] < n:
                before[after[r]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j < n and (m := pairs.get((parts[i], parts[j]))):
                    heapq.heappush(heap, (m[0], i, parts[i], parts[j], m[1]))
        return [p for p in parts if p is not None]

    def of_piece(self, piece: str) -> bytes:
        raw = piece.encode()
        out = np.array(self.merged(raw), "<u4").tobytes()
        if len(raw) < LONG:
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def of_span(self, span: str) -> bytes:
        known = self.pieces.get
        return b"".join([known(p) or self.of_piece(p) for p in self.split(span)])

    def of_chunk(self, chunk: str) -> bytes:
        out = self.of_span(chunk)
        if len(chunk) < LONG:
            if len(self.chunks) >= MEMORY:
                self.chunks.clear()
            self.chunks[chunk] = out
        return out

    def of_plain(self, text: str) -> bytes:
        """A piece has a space at its start only, unless spaces follow white space; so, without such runs, the text
        may be cut before each space and what was seen before taken from memory."""
        head, *rest = text.split(" ")
        if "" in rest:
            return self.of_span(text)
        known = self.chunks.get
        rest = [" " + x for x in rest]
        return (self.of_span(head) if head else b"") + b"".join([known(x) or self.of_chunk(x) for x in rest])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self.of_plain(text) if text else b""
        out, at = [], 0
        for m in self.cut.finditer(text):
            if m.start() > at:
                out.append(self.of_plain(text[at : m.start()]))
            out.append(np.array([self.added[m[0]]], "<u4").tobytes())
            at = m.end()
        if at < len(text):
            out.append(self.of_plain(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8, broken sequences replaced."""
        table = self.table
        raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text. Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded.

    A narrow map: no shuffle, and a lost task is simply run again."""
    path = path or default_path()

    def make():
        bpe, sha = loaded(path), hashlib.sha256

        def f(batch: pa.RecordBatch) -> list:
            ids = [bpe.encode(t) for t in texts(batch)]
            back = [bpe.decode(x) for x in ids]
            out = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([sha(x).hexdigest() for x in ids], pa.string()),
                pa.array([sha(x).hexdigest() for x in back], pa.string()),
            ]
            if with_ids:
                out += [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([x.decode() for x in back], pa.string())]
            return out

        return f

    more = ", ids array<bigint>, decoded string" if with_ids else ""
    return map_arrow(doc_columns(docs), make, f"doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def decode_ids(frame: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of a frame of doc_id, ids array<bigint>; null ids give the empty text."""
    path = path or default_path()

    def make():
        bpe = loaded(path)

        def f(batch: pa.RecordBatch) -> list:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            return [batch.column(0), pa.array([bpe.decode(np.array(x or [], "<u4").tobytes()).decode() for x in ids], pa.string())]

        return f

    return map_arrow(frame.selectExpr("cast(doc_id as bigint) doc_id", "cast(ids as array<bigint>) ids"), make, "doc_id bigint, text string")
