"""Operator 4: byte-level BPE with content-defined chunk reuse.

A rolling hash over 16 bytes cuts each text into chunks whose limits depend on their own
content only, so that texts which share passages share chunks. A task encodes each
distinct chunk once and keeps the ids in a bounded cache that outlives the task. Chunk
joins are then repaired: around a join the text is encoded again, from the last point of
agreement before it to the first one after it, growing over whole chunks if need be.

A point of agreement is a place before a space, with an ASCII letter on either side. The
tokenizer's pattern always splits there, whatever stands before or after: a run of letters
must end at the space, and the next piece starts with it. So the ids of whatever lies
between two such points are those of the whole text.

Added tokens that occur in a text are matched first, as the tokenizer does, and their
surroundings are encoded apart.

Cases: null and empty texts give no ids. Texts without a point of agreement are encoded
whole. Repeated rows are encoded from the cache. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _bytes as B

#: Chunks have 2**CHUNK_BITS bytes on average; the cache holds two generations of CACHE_BYTES of text each.
CHUNK_BITS = 9
CACHE_BYTES = 12 << 20
#: Fixed value: the split pattern of byte-level tokenizers with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
_AGREE = re.compile(rb"(?<=[A-Za-z])(?= [A-Za-z])")
_GEAR = B.mix(np.arange(1, 257, dtype=B.U64)).astype(np.uint32)


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder of one tokenizer file, with its chunk cache."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, model = _byte_chars(), spec["model"]
        raw = lambda token: bytes(chars[c] for c in token)
        ranks = {raw(t): i for t, i in model["vocab"].items()}
        merges = [raw("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if [ranks[m] for m in merges] != sorted(ranks[m] for m in merges):
            raise ValueError(f"{path}: merges aren't in the order of ids")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.encoder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (1 + max([*ranks.values(), *self.added.values()]))
        for b, i in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.bytes[i] = b
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.young, self.old, self.held = {}, {}, 0

    def _encode(self, data: bytes) -> np.ndarray:
        return np.array(self.encoder.encode_ordinary(data.decode("utf-8", "surrogatepass")), np.uint32)

    def _chunk(self, data: bytes) -> tuple[bytes, np.ndarray | None, bytes]:
        """What stands before the chunk's first point of agreement, the ids up to the last one, and the rest."""
        found = self.young.get(data)
        if found is None:
            found = self.old.get(data)
            if found is None:
                first = _AGREE.search(data)
                if first is None:
                    found = (data, None, b"")
                else:
                    a, b = first.start(), len(data)
                    while not (data[b - 1 : b].isalpha() and data[b : b + 1] == b" " and data[b + 1 : b + 2].isalpha()):
                        b = data.rindex(b" ", a, b)
                    found = (data[:a], self._encode(data[a:b]), data[b:])
            self.young[data] = found
            self.held += len(data)
            if self.held > CACHE_BYTES:
                self.young, self.old, self.held = {}, self.young, 0
        return found

    def _part(self, data: bytes, cuts: list[int]) -> list[np.ndarray]:
        out, open_, a = [], b"", 0
        for b in [*cuts, len(data)]:
            head, ids, tail = self._chunk(data[a:b])
            open_ += head
            if ids is not None:
                out += [self._encode(open_), ids]
                open_ = tail
            a = b
        return [*out, self._encode(open_)] if open_ else out

    def encode(self, data: bytes, cuts: list[int]) -> np.ndarray:
        """Ids of a text; ``cuts``: the chunk limits in it."""
        text = None
        if self.split and any(t.encode() in data for t in self.added):
            text = self.split.split(data.decode("utf-8", "surrogatepass"))
        if text is None:
            parts = self._part(data, cuts) if data else []
        else:
            parts, at = [], 0
            for piece in text:
                raw = piece.encode("utf-8", "surrogatepass")
                if piece in self.added:
                    parts.append(np.array([self.added[piece]], np.uint32))
                elif raw:
                    parts += self._part(raw, [c - at for c in cuts if at < c < at + len(raw)])
                at += len(raw)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Where a rolling hash of the 16 bytes before ends a chunk, moved to the next character."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    at = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    at = at[(at >= 16) & (at < len(data))]
    for _ in range(3):
        inner = (data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80
        at = at + inner
    return np.unique(at[at < len(data)])


def _task(path: str, kept: tuple[bool, bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids, (offsets, data) = batch.column(0), B.columns(batch)
            for i, j in B.chunks(offsets, 16 * B.CHUNK):
                rows = []
                for k in range(i, j):
                    own = data[offsets[k] : offsets[k + 1]]
                    found = c.encode(own.tobytes(), cut_points(own).tolist() if len(own) else [])
                    rows.append((len(found), found.astype("<u4").tobytes(), c.decode(found)))
                n, packed, text = zip(*rows, strict=True)
                if not kept[0]:
                    packed = [hashlib.sha256(x).hexdigest() for x in packed]
                if not kept[1]:
                    text = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in text]
                yield pa.record_batch([ids.slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(packed), pa.array(text)], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), decoded (text)."""
    return docs.select("doc_id", "text").mapInArrow(_task(path, (True, True)), SCHEMA)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select("doc_id", "text").mapInArrow(_task(path, (False, False)), "doc_id long, n_tokens long, ids string, decoded string").withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
