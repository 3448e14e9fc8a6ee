"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece the last token of its encoding is stored: the
one token that ends there, whose predecessor is the stored token of the shorter
prefix, and that together with it re-encodes to just the two. A sequence of
tokens is what the merges give if and only if all neighbouring pairs are, so
the stored tokens spell the exact encoding of every prefix. Appending extends
the table; after an edit it is rebuilt only from the edit until it falls in
step with the old one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import Bounded
from .common import ship


class Ranks:
    """A rank file: base64 token and rank on each line; rank = id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.longest = max(map(len, self.rank))
        self.pair: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The merges themselves, for the short strings of the checks."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def whole(self, t: int) -> bool:
        """Whether the merges ever make this token."""
        known = self._whole.get(t)
        if known is None:
            known = self._whole[t] = self.merge(self.token[t]) == [t]
        return known

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pair.get(key)
        if known is None:
            if len(self.pair) > 1_000_000:
                self.pair.clear()
            known = self.pair[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known


class Prefixes:
    """The table of one piece. ``last[i]``: the last token of the first i bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def _extend(self, i: int) -> None:
        """Store the last token of the first ``i`` bytes."""
        ranks, data, last = self.ranks, self.data, self.last
        rank, pair = ranks.rank.get, ranks.pair.get
        for j in range(i - ranks.longest if i > ranks.longest else 0, i):
            t = rank(data[j:i])
            if t is not None:
                if j:
                    good = pair(last[j] << 32 | t)
                    if good is None:
                        good = ranks.fits(last[j], t)
                else:
                    good = ranks.whole(t)
                if good:
                    last.append(t)
                    return
        raise ValueError("the rank file lacks a byte")

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for i in range(start + 1, len(self.data) + 1):
            self._extend(i)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start..end; the number of steps redone."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start + 1]
        done = same = 0
        for i in range(start + 1, len(self.data) + 1):
            self._extend(i)
            done += 1
            # as many equal steps as the longest token spans decide all later ones
            same = same + 1 if i - len(new) >= start and self.last[i] == old[i - shift] else 0
            if same >= self.ranks.longest:
                self.last += old[i - shift + 1:]
                break
        return done

    def ids(self) -> list[int]:
        out, i, token = [], len(self.data), self.ranks.token
        while i:
            out.append(t := self.last[i])
            i -= len(token[t])
        return out[::-1]


class Codec:
    """Whole texts: pieces by the pattern, each encoded separately. A piece that
    is a token itself is that token, as in the public library."""

    def __init__(self, path: str, pattern: str, cache: int = 400_000):
        self.ranks, self.pattern = Ranks(path), regex.compile(pattern)
        self._pieces, self._chunks, self._prefixes = Bounded(cache), Bounded(cache), Bounded(cache)
        # a run of white space belongs to what follows, so no piece crosses these chunks' ends
        self._split = regex.compile(r"\s*\S+|\s+")
        self._odd = re.compile(r"[^\S \n]|\x00")

    def piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        t = self.ranks.rank.get(data)
        ids = [t] if t is not None else self._by_prefixes(data)
        known = np.array(ids, "<u4").tobytes()
        if len(data) <= 64:
            self._pieces.put(piece, known)
        return known

    def _by_prefixes(self, data: bytes) -> list[int]:
        """Prefixes that earlier pieces had are not stepped through again."""
        get, put, table = self._prefixes.get, self._prefixes.put, Prefixes(self.ranks)
        table.data, last = data, table.last
        for i in range(1, len(data) + 1):
            t = get(data[:i]) if i <= 32 else None
            if t is None:
                break
            last.append(t)
        for i in range(len(last), len(data) + 1):
            table._extend(i)
            if i <= 32:
                put(data[:i], last[i])
        return table.ids()

    def chunk(self, chunk: str) -> bytes:
        get = self._pieces.get
        known = b"".join([get(p) or self.piece(p) for p in self.pattern.findall(chunk)])
        if len(chunk) <= 64:
            self._chunks.put(chunk, known)
        return known

    def chunks(self, text: str) -> list[str]:
        """The same cuts by plain replacing where spaces and line ends stand singly."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self._odd.search(text):
            return self._split.findall(text)
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return parts if parts[0] else parts[1:]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self._chunks.get
        return b"".join([get(c) or self.chunk(c) for c in self.chunks(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """``id``, ``n_tokens``, ``ids`` (binary, unless ``with_ids`` is off) and the
    digests ``ids_sha256`` and ``decoded_sha256`` (of the decoded ids). Whole
    texts; null is the empty text with no ids; a row per input row. ``path`` is
    the rank file's place on every machine."""
    ship(docs.sparkSession)
    fields = docs.select(F.col(id_col).alias("id")).schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, ids_out, ids_sha, dec_sha = [], [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                dec_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    ids_out.append(ids)
            cols = [batch.column(0), pa.array(n, pa.int64())] + ([pa.array(ids_out, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())], names)

    names = ["id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    schema = f"id {fields.dataType.simpleString()}, n_tokens long, " + ("ids binary, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
