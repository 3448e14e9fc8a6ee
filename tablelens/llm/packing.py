"""Packing token sequences with little padding.

Method: minimum bin slack. Only the number of pieces of each length matters,
at most ``capacity`` numbers, however many documents there are. The longest
remaining piece opens a sequence; a subset-sum dynamic program over bitsets
finds the multiset of remaining lengths that fills the rest most closely, with
the counts read off by backtracking; the sequence is repeated as often as the
counts allow. The pieces, numbered within their length, then look up their
place in the plan.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) whose sum is the largest that fits into ``room``."""
    full, bits, items, states = (1 << (room + 1)) - 1, 1, [], []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            states.append(bits)
            items.append((length, take))
            bits |= (bits << (length * take)) & full
            left -= take
            part *= 2
        if bits >> room & 1:
            break
    at, out = bits.bit_length() - 1, Counter()
    for (length, take), before in zip(reversed(items), reversed(states)):
        if not before >> at & 1:
            out[length] += take
            at -= length * take
    return sorted(out.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times), ...]) of all sequences."""
    left = {x: n for x, n in counts.items() if n}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        parts = Counter(dict(fill(left, capacity - longest)))
        left[longest] += 1
        parts[longest] += 1
        repeats = min(left[x] // n for x, n in parts.items())
        out.append((repeats, sorted(parts.items(), reverse=True)))
        for x, n in parts.items():
            left[x] -= n * repeats
            if not left[x]:
                del left[x]
    return out


def _places(sequences) -> dict[str, np.ndarray]:
    """Sorted by (length, first index): where the pieces of a length go."""
    rows, used, seq = [], Counter(), 0
    for repeats, parts in sequences:
        offset = 0
        for length, times in parts:
            rows.append((length, used[length], seq, times, offset))
            used[length] += repeats * times
            offset += length * times
        seq += repeats
    rows.sort()
    a = np.array(rows or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "seq", "times", "offset"), a.T))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (longs). ``pieces`` must be
    materialised and have ``length`` (1 to capacity), and ``block`` and ``nth``,
    which number the pieces of a length within a block from 0. Places in a
    sequence are gapless from 0. Ties, repeated rows and a length that a third
    of all pieces share are numbered alike: by block, never in one task."""
    ship(pieces.sparkSession)
    if {"sequence_id", "offset"} & set(pieces.columns):
        pieces = pieces.drop("sequence_id", "offset")
    per_block = pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("__n"))
    per_block = cut(per_block)
    counts = {r[0]: r[1] for r in per_block.groupBy("length").agg(F.sum("__n")).collect()}  # at most capacity rows
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    at = _places(plan(counts, capacity))
    before = per_block.select("block", "length", (F.sum("__n").over(Window.partitionBy("length").orderBy("block")) - F.col("__n")).alias("__before"))
    numbered = pieces.join(before, ["block", "length"]).withColumn("__index", F.col("__before") + F.col("nth")).drop("__before")
    names = [c for c in numbered.columns if c != "__index"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = at["length"] * (1 << 44) + at["first"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            index = batch.column("__index").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.searchsorted(key, length * (1 << 44) + index, side="right") - 1
            step = index - at["first"][row]
            seq = at["seq"][row] + step // at["times"][row]
            offset = at["offset"][row] + step % at["times"][row] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "__index")
    return numbered.mapInArrow(run, schema + ", sequence_id long, offset long").drop("block", "nth")


class WordTokenizer:
    """A ``tokenizers`` file whose pieces never cross white space: the ids of a
    text are those of its words, which are remembered. The few control
    characters that Python splits at and the tokenizer does not are left to the
    tokenizer with their whole text."""

    _control = re.compile("[\x1c-\x1f]")
    _plain = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)\Z")

    def __init__(self, path: str, cache: int = 600_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # two generations: when the young one is full it becomes the old one, from which
        # words that are met again come back, so frequent words stay
        self.limit, self.known, self.old = max(1, cache // 2), {}, {}
        self._letters: dict[int, str] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._bytes = [struct.pack("<I", i) for i in range(size)]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words are remembered here
        probe = ["the", "abandoned", "être", "größe", "señor", "x", "çà", "internationally"]
        self.direct = self._stems(probe) == self._encode(probe)

    def _stems(self, stems: list[str]) -> dict[str, bytes]:
        """Ids of plain stems straight from the library's model, without the
        steps that leave a lower-case Latin-1 word as it is."""
        from tokenizers import pre_tokenizers
        level, letters, tokenize, code = None, self._letters, self.tokenizer.model.tokenize, self._bytes
        out = {}
        for x in stems:
            y = x
            if not x.isascii():
                for c in x:
                    if ord(c) not in letters:
                        level = level or pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
                        letters[ord(c)] = level.pre_tokenize_str(c)[0][0]
                y = x.translate(letters)
            out[x] = b"".join([code[i.id] for i in tokenize(y)])
        return out

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for start in range(0, len(words), 4096):
            part = words[start:start + 4096]
            done = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(done.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            for i, x in enumerate(part):
                out[x] = ids[cuts[i]:cuts[i + 1]]
        return out

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Words not met before, and their parts. Latin-1 letters and ASCII signs
        after them are separate pieces, and the letters count in lower case."""
        plain = {x: x.lower() for x in words if x.isascii() and x.isalpha()}
        split, odd, parts, tails = {}, [], set(plain.values()), set()
        if len(plain) < len(words):
            for x in words:
                if x not in plain:
                    if m := self._plain.match(x):
                        split[x] = stem, tail = m[1].lower(), m[2]
                        parts.add(stem)
                        tails.add(tail)
                    else:
                        odd.append(x)
        known = [self.known, self.old]
        out = {p: t[p] for t in known for p in (parts | tails) & t.keys()}
        stems = [p for p in parts if p not in out]
        out.update(self._stems(stems) if self.direct else self._encode(stems))
        out.update(self._encode([*odd, *[p for p in tails if p and p not in out]]))
        out[""] = b""
        for x, low in plain.items():
            out[x] = out[low]
        for x, (stem, tail) in split.items():
            out[x] = out[stem] + out[tail]
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        words = [[] if self._control.search(t) else t.split() for t in texts]
        missing = set().union(*words).difference(self.known)
        back = missing & self.old.keys()
        fresh = self._fresh(list(missing - back))
        self.known.update({x: self.old[x] for x in back})
        self.known.update(fresh)
        ids = self.known.__getitem__
        out = [b"".join(map(ids, w)) if w or not t else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
               for t, w in zip(texts, words)]
        for x in fresh:
            if len(x) > 64:
                del self.known[x]
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenize_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id",
                    text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The documents' ids, ``end_id`` appended, cut after every ``capacity``:
    ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``block``,
    ``nth`` and, if asked for, ``ids`` (binary). Null texts are empty: one piece
    with ``end_id`` alone. Every row is a document of its own."""
    ship(docs.sparkSession)
    kind = docs.select(F.col(id_col)).schema.fields[0].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "block", "nth"] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        own, block, seen = _tokenizers[path], TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), own.texts([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[4 * start:4 * (start + capacity)]
                        length = len(piece) // 4
                        rows.append((doc, start, length, zlib.crc32(piece), total, block, seen[length], *[piece] * with_ids))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [None, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.binary()]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, block int, nth long" + ", ids binary" * with_ids
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type
    types[0] = to_arrow_type(source.schema.fields[0].dataType)
    return source.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` ids; see
    ``tokenize_pieces`` and ``pack``. Empty input: no rows."""
    pieces = tokenize_pieces(docs, path, end_id, capacity, id_col, text_col, with_ids)
    return pack(cut(pieces), capacity)
