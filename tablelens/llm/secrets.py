"""Secrets in texts: fixed base patterns and learned formats.

Grammar inference: the strings that the base patterns label as credentials (of
each kind) form a prefix tree over character classes; states whose outgoing
frequencies are statistically compatible (Hoeffding bound) are merged into a
probabilistic automaton. A second automaton learns ordinary words: shorter runs of
the same characters, drawn from all texts by occurrence, so that no candidate is
its own measure, however many credentials of one format there are. Every candidate
token of the texts, of any length that a labelled credential may have, is scored
by how much likelier the credential formats make it than the ordinary one; a short
one must make up in likelihood what it lacks in length.

The texts are read twice, once to learn and once to judge; both passes are linear
in a text, whatever the number of its spans.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stage

# fixed values: the base patterns, their kinds in order, and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Length from which evidence per character is enough; shorter tokens need the evidence of as long a one.
FULL_LENGTH = 20
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % min(MIN_ACCESS, MIN_HEX))
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_VALUE)
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, credential), sorted. A run of hex digits or
    an access key is a part of a run of token characters, so those are looked
    for only in long runs; a match that is too short still uses up its text."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    for run in _RUN.finditer(text):
        a, b = run.span()
        out += [(m.start(), 1, m.end(), m[0]) for m in _LONG_ACCESS.finditer(text, a, b)]
        out += [(m.start(), 2, m.end(), m[0]) for m in _LONG_HEX.finditer(text, a, b)]
    return sorted(out)


class Covered:
    """Whether a stretch touches a base span: sorted, joined spans, bisected."""

    def __init__(self, base: list[tuple[int, int, int, str]]):
        self.starts, self.ends = [], []
        for a, _, b, _ in base:
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, str]]:
    """Runs of token characters that touch no base span, end dots cut, of at
    least the length of the shortest labelled credential."""
    covered = Covered(base)
    for run in _TOKEN.finditer(text):
        token = run[0].rstrip(".")
        if len(token) >= MIN_VALUE and not covered.touches(run.start(), run.start() + len(token)):
            yield run.start(), token


#: Places of a text at which an ordinary word is drawn.
PLACES = 16
_TAIL, _HEAD = re.compile(r"[A-Za-z0-9+/_.=-]*\Z"), re.compile(r"[A-Za-z0-9+/_.=-]*")


def words(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[float, str]]:
    """(rank, word): the runs of token characters, shorter than ``FULL_LENGTH``
    and touching no base span, at random places of the text. A copy has the same
    ones; a rank is a uniform random number."""
    out = []
    if text:
        covered = Covered(base)
        draw = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))).random
        for _ in range(PLACES):
            at, rank = int(draw() * len(text)), draw()
            left = _TAIL.search(text[max(0, at - FULL_LENGTH):at])[0]
            word = left + _HEAD.match(text[at:at + FULL_LENGTH])[0]
            a, b = at - len(left), at - len(left) + len(word)
            if at < b and len(word) < FULL_LENGTH and not covered.touches(a, b):
                out.append((rank, word))
    return out


def symbols(token: str) -> str:
    """Character classes: digit, hex and other letters of either case, signs."""
    return token.translate(_CLASSES)


_CLASSES = str.maketrans({c: k for cs, k in (("0123456789", "0"), ("abcdef", "a"), ("ghijklmnopqrstuvwxyz", "g"),
                                             ("ABCDEF", "A"), ("GHIJKLMNOPQRSTUVWXYZ", "G")) for c in cs})
#: Characters in each class; a sign stands for itself.
_SIZE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}
_END = "$"


class Automaton:
    """Probabilistic automaton by state merging (red states are final, blue
    ones their successors; a blue state is merged into the first compatible red
    one or turns red)."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.alpha = alpha
        for s in strings:
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][c]
            self.count[at][_END] = self.count[at].get(_END, 0) + 1
        red = [0]
        while blue := sorted({t for s in red for t in self.next[s].values()} - set(red)):
            b = blue[0]
            for r in red:
                if self._compatible(r, b):
                    self._merge(r, b, red)
                    break
            else:
                red.append(b)
        self.states = red

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = sum(self.count[a].values()), sum(self.count[b].values())
            if na and nb:
                bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
                for c in self.count[a].keys() | self.count[b].keys():
                    if abs(self.count[a].get(c, 0) / na - self.count[b].get(c, 0) / nb) >= bound:
                        return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return True

    def _merge(self, r: int, b: int, red: list[int]) -> None:
        for s in red:
            for c, t in self.next[s].items():
                if t == b:
                    self.next[s][c] = r
        todo = [(r, b)]
        while todo:  # fold the tree below b into what is below r
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c not in self.next[a]:
                    self.next[a][c] = t
                elif self.next[a][c] != t:
                    todo.append((self.next[a][c], t))

    def score(self, classes: str) -> float:
        """Log likelihood per character, given that the token goes on; what was
        never seen costs as one in a thousand."""
        at, total = 0, 0.0
        for c in classes:
            here = self.count[at] if at is not None else {}
            n = sum(here.values()) - here.get(_END, 0)
            p = (here.get(c, 0) + 0.001 * max(n, 1)) / (1.01 * max(n, 1))
            total += math.log(p / _SIZE.get(c, 1))
            at = self.next[at].get(c, at) if at is not None else None
        return total / max(1, len(classes))


@dataclass
class Formats:
    """Automata of credentials by kind, and of ordinary tokens."""

    credentials: list[Automaton]
    ordinary: Automaton | None
    margin: float = 1.0
    #: Verdicts by class string; texts share these by the thousand.
    known: dict[str, bool] = field(default_factory=dict)

    def secret(self, token: str) -> bool:
        if not self.credentials or self.ordinary is None:
            return False
        classes = symbols(token)
        verdict = self.known.get(classes)
        if verdict is None:
            lead = max(a.score(classes) for a in self.credentials) - self.ordinary.score(classes)
            verdict = lead * len(classes) > self.margin * max(len(classes), FULL_LENGTH)
            if len(classes) <= 64 and len(self.known) < 500_000:
                self.known[classes] = verdict
        return verdict


_SCAN = "base array<struct<kind:int,value:string>>, words array<struct<rank:double,value:string>>"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """What there is to learn from in each whole text: the credentials that the
    base patterns label (``base``) and some of its words; null counts as empty."""
    ship(docs.sparkSession)

    @F.pandas_udf(_SCAN)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            base = [base_spans(t or "") for t in texts]
            yield pd.DataFrame({"base": [[{"kind": k, "value": v} for _, k, _, v in b if len(v) <= LONGEST] for b in base],
                                "words": [[{"rank": r, "value": w} for r, w in words(t or "", b)] for t, b in zip(texts, base)]})

    return docs.select(find(F.col(text_col)).alias("found")).select("found.*")


#: Longest string that trains an automaton, and characters of all that train one (a bound on the prefix tree).
LONGEST, CHARACTERS = 4096, 250_000


def learn(found: DataFrame, per_kind: int = 2000, margin: float = 1.0, ordinary: int = 10_000) -> Formats:
    """Automata from bounded samples of whole strings: of each kind the first
    ``per_kind`` distinct strings by hash (of at most ``LONGEST`` characters each and
    ``CHARACTERS`` together), and the first ``ordinary`` words by rank (copies of a
    text count once). A format holds in swapped case too. No labelled
    credentials, or no words: no formats."""
    base = found.select(F.explode("base").alias("b")).select(F.col("b.kind").alias("kind"), F.col("b.value").alias("value"))

    def first(kind: int) -> list[str]:
        rows = base.where(F.col("kind") == kind).select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(per_kind)
        out, left = [], CHARACTERS
        for (value,) in rows.toLocalIterator():
            left -= len(value)
            if left < 0 and out:
                break
            out.append(value)
        return out

    credentials = [strings for k in range(3) if (strings := first(k))]
    if not credentials:
        return Formats([], None, margin)
    drawn = found.select(F.explode("words").alias("w")).select("w.rank", "w.value").distinct()
    plain = [r["value"] for r in drawn.orderBy("rank", "value").limit(ordinary).collect()]
    credentials += [[v.swapcase() for v in strings] for strings in credentials]
    automata = [Automaton([symbols(v) for v in strings]) for strings in [*credentials, plain] if strings]
    return Formats(automata[:len(credentials)], automata[-1] if plain else None, margin)


def find_secrets(docs: DataFrame, text_col: str = "text", keep_text: bool = True, out_col: str = "secrets") -> DataFrame:
    """``docs`` with ``out_col``: all spans (``start``, ``kind``, ``end``; code
    points, end exclusive), sorted by start and kind. Base spans always stay;
    formats add spans of candidates. Null and empty texts have none; repeated
    rows have the same ones; a column of that name is replaced; an empty table
    gives no rows. Only the labelled credentials and drawn words of the texts are
    staged for learning; without ``keep_text`` the text is left out of the result."""
    docs = docs.drop(out_col)
    formats = learn(stage(scan(docs, text_col), "secrets"))

    @F.pandas_udf("array<struct<start:int,kind:int,end:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                base = base_spans(t or "")
                found = [(a, k, b) for a, k, b, _ in base]
                found += [(a, 3, a + len(token)) for a, token in candidates(t or "", base) if formats.secret(token)]
                out.append([{"start": a, "kind": k, "end": b} for a, k, b in sorted(found)])
            yield pd.Series(out)

    marked = docs.withColumn(out_col, spans(F.col(text_col)))
    return marked if keep_text else marked.drop(text_col)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def hide(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with the sorted spans replaced; overlapping ones by one mark."""
    pieces, at = [], 0
    for a, b in spans:
        if a >= at:
            pieces += [text[at:a], mark]
        at = max(at, b)
    return "".join([*pieces, text[at:]])


def mask(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", spans_col: str = "secrets") -> DataFrame:
    """``docs`` (with ``spans_col``) with the spans of ``text_col`` replaced by
    ``mark``, overlapping ones together; texts without spans stay as they are."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def hidden(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([hide(t, list(zip(a, b)), mark) if t is not None and a is not None and len(a) else t for t, a, b in zip(texts, starts, ends)], dtype=object)

    some = F.size(spans_col) > 0
    given = [F.when(some, F.col(text_col)), F.when(some, F.transform(spans_col, lambda s: s["start"])), F.when(some, F.transform(spans_col, lambda s: s["end"]))]
    return docs.withColumn(text_col, F.when(some, hidden(*given)).otherwise(F.col(text_col)))
