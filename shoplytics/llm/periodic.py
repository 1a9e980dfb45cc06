"""Runs of repeated words: maximal periodic stretches, from maximal pairs.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least max(6, 4 q) words that cannot be extended on either side with the
same period.  Two occurrences x < y of one common stretch of length l form a maximal pair
if the words before them differ and the words behind them differ.  Then the words from x
to y + l are a stretch of period y - x that nothing extends, so the maximal pairs with
3 (y - x) <= l are the runs, and nothing has to be extended.  (l is 5 at least then.)

Per text:

1. Words are numbered.  Suffixes whose first five words occur once in the text are in no
   common stretch of five words; the others are sorted by prefix doubling, and the common
   lengths of neighbours in that order are read off the ranks of the doublings.
2. The tree of LCP intervals is gone through bottom-up with a stack.  An interval holds its
   positions in order, and lists of them by the word on their left.  When two children meet,
   each position of the smaller looks for partners in the larger one, not further away than a
   third of the common length.  So near to each other, distances between occurrences are
   multiples of one period (Fine and Wilf), hence the partners on the right all belong to one
   class of left words - one comparison, then a slice of that class - and of those on the
   left, only the first can be of another class.  Pairs of one class are never listed.
3. A stretch found with several periods counts with the smallest.

Per word this costs a few sorts of integers, and for words in repeated stretches some
bisections; a text is looked at whole, in one task, and needs about 4 log2(n) bytes a word.
(Only inserts in the middle of an interval's list are more than logarithmic: they move
memory, 8 bytes a position.)  Rows are independent: no shuffle, whatever the source.

Defined cases: null text, or one without words, has no words, no runs, four nulls and the
digests of the empty string; a null doc_id is treated like others; rows that repeat a doc_id
give a row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytics.llm.common import pick

#: Shortest run, and its length in periods.
MIN_LENGTH, MIN_PERIODS = 6, 4
#: The shortest common stretch of a pair that makes a run.
SHORTEST = MIN_LENGTH - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal words as equal numbers."""
    number = defaultdict(itertools.count().__next__)
    return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))


def _candidates(ids: np.ndarray) -> np.ndarray:
    """Positions whose first five words may occur again (equal hashes)."""
    n = len(ids) - SHORTEST + 1
    w = ids.astype(np.uint64)
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(SHORTEST):
        h = (h ^ w[j:j + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def suffix_order(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes starting at ``at`` in order, and the common length of each with the next."""
    n, ranks, step = len(ids), [np.unique(ids, return_inverse=True)[1].astype(np.int32)], 1
    while len(np.unique(ranks[-1][at])) < len(at):
        now = ranks[-1].astype(np.int64)
        behind = np.zeros(n, dtype=np.int64)
        behind[:n - step] = now[step:] + 1
        ranks.append(np.unique(now * (n + 1) + behind, return_inverse=True)[1].astype(np.int32))
        step *= 2
    order = at[np.argsort(ranks[-1][at], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        for x in (a, b, common):
            x[same] += 1 << k
    return order, common


def _join(a: tuple, b: tuple, length: int, left: list[int], found: dict) -> tuple:
    """Two children of an interval of common ``length`` as one; their pairs go to ``found``.

    A child: its positions in order, and those by the word on their left."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    every, classes = b
    reach = length // (MIN_PERIODS - 1)
    for p in a[0]:
        k, mine = bisect_left(every, p), left[p]
        if k < len(every) and every[k] - p <= reach and left[every[k]] != mine:
            others = classes[left[every[k]]]
            for y in others[bisect_left(others, p):bisect_right(others, p + reach)]:
                key = (p, y + length)
                found[key] = min(y - p, found.get(key, y))
        if k and p - every[k - 1] <= reach:
            x = every[bisect_left(every, p - reach, 0, k)]
            if left[x] != mine:
                key = (x, p + length)
                found[key] = min(p - x, found.get(key, p))
    _add(every, a[0])
    for word, some in a[1].items():
        if word in classes:
            _add(classes[word], some)
        else:
            classes[word] = some
    return b


def _add(into: list[int], more: list[int]) -> None:
    if len(more) > 16:
        into.extend(more)
        into.sort()  # two ascending runs: merged
    else:
        for p in more:
            insort(into, p)


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    at = _candidates(ids)
    if not len(at):
        return []
    order, common = suffix_order(ids, at)
    left = [-1, *ids[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, tuple]] = []  # open intervals: common length, joined children
    for p, with_next in zip(order.tolist(), [*common.tolist(), 0]):
        child = ([p], {left[p]: [p]})
        while stack and stack[-1][0] > with_next:
            length, before = stack.pop()
            child = _join(child, before, length, left, found)
        if with_next >= SHORTEST:
            if stack and stack[-1][0] == with_next:
                child = _join(child, stack.pop()[1], with_next, left, found)
            stack.append((with_next, child))
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= MIN_LENGTH)


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def stretched(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query of this operator takes them: every tenth document by the crc32
    of its id goes on, from some word, in a cycle of the words from there."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_OUT = ("n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long")


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _row(words: list[bytes]) -> tuple:
    found = runs(numbered(words))
    best = strongest(found)
    left = list(itertools.compress(words, kept_words(len(words), found).tolist())) if found else words
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    return (len(found), *top, _hex(listed), _hex(b" ".join(left)), len(words), len(left))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def periodic_runs(docs: DataFrame, prepare=None) -> DataFrame:
    """doc_id, n_runs, the strongest run, digests of all runs and of the text without repeats, n_words, n_kept.

    ``prepare(words, doc_id)``, if given, changes the words first."""

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in f"doc_id long, {_OUT}".split(", ")])
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for i, text in zip(ids, b.column("text")):
                words = _words(text.as_py())
                rows.append((i, *_row(prepare(words, i) if prepare else words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) \
                if rows else pa.RecordBatch.from_pylist([], schema)

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(find, f"doc_id long, {_OUT}")


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_dropped: the text with every run cut to its first period, and how many words that took.

    Texts without runs are as they were, white space included; others have their words joined by one space."""

    @F.pandas_udf("text string, n_dropped long")
    def cut(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = _words(t)
            found = runs(numbered(words))
            stay = kept_words(len(words), found)
            out.append((b" ".join(itertools.compress(words, stay.tolist())).decode("utf-8", "surrogatepass") if found else t,
                        int((~stay).sum())))
        return pd.DataFrame(out, columns=["text", "n_dropped"])

    return pick(docs, "doc_id", "text").select("doc_id", cut("text").alias("_c")).select("doc_id", "_c.*")
