"""Ranked lexical search of many items by scans of the texts, without an index of documents.

The terms of all items make one Aho-Corasick automaton.  Every term stands in it between two
guards, and a text is brought to the same form - A-Z lower-cased, every character that belongs
to no term turned into a guard, one guard at either end - so a match is always a whole term of
the text.  Bytes of the UTF-8 form are scanned (as one character each), so nothing else folds.

1. First scan: how many documents hold each term (df), the number of documents with a term
   (N) and of all their terms (L): sums per task, then per term.  What comes to the driver is
   one number a term.
2. Second scan: the automaton's outputs are counted per document (tf) and mapped to the
   items that hold the term; an item's scores are summed per document.  A task keeps the best
   ``k`` documents of each item, and a rank filter the best of all.

The automaton and the terms' items go to the executors, so their size is bounded: items are
taken in blocks of at most ``BLOCK_TERMS`` (item, term) pairs - or one larger item -, each with
two scans of its own; the usual question set is one block.  All documents are scanned for every
item, and nothing is dropped: a score is exact.

Score of a document with n terms: the sum over the item's terms in it, once each, of
w * ((1000000000 tf) div (1000 tf + 8 m)), where m = 10 + (90 n N) div L and
w = floor(1000 ln((2 N + 2) / (2 df + 1))); whole numbers of 64 bits but for the logarithm.

Defined cases: null text, or one without terms, is no document of N and in no result; rows of
one item_id are one item with the terms of all; an item without terms has no rows; null is an
item_id like others; a null doc_id takes part and stands behind equal scores of others; rows
that repeat a doc_id are documents of their own; empty tables give no rows; extra columns are
ignored; long texts are scanned whole.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplytics.llm.common import kept, pick
from shoplytics.operators.ordering import running_sum

#: A term: a run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS = 200_000
BEST = 10
#: Scores of (documents, items) summed at a time.
_CELLS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes in the form that is scanned: terms lower-cased, everything else a guard.
_FORM = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def scanned(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FORM)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: the distinct terms of every item."""
    rows = pick(items, "item_id", "text").select("item_id", F.explode(
        F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), 0)).alias("term"))
    return rows.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


class _Automaton:
    """The terms of a block of items, and which items hold each."""

    def __init__(self, terms: list[str], held: list[list[int]], n_items: int):
        import ahocorasick
        self.machine, self.n_items = ahocorasick.Automaton(), n_items
        for i, t in enumerate(terms):
            self.machine.add_word(f" {t.encode('utf-8', 'surrogatepass').decode('latin-1')} ", i)
        self.machine.make_automaton()
        self.n_terms = len(terms)
        self.sizes = np.array([len(h) for h in held], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.items = np.array([x for h in held for x in h], dtype=np.int64)

    def scan(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a list of texts: n of each, and (text, term, tf) of every term found."""
        n, per, hits = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), []
        for i, text in enumerate(texts):
            text = text.as_py()
            if not text:
                continue
            form = scanned(text)
            n[i] = len(form.split())
            found = [v for _, v in self.machine.iter(f" {form.decode('latin-1')} ")]
            per[i] = len(found)
            hits += found
        key = np.repeat(np.arange(len(texts)), per) * self.n_terms + np.array(hits, dtype=np.int64)
        key, tf = np.unique(key, return_counts=True)
        return n, key // max(1, self.n_terms), key % max(1, self.n_terms), tf


_BUILT: dict[tuple, _Automaton] = {}


def _automaton(key: tuple, *parts) -> _Automaton:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = _Automaton(*parts)
    return _BUILT[key]


def _statistics(docs: DataFrame, key: tuple, block: tuple) -> tuple[int, int, np.ndarray]:
    """N, L and the df of the block's terms."""
    n_terms = len(block[0])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        automaton = _automaton(key, *block)
        df, total = np.zeros(n_terms, dtype=np.int64), np.zeros(2, dtype=np.int64)
        for b in batches:
            n, _, term, _ = automaton.scan(b.column("text"))
            df += np.bincount(term, minlength=n_terms)
            total += (int((n > 0).sum()), int(n.sum()))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([total, df[at]]))],
                                         names=["term", "n"])

    sums = pick(docs, "text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r["term"]: r["n"] for r in sums}
    return by.get(-2, 0), by.get(-1, 0), np.array([by.get(i, 0) for i in range(n_terms)], dtype=np.int64)


class _Best:
    """The best ``k`` (score, doc_id) of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, dtype=np.int64)  # a score below it has no place
        self.item, self.score, self.null, self.doc = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, item, score, null, doc) -> None:
        self.item, self.score, self.null, self.doc = map(np.concatenate, zip(
            (self.item, self.score, self.null, self.doc), (item, score, null, doc)))
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        sorted_ = self.item[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        order, full = order[place < self.k], order[place == self.k - 1]
        self.least[self.item[full]] = self.score[full]
        self.item, self.score, self.null, self.doc = (x[order] for x in (self.item, self.score, self.null, self.doc))


def _scores(docs: DataFrame, key: tuple, block: tuple, n_docs: int, length: int, df: np.ndarray, k: int) -> DataFrame:
    """item (number within the block), doc_id, score: the best of every task."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    n_items = block[2]

    def rank(batches: Iterator) -> Iterator:
        import pyarrow as pa
        automaton, best = _automaton(key, *block), _Best(n_items, k)
        step = max(1, _CELLS // n_items)
        for b in batches:
            texts, ids = b.column("text"), b.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), step):
                n, row, term, tf = automaton.scan(texts.slice(lo, step))
                m = 10 + 90 * n * n_docs // length
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                # Every (row, term) meets the items of its term.
                sizes = automaton.sizes[term]
                ends = np.cumsum(sizes)
                at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(automaton.first[term], sizes)
                cells = np.zeros(len(n) * n_items, dtype=np.int64)
                np.add.at(cells, np.repeat(row, sizes) * n_items + automaton.items[at], np.repeat(part, sizes))
                hit = np.flatnonzero(cells.reshape(len(n), n_items) >= best.least)
                if len(hit):
                    r = hit // n_items + lo
                    best.add(hit % n_items, cells[hit], null[r], ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.null), pa.array(best.score)],
                                         names=["item", "doc_id", "score"])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(rank, "item long, doc_id long, score long")


_OUT = "item_id long, rank int, doc_id long, score long"


def ranked_search(items: DataFrame, docs: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents with a score above 0,
    equal scores by ascending doc_id."""
    spark = docs.sparkSession
    asked = item_terms(items).withColumn("item_id", F.col("item_id").cast("long"))
    asked = asked.withColumn("size", F.size("terms").cast("long"))
    before = running_sum(asked, ["item_id"], "size", "before", inclusive=False)
    asked = kept(before.withColumn("block", F.expr(f"(before + size - 1) div {int(block_terms)}")))
    out = spark.createDataFrame([], _OUT)
    for (number,) in asked.select("block").distinct().orderBy("block").toLocalIterator():
        rows = asked.filter(F.col("block") == number).select("item_id", "terms").orderBy("item_id").collect()
        pairs = sorted((t, i) for i, r in enumerate(rows) for t in r["terms"])
        held = [(t, [i for _, i in g]) for t, g in groupby(pairs, key=lambda p: p[0])]
        block = ([t for t, _ in held], [h for _, h in held], len(rows))
        key = (uuid.uuid4().hex, number)
        n_docs, length, df = _statistics(docs, key, block)
        if not n_docs:
            break
        best = _scores(docs, key, block, n_docs, length, df, k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        out = out.unionByName(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
