"""English stemming (C1) by Porter's suffix rules (1980).

A word is a string of vowels and consonants: a, e, i, o, u are vowels, y is one behind a
consonant, everything else - digits, blanks, other scripts too - is a consonant.  The measure
of a stem is how often a vowel is followed by a consonant.  Rules go in passes; a pass takes
the longest of its endings that the word has and replaces it if the measure (or another
property) of what stands before allows it.  The rule tables are data.

A token may hold a blank (a bigram): the rules then see one word, whose end is the end of the
second; that is what the analyzer of a shop's index does with its bigrams.  No ending holds a
blank, so what stands before the last one decides by two things only: its measure (none, one,
more) and whether it ends in consonant and vowel.  A bigram is therefore stemmed as its last
word behind one of five beginnings, and a worker remembers the stems of words, not of bigrams.

Arrays of terms go through Arrow: the distinct terms of a batch are stemmed, the others taken
from them.  Tokens of one or two characters stay as they are; null stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rule tables.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
PARTICIPLES = {"eed": "ee", "ed": "", "ing": ""}
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
ENDINGS = {e: "" for e in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
                           "ate", "iti", "ous", "ive", "ize")}

V, C = "V", "c"
REMEMBERED = 150_000  # entries of a worker's tables
SLICE = 1 << 18       # words stemmed at a time


class _Marks(dict):
    def __missing__(self, code: int) -> str:
        return C


_MARKS = _Marks({ord(c): V for c in "aeiou"} | {ord("y"): "y"})


def shape(word: str) -> str:
    """The word's vowels as ``V`` and consonants as ``c``."""
    marked = word.translate(_MARKS)
    if "y" not in marked:
        return marked
    out = ""
    for c in marked:
        out += c if c != "y" else V if out.endswith(C) else C
    return out


def measure(shaped: str) -> int:
    return shaped.count(V + C)


def _closed(stem: str, shaped: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return shaped.endswith(C + V + C) and stem[-1] not in "wxy"


def _tidied(stem: str) -> str:
    """The end of a word that lost ``ed`` or ``ing``."""
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    shaped = shape(stem)
    if shaped.endswith(C) and stem[-1:] == stem[-2:-1]:
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(shaped) == 1 and _closed(stem, shaped) else stem


@dataclass(frozen=True)
class Pass:
    """``endings`` and what replaces them where ``holds(stem, ending)``; ``then`` finishes a stem."""
    endings: dict[str, str]
    holds: Callable[[str, str], bool]
    behind: dict[str, tuple[str, ...]] | None = None  # what must stand before an ending, by ending
    then: Callable[[str, str], str] | None = None
    by_letter: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        # Most words are told by their last letter; the longest endings come first.
        self.by_letter.update({c: tuple(sorted((e for e in self.endings if e[-1] == c), key=len, reverse=True))
                               for c in {e[-1] for e in self.endings}})

    def __call__(self, word: str) -> str:
        for ending in self.by_letter.get(word[-1:], ()):
            if word.endswith(ending):
                stem = word[:-len(ending)]
                if self.behind and ending in self.behind and not stem.endswith(self.behind[ending]):
                    continue
                if not self.holds(stem, ending):
                    return word
                new = stem + self.endings[ending]
                return new if self.then is None else self.then(new, ending)
        return word


def _measured(k: int):
    return lambda stem, ending: measure(shape(stem)) > k


def _has_vowel(stem: str, ending: str) -> bool:
    return V in shape(stem)


def _long(stem: str, ending: str) -> bool:
    shaped = shape(stem)
    m = measure(shaped)
    return m > 1 or (m == 1 and not _closed(stem, shaped))


PASSES = (
    Pass(PLURALS, lambda stem, ending: True),
    Pass(PARTICIPLES, lambda stem, ending: measure(shape(stem)) > 0 if ending == "eed" else _has_vowel(stem, ending),
         then=lambda new, ending: new if ending == "eed" else _tidied(new)),
    Pass({"y": "i"}, _has_vowel),
    Pass(DOUBLE_SUFFIXES, _measured(0)),
    Pass(SUFFIXES, _measured(0)),
    Pass(ENDINGS, _measured(1), behind={"ion": ("s", "t")}),
    Pass({"e": ""}, _long),
    Pass({"ll": "l"}, lambda stem, ending: measure(shape(stem) + C) > 1),
)


def word_stem(word: str) -> str:
    """One term stemmed by the passes, whatever it holds."""
    if len(word) > 2:
        for p in PASSES:
            if word[-1:] in p.by_letter:
                word = p(word)
    return word


class _Remembered(dict):
    """What ``made`` gives for a key; emptied whenever ``REMEMBERED`` keys are held."""

    def __init__(self, made: Callable[[str], str]):
        super().__init__()
        self.made = made

    def __missing__(self, key: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.made(key)
        return value


#: By measure (none, one, more), and whether consonant and vowel are at the end: the shortest such beginnings.
_SHORTEST = ("b ", "ab ", "ba ", "abab ", "aba ")
_KINDS = {x: i for i, x in enumerate(_SHORTEST)}


def _beginning(words: str) -> str:
    """The shortest text, with a blank, that acts on an ending like ``words`` and a blank."""
    shaped = shape(words)
    m = measure(shaped + C)
    return _SHORTEST[0 if m == 0 else min(m, 2) * 2 - 1 + shaped.endswith(C + V)]


def _ending(text: str) -> str:
    """The last word of beginning and word, stemmed behind it."""
    return word_stem(text)[text.index(" ") + 1:]


_WORDS, _BEGINNINGS, _ENDINGS = _Remembered(word_stem), _Remembered(_beginning), _Remembered(_ending)


def term_stem(term: str | None) -> str | None:
    """:func:`word_stem`, remembered by words."""
    if term is None or len(term) <= 2:
        return term
    before, blank, last = term.rpartition(" ")
    if before.endswith(" "):
        return word_stem(term)  # a second blank is a doubled letter to the rules
    return f"{before} {_ENDINGS[_BEGINNINGS[before] + last]}" if blank else _WORDS[last]


def _stemmed_lists(lists):
    import pyarrow as pa
    import pyarrow.compute as pc
    found = lists.flatten().dictionary_encode()
    stems_ = pa.array(map(term_stem, found.dictionary.to_pylist()), pa.string()).take(found.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, stems_, mask=pc.is_null(lists)).cast(lists.type)


def distinct(numbers):
    """The distinct numbers in order (np.unique hashes them first, which takes longer)."""
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=numbers[:1] - 1) != 0]


def _distinct_terms(lists, least: int, pairs: bool):
    """(list number, term) of all words of ``least`` characters and (``pairs``) neighbours of the
    lists, stemmed, each once a list.  Words are numbers here: only distinct words, and distinct
    (beginning, word), are stemmed."""
    import pyarrow as pa
    import pyarrow.compute as pc
    words = lists.flatten().dictionary_encode()
    known, w = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    texts = known.to_pylist()
    stemmed = pa.array(map(term_stem, texts), pa.string()).dictionary_encode()
    code, long_ = (x.to_numpy(zero_copy_only=False) for x in (stemmed.indices, pc.greater_equal(pc.utf8_length(known), least)))
    n = max(1, len(stemmed.dictionary))
    kept = long_[w] if len(w) else np.zeros(0, dtype=bool)
    once = distinct(of[kept] * n + code[w[kept]])
    at, terms = once // n, stemmed.dictionary.take(pa.array(once % n))
    if not pairs or len(w) < 2:
        return at, terms
    near = of[:-1] == of[1:]
    a, b, of, n = w[:-1][near], w[1:][near], of[:-1][near], len(texts)
    kinds = np.array([_KINDS[_BEGINNINGS[x]] for x in texts], dtype=np.int64)
    both = kinds[a] * n + b
    used = np.zeros(len(_SHORTEST) * n, dtype=bool)
    used[both] = True
    ends = pa.array((_ENDINGS[_SHORTEST[x // n] + texts[x % n]] for x in np.flatnonzero(used).tolist()), pa.string()).dictionary_encode()
    which = (np.cumsum(used) - 1)[both]
    m = max(1, len(ends.dictionary))
    once = distinct((of * n + a) * m + ends.indices.to_numpy(zero_copy_only=False)[which])
    first = once // m
    pair = pc.binary_join_element_wise(known.take(pa.array(first % n)), ends.dictionary.take(pa.array(once % m)), " ")
    return np.concatenate([at, first // n]), pa.concat_arrays([terms, pair])


def distinct_terms(lists, least: int, pairs: bool = True):
    """:func:`_distinct_terms`, in slices, as every word of a slice takes some hundred bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc
    before = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(lists)]
    found = [(lo, *_distinct_terms(lists.slice(lo, hi - lo), least, pairs)) for lo, hi in zip(cuts, cuts[1:])]
    return np.concatenate([at + lo for lo, at, _ in found]), pa.concat_arrays([terms for _, _, terms in found])


def _terms(least: int, pairs: bool):
    def terms(lists):
        import pyarrow as pa
        import pyarrow.compute as pc
        at, values = distinct_terms(lists, least, pairs)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(lists)))])
        values = values.take(pa.array(np.argsort(at, kind="stable")))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pc.is_null(lists)).cast(lists.type)
    return terms


def term_stems(words: Column, least: int, pairs: bool = True) -> Column:
    """The distinct stems of a list's words of at least ``least`` characters and (``pairs``) of its
    pairs of neighbours, joined by a blank; words hold no blank and are not empty."""
    return F.arrow_udf(_terms(least, pairs), "array<string>")(words)


def stems(terms: Column) -> Column:
    """Every term of an array stemmed, in order."""
    return F.arrow_udf(_stemmed_lists, "array<string>")(terms)


def stem(term: Column) -> Column:
    """One term stemmed."""
    return F.get(stems(F.array(term)), F.lit(0))
