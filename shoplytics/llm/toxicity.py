"""Toxicity by a weighted grammar of finite-state transducers over clauses.

The words of a clause are looked up once (fixed word classes, learned stems) and become symbols; five
transducers, each a table (state, symbol) -> (state, symbol), read them and are composed into one:

* target - reads the clause first for second and third person words and names for people, and puts
  a mark before it;
* threat - verbs of violence in a clause with a target, after a first person or "will": THREAT;
  such a verb elsewhere is passed on as the plain word it is;
* insult - a word that starts with a learned stem: INSULT, with that stem's weight;
* negation - after a negator, matches are NEGATED;
* reported speech - after a verb of saying, or within quotation marks, matches are REPORTED.

Contractions are two words to them ("isn't" is "is not").  A match comes out with its context (threat,
negated, reported, targeted), which picks a factor, learned from how much more often such matches stand in
toxic than in clean training texts (with a prior, so rare contexts keep the prior factor).  A
clause's weight is the sum of its matches; a document's score is the logistic of a bias plus the clause weights.

Learning: stems from at most about ``FIT_ROWS`` labelled texts per label
(documented bound), chosen by a hash of doc_id, two thirds of them; the other third
calibrates the weights.  Every prefix of every word, up to ``LONGEST`` letters, is
counted once per text by Spark; a prefix is a stem if it is frequent enough in
toxic and rare enough in clean texts, and as long as it can be without losing
texts.  A stem stands in a fiftieth of the toxic texts at least, so there are at most fifty times as many as
a toxic text of the sample has prefixes on average; none are cut.

Texts are read whole: one scan with an Aho-Corasick automaton of the stems and
threat verbs finds candidate clauses, and only these are parsed.

Defined cases: null or empty text scores the bias alone (a clean score); a text
of one very long clause is parsed like any other; rows that repeat score alike;
null doc_id: held_out false, never trained on; labels that contradict each other
count each; no labels at all: every score 0; an empty table gives no rows; extra
columns are ignored by ``score`` and kept by ``clean``.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytics.llm.common import pick, plain
from shoplytics.llm.language import sample

FIT_ROWS = 3000
LONGEST, SHORTEST = 14, 3
THRESHOLD = 0.3

_TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»]")
_BREAK = re.compile(r"[.!?;\n]+")
_CONTRACTED = re.compile(r"n['’]t(?![^\W\d_])")

# Fixed word lists of the grammar, by transducer.
THREATS = frozenset("kill hurt destroy beat shoot stab burn crush töten schlagen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours yourself he she they them him her people everyone du dich ihr euch sie vous tu toi eux tú usted ellos ustedes".split())
NEGATORS = frozenset("not no never nicht kein keine nie pas jamais non nunca jamás ni".split())
REPORTING = frozenset("said says say called wrote quoted reported claimed sagte schrieb dit écrit dijo escribió".split())
ARMING = frozenset("i we will ich wir je nous yo".split())
QUOTES = frozenset("\"“”«»")

# Symbols between the transducers.
TARGETED, UNTARGETED = "targeted", "untargeted"
QUOTE, NEGATOR, SAYING, ARM, VIOLENCE, VIOLENCE_STEM, STEM, OTHER = (
    "quote", "negator", "saying", "arm", "violence", "violence+stem", "stem", "other")
THREAT, INSULT = "threat", "insult"
WORDS = (QUOTE, NEGATOR, SAYING, ARM, VIOLENCE, VIOLENCE_STEM, STEM, OTHER)
THREAT_WEIGHT = 3.0

Machine = dict[tuple, dict]  # state -> symbol -> (state, symbol)


def _machine(states, step, symbols) -> Machine:
    """The table of a transducer; a symbol for which ``step`` gives nothing passes unchanged."""
    return {q: {x: step(q, x) or (q, x) for x in symbols} for q in states}


def threat_machine() -> Machine:
    """States (targeted, armed); start (0, 0)."""
    def step(q, x):
        targeted, armed = q
        if x in (TARGETED, UNTARGETED):
            return (int(x == TARGETED), armed), x
        if x == ARM:
            return (targeted, 1), x
        if x in (VIOLENCE, VIOLENCE_STEM):
            return q, THREAT if targeted and armed else STEM if x == VIOLENCE_STEM else OTHER
    return _machine([(t, a) for t in (0, 1) for a in (0, 1)], step, (TARGETED, UNTARGETED, *WORDS))


def insult_machine() -> Machine:
    """One state: the stem was found by the trie of stems."""
    return _machine([()], lambda q, x: (q, INSULT) if x == STEM else None,
                    (TARGETED, UNTARGETED, QUOTE, NEGATOR, SAYING, ARM, STEM, OTHER, THREAT))


_MATCHES = (THREAT, INSULT)


def negation_machine() -> Machine:
    """States: a negator was read or not; start 0.  Matches become (match, negated)."""
    def step(q, x):
        return (1, x) if x == NEGATOR else (q, (x, q)) if x in _MATCHES else None
    return _machine([0, 1], step, (TARGETED, UNTARGETED, QUOTE, NEGATOR, SAYING, ARM, OTHER, *_MATCHES))


def reported_machine() -> Machine:
    """States (targeted, said, quoted); start (0, 0, 0).  A match comes out with its whole context."""
    def step(q, x):
        targeted, said, quoted = q
        if x in (TARGETED, UNTARGETED):
            return (int(x == TARGETED), said, quoted), x
        if x == SAYING:
            return (targeted, 1, quoted), x
        if x == QUOTE:
            return (targeted, said, 1 - quoted), x
        if isinstance(x, tuple):
            return q, (int(x[0] == THREAT), x[1], int(said or quoted), targeted)
    matches = [(m, n) for m in _MATCHES for n in (0, 1)]
    return _machine([(t, s, d) for t in (0, 1) for s in (0, 1) for d in (0, 1)], step,
                    (TARGETED, UNTARGETED, QUOTE, NEGATOR, SAYING, ARM, OTHER, *matches))


def compose(first: Machine, then: Machine) -> Machine:
    """The transducer that feeds what ``first`` writes to ``then``: states are pairs."""
    out: Machine = {}
    for p, arcs in first.items():
        for q, reads in then.items():
            out[p, q] = {x: ((p2, reads[y][0]), reads[y][1]) for x, (p2, y) in arcs.items()}
    return out


GRAMMAR = functools.reduce(compose, (threat_machine(), insult_machine(), negation_machine(), reported_machine()))
START = ((((0, 0), ()), 0), (0, 0, 0))


class Grammar:
    """The composed transducers with learned stems, context factors and bias."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.factor = {(k, n, r, t): 1.0 for k in (0, 1) for n in (0, 1) for r in (0, 1) for t in (0, 1) if t or not k}
        self.bias, self.unit = -4.0, 1.0
        words = sorted(set(stems) | THREATS)
        self.scan = ahocorasick.Automaton() if words else None
        for w in words:
            self.scan.add_word(w, len(w))
        if words:
            self.scan.make_automaton()

    def __reduce__(self):
        return _grammar, (self.stems, self.factor, self.bias, self.unit)

    def clauses(self, text: str) -> Iterator[tuple[str, tuple]]:
        """Clauses that hold a candidate at a word's start, with their matches."""
        low = text.lower()
        done = -1
        breaks = None
        for end, length in (self.scan.iter(low) if self.scan else ()):
            start = end + 1 - length
            if start < done or (start and low[start - 1].isalpha()):
                continue
            if breaks is None:
                breaks = [m.start() for m in _BREAK.finditer(low)]
            i = bisect.bisect_right(breaks, start)
            a, done = (breaks[i - 1] if i else 0), (breaks[i] if i < len(breaks) else len(low))
            matches = tuple(self.read(low[a:done]))
            if matches:
                yield low[a:done], matches

    def symbol(self, token: str) -> tuple[str, float]:
        """The word class of a token, and its stem's weight."""
        for words, x in ((QUOTES, QUOTE), (NEGATORS, NEGATOR), (REPORTING, SAYING), (ARMING, ARM)):
            if token in words:
                return x, 0.0
        weight = self.stem(token)
        if token in THREATS:
            return (VIOLENCE_STEM if weight else VIOLENCE), weight
        return (STEM if weight else OTHER), weight

    def read(self, clause: str) -> Iterator[tuple[tuple, float]]:
        """The composed machine over one clause: (context, weight) of each match."""
        tokens = _TOKEN.findall(_CONTRACTED.sub(" not", clause))
        mark = TARGETED if any(t in TARGETS for t in tokens) else UNTARGETED
        state, _ = GRAMMAR[START][mark]
        for t in tokens:
            x, weight = self.symbol(t)
            state, out = GRAMMAR[state][x]
            if isinstance(out, tuple):
                yield out, THREAT_WEIGHT if out[0] else weight

    def stem(self, token: str) -> float:
        for n in range(SHORTEST, min(len(token), LONGEST) + 1):
            if w := self.stems.get(token[:n]):
                return w
        return 0.0

    def matches(self, text: str) -> Counter:
        """Context -> summed weight of its matches, over all clauses."""
        out: Counter = Counter()
        for _, found in self.clauses(text):
            for context, weight in found:
                out[context] += weight
        return out

    def score(self, text: str | None) -> float:
        z = self.bias
        if isinstance(text, str):
            z += self.unit * sum(self.factor[c] * w for c, w in self.matches(text).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def calibrate(self, found: list[dict], labels: list[int]) -> None:
        """Context factors, then bias and unit by logistic regression on the match sum.
        ``found``: per training text, :meth:`matches`."""
        n = [max(1, labels.count(0)), max(1, labels.count(1))]
        for c in self.factor:
            with_ = [sum(1 for f, y in zip(found, labels) if y == k and f.get(c)) for k in (0, 1)]
            # How far the odds of this context speak for toxic, against a prior of 5 texts either way.
            toxic, clean = (with_[1] + 5 * self.prior(c)) / (n[1] + 5), (with_[0] + 5 * (1 - self.prior(c))) / (n[0] + 5)
            self.factor[c] = toxic / (toxic + clean)
        if not found:
            return
        x = [sum(self.factor[c] * w for c, w in f.items()) for f in found]
        a, b = self.bias, 1.0
        for _ in range(200):  # gradient steps on the mean loss, with a light pull of b to 1
            ga = gb = 0.0
            for v, y in zip(x, labels):
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * min(v, 20.0)))))
                ga += p - y
                gb += (p - y) * min(v, 20.0)
            a -= 2.0 * ga / len(x)
            b = max(0.1, b - 0.2 * (gb / len(x) + 0.001 * (b - 1)))
        self.bias, self.unit = a, b

    @staticmethod
    def prior(context: tuple) -> float:
        _, negated, reported, targeted = context
        return 0.9 * (0.5 if negated else 1) * (0.6 if reported else 1) * (1 if targeted else 0.95)


def _grammar(stems, factor, bias, unit) -> Grammar:
    g = Grammar(stems)
    g.factor, g.bias, g.unit = factor, bias, unit
    return g


def prefixes(text: str) -> set[str]:
    words = {w for w in _TOKEN.findall(text.lower()) if len(w) >= SHORTEST}
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _prefix_counts(rows: DataFrame) -> DataFrame:
    """prefix, toxic, clean: in how many of the texts of either label a word starts with it."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            seen = (Counter(), Counter())
            for text, y in zip(p["text"], p["toxic"]):
                seen[int(y == 1)].update(prefixes(text))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"prefix": keys, "n1": [seen[1][k] for k in keys], "n0": [seen[0][k] for k in keys]})

    return (rows.select("text", "toxic").mapInPandas(count, "prefix string, n1 long, n0 long")
            .groupBy("prefix").agg(F.sum("n1").alias("toxic"), F.sum("n0").alias("clean")))


def learn_stems(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weighted stems: log odds of the prefixes that mark toxic texts."""
    least = max(3, n_toxic // 50)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    # A mark of toxic texts: enough of them, and thirty times the share of clean texts.
    found = (_prefix_counts(rows).filter(F.col("toxic") >= least).withColumn("odds", odds)
             .filter(F.col("odds") > math.log(30)).collect())
    by = {r.prefix: r for r in found}
    longer: dict[str, int] = {}
    for p, r in by.items():
        longer[p[:-1]] = max(longer.get(p[:-1], 0), r.toxic)
    # Go on while one longer prefix holds nearly all the texts; then stop, and leave its extensions out.
    ends = {p for p, r in by.items() if longer.get(p, 0) < 0.9 * r.toxic}
    stems = {p: by[p].odds for p in ends if not any(p[:n] in ends for n in range(SHORTEST, len(p)))}
    return {p: round(stems[p], 4) for p in sorted(stems)}


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no label is learned from: crc32 of the id mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = FIT_ROWS) -> Grammar | None:
    """Learns from the labelled rows that are not held out; None if there are none."""
    y = pick(labels, "doc_id", "toxic").filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).distinct()
    y = sample(y, "toxic", per_label)  # ids and labels only, about per_label rows a label: small enough to broadcast
    rows = pick(docs, "doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(y), "doc_id")
    got = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).persist()
    try:
        # Stems come from two thirds of the texts; the rest, which they have not seen, weighs them.
        third = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("stems")), F.lit(3)) == 0
        n = {r.toxic: r["count"] for r in got.filter(~third).groupBy("toxic").count().collect()}
        if not n.get(1) or not n.get(0):
            return None
        grammar = Grammar(learn_stems(got.filter(~third), n[1], n[0]))

        order = sorted(grammar.factor)

        @F.pandas_udf("array<double>")
        def found(texts: pd.Series) -> pd.Series:
            return pd.Series([[grammar.matches(t).get(c, 0.0) for c in order] for t in texts])

        rows = got.filter(third).select("doc_id", "toxic", found("text").alias("m")).orderBy("doc_id", "toxic").collect()
        grammar.calibrate([dict(zip(order, r.m)) for r in rows], [r.toxic for r in rows])
        return grammar
    finally:
        got.unpersist()


def score(docs: DataFrame, grammar: Grammar | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), scorer(docs, grammar)("text").alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def scorer(docs: DataFrame, grammar: Grammar | None):
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # its stems; their bound is above

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        g = shared.value
        return pd.Series([g.score(t) if g else 0.0 for t in texts], dtype=float)

    return run


def clean(docs: DataFrame, labels: DataFrame, per_label: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the documents that the grammar rejects."""
    inner, (text,) = plain(docs, "text")
    out = inner.withColumn("_toxicity", scorer(docs, fit(docs, labels, per_label))(text))
    return out.filter(F.col("_toxicity") < THRESHOLD).drop("_toxicity").toDF(*docs.columns)
