"""Personal data: patterns propose spans, checks confirm them, context words score them.

Kinds: email, ip, card, phone (the base kinds) and iban.  A pattern proposes the
leftmost non-overlapping spans of its kind; a span that fails its check (octets,
Luhn, number of digits, mod 97) is dropped, and its characters are not tried
again; an iban alone may be cut at a blank (see ``_ibans``).  Every span that stands
has a score: a base score of its kind, raised when a context word of the kind stands
within ``CONTEXT`` characters on either side, lowered when a contrary word does.  The
score orders and filters at the caller's wish (``min_score``); the base spans are all
returned by default.

Texts are scanned whole, in linear time: the email pattern is anchored at its
``@`` and widened to the left, and runs of digits are entered at their start only.

Defined cases: null text is empty; an empty text has no spans; rows that repeat
give the same spans each; a null doc_id stays null; an empty table gives no rows;
extra columns are ignored by ``find_pii`` and kept by ``redacted``.  Offsets are
code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytics.llm.common import pick, plain

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

#: Characters on either side in which a context word counts.
CONTEXT = 40
_START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
_FOR = {
    "email": "mail e-mail email contact write correo courriel kontakt",
    "ip": "ip host server address login client adresse servidor",
    "card": "card visa mastercard credit payment karte carte tarjeta pay",
    "phone": "phone call tel mobile fax whatsapp telefon telefono téléphone anruf",
    "iban": "iban bank account konto compte cuenta transfer",
}
_AGAINST = {
    "ip": "version release build section chapter",
    "card": "order tracking isbn serial invoice",
    "phone": "order isbn serial score",
}


def _words(listed: dict[str, str]) -> dict[str, re.Pattern]:
    return {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v.split())) + r")(?!\w)", re.I) for k, v in listed.items()}


_FOR_RE, _AGAINST_RE = _words(_FOR), _words(_AGAINST)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, rest 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # nothing before this place may be used again
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            free = m.end()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposed span may run on into a word or number behind the IBAN, or start at one
    before it: of its ends at a blank, the last that passes counts; if none does, the
    search goes on behind its first block."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = start + 4
        while end > start:
            if 15 <= len(whole := text[start:end].replace(" ", "")) <= 34 and mod97(whole):
                yield start, end
                at = end
                break
            end = text.rfind(" ", start, end)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def spans(text: str) -> list[tuple[str, int, int]]:
    """All confirmed (kind, start, end), by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    found += [("iban", a, b) for a, b in _ibans(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT):start] + "\n" + text[end:end + CONTEXT]
    s = _START[kind]
    if _FOR_RE[kind].search(near):
        s += 0.5 * (1 - s)
    if kind in _AGAINST_RE and _AGAINST_RE[kind].search(near):
        s *= 0.5
    return s


def _joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


_FOUND = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "found array<struct<kind:string,start:long,end:long,score:double>>")


def _find(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        text = text if isinstance(text, str) else ""
        all_ = spans(text)
        base = [s for s in all_ if s[0] in BASE]
        rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(),
                     _joined(all_), [{"kind": k, "start": a, "end": b, "score": score(text, k, a, b)} for k, a, b in all_]))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, base_sha256, spans, and found: the spans with their scores."""
    d = pick(docs, "doc_id", "text")
    find = F.pandas_udf(_find, _FOUND)
    return d.select("doc_id", find("text").alias("_f")).select("doc_id", "_f.*")


def redacted(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """``docs`` with every span of at least ``min_score`` replaced by its kind, as in
    ``[EMAIL]`` (overlapping spans by the first one's kind), and n_chars set anew."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if isinstance(text, str):
                parts, at = [], 0
                for kind, a, b in spans(text):
                    if b <= at or score(text, kind, a, b) < min_score:
                        continue
                    if a >= at:
                        parts += [text[at:a], f"[{kind.upper()}]"]
                    at = b
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    inner, (text,) = plain(docs, "text")
    out = inner.withColumn(text, clean(text))
    if "n_chars" in docs.columns:
        _, (n,) = plain(docs, "n_chars")
        out = out.withColumn(n, F.when(F.col(n).isNotNull(), F.length(text).cast(inner.schema[n].dataType)))
    return out.toDF(*docs.columns)
