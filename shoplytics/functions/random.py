"""Reproducible random draws as column expressions.

Draws are keyed by content, not by row position: a uniform is derived from
``md5(seed|key|tag|j)``, so a draw is the same on every run, after any
repartition, on task retry, and in an independent SQL engine.

Beta(a, b) with positive integer shapes is Ga / (Ga + Gb).  A Gamma(k, 1)
variate is drawn by Marsaglia and Tsang's rejection method (2000) with keyed
Box-Muller normals, for every shape alike, as a JVM expression: an attempt
is accepted with over 95 % at k = 1 and more above it, so the cost per item
is the same whatever its count.  Should all ``ATTEMPTS`` fail (less than once
in 1e30 draws), the query fails; no constant stands in for a draw.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ATTEMPTS = 24
_DEN = float(2 ** 48 + 1)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash48(*parts) -> Column:
    """48-bit integer from ``md5(p1|p2|...)`` (first 12 hex digits)."""
    s = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 12), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform in (0, 1) keyed by the parts."""
    return (hash48(*parts) + F.lit(1)) / F.lit(_DEN)


def gamma(seed, key, tag: str, shape) -> Column:
    """Gamma(shape, 1) for integer ``shape`` >= 1, keyed draw."""
    d = _c(shape).cast("double") - F.lit(1.0 / 3.0)
    c = F.lit(1.0) / F.sqrt(F.lit(9.0) * d)

    def step(acc, j):
        u1, u2, u = (uniform(seed, key, F.lit(tag), F.lit(n), j) for n in ("n1", "n2", "u"))
        x = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
        v = F.pow(F.lit(1.0) + c * x, F.lit(3.0))
        ok = (v > 0) & (F.ln(u) < F.lit(0.5) * x * x + d - d * v
                        + d * F.ln(F.when(v > 0, v).otherwise(F.lit(1.0))))
        return F.when(acc.isNotNull(), acc).when(ok, d * v)

    drawn = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("double"), step)
    return F.when(d.isNotNull(), F.coalesce(
        drawn, F.raise_error(F.lit("no gamma draw was accepted")).cast("double")))


def beta(seed, key, a, b) -> Column:
    """Beta(a, b) for positive integer shapes, keyed draw."""
    ga = gamma(seed, key, "a", a)
    gb = gamma(seed, key, "b", b)
    return ga / (ga + gb)


def beta_sql(seed: str, key: str, a: str, b: str) -> str:
    """The same draw in DuckDB SQL, for oracles."""
    def u(tag, n):
        return (f"((CAST(('0x' || substr(md5(CAST({seed} AS VARCHAR) || '|' || "
                f"CAST({key} AS VARCHAR) || '|{tag}|{n}|' || CAST(j AS VARCHAR)), 1, 12)) AS BIGINT) + 1)"
                f" / {_DEN!r})")

    def g(tag, shape):
        d = f"(CAST({shape} AS DOUBLE) - {1.0 / 3.0!r})"
        tries = (f"list_transform(range(1, {ATTEMPTS + 1}), lambda j: {{'x': sqrt(-2.0 * ln({u(tag, 'n1')}))"
                 f" * cos({2.0 * math.pi!r} * {u(tag, 'n2')}), 'u': {u(tag, 'u')}}})")
        cubes = f"list_transform({tries}, lambda t: {{'x': t.x, 'u': t.u, 'v': pow(1.0 + t.x / sqrt(9.0 * {d}), 3.0)}})"
        good = (f"list_filter({cubes}, lambda t: CASE WHEN t.v > 0 THEN ln(t.u) < 0.5 * t.x * t.x + {d}"
                f" - {d} * t.v + {d} * ln(t.v) ELSE false END)")
        return f"({d} * {good}[1].v)"
    return f"({g('a', a)} / ({g('a', a)} + {g('b', b)}))"


def hash48_sql(*parts: str) -> str:
    inner = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({inner}), 1, 12)) AS BIGINT)"


# --- the same draws in plain Python (sequential top-pick refresh chain) -------

def _uniform_py(*parts) -> float:
    return (hash48_py(*parts) + 1) / _DEN


def gamma_py(seed, key, tag: str, shape: int) -> float:
    """The keyed Gamma draw of :func:`gamma` in plain Python."""
    d = int(shape) - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    for j in range(1, ATTEMPTS + 1):
        u1, u2, u = (_uniform_py(seed, key, tag, n, j) for n in ("n1", "n2", "u"))
        x = math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)
        v = (1.0 + c * x) ** 3
        if v > 0 and math.log(u) < 0.5 * x * x + d - d * v + d * math.log(v):
            return d * v
    raise RuntimeError("no gamma draw was accepted")


def beta_py(seed, key, a: int, b: int) -> float:
    ga, gb = gamma_py(seed, key, "a", a), gamma_py(seed, key, "b", b)
    return ga / (ga + gb)


def hash48_py(*parts) -> int:
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:12], 16)


# --- keyed permutations ---------------------------------------------------------

ROUNDS, WALKS = 4, 200


def permuted(place, n, *key) -> Column:
    """Where the keyed permutation of 0 .. n - 1 sends ``place``: a Feistel network on the
    next power of four, walked along its cycle until it is back below ``n`` (a walk leaves the
    rest of the domain with over one in four a step; should ``WALKS`` not do, once in 1e25,
    the query fails).  Different places get different values, without a table of size n."""
    n = _c(n)
    half = F.expr("1L") * F.pow(F.lit(2), F.ceil(F.length(F.bin(F.greatest(n - 1, F.lit(0)))) / 2)).cast("bigint")

    def network(x: Column) -> Column:
        def turn(v, r):
            left, right = F.floor(v / half).cast("bigint"), v % half
            return right * half + left.bitwiseXOR(hash48(*key, r, right) % half)
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("bigint"), turn)

    start = F.aggregate(F.array(_c(place).cast("bigint")), F.lit(0).cast("bigint"), lambda _, x: network(x))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda v, _: F.when(v < n, v).otherwise(network(v)))
    checked = F.aggregate(F.array(walked), F.lit(0).cast("bigint"), lambda _, v: F.when(v < n, v).otherwise(
        F.raise_error(F.lit("a walk of the permutation did not end")).cast("bigint")))
    return F.when(n > 0, checked)


def permuted_sql(place: str, n: str, *key: str) -> str:
    """The same place in DuckDB SQL, for oracles."""
    half = f"(1::BIGINT << CAST(ceil(length(bin(greatest({n} - 1, 0))) / 2) AS INTEGER))"

    def network(x: str) -> str:
        return (f"list_reduce(list_concat([{x}], range(1, {ROUNDS + 1})), lambda v, r: (v % {half}) * {half} + "
                f"xor(v // {half}, {hash48_sql(*key, 'r', f'(v % {half})')} % {half}))")
    return (f"list_reduce(list_concat([{network(f'CAST({place} AS BIGINT)')}], range(1, {WALKS + 1})), "
            f"lambda u, w: CASE WHEN u < {n} THEN u ELSE {network('u')} END)")


def permuted_py(place: int, n: int, *key) -> int:
    """The same place in plain Python."""
    half = 1 << -(-len(f"{max(n - 1, 0):b}") // 2)

    def network(x):
        for r in range(1, ROUNDS + 1):
            left, right = divmod(x, half)
            x = right * half + (left ^ hash48_py(*key, r, right) % half)
        return x

    x = network(place)
    while x >= n:
        x = network(x)
    return x
