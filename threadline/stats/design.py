"""Designs with categories and their interactions, fitted from sums by pairs of levels.

A row has one entry for each term, however many levels there are: the number of
the column that its levels choose, and a value. X'X is the sum over rows of the
products of their entries, grouped by the two column numbers and added up
map-side: its cost is that of the terms squared, not of the levels squared. The
scores of a cluster are sums grouped by column in the same way.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.stats.ols import Fit, complete

_SPLIT = "\x1f"


@dataclass
class Design:
    """Column names, and for each term the expressions of the entry's column number and value."""

    names: list[str]
    entries: list[tuple[Column, Column]]
    terms: dict[str, list[str]]
    needed: list[str]
    references: dict[str, str]

    def joint(self, term: str) -> list[dict[str, float]]:
        """A term's coefficients all 0: rows for ``Fit.wald``."""
        return [{name: 1.0} for name in self.terms[term]]


def levels_of(df: DataFrame, column: str, most: int) -> list[str]:
    """A category's levels as text, in the order of their values."""
    found = [r[1] for r in df.select(F.col(column), F.col(column).cast("string")).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has over {most} levels; absorb it instead")
    return found


def design(df: DataFrame, terms: list[str], references: dict[str, str] | None = None, most: int = 500) -> Design:
    """The design of an intercept and terms: ``x`` (a number), ``C(a)`` (a category), ``C(a):C(b)`` or ``C(a):x`` (interactions).

    Categories leave out a reference level, by default the least one, in interactions too; so each part of an
    interaction must be a term of its own. Levels are those of complete cases.
    """
    references = references or {}
    columns = sorted({p.removeprefix("C(").removesuffix(")") for t in terms for p in t.split(":")})
    whole = complete(df, *columns)
    levels: dict[str, list[str]] = {}
    bases: dict[str, str] = {}
    names, entries, found = ["const"], [(F.lit(0), F.lit(1.0))], {"const": ["const"]}
    for term in terms:
        parts = term.split(":")
        if len(parts) > 1 and not all(p in terms for p in parts):
            raise ValueError(f"{term} needs each of its parts as a term")
        choices, value = [], F.lit(1.0)
        for part in parts:
            if not part.startswith("C("):
                value = value * F.col(part).cast("double")
                continue
            name = part[2:-1]
            if name not in levels:
                all_ = levels_of(whole, name, most)
                base = references.get(name, all_[0] if all_ else None)
                if base not in all_ and all_:
                    raise ValueError(f"{name} has no level {base}")
                levels[name], bases[name] = [v for v in all_ if v != base], base
            choices.append([(name, v) for v in levels[name]])
        combined = list(product(*choices))
        own = [":".join([*(f"{n}={v}" for n, v in combo), *(p for p in parts if not p.startswith("C("))]) for combo in combined]
        number = F.lit(0)
        if choices:
            names_of = [p[2:-1] for p in parts if p.startswith("C(")]
            table = {_SPLIT.join(v for _, v in combo): i for i, combo in enumerate(combined)}
            chosen = F.concat_ws(_SPLIT, *(F.col(c).cast("string") for c in names_of))
            number = F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,int>"), chosen)
        entries.append((number + len(names), value))
        names += own
        found[term] = own
    return Design(names, entries, found, columns, bases)


def fit(df: DataFrame, y: str, d: Design, cluster: str, weight: str | None = None) -> Fit:
    """Least squares of a design over complete cases, errors by cluster; where columns make up others, ``rank`` is less than their number and the pseudo-inverse shares the effect."""
    k = len(d.names)
    e = F.filter(F.array(*(F.struct(n.cast("int").alias("i"), v.alias("v")) for n, v in d.entries)), lambda x: x["i"].isNotNull() & (x["v"] != 0))
    rows = complete(df, y, cluster, *d.needed, *([weight] if weight else [])).select(F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.col(cluster).alias("g"), e.alias("e"))
    n = rows.count()
    pairs = rows.select("w", "y", "e", F.inline("e")).select(F.col("i"), (F.col("v") * F.col("w")).alias("vw"), "y", F.explode("e").alias("o"))
    gram = pairs.filter(F.col("o.i") <= F.col("i")).groupBy("i", F.col("o.i").alias("j")).agg(F.sum(F.col("vw") * F.col("o.v")).alias("s")).collect()
    right = rows.select((F.col("y") * F.col("w")).alias("yw"), F.inline("e")).groupBy("i").agg(F.sum(F.col("yw") * F.col("v")).alias("s")).collect()
    a, b = np.zeros((k, k)), np.zeros(k)
    for r in gram:
        a[r.i, r.j] = a[r.j, r.i] = r.s
    for r in right:
        b[r.i] = r.s
    inverse = np.linalg.pinv(a, hermitian=True)
    beta = inverse @ b
    at = F.array(*(F.lit(float(x)) for x in beta))
    residual = F.col("y") - F.aggregate("e", F.lit(0.0), lambda t, x: t + at[x["i"]] * x["v"])
    scores = rows.select("g", (F.col("w") * residual).alias("r"), F.inline("e")).groupBy("g", "i").agg(F.sum(F.col("r") * F.col("v")).alias("s"))
    by = scores.groupBy("g").agg(F.collect_list(F.struct("i", "s")).alias("e"))
    outer = by.select("e", F.inline("e")).select("i", "s", F.explode("e").alias("o")).groupBy("i", F.col("o.i").alias("j")).agg(F.sum(F.col("s") * F.col("o.s")).alias("m")).collect()
    meat = np.zeros((k, k))
    for r in outer:
        meat[r.i, r.j] = r.m
    g = rows.select("g").distinct().count()
    scale = g / max(g - 1, 1) * (n - 1) / max(n - k, 1)
    return Fit(d.names, beta, scale * inverse @ meat @ inverse, n, g, int(np.linalg.matrix_rank(a, hermitian=True)))


def against(d: Design, category: str, levels: list[str], pairs: list[tuple[str, str]] = ()) -> list[tuple[str, dict[str, float]]]:
    """Named contrasts of a category's levels with its reference, and of pairs of levels with each other; levels that no row has are left out."""
    base = d.references[category]
    have = [v for v in levels if f"{category}={v}" in d.names]
    found = [(f"{v} vs {base}", {f"{category}={v}": 1.0}) for v in have]
    return found + [(f"{a} vs {b}", {f"{category}={a}": 1.0, f"{category}={b}": -1.0}) for a, b in pairs if a in have and b in have]
