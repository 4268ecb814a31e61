"""Score grids and distributions as native array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.prices import let, total


def _folded(head: Column) -> Column:
    """The probabilities with what they lack to one as a last entry."""
    return let({"p": head}, lambda v: F.concat(v.p, F.array(F.greatest(F.lit(0.0), 1 - total(v.p)))))


def poisson_pmf(rate: Column, most: int) -> Column:
    """P(0..most), the tail folded into the last entry."""
    first = F.exp(-rate)
    return _folded(F.array(*[first * F.pow(rate, F.lit(float(k))) / float(math.factorial(k)) for k in range(most)]))


def negative_binomial_pmf(mean: Column, shape: Column, most: int) -> Column:
    """As `poisson_pmf`, with variance mean + mean^2 / shape; by the ratio of successive terms."""
    q, term, terms = mean / (mean + shape), F.pow(shape / (mean + shape), shape), []
    for k in range(most):
        terms.append(term)
        term = term * q * (shape + k) / (k + 1)
    return _folded(F.array(*terms))


def score_grid(left: Column, right: Column, rho: Column | None = None, rates: tuple[Column, Column] | None = None) -> Column:
    """array<struct<h, a, p>> of two pmfs; with rho and rates the four lowest scores are corrected for dependence; scaled to sum to one."""

    def tau(h: Column, a: Column) -> Column:
        if rho is None or rates is None:
            return F.lit(1.0)
        x, y = rates
        return (
            F.when((h == 0) & (a == 0), 1 - x * y * rho).when((h == 0) & (a == 1), 1 + x * rho).when((h == 1) & (a == 0), 1 + y * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(1.0)
        )

    cross = lambda v: F.flatten(F.transform(v.l, lambda p, h: F.transform(v.r, lambda q, a: F.struct(h.alias("h"), a.alias("a"), (p * q * tau(h, a)).alias("p")))))
    cells = let({"l": left, "r": right}, cross)
    mass = lambda g: total(F.transform(g, lambda c: c.p))
    return let({"g": cells}, lambda v: let({"g": v.g, "m": mass(v.g)}, lambda w: F.transform(w.g, lambda c: F.struct(c.h.alias("h"), c.a.alias("a"), (c.p / w.m).alias("p")))))


def region(grid: Column, condition) -> Column:
    """Probability of the cells for which condition(h, a) holds."""
    return total(F.transform(F.filter(grid, lambda c: condition(c.h, c.a)), lambda c: c.p))


def markets(grid: Column, lines: tuple[float, ...] = (1.5, 2.5, 3.5)) -> Column:
    """A struct of the probabilities and means that a grid gives, all added up in one pass over its cells."""
    rules = {
        "p_left": lambda h, a: h > a, "p_draw": lambda h, a: h == a, "p_right": lambda h, a: h < a, "both_score": lambda h, a: (h > 0) & (a > 0),
        "left_clean": lambda h, a: a == 0, "handicap_left": lambda h, a: h - a > 1,
    }
    for line in lines:
        rules[f"over_{str(line).replace('.', '_')}"] = lambda h, a, line=line: h + a > line
    names = [*rules, "mean_left", "mean_right"]

    def add(s: Column, c: Column) -> Column:
        sums = [s[n] + F.when(f(c.h, c.a), c.p).otherwise(0.0) for n, f in rules.items()] + [s["mean_left"] + c.h * c.p, s["mean_right"] + c.a * c.p]
        return F.struct(*[x.alias(n) for n, x in zip(names, sums)])

    return F.aggregate(grid, F.struct(*[F.lit(0.0).alias(n) for n in names]), add)


def side_markets(grid: Column, most_total: int = 7, lines: int = 3) -> Column:
    """A struct of double chance, draw no bet (null if a draw is certain), totals of either side over 0.5, 1.5, ... and the distribution of the total with `most_total` and more as its end; one pass over the cells."""
    rules = {
        "left_or_draw": lambda h, a: h >= a, "no_draw": lambda h, a: h != a, "right_or_draw": lambda h, a: h <= a, "right_clean": lambda h, a: h == 0, "__left": lambda h, a: h > a,
        **{f"left_over_{k}_5": lambda h, a, k=k: h > k for k in range(lines)}, **{f"right_over_{k}_5": lambda h, a, k=k: a > k for k in range(lines)},
        **{f"total_{k}": lambda h, a, k=k: h + a == k for k in range(most_total)}, f"total_{most_total}_up": lambda h, a: h + a >= most_total,
    }
    add = lambda s, c: F.struct(*[(s[n] + F.when(f(c.h, c.a), c.p).otherwise(0.0)).alias(n) for n, f in rules.items()])
    wins = lambda m: F.try_divide(m["__left"], m["no_draw"])
    told = lambda m: F.struct(*[m[n].alias(n) for n in rules if n != "__left"], wins(m).alias("left_if_no_draw"), (1 - wins(m)).alias("right_if_no_draw"))
    return F.aggregate(grid, F.struct(*[F.lit(0.0).alias(n) for n in rules]), add, told)


def rescale(grid: Column, target: Column) -> Column:
    """The grid with its three regions (left, draw, right) scaled to the target vector."""
    regions = {"l": lambda h, a: h > a, "d": lambda h, a: h == a, "r": lambda h, a: h < a}
    factors = {n: F.get(target, i) / region(grid, f) for i, (n, f) in enumerate(regions.items())}
    scale = lambda v, c: F.when(c.h > c.a, v.l).when(c.h == c.a, v.d).otherwise(v.r)
    return let({"g": grid, **factors}, lambda v: F.transform(v.g, lambda c: F.struct(c.h.alias("h"), c.a.alias("a"), (c.p * scale(v, c)).alias("p"))))


def convolve(a: Column, b: Column) -> Column:
    """The pmf of a sum of two counts."""
    n = F.size(a) + F.size(b) - 1
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: total(F.transform(F.filter(F.sequence(F.lit(0), k), lambda i: (i < F.size(a)) & (k - i < F.size(b))), lambda i: F.get(a, i) * F.get(b, k - i))))


def top_cells(grid: Column, n: int) -> Column:
    """The n likeliest cells; ties: fewer on the left, then on the right."""
    order = F.array_sort(F.transform(grid, lambda c: F.struct((-F.round(c.p, 12)).alias("k"), c.h.alias("h"), c.a.alias("a"), c.p.alias("p"))))
    return F.transform(F.slice(order, 1, n), lambda c: F.concat_ws("-", c.h.cast("string"), c.a.cast("string")))


def poisson_terms(rate: Column, most: int) -> Column:
    """P(0..most) without the tail."""
    return F.array(*[F.exp(-rate) * F.pow(rate, F.lit(float(k))) / float(math.factorial(k)) for k in range(most + 1)])


def negative_binomial_terms(mean: Column, shape: Column, most: int) -> Column:
    """P(0..most) without the tail; variance mean + mean^2 / shape."""
    q, term, terms = mean / (mean + shape), F.pow(shape / (mean + shape), shape), []
    for k in range(most + 1):
        terms.append(term)
        term = term * q * (shape + k) / (k + 1)
    return F.array(*terms)


def bivariate_cells(left: Column, right: Column, share: Column, most: int) -> Column:
    """P(h, a) for 0..most as rows of arrays: both counts hold a common Poisson part of rate share x min(left, right), and one of their own."""
    common = share * F.least(left, right)
    own = lambda rate: poisson_terms(F.greatest(rate - common, F.lit(1e-6)), most)
    parts = {"c": poisson_terms(common, most), "l": own(left), "r": own(right)}
    cell = lambda v, h, a: F.aggregate(F.sequence(F.lit(0), F.least(h, a)), F.lit(0.0), lambda s, c: s + F.get(v.c, c) * F.get(v.l, h - c) * F.get(v.r, a - c))
    steps = F.sequence(F.lit(0), F.lit(most))
    return let(parts, lambda v: F.transform(steps, lambda h: F.transform(steps, lambda a: cell(v, h, a))))


def product_cells(left: Column, right: Column) -> Column:
    """P(h, a) of independent counts as rows of arrays."""
    return let({"l": left, "r": right}, lambda v: F.transform(v.l, lambda p: F.transform(v.r, lambda q: p * q)))


def family_cells(family: str, left: Column, right: Column, shape: Column, most: int = 10) -> Column:
    """struct<cells, captured, tail>: the cells of a family (poisson, negative_binomial, bivariate) scaled to sum to one, and the mass that they held and lacked before."""
    if family == "poisson":
        cells = product_cells(poisson_terms(left, most), poisson_terms(right, most))
    elif family == "negative_binomial":
        cells = product_cells(negative_binomial_terms(left, shape, most), negative_binomial_terms(right, shape, most))
    elif family == "bivariate":
        cells = bivariate_cells(left, right, shape, most)
    else:
        raise ValueError(f"unknown family {family}")
    mass = lambda g: total(F.transform(g, lambda row: total(row)))
    scaled = lambda w: F.transform(w.g, lambda row: F.transform(row, lambda p: p / w.m))
    return let({"g": cells}, lambda v: let({"g": v.g, "m": mass(v.g)}, lambda w: F.struct(scaled(w).alias("cells"), w.m.alias("captured"), (1 - w.m).alias("tail"))))
