"""Array and number functions: framing, penalties, log sums, decibels, amplitude distortions, companding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rand import uniform

NEG_INF = float("-inf")


def insert_blanks(labels: Column, blank: int = 0) -> Column:
    """Blanks around and between labels: 2 L + 1 items."""
    b = F.lit(blank).cast("int")
    return F.concat(F.flatten(F.transform(labels, lambda t: F.array(b, t))), F.array(b))


def add_sos(y: Column, sos: int) -> Column:
    return F.concat(F.array(F.lit(sos).cast("int")), y)


def add_eos(y: Column, eos: int) -> Column:
    return F.concat(y, F.array(F.lit(eos).cast("int")))


def framed(y: Column, sos: int, eos: int) -> tuple[Column, Column, Column, Column]:
    """Decoder input and target, left to right and right to left."""
    return add_sos(y, sos), add_eos(y, eos), add_sos(F.reverse(y), sos), add_eos(F.reverse(y), eos)


def log_sum(xs: Column) -> Column:
    """log of the sum of exp, minus infinity for none."""
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(top.isNull() | (top == NEG_INF), F.lit(NEG_INF)).otherwise(top + F.log(total))


def blank_penalty(logits: Column, penalty: float, blank: int = 0) -> Column:
    """Log-softmax of logits after the blank's is lowered."""
    lowered = F.transform(logits, lambda x, i: F.when(i == blank, x - penalty).otherwise(x).cast("double"))
    return F.get(F.transform(F.array(lowered), lambda v: F.transform(v, lambda x: x - log_sum(v))), F.lit(0))


def length_penalty(n: Column, kind: str = "none", alpha: float = 0.0) -> Column:
    return {"wu": F.pow((F.lit(5.0) + n) / 6.0, F.lit(alpha)), "avg": F.pow(n.cast("double"), F.lit(alpha)), "none": F.lit(1.0)}[kind]


def coverage_penalty(coverage: Column, kind: str = "none", beta: float = 0.0) -> Column:
    if kind == "wu":
        return -beta * F.aggregate(coverage, F.lit(0.0), lambda a, c: a + F.log(F.least(c.cast("double"), F.lit(1.0))))
    if kind == "summary":
        return beta * (F.aggregate(coverage, F.lit(0.0), lambda a, c: a + F.greatest(c.cast("double"), F.lit(1.0))) - F.size(coverage))
    return F.lit(0.0)


def db_to_amp(db: Column | float) -> Column:
    return F.pow(F.lit(10.0), (F.lit(db) if isinstance(db, int | float) else db) / 20.0)


def amp_to_db(amp: Column) -> Column:
    return 20.0 * F.log10(amp)


Distortion = Callable[[Column], Column]
# The slots, in decibels, that the fence and jag distortions let through by default.
POSITIVE_SLOTS = ((-110, -95), (-90, -80), (-65, -60), (-50, -30), (-15, 0))
NEGATIVE_SLOTS = ((-50, 0),)


def gain(db: float) -> Distortion:
    return lambda x: F.least(F.lit(0.997), x * 10 ** (db / 20))


def maximal(max_db: float | None = None) -> Distortion:
    top = 10 ** (max_db / 20) if max_db else 0.997
    return lambda x: F.signum(x) * top


def _in_slots(x: Column) -> Column:
    def inside(v: Column, slots: tuple) -> Column:
        out = F.lit(False)
        for low, high in slots:
            out = out | v.between(10 ** (low / 20), 10 ** (high / 20))
        return out

    return F.when(x > 0, inside(x, POSITIVE_SLOTS)).otherwise(inside(-x, NEGATIVE_SLOTS))


def fence(max_db: float = 0.0) -> Distortion:
    """The maximum inside the slots, also for negative values; 0 outside."""
    return lambda x: F.when(x == 0, x).when(_in_slots(x), F.lit(10 ** (max_db / 20))).otherwise(F.lit(0.0))


def jag() -> Distortion:
    return lambda x: F.when((x == 0) | _in_slots(x), x).otherwise(F.lit(0.0))


def poly(a: float = 1, m: float = 1, n: float = 1) -> Distortion:
    def f(x: Column) -> Column:
        d = F.greatest(amp_to_db(F.abs(x)) / 100 + 1, F.lit(0.0))
        bent = F.least(a * F.pow(d, F.lit(float(m))) * F.pow(1 - d, F.lit(float(n))) + d, F.lit(1.0))
        amp = F.least(db_to_amp((bent - 1) * 100), F.lit(0.9997))
        return F.when(F.abs(x) < 0.000001, x).otherwise(F.signum(x) * amp)

    return f


def chain(*steps: Distortion) -> Distortion:
    def f(x: Column) -> Column:
        for step in steps:
            x = step(x)
        return x

    return f


def distort(samples: Column, how: Distortion, key: Column, rate: float = 0.8, seed: int = 0) -> Column:
    """Each sample distorted with probability rate, by its key and place."""
    if rate >= 1:
        return F.transform(samples, lambda x: how(x.cast("double")))
    return F.transform(samples, lambda x, i: F.when(uniform(key, i, op="distort", seed=seed) < rate, how(x.cast("double"))).otherwise(x.cast("double")))


def mu_law(x: Column, levels: int = 256) -> Column:
    """A sample from -1 to 1 companded to so many levels and expanded again."""
    mu = float(levels - 1)
    squeezed = F.signum(x) * F.log1p(mu * F.abs(x)) / F.log1p(F.lit(mu))
    level = F.floor((squeezed + 1) / 2 * mu + 0.5).cast("double")
    back = level / mu * 2 - 1
    return F.signum(back) * (F.exp(F.abs(back) * F.log1p(F.lit(mu))) - 1) / mu


def half_even(x: Column, digits: int = 2) -> Column:
    """A number as text with so many decimals, ties to even as most file formats' writers do."""
    return F.format_string(f"%.{digits}f", F.bround(x.cast("decimal(38,12)"), digits).cast("double"))
