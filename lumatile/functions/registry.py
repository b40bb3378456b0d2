"""Functions by name, as users write them: 'max', 'np.max', 'linalg.norm', ... Names are looked up, never imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Aggregates of a value column. Standard deviation and variance are those of the population.
REDUCERS: dict[str, Callable[..., Column]] = {
    "max": lambda v: F.max(v), "min": lambda v: F.min(v), "mean": lambda v: F.avg(v), "sum": lambda v: F.sum(v),
    "std": lambda v: F.stddev_pop(v), "var": lambda v: F.var_pop(v), "median": lambda v: F.percentile(v, 0.5),
    "prod": lambda v: F.product(v), "norm": lambda v: F.sqrt(F.sum(v * v)), "any": lambda v: F.max((v != 0).cast("double")),
    "all": lambda v: F.min((v != 0).cast("double")), "ptp": lambda v: F.max(v) - F.min(v), "count_nonzero": lambda v: F.sum((v != 0).cast("double")),
    "percentile": lambda v, q: F.percentile(v, q / 100), "quantile": lambda v, q: F.percentile(v, q),
}
ALIASES = {"amax": "max", "amin": "min", "average": "mean", "nanmax": "max", "nanmin": "min", "nanmean": "mean", "nansum": "sum", "linalg.norm": "norm"}

#: Functions of each value, with further arguments.
MAPS: dict[str, Callable[..., Column]] = {
    "add": lambda v, x: v + x, "subtract": lambda v, x: v - x, "multiply": lambda v, x: v * x, "divide": lambda v, x: F.try_divide(v, F.lit(float(x))), "true_divide": lambda v, x: F.try_divide(v, F.lit(float(x))),
    "power": lambda v, x: F.pow(v, F.lit(float(x))), "maximum": lambda v, x: F.greatest(v, F.lit(float(x))), "minimum": lambda v, x: F.least(v, F.lit(float(x))),
    "clip": lambda v, a, b: F.greatest(F.lit(float(a)), F.least(v, F.lit(float(b)))), "sqrt": lambda v: F.sqrt(v), "square": lambda v: v * v, "exp": lambda v: F.exp(v), "log1p": lambda v: F.log1p(v),
    "abs": lambda v: F.abs(v), "absolute": lambda v: F.abs(v), "negative": lambda v: -v, "invert": lambda v: 1 - v, "floor": lambda v: F.floor(v).cast("double"), "ceil": lambda v: F.ceil(v).cast("double"), "greater": lambda v, x: (v > x).cast("double"), "greater_equal": lambda v, x: (v >= x).cast("double"),
}


def _look_up(known: dict, name: str, what: str):
    short = name.removeprefix("np.").removeprefix("numpy.").removeprefix("scipy.")
    short = ALIASES.get(short, short)
    if short not in known:
        raise ValueError(f"{what} {name!r} is not known; known are {sorted(known)}")
    return known[short]


def reducer(name: str, *args) -> Callable[[Column], Column]:
    f = _look_up(REDUCERS, name, "reducer")
    return lambda v: f(v, *args)


def mapper(name: str, *args) -> Callable[[Column], Column]:
    f = _look_up(MAPS, name, "function")
    return lambda v: f(v, *args)
