"""Seeded resampling of daily series, one numpy pass per cell.

Spark collapses the data to one number per cell and day first; what reaches Python is a short series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _draw(b: np.ndarray, k: np.ndarray, seed: int) -> np.ndarray:
    """A number below 2**31 for draw b and block k, by integer arithmetic that SQL can repeat; see ``draw_sql``."""
    m = np.int64(1 << 31)
    x = (b * 1000003 + k * 7919 + seed) % m
    for factor, plus, shift in _ROUNDS:
        x = (x * factor + plus) % m
        x = x ^ (x >> shift)
    return x


#: factors, addends and shifts of the draws
_ROUNDS = ((1103515245, 12345, 15), (747796405, 1013904223, 13), (1103515245, 12345, 16))


def draw_sql(b: str, k: str, seed: int) -> str:
    """The same in SQL."""
    x = f"(({b} * 1000003 + {k} * 7919 + {seed}) % 2147483648)"
    for factor, plus, shift in _ROUNDS:
        x = f"list_transform([({x} * {factor} + {plus}) % 2147483648], lambda x{shift}: xor(x{shift}, x{shift} >> {shift}))[1]"
    return x


def _blocks(n: int, length: int, draws: int, seed: int) -> np.ndarray:
    """Positions of circular blocks: draws x n."""
    starts = _draw(np.arange(draws, dtype=np.int64)[:, None], np.arange(-(-n // length), dtype=np.int64)[None, :], seed) % n
    return ((starts[:, :, None] + np.arange(length)) % n).reshape(draws, -1)[:, :n]


def bootstrap(series: DataFrame, cell: str, day: str, value: str, length: int = 1, draws: int = 1000, seed: int = 11, alpha: float = 0.05) -> DataFrame:
    """cell, days, mean, se, lower, upper, p: block bootstrap of a mean (blocks of ``length`` days; 1: days drawn one by one).

    ``p``: share of draws whose mean isn't above zero.  Nulls are left out; a cell without values has no row.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.dropna(subset=["v"]).sort_values("d")["v"].to_numpy()
        if not len(x):
            return pd.DataFrame({"cell": [], "days": [], "mean": [], "se": [], "lower": [], "upper": [], "p": []})
        m = x[_blocks(len(x), min(length, len(x)), draws, seed)].mean(axis=1)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "days": [len(x)], "mean": [x.mean()], "se": [m.std()], "lower": [np.quantile(m, alpha)], "upper": [np.quantile(m, 1 - alpha)], "p": [float((m <= 0).mean())]})

    s = series.selectExpr(f"cast({cell} as string) as cell", f"cast({day} as string) as d", f"cast({value} as double) as v")
    return s.groupBy("cell").applyInPandas(one, "cell string, days bigint, mean double, se double, lower double, upper double, p double")


def paired_sharpe(series: DataFrame, cell: str, day: str, a: str, b: str, length: int = 5, draws: int = 1000, seed: int = 11) -> DataFrame:
    """cell, days, difference, lower, upper: difference of annual Sharpe ratios with the same blocks drawn for both."""

    def sharpe(x: np.ndarray) -> np.ndarray:
        s = x.std(axis=-1, ddof=1)
        return np.where(s > 0, x.mean(axis=-1) / np.where(s > 0, s, 1) * np.sqrt(252), 0.0)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=["a", "b"]).sort_values("d")
        if len(p) < 2:
            return pd.DataFrame({"cell": [], "days": [], "difference": [], "lower": [], "upper": []})
        x, y = p["a"].to_numpy(), p["b"].to_numpy()
        at = _blocks(len(p), min(length, len(p)), draws, seed)
        diff = sharpe(x[at]) - sharpe(y[at])
        return pd.DataFrame({"cell": [p["cell"].iloc[0]], "days": [len(p)], "difference": [float(sharpe(x) - sharpe(y))], "lower": [np.quantile(diff, 0.05)], "upper": [np.quantile(diff, 0.95)]})

    s = series.selectExpr(f"cast({cell} as string) as cell", f"cast({day} as string) as d", f"cast({a} as double) as a", f"cast({b} as double) as b")
    return s.groupBy("cell").applyInPandas(one, "cell string, days bigint, difference double, lower double, upper double")


def normal_tail(x: Column) -> Column:
    """P(Z > x) of a standard normal variable, exact to the last digits."""

    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda z: None if z is None or math.isnan(z) else 0.5 * math.erfc(z / math.sqrt(2)))

    return tail(x)
