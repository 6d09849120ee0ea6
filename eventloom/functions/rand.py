"""Random numbers from a hash of a seed and keys: the same on every engine, machine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(seed: int | str, *parts: Column | str) -> Column:
    """A number in [0, 1) for each combination of parts."""
    key = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def race(u: Column, weight: Column) -> Column:
    """An exponential race: the k smallest values are a weighted sample without replacement."""
    return -F.log(F.greatest(u, F.lit(1e-12))) / weight


def u01_sql(seed: int | str, *parts: str) -> str:
    """u01 as DuckDB SQL."""
    key = ", ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {key})), 1, 8) AS BIGINT) / 4294967296.0)"


def race_sql(u: str, weight: str) -> str:
    return f"(-ln(greatest({u}, 1e-12)) / ({weight}))"
