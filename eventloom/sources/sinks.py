"""Writers: tables that are skipped if they are there, JSON lines, CSV with decimal commas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def load_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at a path; made and written first if it is not there or is to be made anew."""
    if not overwrite:
        try:
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER" not in str(missing):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing folder stays unless it is to be overwritten. Nulls are kept."""
    rows.write.mode("overwrite" if overwrite else "ignore").option("ignoreNullFields", "false").json(path)


def decimal_comma(rows: DataFrame, digits: int = 3) -> DataFrame:
    """Doubles as text with a decimal comma."""
    return rows.select(*[F.when(F.col(c).isNotNull(), F.replace(F.format_string(f"%.{digits}f", F.bround(c, digits)), F.lit("."), F.lit(","))).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])


def write_csv(rows: DataFrame, path: str, digits: int = 3) -> None:
    decimal_comma(rows, digits).write.mode("overwrite").option("header", "true").option("sep", ";").csv(path)
