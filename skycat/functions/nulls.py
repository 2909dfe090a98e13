"""Missing values: NaN becomes NULL at the sources, once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float and double column with NaN replaced by NULL."""
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None)) for n, t in df.dtypes if t in ("float", "double")})


def finite_rows(df: DataFrame) -> DataFrame:
    """Rows without an infinity in any numeric column; NULL stays."""
    for name, kind in df.dtypes:
        if kind in ("float", "double"):
            df = df.where(F.coalesce(F.abs(F.col(name)) != float("inf"), F.lit(True)))
    return df


def is_new_id(value):
    """NULL, blank, 'none' and 'nan' in any case count as no id."""
    return F.coalesce(F.lower(F.trim(value)), F.lit("")).isin("", "none", "nan")
