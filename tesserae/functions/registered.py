"""Functions for use on columns and in SQL: Arrow-batched versions of the kernels that SQL lacks, on whole arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tesserae.functions import kernels


def _series(values: np.ndarray, like: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series(values, index=like.index).where(known)


@F.pandas_udf(DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return _series(kernels.erf(x.to_numpy(float)), x, x.notna())


@F.pandas_udf(DoubleType())
def digamma(x: pd.Series) -> pd.Series:
    return _series(kernels.digamma(x.fillna(1).to_numpy(float)), x, x.notna())


@F.pandas_udf(DoubleType())
def bessel_ratio(x: pd.Series) -> pd.Series:
    return _series(kernels.bessel_ratio(x.fillna(0).to_numpy(float)), x, x.notna())


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _series(kernels.t_two_sided(t.to_numpy(float), dof.to_numpy(float)), t, t.notna() & dof.notna())


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return _series(kernels.pearson_p(r.to_numpy(float), n.to_numpy(float)), r, r.notna() & n.notna())


def register(spark: SparkSession) -> None:
    """erf(x), digamma(x), bessel_ratio(x), pearson_p(r, n) and t_two_sided(t, dof) in SQL; null in, null out."""
    for name, f in (("erf", erf), ("digamma", digamma), ("bessel_ratio", bessel_ratio), ("pearson_p", pearson_p), ("t_two_sided", t_two_sided)):
        spark.udf.register(name, f)
