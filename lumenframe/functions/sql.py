"""Column expressions, and the functions that SQL text can call after `register`."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from lumenframe.functions import arrays, deconvolution, solvers


def decay_to_g(decay_ms: Column, rate_hz: float) -> Column:
    return F.exp(-1000.0 / (rate_hz * decay_ms))


def g_to_decay(g: Column, rate_hz: float) -> Column:
    return -1000.0 / (rate_hz * F.log(F.least(F.greatest(g, F.lit(1e-6)), F.lit(0.999999))))


def lognormal_pdf(x: Column, mu: float, sigma: float) -> Column:
    return F.exp(-0.5 * ((F.log(x) - mu) / sigma) ** 2) / (x * sigma * math.sqrt(2 * math.pi))


@F.pandas_udf(T.StructType([T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("bl", T.DoubleType())]))
def deconvolve(trace: pd.Series, g: pd.Series, sn: pd.Series) -> pd.DataFrame:
    """Struct (c, s, bl) of a trace array; traces of one length are solved together. A null trace has no course."""
    lengths = trace.map(lambda t: -1 if t is None else len(t)).to_numpy() if len(trace) else np.zeros(0, int)
    parts: list = [(None, None, None)] * len(trace)
    for n in np.unique(lengths[lengths >= 0]):
        on = np.flatnonzero(lengths == n)
        out = deconvolution.deconvolve_all(np.stack(trace.iloc[on].to_list()).astype(float), g.iloc[on].to_numpy(float)[:, None], sn.iloc[on].to_numpy(float))
        for i, row in enumerate(on):
            parts[row] = (out["c"][i], out["s"][i], float(out["bl"][i]))
    return pd.DataFrame(parts, columns=["c", "s", "bl"])


@F.pandas_udf(T.DoubleType())
def noise_level(trace: pd.Series) -> pd.Series:
    """Noise deviation of a trace array, from the upper half of its spectrum."""
    out = np.zeros(len(trace))
    lengths = trace.map(len).to_numpy() if len(trace) else np.zeros(0, int)
    for n in np.unique(lengths):  # traces of one length in one transform
        on = lengths == n
        out[on] = arrays.noise_level(np.stack(trace[on].to_list()).astype(float))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rolling_baseline(trace: pd.Series, window: pd.Series, percentile: pd.Series) -> pd.Series:
    return pd.Series([arrays.rolling_baseline(np.asarray(t, float), int(w), float(q)) for t, w, q in zip(trace, window, percentile)])


@F.pandas_udf(T.DoubleType())
def beta_pdf(x: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
    out = np.zeros(len(x))
    pairs, which = np.unique(np.column_stack([p, q]).astype(float), axis=0, return_inverse=True)
    for i, (a, b) in enumerate(pairs):  # values with the same parameters at once
        on = which.ravel() == i
        out[on] = solvers.beta_pdf(x.to_numpy(float)[on], a, b)
    return pd.Series(out)


@udtf(returnType="dy int, dx int, w double")
class SurroundKernel:
    """Rows of the zero-sum kernel of a given sigma."""

    def eval(self, sigma: float):
        k = arrays.surround_kernel(float(sigma))
        r = len(k) // 2
        for (i, j), w in np.ndenumerate(k):
            yield i - r, j - r, float(w)


@udtf(returnType="t int, c double, s double, bl double")
class DeconvolveRows:
    """A trace array as rows of calcium and spikes."""

    def eval(self, trace, g: float, sn: float):
        c, s, base = deconvolution.deconvolve(np.asarray(trace, float), float(g), float(sn))
        for t, (a, b) in enumerate(zip(c, s)):
            yield t, float(a), float(b), base


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL text: lf_deconvolve, lf_noise, lf_baseline, lf_beta_pdf, lf_kernel, lf_spikes."""
    spark.udf.register("lf_deconvolve", deconvolve)
    spark.udf.register("lf_noise", noise_level)
    spark.udf.register("lf_baseline", rolling_baseline)
    spark.udf.register("lf_beta_pdf", beta_pdf)
    spark.udtf.register("lf_kernel", SurroundKernel)
    spark.udtf.register("lf_spikes", DeconvolveRows)
