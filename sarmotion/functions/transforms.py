"""Fourier transforms of bounded array columns.

Complex values are two ARRAY<DOUBLE> columns.  Transforms are Arrow-batched;
rotations are built-in array functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .geometry import as_col

_DOUBLES = T.ArrayType(T.DoubleType())
_COMPLEX = T.StructType([T.StructField(n, _DOUBLES) for n in ("re", "im")])


def _apply(transform, re: pd.Series, im: pd.Series) -> pd.DataFrame:
    """Rows of one length are transformed together."""
    lengths = re.map(len)
    out = pd.DataFrame({"re": [None] * len(re), "im": [None] * len(re)}, index=re.index, dtype=object)
    for _, at in lengths.groupby(lengths).groups.items():
        z = np.stack(re[at].to_numpy()) + 1j * np.stack(im[at].to_numpy())
        f = transform(z)
        out.loc[at, "re"] = pd.Series(list(f.real), index=at)
        out.loc[at, "im"] = pd.Series(list(f.imag), index=at)
    return out


@pandas_udf(_COMPLEX)
def fft(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    """Unscaled forward transform: STRUCT<re, im>."""
    return _apply(lambda z: np.fft.fft(z, axis=1), re, im)


@pandas_udf(_COMPLEX)
def ifft(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    """Inverse transform, scaled by 1/n: STRUCT<re, im>."""
    return _apply(lambda z: np.fft.ifft(z, axis=1), re, im)


def fft2(re, im, n_row: int, n_col: int, inverse: bool = False) -> Column:
    """Two-dimensional transform of row-major images: STRUCT<re, im>."""
    step = np.fft.ifft2 if inverse else np.fft.fft2

    @pandas_udf(_COMPLEX)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        def images(z):
            return step(z.reshape(-1, n_row, n_col)).reshape(len(z), -1)

        return _apply(images, a, b)

    return run(as_col(re), as_col(im))


def _rotate(values, split: Column) -> Column:
    v = as_col(values)
    return F.concat(F.slice(v, split + 1, F.size(v) - split), F.slice(v, F.lit(1), split))


def fft_shift(values) -> Column:
    """Move zero frequency to index floor(n/2)."""
    n = F.size(as_col(values))
    return _rotate(values, F.ceil(n / 2).cast("int"))


def ifft_shift(values) -> Column:
    """Undo ``fft_shift``, for odd lengths too."""
    n = F.size(as_col(values))
    return _rotate(values, F.floor(n / 2).cast("int"))
