"""Bit and byte transforms of single values, and precision cuts, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParam

#: Bits of the fraction.
FRACTION = {"f4": 23, "f8": 52}


def byte_of(value: Column, k: int | Column) -> Column:
    """Byte k of a whole number, the lowest first, as 0 to 255."""
    shift = F.lit(8 * k) if isinstance(k, int) else (k * 8)
    return F.call_function("shiftrightunsigned", value.cast("long"), shift.cast("int")).bitwiseAND(F.lit(255).cast("long"))


def bit_of(value: Column, k: int | Column) -> Column:
    shift = F.lit(k) if isinstance(k, int) else k
    return F.call_function("shiftrightunsigned", value.cast("long"), shift.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def int_trunc(value: Column, meta: int, bits: int) -> Column:
    """Zero the low bits of whole numbers of ``bits`` bits: meta > 0 keeps that many bits, meta < 0 drops that many."""
    drop = bits - meta if meta > 0 else -meta
    if not 0 <= drop < bits:
        raise InvalidParam(f"{meta} leaves no bits of {bits}")
    return value.cast("long").bitwiseAND(F.lit(-1 << drop).cast("long"))


def trunc_precision(value: Column, meta: int, dtype: str = "f8") -> Column:
    """Zero the low bits of the fraction of floats: meta >= 0 keeps that many bits, meta < 0 drops that many.

    The bits themselves are masked, in Arrow batches. NaN, infinities, zeros and nulls stay; the sign of zero too.
    """
    fraction = FRACTION.get(dtype)
    if fraction is None:
        raise InvalidParam("precision can be cut of f4 and f8 only")
    keep = meta if meta >= 0 else fraction + meta
    if not 0 < keep <= fraction:
        raise InvalidParam(f"{meta} leaves no fraction bits of {fraction}, or more than there are")
    whole = np.dtype("<i4" if dtype == "f4" else "<i8")
    mask = whole.type(-1 << (fraction - keep))
    kind = pa.float32() if dtype == "f4" else pa.float64()

    @F.arrow_udf("float" if dtype == "f4" else "double")
    def cut(x: pa.Array) -> pa.Array:
        x = x.cast(kind)
        plain = x.fill_null(0).to_numpy(zero_copy_only=False)
        masked = (plain.view(whole) & mask).view(plain.dtype)
        return pa.array(np.where(np.isfinite(plain), masked, plain), kind, mask=x.is_null().to_numpy(zero_copy_only=False))

    return cut(value)


def bounded_error(value: Column, digits: int) -> Column:
    """Round to a multiple of 10^digits: the error is no more than half of that."""
    return F.round(value, -digits)
