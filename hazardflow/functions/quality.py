"""Raw-input quality: validation, imputation, clipping and scaling against fixed limits."""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import Column, functions as F

from hazardflow import dims


class Scaling(Enum):
    """Z_SCORE and ROBUST leave values unchanged unless statistics are fitted (see ``enrich.fit_scaling``)."""

    MIN_MAX = "min_max"
    Z_SCORE = "z_score"
    ROBUST = "robust"
    NONE = "none"


def from_map(raw: Column) -> dict[str, Column]:
    """Named inputs out of a ``map<string,string>`` or ``map<string,double>`` column."""
    return {name: F.try_element_at(raw, F.lit(name)) for name in dims.INPUT_NAMES}


def overridden(base: dict[str, Column], raw: Column) -> dict[str, Column]:
    """Base inputs with the request's own values winning."""
    extra = from_map(raw)
    return {name: F.coalesce(extra[name], base[name]) if name in base else extra[name] for name in dims.INPUT_NAMES}


def _missing(values: dict[str, Column], name: str) -> Column:
    return values[name].isNull() if name in values else F.lit(True)


def _number(values: dict[str, Column], name: str) -> Column:
    return values[name].try_cast("double") if name in values else F.lit(None).cast("double")


def errors(values: dict[str, Column], strict: bool = False) -> Column:
    """Reasons to reject a row: a non-numeric or NaN input, and in strict mode a missing required one."""
    found = []
    for name, _, _, required, _ in dims.INPUT_LIMITS:
        number = _number(values, name)
        if name in values:
            found.append(F.when(values[name].isNotNull() & number.isNull(), F.lit(f"{name}: not numeric")))
        found.append(F.when(F.isnan(number), F.lit(f"{name}: NaN")))
        if strict and required:
            found.append(F.when(_missing(values, name), F.lit(f"{name}: missing")))
    return F.array_compact(F.array(*found))


def is_valid(values: dict[str, Column], strict: bool = False) -> Column:
    """Whether a row has no errors, as a plain condition that can filter at the scan.

    NaN sorts above infinity, so one comparison covers "is a number and not NaN".
    """
    conditions = []
    for name, _, _, required, _ in dims.INPUT_LIMITS:
        must_exist = strict and required
        if name in values:
            absent_ok = F.lit(False) if must_exist else values[name].isNull()
            conditions.append(F.coalesce(_number(values, name) <= F.lit(float("inf")), absent_ok))
        elif must_exist:
            conditions.append(F.lit(False))
    return reduce(Column.__and__, conditions, F.lit(True))


def warnings(values: dict[str, Column]) -> Column:
    """Required inputs that are missing and will take their default."""
    found = [
        F.when(_missing(values, name), F.lit(f"{name}: missing"))
        for name, _, _, required, _ in dims.INPUT_LIMITS
        if required
    ]
    return F.array_compact(F.array(*found))


def impute(values: dict[str, Column]) -> dict[str, Column]:
    """Missing inputs take the default; inputs without a limit entry are dropped."""
    return {
        name: F.coalesce(_number(values, name), F.lit(default)) for name, _, _, _, default in dims.INPUT_LIMITS
    }


def clip(values: dict[str, Column]) -> dict[str, Column]:
    """Limit each input to its range. NaN must have been rejected before; infinities clip."""
    return {
        name: F.greatest(F.lit(low), F.least(F.lit(high), values[name])) for name, low, high, _, _ in dims.INPUT_LIMITS
    }


def scale(values: dict[str, Column], scaling: Scaling = Scaling.MIN_MAX) -> dict[str, Column]:
    if scaling is not Scaling.MIN_MAX:
        return values
    return {
        name: (values[name] - F.lit(low)) / F.lit(high - low) for name, low, high, _, _ in dims.INPUT_LIMITS
    }


def preprocess(values: dict[str, Column], scaling: Scaling = Scaling.MIN_MAX) -> dict[str, Column]:
    """Impute, clip and scale; exactly the ten limited inputs come out."""
    return scale(clip(impute(values)), scaling)
