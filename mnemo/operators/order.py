"""Order and limit rules of search (default order, custom ``order_by``,
null placement, mixed-type order, limit cap)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.fixed import (
    DEFAULT_DEPTH, DEFAULT_LIMIT, DEFAULT_ORDER_DESCENDING, DEFAULT_ORDER_PROPERTY, INVALID_ORDER_BY,
    LEGACY_DEFAULT_LIMIT, LEGACY_ORDER_BY_REGEX, MAX_LIMIT, ORDER_BY_REGEX,
)

from mnemo.functions.values import order_keys

ORDER_BY_PATTERN = re.compile(ORDER_BY_REGEX, re.IGNORECASE)
LEGACY_ORDER_BY_PATTERN = re.compile(LEGACY_ORDER_BY_REGEX, re.IGNORECASE)


@dataclass(frozen=True)
class OrderSpec:
    prop: str = DEFAULT_ORDER_PROPERTY
    descending: bool = DEFAULT_ORDER_DESCENDING


DEFAULT_ORDER = OrderSpec()


def parse_order_by(order_by: str | None, strict: bool = False, legacy: bool = False) -> OrderSpec:
    """``[memory.|n.]property ASC|DESC`` (case-insensitive, property made of
    letters and '_'). Anything else falls back to ``created_at DESC``, or
    raises when ``strict`` (the legacy recall behaviour)."""
    if not order_by:
        return DEFAULT_ORDER
    m = (LEGACY_ORDER_BY_PATTERN if legacy else ORDER_BY_PATTERN).fullmatch(order_by)
    if not m:
        if strict:
            raise ValueError(INVALID_ORDER_BY)
        return DEFAULT_ORDER
    return OrderSpec(m.group(2), m.group(3).upper() == "DESC")


def effective_limit(limit, default: int = DEFAULT_LIMIT, cap: int = MAX_LIMIT) -> int:
    """``min(limit ?? default, cap)``; 0 is a real limit, negative or
    fractional limits are request errors."""
    if limit is None:
        return default
    if isinstance(limit, bool) or not float(limit).is_integer() or limit < 0:
        raise ValueError(f"invalid limit: {limit!r}")
    return int(min(limit, cap))


def effective_depth(depth, default: int = DEFAULT_DEPTH) -> int:
    """``depth ?? 1``; a fractional depth is a request error."""
    if depth is None:
        return default
    if isinstance(depth, bool) or not float(depth).is_integer():
        raise ValueError(f"invalid depth: {depth!r}")
    return int(depth)


def order_columns(spec: OrderSpec) -> list[Column]:
    """Sort keys for a spec, ``memory_id`` last for a total order.

    ``created_at`` reads the narrow ``created_pv`` column; other
    properties read the property map.
    """
    pv = F.col("created_pv") if spec.prop == "created_at" else F.col("props")[spec.prop]
    return order_keys(pv, spec.descending) + [F.col("memory_id").asc()]


def top_k(df: DataFrame, spec: OrderSpec, limit: int) -> DataFrame:
    """Ordered top-k: each partition keeps its best ``limit`` rows, one
    task merges them (``TakeOrderedAndProject``)."""
    return df.orderBy(*order_columns(spec)).limit(limit)
