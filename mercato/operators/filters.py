"""Shared predicates. Each is one Column, so a board and its count of blocked rows cannot drift apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_device() -> Column:
    """Positively a new, single device."""
    return (F.col("product_kind") == "device") & (F.col("condition") == "new") & (F.col("is_bundle") == 0)


def not_accessory() -> Column:
    """The loose form: unknown kinds stay. Not interchangeable with ``clean_device``."""
    return F.col("product_kind") != "accessory"


def audited(status: str = "accepted") -> Column:
    """``accepted``: only those; ``not_rejected``: pending ones too."""
    return F.col("audit_status") == "accepted" if status == "accepted" else F.col("audit_status") != "rejected"


def same_category(left: str, right: str) -> Column:
    return (F.col(left) == F.col(right)) | F.col(left).isNull() | F.col(right).isNull()


def public_price() -> Column:
    return F.coalesce(F.col("price_scope"), F.lit("public")) != "card"


def not_bucket(col: str = "is_bucket") -> Column:
    return F.coalesce(F.col(col), F.lit(0)) == 0


def official() -> Column:
    return F.col("seller_kind").isin("self_operated", "brand_official")


def official_tier() -> Column:
    return F.when(F.col("seller_kind") == "self_operated", 2).when(F.col("seller_kind") == "brand_official", 1).otherwise(0)


def self_consistent(tolerance: float = 1.0) -> Column:
    """A move's percentage agrees with its two prices."""
    return F.abs(F.col("change_pct") - F.try_divide(F.col("curr_price") - F.col("prev_price"), F.col("prev_price")) * 100) <= tolerance


def optional(**wanted) -> Column:
    """The conjunction of equalities (or memberships, for lists) for the arguments that are not None."""
    parts = [F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def contains_any_case(col: str, text: str) -> Column:
    """Substring search without case; % and _ are ordinary characters."""
    return F.lower(F.col(col)).contains(text.lower())


def recent(df: DataFrame, days: int, col: str = "obs_date") -> DataFrame:
    """The last ``days`` days up to the latest day in the data (never the wall clock)."""
    now = df.agg(F.max(col).alias("_now"))
    return df.crossJoin(F.broadcast(now)).where(F.col(col) > F.date_sub("_now", days)).drop("_now")


def scope(text: str) -> dict[str, str | None]:
    """``all``, ``CC``, ``CC:category`` or ``:category``."""
    country, _, category = ("" if text == "all" else text).partition(":")
    return {"country": country or None, "category": category or None}
