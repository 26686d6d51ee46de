"""Event names and the revenue expression, so no operator hard-codes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def revenue_from_column() -> Column:
    return F.coalesce(F.col("revenue"), F.lit(0.0))


def revenue_from_prop(key: str = "revenue") -> Column:
    """Amount kept as text in ``props``; text that is not a number counts as 0."""
    return F.coalesce(F.col("props")[key].try_cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Vocabulary:
    """Names an app uses for the events that carry meaning."""

    install: tuple[str, ...] = ("app_installed", "app_install", "first_open")
    open: tuple[str, ...] = ("app_opened",)
    purchase: tuple[str, ...] = ("purchase", "purchase_completed")
    error: tuple[str, ...] = ("error", "app_crashed")
    api_call: tuple[str, ...] = ("api_call",)
    screen: tuple[str, ...] = ("screen_view", "page_view")
    session_start: str = "session_start"
    session_end: str = "session_end"
    revenue: Callable[[], Column] = revenue_from_column

    def is_install(self) -> Column:
        return F.col("event_name").isin(*self.install)

    def is_open(self) -> Column:
        return F.col("event_name").isin(*self.open)

    def is_purchase(self) -> Column:
        return F.col("event_name").isin(*self.purchase)

    def is_error(self) -> Column:
        return F.col("event_name").isin(*self.error)

    def is_api_call(self) -> Column:
        return F.col("event_name").isin(*self.api_call)

    def is_screen(self) -> Column:
        return F.col("event_name").isin(*self.screen)


DEFAULT_VOCABULARY = Vocabulary()
