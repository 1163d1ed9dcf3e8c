"""Balance-sheet ratios. Division by zero and missing inputs give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratingloom import fixed_values as V


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def core_ratios(
    total_assets: Column,
    current_assets: Column,
    current_liabilities: Column,
    retained_earnings: Column,
    total_equity: Column,
    total_liabilities: Column,
    ebit: Column,
) -> dict[str, Column]:
    return {
        "liquid": ratio(current_assets - current_liabilities, total_assets),
        "cumprof": ratio(retained_earnings, total_assets),
        "profitab": ratio(ebit, total_assets),
        "leverage": ratio(total_equity, total_liabilities),
    }


def core_ratios_by_name(prefix: str = "") -> dict[str, Column]:
    """The four ratios over columns named like the statement lines."""
    names = [
        "total_assets", "current_assets", "current_liabilities", "retained_earnings",
        "total_equity", "total_liabilities", "ebit",
    ]
    return core_ratios(*[F.col(prefix + n) for n in names])


def first_line_item(lines: Column, name: str) -> Column:
    """The first alias of a statement line that has a value, from a map of lines."""
    return F.coalesce(*[lines[alias] for alias in V.LINE_ITEM_ALIASES[name]])


def supplement_ebit(operating_profit: Column, ebit: Column) -> Column:
    return F.coalesce(operating_profit, ebit)


def mean_ratio_score(liquid: Column, cumprof: Column, profitab: Column) -> Column:
    return (liquid + cumprof + profitab) / 3


def extended_ratios() -> dict[str, Column]:
    """The specified wider ratio set over named statement columns."""
    c = F.col
    return {
        "current_ratio": ratio(c("current_assets"), c("current_liabilities")),
        "quick_ratio": ratio(c("current_assets") - c("inventory"), c("current_liabilities")),
        "debt_to_equity": ratio(c("total_debt"), c("total_equity")),
        "debt_to_assets": ratio(c("total_debt"), c("total_assets")),
        "interest_coverage": ratio(c("ebit"), c("interest_expense")),
        "debt_service_coverage": ratio(c("operating_cash_flow"), c("total_debt_service")),
        "return_on_assets": ratio(c("net_income"), c("total_assets")),
        "return_on_equity": ratio(c("net_income"), c("total_equity")),
        "net_margin": ratio(c("net_income"), c("revenue")),
        "operating_margin": ratio(c("operating_income"), c("revenue")),
        "asset_turnover": ratio(c("revenue"), c("total_assets")),
    }
