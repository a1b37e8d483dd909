"""Credit metrics over columns. Undefined input gives null instead of an error; `reasons` names what was undefined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.functions import text as X

# Fixed values of the credit policy.
MAX_LEVERAGE = 3.5
MIN_DSCR = 1.25
MIN_CURRENT_RATIO = 1.1
CONCENTRATION_CONCERN = 25.0
MIN_FACILITY_USD = 3_000_000
MAX_FACILITY_USD = 40_000_000
IDENTITY_TOLERANCE = 0.02


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _over(top, bottom, defined) -> Column:
    return F.when(defined, top / bottom)


def total(*parts) -> Column:
    return reduce(lambda a, b: a + b, map(_c, parts)) if parts else F.lit(None).cast("double")


def total_debt(*lines) -> Column:
    return total(*lines)


def leverage(debt, ebitda) -> Column:
    return _over(_c(debt), _c(ebitda), _c(ebitda) > 0)


def dscr(ebitda, capex, taxes, interest, principal) -> Column:
    service = _c(interest) + _c(principal)
    return _over(_c(ebitda) - _c(capex) - _c(taxes), service, service > 0)


def current_ratio(assets, liabilities) -> Column:
    return _over(_c(assets), _c(liabilities), _c(liabilities) > 0)


def concentration(largest, total_) -> Column:
    return _over(_c(largest) * 100, _c(total_), _c(total_) > 0)


def convert_units(printed, scale) -> Column:
    return F.when(_c(scale) >= 1, _c(printed) * _c(scale))


def growth(current, prior) -> Column:
    return _over((_c(current) - _c(prior)) * 100, F.abs(_c(prior)), _c(prior) != 0)


def change(current, prior) -> Column:
    return growth(current, prior)


def share_of(part, whole) -> Column:
    return _over(F.abs(_c(part)) * 100, F.abs(_c(whole)), _c(whole) != 0)


def margin(numerator, revenue) -> Column:
    return share_of(numerator, revenue)


def interest_coverage(ebitda, interest) -> Column:
    return _over(_c(ebitda), F.abs(_c(interest)), _c(interest) != 0)


#: Every metric by name.
METRICS = {
    "total": total,
    "total_debt": total_debt,
    "leverage": leverage,
    "dscr": dscr,
    "current_ratio": current_ratio,
    "concentration": concentration,
    "convert_units": convert_units,
    "growth": growth,
    "share_of": share_of,
    "margin": margin,
    "interest_coverage": interest_coverage,
    "change": change,
}


def formatted(value, unit) -> Column:
    """A result as printed: dollars whole, multiples to two places, percentages to one."""
    value, unit = _c(value), _c(unit)
    plain = F.format_number(value, 2)
    return (
        F.when(unit == "USD", F.concat(F.lit("$"), F.format_number(value, 0)))
        .when(unit == "x", F.concat(X.fixed(value, 2), F.lit("x")))
        .when(unit == "percent", F.concat(X.fixed(value, 1), F.lit("%")))
        .otherwise(plain)
    )


def required_recommendation(leverage_, dscr_) -> Column:
    """What the metrics permit, whatever a memo says."""
    lev, cov = _c(leverage_), _c(dscr_)
    return F.when(lev.isNull() | cov.isNull(), "DEFER").when((lev <= MAX_LEVERAGE) & (cov >= MIN_DSCR), "PROCEED").otherwise("DECLINE")


def permissiveness(recommendation) -> Column:
    r = _c(recommendation)
    return F.when(r == "DECLINE", 0).when(r == "DEFER", 1).when(r == "PROCEED", 2)


def consistent(stated, required) -> Column:
    """A memo may be stricter than the metrics, never looser."""
    return permissiveness(stated) <= permissiveness(required)


def conservative(stated, required) -> Column:
    return permissiveness(stated) < permissiveness(required)
