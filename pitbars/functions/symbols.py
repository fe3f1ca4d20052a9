"""Security codes as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_symbol(raw: Column, strict: bool = False) -> Column:
    """NNNNNN.SH / NNNNNN.SZ from a suffixed, prefixed or bare code in any case; null (strict: an error) for anything else."""
    code = F.upper(F.trim(raw))
    suffixed, prefixed = F.regexp_extract(code, r"^(\d{6})\.(SH|SZ)$", 1), F.regexp_extract(code, r"^(SH|SZ)(\d{6})$", 2)
    head = F.substring(code, 1, 1)
    out = (
        F.when(suffixed != "", code)
        .when(prefixed != "", F.concat(prefixed, F.lit("."), F.substring(code, 1, 2)))
        .when(code.rlike(r"^\d{6}$") & head.isin("6", "5", "9"), F.concat(code, F.lit(".SH")))
        .when(code.rlike(r"^\d{6}$") & head.isin("0", "3", "1"), F.concat(code, F.lit(".SZ")))
    )
    return F.coalesce(out, F.raise_error(F.concat(F.lit("not a security code: "), F.coalesce(raw, F.lit("null"))))) if strict else out


def digits(code: Column) -> Column:
    return F.substring(code, 1, 6)


def market(code: Column) -> Column:
    return F.lower(F.substring(code, 8, 2))


def prefixed(code: Column) -> Column:
    return F.concat(market(code), digits(code))


def dotted(code: Column) -> Column:
    return F.concat(market(code), F.lit("."), digits(code))


def is_index(code: Column) -> Column:
    return digits(code).startswith("399") | (code.endswith(".SH") & digits(code).startswith("000"))


def is_index_or_etf(code: Column) -> Column:
    return F.substring(code, 1, 2).isin("15", "16", "51", "58") | (code.endswith(".SH") & code.startswith("000")) | (code.endswith(".SZ") & code.startswith("399"))


def market_symbol(raw: Column) -> Column:
    """NNNNNN.SH / .SZ / .BJ from eight characters; null for anything else."""
    return F.when(raw.rlike(r"^(sh|sz|bj)\d{6}$"), F.concat(F.substring(raw, 3, 6), F.lit("."), F.upper(F.substring(raw, 1, 2))))


def board(code: Column, variant: str = "context") -> Column:
    """variant 'context' knows BSE by the market, 'export' by the first digits, tested last."""
    three = F.substring(code, 1, 3)
    growth, star = three.isin("300", "301"), three.isin("688", "689")
    if variant == "context":
        return F.when(code.endswith(".BJ"), "BSE").when(growth, "CHINEXT").when(star, "STAR").otherwise("MAIN")
    return F.when(growth, "CHINEXT").when(star, "STAR").when(code.rlike("^(4|8|92)"), "BSE").otherwise("MAIN")


def exchange_code(raw: Column) -> Column:
    """NNNNNN.SZ / .SH from NNNNNN.XSHE (0, 3) / .XSHG (6); null for anything else."""
    return F.when(raw.rlike(r"^[03]\d{5}\.XSHE$"), F.concat(F.substring(raw, 1, 6), F.lit(".SZ"))).when(raw.rlike(r"^6\d{5}\.XSHG$"), F.concat(F.substring(raw, 1, 6), F.lit(".SH")))


#: Adjustment mode and its version.
ADJUSTMENT_VERSIONS = {"hfq": "baostock-adjustflag-1", "qfq": "baostock-adjustflag-2", "raw": "baostock-adjustflag-3"}


def identity_version(mode: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, version in ADJUSTMENT_VERSIONS.items():
        out = F.when(mode == name, version).otherwise(out)
    return out
