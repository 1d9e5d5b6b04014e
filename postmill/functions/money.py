"""Pay ranges: only an identifiable fixed monthly amount is compared; everything else stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import narrow

#: Results (fixed values).
MEETS, MAYBE, UNKNOWN, BELOW = "明确符合", "可能符合", "信息不足", "低于目标"
_WORD = r"(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"
_DASH = "[-–—~～至]"
_AMOUNT = r"(\d+(?:\.\d+)?)"
#: Wordings of the grammar (fixed values).
BASE = r"(固定月薪|税前月薪|基本月薪|月基本工资|基本工资|底薪)\s*[:：]?\s*([^\n;；。]+)"
MONTHLY_BASE = r"(月薪)\s*[:：]?\s*([^\n;；。]+)"
EXTRA = r"(?:\+|加|另有|另加|另外|及|以及|外加)\s*(?:年度)?(?:奖金|绩效|提成|股权|股票|期权|补贴)"
AFTER_TAX = "税后|到手"
COMPOSITE = "综合薪|综合收入|含(?:奖金|绩效|提成)|包含|包括|日薪|时薪|/小时|/天|/日|" + _WORD % "hour|hourly|day|daily|week|weekly"
ANNUAL = r"年薪|年包|/年|每年|万元?\s*/?年|annual|" + _WORD % "year(?:ly)?" + r"|per\s*year|" + _WORD % r"p\.?a\.?" + "|总包|package|ote"
BONUS = "奖金|绩效|提成|股权|股票|期权"
FOREIGN = "美元|港币|欧元|usd|hkd|eur|" + _WORD % "gbp|cad|aud|sgd|jpy|chf" + r"|\$|€"
UPPER = "以下|以内|上限|最高|不超过|低于|少于|<|≤"


def _factor(unit: Column) -> Column:
    return F.when(unit == "k", 1000).when(unit == "千", 1000).when(unit == "万", 10000).when(unit == "元", 1)


def _yuan(amount: Column, unit: Column) -> Column:
    return F.bround(F.expr("1D") * amount.try_cast("double") * _factor(unit)).cast("bigint")


def with_salary(df: DataFrame, raw: str, out: str = "salary", target: Column | int = 40_000, narrowed: Column | None = None) -> DataFrame:
    """df with a struct of group, min_monthly, max_monthly, extra_months.

    `narrowed` may be the text after full NFKC; by default only full-width forms are mapped."""
    target = target if isinstance(target, Column) else F.lit(target)
    p = f"_{out}_"
    c = lambda name: F.col(p + name)
    none = F.lit(None).cast("bigint")
    text = F.replace(F.lower(F.coalesce(narrowed if narrowed is not None else narrow(F.col(raw)), F.lit(""))), F.lit(","), F.lit(""))
    df = df.withColumns({p + "s": text})
    base, month = F.regexp_extract(c("s"), BASE, 2), F.regexp_extract(c("s"), MONTHLY_BASE, 2)
    label = F.when(base != "", F.regexp_extract(c("s"), BASE, 1)).when(month != "", F.lit("月薪"))
    n = F.coalesce(F.nullif(F.regexp_extract(c("s"), r"(?:[·•x×*]|(?<![\p{L}\p{N}_]))(\d{2})\s*薪", 1), F.lit("")), F.nullif(F.regexp_extract(c("s"), r"(\d{2})\s*薪", 1), F.lit("")))
    df = df.withColumns({p + "label": label, p + "extra": F.when(n.isNotNull(), F.greatest(F.lit(0), n.cast("int") - 12)), p + "c": F.trim(F.split(F.when(base != "", base).when(month != "", month).otherwise(c("s")), EXTRA, 2)[0])})
    monthly = (F.coalesce(c("label"), F.lit("")).contains("月")) | c("c").rlike("/月|每月|" + _WORD % "month(?:ly)?" + r"|per\s*month")
    rejected = c("s").rlike(AFTER_TAX) | c("c").rlike(COMPOSITE) | c("c").rlike(ANNUAL) | (c("label").isNull() & c("c").rlike(BONUS)) | c("c").rlike(FOREIGN)
    structured = rf"^(?:cny|rmb)\s*{_AMOUNT}(?:\s*{_DASH}\s*{_AMOUNT})?\s*(?:/?\s*month(?:ly)?|per\s+month)\s*$"
    low, high = F.regexp_extract(c("c"), structured, 1), F.regexp_extract(c("c"), structured, 2)
    plain = F.when(c("c").rlike(structured), F.when(high != "", F.concat(low, F.lit("-"), high, F.lit("元"))).otherwise(F.concat(low, F.lit("元")))).otherwise(c("c"))
    df = df.withColumns({p + "monthly": monthly, p + "rejected": rejected}).withColumns({p + "c": plain})
    span = rf"{_AMOUNT}\s*(k|千|万|元)?\s*{_DASH}\s*{_AMOUNT}\s*(k|千|万|元)"
    single = rf"(?s)(?<![\d.]){_AMOUNT}\s*(k|千|万|元)(?![a-z])(.*)\z"
    of = lambda pattern, i: F.regexp_extract(c("c"), pattern, i)
    is_span, is_single = c("c").rlike(span), c("c").rlike(single)
    unit = F.when(of(span, 2) != "", of(span, 2)).otherwise(of(span, 4))
    one = _yuan(of(single, 1), of(single, 2))
    upper = c("c").rlike(UPPER)
    opened = of(single, 3).rlike(r"^\s*(?:起|以上|\+(?:\s*$|\s*[·•]))")
    df = df.withColumns({
        p + "min": F.when(is_span, _yuan(of(span, 1), unit)).when(is_single & ~upper, one),
        p + "max": F.when(is_span, _yuan(of(span, 3), of(span, 4))).when(is_single & (upper | ~opened), one),
        p + "bad": c("rejected")
        | (is_span & c("c").rlike(UPPER + "|以上|起"))
        | (~is_span & ~is_single)
        | (c("c").contains("万") & ~c("monthly"))
        | c("c").rlike(rf"(^|[:：(（])\s*[-−]\s*\d|\d\s*{_DASH}\s*[-−]\s*\d"),
    })
    bad = c("bad") | F.coalesce(c("min") > c("max"), F.lit(False))
    group = (
        F.when(bad, UNKNOWN)
        .when(c("min") >= target, MEETS)
        .when((c("max") <= target) & c("c").rlike("低于|少于|<(?!=)"), BELOW)
        .when(c("max").isNull() | (c("max") >= target), MAYBE)
        .otherwise(BELOW)
    )
    made = F.struct(group.alias("group"), F.when(bad, none).otherwise(c("min")).alias("min_monthly"), F.when(bad, none).otherwise(c("max")).alias("max_monthly"), c("extra").alias("extra_months"))
    return df.withColumn(out, made).drop(*[p + x for x in ("s", "label", "extra", "c", "monthly", "rejected", "min", "max", "bad")])


def structured_salary(currency: Column, low: Column, high: Column, period: Column, single: Column | None = None) -> Column:
    """A published base salary as text: currency, range with ? for a missing bound, period."""
    amount = F.when(low.isNotNull() | high.isNotNull(), F.concat(F.coalesce(low.cast("string"), F.lit("?")), F.lit("–"), F.coalesce(high.cast("string"), F.lit("?")))).otherwise(F.coalesce(single.cast("string") if single is not None else F.lit(None), F.lit("未知")))
    return F.trim(F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), amount, F.lit(" / "), F.coalesce(period, F.lit("周期未知"))))
