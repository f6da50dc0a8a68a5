"""Stated pay in free text -> bounds in thousand VND per month.

The text is reduced to (low, high, unit) with Catalyst expressions only; the unit is "scale currency/period", a node
of the graph in operators.units. A unit that isn't in the salary text is read from the description's sentence
on pay.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.units import UnitGraph, convert

#: Powers of ten that a written amount may leave out.
SCALES = {"": 1, "k": 1_000, "man": 10_000, "m": 1_000_000}
TARGET = "k VND/month"
#: Units read to the driver; a longer table is refused.
MAX_FACTORS = 10_000


def pay_units(factors: list[tuple[str, str, int, int]]) -> UnitGraph:
    """The graph of all pay units from rows (unit, kind, numer, denom) of unit_factors.

    Nodes are "scale currency/period". Scale edges go to the plain amount, currency edges to VND, period edges
    to the month; currency and period edges stand for every value of the other, so each pair of them closes a
    cycle that the graph checks.
    """
    currencies = {u: Fraction(n, d) for u, kind, n, d in factors if kind == "currency"}
    periods = {u: Fraction(n, d) for u, kind, n, d in factors if kind == "period"}
    edges: list[tuple[str, str, Fraction, int]] = []
    for c, per_unit in currencies.items():
        for p, per_month in periods.items():
            plain = f" {c}/{p}"
            edges += [(f"{s} {c}/{p}", plain, Fraction(x), 0) for s, x in SCALES.items() if s]
            if c != "VND":
                edges.append((plain, f" VND/{p}", per_unit, 0))
            if p != "month":
                edges.append((plain, f" {c}/month", per_month, 0))
    return UnitGraph(edges)


#: Words that name a currency, a scale or a period, in the languages of the boards. Fixed vocabulary.
CURRENCY_WORDS = [
    ("SGD", r"(?<!u)s\$|sgd|đô la sing|singapore dollar"),
    ("EUR", r"€|\beur\b|\beuros?\b"),
    ("JPY", r"¥|￥|円|\bjpy\b|\byen\b|yên nhật"),
    ("USD", r"\$|\busd\b|us dollar|đô la|do la my|đô mỹ"),
    ("VND", r"vnd|vnđ|₫|đồng(?!\s*(nghiệp|đội|hành|thời|phục|bộ))|\b(trieu|nghin|ngan|bang|thousand|million|in|vietnamese|viet nam)\s+dong\b|\d\s*đ(?!\p{L})|\p{L}đ(?!\p{L})|triệu|trieu|\d\s*tr(?!\p{L})|nghìn|nghin|ngàn|ngan\b"),
]
SCALE_WORDS = [
    ("man", r"万|\bman\s*(yen|jpy|円)"),
    ("m", r"triệu|trieu|\d\s*tr(?!\p{L})|million|\d\s*m(?!\p{L})|\bmio\b"),
    ("k", r"nghìn|nghin|ngàn|ngan\b|thousand|\d\s*k(?!\p{L})"),
]
PERIOD_WORDS = [
    ("year", r"year|yearly|annum|annual|\bp\.?\s?a\b|năm\b|\bnam\b|/\s*yr|年"),
    ("day", r"\bday\b|daily|ngày|\bngay\b|日"),
    ("hour", r"\bhour|hourly|/\s*hr?\b|giờ|\bgio\b|時"),
]


def _first(text: Column, words: list[tuple[str, str]], default: str | None) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(words):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _unit(scale: Column, currency: Column, period: Column) -> Column:
    named = F.coalesce(currency, F.when(scale == "m", F.lit("VND")))
    return F.when(named.isNotNull(), F.concat(scale, F.lit(" "), named, F.lit("/"), period))


def unit_of(text: Column) -> Column:
    """"scale currency/period" named in a text, null when it names neither a currency nor a scale.

    A scale of million without a currency means VND; a period that isn't named is the month.
    """
    return _unit(_first(text, SCALE_WORDS, ""), _first(text, CURRENCY_WORDS, None), _first(text, PERIOD_WORDS, "month"))


def clean_pay(text: Column) -> Column:
    """Lower-cased pay text without remarks on extra months, bonuses or tax; spaces of any kind become one blank."""
    t = F.lower(F.translate(text, "\u00a0\u202f\u2007\u2009\u3000\t\r\n", " " * 8))
    t = F.regexp_replace(t, r"\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\+\s*(?=\p{L}|\d+(st|nd|rd|th)\b|\d+\s*(tháng|months?)).*$", " ")
    t = F.regexp_replace(t, r"\b\d+\s*(st|nd|rd|th|months?|tháng lương|tháng)\b.*$", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: Amount: grouped by thousands (same or mixed separators), else with up to two decimals.
AMOUNT = r"\d{1,3}(?:[., ]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d{1,2})?(?!\d)|\d+"


def amounts(cleaned: Column) -> Column:
    """Amounts of a cleaned pay text in order, as decimal(18,6)."""
    found = F.regexp_extract_all(cleaned, F.lit(f"({AMOUNT})"), 1)

    def value(x: Column) -> Column:
        grouped = x.rlike(r"^\d{1,3}([., ]\d{3})+")
        tail = F.regexp_extract(x, r"[.,](\d{1,2})$", 1)
        head = F.regexp_replace(F.when(tail != "", F.regexp_replace(x, r"[.,]\d{1,2}$", "")).otherwise(x), r"[^\d]", "")
        plain = F.regexp_replace(x, ",", ".")
        text = F.when(grouped & (tail != ""), F.concat(head, F.lit("."), tail)).when(grouped, head).otherwise(plain)
        return text.try_cast("decimal(18,6)")

    return F.transform(found, value)


#: Direction words before an amount, and sentences that speak of pay. Fixed vocabulary.
UP_TO = r"up\s*to|upto|lên đến|len den|lên tới|\btới\b|\btoi\b|\bmax|tối đa|toi da|<=|≤|dưới|under|below|^\s*<"
AT_LEAST = r"^\s*từ|^\s*tu\b|^\s*from|\bmin|trên|^\s*tren\b|tối thiểu|>=|≥|at least|above|over|^\s*>|\+\s*$|trở lên"
PAY_SENTENCE = r"lương|(?<!chat )(?<!so )(?<!dung )\bluong\b(?! du lieu)|salary|\bpay\b|\bpaid\b|thu nhập|thu nhap|income|wage|package|compensation|remuneration|給与|月給|年収|급여|연봉|gehalt|salaire"


def described_unit(description: Column) -> Column:
    """The unit that the first sentence of a description names which speaks of pay and names one; null if none does."""
    sentences = F.filter(F.split(F.lower(description), r"[.!?。\r\n]+"), lambda s: s.rlike(PAY_SENTENCE))
    # the units of the sentences are elements of an array, so that no sentence is cut out again for each of the words looked for
    return F.try_element_at(F.filter(F.transform(sentences, unit_of), lambda u: u.isNotNull()), F.lit(1))


def parse_pay(df: DataFrame, salary: str = "salary", description: str = "job_description") -> DataFrame:
    """Add pay_low, pay_high (decimal, in the stated unit, null = not stated) and pay_unit.

    A text without digits, blank or null states no amount: all three are null. With two amounts the first is
    the low and the second the high bound; one amount is the high bound after words like "up to", the low bound
    after words like "from" or before "+", else both. pay_unit is null if neither the salary nor the
    description names one.
    """
    t = clean_pay(F.col(salary))
    df = df.drop("pay_low", "pay_high", "pay_unit").withColumn("__clean", t)
    df = df.withColumn("__pay", F.when(F.col("__clean").rlike(r"\d"), F.col("__clean"))).drop("__clean")
    pay = F.col("__pay")
    # one column per test: each is used more than once below and none is evaluated twice
    parts = {"scale": _first(pay, SCALE_WORDS, ""), "currency": _first(pay, CURRENCY_WORDS, None), "period": _first(pay, PERIOD_WORDS, "month"), "up": pay.rlike(UP_TO), "least": pay.rlike(AT_LEAST), "amounts": amounts(pay)}
    names = [f"__{n}" for n in parts]
    df = df.withColumns({f"__{n}": e for n, e in parts.items()})
    one, two = F.try_element_at("__amounts", F.lit(1)), F.try_element_at("__amounts", F.lit(2))
    single = F.size("__amounts") == 1
    up, least = F.col("__up"), F.col("__least")
    # a scale letter alone, as in "20K", doesn't tell the currency: the description does
    own = _unit(F.col("__scale"), F.col("__currency"), F.col("__period"))
    return df.select(
        *(df[c] for c in df.columns if c not in ("__pay", *names)),
        F.when(single & up, F.lit(None)).otherwise(F.when(F.size("__amounts") >= 1, one)).alias("pay_low"),
        F.when(single & least & ~up, F.lit(None)).when(single, one).otherwise(two).alias("pay_high"),
        F.when(pay.isNotNull(), F.coalesce(own, described_unit(F.col(description)))).alias("pay_unit"),
    )


def monthly_kvnd(df: DataFrame, factors: DataFrame, salary: str = "salary", description: str = "job_description") -> DataFrame:
    """Add low_kvnd and high_kvnd (long, thousand VND a month; 0 = bound not stated) to postings.

    Both are null when no amount is stated or its unit can't be told. Columns of these names and of those that
    parse_pay adds are replaced, repeated rows stay repeated. `factors` (unit, kind, numer, denom) is a
    table of units: its rows are read to the driver to build the graph, at most MAX_FACTORS.
    """
    spark: SparkSession = df.sparkSession
    rows = [tuple(r) for r in factors.filter(F.col("kind").isin("currency", "period")).select("unit", "kind", "numer", "denom").limit(MAX_FACTORS + 1).collect()]
    if len(rows) > MAX_FACTORS:
        raise ValueError(f"more than {MAX_FACTORS} units")
    df = df.drop("low_kvnd", "high_kvnd", "pay_low", "pay_high", "pay_unit")
    conversions = pay_units(rows).table(spark, [TARGET])
    parsed = parse_pay(df, salary, description)
    out = convert(parsed, conversions, TARGET, {"pay_low": "__low", "pay_high": "__high"}, "pay_unit")
    stated = F.col("__low").isNotNull() | F.col("__high").isNotNull()
    return out.select(
        *(out[c] for c in df.columns),
        *(F.when(stated, F.coalesce(F.round(F.col(c)).try_cast("long"), F.lit(0))).alias(name) for c, name in (("__low", "low_kvnd"), ("__high", "high_kvnd"))),
    )
