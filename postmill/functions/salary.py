"""Board salaries as numbers: bounds and mean in million VND a month, flags of missing pay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.fields import NEGOTIABLE, salary_text
from postmill.functions.text import strip

#: VND of one US dollar where a caller brings no rate. Fixed value.
USD_RATE = 25_000
#: Whole texts that say that pay is negotiable. Fixed values.
NEGOTIABLE_TEXTS = ("thỏa thuận", "thoả thuận", "thoa thuan", "negotiable")
UP_TO, FROM = r"up to|upto|tới", r"từ|from"


def salary_bounds(salary: Column, usd_rate: float = USD_RATE) -> Column:
    """struct(min_salary, max_salary, avg_salary), million VND, 0.0 where a bound isn't stated.

    Dots before groups of three digits and commas are no decimals. "up to" words make the first number the upper bound, then "from" words the
    lower one, then a hyphen between two numbers both; otherwise one number is both. Dollars go by `usd_rate`, other amounts from
    1,000,000 on are VND, below millions. The mean is that of both bounds, or the only one. Two decimals. Null, negotiable and
    digitless texts are all 0.
    """

    def read(x: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda n: n.cast("double"))
        return F.struct(x.alias("text"), numbers.alias("n"))

    def bounds(p: Column) -> Column:
        one, two = F.get(p["n"], F.lit(0)), F.get(p["n"], F.lit(1))
        upper, lower = p["text"].rlike(UP_TO), p["text"].rlike(FROM)
        low = F.when(upper, 0.0).otherwise(one)
        high = F.when(upper, one).when(lower, 0.0).when(p["text"].contains("-") & two.isNotNull(), two).otherwise(one)
        usd = p["text"].contains("usd") | p["text"].contains("$")
        million = lambda v: F.when(v <= 0, 0.0).when(usd, v * usd_rate / 1e6).when(v >= 1e6, v / 1e6).otherwise(v)
        return F.struct(F.coalesce(million(low), F.lit(0.0)).alias("lo"), F.coalesce(million(high), F.lit(0.0)).alias("hi"))

    def rounded(b: Column) -> Column:
        mean = F.when((b["lo"] > 0) & (b["hi"] > 0), (b["lo"] + b["hi"]) / 2).otherwise(F.greatest(b["lo"], b["hi"]))
        return F.struct(F.round(b["lo"], 2).alias("min_salary"), F.round(b["hi"], 2).alias("max_salary"), F.round(mean, 2).alias("avg_salary"))

    low = F.regexp_replace(F.translate(strip(F.lower(salary)), "–,", "-"), r"(?<=\d)\.(?=\d{3}(?!\d))", "")
    text = F.when(salary.isNull() | (salary == NEGOTIABLE), F.lit("")).otherwise(low)
    # each step is the only element of an array, so that none is computed again for the next
    return F.transform(F.transform(F.transform(F.transform(F.array(text), read), bounds), rounded), lambda x: x)[0]


def process_salary(df: DataFrame, salary: str = "salary", usd_rate: float = USD_RATE) -> DataFrame:
    """`df` with the salary text cleaned, min_salary, max_salary, avg_salary and the flags is_null_salary, is_thoa_thuan and is_missing_salary."""
    names = ("min_salary", "max_salary", "avg_salary", "is_null_salary", "is_thoa_thuan", "is_missing_salary")
    cleaned = df.drop(*names).withColumn(salary, salary_text(F.col(salary)))
    parsed = cleaned.withColumn("__b", salary_bounds(F.col(salary), usd_rate))
    negotiable = F.lower(F.col(salary)).contains("thỏa thuận")
    out = parsed.select(*cleaned.columns, *(F.col("__b")[n].alias(n) for n in names[:3]), F.col(salary).isNull().alias("is_null_salary"), negotiable.alias("is_thoa_thuan"))
    return out.withColumn("is_missing_salary", F.col("is_thoa_thuan") | strip(F.lower(salary)).isin("", "nan", "none") | (F.col("avg_salary") == 0))


def salary_flags(salary: Column) -> Column:
    """struct(is_null_salary, is_thoa_thuan, is_missing_salary) by whole texts, before any parsing."""
    said = F.coalesce(strip(F.lower(salary)).isin(*NEGOTIABLE_TEXTS), F.lit(False))
    return F.struct(salary.isNull().alias("is_null_salary"), said.alias("is_thoa_thuan"), (salary.isNull() | said).alias("is_missing_salary"))


def valid_salary(salary: Column) -> Column:
    """Whether a salary says more than nothing or that it is negotiable."""
    return salary.isNotNull() & ~strip(F.lower(salary)).isin(*NEGOTIABLE_TEXTS, "")


def completeness(df: DataFrame, by: str, salary: str = "avg_salary") -> DataFrame:
    """(by, rows, share): the share of rows of each group that state pay, rounded to four places."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.round(F.avg((F.col(salary) > 0).cast("int")), 4).alias("share"))
