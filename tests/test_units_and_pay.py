from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.operators.pay import monthly_kvnd, pay_units
from postmill.operators.units import InconsistentUnits, UnitGraph, compose, convert, inverse

FACTORS = [("VND", "currency", 1, 1), ("USD", "currency", 25000, 1), ("EUR", "currency", 27000, 1), ("JPY", "currency", 165, 1), ("SGD", "currency", 19000, 1)] + [
    ("month", "period", 1, 1), ("year", "period", 1, 12), ("day", "period", 22, 1), ("hour", "period", 176, 1)
]


def test_affine_chain_and_inverse():
    g = UnitGraph([("F", "C", Fraction(5, 9), Fraction(-160, 9)), ("C", "K", 1, Fraction(5463, 20))])
    (a, b), hops = g.compositions("K")["F"]
    assert hops == 2 and a * 212 + b == Fraction(37315, 100)
    f = (Fraction(3, 7), Fraction(-2))
    assert compose(f, inverse(f)) == (1, 0)


def test_inconsistent_cycles_are_refused():
    g = UnitGraph([("a", "b", 2, 0), ("b", "c", 3, 0), ("a", "c", 7, 0)])
    with pytest.raises(InconsistentUnits):
        g.compositions("c")
    with pytest.raises(InconsistentUnits):
        UnitGraph([("a", "b", 2, 0), ("b", "a", 2, 0)])
    with pytest.raises(ValueError):
        UnitGraph([("a", "b", 0, 1)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.fractions(min_value=Fraction(1, 100), max_value=100).filter(bool), min_size=2, max_size=6))
def test_any_path_composes_to_the_product(factors):
    g = UnitGraph([(str(i), str(i + 1), f, 0) for i, f in enumerate(factors)])
    (a, b), _ = g.compositions(str(len(factors)))["0"]
    product = Fraction(1)
    for f in factors:
        product *= f
    assert (a, b) == (product, 0)


def test_convert_keeps_unknown_units_and_clashing_names(spark):
    g = UnitGraph([("km", "m", 1000, 0), ("C", "m", 1, 5)])
    df = spark.createDataFrame([("km", "1.5", "x"), ("C", "2", "y"), (None, "3", "z"), ("lb", "4", "w"), ("km", None, "v")], "unit string, v string, target string")
    out = convert(df, g.table(spark, ["m"]), "m", {"v": "metres"})
    got = {r.target: (r.metres and float(r.metres)) for r in out.collect()}
    assert got == {"x": 1500.0, "y": 7.0, "z": None, "w": None, "v": None}
    assert convert(df.limit(0), g.table(spark, ["m"]), "m", {"v": "metres"}).count() == 0


CASES = [
    ("500 - 700 USD", "", (12500, 17500)), ("Up to $3,100", "", (0, 77500)), ("US$400+", "", (10000, 0)), ("S$1,000 – S$1,200", "", (19000, 22800)), ("USD 4,800-USD 7,200 p.a.", "", (10000, 15000)),
    ("Từ 27.500 đến 32.500 nghìn đồng", "", (27500, 32500)), ("12 500 000 - 22 500 000đ", "", (12500, 22500)), ("10 – 15 tr", "", (10000, 15000)), ("2.3k - 2.4k USD + 13th month", "", (57500, 60000)),
    ("1.900 USD (13 months)", "", (47500, 47500)), ("Từ 12 đến 18万円", "", (19800, 29700)), ("20 man yen", "", (33000, 33000)), ("100 to 160 USD/man-day", "", (55000, 88000)), ("$7/giờ", "", (30800, 30800)),
    ("2100 ~ 3100", "You join us. Figures for pay are US dollars each month, before tax.", (52500, 77500)), ("42,5 - 55", "The salary shown is in million VND per month.", (42500, 55000)),
    (">= 26,400", "Con số nêu trên là tổng thu nhập một năm, tính bằng USD.", (55000, 0)), ("17.500", "Unit of pay: thousand dong a month.", (17500, 17500)),
    ("27.5 - 30", "Phoi hop tu dong. Muc tieu chat luong ro rang. Muc luong ghi o tren tinh bang trieu dong moi thang.", (27500, 30000)),
    ("Thỏa thuận", "", None), ("", "", None), (None, None, None), ("   ", "x", None), ("100 - 200", "nothing said", None), ("9" * 500, "US dollars pay", None),
]


def test_pay_texts(spark):
    df = spark.createDataFrame([(i, s, d, "clash") for i, (s, d, _) in enumerate(CASES)], "i int, salary string, job_description string, pay_unit string")
    factors = spark.createDataFrame(FACTORS, "unit string, kind string, numer long, denom long")
    got = {r.i: None if r.low_kvnd is None else (r.low_kvnd, r.high_kvnd) for r in monthly_kvnd(df, factors).collect()}
    assert {i: got[i] for i in got if got[i] != CASES[i][2]} == {}
    assert monthly_kvnd(df.limit(0), factors).count() == 0


def test_all_pay_units_reach_the_target():
    assert len(pay_units(FACTORS).compositions("k VND/month")) == 5 * 4 * 4
