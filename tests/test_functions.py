from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions import dates, jsons, logic, numbers, strings


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda c: frame.select(c.alias("v")).first()["v"]


def test_errors_raise(one):
    columns = [
        strings.char(F.lit(-1)), strings.space(F.lit(-1)), strings.repeat(F.lit("a"), F.lit(-1)), strings.left(F.lit("a"), F.lit(-1)), strings.right(F.lit("a"), F.lit(-1)),
        strings.substring(F.lit("abc"), 1, -1), strings.overlay(F.lit("abc"), "x", 0), strings.overlay(F.lit("abc"), "x", 1, -1), numbers.sqrt(F.lit(-1.0)), numbers.exp(F.lit(1000.0)),
        numbers.power(F.lit(-1.0), F.lit(0.5)), numbers.int_div(F.lit(1), F.lit(0)), jsons.field(F.lit("{bad"), "a"), jsons.field(F.lit("{bad"), "a[-1]"), jsons.array_length(F.lit("[1,")),
        logic.sql_error(7, "stop"), dates.extract("YEAR", F.lit("1500-01-01").cast("timestamp_ntz")), numbers.decimal_divide(F.lit("1").cast("decimal(38,12)"), F.lit("0").cast("decimal(38,12)")),
    ]
    for column in columns:
        with pytest.raises(Exception):
            one(column)


def test_values(one):
    null_text = F.lit(None).cast("string")
    cases = [
        (strings.char(F.lit(8364)), "€"), (strings.concat(F.lit(""), F.lit("")), None), (strings.concat(F.lit("a"), null_text), None), (strings.substring(F.lit("abc"), 0, 3), "ab"),
        (strings.substring(F.lit("abc"), -5), "abc"), (strings.trim(F.lit("ababxab"), "ab"), "x"), (strings.trim(F.lit("aabxa"), "ab", "leading"), "aabxa"), (strings.trim(F.lit("..a.."), "."), "a"),
        (strings.lower(F.lit("ÀB")), "Àb"), (strings.format_currency(F.lit("1234567.125").cast("decimal(38,12)"), 2), "1,234,567.12"), (strings.format_currency(F.lit("1251").cast("decimal(38,12)"), -2), "1,300"),
        (strings.space(null_text.cast("int")), None), (numbers.int_div(F.lit(-7), F.lit(2)), -3), (numbers.decimal_multiply(F.lit("1000000000").cast("decimal(38,12)"), F.lit("1000000000").cast("decimal(38,12)")), Decimal("1000000000000000000.000000000000")),
        (numbers.decimal_divide(F.lit("1").cast("decimal(38,12)"), F.lit("3").cast("decimal(38,12)")), Decimal("0.333333333333")), (dates.since_epoch("SECOND", F.lit("1969-12-31 23:59:58.5").cast("timestamp_ntz")), -1),
        (logic.decode(null_text, None, "null", "x"), "null"), (logic.decode(F.lit("a"), "b", 1), None), (logic.sql_error(0), 0), (jsons.field(F.lit('{"a":{"":[true,false]}}'), "a.[0]"), "true"),
        (jsons.field(F.lit('{"a.b":1}'), "a\\.b"), "1"), (jsons.field(null_text, "a"), None), (jsons.array_element(F.lit("[1]"), F.lit(-1)), None), (jsons.array_element(F.lit('{"a":1}'), F.lit(0)), None),
    ]
    for column, want in cases:
        assert one(column) == want, column


@pytest.mark.parametrize("path", ["a[", "a[x]", "a[-2]", "a\\x", "a[99999999999]"])
def test_bad_paths(path):
    with pytest.raises(ValueError):
        jsons.parse_path(path)


def test_arguments_out_of_range():
    for bad in (lambda: strings.trim(F.lit("a"), ""), lambda: strings.format_currency(F.lit(1), 12), lambda: strings.format_currency(F.lit(1), -26)):
        with pytest.raises(ValueError):
            bad()


def test_set_field():
    assert jsons.put_field('{"a":1}', "b.c", "[1]") == '{"a":1,"b":{"c":[1]}}'
    assert jsons.put_field('{"a":[1]}', "a[-1]", "2") == '{"a":[1,2]}'
    assert jsons.put_field('{"a":[1]}', "a[3]", "2") == '{"a":[1,null,null,2]}'
    assert jsons.put_field('{"a":1}', "a.b", "2") == '{"a":1}'


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab.[]\\", max_size=4), st.integers(0, 9)), min_size=1, max_size=5))
def test_path_roundtrip(steps):
    if not isinstance(steps[0], str):
        steps = ["r", *steps]
    quoted = lambda s: "".join("\\" + c if c in ".[]\\" else c for c in s)
    path = ""
    for i, s in enumerate(steps):
        path += f"[{s}]" if isinstance(s, int) else ("." if i else "") + quoted(s)
    if steps[0] == "" and len(steps) > 1:
        return  # a leading empty name has its own spelling
    assert jsons.parse_path(path) == steps


def test_strict_operands(spark):
    df = spark.sql("SELECT '1' AS s, 1 AS i, 1.5D AS f, CAST(1 AS DECIMAL(38,12)) AS d")
    for a, b in (("s", "i"), ("d", "f")):
        with pytest.raises(TypeError):
            numbers.check_operands(df, a, "*", b)
    numbers.check_operands(df, "i", "+", "d")
