import pytest
from pyspark.sql import functions as F

from sheetwright.functions import addressing as A
from sheetwright.plans.expressions import compile_field, is_interpolation, order, references
from sheetwright.plans.template import TemplateError, fields_table, template


def made(**versions):
    return template({"name": "t", "discriminator": {"cells": ["A1"]}, "versions": versions})


def test_letters_round_trip(spark):
    rows = spark.range(1, 18278).select(F.col("id").cast("int").alias("i")).withColumn("l", A.index_to_letters(F.col("i"))).withColumn("b", A.letters_to_index(F.col("l")))
    assert rows.filter("b <> i OR b IS NULL").count() == 0
    assert [(A.column_letters(n), A.column_number(A.column_letters(n))) for n in (1, 26, 27, 52, 53, 703)] == [("A", 1), ("Z", 26), ("AA", 27), ("AZ", 52), ("BA", 53), ("AAA", 703)]


def test_references(spark):
    rows = spark.createDataFrame([("b3",), ("Sheet2!B3",), ("123",), ("A",), ("",), (None,)], "r string").select(A.parse_cell(F.col("r")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in rows] == [(None, 3, 2), ("Sheet2", 3, 2), (None, None, None), (None, None, None), (None, None, None), (None, None, None)]
    rows = spark.createDataFrame([("Sheet2!A1:D",), ("A1:D9",), ("A1",)], "r string").select(A.parse_range(F.col("r")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in rows] == [("Sheet2", 1, 1, None, 4), (None, 1, 1, 9, 4), (None, None, None, None, None)]
    for bad in ("123", "A", "", "A1B:", "A0"):
        with pytest.raises(ValueError):
            A.area(bad)


def test_inheritance():
    t = made(a={"fields": {"x": {"cell": "A1", "type": "int"}, "y": {"cell": "B1"}}, "validation": {"x": {"min": 1}}}, b={"extends": "a", "fields": {"y": {"cell": "B2"}}, "validation": {"x": {"min": 9}}}, c={"extends": "b", "fields": {"z": {"range": "A1:A"}}})
    assert list(t.versions["c"]) == ["x", "y", "z"]
    assert t.versions["c"]["y"].start_row == 2 and t.versions["c"]["x"].low == 1 and t.versions["c"]["z"].type == "list[str]"
    assert [f.dataType.simpleString() for f in t.struct("c")] == ["bigint", "string", "array<string>"]
    with pytest.raises(TemplateError, match="cycle"):
        made(a={"extends": "b"}, b={"extends": "a"})
    with pytest.raises(TemplateError, match="unknown parent"):
        made(a={"extends": "z"})
    with pytest.raises(TemplateError, match="unknown type"):
        made(a={"fields": {"x": {"cell": "A1", "type": "decimal"}}})
    with pytest.raises(TemplateError):
        template({"name": "t", "versions": {"a": {}}, "discriminator": {}})


def test_fields_table(spark):
    t = made(v={"fields": {"h": {"cell": "Cover!footer:first:center"}, "x": {"computed": "{h}"}}})
    rows = {r.field: r for r in fields_table(spark, [t]).collect()}
    assert (rows["h"].ref_kind, rows["h"].f_sheet, rows["h"].edge_kind, rows["h"].edge_page, rows["h"].edge_section) == ("edge", "Cover", "footer", "first", "center")
    assert rows["x"].type == "any"


@pytest.mark.parametrize(("text", "value"), [
    ("{a} + {b}", 7), ("{a} / {b}", 2.5), ("{b} ** 2", 4.0), ("{a} // {b}", 2), ("-{a} % {b}", 1), ("({a} - {b}) * 2", 6), ("{s} + '!'", "x!"), ("1 if {a} > 3 else 0", 1),
    ("sum({l})", 6.0), ("len({l})", 3), ("max({l})", 3.0), ("round({a} / 3, 2)", 1.67), ("{a} if {n} == 1 else {b}", 2), ("abs({b} - {a})", 3), ("{a} > 1 and {b} > 5", False), ("not {a}", False),
    ("{a} + {n}", None), ("{a} / ({b} - 2)", None), ("{a} / {zero} if {zero} else 0", 0),
])
def test_expressions(spark, text, value):
    rows = spark.sql("SELECT 5L AS a, 2L AS b, 'x' AS s, array(1.0D, 2.0D, 3.0D) AS l, CAST(NULL AS BIGINT) AS n, 0L AS zero")
    made_ = compile_field(text, {"a": "int", "b": "int", "s": "str", "l": "list", "n": "int", "zero": "int"})
    row = rows.select(F.when(~made_.error, made_.column).alias("v")).first()
    assert row.v == value


def test_interpolation_and_order(spark):
    assert is_interpolation("{a} {b}") and not is_interpolation("{a}") and not is_interpolation("{a}, {b}")
    row = spark.sql("SELECT 'x' AS a, CAST(NULL AS STRING) AS b").select(compile_field("{a} {b}", {"a": "str", "b": "str"}).column.alias("v")).first()
    assert row.v == "x " and references("{b} {a} {b}") == ["b", "a"]
    t = made(v={"fields": {"c": {"computed": "{b} + 1"}, "b": {"computed": "{a} * 2"}, "a": {"cell": "A1", "type": "int"}}})
    assert [f.name for f in order(list(t.versions["v"].values()))] == ["b", "c"]
    with pytest.raises(TemplateError, match="depend"):
        order(list(made(v={"fields": {"a": {"computed": "{b} + 1"}, "b": {"computed": "{a} + 1"}}}).versions["v"].values()))
    for bad in ("__import__('os')", "{a}.real", "open('x')", "[x for x in {a}]", "{s} * 2"):
        with pytest.raises(TemplateError):
            compile_field(bad, {"a": "int", "s": "str"})
