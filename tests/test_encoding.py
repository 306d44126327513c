from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import encoding as E


def test_operation_flags(spark):
    rows = spark.createDataFrame([(42, k) for k in ("insert", "update_before", "update_after", "delete")], "id int, row_kind string")
    kept = E.encode_operations(rows, ignore_update_before=False)
    assert sorted(r["__op"] for r in kept.collect()) == [0, 0, 1, 1]
    assert sorted(r["__op"] for r in E.encode_operations(rows).collect()) == [0, 0, 1]
    assert E.encode_operations(rows, has_primary_key=False).count() == 2


def test_separators():
    assert E.separator(None) == "\t" and E.separator("") == "\t" and E.separator("|") == "|"
    assert E.separator("\\x01") == "\x01" and E.separator("\\X2c20") == ", "
    for bad in ("\\x", "\\x0", "\\xzz"):
        with pytest.raises(ValueError):
            E.separator(bad)


def test_lines(spark):
    row = (1, None, True, date(2026, 1, 2), datetime(2026, 1, 2, 3, 4), datetime(2026, 1, 2, 3, 4, 5, 120000), [1, 2], {"k": "v"}, (7,), '{"a": 1}', "plain")
    df = spark.createDataFrame(
        [row],
        "i int, n string, b boolean, d date, t timestamp_ntz, f timestamp_ntz, a array<int>, m map<string,string>, s struct<x:int>, j string, p string",
    )
    assert E.text_lines(df, "|").first().value == '1|\\N|1|2026-01-02|2026-01-02T03:04|2026-01-02T03:04:05.120|[1,2]|{"k":"v"}|{"x":7}|{"a": 1}|plain'
    line = E.json_lines(df, ["j", "p"]).first().value
    assert line == (
        '{"i":1,"b":1,"d":"2026-01-02","t":"2026-01-02T03:04","f":"2026-01-02T03:04:05.120","a":[1,2],"m":{"k":"v"},"s":{"x":7},"j":{"a":1},"p":"plain"}'
    )


def test_binary_as_number(spark):
    df = spark.range(1).select(F.unhex(F.lit("0102")).alias("b"))
    assert E.text_lines(df).first().value == "258"


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    target = [{"name": "ID", "type": "bigint", "key": True}, {"name": "name", "type": "varchar"}, {"name": "extra", "type": "json"}]
    assert E.check_sink_schema(df, target, ["Id"]) is False
    plain = [{"name": "id", "type": "int"}, {"name": "name", "type": "json"}]
    assert E.check_sink_schema(df, plain, None) is True
    for bad_target, key in [(target, None), (target, ["name"]), (plain[:1], None), ([{"name": "id", "type": "date"}, plain[1]], None), ([], None)]:
        with pytest.raises(E.SchemaMismatch):
            E.check_sink_schema(df, bad_target, key)


def test_key_change_deletes_the_old_key(spark):
    rows = [("u", (1, "a"), (2, "a")), ("u", (3, "a"), (3, "b")), ("c", None, (4, "a")), ("d", (5, "a"), None)]
    df = spark.createDataFrame(rows, "op string, before struct<id:int,v:string>, after struct<id:int,v:string>")
    out = E.encode_operations(E.key_change_rows(df, "id"), ignore_update_before=False)
    assert sorted((r.id, r["__op"]) for r in out.collect()) == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
