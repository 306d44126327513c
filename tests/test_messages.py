import pytest
from pyspark.sql import functions as F

from tidewatch.operators import messages as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_values_are_escaped_and_braces_kept(spark):
    value = "皖A[危险](https://evil.example)"
    text = M.render_private("{{阈值}} {plate} {none}", {"plate": F.lit(value), "none": F.lit(None)}, F.lit("u"))
    assert one(spark, text) == r"{阈值} 皖A\[危险\]\(https://evil.example\) "


def test_record_link(spark):
    text = M.render_private("[看]({异常记录链接})", {}, F.lit("https://w.example/#records/1"))
    assert one(spark, text) == "[看](https://w.example/#records/1)"


def test_list_values_are_distinct_in_first_seen_order(spark):
    values = F.array(*[F.lit(v) for v in ("皖A001", "皖A002", "皖A001", None, "  ")])
    assert one(spark, M.list_text(values)) == "皖A001、皖A002"


@pytest.mark.parametrize(
    "template",
    ["", "  ", "{unknown}", "{open", "close}", "{异常记录组链接}", "{plate列表}", "[x](http://a.example)", "[x]({plate})", "[x](https://u:p@a.example)"],
)
def test_bad_private_templates(template):
    with pytest.raises(M.TemplateError):
        M.check_private_template(template, ["plate"])


@pytest.mark.parametrize("template", ["{plate}", "{异常记录链接}", "{other列表}", "[x]({plate列表})", "[x]("])
def test_bad_group_templates(template):
    with pytest.raises(M.TemplateError):
        M.check_group_template(template, ["plate"])


def test_group_lines(spark):
    lines = M.render_group_lines("组 [开]({异常记录组链接})：{plate列表}\n\n完", {"plate": F.array(F.lit("a"), F.lit("b"))}, F.lit("https://g"))
    got = one(spark, lines)
    assert [[(n.tag, n.text, n.href) for n in line] for line in got] == [
        [("text", "组 ", None), ("a", "开", "https://g"), ("text", "：a、b", None)],
        [("text", "", None)],
        [("text", "完", None)],
    ]


def test_deadline_labels(spark):
    at = F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    assert one(spark, M.deadline_label(at, F.lit(1))) == "2026-01-02 03:04:05"
    assert one(spark, M.deadline_label(none, F.lit(90061))) == "首次推送成功后 1 天 1 小时 1 分钟 1 秒"
    assert one(spark, M.deadline_label(none, F.lit(None).cast("int"))) == "—"
