"""Registered queries: message text, chunks, mentions and timeout rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import groups as G
from tidewatch.operators import messages as M
from tidewatch.operators.rules import Rule, Target
from tidewatch.plans.derived import NOW, ctes, frame, record_frame
from tidewatch.plans.registry import query
from tidewatch.session import table

BASE = "https://watch.example"


@query(
    "m1_private_template",
    """SELECT c_custkey, '客户 ' || replace(c_name, '#', '\\#') || ' { ' || c_mktsegment || ' } ' || CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END
        || chr(10) || '[查看](https://watch.example/#records/' || c_custkey || ')' AS text FROM customer""",
)
def m1(spark, sf):
    df = table(spark, sf, "customer")
    values = {
        "name": F.col("c_name"), "segment": F.col("c_mktsegment"),
        "nation": F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")),
    }
    url = F.concat(F.lit(f"{BASE}/#records/"), F.col("c_custkey").cast("string"))
    text = M.render_private("客户 {name} {{ {segment} }} {nation}\n[查看]({异常记录链接})", values, url)
    return df.select("c_custkey", text.alias("text"))


@query(
    "m2_markdown_escape",
    r"""SELECT event_id, regexp_replace(props || '*_[' || event_type || '](x)<>#+!|`\', '([\\`*_{}\[\]()<>#+!|])', '\\\1', 'g') AS text FROM events""",
)
def m2(spark, sf):
    raw = F.concat(F.col("props"), F.lit("*_["), F.col("event_type"), F.lit("](x)<>#+!|`\\"))
    return table(spark, sf, "events").select("event_id", M.escape_markdown(raw).alias("text"))


GROUPS_SQL = """g AS (SELECT c_mktsegment AS rule_id, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2),
  r AS (SELECT c_mktsegment AS rule_id, c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
  p AS (SELECT r.*, g.n, CAST(floor(i / 20) + 1 AS INTEGER) AS part_index, CAST(ceil(n / 20) AS INTEGER) AS total_parts FROM r JOIN g USING (rule_id, c_nationkey))"""


def customer_groups(spark, sf):
    """Customers as group members: one group per segment and nation."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("c_nationkey"))
    df = table(spark, sf, "customer").withColumn("detected_at", at)
    details = F.to_json(
        F.struct(
            F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
            F.when(F.col("c_acctbal") > 0, F.concat(F.lit("p"), (F.col("c_custkey") % 7).cast("string"))).alias("owner"),
        )
    )
    rows = df.select(
        F.col("c_mktsegment").alias("rule_id"), "detected_at", F.col("c_custkey").alias("position"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("anomaly_id"), F.lit("pending").alias("status"),
        F.concat(F.lit('{"id": '), F.col("c_custkey").cast("string"), F.lit("}")).alias("business_key"), details.alias("row_details"),
        "c_nationkey",
    )
    groups = rows.groupBy("rule_id", "detected_at", "c_nationkey").agg(F.count("*").alias("matched_rows")).select(
        "rule_id", "detected_at", F.concat("rule_id", F.lit("-"), F.col("c_nationkey").cast("string")).alias("run_id"),
        F.concat(F.lit("Rule "), "rule_id").alias("rule_name"), (F.col("matched_rows") + 5).alias("scanned_rows"),
        "matched_rows", F.col("matched_rows").alias("new_anomalies"),
    )
    return groups, rows.drop("c_nationkey")


def content(payload, path):
    return F.get_json_object(payload, "$.content.post.zh-CN." + path)


@query(
    "m3_group_list_template",
    f"""WITH {GROUPS_SQL} SELECT rule_id || '-' || c_nationkey AS run_id, part_index,
        '涉及 ' || string_agg(c_name, '、' ORDER BY i) || ' 共享 ' || any_value(rule_id) AS text FROM p GROUP BY rule_id, c_nationkey, part_index""",
)
def m3(spark, sf):
    groups, rows = customer_groups(spark, sf)
    template = "涉及 {name列表} 共享 {segment列表}\n[打开]({异常记录组链接})"
    out = G.group_messages(groups, rows, G.mentions(rows, []), BASE, template, ["name", "segment", "owner"])
    return out.select("run_id", "part_index", content("payload", "content[0][0].text").alias("text"))


@query(
    "m4_line_nodes",
    f"""WITH {GROUPS_SQL} SELECT DISTINCT rule_id || '-' || c_nationkey AS run_id, part_index, 'text' AS first_tag, '组：' AS first_text, 'a' AS link_tag, '打开' AS link_text,
        '{BASE}/#anomaly-groups/' || rule_id || '-' || c_nationkey AS href, 'https://help.example/x' AS help FROM p""",
)
def m4(spark, sf):
    groups, rows = customer_groups(spark, sf)
    template = "组：[打开]({异常记录组链接}) {segment列表}\n[帮助](https://help.example/x)"
    out = G.group_messages(groups, rows, G.mentions(rows, []), BASE, template, ["segment"])
    return out.select(
        "run_id", "part_index", content("payload", "content[0][0].tag").alias("first_tag"), content("payload", "content[0][0].text").alias("first_text"),
        content("payload", "content[0][1].tag").alias("link_tag"), content("payload", "content[0][1].text").alias("link_text"),
        content("payload", "content[0][1].href").alias("href"), content("payload", "content[1][0].href").alias("help"),
    )


@query(
    "m6_chunks_of_twenty",
    f"""WITH {GROUPS_SQL} SELECT DISTINCT rule_id || '-' || c_nationkey AS run_id, part_index, total_parts,
        '【情况播报】Rule ' || rule_id || CASE WHEN total_parts > 1 THEN '（' || part_index || '/' || total_parts || '）' ELSE '' END AS title FROM p""",
)
def m6(spark, sf):
    groups, rows = customer_groups(spark, sf)
    return G.group_messages(groups, rows, G.mentions(rows, []), BASE).select("run_id", "part_index", "total_parts", "title")


MENTIONS = [Target("literal", value=" boss "), Target("field", field="owner"), Target("literal", value="p3")]


@query(
    "m7_mentions",
    """WITH m AS (SELECT c_mktsegment || '-' || c_nationkey AS run_id, 'boss' AS user_id, 0 AS rank, 0 AS place FROM customer
          UNION ALL SELECT c_mktsegment || '-' || c_nationkey, 'p' || (c_custkey % 7), 1, c_custkey FROM customer WHERE c_acctbal > 0
          UNION ALL SELECT c_mktsegment || '-' || c_nationkey, 'p3', 2, 0 FROM customer),
        f AS (SELECT run_id, user_id, min((rank, place)) AS first FROM m GROUP BY 1, 2)
        SELECT run_id, string_agg(user_id, ',' ORDER BY first) AS people FROM f GROUP BY run_id""",
)
def m7(spark, sf):
    groups, rows = customer_groups(spark, sf)
    out = G.group_messages(groups, rows, G.mentions(rows, MENTIONS), BASE)
    last = F.from_json(content("payload", "content"), "array<array<struct<tag:string,user_id:string>>>")
    line = F.element_at(last, -1)
    people = F.array_join(F.transform(F.filter(line, lambda n: n["tag"] == "at"), lambda n: n["user_id"]), ",")
    return out.filter("part_index = 1").select("run_id", people.alias("people"))


@query(
    "m8_default_group_text",
    f"""WITH {GROUPS_SQL} SELECT rule_id || '-' || c_nationkey AS run_id, part_index,
        '规则：Rule ' || rule_id || chr(10) || '检测时间：' || strftime(TIMESTAMP '2024-01-01' + to_days(c_nationkey), '%Y-%m-%d %H:%M:%S') || chr(10)
          || '扫描 ' || (n + 5) || ' 条，命中 ' || n || ' 条，新增 ' || n || ' 条' AS head,
        '[待处理] {{"id": ' || min(c_custkey) || '}} ' AS first_record, '{BASE}/#records/c' || min(c_custkey) AS first_link
        FROM p GROUP BY rule_id, c_nationkey, n, part_index""",
)
def m8(spark, sf):
    groups, rows = customer_groups(spark, sf)
    out = G.group_messages(groups, rows, G.mentions(rows, []), BASE)
    return out.select(
        "run_id", "part_index", content("payload", "content[0][0].text").alias("head"),
        content("payload", "content[2][0].text").alias("first_record"), content("payload", "content[2][1].href").alias("first_link"),
    )


@query(
    "m9_private_text_and_card",
    ctes("records")
    + f""" SELECT id, '【数据异常】' || rule_name || chr(10) || '严重程度：' || CASE severity WHEN 'low' THEN '低' WHEN 'medium' THEN '中' ELSE '高' END || chr(10)
        || '数据集：' || dataset_name || chr(10) || '异常主键：' || business_key || chr(10) || '检出时间：' || strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') || chr(10)
        || '异常明细：' || row_details AS text, CASE severity WHEN 'high' THEN 'red' WHEN 'medium' THEN 'yellow' ELSE 'blue' END AS colour,
        '异常告警 · ' || rule_name AS title, '处理 ' || user_id || ' {BASE}/#records/' || id AS body FROM records""",
)
def m9(spark, sf):
    df = record_frame(spark, sf)
    record = {c: F.col(c) for c in ("severity", "rule_name", "dataset_name", "business_key", "first_seen_at", "row_details")}
    url = F.concat(F.lit(f"{BASE}/#records/"), "id")
    markdown = M.render_private("处理 {user_id} {异常记录链接}", {"user_id": F.col("user_id")}, url)
    card = M.private_card(record, markdown)
    return df.select(
        "id", M.private_text(record).alias("text"), F.get_json_object(card, "$.header.template").alias("colour"),
        F.get_json_object(card, "$.header.title.content").alias("title"), F.get_json_object(card, "$.body.elements[0].content").alias("body"),
    )


@query(
    "m11_deadline_label",
    ctes("records")
    + """ SELECT id, CASE WHEN validation_deadline IS NOT NULL THEN strftime(validation_deadline, '%Y-%m-%d %H:%M:%S') WHEN deadline_seconds_snapshot IS NULL THEN '—'
        ELSE '首次推送成功后 ' || (d // 86400) || ' 天 ' || (d % 86400 // 3600) || ' 小时 ' || (d % 3600 // 60) || ' 分钟 ' || (d % 60) || ' 秒' END AS label
        FROM (SELECT *, deadline_seconds_snapshot * 31 + user_id AS d FROM records)""",
)
def m11(spark, sf):
    seconds = F.col("deadline_seconds_snapshot") * 31 + F.col("user_id")
    return record_frame(spark, sf).select("id", M.deadline_label(F.col("validation_deadline"), seconds).alias("label"))


@query(
    "d15_situation_broadcasts",
    ctes("groups", "members")
    + """, n AS (SELECT rule_id, detected_at, count(*) AS c FROM members WHERE is_new GROUP BY 1, 2)
        SELECT g.run_id, CAST(ceil(n.c / 20) AS INTEGER) AS parts, 'situation' AS broadcast_kind, 'pending' AS status FROM groups g JOIN n USING (rule_id, detected_at) WHERE g.new_anomalies > 0""",
)
def d15(spark, sf):
    rule = Rule("any", [], [], group_broadcast_enabled=True, group_webhook_url="https://hooks.example/s")
    groups = frame(spark, sf, "groups")
    out = G.situation_messages(groups, frame(spark, sf, "members"), record_frame(spark, sf), rule, BASE, [])
    named = out.join(groups.select("rule_id", "detected_at", "run_id"), ["rule_id", "detected_at"])
    return named.groupBy("run_id", "broadcast_kind", "status").agg(F.count("*").cast("int").alias("parts"))


DUE_SQL = (
    ctes("records", "members", "groups", "requests", "broadcasts")
    + f""", waiting AS (SELECT m.*, r.status, r.validation_deadline, r.id, r.user_id, g.timeout_enabled, g.timeout_webhook, g.run_id
        FROM members m JOIN records r ON r.id = m.anomaly_id JOIN groups g ON g.rule_id = m.rule_id AND g.detected_at = m.detected_at
        WHERE m.is_new AND m.timeout_notified_at IS NULL AND g.timeout_processed_at IS NULL),
      due AS (SELECT *, timeout_enabled AND coalesce(timeout_webhook, '') <> '' AS sends FROM waiting WHERE validation_deadline <= TIMESTAMP '{NOW}' AND status <> 'resolved'),
      picked AS (SELECT rule_id, detected_at FROM due GROUP BY 1, 2 ORDER BY min(validation_deadline), rule_id, detected_at LIMIT 50)"""
)


def scan(spark, sf):
    return G.timeout_scan(
        frame(spark, sf, "groups"), frame(spark, sf, "members"), record_frame(spark, sf), frame(spark, sf, "requests"),
        frame(spark, sf, "broadcasts"), NOW, 50, [Target("field", field="owner"), Target("literal", value="boss")],
    )


@query(
    "d14_timeout_rounds",
    DUE_SQL
    + """ SELECT d.run_id, count(*) AS member_count, coalesce((SELECT max(round_index) FROM broadcasts b WHERE b.rule_id = d.rule_id AND b.detected_at = d.detected_at
          AND b.broadcast_kind = 'timeout'), 0) + 1 AS round_index, any_value(d.timeout_webhook) AS webhook_url
        FROM due d JOIN picked p USING (rule_id, detected_at) WHERE d.sends GROUP BY d.run_id, d.rule_id, d.detected_at""",
)
def d14_rounds(spark, sf):
    named = frame(spark, sf, "groups").select("rule_id", "detected_at", "run_id")
    return scan(spark, sf).rounds.join(named, ["rule_id", "detected_at"]).select("run_id", "member_count", "round_index", "webhook_url")


@query(
    "d14_timeout_expired_members",
    DUE_SQL + " SELECT d.anomaly_id AS id FROM due d JOIN picked p USING (rule_id, detected_at) WHERE d.status <> 'timed_out'",
)
def d14_expired(spark, sf):
    return scan(spark, sf).expired


@query(
    "d14_timeout_mentions",
    DUE_SQL
    + """, s AS (SELECT d.* FROM due d JOIN picked p USING (rule_id, detected_at) WHERE d.sends)
        SELECT run_id, user_id, min(rank) AS rank FROM (SELECT s.run_id, q.recipient_user_id AS user_id, -1 AS rank FROM s JOIN requests q ON q.anomaly_id = s.anomaly_id
          UNION ALL SELECT run_id, concat('u', user_id), 0 FROM s UNION ALL SELECT run_id, 'boss', 1 FROM s) GROUP BY run_id, user_id""",
)
def d14_mentions(spark, sf):
    named = frame(spark, sf, "groups").select("rule_id", "detected_at", "run_id")
    return scan(spark, sf).mentions.join(named, ["rule_id", "detected_at"]).select("run_id", "user_id", "rank")


@query(
    "d14_timeout_closed_groups",
    DUE_SQL
    + f""" SELECT w.run_id FROM waiting w JOIN picked p USING (rule_id, detected_at) GROUP BY w.run_id
        HAVING NOT bool_or(w.timeout_enabled) OR count(*) FILTER (WHERE w.status <> 'resolved' AND NOT coalesce(w.validation_deadline <= TIMESTAMP '{NOW}'
          AND w.timeout_enabled AND coalesce(w.timeout_webhook, '') <> '', false)) = 0""",
)
def d14_closed(spark, sf):
    named = frame(spark, sf, "groups").select("rule_id", "detected_at", "run_id")
    return scan(spark, sf).closed.join(named, ["rule_id", "detected_at"]).select("run_id")


@query(
    "d14_timeout_messages",
    DUE_SQL
    + """, s AS (SELECT run_id, rule_id, detected_at, count(*) AS n FROM due JOIN picked USING (rule_id, detected_at) WHERE sends GROUP BY 1, 2, 3)
        SELECT run_id, i AS part_index, '已超时未解决：' || n || ' 条，请相关处理人尽快处理。' AS head,
          '【超时播报】Rule ' || substr(rule_id, 6) || CASE WHEN n > 20 THEN '（' || i || '/' || CAST(ceil(n / 20) AS INTEGER) || '）' ELSE '' END AS title
        FROM s, LATERAL (SELECT unnest(range(1, CAST(ceil(n / 20) AS BIGINT) + 1)) AS i)""",
)
def d14_messages(spark, sf):
    found = scan(spark, sf)
    groups = frame(spark, sf, "groups").join(found.rounds.select("rule_id", "detected_at"), ["rule_id", "detected_at"], "left_semi")
    out = G.group_messages(groups, found.rows, found.mentions, BASE, kind="timeout")
    return out.select("run_id", "part_index", content("payload", "content[0][0].text").alias("head"), "title")
