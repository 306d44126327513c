"""Message text as columns: templates, escaping, lists and deadline labels.

A template is read once on the driver into literal and parameter pieces; per row
it is only string concatenation over built-in functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.values import clean_text

# Template parameters, the list suffix and the joiner.
RECORD_LINK = "异常记录链接"
GROUP_LINK = "异常记录组链接"
LIST_SUFFIX = "列表"
LIST_JOINER = "、"

# Characters a Markdown value gets a backslash before.
MARKDOWN_SPECIAL = r"([\\`*_{}\[\]()<>#+!|])"

# Status and severity labels and header colours.
STATUS_LABELS = {"pending": "待处理", "processing": "处理中", "timed_out": "已超时", "resolved": "已解决"}
SEVERITY_LABELS = {"low": "低", "medium": "中", "high": "高"}
SEVERITY_COLOURS = {"high": "red", "medium": "yellow", "low": "blue"}

_CUSTOM_TARGET = re.compile(r"https://[^/@\s?#]+([/?#]\S*)?")


class TemplateError(ValueError):
    """A template is empty, unbalanced or names an unknown parameter."""


@dataclass(frozen=True)
class Piece:
    text: str
    is_parameter: bool = False


@dataclass(frozen=True)
class Node:
    """Part of a message line: text pieces, or a link with a label and target."""

    pieces: tuple[Piece, ...]
    href: tuple[Piece, ...] | None = None


def read_pieces(text: str) -> tuple[Piece, ...]:
    """Split text into literals and ``{name}`` parameters; doubled braces are literal."""
    pieces: list[Piece] = []
    literal, name = "", None
    i = 0
    while i < len(text):
        two, one = text[i : i + 2], text[i]
        if two in ("{{", "}}"):
            if name is not None:
                raise TemplateError(f"unknown template parameter: {name}{one}")
            literal, i = literal + one, i + 2
            continue
        if one == "{":
            if name is not None:
                raise TemplateError("unbalanced braces in template")
            name = ""
        elif one == "}":
            if not name:
                raise TemplateError("unbalanced braces in template")
            if literal:
                pieces.append(Piece(literal))
            pieces.append(Piece(name, True))
            literal, name = "", None
        elif name is not None:
            name += one
        else:
            literal += one
        i += 1
    if name is not None:
        raise TemplateError("unbalanced braces in template")
    if literal:
        pieces.append(Piece(literal))
    return tuple(pieces)


def read_nodes(line: str) -> tuple[Node, ...]:
    """One pass over a line: links (``[label](target)``) and the text between them."""
    nodes: list[Node] = []
    text, rest = "", line
    while rest:
        before, bracket, rest = rest.partition("[")
        text += before
        if not bracket:
            break
        label, opened, after = rest.partition("](")
        if not opened or not label or "]" in label:
            text += bracket
            continue
        target, closed, rest = after.partition(")")
        if not closed or not target:
            raise TemplateError("incomplete link in template")
        if text:
            nodes.append(Node(read_pieces(text)))
        nodes.append(Node(read_pieces(label), read_pieces(target)))
        text = ""
    if text or not nodes:
        nodes.append(Node(read_pieces(text)))
    return tuple(nodes)


def label_text(node: Node) -> str:
    """A link's label as written: parameters are not filled in."""
    return "".join("{" + p.text + "}" if p.is_parameter else p.text for p in node.pieces)


def _checked(template: str, allowed: set[str], link_name: str) -> list[tuple[Node, ...]]:
    """Lines of a template whose parameters are known and whose links lead where they may."""
    if not template or not template.strip():
        raise TemplateError("a template must not be empty")
    lines = [read_nodes(line) for line in template.splitlines()]
    for node in (node for line in lines for node in line):
        for piece in (*node.pieces, *(node.href or ())):
            if piece.is_parameter and piece.text not in allowed:
                raise TemplateError(f"unknown template parameter: {piece.text}")
        if node.href and node.href[0].is_parameter:
            if node.href != (Piece(link_name, True),):
                raise TemplateError("a link may only target the system link parameter")
        elif node.href and not _CUSTOM_TARGET.fullmatch("".join(p.text for p in node.href)):
            raise TemplateError("a custom link must use https")
    return lines


def check_private_template(template: str, field_names: list[str]) -> None:
    _checked(template, {*field_names, RECORD_LINK}, RECORD_LINK)


def check_group_template(template: str, field_names: list[str]) -> None:
    read_lines(template, field_names)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), MARKDOWN_SPECIAL, r"\\$1")


def joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.lit("")


def render_private(template: str, values: dict[str, Column], record_url: Column) -> Column:
    """Per-record Markdown: parameters become escaped values, null becomes empty."""
    check_private_template(template, list(values))
    parts = []
    for piece in read_pieces(template):
        if not piece.is_parameter:
            parts.append(F.lit(piece.text))
        elif piece.text == RECORD_LINK:
            parts.append(record_url)
        else:
            parts.append(escape_markdown(values[piece.text].cast("string")))
    return joined(parts)


def distinct_values(values: Column) -> Column:
    """Distinct non-blank trimmed values of an array, first-seen order."""
    cleaned = F.transform(values, lambda v: clean_text(v))
    return F.array_distinct(F.filter(cleaned, lambda v: v.isNotNull()))


def list_text(values: Column) -> Column:
    return F.array_join(distinct_values(values), LIST_JOINER)


def read_lines(template: str, field_names: list[str]) -> list[tuple[Node, ...]]:
    """Lines of a group template, each split into text and link nodes."""
    return _checked(template, {GROUP_LINK, *[name + LIST_SUFFIX for name in field_names]}, GROUP_LINK)


def text_node(text: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit("text").alias("tag"), text.alias("text"), null.alias("href"), null.alias("user_id"), null.alias("user_name")
    )


def link_node(label: Column, href: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit("a").alias("tag"), label.alias("text"), href.alias("href"), null.alias("user_id"), null.alias("user_name")
    )


def mention_node(user_id: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit("at").alias("tag"),
        null.alias("text"),
        null.alias("href"),
        user_id.alias("user_id"),
        F.lit("相关成员").alias("user_name"),
    )


def render_group_lines(template: str, lists: dict[str, Column], group_url: Column) -> Column:
    """Array of lines, each an array of nodes, for one chunk of records.

    ``lists`` maps field names to the array of the chunk's values in order.
    """

    def text_of(pieces: tuple[Piece, ...]) -> Column:
        parts = []
        for piece in pieces:
            if not piece.is_parameter:
                parts.append(F.lit(piece.text))
            elif piece.text == GROUP_LINK:
                parts.append(group_url)
            else:
                parts.append(list_text(lists[piece.text[: -len(LIST_SUFFIX)]]))
        return joined(parts)

    rendered = []
    for line in read_lines(template, list(lists)):
        nodes = []
        for node in line:
            if node.href is None:
                nodes.append(text_node(text_of(node.pieces)))
            else:
                nodes.append(link_node(F.lit(label_text(node)), text_of(node.href)))
        rendered.append(F.array(*nodes))
    return F.array(*rendered)


def label_of(labels: dict[str, str], key: Column, default: Column) -> Column:
    value = default
    for name, text in reversed(labels.items()):
        value = F.when(key == name, text).otherwise(value)
    return value


def status_label(status: Column) -> Column:
    blank = F.coalesce(F.when(status != "", status), F.lit("未知"))
    return label_of(STATUS_LABELS, status, blank)


def seconds_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def private_text(record: dict[str, Column], title: str = "数据异常") -> Column:
    """Default text of one record."""
    severity = label_of(SEVERITY_LABELS, record["severity"], F.lit(SEVERITY_LABELS["high"]))
    return F.concat(
        F.lit(f"【{title}】"), record["rule_name"],
        F.lit("\n严重程度："), severity,
        F.lit("\n数据集："), record["dataset_name"],
        F.lit("\n异常主键："), record["business_key"],
        F.lit("\n检出时间："), seconds_text(record["first_seen_at"]),
        F.lit("\n异常明细："), record["row_details"],
    )


def private_card(record: dict[str, Column], markdown: Column) -> Column:
    """Card payload of one record: title, colour by severity, Markdown body."""
    colour = label_of(SEVERITY_COLOURS, record["severity"], F.lit("orange"))
    title = F.struct(
        F.lit("plain_text").alias("tag"), F.concat(F.lit("异常告警 · "), record["rule_name"]).alias("content")
    )
    body = F.struct(
        F.array(F.struct(F.lit("markdown").alias("tag"), markdown.alias("content"))).alias("elements")
    )
    return F.to_json(
        F.struct(
            F.lit("2.0").alias("schema"),
            F.struct(title.alias("title"), colour.alias("template")).alias("header"),
            body.alias("body"),
        )
    )


def deadline_label(deadline: Column, seconds: Column) -> Column:
    """Fixed deadline time, else the time span after first delivery, else a dash."""
    def part(value: Column) -> Column:
        return F.floor(value).cast("string")

    span = F.concat(
        F.lit("首次推送成功后 "), part(seconds / 86400), F.lit(" 天 "),
        part(seconds % 86400 / 3600), F.lit(" 小时 "),
        part(seconds % 3600 / 60), F.lit(" 分钟 "),
        part(seconds % 60), F.lit(" 秒"),
    )
    return F.when(deadline.isNotNull(), seconds_text(deadline)).when(seconds.isNull(), F.lit("—")).otherwise(span)
