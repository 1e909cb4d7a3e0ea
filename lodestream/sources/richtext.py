"""Rich text as trees: nodes of any depth are taken apart level by level and rendered from the leaves up.

A tree is a VARIANT. Each level is a table of nodes (id, path, fields) whose children are the rows of the next; a path
is the positions from the root, so it orders a tree and names a node's parent. Rendering joins each level with the
ordered texts of the next. Work is linear in nodes, with two small jobs a level; nothing is walked in Python, and no level is broadcast.
Most trees are shallow: these are rendered in their row by functions on arrays, without a join or a table between; only deeper ones are taken apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.storage import discard, merged, written

#: A tree that is deeper than this is an error: it is no text.
MOST_LEVELS = 200
#: Levels below its root of a tree that is rendered in its row.
ROW_LEVELS = 5
# Node types of documents that end in a line feed, how deep child blocks of a page are taken, and pages that are only named.
BLOCKS = ["paragraph", "heading", "bulletList", "orderedList", "listItem", "codeBlock"]
PAGE_DEPTH = 5
NAMED_PAGES = {"child_page": ("- 📄 [", "(untitled)"), "child_database": ("- 🗃 [", "(untitled database)")}


def text_at(v: Column, path: str) -> Column:
    """The string, number or flag at a path of a variant, else null."""
    return F.try_variant_get(v, path, "string")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def children_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def none() -> Column:
    return F.array().cast("array<variant>")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), 0)


def deeper(v: Column, children: Callable[[Column], Column], levels: int = ROW_LEVELS) -> Column:
    """Whether a tree has more levels below its root."""
    own = F.coalesce(children(v), none())
    return F.exists(own, lambda c: deeper(c, children, levels - 1)) if levels else F.size(own) > 0


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def levels(roots: DataFrame, fields: Callable[[Column], dict[str, Column]], children: Callable[[Column], Column]) -> list[DataFrame]:
    """Tables of nodes (id, path, fields) by depth, from roots (id, node), whose ids differ. Empty levels end the list."""
    out = []
    own = lambda rows: rows.select("id", "path", *[c.alias(k) for k, c in fields(F.col("node")).items()], children(F.col("node")).alias("children"))
    rows = roots.select("id", F.array().cast("array<int>").alias("path"), "node")
    while True:
        level = written(own(rows))
        if level.isEmpty():
            discard(level)
            return out
        if len(out) == MOST_LEVELS:
            raise ValueError(f"a tree has more than {MOST_LEVELS} levels")
        out.append(level)
        rows = level.select("id", "path", F.posexplode("children").alias("at", "node")).select("id", F.concat("path", F.array("at")).alias("path"), "node")


def render(levels_: list[DataFrame], value: Callable[[Column], Column], kind: str) -> DataFrame:
    """(id, value) of the roots, a written table: value takes the ordered array of the children's values; kind is its type."""
    below, steps = None, []
    for n, level in enumerate(reversed(levels_)):
        if n and n % 8 == 0:  # keeps the plan of a deep tree short
            below = written(below)
            steps.append(below)
        none = F.array().cast(f"array<{kind}>")
        if below is None:
            met = level.withColumn("below", none)
        else:
            parent = below.select("id", F.slice("path", 1, F.size("path") - 1).alias("path"), F.element_at("path", -1).alias("at"), "value")
            lists = parent.groupBy("id", "path").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("rows"))
            met = level.join(merged(lists.select("id", "path", F.col("rows")["value"].alias("below"))), ["id", "path"], "left").withColumn("below", F.coalesce("below", none))
        below = met.select("id", "path", value(F.col("below")).alias("value"))
    out = written(below.select("id", "value"))
    discard(*steps)
    return out


def document_children(v: Column) -> Column:
    return F.when(F.coalesce(text_at(v, "$.type"), F.lit("")) != "text", children_at(v, "$.content"))


def document_text(v: Column, levels: int = ROW_LEVELS) -> Column:
    """The text that document_texts() gives a tree that is not deeper; empty where that has none."""

    def value(v: Column, left: int) -> Column:
        below = F.transform(F.coalesce(children_at(v, "$.content"), none()), lambda c: value(c, left - 1)) if left else F.array().cast("array<string>")
        joined = lambda kind: let(below, lambda b: F.when(kind.isin(BLOCKS), F.concat(F.array_join(F.filter(b, lambda x: x != ""), "\n"), F.lit("\n"))).otherwise(F.array_join(b, "")))
        return let(text_at(v, "$.type"), lambda kind: F.when(kind == "text", F.coalesce(text_at(v, "$.text"), F.lit(""))).when(kind.isNull() & is_string(v), v.cast("string")).otherwise(joined(kind)))

    return strip(value(v, levels))


def document_texts(roots: DataFrame) -> DataFrame:
    """(id, text) of rich-text documents (id, node): text nodes in order; blocks put their parts on lines and end in a line feed.

    A node that is a string is its own text. Null and other nodes have no text. White space at both ends goes.
    """

    def fields(v: Column) -> dict[str, Column]:
        kind = text_at(v, "$.type")
        return {"type": kind, "own": F.when(is_string(v), v.cast("string")).when(kind == "text", F.coalesce(text_at(v, "$.text"), F.lit("")))}

    def value(below: Column) -> Column:
        lines = F.concat(F.array_join(F.filter(below, lambda x: x != ""), "\n"), F.lit("\n"))
        return F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("type").isin(BLOCKS), lines).otherwise(F.array_join(below, ""))

    own = levels(roots.where(F.col("node").isNotNull()), fields, document_children)
    if not own:
        return roots.select("id", F.lit("").alias("text")).limit(0)
    out = render(own, value, "string")
    discard(*own)
    return out.select("id", strip(F.col("value")).alias("text"))


def _rich(v: Column, path: str) -> Column:
    """The plain text of a list of rich-text pieces."""
    return F.coalesce(F.array_join(F.transform(children_at(v, path), lambda t: F.coalesce(text_at(t, "$.plain_text"), F.lit(""))), ""), F.lit(""))


def _block_line(v: Column, kind: Column) -> Column:
    """The line of a block, or null if it has none."""
    own = F.coalesce(F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), kind), v)
    text = F.coalesce(F.nullif(_rich(own, "$.rich_text"), F.lit("")), text_at(v, "$.text"), F.lit(""))
    out = F.when(kind == "paragraph", text)
    for k, mark in {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> "}.items():
        out = out.when(kind == k, F.concat(F.lit(mark), text))
    out = out.when(kind == "to_do", F.concat(F.lit("- ["), F.when(F.coalesce(F.try_variant_get(own, "$.checked", "boolean"), F.lit(False)), "x").otherwise(" "), F.lit("] "), text))
    out = out.when(kind == "toggle", F.concat(F.lit("<details><summary>"), text, F.lit("</summary></details>")))
    out = out.when(kind == "code", F.concat(F.lit("```"), F.coalesce(text_at(own, "$.language"), F.lit("")), F.lit("\n"), text, F.lit("\n```")))
    out = out.when(kind == "divider", F.lit("---"))
    out = out.when(kind == "callout", F.concat(F.lit("> "), F.coalesce(text_at(own, "$.icon.emoji"), F.lit("")), F.lit(" "), text))
    cells = F.transform(F.coalesce(children_at(own, "$.cells"), F.array().cast("array<variant>")), lambda c: _rich(c, "$"))
    out = out.when(kind == "table_row", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")))
    for k, (mark, untitled) in NAMED_PAGES.items():
        out = out.when(kind == k, F.concat(F.lit(mark), F.coalesce(text_at(own, "$.title"), F.lit(untitled)), F.lit("]")))
    return out.otherwise(F.nullif(text, F.lit("")))


def page_children(v: Column) -> Column:
    return F.when(~F.coalesce(text_at(v, "$.type"), F.lit("")).isin(list(NAMED_PAGES)), children_at(v, "$.children"))


def page_text(blocks: Column, levels: int = ROW_LEVELS) -> Column:
    """The text that page_texts() gives a page without a title whose blocks are not deeper than so many levels, themselves included; PAGE_DEPTH at most."""

    def value(v: Column, left: int) -> Column:
        line = let(F.coalesce(text_at(v, "$.type"), F.lit("")), lambda kind: _block_line(v, kind))
        own = F.filter(F.array(line), lambda x: x.isNotNull())
        if not left:
            return own
        inner = F.array_join(F.flatten(F.transform(F.coalesce(page_children(v), none()), lambda c: value(c, left - 1))), "\n\n")
        return F.concat(own, F.filter(F.array(inner), lambda x: strip(x) != ""))

    return F.array_join(F.flatten(F.transform(F.coalesce(blocks, none()), lambda b: value(b, levels - 1))), "\n\n")


def page_texts(pages: DataFrame) -> DataFrame:
    """(id, text): Markdown of pages (id, title, blocks: an array of variants); a block may have children, which follow it.

    Blocks stand apart by an empty line. Pages and databases inside a page are named only.
    """
    root = F.to_variant_object(F.struct(F.lit("root").alias("type"), F.coalesce("blocks", F.array().cast("array<variant>")).alias("children")))

    def fields(v: Column) -> dict[str, Column]:
        kind = F.coalesce(text_at(v, "$.type"), F.lit(""))
        return {"type": kind, "line": F.when(kind != "root", _block_line(v, kind))}

    def value(below: Column) -> Column:
        inner = F.array_join(F.flatten(below), "\n\n")
        too_deep = F.size("path") > PAGE_DEPTH
        deeper = F.when((strip(inner) != "") & ~too_deep, F.array(inner)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.when(F.col("line").isNotNull(), F.array("line")).otherwise(F.array().cast("array<string>")), F.when(F.col("type") == "root", F.flatten(below)).otherwise(deeper))

    own = levels(pages.select("id", root.alias("node")), fields, page_children)
    if not own:
        return pages.select("id", F.lit("").alias("text")).limit(0)
    lines = render(own, value, "array<string>").join(merged(pages.select("id", "title")), "id")
    discard(*own)
    title = F.when(F.coalesce("title", F.lit("")) != "", F.array(F.concat(F.lit("# "), "title"))).otherwise(F.array().cast("array<string>"))
    return lines.select("id", F.array_join(F.concat(title, "value"), "\n\n").alias("text"))
