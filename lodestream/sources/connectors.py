"""Connectors: a registry of readers that turn raw API objects (JSON lines) into documents.

A document has source_type, source_id, title, content, url, author, updated_at. What a connector
fetches over the network lands as JSON lines first; from there on everything is a plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import html_text
from lodestream.operators.storage import discard, merged, written
from lodestream.sources import richtext

COLUMNS = ["source_type", "source_id", "title", "content", "url", "author", "updated_at"]
_REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    def put(reader):
        _REGISTRY[name] = reader
        return reader

    return put


def names() -> list[str]:
    return sorted(_REGISTRY)


def read(name: str, raw: DataFrame, since: Column | None = None) -> DataFrame:
    """Documents of raw (value: one JSON object a row), strictly newer than since. Objects without an id are left out."""
    if name not in _REGISTRY:
        raise ValueError(f"no connector is called {name}; there are {', '.join(names())}")
    docs = _REGISTRY[name](raw).where("source_id is not null and source_id <> ''").select(*COLUMNS)
    return docs if since is None else docs.where(F.col("updated_at") > since)


def _j(path: str) -> Column:
    return F.get_json_object("value", path)


def _time(path: str) -> Column:
    return F.try_to_timestamp(_j(path))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *[F.when(F.length(p) > 0, p) for p in parts])


def _field(label: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(f"**{label}:** "), value))


def _document(kind: str, id_: Column, title: Column, content: Column, url: Column, author: Column, updated: Column):
    values = (F.lit(kind), id_, title, content, url, author, updated)
    return [v.alias(n) for v, n in zip(values, COLUMNS)]


# Fixed value: how many of an issue's last changes are told.
CHANGES = 10


def _with_key(raw: DataFrame) -> DataFrame:
    """raw with a key of each object and the object as a VARIANT; what is no JSON has none."""
    return raw.withColumn("key_", F.md5("value")).withColumn("v_", F.try_parse_json("value"))


def _or(v: Column, path: str, default: str) -> Column:
    return F.coalesce(richtext.text_at(v, path), F.lit(default))


def _deep(rows: DataFrame, deep: Column, texts: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """rows with deep_, and beside deep ones what texts() gives for them by key_; None if there is no deep one."""
    found = written(rows.where(deep).select("key_", "v_").dropDuplicates(["key_"]))
    if found.isEmpty():
        discard(found)
        return None
    out = written(texts(found))
    discard(found)
    return rows.withColumn("deep_", F.coalesce(deep, F.lit(False))).join(merged(out), "key_", "left")


def _issue_texts(rows: DataFrame, nodes: Column) -> DataFrame:
    """(key_, texts): the texts of all rich text of issues (key_, v_) by its place."""
    trees = rows.select("key_", F.posexplode(nodes).alias("part", "node"))
    trees = trees.where(richtext.is_object(F.col("node")) | richtext.is_string(F.col("node"))).select(F.struct("key_", "part").alias("id"), "node")
    return richtext.document_texts(trees).groupBy(F.col("id.key_").alias("key_")).agg(F.map_from_entries(F.collect_list(F.struct("id.part", "text"))).alias("texts"))


@register("jira")
def jira(raw: DataFrame) -> DataFrame:
    """Issues as Markdown: fields, description, comments and the last changes; rich text of any depth becomes plain text."""
    own = _with_key(raw)
    at = richtext.text_at
    v, f = F.col("v_"), "$.fields"
    comments = F.coalesce(richtext.children_at(v, f"{f}.comment.comments"), F.array().cast("array<variant>"))
    described_, bodies = F.try_variant_get(v, f"{f}.description", "variant"), F.transform(comments, lambda c: F.try_variant_get(c, "$.body", "variant"))
    deep = F.exists(F.concat(F.array(described_), bodies), lambda n: richtext.deeper(n, richtext.document_children))
    joined = _deep(own, deep, lambda rows: _issue_texts(rows, F.concat(F.array(described_), bodies)))
    shallow = [richtext.document_text(described_), F.transform(bodies, lambda n: richtext.document_text(n))]
    if joined is None:
        joined = own.withColumns({"described_": shallow[0], "said_": shallow[1]})
    else:
        text = lambda n: F.coalesce(F.try_element_at("texts", n), F.lit(""))
        joined = joined.withColumns({"described_": F.when(F.col("deep_"), text(F.lit(0))).otherwise(shallow[0]), "said_": F.when(F.col("deep_"), F.transform(comments, lambda c, i: text(i + 1))).otherwise(shallow[1])})

    title = F.concat(F.lit("["), _or(v, "$.key", ""), F.lit("] "), _or(v, f"{f}.summary", ""))
    fields = [F.concat(F.lit("**Status:** "), _or(v, f"{f}.status.name", ""))]
    for label, path in (("Type", "issuetype.name"), ("Priority", "priority.name"), ("Assignee", "assignee.displayName"), ("Reporter", "reporter.displayName"), ("Created", "created"), ("Updated", "updated")):
        fields.append(_field(label, at(v, f"{f}.{path}")))
    head = F.concat(F.array(F.concat(F.lit("# "), title), F.lit("")), F.filter(F.array(*fields), lambda x: x.isNotNull()), F.array(F.lit("")))
    described = F.when(F.col("described_") != "", F.array(F.lit("## Description"), F.lit(""), F.col("described_"), F.lit("")))
    said = F.flatten(F.transform(comments, lambda c, i: F.array(F.concat(F.lit("**"), _or(c, "$.author.displayName", "Unknown"), F.lit("** ("), _or(c, "$.created", ""), F.lit("):")), F.get("said_", i), F.lit(""))))
    discussed = F.when(F.size(comments) > 0, F.concat(F.array(F.lit("## Comments"), F.lit("")), said))
    histories = F.coalesce(richtext.children_at(v, "$.changelog.histories"), F.array().cast("array<variant>"))
    told = lambda h, i: F.concat(F.lit("- "), _or(h, "$.created", ""), F.lit(": "), _or(h, "$.author.displayName", "Unknown"), F.lit(" changed **"), _or(i, "$.field", ""), F.lit("**: "), _or(i, "$.fromString", ""), F.lit(" → "), _or(i, "$.toString", ""))
    changes = F.flatten(F.transform(histories, lambda h: F.transform(F.coalesce(richtext.children_at(h, "$.items"), F.array().cast("array<variant>")), lambda i: told(h, i))))
    last = F.when(F.size(changes) > CHANGES, F.slice(changes, -CHANGES, CHANGES)).otherwise(changes)
    changed = F.when(F.size(changes) > 0, F.concat(F.array(F.lit("## Changelog"), F.lit("")), last, F.array(F.lit(""))))
    none = F.array().cast("array<string>")
    content = F.array_join(F.concat(head, F.coalesce(described, none), F.coalesce(discussed, none), F.coalesce(changed, none)), "\n")
    return joined.select(*_document("jira", at(v, "$.key"), title, content, at(v, "$.self"), at(v, f"{f}.reporter.displayName"), _time("$.fields.updated")))


@register("confluence")
def confluence(raw: DataFrame) -> DataFrame:
    return raw.select(*_document("confluence", _j("$.id"), _j("$.title"), html_text(F.col("value")), _j("$._links.webui"), _j("$.version.by.displayName"), _time("$.version.when")))


@register("notion")
def notion(raw: DataFrame) -> DataFrame:
    """Pages with blocks (and their children, to any depth) as Markdown. The title is a property of type title, or title itself."""
    own = _with_key(raw)
    v = F.col("v_")
    properties = F.map_values(F.try_variant_get(v, "$.properties", "map<string,variant>"))
    named = F.get(F.filter(properties, lambda p: richtext.text_at(p, "$.type") == "title"), 0)
    title = F.coalesce(richtext.text_at(v, "$.title"), F.array_join(F.transform(richtext.children_at(named, "$.title"), lambda t: _or(t, "$.plain_text", "")), ""), F.lit(""))
    rows = own.withColumn("title_", title)
    blocks = lambda: richtext.children_at(v, "$.blocks")
    deep = F.exists(F.coalesce(blocks(), richtext.none()), lambda b: richtext.deeper(b, richtext.page_children, richtext.ROW_LEVELS - 1))
    pages = lambda found: found.select(F.col("key_").alias("id"), F.lit(None).cast("string").alias("title"), F.coalesce(blocks(), richtext.none()).alias("blocks"))
    joined = _deep(rows, deep, lambda found: richtext.page_texts(pages(found)).withColumnRenamed("id", "key_"))
    text = richtext.page_text(blocks())
    if joined is None:
        joined = rows
    else:
        text = F.when(F.col("deep_"), F.col("text")).otherwise(text)
    return joined.select(*_document("notion", _j("$.id"), F.col("title_"), F.coalesce(text, F.lit("")), _j("$.url"), _j("$.last_edited_by.name"), _time("$.last_edited_time")))


@register("github")
def github(raw: DataFrame) -> DataFrame:
    """Issues, pull requests, releases and files, told apart by what they carry."""
    release, file = _j("$.tag_name").isNotNull(), _j("$.path").isNotNull()
    pull = _j("$.pull_request").isNotNull() | _j("$.merged_at").isNotNull()
    repo = F.coalesce(_j("$.repository"), F.lit(""))
    kind = F.when(release, "release").when(file, "file").when(pull, "pr").otherwise("issue")
    number = F.coalesce(_j("$.tag_name"), _j("$.path"), _j("$.number"))
    labels = F.array_join(F.transform(F.from_json(_j("$.labels"), "array<struct<name:string>>"), lambda x: x["name"]), ", ")
    title = F.coalesce(_j("$.title"), _j("$.name"), _j("$.path"))
    body = _lines(F.concat(F.lit("# "), title), _field("State", _j("$.state")), _field("Labels", labels), F.coalesce(_j("$.body"), _j("$.content")))
    return raw.select(*_document("github", F.when(number.isNotNull(), F.concat(repo, F.lit("#"), kind, F.lit("/"), number)), title, body, _j("$.html_url"), F.coalesce(_j("$.user.login"), _j("$.author.login")), F.coalesce(_time("$.updated_at"), _time("$.published_at"))))


@register("gdrive")
def gdrive(raw: DataFrame) -> DataFrame:
    return raw.select(*_document("gdrive", _j("$.id"), _j("$.name"), _j("$.text"), _j("$.webViewLink"), _j("$.owners[0].displayName"), _time("$.modifiedTime")))
