"""Candidates for fields: labelled blocks, JSON-LD scalars, page facts. The field schema is data, so one plan
serves every request; rows carry their place (source, node, item), which stands for the order of discovery.

Each page gives one array of what fields may be read from; it is exploded once, and all that follows is a
projection: one scan, no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.dom import BLOCK_TAGS, LONGEST_BLOCK, elements, flat_map, let, node_path, tagged
from factloom.functions.jsonld import LONGEST_ITEM_SCRIPT
from factloom.functions.scalars import labelled, scalar, squeezed

#: Names of page facts, the longest of them, and what parts a label from its value.
PAGE_FACTS = ("page_title", "main_heading", "page_description", "site_name")
LONGEST_FACT = 200
PARTED = r"[:\-–]"

COLUMNS = ["page_key", "field", "src_rank", "node_id", "item_idx", "value", "unit", "currency", "billing_period", "value_type", "encoding", "locator", "excerpt", "label", "raw_value"]


class Field(NamedTuple):
    """One field of a request's schema."""

    name: str
    type: str = "string"
    title: str | None = None
    x_unit: str | None = None
    x_currency: str | None = None


#: A schema for all pages, or a table (page_key, name, type, title, x_unit, x_currency) with one for each page.
Schema = Sequence[Field] | DataFrame


def per_field(rows: DataFrame, fields: Schema) -> DataFrame:
    """rows with each field of their page: name, type, title, x_unit, x_currency and label (the title, or the
    name with spaces). A schema for all pages is exploded in place; a table is joined by page_key."""
    if isinstance(fields, DataFrame):
        out = rows.join(fields, "page_key")
    else:
        own = [F.struct(*[F.lit(v).cast("string").alias(c) for c, v in f._asdict().items()]) for f in fields]
        own = own or [F.struct(*[F.lit(None).cast("string").alias(c) for c in Field._fields])]
        out = rows.withColumn("__f", F.explode(F.array(*own))).where("__f.name is not null").select("*", "__f.*").drop("__f")
    return out.withColumn("label", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.replace(F.col("name"), F.lit("_"), F.lit(" "))))


def _blocks(nodes: Column) -> Column:
    return tagged(nodes, BLOCK_TAGS, lambda n: ~n["hidden"] & F.length(n["block_text"]).between(1, LONGEST_BLOCK))


def visible_blocks(pages: DataFrame) -> DataFrame:
    """(page_key, node_id, tag, text, locator) of shown blocks of 1 to 400 characters."""
    nodes = F.col("nodes")
    found = F.transform(_blocks(nodes), lambda n: F.struct(n["node_id"].alias("node_id"), n["tag"].alias("tag"), n["block_text"].alias("text"), node_path(nodes, n["node_id"]).alias("locator")))
    return pages.select("page_key", F.inline(found))


def _sort_of(n: Column, attr: str) -> Column:
    """An attribute's value as it compares with the names of metas, whose letters only the long s folds to as well."""
    return F.lower(F.translate(F.coalesce(n["attrs"][attr], F.lit("")), "ſ", "s"))


def metas(nodes: Column, attr: str, value: str) -> Column:
    """The metas whose property or name is that value, without regard to case."""
    return tagged(nodes, ("meta",), lambda n: _sort_of(n, attr) == value)


def fact_array(nodes: Column) -> Column:
    """(field, node_id, path, raw_value) of each page fact: title, main heading, description and site name of 1 to 200
    characters. Open Graph metas stand in for a title or description only where a page has no element of the first
    kind."""

    def of(field: str, found: Column, text: str | None) -> Column:
        raw = (lambda n: n[text]) if text else (lambda n: F.coalesce(n["attrs"]["content"], F.lit("")))
        return F.transform(found, lambda n: F.struct(F.lit(field).alias("field"), n["node_id"].alias("node_id"), node_path(nodes, n["node_id"]).alias("path"), squeezed(raw(n)).alias("raw_value")))

    def first_kind(field: str, found: Column, text: str | None, instead: Column) -> Column:
        return let(of(field, found, text), lambda own: F.when(F.size(own) > 0, own).otherwise(of(field, instead, None)))

    every = F.concat(
        first_kind("page_title", tagged(nodes, ("title",)), "plain_text", metas(nodes, "property", "og:title")),
        of("main_heading", tagged(nodes, ("h1",), lambda n: ~n["hidden"]), "shown_text"),
        first_kind("page_description", metas(nodes, "name", "description"), None, metas(nodes, "property", "og:description")),
        of("site_name", metas(nodes, "property", "og:site_name"), None),
    )
    return F.filter(every, lambda f: F.length(f["raw_value"]).between(1, LONGEST_FACT))


def page_facts(pages: DataFrame) -> DataFrame:
    """The page facts of each page as candidates (COLUMNS)."""
    none = F.lit(None).cast("string")
    return pages.select("page_key", F.inline(fact_array(F.col("nodes")))).withColumns({
        "src_rank": F.lit(0), "item_idx": F.lit(0), "value": F.col("raw_value"), "unit": none, "currency": none, "billing_period": none, "value_type": F.lit("string"), "encoding": none,
        "locator": fact_locator(F.col("path"), F.col("field")), "excerpt": F.col("raw_value"), "label": F.col("field"),
    }).select(COLUMNS)


def fact_locator(path: Column, field: Column) -> Column:
    return F.concat(path, F.lit("::page-fact("), field, F.lit(")"))


def _readings(pages: DataFrame, also: Sequence[str] = (), marks: bool = False) -> DataFrame:
    """What fields may be read from, a row each: kind (block, item or fact), node_id, item_idx, key, text, locator, excerpt;
    with marks also one of kind page for each page, which says that it is there."""

    def reading(kind: str, node_id: Column, item_idx: Column, key: Column, text: Column, locator: Column, excerpt: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), node_id.alias("node_id"), item_idx.cast("int").alias("item_idx"), key.cast("string").alias("key"), text.alias("text"), locator.alias("locator"), excerpt.alias("excerpt"))

    none = F.lit(None)
    blocks = F.transform(F.filter(_blocks(F.col("nodes")), lambda n: n["block_text"].rlike(PARTED)), lambda n: reading("block", n["node_id"], F.lit(0), none, n["block_text"], node_path(F.col("nodes"), n["node_id"]), n["block_text"]))
    items = flat_map(F.filter("scripts", lambda s: F.length(s["script"]) <= LONGEST_ITEM_SCRIPT), lambda s: F.transform(s["items"], lambda i: reading(
        "item", s["node_id"], i["item_idx"], i["key"], i["raw_value"], F.concat(s["path"], F.lit("::item("), i["item_idx"].cast("string"), F.lit(")::"), i["key"]), s["script"])))
    facts = F.transform(fact_array(F.col("nodes")), lambda f: reading("fact", f["node_id"], F.lit(0), f["field"], f["raw_value"], fact_locator(f["path"], f["field"]), f["raw_value"]))
    there = F.array(reading("page", F.lit(0), F.lit(0), none, none.cast("string"), none.cast("string"), none.cast("string"))) if marks else None
    return pages.select("page_key", *also, F.inline(F.concat(blocks, items, facts, *([] if there is None else [there]))))


def candidates(pages: DataFrame, fields: Schema) -> DataFrame:
    """All candidates (COLUMNS) for the fields of a request. A page-fact name goes to page facts alone, for strings;
    others to blocks of the form "label: value" and to top-level scalars of JSON-LD objects with that key."""
    rows = per_field(_readings(pages), fields)
    of_page, kind = F.col("name").isin(*PAGE_FACTS), F.col("kind")
    own = F.when(kind == "fact", (F.col("name") == F.col("key")) & (F.col("type") == "string")).when(kind == "item", ~of_page & (F.col("name") == F.col("key"))).otherwise(~of_page)
    rows = rows.where(own).withColumn("raw_value", F.when(kind == "block", labelled(F.col("text"), F.col("label"))).otherwise(F.col("text"))).where("raw_value is not null")
    rows = rows.withColumn("s", scalar("raw_value", "type")).where("s.value is not null")
    return rows.withColumns({
        "field": F.col("name"), "src_rank": F.when(kind == "item", 1).otherwise(0), "value": F.col("s.value"), "unit": F.col("s.unit"), "currency": F.col("s.currency"), "encoding": F.col("s.encoding"),
        "billing_period": F.lit(None).cast("string"), "value_type": F.col("type"), "label": F.coalesce("key", "label"),
    }).select(COLUMNS)


def read_fields(pages: DataFrame, fields: Schema, also: Sequence[str] = ()) -> DataFrame:
    """All that pages tell of the fields of a request, in one pass: COLUMNS, what is taken along, the field's x_unit and
    x_currency, and what a row is: `candidate`; `hit`, a block with the field's label, whatever its value; or neither, the
    mark that each page has for each field."""
    rows = per_field(_readings(pages, also, marks=True), fields)
    of_page, kind = F.col("name").isin(*PAGE_FACTS), F.col("kind")
    own = F.when(kind == "fact", (F.col("name") == F.col("key")) & (F.col("type") == "string")).when(kind == "item", ~of_page & (F.col("name") == F.col("key"))).when(kind == "block", ~of_page).otherwise(False)
    rows = rows.withColumn("raw_value", F.when(kind == "block", labelled(F.col("text"), F.col("label"))).otherwise(F.col("text"))).withColumn("hit", (kind == "block") & F.col("raw_value").isNotNull())
    rows = rows.withColumn("own", F.coalesce(own & F.col("raw_value").isNotNull(), F.lit(False))).where(F.col("own") | F.col("hit") | (kind == "page"))
    rows = rows.withColumn("s", scalar("raw_value", "type")).withColumn("candidate", F.col("own") & F.col("s.value").isNotNull())
    return rows.withColumns({
        "field": F.col("name"), "src_rank": F.when(kind == "item", 1).otherwise(0), "value": F.col("s.value"), "unit": F.col("s.unit"), "currency": F.col("s.currency"), "encoding": F.col("s.encoding"),
        "billing_period": F.lit(None).cast("string"), "value_type": F.col("type"), "label": F.coalesce("key", "label"),
    }).select(*COLUMNS, *also, "x_unit", "x_currency", "candidate", "hit")


def label_hits(pages: DataFrame, fields: Schema) -> DataFrame:
    """(page_key, field) for which some visible block has the label, whatever the value."""
    marked = visible_blocks(pages).where(F.col("text").rlike(PARTED))
    return per_field(marked, fields).where(labelled(F.col("text"), F.col("label")).isNotNull()).select("page_key", F.col("name").alias("field")).distinct()


def jsonld_scripts(pages: DataFrame) -> DataFrame:
    """Shown JSON-LD scripts: page_key, node_id, path, script, items, entities."""
    return pages.select("page_key", F.inline("scripts"))


__all__ = ["BLOCK_TAGS", "COLUMNS", "PAGE_FACTS", "Field", "Schema", "candidates", "elements", "fact_array", "fact_locator", "jsonld_scripts", "label_hits", "metas", "page_facts", "per_field", "read_fields", "visible_blocks"]
