"""Named plans: the card or table column that belongs to a plan, and the plan's fields inside it.

A page's elements are an array in pre-order, and b lies below a if a.node_id < b.node_id <= a.last_id. So the nearest
card, the column's cells and the innermost matches are functions over that array; no page is joined with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.dom import LONGEST_LABELLED, LONGEST_SCOPE, below, flat_map, let, node_path, tagged
from factloom.functions.scalars import MONTH_UNIT, amount, billing_period, casefold, is_price_text, labelled, money, price_currency, scalar

#: Plan fields with their kinds and labels.
PLAN_FIELDS = {
    "named_plan": ("string", "Plan"), "listed_price": ("number", "Price"), "currency": ("string", "Currency"),
    "billing_period": ("string", "Billing period"), "usage_or_seat_limit": ("string", "Usage limit"), "support_channel": ("string", "Support"),
}
PRICED = ("listed_price", "currency", "billing_period")
LABELLED = tuple(n for n in PLAN_FIELDS if n not in (*PRICED, "named_plan"))
PRICE_ROW = r"(?iU)\b(price|cost|rate)\b"
#: Elements that may hold a label below the box that is looked at.
HOLDERS = ("p", "li", "div", "span", "td")

COLUMNS = ["page_key", "plan_name", "field", "scope_rank", "scope_id", "node_id", "value", "unit", "currency", "billing_period", "value_type", "encoding", "locator", "excerpt", "label", "raw_value"]


def table_rows(nodes: Column) -> Column:
    """Every tr: node_id, last_id, hidden, its cells in order, and whether one of them spans."""

    def cell(c: Column) -> Column:
        spanned = F.map_contains_key(c["attrs"], "colspan") | F.map_contains_key(c["attrs"], "rowspan")
        return F.struct(*[c[k].alias(k) for k in ("node_id", "last_id", "parent_id", "shown_text", "fold")], spanned.alias("spanned"))

    def row(cells: Column, r: Column) -> Column:
        own = F.filter(cells, lambda c: c["parent_id"] == r["node_id"])
        return let(own, lambda cs: F.struct(*[r[k].alias(k) for k in ("node_id", "last_id", "hidden")], cs.alias("cells"), F.exists(cs, lambda c: c["spanned"]).alias("spanned")))

    return let(F.transform(tagged(nodes, ("td", "th")), cell), lambda cells: F.transform(tagged(nodes, ("tr",)), lambda r: row(cells, r)))


def first_row(rows: Column, table: Column) -> Column:
    """The first row below a table, as an array of one or none."""
    return F.slice(F.filter(rows, lambda r: below(table, r)), 1, 1)


def priced_nodes(nodes: Column) -> Column:
    """Elements whose shown text is a price text: node_id, last_id, shown_text."""
    return F.transform(F.filter(nodes, lambda n: is_price_text(n["shown_text"])), lambda n: F.struct(*[n[k].alias(k) for k in ("node_id", "last_id", "shown_text")]))


def _nearest(nodes: Column, priced: Column, head: Column) -> Column:
    """The nearest ancestor with an amount and a price node below it. The walk up ends at body and html and at the
    first ancestor with more than LONGEST_SCOPE characters."""
    none = F.lit(None).cast("struct<node_id:int,last_id:int>")

    def step(at: Column, a: Column) -> Column:
        fits = a["amount"] & F.exists(priced, lambda p: below(a, p))
        own = F.struct(a["node_id"].alias("node_id"), a["last_id"].alias("last_id"))
        ends = a["tag"].isin("body", "html") | (a["size"] > LONGEST_SCOPE)
        return F.when(at["done"], at).when(ends, F.struct(F.lit(True).alias("done"), none.alias("scope"))).when(fits, F.struct(F.lit(True).alias("done"), own.alias("scope"))).otherwise(at)

    up = F.reverse(F.filter(nodes, lambda a: below(a, head)))
    return F.aggregate(up, F.struct(F.lit(False).alias("done"), none.alias("scope")), step, lambda at: at["scope"])


def _scope(nodes: Column, name: Column, rank: int, order: Column, scope: Column, at: Column, col: Column) -> Column:
    return F.struct(
        name["plan_name"].alias("plan_name"), name["name_idx"].alias("name_idx"), F.lit(rank).alias("scope_rank"), order.alias("order_id"), scope["node_id"].alias("scope_id"), scope["last_id"].alias("scope_last"),
        node_path(nodes, scope["node_id"]).alias("scope_path"), at["node_id"].alias("plan_id"), node_path(nodes, at["node_id"]).alias("plan_path"), at["shown_text"].alias("plan_text"), col.cast("int").alias("col"),
    )


def card_scopes(nodes: Column, priced: Column, names: Column) -> Column:
    """For each shown h2-h4 that is a plan's name, its nearest card; a card that several headings of a plan reach counts
    once, by the first."""
    heads = tagged(nodes, ("h2", "h3", "h4"), lambda h: ~h["hidden"] & F.exists(names, lambda n: n["fold"] == h["fold"]))

    def of(h: Column) -> Column:
        return let(_nearest(nodes, priced, h), lambda s: F.transform(F.filter(names, lambda n: s.isNotNull() & (n["fold"] == h["fold"])), lambda n: _scope(nodes, n, 0, h["node_id"], s, h, F.lit(None))))

    def repeated(every: Column, s: Column, i: Column) -> Column:
        return F.exists(F.slice(every, F.lit(1), i), lambda e: (e["plan_name"] == s["plan_name"]) & (e["scope_id"] == s["scope_id"]))

    return let(flat_map(heads, of), lambda every: F.filter(every, lambda s, i: ~repeated(every, s, i)))


def column_scopes(nodes: Column, rows: Column, names: Column) -> Column:
    """Shown tables whose unspanned first row names the plan in exactly one cell, with that cell's index."""

    def of(t: Column, r: Column, n: Column) -> Column:
        at = F.array_position(F.transform(r["cells"], lambda c: c["fold"]), n["fold"]) - 1
        return let(at.cast("int"), lambda k: _scope(nodes, n, 1, t["node_id"], t, F.get(r["cells"], k), k))

    def named(r: Column) -> Column:
        return F.filter(names, lambda n: F.size(F.filter(r["cells"], lambda c: c["fold"] == n["fold"])) == 1)

    tables = tagged(nodes, ("table",), lambda t: ~t["hidden"])
    return flat_map(tables, lambda t: flat_map(F.filter(first_row(rows, t), lambda r: ~r["spanned"]), lambda r: F.transform(named(r), lambda n: of(t, r, n))))


def _innermost(found: Column, same: str | None = None) -> Column:
    """Those without another below them (with the same text, if that counts)."""
    return F.filter(found, lambda a: ~F.exists(found, lambda b: below(a, b) & (b[same] == a[same] if same else F.lit(True))))


def _boxes(s: Column, rows: Column, fits: Column) -> Column:
    """Where to look in a scope: a card itself, or the cells of its column in rows whose first cell fits."""
    card = F.array(F.struct(s["scope_id"].alias("node_id"), s["scope_last"].alias("last_id")))
    own = F.filter(rows, lambda r: (r["node_id"] > s["scope_id"]) & (r["node_id"] <= s["scope_last"]) & ~r["spanned"] & (F.size(r["cells"]) > s["col"]) & fits(F.get(r["cells"], F.lit(0))))
    cells = F.transform(own, lambda r: let(F.get(r["cells"], s["col"]), lambda c: F.struct(c["node_id"].alias("node_id"), c["last_id"].alias("last_id"))))
    return F.when(s["col"].isNull(), card).otherwise(cells)


def plan_array(nodes: Column, rows: Column, names: Column) -> Column:
    """What a page says of its plans (names: array of plan_name, fold, name_idx), not yet parsed: named_plan, price
    nodes ("priced") and labels, each with its scope. Price nodes are the innermost of a card, or of the cell in the
    plan's column and a row whose first cell speaks of price, cost or rate; labels the innermost labelled nodes of the
    card, or of the cell in the row that the label names."""

    def out(s: Column, field: str, at: Column, text: str, raw: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), *[s[k].alias(k) for k in ("plan_name", "name_idx", "scope_rank", "order_id", "scope_id", "scope_path")], at["node_id"].alias("node_id"), node_path(nodes, at["node_id"]).alias("path"), at[text].alias("text"), raw.cast("string").alias("raw"))

    def named(s: Column) -> Column:
        return F.struct(F.lit("named_plan").alias("field"), *[s[k].alias(k) for k in ("plan_name", "name_idx", "scope_rank", "order_id", "scope_id", "scope_path")], s["plan_id"].alias("node_id"), s["plan_path"].alias("path"), s["plan_text"].alias("text"), s["plan_text"].alias("raw"))

    def prices(s: Column, inner: Column) -> Column:
        boxes = _boxes(s, rows, lambda first: first["shown_text"].rlike(PRICE_ROW))
        return flat_map(boxes, lambda b: F.transform(F.filter(inner, lambda p: below(b, p, itself=True)), lambda p: out(s, "priced", p, "shown_text", F.lit(None))))

    def labels(s: Column, field: str, said: Column) -> Column:
        boxes = _boxes(s, rows, lambda first: first["fold"] == PLAN_FIELDS[field][1].casefold())
        fits = lambda b, x: below(b, x, itself=True) & ((x["node_id"] == b["node_id"]) | x["tag"].isin(*HOLDERS))
        return flat_map(boxes, lambda b: F.transform(F.filter(said, lambda x: fits(b, x)), lambda x: out(s, field, x, "shown_text", x["raw"])))

    def said(title: str) -> Column:
        short = F.filter(nodes, lambda n: (F.length(n["shown_text"]) <= LONGEST_LABELLED) & n["shown_text"].rlike(r"[:\-–]"))
        with_raw = F.transform(short, lambda n: F.struct(*[n[k].alias(k) for k in ("node_id", "last_id", "tag", "shown_text")], labelled(n["shown_text"], F.lit(title)).alias("raw")))
        return let(F.filter(with_raw, lambda n: n["raw"].isNotNull()), lambda found: _innermost(found))

    def labelled_in(found: Column, field: str) -> Column:
        return let(said(PLAN_FIELDS[field][1]), lambda x: flat_map(found, lambda s: labels(s, field, x)))

    def all_of(priced: Column) -> Column:
        scopes = F.concat(card_scopes(nodes, priced, names), column_scopes(nodes, rows, names))

        def each(found: Column) -> Column:
            parts = [F.transform(found, named), let(_innermost(priced, "shown_text"), lambda inner: flat_map(found, lambda s: prices(s, inner)))]
            parts += [labelled_in(found, f) for f in LABELLED]
            return F.when(F.size(found) > 0, F.concat(*parts))

        return let(scopes, each)

    return F.when(F.size(names) > 0, let(priced_nodes(nodes), all_of))


def parsed(rows: DataFrame, carried: Sequence[str] = (), along: dict[str, Column] | None = None) -> DataFrame:
    """Flat rows of plan_array (page_key and its parts) as candidates: COLUMNS, order_id, name_idx and what is carried
    along. What the scope does not say is not made up. Rows whose field is "said" are none of a plan
    and pass; `along` are Arrow functions that go to the workers with the same rows."""
    text, asked, field = F.col("text"), F.col("field"), F.col("f")
    priced = asked == "priced"
    rows = rows.withColumns({"p": F.when(priced, billing_period(text)), "cur": F.when(priced, price_currency(text)), "number": F.when(priced, amount(text))})
    kinds = F.create_map(*[F.lit(x) for n, (k, _) in PLAN_FIELDS.items() for x in (n, k)])
    rows = rows.withColumns({**(along or {}), "s": scalar(F.when(priced, F.col("number")).otherwise(F.col("raw")), F.when(priced, F.lit("number")).otherwise(F.lit("string")))})
    rows = rows.withColumn("f", F.explode(F.when(priced, F.array(*map(F.lit, PRICED))).otherwise(F.array(asked))))  # only now, so that a text is read once
    told = F.when(priced, F.col("p").isNotNull() & ((field == "billing_period") | F.col("cur").isNotNull() & F.col("s.value").isNotNull())).otherwise(field.isin("named_plan", "said") | F.col("s.value").isNotNull())
    whole = F.trim(money(text)["whole"])
    is_price = field == "listed_price"
    value = F.when(field == "named_plan", F.col("plan_name")).when(field == "currency", F.col("cur")).when(field == "billing_period", F.col("p")).otherwise(F.col("s.value"))
    labels = field.isin(*LABELLED)
    return rows.where(told).select(
        "page_key", "plan_name", F.col("f").alias("field"), "scope_rank", "scope_id", "node_id", value.alias("value"), F.when(is_price & text.rlike(MONTH_UNIT), "month").when(labels, F.col("s.unit")).alias("unit"),
        F.when(is_price, F.col("cur")).when(labels, F.col("s.currency")).alias("currency"), F.when(is_price, F.col("p")).alias("billing_period"), kinds[field].alias("value_type"), F.when(is_price | labels, F.col("s.encoding")).alias("encoding"),
        F.concat("path", F.lit("::plan-scope("), "scope_path", F.lit(")")).alias("locator"), text.alias("excerpt"), F.col("f").alias("label"),
        F.when(is_price, whole).when(field == "currency", F.col("cur")).when(field == "billing_period", F.col("p")).otherwise(F.col("raw")).alias("raw_value"), "order_id", "name_idx", *carried, *(along or {}),
    )


def with_names(pages: DataFrame, plans: DataFrame | None) -> DataFrame:
    """pages with the array of names: their own plan_name, or those that a table (page_key, plan_name) asks for."""
    name = F.struct("plan_name", casefold("plan_name").alias("fold"), F.lit(0).alias("name_idx"))
    if plans is None:
        return pages.withColumn("names", F.array(name))
    return pages.join(plans.groupBy("page_key").agg(F.collect_set(name).alias("names")), "page_key")


def plan_candidates(pages: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Candidates for the six plan fields of each (page_key, plan_name); without a table of plans, of the plan_name that
    each page brings along, with no join."""
    rows = with_names(pages, plans).withColumn("found", let(table_rows(F.col("nodes")), lambda rows: plan_array(F.col("nodes"), rows, F.col("names"))))
    return parsed(rows.select("page_key", F.inline("found")))


def nearest_cards(pages: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """(page_key, plan_name, scope_path, plan_path) of each plan's cards."""
    cards = let(priced_nodes(F.col("nodes")), lambda priced: card_scopes(F.col("nodes"), priced, F.col("names")))
    return with_names(pages, plans).select("page_key", F.inline(cards)).select("page_key", "plan_name", "scope_path", "plan_path")
