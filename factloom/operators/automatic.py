"""Automatic facts: claims from six kinds of source, reconciled into facts, an overview and a page type.

All claims of a page are one array, made where the page is parsed; exploded, they move once, by page, and every
later step (order, caps, variants, display) keeps that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import dom
from factloom.functions.dom import below, flat_map, let, node_path, tagged
from factloom.functions.scalars import casefold, squeezed
from factloom.sources.captures import decode_html

from .candidates import fact_array, fact_locator, metas
from .plans import PLAN_FIELDS, first_row, parsed, plan_array, table_rows

#: Entity types and what page they make, labels, headings that name no plan, and caps.
PAGE_TYPES = {
    "article": "article", "newsarticle": "article", "blogposting": "article", "organization": "organization/service", "localbusiness": "organization/service",
    "service": "organization/service", "product": "product", "softwareapplication": "product", "webapplication": "product",
}
PAGE_LABELS = {"page_title": "Title", "main_heading": "Main heading", "page_description": "Description", "site_name": "Site name"}
ENTITY_LABELS = {"headline": "Headline", "name": "Name", "description": "Description", "datePublished": "Published"}
NO_PLANS = ("pricing", "plans", "compare plans", "features", "faq", "frequently asked questions", "contact sales", "let's talk")
KEY_ORDER = ("page_title", "main_heading", "page_description", "overview_text", "site_name", "named_plan", "listed_price")
OFFER_CURRENCIES = ("USD", "EUR", "GBP", "INR")
MOST_FACTS, MOST_CLAIMS, MOST_NAMES = 60, 250, 12

#: Parts of a claim; the folded ones tell which facts look the same.
CLAIM = ["page_key", "grp", "key", "label", "value", "currency", "unit", "billing_period", "encoding", "locator", "excerpt", "pos", "folded_label", "folded_value"]


#: Sources of claims in their order; marks are no claims but what else a page tells of itself.
FROM_PAGE, FROM_ENTITY, FROM_OVERVIEW, FROM_DETAIL, FROM_PLAN, WANTED = 0, 1, 2, 3, 4, 9


def _none(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def _pos(source: int, *parts: Column) -> Column:
    """Place of a claim: its source, then up to five numbers within it."""
    return F.array(*[c.cast("long") for c in (F.lit(source), *parts, *[F.lit(0)] * (5 - len(parts)))])


def _claim(grp: Column, key: Column, label: Column, value: Column, locator: Column, excerpt: Column, pos: Column, currency: Column | None = None, encoding: Column | None = None, in_article: Column | None = None) -> Column:
    parts = {"grp": grp, "key": key, "label": label, "value": value, "currency": currency, "unit": None, "billing_period": None, "encoding": encoding, "locator": locator, "excerpt": excerpt}
    texts = [(F.lit(None) if c is None else c).cast("string").alias(n) for n, c in parts.items()]
    return F.struct(*texts, pos.alias("pos"), (F.lit(None) if in_article is None else in_article).cast("boolean").alias("in_article"))


def _among(nodes: Column, tags: tuple[str, ...]) -> Column:
    return F.transform(tagged(nodes, tags), lambda a: F.struct(a["node_id"].alias("node_id"), a["last_id"].alias("last_id")))


def _inside(around: Column, b: Column) -> Column:
    return F.exists(around, lambda a: below(a, b))


def page_claims(nodes: Column) -> Column:
    order = F.create_map(*[F.lit(x) for i, k in enumerate(PAGE_LABELS) for x in (k, i)])
    labels = F.create_map(*[F.lit(x) for pair in PAGE_LABELS.items() for x in pair])
    return F.transform(fact_array(nodes), lambda f: _claim(F.lit("Page"), f["field"], labels[f["field"]], f["raw_value"], fact_locator(f["path"], f["field"]), f["raw_value"], _pos(FROM_PAGE, order[f["field"]], f["node_id"])))


def wanted_claims() -> Column:
    """A mark for each label that every page should have; it stands where nothing else is found."""
    return F.array(*[_claim(F.lit("Page"), F.lit(k), F.lit(v), F.lit(None), F.lit(None), F.lit(None), _pos(WANTED, F.lit(i))) for i, (k, v) in enumerate(PAGE_LABELS.items())])


def entities(nodes: Column, scripts: Column, host: Column, path: Column) -> Column:
    """JSON-LD objects of a known type that are about the page: of its host and path, if they name one, and with a
    headline or name that a heading, title or og:title of the page shows."""
    known = F.array(*map(F.lit, PAGE_TYPES))
    shown = F.concat(tagged(nodes, ("title",)), tagged(nodes, ("h1",), lambda n: ~n["hidden"]), metas(nodes, "property", "og:title"))
    anchors = F.filter(F.transform(shown, lambda n: squeezed(n["fold"])), lambda t: t != "")
    every = flat_map(scripts, lambda s: F.transform(s["entities"], lambda e: F.struct(s["node_id"].alias("node_id"), s["path"].alias("path"), e.alias("e"))))

    def about(anchored: Column, x: Column) -> Column:
        e = x["e"]
        return F.arrays_overlap(e["types"], known) & (e["host"].isNull() | e["host"].eqNullSafe(host) & e["own_path"].eqNullSafe(path)) & F.array_contains(anchored, e["anchor"])

    return let(anchors, lambda anchored: F.filter(every, lambda x: F.coalesce(about(anchored, x), F.lit(False))))


def entity_claims(found: Column) -> Column:
    """Facts of the page's entities, and prices of a product's offers."""
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("key"), F.lit(v).alias("label")) for i, (k, v) in enumerate(ENTITY_LABELS.items())])

    def has(x: Column, *names: str) -> Column:
        return F.arrays_overlap(x["e"]["types"], F.array(*map(F.lit, names)))

    def of(x: Column) -> Column:
        e = x["e"]
        grp = F.when(has(x, "article", "newsarticle", "blogposting"), "Article").when(has(x, "product", "softwareapplication", "webapplication"), "Product").otherwise("Organization")
        place = F.concat(e["root_idx"].cast("string"), F.lit(","), e["child_idx"].cast("string"), F.lit(","))
        at = (x["node_id"], e["root_idx"], e["child_idx"])

        def fact(g: Column, k: Column) -> Column:
            value = e["facts"][k["key"]]
            return _claim(g, k["key"], k["label"], value, F.concat(x["path"], F.lit("::auto-json("), place, k["key"], F.lit(")")), value, _pos(FROM_ENTITY, *at, k["i"]))

        def offer(o: Column) -> Column:
            name = F.coalesce(o["name"], F.concat(F.lit("Offer "), (o["idx"] + 1).cast("string")))
            encoding = F.when(o["price"].contains("."), "decimal-string").otherwise("integer-string")
            locator = F.concat(x["path"], F.lit("::auto-offer("), place, o["idx"].cast("string"), F.lit(")"))
            return _claim(F.concat(F.lit("Offer: "), name), F.lit("price"), F.lit("Listed price"), o["price"], locator, o["price"], _pos(FROM_ENTITY, *at, o["idx"] + 4), o["currency"], encoding)

        def both(g: Column) -> Column:
            facts = F.transform(F.filter(keys, lambda k: e["facts"][k["key"]].isNotNull()), lambda k: fact(g, k))
            offers = F.filter(e["offers"], lambda o: (g == "Product") & o["price"].isNotNull() & F.coalesce(o["currency"].isin(*OFFER_CURRENCIES), F.lit(False)))
            return F.concat(facts, F.transform(offers, offer))

        return let(grp, both)

    return flat_map(found, of)


def overview_claims(nodes: Column) -> Column:
    """The first shown paragraph of 45 to 240 characters outside aside, nav and footer that is no "label: value"."""
    said = tagged(nodes, ("p",), lambda n: ~n["hidden"] & F.length(n["shown_text"]).between(45, 240) & ~n["shown_text"].rlike(r"(?U)^[\w /-]{2,45}:\s*\S"))
    first = let(_among(nodes, ("aside", "nav", "footer")), lambda around: F.slice(F.filter(said, lambda n: ~_inside(around, n)), 1, 1))
    return F.transform(first, lambda n: _claim(F.lit("Page"), F.lit("overview_text"), F.lit("On-page summary"), n["shown_text"], node_path(nodes, n["node_id"]), n["shown_text"], _pos(FROM_OVERVIEW, n["node_id"])))


def detail_claims(nodes: Column, rows: Column) -> Column:
    """Pairs of a label and a value: "label: value" in p and li, dt with the first later dd beside it, rows of two cells
    without spans; outside nav, footer, aside, script and template. The key follows when the label is folded."""
    pair = r"(?Ud)\A([^:]{2,40}):\s*(.{1,180})\z"

    def found(at: Column, place: Column, name: Column, value: Column, excerpt: Column) -> Column:
        return F.struct(at["node_id"].alias("node_id"), place["node_id"].alias("place"), name.alias("name"), value.alias("value"), excerpt.alias("excerpt"))

    said = tagged(nodes, ("p", "li"), lambda n: ~n["hidden"] & n["shown_text"].rlike(pair))
    said = F.transform(said, lambda n: found(n, n, F.regexp_extract(n["shown_text"], pair, 1), F.regexp_extract(n["shown_text"], pair, 2), n["shown_text"]))

    def term(dds: Column, t: Column) -> Column:
        beside = F.slice(F.filter(dds, lambda d: (d["parent_id"] == t["parent_id"]) & (d["node_id"] > t["node_id"])), 1, 1)
        return F.transform(F.filter(beside, lambda d: ~d["hidden"]), lambda d: found(t, d, t["shown_text"], d["shown_text"], d["shown_text"]))

    terms = let(tagged(nodes, ("dd",)), lambda dds: flat_map(tagged(nodes, ("dt",), lambda t: ~t["hidden"]), lambda t: term(dds, t)))
    two = F.filter(rows, lambda r: ~r["hidden"] & (F.size(r["cells"]) == 2) & ~r["spanned"])
    two = F.transform(two, lambda r: found(r, r["cells"][1], r["cells"][0]["shown_text"], r["cells"][1]["shown_text"], r["cells"][1]["shown_text"]))
    every = F.filter(F.concat(said, terms, two), lambda d: F.length(d["name"]).between(2, 40) & F.length(d["value"]).between(1, 180))

    def kept(around: Column, articles: Column) -> Column:
        return F.transform(F.filter(every, lambda d: ~_inside(around, d)), lambda d: _claim(F.lit("Details"), F.lit(None), d["name"], d["value"], node_path(nodes, d["place"]), d["excerpt"], _pos(FROM_DETAIL, d["node_id"]), in_article=_inside(articles, d)))

    return let(F.struct(_among(nodes, ("nav", "footer", "aside", "script", "template")).alias("a"), _among(nodes, ("article",)).alias("b")), lambda x: kept(x["a"], x["b"]))


def plan_names(nodes: Column, rows: Column) -> Column:
    """(plan_name, fold, name_idx): distinct shown h2-h4 texts of 1 to 60 characters, then cells of first rows
    after the first cell; of these the first MOST_NAMES, then without repeats and general headings."""
    name = lambda n: F.struct(n["shown_text"].alias("plan_name"), n["fold"].alias("fold"))
    heads = F.array_distinct(F.transform(tagged(nodes, ("h2", "h3", "h4"), lambda n: ~n["hidden"] & F.length(n["shown_text"]).between(1, 60)), name))
    cells = flat_map(tagged(nodes, ("table",)), lambda t: flat_map(first_row(rows, t), lambda r: F.transform(F.slice(r["cells"], F.lit(2), F.size(r["cells"])), name)))
    some = F.transform(F.slice(F.concat(heads, cells), 1, MOST_NAMES), lambda n, i: F.struct(n["plan_name"].alias("plan_name"), n["fold"].alias("fold"), (i + 1).alias("name_idx")))

    def once(every: Column) -> Column:
        return F.filter(every, lambda n, i: ~n["fold"].isin(*NO_PLANS) & ~F.exists(F.slice(every, F.lit(1), i), lambda e: e["plan_name"] == n["plan_name"]))

    return let(some, once)


def told_types(pages: DataFrame) -> DataFrame:
    """(page_key, t, looks): types that a page's entities and og:type tell, and once for each page a row without a type
    that says whether it looks like an article."""
    nodes = F.col("nodes")
    names = F.create_map(*[F.lit(x) for pair in PAGE_TYPES.items() for x in pair])
    about = flat_map(entities(nodes, F.col("scripts"), F.col("page_host"), F.col("page_path")), lambda x: F.transform(x["e"]["types"], lambda t: names[t]))
    og = F.filter(F.transform(metas(nodes, "property", "og:type"), lambda n: n["fold"]), lambda t: t.isin("article", "product"))
    looks = F.exists(nodes, lambda n: n["tag"] == "article") & F.exists(nodes, lambda n: n["tag"] == "time")
    return pages.select("page_key", looks.alias("looks"), F.explode(F.concat(F.filter(about, lambda t: t.isNotNull()), og, F.array(F.lit(None).cast("string")))).alias("t"))


def every_claim(pages: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Claims of every source (CLAIM, and `also` of the page), uncapped, and marks of what is wanted; one pass over the
    pages."""
    nodes, scripts = F.col("nodes"), F.col("scripts")

    def of(rows: Column) -> Column:
        said = F.concat(
            page_claims(nodes), entity_claims(entities(nodes, scripts, F.col("page_host"), F.col("page_path"))), overview_claims(nodes), detail_claims(nodes, rows), wanted_claims(),
        )
        plans = let(plan_names(nodes, rows), lambda names: plan_array(nodes, rows, names))
        none = F.lit(None)
        told = F.transform(said, lambda c: F.struct(c.alias("c"), none.cast("struct<field:string,plan_name:string,name_idx:int,scope_rank:int,order_id:int,scope_id:int,scope_path:string,node_id:int,path:string,text:string,raw:string>").alias("p")))
        more = F.transform(F.coalesce(plans, F.array().cast("array<struct<field:string,plan_name:string,name_idx:int,scope_rank:int,order_id:int,scope_id:int,scope_path:string,node_id:int,path:string,text:string,raw:string>>")), lambda p: F.struct(none.cast("struct<grp:string,key:string,label:string,value:string,currency:string,unit:string,billing_period:string,encoding:string,locator:string,excerpt:string,pos:array<bigint>,in_article:boolean>").alias("c"), p.alias("p")))
        return F.concat(told, more)

    rows = pages.select("page_key", *also, F.explode(let(table_rows(nodes), of)).alias("r"))
    return _plans_and_details(rows, also)


def _plans_and_details(rows: DataFrame, also: Sequence[str]) -> DataFrame:
    """What needs Arrow functions: folded labels of details, and numbers of plans. Rows that are neither pass through
    the same projection, so that nothing is read twice."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(PLAN_FIELDS) for x in (k, i)])
    titles = F.create_map(*[F.lit(x) for k, (_, t) in PLAN_FIELDS.items() for x in (k, t)])
    flat = parsed(rows.select("page_key", *also, "r.c", F.when(F.col("r.c").isNotNull(), F.lit("said")).otherwise(F.col("r.p.field")).alias("field"), *[F.col(f"r.p.{k}").alias(k) for k in ("plan_name", "name_idx", "scope_rank", "order_id", "scope_id", "scope_path", "node_id", "path", "text", "raw")]), ["c", *also], {"folded": casefold("c.label"), "folded_value": casefold(F.coalesce("c.value", "raw"))})
    detail = F.when(F.col("c.pos")[0] == FROM_DETAIL, F.col("folded"))
    slug = F.regexp_replace(F.regexp_replace(detail, r"(?U)\W+", "_"), "^_+|_+$", "")
    flat = flat.withColumn("slug", slug).where("slug is null or slug not in ('', 'cookie', 'privacy') and not (folded in ('price', 'cost', 'rate') and c.in_article)")
    said = F.col("c").isNotNull()
    place = _pos(FROM_PLAN, F.col("name_idx"), order[F.col("field")], F.col("scope_rank") * F.lit(1 << 31).cast("long") + F.col("order_id"), F.col("node_id"))
    # of what prices say, and of titles, only ASCII letters fold
    plan = {"grp": F.concat(F.lit("Plan: "), "plan_name"), "key": F.col("field"), "label": titles[F.col("field")], "pos": place, "folded_label": F.lower(titles[F.col("field")]), "folded_value": F.coalesce("folded_value", F.lower("value"))}
    own = {"folded_label": F.col("folded"), "folded_value": F.col("folded_value"), "key": F.when(F.col("slug").isNotNull(), F.concat(F.lit("detail:"), "slug")).otherwise(F.col("c.key"))}
    return flat.select("page_key", *also, *[F.when(said, own[c] if c in own else F.col(f"c.{c}")).otherwise(plan[c] if c in plan else F.col(c)).alias(c) for c in CLAIM[1:]])


def all_claims(pages: DataFrame) -> DataFrame:
    """Claims of every source in their fixed order, the first MOST_CLAIMS of each page, and marks of what is wanted;
    pos tells the order. The result is partitioned by page."""
    place = Window.partitionBy("page_key").orderBy("pos")  # marks come last
    ranked = every_claim(pages).withColumn("n", F.row_number().over(place))
    return ranked.where((F.col("n") <= MOST_CLAIMS) | (F.col("pos")[0] == WANTED)).select(CLAIM)


def both_sides(claimed: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Claims, and those made again of the retained bytes, as `confirmed` takes them."""
    return claimed.select(*CLAIM, F.lit(True).alias("claimed")).unionByName(regenerated.select(*CLAIM, F.lit(False).alias("claimed")))


def confirmed(both: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The claimed rows (CLAIM, claimed) that come up again among those that are not claimed, null-safe in all but their
    place, and all marks. Both sides move once, together, by page."""
    compared = CLAIM[:11]
    both = both.repartition("page_key")
    same = Window.partitionBy(*compared)
    kept = both.withColumn("again", F.bool_or(~F.col("claimed")).over(same)).where("claimed and (again or pos[0] = 9)")
    ranked = kept.withColumn("n", F.row_number().over(Window.partitionBy("page_key").orderBy("pos")))
    return ranked.where((F.col("n") <= MOST_CLAIMS) | (F.col("pos")[0] == WANTED)).select(*CLAIM, *also)


def claimed_and_again(captures: DataFrame) -> DataFrame:
    """Two rows for each of captures (page_key, url, html, raw, content_type): its html, claimed, and what the retained
    bytes decode to, with code. Where these differ the code is CAPTURE_DECODE_MISMATCH, and there is no html to take
    facts from."""
    rows = captures.select("page_key", "url", "html", decode_html("raw", "content_type")["text"].alias("again"))
    same = F.col("again").eqNullSafe(F.col("html"))
    sides = [F.struct(F.when(same, F.col(c)).alias("html"), F.lit(c == "html").alias("claimed")) for c in ("html", "again")]
    return rows.select("page_key", "url", F.when(~same, "CAPTURE_DECODE_MISMATCH").alias("code"), F.inline(F.array(*sides)))


def automatic_facts(captures: DataFrame) -> DataFrame:
    """Facts of captures, with code, overview_state and overview_text: claims are made of the html, made again of the
    retained bytes, and kept where both agree; one parse of either, one move, by page."""
    pages = dom.nodes(claimed_and_again(captures), also=["code", "claimed"])
    claims = every_claim(pages, ["code", "claimed"])
    return with_overview(facts(confirmed(claims, ["code"]), ["code"]))


def facts(claims: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """One row for each fact of each page, in display order (fact_idx from 0), MOST_FACTS at most.

    Claims of a (group, key) with one (value, currency, unit, period) are found in the source; several are
    ambiguous and keep one claim each as evidence and alternative. A page label with no claim but its mark is
    missing. A found fact whose label and value were shown before is left out, but plan and offer facts never are.
    """
    variants = claims.groupBy("page_key", *also, "grp", "key", "value", "currency", "unit", "billing_period").agg(F.min("pos").alias("pos"), F.min_by(F.struct("label", "encoding", "locator", "excerpt", "folded_label", "folded_value"), "pos").alias("c"))
    item = F.struct("pos", "value", "currency", "unit", "billing_period", "c.encoding", "c.label", "c.locator", "c.excerpt", "c.folded_label", "c.folded_value")
    found = variants.groupBy("page_key", *also, "grp", "key").agg(F.sort_array(F.collect_list(item)).alias("v"))
    found = found.withColumns({"mark": F.col("v")[0], "v": F.filter("v", lambda x: x["pos"][0] != WANTED)})
    n, first = F.size("v"), F.get("v", F.lit(0))
    one = n == 1
    what = ("value", "currency", "unit", "billing_period")
    every = found.select(
        "page_key", *also, "grp", "key", F.coalesce(first["label"], F.col("mark.label")).alias("label"), F.when(F.col("grp").rlike("^(Plan|Offer): "), F.regexp_replace("grp", "^(Plan|Offer): ", "")).alias("variant"),
        F.when(n == 0, "missing").when(one, "found_in_source").otherwise("ambiguous").alias("state"), *[F.when(one, first[c]).alias(c) for c in (*what, "encoding")],
        F.transform("v", lambda x: F.struct(x["locator"].alias("locator"), x["excerpt"].alias("excerpt"))).alias("evidence"),
        F.transform(F.when(n > 1, F.col("v")).otherwise(F.slice("v", 1, 0)), lambda x: F.struct(*[x[c].alias(c) for c in what])).alias("alternatives"), F.col("mark.pos").alias("pos"), F.col("mark.folded_label").alias("folded_label"),
        F.coalesce(F.when(one, first["folded_value"]), F.lit("none")).alias("folded_value"),  # what is shown where there is no value
    )
    rank = F.when(F.col("grp") == "Page", 0).when(F.col("grp").startswith("Plan: "), 1).otherwise(2)
    key_rank = F.coalesce(F.create_map(*[F.lit(x) for i, k in enumerate(KEY_ORDER) for x in (k, i)])[F.col("key")], F.lit(20))
    # groups come in the order of their first claim, keys within them likewise: the tie-break of the display order
    group_pos = F.min("pos").over(Window.partitionBy("page_key", "grp"))
    every = every.withColumns({"rank": rank, "key_rank": key_rank, "group_pos": F.when(F.col("state") == "missing", F.col("pos")).otherwise(group_pos)})
    every = every.withColumn("at", F.row_number().over(Window.partitionBy("page_key").orderBy("rank", "key_rank", "label", "group_pos", "pos")))
    same = Window.partitionBy("page_key", "folded_label", "folded_value", (F.col("state") == "found_in_source")).orderBy("at")
    every = every.withColumn("nth", F.row_number().over(same)).where("state <> 'found_in_source' or variant is not null or nth = 1")
    every = every.withColumn("fact_idx", F.row_number().over(Window.partitionBy("page_key").orderBy("at")) - 1).where(F.col("fact_idx") < MOST_FACTS)
    return every.drop("pos", "rank", "key_rank", "group_pos", "at", "nth", "folded_label", "folded_value")


#: What may stand as the overview of a page.
OVERVIEW = "key in ('page_description', 'overview_text', 'description') and state = 'found_in_source'"


def with_overview(facts: DataFrame) -> DataFrame:
    """facts with overview_state and overview_text: the first found description or summary of the page in display order."""
    page = Window.partitionBy("page_key").orderBy("fact_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    text = F.first(F.when(F.expr(OVERVIEW), F.col("value")), ignorenulls=True).over(page)
    return facts.withColumn("overview_text", text).withColumn("overview_state", F.when(F.col("overview_text").isNotNull(), "found_in_source").otherwise("missing"))


def page_types(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """(page_key, value, alternatives): the one type the page's entities, plans and og:type tell, an article where
    there is none but article and time elements, else general with what was told."""
    told = told_types(pages).select("page_key", "t", "looks")
    told = told.unionByName(claims.where(F.col("grp").startswith("Plan: ")).select("page_key", F.lit("saas_pricing").alias("t"), F.lit(False).alias("looks")))
    every = told.groupBy("page_key").agg(F.array_sort(F.collect_set("t")).alias("types"), F.bool_or("looks").alias("looks"))
    every = every.withColumn("types", F.when((F.size("types") == 0) & F.col("looks"), F.array(F.lit("article"))).otherwise(F.col("types")))
    one = F.size("types") == 1
    return every.select("page_key", F.when(one, F.col("types")[0]).otherwise("general").alias("value"), F.when(one, F.slice("types", 1, 0)).otherwise(F.col("types")).alias("alternatives"))
