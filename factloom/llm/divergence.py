"""How far the sources of a language differ from each other and from the language, by exact integer term frequencies."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What a term is not made of (all of ASCII but letters), and the scale of a frequency.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
ONE = 1_000_000_000
#: Least documents of a language that hold a kept term; what is added to each count; terms reported of a group.
LEAST_DOCS, PRIOR, TOP = 10, 2, 10
#: Parts into which the kept terms of one language are dealt where groups meet them.
SALTS = 64


def terms_of(text: Column) -> Column:
    """The terms of a text in order, only A-Z lower-cased: the maximal matches of TERM, as what stands between those of its
    complement (a split costs a quarter of the time); an empty string where the text begins or ends with none."""
    return F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents of each term in each group; counts are summed in the
    task that reads the documents, before anything moves."""
    words = docs.select("lang", "source", F.sort_array(terms_of(F.col("text"))).alias("words"))
    # equal terms of a document stand together, so the first of each is the one that differs from the term before; outer,
    # as the planner would else filter on the size of the array and cut each text twice
    before = F.concat(F.array(F.lit("")), F.slice("words", 1, F.size("words") - 1))
    each = words.select("lang", "source", F.inline_outer(F.arrays_zip(F.col("words").alias("term"), before.alias("last")))).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("term") != F.col("last")).alias("docs"))


def frequency(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(ONE * (count + PRIOR) / (total + PRIOR * kept)), exact for counts of any size that a bigint holds."""
    over = (F.lit(ONE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)")).alias("over")
    return 1 + F.call_function("div", over, (total + PRIOR * kept).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for documents with text, lang and source, of which null reads as ''.

    A language keeps the terms that LEAST_DOCS of its documents hold. Each group (lang, source), also one without
    terms, meets each kept term of its language, with zero where the term is not there. Part `pair` compares a group
    with each other group of its language over all kept terms; part `term` ranks the TOP kept terms that the group uses
    more than its language does. A language of one source has no pairs; one without kept terms has pairs of value 0 and
    no terms. Repeated rows count as often as they occur; other columns are left behind; no rows give none.

    Every sum is combined before it moves. Groups meet terms under SALTS keys for each language, so a language with
    most of the rows is not one task; each pair of groups is compared once, and written in both directions.
    """
    read = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = materialize(term_counts(read), "term-counts")  # texts are read once, and each table below is made once
    terms = counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    terms = materialize(terms, "kept-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_count").alias("lang_total"))
    used = materialize(counts.select("lang", "source", "term", "count").join(terms.select("lang", "term"), ["lang", "term"], "left_semi"), "kept-counts")
    totals = used.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = materialize(read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total"]), "term-groups")

    salted = terms.join(langs, "lang").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    salted = salted.withColumn("q", frequency(F.col("lang_count"), F.col("lang_total"), F.col("kept"))).drop("lang_count", "lang_total")
    everywhere = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    dense = everywhere.join(salted, ["lang", "salt"]).drop("salt").join(used, ["lang", "source", "term"], "left").na.fill(0, ["count"])
    dense = dense.withColumn("p", frequency(F.col("count"), F.col("total"), F.col("kept"))).select("lang", "source", "term", "count", "p", "q")
    dense = materialize(dense, "dense-counts")

    a, b = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"))
    both = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(gap(F.col("p"), F.col("r"))).alias("value"))
    none = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source < item").withColumn("value", F.lit(0).cast("bigint"))
    once = materialize(both.unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "source-pairs")
    pairs = once.union(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    own = dense.where("count > 0 and p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [(pairs.withColumn("rank", rank), "pair"), (own.withColumn("rank", rank).where(F.col("rank") <= TOP), "term")]
    done = [part.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank") for part, name in parts]
    return done[0].unionByName(done[1])


#: The same rows by DuckDB, over a table named documents.
SQL = f"""
WITH read AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS words FROM documents),
each AS (SELECT row, lang, source, unnest(words) AS term FROM read),
terms AS (SELECT lang, term, count(*)::HUGEINT AS n FROM each GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*)::HUGEINT AS kept, sum(n)::HUGEINT AS total FROM terms GROUP BY lang),
used AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM each SEMI JOIN terms USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM read) g LEFT JOIN used USING (lang, source) GROUP BY ALL),
dense AS (SELECT lang, source, term, coalesce(u.n, 0) AS n, 1 + ({ONE} * (coalesce(u.n, 0) + {PRIOR})) // (g.total + {PRIOR} * kept) AS p, 1 + ({ONE} * (t.n + {PRIOR})) // (l.total + {PRIOR} * kept) AS q
    FROM groups g JOIN terms t USING (lang) JOIN langs l USING (lang) LEFT JOIN used u USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= {TOP}
"""
