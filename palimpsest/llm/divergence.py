"""Source divergence audit: how the word use of each source of a language differs from the other sources' and from the language's.

Relational throughout: terms are exploded and counted by group (language, source), each language keeps the terms that enough of
its documents have, groups meet the kept terms of their language so that zeros count too, smoothed shares are compared by a
self-join on language and term, and windows rank what comes out. Joins on the language alone, of which there are few, one
maybe with most of the rows, are dealt out by a salt; counts are combined before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import materialize

TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LEAST_DOCS, SMOOTHING, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Into so many parts a join on the language is dealt; the smaller side is repeated as often.
SALTS = 32


def lowered(text: Column) -> Column:
    """A-Z in lower case. Text of ASCII characters alone goes the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; docs is 0 nowhere."""
    terms = docs.select("lang", "source", F.regexp_extract_all(lowered(F.col("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    # Every occurrence once, and every different term of a document once more.
    listed = terms.select("lang", "source", F.explode(F.array(F.struct(F.lit(1).alias("n"), "terms"), F.struct(F.lit(0).alias("n"), F.array_distinct("terms").alias("terms")))).alias("x"))
    exploded = listed.select("lang", "source", F.col("x.n").alias("n"), F.explode("x.terms").alias("term"))
    return exploded.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum(1 - F.col("n")).alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term in parts of SCALE, exactly: numerators go beyond 64 bits."""
    return F.call_function("div", (n + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE), total + SMOOTHING * terms) + 1


def salted_join(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key``, of which there are few: rows of ``many`` are dealt out by ``by``, those of ``few`` repeated for each part."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [key, "salt"]).drop("salt")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows lang, source, part, item, value, rank for each group (lang, source) of ``docs`` (text, lang, source).

    Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z in lower case. A language keeps the V terms that ``least_docs`` of its
    documents have at least. A group's share of a kept term that it has n times is p = 1 + floor(10^9 (n + 5) / (N + 5 V)), N of its
    occurrences being of kept terms; a language's share q likewise. Part ``pair``: for each other source of the language the sum of
    the shares' differences over all kept terms, 0 without any. Part ``term``: the ``top`` kept terms that the group has and that exceed the
    language's share most, with the difference. Ranks go by value, largest first, then by item in order of bytes, so ties are settled.

    Null texts, languages and sources count as empty; an empty text has no terms, but its group has rows. Repeated rows count as often
    as they occur. Very long texts are taken whole, as one array of terms in a task. A language with one source has no pairs. An empty
    table gives no rows. Other columns, doc_id among them, aren't read.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = materialize(term_counts(docs), "terms")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    vocabulary = materialize(of_lang, "vocabulary")
    kept = materialize(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-terms")
    sizes = vocabulary.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = docs.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = materialize(groups.na.fill(0, ["total", "lang_total", "terms"]), "groups")

    dense = salted_join(vocabulary, groups, "lang", "term").join(kept, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    shares = materialize(dense.select("lang", "term", "source", "n", p.alias("p"), q.alias("q")), "shares")

    one, two = shares.select("lang", "term", "source", "p"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"))
    halves = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("r"))).alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")
    halves = halves.unionByName(salted_join(bare, bare.withColumnRenamed("source", "item"), "lang", "source").where("source < item").select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    halves = materialize(halves, "pairs")
    pairs = halves.unionByName(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    above = shares.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs.withColumn("rank", rank), "pair").unionByName(named(above.withColumn("rank", rank).where(F.col("rank") <= top), "term"))
