"""How text filters act on each other: what each removes, in every order, from one SQL CUBE.

Five filters fail a document or pass it; which ones is a pattern of five flags. A CUBE over the flags and the part counts
all patterns at all granularities. In the grouping set of a subset of filters, the row whose flags are all false
counts the documents that survive the subset. An order of filters is a chain of subsets, each with one filter more; so each
step of each order is a pair of subsets, joined, and what a step removes is the difference of their survivors.

DataFrame functions only. The texts are read once. What is left of a document is its id, its part, its flags
and a digest of its text; the CUBE is taken of the counts of patterns, of which there are 32 a part at most.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import words_of

FILTERS = "ABCDE"
#: The filter that looks at other documents: it fails copies.
COPIES = "E"
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text, true where it fails: few words, few distinct words, many capitals, symbols."""
    words = words_of(text)
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n_words < 200,
        "B": F.lit(100).cast("long") * distinct < F.lit(50).cast("long") * n_words,
        "C": F.lit(100).cast("long") * capitals > F.lit(2).cast("long") * F.length(text),
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """Rows (doc_id, part, digest, A to D, good, toxic, spread). spread is the id, or for a null id a number that keeps such rows apart."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), *[flag.alias(k) for k, flag in failures(F.col("text")).items()])
    own = own.withColumn("spread", F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("null"), F.spark_partition_id(), F.hash("digest"))))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("spread")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return own.join(known, "spread", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})


def pattern_counts(found: DataFrame) -> DataFrame:
    """From flagged(), rows (part, A to E, n, good, toxic): 32 a part at most.

    E is decided on groups, not on rows: of the rows of one text and part, those of the smallest id are counted apart, and
    the smallest of all parts passes. So a text with any number of copies is a row a part before it meets its other parts.
    """
    flags, one = [k for k in FILTERS if k != COPIES], F.lit(1).cast("long")
    counts = [F.sum(x.cast("long")).alias(k) for k, x in zip(COUNTS, (one, F.col("good"), F.col("toxic")), strict=True)]
    by_id = found.groupBy("spread", "doc_id", "part", "digest", *flags).agg(*counts)
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *COUNTS)))
    nameless = [F.sum(F.when(F.col("doc_id").isNull(), F.col(k)).otherwise(0)).alias(f"nameless_{k}") for k in COUNTS]
    by_text = by_id.groupBy("digest", "part", *flags).agg(least.alias("least"), *[F.sum(k).alias(k) for k in COUNTS], *nameless)
    by_text = by_text.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))  # a row a part at most
    passing = {k: F.col(f"nameless_{k}") + F.when(F.col("least.doc_id") == F.col("first"), F.col(f"least.{k}")).otherwise(0) for k in COUNTS}
    both = [F.struct(F.lit(False).alias(COPIES), *[x.alias(k) for k, x in passing.items()]), F.struct(F.lit(True).alias(COPIES), *[(F.col(k) - x).alias(k) for k, x in passing.items()])]
    split = by_text.select("part", *flags, F.explode(F.array(*both)).alias("x")).select("part", *flags, "x.*").filter("n > 0")
    return split.groupBy("part", *FILTERS).agg(*[F.sum(k).alias(k) for k in COUNTS])


def survivors(counts: DataFrame) -> DataFrame:
    """Rows (part, subset, n, good, toxic), for each part and each of the 32 subsets of filters, what passes all of the subset. subset has a bit for each filter, A the lowest."""
    bits = {k: 1 << i for i, k in enumerate(FILTERS)}
    selected = {k: F.grouping(k) == 0 for k in FILTERS}
    cube = counts.cube("part", *FILTERS).agg(*[F.sum(k).alias(k) for k in COUNTS], F.grouping("part").alias("all_parts"), sum((F.when(selected[k], b).otherwise(0) for k, b in bits.items()), F.lit(0)).alias("subset"))
    passed = cube.filter("all_parts = 0")
    for k in FILTERS:
        passed = passed.filter(F.col(k).isNull() | ~F.col(k))  # not in the subset, or false
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))).alias("subset"))
    return every.join(passed.select("part", "subset", *COUNTS), ["part", "subset"], "left").select("part", "subset", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """Rows (part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 for each part.

    A null text is an empty one, a null part an empty string. A copy fails E if any row of a smaller id has its text; rows of one id
    are no copies of each other, and a row of a null id neither fails E nor makes others fail. A document is good or toxic if any of
    its labels says so; null labels and labels of a null id say nothing. An empty table has no parts and gives no rows.
    Other columns are not looked at.
    """
    spark, last = docs.sparkSession, 2 ** len(FILTERS) - 1
    of = {k: 1 << i for i, k in enumerate(FILTERS)}
    steps = [("".join(order), i + 1, k, sum(of[x] for x in order[:i]), sum(of[x] for x in order[: i + 1]), of[k], last - of[k]) for order in permutations(FILTERS) for i, k in enumerate(order)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int, alone int, others int"))  # 600 rows
    left = survivors(pattern_counts(flagged(docs, labels, id_column, text_column, part_column)))
    # The survivors of all subsets, a row a part: a step reads two of them.
    left = left.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *COUNTS))).alias("by_subset"))
    chain = left.select("part", F.posexplode("by_subset").alias("before", "own"), "by_subset").join(steps, "before")
    at = lambda column, k: F.get("by_subset", F.col(column) if isinstance(column, str) else column)[k]
    gone = lambda k: F.col(f"own.{k}") - at("after", k)
    chain = chain.select(
        "part", "filter_order", "step", "filter", at("after", "n").alias("kept"), gone("n").alias("removed"), (at(F.lit(0), "n") - at("alone", "n") - gone("n")).alias("redundant"),
        (at("others", "n") - at(F.lit(last), "n")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"),
    )
    shares = chain.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return chain.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
