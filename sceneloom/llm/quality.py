"""Quality rules by weak supervision.

Each rule votes on a document: good (1), bad (-1), or abstains (0). How good each rule is, is not
given but estimated: expectation-maximisation fits a model in which a document is good with some
prior probability, and each rule votes independently given that. The posterior probability that a
document is good, given all its votes, replaces the demand that it pass every rule.

DataFrame functions only. The documents are read once, for their metrics, which are kept in the
shared folder. The model is fitted on the table of distinct vote patterns with their counts, which
has 3**len(RULES) rows at most, however many documents there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed

#: Documents with fewer words, or with more of their words in repeated windows, fail at once.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: A document is kept from this posterior probability of being good.
KEEP_FROM = 0.5
EM_ROUNDS, EM_TOLERANCE = 60, 1e-6
#: What is believed of the rules before the data: the chances of a vote on a good and on a bad document. It counts
#: as PRIOR_SHARE times the number of documents of each class, and keeps EM from swapping the classes.
PRIOR_GOOD, PRIOR_SHARE = 0.7, 0.1
PRIOR_VOTES = {1: (0.9, 0.5), 0: (0.09, 0.1), -1: (0.01, 0.4)}
PRIOR_BAD_ONLY = {1: (0.001, 0.001), 0: (0.989, 0.799), -1: (0.01, 0.2)}
#: The rules that can vote good too.
BOTH_WAYS = ("length", "symbols", "word_ends")
#: How words of prose end: in a letter, a digit, or a mark of punctuation.
PLAIN_END = r"[\p{L}\p{N}.,;:!?)\]\"'»”’…]"
#: Up to so many repeated windows are looked for one by one.
FEW = 48


def _bind(value: Column, then) -> Column:
    """then(value), with value computed once, however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeat_words(words: Column) -> Column:
    """How many of the words stand in a window of three words that occurs twice or more.

    The windows' hashes are sorted, so equal ones meet. The places of the repeated ones, in order, cover
    three words each, less what the next one covers too. Where many windows repeat, the hashes are sorted
    with their places; so time goes as n log n at most.
    """

    def windows(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def from_few(hashes: Column, twice: Column) -> Column:
        placed = F.transform(hashes, lambda x, i: F.when(F.array_contains(twice, x), i))
        return F.array_compact(placed)

    def from_many(hashes: Column) -> Column:
        same = lambda found, x, i: F.coalesce(F.get(found, i)["x"] == x["x"], F.lit(False))
        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("at"))))
        twice = _bind(placed, lambda found: F.filter(found, lambda x, i: same(found, x, i - 1) | same(found, x, i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda total, x: total + x)

    def count(hashes: Column) -> Column:
        twice = _bind(F.sort_array(hashes), lambda found: F.array_distinct(F.filter(found, lambda x, i: F.get(found, i - 1) == x)))
        places = _bind(twice, lambda twice: F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(F.size(twice) <= FEW, from_few(hashes, twice)).otherwise(from_many(hashes)))
        return _bind(places, covered)

    return F.when(F.size(words) >= 4, _bind(windows(words), count)).otherwise(0).cast("long")


def metrics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the metrics of each document. No other column of docs is kept."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = _bind(
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            F.size(F.filter(words, lambda w: ~F.regexp_like(w, F.lit(r"\p{Ll}")) & (F.lower(w) != w))).cast("long").alias("n_caps"),
            F.size(F.filter(words, lambda w: ~F.regexp_like(F.right(w, F.lit(1)), F.lit(PLAIN_END)))).cast("long").alias("n_odd_ends"),
            repeat_words(words).alias("n_repeat_words"),
        ),
    )
    of_lines = _bind(lines, lambda found: F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines")))
    symbols = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in "#*$%&|<>"), F.lit(0)).cast("long")
    found = docs.select(F.col(id_column).alias("doc_id"), of_words.alias("words"), of_lines.alias("lines"), symbols.alias("n_symbols"))
    return found.select("doc_id", "words.*", "lines.*", "n_symbols")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, Column]:
    """The votes, as columns over metrics(). Between its good and its bad range a rule abstains; some only ever vote bad."""
    never, mean = F.lit(False), _share("word_chars", "n_words")
    symbols, odd_ends = _share("n_symbols", "n_words"), _share("n_odd_ends", "n_words")
    return {
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < LEAST_WORDS),
        "symbols": _vote(symbols <= 0.02, symbols > 0.1),
        "word_ends": _vote(odd_ends <= 0.05, odd_ends > 0.25),
        "word_length": _vote(never, (mean < 2.2) | (mean > 12.0)),
        "lines": _vote(never, _share("n_dup_lines", "n_lines") > 0.3),
        "repeats": _vote(never, _share("n_repeat_words", "n_words") > 0.25),
        "capitals": _vote(never, _share("n_caps", "n_words") > 0.3),
    }


def fit(patterns: dict[tuple[int, ...], int], names: list[str]) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """The prior of good, and for each rule and vote the chances of that vote on a good and on a bad document.

    patterns has the number of documents of each vote pattern, of which there are 3**len(names) at most.
    """
    total = float(sum(patterns.values()))
    prior, chance = PRIOR_GOOD, {k: dict(PRIOR_VOTES if k in BOTH_WAYS else PRIOR_BAD_ONLY) for k in names}
    start, extra = {k: dict(v) for k, v in chance.items()}, max(1.0, PRIOR_SHARE * total)
    for _ in range(EM_ROUNDS if total else 0):
        good: dict[tuple[int, ...], float] = {}
        for votes in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[k][v][0] / chance[k][v][1]) for k, v in zip(names, votes, strict=True))
            good[votes] = 1 / (1 + math.exp(-odds))
        n_good = sum(n * good[votes] for votes, n in patterns.items())
        before, prior = prior, (n_good + extra * PRIOR_GOOD) / (total + extra)
        for i, k in enumerate(names):
            for v in (1, 0, -1):
                g = sum(n * good[votes] for votes, n in patterns.items() if votes[i] == v)
                b = sum(n * (1 - good[votes]) for votes, n in patterns.items() if votes[i] == v)
                chance[k][v] = ((g + extra * start[k][v][0]) / (n_good + extra), (b + extra * start[k][v][1]) / (total - n_good + extra))
        if abs(before - prior) < EM_TOLERANCE:
            break
    return prior, chance


def posterior(prior: float, chance: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """The probability that a document is good, given the votes in the columns named as the rules."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, by_vote in chance.items():
        said = {v: math.log(g / b) for v, (g, b) in by_vote.items()}
        odds = odds + F.when(F.col(k) == 1, said[1]).when(F.col(k) == -1, said[-1]).otherwise(said[0])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The metrics of each document with the votes (vote_<rule>), posterior, base_failed and kept.

    One row for each row of docs, repeated ids included; other columns are not carried, so none can
    clash. A null or empty text has no words, so base_failed is true. kept is false if base_failed is
    true, else whether the posterior is KEEP_FROM or more. An empty table gives an empty result.
    """
    names = list(rules())
    voted = checkpointed(metrics(docs, id_column, text_column)).withColumns(rules())
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # 3**len(names) rows at most
    prior, chance = fit({tuple(r[:-1]): r.n for r in counted}, names)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = voted.select("*", posterior(prior, chance).alias("posterior"), failed.alias("base_failed"))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))
    return judged.withColumnsRenamed({k: f"vote_{k}" for k in names})
