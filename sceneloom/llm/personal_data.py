"""Personal data: generators propose overlapping spans, boosted trees judge their format and context, calibrated thresholds decide.

Each kind (email, ip, card, phone) has a strict pattern, whose valid matches are the base and always stay, and a wide one
that also proposes what the strict one misses: obfuscated addresses, numbers without a plus, what a match that is invalid has swallowed.
All proposals get a few features of small range. What is known of them is weak: a proposal counts as personal data if it is one of the
base, or if it is well formed, stands alone and follows a word that announces its kind; of what an invalid strict match has swallowed nothing is
known, and nothing learned; all others count as something else. Gradient boosting of trees of depth two
is fitted to the counts of feature patterns of all proposals (there are at most PATTERNS of them, however large the input),
of four fifths of the documents. On the last fifth, each kind gets the lowest threshold whose calibrated precision is PRECISION; a kind without one adds nothing.

DataFrame functions only. The texts are read once: what leaves that pass is, of each hit, its text, its surroundings and the length
of what stands between it and the last one; positions are running sums of those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, work_dir

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The strict patterns. They match what the plain ones in BASE do, at the same places, in time in proportion to the text: no run of characters is begun twice,
#: none is given back, and runs of digits too short for a card are not matched.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?@\x20?|\x20?[\[({]at[\])}]\x20?)", r"(?:\.|\x20?[\[({]dot[\])}]\x20?)"
#: The wide patterns. What stands in a longer word, as digits do in keys and hashes, is nothing to them.
WIDE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++{_AT}{_HOST}++(?:{_DOT}{_HOST}++)++",
    "ip": rf"(?<![0-9A-Za-z]){_OCTET}(?:(?:\.|\[\.\]|\(\.\)){_OCTET}){{3}}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}([\x20._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20._/-])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:00|\+)[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: What every match of a pattern holds, and what is found sooner: a text without it has none.
NEEDED_STRICT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}+", "phone": r"\+[0-9]"}
NEEDED_WIDE = {"email": r"@|[\[({]at[\])}]", "ip": r"[0-9](?:\.|\[\.\]|\(\.\))[0-9]", "card": "[0-9]{4}", "phone": "[0-9]{4}"}
#: Words that announce a kind, and words that announce numbers of other sorts; they end at most 12 characters before it.
ANNOUNCED = {"email": "e-?mail|contact|write to|reach", "ip": "ip|address|host|server", "card": "card|visa|mastercard|amex|credit", "phone": "phone|tel|call|mobile|fax|dial"}
OTHERWISE = "token|key|hash|sha|version|serial|order|isbn|id"
#: What is looked at before and after a hit, and the length of the shortest match of any pattern.
BEFORE, AFTER, SHORTEST = 24, 2, 4
#: Features and the numbers of their values.
FEATURES = {"left": 3, "right": 3, "hint": 3, "valid": 2, "size": 5, "shape": 4, "odd": 2}
PATTERNS = len(KINDS) * math.prod(FEATURES.values())
#: Rounds of boosting, how far each goes, and what keeps leaves small.
TREES, RATE, REGULAR = 40, 0.3, 1.0
#: Of held-out proposals at a threshold, this share has to be known as personal data, with so many of them at the threshold or above at least.
PRECISION, LEAST_HELD = 0.95, 20
#: Marks put around matches. A text that holds them is looked at with others instead.
_OPEN, _CLOSE = "\uE000", "\uE001"


def hits(text: Column, pattern: str, needed: str) -> Column:
    """An array of (gap, hit, before, after), one for each match: the characters since the last match, the match, and what stands around it, other matches included.

    needed: what each match of the pattern holds.
    """
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    pieces = F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)
    reach = 2 * -(-BEFORE // SHORTEST)  # so many pieces, half of them matches, hold what is looked at

    def one(pieces: Column, i: Column) -> Column:
        gap, then = F.get(pieces, i - 1), F.get(pieces, i + 1)
        near = F.when(F.length(gap) >= BEFORE, gap).otherwise(F.array_join(F.slice(pieces, F.greatest(i - (reach - 1), F.lit(1)), F.least(i, F.lit(reach))), ""))
        then = F.when(F.length(then) >= AFTER, then).otherwise(F.concat(then, F.coalesce(F.get(pieces, i + 2), F.lit(""))))
        return F.struct(F.length(gap).alias("gap"), F.get(pieces, i).alias("hit"), F.right(near, F.lit(BEFORE)).alias("before"), F.left(then, F.lit(AFTER)).alias("after"))

    own = lambda pieces: F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: one(pieces, i))
    found = F.element_at(F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 2, own(p))), 1)
    return F.coalesce(F.when(F.regexp_like(text, F.lit(needed)), found), F.array().cast("array<struct<gap:int,hit:string,before:string,after:string>>"))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, 19 at most, pass the check of card numbers."""
    value = lambda x, i: F.when((F.length(digits) - i) % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
    each = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x) % 10 == 0


def passes(kind: Column, hit: Column, n: Column, checked: Column) -> Column:
    """Whether a match of a strict pattern is valid. n is its number of digits, checked whether they pass luhn()."""
    return F.when(kind == "email", True).when(kind == "ip", F.regexp_like(hit, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))).when(kind == "card", n.between(16, 19) & checked).otherwise(n.between(8, 15))


def hint(kind: Column, before: Column) -> Column:
    """1 after a word that announces the kind, 2 after one of other sorts of numbers, or else 0."""
    said = lambda words: F.regexp_like(before, F.lit(rf"(?i)\b(?:{words})\b[^\n]{{0,12}}$"))
    own = F.lit(False)
    for k, words in ANNOUNCED.items():
        own = F.when(kind == k, said(words)).otherwise(own)
    return F.when(F.regexp_like(before, F.lit(r"[A-Za-z]{2}")), F.when(own, 1).when(said(OTHERWISE), 2).otherwise(0)).otherwise(0)


def features(kind: Column, hit: Column, before: Column, after: Column, n: Column, checked: Column) -> dict[str, Column]:
    """Format as small whole numbers. left, right: nothing or blank, another character, a letter or digit beside it. valid: well formed. size: how long. shape: how written. odd: what is unlikely in its kind."""
    beside = lambda x: F.when(x.isNull() | (x == "") | F.regexp_like(x, F.lit(r"^\s$")), 0).when(F.regexp_like(x, F.lit(r"^[\p{L}\p{N}]$")), 2).otherwise(1)
    has = lambda pattern: F.regexp_like(hit, F.lit(pattern))
    of_ip = F.regexp_like(F.regexp_replace(hit, r"[\[\](){}]", ""), F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    return {
        "left": beside(F.right(before, F.lit(1))),
        "right": beside(F.left(after, F.lit(1))),
        "valid": F.when(kind == "email", has(r"[.\]})]\x20?[A-Za-z]{2,24}$")).when(kind == "ip", of_ip).when(kind == "card", checked).otherwise(n.between(8, 15)).cast("int"),
        "size": F.when(kind.isin("email", "ip"), F.least(F.lit(4), F.floor(F.length(hit) / 8))).otherwise(F.when(n < 8, 0).when(n < 13, 1).when(n < 16, 2).when(n < 20, 3).otherwise(4)).cast("int"),
        "shape": F.when(kind == "email", F.when(has("@"), 0).otherwise(1)).when(kind == "ip", F.when(has(r"[\[(]"), 1).otherwise(0)).when(has(r"^\+"), 3).when(has(r"[\x20-]"), 1).when(has(r"[^0-9]"), 2).otherwise(0),
        "odd": F.when(kind == "email", has(r"\x20")).when(kind == "ip", has(r"^[0-9](?:\D+[0-9]){3}$")).when(kind == "card", ~has("^[3-6]")).otherwise(~has(r"[\x20().-]")).cast("int"),
    }


def proposals(docs: DataFrame, text_column: str, kept: list[Column], at: str) -> DataFrame:
    """A row for each row of docs, numbered by row, with kept and, for each kind, its hits; written to a folder and read back, so the numbers stay."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    text = F.replace(F.replace(text, F.lit(_OPEN), F.lit("~")), F.lit(_CLOSE), F.lit("~"))  # no pattern has these
    found = docs.select(*kept, text.alias("_text"))
    found = found.select("*", *[hits(F.col("_text"), of[k], needed[k]).alias(f"{name}_{k}") for name, of, needed in (("strict", STRICT, NEEDED_STRICT), ("wide", WIDE, NEEDED_WIDE)) for k in KINDS]).drop("_text")
    found.withColumn("row", F.monotonically_increasing_id()).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def candidates(found: DataFrame) -> DataFrame:
    """From proposals(), rows (row, fold, kind, begin, end, base, known, unsure, overlaps, and FEATURES): each proposed span once.

    base: valid by the strict pattern. known: personal data as far as is known. unsure: an invalid strict match of its kind has swallowed it.
    overlaps: it meets a span of the base, and is none itself.
    """
    listed = F.array(*[F.struct(F.lit(name == "strict").alias("strict"), F.lit(k).alias("kind"), F.col(f"{name}_{k}").alias("hits")) for name in ("strict", "wide") for k in KINDS])
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int")
    rows = found.select("row", fold.alias("fold"), F.explode(listed).alias("x")).select("row", "fold", "x.strict", "x.kind", F.posexplode("x.hits").alias("place", "h")).select("row", "fold", "strict", "kind", "place", "h.*")
    order = Window.partitionBy("row", "strict", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("row")  # all windows to come are within a row
    rows = rows.withColumn("end", (F.sum(F.col("gap") + F.length("hit")).over(order)).cast("long")).withColumn("begin", F.col("end") - F.length("hit"))
    # What is used more than once is a column first, so that it is made once.
    rows = rows.withColumn("digits", digits_of(F.col("hit")))
    rows = rows.withColumn("checked", F.when((F.col("kind") == "card") & F.length("digits").between(13, 19), luhn(F.col("digits"))).otherwise(False))
    own = [F.col("kind"), F.col("hit"), F.col("before"), F.col("after"), F.length("digits"), F.col("checked")]
    told = features(*own) | {"hint": hint(*own[:1], own[2])}
    rows = rows.select("row", "fold", "kind", "begin", "end", "strict", (F.col("strict") & passes(own[0], own[1], *own[4:])).alias("base"), *[told[k].alias(k) for k in FEATURES])
    # A span that both patterns propose is one. Its surroundings, and so its features, are the same in both.
    rows = rows.groupBy("row", "fold", "kind", "begin", "end").agg(F.max("base").alias("base"), F.max("strict").alias("strict"), F.max(F.struct(F.col("hint").alias("first"), *FEATURES)).alias("f")).select("row", "fold", "kind", "begin", "end", "base", "strict", *[F.col(f"f.{k}").alias(k) for k in FEATURES])
    def meets(other: Column, *within: str) -> Column:
        """Whether a span overlaps another one for which other holds."""
        order = Window.partitionBy("row", *within).orderBy("begin", "end", "kind")
        ends = F.max(F.when(other, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
        begins = F.min(F.when(other, F.col("begin"))).over(order.rowsBetween(1, Window.unboundedFollowing))
        return F.coalesce(ends > F.col("begin"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))

    announced = (F.col("hint") == 1) & (F.col("valid") == 1) & (F.col("left") < 2) & (F.col("right") < 2)
    swallowed = ~F.col("strict") & meets(F.col("strict") & ~F.col("base"), "kind")
    return rows.withColumns({"overlaps": meets(F.col("base")) & ~F.col("base"), "unsure": swallowed & ~announced, "known": F.col("base") | announced}).drop("strict")


@dataclass(frozen=True)
class Tree:
    """Two levels of equality tests: at the root and on either side. leaves: by the outcome of both, a value."""

    root: tuple[int, int]
    sides: tuple[tuple[int, int], tuple[int, int]]
    leaves: dict[tuple[bool, bool], float]

    def value(self, pattern: tuple[int, ...]) -> float:
        one = pattern[self.root[0]] == self.root[1]
        at, value = self.sides[one]
        return self.leaves[one, pattern[at] == value]


class Boosted:
    """Gradient boosting with logistic loss over counted patterns: {pattern: (n, known)}."""

    def __init__(self, counts: dict[tuple[int, ...], tuple[float, float]], trees: int = TREES, rate: float = RATE):
        n, known = (sum(x[i] for x in counts.values()) for i in (0, 1))
        self.start = math.log((known + 1) / (n - known + 1))
        self.trees: list[Tree] = []
        score = dict.fromkeys(counts, self.start)
        tests = sorted({(i, v) for p in counts for i, v in enumerate(p)})
        for _ in range(trees if tests else 0):
            slopes = {}
            for p, (m, k) in counts.items():
                chance = 1 / (1 + math.exp(-score[p]))
                slopes[p] = (k - m * chance, m * chance * (1 - chance))
            root = self._best(slopes, tests)
            sides = tuple(self._best({p: s for p, s in slopes.items() if (p[root[0]] == root[1]) == one}, tests) for one in (False, True))
            sums: dict[tuple[bool, bool], list[float]] = {(a, b): [0.0, 0.0] for a in (False, True) for b in (False, True)}
            for p, (g, h) in slopes.items():
                one = p[root[0]] == root[1]
                total = sums[one, p[sides[one][0]] == sides[one][1]]
                total[0] += g
                total[1] += h
            tree = Tree(root, sides, {k: rate * g / (h + REGULAR) for k, (g, h) in sums.items()})
            self.trees.append(tree)
            for p in score:
                score[p] += tree.value(p)

    @staticmethod
    def _best(slopes: dict, tests: list[tuple[int, int]]) -> tuple[int, int]:
        """The test that splits the slopes best, the first one of equals."""
        g_all, h_all = (sum(s[i] for s in slopes.values()) for i in (0, 1))
        split: dict[tuple[int, int], list[float]] = {}
        for p, (g, h) in slopes.items():
            for test in enumerate(p):
                total = split.setdefault(test, [0.0, 0.0])
                total[0] += g
                total[1] += h
        gain = lambda t: split[t][0] ** 2 / (split[t][1] + REGULAR) + (g_all - split[t][0]) ** 2 / (h_all - split[t][1] + REGULAR) if t in split else -1.0
        return max(tests, key=lambda t: (round(gain(t), 9), tuple(-x for x in t)))

    def score(self, pattern: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-(self.start + sum(t.value(pattern) for t in self.trees))))


def least_score(levels: list[tuple[float, int, int]]) -> float:
    """The lowest score that is right often enough, from rows (score, n, known) of held-out proposals by falling score; infinite if none is.

    The share that is known is calibrated to fall with the score: neighbouring levels of which the lower has the larger share are pooled. So each level answers for its own
    proposals, and many sure ones above do not cover for it.
    """
    pooled: list[list[float]] = []
    for score, n, known in levels:
        pooled.append([score, n, known])
        while len(pooled) > 1 and pooled[-1][2] * pooled[-2][1] > pooled[-2][2] * pooled[-1][1]:
            score, n, known = pooled.pop()
            pooled[-1] = [score, pooled[-1][1] + n, pooled[-1][2] + known]
    threshold, total = math.inf, 0
    for score, n, known in pooled:
        if known < PRECISION * n:
            break
        total += n
        if total >= LEAST_HELD:
            threshold = score
    return threshold


def accepted(counted: list[tuple[str, tuple[int, ...], bool, int, int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """From rows (kind, pattern, held out, n, known), the patterns that are personal data, with their scores. Each kind has a model and a threshold of its own."""
    found = {}
    for kind in KINDS:
        learned: dict[tuple[int, ...], tuple[float, float]] = {}
        held: dict[tuple[int, ...], tuple[int, int]] = {}
        for k, pattern, out, n, known in counted:
            if k == kind:
                into = held if out else learned
                m, j = into.get(pattern, (0, 0))
                into[pattern] = (m + n, j + known)
        if not learned:
            continue
        model = Boosted(learned)
        scores = {p: model.score(p) for p in {*learned, *held}}
        threshold = least_score([(s, *(sum(x) for x in zip(*(held[p] for p in held if scores[p] == s), strict=True))) for s in sorted({scores[p] for p in held}, reverse=True)])
        found |= {(kind, p): s for p, s in scores.items() if s >= threshold}
    return found


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carried: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, spans, and the columns carried), one for each row of docs; spans has (kind, begin, end, base, score, covered), by begin.

    Positions are code points, the end exclusive. The valid matches of the strict patterns are in it, with base true; others do not meet those
    nor each other: of proposals that overlap in a chain the best scored stays, of equals the longest, then the first. covered is where
    the spans before it end. A null or empty text has no spans, nor has one without a match. Rows of one id are rows of their own. An empty table gives no rows.
    """
    spark, at = docs.sparkSession, work_dir(docs.sparkSession, "personal")
    kept = [F.col(id_column).alias("doc_id"), *([F.struct(*[F.col(c) for c in carried]).alias("carried")] if carried else [])]
    found = proposals(docs, text_column, kept, f"{at}/hits")
    candidates(found).write.parquet(f"{at}/spans")
    spans = spark.read.parquet(f"{at}/spans")
    counted = spans.filter("not unsure").groupBy("kind", *FEATURES, (F.col("fold") == 0).alias("held")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("known").cast("long")).alias("known")).collect()  # 2 * PATTERNS rows at most
    taken = accepted([(r.kind, tuple(r[k] for k in FEATURES), r.held, r.n, r.known) for r in counted])
    taken = F.broadcast(spark.createDataFrame([(kind, *p, s) for (kind, p), s in sorted(taken.items())], f"kind string, {', '.join(f'{k} int' for k in FEATURES)}, score double"))  # PATTERNS rows at most
    spans = spans.join(taken, ["kind", *FEATURES], "left").filter("base or (score is not null and not overlaps)")
    spans = spans.repartition("row")
    # Added spans that overlap, directly or by others between them, are an island, of which one stays.
    order = Window.partitionBy("row", "base").orderBy("begin", "end", "kind")
    begins = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("begin"), F.lit(True))
    spans = spans.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy("row", "base", "island").orderBy(F.col("score").desc(), (F.col("end") - F.col("begin")).desc(), "begin", "kind"))
    spans = spans.withColumn("best", best).filter("base or best = 1")
    covered = F.max("end").over(Window.partitionBy("row").orderBy("begin", "end", "kind").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("covered", F.coalesce(covered, F.lit(0).cast("long")))
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "kind", "base", "score", "covered"))).alias("spans"))
    none = F.array().cast("array<struct<begin:bigint,end:bigint,kind:string,base:boolean,score:double,covered:bigint>>")
    return found.drop(*[f"{name}_{k}" for name in ("strict", "wide") for k in KINDS]).join(listed, "row", "left").withColumn("spans", F.coalesce("spans", none)).drop("row")


def written(spans: Column) -> Column:
    """Spans as kind:begin:end, by kind in the order of KINDS, then begin, with commas between."""
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    return F.array_join(F.transform(F.concat(*map(of, KINDS)), lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets, as in [email]; of spans that overlap the first names it. One more column, spans (_spans if there is one), says where they were."""
    found = find_spans(docs, id_column, text_column, docs.columns)
    text, spans = F.col(f"carried.{text_column}"), F.col("spans")
    between = F.transform(spans, lambda s: F.when(s["begin"] >= s["covered"], F.concat(F.substring(text, s["covered"].cast("int") + 1, (s["begin"] - s["covered"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    new = F.when(F.size(spans) > 0, F.concat(F.array_join(between, ""), F.substring(text, last.cast("int") + 1, F.length(text)))).otherwise(text)
    return found.select(*[(new if c == text_column else F.col(f"carried.{c}")).alias(c) for c in docs.columns], spans.alias(free_name(docs, "spans")))
