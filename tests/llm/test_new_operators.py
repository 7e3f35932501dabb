"""The filter audit, personal data and vector codes: against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.llm import filter_audit, personal_data, queries, vector_codes

from ..compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_vector_codes"])
def test_query_matches_its_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), SF, queries.oracle_sql()[name])


# ---- filter audit ----------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    flags, first = [], {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        said = labels.get(i, []) if i is not None else []
        flags.append((part or "", own, any(q == 1 for q, _ in said), any(t == 1 for _, t in said)))
    out = {}
    for part in {f[0] for f in flags}:
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in flags if f[0] == part]
            gone = []
            for step, k in enumerate(order, 1):
                removed = [f for f in left if f[1][k]]
                left = [f for f in left if not f[1][k]]
                everyone = [f for f in flags if f[0] == part]
                out[part, order, step] = [len(left), len(removed), sum(f[1][k] for f in gone), sum(f[1][k] and sum(f[1].values()) == 1 for f in everyone), sum(f[2] for f in removed), sum(f[3] for f in removed), k]
                gone += removed
                share[k] += len(removed)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                k = out[part, order, step].pop()
                out[part, order, step].append(share[k])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_against_every_order(spark):
    draw = np.random.default_rng(5)
    texts = [None, "", "   ", "UP " * 250, "a # b", *(" ".join(draw.choice([f"w{k}" for k in range(400)] + ["Up", "%"], int(n))) for n in draw.integers(0, 500, 30)), "same " * 3, " ".join(f"x{k}" for k in range(50_000))]
    rows = [(int(i) if i % 9 else None, texts[int(draw.integers(0, len(texts)))], ["s1", "s1", "s1", None, "", "s2"][int(draw.integers(0, 6))]) for i in range(220)]
    rows += [(5, "copy", "s1"), (5, "copy", "s2"), (5, "copy", "s1"), (7, "copy", "s1"), (None, "copy", "s1"), (4, None, "s3"), (300, "", "s3")]
    labels = [(int(i), int(i % 3 == 0), int(i % 4 == 0)) for i in range(0, 220, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], "doc_id long, text string, source string, part string, A int, digest string, good int").repartition(5)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    by: dict = {}
    for i, q, t in labels:
        by.setdefault(i, []).append((q, t))
    found = filter_audit.audit(docs, marked).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found} == plain_audit(rows, by)
    assert all(r.filter == r.filter_order[r.step - 1] for r in found) and len(found) == 600 * 4
    assert filter_audit.audit(docs.limit(0), marked).count() == 0
    alone = filter_audit.audit(docs.limit(3), marked.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(alone) == (0, 0)


# ---- vector codes -----------------------------------------------------------------------------------------------


def plain_lloyd(vectors, parts, entries, rounds):
    """vectors: whole numbers, by id. Every part with every entry, in Python's own integers."""
    wide = len(vectors[0]) // parts
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return codes, [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)], books


@pytest.mark.parametrize(("n", "rounds", "spread"), [(300, 2, 0.2), (40, 3, 0.01), (5, 2, 1.0), (200, 6, 50.0)])
def test_vector_codes_against_plain_lloyd(spark, n, rounds, spread):
    draw = np.random.default_rng(n)
    values = (draw.normal(size=(n, 8)) * spread).astype(np.float32)
    values[n // 2] = values[0]  # ties
    rows = [(int(i), [float(x) for x in v], int(i % 3) if i % 4 else None, "x", b"y") for i, v in enumerate(values)]
    odd = [(1000, None, 1, "x", b"y"), (1001, [1.0] * 7 + [None], 1, "x", b"y"), (-5, [float("nan")] * 8, 1, "x", b"y"), (-6, [float("inf")] + [0.0] * 7, 1, "x", b"y"), (-7, [float("-inf")] + [0.0] * 7, None, "x", b"y")]
    vectors = spark.createDataFrame(rows[::-1] + odd, "vec_id long, embedding array<float>, label int, keys string, codes binary").repartition(3)
    found, books = vector_codes.compress(vectors, parts=4, entries=16, rounds=rounds)
    codes, errors, plain = plain_lloyd([[math.floor(float(x) * 256) for x in v] for v in values], 4, 16, rounds)
    got = {r.vec_id: (list(r.codes), r.error) for r in found.collect()}
    assert got == {i: (codes[i], errors[i]) for i in range(n)} and books.entries.tolist() == plain
    of_label: dict = {}
    for i, _, label, *_ in rows:
        of_label[label] = of_label.get(label, 0) + errors[i]
    assert {(r.label, r.label_error) for r in vector_codes.with_label_errors(found).collect()} == set(of_label.items())
    back = {r.vec_id: r.vector for r in vector_codes.decoded(found, books).collect()}
    assert back[0] == pytest.approx([x / 256 for p, k in enumerate(codes[0]) for x in plain[p][k]])


def test_heaps_leave_most_parts_alone():
    draw = np.random.default_rng(1)
    middles = draw.integers(-4000, 4000, (8, 4))
    own = np.concatenate([m + draw.integers(-40, 40, (200, 4)) for m in middles])
    books = vector_codes.Codebooks(middles[None] + 3, np.zeros((1, 8)))
    codes, slack = vector_codes.nearest(own, books.entries[0])
    keys = vector_codes.keys_of(slack, books.drift[0][codes])
    counts = np.bincount(codes, minlength=8)
    sums = np.array([own[codes == e].sum(axis=0) for e in range(8)])
    moved = books.moved(sums[None], counts[None])
    popped = vector_codes.violated(codes, keys, moved.drift[0])
    again, _ = vector_codes.nearest(own, moved.entries[0])
    assert set(np.flatnonzero(again != codes)) <= set(popped) and len(popped) < len(own) // 10


def test_vector_codes_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    found, books = vector_codes.compress(none)
    assert found.count() == 0 and books is None
    same = spark.createDataFrame([(3, [1.0] * 16, None)] * 5 + [(None, [2.0] * 16, None), (3, [0.5] * 16, 1)], none.schema)
    found, books = vector_codes.compress(same)
    assert books.entries[:, :, 0].tolist() == [[128, 256, 256, 256, 256, 256, 512]] * 16  # unused entries stay
    assert sorted((r.vec_id or 0, r.codes[0], r.error) for r in found.collect()) == [(0, 6, 0), (3, 0, 0), *[(3, 1, 0)] * 5]
    for bad, message in (([1.0] * 15, "one length"), ([1.0] * 32, "one length")):
        with pytest.raises(ValueError, match=message):
            vector_codes.compress(same.unionAll(spark.createDataFrame([(9, bad, 1)], none.schema)))
    with pytest.raises(Exception, match="in the vector 9"):
        vector_codes.compress(same.unionAll(spark.createDataFrame([(9, [1e30] * 16, 1)], none.schema)))


# ---- personal data ------------------------------------------------------------------------------------------------


def luhn(digits):
    each = [int(c) for c in reversed(digits)]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(each)) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in personal_data.BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


PIECES = ["a@b.c", "a@b.c_d@e.f", "x.y@z", "@", "a@b..c", "é", "🎉", "1.2.3.4", "999.1.2.3.4", "1.2.3.4.5.6", "0001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111111111111112", "12 4111111111111111", "+1 (788) 555-0037", "+12", "+1 2345678 9", "+1-2-3 4.5.6.7", " ", "  ", "\n", "-", ".", "1", "22", "", "x", "call 555 0100 200", "tel: ", "card ", "%+_", "aa", "+", "(", ")", "$0", "\\1"]


def test_base_spans_against_plain_patterns(spark):
    draw = np.random.default_rng(7)
    texts = [None, "", *("".join(draw.choice(PIECES, int(n))) for n in draw.integers(1, 12, 3000)), "7" * 30_000, "1-" * 20_000, "a" * 50_000 + "@", "+1" * 10_000, "1." * 20_000, "a@" * 10_000, " ".join(["a@b.c 1.2.3.4"] * 3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = personal_data.find_spans(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        assert sorted((s.kind, s.begin, s.end) for s in r.spans if s.base) == sorted(plain_base(texts[r.doc_id])), texts[r.doc_id]
        ends = sorted((s.begin, s.end) for s in r.spans if not s.base)
        base = [(s.begin, s.end) for s in r.spans if s.base]
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(ends)) and not [1 for a in ends for b in base if a[0] < b[1] and b[0] < a[1]]


def test_no_text_is_passed_over(spark):
    """Numbers in any groups of digits and addresses with all points hidden are found, whatever else a text holds."""
    texts = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "411-111-111-111-111-1", "🎉 41 11 11 11 11 11 11 11 é", "x +1 2 3 4 5 6 7 8 y", "+1-2-3-4-5-6-7-8", "+1.2.3.4.5.6.7.8", "at 8[.]7[.]6[.]5 now", "at 8(.)7(.)6(.)5 now"]
    draw = np.random.default_rng(11)
    pieces = ["1", "7 ", "3-", "12", "4 1 1 1", "1-1", "0 ", "+1 ", "+2.", "5[.]", "6(.)", "9.", "a (at) b", "[dot]c", "@", "x", "é", " ", "(", "+1 2", "ip 1.2.3.4", "a@b.c", " 4111-1111-1111-1112 ", "tel 0121 555-0100 "]
    texts += ["".join(draw.choice(pieces, int(n))) for n in draw.integers(1, 25, 2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.spans for r in personal_data.find_spans(docs).collect()}
    for i, text in enumerate(texts):
        assert sorted((s.kind, s.begin, s.end) for s in found[i] if s.base) == sorted(plain_base(text)), text
    kinds = [(patterns[k], needed[k]) for patterns, needed in ((personal_data.STRICT, personal_data.NEEDED_STRICT), (personal_data.WIDE, personal_data.NEEDED_WIDE)) for k in personal_data.KINDS]
    for pattern, needed in kinds:
        both = docs.select("text", *[personal_data.hits(F.col("text"), pattern, x).alias(name) for name, x in (("own", needed), ("any", ""))]).collect()
        assert any(r["any"] for r in both)
        for r in both:
            assert r["own"] == r["any"], (pattern, r.text)
            at = 0
            for h in r["own"]:
                begin, at = at + h.gap, at + h.gap + len(h.hit)
                assert r.text[begin:at] == h.hit and h.before == r.text[max(0, begin - 24) : begin] and h.after == r.text[at : at + 2]
    hidden = docs.filter("doc_id in (6, 7)").select(personal_data.hits(F.col("text"), personal_data.WIDE["ip"], personal_data.NEEDED_WIDE["ip"])["hit"].alias("h")).collect()
    assert sorted(r.h for r in hidden) == [["8(.)7(.)6(.)5"], ["8[.]7[.]6[.]5"]]


def test_proposals_beyond_the_base(spark):
    """A number that a longer invalid match has swallowed is found; what looks like one, but isn't, is left alone."""
    draw = np.random.default_rng(3)

    def card():
        digits = "4" + "".join(map(str, draw.integers(0, 10, 14)))
        return next(digits + str(k) for k in range(10) if luhn(digits + str(k)))

    words = lambda: " ".join(draw.choice(["walk", "river", "of", "stones", "under"], 8))
    rows = [f"{words()} {card()} {words()}" for _ in range(300)] + [f"{words()} {str(int(card()) + 1)} {words()}" for _ in range(300)]
    swallowed = [(f"{words()} ", f"{int(card()) + 1} ", card(), f" {words()}") for _ in range(20)]
    rows += ["".join(x) for x in swallowed] + [f"id 1234 {words()}", "", None, *(f"{words()} key 3fa{int(card()[:13]) + k}be {words()}" for k in range(40))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in personal_data.find_spans(docs).collect()}
    for i in range(300):
        assert [s.kind for s in found[i]] == ["card"] and found[i][0].base and not found[300 + i]
    for k, x in enumerate(swallowed):
        (span,) = found[600 + k]
        assert not span.base and rows[600 + k][span.begin : span.end] == x[2] and 0.5 < span.score <= 1
    assert not any(s for k, s in found.items() if k >= 620)


def test_boosted_trees_learn_an_interaction():
    counts = {(a, b, c): (100, 95 if a == 1 and b == 2 else 3) for a in range(3) for b in range(3) for c in range(2)}
    model = personal_data.Boosted(counts)
    for p, (n, known) in counts.items():
        assert model.score(p) == pytest.approx(known / n, abs=0.03)
    assert personal_data.Boosted({(0,): (10, 10)}).score((0,)) > 0.9 and personal_data.accepted([]) == {}
    few = [("card", (1,), True, 10, 10), ("card", (1,), False, 10, 10), ("card", (0,), False, 90, 0)]
    assert personal_data.accepted(few) == {}  # too few held out to set a threshold by


def test_each_level_of_scores_answers_for_itself():
    assert personal_data.least_score([(0.99, 500, 500), (0.9, 30, 29), (0.2, 4, 0)]) == 0.9  # the last four would hide among the others
    assert personal_data.least_score([(0.99, 500, 480), (0.9, 100, 100), (0.2, 40, 0)]) == 0.9  # pooled, as the lower level is right more often
    assert personal_data.least_score([(0.99, 10, 10), (0.5, 5, 5), (0.3, 50, 10)]) == math.inf and personal_data.least_score([]) == math.inf
    assert personal_data.least_score([(0.99, 10, 10), (0.5, 15, 15)]) == 0.5 and personal_data.least_score([(0.7, 100, 10)]) == math.inf


def test_redaction(spark):
    rows = [(1, "mail a@b.cd, now", "q"), (1, "mail a@b.cd, now", "q"), (2, None, "q"), (3, "🎉 +1 (788) 555-0037 🎉 1.2.3.4", None), (None, "x@y.zz", "q"), (4, "+1-2-3 4.5.6.77", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumns({c: F.lit(c) for c in ("row", "kind", "_text", "carried", "strict_card")})
    found = personal_data.redact(docs)
    assert found.columns == [*docs.columns, "_spans"]
    got = sorted(((r.doc_id or 0), r.text or "", r.spans or "", r.row, r.carried) for r in found.collect())
    assert got == sorted((i, t, s, "row", "carried") for i, t, s in [(1, "mail [email], now", "q"), (1, "mail [email], now", "q"), (2, "", "q"), (3, "🎉 [phone] 🎉 [ip]", ""), (0, "[email]", "q"), (4, "[phone]", "q")])
    assert personal_data.redact(docs.limit(0)).count() == 0 and personal_data.find_spans(docs.limit(0)).count() == 0
