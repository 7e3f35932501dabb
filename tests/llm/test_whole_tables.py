"""The queries and the pipeline on whole small tables with planted cases, and the models against plain ones."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sceneloom.llm import common, mixing, quality, queries, token_counts, toxicity

from ..compare import assert_same

SF = "/root/testdata/sf0.01"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru") for b in ("ran", "sel", "tim", "vor", "wen", "lus", "dak", "pem", "rin", "tol")]


def plain_fit(votes, names):
    """Expectation-maximisation with one row a document."""
    n, prior = len(votes), quality.PRIOR_GOOD
    first = [quality.PRIOR_VOTES if k in quality.BOTH_WAYS else quality.PRIOR_BAD_ONLY for k in names]
    chance = [{v: np.array(pair) for v, pair in by.items()} for by in first]
    extra = max(1.0, quality.PRIOR_SHARE * n)
    for _ in range(quality.EM_ROUNDS):
        likely = np.array([prior, 1 - prior]) * np.prod([[chance[i][v] for v in votes[:, i]] for i in range(len(names))], axis=0)
        good = likely[:, 0] / likely.sum(axis=1)
        before, prior = prior, (good.sum() + extra * quality.PRIOR_GOOD) / (n + extra)
        weight = np.stack([good, 1 - good], axis=1)
        chance = [{v: (weight[votes[:, i] == v].sum(axis=0) + extra * np.array(first[i][v])) / (weight.sum(axis=0) + extra) for v in (1, 0, -1)} for i in range(len(names))]
        if abs(before - prior) < quality.EM_TOLERANCE:
            break
    return prior, chance


def test_expectation_maximisation():
    draw = np.random.default_rng(6)
    names = ["length", "symbols", "word_ends", "lines"]
    planted = [((0.8, 0.15, 0.05), (0.3, 0.2, 0.5)), ((0.9, 0.08, 0.02), (0.4, 0.1, 0.5)), ((0.85, 0.1, 0.05), (0.2, 0.1, 0.7)), ((0.0, 0.97, 0.03), (0.0, 0.6, 0.4))]
    good = draw.random(20_000) < 0.65
    votes = np.stack([np.where(good, draw.choice([1, 0, -1], 20_000, p=g), draw.choice([1, 0, -1], 20_000, p=b)) for g, b in planted], axis=1)
    patterns: dict = {}
    for row in map(tuple, votes.tolist()):
        patterns[row] = patterns.get(row, 0) + 1
    prior, chance = quality.fit(patterns, names)
    plain_prior, plain = plain_fit(votes, names)
    assert prior == pytest.approx(plain_prior, rel=1e-9)
    for i, k in enumerate(names):
        for v in (1, 0, -1):
            assert chance[k][v] == pytest.approx(tuple(plain[i][v]), rel=1e-8)
    assert prior == pytest.approx(0.65, abs=0.08)  # what was believed before pulls a little
    for i, k in enumerate(names[:3]):  # the planted accuracies come out, up to what was believed before
        assert chance[k][1][0] == pytest.approx(planted[i][0][0], abs=0.08) and chance[k][-1][1] == pytest.approx(planted[i][1][2], abs=0.15)


def test_quality_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality.judge(docs).collect()
    names = list(quality.rules())
    votes = np.array([[r[f"vote_{k}"] for k in names] for r in rows])
    prior, chance = plain_fit(votes, names)
    for r, own in zip(rows, votes, strict=True):
        g, b = prior * math.prod(chance[i][v][0] for i, v in enumerate(own)), (1 - prior) * math.prod(chance[i][v][1] for i, v in enumerate(own))
        assert r.posterior == pytest.approx(g / (g + b), rel=1e-6)
        assert r.kept == (not r.base_failed and r.posterior >= quality.KEEP_FROM)


def test_near_duplicates_miss_no_pair_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets, holders = {}, {}
    for r in docs:
        words = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(words[k : k + 2]) for k in range(max(1, len(words) - 1))} if words else set()
        for shingle in sets[r.doc_id]:
            holders.setdefault(shingle, []).append(r.doc_id)
    shared: dict = {}
    for ids in holders.values():
        for pair in itertools.combinations(sorted(ids), 2):
            shared[pair] = shared.get(pair, 0) + 1
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in links:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_near_duplicates(spark, SF).collect()}
    assert len(links) > 100 and found == {i: (len(s), root(i)) for i, s in sets.items()}


def test_token_counts_of_documents_longer_than_a_chunk(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    library = token_counts.ChunkedCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert library.plain
    texts = {1: " ".join(WORDS * 400), 2: "中文字" * 30_000, 3: "x" * 90_000, 4: "a\nb\t" * 20_000 + "é" * 40_000, 5: None, 6: "  " * 40_000 + "end ▁ ▁▁ of it"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op2_count_tokens(spark, str(tmp_path)).collect()}
    assert found == {i: (len((t or "").encode()), len(library.model.encode(t or ""))) for i, t in texts.items()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_match_their_sql(spark, name, sf):
    at = f"/root/testdata/{sf}"
    assert_same(queries.queries()[name](spark, at), at, queries.oracle_sql()[name])


def sentence(draw, n):
    return " ".join(draw.choice(WORDS, n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables: ids below 300 are plain, 300 on near copies, 400 on toxic, 500 on with benchmark passages, 600 on odd."""
    draw, at = np.random.default_rng(12), tmp_path_factory.mktemp("planted")
    text = {i: sentence(draw, 120) for i in range(300)}
    for i in range(300, 340):
        words = text[i - 300].split()
        words[int(draw.integers(0, 120))] = "changed"
        text[i] = " ".join(words)
    for i in range(400, 440):
        words = sentence(draw, 120).split()
        words[5] = words[60] = str(draw.choice(["zhukrax", "zhukrog", "krazhuk"]))
        text[i] = " ".join(words)
    items = [(k, sentence(draw, 30)) for k in range(5)]
    for i in range(500, 510):
        text[i] = f"{sentence(draw, 60)} {items[i % 5][1].upper()} {sentence(draw, 60)}"
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in text.items()] + [(600, None, None, None, None), (601, "", "en", "s1", 0), (602, " \n ", "en", None, 3), (None, sentence(draw, 90), "en", "s2", 1), (None, sentence(draw, 90), "en", "s2", 1), (603, sentence(draw, 40_000), "en", "s3", 1)]
    rows += [rows[7], (700, rows[8][1], "en", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name in ("shard", "slot", "_gone_id", "_gone_tie", "mix_shard", "key", "tie", "row", "doc_id2"):
        docs = docs.withColumn(name, F.lit(name))
    docs.repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items + [(9, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, 1, int(400 <= i < 440)) for i in text if i % 2 or i >= 400] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_each_stage_of_the_pipeline(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect() if r.doc_id is not None)
    all_ids = ids(docs)
    gone = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), planted).count() == 0
        if name not in ("mixing", "sharding"):
            found = stage(spark, docs, planted)
            assert found.columns == docs.columns and found.filter("doc_id is null").count() == 2
            left = ids(found)
            gone[name] = sorted(set(all_ids) - set(left))
            assert left == [i for i in all_ids if i not in gone[name]]
    assert set(gone["toxicity"]) == set(range(400, 440))
    assert gone["near duplicates"] == [*range(300, 340), 700]
    assert gone["decontamination"] == list(range(500, 510))
    mixed = corpus_pipeline.mixed(spark, docs, planted)
    targets = {r.source: r for r in mixing.plan_mix(docs)[1].collect()}
    got, largest, texts = {}, {}, {}
    for r in docs.collect():
        largest[r.source] = max(largest.get(r.source, 0), len((r.text or "").split()))
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in mixed.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert r.text in texts[r.doc_id]  # whole
    assert mixed.columns == docs.columns and all(abs(got.get(k, 0) - r.target) <= max(0.02 * r.target, largest[k] / 2) + 1 for k, r in targets.items())
    sharded = corpus_pipeline.sharded(spark, docs, planted)
    assert sharded.columns == [*docs.columns, "_shard", "_slot"] and ids(sharded) == all_ids


def test_the_whole_pipeline(spark, planted):
    rows = corpus_pipeline.run(spark, planted).collect()
    left = {r.doc_id for r in rows}
    assert not left & {*range(300, 340), *range(400, 440), *range(500, 510), 700}
    counts = [sum(r._shard == s for r in rows) for s in range(corpus_pipeline.SHARDS)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for s in range(corpus_pipeline.SHARDS):
        slots = sorted(r._slot for r in rows if r._shard == s)
        assert slots == list(range(len(slots)))
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, planted).collect()))


def test_shards_of_the_query_hold_each_document_once(spark):
    rows = queries.op1_shuffle_shards(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d.doc_id, len((d.text or "").encode()) + 16) for d in docs)


def test_toxic_rows_fall_by_their_own_text(spark):
    draw = np.random.default_rng(3)
    bad = lambda: sentence(draw, 40) + " zhukrax zhukrog"
    rows = [(i, bad() if i % 4 == 0 else sentence(draw, 42)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    odd = [(None, bad()), (None, sentence(draw, 42)), (1, bad()), (2, None)]
    own = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("_gone_id", F.lit(1)).withColumn("part", F.lit(1))
    left = toxicity.reject_toxic(own, labels)
    assert left.columns == own.columns
    expected = [r for r in [*rows, *odd] if not re.search("zhuk", r[1] or "")]
    assert sorted(map(str, (tuple(r)[:2] for r in left.collect()))) == sorted(map(str, expected))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Nothing:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "yarn"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("C", (), {"get": lambda self, k, d=None: d})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
