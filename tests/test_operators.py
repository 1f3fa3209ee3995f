"""Golden values and invariants of single operators."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.functions import dates, shapes, text as T, vectors
from facetspark.operators import cards, channels, context, coverage, graph, metrics, reports, select, similarity, stats, units
from facetspark.sources import files
from facetspark.streaming import incremental


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column, **values):
    return spark.range(1).select(column).first()[0]


def test_ranking_metrics_by_hand(spark):
    ranking = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, uid string, rank int")
    gains = spark.createDataFrame([("q", "a", 1.0), ("q", "c", 1.0), ("z", "a", 0.0)], "qid string, uid string, gain double")
    got = {r.qid: r for r in metrics.ranking_metrics(ranking, gains, 3).collect()}
    assert got["q"].ndcg == pytest.approx(1.5 / (1 + 1 / np.log2(3))) and got["q"].recall == 1 and got["q"].mrr == 1
    assert got["q"].judged == pytest.approx(2 / 3) and got["q"].ap == pytest.approx((1 + 2 / 3) / 2)
    assert (got["z"].ndcg, got["z"].recall, got["z"].success) == (0, 0, 0)


def test_fusion_orders_ties_by_id(spark):
    lists = [("q", u, r + 1, c, 1.0) for c, order in (("x", "abc"), ("y", "cba")) for r, u in enumerate(order)]
    lists.append(("q", "d", 1, "off", 0.0))
    fused = similarity.rrf(spark.createDataFrame(lists, "qid string, uid string, rank int, channel string, weight double"))
    assert [r.uid for r in fused.orderBy("rank").collect()] == ["a", "c", "b"]


def test_search_in_blocks_finds_the_same(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vec"))
    q = v.where("uid % 50 = 0").select(F.col("uid").alias("qid"), "vec")
    whole = sorted(rows(similarity.top_k(q, v, 5).select("qid", "uid", "rank")))
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 2000)
    assert sorted(rows(similarity.top_k(q, v, 5).select("qid", "uid", "rank"))) == whole
    with_null = v.unionByName(v.limit(1).select(F.lit(-5).cast("long").alias("uid"), F.lit(None).cast("array<float>").alias("vec")))
    assert sorted(rows(similarity.top_k(q, with_null, 5).select("qid", "uid", "rank"))) == whole


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.norm(a)) == 5 and one(spark, vectors.unit(a)) == [0.6, 0.8]
    assert one(spark, vectors.cosine(a, zero)) == 0 and one(spark, vectors.unit(zero)) == [0, 0]


@pytest.mark.parametrize("policy", ["mmr", "dpp", "cluster_round_robin", "outlier_harvest", "coverage_stratified"])
def test_policies_pick_distinct_units(spark, policy):
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(30, 32))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    pool = spark.createDataFrame([("q", i, float(rng.random()), vec[i].tolist(), i % 4 - 1) for i in range(30)], "qid string, uid long, rel double, vec array<double>, label int")
    got = select.POLICIES[policy](pool, 10).collect()
    assert len({r.uid for r in got}) == 10 and sorted(r.pos for r in got) == list(range(1, 11))


def test_mmr_without_diversity_is_top_k(spark):
    rel = [0.2, 0.9, 0.5, 0.7]
    pool = spark.createDataFrame([("q", i, r, np.eye(4)[i].tolist()) for i, r in enumerate(rel)], "qid string, uid long, rel double, vec array<double>")
    assert [r.uid for r in select.mmr(pool, 3, balance=1.0).orderBy("pos").collect()] == [1, 3, 2]


def test_largest_remainder_adds_up(spark):
    q = dict(rows(select.largest_remainder(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long"), 5, "k")))
    assert q == {"a": 2, "b": 2, "c": 1}


def test_text_functions(spark):
    col = F.lit("One two three four. Five six.\n\nSeven eight nine ten")
    assert one(spark, T.sentences(col)) == ["One two three four.", "Seven eight nine ten"]
    tokens = F.split(F.lit(" ".join(map(str, range(10)))), " ")
    assert one(spark, T.windows(tokens, 4, 1, 2)) == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    assert one(spark, T.windows(F.split(F.lit("a b"), " "), 4, 1, 2, F.lit("a \n b"))) == ["a \n b"]
    assert one(spark, T.windows(F.array().cast("array<string>"), 4, 1, 2)) == []
    assert one(spark, T.word_chunks(tokens, size=4)) == ["0 1 2 3", "4 5 6 7", "8 9"]
    assert one(spark, T.attributes(F.lit("Ann likes tea, old maps and , salt."))) == ("Ann", ["tea", "old maps and", "salt"])
    assert one(spark, T.attributes(F.lit(" no verb "))) == ("no verb", ["no verb"])
    assert one(spark, T.strip_quoted(F.lit("yes\n > no\nok\n-----ORIGINAL Message-----\nold"))) == "yes\nok"
    assert one(spark, T.strip_quoted(F.lit("a\n----- Forwarded by X"))) == "a"
    assert one(spark, T.strip_signature(F.lit("x" * 90 + "\nBest Regards,\nAnn"))) == "x" * 90
    assert one(spark, T.strip_signature(F.lit("x" * 90 + "\nThanks,\nyou\n-- \nAnn"))) == "x" * 90
    assert one(spark, T.strip_signature(F.lit("a\n-- \n" + "x" * 90))) == "a\n-- \n" + "x" * 90
    assert one(spark, T.clean_body(F.lit(" a \t b\n\n\n\nc\n> d"))) == "a b\n\nc"
    assert one(spark, T.normalise_answer(F.lit("The New  York!"))) == "new york"
    assert one(spark, T.container(F.lit("doc#x#3/7"))) == "doc#x" and one(spark, T.owner(F.lit("d#3/7"))) == "d#3" and one(spark, T.index_of(F.lit("d#3/7"))) == 3


def test_packing_keeps_every_word_within_the_budget(spark):
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(3 + 7 * i % 10)) + "." for i in range(20)) + "\n\n" + ". ".join("a b c" for _ in range(30))
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = units.pack(d, 12).orderBy("pos").collect()
    assert [w for r in got for w in text[r.start : r.end].split()] == text.split() and max(r.tokens for r in got) <= 12


def test_long_turns_fall_into_ten_groups(spark):
    t = spark.createDataFrame([(1, 0, "assistant", "\n".join(f"line number {i}" for i in range(23))), (1, 1, "user", "Hm."), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    got = {(r.turn, r.pos): r.part for r in units.split_turns(t).collect()}
    assert [got[0, i].count("\n") + 1 for i in range(10)] == [3, 3, 3] + [2] * 7 and got[1, 0] == "Hm."


def test_budget_take_truncates_once_and_stops(spark):
    u = spark.createDataFrame([("q", i, t) for i, t in enumerate([50, 70, 10])], "qid string, rank int, tokens long")
    got = context.budget_take(u, 100, ["qid"], ["rank"]).orderBy("rank").collect()
    assert [(r.taken, r.truncated) for r in got] == [(50, False), (50, True)]
    assert context.budget_take(u, 60, ["qid"], ["rank"], least=20).count() == 1


def test_supersession(spark):
    f = [(1, "s", 1, "x"), (2, "s", 2, "x"), (3, "s", 3, "y"), (4, "s", 3, "x"), (5, "s", 4, "x"), (6, "t", 1, "x"), (7, "t", None, "y"), (8, "s", 5, "z")]
    got = {r.id: r.superseded_at for r in context.supersede(spark.createDataFrame(f, "id int, slot string, clock int, object string")).collect()}
    want = {i: min((c2 for _, s2, c2, o2 in f if s2 == s and c2 and c and c2 > c and o2 != o), default=None) for i, s, c, o in f}
    assert got == want


def test_duplicate_share_and_expansion(spark):
    u = spark.createDataFrame([("q", 1, 10, ["a"]), ("q", 2, 30, ["a"]), ("q", 3, 10, ["a", "b"])], "qid string, take_order int, tokens long, turns array<string>")
    assert rows(context.duplicate_share(u)) == [("q", 0.6)]


def test_cooccurrence_and_pmi_by_hand(spark):
    occ = spark.createDataFrame([(u, p) for u, ps in enumerate(["abc", "ab", "c", "da"]) for p in ps] + [(0, "a")], "unit int, phrase string")
    edges = graph.cooccurrence(occ)
    assert {(a, b): n for a, b, n in rows(edges)} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("a", "d"): 1}
    freq = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "phrase string, f long")
    weight = {(r.a, r.b): r.weight for r in graph.pmi(edges, freq).collect()}
    assert weight["a", "b"] == pytest.approx(2 / 5 * np.log2(2 / 5 / (3 / 8 * 2 / 8)))
    assert weight["a", "d"] == pytest.approx(1 / 5 * np.log2(1 / 5 / (3 / 8 * 1 / 8)))


def test_hub_rule_takes_pronouns_and_the_most_frequent(spark):
    occ = [(i, "often", False) for i in range(9)] + [(i, "tied", False) for i in range(9)] + [(i, "it", i < 3) for i in range(5)] + [(i, "half", i < 2) for i in range(4)] + [(0, f"r{i}", False) for i in range(16)]
    d = spark.createDataFrame(occ, "unit int, phrase string, pron boolean")
    got = {r.phrase: (r.f, r.pronoun, r.hub) for r in graph.hub_rule(d, share=0.05).collect()}
    assert len(got) == 20 and got["often"] == (9, False, True) and got["tied"] == (9, False, False)
    assert got["it"] == (5, True, False) and got["half"] == (4, False, False)


def test_pruning_goes_by_degrees_of_the_whole_graph(spark):
    """The ego goes, then rare phrases; a phrase whose only edge led to the ego does no harm, and one edge is enough to stay."""
    e = [("a", "b", 5, 3, 0.5), ("a", "c", 5, 3, 0.4), ("a", "d", 5, 1, 0.9), ("b", "c", 3, 3, 1.0), ("b", "e", 3, 2, 0.2), ("d", "e", 1, 2, 0.7), ("e", "f", 2, 2, 0.0)]
    got = graph.prune(spark.createDataFrame(e, "a string, b string, fa int, fb int, weight double"))
    assert sorted((r.a, r.b) for r in got.collect()) == [("b", "c"), ("b", "e")]  # 40th percentile of 0, 0.2 and 1.0: 0.16


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_percentiles_are_exact_at_every_size(spark, n):
    x = np.random.default_rng(n).choice(np.concatenate((np.random.default_rng(1).normal(size=3000), [0.0] * 2000, [1e9])), n)
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    for share in (0.0, 0.05, 0.4, 0.5, 0.999, 1.0):
        assert stats.exact_percentile(d, "x", share) == pytest.approx(np.percentile(x, 100 * share), rel=1e-12)
    assert stats.exact_percentile(d.where("x IS NULL"), "x", 0.5) is None


def _pool_rows(seed, n=24):
    rng = np.random.default_rng(seed)
    vec = rng.normal(size=(n, 6))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    rel = np.round(rng.uniform(size=n), 2)
    return rel, vec, rng.integers(-1, 4, n)


def _by_relevance(rel):
    return sorted(range(len(rel)), key=lambda i: (-rel[i], i))


def mmr_by_hand(rel, vec, n):
    out = []
    while len(out) < n:
        gain = {i: 0.5 * rel[i] - 0.5 * (max(vec[i] @ vec[j] for j in out) if out else 0) for i in range(len(rel)) if i not in out}
        out.append(max(gain, key=lambda i: (round(gain[i], 12), -i)))
    return out


def dpp_by_hand(rel, vec, n):
    """The unit that makes the determinant of the chosen kernel largest, with quality exp(rel / 2)."""
    q = np.exp(np.array(rel) / 2)
    kernel = q[:, None] * (vec @ vec.T) * q
    out = []
    while len(out) < n:
        det = {i: np.linalg.det(kernel[np.ix_(out + [i], out + [i])]) for i in range(len(rel)) if i not in out}
        best = max(det, key=lambda i: (round(det[i], 12), -i))
        if det[best] < 1e-9:
            break
        out.append(best)
    return out


def harvest_by_hand(rel, n):
    order = _by_relevance(rel)
    tail = round(0.3 * n)
    return order[: n - tail] + [i for i in reversed(order[n - tail :]) if rel[i] >= 0.1][:tail]


def coverage_by_hand(rel, label, n):
    strata = {}
    for i in _by_relevance(rel):
        strata.setdefault(int(label[i]), []).append(i)
    out = [strata[c].pop(0) for c in (2, -1, 9) if strata.get(c)]
    full = [c for c in strata if strata[c]]
    share = max(1, (n - len(out)) // max(1, len(full)))
    for c in sorted(full, key=lambda c: (-len(strata[c]), str(c))):
        out += strata[c][:: max(1, len(strata[c]) // share)]
    return (out[:n] + [i for i in _by_relevance(rel) if i not in out[:n]])[:n]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_policies_choose_what_their_definitions_say(spark, seed):
    rel, vec, label = _pool_rows(seed)
    d = spark.createDataFrame([("q", i, float(rel[i]), [float(x) for x in vec[i]], int(label[i])) for i in range(len(rel))], "qid string, uid long, rel double, vec array<double>, label int")
    chosen = lambda df: [r.uid for r in df.orderBy("pos").collect()]
    assert chosen(select.mmr(d, 8)) == mmr_by_hand(rel, vec, 8)
    assert chosen(select.dpp(d, 6)) == dpp_by_hand(rel, vec, 6)
    assert chosen(select.outlier_harvest(d, 10, floor=0.1)) == harvest_by_hand(rel, 10)
    for n in (2, 10, 24):
        assert chosen(select.coverage_stratified(d, n, must_cover=(2, -1, 9))) == coverage_by_hand(rel, label, n)


def test_lazy_expansion_comes_after_the_kept_ranking(spark):
    kept = spark.createDataFrame([("q", 11, 1, 1), ("q", 25, 2, 2), ("q", 12, 1, 3), ("q", 30, 3, 4)], "qid string, uid long, container long, rank int")
    tail = spark.createDataFrame([("q", 13, 1, 5), ("q", 41, 4, 6)], "qid string, uid long, container long, rank int")
    owners = spark.createDataFrame([(11, 1, [1.0]), (13, 1, [0.2]), (21, 2, [0.9]), (25, 2, [0.1]), (31, 3, [5.0])], "uid long, container long, vec array<double>")
    asked = spark.createDataFrame([("q", [1.0])], "qid string, qvec array<double>")
    got = context.lazy_expand(kept, tail, owners, asked, 2).orderBy("pos").collect()
    assert [(r.uid, r.stage) for r in got] == [(11, 0), (25, 0), (12, 0), (30, 0), (21, 1), (13, 1), (41, 2)]


def test_two_cliques_are_two_communities(spark):
    e = [(a, b, 1.0) for base in (0, 5) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 5, 0.1)]
    got = dict(rows(graph.label_propagation(spark.createDataFrame(e, "a int, b int, weight double"))))
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]


def test_partition_cards_lose_no_span(spark):
    spans = spark.createDataFrame([(i, i // 3, i % 3, f"s{i}") for i in range(9)], "uid int, doc int, pos int, text string")
    scored = spark.createDataFrame([(i, a, k, ((i * 7 + a * 5 + k) % 11) / 11) for i in range(9) for a in (1, 2) for k in range(3)], "uid int, aspect int, anchor int, score double")
    best = cards.best_aspect(cards.aspect_scores(scored))
    got = cards.partition_cards(spans, best).collect()
    assert sorted(w for r in got for w in r.text.split()) == sorted(f"s{i}" for i in range(9))
    docs = spark.createDataFrame([(0, "x"), (7, "y" * 2000)], "doc int, text string")
    assert {r.doc: len(r.text) for r in cards.with_fallback(cards.partition_cards(spans, best), docs).collect()}[7] == 1500


def test_coverage_and_buckets(spark):
    shown = spark.createDataFrame([("q", "t1", 30), ("q", "t1", 25), ("q", "t2", 10)], "qid string, turn string, chars long")
    lengths = spark.createDataFrame([("t1", 100), ("t2", 100)], "turn string, length long")
    covered = coverage.turn_coverage(shown, lengths)
    assert {r.turn: r.covered for r in covered.collect()} == {"t1": True, "t2": False}
    evidence = spark.createDataFrame([("q", "t1"), ("q", "t2"), ("r", "t1")], "qid string, turn string")
    assert {r.qid: (r.recall, r.joint) for r in coverage.joint_recall(evidence, covered).collect()} == {"q": (0.5, False), "r": (0.0, False)}
    cases = spark.createDataFrame([(1, True, False, False, False), (2, False, False, True, True), (3, False, True, False, True), (4, False, True, True, False), (5, False, True, True, True)], "id int, refused boolean, located boolean, retrieved boolean, rendered boolean")
    assert [r.bucket for r in coverage.buckets(cases).orderBy("id").collect()] == [5, 1, 2, 3, 4]


def test_token_f1_and_tau(spark):
    p = spark.createDataFrame([(1, ["red", "red", "blue"], ["red", "blue", "blue"]), (2, [], ["x"])], "id int, p array<string>, g array<string>")
    assert {r.id: round(r.f1, 6) for r in metrics.token_f1(p, "id", F.col("p"), F.col("g")).collect()} == {1: round(2 / 3, 6), 2: 0.0}
    t = spark.createDataFrame([("k", i, i, y) for i, y in enumerate([1, 2, 2, 3])] + [("c", i, i, 1) for i in range(3)], "key string, id int, x int, y int")
    got = {r.key: r.tau for r in metrics.kendall_tau_b(t, "key", "x", "y", "id").collect()}
    assert got["k"] == pytest.approx(5 / np.sqrt(30)) and got["c"] is None


def test_statistics(spark):
    assert stats.mcnemar_exact(0, 0) == 1 and stats.mcnemar_exact(1, 9) == pytest.approx(2 * 11 / 1024)
    tests = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, test string, p double")
    assert {r.test: (round(r.holm_p, 6), r.significant) for r in stats.holm(tests, "family").collect()} == {"a": (0.03, True), "b": (0.06, False), "c": (0.06, False)}
    same = spark.createDataFrame([("t", i, 0.5, 0.5) for i in range(20)], "test string, qid int, a double, b double")
    assert rows(stats.sign_flips(same, "test", draws=1000)) == [("t", 1.0)]
    rng = np.random.default_rng(4)
    d = rng.normal(0.3, 1.0, 60)
    pairs = spark.createDataFrame([("t", i, 0.0, float(x), 1) for i, x in enumerate(d)], "test string, qid int, a double, b double, n int")
    p = stats.sign_flips(pairs, "test", draws=4000).first().p
    by_numpy = np.mean(np.abs((rng.choice([-1, 1], (20_000, 60)) * d).mean(axis=1)) >= abs(d.mean()))
    assert p == pytest.approx(by_numpy, abs=0.01)
    got = stats.bootstrap_interval(pairs, "test", "qid", "b", "n", draws=4000).first()
    want = np.quantile(d[rng.integers(0, 60, (20_000, 60))].mean(axis=1), [0.025, 0.975])
    assert (got.low, got.high) == pytest.approx(tuple(want), abs=0.05)


def test_phrases_meet_questions_by_word_boundaries(spark):
    q = spark.createDataFrame([("q", "new york city hall".split()), ("r", "newyork york".split())], "qid string, words array<string>")
    p = spark.createDataFrame([("a", ["new", "york"]), ("a", ["new", "york", "city"]), ("b", ["york"]), ("c", ["hall", "of"]), ("d", [])], "key string, words array<string>")
    assert sorted(rows(channels.phrase_matches(q, p))) == [("q", "a", "new york city"), ("q", "b", "york"), ("r", "b", "york")]


def test_lazy_walk_stops_after_barren_communities(spark):
    hits = spark.createDataFrame([("q", g, r) for r, g in enumerate("aabbccddee")], "qid string, grp string, rank int")
    members = spark.createDataFrame([("q", g, 10 * i + j, float(-j)) for i, g in enumerate("abcde") for j in range(3)], "qid string, grp string, uid int, score double")
    walk = lambda yes, **k: [(r.grp, r.tested, r.accepted) for r in channels.lazy_walk(hits, members, spark.createDataFrame([(y,) for y in yes], "uid int"), **k).orderBy("place").collect()]
    assert walk([0, 12]) == [("a", 3, 1), ("b", 3, 1), ("c", 3, 0), ("d", 3, 0), ("e", 3, 0)]
    assert walk([40]) == [("a", 3, 0), ("b", 3, 0), ("c", 3, 0)]
    assert walk([0], tests=5, each=2) == [("a", 2, 1), ("b", 2, 0), ("c", 1, 0)]


def test_alpha_ndcg_against_the_greedy_ideal(spark):
    topics = {"x": ["s", "t"], "y": ["s"], "z": ["u"], "w": []}
    sub = spark.createDataFrame([("q", u, s) for u, ss in topics.items() for s in ss], "qid string, uid string, subtopic string")
    pool = spark.createDataFrame([("q", u, i) for i, u in enumerate("wyzx", 1)], "qid string, uid string, rank int")
    got = reports.alpha_ndcg(pool, sub, pool).first()
    dcg = 0 + 1 / np.log2(3) + 1 / np.log2(4) + (0.5 + 1) / np.log2(5)
    ideal = 2 + 1 / np.log2(3) + 0.5 / np.log2(4)  # x, then z, then y
    assert (got.alpha_dcg, got.ideal, got.alpha_ndcg) == pytest.approx((dcg, ideal, dcg / ideal))


def test_quotas_with_one_at_least(spark):
    sizes = spark.createDataFrame([("a", 90), ("b", 5), ("c", 5), ("d", 1)], "k string, n long")
    assert dict(rows(select.least_one_quota(sizes, 10, "k"))) == {"a": 7, "b": 1, "c": 1, "d": 1}
    assert dict(rows(select.least_one_quota(sizes, 500, "k"))) == {"a": 90, "b": 5, "c": 5, "d": 1}


def test_buckets_and_readings(spark):
    cases = [(True, None, True, True, True), (False, True, False, False, False), (False, False, False, True, True), (False, None, True, False, True), (False, None, True, True, False), (False, False, True, True, True), (None, None, True, True, True)]
    d = spark.createDataFrame(cases, "primary boolean, second boolean, indexed boolean, found boolean, rendered boolean")
    assert [r.bucket for r in reports.failure_bucket(d).collect()] == [0, 5, 1, 2, 3, 4, 0]
    replies = spark.createDataFrame([('```json\n{"score": 0.5}\n```',), ('{"score": 1}',), ('{"score": 0.7}',), ("no",), ('{"score": true}',)], "r string")
    assert [r[0] for r in replies.select(reports.rubric_score(F.col("r"))).collect()] == [0.5, 1.0, None, None, None]
    letters = spark.createDataFrame([("b",), ("Answer: (C).",), ("(A",), ("B or C",), ("E",)], "r string")
    assert [r[0] for r in letters.select(reports.mcq_letter(F.col("r"))).collect()] == ["B", "C", "A", None, None]


def test_words_keep_their_white_space_in_chunks(spark):
    text = "  " + " \n".join(f"w{i}" for i in range(7)) + " "
    assert one(spark, T.spaced_chunks(T.spaced_words(F.lit(text)), 3, 1)) == ["w0 \nw1 \nw2", "w2 \nw3 \nw4", "w4 \nw5 \nw6"]
    assert one(spark, T.cut_to_tokens(T.words(F.lit("a b-c d-e-f g")), 4)) == 2 and one(spark, T.cut_to_tokens(T.words(F.lit("")), 4)) == 0
    assert one(spark, T.predicate(F.lit("Was born-in  City!"))) == "born_in"


def test_shapes_of_questions(spark):
    asked = {'who said "so"?': "lexical", "code a1b?": "lexical", "How LONG is it": "temporal", "in total": "cross-topic", "who is it": "multi-hop", "any tips": "thematic", "my dog": "entity", "is it Ann": "entity", "It is. And": "local", "is it I": "entity", "": "local"}
    got = spark.createDataFrame([(q,) for q in asked], "q string").select("q", shapes.shape(F.col("q"))).collect()
    assert {r[0]: r[1] for r in got} == asked
    assert one(spark, shapes.parse_label(F.lit(" Multi-Hop\n"))) == ("multi-hop", False) and one(spark, shapes.parse_label(F.lit("local."))) == ("local", True)


def test_dates(spark):
    assert str(one(spark, dates.chat_time(F.lit("1:56 pm on 8 May, 2023")))) == "2023-05-08 13:56:00" and one(spark, dates.chat_time(F.lit("soon"))) is None
    assert str(one(spark, dates.date_with_year(F.lit("on May 8, 2023, maybe")))) == "2023-05-08" and one(spark, dates.date_with_year(F.lit("May 8"))) is None
    assert one(spark, dates.date_range(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "unknown to present"


def test_mail_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "mail.tar.gz", "w:gz") as tar:
        for name, body in (("m/ann/sent/1", "From: a@x\nTo: b@x\nSubject: Hi\n\nhello there"), ("m/ann/deleted/1", "From: a@x\n\nno"), ("m/bob/Inbox/2", "Subject: none\n\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body.encode()))
    got = {r.path: r for r in files.read_mail_archives(spark, f"file://{tmp_path}/mail.tar.gz").collect()}
    assert set(got) == {"m/ann/sent/1", "m/bob/Inbox/2"} and got["m/ann/sent/1"].body.strip() == "hello there" and got["m/ann/sent/1"].custodian == "ann"


def test_datasets_keep_their_rules(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "g"), ("b", "g")], "id string, `group` string")
    good = spark.createDataFrame([("q", "g", ["a"])], "id string, `group` string, evidence_ids array<string>")
    assert {r.name: r.rows for r in files.write_dataset(corpus, good, f"file://{tmp_path}/d").collect()} == {"corpus": 2, "questions": 1}
    bad = spark.createDataFrame([("q", "g", ["z"]), ("q", "h", [])], "id string, `group` string, evidence_ids array<string>")
    assert {r.rule for r in files.integrity(corpus, bad).collect()} == {"repeated question", "unknown group", "dangling evidence"}
    with pytest.raises(ValueError, match="rules"):
        files.write_dataset(corpus, bad, f"file://{tmp_path}/e")


def test_json_lines_resume(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "id string, n int"
    for n in (1, 2):
        files.append_jsonl(spark.createDataFrame([("a", n)], schema), path)
    assert rows(files.read_latest_jsonl(spark, path, schema, "id", "n")) == [("a", 2)]
    assert rows(files.pending(spark.createDataFrame([("a", 0), ("b", 0)], schema), files.read_jsonl(spark, path, schema), "id")) == [("b", 0)]
    files.write_csv(spark.createDataFrame([(1.23456789, [1, 2]), (float("nan"), None)], "x double, y array<int>"), f"file://{tmp_path}/csv")
    assert sorted(rows(spark.read.option("header", True).csv(f"file://{tmp_path}/csv")), key=repr) == [("1.234568", "[1,2]"), (None, None)]


def test_nested_chats_in_numeric_order(spark):
    m = "id int, role string, content string, time_anchor string"
    data = [("c", {"plan-10": [(3, "user", "z", "")], "plan-2": [(2, "user", "y", None), (9, "user", " ", "x")], "plan-1": [(1, "user", "x", "Mar")], "plan-3": None})]
    chats = spark.createDataFrame(data, f"conversation_id string, plans map<string, array<struct<{m.replace(' ', ':').replace(',:', ',')}>>>")
    got = files.chat_messages(chats, files.plans_in_order(F.col("plans"))).orderBy("ordinal").collect()
    assert [(r.message_id, r.time_anchor) for r in got] == [(1, "Mar"), (2, "Mar"), (3, "x")]
    ids = files.occurrence_ids(spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "k string, o int"), "k", "o")
    assert sorted(r.occurrence_id for r in ids.collect()) == ["s", "s@occ2", "t"]


def test_streamed_items_are_assigned_like_a_batch(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vec"), "label")
    centroids = similarity.centroids(v, "label")
    v.select("uid", "vec").repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("uid long, vec array<float>").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    incremental.assign_stream(stream, centroids, f"file://{tmp_path}/a", f"file://{tmp_path}/r", f"file://{tmp_path}/c").awaitTermination(120)
    got = dict(rows(spark.read.parquet(f"file://{tmp_path}/a").select("uid", "label")))
    rest = {r.uid for r in spark.read.parquet(f"file://{tmp_path}/r").collect()}
    want = dict(rows(incremental.assign_batch(v, centroids).select("uid", "label")))
    assert got == {u: x for u, x in want.items() if x != -1} and rest == {u for u, x in want.items() if x == -1}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    q = incremental.windowed_counts(stream, "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()


def test_minhash_signatures_are_made_once_and_equal_the_plain_ones(spark, tmp_path):
    import hashlib
    import re

    from facetspark.operators import units
    from facetspark.plans import texts

    said = ["Ein Wort\tund  noch\x0bÄin wort", "a b c d", " a b c d e ", "A b c d x e", "", None, " ".join(f"w{i % 3000}" for i in range(9000)), " \n "]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")

    def plain(text):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if x]
        h = {int(hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:7], 16) for i in range(len(w) - 4)}
        return ",".join(str(min(x * ((i * 2654435761 + 1) % 2**32) % 2**32 for x in h)) for i in range(32)) if h else None

    got = {r.doc_id: r.signature for r in units.minhash_groups(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(said) if t and plain(t)} and len(got) == 4
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = texts.t21_minhash_signatures(spark, str(tmp_path))
    assert df.count() == 4 and not [f for f in df.inputFiles() if "documents.parquet" in f]


def test_tfidf_is_the_same_however_many_terms_are_broadcast(spark):
    from collections import Counter
    from math import log, sqrt

    from facetspark.operators import lexical

    said = {0: "aa bb bb cc", 1: "AA dd", 2: "aa bb x", 3: None, 4: "", 5: "aa ee ee ff gg"}
    docs = spark.createDataFrame(list(said.items()), "doc_id long, text string").unionByName(spark.createDataFrame([(5, "ee aa")], "doc_id long, text string"))
    said[5] += " ee aa"
    tf = {d: Counter(w for w in (t or "").lower().split() if len(w) > 1) for d, t in said.items()}
    df = Counter(w for c in tf.values() for w in c)
    w = {d: {t: n * (log((1 + 7) / (1 + df[t])) + 1) for t, n in c.items()} for d, c in tf.items()}
    want = {(d, t): round(x / sqrt(sum(y * y for y in c.values())), 9) for d, c in w.items() for t, x in c.items()}
    for held in (0, 2 * lexical.ROW_BYTES + 10, lexical.BLOCK_BYTES):
        assert {(r.doc_id, r.term): round(r.w, 9) for r in lexical.tfidf(docs, held).collect()} == want
