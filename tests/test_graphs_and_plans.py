"""Communities, placebo links, shard plans and alignments against plain versions."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from facetspark.operators import communities, graph, metrics, order, placebo


def quality(edges, member):
    """Modularity by its definition."""
    total = sum(w for _, _, w in edges)
    inside, degree = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            degree[member[x]] = degree.get(member[x], 0) + w
        if member[a] == member[b]:
            inside[member[a]] = inside.get(member[a], 0) + w
    return sum(inside.get(c, 0) / total - (d / (2 * total)) ** 2 for c, d in degree.items())


def partitions(n):
    """All set partitions as restricted growth strings."""
    def grow(prefix, most):
        if len(prefix) == n:
            yield prefix
            return
        for c in range(most + 2):
            yield from grow([*prefix, c], max(most, c))
    return grow([0], 0)


def found(spark, edges, **more):
    rows = communities.modularity_communities(spark.createDataFrame(edges, "a long, b long, weight double"), **more).collect()
    sizes = {r.community: r.size for r in rows}
    assert [sizes[c] for c in sorted(sizes)] == sorted(sizes.values(), reverse=True) and sorted(sizes) == list(range(len(sizes)))
    return {r.id: r.community for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_are_near_the_best_of_all_partitions(spark, seed):
    rng = random.Random(seed)
    nodes = range(8)
    edges = [(a, b, float(rng.randint(1, 5))) for a, b in itertools.combinations(nodes, 2) if rng.random() < (0.8 if a // 4 == b // 4 else 0.25)]
    edges += [(3, 3, 2.0), (edges[0][1], edges[0][0], 1.0)]
    got = found(spark, edges)
    best = max(quality(edges, dict(enumerate(p))) for p in partitions(8))
    assert quality(edges, got) >= 0.9 * best
    member = spark.createDataFrame(list(got.items()), "id long, community long")
    assert communities.modularity(spark.createDataFrame(edges, "a long, b long, weight double"), member) == pytest.approx(quality(edges, got))


def test_cliques_in_a_ring_are_found(spark):
    edges = [(c * 5 + i, c * 5 + j, 1.0) for c in range(6) for i, j in itertools.combinations(range(5), 2)] + [(c * 5, (c * 5 + 6) % 30, 1.0) for c in range(6)]
    got = found(spark, edges)
    assert len(set(got.values())) == 6 and all(len({got[c * 5 + i] for i in range(5)}) == 1 for c in range(6))


def test_communities_of_odd_graphs(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, 2, 0.0), (3, None, 1.0), (4, 4, 1.0)]) == {4: 0}
    rows = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    split = communities._connected(communities._both_ways(rows.withColumn("weight", F.lit(1.0))), spark.createDataFrame([(i, 7 if i < 10 or i > 30 else 8) for i in range(41)], "id long, c long"))
    assert {r.id: r.c for r in split.collect()} == {i: 0 if i < 10 else 10 if i <= 30 else 31 for i in range(41)}


def test_placebo_keeps_degrees_and_repeats_nothing(spark):
    rng = random.Random(5)
    links = sorted({(f"t{min(rng.randint(0, 14), rng.randint(4, 18))}", rng.randint(0, 39)) for _ in range(120)})
    rows = [(t, c, i / 7) for i, (t, c) in enumerate(links)]
    df = spark.createDataFrame(rows, "topic string, community long, w double")
    got = placebo.placebo_links(df).collect()
    assert not any(r.coincident or r.repeated for r in got) and len({(r.topic, r.community) for r in got}) == len(links)
    assert not {(r.topic, r.community) for r in got} & set(links)
    assert sorted(r.community for r in got) == sorted(c for _, c in links)
    assert sorted((r.topic, round(r.w, 9)) for r in got) == sorted((t, round(w, 9)) for t, _, w in rows)
    again = placebo.placebo_links(df.repartition(7, "w")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) != sorted(map(tuple, placebo.placebo_links(df, seed=7).collect()))


def test_placebo_marks_what_cannot_be_repaired(spark):
    whole = spark.createDataFrame([(t, c, 1.0) for t in "ab" for c in (1, 2)], "topic string, community long, w double")
    got = placebo.placebo_links(whole).collect()
    assert len(got) == 4 and all(r.coincident for r in got)
    assert placebo.placebo_links(whole.limit(0)).collect() == []


def test_placebo_rounds_write_no_links(spark, monkeypatch):
    rng, sizes = random.Random(6), []
    links = sorted({(min(rng.randint(0, 60), rng.randint(0, 60)), rng.randint(0, 60)) for _ in range(1000)})
    df = spark.createDataFrame([(t, c, 1.0) for t, c in links], "topic long, community long, w double")

    def recorded(table, f=placebo.written):
        out = f(table)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(placebo, "written", recorded)
    monkeypatch.setattr(placebo, "TRIES", 1)
    monkeypatch.setattr(placebo, "PARTNERS", 2)
    got = placebo.placebo_links(df, rounds=3).collect()
    assert sum(n == len(links) for n in sizes) == 4  # named, two orders and the match; the rounds add none
    assert sorted(r.community for r in got) == sorted(c for _, c in links) and sorted(r.topic for r in got) == sorted(t for t, _ in links)
    assert sorted(map(tuple, got)) == sorted(map(tuple, placebo.placebo_links(df, rounds=3, distinct=True).collect()))


def test_placebo_of_repeated_and_null_links(spark, monkeypatch):
    rng = random.Random(8)
    links = [(rng.choice([None, *"abcdefghij"]), rng.choice([None, *range(12)]), rng.randint(0, 2) / 7) for _ in range(60)]
    df = spark.createDataFrame(links, "topic string, community long, w double")
    got = placebo.placebo_links(df, rounds=4).collect()
    pairs, given = Counter((r.topic, r.community) for r in got), {(t, c) for t, c, _ in links}
    assert all(r.coincident == (None not in (r.topic, r.community) and (r.topic, r.community) in given) for r in got)
    assert Counter((r.topic, r.community) for r in got if r.repeated) == Counter({p: n - 1 for p, n in pairs.items() if n > 1})
    assert Counter(r.community for r in got) == Counter(c for _, c, _ in links) and Counter((r.topic, r.w) for r in got) == Counter((t, w) for t, _, w in links)
    monkeypatch.setattr(placebo, "SMALL", 0)  # every join is shuffled, and swaps are put in place at once
    assert Counter(map(tuple, placebo.placebo_links(df, rounds=4).collect())) == Counter(map(tuple, got))


def plan_by_hand(sizes, target):
    out, shard, held = [], 0, 0
    for n in sizes:
        out.append(shard)
        held += n or 0
        if held >= target:
            shard, held = shard + 1, 0
    return out


@pytest.mark.parametrize("case", [0, 1, 2, 3])
def test_shard_plan_equals_the_sequential_one(spark, case):
    rng = random.Random(case)
    sizes = [[rng.choice([0, 0, 1, 2, 3, 9, 40, None]) for _ in range(160)], [5] * 33, [0] * 6, [100, 0, 0, 1, 0, 250, 3]][case]
    df = spark.createDataFrame(list(enumerate(sizes)), "qid long, n long").repartition(5)
    got = [r.shard for r in order.shard_plan(df, ["qid"], "n", 12).orderBy("qid").collect()]
    assert got == plan_by_hand(sizes, 12)


def test_numbers_and_sums_follow_the_order(spark):
    rows = [(i * 7919 % 503, i % 5) for i in range(503)]
    got = order.numbered(spark.createDataFrame(rows, "k long, v long").repartition(9), ["k"], "pos", {"upto": "v"}).orderBy("k").collect()
    total = 0
    for i, r in enumerate(got):
        total += r.v
        assert (r.pos, r.upto) == (i, total)


def aligned_by_hand(n_candidates, n_references, yes):
    used, out = set(), {}
    for c in range(n_candidates):
        for r in range(n_references):
            if r not in used and (c, r) in yes:
                used.add(r)
                out[c] = r
                break
    return out


def test_first_unused_equals_the_sequential_match(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for q in range(12):
        yes = {(c, r) for c in range(9) for r in range(7) if rng.random() < 0.3}
        rows += [(q, c, r) for c, r in yes]
        want |= {(q, c): r for c, r in aligned_by_hand(9, 7, yes).items()}
    got = metrics.first_unused(spark.createDataFrame(rows + rows[:5], "qid long, cand int, ref int"))
    assert {(r.qid, r.cand): r.ref for r in got.collect()} == want


def test_event_order_by_hand(spark):
    refs = spark.createDataFrame([(q, i, t) for q in (1, 2, 3) for i, t in enumerate("abc")], "qid long, ref int, text string")
    cands = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "c"), (2, 0, "q")], "qid long, cand int, text string")
    matches = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "qid long, cand int, ref int")
    got = {r.qid: r for r in metrics.event_order(refs, cands, matches).collect()}
    # question 1 reads b, a, c: all three found, one pair of three in the wrong order
    assert (got[1].precision, got[1].recall, got[1].f1) == (1, 1, 1) and got[1].tau_norm == pytest.approx((1 / 3 + 1) / 2)
    # question 2 reads q: ranks 1, 2, 3, 5 against 5, 5, 5, 1
    assert (got[2].precision, got[2].recall, got[2].f1, got[2].final_score) == (0, 0, 0, 0) and got[2].tau_norm == pytest.approx((1 - 3 / (6 * 3) ** 0.5) / 2)
    assert got[3].tau_norm is None and got[3].final_score is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_tables_of_a_graph_are_not_broadcast(spark):
    occ = spark.createDataFrame([(u, f"p{(u * 7 + i) % 23}") for u in range(40) for i in range(5)], "unit long, phrase string")
    freq = occ.groupBy("phrase").agg(F.count("*").alias("f"))
    edges = graph.pmi(graph.cooccurrence(occ), freq)
    vectors = graph.topic_vectors(occ, occ.select("unit").distinct().selectExpr("unit", "unit % 2 AS topic", "1.0D AS p"), F.broadcast(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "topic long, i int, x double")))
    member = freq.selectExpr("phrase AS id", "ascii(phrase) AS community")
    for df, joins in ((edges, 0), (graph.topic_factor(edges, vectors), 2), (graph.diagnostics(edges, member), 0)):
        assert plan_of(df).count("BroadcastHashJoin") <= joins  # topics alone are broadcast, for either end


def test_two_hops_follow_a_shared_seed_once(spark, monkeypatch):
    links = [(a, 100 + b) for a in range(12) for b in range(12) if (a * b + a) % 3 == 0]
    seeds = [(q, q % 3) for q in range(300)] + [(0, None), (1, 7), (1, 7), (2, 999)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set(seeds)
    for q, n in seeds:
        one = near.get(n, set())
        want |= {(q, x) for x in one} | {(q, y) for x in one for y in near[x]}
    sizes, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: sizes.append(df.count()) or real(df))
    got = graph.expand(spark.createDataFrame(seeds, "qid long, node long"), spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(str, got.collect())) == sorted(f"Row(qid={q}, node={n})" for q, n in want)
    assert max(sizes[2:]) <= 5 * 24  # four seeds with links and one without, whatever the number of questions


def test_next_values_are_read_in_one_pass(spark):
    asked, values = spark.range(0, 900, 7).select(F.col("id").alias("key")), spark.range(3, 800, 13).select(F.col("id").alias("v"))
    got = order.next_value(asked, values)
    assert "unboundedfollowing" not in plan_of(got).lower()
    assert {r.key: r.to for r in got.collect()} == {k: min((v for v in range(3, 800, 13) if v >= k), default=None) for k in range(0, 900, 7)}


def test_lists_of_neighbours_change_no_community(spark, monkeypatch):
    """Ids of any type, split lists and many tasks give the same rows, and a round reads a row a node rather than one an edge."""
    edges = [(c * 5 + i, c * 5 + j, 1.0) for c in range(4) for i, j in itertools.combinations(range(5), 2)] + [(c * 5, (c * 5 + 6) % 20, 1.0) for c in range(4)] + [(0, 1, 0.5), (3, 3, 1.0)]
    want = found(spark, edges, levels=2, rounds=3)
    read, real = [], communities._told
    monkeypatch.setattr(communities, "_told", lambda lists, *more: read.append(lists.count()) or real(lists, *more))
    assert found(spark, edges, levels=2, rounds=3) == want and max(read) == 20 < len(edges)
    monkeypatch.setattr(communities, "LIST", 2)
    monkeypatch.setattr(communities, "ROWS", 10)
    assert found(spark, edges, levels=2, rounds=3) == want and max(read) > 20
