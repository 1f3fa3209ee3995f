"""Graphs of phrases over whole texts: turns of more than fifty different words, against the oracle SQL."""

import duckdb
import pytest

from facetspark.operators import graph
from facetspark.plans import registry


def word(i):
    return "w" + "".join(chr(97 + i // 26**k % 26) for k in range(4))


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    """Each turn begins with sixty words of its own; words that several turns share stand behind them."""
    at = tmp_path_factory.mktemp("turns")
    rows = []
    for u in range(12):
        own = [word(1000 + 60 * u + i) for i in range(60)]
        shared = [word(i) for i in range(30) if (u + i) % 3 and (u * i) % 4]
        rows.append((u // 4, u % 4, "user" if u % 2 else "assistant", " ".join([*own, *shared])))
    rows.append((9, 0, "user", " ".join(word(i) for i in range(8))))
    rows.append((9, 1, "user", None))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{at}/conversations.parquet")
    return str(at)


def plain(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", ["a13_cooccurrence_pmi", "a15_topic_weighted_edges", "a19_graph_diagnostics", "a41_degree_distribution", "g16_evidence_graph", "p17_pruned_graph"])
def test_phrases_behind_the_fiftieth_count(spark, turns, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{turns}/conversations.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    want = plain(want.fetchall())
    con.execute("CREATE OR REPLACE VIEW cut AS SELECT conv_id, turn, role, array_to_string(list_slice(string_split(text, ' '), 1, 50), ' ') AS text FROM conversations")
    assert plain(con.execute(registry.ORACLES[name].replace("conversations", "cut")).fetchall()) != want
    assert plain(registry.QUERIES[name](spark, turns).select(*columns).collect()) == want


def test_communities_hold_phrases_behind_the_fiftieth(spark, turns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{turns}/conversations.parquet/*.parquet'")
    ends = {x for a, b, *_ in con.execute(registry.ORACLES["p17_pruned_graph"]).fetchall() for x in (a, b)}
    assert {r.id for r in registry.QUERIES["g10_phrase_communities"](spark, turns).collect()} == ends != set()


def test_long_units_are_paired_in_blocks(spark, monkeypatch):
    """Blocks, tasks and frequencies that are handed on change no pair; a unit of null is a unit, a phrase of null is none."""
    monkeypatch.setattr(graph, "HEADS", 3)
    monkeypatch.setattr(graph, "PAIRS", 40)
    units = {None: range(5), 0: range(20), 1: range(7, 11), 2: [4], 3: [8, 8, 9]}
    rows = [(u, None if p == 4 else f"p{p:02}", p + 1) for u, ps in units.items() for p in ps]
    want = {}
    for ps in units.values():
        for a in set(ps) - {4}:
            for b in set(ps) - {4}:
                if a < b:
                    want[f"p{a:02}", f"p{b:02}"] = want.get((f"p{a:02}", f"p{b:02}"), 0) + 1
    d = spark.createDataFrame(rows, "unit long, phrase string, f long")
    assert {(a, b): n for a, b, n in graph.cooccurrence(d.drop("f")).collect()} == want
    with_f = graph.cooccurrence(d)
    assert with_f.columns == ["a", "b", "n", "fa", "fb"]
    assert {(r.a, r.b): r.n for r in with_f.collect()} == want and all(int(r.a[1:]) + 1 == r.fa and int(r.b[1:]) + 1 == r.fb for r in with_f.collect())
    freq = d.where("phrase IS NOT NULL").select("phrase", "f").distinct()
    weights = [{(r.a, r.b): (r.fa, r.fb, r.weight) for r in graph.pmi(e, freq).collect()} for e in (with_f, with_f.drop("fa", "fb"))]
    assert weights[0] == weights[1] and len(weights[0]) == len(want)
