"""Arms, reuse chains, dates in running text, repaired replies and committed tables."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from facetspark.functions import dates, text as T
from facetspark.operators import arms, chains, reports
from facetspark.sources import files


def test_weights_by_shape_and_arm(spark):
    shapes = spark.createDataFrame([(1, "llm", "lexical"), (1, "rules", "thematic"), (1, "oracle", "unanswerable")], "qid long, planner string, shape string")
    w = arms.arm_weights(shapes).collect()
    of = lambda arm: {r.channel: (r.weight, r.overlay) for r in w if r.arm == arm}
    assert len({r.arm for r in w}) == 13
    assert of("S5_primary") == {"dense": (1, ""), "bm25": (3, "")}  # channels of weight 0 are not even asked for
    assert of("S5_planner_rules") == {"dense": (1, ""), "bm25": (1, ""), "topic": (3, "R3"), "community": (2, "R3"), "relation": (1, ""), "entity": (1, "")}
    assert of("ours_sentence_norule") == {"sentence": (1, ""), "bm25": (1, "")}
    assert of("S4_static")["topic"] == (1, "R0") and of("S2_lazy")["entity"] == (1, "")
    assert {(r.arm, r.depth) for r in w} >= {("S5_primary", 1), ("S5_planner_rules", 2), ("S5_planner_oracle", 0), ("S4_static", 3), ("ours_cheap", 0)}
    asked = {(r.channel, r.overlay) for r in arms.needed(arms.arm_weights(shapes)).collect()}
    assert ("topic", "P0") not in asked and ("topic", "R3") in asked and ("topic", "R0") in asked


def test_a_planned_shape_without_the_graph(spark):
    shapes = spark.createDataFrame([(1, p, "multi-hop") for p in ("llm", "rules", "oracle")], "qid long, planner string, shape string")
    w = {(r.arm, r.channel): r.weight for r in arms.arm_weights(shapes).collect()}
    assert w["S5_primary", "relation"] == 3 and ("S5_noPGR", "relation") not in w and w["S5_noPGR", "topic"] == 1


def test_arms_by_hand(spark):
    shapes = spark.createDataFrame([(1, p, "local") for p in ("llm", "rules", "oracle")], "qid long, planner string, shape string")
    w = arms.arm_weights(shapes)
    hits = [("dense", "", [10, 11, 12]), ("bm25", "", [12, 10]), ("sentence", "", [11]), ("topic", "R3", [13]), ("topic", "R0", [14]), ("entity", "", [11])]
    rows = [(1, c, o, u, i + 1) for c, o, us in hits for i, u in enumerate(us)]
    hits = spark.createDataFrame(rows, "qid long, channel string, overlay string, uid long, rank int")
    out = spark.createDataFrame([(1, 10)], "qid long, uid long")
    accepted = spark.createDataFrame([(1, 99, 1), (1, 12, 2)], "qid long, uid long, rank int")
    got = {}
    for r in arms.run_arms(w, hits, out, accepted).orderBy("rank").collect():
        got.setdefault(r.arm, []).append(r.uid)
    # dense 2, bm25 2: 10 has 2/61 + 2/62, 12 has 2/63 + 2/61, 11 has 2/62 + 1/61 of the entity channel
    assert got["S5_primary_norule"] == [10, 12, 11, 13] and got["S5_primary"] == [12, 11, 13] == got["S5_planner_oracle"]
    assert got["S5_noPGR"] == [12, 11, 13] and got["S5_overlay_R0"] == [12, 11, 14] and got["S5_overlay_R2"] == [12, 11]
    assert got["ours_cheap_norule"] == [10, 12, 11] and got["ours_cheap"] == [12, 11] and got["ours_sentence_norule"] == [11, 12, 10]
    assert got["S2_lazy"] == [99, 12, 11, 14]


def resolved_by_hand(files):
    out = {}
    for name, (data, to) in files.items():
        at, seen = name, {name}
        while files[at][0] is None and files[at][1] is not None:
            nxt = files[at][1]
            if nxt in seen:
                out[name] = (None, None, "cycle")
                break
            if nxt not in files:
                out[name] = (None, None, "missing")
                break
            seen.add(nxt)
            at = nxt
        else:
            data = files[at][0]
            out[name] = (at if data else None, data, "missing" if data is None else "own" if at == name else "reused")
    return out


def test_reuse_chains_equal_a_walk(spark):
    rng = random.Random(4)
    one = {f"v{i}": (f"d{i}" if rng.random() < 0.25 else None, rng.choice([None, "gone", *[f"v{j}" for j in range(5)]])) for i in range(30)}
    long = {f"v{i}": (None if i else "first", f"v{i - 1}" if i else None) for i in range(45)}
    ring = {f"v{i}": (None, f"v{(i + 1) % 5}") for i in range(5)} | {"self": (None, "self"), "into": (None, "v2")}
    rows = [(g, n, d, to) for g, fs in enumerate((one, long, ring)) for n, (d, to) in fs.items()] + [(0, None, "x", None)]
    got = chains.resolve_reuse(spark.createDataFrame(rows, "g int, variant string, data string, reused_from string"), ["g"]).collect()
    want = {(g, n): v for g, fs in enumerate((one, long, ring)) for n, v in resolved_by_hand(fs).items()}
    assert {(r.g, r.variant): (r.source, r.data, r.status) for r in got} == want and len(got) == len(want)
    assert {v[2] for v in want.values()} == {"own", "reused", "missing", "cycle"}


def test_reuse_rounds_follow_the_longest_chain_not_the_number_of_groups(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(chains, "written", lambda df, write=chains.written: rounds.append(1) or write(df))
    rows = [(g, v, None if v or g % 2 else "d", v - 1 if v else 3 if g % 2 else None) for g in range(300) for v in range(4)]  # odd groups are circles
    got = chains.resolve_reuse(spark.createDataFrame(rows, "g int, variant int, data string, reused_from int"), ["g"]).collect()
    assert sorted({(r.g % 2, r.variant, r.source, r.data, r.status) for r in got}, key=str) == sorted(
        {(g, v, None, None, "cycle") if g else (g, v, 0, "d", "reused" if v else "own") for g in range(2) for v in range(4)}, key=str
    ) and len(got) == 1200
    assert len(rounds) <= 4


DATES = {
    "8 may 2023": "2023-05-08", "Sept 3, 2021": "2021-09-03", "2023/05/08": "2023-05-08", "May 2023": "2023-05-01", "in 2021": "2021-01-01",
    "1:56 pm on 8 May, 2023": "2023-05-08", "the 8th of May 2023": "2023-05-08", "2023-05-08T10:00": "2023-05-08", "05/08/2023": "2023-05-08", "23/05/2023": "2023-05-23",
    "2023/05/20 (Sat) 02:21": "2023-05-20", "December 31, 1999 was cold": "1999-12-31", "Feb. 29, 2020": "2020-02-29", "Feb 30 2021": "2021-01-01", "no year in May": None, "1850": None, "": None,
    "in march of 2020": "2020-03-01", "June 5 2022, not July 6 2023": "2022-06-05", "maybe 2020": "2020-01-01", "5/2021": "2021-05-01",
}


def test_dates_in_running_text(spark):
    df = spark.createDataFrame([*[(k,) for k in DATES], (None,)], "t string")
    got = {r.t: r.d and r.d.isoformat() for r in df.select("t", dates.date_with_year(F.col("t")).alias("d")).collect()}
    assert got == {**DATES, None: None} and isinstance(datetime.date.fromisoformat(DATES["in 2021"]), datetime.date)


def test_a_date_is_searched_for_once_in_each_form(spark):
    df = spark.createDataFrame([("in 2021",)], "t string").select(dates.date_with_year(F.col("t")).alias("d"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # three parts of a form at most, each read once
    assert plan.count("regexp_extract(") == sum(1 + (m > 0) + (d > 0) for _, _, m, d in dates.FORMS) and plan.count("RLIKE") == len(dates.FORMS) + 1


def repaired_by_hand(text):
    out, i = "", 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            if text[i + 1] in '"\\/bfnrtu':
                out, i = out + text[i : i + 2], i + 2
                continue
            out += "\\\\"
        else:
            out += text[i]
        i += 1
    return out


def test_escapes_are_repaired_as_by_a_scan(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice('\\\\\\"/bdnux \n$') for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["\\", "a\\", "\\\\\\d", "x" * 30_000 + "\\d" + "\\n" * 20_000 + "\\q"]
    got = {r.t: r.r for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", T.repair_json_escapes(F.col("t")).alias("r")).collect()}
    assert got == {t: repaired_by_hand(t) for t in texts}
    assert json.loads(got["\\\\\\d"].join('""')) == "\\\\d"


def test_rubrics_are_recovered(spark):
    replies = {'{"score": 0.5, "reason": "fine"}': (0.5, False), '{"score": 1.0, "reason": "the \\dollar"}': (1.0, True), "no": (None, False), '{"score": 2.0, "reason": "\\q"}': (None, False)}
    got = {r.t: (r.s.score, r.s.recovered) for r in spark.createDataFrame([(t,) for t in replies], "t string").select("t", reports.recovered_rubric(F.col("t")).alias("s")).collect()}
    assert got == replies


def test_committed_tables(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    a, b = spark.range(50).selectExpr("id", "id % 3 AS budget"), spark.range(7).selectExpr("id AS k")
    told = {r.name: (r.rows, r.digest) for r in files.write_committed({"a": a, "b": b}, path, {"a": ["budget"]}).collect()}
    assert told["a"][0] == 50 and told["b"][0] == 7
    assert sorted(map(tuple, files.read_committed(spark, path, "a").select("id", "budget").collect())) == [(i, i % 3) for i in range(50)]
    again = {r.name: r.digest for r in files.write_committed({"a": a.repartition(3, "budget")}, path).collect()}
    assert again == {"a": told["a"][1]}
    with pytest.raises(Exception):
        files.write_committed({"a": a.select("id", F.expr("raise_error('lost')").cast("long").alias("budget"))}, path)
    with pytest.raises(ValueError):
        files.read_committed(spark, path, "a")
