"""Rendered contexts, causes of wrong answers and stemmed scores against plain versions and worked cases."""

import random
import re
from collections import Counter

from facetspark.functions.stems import stem
from facetspark.operators import answers, failures, render

# Published pairs of words and stems.
PAIRS = """caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
digitizer digit radicalli radic differentli differ vileli vile vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
formaliti formal sensibiliti sensibl triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow
adjustable adjust replacement replac adoption adopt communism commun effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control roll roll
dying die flies fli dies die enjoy enjoy tied tie geology geolog generally gener as as""".split()


def test_stems_are_the_published_ones():
    assert [stem(w) for w in PAIRS[::2]] == PAIRS[1::2]


def _plain_score(category, prediction, reference):
    prediction, reference = prediction or "", reference or ""
    clean = lambda t: Counter(stem(w) for w in re.sub(r"\b(a|an|the|and)\b", " ", re.sub(r"[!-/:-@\[-`{-~]", "", t.lower())).split())

    def f1(x, y):
        x, y = clean(x), clean(y)
        common = sum((x & y).values())
        return 2 * common / (sum(x.values()) + sum(y.values())) if common else 0.0

    if category == 5:
        return float("no information available" in prediction.lower() or "not mentioned" in prediction.lower())
    if category == 1:
        parts = reference.split(",")
        return sum(max(f1(p, r) for p in prediction.split(",")) for r in parts) / len(parts)
    if category == 3:
        reference = reference.split(";")[0]
    return f1(prediction, reference) if category in (2, 3, 4) else None


def test_category_scores_agree_with_a_plain_version(spark):
    draw = random.Random(5)
    words = ["Running", "runs", "the", "a dog", "dogs,", ",", "hopes; hop", "and", "Not mentioned", "it's", "cats", "café", "!", "relational,", "  "]
    text = lambda: None if draw.random() < 0.05 else " ".join(draw.choice(words) for _ in range(draw.randrange(9)))
    rows = [(i, draw.choice([1, 1, 2, 3, 4, 5, 7, None]), text(), text()) for i in range(300)]
    df = spark.createDataFrame(rows, "qid int, category int, prediction string, reference string")
    got = {r.qid: r.score for r in answers.category_scores(df).collect()}
    assert len(got) == len(rows)
    for qid, category, prediction, reference in rows:
        want = _plain_score(category, prediction, reference)
        assert (got[qid] is None) if want is None else abs(got[qid] - want) < 1e-9, rows[qid]
    assert answers.category_scores(df.limit(0)).count() == 0


def _plain_context(ranking, units, compressed, facts, budget, least):
    out, used, chosen = "", 0, []
    for uid in ranking:
        if uid not in units or (uid in compressed and not facts.get(uid)):
            continue
        text, date, who, at = units[uid]
        body = "\n".join(facts[uid]) if uid in compressed else text or ""
        line = ("\n\n" if chosen else "") + f"[{uid}; {date or ''}; {who or ''}; order={'' if at is None else at}]\n{body}"
        if budget - used < least:
            break
        ends = [m.end() for m in re.finditer(r"\w+", line, re.A)]
        if len(ends) > budget - used:
            line = line[: ends[budget - used - 1]]
        used += min(len(ends), budget - used)
        out += line
        chosen.append(uid)
    return out, used, chosen


def test_rendered_contexts_agree_with_a_plain_version(spark):
    draw = random.Random(3)
    units = {u: (None if u % 11 == 0 else " ".join(draw.choice(["one", "two-three", "...", "four\n"]) for _ in range(draw.randrange(30))), None if u % 3 else "2024", "x" if u % 2 else None, u if u % 5 else None) for u in range(40)}
    compressed = {u for u in range(0, 45, 2)}
    facts = {u: [f"{u} likes thing {i}" for i in range(draw.choice([1, 3, 200]))] for u in range(0, 40, 4)}
    rankings = {q: draw.sample(range(45), 25) for q in range(12)}
    r = spark.createDataFrame([(q, u, i) for q, us in rankings.items() for i, u in enumerate(us, 1)], "qid int, uid int, rank int")
    d = spark.createDataFrame([(u, *x) for u, x in units.items()], "uid int, text string, date string, speaker string, place int")
    c = spark.createDataFrame([(u,) for u in compressed] * 2, "uid int")
    f = spark.createDataFrame([(u, i, x) for u, xs in facts.items() for i, x in enumerate(xs)] + [(2, 0, None)], "uid int, place int, line string")
    for budget, least in ((120, 20), (33, 1), (1000, 20)):
        got = {x.qid: (x.context, x.tokens, list(x.selected)) for x in render.contexts(render.lines(r, d, c, f, budget, least)).collect()}
        assert got == {q: _plain_context(us, units, compressed, facts, budget, least) for q, us in rankings.items()}
    assert render.contexts(render.lines(r, d.limit(0), c, f, 50)).count() == 0


CASE = "case string, gold string, primary boolean, second boolean, listed boolean, update boolean"


def test_causes_in_chats(spark):
    wrong = lambda name, gold="blue", second=False, listed=True, update=False: (name, gold, False, second, listed, update)
    cases = spark.createDataFrame(
        [("right", "blue", True, None, True, False), wrong("split", second=True), wrong("unlisted"), wrong("unlisted but unknown", listed=False), wrong("not found"), wrong("outside"), wrong("cut"),
         wrong("half"), wrong("update", update=True), wrong("backwards", update=True), wrong("two holders", update=True, second=None), wrong("other day", update=True), wrong("cited"), wrong("none"), wrong("no gold", gold=None)], CASE)
    whole = "the car is blue"
    evidence, shown = [], []

    def turn(case, item, text, day=None, clock=0, stages=("index", "candidates", "context"), chars=None, place=1, via=False):
        evidence.append((case, item, text, day, clock))
        shown.extend((case, s, place, item, (len(text) if chars is None or s != "context" else chars), via) for s in stages)

    for name in ("right", "split"):
        turn(name, "a", whole, stages=())
    turn("unlisted", "a", whole, stages=("candidates", "context"))
    turn("unlisted but unknown", "a", whole, stages=("candidates", "context"))
    turn("not found", "a", whole, stages=("index",))
    turn("not found", "b", whole)
    turn("outside", "a", whole, chars=2)
    turn("cut", "a", whole, chars=11)
    turn("half", "a", "blue is the car", chars=9)
    turn("no gold", "a", whole, chars=11)
    for name, other, clock in (("update", "d1", 1), ("backwards", "d1", 9), ("other day", "d2", 1)):
        turn(name, "a", whole, "d1", 5, place=1)
        turn(name, "b", "the car is red", other, clock, place=2)
    turn("two holders", "a", whole, "d1", 1)
    turn("two holders", "b", whole, "d1", 2, place=2)
    turn("cited", "a", whole, via=True)
    e = spark.createDataFrame(evidence, "case string, item string, text string, day string, clock long")
    s = spark.createDataFrame(shown, "case string, stage string, place int, item string, chars long, via boolean")
    got = {r["case"]: r for r in failures.assign(cases, failures.chat_items(e, s, cases)).collect()}
    assert {k: (r.bucket, r.rule) for k, r in got.items()} == {
        "right": (0, "not wrong"), "split": (5, "judges disagree"), "unlisted": (1, "index"), "unlisted but unknown": (4, "inside"), "not found": (2, "candidates"), "outside": (3, "context"), "cut": (3, "tail"),
        "half": (4, "inside"), "update": (3, "update"), "backwards": (3, "update"), "two holders": (4, "inside"), "other day": (4, "inside"), "cited": (4, "inside"), "none": (4, "inside"), "no gold": (4, "inside"),
    }
    assert got["not found"].lost == ["a"] and got["half"].half == 1 and got["half"].lost == []
    assert got["update"].gold_earlier is False and got["backwards"].gold_earlier is True and got["half"].gold_earlier is None
    assert got["two holders"].skipped and not got["two holders"].decidable and not got["other day"].skipped
    assert failures.assign(cases.limit(0), failures.chat_items(e, s, cases)).count() == 0


def test_causes_in_articles(spark):
    cases = spark.createDataFrame([(c, None, False, None, True, False) for c in ("kept", "cut", "gone", "unplaced", "fallback", "part")], CASE)
    facts = spark.createDataFrame(
        [("kept", 1, "d", "d#0", "Red  fox.", False), ("cut", 1, "d", "d#1", "lazy dog", False), ("gone", 1, "d", "d#2", "slow hen", False), ("unplaced", 1, None, None, "Red fox", False), ("fallback", 1, "d", None, "not there", True), ("part", 1, "d", "d#1", "over the", False)],
        "case string, item int, doc string, chunk string, fact string, fallback boolean")
    texts = spark.createDataFrame([("d#0", "the red fox"), ("d#1", "jumps over the lazy dog"), ("d#2", "slow hen")], "chunk string, text string")
    rows = []
    for c in ("kept", "cut", "gone", "unplaced", "fallback", "part"):
        for stage in ("index", "candidates"):
            rows += [(c, stage, "d", "d#0", 0, "the red fox", False), (c, stage, "d", "d#1", 1, "jumps over the lazy dog", False), (c, stage, "d", "d#2", 2, "slow hen", False)]
        rows += [(c, "context", "d", "d#0", 0, "the red fox", False), (c, "context", "d", "d#1", 1, "jumps over the", True)]
    chunks = spark.createDataFrame(rows, "case string, stage string, doc string, chunk string, place int, body string, truncated boolean")
    got = {r["case"]: (r.bucket, r.rule, r.half) for r in failures.assign(cases, failures.fact_items(facts, chunks, texts)).collect()}
    assert got == {"kept": (4, "inside", 0), "cut": (3, "tail", 0), "gone": (3, "context", 0), "unplaced": (1, "index", 0), "fallback": (4, "inside", 0), "part": (4, "inside", 1)}


def test_texts_of_a_stage_go_no_further_than_their_facts(spark):
    facts = spark.createDataFrame([("c", 1, "d", "d#0", "fox", False)], "case string, item int, doc string, chunk string, fact string, fallback boolean")
    chunks = spark.createDataFrame([("c", "index", "d", "d#0", 0, "the fox", False)], "case string, stage string, doc string, chunk string, place int, body string, truncated boolean")
    texts = spark.createDataFrame([("d#0", "the fox")], "chunk string, text string")
    todo, met = [failures.fact_items(facts, chunks, texts)._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        todo += below
        if node.nodeName() == "Join" and all("chunk" in x.output().mkString(" ") for x in below):
            met += [(x.name(), x.dataType().simpleString()) for x in (below[0].output().apply(i) for i in range(below[0].output().size()))]
    assert {t for c, t in met if c in failures.STAGES} == {"boolean"}


def test_causes_in_sessions(spark):
    cases = spark.createDataFrame([(c, None, False, None, c != "b", False) for c in "abcd"], CASE)
    evidence = spark.createDataFrame([(c, i) for c in "abcd" for i in (1, 2)], "case string, item int")
    stages = {"a": ["candidates", "context"], "b": ["candidates", "context"], "c": ["index"], "d": ["index", "candidates"]}
    rows = [(c, s, i) for c in "abcd" for s in failures.STAGES for i in ((1, 2) if s in stages[c] else (1,))]
    got = {r["case"]: (r.bucket, r.lost) for r in failures.assign(cases, failures.session_items(evidence, spark.createDataFrame(rows, "case string, stage string, item int"))).collect()}
    assert got == {"a": (1, [2]), "b": (4, []), "c": (2, [2]), "d": (3, [2])}
