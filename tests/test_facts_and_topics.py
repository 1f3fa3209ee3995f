"""Facts against their sources and topic rows of units and owners, by worked cases."""

from facetspark.operators import facts

FACTS = "id int, source string, nth int, subject string, predicate string, object string, quote string, kind string, cardinality string, valid_from string, valid_to string"
SOURCE = "1. Ann was  born in Rome.\n2. Ann moved to Oslo in 2001\n3. Ann moved to Oslo again"


def test_facts_are_judged_by_the_first_rule_they_break(spark):
    base = dict(source=SOURCE, nth=1, subject=" Ann ", predicate="Was Born-In", object="rome", quote="ANN was born in Rome", kind="state", cardinality="one", valid_from="2001-02-03", valid_to="2001")
    cases = [{}, {"nth": 17}, {"subject": "  "}, {"object": None}, {"quote": "Ann died"}, {"object": "Oslo"}, {"kind": "guess"}, {"cardinality": None}, {"source": None}, {"quote": "Ann moved to Oslo", "object": "oslo"}, {"source": ""}, {"nth": 16}]
    names = [x.split()[0] for x in FACTS.split(", ")][1:]
    df = spark.createDataFrame([(i, *[(base | c)[n] for n in names]) for i, c in enumerate(cases)], FACTS)
    got = {r.id: r for r in facts.validated(df).collect()}
    assert [got[i].verdict for i in range(len(cases))] == ["accepted", "beyond", "missing", "missing", "quote", "object", "enum", "enum", "quote", "accepted", "quote", "accepted"]
    assert (got[0].subject, got[0].predicate, got[0].serial, got[0].valid_from, got[0].valid_to) == ("Ann", "born_in", 1, "2001-02-03", None)
    assert got[9].serial is None  # two numbered lines hold the quote
    assert facts.validated(df.limit(0)).collect() == []


def test_topic_rows_reach_units_directly_or_through_their_owner(spark):
    units = spark.createDataFrame([("a/1", "a"), ("a/2", "a"), ("b", "b"), ("c/1", "c")], "uid string, owner string")
    topics = spark.createDataFrame([(1,), (2,), (2,)], "topic_id long")
    rows = [("a", 1, 0.5), ("a", 1, 0.25), ("a/1", 1, 1.0), ("b", 2, 0.5), ("z", 1, 1.0), ("a", 9, 1.0), (None, 1, 1.0), ("c/1", None, 1.0), ("z", 9, 1.0)]
    placed = facts.placed_topics(spark.createDataFrame(rows, "unit_id string, topic_id long, prob double"), units, topics)
    assert sorted(r["found"] for r in placed.collect()) == sorted(["owner"] * 2 + ["direct"] * 2 + ["unit"] * 2 + ["topic"] * 3)
    assert sorted(tuple(r) for r in facts.unit_topics(placed, units).collect()) == [("a/1", 1, 1.75), ("a/2", 1, 0.75), ("b", 2, 0.5)]
    assert facts.unit_topics(placed.limit(0), units).collect() == []
