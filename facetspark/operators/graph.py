"""Co-occurrence graphs: pairs within units, PMI weights, pruning, communities and topic bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from facetspark.operators.stats import exact_percentile
from facetspark.sources.scratch import cut, written


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input. Spark guesses sizes of exploded and grouped rows from the file they came from, so it
    would take millions of pairs for a small table and broadcast them through the driver; both sides are shuffled instead."""
    return left.join(right.hint("merge"), on, how)


#: Phrases of a unit that are paired at a time, and pairs that a task counts.
HEADS, PAIRS = 256, 1_000_000


def cooccurrence(occurrences: DataFrame) -> DataFrame:
    """(a, b, n): units (unit, phrase) in which both phrases stand, a < b. A column f that belongs to the phrase is handed on as fa and fb.

    A unit's pairs grow with the square of its phrases, so pairs aren't shuffled one by one: each phrase goes to its task with the array of those
    that follow it in the unit. Tasks are as many as the pairs call for, and a long unit is dealt over them by blocks of its phrases.
    """
    f, fa, fb = (["f"], ["fa"], ["fb"]) if "f" in occurrences.columns else ([], [], [])
    listed = occurrences.where("phrase IS NOT NULL").groupBy("unit").agg(F.sort_array(F.collect_set(F.struct("phrase", *f))).alias("p"))
    listed = written(listed.where(F.size("p") > 1))  # used twice
    pairs = listed.agg(F.sum(F.size("p").cast("long") * (F.size("p") - 1) / 2)).first()[0] or 0
    tasks = 1 + int(pairs) // PAIRS
    blocks = listed.select("unit", F.explode(F.sequence(F.lit(0), F.size("p") - 2, F.lit(HEADS))).alias("at"), "p")
    rest = lambda c, i: F.slice(c, i, F.size("p"))
    dealt = blocks.select("unit", "at", rest("p", F.col("at") + 1).alias("p")).repartition(tasks, "unit", "at")
    heads = dealt.select(F.posexplode_outer(F.slice("p", 1, HEADS)).alias("i", "x"), "p").where(F.col("i") < F.size("p") - 1)
    tails = heads.select(F.col("x.phrase").alias("a"), *[F.col("x.f").alias(c) for c in fa], rest("p.phrase", F.col("i") + 2).alias("y"), *[rest("p.f", F.col("i") + 2).alias("z") for _ in fb])
    met = tails.repartition(tasks, "a").select("a", *fa, F.posexplode_outer("y").alias("j", "b"), *["z" for _ in fb]).select("a", *fa, "b", *[F.get("z", F.col("j")).alias(c) for c in fb])
    return met.groupBy("a", "b", *fa, *fb).agg(F.count("*").alias("n")).select("a", "b", "n", *fa, *fb)


def hub_rule(occurrences: DataFrame, share: float = 0.005) -> DataFrame:
    """(phrase, f, pronoun, hub) of occurrences (unit, phrase, pron): phrases that are pronouns in most occurrences, and the most frequent share.

    The number of hubs is the share of all phrases, rounded down; ties go to the smaller phrase. The frequency of the
    last hub is read off the counts of counts, so that only phrases of that one frequency are ranked.
    """
    freq = cut(occurrences.groupBy("phrase").agg(F.count("*").alias("f"), (2 * F.sum(F.col("pron").cast("int")) > F.count("*")).alias("pronoun")))
    hubs = int(share * freq.count())
    above, edge, left = 0, None, 0
    for r in freq.groupBy("f").agg(F.count("*").alias("c")).orderBy(F.desc("f")).limit(hubs).collect():  # a row for each frequency of a hub
        if above + r["c"] >= hubs:
            edge, left = r["f"], hubs - above
            break
        above += r["c"]
    if edge is None:
        return freq.withColumn("hub", F.lit(False))
    tied = freq.where(F.col("f") == edge).orderBy("phrase").limit(left).select(F.col("phrase").alias("p"), F.lit(True).alias("tied"))
    return freq.join(tied, F.col("phrase") == F.col("p"), "left").select("phrase", "f", "pronoun", ((F.col("f") > edge) | F.coalesce("tied", F.lit(False))).alias("hub"))


def pmi(edges: DataFrame, freq: DataFrame) -> DataFrame:
    """Edges with fa, fb and weight p(a, b) * log2(p(a, b) / (p(a) p(b))).

    p(a, b) is an edge's share of all edges' counts, p(a) a phrase's share of all phrases' frequencies (phrase, f). Edges that
    carry their ends' frequencies already are not joined with them.
    """
    both = edges = written(edges)  # read often
    pairs, total = edges.agg(F.sum("n")).first()[0] or 0, freq.agg(F.sum("f")).first()[0] or 0
    if "fa" not in edges.columns:
        fa, fb = freq.select(F.col("phrase").alias("a"), F.col("f").alias("fa")), freq.select(F.col("phrase").alias("b"), F.col("f").alias("fb"))
        both = meet(meet(edges, fa, "a"), fb, "b")
    p = F.col("n") / F.lit(pairs)
    return both.withColumn("weight", p * F.log2(p / (F.col("fa") / F.lit(total) * F.col("fb") / F.lit(total))))


def prune(weighted: DataFrame, least_freq: int = 2, share: float = 0.4) -> DataFrame:
    """Edges (a, b, fa, fb, weight) without the best connected phrase and rare phrases, from the weights' quantile up, above 0; in that order.

    Degrees are counted once, over all edges, so that each phrase of an edge has one at least. What is left is not held: to
    weigh edges that are written (`pmi`) takes less than to write them again.
    """
    ends = weighted.select(F.col("a").alias("p")).unionByName(weighted.select(F.col("b").alias("p"))).groupBy("p").agg(F.count("*").alias("deg"))
    ego = ends.agg(F.min_by("p", F.struct((-F.col("deg")).alias("fewer"), "p"))).first()[0]
    left = weighted.where((F.col("a") != F.lit(ego)) & (F.col("b") != F.lit(ego)) & (F.col("fa") >= least_freq) & (F.col("fb") >= least_freq))
    least = exact_percentile(left, "weight", share)
    return left.where((F.col("weight") >= F.lit(least)) & (F.col("weight") > 0))


def plurality(members: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, label): the label that most of a unit's rows have, ties to the lower."""
    n = members.groupBy(unit, label).agg(F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy(unit).orderBy(F.desc("n"), label))
    return n.withColumn("r", first).where("r = 1").select(unit, label)


def entropy(members: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, entropy): bits of the labels' distribution in each group."""
    n = members.groupBy(group, label).agg(F.count("*").alias("c"))
    p = n.withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy(group)))
    return p.groupBy(group).agg(F.sum("c").alias("n"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def bridge(topics: DataFrame, communities: DataFrame, least: int = 5) -> DataFrame:
    """(topic, community, shared, jaccard, d) of memberships (topic, unit) and (community, unit) with `least` units shared; d = shared * (1 - jaccard)."""
    t, c = topics.dropDuplicates(["topic", "unit"]), communities.dropDuplicates(["community", "unit"])
    shared = t.join(c, "unit").groupBy("topic", "community").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    nt, nc = t.groupBy("topic").agg(F.count("*").alias("nt")), c.groupBy("community").agg(F.count("*").alias("nc"))
    both = shared.join(nt, "topic").join(nc, "community").withColumn("jaccard", F.col("shared") / (F.col("nt") + F.col("nc") - F.col("shared")))
    return both.select("topic", "community", "shared", "jaccard", (F.col("shared") * (1 - F.col("jaccard"))).alias("d"))


def apply_links(topics: DataFrame, communities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores (topic, score) and (community, score) with weighted links (topic, community, w) added; both sides read the original scores."""
    to_t = links.join(communities.withColumnRenamed("score", "s"), "community").groupBy("topic").agg(F.sum(F.col("w") * F.col("s")).alias("more"))
    to_c = links.join(topics.withColumnRenamed("score", "s"), "topic").groupBy("community").agg(F.sum(F.col("w") * F.col("s")).alias("more"))
    add = lambda base, more, key: base.join(more, key, "left").select(key, (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return add(topics, to_t, "topic"), add(communities, to_c, "community")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): weighted label propagation over edges (a, b, weight), a stand-in for modularity communities.

    Each round every node takes the label with most weight among its neighbours and itself, ties to the lower.
    """
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = cut(both)
    labels = both.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "community", "weight")
        votes = votes.unionByName(labels.withColumn("weight", F.lit(0.5)))
        summed = votes.groupBy("id", "community").agg(F.sum("weight").alias("w"))
        first = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("w", 9)), "community"))
        labels = cut(summed.withColumn("r", first).where("r = 1").select("id", "community"))
    return labels


def link_sets(proposals: DataFrame, strong: float = 0.7) -> DataFrame:
    """Proposals (topic, community, w, parse_ok) as link sets: R2 has all that parsed, R3 those of weight `strong` and more; R0 is empty."""
    good = proposals.where("parse_ok")
    return good.withColumn("link_set", F.lit("R2")).unionByName(good.where(F.col("w") >= strong).withColumn("link_set", F.lit("R3")))


def shared_entity_pairs(mentions: DataFrame, least_docs: int = 2, most_docs: int = 64) -> DataFrame:
    """(a, b, weight): documents (entity, doc) that share entities, a < b, and how many.

    Entities in more than min(most_docs, max(2, half of the documents)) documents make no pairs, so an entity
    makes at most most_docs * (most_docs - 1) / 2 of them.
    """
    once = mentions.select("entity", "doc").distinct()
    docs = once.agg(F.countDistinct("doc").alias("docs"))
    many = once.groupBy("entity").agg(F.count("*").alias("n"))
    few = many.crossJoin(F.broadcast(docs)).where((F.col("n") >= least_docs) & (F.col("n") <= F.least(F.lit(most_docs), F.greatest(F.lit(2), F.floor(F.col("docs") / 2))))).select("entity")
    return cooccurrence(meet(once, few, "entity").select(F.col("entity").alias("unit"), F.col("doc").alias("phrase"))).withColumnRenamed("n", "weight")


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(qid, node): what can be reached from the seeds (qid, node) over edges (a, b), in either direction, in so many steps.

    What a question reaches is the union of what its seeds reach, so each seed is followed once, however many questions share it,
    and only questions with several seeds need their nodes made distinct.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    asked = written(seeds.select("qid", "node").distinct().withColumn("n", F.count("node").over(W.partitionBy("qid"))))
    start = asked.where("node IS NOT NULL").select(F.col("node").alias("seed")).distinct()
    reached = edge = written(start.select("seed", F.col("seed").alias("node")))
    for _ in range(hops):
        # written, as Spark would move the anti-join below the distinct and shuffle every path
        step = written(meet(edge, both, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct())
        edge = written(meet(step, reached, ["seed", "node"], "left_anti"))  # nodes reached before were followed then
        reached = reached.unionByName(edge)
    of = lambda some: meet(asked.where(some).withColumnRenamed("node", "seed"), reached, "seed").select("qid", "node")
    return of("n = 1").unionByName(of("n > 1").distinct()).unionByName(asked.where("node IS NULL").select("qid", "node"))


def topic_vectors(occurrences: DataFrame, unit_topics: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(phrase, i, x): the mean of topics' prototypes (topic, i, x) by the probability mass (unit, topic, p) of the units a phrase stands in."""
    mass = meet(occurrences, unit_topics, "unit").groupBy("phrase", "topic").agg(F.sum("p").alias("p"))
    total = mass.groupBy("phrase").agg(F.sum("p").alias("total"))
    summed = mass.join(prototypes, "topic").groupBy("phrase", "i").agg(F.sum(F.col("p") * F.col("x")).alias("x"))
    return meet(summed, total, "phrase").select("phrase", "i", (F.col("x") / F.col("total")).alias("x"))


def topic_factor(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """factor: one plus the cosine of an edge's ends; 1 where an end has no vector. vectors: (phrase, i, x) in few dimensions."""
    length = vectors.groupBy("phrase").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    unit = length.where("norm > 0").select("phrase", F.map_from_entries(F.transform("v", lambda s: F.struct(s["i"], s["x"] / F.col("norm")))).alias("v"))
    a, b = unit.select(F.col("phrase").alias("a"), F.col("v").alias("va")), unit.select(F.col("phrase").alias("b"), F.col("v").alias("vb"))
    dot = F.aggregate(F.map_keys("va"), F.lit(0.0), lambda s, k: s + F.element_at("va", k) * F.coalesce(F.try_element_at("vb", k), F.lit(0.0)))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))
    return meet(meet(edges, a, "a", "left"), b, "b", "left").withColumn("factor", 1 + F.coalesce(cosine, F.lit(0.0))).drop("va", "vb")


def diagnostics(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: communities, nodes, edges, the largest one's share, density, the share of edges inside, and the mean density inside those of two nodes and more."""
    m = membership.select("id", "community")
    ends = meet(meet(edges, m.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a"), m.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    total = ends.agg(F.count("*").alias("edges"), F.avg((F.col("ca") == F.col("cb")).cast("int")).alias("intra_share"))
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inside"))
    sizes = meet(m.groupBy("community").agg(F.count("*").alias("size")), inside, "community", "left")
    within = F.when(F.col("size") >= 2, F.coalesce("inside", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2))
    of = sizes.agg(F.count("*").alias("communities"), F.sum("size").alias("nodes"), F.max("size").alias("largest"), F.avg(within).alias("within_density"))
    density = F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))
    return of.crossJoin(total).select("communities", "nodes", "edges", (F.col("largest") / F.col("nodes")).alias("largest_share"), density.alias("density"), "intra_share", "within_density")
