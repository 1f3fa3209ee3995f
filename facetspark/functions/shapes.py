"""Shapes of questions by ordered rules, the weights and depth they get, and strict parsing of labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# The patterns of each shape, in the order in which they are tried.
RULES = {
    "lexical": ['"[^"]+"|“[^”]+”', r"\b[0-9]*[a-z][a-z0-9]*[0-9][a-z0-9]*\b|\b[0-9]+[a-z][a-z0-9]*\b", r"\b\d{4,}\b"],
    "temporal": ["how long", "how many (days|weeks|months|years)", "ago", "since", "before", "after", "when", "date", "first time", "last time", "most recent", "currently", "now"],
    "cross-topic": ["in total", "altogether", "combined", "all the", "across", "both", "compare", "same", "different", "either", "neither"],
    "multi-hop": ["which (company|organization|organisation|person|team|country)", "who", "reported by", "according to"],
    "thematic": ["recommend", "suggest", "ideas", "what should i", "advice", "plan", "tips", "help me"],
    "entity": ["my (dog|cat|wife|husband|partner|son|daughter|boss|friend|sister|brother|mother|father|car|house)"],
}
SHAPES = ["local", "entity", "thematic", "cross-topic", "multi-hop", "temporal", "lexical", "unanswerable"]
# The shape of each type of question in the labelled sets.
ORACLE = {
    "single-session-user": "local",
    "single-session-assistant": "local",
    "single-session-preference": "thematic",
    "multi-session": "cross-topic",
    "temporal-reasoning": "temporal",
    "knowledge-update": "temporal",
    "inference_query": "multi-hop",
    "comparison_query": "cross-topic",
    "temporal_query": "temporal",
    "null_query": "unanswerable",
}


def capitalised_token(text: Column) -> Column:
    """A word that begins with a capital letter, leading quotes aside, and doesn't begin a sentence."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    capital = lambda w: F.regexp_replace(w, "^[\"'(“‘\\[]+", "").rlike(r"^\p{Lu}")
    ends = lambda w: F.regexp_replace(w, "[\"')”’\\]]+$", "").rlike("[.!?]$")
    # words are paired with the one before, so that no word is looked up by its place
    pairs = F.zip_with(F.slice(words, 2, 1 << 30), F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), lambda w, before: capital(w) & ~ends(before))
    return F.exists(pairs, lambda x: x)


def shape(text: Column) -> Column:
    """The first shape whose rules match anywhere in the text, whatever the case; entity for an inner capital; else local."""
    found = F.when(F.lit(False), "")
    for name, patterns in RULES.items():
        found = found.when(text.rlike("(?i)" + "|".join(patterns)), name)
    return found.when(capitalised_token(text), "entity").otherwise("local")


def oracle_shape(kind: Column, abstention: Column) -> Column:
    """The shape of a labelled type; questions to abstain from are unanswerable. Null for types that aren't known."""
    known = F.create_map(*[F.lit(x) for x in chain(*ORACLE.items())])
    return F.when(abstention, "unanswerable").otherwise(F.try_element_at(known, kind))


def parse_label(reply: Column) -> Column:
    """(shape, off_list): the trimmed reply in lower case if it is a shape and nothing else, else local."""
    label = F.lower(F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+|\s+$", ""))
    ok = label.isin(SHAPES)
    return F.struct(F.when(ok, label).otherwise("local").alias("shape"), (~ok).alias("off_list"))
