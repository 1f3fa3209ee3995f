"""Text expressions: sentences, word windows, cleaning, normalising. All are Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Where a quoted reply, or a signature, begins in a mail body (in lower case).
REPLY_MARKERS = (
    "-----original message-----",
    "----- original message -----",
    "-----forwarded by",
    "----- forwarded by",
    "__________________________________",
)
SIGNATURE_MARKERS = ("\n-- \n", "\nthanks,\n", "\nregards,\n", "\nbest regards,\n")
ARTICLES = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """The text's words between white space; an empty array for blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentences(text: Column, min_words: int = 4) -> Column:
    """Spans between sentence ends or blank lines, trimmed, with at least min_words words."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n{2,}"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.size(words(s)) >= min_words)


def windows(tokens: Column, size: int, overlap: int, least_tail: int, whole: Column | None = None) -> Column:
    """Runs of `size` words that begin every size - overlap words; a run of under least_tail words is left out.

    A text of at most `size` words stays as it is where `whole` gives it, and else is one run; a blank text is none.
    `tokens` should be a column of its own, not an expression, which would be computed for every run.
    """
    n, step = F.size(tokens), max(1, size - overlap)
    runs = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: F.slice(tokens, i + 1, F.lit(size)))
    kept = F.transform(F.filter(runs, lambda r: F.size(r) >= least_tail), lambda r: F.array_join(r, " "))
    short = F.array(F.array_join(tokens, " ") if whole is None else whole)
    return F.when(n > size, kept).when(n > 0, short).otherwise(F.array().cast("array<string>"))


def card_windows(tokens: Column, whole: Column | None = None, size: int = 180, overlap: int = 60) -> Column:
    return windows(tokens, size, overlap, min(size // 3, 15), whole)


def sub_chunks(tokens: Column, whole: Column | None = None, size: int = 180, overlap: int = 60) -> Column:
    return windows(tokens, size, overlap, min(size // 3, 20), whole)


def word_chunks(tokens: Column, whole: Column | None = None, size: int = 100) -> Column:
    """Runs of `size` words, the last however short."""
    return windows(tokens, size, 0, 1, whole)


def attributes(text: Column, verb: str = "likes") -> Column:
    """(subject, attributes): what stands before the first `verb`, and what follows it, split at commas; the text itself twice where the verb is missing."""
    parts = F.split(text, rf"\b{verb}\b", 2)
    listed = F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda x: F.regexp_replace(x, r"^[ .,]+|[ .,]+$", ""))
    subject = trim_space(F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(text))
    found = F.when(F.size(parts) > 1, F.filter(listed, lambda x: x != "")).otherwise(F.array(trim_space(text)))
    return F.struct(subject.alias("subject"), found.alias("attributes"))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_quoted(body: Column) -> Column:
    """The body before its first reply marker (in any case), without lines that begin with '>', trimmed."""
    first = F.least(*[F.nullif(F.instr(F.lower(body), m), F.lit(0)) for m in REPLY_MARKERS])
    own = F.when(first.isNotNull(), F.substring(body, F.lit(1), first - 1)).otherwise(body)
    return trim_space(F.array_join(F.filter(F.split(own, r"\r\n|\n|\r"), lambda line: ~F.startswith(F.regexp_replace(line, r"^\s+", ""), F.lit(">"))), "\n"))


def strip_signature(body: Column, last_share: float = 0.66) -> Column:
    """The body before the first of its last signature markers that stand beyond last_share of it, trimmed."""
    n, low = F.length(body), F.lower(body)
    ends = []
    for m in SIGNATURE_MARKERS:
        behind = F.instr(F.reverse(low), m[::-1])
        at = n - behind - len(m) + 1
        ends.append(F.when((behind > 0) & (at > n * last_share), at))
    cut = F.least(*ends)
    return trim_space(F.when(cut.isNotNull(), F.substring(body, F.lit(1), cut)).otherwise(body))


def clean_body(body: Column) -> Column:
    """Without quoted replies and signature; single blanks, at most one blank line, trimmed."""
    out = F.regexp_replace(strip_signature(strip_quoted(body)), "[ \t]+", " ")
    return trim_space(F.regexp_replace(out, "\n{3,}", "\n\n"))


def normalise(text: Column) -> Column:
    """Lower case, single blanks, no punctuation at the ends."""
    return F.regexp_replace(collapse(F.lower(text)), r"^\p{P}+|\p{P}+$", "")


def normalise_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, single blanks."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), ARTICLES, " "))


def capitalised_inside(text: Column) -> Column:
    """A word after the first begins with a capital letter."""
    rest = F.slice(words(text), 2, 1_000_000_000)
    return F.exists(rest, lambda w: w.rlike(r"^[A-Z][a-z]"))


def owner(unit: Column) -> Column:
    """doc#k/j -> doc#k."""
    return F.substring_index(unit, "/", 1)


def container(unit: Column) -> Column:
    """doc#k -> doc."""
    own = F.substring_index(unit, "/", 1)
    return F.substring(own, F.lit(1), F.length(own) - F.length(F.substring_index(own, "#", -1)) - 1)


def index_of(unit: Column) -> Column:
    return F.substring_index(F.substring_index(unit, "/", 1), "#", -1).cast("int")


# Predicates that mean the same as another.
PREDICATE_ALIASES = {
    "resides_in": "lives_in",
    "has_residence_in": "lives_in",
    "is_living_in": "lives_in",
    "is_married_to": "married_to",
    "spouse": "married_to",
    "is_associated_with_sport": "associated_with_sport",
    "plays_sport": "associated_with_sport",
    "was_born_in_city": "born_in",
    "born_in_city": "born_in",
    "was_born_in": "born_in",
    "died_in_city": "died_in",
    "has_headquarters_in_city": "headquarters_in",
    "headquarters_location": "headquarters_in",
    "is_headquartered_in": "headquarters_in",
    "is_located_in_continent": "located_in_continent",
    "is_employed_by": "works_for",
}


def predicate(text: Column, aliases: dict[str, str] = PREDICATE_ALIASES) -> Column:
    """Lower case with underscores for all but letters and digits, then the alias where there is one."""
    name = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def spaced_words(text: Column) -> Column:
    """The words of a text, each with the white space that follows it."""
    return F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0))


def spaced_chunks(words: Column, size: int = 200, overlap: int = 30) -> Column:
    """Runs of `size` words that keep their white space and overlap; the first run that reaches the end is the last."""
    n, step = F.size(words), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int") * step
    runs = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.regexp_replace(F.array_join(F.slice(words, i + 1, F.lit(size)), ""), r"\s+$", ""))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def cut_to_tokens(words: Column, limit: int, count=lambda w: F.size(F.regexp_extract_all(w, F.lit(r"\w+"), F.lit(0)))) -> Column:
    """How many of the first words have at most `limit` tokens together; `count` gives a word's tokens."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s, w):
        used = s["used"] + count(w)
        fits = s["open"] & (used <= limit)
        return F.struct(used.alias("used"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    return F.aggregate(words, start, step, lambda s: s["n"])


def repair_json_escapes(text: Column) -> Column:
    """Backslashes that begin no JSON escape doubled, read from left to right, so that they stand for themselves; one at the very end stays.

    Each match runs, without going back, over characters and whole escapes up to the next backslash that begins none.
    """
    return F.regexp_replace(text, r"""\G([^\\]*+(?:\\["\\/bfnrtu][^\\]*+)*+)\\(?!\z)""", r"$1\\\\")
