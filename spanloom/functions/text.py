"""Text features as Column expressions.  All word lists are parameters with neutral defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to, for the languages of the tables.
MARKED, PLAIN = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
HOOK_PATTERNS = (r"\bwhy\b", r"\bhow\b", r"\bnever\b", r"\bsecret\b", r"\btruth\b", r"\blisten\b", r"\blook\b", r"\bimagine\b")
MID_SENTENCE = ("and", "but", "so", "because", "or", "then", "that")
ARGUMENT_MARKERS = ("because", "therefore", "which means", "if ", "then", "thus")
CONTINUITY = ("to be continued", "next time", "we will see", "later on")
RESOLUTION = ("in conclusion", "therefore", "that is why", "in the end", "so the answer")
OPEN_TAIL = ("and", "but", "or", "because", "with", "of", "to", "that")
FILLERS = ("uh", "um", "like", "you know", "kind of")
EMOTIONAL = ("love", "hate", "fear", "hope", "anger", "joy")
ATTENTION = ("breaking", "urgent", "watch", "alert")
SENTENCE_BREAK = r"[.!?]+"


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)


def collapsed(text: Column) -> Column:
    """White space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def words(text: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def tokens(text: Column, least: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct folded letter-and-digit tokens (hyphens inside) of ``least`` characters or more."""
    found = F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}_-]+)"), 1)
    keep = F.filter(F.array_distinct(found), lambda t: F.length(t) >= least)
    return F.array_except(keep, F.array(*map(F.lit, stop))) if stop else keep


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays taken as sets; 0 where either is empty."""
    common, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), common / either).otherwise(0.0)


def cue_count(text: Column, cues: tuple[str, ...]) -> Column:
    """How many of the cues occur as substrings."""
    return sum((text.contains(c).cast("int") for c in cues), F.lit(0))


def word_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur as whole words."""
    return sum((text.rlike(rf"\b{t}\b").cast("int") for t in terms), F.lit(0))


def occurrences(text: Column, cue: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(cue), F.lit("")))) / len(cue)).cast("int")


def opening(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def hook_matches(text: Column, patterns: tuple[str, ...] = HOOK_PATTERNS, n: int = 24) -> Column:
    """How many patterns the first n words match."""
    start = opening(folded(text), n)
    return sum((start.rlike(p).cast("int") for p in patterns), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def is_question(text: Column, starters: tuple[str, ...] = ("what", "why", "how", "who", "when", "where")) -> Column:
    first = F.get(words(folded(text)), F.lit(0))
    return text.contains("?") | F.coalesce(first.isin(*starters), F.lit(False))


def closure_type(text: Column, continuity: tuple[str, ...] = CONTINUITY, resolution: tuple[str, ...] = RESOLUTION, open_tail: tuple[str, ...] = OPEN_TAIL) -> Column:
    """cliffhanger, conclusion, open or closed_statement, by the last 260 characters."""
    ending = F.right(folded(text), F.lit(260))
    goes_on, resolves = cue_count(ending, continuity) > 0, cue_count(ending, resolution) > 0
    last = F.try_element_at(F.regexp_extract_all(ending, F.lit("([a-z0-9-]+)"), 1), F.lit(-1))
    return (
        F.when(goes_on & ~resolves, "cliffhanger")
        .when(resolves, "conclusion")
        .when(F.coalesce(last.isin(*open_tail), F.lit(False)), "open")
        .when(F.rtrim(text).rlike(r"[.!?]$"), "closed_statement")
        .otherwise("open")
    )


def headline_shape(text: Column) -> Column:
    """Counts and marks of a headline."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(
        F.size(words(t)).cast("long").alias("word_count"),
        F.length(t).cast("long").alias("character_count"),
        t.contains("?").alias("question"),
        t.contains("!").alias("exclamation"),
        t.contains(":").alias("colon"),
        t.rlike(r'["“”]').alias("quoted"),
        t.rlike(r"[0-9]").alias("number"),
        folded(t).rlike(r"\b(?:but|however|yet)\b").alias("contrast"),
        (word_hits(folded(t), ATTENTION) > 0).alias("attention_word"),
    )


def family(text: Column, lexicon: dict[str, tuple[str, ...]], default: str) -> Column:
    """The family with most cues; of equal ones the first listed; the default where none has any."""
    t = folded(text)
    found = [F.struct(cue_count(t, cues).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, cues) in enumerate(lexicon.items())]
    best = F.array_max(F.array(*found))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def first_rule(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """The name of the first pattern that matches the folded text."""
    t, out = folded(text), None
    for name, pattern in rules:
        out = F.when(t.rlike(pattern), name) if out is None else out.when(t.rlike(pattern), name)
    return out.otherwise(default)


def named_entities(text: Column) -> Column:
    """Distinct runs of two or more capitalized words."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+)+)"), 1))


def co_occurs(text: Column, left: str, right: str, within: int = 96) -> Column:
    """Two terms with at most ``within`` characters between them, in either order."""
    return text.rlike(f"(?s){left}.{{0,{within}}}{right}|{right}.{{0,{within}}}{left}")


def compacted(text: Column, most: int, stop: tuple[str, ...] = OPEN_TAIL) -> Column:
    """Cut to ``most`` characters at a word, without a stop word at the end."""
    t = collapsed(text)
    cut = F.when(F.length(t) <= most, t).otherwise(F.regexp_replace(F.left(t, F.lit(most + 1)), r"\s*\S*$", ""))
    return F.regexp_replace(cut, rf"(?:\s+(?:{'|'.join(stop)}))+$", "")


def flags(text: Column) -> Column:
    """Editorial booleans of a passage."""
    t = folded(text)
    first = F.get(words(t), F.lit(0))
    return F.struct(
        F.coalesce(first.isin(*MID_SENTENCE), F.lit(False)).alias("starts_mid_sentence"),
        F.coalesce(first.isin("this", "that", "he", "she", "it", "they"), F.lit(False)).alias("starts_with_context_reference"),
        is_question(text).alias("question_detected"),
        (cue_count(t, ("percent", "according to", "data")) + t.rlike("[0-9]").cast("int") > 0).alias("evidence_present"),
        (cue_count(t, RESOLUTION) > 0).alias("payoff_complete"),
        t.rlike(r"\b(?:i|we)\b").alias("first_person"),
        F.rtrim(F.coalesce(text, F.lit(""))).rlike(r"[.!?]$").alias("ends_with_stop"),
    )


def slug(text: Column, most: int = 80) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def ranked_sentences(text: Column, cues: tuple[str, ...], most: int = 3) -> Column:
    """The sentences with most cues, of equal ones the earlier."""
    scored = F.transform(sentences(text), lambda s, i: F.struct((-cue_count(folded(s), cues)).alias("score"), i.alias("place"), s.alias("sentence")))
    return F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: x["sentence"])


def topic_terms(text: Column, most: int = 6, least: int = 4, stop: tuple[str, ...] = ()) -> Column:
    """The most frequent tokens, of equal ones the one that occurs first."""
    found = F.filter(F.regexp_extract_all(folded(text), F.lit(r"([a-z0-9]+)"), 1), lambda t: F.length(t) >= least)
    if stop:
        found = F.filter(found, lambda t: ~t.isin(*stop))
    counted = F.transform(F.array_distinct(found), lambda t: F.struct((-F.size(F.filter(found, lambda x: x == t))).alias("n"), F.array_position(found, t).alias("at"), t.alias("term")))
    return F.transform(F.slice(F.array_sort(counted), 1, most), lambda x: x["term"])


def topic_signature(kind: Column, terms: Column) -> Column:
    """``kind:a-b-c`` of the first three terms in alphabetical order."""
    return F.concat(kind, F.lit(":"), F.array_join(F.array_sort(F.slice(terms, 1, 3)), "-"))


def topic_similarity(left: Column, right: Column) -> Column:
    """Jaccard of two signatures' terms, 0.15 more where the kinds agree and it reaches 0.34; at most 1."""
    part = lambda s, i: F.split_part(F.coalesce(s, F.lit("")), F.lit(":"), F.lit(i))
    terms = lambda s: F.filter(F.split(part(s, 2), "-"), lambda t: t != "")
    lexical = jaccard(terms(left), terms(right))
    bonus = F.when((part(left, 1) != "") & (part(left, 1) == part(right, 1)) & (lexical >= 0.34), 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), lexical + bonus)


def editorial_key(path: Column, start: Column, end: Column, text: Column) -> Column:
    """Identity of a passage: 32 hex digits of SHA-256 over its place and text."""
    number = lambda x: F.format_string("%.3f", x.cast("double"))
    return F.substring(F.sha2(F.concat_ws("|", F.lower(path), number(start), number(end), F.lower(collapsed(text))), 256), 1, 32)


def balanced_lines(value: Column, most: int = 3, ideal: int = 22, least: int = 11) -> Column:
    """A title's words in ``most`` lines of like length; three words or fewer are one line, none no line.

    A line wraps before the word that takes it past the target, ``ideal`` characters or a
    share of the whole and four more, whichever is less.  It doesn't where too few words
    are left for the lines, and the last line holds all that is left.
    """
    most = max(1, most)
    said = F.split(collapsed(value), " ")
    share = F.greatest(F.lit(least), F.bround(F.length(collapsed(value)) / most))
    target = F.greatest(F.lit(least), F.least(F.lit(ideal), share + 4))

    def lines(found: Column) -> Column:
        words, goal, n = found["words"], found["goal"], F.size(found["words"])
        begin = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(-1).alias("length"))

        def step(held: Column, word: Column) -> Column:
            wider = held["length"] + 1 + word["length"]
            full = (word["at"] > 0) & (wider > goal) & (F.size(held["starts"]) < most) & (n - word["at"] >= most + 1 - F.size(held["starts"]))
            starts = F.when(full, F.concat(held["starts"], F.array(word["at"]))).otherwise(held["starts"])
            return F.struct(starts.alias("starts"), F.when(full, word["length"]).otherwise(wider).alias("length"))

        lengths = F.transform(words, lambda w, i: F.struct(F.length(w).alias("length"), i.alias("at")))
        starts = F.aggregate(lengths, begin, step)["starts"]
        cut = lambda at: F.transform(at, lambda s, k: F.array_join(F.slice(words, s + 1, F.coalesce(F.get(at, k + 1), n) - s), " "))
        # held by one element, so that the fold runs once
        return F.get(F.transform(F.array(starts), cut), F.lit(0))

    held = F.array(F.struct(said.alias("words"), target.alias("goal")))
    few = F.filter(F.array(collapsed(value)), lambda line: line != "")
    return F.when(F.size(said) <= 3, few).otherwise(F.get(F.transform(held, lines), F.lit(0)))
