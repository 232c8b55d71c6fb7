"""Signals of a candidate from its flags, its text and the feedback so far: Column expressions.

Cue lists and lexicons are parameters with neutral defaults.  Weights and bounds that
results depend on stand as tables under "Fixed values".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .coerce import clamp
from .scoring import PREFERRED_SECONDS, bounded


def _yes(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


# Boundaries and hooks


def speaker_boundary(valid: Column, sure: Column, change: Column) -> Column:
    """25 for an invalid turn (null is valid), 45..90 by the confidence if known, else 82 at a change of speakers and 50."""
    known = F.when(sure.isNotNull(), F.round(45.0 + clamp(sure, 0.0, 1.0) * 45.0, 1))
    usual = F.when(_yes(change), 82.0).otherwise(50.0)
    return F.when(~F.coalesce(valid, F.lit(True)), 25.0).otherwise(F.coalesce(known, usual))


def qa_boundary(bridge: Column, complete: Column, question: Column, review: Column) -> Column:
    """90 for a bridge, 78 for a complete question and answer, 58 for a question (42 if to be reviewed), else 55."""
    asked = F.when(_yes(review), 42.0).otherwise(58.0)
    return F.when(_yes(bridge), 90.0).when(_yes(complete), 78.0).when(_yes(question), asked).otherwise(55.0)


def hook_proximity(score: Column, seconds: Column) -> Column:
    """50, bent by 0.55 of the hook's distance from 50 as far as it lies within 12 s; 50 without a hook."""
    near = clamp(1.0 - F.greatest(seconds, F.lit(0.0)) / 12.0, 0.0, 1.0)
    return F.when(score.isNotNull() & seconds.isNotNull(), F.round(50.0 + (bounded(score) - 50.0) * 0.55 * near, 1)).otherwise(50.0)


# Feedback


def reason_alignment(approved: Column, total: Column) -> Column:
    """25..75 by the approved share of a reason's reviews, from three on; else 50."""
    return F.when(total >= 3, F.round(25.0 + clamp(approved / total, 0.0, 1.0) * 50.0, 1)).otherwise(50.0)


def reason_category(overlap: Column, turn_valid: Column, seconds: Column, question: Column, context: Column, payoff: Column) -> Column:
    """What a review of the clip would most likely be about."""
    heard = _yes(overlap) | ~F.coalesce(turn_valid, F.lit(True))
    return F.when(heard, "speaker_audio").when(seconds > PREFERRED_SECONDS, "duration").when(_yes(question) | _yes(context) | _yes(payoff), "context_payoff").otherwise("hook")


def feedback_adjustment(factors: Column, deltas: Column, origin_delta: Column, confidence: Column, eligible: Column) -> Column:
    """At most 6 points either way: what reviews say about the factors (maps by name), and a little about the origin.

    A factor counts if its delta is 2 at least; it pulls by its distance from 50, in the
    delta's direction, as strongly as the delta (25 at most).
    """
    both = F.filter(F.map_entries(deltas), lambda d: F.try_element_at(factors, d["key"]).isNotNull() & (F.abs(d["value"]) >= 2))
    pull = F.transform(both, lambda d: F.signum(d["value"]) * (F.try_element_at(factors, d["key"]) - 50.0) / 50.0 * F.least(F.abs(d["value"]), F.lit(25.0)))
    by_factor = F.coalesce(F.try_divide(F.aggregate(pull, F.lit(0.0), lambda a, x: a + x), F.size(pull)) * 0.35, F.lit(0.0))
    by_origin = F.coalesce(origin_delta, F.lit(0.0)) * 0.075 * (0.5 + clamp(F.coalesce(confidence, F.lit(0.75)), 0.0, 1.0) * 0.5)
    return F.when(_yes(eligible), clamp(by_factor + by_origin, -6.0, 6.0)).otherwise(0.0)


def selection_score(base: Column, available: Column, signal: Column, review: Column) -> Column:
    """The base, and 0.04 of the signal's distance from 50 (within 2 points) where it is available and needs no review."""
    lift = clamp((bounded(F.coalesce(signal, F.lit(50.0))) - 50.0) * 0.04, -2.0, 2.0)
    return base + F.when(_yes(available) & ~_yes(review), lift).otherwise(0.0)


def favorability(strengths: list[Column], defensive: Column, reversal: Column, own_voice: Column, counter: Column) -> Column:
    """Mean of the strengths, up for turns of argument and the own voice, down for defence; ``counter`` adds 0.12 of its distance from 50."""
    mean = sum((bounded(F.coalesce(s, F.lit(50.0))) for s in strengths), F.lit(0.0)) / len(strengths)
    moved = mean + F.when(_yes(own_voice), 8.0).otherwise(0.0) + F.least(F.lit(8.0), reversal * 2.0) - F.least(F.lit(12.0), defensive * 4.0)
    return F.round(bounded(moved + (F.coalesce(counter, F.lit(50.0)) - 50.0) * 0.12), 1)


def counter_response(question: Column, hostile: Column, complete: Column, own_voice: Column, markers: Column) -> Column:
    """How well an answer meets a question; 50 without one."""
    on = lambda flag, points: F.when(_yes(flag), points).otherwise(0.0)
    met = 58.0 + on(hostile, 12.0) + F.when(_yes(complete), 16.0).otherwise(-18.0) + on(own_voice, 8.0) + F.least(F.lit(8.0), markers * 2.0)
    return F.when(_yes(question), bounded(met)).otherwise(50.0)


# Text signals


LEXICON = {
    "topic": ("market", "data", "system", "river", "city", "school", "health"),
    "claim": ("is", "must", "always", "never", "proves"),
    "conflict": ("against", "but", "fight", "wrong", "problem"),
    "proposal": ("should", "plan", "propose", "solution", "will"),
    "evidence": ("according to", "percent", "study", "report", "shows"),
    "mobilization": ("join", "share", "act", "together", "now"),
}
#: Start and points a hit of each signal, and its weight in the fit (the weights sum to 1.08).
STARTS = {
    "topic_relevance": ("topic", 22.0, 15.0), "claim_strength": ("claim", 30.0, 13.0), "conflict_or_stakes": ("conflict", 28.0, 12.0), "proposal_strength": ("proposal", 24.0, 15.0),
    "evidence_density": ("evidence", 28.0, 10.0), "mobilization": ("mobilization", 20.0, 18.0),
}
WEIGHTS = {
    "topic_relevance": 0.20, "claim_strength": 0.15, "conflict_or_stakes": 0.15, "proposal_strength": 0.15, "evidence_density": 0.12, "specificity": 0.08,
    "conclusion": 0.09, "context_match": 0.04, "context_completeness": 0.10,
}
UNRESOLVED = ("and", "but", "so", "because", "that is why", "this")


def _hits(t: Column, cues: tuple[str, ...]) -> Column:
    """How many of the cues stand in a text with blanks around it."""
    return sum((t.contains(f" {c} ").cast("int") for c in cues), F.lit(0))


def text_signals(text: Column, context: Column, lexicon: dict[str, tuple[str, ...]] = LEXICON, unresolved: tuple[str, ...] = UNRESOLVED) -> Column:
    """A struct of signals of 0..100 and their weighted ``fit``, from cues in the folded words of a text.

    ``context_match`` compares with the words (of four letters) of a request; without
    one it is 50.  A null text is an empty one.
    """
    raw = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.regexp_replace(T.folded(raw), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    wanted = F.array_distinct(F.filter(T.words(T.folded(context)), lambda x: F.length(x) >= 4))
    on = lambda condition, points: F.when(condition, points).otherwise(0.0)

    def once(value: Column, of) -> Column:
        """``of(value)``, for which the value is worked out once and not wherever it stands."""
        return F.get(F.transform(F.array(value), of), F.lit(0))

    def found(w: Column) -> Column:
        t = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        return once(F.struct(w.alias("w"), t.alias("t"), F.array_join(F.slice(w, 1, 4), " ").alias("opening")), counted)

    def counted(x: Column) -> Column:
        w, t, opening = x["w"], x["t"], x["opening"]
        hits = (_hits(t, cues).alias(name) for name, cues in lexicon.items())
        open_start = sum(((opening == u) | opening.startswith(u + " ")).cast("int") for u in unresolved) > 0
        share = F.try_divide(F.size(F.array_intersect(wanted, w)), F.size(wanted))
        numbers = F.regexp_count(t, F.lit(r"\b[0-9]+\b"))
        return once(F.struct(F.struct(*hits).alias("hits"), F.size(w).alias("n"), numbers.alias("numbers"), open_start.alias("open_start"), share.alias("share")), scored)

    def scored(x: Column) -> Column:
        numbers, n = x["numbers"], x["n"]
        hits = {name: x["hits"][name] for name in lexicon}
        counts = hits | {"evidence": hits["evidence"] + F.least(numbers, F.lit(3))}
        scores = {name: bounded(start + counts[kind] * points) for name, (kind, start, points) in STARTS.items()}
        full = F.rtrim(raw).rlike(r"[.!?]$")
        scores["specificity"] = bounded(32.0 + F.least(F.lit(35.0), numbers * 12.0) + F.least(F.lit(25.0), hits["topic"] * 5.0) + on(n >= 35, 10.0))
        scores["conclusion"] = bounded(35.0 + on(full, 30.0) + on(F.size(T.sentences(raw)) >= 3, 20.0) + on(n >= 24, 15.0))
        scores["context_completeness"] = bounded(78.0 - on(x["open_start"], 24.0) - on(n < 14, 12.0) + on(hits["topic"] > 0, 8.0) + on(hits["claim"] + hits["conflict"] > 0, 6.0))
        scores["context_match"] = F.coalesce(F.least(F.lit(100.0), 20.0 + x["share"] * 80.0), F.lit(50.0))
        return once(F.struct(*(score.alias(name) for name, score in scores.items())), weighed)

    def weighed(x: Column) -> Column:
        fit = sum((x[name] * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
        return F.struct(*(F.round(x[name], 1).alias(name) for name in (*STARTS, "specificity", "conclusion", "context_completeness", "context_match")), F.round(fit, 1).alias("fit"))

    return once(words, found)


def editorial_type(scores: dict[str, Column], default: str, override: tuple[Column, str] | None = None, least: float = 45.0) -> Column:
    """The name of the highest score, the first listed of equal ones; the default under ``least``; an override where its condition holds."""
    best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores.items()))))
    chosen = best["name"]
    if override:
        chosen = F.when(_yes(override[0]), override[1]).otherwise(chosen)
    own = F.coalesce(*(F.when(chosen == name, s) for name, s in scores.items()))
    return F.when(own >= least, chosen).otherwise(default)


def lexicon_topic(text: Column, lexicon: dict[str, tuple[str, ...]], default: str = "general") -> Column:
    """The label with most evidence: 1.5 for each distinct term, and its occurrences up to 3; the first listed of equal ones."""
    tokens = F.array_join(F.regexp_extract_all(T.folded(text), F.lit("([a-z0-9]+)"), 1), "  ")

    def of(t: Column) -> Column:
        padded = F.concat(F.lit(" "), t, F.lit(" "))
        best = F.struct(F.lit(0.0).alias("s"), F.lit(default).alias("name"))
        for label, terms in lexicon.items():
            counts = [F.floor((F.length(padded) - F.length(F.replace(padded, F.lit(f" {'  '.join(x.split())} "), F.lit("")))) / (len("  ".join(x.split())) + 2)) for x in dict.fromkeys(terms)]
            score = sum((F.when(c > 0, 1.5 + F.least(F.lit(3), c)).otherwise(0.0) for c in counts), F.lit(0.0))
            best = F.when(score > best["s"], F.struct(score.alias("s"), F.lit(label).alias("name"))).otherwise(best)
        return best["name"]

    return F.get(F.transform(F.array(tokens), of), F.lit(0))


def entity_roles(text: Column, entities: dict[str, str], comparison: str, central: str) -> Column:
    """Map of entity to role: comparative if any of its sentences compares, else what its first sentence makes it.

    ``entities`` are patterns of folded text; a sentence that has no ``central`` cue
    either makes a lateral mention.
    """
    sentences = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), T.folded)
    role = lambda s: F.when(s.rlike(comparison), "comparative").when(s.rlike(central), "central").otherwise("lateral")

    def of(pattern: str) -> Column:
        roles = F.transform(F.filter(sentences, lambda s: s.rlike(pattern)), role)
        return F.when(F.array_contains(roles, "comparative"), "comparative").otherwise(F.get(roles, F.lit(0)))

    found = F.array(*(F.struct(F.lit(name).alias("key"), of(pattern).alias("value")) for name, pattern in entities.items()))
    return F.map_from_entries(F.filter(found, lambda x: x["value"].isNotNull()))


def speaker_marker(text: Column) -> Column:
    """The name of one or two capitalized words before a colon at the start; null without."""
    name = r"\p{Lu}[\p{L}\p{N}_-]{2,}"
    found = F.regexp_extract(F.coalesce(text, F.lit("")), rf"^\s*(?:>>\s*)?({name}(?:\s+{name})?)\s*:", 1)
    return F.when(found != "", found)


def needs_a_look(text: Column, cues: tuple[str, ...] = ("chart", "graph", "image", "on the screen", "as you can see", "percent")) -> Column:
    """Whether the text points at something that must be seen."""
    return T.folded(text).rlike(rf"\b(?:{'|'.join(cues)})\b")


def ends_open(text: Column, tail: tuple[str, ...] = T.OPEN_TAIL) -> Column:
    """Whether a text is cut off: empty, ended by a joining mark, or by a word that leads on."""
    t = T.collapsed(text)
    last = F.element_at(F.regexp_extract_all(F.concat(F.lit("_ "), T.folded(t)), F.lit(r"([\p{L}\p{N}_-]+)"), 1), -1)
    return F.when(t == "", True).when(t.rlike(r"[.!?]$"), False).otherwise(t.rlike(r"[,;:—-]$") | last.isin(*tail))


def context_words(context: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words of two characters or more, without marks and stop words."""
    clean = F.transform(T.words(context), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    return F.filter(clean, lambda w: (F.length(w) > 1) & ~F.lower(w).isin("", *stop))


def context_names(context: Column, stop: tuple[str, ...] = ()) -> Column:
    """Capitalized words of 3 to 15 characters, the first of each spelling."""
    names = F.filter(context_words(context, stop), lambda w: F.length(w).between(3, 15) & w.rlike(r"^\p{Lu}"))
    low = F.transform(names, F.lower)
    return F.filter(names, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def is_impact_word(word: Column, words: tuple[str, ...] = ("never", "always", "first", "truth", "proof")) -> Column:
    """A listed word, whatever marks are around it, or one with a digit."""
    plain = F.regexp_replace(T.folded(word), r"^[.,!?;:\"'()\[\]{}]+|[.,!?;:\"'()\[\]{}]+$", "")
    return plain.isin(*words) | plain.rlike("[0-9]")


# Blocks of a transcript


def duration_points(seconds: Column, shortest: float = 15.0) -> Column:
    """-8 when too short, 10 up to half a minute, then 7, 2 and -1 up to the preferred length, and -5."""
    d = F.greatest(F.coalesce(seconds.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(d < shortest, -8).when(d <= 30, 10).when(d <= 60, 7).when(d <= 120, 2).when(d <= PREFERRED_SECONDS, -1).otherwise(-5)


def relevance(text: Column, phrases: Column, names: Column, words: Column) -> Column:
    """20 a phrase, 25 a name, 5 a word (of two letters) that the text holds; 80 at most with a name, else 60."""
    held = lambda xs: F.coalesce(F.size(F.filter(xs, lambda x: F.contains(text, x))), F.lit(0))
    named = held(names)
    total = held(phrases) * 20 + named * 25 + held(F.filter(words, lambda w: F.length(w) > 1)) * 5
    return F.least(F.when(named > 0, 80).otherwise(60), total)


def block_score(
    text: Column, seconds: Column, context: Column, bonus: Column,
    hooks: tuple[str, ...] = T.HOOK_PATTERNS, emotional: tuple[str, ...] = T.EMOTIONAL, fillers: tuple[str, ...] = T.FILLERS,
) -> Column:
    """0..100 of a block: 40, and what its opening, feeling, marks, length, ending and context give or take."""
    raw = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        start = F.array_join(F.slice(w, 1, 15), " ")
        opening = F.least(F.lit(20), sum((start.rlike(p).cast("int") * 12 for p in hooks), F.lit(0)))
        felt = F.size(F.filter(w, lambda x: x.rlike("|".join(emotional))))
        whole = F.array_join(w, " ")
        spoken = sum((T.occurrences(whole, f) if " " in f else F.size(F.filter(w, _same(f))) for f in fillers), F.lit(0))
        marks = F.least(F.lit(10), T.occurrences(raw, "!") * 4 + T.occurrences(raw, "?") * 2)
        ending = F.when(F.rtrim(raw).rlike(r"[.!?]$"), 10).otherwise(-15)
        return bounded(40.0 + opening + F.least(F.lit(20.0), felt / n * 200) + marks + context + duration_points(seconds) + ending + bonus - F.least(F.lit(15.0), spoken / n * 150))

    return F.get(F.transform(F.array(T.words(F.lower(raw))), of), F.lit(0))


def _same(word: str):
    return lambda x: x == word


def catalog_metrics(views: Column, plays: Column, likes: Column, comments: Column, followers: Column, caption: Column, width: Column, height: Column) -> Column:
    """Rates of a catalog row; views are plays where they are missing or 0, and a rate without its base is 0."""
    seen = F.when(F.coalesce(views, F.lit(0)) != 0, views).otherwise(F.coalesce(plays, F.lit(0))).cast("double")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.coalesce(caption, F.lit(""))
    return F.struct(
        seen.alias("views"),
        rate(F.coalesce(likes, F.lit(0)) + F.coalesce(comments, F.lit(0)), seen).alias("engagement_rate"),
        rate(seen, followers).alias("view_rate"),
        rate(width, height).alias("aspect_ratio"),
        F.length(c).alias("caption_chars"),
        F.size(T.words(c)).alias("caption_words"),
    )
