"""Scores of written text between 0 and 1 as column expressions: U8 to U14."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
#: The weights of the scores by mode; a score that is null is left out.
WEIGHTS = {
    "story": {"spelling": 1.0, "punctuation": 1.0, "grammar": 1.0, "semantics": 1.0},
    "chat": {"spelling": 1.0, "punctuation": 1.0, "grammar": 1.0, "semantics": 0.25, "turn_format": 1.5, "instruction_follow": 1.5, "coherence": 1.0},
    "both": {"spelling": 1.0, "punctuation": 1.0, "grammar": 1.0, "semantics": 1.0, "turn_format": 1.0, "instruction_follow": 1.0, "coherence": 1.0},
}
#: Words of a story prompt that are no topic, and words that tell a story.
PROMPT_WORDS = ("user", "assistant", "tell", "me", "a", "an", "the", "about", "short", "story")
STORY_WORDS = ("once", "then", "was", "had", "little", "one")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; inside a lambda its expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _scored(text: Column, score: Column) -> Column:
    """Zero for a blank text."""
    return F.when(strip(text) == "", 0.0).otherwise(score)


def spelling(text: Column, known: Column | None = None) -> Column:
    """U8: the share of words without a character four times in a row; with ``known``, the share of known words, weighted 0.6, else with the share of letters, weighted 0.3."""
    w = words(text)
    n = F.size(w)
    clean = 1.0 - F.size(F.filter(w, lambda x: F.rlike(F.lower(x), F.lit(r"(.)\1{3,}")))) / n
    letters = _count(text, r"\p{L}") / F.greatest(F.lit(1), F.length(strip(text)))
    return F.when(n == 0, 0.0).otherwise(_clamp(0.7 * clean + 0.3 * letters if known is None else 0.4 * clean + 0.6 * known))


def punctuation(text: Column) -> Column:
    """A sentence's end anywhere and at the end, blanks around marks, balanced quotes and brackets."""
    t = strip(text)
    ends = F.when(F.rlike(t, F.lit(r"[.!?]$")), 1.0).when(F.size(F.split(collapse(t), " ")) < 4, 0.5).otherwise(0.0)
    bad = _count(t, r"\s+[,.!?;:]") + _count(t, r"[,.!?;:]{2,}")
    spacing = _clamp(1.0 - bad / F.greatest(F.lit(1), F.floor(F.length(t) / 20)))
    odd = [_count(t, '"') % 2 != 0, _count(t, "'") % 2 != 0, _count(t, r"\(") != _count(t, r"\)"), _count(t, r"\[") != _count(t, r"\]")]
    balance = 1.0 - 0.15 * sum(x.cast("int") for x in odd)
    return _scored(text, _clamp(0.35 * F.rlike(t, F.lit("[.!?]")).cast("int") + 0.25 * ends + 0.25 * spacing + 0.15 * balance))


def grammar(text: Column) -> Column:
    """Capitals after sentence ends, words said twice in a row, runs of spaces."""
    t = strip(text)
    total, good = _count(t, r"[.!?]++(?=\s*\S)"), _count(t, r"[.!?]++(?=\s*\p{Lu})")
    capitals = F.when(total > 0, good / total).when(F.rlike(t, F.lit(r"^\p{Lu}")), 1.0).otherwise(0.5)
    w = F.transform(words(t), F.lower)
    before = F.concat(F.array(F.lit(None).cast("string")), w)
    twice = F.size(F.filter(F.zip_with(w, before, lambda x, y: x == y), lambda x: x))
    said = F.when(F.size(w) > 0, 1.0 - twice / F.size(w)).otherwise(0.0)
    spacing = _clamp(1.0 - _count(t, "  +") / F.greatest(F.lit(1), F.floor(F.length(t) / 30)))
    return _scored(text, _clamp(0.4 * capitals + 0.35 * said + 0.25 * spacing))


def continuation(text: Column, prompt: Column) -> Column:
    """The text after the prompt, where it starts with it."""
    t = strip(text)
    return F.when((prompt != "") & F.startswith(F.lower(t), F.lower(prompt)), F.regexp_replace(F.substr(t, F.length(prompt) + 1), r"^\s+", "")).otherwise(t)


def semantics(text: Column, prompt: Column | None = None) -> Column:
    """The share of distinct words, words taken up from the prompt (best at 15 %), entropy of the characters."""
    prompt = F.lit("") if prompt is None else prompt
    cont = continuation(text, prompt)
    w, asked = F.transform(words(cont), F.lower), F.transform(words(prompt), F.lower)
    unique = F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)
    taken = _let(asked, lambda a: F.size(F.filter(w, lambda x: F.array_contains(a, x)))) / F.size(w)
    stick = F.when((F.size(asked) > 0) & (F.size(w) > 0), _clamp(1.0 - F.abs(taken - 0.15) / 0.85)).otherwise(0.5)
    low = F.lower(F.when(cont != "", cont).otherwise(strip(text)))
    shares = _let(low, lambda s: F.transform(F.array_distinct(F.split(s, "")), lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / F.length(s)))
    entropy = F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return _scored(text, _clamp(0.35 * unique + 0.30 * stick + 0.35 * _clamp((entropy - 1.5) / 3.0)))


def _extra_user(cont: Column) -> Column:
    return F.rlike(cont, F.lit(r"(?:^|\s)User:"))


def turn_format(text: Column, prompt: Column) -> Column:
    """Words of its own, no user turn, no repeated role marker."""
    cont = continuation(text, prompt)
    n = F.size(words(cont))
    content = F.when(n >= 3, 1.0).when(n > 0, 0.4).otherwise(0.0)
    no = lambda x: (~x).cast("int")
    score = 0.45 * content + 0.35 * no(_extra_user(cont)) + 0.10 * no(F.startswith(cont, F.lit("User:"))) + 0.10 * no(F.startswith(cont, F.lit("Assistant:")))
    return F.when(strip(cont) == "", 0.0).otherwise(_clamp(score))


def instruction_kind(prompt: Column) -> Column:
    """What a prompt asks for: yesno, onesentence, dialogue, story or generic."""
    p = F.lower(prompt)
    has = lambda *xs: F.rlike(p, F.lit("|".join(xs)))
    return F.when(has("yes or no", "yes/no"), "yesno").when(has("summarize", "one sentence"), "onesentence").when(has("what is your name") | (_count(p, "user:") >= 2), "dialogue").when(has("story", "tell me"), "story").otherwise("generic")


def instruction_follow(text: Column, prompt: Column) -> Column:
    """Checks by the kind of prompt."""
    cont, kind = continuation(text, prompt), instruction_kind(prompt)
    w = F.transform(words(cont), F.lower)
    n, alone = F.size(w), (~_extra_user(cont)).cast("int")
    yesno = 0.7 * F.rlike(F.lower(cont), F.lit(r"\b(?:yes|no)\b")).cast("int") + 0.2 * F.when(n <= 40, 1.0).otherwise(0.4) + 0.1 * alone
    ends = _count(cont, "[.!?]+")
    one = 0.5 * F.when(ends <= 1, 1.0).when(ends == 2, 0.6).otherwise(0.2) + 0.4 * F.when(n.between(3, 40), 1.0).otherwise(0.4) + 0.1 * alone
    topic = F.array_distinct(F.filter(F.transform(words(prompt), F.lower), lambda x: ~x.isin(*PROMPT_WORDS)))
    overlap = F.when(F.size(topic) > 0, _let(topic, lambda t: F.size(F.filter(w, lambda x: F.array_contains(t, x)))) / F.size(topic)).otherwise(0.5)
    told = F.when(F.exists(w, lambda x: x.isin(*STORY_WORDS)), 1.0).otherwise(0.5)
    story = 0.35 * _clamp(overlap) + 0.3 * _clamp(n / 20.0) + 0.25 * told + 0.1 * alone
    talk = 0.55 * alone + 0.45 * F.when(n.between(2, 60), 1.0).otherwise(0.4)
    score = F.when(kind == "yesno", yesno).when(kind == "onesentence", one).when(kind == "story", story).when(kind == "dialogue", talk).otherwise(0.5 * alone + 0.5 * _clamp(n / 8.0))
    return F.when(n == 0, 0.0).otherwise(_clamp(score))


def parse_weights(written: str) -> dict[str, float]:
    """Weights written as ``spelling=1,grammar=0.5``."""
    return {k.strip(): float(v) for k, _, v in (x.partition("=") for x in written.split(",") if x.strip())}


def aggregate(scores: dict[str, Column], mode: str = "story", weights: dict[str, float] | None = None) -> Column:
    """The weighted mean of the scores that are not null; unknown names in ``weights`` are ignored."""
    used = WEIGHTS[mode] | {k: v for k, v in (weights or {}).items() if k in WEIGHTS[mode]}
    given = [(scores[k].cast("double"), w) for k, w in used.items() if k in scores]
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in given), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in given), F.lit(0.0))
    return _clamp(F.when(weight == 0, 0.0).otherwise(total / weight))
