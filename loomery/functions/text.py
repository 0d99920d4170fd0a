"""Text keys, filters and classifiers as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r\f\x0B]+"
#: Openings of questions about facts; the longest that fits counts.
TOPIC_PREFIXES = ("what is", "what are", "what's", "whats", "who is", "who was", "who were", "who's", "where is", "where was", "when is", "when was", "tell me about", "how many", "how much")
#: Openings of stories and commands, and wrappers of arithmetic.
STORY_PREFIXES = ("once upon", "once there", "there once", "let me tell", "write a", "write me", "continue the", "continue this")
CALC_WRAPPERS = ("what is the value of", "what is", "what's", "whats", "calculate", "compute")
#: Ordered rules of question families, (family, pattern on the question's key).
FAMILIES = (
    ("capital_of", r"^what is the capital of "),
    ("possess_capital", r"^what is .+?'s capital$"),
    ("country_of", r"^what country is .+ in$"),
    ("where_is", r"^where is "),
    ("organ_system", r"^which organ system does .+ belong to$"),
    ("pathogen", r"^what pathogen causes "),
    ("who_invented", r"^who invented "),
    ("what_did_invent", r"^what did .+ invent$"),
    ("atomic_number", r"^what is the atomic number of "),
    ("element_by_number", r"^which element has atomic number "),
    ("born", r"^when was .+ born$"),
    ("prime", r"^is [0-9]+ a prime number$"),
    ("year_released", r"^in which year was "),
    ("theorem", r"^state the "),
    ("how_do_i", r"^how do i "),
    ("layer_stream", r"^what is sequential layer streaming$"),
    ("gas", r"^what gas "),
    ("project", r"^(?:does training use autograd|what tokenizer )"),
    ("wiki_extra", r"^what are pancakes$"),
)
#: Patterns of the slot that a question asks for, in order.
SLOTS = (
    r"^which organ system does (?:the )?(.+) belong to$", r"^what pathogen causes (.+)$", r"^what is the capital of (.+)$", r"^what is (.+)'s capital$", r"^what country is (.+) in$", r"^where is (.+)$", r"^is ([0-9]+) a prime number$",
    r"^when was (.+) born$", r"^who invented (.+)$", r"^what did (.+) invent$", r"^what is the atomic number of (.+)$", r"^which element has atomic number (.+)$", r"^in which year was (?:the )?(.+?)(?: programming language)? first released$",
)
#: Shapes of answers from the mix of facts; one character on either side says as much as many, and is found in linear time.
MIX_SHAPES = r"(?i)the capital of .+? is .|. is the capital of .|. belongs to the .|. is the pathogen that causes .|. is credited with inventing .|. was born in [0-9]|. was first released in [0-9]|(?:yes|no), [0-9]+ is a (?:prime|composite) number"
#: Greek letters and dashes of formulas, which the compatibility decomposition leaves.
SCIENCE = {"α": "alpha", "β": "beta", "γ": "gamma", "π": "pi", "–": "-", "—": "-"}
#: Markers of an answer that dumps stored facts, in lower case.
DUMP_MARKERS = ("the capital of", " belongs to the ", "is the pathogen that causes", "user:", "assistant:", "rotavirus")
#: Wording of dosing and treatment.
ADVICE = r"(?i)\b(?:take\s+[0-9]|dosage|dosing|mg/?d(?:ay)?|should\s+you|how\s+much\s+to\s+take|treatment\s+for|how\s+to\s+treat|cure\s+for|prescri(?:be|ption))\b"
#: Frames that no native line may hold.
WRAPPERS = ("it is known that ", "a short note on ", "regarding ", "in plain terms, ", "students remembering ", "if you ask ", "question: ")


def collapse(text: Column) -> Column:
    """Runs of blanks to one space, trimmed (ASCII blanks, the same in Spark and SQL twins)."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def fold(text: Column) -> Column:
    """Lower case, with the one folding of German that lower() leaves out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def question_key(text: Column) -> Column:
    """H1: collapse, drop a leading ``User:``, cut at ``Assistant:`` (in any case), drop one question mark, fold."""
    bare = F.trim(F.regexp_replace(collapse(text), r"(?i)^user:", ""))
    bare = F.trim(F.regexp_replace(bare, r"(?i)assistant:.*$", ""))
    return fold(F.trim(F.regexp_replace(bare, r"\?$", "")))


def pair_key(text: Column) -> Column:
    """The key of conflict drops: lower case, question mark kept."""
    return F.lower(collapse(text))


def answer_key(text: Column) -> Column:
    """H2: whatever is no letter, number, low line or blank to blanks, collapsed and folded."""
    return fold(collapse(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")))


def answers_match(a: Column, b: Column) -> Column:
    return (answer_key(a) == answer_key(b)) & (answer_key(a) != "")


def bare_entity(text: Column) -> Column:
    """H3: collapse, strip blanks and dots, fold."""
    return fold(F.regexp_replace(collapse(text), r"^[ .]+|[ .]+$", ""))


def search_topic(text: Column) -> Column:
    """H4: drop one closing question mark and closing dots, the longest opening that fits, and one article."""
    bare = F.trim(F.regexp_replace(collapse(text), r"(?i)^user:", ""))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\?$", "")), r"\.+$", ""))
    opening = "|".join(sorted(TOPIC_PREFIXES, key=len, reverse=True))
    rest = F.regexp_replace(F.regexp_replace(bare, f"(?i)^(?:{opening})", ""), r"^[ :?.]+|[ :?.]+$", "")
    rest = F.when(F.rlike(bare, F.lit(f"(?i)^(?:{opening})")), rest).otherwise(bare)
    return F.trim(F.regexp_replace(rest, r"(?i)^(?:the|a|an)(?: |$)", ""))


def article_variants(entity: Column) -> Column:
    """The entity as given, bare, and with each article; distinct."""
    bare = F.regexp_replace(collapse(entity), r"(?i)^(?:the|a|an) ", "")
    return F.array_distinct(F.array(collapse(entity), bare, *[F.concat(F.lit(a + " "), bare) for a in ("the", "a", "an")]))


def story_line(text: Column) -> Column:
    """H7: curly marks to ASCII, everything else beyond printable ASCII to blanks, collapsed."""
    plain = F.translate(text, "‘’“”–—", "''\"\"--")
    return collapse(F.regexp_replace(F.replace(plain, F.lit("…"), F.lit("...")), r"[^ -~]", " "))


def story_with_boundaries(body: Column) -> Column:
    """H10."""
    return F.concat(F.lit("<story> "), body, F.lit(" </story>"))


def native_line(user: Column, assistant: Column) -> Column:
    """H9: one line of both turns."""
    return F.concat(F.lit("User: "), collapse(user), F.lit(" Assistant: "), collapse(assistant))


def split_native(line: Column) -> tuple[Column, Column]:
    """Both turns of a native line; null where one is missing."""
    user = F.trim(F.regexp_extract(line, r"^User: (.*?) Assistant: ", 1))
    assistant = F.trim(F.regexp_extract(line, r"^User: .*? Assistant: (.*)$", 1))
    good = (user != "") & (assistant != "")
    return F.when(good, user), F.when(good, assistant)


#: What a turn's marker looks like when generation stops within it.
PARTIAL_MARKERS = ("User:", "Assistant:")


def sanitize_reply(text: Column, stops: tuple[str, ...] = ()) -> Column:
    """Cut at a leaked user turn and at the first of the ``stops``; then unfinished markers and blanks at the end go, until none is left."""
    cut = F.regexp_replace(text, r"(?s)User:.*$", "")
    for s in stops:
        at = F.instr(cut, s)
        cut = F.when(at > 0, F.substr(cut, F.lit(1), at - 1)).otherwise(cut)
    # Every proper beginning of two letters or more, and the whole markers; one repeated group strips any number of them.
    tails = sorted({m[:n] for m in PARTIAL_MARKERS for n in range(2, len(m) + 1)}, key=len, reverse=True)
    return F.trim(F.regexp_replace(cut, rf"(?:(?:^|\s+)(?:{'|'.join(tails)}))+\s*$", ""))


def first_sentences(text: Column, n: int = 2) -> Column:
    """H6."""
    return F.array_join(F.slice(F.split(collapse(text), r"(?<=[.!?]) "), 1, n), " ")


def usable_label(text: Column) -> Column:
    """Not empty, no bare item id, no address."""
    return (F.trim(text) != "") & ~F.rlike(F.trim(text), F.lit(r"^Q[0-9]+$")) & ~F.rlike(F.trim(text), F.lit(r"^https?://"))


def looks_like_advice(user: Column, assistant: Column) -> Column:
    """P3."""
    return F.rlike(F.concat_ws(" ", user, assistant), F.lit(ADVICE))


def looks_like_dump(text: Column) -> Column:
    """P10: blank, or with a marker in any case."""
    return (F.trim(text) == "") | reduce(lambda a, b: a | b, [F.contains(fold(text), F.lit(m)) for m in DUMP_MARKERS])


def neighbour_bleed(prompt: Column, answer: Column, entity: str, forbidden: tuple[str, ...]) -> Column:
    """The prompt names the entity and the answer one of its forbidden neighbours."""
    return F.contains(fold(prompt), F.lit(entity)) & reduce(lambda a, b: a | b, [F.contains(fold(answer), F.lit(x)) for x in forbidden])


def wrapped(line: Column) -> Column:
    """A native line that holds a wrapping frame."""
    return reduce(lambda a, b: a | b, [F.contains(fold(line), F.lit(m)) for m in WRAPPERS])


def is_stub(text: Column, trimmed: str = " .:") -> Column:
    """A disambiguation stub; ``trimmed`` at its end doesn't count."""
    return F.endswith(F.regexp_replace(fold(text), f"[{trimmed}]+$", ""), F.lit("may refer to"))


def fact_question(text: Column) -> Column:
    """A known opening; else no story or command, and 2 to 8 words."""
    low = fold(F.trim(F.regexp_replace(collapse(text), r"(?i)^user:", "")))
    opens = lambda words: reduce(lambda a, b: a | b, [F.startswith(low, F.lit(w)) for w in words])
    return opens(TOPIC_PREFIXES) | (~opens((*STORY_PREFIXES, "python ", ":", "/")) & F.size(F.split(low, " ")).between(2, 8) & (low != ""))


def calc_candidate(text: Column) -> Column:
    """A digit and an operator once the longest wrapper that fits is gone."""
    wrapper = "|".join(sorted(CALC_WRAPPERS, key=len, reverse=True))
    rest = F.regexp_replace(F.trim(F.regexp_replace(collapse(text), r"(?i)^user:", "")), f"(?i)^(?:{wrapper})", "")
    return F.rlike(rest, F.lit("[0-9]")) & F.rlike(rest, F.lit(r"[-+*/^%]"))


def family(user: Column) -> Column:
    """The first rule that matches the question's key, else ``other``."""
    key = question_key(user)
    return reduce(lambda w, r: w.when(F.rlike(key, F.lit(r[1])), r[0]), FAMILIES[1:], F.when(F.rlike(key, F.lit(FAMILIES[0][1])), FAMILIES[0][0])).otherwise("other")


def relation(user: Column) -> Column:
    """``inventor``, ``capital`` or empty."""
    key = question_key(user)
    asks = F.rlike(key, F.lit(r"^(?:who invented|who is credited with inventing) |(?:who invented|who is credited with inventing|what did)$"))
    inventor = F.when(F.startswith(key, F.lit("what did ")), F.endswith(key, F.lit(" invent"))).otherwise(asks)
    capital = F.rlike(key, F.lit(r"what is the capital of |where is |what country is |'s capital"))
    return F.when(inventor, "inventor").when(capital, "capital").otherwise("")


def slot(user: Column) -> Column:
    """What the question asks about, or empty."""
    return slot_of(question_key(user))


def slot_of(key: Column) -> Column:
    """U3 for a question's key. A pattern is tried only where the key has the words that it begins with."""
    found = [F.when(F.startswith(key, F.lit(p[1:].split("(")[0])), F.nullif(F.trim(F.regexp_extract(key, p, 1)), F.lit(""))) for p in SLOTS]
    return F.coalesce(*found, F.lit(""))


def omits(slot: Column, assistant: Column) -> Column:
    """A9 for a slot that is known: the answer does not name it; the slot's own punctuation is not dropped."""
    return (slot != "") & ~F.contains(answer_key(assistant), slot)


def omits_slot(user: Column, assistant: Column) -> Column:
    """The answer does not name what the question asks about."""
    return omits(slot(user), assistant)


def linked_variants(user: Column, assistant: Column) -> Column:
    """Further pairs that a capital, inventor or element fact implies, as an array of structs; empty unless question and answer agree."""
    q, given = collapse(user), F.regexp_replace(collapse(assistant), r"\.+$", "")
    full = F.when(F.endswith(assistant, F.lit(".")), assistant).otherwise(F.concat(assistant, F.lit(".")))
    pair = lambda u, a: F.struct(u.alias("user"), a.alias("assistant"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    land, told = F.regexp_extract(q, r"^What is the capital of (.+)\?$", 1), r"^The capital of (.+) is (.+)$"
    city = F.regexp_extract(given, told, 2)
    body = say(city, " is the capital of ", land, ".")
    capital = F.array(pair(say("Where is ", city, "?"), body), pair(say("What country is ", city, " in?"), body), pair(say("What is ", land, "'s capital?"), say("The capital of ", land, " is ", city, ".")))
    thing, credit = F.regexp_extract(q, r"^Who invented (.+)\?$", 1), r"^(.+) is credited with inventing (.+)$"
    inventor = F.array(pair(say("Who is credited with inventing ", thing, "?"), full), pair(say("What did ", F.regexp_extract(given, credit, 1), " invent?"), full))
    matter, counted = F.regexp_extract(q, r"^What is the atomic number of (.+)\?$", 1), r"^The atomic number of (.+) is ([0-9]+)$"
    element = F.array(pair(say("Which element has atomic number ", F.regexp_extract(given, counted, 2), "?"), full))
    empty = F.array().cast("array<struct<user:string,assistant:string>>")
    return F.when((land != "") & (F.regexp_extract(given, told, 1) == land), capital).when((thing != "") & (F.regexp_extract(given, credit, 2) == thing), inventor).when((matter != "") & (F.regexp_extract(given, counted, 1) == matter), element).otherwise(empty)


def frames(user: Column, assistant: Column, dense: bool = False) -> Column:
    """Four wordings of a pair, or eight where ``dense``; distinct, in order."""
    u, a = F.trim(F.replace(F.regexp_replace(collapse(user), r"(?i)^user: ?", ""), F.lit("?"), F.lit(""))), F.regexp_replace(collapse(assistant), r"(?i)^assistant: ?", "")
    forms = ["It is known that {u} is resolved by {a}.", "Regarding {u}, the corresponding detail is {a}.", "Question: {u}? Response: {a}."]
    if dense:
        forms += ["If you ask {u}, the answer is {a}.", "In plain terms, {u} maps to {a}.", "A short note on {u}: {a}", "Students remembering {u} recall {a}."]
    filled = [F.concat(*[u if x == "{u}" else a if x == "{a}" else F.lit(x) for x in re.split(r"(\{[ua]\})", f) if x]) for f in forms]
    return F.array_distinct(F.array(native_line(user, assistant), *filled))


def story_question(ord: Column) -> Column:
    """The template by line number."""
    forms = ("Tell me a story.", "Write a short story.", "Can you tell a story?", "I want a story.", "Story time!")
    return F.element_at(F.array(*map(F.lit, forms)), (F.pmod(ord, F.lit(len(forms))) + 1).cast("int"))


def folded(label: str | None) -> str | None:
    """H8 for one label: formula signs by name, letters without their marks, whatever has no ASCII form left out; if nothing stays, the label."""
    if label is None:
        return None
    named = "".join(SCIENCE.get(c, c) for c in " ".join(label.split()))
    bare = "".join(c for c in unicodedata.normalize("NFKD", named) if c.isascii())
    return " ".join(bare.split()) or named


def fold_label(text: Column) -> Column:
    """H8. Spark has no built-in decomposition, so the labels go through Arrow batches."""

    def fold_all(labels: pd.Series) -> pd.Series:
        return labels.map(folded, na_action="ignore")

    return F.pandas_udf(fold_all, "string")(text)
