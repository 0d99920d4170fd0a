"""License scan: ordered signature rules behind a keyword prefilter, with DataFrame functions only.

A text becomes its words. A text with none of the rules' anchor words is done; in the others each anchor word is
looked at with the words around it. A rule is an anchor word, a pattern for the words up to it and one for the words
after it, a priority (1 is best) and a confidence. Detections are ordered by place, longer first; one whose
interval lies within an earlier one's of the same or better priority is suppressed.

The rules are the hand-written sentences and glued names of ``signatures``, and for every family of names below the usual wordings: grants, versions,
identifiers, expressions of identifiers, and bare names after a grant. How many words around an anchor are looked at follows from the longest rule.

Everything stays in the row of its document: no shuffle, no join.

Edge cases: null and empty texts have no words and no labels, score 0. Repeated rows are scanned one by
one. Extra columns are ignored. Work on a text grows with its words: detections are compared only with those of anchors that can reach them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signatures as S
from .common import words_of

#: Phrases whose places are always reported.
BASE = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))
#: Label, pattern of the name before the word "license", identifier as words, acronym.
FAMILIES = (
    ("agpl", "(?:gnu )?affero general public", "agpl", "agpl"),
    ("afl", "academic free", "afl", "afl"),
    ("apache", "apache(?: software)?", "apache", "asl"),
    ("apsl", "apple public source", "apsl", "apsl"),
    ("artistic", "(?:perl )?artistic", "artistic", ""),
    ("blueoak", "blue oak model", "blueoak", ""),
    ("boost", "boost(?: software)?", "bsl", ""),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause) bsd", "bsd 2 clause", ""),
    ("bsd-3-clause", "(?:revised|new|modified|3 clause) bsd", "bsd 3 clause", ""),
    ("bsd", "bsd(?: style)?", "0bsd", ""),
    ("cddl", "common development and distribution", "cddl", "cddl"),
    ("cecill", "cecill(?: free software)?", "cecill", "cecill"),
    ("cpl", "common public", "cpl", "cpl"),
    ("ecl", "educational community", "ecl", "ecl"),
    ("epl", "eclipse public", "epl", "epl"),
    ("eupl", "european union public", "eupl", "eupl"),
    ("gfdl", "(?:gnu )?free documentation", "gfdl", "gfdl"),
    ("gpl", "(?:gnu )?general public", "gpl", "gpl"),
    ("icu", "(?:unicode )?icu", "icu", ""),
    ("isc", "isc", "isc", ""),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "lgpl", "lgpl"),
    ("libpng", "libpng", "libpng", ""),
    ("lppl", "latex project public", "lppl", "lppl"),
    ("mit", "(?:mit|expat)(?: style)?", "mit", ""),
    ("mit-0", "mit no attribution", "mit 0", ""),
    ("mpl", "mozilla public", "mpl", "mpl"),
    ("ms-pl", "microsoft public", "ms pl", ""),
    ("ms-rl", "microsoft reciprocal", "ms rl", ""),
    ("ncsa", "(?:university of illinois )?ncsa open source", "ncsa", ""),
    ("ofl", "(?:sil )?open font", "ofl", "ofl"),
    ("openssl", "openssl", "openssl", ""),
    ("osl", "open software", "osl", "osl"),
    ("php", "php", "php", ""),
    ("postgresql", "postgresql", "postgresql", ""),
    ("psf", "python(?: software foundation)?", "psf", "psfl"),
    ("qpl", "q public", "qpl", "qpl"),
    ("ruby", "ruby", "ruby", ""),
    ("upl", "universal permissive", "upl", ""),
    ("vim", "vim", "vim", ""),
    ("w3c", "w3c software", "w3c", ""),
    ("wtfpl", "do what the fuck you want to public", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib", ""),
    ("zpl", "zope public", "zpl", "zpl"),
)
#: Terms of the Creative Commons family, as words.
CC_TERMS = (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"), ("by-nc", "attribution noncommercial"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"))
GRANT = r"(?:licensed|released|distributed|available|published|provided|covered) under (?:the |an |a )?(?:terms (?:and conditions )?of )?(?:the )?"
VERSION = r"(?: version| v| ver)? v?[0-9]+(?: [0-9]+)*(?: or(?: any)? later)?"


@dataclass(frozen=True)
class Rule:
    label: str
    anchor: str
    left: str  # of the words up to the anchor, each followed by a space; empty: any
    right: str  # of the words after the anchor, each led by a space; empty: any
    tier: int
    confidence: float
    own: bool = False  # the detection is the words of the right pattern's first group, not all that was matched


#: Words an expression of identifiers may hold besides the identifiers of the families.
EXPRESSION = ("or", "and", "with", "only", "later", "plus", "exception", "classpath", "llvm", "gcc", "runtime", "cc0", "unlicense", "cc", "by", "sa", "nc", "nd", "ref", "licenseref")
#: Words after "spdx license identifier" that are looked at.
LONG_AFTER = 400


def rules() -> list[Rule]:
    """The signatures, built from the families above by a few forms of wording."""
    begin, end = r"(?<![^ ])", r"(?![^ ])"
    out = []
    member = "(?:" + "|".join(sorted({*EXPRESSION, *(w for f in FAMILIES for w in f[2].split())}, key=lambda w: (-len(w), w))) + "|v?[0-9]+)(?![^ ])"
    for label, name, identifier, acronym in FAMILIES:
        for anchor in ("license", "licence"):
            out.append(Rule(label, anchor, f"{begin}{GRANT}{name} $", f"^{VERSION}{end}", 1, 0.99))
            out.append(Rule(label, anchor, f"{begin}{name} $", f"^{VERSION}{end}", 1, 0.97))
            out.append(Rule(label, anchor, f"{begin}{GRANT}{name} $", "", 2, 0.95))
            out.append(Rule(label, anchor, f"{begin}{name} $", "", 3, 0.8))
        out.append(Rule(label, "identifier", f"{begin}spdx license $", f"^ {identifier}(?: [0-9]+)*{end}", 1, 0.99))
        out.append(Rule(label, "identifier", f"{begin}spdx license $", f"^(?: {member})+? (?:or|and|with)( {identifier}(?: [0-9]+)*){end}", 2, 0.9, own=True))
        first, *rest = identifier.split()
        after = "".join(f" {w}" for w in rest)
        out.append(Rule(label, first, f"{begin}{GRANT}$", f"^{after}(?: version| v)?(?: [0-9]+)*{end}", 2, 0.9))
        if rest:
            out.append(Rule(label, first, "", f"^{after}{end}", 3, 0.7))
        if acronym:
            out.append(Rule(label, acronym, "", f"^{VERSION}{end}", 2, 0.9))
            out.append(Rule(label, acronym, f"{begin}{GRANT}(?:gnu )?$", "", 2, 0.9))
    for term, words in CC_TERMS:
        spoken = term.replace("-", " ")
        out.append(Rule(f"cc-{term}", "cc", "", f"^ {spoken}(?: [0-9]+)+{end}", 1, 0.97))
        out.append(Rule(f"cc-{term}", "cc", f"{begin}{GRANT}$", f"^ {spoken}{end}", 1, 0.97))
        out.append(Rule(f"cc-{term}", "cc", "", f"^ {spoken}{end}", 3, 0.7))
        out.append(Rule(f"cc-{term}", "commons", f"{begin}creative $", f"^ {words}(?: [0-9]+)*{end}", 1, 0.97))
    for label, phrase in S.BODIES:
        left, anchor, right = (x.strip() for x in re.fullmatch(r"(.*?)\*([a-z0-9]+)\*(.*)", phrase).groups())
        out.append(Rule(label, anchor, f"{begin}{left} $" if left else "", f"^ {right}{end}" if right else "", 1 if label != "warranty" else 3, 0.98 if label != "warranty" else 0.6))
    out += [Rule(label, anchor, "", "", 2, 0.85) for label, anchor in S.GLUED]
    out.append(Rule("cc0", "cc0", "", "", 2, 0.9))
    out.append(Rule("unlicense", "unlicense", "", "", 2, 0.9))
    out.append(Rule("public-domain", "domain", f"{begin}(?:released into|dedicated to|placed in|in) the public $", "", 2, 0.85))
    out.append(Rule("copyright", "copyright", "", r"^(?: c)? (?:19|20)[0-9][0-9](?![^ ])", 3, 0.7))
    out.append(Rule("reserved", "reserved", f"{begin}all rights $", "", 2, 0.8))
    out.append(Rule("proprietary", "confidential", f"{begin}proprietary and $", "", 2, 0.8))
    return out


def reach(patterns: list[str]) -> int:
    """At least as many words as any of the patterns can match, for repeats of numbers with a few to spare."""
    return max(p.count(" ") for p in patterns) + 4


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(documents: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, base (label and start of each fixed phrase) and kept (start, end, label, tier, confidence, matched text of each detection left)."""
    signatures = rules() if signatures is None else signatures
    anchors = sorted({r.anchor for r in signatures} | {"cc", "license", "reserved"})
    before_n, after_n = reach([r.left for r in signatures]), reach([r.right for r in signatures if not r.own])
    row = lambda r: F.struct(F.lit(r.label).alias("label"), F.lit(r.left).alias("left"), F.lit(r.right).alias("right"), F.lit(r.tier).alias("tier"), F.lit(r.confidence).alias("confidence"), F.lit(r.own).alias("own"))
    by_anchor = F.create_map(*[x for a in sorted({r.anchor for r in signatures}) for x in (F.lit(a), F.array(*[row(r) for r in signatures if r.anchor == a]))])
    w = F.col("words")
    rows = documents.select("doc_id", words_of(F.col("text")).alias("words"))
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(anchors))
    rows = rows.withColumn("places", F.when(F.arrays_overlap(w, F.array(*map(F.lit, anchors))), places).otherwise(F.array().cast("array<int>")))

    def base_at(i: Column) -> Column:
        at = lambda j: F.get(w, i + j)
        found = F.when((at(0) == "cc") & (at(1) == "by"), F.struct(F.lit("cc-by").alias("label"), i.alias("start")))
        found = found.when((at(0) == "license") & (i >= 2) & (at(-1) == "public") & (at(-2) == "general"), F.struct(F.lit("gpl").alias("label"), (i - 2).alias("start")))
        return found.when((at(0) == "reserved") & (i >= 2) & (at(-1) == "rights") & (at(-2) == "all"), F.struct(F.lit("reserved").alias("label"), (i - 2).alias("start")))

    def around(i: Column) -> Column:
        before = F.least(i, F.lit(before_n))
        # Expressions of identifiers go on for long; only those are looked at so far.
        long = (F.get(w, i) == "identifier") & (i >= 2) & (F.get(w, i - 2) == "spdx")
        left, right = F.array_join(F.slice(w, i - before + 1, before), " "), F.array_join(F.slice(w, i + 2, F.when(long, F.lit(LONG_AFTER)).otherwise(F.lit(after_n))), " ")
        return F.struct(i.alias("at"), F.get(w, i).alias("word"), F.when(left != "", F.concat(left, F.lit(" "))).otherwise("").alias("left"), F.when(right != "", F.concat(F.lit(" "), right)).otherwise("").alias("right"))

    def detections(c: Column) -> Column:
        own = F.coalesce(F.try_element_at(by_anchor, c["word"]), F.array().cast("array<struct<label:string,left:string,right:string,tier:int,confidence:double,own:boolean>>"))
        fits = F.filter(own, lambda r: F.rlike(c["left"], r["left"]) & F.rlike(c["right"], r["right"]))

        def one(r: Column) -> Column:
            left, right = F.call_function("regexp_extract", c["left"], r["left"], F.lit(0)), F.call_function("regexp_extract", c["right"], r["right"], F.lit(0))
            tail = F.when(r["own"], F.call_function("regexp_extract", c["right"], r["right"], F.when(r["own"], 1).otherwise(0))).otherwise("")
            end = c["at"] + 1 + _spaces(right)
            start = F.when(r["own"], end - _spaces(tail)).otherwise(c["at"] - _spaces(left))
            return F.struct(start.alias("start"), (-end).alias("minus_end"), r["tier"].alias("tier"), r["label"].alias("label"), end.alias("end"), r["confidence"].alias("confidence"), F.when(r["own"], F.ltrim(tail)).otherwise(F.concat(left, c["word"], right)).alias("matched"))

        return F.transform(fits, one)

    rows = rows.withColumn("base", F.filter(F.transform("places", base_at), lambda b: b.isNotNull())).withColumn("near", F.transform("places", around))
    kind = "array<struct<start:int,minus_end:int,tier:int,label:string,end:int,confidence:double,matched:string>>"
    rows = rows.withColumn("found", F.filter(F.transform("near", lambda c: F.array_sort(detections(c))), lambda x: F.size(x) > 0))
    # What other anchors find in the words of an expression far from its begin has the expression's labels; it stays beside them.
    far = before_n + after_n

    def alive(x: Column, k: Column) -> Column:
        """Not inside a detection of the same or better priority that comes first, by the anchors at most ``far`` words away."""
        low = F.greatest(F.lit(0), k - far)
        others = F.flatten(F.slice("found", low + 1, F.lit(2 * far + 1)))
        return ~F.exists(others, lambda y: (y < x) & (y["end"] >= x["end"]) & (y["tier"] <= x["tier"]))

    kept = F.array_sort(F.flatten(F.transform("found", lambda xs, k: F.filter(xs, lambda x: alive(x, k)))))
    kept = F.when(F.size("found") > 0, F.array_distinct(kept)).otherwise(F.array()).cast(kind)
    return rows.select("doc_id", F.size(w).cast("long").alias("n_words"), "base", kept.alias("kept"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of ``scan``'s rows."""
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    base = F.transform("base", lambda b: b["label"])
    found = F.transform("kept", lambda k: k["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda k: k["confidence"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return scanned.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"), score.alias("score"))
