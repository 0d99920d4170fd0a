"""U4: the topic of a fact line as column expressions: heading, defined subject, leading name, first name inside.

The rules are regular expressions that read the same in Spark and SQL, so that the whole line stays in the JVM. They are an approximation by
shape: names are runs of capitalised words, and words that open a sentence without naming anything are told by a list and by their endings.
A null, empty or nameless line has no topic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

#: Closed classes of English: words that may open a sentence and name nothing.
ARTICLES = "a an the"
PRONOUNS = "i me we us you he him she they them it one nobody somebody anybody everybody nothing something anything everything mine yours ours theirs this that these those what who whom whose which whoever whatever"
POSSESSIVES = "my your his her its our their"
QUANTIFIERS = "all any both each either enough every few fewer half less little many more most much neither no none other another several some such two three"
PREPOSITIONS = "about above across after against along amid among around as at before behind below beneath beside besides between beyond by despite down during except for from in inside into like near of off on onto out outside over past per since through throughout to toward towards under underneath until up upon via with within without according because instead"
CONJUNCTIONS = "and but or nor yet so if unless although though while whereas whether when where why how once than lest"
AUXILIARIES = "am is are was were be been being have has had do does did will would shall should can could may might must ought let"
ADVERBS = "accordingly afterwards again almost also always anyway consequently earlier else even finally first furthermore hence here however indeed later meanwhile moreover never nevertheless next nonetheless not now often only otherwise perhaps rather second similarly sometimes soon still then there thereafter therefore thus today together tomorrow too twice usually very yesterday just instead maybe quite additionally various"
OPENERS = tuple(sorted(set(" ".join((ARTICLES, PRONOUNS, POSSESSIVES, QUANTIFIERS, PREPOSITIONS, CONJUNCTIONS, AUXILIARIES, ADVERBS)).split())))
#: Months are dates, not names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

NAME = r"[A-Z][A-Za-z'-]+(?: (?:of |de |van |von )?[A-Z][A-Za-z'-]+)*"
ARTICLE = r"^(?:The|A|An) "
HEADING = r"^([A-Z][A-Za-z'-]+(?: [A-Za-z'-]+){0,5}) ?(?:[(][^)]*[)])?:(?: |$)"
DEFINED = r"^([A-Za-z][A-Za-z'-]+(?: [A-Za-z][A-Za-z'-]*){0,4}?) (?:is|are|was|were) (?:a|an|the|one|any|small|large) "
LEADING = f"^({NAME})"
INSIDE = f"[a-z,;] ({NAME})"
#: What is no topic: an opener before anything, a month or a short acronym alone, a lone verb or adverb.
NO_TOPIC = f"^(?:(?i:{'|'.join(OPENERS)})(?: .*)?|(?i:{'|'.join(MONTHS)})|[A-Z]{{2,3}}|[A-Za-z]+(?:ing|ly|ed))$"


def topic(text: Column) -> Column:
    """The topic of a line, or null."""
    line = collapse(text)
    bare = F.regexp_replace(line, ARTICLE, "")
    good = lambda x: F.when((x != "") & ~F.rlike(x, F.lit(NO_TOPIC)), x)
    inside = F.filter(F.regexp_extract_all(line, F.lit(INSIDE), 1), lambda x: ~F.rlike(x, F.lit(NO_TOPIC)))
    return F.coalesce(good(F.regexp_extract(line, HEADING, 1)), *[good(F.regexp_extract(bare, p, 1)) for p in (DEFINED, LEADING)], F.get(inside, F.lit(0)))


def topic_sql(line: str) -> str:
    """The same in DuckDB's SQL, of a collapsed line."""
    quoted = {k: v.replace("'", "''") for k, v in {"heading": HEADING, "defined": DEFINED, "leading": LEADING, "inside": INSIDE, "none": NO_TOPIC}.items()}
    bare = f"regexp_replace({line}, '{ARTICLE}', '')"
    good = lambda x: f"case when {x} <> '' and not regexp_matches({x}, '{quoted['none']}') then {x} end"
    found = [good(f"regexp_extract({line}, '{quoted['heading']}', 1)"), *[good(f"regexp_extract({bare}, '{quoted[k]}', 1)") for k in ("defined", "leading")]]
    return f"coalesce({', '.join(found)}, list_filter(regexp_extract_all({line}, '{quoted['inside']}', 1), lambda x: not regexp_matches(x, '{quoted['none']}'))[1])"
