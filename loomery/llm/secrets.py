"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are, in this order and without overlap: values of a known shape (providers' prefixes, web tokens, private key blocks), values assigned to
a secret's name, and runs of letters, digits and ``+/_-`` with a digit among them. Each has features of its length, character
transitions, entropy, dictionary coverage, path (the document's source) and neighbouring words. The forest is Spark's, trained on
labelled findings: a table of reviewed ones (``labelled``), or where there is none ``evidence``, labels from what the forest does not
see: the known shape and the assignment itself (the assigned name is taken out of the neighbouring words) speak for a secret, checks that the value is something else
(check digits of card numbers, identifiers, addresses, dates, file names) against it. Both are silent on most runs; those the forest decides alone.

By definition an assigned value has six characters or more (two quotes hold any number up to the line's end), its name and the blanks around the sign any number, and a
run twelve or more with a digit somewhere in it. Texts are read whole; a run of more than ``LONGEST`` characters is cut into consecutive candidates
of that length, of which the last two share what is left, so no part of it is too short to be one.

Edge cases: null and empty texts have no findings. Repeated rows report each their own findings. Without both classes among the labelled findings the score is the share
of secrets among them. Extra columns are ignored; a null source is an empty path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHORTEST, LONGEST, AROUND = 12, 512, 48
RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
#: Shapes of providers' keys, of web tokens and of private key blocks.
SHAPED = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_\-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_\-]{30,}"
    r"|npm_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*"
)
#: What the name of a secret contains.
NAME = re.compile(r"(?i)token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth")
SIGN = re.compile(r":=|=>|[:=]")
VALUE = re.compile(r"\s*+(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"',;<>(){}]{6,}))")
#: The same at the end of the text before a value, to take the name out of the neighbouring words.
NAMED = re.compile(rf"(?i)[a-z_\-]*(?:{NAME.pattern[4:]})[a-z_\-]*[\"']?\s*(?::=|=>|[:=])?\s*[\"']?$")
#: What is plainly no secret: an identifier in groups, an address, a date or time, a file's path, a version.
OTHERWISE = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|[+0-9() .\-/]{7,}|[0-9]{4}-[0-9]{2}-[0-9]{2}[t0-9:.z+\-]*|(?:/?[\w.\-]+/)+[\w.\-]+\.[a-z]{1,5}|v?[0-9]+(?:[._\-][0-9a-z]+)+|[a-z]+[0-9]{1,4}|(?:[a-z]+[_\-/])+[a-z]*[0-9]{0,4}")
#: Words that stand near secrets, near harmless identifiers, and in paths of tests and samples.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "bearer", "credential", "login", "private")
HARMLESS_WORDS = ("commit", "sha", "md5", "hash", "checksum", "uuid", "guid", "id", "isbn", "phone", "tel", "card", "version", "build", "order", "invoice", "http", "https", "www", "example", "sample", "dummy")
PATH_WORDS = ("test", "example", "sample", "doc", "fixture", "mock", "config", "env", "deploy")
#: Common words for the dictionary's coverage of a candidate.
DICTIONARY = frozenset("about access account action address after again also always answer application array author backup base before between block board body book build button call case change check child class client close cloud code color column command comment commit common company config connect content control copy count country create data database date default delete deploy design detail device digest document domain double download drive email enable engine entry error event example export field file filter first folder form format from function general global group handle hash header height hello help home host image import index info input item java json label language last level library license line link list local login main manager message method model module month name network node number object office online open option order output package page parent password path people phone picture place plan point port post power present print private process product profile project public query question random read record region release remote report request response result return right root sample save schema school script search secret section select server service session setting simple single size source space spark stack start state static status stop store stream string style subject submit support switch symbol system table target task team template test text that their thing this thread time title token tool total track train type under unit update upload user value vector version view water week window with word work world write year".split())
FEATURES = ("length", "entropy", "digits", "uppers", "lowers", "symbols", "changes", "letter_digit", "digit_letter", "case_changes", "dictionary", "path_hint", "secret_near", "harmless_near", "hex_only")


def _class(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s"


def coverage(candidate: str) -> float:
    """Share of the candidate's characters inside dictionary words, longest first from the left."""
    low, at, covered = candidate.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(11, len(low) - at), 3, -1) if low[at : at + n] in DICTIONARY), 0)
        covered += n
        at += n or 1
    return covered / len(low)


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    n, kinds = len(candidate), [_class(c) for c in candidate]
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    share, near = Counter(kinds), set(re.findall(r"[a-z0-9]+", f"{NAMED.sub('', before)} {after}".lower()))
    changed = lambda a, b: sum(v for (x, y), v in pairs.items() if x in a and y in b) / n
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(candidate).values())
    return [
        float(n), entropy, share["d"] / n, share["u"] / n, share["l"] / n, share["s"] / n, sum(v for (x, y), v in pairs.items() if x != y) / n, changed("ul", "d"), changed("d", "ul"), changed("u", "l") + changed("l", "u"),
        coverage(candidate), float(any(w in path.lower() for w in PATH_WORDS)), float(any(w in x for w in SECRET_WORDS for x in near)), float(any(w in near for w in HARMLESS_WORDS)), float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate) is not None),
    ]


_NAME_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-")


def assigned(text: str) -> Iterator[tuple[int, int]]:
    """The values that follow a secret's name and an assignment sign. Looks back from each sign, so the work grows with the text whatever it holds."""
    done = 0
    for m in SIGN.finditer(text):
        stop = m.start()
        if stop < done:
            continue
        while stop > done and text[stop - 1].isspace():
            stop -= 1
        if stop > done and text[stop - 1] in "\"'":
            stop -= 1
        start = stop
        while start > done and text[start - 1] in _NAME_LETTERS:
            start -= 1
        if start < stop and NAME.search(text, start, stop) and (v := VALUE.match(text, m.end())):
            yield v.span(v.lastindex)
            done = v.end()


def pieces(start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Consecutive parts of at most ``LONGEST``; the last two are of equal length, give or take one."""
    while stop - start > 2 * LONGEST:
        yield start, start + LONGEST
        start += LONGEST
    if stop - start > LONGEST:
        middle = start + max((stop - start + 1) // 2, SHORTEST)
        yield start, middle
        start = middle
    yield start, stop


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the whole text's candidates, in order."""
    taken = [(*m.span(), "shaped") for m in SHAPED.finditer(text)]
    more, at = [], 0
    for a, b in assigned(text):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            more.append((a, b, "assigned"))
    taken, out, at = sorted(taken + more), [], 0
    for m in RUN.finditer(text):
        a, stop = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        i = at
        while a < stop:
            b = min(stop, taken[i][0]) if i < len(taken) else stop
            if b - a >= SHORTEST and any(map(str.isdigit, text[a:b])):
                out += [(x, y, "generic") for x, y in pieces(a, b)]
            a = taken[i][1] if i < len(taken) and b < stop else stop
            i += 1
    return sorted(taken + out)


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    twice = [int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in twice)) % 10 == 0


def evidence(candidate: str, kind: str) -> int | None:
    """1: the known shape of a secret, or assigned to a secret's name and not plainly something else; 0: plainly something else; null: open."""
    other = candidate.isdigit() or OTHERWISE.fullmatch(candidate) is not None or (re.sub("[ -]", "", candidate).isdigit() and luhn(re.sub("[ -]", "", candidate)))
    if kind == "shaped":
        return 1
    if kind == "assigned":
        return 0 if other or re.fullmatch(r"[A-Za-z]{1,11}|.*[<>{}$].*|(?:[A-Za-z]+ )+[A-Za-z]+", candidate) else 1
    return 0 if other else None


def findings(documents: DataFrame) -> DataFrame:
    """doc_id, start, stop, kind, candidate, evidence and the features, one row for each candidate."""
    rows = documents.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    of_id = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "stop", "kind", "candidate", "evidence", *FEATURES]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * len(FEATURES)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (text, path) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                text = text.as_py() or ""
                for a, b, kind in candidates(text):
                    at.append(i)
                    out.append((a, b, kind, text[a:b], evidence(text[a:b], kind), *features(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND], path.as_py())))
            columns = list(zip(*out, strict=True)) if out else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return rows.mapInArrow(find, f"doc_id {of_id}, start long, stop long, kind string, candidate string, evidence int, " + ", ".join(f"{x} double" for x in FEATURES))


def classify(found: DataFrame, label: Column, learn: Column, trees: int = 24, depth: int = 6) -> DataFrame:
    """Adds score (0 to 1) and secret (0 or 1) to ``found``; learns where ``learn`` holds and ``label`` is not null."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(found.withColumn("label", label))
    known = rows.filter(learn & F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0.0, 1.0}:
        rows = rows.withColumn("score", F.lit(sizes.get(1.0, 0) / max(1, sum(sizes.values()))))
    else:
        forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=5, subsamplingRate=0.8).fit(known.select("vector", "label"))
        rows = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return rows.withColumn("secret", (F.col("score") >= 0.5).cast("int")).drop("vector", "rawPrediction", "probability", "prediction", "label")


def scan(documents: DataFrame, labelled: DataFrame | None = None, learn: Column | None = None) -> DataFrame:
    """The findings of ``documents`` with their scores.

    ``labelled`` (candidate_sha256, secret 0 or 1) are reviewed findings; several verdicts on one count by their mean. Without it the evidence labels.
    """
    found = materialize(findings(documents))
    label = F.col("evidence").cast("double")
    if labelled is not None:
        verdicts = labelled.filter("secret is not null").groupBy("candidate_sha256").agg(F.round(F.avg("secret")).alias("reviewed"))
        found = found.withColumn("candidate_sha256", F.sha2(F.col("candidate").cast("binary"), 256)).join(verdicts, "candidate_sha256", "left").drop("candidate_sha256")
        label = F.col("reviewed").cast("double")
    return classify(found, label, F.lit(True) if learn is None else learn)


def quality(scanned: DataFrame, label: str = "evidence") -> dict[str, float]:
    """Precision and recall against ``label`` of reporting every candidate (before) and those the forest leaves (after)."""
    known = scanned.filter(F.col(label).isNotNull())
    n, yes, kept, hit = known.agg(F.count(F.lit(1)), F.sum(label), F.sum("secret"), F.sum(F.col("secret") * F.col(label))).first()
    ratio = lambda a, b: float(a or 0) / float(b) if b else 0.0
    return {"precision_before": ratio(yes, n), "recall_before": 1.0, "precision_after": ratio(hit, kept), "recall_after": ratio(hit, yes), "n": float(n)}
