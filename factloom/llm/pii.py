"""Personal data by weak supervision, with DataFrame and SQL functions only.

Candidates are the spans of four strict patterns (email, ip, card, phone), which always count,
and of looser ones (numbers without a country code, spelled-out addresses, social-security
numbers, names after a title, card-like numbers that fail the checksum).  Three labelers vote
yes, no or nothing on every candidate:

* shape: the strict form, or a failed check;
* gazetteer: known top-level domains, issuer prefixes, number-plan and address ranges, names,
  all of which are parameters (``Gazetteers``);
* context: cue words in the 40 characters before (as far as they lie behind the pattern's last
  match), or words that announce other numbers.

Votes and forms are counted in one grouping (at most kinds * 54 * 2**FORMS rows reach the
driver), where expectation-maximisation estimates from the votes how reliable each labeler is;
its posteriors train a logistic span classifier over kind, votes and what no labeler looks at:
the span's form and place (``FORMS``: after a mark, at a line's start, a cue behind it, cut into
groups, long).  It is applied as a SQL expression.  A loose candidate that it accepts, and that
overlaps no strict span, is added.

Offsets are found without Python: a pattern splits a text into the pieces between its matches,
and a running sum over piece and match lengths gives each start, by chunks of CHUNK matches so
that arrays are not copied once a match.  Patterns are written with possessive runs and
look-behinds so that no text costs more than linear time.

Defined results: null or empty text has no spans; every input row gives one row, repeated rows
included; nothing is learned from an empty table and every loose candidate is then refused.
``redact`` keeps all columns, null text and empty text as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone", "ssn", "name")

#: kind, pattern, cheap test that a text must pass first.
STRICT = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
)
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,12}+)", lambda t: t.rlike(r"[(\[]at[)\]]")),
    ("phone", r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z])", lambda t: t.rlike(r"[0-9]{3}[-.\x20][0-9]{4}")),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]")),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}+(?:\x20[A-Z][a-z]{1,30}+)?", lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]")),
)


@dataclass(frozen=True)
class Gazetteers:
    """What the second labeler looks up; all of it may be given."""

    #: Top-level domains besides those of two letters, which are countries.
    tlds: tuple[str, ...] = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "cloud", "online", "shop", "site", "tech", "xyz", "email", "blog", "agency", "studio", "world", "life")
    names: tuple[str, ...] = (
        "Adam", "Alan", "Albert", "Alejandro", "Alexander", "Alice", "Amanda", "Amy", "Ana", "Andrea", "Andrew", "Angela", "Anna", "Anne", "Antonio", "Barbara", "Benjamin", "Brian", "Camille", "Carlos", "Carmen", "Charles", "Charlotte",
        "Christian", "Christine", "Claire", "Claudia", "Daniel", "David", "Diego", "Dorothy", "Edward", "Elena", "Elizabeth", "Emily", "Emma", "Eric", "Eva", "Fernando", "Francisco", "Frank", "Gabriel", "George", "Hannah", "Hans", "Heinz",
        "Helen", "Helga", "Henri", "Henry", "Hugo", "Isabel", "Jack", "James", "Jane", "Javier", "Jean", "Jennifer", "Jessica", "Joan", "Johann", "John", "Jorge", "Jose", "Joseph", "Juan", "Julia", "Julie", "Karen", "Karl", "Katharina",
        "Kevin", "Klaus", "Laura", "Lena", "Linda", "Lisa", "Louis", "Lucas", "Lucia", "Luis", "Manuel", "Margaret", "Maria", "Marie", "Mark", "Marta", "Martin", "Mary", "Matthew", "Matthias", "Max", "Michael", "Michel", "Miguel", "Nancy",
        "Nicolas", "Olivia", "Otto", "Pablo", "Patricia", "Paul", "Pedro", "Peter", "Petra", "Philippe", "Pierre", "Rachel", "Rafael", "Richard", "Robert", "Rosa", "Ruth", "Sabine", "Samuel", "Sandra", "Sara", "Sarah", "Sofia", "Sophie",
        "Stefan", "Stephanie", "Stephen", "Susan", "Teresa", "Thomas", "Ursula", "Victor", "Walter", "William", "Wolfgang",
    )
    #: Patterns over the digits: card issuers, and numbers that no plan gives out.
    issuers: str = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
    not_issued: str = "^[019]"


CUES = {
    "email": "mail|contact|write|reach",
    "ip": "host|server|address|login|client",
    "card": "card|visa|master|amex|pay|credit",
    "phone": "call|phone|tel|mobile|cell|fax|contact|dial|sms",
    "ssn": "ssn|social|security|tax",
    "name": "dear|sincerely|regards|contact|signed|patient",
}
OTHER = "version|release|isbn|issn|order|invoice|item|sku|serial|ratio|score|page|chapter|section"
CONTEXT = 40
CHUNK = 64
NO_ERROR = 0.02
#: What the classifier sees besides kind and votes, one bit each in this order.
FORMS = ("marked", "line", "after", "grouped", "long")


def _let(value: Column, then) -> Column:  # noqa: ANN001
    """*then* of the value, which is computed once: inside a lambda an expression would be computed for each element."""
    return F.transform(F.array(value), then)[0]


def _chunks(values: Column) -> Column:
    """The array cut into arrays of CHUNK elements."""

    def cut(v: Column) -> Column:
        last = F.ceil(F.size(v) / CHUNK).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK)))

    return _let(values, cut)


def _running(starts: str, base: Column, values: Column, step) -> Column:  # noqa: ANN001
    """What *step* appends to an array of type *starts* while it moves on from *base*."""
    zero = F.struct(base.alias("at"), F.array().cast(starts).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def _hits(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit, before, after>> in code points, of all matches from left to right.

    *before* and *after* are what lies next to a match, up to the neighbouring one: taken from the
    pieces, as a substring of the whole text would be searched from its start for each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    n = F.size(found)
    one = lambda p, h: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"), h.alias("hit"))
    with_next = lambda x, p: F.struct(x["gap"].alias("gap"), x["before"].alias("before"), x["hit"].alias("hit"), F.left(p, F.lit(CONTEXT)).alias("after"))
    rows = F.zip_with(F.zip_with(F.slice(parts, F.lit(1), n), found, one), F.slice(parts, F.lit(2), n), with_next)
    return _let(_chunks(rows), _placed)


def _placed(chunks: Column) -> Column:
    """The starts and ends of matches in chunks of (gap, before, hit, after)."""
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["hit"])))
    bases = _running("array<int>", F.lit(0), totals, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.flatten(F.zip_with(chunks, bases, lambda c, base: _running("array<struct<start:int,end:int,hit:string,before:string,after:string>>", base, c, step)))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _octets(hit: Column) -> Column:
    """Parts of a dotted number with leading zeros cut; longer ones than three digits become 999."""
    cut = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.transform(cut, lambda p: F.when(F.length(p) <= 3, p).otherwise("999").cast("int"))


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": F.forall(_octets(hit), lambda p: p <= 255),
        "card": F.when(n.between(14, 19), luhn(_digits(hit))).otherwise(False),
        "phone": n.between(10, 15),
    }[kind]


def _checked(kind: str):  # noqa: ANN202
    return lambda s: _valid(kind, s["hit"])


def _strict_of(kind: str):  # noqa: ANN202
    return lambda s: s["strict"] & (s["kind"] == kind)


def _gazetteer(kind: str, hit: Column, lists: Gazetteers) -> Column:
    """1, 0 or -1 by lists and number plans."""
    d = _digits(hit)
    yes, no = {
        "email": (F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)).isin(*lists.tlds) | hit.rlike(r"\.[A-Za-z]{2}$"), F.lit(False)),
        "ip": (~hit.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9]|192\.168|169\.254)\."), hit.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\.")),
        "card": (d.rlike(lists.issuers), d.rlike(lists.not_issued)),
        "phone": (d.rlike("^1?[2-9][0-9]{2}[2-9]"), d.rlike("^(?:0|1[01])")),
        "ssn": (d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)"), d.rlike("^(?:000|666|9)")),
        "name": (F.exists(F.split(hit, r"\x20"), lambda w: w.isin(*lists.names)), F.lit(False)),
    }[kind]
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _shape(kind: str, hit: Column) -> Column:
    """The vote on a loose candidate's form: 1 if it is complete, -1 if a check fails."""
    return {
        "email": F.lit(1),
        "card": F.lit(-1),
        "phone": F.when(hit.rlike(r"^\(|^[0-9]{3}([-.])[0-9]{3}\1"), 1).otherwise(0),
        "ssn": F.lit(1),
        "name": F.when(F.size(F.split(hit, r"\x20")) > 2, 1).otherwise(0),
    }[kind]


def _form(kind: str, s: Column) -> Column:
    """The FORMS of a span as bits."""
    tests = (
        s["before"].rlike(r"[:=#]\s*$"),
        (s["start"] == 0) | s["before"].endswith("\n"),
        F.lower(s["after"]).rlike(rf"\b(?:{CUES[kind]})"),
        s["hit"].rlike(r"[0-9a-z][\x20.-][0-9A-Za-z(]"),
        F.length(s["hit"]) >= 16,
    )
    out = F.lit(0)
    for i, t in enumerate(tests):
        out = out + F.when(t, 1 << i).otherwise(0)
    return out


def _voted(kind: str, spans: Column, strict: bool, lists: Gazetteers) -> Column:
    """Spans with kind, rank, the votes of the three labelers and the form."""

    def one(s: Column) -> Column:
        before = F.lower(s["before"])
        context = F.when(before.rlike(rf"\b(?:{OTHER})"), -1).when(before.rlike(rf"\b(?:{CUES[kind]})"), 1).otherwise(0)
        shape = F.lit(1) if strict else _shape(kind, s["hit"])
        return F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            F.lit(strict).alias("strict"), shape.alias("shape"), _gazetteer(kind, s["hit"], lists).alias("gazetteer"), context.alias("context"),
            _form(kind, s).alias("form"),
        )

    return F.transform(spans, one)


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,strict:boolean,shape:int,gazetteer:int,context:int,form:int>>"


def candidates(text: Column, lists: Gazetteers = Gazetteers()) -> Column:
    """All candidate spans of a text with their votes: strict ones, then loose ones that overlap none of those."""
    none = F.array().cast(_SPAN)
    strict, loose = [], []
    for kind, pattern, test in STRICT:
        hits = _hits(text, pattern)
        strict.append(F.when(test(text), _voted(kind, F.filter(hits, _checked(kind)), True, lists).cast(_SPAN)).otherwise(none))
        if kind == "card":  # runs of card length that fail the checksum stay as loose candidates
            bad = F.filter(hits, lambda s: F.length(_digits(s["hit"])).between(14, 19) & ~_valid("card", s["hit"]))
            loose.append(F.when(test(text), _voted(kind, bad, False, lists).cast(_SPAN)).otherwise(none))
    for kind, pattern, test in LOOSE:
        loose.append(F.when(test(text), _voted(kind, _hits(text, pattern), False, lists).cast(_SPAN)).otherwise(none))

    def reach(c: Column) -> Column:
        return F.struct(F.array_min(F.transform(c, lambda b: b["start"])).alias("lo"), F.array_max(F.transform(c, lambda b: b["end"])).alias("hi"), c.alias("spans"))

    def free(s: Column, near: Column) -> Column:
        overlap = lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
        return ~F.exists(near, lambda c: F.coalesce((c["lo"] < s["end"]) & (s["start"] < c["hi"]), F.lit(False)) & F.exists(c["spans"], overlap))

    both = F.array(F.struct(F.concat(*strict).alias("base"), F.concat(*loose).alias("more")))
    some = lambda x: F.array(F.struct(x["more"].alias("more"), F.transform(_chunks(F.array_sort(x["base"])), reach).alias("near")))
    kept = lambda x: F.flatten(F.transform(some(x), lambda y: F.filter(y["more"], lambda s: free(s, y["near"]))))
    return F.transform(both, lambda x: F.when(F.size(x["more"]) == 0, x["base"]).otherwise(F.concat(x["base"], kept(x))))[0]


Counts = list[tuple[str, bool, tuple[int, int, int], int]]


def estimate(counts: Counts, rounds: int = 60) -> dict[tuple[str, bool, tuple[int, int, int]], float]:
    """Posterior that a candidate of each (kind, strict, votes) is personal data, by expectation-maximisation.

    A candidate's class decides each labeler's vote independently; every kind has its own share
    of true spans.  Strict spans are known to be true.  Labelers are taken to be better than
    chance with the weight of ten votes, which decides where a corpus says little.  A no has a
    reason (a failed check, a word that announces something else), while yeses are what any number
    of the form gets, and they come together: a no outweighs two yeses at the start, and is taken
    to be wrong of at most the share NO_ERROR of true spans.
    """
    post = {(k, s, v): 1.0 if s else 1 / (1 + math.exp(-1.5 * sum(x if x > 0 else 3 * x for x in v))) for k, s, v, _ in counts}
    for _ in range(rounds):
        seen = [[{-1: 1.0, 0: 4.0, 1: 1.0} for _ in range(3)] for _ in (0, 1)]
        for y in (0, 1):
            for j in range(3):
                seen[y][j][1 if y else -1] += 10.0
        share: dict[str, list[float]] = {}
        for k, s, v, n in counts:
            p = post[k, s, v]
            own = share.setdefault(k, [1.0, 1.0])
            for y, q in ((0, 1 - p), (1, p)):
                own[y] += 0.0 if s else q * n
                for j in range(3):
                    seen[y][j][v[j]] += q * n
        for x in seen[1]:  # a no is rarely said of a true span
            x[-1] = min(x[-1], NO_ERROR * (x[0] + x[1]) / (1 - NO_ERROR))
        total = [[sum(x.values()) for x in side] for side in seen]
        for k, s, v, _ in counts:
            logs = [math.log(share[k][y]) + sum(math.log(seen[y][j][v[j]] / total[y][j]) for j in range(3)) for y in (0, 1)]
            post[k, s, v] = 1.0 if s else 1 / (1 + math.exp(max(-40.0, min(40.0, logs[0] - logs[1]))))
    return post


FEATURES = ("bias", "shape+", "shape-", "gazetteer+", "gazetteer-", "context+", "context-", *FORMS, *KINDS)
Forms = dict[tuple[str, bool, tuple[int, int, int]], dict[int, int]]


def features(kind: str, votes: tuple[int, int, int], form: int = 0) -> list[float]:
    out = [1.0]
    for v in votes:
        out += [float(v > 0), float(v < 0)]
    return out + [float(form >> i & 1) for i in range(len(FORMS))] + [float(kind == k) for k in KINDS]


def classifier(counts: Counts, forms: Forms | None = None, steps: int = 2000) -> list[float]:
    """Weights of the logistic span classifier, trained on posteriors weighted by counts; *forms* splits a count by form."""
    w = [0.0] * len(FEATURES)
    if not counts:
        return [-1.0, *w[1:]]
    post = estimate(counts)
    rows = [(features(k, v, f), post[k, s, v], math.sqrt(m)) for k, s, v, n in counts for f, m in sorted((forms or {}).get((k, s, v), {0: n}).items())]
    mass = sum(n for _, _, n in rows)
    x = np.array([f for f, _, _ in rows])
    y, n = np.array([p for _, p, _ in rows]), np.array([m / mass for _, _, m in rows])
    out = np.zeros(len(FEATURES))
    for _ in range(steps):
        out -= 0.002 * out + x.T @ ((1 / (1 + np.exp(-np.clip(x @ out, -50, 50))) - y) * n)
    return out.tolist()


def fit(found: DataFrame) -> list[float]:
    """Classifier weights from a table with a ``found`` column of candidates."""
    one = found.select(F.explode("found").alias("s"))
    rows = one.groupBy("s.kind", "s.strict", "s.shape", "s.gazetteer", "s.context", "s.form").count().collect()  # at most kinds * 54 * 2**FORMS rows
    counts: dict[tuple, int] = {}
    forms: Forms = {}
    for r in rows:
        key = (r["kind"], r["strict"], (r["shape"], r["gazetteer"], r["context"]))
        counts[key] = counts.get(key, 0) + r["count"]
        forms.setdefault(key, {})[r["form"]] = r["count"]
    return classifier(sorted((*k, n) for k, n in counts.items()), forms)


def accepted(found: Column, weights: list[float]) -> Column:
    """Strict spans and the loose ones that the classifier accepts, sorted by start, kind and end."""
    w = dict(zip(FEATURES, weights, strict=True))

    def logit(s: Column) -> Column:
        out = F.lit(w["bias"])
        for name in ("shape", "gazetteer", "context"):
            out = out + F.when(s[name] > 0, w[f"{name}+"]).when(s[name] < 0, w[f"{name}-"]).otherwise(0.0)
        for i, name in enumerate(FORMS):
            out = out + F.when(s["form"].bitwiseAND(1 << i) != 0, w[name]).otherwise(0.0)
        for k in KINDS:
            out = out + F.when(s["kind"] == k, w[k]).otherwise(0.0)
        return out

    return F.array_sort(F.filter(found, lambda s: s["strict"] | (logit(s) >= 0)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii(spark: SparkSession, docs: DataFrame, lists: Gazetteers = Gazetteers()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of *docs* (doc_id, text)."""
    found = C.docs_of(docs).select("doc_id", candidates(F.col("text"), lists).alias("found"))
    found = C.staged(spark, found, "pii")
    weights = fit(found)
    base = F.array_sort(F.filter("found", lambda s: s["strict"]))
    counts = [F.size(F.filter("found", _strict_of(k))).cast("long").alias(f"n_{k}") for k, _, _ in STRICT]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(accepted(F.col("found"), weights)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans (sorted by start) replaced by the kind of its first, as [EMAIL].

    The text is cut before every CHUNK-th span, and each part is then redacted by itself, so that
    no string grows or is searched from its start once a span.
    """
    return _let(_chunks(spans), lambda chunks: _replaced(text, chunks))


def _replaced(text: Column, chunks: Column) -> Column:
    lows = F.transform(chunks, lambda c: F.get(c, F.lit(0))["start"])
    tops = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
    before = _running("array<int>", F.lit(0), tops, lambda acc, t: F.struct(F.greatest(acc["at"], t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    stops = F.concat(F.slice(lows, F.lit(2), F.size(lows)), F.array(F.length(text)))
    cut = F.arrays_zip(chunks.alias("spans"), lows.alias("low"), before.alias("reach"), stops.alias("stop"))

    def part(x: Column) -> Column:
        own = F.substr(text, x["low"] + 1, x["stop"] - x["low"])

        def inside(y: Column) -> Column:
            zero = F.struct(F.greatest(x["low"], x["reach"]).alias("at"), F.lit("").alias("out"))

            def step(acc: Column, s: Column) -> Column:
                gap = F.substr(y, acc["at"] - x["low"] + 1, s["start"] - acc["at"])
                out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

            tail = lambda acc: F.when(acc["at"] < x["stop"], F.substr(y, acc["at"] - x["low"] + 1, x["stop"] - acc["at"])).otherwise("")
            return F.aggregate(x["spans"], zero, step, lambda acc: F.concat(acc["out"], tail(acc)))

        return F.transform(F.array(own), inside)[0]

    return F.concat(F.left(text, F.get(lows, F.lit(0))), F.array_join(F.transform(cut, part), ""))


def redact(spark: SparkSession, docs: DataFrame, lists: Gazetteers = Gazetteers()) -> DataFrame:
    """*docs* with personal data replaced in ``text`` (null stays null); all other columns as they are.

    The rows are written once with their candidates, so that the patterns run once.
    """
    (name,) = C.fresh(docs, "found")
    rows = C.staged(spark, docs.withColumn(name, candidates(F.coalesce("text", F.lit("")), lists)), "candidates")
    weights = fit(rows.select(F.col(name).alias("found")))
    text = _let(accepted(F.col(name), weights), lambda spans: F.when(F.size(spans) > 0, redacted(F.col("text"), spans)).otherwise(F.col("text")))
    return rows.withColumn("text", text).drop(name)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(spark, C.table(spark, sf_dir, "documents"))
