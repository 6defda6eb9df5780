"""Personal data by weak supervision (DataFrame functions only).

Candidates are the base matches (e-mail, IP address, card, phone, as their patterns and
checks say) and looser ones of further kinds. Five labelers vote on each candidate: *format*
(checksum or strict shape), *gazetteer* (names, titles, issuers, top-level domains),
*context* (a telling word shortly before), *contra* (a word of versions, orders and the like
shortly before) and *border* (glued to letters or digits). A vote is 1, 0 or -1 (abstains).

Expectation-maximisation estimates how reliable each labeler is and how often each kind is
real, from the counts of vote patterns (at most kinds x 3^5 rows, whatever the table), as
one aggregate a round. Its posteriors are the soft labels of a logistic regression over
kind, votes and shape of the span, which is the final span classifier. It decides on the
looser candidates; base spans stay whatever it says.

Positions are code points, end exclusive, by start and then by kind as listed. A looser
candidate that overlaps a base span is left out. Patterns are written without backtracking
into runs they have passed, so long texts take time in proportion to their length.

Defined results: null and empty texts have no spans; equal rows give equal results; with no
candidates at all nothing is trained; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfield.llm.common import bind, materialize, text_of
from crossfield.llm.registry import documents, register

LABELERS = ("format", "gazetteer", "context", "contra", "border")
ROUNDS = 15
THRESHOLD = 0.5
WINDOW = 40

# Frequent given names, titles, card issuers' first digits, top-level domains.
GIVEN_NAMES = (
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara",
    "Thomas", "Sarah", "Daniel", "Anna", "Peter", "Maria", "Hans", "Klaus", "Ursula", "Monika", "Stefan", "Sabine", "Andreas",
    "Pierre", "Jean", "Marie", "Claire", "Sophie", "Antoine", "Nicolas", "Carlos", "Carmen", "Antonio", "Manuel", "Lucia", "Juan",
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it")
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": r"\bip\b|address|host|login|server|adresse",
    "card": "card|visa|master|credit|karte|carte|tarjeta", "phone": "phone|call|tel|mobile|fax|anruf|appel|llam",
    "name": "name|regards|contact|author|called|signed", "local_phone": "phone|call|tel|mobile|fax",
    "national_id": "ssn|social security|national id|tax id|passport", "iban": "iban|account|konto|compte|cuenta",
    "loose_card": "card|visa|master|credit|karte|carte|tarjeta", "masked_email": "mail|contact|write|kontakt",
}
CONTRA = r"version|release|\bv\.? ?$|isbn|issn|order|invoice|serial|build|port|sha|md5|hash|\bid\b|chapter|section|\$ ?$"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: bool = False


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", True),
    Kind("name", r"(?<!\p{L})(?=\p{Lu})(?:(?:" + "|".join(TITLES) + r")\.? |(?=(?:" + "|".join(GIVEN_NAMES) + r") ))\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?"),
    Kind("local_phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"),
    Kind("masked_email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,64} ?[(\[]?(?:dot|\.)[)\]]? ?[A-Za-z]{2,10}(?![A-Za-z])"),
)
# A number that fails the card check is a candidate of a looser kind.
LOOSE_CARD = len(KINDS)
BASE = tuple(k.name for k in KINDS if k.base)
NAMES = (*[k.name for k in KINDS], "loose_card")


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern in order: (s, e, v) with code-point positions and the matched text.

    The text between matches has the same cuts in ``split``, so running lengths are positions.
    """
    def places(values: Column) -> Column:
        def ends(between: Column) -> Column:
            run = F.aggregate(
                values,
                F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("all")),
                lambda a, v: F.struct(
                    (a["i"] + 1).alias("i"), (a["at"] + F.length(F.get(between, a["i"])) + F.length(v)).alias("at"),
                    F.concat(a["all"], F.array(F.struct(
                        (a["at"] + F.length(F.get(between, a["i"]))).alias("s"),
                        (a["at"] + F.length(F.get(between, a["i"])) + F.length(v)).alias("e"), v.alias("v")))).alias("all")))
            return run["all"]
        return F.when(F.size(values) > 0, bind(F.split(text, pattern, -1), ends)).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    figures = F.transform(F.array_remove(F.split(F.reverse(digits), ""), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(figures, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a base match passes its kind's check."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        n = F.length(digits_of(value))
        return F.when((n >= 14) & (n <= 19), luhn(digits_of(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    return F.lit(True)


def plausible(kind: str, value: Column) -> Column:
    """Whether a match that failed its check, or a looser one, is worth the labelers' votes."""
    if kind == "card":
        return F.length(digits_of(value)).between(13, 19)
    return F.lit(kind != "ip" and kind != "phone")


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.when(no, F.lit(0)) if no is not None else out).otherwise(F.lit(-1))


def _votes(kind: str, value: Column, before: Column, after: Column, passed: Column) -> Column:
    never = F.lit(False)
    gazetteer = {
        "email": F.regexp_extract(value, r"\.([A-Za-z0-9-]+)$", 1).isin(*DOMAINS), "masked_email": F.regexp_extract(value, "([A-Za-z]+)$", 1).isin(*DOMAINS),
        "card": digits_of(value).rlike("^[3-6]"),
        "name": F.regexp_extract(value, r"(\p{L}+)", 1).isin(*GIVEN_NAMES), "iban": F.substring(value, 1, 2).isin("DE", "FR", "ES", "GB", "CH", "AT", "IT"),
    }.get(kind, never)
    strict = _vote(passed, ~passed) if kind in BASE else _vote(value.rlike("^(?:" + "|".join(TITLES) + r")\b")) if kind == "name" else F.lit(-1)
    near = F.lower(before)
    glued = before.rlike(r"[\p{L}0-9_/=#]$") | after.rlike(r"^[\p{L}0-9_/=#]")
    told = near.rlike(CONTEXT[kind])
    return F.array(strict, _vote(gazetteer), _vote(told, F.lit(kind not in BASE) & ~told), F.when(near.rlike(CONTRA), F.lit(0)).otherwise(F.lit(-1)),
                   F.when(glued, F.lit(0)).otherwise(F.lit(-1)))


def _shape(value: Column) -> Column:
    """Bucketed length and shares of the span."""
    digits = F.length(digits_of(value)) / F.greatest(F.length(value), F.lit(1))
    return F.array(F.least(F.floor(F.length(value) / 8), F.lit(6)).cast("int"), F.floor(digits * 4).cast("int"),
                   F.least(F.length(F.regexp_replace(value, "[^ .-]", "")), F.lit(4)))


def candidates(text: Column) -> Column:
    """All candidates of a text: (kind, s, e, base, votes, shape), by start, then kind as listed."""
    def made(k: int, kind: Kind) -> Column:
        def one(m: Column) -> Column:
            passed = valid(kind.name, m["v"]) if kind.base else F.lit(False)
            before = F.substring(text, F.greatest(m["s"] + 1 - WINDOW, F.lit(1)), F.least(m["s"], F.lit(WINDOW)))
            after = F.substring(text, m["e"] + 1, F.lit(1))
            return F.struct(
                (F.when(passed, F.lit(k)).otherwise(F.lit(LOOSE_CARD)) if kind.name == "card" else F.lit(k)).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), passed.alias("base"),
                _votes(kind.name, m["v"], before, after, passed).alias("votes"), _shape(m["v"]).alias("shape"))
        found = F.filter(located(text, kind.pattern), lambda m: plausible(kind.name, m["v"]) | (valid(kind.name, m["v"]) if kind.base else F.lit(False)))
        return F.transform(found, one)

    def apart(every: Column) -> Column:
        base = F.filter(every, lambda c: c["base"])
        return bind(base, lambda b: F.filter(every, lambda c: c["base"] | ~F.exists(b, lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"]))))

    joined = F.concat(*[made(k, kind) for k, kind in enumerate(KINDS)])
    order = bind(joined, lambda a: F.transform(F.array_sort(F.transform(a, lambda c: F.struct(c["s"].alias("o"), c["kind"].alias("k"), c.alias("c")))), lambda x: x["c"]))
    return bind(order, apart)


def _posterior(prior: dict[int, float], rates: list[tuple[float, float, float, float]]) -> Column:
    """P(real | votes): prior by kind, and per labeler P(1|real), P(0|real), P(1|not), P(0|not)."""
    import math

    odds = F.lit(0.0)
    for k, p in prior.items():
        odds = F.when(F.col("kind") == k, F.lit(math.log(p / (1 - p)))).otherwise(odds)
    for j, (yes1, no1, yes0, no0) in enumerate(rates):
        vote = F.col("votes")[j]
        odds = odds + F.when(vote == 1, F.lit(math.log(yes1 / yes0))).when(vote == 0, F.lit(math.log(no1 / no0))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Column:
    """Expectation-maximisation over (kind, votes, n) rows: the posterior as an expression."""
    # To begin with, the format labeler decides where it votes, else the mean vote.
    cast = F.filter("votes", lambda v: v >= 0)
    mean = F.when(F.size(cast) > 0, F.aggregate(cast, F.lit(0.0), lambda a, v: a + v) / F.size(cast)).otherwise(F.lit(0.5))
    posterior = F.when(F.col("votes")[0] >= 0, F.col("votes")[0].cast("double")).otherwise(mean)
    for _ in range(rounds):
        weighed = patterns.withColumn("p", posterior * F.col("n")).withColumn("q", F.col("n") - F.col("p"))
        sums = [F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0.0)).alias(f"{c}{k}") for k in range(len(NAMES)) for c in "pq"]
        for j in range(len(LABELERS)):
            sums += [F.sum(F.when(F.col("votes")[j] == v, F.col(c)).otherwise(0.0)).alias(f"v{j}{v}{c}") for v in (1, 0) for c in "pq"]
        row = weighed.agg(*sums).first()
        # One imagined case of each kind keeps every estimate off 0 and 1.
        prior = {k: (row[f"p{k}"] + 0.5) / (row[f"p{k}"] + row[f"q{k}"] + 1) for k in range(len(NAMES))}
        p, q = (sum(row[f"{c}{k}"] for k in range(len(NAMES))) for c in "pq")
        rates = [tuple((row[f"v{j}{v}{c}"] + 0.5) / (total + 1.5) for c, total in (("p", p), ("q", q)) for v in (1, 0)) for j in range(len(LABELERS))]
        posterior = _posterior(prior, rates)
    return posterior


def _features(kind: Column, votes: Column, shape: Column) -> list[Column]:
    return [*[(kind == k).cast("double") for k in range(len(NAMES))],
            *[F.when(votes[j] >= 0, votes[j] * 2.0 - 1.0).otherwise(0.0) for j in range(len(LABELERS))],
            *[shape[j].cast("double") for j in range(3)]]


def train(patterns: DataFrame) -> list[float] | None:
    """Weights of the span classifier (bias last), fitted on soft labels; None without candidates."""
    if patterns.isEmpty():
        return None
    soft = patterns.withColumn("p", estimate(patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n"))))
    features = array_to_vector(F.array(*_features(F.col("kind"), F.col("votes"), F.col("shape")))).alias("features")
    rows = soft.select(features, F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")).union(
        soft.select(features, F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))
    model = LogisticRegression(weightCol="weight", maxIter=50, regParam=1e-3).fit(rows.filter("weight > 0"))
    return [*[float(w) for w in model.coefficients], float(model.intercept)]


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, found): spans (kind, start, end, base) of each text."""
    rows = materialize(df.select(F.col(doc_id).alias("doc_id"), bind(text_of(text), candidates).alias("all")), "pii-candidates")
    patterns = materialize(rows.select(F.explode("all").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
    weights = train(patterns)

    def real(c: Column) -> Column:
        if weights is None:
            return c["base"]
        score = F.lit(weights[-1])
        for w, f in zip(weights, _features(c["kind"], c["votes"], c["shape"])):
            score = score + f * w
        return c["base"] | (1 / (1 + F.exp(-score)) >= threshold)

    names = F.array(*[F.lit(n) for n in NAMES])
    spans = F.transform(F.filter("all", real), lambda c: F.struct(
        F.get(names, c["kind"]).alias("kind"), c["s"].cast("long").alias("start"), c["e"].cast("long").alias("end"), c["base"].alias("base")))
    return rows.select("doc_id", spans.alias("found"))


def number_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op4_pii")
def op4_pii(spark, sf_dir):
    found = F.col("found")
    base = F.filter(found, lambda s: s["base"])
    return find(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", *[number_of(found, k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(found).alias("spans"))
