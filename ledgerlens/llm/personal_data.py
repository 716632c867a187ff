"""Personal data in whole texts, by labelers that vote and an estimate of how far each can be trusted.

Base spans follow fixed patterns and checks and always stay. Wider patterns give more candidates (written-out addresses,
other separators, numbers without a plus sign). Regular expressions, short lists and the words before a span vote on
every candidate; expectation-maximisation over the vote patterns estimates how reliable each labeler is for each kind, and
a logistic span classifier is trained on its soft labels. Everything is DataFrame expressions; positions are code points.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# The base patterns, written so that a failing start is not tried again inside the same run and nothing recurses: long
# runs take linear time and the matches stay the leftmost ones.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"[\[({<] ?(?i:at) ?[\])}>]", r"[\[({<] ?(?:\.|(?i:dot)) ?[\])}>]"
WIDER = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?: ?(?:@|{_AT}) ?{_HOST}++(?:(?:\.| ?{_DOT} ?){_HOST}++)++"
             rf"| (?i:at) {_HOST}++(?: (?i:dot) {_HOST}++)++)",
    "ip": rf"(?<![0-9A-Fa-f:.])(?:[0-9]{{1,5}}(?:(?:\.| ?{_DOT} ?)[0-9]{{1,5}}){{3}}"
          r"|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9]{1,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])",
}
# What a text must hold to be searched at all.
NEEDS = {"email": r"@|[\[({< ](?i:at)[\])}> ]", "ip": r"[0-9][.:\[( ]", "card": "[0-9][ ./_-]{0,2}[0-9]", "phone": "[0-9]"}
CONTEXT = 40  # characters before a span, up to the match before it, in which words are looked for
# Fixed lists: top-level domains, calling codes of countries, first digits of card issuers, words before a span.
DOMAINS = ("com net org edu gov mil int info biz name pro io co me tv de fr es uk it nl be at ch pl pt se no dk fi ie "
           "cz hu ro gr ru ua tr us ca mx br ar cl pe au nz jp kr cn tw hk sg in id th vn za eg ng ke il ae sa eu").split()
CALLING = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[058][0-9]|9[679][0-9])"
ISSUERS = "^(?:4|5[0-8]|2[2-7]|3[0-9]|6)"
CUES = {
    "email": "mail|contact|kontakt|write|reply|courriel|correo",
    "ip": r"\bip|host|server|client|gateway|adresse|address|direcci",
    "card": "card|visa|amex|karte|carte|tarjeta|credit|kredit",
    "phone": "phone|tel|call|mobil|fax|cell|handy|ruf|appel|llam|whatsapp",
}
COUNTER_CUES = r"version|\bv$|isbn|issn|order|invoice|serial|chapter|section|figure|price|bestell|rechnung|factur|token|hash|passw"
LABELERS = ("form", "checks", "listed", "cue", "edges")
FEATURES = 9  # beyond the votes
THRESHOLD = 0.5


def luhn(digits: Column) -> Column:
    """Whether the digits pass the checksum of card numbers."""
    back = F.reverse(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def raw_matches(docs: DataFrame) -> DataFrame:
    """One row for each match of each pattern, and one without a kind for each document; ``row`` names the document.

    A match has its number, the length of the text since the match before, the end of that text, and the next character.
    """
    patterns = [(k, wider, p) for wider, table in ((False, BASE), (True, WIDER)) for k, p in table.items()]
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"),
                        F.monotonically_increasing_id().alias("row"))
    needed = [F.col("text").rlike(NEEDS[k]) for k, _, _ in patterns]
    parts = texts.select(
        "row", "doc_id",
        *[F.when(need, F.split("text", p, -1)).alias(f"parts_{at}") for at, (need, (_, _, p)) in enumerate(zip(needed, patterns))],
        *[F.when(need, F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"hits_{at}")
          for at, (need, (_, _, p)) in enumerate(zip(needed, patterns))])

    def matches(at: int, kind: str, wider: bool) -> Column:
        part = F.col(f"parts_{at}")  # used more than once, so it stays a column and is not split anew for each match
        return F.transform(f"hits_{at}", lambda hit, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(wider).alias("wider"), i.alias("i"),
            F.char_length(F.get(part, i)).alias("gap"), F.right(F.get(part, i), F.lit(CONTEXT)).alias("left"),
            hit.alias("hit"), F.left(F.get(part, i + 1), F.lit(1)).alias("next")))

    document = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (
        ("kind", "int"), ("wider", "boolean"), ("i", "int"), ("gap", "int"), ("left", "string"), ("hit", "string"),
        ("next", "string"))])
    every = F.concat(F.array(document), *[
        F.coalesce(matches(at, k, wider), F.array()) for at, (k, wider, _) in enumerate(patterns)])
    return parts.select("row", "doc_id", F.explode(every).alias("m")).select("row", "doc_id", "m.*")


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")


def by_kind(**columns: Column) -> Column:
    out = F.lit(None)
    for k, c in columns.items():
        out = F.when(F.col("kind") == KINDS.index(k), c).otherwise(out)
    return out


def labelled(found: DataFrame) -> DataFrame:
    """Validity, votes (-1, 0 or 1) and features of each match; its text is dropped."""
    hit, digits, n = F.col("hit"), F.col("digits"), F.length("digits")
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    dotted = hit.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$")
    digit_runs = F.regexp_extract_all("hit", F.lit("[0-9]+"), F.lit(0))
    in_range = (F.size(digit_runs) == 4) & F.forall(digit_runs, lambda d: d.rlike(f"^{byte}$"))
    passes = F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    plus = hit.startswith("+")
    rows = found.withColumn("digits", F.regexp_replace("hit", "[^0-9]", ""))
    rows = rows.withColumn("passes", passes).withColumn("valid", F.col("kind").isNotNull() & by_kind(
        email=F.lit(True), ip=dotted, card=F.col("passes"), phone=n.between(9, 15)))
    strict = ~F.col("wider") & F.col("valid")
    domain = F.lower(F.regexp_extract("hit", "([A-Za-z0-9-]+)$", 1))
    date = hit.rlike(r"^(?:[12][0-9]{3}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}|[12][0-9]{3}))$")
    colons = hit.contains(":")
    cue, counter = by_kind(**{k: F.lower("left").rlike(w) for k, w in CUES.items()}), F.lower("left").rlike(COUNTER_CUES)
    glued = F.col("left").rlike(r"[\p{L}\p{N}_=#/\\]$") | F.col("next").rlike(r"^[\p{L}\p{N}_=/\\]")
    separators = F.regexp_extract_all("hit", F.lit("[ ./_()-]+"), F.lit(0))
    votes = {
        "form": vote(strict, by_kind(
            email=~hit.contains("@"), ip=~hit.contains("."), card=~F.col("passes"), phone=~hit.startswith("0") & ~hit.startswith("("))),
        "checks": vote(
            by_kind(email=domain.rlike("^[a-z]{2,}$"), ip=in_range | colons, card=F.col("passes"), phone=n.between(9, 15) & ~date),
            by_kind(email=~domain.rlike("^[a-z]{2,}$"), ip=~in_range & ~colons, card=~F.col("passes"), phone=~n.between(7, 15) | date)),
        "listed": vote(
            by_kind(email=domain.isin(DOMAINS), ip=~hit.rlike("^0"), card=digits.rlike(ISSUERS),
                    phone=plus & digits.rlike(f"^{CALLING}") | digits.rlike(f"^00{CALLING}") | hit.rlike(r"^\(?0[1-9]")),
            by_kind(email=~domain.isin(DOMAINS), ip=hit.rlike("^0"), card=~digits.rlike(ISSUERS), phone=~plus)),
        "cue": vote(cue & ~counter, counter & ~cue),
        "edges": vote(~glued, glued),
    }
    features = [F.size(separators) > 0, F.size(F.array_distinct(separators)) == 1, hit.rlike(r"[\[({<]"), n <= 8,
                n.between(9, 11), n >= 16, *[F.col("kind") == k for k in (1, 2, 3)]]
    usable = {name: F.coalesce(v, F.lit(0)).cast("tinyint") for name, v in votes.items()}
    return rows.select(
        "row", "doc_id", "kind", "wider", "i", "gap", F.char_length("hit").alias("size"),
        F.coalesce(F.col("wider") | F.col("valid"), F.lit(False)).alias("kept"), *[v.alias(k) for k, v in usable.items()],
        F.array(*[F.coalesce(f, F.lit(False)).cast("tinyint") for f in features]).alias("features"))


def placed(found: DataFrame) -> DataFrame:
    """Base spans, and wider candidates that overlap none of them: row, kind, start, end, base, votes, features."""
    before = Window.partitionBy("row", "kind", "wider").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")
    spans = found.filter("kind is not null").withColumn("start", start.cast("long"))
    spans = spans.withColumn("end", F.col("start") + F.col("size")).withColumn("base", ~F.col("wider")).filter("kept")
    order = Window.partitionBy("row").orderBy("start", "wider", "kind")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    met = spans.withColumns({"ended": ended, "begins": begins})
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.col("end") <= F.coalesce("begins", F.col("end")))
    return met.filter(F.col("base") | free).select("row", "kind", "start", "end", "base", *LABELERS, "features")


def evidence_of(values: list[float]) -> list[Column]:
    """Log odds that each labeler's vote adds, from a flat list by kind, labeler and vote."""
    table = F.lit(values)
    return [F.get(table, F.col("kind") * 3 * len(LABELERS) + 3 * at + F.col(name).cast("int") + 1) for at, name in enumerate(LABELERS)]


def posterior(priors: list[float], evidence: list[float]) -> Column:
    odds = sum(evidence_of(evidence), F.get(F.lit(priors), F.col("kind")))
    return 1 / (1 + F.exp(-odds))


def reliabilities(patterns: DataFrame, rounds: int = 40) -> tuple[list[float], list[float]]:
    """Log prior odds by kind, and log odds by kind, labeler and vote, from vote patterns with their number ``n``.

    Labelers are taken to be independent given the truth. The first labels are majority votes, and small pseudo-counts
    keep a labeler's yes on the side of true. Each round is one aggregate over the patterns, of which there are only as
    many as votes and features can be combined, and four rows return.
    """
    size = 3 * len(LABELERS)
    priors, evidence = [0.0] * len(KINDS), [float(v) for _ in KINDS for _ in LABELERS for v in (-1, 0, 1)]
    pseudo = {1: (0.5, 1.0, 1.5), 0: (1.5, 1.0, 0.5)}
    for _ in range(rounds):
        true = F.col("n") * posterior(priors, evidence)
        sums = [F.sum(F.when(F.col(name) == v, x)).alias(f"{side}_{at}_{v + 1}")
                for at, name in enumerate(LABELERS) for v in (-1, 0, 1) for side, x in (("t", true), ("n", F.col("n")))]
        rows = patterns.groupBy("kind").agg(F.sum("n").alias("all"), F.sum(true).alias("true"), *sums).collect()
        old = priors + evidence
        for r in rows:
            a, b = r["true"], r["all"] - r["true"]
            priors[r.kind] = math.log((a + 1) / (b + 1))
            for at in range(len(LABELERS)):
                for v in range(3):
                    t = r[f"t_{at}_{v}"] or 0.0
                    f = (r[f"n_{at}_{v}"] or 0) - t
                    evidence[r.kind * size + 3 * at + v] = math.log(
                        (t + pseudo[1][v]) / (a + 3) / ((max(f, 0.0) + pseudo[0][v]) / (b + 3)))
        if max(abs(x - y) for x, y in zip(old, priors + evidence)) < 1e-6:
            break
    return priors, evidence


def inputs() -> list[Column]:
    """What the classifier sees: yes and no of each labeler, and the features."""
    votes = [(F.col(name) == v).cast("double") for name in LABELERS for v in (1, -1)]
    return votes + [F.get("features", F.lit(i)).cast("double") for i in range(FEATURES)]


def train(spans: DataFrame) -> list[float] | None:
    """Intercept and weights of the span classifier, fitted on the soft labels of all spans; None without spans."""
    patterns = stage(spans.groupBy("kind", *LABELERS, "features").agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    if patterns.isEmpty():
        return None
    p = posterior(*reliabilities(patterns))
    soft = patterns.withColumn("p", p).withColumn("x", array_to_vector(F.array(*inputs())))
    both = soft.select("x", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("s"))
    rows = stage(both.select("x", "s.*").filter("weight > 1e-6"), "soft-labels")
    model = LogisticRegression(featuresCol="x", weightCol="weight", regParam=1e-3, maxIter=50, standardization=False).fit(rows)
    if not math.isfinite(model.intercept):  # every label is alike
        return [math.copysign(30.0, model.intercept)] + [0.0] * len(inputs())
    return [float(model.intercept), *map(float, model.coefficients)]


def find_spans(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): row and doc_id of every document; row, kind (number), start, end, base, score of every span.

    Base spans always stay, whatever their score; wider candidates stay if the classifier gives them the threshold and
    may overlap each other. Texts are read once; what is stored holds places, votes and features, never the found text.
    """
    found = stage(labelled(raw_matches(docs)), "matches")
    spans = stage(placed(found), "spans")
    weights = train(spans)
    score = F.lit(None).cast("double")
    if weights:
        score = 1 / (1 + F.exp(-sum((F.lit(w) * x for w, x in zip(weights[1:], inputs())), F.lit(weights[0]))))
    scored = spans.select("row", "kind", "start", "end", "base", score.alias("score"))
    return found.filter("kind is null").select("row", "doc_id"), scored.filter(F.col("base") | (F.col("score") >= threshold))


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, number of base spans by kind, their digest, all spans as text, n_added.

    Null and empty texts have no spans (the digest is that of the empty text). Repeated rows and null ids are documents
    of their own. An empty table gives no rows. Other columns are not read.
    """
    documents, spans = find_spans(docs, threshold)
    every = documents.unionByName(spans, allowMissingColumns=True)
    span = F.struct("start", "kind", "end", "base")
    grouped = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"))

    def text(spans: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def base_count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    return grouped.select(
        "doc_id", *[base_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
