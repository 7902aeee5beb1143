"""Personal data in texts: fixed patterns, and further spans by weak supervision."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import clean_text, written
from quern.llm.spans import add_matches, count_of, digest, joined, tagged

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans. A look behind keeps a search from starting within a run that it has passed.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", [0]),
    "ip": (r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)", [0, 1, 2, 3, 4]),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", [0]),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", [0]),
}
#: Candidates for further spans, in the shapes of national ids, local phone numbers, bank accounts and handles.
CANDIDATES = {
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", [0]),
    "local_phone": (r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", [0]),
    "account": (r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])", [0]),
    "handle": (r"(?<![A-Za-z0-9._%+@-])@[A-Za-z][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_.@])", [0]),
}
#: Words that stand before personal data of a kind, and words that stand before other numbers and names.
GAZETTEER = {
    "national_id": ("ssn", "social security", "national id", "tax id", "passport"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "account": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "handle": ("twitter", "instagram", "follow", "contact", "telegram", "dm"),
}
PERSONAL = ("name", "mr", "mrs", "ms", "dr", "my", "his", "her", "their", "address", "email", "e-mail", "born", "customer", "patient")
IMPERSONAL = ("order", "invoice", "version", "isbn", "part", "serial", "sku", "issue", "ticket", "import", "param", "return", "override", "media")
LABELERS = ("shape", "gazetteer", "personal", "impersonal", "neighbour")
BEFORE = 40
NEAR = 120
_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of card numbers."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda t, i: t + term(i)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m["g0"], "[^0-9]", "")


def _octet(part: Column) -> Column:
    return F.coalesce(F.regexp_replace(part, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False))


def base_spans() -> Column:
    """Matches of BASE that hold: parts of an address at most 255, 12 to 19 digits and the checksum of a card, 9 to 15 digits of a phone."""
    ip = F.filter("ip", lambda m: _octet(m["g1"]) & _octet(m["g2"]) & _octet(m["g3"]) & _octet(m["g4"]))
    card = F.filter("card", lambda m: (F.length(_digits(m)) <= 19) & luhn(_digits(m)))
    phone = F.filter("phone", lambda m: F.length(_digits(m)).between(9, 15))
    return F.sort_array(F.concat(*(tagged(c, k, i) for i, (k, c) in enumerate(zip(KINDS, (F.col("email"), ip, card, phone))))))


def _word_before(words: tuple[str, ...]) -> Column:
    return F.lower("before").rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")


def votes() -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 personal, -1 not, 0 no opinion.

    shape: area and group numbers of a national id, exchange numbers of a phone, check digits' place and
    length of an account, no repeated letter in a handle. gazetteer: a word of its kind stands before.
    personal, impersonal: words of the context before. neighbour: a base span stands near.
    """
    digits = F.regexp_replace("g0", "[^0-9]", "")
    kind = F.col("kind")
    good = (
        F.when(kind == "national_id", ~digits.rlike("^(000|666|9)|^...00|0000$"))
        .when(kind == "local_phone", digits.rlike("^[2-9]..[2-9]"))
        .when(kind == "account", F.length(F.regexp_replace("g0", r"\x20", "")).between(15, 34) & (F.length(digits) >= 8))
        .otherwise(~F.col("g0").rlike(r"(.)\1\1"))
    )
    known = F.lit(False)
    for k, words in GAZETTEER.items():
        known = known | (kind == k) & _word_before(words)
    return {
        "shape": F.when(good, 1).otherwise(-1),
        "gazetteer": F.when(known, 1).otherwise(0),
        "personal": F.when(_word_before(PERSONAL), 1).otherwise(0),
        "impersonal": F.when(_word_before(IMPERSONAL), -1).otherwise(0),
        "neighbour": F.when(F.col("near"), 1).otherwise(0),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over vote patterns and how often they occur.

    Returns the share of personal candidates and for each labeler the chances of each vote on personal
    and on other candidates. Starts from labelers that are right somewhat more often than not; counts
    are smoothed towards that start, which keeps the two classes from changing places.
    """
    width = len(LABELERS)
    start = [{v: ((3 if v > 0 else 1 if v < 0 else 4) / 8, (1 if v > 0 else 3 if v < 0 else 4) / 8) for v in (-1, 0, 1)} for _ in range(width)]
    share, chances = 0.3, start
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        sums = [{v: [4 * start[j][v][0], 4 * start[j][v][1]] for v in (-1, 0, 1)} for j in range(width)]
        mass = 0.0
        for pattern, n in patterns:
            p, q = share, 1 - share
            for j, v in enumerate(pattern):
                p, q = p * chances[j][v][0], q * chances[j][v][1]
            p = p / (p + q)
            mass += n * p
            for j, v in enumerate(pattern):
                sums[j][v][0] += n * p
                sums[j][v][1] += n * (1 - p)
        fresh = (mass + 3) / (total + 10)
        chances = [{v: tuple(s[v][c] / sum(x[c] for x in s.values()) for c in (0, 1)) for v in s} for s in sums]
        if abs(fresh - share) < 1e-9:
            break
        share = fresh
    return share, chances


def train(rows: list[tuple[str, tuple[int, ...], int]]) -> dict[str, float]:
    """Final classifier: logistic regression on the kind and the votes, taught by the estimated chances.

    rows: kind, votes and number of candidates; their number is bounded by the kinds and votes there
    are. Gradient descent on the weighted log loss with a small ridge.
    """
    share, chances = estimate([(v, n) for _, v, n in rows])
    total = sum(n for _, _, n in rows)
    examples = []
    for kind, v, n in rows:
        p, q = share, 1 - share
        for j, x in enumerate(v):
            p, q = p * chances[j][x][0], q * chances[j][x][1]
        names = ["bias", f"kind {kind}", *(f"{name} {x}" for name, x in zip(LABELERS, v) if x)]
        examples.append((names, n / max(total, 1), p / (p + q)))
    weights: dict[str, float] = {"bias": 0.0}
    weights |= {f"kind {k}": 0.0 for k in CANDIDATES} | {f"{name} {x}": 0.0 for name, x in product(LABELERS, (-1, 1))}
    for _ in range(2000):
        slope = {k: 1e-3 * w for k, w in weights.items()}
        for names, share_, target in examples:
            error = 1 / (1 + math.exp(-sum(weights[k] for k in names))) - target
            for k in names:
                slope[k] += share_ * error
        weights = {k: w - 0.8 * slope[k] for k, w in weights.items()}
    return weights


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and found (spans as structs) of every row.

    Base spans as in base_spans: leftmost, not overlapping within a kind, a match that fails is dropped
    without another try; all stay. Candidates of further kinds outside of them get votes of the
    labelers; the counts of vote patterns, whose number is fixed, teach reliabilities and a classifier
    on the driver, and candidates with a chance of one half or more are added. Null and empty texts
    have no span. Repeated rows each keep their result; other columns are left out.
    """
    texts = docs.select("doc_id", clean_text().alias("text"))
    found = add_matches(texts, "text", {**BASE, **CANDIDATES}).withColumn("base", base_spans())

    def candidate(kind: str) -> Column:
        def one(m: Column) -> Column:
            first = F.greatest(m["start"] - BEFORE, F.lit(0))
            before = F.substring(F.col("text"), (first + 1).cast("int"), (m["start"] - first).cast("int"))
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["g0"].alias("g0"), before.alias("before"))

        return F.transform(F.col(kind), one)

    found = found.withColumn("more", F.concat(*map(candidate, CANDIDATES)))
    found = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "more"), "personal")
    spread = found.where("size(more) > 0").select("row", "base", F.explode("more").alias("m"))
    m = F.col("m")
    apart = ~F.exists("base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    near = F.exists("base", lambda s: (s["start"] < m["end"] + NEAR) & (m["start"] - NEAR < s["end"]))
    rated = spread.where(apart).select("row", "m.*", near.alias("near"))
    rated = written(rated.withColumns(votes()).select("row", "start", "end", "kind", *LABELERS), "votes")
    counted = rated.groupBy("kind", *LABELERS).count().collect()
    weights = train(sorted((r["kind"], tuple(r[x] for x in LABELERS), r["count"]) for r in counted))
    logit = F.lit(weights["bias"])
    for kind in CANDIDATES:
        logit = logit + F.when(F.col("kind") == kind, F.lit(weights[f"kind {kind}"])).otherwise(F.lit(0.0))
    for name, x in product(LABELERS, (-1, 1)):
        logit = logit + F.when(F.col(name) == x, F.lit(weights[f"{name} {x}"])).otherwise(F.lit(0.0))
    rank = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(CANDIDATES) for x in (k, len(KINDS) + i))), F.col("kind"))
    chosen = rated.where(logit >= 0).groupBy("row").agg(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end")).alias("chosen"))
    spans = found.join(chosen, "row", "left").withColumn("found", F.sort_array(F.concat("base", F.coalesce("chosen", F.array().cast(_SPANS)))))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, digest(F.col("base")).alias("base_sha256"), joined(F.col("found")).alias("spans"), "found")
