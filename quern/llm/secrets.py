"""Secrets in texts, and weak candidates that complementary parts of a credential nearby confirm."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import clean_text, written
from quern.llm.spans import add_matches, count_of, digest, joined, tagged

KINDS = ("assign", "access", "hex")
#: Code points within which the parts of one credential stand.
SCOPE = 300

#: Fixed patterns. Base: see find_secrets. Weak: an access identifier, a secret or an endpoint that alone proves nothing.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", [0, 1]),
    "access": (r"AKIA[A-Z0-9]{16,}+", [0]),
    "hex": (r"[0-9a-f]{24,}+", [0]),
}
WEAK = {
    "weak_access": (r"""(?<!(?i:secret)[_-]?)(?i:access_?key(?:_?id)?|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,}+)""", [0]),
    "weak_secret": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}", [0]),
    "endpoint": (r"""(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]++|(?i:endpoint|host(?:name)?|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._:/-]{4,}+)""", [0]),
}
_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
#: What each weak part needs in its scope: all groups, one of the kinds of each. An access key alone confirms a weak
#: secret; a word like user does only with an endpoint, as names and long tokens often meet by chance.
NEEDS = {
    "weak_access": [("assign", "hex", "weak_secret")],
    "weak_secret": [("access", "weak_access"), ("access", "endpoint")],
    "endpoint": [("access", "weak_access"), ("assign", "hex", "weak_secret")],
}


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts (row, kind, start, end) with complementary parts within scope code points.

    Interval join by a sweep over a text's parts in either direction: each weak part meets, of every
    kind, the nearest part that ends before it and the nearest that begins behind it. The parts of a
    kind don't overlap, so if any of them lies apart from the weak part and within scope of it, one of
    these two does. A part that overlaps the weak part complements nothing: it may be the same value.
    No pairs of parts are made, however many a text has.
    """
    kinds, weak = [*BASE, *WEAK], F.col("kind").isin(*WEAK)

    def swept(ask: str, answer: str, order, nearest, side: str) -> DataFrame:
        event = lambda asks, place: F.struct(F.lit(asks).alias("asks"), F.col(place).alias("place"))
        events = F.when(weak, F.array(event(False, answer), event(True, ask))).otherwise(F.array(event(False, answer)))
        rows = parts.select("*", F.explode(events).alias("event")).select("*", "event.*")
        so_far = Window.partitionBy("row").orderBy(order("place"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = [nearest(F.when(~F.col("asks") & (F.col("kind") == k), F.col(answer))).over(so_far).alias(f"{side}_{k}") for k in kinds]
        return rows.select("row", "kind", "start", "end", "asks", *found).where("asks").drop("asks")

    before, behind = swept("start", "end", F.asc, F.max, "left"), swept("end", "start", F.desc, F.min, "right")
    met = before.join(behind, ["row", "kind", "start", "end"])
    there = {k: F.coalesce((F.col("start") - F.col(f"left_{k}") <= scope) | (F.col(f"right_{k}") - F.col("end") <= scope), F.lit(False)) for k in kinds}
    one_of = lambda group: reduce(or_, (there[k] for k in group))
    enough = [(F.col("kind") == kind) & reduce(and_, map(one_of, needs)) for kind, needs in NEEDS.items()]
    return met.where(reduce(or_, enough)).select("row", "kind", "start", "end")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and found (spans as structs) of every row.

    Base spans: assignments to a secret's name with a value of 6 or more characters, access keys of 20
    or more, runs of 24 or more hexadecimal digits; leftmost, not overlapping within a kind, and a
    match that fails is dropped without another try. The base spans stay; weak access identifiers,
    weak secrets and endpoints are added where linked_parts confirms them. Null and empty texts have
    no span. doc_id may be null and of any type. Repeated rows each keep their result; other columns are left out.
    """
    texts = docs.select("doc_id", clean_text().alias("text"))
    found = add_matches(texts, "text", {**BASE, **WEAK})
    long_enough = F.filter("assign", lambda m: F.length(m["g1"]) >= 6)
    base = F.sort_array(F.concat(tagged(long_enough, "assign", 0), tagged(F.col("access"), "access", 1), tagged(F.col("hex"), "hex", 2)))
    weak = F.concat(*(tagged(F.col(k), k, 3 + i) for i, k in enumerate(WEAK)))
    found = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", base.alias("base"), weak.alias("weak")), "secrets")
    several = found.where("size(weak) > 0 and size(base) + size(weak) > 1")
    parts = several.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.kind", "p.start", "p.end")
    rank = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(WEAK) for x in (k, 3 + i))), F.col("kind"))
    more = linked_parts(parts, scope).groupBy("row").agg(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end")).alias("more"))
    spans = found.join(more, "row", "left").withColumn("found", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, digest(F.col("base")).alias("base_sha256"), joined(F.col("found")).alias("spans"), "found")
