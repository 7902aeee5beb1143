"""Rules on the text of a document and verdicts on the hosts that documents come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, WORDS, clean_text, written

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5


def text_measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words.

    Column expressions only. Windows of five words are compared by 64-bit hash; the windows of a text
    are sorted only if some hash occurs twice, so the usual text costs one pass. Null and empty texts
    have zeros. Columns of these names are replaced.
    """
    text = clean_text()
    stripped = F.btrim(F.col("_t"), F.lit(_SPACES))
    without = lambda chars: F.length(F.translate("_t", chars, "")).cast("long")
    with_word = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    step = docs.drop(*names).withColumn("_t", text)
    step = step.withColumns({
        "_w": F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, WORDS)),
        "word_chars": without(_SPACES),
        "n_symbols": F.length("_t").cast("long") - without(_SYMBOLS),
        "_lines": with_word,
    })
    n = F.size("_w")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW))))
    step = step.withColumns({
        "n_words": n.cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")),
    })
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_s", F.when(again, ordered))
    same = lambda e, i: (e["h"] == F.get("_s", i - 1)["h"]) | (e["h"] == F.get("_s", i + 1)["h"])
    found = F.transform("_s", lambda e, i: F.when(F.coalesce(same(e, i), F.lit(False)), e["i"]))
    step = step.withColumn("_p", F.sort_array(F.filter(found, lambda x: x.isNotNull())))
    gaps = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    repeated = F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x)
    return step.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long"))).drop("_t", "_w", "_lines", "_h", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: The rules whose failures are counted by host; the first two are those that a document itself may fail.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "letters": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 15 * n_words)",
}


def beta_priors(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """For each rule the beta prior of the hosts' failure rates by the method of moments.

    hosts: n and a column of failures for each rule, a row a host. The spread that sampling alone would
    give is taken off the hosts' spread; with none left the prior weighs as much as it may, with fewer
    than two hosts as much as the average host. Its weight is held between 2 and 1,000,000 documents.
    """
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k")]
    total = hosts.agg(*sums, *(F.sum(r).alias(f"f_{r}") for r in rules)).first()
    if not total.n:
        return dict.fromkeys(rules, (1.0, 1.0))
    means = {r: min(max(total[f"f_{r}"] / total.n, 1e-6), 1 - 1e-6) for r in rules}
    squares = hosts.agg(*(F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(means[r]), F.lit(2.0))).alias(r) for r in rules)).first()
    scale, out = total.n - total.nn / total.n, {}
    for r, mean in means.items():
        weight = total.n / total.k
        if total.k > 1 and scale > 0:
            between = (squares[r] - (total.k - 1) * mean * (1 - mean)) / scale
            weight = mean * (1 - mean) / between - 1 if between > 0 else 1e6
        weight = min(max(weight, 2.0), 1e6)
        out[r] = (mean * weight, (1 - mean) * weight)
    return out


def host_rules(docs: DataFrame, host: str = "source", most_times: float = 3.0, least_rate: float = 0.05) -> DataFrame:
    """doc_id, host, the measures, base_failed, host_rates, host_failed and kept of every document.

    The failures of each rule (RULES) are counted by host, and each rate is shrunk towards the beta
    prior of all hosts for that rule (host_rates). A host is kept out if it is sure to fail a rule far
    more often than others: its posterior mean less two posterior standard deviations is above most_times the
    prior's mean and above least_rate. A few failures of a small host decide nothing, as its posterior
    is nearly the prior; host_failed names the rules. Its documents are then not kept, nor are those that
    fail a base rule themselves. Null is a host of its own; null and empty texts count as short.
    Repeated rows count as often as they occur; doc_id may be null and of any type; other columns are
    left out. Hosts are counted in the tasks before the exchange, and the verdicts are joined back to a
    written table, so that a host with a third of all documents is split or, if the verdicts are few,
    broadcast at run time.
    """
    measured = text_measures(docs.select("doc_id", clean_text().alias("text"), F.col(host).cast("string").alias("host")))
    measured = written(measured.drop("text").withColumn("base_failed", base_failed()), "measures")
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(F.expr(c)).alias(r) for r, c in RULES.items()))
    hosts = written(hosts, "hosts")
    priors = beta_priors(hosts, list(RULES))
    rates = {r: (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)) for r, (a, b) in priors.items()}
    spreads = {r: F.sqrt(rates[r] * (1 - rates[r]) / (F.col("n") + F.lit(a + b + 1))) for r, (a, b) in priors.items()}
    beyond = {r: max(most_times * a / (a + b), least_rate) for r, (a, b) in priors.items()}
    failed = F.array_compact(F.array(*(F.when(rates[r] - 2 * spreads[r] > beyond[r], F.lit(r)) for r in rates)))
    verdicts = hosts.select(F.col("host").alias("of"), F.struct(*(rate.alias(r) for r, rate in rates.items())).alias("host_rates"), failed.alias("host_failed"))
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("host_failed") == 0))


QUALITY_SQL = r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), win AS (
        SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)
    ), dup AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1
    ), cov AS (
        SELECT doc_id, sum(least(5, coalesce(following - i, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM dup) GROUP BY doc_id
    ), ln AS (
        SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ), ll AS (
        SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ), m AS (
        SELECT d.doc_id, d.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(ll.n, 0) AS n_lines, coalesce(ln.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
        FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN ll ON ll.doc_id = d.doc_id
    ), b AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
    ), x AS (
        SELECT source, unnest(['short', 'repeats', 'symbols', 'lines', 'letters']) AS rule, unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines,
            n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 15 * n_words)]) AS failed FROM b
    ), h AS (
        SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM x GROUP BY ALL
    ), o AS (
        SELECT rule, sum(n) AS n, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS p, sum(n * n) AS nn, count(*) AS k FROM h GROUP BY rule
    ), s AS (
        SELECT o.rule, any_value(o.p) AS p, any_value(o.n) AS n, any_value(o.k) AS k, any_value(o.n - o.nn / o.n) AS scale, sum(h.n * power(h.f / h.n - o.p, 2)) AS spread FROM o JOIN h USING (rule) GROUP BY o.rule
    ), v AS (
        SELECT rule, p, CASE WHEN NOT (k > 1 AND scale > 0) THEN n / k WHEN (spread - (k - 1) * p * (1 - p)) > 0 THEN p * (1 - p) * scale / (spread - (k - 1) * p * (1 - p)) - 1 ELSE 1e6 END AS raw FROM s
    ), w AS (
        SELECT rule, p, least(greatest(raw, 2.0), 1e6) AS weight FROM v
    ), q AS (
        SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (n + weight + 1)) > greatest(3 * p, 0.05)) AS bad
        FROM (SELECT *, (f + p * weight) / (n + weight) AS rate FROM h JOIN w USING (rule)) GROUP BY source
    )
    SELECT b.doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
    FROM b JOIN q ON q.source IS NOT DISTINCT FROM b.source
"""
