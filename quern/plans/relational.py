"""Queries of the relational core: labels, parsing, duplicates, panels, splits, joins, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.nulls import known, num, row_count, row_mean, row_variance
from quern.functions.parse import is_missense, last_part
from quern.operators import clean, ordered, report, select
from quern.plans.registry import query, table


@query("""
    SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('view', 'click') THEN 0 END AS label, event_type, count(*) AS n,
        count(*) FILTER (WHERE value > 50) AS n_high
    FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def label_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    label = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type").isin("view", "click"), 0)
    return e.groupBy(label.alias("label"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))


@query("""
    SELECT p_partkey, regexp_extract(p_brand, 'Brand#(\\d)(\\d)', 1) AS maker, regexp_extract(p_brand, 'Brand#(\\d)(\\d)', 2) AS line,
        trim(string_split(p_brand, '#')[-1]) AS code, upper(left(p_name, 1)) AS initial FROM part""")
def parse_names(spark, sf_dir):
    p, brand = table(spark, sf_dir, "part"), F.col("p_brand")
    part = lambda g: F.regexp_extract(brand, r"Brand#(\d)(\d)", g)
    return p.select("p_partkey", part(1).alias("maker"), part(2).alias("line"), last_part(brand, "#").alias("code"), F.upper(F.substring("p_name", 1, 1)).alias("initial"))


@query("""
    WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'NM_1.1(G):c.' || p_partkey || 'A>G (p.Lys' || p_partkey || 'Glu)' WHEN 1 THEN 'c.' || p_partkey || 'c>t (p.Gly12Ter)'
        WHEN 2 THEN 'p.Val' || p_partkey || 'Leu' WHEN 3 THEN 'c.1del' WHEN 4 THEN NULL ELSE 'p.Arg9fs' END AS name FROM part)
    SELECT p_partkey, coalesce(nullif(upper(regexp_extract(name, '(?i)c\\.\\d+([ACGT])>([ACGT])', 1)), ''), 'N') AS ref_nuc,
        coalesce(nullif(upper(regexp_extract(name, '(?i)c\\.\\d+([ACGT])>([ACGT])', 2)), ''), 'N') AS alt_nuc,
        coalesce(contains(name, 'p.') AND NOT regexp_matches(name, '(?i)p\\..*(?:Ter|\\*|fs|del|ins|dup|Ext|Met1\\?|=)') AND regexp_matches(name, 'p\\.[A-Z][a-z]{2}\\d+[A-Z][a-z]{2}'), false) AS missense
    FROM n""")
def missense_names(spark, sf_dir):
    from quern.functions.parse import nucleotides_of

    key = F.col("p_partkey")
    text = key.cast("string")
    made = (
        F.when(key % 6 == 0, F.concat(F.lit("NM_1.1(G):c."), text, F.lit("A>G (p.Lys"), text, F.lit("Glu)")))
        .when(key % 6 == 1, F.concat(F.lit("c."), text, F.lit("c>t (p.Gly12Ter)")))
        .when(key % 6 == 2, F.concat(F.lit("p.Val"), text, F.lit("Leu")))
        .when(key % 6 == 3, F.lit("c.1del")).when(key % 6 == 5, F.lit("p.Arg9fs"))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", made.alias("name"))
    ref, alt = nucleotides_of(F.col("name"))
    return rows.select("p_partkey", ref.alias("ref_nuc"), alt.alias("alt_nuc"), is_missense(F.col("name")).alias("missense"))


@query("""
    WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'p.Lys' || p_partkey || 'Glu' WHEN 1 THEN 'p.D' || p_partkey || 'V' WHEN 2 THEN 'p.Sec' || p_partkey || 'Cys' WHEN 3 THEN 'p.?' END AS t FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'D' WHEN 2 THEN 'U' ELSE 'X' END AS ref_aa, CASE p_partkey % 5 WHEN 0 THEN 'E' WHEN 1 THEN 'V' WHEN 2 THEN 'C' ELSE 'X' END AS alt_aa,
        CASE WHEN p_partkey % 5 < 3 THEN p_partkey::INT ELSE -1 END AS aa_position FROM n""")
def protein_changes(spark, sf_dir):
    from quern.functions.parse import protein_change

    key = F.col("p_partkey")
    text = key.cast("string")
    made = F.when(key % 5 == 0, F.concat(F.lit("p.Lys"), text, F.lit("Glu"))).when(key % 5 == 1, F.concat(F.lit("p.D"), text, F.lit("V")))
    made = made.when(key % 5 == 2, F.concat(F.lit("p.Sec"), text, F.lit("Cys"))).when(key % 5 == 3, F.lit("p.?"))
    ref, alt, position = protein_change(F.col("t"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("t")).select("p_partkey", ref.alias("ref_aa"), alt.alias("alt_aa"), position.alias("aa_position"))


@query("SELECT p_type, count(*) AS n FROM part WHERE regexp_matches(lower(trim(p_type)), '(brass|tin)$') AND upper(trim(p_brand)) <> 'BRAND#11' AND p_name IS NOT NULL GROUP BY p_type")
def regex_predicate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kept = p.where(F.lower(F.trim("p_type")).rlike("(brass|tin)$") & (F.upper(F.trim("p_brand")) != "BRAND#11") & F.col("p_name").isNotNull())
    return kept.groupBy("p_type").agg(F.count("*").alias("n"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")]
    return select.keep_first(rows, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return select.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS n_rows, count(*) - count(DISTINCT md5(l_orderkey || '|' || l_linenumber)) AS n_extra FROM lineitem")
def dup_hash(spark, sf_dir):
    h = F.md5(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct(h)).alias("n_extra"))


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 15")
def top_values(spark, sf_dir):
    return select.value_counts(table(spark, sf_dir, "part"), F.col("p_type"), top=15)


@query("SELECT coalesce(nullif(l_returnflag, 'A'), 'hard') AS value, count(*) AS n FROM lineitem GROUP BY 1")
def filled_counts(spark, sf_dir):
    return select.value_counts(table(spark, sf_dir, "lineitem"), F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("A")), F.lit("hard")))


@query("""
    WITH base AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority LIKE '1%'), more AS (
        SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderpriority LIKE '2%' AND o_custkey IN (SELECT o_custkey FROM base) AND o_orderkey NOT IN (SELECT o_orderkey FROM base)
        ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500)
    SELECT o_orderkey, o_custkey, 'base' AS origin FROM base UNION ALL SELECT o_orderkey, o_custkey, 'more' AS origin FROM more""")
def benign_supplement(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.where(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey")
    other = o.where(F.col("o_orderpriority").startswith("2")).select("o_orderkey", "o_custkey")
    other = other.join(base.select("o_custkey").distinct(), "o_custkey", "left_semi").join(base, "o_orderkey", "left_anti")
    more = select.sample_up_to(other, 500, F.col("o_orderkey"))
    return base.withColumn("origin", F.lit("base")).unionByName(more.select("o_orderkey", "o_custkey").withColumn("origin", F.lit("more")))


@query("""
    SELECT CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'first' WHEN p_brand = 'Brand#55' THEN 'single' ELSE 'general' END AS panel, count(*) AS n, count(DISTINCT p_type) AS n_types
    FROM part GROUP BY 1""")
def panels(spark, sf_dir):
    panel = F.when(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"), "first").when(F.col("p_brand") == "Brand#55", "single").otherwise("general")
    return table(spark, sf_dir, "part").groupBy(panel.alias("panel")).agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("n_types"))


@query("""
    WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
    SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
    UNION ALL SELECT 'only_second', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def panel_overlap(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_partkey")
    flags = keys.agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("b"))
    sums = flags.agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("only_first"), F.sum((1 - F.col("a")) * F.col("b")).alias("only_second"), F.count("*").alias("any"))
    return sums.unpivot([], ["both", "only_first", "only_second", "any"], "part", "n")


@query("""
    SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= tr THEN 'train' WHEN rn <= te THEN 'test' ELSE 'unused' END AS side FROM (
        SELECT *, CASE WHEN n < 6000 THEN round_even(n * 4000.0 / 6000.0, 0) ELSE 4000 END AS tr, CASE WHEN n < 6000 THEN n ELSE 6000 END AS te FROM (
            SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn FROM orders))""")
def variant_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return select.variant_split(rows, "o_orderstatus", 4000, 2000, F.col("o_orderkey"))


_GROUP_SPLIT = """
    WITH g AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_p, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_b FROM orders GROUP BY o_custkey),
    t AS (SELECT floor(0.3 * least(sum(n_p), 2000) + 0.5) AS need_p, floor(0.3 * least(sum(n_b), 3000) + 0.5) AS need_b FROM g),
    w AS (SELECT o_custkey, n_p, n_b, coalesce(sum(n_p) OVER b, 0) AS prev_p, coalesce(sum(n_b) OVER b, 0) AS prev_b FROM g WINDOW b AS (ORDER BY md5('42|' || o_custkey), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT o_custkey, n_p, n_b, NOT (prev_p >= need_p AND prev_b >= need_b) AS in_test FROM w, t)"""


def _group_split(spark, sf_dir):
    return select.group_split(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F", 0.3, (2000, 3000))


@query(_GROUP_SPLIT + " SELECT o_custkey, n_p, n_b, in_test FROM s")
def group_split(spark, sf_dir):
    return _group_split(spark, sf_dir)


@query(_GROUP_SPLIT + """
    SELECT in_test, count(*) AS n_groups, sum(n_p)::BIGINT AS n_p, sum(n_b)::BIGINT AS n_b FROM s GROUP BY in_test""")
def split_summary(spark, sf_dir):
    return _group_split(spark, sf_dir).groupBy("in_test").agg(F.count("*").alias("n_groups"), F.sum("n_p").alias("n_p"), F.sum("n_b").alias("n_b"))


@query(_GROUP_SPLIT + """
    SELECT o_orderkey, CASE WHEN in_test THEN 'test' WHEN hash_place <= 5000 THEN 'train' ELSE 'unused' END AS side
    FROM (SELECT o_orderkey, in_test, row_number() OVER (PARTITION BY in_test ORDER BY md5('42|' || o_orderkey), o_orderkey) AS hash_place FROM orders JOIN s USING (o_custkey))""")
def group_split_rows(spark, sf_dir):
    groups = _group_split(spark, sf_dir).select("o_custkey", "in_test")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(groups, "o_custkey")
    placed = ordered.drawn_places(rows, ["in_test"], select.draw(42, F.col("o_orderkey")), "o_orderkey")
    return placed.select("o_orderkey", F.when(F.col("in_test"), "test").when(F.col("place") <= 5000, "train").otherwise("unused").alias("side"))


@query("""
    WITH r AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'unused' END AS variant, CASE WHEN o_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS gene FROM orders),
    u AS (SELECT 'gene' AS scheme, gene AS side, y, o_custkey FROM r UNION ALL SELECT 'variant', variant, y, o_custkey FROM r)
    SELECT scheme, side, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, count(DISTINCT o_custkey) AS n_groups FROM u GROUP BY ALL""")
def scheme_counts(spark, sf_dir):
    """Classes and groups of each side of every split scheme, in one pass over the rows."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("label"), "o_custkey", F.when(k % 3 == 0, "test").when(k % 3 == 1, "train").otherwise("unused").alias("_split_variant"),
        F.when(F.col("o_custkey") % 4 == 0, "test").otherwise("train").alias("_split_gene"),
    )
    return report.scheme_counts(rows, ["gene", "variant"], "label", "o_custkey")


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def kfold(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return select.stratified_folds(rows, "o_orderstatus", F.col("o_orderkey")).select("o_orderkey", "fold")


@query("""
    WITH g AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_p, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_b FROM orders GROUP BY 1),
    p AS (SELECT o_custkey, row_number() OVER (ORDER BY n_p DESC, n_b DESC, md5('42|' || o_custkey) DESC, o_custkey DESC) - 1 AS i FROM g)
    SELECT o_custkey, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INT AS fold FROM p""")
def group_kfold(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return select.group_folds(rows, "o_custkey", "label", 5)


@query("""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.15) AS held FROM orders""")
def stratified_hold_out(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return select.hold_out(rows, "o_orderstatus", F.col("o_orderkey")).select("o_orderkey", "held")


@query("""
    WITH g AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT ceil(0.15 * count(*)) AS k FROM g)
    SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY md5('42|' || o_custkey), o_custkey) AS rn FROM g), n WHERE rn <= k""")
def group_hold_out(spark, sf_dir):
    return select.group_hold_out(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 200")
def sample_rows(spark, sf_dir):
    return select.sample_up_to(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 200, F.col("c_custkey"), 7)


@query("""
    WITH e AS (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
    m AS (SELECT l_partkey, median(v) AS med FROM (SELECT l_partkey, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1)
    SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, round(coalesce(e.v, m.med), 4) AS price, CASE WHEN e.v IS NOT NULL THEN 'precise' WHEN m.med IS NOT NULL THEN 'coarse' ELSE 'failed' END AS method
    FROM lineitem r LEFT JOIN e USING (l_partkey, l_suppkey) LEFT JOIN m USING (l_partkey) WHERE r.l_returnflag = 'R'""")
def lookup_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    exact = rows.where(F.col("l_returnflag") == "A").select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"))
    asked = rows.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return select.with_fallback(asked, exact, ["l_partkey", "l_suppkey"], ["l_partkey"], "price").withColumn("price", F.round("price", 4))


@query("SELECT o_orderkey, n_name, r_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'")
def constraint_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    return joined.select("o_orderkey", "n_name", "r_name", "c_mktsegment")


@query("""
    SELECT a.o_orderkey, a.o_totalprice AS price_core, b.total AS price_full, round(b.total - a.o_totalprice, 2) AS difference
    FROM orders a JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey""")
def core_full_join(spark, sf_dir):
    core = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price_core"))
    full = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("price_full"))
    return core.join(full, "o_orderkey").withColumn("difference", F.round(F.col("price_full") - F.col("price_core"), 2))


@query("SELECT c.c_custkey, c.c_acctbal, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def one_to_one_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), "n_name")
    by_customer = c.select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return select.left_one_to_one(c.drop("c_nationkey"), by_customer, ["c_custkey"])


@query("""
    WITH t AS (SELECT nullif(l_quantity, 1) AS q, nullif(l_discount, 0.0) AS d, l_tax FROM lineitem WHERE l_returnflag = 'A'),
    s AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 1) AS q, nullif(l_discount, 0.0) AS d, l_tax FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F')
    SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.q IS NOT DISTINCT FROM s.q AND t.d IS NOT DISTINCT FROM s.d AND t.l_tax IS NOT DISTINCT FROM s.l_tax)""")
def test_dup_removal(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"q": F.nullif(F.col("l_quantity"), F.lit(1.0)), "d": F.nullif(F.col("l_discount"), F.lit(0.0))})
    test = rows.where((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).select("l_orderkey", "l_linenumber", "q", "d", "l_tax")
    return select.without_rows_of(test, rows.where(F.col("l_returnflag") == "A"), ["q", "d", "l_tax"])


_SIX = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey")


def _nulled(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*(F.nullif(F.col(c).cast("double"), F.lit(float(k))).alias(c) for k, c in enumerate(_SIX)), F.lit(1.5).alias("fixed"), F.lit(None).cast("double").alias("empty"), "l_returnflag")


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg((x IS NULL)::INT), 6) AS null_rate, min(x) AS least, max(x) AS most FROM (SELECT nullif({c}::DOUBLE, {k}) AS x FROM lineitem)" for k, c in enumerate(_SIX)
) + " UNION ALL SELECT 'fixed', 0.0, 1.5, 1.5 UNION ALL SELECT 'empty', 1.0, NULL, NULL"


@query(_PROFILE)
def null_rates(spark, sf_dir):
    profile = clean.column_profile(_nulled(spark, sf_dir), [*_SIX, "fixed", "empty"])
    return profile.select("column", F.round("null_rate", 6).alias("null_rate"), "least", "most")


@query("SELECT 'empty' AS \"column\" UNION ALL SELECT 'fixed'")
def degenerate_cols(spark, sf_dir):
    return clean.degenerate(clean.column_profile(_nulled(spark, sf_dir), [*_SIX, "fixed", "empty"])).select("column")


@query("SELECT * FROM (SELECT 'l_quantity' AS \"column\", min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem) WHERE (\"column\" = 'l_quantity' AND (least < 5 OR most > 40)) OR (\"column\" = 'l_tax' AND (least < 0 OR most > 1))")
def range_check(spark, sf_dir):
    profile = clean.column_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])
    return clean.out_of_range(profile, {"l_quantity": (5.0, 40.0), "l_tax": (0.0, 1.0)}).select("column", "least", "most")


@query("SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 6) AS share, abs(avg((o_orderstatus = 'F')::INT) - 0.5) > 0.10 AS unbalanced FROM orders GROUP BY 1")
def label_balance(spark, sf_dir):
    share = F.avg((F.col("o_orderstatus") == "F").cast("double"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(share, 6).alias("share"), (F.abs(share - 0.5) > 0.10).alias("unbalanced"))


@query("""
    SELECT 'missing' AS "check", 'l_comment' AS subject, 1.0 AS value UNION ALL SELECT 'extra', 'l_linestatus', 1.0 UNION ALL SELECT 'range', 'l_quantity', max(l_quantity) FROM lineitem
    UNION ALL SELECT 'duplicates', 'l_orderkey,l_linenumber', (count(*) - count(DISTINCT md5(l_orderkey || '|' || l_linenumber)))::DOUBLE FROM lineitem
    UNION ALL SELECT 'balance', 'label', round(avg((l_returnflag = 'A')::INT), 6) FROM lineitem""")
def consistency_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "A").cast("int"))
    expected = [c for c in rows.columns if c != "l_linestatus"] + ["l_comment"]
    found = clean.consistency_findings(rows, ["l_quantity", "l_tax"], "label", ["l_orderkey", "l_linenumber"], {"l_quantity": (5.0, 40.0)}, expected)
    return found.withColumn("value", F.round("value", 6))


_PAIRS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1 :]))
def corr_pairs(spark, sf_dir):
    return clean.correlations(table(spark, sf_dir, "lineitem"), list(_PAIRS)).withColumn("r", F.round("r", 6))


@query("SELECT 'l_double' AS dropped")
def corr_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_double", F.col("l_quantity") * 2 + 1)
    dropped = clean.correlated_columns(rows, ["l_quantity", "l_discount", "l_tax", "l_double"])
    return spark.createDataFrame([(c,) for c in dropped], "dropped string")


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, [nullif(l_discount, 0.0), nullif(l_tax, 0.0), nullif(l_quantity / 50.0, 1.0)] AS a FROM lineitem),
    v AS (SELECT *, list_filter(a, lambda x: x IS NOT NULL) AS b FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(list_avg(b), 6) AS mean, round(list_var_pop(b), 6) AS variance, len(b)::INT AS n, list_max(b) AS most FROM v""")
def row_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    a = [F.nullif(F.col("l_discount"), F.lit(0.0)), F.nullif(F.col("l_tax"), F.lit(0.0)), F.nullif(F.col("l_quantity") / F.lit(50.0), F.lit(1.0))]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(row_mean(*a), 6).alias("mean"), F.round(row_variance(*a), 6).alias("variance"), row_count(*a).alias("n"), F.greatest(*a).alias("most"))


@query("SELECT event_id, TRY_CAST(props->>'k' AS DOUBLE) AS k, CASE WHEN TRY_CAST(props->>'k' AS DOUBLE) IS NULL THEN 'none' ELSE 'some' END AS state FROM events")
def nested_af(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k string"))
    k = num(known(F.col("p.k")))
    return e.select("event_id", k.alias("k"), F.when(k.isNull(), "none").otherwise("some").alias("state"))


@query("SELECT vec_id, round(list_median(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS median FROM embeddings")
def list_median(spark, sf_dir):
    s = F.array_sort(F.transform("embedding", lambda x: x.cast("double")))
    n = F.size(s)
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.ceil((n + 1) / 2).cast("int"))) / F.lit(2.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(middle, 6).alias("median"))


@query("""
    SELECT source, to_json(list({'k': lang, 'n': n} ORDER BY lang)) AS sources, sum(n)::BIGINT AS total FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def json_summary(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("lang").alias("k"), "n")))
    return counts.groupBy("source").agg(F.to_json(pairs).alias("sources"), F.sum("n").alias("total"))


@query("""
    SELECT l_returnflag, coalesce(sum(n) FILTER (WHERE l_linestatus = 'F'), 0)::BIGINT AS f, coalesce(sum(n) FILTER (WHERE l_linestatus = 'O'), 0)::BIGINT AS o
    FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def pivot_counts(spark, sf_dir):
    return report.wide_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", {"F": "f", "O": "o"})


@query("""
    WITH c AS (SELECT l_returnflag || '/' || l_linestatus AS cell, avg(l_discount) AS m, stddev_samp(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT cell, format('{:.3f} ({:.3f}–{:.3f})', m, m - 1.96 * s / sqrt(n), m + 1.96 * s / sqrt(n)) AS shown FROM c""")
def formatted_intervals(spark, sf_dir):
    cell = F.concat_ws("/", "l_returnflag", "l_linestatus").alias("cell")
    c = table(spark, sf_dir, "lineitem").groupBy(cell).agg(F.avg("l_discount").alias("m"), (F.stddev_samp("l_discount") * 1.96 / F.sqrt(F.count("*"))).alias("h"))
    return c.withColumns({"lo": F.col("m") - F.col("h"), "hi": F.col("m") + F.col("h")}).select("cell", report.interval_text("m", "lo", "hi").alias("shown"))


@query("""
    WITH a AS (SELECT o_orderpriority AS panel, avg(o_totalprice) AS m, stddev_samp(o_totalprice) / sqrt(count(*)) AS e FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    b AS (SELECT o_orderpriority AS panel, avg(o_totalprice) AS m, stddev_samp(o_totalprice) / sqrt(count(*)) AS e FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT panel, round(a.m - b.m, 4) AS difference, round((a.m - 1.96 * a.e) - (b.m + 1.96 * b.e), 4) AS lo, round((a.m + 1.96 * a.e) - (b.m - 1.96 * b.e), 4) AS hi FROM a JOIN b USING (panel)""")
def type2_ci(spark, sf_dir):
    o = table(spark, sf_dir, "orders")

    def of(status):
        mean, half = F.avg("o_totalprice"), F.stddev_samp("o_totalprice") / F.sqrt(F.count("*")) * 1.96
        rows = o.where(F.col("o_orderstatus") == status).groupBy(F.col("o_orderpriority").alias("panel"))
        return rows.agg(mean.alias("auc"), (mean - half).alias("lo"), (mean + half).alias("hi"))

    found = report.independent_difference(of("F"), of("O"), "panel")
    return found.select("panel", *(F.round(c, 4).alias(c) for c in ("difference", "lo", "hi")))


@query("SELECT n_nationkey AS key, n_name AS name, 'nation' AS origin, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_suppkey, s_name, 'supplier', s_acctbal FROM supplier")
def union_by_name(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.lit("nation").alias("origin"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin"), F.col("s_acctbal").alias("balance"))
    return n.unionByName(s, allowMissingColumns=True)
