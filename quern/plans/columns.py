"""Queries of columns, blocks of features, panels, validation, folds and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import features as fx
from quern.functions.parse import confidence_of, label_of
from quern.functions.residues import letter
from quern.functions.schema import feature_group, select_features
from quern.operators import clean, columns, models, panels, report, rules, select, stats, validate
from quern.plans import registry
from quern.plans.features import _AA, _CTX, _D, _DISTANCES, _PROPS, _ROWS, _SEQ, _context, _labelled, _rounded, _rows
from quern.plans.registry import query, table

# ---------------------------------------------------------------- columns


@query("SELECT p_brand, p_name, p_size, NULL::VARCHAR AS first_missing, p_type AS first_there FROM part")
def existing_columns(spark, sf_dir):
    """The wanted columns there are, in order, and the first that exists of several names."""
    p = table(spark, sf_dir, "part")
    first = columns.first_existing(p, ["kind", "p_type", "p_name"])
    return columns.existing(p.withColumns({"first_missing": columns.first_existing(p, ["a", "b"]), "first_there": first}), ["p_brand", "nothing", "p_name", "p_size", "first_missing", "first_there"])


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier")
def renamed_and_dropped(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumns({"enrich_a": F.lit(1), "enrich_b": F.lit(2)})
    s = columns.renamed(s, {"s_suppkey": "key", "s_name": "name", "absent": "x"})
    return columns.without(s, ("s_acctbal", "s_nationkey", "s_address", "s_phone", "s_comment"), ("enrich_",)).select("key", "name")


@query("SELECT c_custkey, c_acctbal, c_nationkey FROM customer")
def restored_names(spark, sf_dir):
    """Names taken away and given back."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    hidden, back = columns.anonymised(c, ["c_acctbal", "c_nationkey"])
    return columns.renamed(hidden, back)


@query("SELECT p_size::DOUBLE AS p_size, NULL::DOUBLE AS absent, p_retailprice, NULL::DOUBLE AS p_brand FROM part")
def aligned_columns(spark, sf_dir):
    return columns.aligned(table(spark, sf_dir, "part"), ["p_size", "absent", "p_retailprice", "p_brand"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'A'")
def columns_of_type(spark, sf_dir):
    """The numeric columns but for keys and dates."""
    x = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    doubles = [c for c in columns.of_type(x, T.DoubleType) if c in ("l_quantity", "l_discount")]
    whole = [c for c in columns.of_type(x) if c in ("l_orderkey", "l_linenumber", "l_partkey")]
    return x.select(*whole, *doubles)


@query("SELECT n_nationkey AS \"_id\", n_name AS alpha, NULL::DOUBLE AS beta, NULL::DOUBLE AS cadd_phred, 0 AS label FROM nation UNION ALL SELECT s_suppkey, NULL, s_acctbal, s_suppkey / 10.0, 1 FROM supplier")
def harmonised_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit(0).alias("label"), F.col("n_name").alias("alpha"), F.col("n_nationkey").cast("long").alias("_id"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") / F.lit(10.0)).alias("cadd_phred"), F.lit(1).alias("label"), F.col("s_acctbal").alias("beta"), F.col("s_suppkey").cast("long").alias("_id"))
    out = columns.harmonised([n, s], lambda c: feature_group(c) == "insilico")
    if out.columns != ["_id", "alpha", "beta", "cadd_phred", "label"]:
        raise ValueError(out.columns)
    return out


@query("SELECT c_custkey, c_name, upper(c_mktsegment) AS c_mktsegment, n_orders FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) USING (c_custkey)")
def keyed_concat(spark, sf_dir):
    """New columns beside the old by key; of clashing names the new one stays."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return columns.beside(columns.beside(c, counts, "c_custkey"), c.select("c_custkey", F.upper("c_mktsegment").alias("c_mktsegment")), "c_custkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS row_id FROM orders")
def dense_row_ids(spark, sf_dir):
    return columns.row_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", "row_id").select("o_orderkey", "row_id")


@query("""
    SELECT p_partkey::VARCHAR AS "_variant_id", p_brand AS "_gene", CASE WHEN p_partkey % 3 = 0 THEN 'gnomAD' ELSE 'ClinVar' END AS "_source",
        CASE WHEN p_partkey % 4 = 0 THEN 'p.A1V' WHEN p_partkey % 2 = 0 THEN 'x p.' || p_partkey ELSE '' END AS "_protein_change" FROM part""")
def metadata_defaults(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("x p."), k.cast("string"))).otherwise(F.lit("none"))
    p = table(spark, sf_dir, "part").select(k.alias("VariationID"), F.col("p_brand").alias("GeneSymbol"), F.when(k % 3 == 0, "gnomAD").alias("source"), F.when(k % 4 == 0, "p.A1V").alias("ProteinChange"), name.alias("Name"))
    return columns.metadata(p).select("_variant_id", "_gene", "_source", "_protein_change")


@query("SELECT p_brand, arg_min(p_name, p_partkey) FILTER (WHERE p_partkey % 5 = 0) AS note FROM part GROUP BY p_brand")
def first_notes(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("note", F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")))
    return columns.first_note(p, "note", "p_partkey", ["p_brand"])


@query("SELECT 'l_linenumber' AS \"column\" FROM range(1) WHERE 1 = 0 UNION ALL SELECT c FROM (SELECT 'l_tax' AS c, stddev_samp(l_tax) AS s FROM lineitem UNION ALL SELECT 'tiny', stddev_samp(l_discount / 1000) FROM lineitem UNION ALL SELECT 'l_quantity', stddev_samp(l_quantity) FROM lineitem) WHERE s < 0.01")
def low_spread(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("tiny", F.col("l_discount") / 1000)
    return clean.low_spread(clean.column_profile(x, ["l_tax", "tiny", "l_quantity"])).select("column")


@query("SELECT p_brand, bool_and(p_partkey % 9 <> 0) AS all_known, bool_or(p_partkey % 9 <> 0) AS any_known FROM part GROUP BY 1 UNION ALL SELECT 'none', false, false")
def all_and_any(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_partkey") % 9 != 0, 1).alias("x"))
    return validate.complete_and_known(p.union(spark.createDataFrame([("none", None)], "p_brand string, x int")), ["p_brand"], "x")


@query("SELECT o_orderpriority, median(o_totalprice) AS threshold, count(*) FILTER (WHERE o_totalprice >= m) AS n_called FROM (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders) GROUP BY 1")
def median_thresholds(spark, sf_dir):
    """The median of what is known as a group's threshold, and how many reach it."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    medians = o.groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("threshold"))
    return o.join(F.broadcast(medians), "o_orderpriority").groupBy("o_orderpriority", "threshold").agg(F.count_if(F.col("o_totalprice") >= F.col("threshold")).alias("n_called"))


@query("SELECT label, l_linestatus, count(*) FILTER (WHERE q IS NULL OR t IS NULL) AS n_dropped, count(*) FILTER (WHERE q IS NOT NULL AND t IS NOT NULL) AS n_kept FROM (SELECT (l_returnflag = 'A')::INT AS label, l_linestatus, nullif(l_quantity, 1) AS q, nullif(l_tax, 0.0) AS t FROM lineitem) GROUP BY ALL")
def incomplete_rows(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "A").cast("int").alias("label"), "l_linestatus", F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("q"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("t"))
    return validate.incomplete_report(x, ["q", "t"], ["label", "l_linestatus"])


@query("SELECT o_orderkey, 'TRAIN_G' || lpad((('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 20)::VARCHAR, 2, '0') AS fixture_group FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 800)")
def fixture_rows(spark, sf_dir):
    """A drawn group for each row, and 800 drawn rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return select.sample_up_to(o, 800, F.col("o_orderkey")).withColumn("fixture_group", select.pseudo_group(F.col("o_orderkey")))


@query("SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS fold FROM nation")
def leave_one_out(spark, sf_dir):
    return select.leave_one_out(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")


@query("SELECT o_orderkey, 'gene' AS \"_split_scheme\" FROM orders WHERE o_orderstatus = 'F'")
def split_side(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("_split_gene"))
    return columns.split_sides(o, "gene", "train").select("o_orderkey", "_split_scheme")


# ---------------------------------------------------------------- panels and labels


_TEXTS = ("Pathogenic", "Benign", "Likely pathogenic", "Conflicting interpretations of pathogenicity", "Likely benign", "Pathogenic/Benign", "Uncertain significance", "risk factor")
_SIGNIFICANCE = f"list_extract({list(_TEXTS)}, (p_partkey % {len(_TEXTS)})::INT + 1)"


def _significance():
    return F.get(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % len(_TEXTS)).cast("int"))


@query(f"""
    SELECT label, confidence, strict, count(*) AS n FROM (SELECT CASE t WHEN 'Pathogenic' THEN 1 WHEN 'Likely pathogenic' THEN 1 WHEN 'Benign' THEN 0 WHEN 'Likely benign' THEN 0 END AS label,
        CASE WHEN t IN ('Pathogenic', 'Benign') THEN 'hard' WHEN t IN ('Likely pathogenic', 'Likely benign') THEN 'likely' END AS confidence,
        CASE WHEN t IN ('Pathogenic', 'Benign') THEN 'hard_2star' WHEN t IN ('Likely pathogenic', 'Likely benign') THEN 'likely_2star' END AS strict FROM (SELECT {_SIGNIFICANCE} AS t FROM part)) GROUP BY ALL""")
def labels_of_texts(spark, sf_dir):
    t = _significance()
    return table(spark, sf_dir, "part").groupBy(label_of(t).alias("label"), confidence_of(t).alias("confidence"), confidence_of(t, "_2star").alias("strict")).agg(F.count("*").alias("n"))


_GENES = "list_extract(['BRCA1', 'PAH', 'CFTR', 'ABC1', 'ABC2', NULL], (p_partkey % 6)::INT + 1)"
_RAW = f"""raw AS (SELECT p_partkey, {_GENES} AS gene, {_SIGNIFICANCE} AS t, CASE p_partkey % 3 WHEN 0 THEN 'grch38 ' WHEN 1 THEN 'GRCh38' ELSE 'GRCh37' END AS assembly,
    CASE WHEN p_partkey % 7 = 0 THEN 'no assertion criteria provided' ELSE 'Reviewed by expert panel' END AS review FROM part),
    lab AS (SELECT p_partkey::VARCHAR AS "VariationID", gene, CASE t WHEN 'Pathogenic' THEN 1 WHEN 'Likely pathogenic' THEN 1 WHEN 'Benign' THEN 0 WHEN 'Likely benign' THEN 0 END AS label, review FROM raw WHERE assembly <> 'GRCh37')"""


def _raw(spark, sf_dir):
    k = F.col("p_partkey")
    gene = F.get(F.array(*map(F.lit, ("BRCA1", "PAH", "CFTR", "ABC1", "ABC2", None))), (k % 6).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("VariationID"), F.when(k % 3 == 0, "grch38 ").when(k % 3 == 1, "GRCh38").otherwise("GRCh37").alias("Assembly"), F.lit(" Single nucleotide variant").alias("Type"),
        F.when(k % 7 == 0, "no assertion criteria provided").otherwise("Reviewed by expert panel").alias("ReviewStatus"), _significance().alias("ClinicalSignificance"),
        F.concat(F.lit("NM_1:c."), k.cast("string"), F.lit("A>G (p.Lys"), k.cast("string"), F.lit("Glu)")).alias("Name"), gene.alias("GeneSymbol"), F.lit("1").alias("Chromosome"), k.cast("long").alias("Start"),
    )


@query(f"""WITH {_RAW} SELECT panel, label, count(*) AS n FROM (SELECT label, unnest(CASE WHEN gene = 'PAH' THEN ['pah'] WHEN gene = 'CFTR' THEN ['cftr'] WHEN gene = 'BRCA1' THEN ['cancer'] ELSE ['general'] END) AS panel
    FROM lab WHERE label IS NOT NULL AND review = 'Reviewed by expert panel') GROUP BY ALL""")
def panel_pools(spark, sf_dir):
    """Raw records to labelled ones to panels, by the panel operators."""
    rows = panels.labelled(_raw(spark, sf_dir)).persist()
    out = None
    for name in ("general", "cancer", "pah", "cftr"):
        part = panels.panel(rows, name)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("panel", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {_RAW}, base AS (SELECT * FROM lab WHERE label = 1 OR (label = 0 AND p_mod = 0)), more AS (SELECT * FROM lab WHERE label = 0),
    n AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS b FROM base),
    added AS (SELECT m."VariationID" FROM more m WHERE gene IN (SELECT gene FROM base WHERE label = 1) AND "VariationID" NOT IN (SELECT "VariationID" FROM base) ORDER BY md5('42|' || "VariationID"), "VariationID" LIMIT (SELECT CASE WHEN b < p THEN p - b + 5 ELSE 0 END FROM n))
    SELECT "VariationID" FROM base UNION ALL SELECT "VariationID" FROM added""".replace("'Reviewed by expert panel' END AS review FROM part)", "'Reviewed by expert panel' END AS review FROM part)").replace("label, review FROM raw", "label, review, p_partkey % 5 AS p_mod FROM raw"))
def supplemented_panel(spark, sf_dir):
    """Negatives of the positives' genes up to the deficit and five, where negatives are fewer."""
    rows = panels.labelled(_raw(spark, sf_dir), reviewed=None)
    base = rows.where((F.col("label") == 1) | (F.col("VariationID").cast("long") % 5 == 0))
    return panels.supplemented(base, rows, extra=5).select("VariationID")


@query(f"""WITH {_RAW}, strict AS (SELECT * FROM lab WHERE label IS NOT NULL AND review = 'Reviewed by expert panel' AND gene = 'PAH'),
    any_star AS (SELECT * FROM lab WHERE label = 0 AND gene = 'PAH' AND "VariationID" NOT IN (SELECT "VariationID" FROM strict))
    SELECT "VariationID" FROM strict UNION ALL SELECT "VariationID" FROM any_star WHERE (SELECT count(*) FROM strict) < 0.5 * 100000""")
def any_star_panel(spark, sf_dir):
    """A single gene's pool that is less than half its target takes negatives of any review level."""
    raw = _raw(spark, sf_dir)
    strict = panels.panel(panels.labelled(raw), "pah")
    return panels.with_any_star(strict, raw, "pah", 100_000).select("VariationID")


# ---------------------------------------------------------------- feature blocks


def _prefixed(sql: str) -> str:
    return f"(SELECT * RENAME (enrich_doc_id AS doc_id) FROM (SELECT COLUMNS('(.*)') AS 'enrich_\\1' FROM ({sql})))"


_PIECES = ["substitution_features", "substitution_flags", "codon_features", "neighbour_features", "ctx_features", "structure_features"]


@query(f"SELECT a.* FROM {_prefixed(registry.SQL['substitution_features'])} a".replace("SELECT a.*", "SELECT *") + "".join(f" JOIN {_prefixed(registry.SQL[p])} {p}_ USING (doc_id)" for p in _PIECES[1:]))
def enriched(spark, sf_dir):
    """All 149 enrichment columns in one projection."""
    rows = fx.enrich(_context(spark, sf_dir))
    return _rounded(rows.select("doc_id", *(c for c in rows.columns if c.startswith("enrich_"))))


_PURINES = "(({0} IN ('A', 'G') AND {1} IN ('A', 'G')) OR ({0} IN ('C', 'T') AND {1} IN ('C', 'T')))".format("ref_nuc", "alt_nuc")


@query(
    f"WITH {_ROWS} SELECT doc_id, ref_nuc, alt_nuc, ref_aa, alt_aa, "
    + ", ".join(f"({s}_nuc = '{x}')::INT AS {s}_nuc_{x}" for s in ("ref", "alt") for x in "ACGT") + ", " + ", ".join(f"({s}_aa = '{x}')::INT AS {s}_aa_{x}" for s in ("ref", "alt") for x in _AA)
    + f", {_PURINES}::INT AS is_transition, 1 - {_PURINES}::INT AS is_transversion, (ref_nuc = 'C' AND alt_nuc = 'T')::INT AS is_ct_transition, CASE WHEN aa_position > 0 THEN aa_position::DOUBLE END AS aa_position, CASE WHEN aa_position > 0 THEN round(ln(1 + aa_position), 6) END AS aa_position_log FROM r"
)
def sequence_block(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _rounded(r.select("doc_id", *(v.alias(k) for k, v in fx.sequence_block(*(F.col(c) for c in ("ref_nuc", "alt_nuc", "ref_aa", "alt_aa", "aa_position"))).items())))


_BASE_AT = "CASE WHEN pos > 0 AND {0} BETWEEN 1 AND length(seq) THEN substr(seq, {0}, 1) ELSE 'N' END"
_BASES = {n: _BASE_AT.format(f"((pos - 1) * 3 + {o} + {1 if o < 0 else 3})") for n, o in zip(fx.NEIGHBOURS, [*range(-5, 0), *range(1, 6)])}


@query(f"WITH {_SEQ}, {_CTX} SELECT doc_id, " + ", ".join(f"max((i = {k} AND aa = '{x}')::INT) AS aa_ctx_{n}_{x}" for k, n in enumerate(fx.NEIGHBOURS) for x in _AA) + " FROM c GROUP BY doc_id")
def residue_one_hots(spark, sf_dir):
    """Ten neighbours by twenty residues."""
    return _context(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in fx.context_one_hots(F.col("context"), _AA, "aa").items()))


def _with_bases(spark, sf_dir):
    bases = F.transform(fx.window(F.col("letters"), F.col("aa_position"), pad="N", step=3), lambda x: x)
    residues = F.transform(fx.window(F.col("letters"), F.col("aa_position")), letter)
    return _rows(spark, sf_dir).withColumns({"context": residues, "bases": bases}).drop("letters")


@query(
    f"WITH {_SEQ}, n AS (SELECT doc_id, " + ", ".join(f"({b} = '{x}')::INT AS nuc_ctx_{n}_{x}" for n, b in _BASES.items() for x in "ACGT")
    + f" FROM s), a AS ({registry.SQL['neighbour_features']}), b AS ({registry.SQL['ctx_features']}) SELECT * FROM n JOIN (SELECT * RENAME (aa_doc_id AS doc_id) FROM (SELECT COLUMNS('(.*)') AS 'aa_\\1' FROM a)) USING (doc_id) JOIN b USING (doc_id)"
)
def context_block(spark, sf_dir):
    """Nucleotides around as 10 x 4 one-hots, residues as 10 x 7 properties, four summaries."""
    return _rounded(_with_bases(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in fx.context_block(F.col("context"), F.col("bases")).items())))


_SIX = ("is_conservative", "is_charge_reversal", "gains_charge", "loses_charge", "hydro_to_polar", "polar_to_hydro")


@query(f"SELECT * FROM ({registry.SQL['substitution_features']}) JOIN (SELECT doc_id, {', '.join(_SIX)} FROM ({registry.SQL['substitution_flags']})) USING (doc_id)")
def biochemical_block(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _rounded(r.select("doc_id", *(v.alias(k) for k, v in fx.biochemical_block(F.col("ref_aa"), F.col("alt_aa")).items())))


def _scores(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    known = lambda c, v: F.when(c, v)
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", known(q > 5, q / F.lit(10.0)).alias("phylop_score"), (F.col("l_tax") * F.lit(100.0)).cast("string").alias("gerp_score"), known(k > 1, F.lit(0.5)).alias("pli"),
        F.lit("n/a").alias("loeuf"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("gnomad_af_global"), F.col("l_tax").alias("gnomad_af_nfe"), known(q > 25, q).alias("cadd_phred"), known(k == 2, F.col("l_discount")).alias("sift_score"), F.col("l_tax").alias("am_pathogenicity"),
    )


_SCORES = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 5 THEN l_quantity / 10.0 END AS phylop_score, l_tax * 100.0 AS gerp_score, CASE WHEN l_linenumber > 1 THEN 0.5 END AS pli,
    coalesce(l_discount, 0) AS af, l_tax AS nfe, CASE WHEN l_quantity > 25 THEN l_quantity END AS cadd, CASE WHEN l_linenumber = 2 THEN l_discount END AS sift, l_tax AS am FROM lineitem WHERE l_returnflag = 'R')"""
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"WITH {_SCORES} SELECT {_KEY}, phylop_score, NULL::DOUBLE AS phastcons_score, round(gerp_score, 6) AS gerp_score, pli, NULL::DOUBLE AS loeuf, NULL::DOUBLE AS mis_z FROM x")
def conservation_block(spark, sf_dir):
    x = _scores(spark, sf_dir)
    return _rounded(x.select(*_KEY.split(", "), *(v.alias(k) for k, v in fx.conservation_block(x).items())))


@query(f"""WITH {_SCORES} SELECT {_KEY}, af AS maf_global, round(log10(af + 1e-6), 6) AS maf_log10, (af < 0.0001)::INT AS maf_is_rare, (af < 0.000001)::INT AS maf_is_very_rare, (af > 0.01)::INT AS maf_is_common,
    NULL::DOUBLE AS maf_afr, NULL::DOUBLE AS maf_amr, NULL::DOUBLE AS maf_eas, NULL::DOUBLE AS maf_fin, nfe AS maf_nfe, NULL::DOUBLE AS maf_sas FROM x""")
def population_block(spark, sf_dir):
    x = _scores(spark, sf_dir)
    return _rounded(x.select(*_KEY.split(", "), *(v.alias(k) for k, v in fx.population_block(x).items())))


@query(f"""WITH {_SCORES}, y AS (SELECT *, list_filter([cadd, sift, am], lambda v: v IS NOT NULL) AS a FROM x)
    SELECT {_KEY}, NULL::DOUBLE AS cadd_raw, cadd AS cadd_phred, NULL::DOUBLE AS revel_score, NULL::DOUBLE AS polyphen2_hdiv, NULL::DOUBLE AS polyphen2_hvar, sift AS sift_score, am AS alphamissense,
    round(list_avg(a), 6) AS silico_mean, CASE WHEN len(a) > 1 THEN round(list_var_pop(a), 6) END AS silico_variance, len(a)::INT AS silico_n_tools FROM y""")
def tool_block(spark, sf_dir):
    x = _scores(spark, sf_dir)
    return _rounded(x.select(*_KEY.split(", "), *(v.alias(k) for k, v in fx.tool_block(x).items())))


# ---------------------------------------------------------------- rules over a table's own columns


_FULL = f"""WITH {_PROPS}, {_DISTANCES}, {_ROWS}, v AS (SELECT doc_id, ref_aa, alt_aa, (doc_id % 13) / 200.0 AS af, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 7) / 1000.0 END AS afr, (doc_id % 5) / 1000.0 AS nfe, (doc_id % 11) / 3.0 AS ph,
        CASE WHEN doc_id % 4 = 0 THEN (doc_id % 9) / 3.0 END AS gerp, (doc_id % 10) / 9.0 AS pli, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 60)::DOUBLE END AS cadd, (doc_id % 17) / 16.0 AS sift FROM r),
    q AS (SELECT v.*, greatest(afr, nfe) AS pop, greatest(ph, gerp) AS cons, list_avg(list_filter([CASE WHEN cadd IS NOT NULL THEN least(cadd / 40.0, 1.0) END, 1 - sift], lambda z: z IS NOT NULL)) AS sil, CASE WHEN ref_aa = alt_aa THEN 0.0 ELSE coalesce(d, 100.0) END AS dist, x.charge AS c1, y.charge AS c2, x.polar AS p1, y.polar AS p2
        FROM v JOIN props x ON x.aa = ref_aa JOIN props y ON y.aa = alt_aa LEFT JOIN dist ON pair = ref_aa || alt_aa),
    f AS (SELECT doc_id, CASE WHEN af > 0.05 THEN ['BA1'] ELSE list_filter([CASE WHEN af > 0.01 THEN 'BS1' END, CASE WHEN pop > 0.005 THEN 'BS2' END, CASE WHEN sil > 0.7 THEN 'PP3' END, CASE WHEN sil < 0.3 THEN 'BP4' END,
        CASE WHEN cons > 2.5 THEN 'CONS_HIGH' END, CASE WHEN pli > 0.9 THEN 'GENE_INTOL' END, CASE WHEN dist > 150 THEN 'RADICAL_SUB' END, CASE WHEN c1 * c2 < 0 THEN 'CHARGE_REV' END,
        CASE WHEN dist < 30 AND c1 = c2 AND p1 = p2 AND ref_aa <> 'X' AND alt_aa <> 'X' THEN 'CONSERV_SUB' END], lambda z: z IS NOT NULL) END AS a FROM q)
    SELECT doc_id, len(a)::INT AS n_fired, coalesce(array_to_string(a, ','), '') AS rules FROM f"""


@query(_FULL)
def full_rule_scores(spark, sf_dir):
    """The rules over the table's own columns: maxima of populations and conservation, tools turned the same way."""
    k = F.col("doc_id")
    rows = _rows(spark, sf_dir).withColumns({
        "maf_global": (k % 13) / F.lit(200.0), "maf_afr": F.when(k % 2 == 0, (k % 7) / F.lit(1000.0)), "maf_nfe": (k % 5) / F.lit(1000.0), "phylop_score": (k % 11) / F.lit(3.0),
        "gerp_score": F.when(k % 4 == 0, (k % 9) / F.lit(3.0)), "pli": (k % 10) / F.lit(9.0), "cadd_phred": F.when(k % 3 > 0, (k % 60).cast("double")), "sift_score": (k % 17) / F.lit(16.0),
    })
    return rules.evidence(rows, rules.column_rules(rows, "full")).select("doc_id", "n_fired", "rules")


# ---------------------------------------------------------------- evaluation and reports


_FOLDS = f"WITH {_D}, f AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM d)"
_LONG = "u AS (SELECT fold, y, 's' AS learner, s AS v FROM f UNION ALL SELECT fold, y, 't', t FROM f), r AS (SELECT fold, learner, y, rank() OVER (PARTITION BY fold, learner ORDER BY v) + (count(*) OVER (PARTITION BY fold, learner, v) - 1) / 2.0 AS r FROM u), a AS (SELECT fold, learner, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY ALL)"


@query(f"{_FOLDS}, {_LONG} SELECT learner, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS spread, count(auc) AS n_folds FROM a GROUP BY learner")
def fold_summary(spark, sf_dir):
    """AUC of each learner in each fold, their mean and population standard deviation."""
    folds = select.stratified_folds(_labelled(spark, sf_dir), "y", F.col("doc_id"))
    return _rounded(report.fold_summary(models.fold_aucs(folds, "y", ["s", "t"]), by=["learner"]))


@query(f"""WITH {_D}, g AS (SELECT i, round(0.05 + 0.01 * i, 2)::DOUBLE AS threshold FROM range(91) t(i)),
    e AS (SELECT i, threshold, sum((s >= threshold AND y = 1)::INT) / sum(y) AS sens, sum((s < threshold AND y = 0)::INT) / (count(*) - sum(y)) AS spec FROM g, d GROUP BY ALL),
    h AS (SELECT (SELECT threshold FROM e ORDER BY round(sens + spec - 1, 9) DESC, i LIMIT 1) AS a, (SELECT coalesce(max(threshold) FILTER (WHERE sens >= 0.9), 0.05) FROM e) AS b)
    SELECT doc_id, (s >= a)::INT AS pred_youden, (s >= b)::INT AS pred_sens90 FROM d, h""")
def two_calls(spark, sf_dir):
    """Binary calls at the best threshold and at the highest with enough sensitivity."""
    d = _labelled(spark, sf_dir)
    first, high = stats.youden_threshold(d, "y", "s").first().threshold, stats.sensitivity_threshold(d, "y", "s").first().threshold
    return models.binary_calls(d, "s", F.lit(first), F.lit(high)).select("doc_id", "pred_youden", "pred_sens90")


@query("""SELECT feature_group, round(sum(importance), 6) AS importance FROM (SELECT list_extract(['pli', 'cadd_phred', 'maf_afr', 'delta_mw', 'new_one'], (p_partkey % 5)::INT + 1) AS feature, p_size::DOUBLE AS importance FROM part)
    JOIN (VALUES ('pli', 'gene_constraint'), ('cadd_phred', 'insilico'), ('maf_afr', 'population'), ('delta_mw', 'biochemical'), ('new_one', 'other')) g(feature, feature_group) USING (feature) GROUP BY 1""")
def importances_by_group(spark, sf_dir):
    names = ["pli", "cadd_phred", "maf_afr", "delta_mw", "new_one"]
    feature = F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 5).cast("int"))
    importances = table(spark, sf_dir, "part").select(feature.alias("feature"), F.col("p_size").cast("double").alias("importance"))
    groups = spark.createDataFrame([(n, feature_group(n)) for n in names], "feature string, feature_group string")
    return _rounded(report.group_importances(importances, groups))


@query("""WITH a AS (SELECT o_orderpriority AS panel, avg(o_totalprice) AS auc, stddev_samp(o_totalprice) / sqrt(count(*)) * 1.96 AS h FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    b AS (SELECT o_orderpriority AS panel, avg(o_totalprice) AS auc FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT panel, round(auc, 4) AS auc, round(h, 4) AS half, 'core' AS feature_set FROM a UNION ALL SELECT panel, round(auc, 4), NULL, 'full' FROM b""")
def stacked_tables(spark, sf_dir):
    """Tables of several cells under one another: the ablation and comparison tables."""
    o = table(spark, sf_dir, "orders")
    of = lambda s, *more: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("panel")).agg(F.round(F.avg("o_totalprice"), 4).alias("auc"), *more)
    half = F.round(F.stddev_samp("o_totalprice") / F.sqrt(F.count("*")) * 1.96, 4).alias("half")
    return report.stacked_tables({"core": of("F", half), "full": of("O")}, "feature_set")


_BY_LANG = registry.SQL["delong_p"].replace("FROM documents JOIN labels USING (doc_id)", "FROM documents JOIN labels USING (doc_id) WHERE lang = '{0}'")


@query("WITH n AS (SELECT lang AS panel, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT n.panel, n.n, auc_a AS auc_full, auc_b AS auc_core, delta, z, p FROM n JOIN (" + " UNION ALL ".join(f"SELECT '{g}' AS panel, * FROM ({_BY_LANG.format(g)})" for g in ("de", "en", "fr")) + ") USING (panel) WHERE z IS NOT NULL")
def circularity(spark, sf_dir):
    """Type 1: the paired test of two feature sets' scores on the same rows of each panel."""
    d = _labelled(spark, sf_dir).where(F.col("lang").isin("de", "en", "fr")).withColumnRenamed("lang", "panel")
    full, core = (d.select("panel", "doc_id", "y", F.col(s).alias("p")) for s in ("s", "t"))
    return _rounded(report.circularity(d.select("panel").distinct(), full, core))


@query("SELECT 'coverage' AS \"check\", 'enrich_log' AS subject, round(avg((p_size > 5)::INT), 6) AS value FROM part UNION ALL SELECT 'empty', 'enrich_none', 1.0 UNION ALL SELECT 'lost', 'p_brand', 1.0")
def enrichment_report(spark, sf_dir):
    """A lost column, a column without a value, and the coverage of the rest."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    after = p.drop("p_brand").withColumns({"enrich_log": F.when(F.col("p_size") > 5, F.log("p_size")), "enrich_none": F.lit(None).cast("double")})
    return _rounded(validate.enrichment_report(p, after))


_SEEN = ["_gene", "label", "cadd_phred", "ref_aa", "delta_mw", "is_radical", "maf_afr", "pli", "gerp_rs", "aa_ctx_up1", "track_c_logit"]


@query(f"""SELECT feature_group, count(*) AS n, sum(k)::BIGINT AS n_rows FROM (SELECT list_extract({_SEEN}, (p_partkey % {len(_SEEN)})::INT + 1) AS name, count(*) AS k FROM part GROUP BY 1)
    JOIN (VALUES ('ref_aa', 'sequence'), ('delta_mw', 'biochemical'), ('is_radical', 'biochemical'), ('maf_afr', 'population'), ('pli', 'gene_constraint'), ('gerp_rs', 'conservation')) t(name, feature_group) USING (name) GROUP BY 1""")
def checked_features(spark, sf_dir):
    """The features that core may see of those named in a table's rows, checked, by group."""
    named = table(spark, sf_dir, "part").groupBy(F.get(F.array(*map(F.lit, _SEEN)), (F.col("p_partkey") % len(_SEEN)).cast("int")).alias("name")).agg(F.count("*").alias("k"))
    names = sorted(r.name for r in named.select("name").collect())  # names of columns
    chosen = validate.check_features(select_features(names, "core"), "core")
    groups = spark.createDataFrame([(c, feature_group(c)) for c in chosen], "name string, feature_group string")
    return named.join(groups, "name").groupBy("feature_group").agg(F.count("*").alias("n"), F.sum("k").alias("n_rows"))
