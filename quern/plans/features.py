"""Queries of the lookup features, windows, rules and evaluation statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quern.functions import features as fx
from quern.functions.residues import distance, distance_table, letter, prop, property_table
from quern.functions.schema import feature_group
from quern.operators import resample, rules, stats
from quern.plans import registry
from quern.plans.registry import query, table

_AA = "ACDEFGHIKLMNPQRSTVWY"
#: Letters for the test tables, which have no residues: hexadecimal digits of an md5 picked into an alphabet.
_VALUES = ", ".join("(" + ", ".join([f"'{k}'", *(repr(v[p]) + "::DOUBLE" for p in v)]) + ")" for k, v in property_table().items())
_COLUMNS = "aa, " + ", ".join(next(iter(property_table().values())))
_PROPS = f"props({_COLUMNS}) AS (VALUES {_VALUES})"
_DISTANCES = "dist(pair, d) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in distance_table().items()) + ")"
_PICK = f"substr('{_AA}X', (('0x' || substr(md5(doc_id || '|{{}}'), 1, 6))::BIGINT % 21 + 1)::INT, 1)"
_NUC = "substr('ACGTN', (('0x' || substr(md5(doc_id || '|{}'), 1, 6))::BIGINT % 5 + 1)::INT, 1)"
_ROWS = f"r AS (SELECT doc_id, {_PICK.format('r')} AS ref_aa, {_PICK.format('a')} AS alt_aa, {_NUC.format('n')} AS ref_nuc, {_NUC.format('m')} AS alt_nuc, (n_chars % 400)::INT AS aa_position FROM documents)"


def _pick(salt: str, alphabet: str):
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(salt))), 1, 6), 16, 10).cast("long") % len(alphabet)
    return F.substring(F.lit(alphabet), (number + 1).cast("int"), F.lit(1))


def _rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", letter(_pick("r", _AA + "X")).alias("ref_aa"), letter(_pick("a", _AA + "X")).alias("alt_aa"), _pick("n", "ACGTN").alias("ref_nuc"), _pick("m", "ACGTN").alias("alt_nuc"),
        (F.col("n_chars") % 400).cast("int").alias("aa_position"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("letters"),
    )


def _rounded(df, digits: int = 6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {_PROPS}, {_ROWS} SELECT doc_id, ref_aa, p.hydro, p.mw, p.degeneracy, round(p.rscu_mean, 6) AS rscu_mean FROM r JOIN props p ON p.aa = r.ref_aa")
def map_lookup(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _rounded(r.select("doc_id", "ref_aa", *(prop(F.col("ref_aa"), p).alias(p) for p in ("hydro", "mw", "degeneracy", "rscu_mean"))))


@query(f"WITH {_DISTANCES}, {_ROWS} SELECT doc_id, ref_aa, alt_aa, CASE WHEN ref_aa = alt_aa THEN 0.0 ELSE coalesce(d, 100.0) END AS distance FROM r LEFT JOIN dist ON pair = ref_aa || alt_aa")
def pair_distance(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", "ref_aa", "alt_aa", distance(F.col("ref_aa"), F.col("alt_aa")).alias("distance"))


_A = ", ".join(f"x.{p} AS ref_{p}, y.{p} AS alt_{p}, round(y.{p} - x.{p}, 6) AS delta_{p}, round(abs(y.{p} - x.{p}), 6) AS abs_delta_{p}" for p in fx.SEVEN)


@query(f"WITH {_PROPS}, {_DISTANCES}, {_ROWS} SELECT doc_id, {_A}, CASE WHEN ref_aa = alt_aa THEN 0.0 ELSE coalesce(d, 100.0) END AS grantham_dist FROM r JOIN props x ON x.aa = ref_aa JOIN props y ON y.aa = alt_aa LEFT JOIN dist ON pair = ref_aa || alt_aa")
def substitution_features(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _rounded(r.select("doc_id", *(v.alias(k) for k, v in fx.substitution(F.col("ref_aa"), F.col("alt_aa")).items())))


@query(f"""WITH {_PROPS}, {_DISTANCES}, {_ROWS} SELECT doc_id, (x.charge = y.charge AND x.polar = y.polar)::INT AS is_conservative,
    (CASE WHEN ref_aa = alt_aa THEN 0.0 ELSE coalesce(d, 100.0) END > 100)::INT AS is_radical, (x.charge * y.charge < 0)::INT AS is_charge_reversal,
    (x.charge = 0 AND y.charge <> 0)::INT AS gains_charge, (x.charge <> 0 AND y.charge = 0)::INT AS loses_charge, (x.hydro > 0 AND y.hydro <= 0)::INT AS hydro_to_polar,
    (x.hydro <= 0 AND y.hydro > 0)::INT AS polar_to_hydro, (x.polar = y.polar)::INT AS same_polarity_class, ((x.charge >= 0) = (y.charge >= 0))::INT AS same_charge_sign,
    (ref_nuc || alt_nuc IN ('AG', 'GA', 'CT', 'TC'))::INT AS is_transition, 1 - (ref_nuc || alt_nuc IN ('AG', 'GA', 'CT', 'TC'))::INT AS is_transversion, (ref_nuc || alt_nuc IN ('CT', 'GA'))::INT AS is_ct_transition,
    CASE WHEN aa_position > 0 THEN round(ln(1 + aa_position), 6) END AS log_position
    FROM r JOIN props x ON x.aa = ref_aa JOIN props y ON y.aa = alt_aa LEFT JOIN dist ON pair = ref_aa || alt_aa""")
def substitution_flags(spark, sf_dir):
    r = _rows(spark, sf_dir)
    blocks = fx.substitution_flags(F.col("ref_aa"), F.col("alt_aa")) | fx.transitions(F.col("ref_nuc"), F.col("alt_nuc")) | {"log_position": fx.log_position(F.col("aa_position"))}
    return _rounded(r.select("doc_id", *(v.alias(k) for k, v in blocks.items())))


@query(f"""WITH {_PROPS}, {_ROWS} SELECT doc_id, CASE WHEN aa_position > 0 THEN (aa_position - 1) % 3 + 1 ELSE 0 END AS codon_position, x.degeneracy::INT AS codon_degeneracy_ref, y.degeneracy::INT AS codon_degeneracy_alt,
    round(x.rscu_mean, 6) AS ref_mean_rscu, round(y.rscu_mean, 6) AS alt_mean_rscu, round(y.rscu_mean - x.rscu_mean, 6) AS delta_mean_rscu, round(abs(y.rscu_mean - x.rscu_mean), 6) AS abs_delta_mean_rscu,
    x.rscu_max AS ref_max_rscu, y.rscu_max AS alt_max_rscu, round(y.rscu_max - x.rscu_max, 6) AS delta_max_rscu, round(x.rscu_max - x.rscu_mean, 6) AS codon_usage_pressure
    FROM r JOIN props x ON x.aa = ref_aa JOIN props y ON y.aa = alt_aa""")
def codon_features(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _rounded(r.select("doc_id", *(v.alias(k) for k, v in fx.codon(F.col("ref_aa"), F.col("alt_aa"), F.col("aa_position")).items())))


_SEQ = "s AS (SELECT doc_id, (n_chars % 400)::INT AS pos, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)"
_AT = "CASE WHEN pos > 0 AND pos + {0} BETWEEN 1 AND length(seq) THEN substr(seq, pos + {0}, 1) ELSE 'X' END"
_OFFSETS = [*range(-5, 0), *range(1, 6)]


@query(f"WITH {_SEQ} SELECT doc_id, {' || '.join(_AT.format(o) for o in _OFFSETS)} AS residues, " + " || ".join("CASE WHEN pos > 0 AND {0} BETWEEN 1 AND length(seq) THEN substr(seq, {0}, 1) ELSE 'N' END".format(f"((pos - 1) * 3 + {o} + {1 if o < 0 else 3})") for o in _OFFSETS) + " AS bases FROM s")
def seq_window(spark, sf_dir):
    r = _rows(spark, sf_dir)
    residues, bases = fx.window(F.col("letters"), F.col("aa_position")), fx.window(F.col("letters"), F.col("aa_position"), pad="N", step=3)
    return r.select("doc_id", F.array_join(residues, "").alias("residues"), F.array_join(bases, "").alias("bases"))


@query(f"WITH {_ROWS} SELECT doc_id, " + ", ".join(f"(ref_nuc = '{x}')::INT AS ref_nuc_{x}" for x in "ACGT") + ", " + ", ".join(f"(ref_aa = '{x}')::INT AS ref_aa_{x}" for x in _AA) + " FROM r")
def onehot(spark, sf_dir):
    hot = fx.one_hot(F.col("ref_nuc"), "ACGT", "ref_nuc") | fx.one_hot(F.col("ref_aa"), _AA, "ref_aa")
    return _rows(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in hot.items()))


@query(f"WITH {_ROWS} SELECT doc_id, ref_nuc, ref_aa FROM r")
def onehot_decode(spark, sf_dir):
    hot = onehot(spark, sf_dir)
    return hot.select("doc_id", fx.one_hot_letter(hot, "ref_nuc", "ACGT", "N").alias("ref_nuc"), fx.one_hot_letter(hot, "ref_aa", _AA, "X").alias("ref_aa"))


def _context(spark, sf_dir):
    context = F.transform(fx.window(F.col("letters"), F.col("aa_position")), letter)
    return _rows(spark, sf_dir).withColumn("context", context).drop("letters")


_CTX = f"c AS (SELECT doc_id, i, CASE WHEN contains('{_AA}', ch) THEN ch ELSE 'X' END AS aa FROM (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS i, {_AT.format(o)} AS ch FROM s" for k, o in enumerate(_OFFSETS)) + "))"


@query(f"""WITH {_PROPS}, {_SEQ}, {_CTX} SELECT doc_id, round(avg(hydro), 6) AS ctx_mean_hydro, round(stddev_pop(hydro), 6) AS ctx_std_hydro, round(avg(charge), 6) AS ctx_mean_charge, round(stddev_pop(charge), 6) AS ctx_std_charge
    FROM c JOIN props USING (aa) GROUP BY doc_id""")
def ctx_features(spark, sf_dir):
    return _rounded(_context(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in fx.neighbour_summary(F.col("context")).items())))


@query(f"""WITH {_PROPS}, {_SEQ}, {_CTX}, {_ROWS}, k AS (SELECT doc_id, avg(alpha) AS a, avg(beta) AS b, avg((alpha > 1.0)::INT) AS sa, avg((beta > 1.0)::INT) AS sb FROM c JOIN props USING (aa) GROUP BY doc_id)
    SELECT doc_id, x.alpha AS ref_alpha, y.alpha AS alt_alpha, round(y.alpha - x.alpha, 6) AS delta_alpha, round(abs(y.alpha - x.alpha), 6) AS abs_delta_alpha, x.beta AS ref_beta, y.beta AS alt_beta, round(y.beta - x.beta, 6) AS delta_beta,
    round(abs(y.beta - x.beta), 6) AS abs_delta_beta, x.turn AS ref_turn, y.turn AS alt_turn, round(y.turn - x.turn, 6) AS delta_turn, x.rsa AS ref_rsa, y.rsa AS alt_rsa, round(y.rsa - x.rsa, 6) AS delta_rsa, round(abs(y.rsa - x.rsa), 6) AS abs_delta_rsa,
    (x.alpha >= 1.0 AND y.alpha < 0.7)::INT AS helix_breaker, (x.beta >= 1.0 AND y.beta < 0.6)::INT AS sheet_breaker, sign(y.rsa - x.rsa)::DOUBLE AS burial_change,
    round(a, 6) AS ctx_mean_alpha, round(sa, 6) AS ctx_share_alpha, round(b, 6) AS ctx_mean_beta, round(sb, 6) AS ctx_share_beta
    FROM r JOIN props x ON x.aa = ref_aa JOIN props y ON y.aa = alt_aa JOIN k USING (doc_id)""")
def structure_features(spark, sf_dir):
    blocks = fx.structure(F.col("ref_aa"), F.col("alt_aa"), F.col("context"))
    return _rounded(_context(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in blocks.items())))


@query(f"""WITH {_PROPS}, {_SEQ}, {_CTX} SELECT doc_id, """ + ", ".join(f"max({p}) FILTER (WHERE i = {k}) AS ctx_{n}_{p}" for k, n in enumerate(['up5', 'up4', 'up3', 'up2', 'up1', 'dn1', 'dn2', 'dn3', 'dn4', 'dn5']) for p in fx.SEVEN) + " FROM c JOIN props USING (aa) GROUP BY doc_id")
def neighbour_features(spark, sf_dir):
    return _context(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in fx.neighbours(F.col("context")).items()))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS maf_global, round(log10(l_discount + 1e-6), 6) AS maf_log10, (l_discount < 0.0001)::INT AS is_rare, (l_discount < 0.000001)::INT AS is_very_rare, (l_discount > 0.01)::INT AS is_common FROM lineitem""")
def population_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return _rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", *(v.alias(k) for k, v in fx.population(F.col("l_discount")).items())))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN l_quantity <> 1 THEN least(l_quantity, 40) / 40.0 END, 1 - nullif(l_tax, 0.0), nullif(l_discount, 0.0)], lambda x: x IS NOT NULL) AS a FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(list_avg(a), 6) AS silico_mean, round(list_var_pop(a), 6) AS silico_variance, len(a)::INT AS silico_n_tools FROM v""")
def tool_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    summary = fx.tool_summary(F.nullif(F.col("l_quantity"), F.lit(1.0)), F.nullif(F.col("l_tax"), F.lit(0.0)), F.nullif(F.col("l_discount"), F.lit(0.0)))
    return _rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", *(v.alias(k) for k, v in summary.items())))


_RULES = f"""WITH {_PROPS}, {_DISTANCES}, {_ROWS}, v AS (SELECT doc_id, ref_aa, alt_aa, (doc_id % 13) / 200.0 AS af, (doc_id % 7) / 1000.0 AS pop, (doc_id % 11) / 3.0 AS cons, (doc_id % 10) / 9.0 AS pli, (doc_id % 17) / 16.0 AS sil FROM r),
    q AS (SELECT v.*, CASE WHEN ref_aa = alt_aa THEN 0.0 ELSE coalesce(d, 100.0) END AS dist, x.charge AS c1, y.charge AS c2, x.polar AS p1, y.polar AS p2 FROM v JOIN props x ON x.aa = ref_aa JOIN props y ON y.aa = alt_aa LEFT JOIN dist ON pair = ref_aa || alt_aa),
    f AS (SELECT doc_id, CASE WHEN af > 0.05 THEN [{{'n': 'BA1', 'w': -6.0}}] ELSE list_filter([CASE WHEN af > 0.01 THEN {{'n': 'BS1', 'w': -2.0}} END, CASE WHEN pop > 0.005 THEN {{'n': 'BS2', 'w': -1.0}} END,
        CASE WHEN sil > 0.7 THEN {{'n': 'PP3', 'w': 1.0}} END, CASE WHEN sil < 0.3 THEN {{'n': 'BP4', 'w': -1.0}} END, CASE WHEN cons > 2.5 THEN {{'n': 'CONS_HIGH', 'w': 2.0}} END, CASE WHEN pli > 0.9 THEN {{'n': 'GENE_INTOL', 'w': 2.0}} END,
        CASE WHEN dist > 150 THEN {{'n': 'RADICAL_SUB', 'w': 2.0}} END, CASE WHEN c1 * c2 < 0 THEN {{'n': 'CHARGE_REV', 'w': 2.0}} END,
        CASE WHEN dist < 30 AND c1 = c2 AND p1 = p2 AND ref_aa <> 'X' AND alt_aa <> 'X' THEN {{'n': 'CONSERV_SUB', 'w': -1.0}} END], lambda x: x IS NOT NULL) END AS a FROM q),
    s AS (SELECT doc_id, coalesce(list_sum(list_transform(a, lambda x: x.w)), 0)::DOUBLE AS logit, len(a)::INT AS n_fired, coalesce(array_to_string(list_transform(a, lambda x: x.n), ','), '') AS rules FROM f)"""


def _scored(spark, sf_dir):
    d, k = _rows(spark, sf_dir), F.col("doc_id")
    table_ = rules.substitution_rules((k % 13) / F.lit(200.0), (k % 7) / F.lit(1000.0), (k % 11) / F.lit(3.0), (k % 10) / F.lit(9.0), F.col("ref_aa"), F.col("alt_aa"), [(k % 17) / F.lit(16.0)])
    return rules.evidence(d, table_)


@query(_RULES + " SELECT doc_id, logit, round(1 / (1 + exp(-logit)), 6) AS score, n_fired, rules FROM s")
def rule_scores(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir).select("doc_id", "logit", "score", "n_fired", "rules"))


@query(_RULES + " SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(rules, ',')) AS rule FROM s WHERE rules <> '') GROUP BY rule")
def rule_counts(spark, sf_dir):
    return rules.rule_counts(_scored(spark, sf_dir))


_NAMES = ["_gene", "label", "cadd_phred", "phylop_score", "pli", "maf_global", "enrich_delta_hydro", "aa_ctx_up1", "nuc_ctx_dn5_A", "ctx_mean_hydro", "delta_mw", "ref_vol", "ref_aa_A", "codon_position", "track_c_logit", "extra"]
_EXPECTED = [None, None, "insilico", "conservation", "gene_constraint", "population", "enrichment", "context", "context", "context", "biochemical", "biochemical", "sequence", "sequence", None, "other"]


@query(f"""SELECT feature_group, count(DISTINCT name) AS n, count(*) AS n_rows FROM (SELECT list_extract({_NAMES}, (p_partkey % {len(_NAMES)})::INT + 1) AS name FROM part)
    JOIN (VALUES {", ".join(f"('{n}', '{g}')" for n, g in zip(_NAMES, _EXPECTED) if g)}) t(name, feature_group) USING (name) GROUP BY 1""")
def feature_counts(spark, sf_dir):
    """Features named in a table's rows, and the rows that name them, by group."""
    named = table(spark, sf_dir, "part").select(F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int")).alias("name"))
    groups = spark.createDataFrame([(c, feature_group(c)) for c in _NAMES], "name string, feature_group string").where("feature_group is not null")
    return named.join(groups, "name").groupBy("feature_group").agg(F.count_distinct("name").alias("n"), F.count("*").alias("n_rows"))


_D = "d AS (SELECT doc_id, lang, quality AS y, least(n_chars / 5000.0, 1.0) AS s, (n_chars % 97) / 96.0 AS t FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", F.col("quality").alias("y"), F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("s"), ((F.col("n_chars") % 97) / F.lit(96.0)).alias("t"))


_AUC = "sum(CASE WHEN y = 1 THEN r END) - m * (m + 1) / 2.0"
_RANKED = "(SELECT *, rank() OVER (PARTITION BY {by} ORDER BY s) + (count(*) OVER (PARTITION BY {by}, s) - 1) / 2.0 AS r, sum(y) OVER (PARTITION BY {by}) AS m, count(*) OVER (PARTITION BY {by}) - sum(y) OVER (PARTITION BY {by}) AS n FROM d)"


@query(f"WITH {_D} SELECT lang, max(m)::BIGINT AS n_pos, max(n)::BIGINT AS n_neg, round((sum(CASE WHEN y = 1 THEN r END) - max(m) * (max(m) + 1) / 2.0) / nullif(max(m) * max(n), 0), 6) AS auc FROM {_RANKED.format(by='lang')} GROUP BY lang")
def roc_auc(spark, sf_dir):
    return _rounded(stats.roc_auc(_labelled(spark, sf_dir), "y", "s", ["lang"]))


@query(f"WITH {_D}, c AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM d GROUP BY s), w AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM c) SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) AS ap FROM w")
def avg_precision(spark, sf_dir):
    return _rounded(stats.average_precision(_labelled(spark, sf_dir), "y", "s"))


@query(f"WITH {_D}, c AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM d GROUP BY s), w AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS m, sum(n) OVER () AS k FROM c) SELECT round(s, 6) AS threshold, round(tp / m, 6) AS tpr, round(fp / k, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM w")
def curve_points(spark, sf_dir):
    return _rounded(stats.curves(_labelled(spark, sf_dir), "y", "s"))


_CONFUSION = "count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND s >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND s < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND s < 0.5) AS fn, avg((s - y) * (s - y)) AS brier"


@query(f"WITH {_D} SELECT lang, tp, fp, tn, fn, round(brier, 6) AS brier FROM (SELECT lang, {_CONFUSION} FROM d GROUP BY lang)")
def confusion(spark, sf_dir):
    return _rounded(stats.confusion(_labelled(spark, sf_dir), "y", "s", 0.5, ["lang"]))


@query(f"""WITH {_D}, k AS (SELECT {_CONFUSION} FROM d), a AS (SELECT (sum(CASE WHEN y = 1 THEN r END) - max(m) * (max(m) + 1) / 2.0) / (max(m) * max(n)) AS auc FROM {_RANKED.format(by='1')}),
    c AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM d GROUP BY s), w AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS t, sum(n) OVER (ORDER BY s DESC) AS f FROM c), b AS (SELECT sum(p * t / (t + f)) / sum(p) AS ap FROM w)
    SELECT tp + fp + tn + fn AS n, round(auc, 6) AS auc, round(ap, 6) AS ap, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity,
    round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(brier, 6) AS brier FROM k, a, b""")
def evaluate(spark, sf_dir):
    return _rounded(stats.evaluate(_labelled(spark, sf_dir), "y", "s"))


_GRID = f"""WITH {_D}, g AS (SELECT i, round(0.05 + 0.01 * i, 2)::DOUBLE AS threshold FROM range(91) t(i)),
    e AS (SELECT i, threshold, sum((s >= threshold AND y = 1)::INT) / sum(y) AS sens, sum((s < threshold AND y = 0)::INT) / (count(*) - sum(y)) AS spec FROM g, d GROUP BY ALL)"""


@query(_GRID + " SELECT i::INT AS i, threshold, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity FROM e")
def threshold_grid(spark, sf_dir):
    return _rounded(stats.threshold_grid(_labelled(spark, sf_dir), "y", "s"))


@query(_GRID + " SELECT threshold, round(sens + spec - 1, 6) AS j FROM e ORDER BY round(sens + spec - 1, 9) DESC, i LIMIT 1")
def youden(spark, sf_dir):
    return _rounded(stats.youden_threshold(_labelled(spark, sf_dir), "y", "s"))


@query(_GRID + " SELECT coalesce(max(threshold) FILTER (WHERE sens >= 0.9), 0.05) AS threshold FROM e")
def sens_threshold(spark, sf_dir):
    return stats.sensitivity_threshold(_labelled(spark, sf_dir), "y", "s")


@query(f"WITH {_D} SELECT least(floor(s * 5), 4)::INT AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(y), 6) AS share_positive FROM d GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return _rounded(stats.calibration_bins(_labelled(spark, sf_dir), "y", "s"))


@query(f"""WITH {_D}, r AS (SELECT y, {', '.join(f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS all_{x}, rank() OVER (PARTITION BY y ORDER BY {x}) + (count(*) OVER (PARTITION BY y, {x}) - 1) / 2.0 AS own_{x}" for x in 'st')}, sum(y) OVER () AS m, count(*) OVER () - sum(y) OVER () AS n FROM d),
    v AS (SELECT y, m, n, {', '.join(f"CASE WHEN y = 1 THEN (all_{x} - own_{x}) / n ELSE 1 - (all_{x} - own_{x}) / m END AS v{x}" for x in 'st')} FROM r),
    g AS (SELECT avg(vs) FILTER (WHERE y = 1) AS a, avg(vt) FILTER (WHERE y = 1) AS b, (var_samp(vs) FILTER (WHERE y = 1) + var_samp(vt) FILTER (WHERE y = 1) - 2 * covar_samp(vs, vt) FILTER (WHERE y = 1)) / max(m) + (var_samp(vs) FILTER (WHERE y = 0) + var_samp(vt) FILTER (WHERE y = 0) - 2 * covar_samp(vs, vt) FILTER (WHERE y = 0)) / max(n) AS v FROM v)
    SELECT round(a, 6) AS auc_a, round(b, 6) AS auc_b, round(a - b, 6) AS delta, round((a - b) / sqrt(v), 6) AS z FROM g""")
def delong(spark, sf_dir):
    return _rounded(stats.delong(_labelled(spark, sf_dir), "y", "s", "t"))


_DELONG = registry.SQL["delong"]
#: The error function's approximation that stats.normal_p has.
_ERF = "0.3275911 0.254829592 -0.284496736 1.421413741 -1.453152027 1.061405429".split()


@query(f"""WITH z AS ({_DELONG}), x AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + {_ERF[0]} * abs(z) / sqrt(2.0)) AS t FROM z)
    SELECT auc_a, auc_b, delta, z, round(CASE WHEN x = 0 THEN 1.0 ELSE t * ({_ERF[1]} + t * ({_ERF[2]} + t * ({_ERF[3]} + t * ({_ERF[4]} + t * {_ERF[5]})))) * exp(-x * x) END, 6) AS p FROM x""")
def delong_p(spark, sf_dir):
    return _rounded(delong(spark, sf_dir).withColumn("p", stats.normal_p(F.col("z"))))


_BOOT = f"""WITH {_D}, b AS (SELECT y, s, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM d), k AS (SELECT count(*) AS n FROM d),
    x AS (SELECT r AS round, ('0x' || substr(md5('42|' || r || '|' || j), 1, 8))::BIGINT % k.n AS i FROM k, range(50) t(r), range((SELECT count(*) FROM d)) u(j)),
    z AS (SELECT x.round, y, s FROM x JOIN b USING (i)), q AS (SELECT round, y, rank() OVER (PARTITION BY round ORDER BY s) + (count(*) OVER (PARTITION BY round, s) - 1) / 2.0 AS r FROM z),
    a AS (SELECT round, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM q GROUP BY round)"""


@query(_BOOT + " SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a")
def bootstrap_auc(spark, sf_dir):
    return _rounded(stats.interval(stats.bootstrap_auc(_labelled(spark, sf_dir), "y", "s", F.col("doc_id"))))


_CUMULATED = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
_POISSON = f"""WITH {_D}, u AS (SELECT r AS round, y, s, (('0x' || substr(md5('42|' || (r // 4) || '|' || doc_id), 1 + 8 * (r % 4)::INT, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM d, range(100) t(r)),
    w AS (SELECT round, y, s, {' + '.join(f'(u > {c!r})::INT' for c in _CUMULATED)} AS w FROM u), c AS (SELECT round, s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS n FROM w GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY round ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
    a AS (SELECT round, sum(p * (below + n / 2.0)) / sum(p) / sum(n) AS auc FROM b GROUP BY round)"""


@query(_POISSON + " SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a")
def poisson_bootstrap_auc(spark, sf_dir):
    return _rounded(stats.interval(stats.poisson_auc(_labelled(spark, sf_dir), "y", "s", F.col("doc_id"), 100)))


@query(_POISSON.replace("range(100)", "range(2000)") + """, k AS (SELECT round, sum(p) AS p, sum(n) AS n, sum(p) FILTER (WHERE s >= 0.5) AS tp, sum(n) FILTER (WHERE s >= 0.5) AS fp FROM c GROUP BY round),
    l AS (SELECT round, auc, 2.0 * tp / (tp + fp + p) AS f1, tp / p AS sensitivity, 1 - fp / n AS specificity FROM a JOIN k USING (round)), x AS (UNPIVOT l ON auc, f1, sensitivity, specificity INTO NAME metric VALUE v)
    SELECT metric, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM x GROUP BY metric""")
def poisson_intervals(spark, sf_dir):
    """Intervals of four metrics from 2,000 resamples."""
    found = resample.poisson_metrics(_labelled(spark, sf_dir), "y", "s", F.col("doc_id"), 2000)
    return _rounded(stats.metric_intervals(found, ("auc", "f1", "sensitivity", "specificity")))


_DRAWN = f"""WITH {_D}, b AS (SELECT y, s, t, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS i FROM d), k AS (SELECT count(*) AS n FROM d),
    x AS (SELECT r AS round, ('0x' || substr(md5('42|' || r || '|' || j), 1, 8))::BIGINT % k.n AS i FROM k, range(50) q(r), range((SELECT count(*) FROM d)) v(j)),
    z AS (SELECT x.round, y, s, t FROM x JOIN b USING (i))"""


@query(_DRAWN + """, r AS (SELECT round, y, s, rank() OVER (PARTITION BY round ORDER BY s) + (count(*) OVER (PARTITION BY round, s) - 1) / 2.0 AS r FROM z),
    m AS (SELECT round, sum(y) AS p, count(*) - sum(y) AS n, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc,
        count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND s >= 0.5) AS fp FROM r GROUP BY round),
    c AS (SELECT round, s, sum(y) AS p, count(*) - sum(y) AS n FROM z GROUP BY ALL),
    w AS (SELECT round, p, sum(p) OVER (PARTITION BY round ORDER BY s DESC) AS t, sum(n) OVER (PARTITION BY round ORDER BY s DESC) AS f FROM c),
    e AS (SELECT round, sum(p * t / (t + f)) / sum(p) AS ap FROM w GROUP BY round),
    l AS (SELECT round, auc, ap, 2.0 * tp / (2 * tp + fp + p - tp) AS f1, tp / p AS sensitivity, 1 - fp / n AS specificity FROM m JOIN e USING (round) WHERE p > 0 AND n > 0),
    u AS (UNPIVOT l ON auc, ap, f1, sensitivity, specificity INTO NAME metric VALUE v)
    SELECT metric, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM u GROUP BY metric""")
def bootstrap_intervals(spark, sf_dir):
    return _rounded(stats.metric_intervals(stats.bootstrap_metrics(_labelled(spark, sf_dir), "y", "s", F.col("doc_id"))))


@query(_DRAWN + """, g AS (SELECT round, 'a' AS which, y, s AS x FROM z UNION ALL SELECT round, 'b', y, t FROM z UNION ALL SELECT -1, 'a', y, s FROM d UNION ALL SELECT -1, 'b', y, t FROM d),
    r AS (SELECT round, which, y, rank() OVER (PARTITION BY round, which ORDER BY x) + (count(*) OVER (PARTITION BY round, which, x) - 1) / 2.0 AS r FROM g),
    a AS (SELECT round, which, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY ALL),
    e AS (SELECT round, max(auc) FILTER (WHERE which = 'a') - max(auc) FILTER (WHERE which = 'b') AS d FROM a GROUP BY round)
    SELECT round((SELECT d FROM e WHERE round = -1), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi,
        round(least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 6) AS p FROM e WHERE round >= 0 AND d IS NOT NULL""")
def paired_bootstrap(spark, sf_dir):
    return _rounded(stats.paired_bootstrap(_labelled(spark, sf_dir), "y", "s", "t", F.col("doc_id")))


@query(f"""WITH {_D}, u AS (SELECT lang, y, 's' AS baseline, CASE WHEN s < 1 THEN s END AS v, CASE WHEN s < 1 THEN s END AS x FROM d UNION ALL SELECT lang, y, 't', nullif(t, 0), -nullif(t, 0) FROM d),
    c AS (SELECT lang, baseline, round(avg((v IS NOT NULL)::INT), 6) AS coverage, count(v) AS n FROM u GROUP BY ALL),
    r AS (SELECT lang, baseline, y, rank() OVER (PARTITION BY lang, baseline ORDER BY x) + (count(*) OVER (PARTITION BY lang, baseline, x) - 1) / 2.0 AS r FROM u WHERE v IS NOT NULL),
    a AS (SELECT lang, baseline, sum(y) AS p, count(*) - sum(y) AS q, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY ALL)
    SELECT lang, baseline, coverage, n, round(auc, 6) AS auc FROM c JOIN a USING (lang, baseline) WHERE n >= 10 AND p > 0 AND q > 0""")
def baseline_table(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumns({"s": F.when(F.col("s") < 1, F.col("s")), "t": F.nullif(F.col("t"), F.lit(0.0))})
    return _rounded(stats.baseline_table(d, "y", {"s": 1, "t": -1}, "lang"))
