"""Queries that write the tables out in the formats of the sources and sinks, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.parse import change_or_null
from quern.plans.registry import query, table
from quern.sources import fetch, readers, sinks
from quern.sources.work import fresh_path

_FILLED = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END"


@query(f"SELECT p_partkey, {_FILLED} AS p_name, p_brand, p_retailprice, NULL::INT AS absent FROM part")
def delimited_round_trip(spark, sf_dir):
    """Gzip, tab-separated, tokens for missing values, columns in another order than declared."""
    p, path = table(spark, sf_dir, "part"), fresh_path(spark, "parts_tsv")
    name = F.when(F.col("p_partkey") % 7 == 0, F.lit("N/A")).otherwise(F.col("p_name"))
    p.select("p_brand", name.alias("p_name"), "p_retailprice", "p_partkey", "p_type").write.options(sep="\t", header=True, compression="gzip").csv(path)
    return readers.delimited(spark, path, "p_partkey BIGINT, p_name STRING, p_brand STRING, p_retailprice DOUBLE, absent INT", sep="\t")


@query("SELECT p_partkey, p_brand, p_size FROM part")
def csv_round_trip(spark, sf_dir):
    path = fresh_path(spark, "parts_csv")
    sinks.delimited(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), path)
    return readers.delimited(spark, path, "p_partkey BIGINT, p_brand STRING, p_size INT")


@query("SELECT 'P' || p_partkey || '_K' || p_partkey || 'E' AS key, 'K' || p_partkey || 'E' AS change, p_size / 50.0 AS am_pathogenicity, p_brand AS am_class FROM part WHERE p_partkey % 11 <> 0")
def precise_score_file(spark, sf_dir):
    """A headerless table with comments, a missing score here and there."""
    p, path, key = table(spark, sf_dir, "part"), fresh_path(spark, "scores"), F.col("p_partkey").cast("string")
    score = F.when(F.col("p_partkey") % 11 == 0, F.lit("")).otherwise((F.col("p_size") / F.lit(50.0)).cast("string"))
    fields = [F.lit("chr1"), key, F.lit("A"), F.lit("G"), F.lit("GRCh38"), F.concat(F.lit("P"), key), F.lit("ENST"), F.concat(F.lit("K"), key, F.lit("E")), score, F.col("p_brand")]
    lines = p.select(F.concat_ws("\t", *fields).alias("value"))
    lines.union(spark.createDataFrame([("# a comment\t1",)], "value string")).write.text(path)
    return readers.precise_scores(spark, path).select("key", "change", "am_pathogenicity", "am_class")


@query("SELECT '1_' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey + 1000 END || '_A_G' AS key, p_size / 100.0 AS revel FROM part")
def positional_score_rows(spark, sf_dir):
    """The newer position where there is one, else the older."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(F.lit(1).alias("chr"), k.alias("hg19_pos"), F.when(k % 3 != 0, k + 1000).alias("grch38_pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), (F.col("p_size") / F.lit(100.0)).alias("revel"))
    return readers.positional_scores(rows, "revel").select("key", "revel")


@query("""
    SELECT gene AS "GeneSymbol", pli, NULL::DOUBLE AS loeuf, mis_z FROM (SELECT s_nationkey AS gene, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey / 1000.0 END AS pli, s_acctbal AS mis_z,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey / 1000.0 END NULLS LAST, s_acctbal) AS rn FROM supplier) WHERE rn = 1""")
def constraint_rows(spark, sf_dir):
    """A version's own column names; one column is absent; the first row of a gene."""
    s = table(spark, sf_dir, "supplier")
    pli = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") / F.lit(1000.0))
    return readers.gene_constraints(s.select(F.col("s_nationkey").alias("gene"), pli.alias("lof.pLI"), F.col("s_acctbal").alias("mis.z_score")))


@query("SELECT min('Q' || ps) AS uniprot_ac, g AS gene_symbol FROM (SELECT s_suppkey AS ps, 'G' || s_nationkey AS g FROM supplier WHERE s_suppkey % 5 <> 0) GROUP BY g")
def accession_file(spark, sf_dir):
    s, path = table(spark, sf_dir, "supplier"), fresh_path(spark, "accessions")
    gene = F.when(F.col("s_suppkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("G"), F.col("s_nationkey").cast("string")))
    s.select(F.concat_ws("\t", F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")), gene).alias("value")).write.text(path)
    return fetch.accessions(spark, path).select("uniprot_ac", "gene_symbol")


@query("""
    SELECT gene, seq FROM (SELECT source AS gene, letters AS seq, row_number() OVER (PARTITION BY source ORDER BY length(letters) DESC, letters) AS rn
        FROM (SELECT source, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents)) WHERE rn = 1""")
def fasta_file(spark, sf_dir):
    """The longest sequence of each gene, written in lines of 60."""
    d, path = table(spark, sf_dir, "documents"), fresh_path(spark, "fasta")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    body = F.regexp_replace(letters, "(.{60})", "$1\n")
    d.select(F.concat(F.lit("sp|"), F.col("doc_id").cast("string"), F.lit(" OS=x GN="), F.col("source"), F.lit("\n"), body).alias("value")).write.option("lineSep", "\n>").text(path)
    return readers.fasta(spark, path)


_GENOME = "CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE l_discount END"
_EXOME = "l_tax"


@query(f"""
    SELECT 'G' || l_suppkey AS "GeneSymbol", 'gnomad_1-' || l_orderkey || '-' || l_linenumber AS "VariationID", '1' AS "Chromosome", 'p.Lys' || l_partkey || 'Glu' AS "ProteinChange",
        CASE WHEN {_GENOME} > 0 THEN {_GENOME} ELSE {_EXOME} END AS gnomad_af_global,
        CASE WHEN l_linenumber > 0 THEN l_linenumber / 100.0 END AS gnomad_af_afr, CASE WHEN l_quantity > 25 THEN l_linenumber / l_quantity ELSE l_linenumber / 1000.0 END AS gnomad_af_nfe, NULL::DOUBLE AS gnomad_af_eas
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_quantity FROM lineitem WHERE l_orderkey % 20 = 0)
    WHERE l_linenumber <> 5 AND CASE WHEN {_GENOME} > 0 THEN {_GENOME} ELSE {_EXOME} END >= 0.001""")
def population_file(spark, sf_dir):
    """Nested JSON documents of genes with lists of variants, read, flattened and filtered."""
    x, path = table(spark, sf_dir, "lineitem").where("l_orderkey % 20 = 0"), fresh_path(spark, "population")
    x = x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity").distinct()
    line, quantity = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    of = lambda name, ac, an: F.struct(F.lit(name).alias("id"), ac.alias("ac"), an.alias("an"))
    genome = F.struct(F.when(line % 3 == 0, 0.0).otherwise(F.col("l_discount")).alias("af"), F.array(of("AFR", line, F.lit(100)), of("nfe", line, F.when(quantity > 25, quantity).otherwise(0))).alias("populations"))
    exome = F.struct(F.col("l_tax").alias("af"), F.array(of("nfe", line, F.lit(1000))).alias("populations"))
    name = F.concat_ws("-", F.lit("1"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    change = F.concat(F.lit("ENSP:p.Lys"), F.col("l_partkey").cast("string"), F.lit("Glu"))
    variant = F.struct(name.alias("variant_id"), F.lit(5).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), change.alias("hgvsp"), F.when(line == 5, "synonymous").otherwise("Missense_variant").alias("consequence"), genome.alias("genome"), exome.alias("exome"))
    x.groupBy(F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("gene")).agg(F.collect_list(variant).alias("variants")).write.json(path)
    genes = readers.documents(spark, path, f"gene STRING, variants ARRAY<STRUCT<{readers.POPULATION}>>", multi_line=False)
    rows = readers.population_rows(readers.population_records(genes))
    return rows.select("GeneSymbol", "VariationID", "Chromosome", "ProteinChange", "gnomad_af_global", "gnomad_af_afr", "gnomad_af_nfe", "gnomad_af_eas")


@query("""
    SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'empty' WHEN n_nationkey % 7 = 6 THEN 'failed' ELSE 'found' END AS state,
        CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 6 THEN 'ATG' || n_nationkey END AS seq FROM nation""")
def resumed_fetch(spark, sf_dir):
    """Half the keys, then all of them: the second run asks only for what the first has not settled."""
    path = fresh_path(spark, "fetched")

    def ask(key):
        n = int(key)
        if n % 5 == 0:
            return []
        if n % 7 == 6:
            raise fetch.Passing(key)
        return [(f"ATG{n}",)]

    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    fetch.resumed(spark, keys.where("key < 12"), ask, "seq STRING", path, page=5, at_once=2)
    return fetch.resumed(spark, keys, ask, "seq STRING", path, page=5, at_once=2)


@query("SELECT n_name AS gene, 'ATG' || n_nationkey AS seq FROM nation WHERE n_nationkey % 4 <> 0")
def sequence_cache(spark, sf_dir):
    path, n = fresh_path(spark, "cache"), table(spark, sf_dir, "nation")
    seq = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("ATG"), F.col("n_nationkey").cast("string")))
    rows = n.select(F.col("n_name").alias("gene"), seq.alias("seq"))
    fetch.keep_sequences(rows.where("seq like '%1%'"), path)
    fetch.keep_sequences(rows.where("seq not like '%1%' or seq is null"), path)
    return fetch.cached_sequences(spark, path)


@query("""
    WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS phred, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_extendedprice, l_tax) AS rn FROM lineitem WHERE l_returnflag = 'A')
    SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity, h.phred FROM lineitem r LEFT JOIN (SELECT * FROM h WHERE rn = 1) h USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def snapshot_join(spark, sf_dir):
    """The first hit by four keys."""
    rows, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    snapshot = rows.where("l_returnflag = 'A'").select(*keys, F.col("l_extendedprice").alias("phred"), "l_tax")
    return fetch.first_hits(rows.select(*keys, "l_quantity"), snapshot, keys, ["phred"], ["phred", "l_tax"])


@query("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 3.0 WHEN 2 THEN NULL ELSE event_id % 10 END AS gerp_rs, CASE WHEN event_id % 3 = 0 THEN 0.25 END AS sift_score FROM events""")
def service_answers(spark, sf_dir):
    """Scores of nested answers: numbers, lists with nulls, absent parts."""
    k = F.col("event_id")
    gerp = F.when(k % 4 == 0, F.lit("[1, 2]")).when(k % 4 == 1, F.lit("[9, null, 3, 1]")).when(k % 4 == 2, F.lit("null")).otherwise((k % 10).cast("string"))
    sift = F.when(k % 3 == 0, F.lit('{"score": "0.25"}')).otherwise(F.lit("{}"))
    answer = F.concat(F.lit('{"dbnsfp": {"gerp++": {"rs": '), gerp, F.lit('}, "sift": '), sift, F.lit("}}"))
    scores = fetch.service_scores(F.col("answer"))
    return table(spark, sf_dir, "events").select("event_id", answer.alias("answer")).select("event_id", scores["gerp_rs"].alias("gerp_rs"), scores["sift_score"].alias("sift_score"))


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'D' END AS ref_aa, CASE p_partkey % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'V' END AS alt_aa,
        CASE WHEN p_partkey % 3 < 2 THEN p_partkey::INT END AS aa_position FROM part""")
def whole_changes(spark, sf_dir):
    """Changes that are stated whole, else null."""
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("p.Lys"), key.cast("string"), F.lit("Glu"))).when(key % 3 == 1, F.concat(F.lit("p.D"), key.cast("string"), F.lit("V"))).otherwise(F.lit("p.?"))
    ref, alt, position = change_or_null(F.col("t"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", ref.alias("ref_aa"), alt.alias("alt_aa"), position.alias("aa_position"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def stage_round_trip(spark, sf_dir):
    """A stage written by partitions, of which one is read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("side"))
    path = sinks.stage(o, fresh_path(spark, "stage"), "v1")
    return spark.read.parquet(path).where("side = 'P'").select("o_orderkey", "o_totalprice")


@query("SELECT '| r_regionkey | r_name | share |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' | ' || format('{:.3f}', r_regionkey / 7.0) || ' |', chr(10) ORDER BY r_regionkey) AS text FROM region")
def markdown_table(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name", (F.col("r_regionkey") / F.lit(7.0)).alias("share")).orderBy("r_regionkey").collect()
    return spark.createDataFrame([(sinks.markdown([r.asDict() for r in rows]),)], "text string")


@query("""SELECT s_suppkey AS run, CASE WHEN s_suppkey % 3 < 2 THEN s_nationkey / 25.0 END AS auc, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey::DOUBLE END AS f1, CASE WHEN s_suppkey % 3 = 1 THEN s_name END AS note,
    CASE WHEN s_suppkey % 3 = 2 THEN 2 END AS n_folds, CASE WHEN s_suppkey % 3 = 2 THEN round((s_nationkey + 0.5) / 2, 6) END AS fold_auc FROM supplier""")
def run_artefacts(spark, sf_dir):
    """Files of runs whose documents differ in shape: metrics here, folds there, a note, a text where a number is expected."""
    s, path = table(spark, sf_dir, "supplier"), fresh_path(spark, "runs")
    key, kind, nation = F.col("s_suppkey"), F.col("s_suppkey") % 3, F.col("s_nationkey").cast("double")
    first = F.struct(key.alias("run"), F.struct((nation / 25.0).alias("auc"), F.lit("none").alias("f1")).alias("metrics"))
    second = F.struct(key.alias("run"), F.struct((nation / 25.0).alias("auc"), key.cast("double").alias("f1")).alias("metrics"), F.col("s_name").alias("note"))
    third = F.struct(key.alias("run"), F.array(F.struct(nation.alias("auc")), F.struct(F.lit(0.5).alias("auc"))).alias("folds"))
    line = F.when(kind == 0, F.to_json(first)).when(kind == 1, F.to_json(second)).otherwise(F.to_json(third))
    s.select(line.alias("value"), kind.alias("stage")).write.partitionBy("stage").text(path)
    docs = readers.artefacts(spark, f"{path}/stage=*/*.txt", multi_line=False)
    runs = readers.artefact_fields(docs, {"run": ("$.run", "long"), "auc": ("$.metrics.auc", "double"), "f1": ("$.metrics.f1", "double"), "note": ("$.note", "string")})
    folds = readers.artefact_entries(runs, "$.folds", ["run"]).select("run", F.try_variant_get("value", "$.auc", "double").alias("auc"))
    means = folds.groupBy("run").agg(F.count("*").cast("int").alias("n_folds"), F.round(F.avg("auc"), 6).alias("fold_auc"))
    return runs.select("run", "auc", "f1", "note").join(means, "run", "left")


@query("SELECT 'customers' AS source, count(*) AS rows, sum(('0x' || substr(md5(c_custkey || '|' || c_nationkey), 1, 8))::BIGINT)::VARCHAR AS checksum, 1 AS n_files FROM customer")
def stage_provenance(spark, sf_dir):
    """A stage written with its record: rows and checksum seen while it is written, and the digest of its input file."""
    c, path = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), fresh_path(spark, "recorded")
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))), 1, 8), 16, 10).cast("long")
    told = sinks.recorded(c, path, "customers", digest=digest)
    return spark.createDataFrame([(told["source"], told["rows"], told["checksum"], told["n_files"])], "source string, rows long, checksum string, n_files int")
