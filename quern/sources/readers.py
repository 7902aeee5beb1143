"""Readers with declared schemas: delimited text, FASTA, nested documents, snapshots, optional tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.nulls import known, num
from quern.operators.select import keep_first

VARIANTS = "VariationID STRING, Assembly STRING, Type STRING, ReviewStatus STRING, ClinicalSignificance STRING, Name STRING, GeneSymbol STRING, Chromosome STRING, Start BIGINT"
SCORES = "chrom STRING, pos BIGINT, ref STRING, alt STRING, genome STRING, uniprot_id STRING, transcript_id STRING, protein_variant STRING, am_pathogenicity DOUBLE, am_class STRING"
_COUNTS = "STRUCT<af: DOUBLE, ac: BIGINT, an: BIGINT, populations: ARRAY<STRUCT<id: STRING, ac: BIGINT, an: BIGINT>>>"
POPULATION = f"variant_id: STRING, pos: BIGINT, ref: STRING, alt: STRING, hgvsp: STRING, consequence: STRING, genome: {_COUNTS}, exome: {_COUNTS}"
#: Names that versions of the constraint table give to its columns, first choice first.
CONSTRAINT_NAMES = {"pli": ("pLI", "lof.pLI", "exac_pLI"), "loeuf": ("oe_lof_upper", "lof.oe_ci.upper", "LOEUF"), "mis_z": ("mis_z", "mis.z_score", "exac_mis_z")}


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, comment: str | None = None) -> DataFrame:
    """A delimited table, compressed or not: values that stand for missing are null, numbers that aren't are null.

    A row with too many fields is dropped, one with too few is filled with nulls. With a header the
    columns are found by name, whatever their order and whatever other columns there are.
    """
    declared = T._parse_datatype_string(schema)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "enforceSchema": "true", "columnPruning": "false"}
    if comment:
        options["comment"] = comment
    reader = spark.read.options(**options)
    if header:
        names = reader.option("header", True).option("inferSchema", False).csv(path).columns
    else:
        names = declared.fieldNames()
    text = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_corrupt", T.StringType())])
    rows = reader.option("header", header).schema(text).csv(path)
    # the reader refuses a plan that needs nothing but the corrupt record, as a mere count would; no letter of a real column is added
    whole = F.concat("_corrupt", F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0))
    fields = F.size(F.split(whole, sep if sep != "|" else r"\|"))
    rows = rows.where(F.col("_corrupt").isNull() | (fields <= len(names)))
    out = []
    for f in declared.fields:
        c = known(F.col(f"`{f.name}`")) if f.name in names else F.lit(None)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = num(c)
        elif not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def optional(spark: SparkSession, path: str, schema: str, **how) -> DataFrame:
    """The table, or an empty one of its schema where the path doesn't exist: joins then give nulls."""
    from pyspark.errors import AnalysisException

    try:
        return delimited(spark, path, schema, **how)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T._parse_datatype_string(schema))


def precise_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores by accession and change (key ACC_R175H), from a headerless table with # comments."""
    rows = delimited(spark, path, SCORES, sep="\t", header=False, comment="#").where("am_pathogenicity is not null and uniprot_id is not null and protein_variant is not null")
    return rows.select(F.concat_ws("_", F.trim("uniprot_id"), F.trim("protein_variant")).alias("key"), F.trim("protein_variant").alias("change"), "am_pathogenicity", "am_class")


def positional_scores(rows: DataFrame, value: str) -> DataFrame:
    """key (chrom_pos_ref_alt), value; the newer position column where there is one."""
    position = F.coalesce(*(F.col(c) for c in ("grch38_pos", "hg19_pos") if c in rows.columns))
    return rows.select(F.concat_ws("_", F.col("chr").cast("string"), position.cast("string"), "ref", "alt").alias("key"), F.col(value).cast("double").alias(value))


def gene_constraints(rows: DataFrame, gene: str = "gene") -> DataFrame:
    """GeneSymbol, pli, loeuf, mis_z from whatever names a version has; the first row of a gene by its values."""
    picked = [num(F.col(f"`{next(n for n in names if n in rows.columns)}`")).alias(k) if any(n in rows.columns for n in names) else F.lit(None).cast("double").alias(k) for k, names in CONSTRAINT_NAMES.items()]
    chosen = rows.select(F.col(gene).alias("GeneSymbol"), *picked)
    return keep_first(chosen, ["GeneSymbol"], [F.col(k).isNull() for k in CONSTRAINT_NAMES] + [F.col(k) for k in CONSTRAINT_NAMES])


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """gene, seq: the longest sequence of each gene (GN= in the header), of equal ones the first by text."""
    records = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    header = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    rows = records.select(F.regexp_extract(header, r"\bGN=(\S+)", 1).alias("gene"), body.alias("seq")).where("gene <> ''")
    return keep_first(rows, ["gene"], [-F.length("seq"), F.col("seq")])


def documents(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON documents, one file or many (path may have wildcards): a document a file, or a line."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def artefacts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """file and doc (VARIANT) of JSON documents whose shapes differ, from all files that match path: no schema is agreed on or guessed."""
    docs = spark.read.option("singleVariantColumn", "doc").option("multiLine", multi_line).json(path)
    return docs.select(F.col("_metadata.file_path").alias("file"), "doc")


def artefact_fields(docs: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """docs with a column for each field (name: path, type); null where a document lacks the path or has another type there."""
    return docs.select("*", *(F.try_variant_get("doc", path, kind).alias(name) for name, (path, kind) in fields.items()))


def artefact_entries(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """keep, pos, key (null in a list) and value (VARIANT) of each entry of the list or object at path; documents without it have no row."""
    names = ", ".join("d.`" + c.replace("`", "``") + "`" for c in keep)
    inner = "CAST(try_variant_get(d.doc, :path, 'variant') AS VARIANT)"
    return docs.sparkSession.sql(f"SELECT {names}, e.pos, e.key, e.value FROM {{docs}} d, LATERAL variant_explode({inner}) e", args={"path": path}, docs=docs)


def population_records(genes: DataFrame) -> DataFrame:
    """gene and the fields of each variant, from documents with a gene and its list of variants (POPULATION)."""
    return genes.select("gene", F.explode("variants").alias("v")).select("gene", "v.*")


def population_rows(raw: DataFrame, populations: tuple[str, ...] = ("afr", "amr", "eas", "fin", "nfe", "sas"), least: float = 0.001) -> DataFrame:
    """Common missense variants of population records, flat and labelled benign: the frequency from genomes, else exomes."""
    from quern.functions.parse import frequency, last_part

    af = F.when(F.col("genome.af") > 0, F.col("genome.af")).otherwise(F.col("exome.af"))
    kept = raw.where(F.lower("consequence").contains("missense") & (F.coalesce(af, F.lit(0.0)) >= least))
    gene = F.col("gene") if "gene" in raw.columns else F.lit(None).cast("string")
    return kept.select(
        gene.alias("GeneSymbol"), F.concat(F.lit("gnomad_"), "variant_id").alias("VariationID"), F.col("variant_id").alias("Name"), F.lit("Benign_gnomAD").alias("ClinicalSignificance"),
        F.lit(0).alias("label"), F.lit("gnomad_common").alias("label_confidence"), F.lit("gnomAD").alias("source"), F.split("variant_id", "-")[0].alias("Chromosome"), F.col("pos").alias("Start"),
        F.col("ref").alias("ReferenceAllele"), F.col("alt").alias("AlternateAllele"), F.coalesce(last_part(F.col("hgvsp"), ":"), F.lit("")).alias("ProteinChange"), af.alias("gnomad_af_global"),
        *(frequency(F.col("genome"), F.col("exome"), p).alias(f"gnomad_af_{p}") for p in populations),
    )


def snapshot_source(spark: SparkSession, name: str, fetch, schema: str, keys: list) -> DataFrame:
    """A table of what fetch(key) returns (a list of tuples) for each key, one partition a key, over the Python data source interface.

    fetch runs on the executors and should raise on a passing failure, so that the task is tried again.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in keys]

        def read(self, partition):
            yield from fetch(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
