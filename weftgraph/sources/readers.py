"""Readers for the record formats that identifiers come in: tables, tagged records, sequences, ontologies, XML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import name_matches


def tab_table(spark: SparkSession, path: str, columns: Sequence[str], taxa: Sequence[str] = (), taxon: str = "tax_id", sep: str = "\t") -> DataFrame:
    """A tab file with `#` comment lines and `-` for nothing; with taxa, only rows of these."""
    df = spark.read.csv(path, sep=sep, comment="#", nullValue="-", schema=", ".join(f"`{c}` string" for c in columns))
    return df.where(F.col(taxon).isin(*taxa)) if taxa else df


def taxdump(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Taxonomy dumps: fields between `\\t|\\t`, lines ended by `\\t|`."""
    parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*[F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit("")).alias(c) for k, c in enumerate(columns)])


def tagged_records(spark: SparkSession, path: str, end: str = "//\n", tag: str = r"^([A-Z_]+) +(.*)$") -> DataFrame:
    """record, tag, n, value: the `TAG value` lines of records that end with a mark; n counts a tag's lines in order.

    A record is named by its ID line, or by its first line.
    """
    text = spark.read.text(path, lineSep=end).where("trim(value) != ''")
    lines = text.withColumn("_r", F.monotonically_increasing_id()).select("_r", F.posexplode(F.split("value", "\n")).alias("line", "value")).where("trim(value) != ''")
    found = lines.select("_r", "line", F.regexp_extract("value", tag, 1).alias("tag"), F.trim(F.regexp_extract("value", tag, 2)).alias("value")).where("tag != ''")
    name = F.coalesce(F.min_by(F.when(F.col("tag") == "ID", F.col("value")), F.when(F.col("tag") == "ID", F.col("line"))).over(Window.partitionBy("_r")), F.min_by("value", "line").over(Window.partitionBy("_r")))
    return found.withColumn("record", name).withColumn("n", F.row_number().over(Window.partitionBy("_r", "tag").orderBy("line"))).select("record", "tag", "n", "value")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, sequence, length."""
    text = spark.read.text(path, lineSep=">").where("trim(value) != ''")
    head, body = F.substring_index("value", "\n", 1), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return text.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), F.upper(body).alias("sequence"), F.length(body).alias("length"))


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """name, definition, sequence of flat-file records."""
    text = spark.read.text(path, lineSep="//\n").where("value rlike 'LOCUS'")
    body = F.regexp_replace(F.regexp_extract("value", r"(?s)ORIGIN[^\n]*\n(.*)$", 1), r"[\s\d/]", "")
    definition = F.regexp_replace(F.regexp_extract("value", r"(?s)DEFINITION\s+(.*?)\n[A-Z]", 1), r"\s+", " ")
    return text.select(F.regexp_extract("value", r"LOCUS\s+(\S+)", 1).alias("name"), definition.alias("definition"), F.upper(body).alias("sequence"))


def structure_records(spark: SparkSession, path: str) -> DataFrame:
    """record, tag, value: the `> <TAG>` fields of structure files whose records end with `$$$$`."""
    text = spark.read.text(path, lineSep="$$$$\n").where("trim(value) != ''")
    fields = text.select(F.trim(F.substring_index("value", "\n", 1)).alias("record"), F.explode(F.expr(r"regexp_extract_all(value, '(?s)>\\s*<[^>]+>[^\\n]*\\n.*?(?=\\n\\s*\\n|$)', 0)")).alias("f"))
    return fields.select("record", F.regexp_extract("f", r"<([^>]+)>", 1).alias("tag"), F.trim(F.regexp_replace("f", r"^>[^\n]*\n", "")).alias("value"))


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms: id, name, namespace, obsolete; links: child, parent, kind) of an OBO file."""
    text = spark.read.text(path, lineSep="\n\n").where(F.trim("value").startswith("[Term]"))

    def field(tag: str):
        return F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{tag}: ([^\n!]*)", 1)), F.lit(""))

    terms = text.select(field("id").alias("id"), field("name").alias("name"), field("namespace").alias("namespace"), F.coalesce(field("is_obsolete") == "true", F.lit(False)).alias("obsolete"), "value")
    up = terms.select("id", F.explode(F.split("value", "\n")).alias("line"))
    is_a = up.where("line LIKE 'is_a: %'").select(F.col("id").alias("child"), F.regexp_extract("line", r"^is_a: (\S+)", 1).alias("parent"), F.lit("is_a").alias("kind"))
    other = up.where("line LIKE 'relationship: %'").select(F.col("id").alias("child"), F.regexp_extract("line", r"^relationship: \S+ (\S+)", 1).alias("parent"), F.regexp_extract("line", r"^relationship: (\S+)", 1).alias("kind"))
    return terms.drop("value"), is_a.unionByName(other)


def xml_rows(spark: SparkSession, path: str, row: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row)
    return (reader.schema(schema) if schema else reader).load(path)


def newest_files(df: DataFrame, key: str, version: str, name: Column | None = None) -> DataFrame:
    """Rows from the file with the highest version per key; key and version are patterns over the file's name, or another (that of a folder of files, which Spark reads as a column)."""
    name = F.col("_metadata.file_name") if name is None else name
    df = df.select("*", F.regexp_extract(name, key, 1).alias("file_key"), F.regexp_extract(name, version, 1).try_cast("long").alias("file_version"))
    newest = df.groupBy("file_key").agg(F.max("file_version").alias("file_version"))
    return df.join(newest, ["file_key", "file_version"], "left_semi")


def ranked_lists(spark: SparkSession, path: str) -> DataFrame:
    """list, rank, id, metadata (map) of files with `# LIST name`, `# KEY=VAL` and tab rows of an id and values.

    A list's rows are few enough for one task (they are ranked by hand or by file order); files are read whole.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"), F.col("_metadata.file_path").alias("file")).where("trim(value) != ''")
    order = Window.partitionBy("file").orderBy("line")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("value", r"^#\s*LIST\s+(.+)$", 1)
    rows = rows.withColumn("list", F.last(F.nullif(F.trim(head), F.lit("")), ignorenulls=True).over(so_far))
    pairs = rows.where(F.col("value").rlike(r"^#\s*\w+\s*=")).groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct(F.regexp_extract("value", r"^#\s*(\w+)", 1), F.trim(F.regexp_extract("value", r"=(.*)$", 1))))).alias("metadata"))
    ids = rows.where(~F.col("value").startswith("#")).withColumn("id", F.regexp_replace(F.substring_index("value", "\t", 1), r"^['\"]|['\"]$", ""))
    ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy("file", "list").orderBy("line")))
    return ids.join(pairs, "list", "left").select("list", "rank", "id", "metadata")


def id_list(spark: SparkSession, text: str) -> DataFrame:
    """id: identifiers given as text, split at commas, semicolons and white space."""
    return spark.range(1).select(F.explode(F.split(F.lit(text), r"[\s,;]+")).alias("id")).where("id != ''").distinct()


def id_file(spark: SparkSession, path: str) -> DataFrame:
    """id: identifiers in text files, split like those of id_list."""
    return spark.read.text(path).select(F.explode(F.split("value", r"[\s,;]+")).alias("id")).where("id != ''").distinct()


def resolved_names(df: DataFrame, aliases: DataFrame, key: str = "name") -> DataFrame:
    """tax_id for each name: by name, else by alias; merged ids give the one they were merged into."""
    own = df.join(aliases.where("kind = 'name'").select(F.upper("alias").alias("_k"), F.col("tax_id").alias("_own")), F.upper(key) == F.col("_k"), "left").drop("_k")
    other = own.join(aliases.where("kind != 'name'").groupBy(F.upper("alias").alias("_k")).agg(F.min("tax_id").alias("_other")), F.upper(key) == F.col("_k"), "left").drop("_k")
    return other.select(*df.columns, F.coalesce("_own", "_other").alias("tax_id"))


def network_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (name, value: its label), edges (name1, reading, name2) and parameters (name, value) of a network's flat file.

    Lines are `NODE`, `EDGE` or `PARAM` and their fields, between tabs; `#` begins a comment.
    """
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) != ''").select(F.upper(parts[0]).alias("kind"), *[F.get(parts, F.lit(k)).alias(f"f{k}") for k in (1, 2, 3)])
    two = [F.col("f1").alias("name"), F.col("f2").alias("value")]
    return {
        "nodes": rows.where("kind = 'NODE'").select(*two), "parameters": rows.where("kind = 'PARAM'").select(*two),
        "edges": rows.where("kind = 'EDGE'").select(F.col("f1").alias("name1"), F.col("f2").alias("reading"), F.col("f3").alias("name2")),
    }


def taxa_named(names: DataFrame, pattern: str) -> DataFrame:
    """tax_id: taxa (tax_id, merged_id, name, alias) whose name fits a pattern with `%` and `?`, or whose alias does where no name fits; merged ones as what they are now."""
    fits = names.select(F.coalesce("merged_id", "tax_id").alias("tax_id"), name_matches(F.col("name"), pattern).alias("by_name"), name_matches(F.col("alias"), pattern).alias("by_alias"))
    any_name = F.broadcast(fits.agg(F.bool_or("by_name").alias("named")))  # one row
    return fits.join(any_name).where(F.when(F.coalesce("named", F.lit(False)), F.col("by_name")).otherwise(F.col("by_alias"))).select("tax_id").distinct()


#: A value of a dump's row: a quoted text (with doubled or escaped quotes) or what stands up to the next comma.
_DUMPED = r"'[^'\\]*(?:(?:\\.|'')[^'\\]*)*'|[^,()']+"


def sql_dump(spark: SparkSession, path: str, table: str, columns: str) -> DataFrame:
    """The rows that the `INSERT INTO table VALUES (...),(...);` statements of a dump hold, with these columns (DDL).

    Spark reads a dump in ranges of bytes that are cut at the ends of statements; commas, brackets and
    semicolons within quoted texts are texts. NULL is null, and so is what its column's type can't hold.
    """
    names = [f.strip().split()[0] for f in columns.split(",")]
    kinds = [f.strip().split()[1] for f in columns.split(",")]
    statement = spark.read.text(path, lineSep=";\n").where(F.col("value").rlike(rf"(?is)^\s*INSERT INTO `?{table}`?\s*(?:\([^)]*\))?\s*VALUES"))
    body = F.regexp_replace("value", r"(?is)^\s*INSERT INTO [^(]*?(?:\([^)]*\)\s*)?VALUES\s*", "")
    tuples = statement.select(F.explode(F.regexp_extract_all(body, F.lit(rf"\(((?:{_DUMPED}|,)*)\)"), F.lit(1))).alias("row"))
    fields = tuples.select(F.regexp_extract_all("row", F.lit(_DUMPED), F.lit(0)).alias("f"))

    def value(k: int, kind: str):
        raw = F.trim(F.get("f", F.lit(k)))
        quoted = F.substring(raw, F.lit(2), F.length(raw) - 2)
        plain = F.replace(F.replace(quoted, F.lit("''"), F.lit("'")), F.lit("\\\\"), F.lit("\x00"))  # escaped backslashes wait
        plain = F.replace(F.regexp_replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))
        text = F.when(raw.startswith("'"), plain).when(F.upper(raw) != "NULL", raw)
        return text if kind == "string" else text.try_cast(kind)

    return fields.select(*[value(k, kind).alias(name) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))])
