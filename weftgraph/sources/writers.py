"""Lines of the usual exchange formats; each row is formatted where it lies and written as text by the executors."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import xml_escaped
from weftgraph.plans.shared import listed


def sif(edges: DataFrame) -> DataFrame:
    """value: `name<TAB>reading<TAB>name` of (name1, reading, name2)."""
    return edges.select(F.concat_ws("\t", "name1", "reading", "name2").alias("value"))


def gml_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.format_string('  node [ id %d label "%s" ]', F.col("node_id"), F.replace(F.col("name"), F.lit('"'), F.lit("'"))).alias("value"))


def gml_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('  edge [ source %d target %d label "%s" ]', F.col("source"), F.col("target"), F.col("reading")).alias("value"))


def dot(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', F.col("name1"), F.col("name2"), F.col("reading")).alias("value"))


def xgmml(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('<edge source="%s" target="%s" label="%s"/>', *[xml_escaped(F.col(c)) for c in ("name1", "name2", "reading")]).alias("value"))


def bed(mappings: DataFrame) -> DataFrame:
    """value: BED lines of (seq, start, end, name, score, strand); starts count from 0, scores go up to 1000."""
    score = F.least(F.lit(1000), F.greatest(F.lit(0), F.round(1000 * F.coalesce("score", F.lit(0.0))))).cast("int").cast("string")
    return mappings.select(F.concat_ws("\t", F.col("seq").cast("string"), (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.col("name").cast("string"), score, F.when(F.col("strand") < 0, "-").otherwise("+")).alias("value"))


def fasta(rows: DataFrame, width: int = 60) -> DataFrame:
    """value: name and sequence, in lines of so many letters."""
    return rows.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def matrix_market(cells: DataFrame) -> tuple[str, DataFrame]:
    """(head, value): the size line and the lines of (i, j, value)."""
    rows, columns, n = cells.agg(F.coalesce(F.max("i"), F.lit(0)), F.coalesce(F.max("j"), F.lit(0)), F.count("*")).first()
    return f"%%MatrixMarket matrix coordinate real general\n{rows} {columns} {n}", cells.select(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("value").cast("string")).alias("value"))


def set_lines(rows: DataFrame, key: str, member: str) -> DataFrame:
    """value: one line per key with its members in order."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(F.col(member).cast("string"))).alias("m")).select(F.concat_ws("\t", F.col(key).cast("string"), F.array_join("m", "\t")).alias("value"))


def linkouts(terms: DataFrame, templates: DataFrame) -> DataFrame:
    """term, site, url: templates (space, site, template) with the term in place of its mark."""
    return terms.join(F.broadcast(templates), "space").select("term", "site", F.replace("template", F.lit("__ACC__"), F.col("term")).alias("url"))  # templates are a vocabulary


def json_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("error").text(path)


def write_tab(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("error").csv(path, sep=sep, header=True, emptyValue="")


def network_lines(nodes: DataFrame, edges: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """value: the lines of a network's flat file, as readers.network_file takes them; nodes (name, value), edges (name1, reading, name2)."""
    params = nodes.sparkSession.createDataFrame([(f"PARAM\t{k}\t{v}",) for k, v in sorted(parameters.items())], "value string")
    tab = F.lit("\t")
    lines = nodes.select(F.concat_ws("\t", F.lit("NODE"), "name", F.coalesce("value", F.lit(""))).alias("value"))
    return params.union(lines).union(edges.select(F.concat(F.lit("EDGE"), tab, "name1", tab, "reading", tab, "name2").alias("value")))


def sql_dump_lines(rows: DataFrame, table: str, per_statement: int = 100) -> DataFrame:
    """value: INSERT statements of so many rows each, without the `;` and line end that a text writer puts behind them."""
    def told(c: str, kind: str):
        plain = F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
        quoted = F.concat(F.lit("'"), plain, F.lit("'"))
        return F.coalesce(quoted if kind == "string" else F.col(c).cast("string"), F.lit("NULL"))

    one = F.concat(F.lit("("), F.concat_ws(",", *[told(c, k) for c, k in rows.dtypes]), F.lit(")"))
    grouped = rows.select(one.alias("v"), F.expr(f"CAST(monotonically_increasing_id() div {per_statement} AS LONG)").alias("g"))
    return grouped.groupBy("g").agg(F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), F.array_join(F.collect_list("v"), ",")).alias("value")).select("value")


# --- tables that are appended to or replaced as a whole --------------------------------------------


def write_table(rows: DataFrame, folder: str, mode: str = "append") -> int:
    """Adds rows to a table (`append`) or puts them in its place (`drop`), and returns its new version.

    The rows go to a folder of their own; only when all are written does the table's list of folders
    name it. A write that fails leaves the table as it was, and readers keep the version they have.
    Columns must be those the table has.
    """
    if mode not in ("append", "drop"):
        raise ValueError(f"no mode named {mode}")
    spark = rows.sparkSession
    version, folders = table_folders(spark, folder)
    if mode == "append" and folders:
        have = spark.read.parquet(folders[-1])
        if sorted(rows.dtypes) != sorted(have.dtypes):
            raise ValueError(f"the table has columns {have.dtypes}, the rows {rows.dtypes}")
    path = f"{folder}/rows/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    listing = [*(folders if mode == "append" else []), path]
    spark.createDataFrame([(k, p.rsplit("/", 1)[1]) for k, p in enumerate(listing)], "n int, part string").coalesce(1).write.json(f"{folder}/versions/v={version + 1}")
    return version + 1


def table_folders(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list[str]]:
    """(version, folders) of a table's last version that was written whole, or of an older one; (0, []) of none."""
    have = sorted(int(n[2:]) for n in listed(spark, f"{folder}/versions") if "_SUCCESS" in listed(spark, f"{folder}/versions/{n}"))
    if not have:
        return 0, []
    v = have[-1] if version is None else version
    return v, [f"{folder}/rows/{r.part}" for r in spark.read.schema("n int, part string").json(f"{folder}/versions/v={v}").orderBy("n").collect()]


def read_table(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(*table_folders(spark, folder, version)[1])
