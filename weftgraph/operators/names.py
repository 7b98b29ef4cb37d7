"""Names as tokens, `#SPACE#name` with flags for case, and their ids in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.stretches import numbered
from weftgraph.plans.shared import checkpointed


def token_columns(token: Column) -> tuple[Column, Column, Column]:
    """(space, case rule, name) of tokens, as functions.text.token() reads one: a rule of 1 heeds case, -1 wants another case, 0 leaves it to the space."""
    flag = F.regexp_extract(token, r"^(\?\?|!\?|\?!|\?)?", 1)
    rest = F.substring(token, F.length(flag) + 1, F.length(token))
    named = rest.rlike(r"(?s)^#[^#]+#")
    space = F.when(named, F.regexp_extract(rest, r"(?s)^#([^#]+)#", 1))
    return space, F.when(flag == "?", 1).when(flag.isin("!?", "?!"), -1).otherwise(0), F.when(named, F.regexp_replace(rest, r"(?s)^#[^#]+#", "")).otherwise(rest)


def looked_up(tokens: DataFrame, nodes: DataFrame, spaces: DataFrame, create: bool = False, default_space: int = 1) -> tuple[DataFrame, DataFrame]:
    """(token, node_id, made; the nodes that were made) of tokens (token): every node of the name in the token's space, or in any without one.

    spaces: space_id, space_name, case_sensitive (names of spaces count whatever their case). In a space
    that heeds case a name fits exactly, in others whatever its case, unless the token's flags say so:
    `?` fits exactly, `!?` only in another case. `MTID:n` is the node with that id. With `create`, a name
    without a node gets one in its space, or the default one, with the next free id, one for all
    tokens that mean it; but not if its flags ask for another case, for `MTID:n` or in an unknown space.
    Tokens without a node have a null id.
    """
    space, rule, name = token_columns(F.col("token"))
    asked = tokens.select("token").distinct().select("token", F.upper(space).alias("_space"), rule.alias("_rule"), name.alias("_name"))
    asked = asked.withColumn("_id", F.regexp_extract("_name", r"(?i)^MTID:(\d+)$", 1).try_cast("long"))
    dims = F.broadcast(spaces.select("space_id", F.upper("space_name").alias("_space"), F.coalesce("case_sensitive", F.lit(False)).alias("_heeds")))  # a vocabulary
    by_id = asked.where("_id IS NOT NULL").join(nodes.select(F.col("node_id").alias("_id"), F.col("node_id")), "_id")
    held = nodes.select("node_id", "name", "space_id").join(dims.withColumnRenamed("_space", "_in"), "space_id").withColumn("_key", F.upper("name"))
    exact = F.col("name") == F.col("_name")
    fits = (F.col("_space").isNull() | (F.col("_space") == F.col("_in"))) & F.when(F.col("_rule") == 1, exact).when(F.col("_rule") == -1, ~exact).otherwise(exact | ~F.col("_heeds"))
    by_name = asked.where("_id IS NULL").withColumn("_key", F.upper("_name")).join(held, "_key").where(fits)
    found = checkpointed(by_id.select("token", "node_id").unionByName(by_name.select("token", "node_id")).distinct())
    missing = asked.join(found.select("token").distinct(), "token", "left_anti")
    if not create:
        made = nodes.sparkSession.createDataFrame([], "node_id long, name string, space_id int")
        return found.withColumn("made", F.lit(False)).unionByName(missing.select("token", F.lit(None).cast("long").alias("node_id"), F.lit(False).alias("made"))), made
    place = dims.where(F.col("space_id") == default_space).select(F.col("space_id").alias("_d"), F.col("_heeds").alias("_dh"))  # one row
    want = missing.where("_id IS NULL AND _rule >= 0 AND _name != ''").join(dims, "_space", "left").join(F.broadcast(place))
    want = want.where("_space IS NULL OR space_id IS NOT NULL").withColumn("space_id", F.coalesce("space_id", "_d")).withColumn("_heeds", F.coalesce("_heeds", "_dh"))
    want = want.withColumn("_same", F.when(F.col("_heeds") | (F.col("_rule") == 1), F.col("_name")).otherwise(F.upper("_name")))
    first = want.groupBy("space_id", "_same").agg(F.min("_name").alias("name"))
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0))).first()[0]
    new = checkpointed(numbered(first, [], [F.col("space_id").asc(), F.col("_same").asc()], "_n", ties=False).withColumn("node_id", F.col("_n") + top))
    given = want.join(new.select("space_id", "_same", "node_id"), ["space_id", "_same"]).select("token", "node_id", F.lit(True).alias("made"))
    none = missing.join(given.select("token"), "token", "left_anti").select("token", F.lit(None).cast("long").alias("node_id"), F.lit(False).alias("made"))
    return found.withColumn("made", F.lit(False)).unionByName(given).unionByName(none), new.select("node_id", "name", "space_id")


def normalised(accessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges: name1, reading, name2; labels: name, class_name) that the form of accessions (accession) tells.

    GI numbers, however written (`1234`, `gi1234`, `gi|1234`, `g:1234`), are `gi1234` and `GI:1234`, aliases
    of each other, of class GI. A versioned accession is a version of the one without, and of the one
    before; names with the prefixes of reference sequences are of their classes. Others tell nothing.
    """
    a = F.trim("accession")
    gi = F.regexp_extract(a, r"(?i)^(?:gi?[|:]?)?0*([1-9][0-9]*)$", 1)
    base, version = F.regexp_extract(a, r"^([A-Z]{1,2}_?[A-Z]*[0-9]+)\.[0-9]+$", 1), F.regexp_extract(a, r"^[A-Z]{1,2}_?[A-Z]*[0-9]+\.([0-9]+)$", 1).try_cast("int")
    rows = accessions.select(a.alias("accession"), gi.alias("gi"), base.alias("base"), version.alias("version")).distinct()
    short, long = F.concat(F.lit("gi"), "gi"), F.concat(F.lit("GI:"), "gi")
    alias, edge = F.lit("is a reliable alias for"), lambda x, r, y: F.struct(x.alias("name1"), r.alias("reading"), y.alias("name2"))
    versioned = rows.where("base != ''")
    edges = rows.where("gi != ''").select(F.explode(F.array(edge(short, alias, long), edge(long, alias, short))).alias("e")).select("e.*")
    edges = edges.union(versioned.select("accession", F.lit("is a version of"), "base")).union(versioned.where("version > 1").select("accession", F.lit("is the version after"), F.concat("base", F.lit("."), F.col("version") - 1)))
    named = rows.where("gi != ''").select(F.explode(F.array(short, long)).alias("name"), F.lit("GI").alias("class_name"))
    kind = F.when(F.col("base").rlike("^[NX]M_"), "RNA").when(F.col("base").rlike("^[NX]P_"), "PROTEIN").when(F.col("base").rlike("^N[CGTW]_"), "GENOMIC")
    named = named.union(versioned.select(F.explode(F.array("accession", "base")).alias("name"), kind.alias("class_name")).where("class_name IS NOT NULL"))
    return edges.distinct(), named.distinct()
