"""Sources and sinks: annotations, sequences, taxonomies, groups, manifests and tables as text files.

Order is data in several of these files, so readers that need it return ``ord``: the file of a line,
the byte at which its split of the file starts, and its number among the lines of the task. Lines
compare by it as they stand, in files in the order of their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spanwright.functions import expr as E


def _lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).text(path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``ord, value`` of the lines of text files; ``ord`` compares as the lines stand."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    return spark.read.text(path).select(at.alias("ord"), "value")


def intervals(lines: DataFrame, kind: str | None = None) -> DataFrame:
    """Annotation lines (``value``) as intervals; comments, blank and short lines are left out."""
    df = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    df = df.withColumn("f", F.split("value", "\t")).where(F.size("f") >= 9)
    names = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
    columns = [F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)]
    df = df.select(*columns).withColumns({"start": F.col("start").try_cast("bigint"), "end": F.col("end").try_cast("bigint")})
    return df.where(F.col("type") == kind) if kind else df


def read_intervals(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """All ``*.gff3`` files below a folder, read as text since quotes belong to attributes."""
    return intervals(_lines(spark, path, "*.gff3"), kind)


def read_sequences(spark: SparkSession, path: str, upper: bool = False, glob: str | None = None) -> DataFrame:
    """``header, id, seq`` of FASTA records, plain or gzipped; records without sequence stay, empty."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n>")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    record = F.ltrim(F.regexp_replace("value", "^>", ""))
    body = F.when(F.instr(record, "\n") > 0, F.substr(record, F.instr(record, "\n") + 1)).otherwise("")
    seq = F.regexp_replace(body, r"\s", "")
    df = df.where(F.trim("value") != "").select(F.substring_index(record, "\n", 1).alias("header"), (F.upper(seq) if upper else seq).alias("seq"))
    return df.select("header", F.get(F.split("header", r"\s+"), F.lit(0)).alias("id"), "seq")


def taxonomy(lines: DataFrame) -> DataFrame:
    """``gca, speci, label`` of lines (``ord, value``); the last line of an accession wins."""
    df = lines.where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 4)
    f = lambda i: F.trim(F.coalesce(F.get("f", F.lit(i)), F.lit("")))
    df = df.select("ord", f(0).alias("gca"), f(1).alias("speci"), F.trim(F.concat_ws(" ", f(3), f(4))).alias("label"))
    return df.groupBy("gca").agg(F.max_by(F.struct("speci", "label"), "ord").alias("x")).select("gca", "x.*")


def validate_columns(lines: DataFrame, n: int = 4) -> DataFrame:
    """How many data lines there are, and how many have fewer than n columns."""
    df = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return df.agg(F.count("*").alias("n_lines"), F.count_if(F.size(F.split("value", "\t")) < n).alias("n_short"))


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Names and edges of similarity tables: rows with a blank name are dropped, those whose numbers do not parse give names only."""
    columns = ("Ref_file", "Query_file", "ANI", "Align_fraction_ref", "Align_fraction_query")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="")
    return split_pairs(df)


def split_pairs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    df = df.where((F.trim(F.coalesce("Ref_file", F.lit(""))) != "") & (F.trim(F.coalesce("Query_file", F.lit(""))) != ""))
    names = df.select(F.explode(F.array("Ref_file", "Query_file")).alias("name")).distinct()
    number = lambda c: F.col(c).try_cast("double")
    edges = df.select(F.col("Ref_file").alias("a"), F.col("Query_file").alias("b"), number("ANI").alias("ani"), number("Align_fraction_ref").alias("af_ref"), number("Align_fraction_query").alias("af_query"))
    return names, edges.where(F.col("ani").isNotNull() & F.col("af_ref").isNotNull() & F.col("af_query").isNotNull())


def membership(lines: DataFrame) -> DataFrame:
    """``member, rep`` of lines (``ord, value``); the last line of a member wins."""
    df = lines.withColumn("f", F.split("value", "\t")).where(F.size("f") >= 2)
    df = df.select("ord", F.trim(F.get("f", F.lit(0))).alias("rep"), F.trim(F.get("f", F.lit(1))).alias("member"))
    return df.groupBy("member").agg(F.max_by("rep", "ord").alias("rep"))


def _tokens(lines: DataFrame) -> DataFrame:
    """``group_no, pos, token``: non-blank lines are groups, numbered 1.. in file order."""
    full = lines.where(F.trim("value") != "").select("ord.*", "value")
    # Lines are numbered within a split of a file; splits, of which there are few, carry the sums of those before
    splits = full.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = splits.select("file", "start", (F.sum("n").over(W.orderBy("file", "start")) - F.col("n")).alias("base"))
    placed = full.withColumn("i", F.row_number().over(W.partitionBy("file", "start").orderBy("nth"))).join(before, ["file", "start"])
    return placed.select((F.col("base") + F.col("i")).cast("bigint").alias("group_no"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "token"))


def duplicate_groups(lines: DataFrame) -> DataFrame:
    """``group_no, member`` of duplicate-group lines; a member counts once in a line."""
    return _tokens(lines).select("group_no", F.regexp_replace("token", "^[+-]+", "").alias("member")).distinct()


def orientation(lines: DataFrame) -> DataFrame:
    """``member, sign``: ``+`` or ``-`` of each id, unsigned is ``-``; the last occurrence wins."""
    df = _tokens(lines).select(F.struct("group_no", "pos").alias("at"), F.regexp_replace("token", "^[+-]+", "").alias("member"), F.when(F.col("token").startswith("+"), "+").otherwise("-").alias("sign"))
    return df.groupBy("member").agg(F.max_by("sign", "at").alias("sign"))


def last_status(manifest: DataFrame) -> DataFrame:
    """``genome_key, status``: the last status of each key."""
    return manifest.groupBy("genome_key").agg(F.max_by("status", "ord").alias("status"))


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, sep="\t", quote="")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table with a header; ``NA`` and empty cells are null."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="NA", quote="", emptyValue="")


def write_table(df: DataFrame, path: str) -> None:
    """A table with a header; null is ``NA``."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA", quote="", emptyValue="")


def write_flanks(df: DataFrame, path: str) -> None:
    """Windows as Parquet, a folder for each type, cluster and group; a group's rows stay in few files."""
    df.repartition("rec_type", "cluster_number", "group_dir").write.mode("overwrite").partitionBy("rec_type", "cluster_number", "group_dir").parquet(path)


def read_flank_tree(spark: SparkSession, path: str, rec_types: str | None = None, singletons: bool = False) -> DataFrame:
    """Windows of duplicate groups, with their group numbers; types and singletons are pruned by folder."""
    df = spark.read.parquet(path).where(E.rec_type_subset(F.col("rec_type"), rec_types))
    df = df if singletons else df.where(F.col("group_dir") != "singleton")
    return df.withColumn("group_no", F.regexp_extract("group_dir", r"(\d+)$", 1).try_cast("bigint"))


def write_sequences(df: DataFrame, path: str, compression: str = "none") -> None:
    """FASTA records of ``id, seq``, each id once."""
    record = F.concat(F.lit(">"), F.col("id"), F.lit("\n"), F.col("seq"))
    df.groupBy("id").agg(F.min("seq").alias("seq")).select(record.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def position_scores(rows: DataFrame, rec_types: DataFrame) -> DataFrame:
    """Keys of score files by their names: the longest known type, the side at the end, the rest is the id.

    ``rows`` has ``name`` and further columns; ``rec_types`` has ``rec_type``. Every beginning of a name
    that ends before an underscore is looked up, so it is a join of equal names.
    """
    stem = F.regexp_replace("name", r"\.tsv$", "")
    df = rows.withColumn("stem", stem).withColumn("side", F.regexp_extract("stem", "_(left|right)$", 1)).where(F.col("side") != "")
    names = df.select("stem").distinct()
    parts = F.split("stem", "_")
    begun = names.select("stem", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "_"))).alias("rec_type"))
    best = begun.join(rec_types, "rec_type").groupBy("stem").agg(F.max_by("rec_type", F.length("rec_type")).alias("rec_type"))
    df = df.join(best, "stem")
    start = F.length("rec_type") + 2
    return df.withColumn("mge_id", F.substr("stem", start, F.length("stem") - F.length("side") - start)).drop("stem", "name")
