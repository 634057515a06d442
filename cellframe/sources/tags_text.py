"""Tag sidecars and vocabulary files as text.

A tag line is ``cell<TAB>category[<TAB>confidence]``; lines starting with ``#``
are headers or notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import parse_vocab_header, strip_legacy_suffix, stripped
from ..schemas import TAG_KEY

FILE_PATTERN = r"([^/]+)/05_tiles/([^/]+)\.txt$"


def read_lines(spark: SparkSession, path: str, partitioned: bool) -> DataFrame:
    """(project, fov_id, value, at) of every line, ``at`` ordering the lines of a file.

    Large files stay splittable: within one split the row id grows line by
    line, and the split's offset orders the splits.
    """
    if partitioned:
        raw = spark.read.schema("value string, project string, fov_id string").text(path)
        who = [F.col("project"), F.col("fov_id")]
    else:
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
        file = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
        who = [F.regexp_extract(file, FILE_PATTERN, g).alias(n) for g, n in ((1, "project"), (2, "fov_id"))]
    at = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(*who, "value", at.alias("at"))


def parse_tag_lines(lines: DataFrame) -> DataFrame:
    """Tags from lines; the last line of a key wins, and an unreadable confidence counts as none."""
    parts = F.split("value", "\t", -1)
    rows = lines.where(~F.startswith("value", F.lit("#"))).withColumn("_p", parts)
    rows = rows.where(F.size("_p").isin(2, 3) & (F.get("_p", F.lit(0)) != ""))
    text = F.trim(F.get("_p", F.lit(2)))
    number = F.when(~text.rlike(r"(?i)[0-9.][df]$"), F.expr("try_cast(trim(get(_p, 2)) as double)"))
    rows = rows.select(
        "project",
        "fov_id",
        strip_legacy_suffix(F.get("_p", F.lit(0))).alias("cell_id"),
        F.get("_p", F.lit(1)).alias("category"),
        number.alias("confidence"),
        "at",
    )
    return rows.groupBy(*TAG_KEY).agg(
        F.max_by("category", "at").alias("category"),
        F.max_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("at"))).alias("confidence"),
    )


def read_tags(spark: SparkSession, path: str, partitioned: bool = True) -> DataFrame:
    return parse_tag_lines(read_lines(spark, path, partitioned))


def read_header_vocabulary(spark: SparkSession, path: str, partitioned: bool = True) -> DataFrame:
    """(project, fov_id, position, category) from ``#categories`` headers; the last header counts."""
    found = read_lines(spark, path, partitioned).withColumn("_v", parse_vocab_header("value")).where("_v is not null")
    last = found.groupBy("project", "fov_id").agg(F.max_by("_v", "at").alias("_v"))
    return last.select("project", "fov_id", F.posexplode("_v").alias("position", "category"))


def tag_lines(tags: DataFrame) -> DataFrame:
    line = F.concat_ws("\t", "cell_id", "category", F.format_string("%.4f", F.col("confidence")))
    plain = F.concat_ws("\t", "cell_id", "category")
    return tags.select(
        "project", "fov_id", "cell_id", F.when(F.col("confidence").isNull(), plain).otherwise(line).alias("value")
    )


def write_tags(tags: DataFrame, path: str, touched: DataFrame | None = None) -> None:
    """One folder per field of view, lines sorted by key.

    Fields of view in ``touched`` (project, fov_id) are written even if no tag
    is left: their file holds a bare ``#`` line then, and its old tags are gone.

    Rows are range-partitioned by the full key, so a field of view with very
    many tags becomes several files that follow each other in order.
    """
    lines = tag_lines(tags)
    if touched is not None:
        fov = ["project", "fov_id"]
        emptied = touched.select(*fov).distinct().join(tags.select(*fov).distinct(), fov, "left_anti")
        lines = lines.unionByName(emptied.withColumn("value", F.lit("#")), allowMissingColumns=True)
    lines = lines.repartitionByRange(*TAG_KEY).sortWithinPartitions(*TAG_KEY)
    lines.select("project", "fov_id", "value").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("project", "fov_id").text(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``project=…/`` folders of one name per line; blank and ``#`` lines don't count."""
    raw = spark.read.schema("value string, project string").text(path)
    name = stripped("value")
    at = F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = raw.select("project", name.alias("category"), F.startswith("value", F.lit("#")).alias("_note"), at.alias("at"))
    rows = rows.where((F.col("category") != "") & ~F.col("_note"))
    # A vocabulary is a short list by nature.
    pos = F.row_number().over(Window.partitionBy("project").orderBy("at"))
    return rows.select("project", pos.alias("position"), "category")


def write_vocab(vocab: DataFrame, path: str) -> None:
    ordered = vocab.repartitionByRange("project", "position").sortWithinPartitions("project", "position")
    ordered.select("project", F.col("category").alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("project").text(path)
