"""Registration and the derived tables the queries run on."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import cell_id_for
from ..session import materialize


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[["Views"], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Results carry whole numbers as BIGINT, as the SQL does."""
        out = self.build(Views(spark, sf_dir))
        whole = {f.name: F.col(f"`{f.name}`").cast("long") for f in out.schema.fields if isinstance(f.dataType, T.IntegerType)}
        return out.withColumns(whole) if whole else out


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the ``fx_`` views below."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, fn, None if sql is None else expand(sql))
        return fn

    return deco


def r6(col):
    return F.round(col.cast("double") if not isinstance(col, str) else F.col(col).cast("double"), 6)


def when_text(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# SQL twins of the DataFrames in ``Views``.
VIEW_SQL: dict[str, str] = {
    "fx_tiles": """SELECT concat('p', CAST((doc_id % 20) % 4 AS VARCHAR)) AS project, source AS fov_id,
        printf('%s_cell%05d', source, doc_id) AS cell_id, doc_id AS label, n_chars FROM documents""",
    "fx_tags": """SELECT t.project, t.fov_id, t.cell_id,
        CASE WHEN l.toxic = 1 THEN 'junk' WHEN l.quality = 1 THEN 'single' WHEN l.quality = 0 THEN 'two'
             WHEN t.n_chars % 4 = 0 THEN 'bud' WHEN t.n_chars % 4 = 1 THEN 'single'
             WHEN t.n_chars % 4 = 2 THEN 'tetrad' ELSE 'two' END AS category,
        CASE WHEN l.doc_id IS NULL THEN CAST(t.n_chars % 1000 AS DOUBLE) / 1000 END AS confidence
        FROM fx_tiles t LEFT JOIN labels l ON t.label = l.doc_id WHERE l.doc_id IS NOT NULL OR t.label % 3 = 0
        UNION ALL SELECT project, fov_id, concat(fov_id, '_cell', CAST(90000000 + label AS VARCHAR)), 'junk', NULL
        FROM fx_tiles WHERE label % 50 = 0""",
    "fx_pred": """SELECT project, fov_id, cell_id, label,
        CASE (label * 7 + n_chars) % 4 WHEN 0 THEN 'bud' WHEN 1 THEN 'single' WHEN 2 THEN 'tetrad' ELSE 'two' END AS pred,
        CAST(label * 31 % 1000 AS DOUBLE) / 1000 AS score FROM fx_tiles""",
    "fx_edits": """SELECT concat('p', CAST((user_id % 20) % 4 AS VARCHAR)) AS project,
        concat('src', CAST(user_id % 20 AS VARCHAR)) AS fov_id,
        printf('src%d_cell%05d', user_id % 20, user_id) AS cell_id,
        CASE WHEN event_type = 'signup' THEN '' WHEN event_id % 2 = 0 THEN 'single' ELSE 'two' END AS category,
        event_id AS seq FROM events WHERE event_type NOT IN ('view', 'error')""",
    "fx_names": """SELECT event_id, user_id % 10 AS fov,
        CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN concat(' ', event_type) ELSE event_type END AS name
        FROM events""",
    "fx_planes": """SELECT vec_id // 16 AS fov, vec_id % 16 AS z, vec_id, CAST(label AS BIGINT) AS class, embedding FROM embeddings""",
    "fx_pixels": """SELECT fov, z, vec_id, class, pos // 8 AS y, pos % 8 AS x, CAST(v AS DOUBLE) AS value FROM
        (SELECT fov, z, vec_id, class, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM fx_planes)""",
    "fx_counts": """SELECT fov, z, vec_id, y, x, round_even(CAST(value AS DOUBLE) * 1000, 0) + 1000 AS value FROM fx_pixels""",
    "fx_mask": """SELECT fov, z, vec_id, y, x, 1 + (y // 4) * 2 + (x // 4) AS label FROM fx_pixels WHERE value > 0.02""",
    "fx_files": """SELECT o_custkey % 10 AS project, CASE WHEN o_custkey % 10 = 3 AND substr(o_orderpriority, 1, 1) = '1' OR o_custkey % 10 = 4 AND substr(o_orderpriority, 1, 1) IN ('3', '4')
        THEN '05_tiles' ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'raw'
        WHEN '2' THEN '01_reduced' WHEN '3' THEN '02_denoised' WHEN '4' THEN '03_deconvolved' ELSE '05_tiles' END END AS stage,
        concat('s', CAST(o_custkey AS VARCHAR)) AS stem, max(o_orderdate) AS mtime, count(*) AS size
        FROM orders GROUP BY 1, 2, 3""",
    "fx_masks": """SELECT CASE l_partkey % 10 WHEN 5 THEN 15 ELSE l_partkey % 10 END AS project, concat('s', l_partkey) AS stem, max(l_shipdate) AS mtime
        FROM lineitem GROUP BY 1, 2""",
    "fx_overrides": """SELECT DISTINCT project, CASE project WHEN 1 THEN '01_reduced' WHEN 4 THEN '03_deconvolved' END AS override
        FROM fx_files""",
    "fx_epochs": """SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS epoch, max(l_extendedprice) AS avg_loss,
        max(1 - l_discount) AS val_accuracy,
        CASE WHEN l_linenumber % 2 = 0 AND l_orderkey % 3 > 0 THEN max(1 - l_tax) END AS knn_accuracy
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "fx_provenance": """SELECT DISTINCT l_suppkey AS container, l_partkey AS label FROM lineitem WHERE l_returnflag <> 'R'""",
    "fx_candidates": """SELECT DISTINCT l_suppkey AS container, l_partkey AS label FROM lineitem WHERE l_returnflag <> 'A'""",
    "fx_tag_events": """SELECT user_id AS tile, ts, event_id,
        CASE WHEN event_type IN ('view', 'error') THEN 'ai' ELSE 'human' END AS actor,
        CASE WHEN event_type = 'signup' THEN '' WHEN event_id % 2 = 0 THEN 'single' ELSE 'two' END AS category,
        CASE WHEN event_type IN ('view', 'error') THEN value / 1000 END AS confidence FROM events""",
    "fx_vecs": """SELECT vec_id, concat('p', CAST((vec_id % 20) % 4 AS VARCHAR)) AS project,
        concat('src', CAST(vec_id % 20 AS VARCHAR)) AS fov_id, printf('src%d_cell%05d', vec_id % 20, vec_id) AS cell_id,
        embedding, concat('c', CAST(label AS VARCHAR)) AS truth FROM embeddings""",
    "fx_vec_tags": """SELECT project, fov_id, cell_id, truth AS category,
        CASE WHEN vec_id % 3 = 1 THEN CAST(vec_id % 100 AS DOUBLE) / 100 END AS confidence
        FROM fx_vecs WHERE vec_id % 3 < 2""",
}


def expand(sql: str) -> str:
    """Prepend the views a statement names, and those they name in turn."""
    needed: list[str] = []

    def visit(text):
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEW_SQL and name not in needed:
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    body = sql.strip()
    if body.startswith("WITH fx_"):  # expanded already, taken over from another query
        return body
    visit(sql)
    if not needed:
        return body
    heads = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


class Views:
    """The driver's tables seen as tiles, tags, planes, files and so on.

    Keys of related tables are computed rather than joined where a row carries
    all they need; fields of view hold sixteen planes each, so stacks stay
    bounded while their number grows with the data.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _project(i):
        return F.concat(F.lit("p"), (F.col(i) % 20 % 4).cast("string"))

    @staticmethod
    def _fov(i):
        return F.concat(F.lit("src"), (F.col(i) % 20).cast("string"))

    @cached_property
    def tiles(self):
        return self.table("documents").select(
            self._project("doc_id").alias("project"),
            F.col("source").alias("fov_id"),
            cell_id_for("source", "doc_id").alias("cell_id"),
            F.col("doc_id").alias("label"),
            "n_chars",
        )

    @cached_property
    def tags(self):
        t = self.tiles
        lab = self.table("labels")
        j = t.join(lab, t["label"] == lab["doc_id"], "left")
        m = F.col("n_chars") % 4
        category = (
            F.when(F.col("toxic") == 1, "junk")
            .when(F.col("quality") == 1, "single")
            .when(F.col("quality") == 0, "two")
            .when(m == 0, "bud")
            .when(m == 1, "single")
            .when(m == 2, "tetrad")
            .otherwise("two")
        )
        confidence = F.when(F.col("doc_id").isNull(), (F.col("n_chars") % 1000).cast("double") / 1000)
        live = j.where(F.col("doc_id").isNotNull() | (F.col("label") % 3 == 0)).select(
            "project", "fov_id", "cell_id", category.alias("category"), confidence.alias("confidence")
        )
        orphans = t.where(F.col("label") % 50 == 0).select(
            "project",
            "fov_id",
            F.concat("fov_id", F.lit("_cell"), (F.col("label") + 90000000).cast("string")).alias("cell_id"),
            F.lit("junk").alias("category"),
            F.lit(None).cast("double").alias("confidence"),
        )
        return live.unionByName(orphans)

    @cached_property
    def pred(self):
        m = (F.col("label") * 7 + F.col("n_chars")) % 4
        return self.tiles.select(
            "project", "fov_id", "cell_id", "label",
            F.when(m == 0, "bud").when(m == 1, "single").when(m == 2, "tetrad").otherwise("two").alias("pred"),
            ((F.col("label") * 31 % 1000).cast("double") / 1000).alias("score"),
        )

    @cached_property
    def pred_tags(self):
        return self.pred.select(
            "project", "fov_id", "cell_id", F.col("pred").alias("category"), F.col("score").alias("confidence")
        )

    @staticmethod
    def _event_category():
        return (
            F.when(F.col("event_type") == "signup", "")
            .when(F.col("event_id") % 2 == 0, "single")
            .otherwise("two")
        )

    @cached_property
    def edits(self):
        e = self.table("events").where(~F.col("event_type").isin("view", "error"))
        return e.select(
            self._project("user_id").alias("project"),
            self._fov("user_id").alias("fov_id"),
            cell_id_for(self._fov("user_id"), "user_id").alias("cell_id"),
            self._event_category().alias("category"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def names(self):
        m = F.col("event_id") % 3
        return self.table("events").select(
            "event_id",
            (F.col("user_id") % 10).alias("fov"),
            F.when(m == 0, F.upper("event_type"))
            .when(m == 1, F.concat(F.lit(" "), F.col("event_type")))
            .otherwise(F.col("event_type"))
            .alias("name"),
        )

    @cached_property
    def planes(self):
        """Each 64-float vector as an 8x8 plane; sixteen in a row make a stack."""
        return self.table("embeddings").select(
            F.floor(F.col("vec_id") / 16).alias("fov"),
            (F.col("vec_id") % 16).alias("z"),
            "vec_id",
            F.col("label").alias("class"),
            F.lit(8).alias("height"),
            F.lit(8).alias("width"),
            F.transform("embedding", lambda v: v.cast("double")).alias("values"),
        )

    @cached_property
    def count_planes(self):
        """The same planes as whole camera counts."""
        return self.planes.withColumn("values", F.transform("values", lambda v: F.rint(v * 1000) + 1000))

    @cached_property
    def pixels(self):
        from ..operators.images import explode_pixels

        return explode_pixels(self.planes, ["fov", "z", "vec_id", "class"]).drop("height", "width", "values")

    @cached_property
    def mask(self):
        quadrant = 1 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)
        return self.pixels.where(F.col("value") > 0.02).select(
            "fov", "z", "vec_id", "y", "x", quadrant.cast("int").alias("label")
        )

    @cached_property
    def stored_files(self):
        """The manifest as the stored table it is in practice, for jobs that read it many times."""
        return materialize(self.files, "files")

    @cached_property
    def files(self):
        p = F.substring("o_orderpriority", 1, 1)
        project = F.col("o_custkey") % 10
        stage = (
            F.when(p == "1", "raw")
            .when(p == "2", "01_reduced")
            .when(p == "3", "02_denoised")
            .when(p == "4", "03_deconvolved")
            .otherwise("05_tiles")
        )
        # one project without raw files, one without some of its stages
        stage = F.when(((project == 3) & (p == "1")) | ((project == 4) & p.isin("3", "4")), "05_tiles").otherwise(stage)
        return self.table("orders").groupBy(
            project.alias("project"), stage.alias("stage"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("stem")
        ).agg(F.max("o_orderdate").alias("mtime"), F.count(F.lit(1)).alias("size"))

    @cached_property
    def masks(self):
        """Masks of every part's stem; those of project 5 went to a project without files."""
        p = F.col("l_partkey") % 10
        stem = F.concat(F.lit("s"), F.col("l_partkey").cast("string"))
        return self.table("lineitem").groupBy(F.when(p == 5, 15).otherwise(p).alias("project"), stem.alias("stem")).agg(
            F.max("l_shipdate").alias("mtime")
        )

    @cached_property
    def overrides(self):
        o = F.when(F.col("project") == 1, "01_reduced").when(F.col("project") == 4, "03_deconvolved")
        return self.files.select("project").distinct().withColumn("override", o)

    @cached_property
    def epochs(self):
        li = self.table("lineitem")
        scored = (F.col("l_linenumber") % 2 == 0) & (F.col("l_orderkey") % 3 > 0)
        return (
            li.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("epoch"))
            .agg(
                F.max("l_extendedprice").alias("avg_loss"),
                F.max(1 - F.col("l_discount")).alias("val_accuracy"),
                F.max(F.when(scored, 1 - F.col("l_tax"))).alias("knn_accuracy"),
            )
        )

    def _lineitem_pairs(self, other):
        """Lines with flag N are on both sides, those with A and R on one each."""
        li = self.table("lineitem").where(F.col("l_returnflag") != other)
        return li.select(F.col("l_suppkey").alias("container"), F.col("l_partkey").alias("label")).distinct()

    @cached_property
    def provenance(self):
        return self._lineitem_pairs("R")

    @cached_property
    def candidates(self):
        return self._lineitem_pairs("A")

    @cached_property
    def tag_events(self):
        return self.as_tag_events(self.table("events"))

    def as_tag_events(self, events: DataFrame) -> DataFrame:
        ai = F.col("event_type").isin("view", "error")
        return events.select(
            F.col("user_id").alias("tile"),
            "ts",
            "event_id",
            F.when(ai, "ai").otherwise("human").alias("actor"),
            self._event_category().alias("category"),
            F.when(ai, F.col("value") / 1000).alias("confidence"),
        )

    @cached_property
    def vecs(self):
        return self.table("embeddings").select(
            "vec_id",
            self._project("vec_id").alias("project"),
            self._fov("vec_id").alias("fov_id"),
            cell_id_for(self._fov("vec_id"), "vec_id").alias("cell_id"),
            "embedding",
            F.concat(F.lit("c"), F.col("label").cast("string")).alias("truth"),
        )

    @cached_property
    def vec_tags(self):
        return self.vecs.where(F.col("vec_id") % 3 < 2).select(
            "project",
            "fov_id",
            "cell_id",
            F.col("truth").alias("category"),
            F.when(F.col("vec_id") % 3 == 1, (F.col("vec_id") % 100).cast("double") / 100).alias("confidence"),
        )
