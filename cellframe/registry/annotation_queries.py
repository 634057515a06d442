"""Names, tags, vocabularies, pools and class reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as nm
from ..operators import analytics, pool, ranking, tags, vocab
from .core import Views, query, r6

VOCABULARY = ["bud", "single", "tetrad", "two"]
KEY = ["project", "fov_id", "cell_id"]

# --- names ----------------------------------------------------------------------


@query(
    "container_and_cell",
    "SELECT page_id, regexp_extract(url, '^(.*)/([^/]*)$', 1) AS container, "
    "regexp_extract(url, '^(.*)/([^/]*)$', 2) AS cell FROM pages",
)
def _(v: Views):
    return v.table("pages").select("page_id", nm.container_of("url").alias("container"), nm.cell_of("url").alias("cell"))


@query(
    "tile_display_name",
    """SELECT label, concat(fov_id, ' · cell ', CAST(label AS VARCHAR)) AS shown,
       concat('cell ', CAST(label AS VARCHAR)) AS short, fov_id AS other FROM fx_tiles""",
)
def _(v: Views):
    return v.tiles.select(
        "label",
        nm.tile_display_name("cell_id").alias("shown"),
        nm.tile_display_name("cell_id", with_fov=False).alias("short"),
        nm.tile_display_name("fov_id").alias("other"),
    )


@query("cell_id_for", "SELECT doc_id, printf('%s_cell%05d', source, doc_id) AS cell_id FROM documents")
def _(v: Views):
    return v.table("documents").select("doc_id", nm.cell_id_for("source", "doc_id").alias("cell_id"))


@query("category_key", "SELECT event_id, lower(trim(name)) AS key FROM fx_names")
def _(v: Views):
    return v.names.select("event_id", nm.category_key("name").alias("key"))


@query(
    "natural_sort_key",
    """SELECT c_custkey, concat('customer#|', printf('%04d', length(CAST(CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS VARCHAR))),
       CAST(CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS VARCHAR)) AS sort_key FROM customer""",
)
def _(v: Views):
    return v.table("customer").select("c_custkey", F.array_join(nm.natural_key("c_name"), "|").alias("sort_key"))


@query(
    "filter_by_fov",
    "SELECT cell_id FROM fx_tiles WHERE starts_with(cell_id, 'src1_cell') OR starts_with(cell_id, 'src7_cell')",
)
def _(v: Views):
    return v.tiles.where(nm.in_fovs("cell_id", ["src1", "src7"])).select("cell_id")


@query(
    "strip_legacy_suffix",
    "SELECT label, concat(fov_id, '.tiles/', cell_id) AS key FROM fx_tiles",
)
def _(v: Views):
    old = F.concat(
        "fov_id", F.lit(".tiles/"), "cell_id", F.when(F.col("label") % 2 == 1, ".tif").otherwise("")
    )
    return v.tiles.select("label", nm.strip_legacy_suffix(old).alias("key"))


@query(
    "tag_source",
    """SELECT t.cell_id, CASE WHEN g.category IS NULL THEN '' WHEN g.confidence IS NULL THEN 'human' ELSE 'ai' END AS source
       FROM fx_tiles t LEFT JOIN fx_tags g USING (project, fov_id, cell_id)""",
)
def _(v: Views):
    return tags.tag_tiles(v.tiles, v.tags).select("cell_id", nm.tag_source("category", "confidence").alias("source"))


@query(
    "parse_vocab_header",
    """SELECT doc_id, concat_ws('|', 'single', 'two', source) AS names FROM documents WHERE doc_id % 4 < 3
       UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 4 = 3""",
)
def _(v: Views):
    m = F.col("doc_id") % 4
    line = (
        F.when(m == 0, F.concat(F.lit("#categories\tsingle\ttwo\t"), "source"))
        .when(m == 1, F.concat(F.lit("#categories: single, two ,"), "source"))
        .when(m == 2, F.concat(F.lit("#categories single  two "), "source"))
        .otherwise(F.concat(F.lit("#categoriesX single "), "source"))
    )
    return v.table("documents").select("doc_id", F.array_join(nm.parse_vocab_header(line), "|").alias("names"))


@query(
    "channel_name_class",
    """SELECT p_partkey, (list_contains(regexp_extract_all(lower(p_name), '[a-z]+'), 'ring') OR contains(lower(p_name), 'widget')) AS is_bright,
       (list_contains(regexp_extract_all(lower(p_name), '[a-z]+'), 'old')) AS is_target FROM part""",
)
def _(v: Views):
    return v.table("part").select(
        "p_partkey",
        nm.channel_name_matches("p_name", ("ring", "widget")).alias("is_bright"),
        nm.channel_name_matches("p_name", ("old",)).alias("is_target"),
    )


# --- tags against tiles -----------------------------------------------------------


@query(
    "tag_tiles",
    """SELECT t.project, t.fov_id, t.cell_id, t.label, g.category, g.confidence
       FROM fx_tiles t LEFT JOIN fx_tags g USING (project, fov_id, cell_id)""",
)
def _(v: Views):
    return tags.tag_tiles(v.tiles, v.tags).select(*KEY, "label", "category", "confidence")


@query(
    "unlabeled",
    """SELECT t.project, t.fov_id, t.cell_id FROM fx_tiles t WHERE NOT EXISTS (SELECT 1 FROM fx_tags g
       WHERE g.project = t.project AND g.fov_id = t.fov_id AND g.cell_id = t.cell_id AND g.confidence IS NULL)""",
)
def _(v: Views):
    return tags.unlabeled(v.tiles, v.tags).select(*KEY)


@query(
    "confirmed_records",
    """SELECT project, fov_id, cell_id, category FROM fx_tags WHERE confidence IS NULL
       AND fov_id IN (SELECT fov_id FROM fx_tiles WHERE project <> 'p3')""",
)
def _(v: Views):
    return tags.confirmed_records(v.tags, v.tiles.where("project <> 'p3'").select("project", "fov_id"))


@query(
    "filter_category",
    """SELECT t.cell_id, 'none' AS shown FROM fx_tiles t LEFT JOIN fx_tags g USING (project, fov_id, cell_id)
       WHERE g.category IS NULL UNION ALL
       SELECT t.cell_id, 'two' FROM fx_tiles t JOIN fx_tags g USING (project, fov_id, cell_id) WHERE g.category = 'two'""",
)
def _(v: Views):
    t = tags.tag_tiles(v.tiles, v.tags)
    none = tags.filter_category(t, "").select("cell_id", F.lit("none").alias("shown"))
    return none.unionByName(tags.filter_category(t, "two").select("cell_id", F.lit("two").alias("shown")))


@query(
    "tile_report",
    """SELECT t.project, t.fov_id AS fov, t.label AS cell, coalesce(g.category, '') AS category,
       CASE WHEN g.category IS NULL THEN '' WHEN g.confidence IS NULL THEN 'human' ELSE 'ai' END AS source,
       CASE WHEN g.confidence IS NULL THEN '' ELSE printf('%.4f', g.confidence) END AS confidence
       FROM fx_tiles t LEFT JOIN fx_tags g USING (project, fov_id, cell_id)""",
)
def _(v: Views):
    return tags.tile_report(v.tiles, v.tags)


@query("usage_count", "SELECT project, count(*) AS n_tags FROM fx_tags WHERE category = 'junk' GROUP BY 1")
def _(v: Views):
    return tags.usage_count(v.tags, "junk")


@query(
    "tagged_items",
    "SELECT concat(project, '/', fov_id, '.tiles/', cell_id) AS path, category, confidence FROM fx_tags",
)
def _(v: Views):
    return tags.tagged_items(v.tags)


@query(
    "route_to_owner",
    """SELECT page_id, CASE
         WHEN url IS NULL OR NOT starts_with(url, 'https://') THEN NULL
         WHEN split_part(url, '/', 4) IN ('fr', 'de') AND split_part(url, '/', 5) <> '' THEN concat_ws('/', 'https:', '', split_part(url, '/', 3), split_part(url, '/', 4))
         WHEN split_part(url, '/', 3) LIKE '%.com' THEN concat('https://', split_part(url, '/', 3)) END AS owner
       FROM pages""",
)
def _(v: Views):
    # Owners are folders of https sites; every page is routed.
    pages = v.table("pages").select("page_id", F.col("url").alias("path"))
    secure = pages.where(F.startswith("path", F.lit("https://")))
    parts = F.split("path", "/")
    host = F.concat(F.lit("https://"), F.get(parts, F.lit(2)))
    sites = secure.where(F.get(parts, F.lit(2)).endswith(".com")).select(host.alias("folder"))
    deep = secure.where(F.get(parts, F.lit(3)).isin("fr", "de")).select(
        F.concat(host, F.lit("/"), F.get(parts, F.lit(3))).alias("folder")
    )
    return pool.route_to_owner(pages, sites.union(deep)).select("page_id", "owner")


@query(
    "label_points",
    """SELECT v.vec_id, coalesce(g.category, 'unlabeled') AS category FROM fx_vecs v
       LEFT JOIN (SELECT * FROM fx_vec_tags WHERE confidence IS NULL) g USING (project, fov_id, cell_id)""",
)
def _(v: Views):
    from ..operators.embeddings import label_points

    return label_points(v.vecs, tags.confirmed_records(v.vec_tags), KEY).select("vec_id", "category")


@query(
    "label_legend",
    """SELECT coalesce(g.category, 'unlabeled') AS category, count(*) AS n FROM fx_vecs v
       LEFT JOIN (SELECT * FROM fx_vec_tags WHERE confidence IS NULL) g USING (project, fov_id, cell_id) GROUP BY 1""",
)
def _(v: Views):
    from ..operators.embeddings import label_legend, label_points

    return label_legend(label_points(v.vecs, tags.confirmed_records(v.vec_tags), KEY))


# --- tallies ----------------------------------------------------------------------

_TAGGED = "fx_tiles t LEFT JOIN fx_tags g USING (project, fov_id, cell_id)"


@query(
    "fov_tally",
    f"""SELECT t.project, t.fov_id, count(*) AS n_tiles, count(g.category) AS n_tagged,
       count(CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN 1 END) AS n_human, count(CASE WHEN g.category IS NULL THEN 1 END) AS untagged
       FROM {_TAGGED} GROUP BY 1, 2""",
)
def _(v: Views):
    return pool.fov_tally(v.tiles, v.tags)


@query(
    "pool_summary",
    f"""SELECT project, fov_id, category, count(*) AS n_tiles, count(CASE WHEN human THEN 1 END) AS n_human FROM (
         SELECT t.project, t.fov_id, coalesce(g.category, '(untagged)') AS category,
           (g.category IS NOT NULL AND g.confidence IS NULL) AS human FROM {_TAGGED})
       GROUP BY ROLLUP (project, fov_id, category)""",
)
def _(v: Views):
    return pool.pool_summary(v.tiles, v.tags)


@query(
    "category_count_map",
    f"""SELECT project, fov_id, string_agg(concat(category, '=', n), ',' ORDER BY category) AS counts FROM (
         SELECT t.project, t.fov_id, g.category, count(*) AS n FROM {_TAGGED} WHERE g.category IS NOT NULL GROUP BY 1, 2, 3)
       GROUP BY 1, 2""",
)
def _(v: Views):
    m = pool.category_count_map(v.tiles, v.tags)
    shown = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("project", "fov_id", F.array_join(shown, ",").alias("counts"))


@query(
    "annotation_stats",
    f"""WITH c AS (SELECT g.category, count(*) AS n, count(CASE WHEN g.confidence IS NULL THEN 1 END) AS h FROM {_TAGGED}
           WHERE g.category IS NOT NULL GROUP BY 1),
       names AS (SELECT unnest(['bud', 'single', 'tetrad', 'two', 'unused']) AS category UNION SELECT category FROM c)
       SELECT category, coalesce(n, 0) AS n_tiles, round(100.0 * coalesce(n, 0) / (SELECT sum(n) FROM c), 6) AS percent,
         coalesce(h, 0) AS n_human FROM names LEFT JOIN c USING (category)
       UNION ALL SELECT 'Un-annotated', count(CASE WHEN g.category IS NULL THEN 1 END), NULL, NULL FROM {_TAGGED}""",
)
def _(v: Views):
    return pool.annotation_stats(v.tiles, v.tags, [*VOCABULARY, "unused"]).select(
        "category", "n_tiles", r6("percent").alias("percent"), "n_human"
    )


_CATS = ["bud", "single", "tetrad", "two", "junk"]
_PIVOT = ", ".join(f"count(CASE WHEN g.category = '{c}' THEN 1 END) AS {c}" for c in _CATS)


@query(
    "results_table",
    f"""WITH r AS (SELECT t.project, t.fov_id AS fov, count(*) AS tiles, {_PIVOT}, count(CASE WHEN g.category IS NULL THEN 1 END) AS unclassified,
         count(CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN 1 END) AS human_set FROM {_TAGGED} GROUP BY 1, 2)
       SELECT * FROM r UNION ALL SELECT '', concat('All ', count(*), ' FOV(s)'), CAST(sum(tiles) AS BIGINT),
         {", ".join(f"CAST(sum({c}) AS BIGINT)" for c in _CATS)}, CAST(sum(unclassified) AS BIGINT), CAST(sum(human_set) AS BIGINT) FROM r""",
)
def _(v: Views):
    return pool.results_table(v.tiles, v.tags, VOCABULARY)


@query(
    "results_long",
    f"""WITH r AS (SELECT t.project, t.fov_id AS fov, g.category, count(*) AS n, count(CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN 1 END) AS n_human
         FROM {_TAGGED} GROUP BY 1, 2, 3)
       SELECT * FROM r UNION ALL SELECT '', '', category, CAST(sum(n) AS BIGINT), CAST(sum(n_human) AS BIGINT) FROM r GROUP BY category""",
)
def _(v: Views):
    return pool.results_long(v.tiles, v.tags)


@query(
    "checked_fovs",
    """SELECT DISTINCT project, fov_id FROM fx_tiles WHERE project IN ('p0', 'p1', 'p2')
       AND fov_id NOT IN (SELECT fov_id FROM fx_tags WHERE category = 'tetrad' AND confidence < 0.1)""",
)
def _(v: Views):
    roots = v.tiles.select("project").where("project <> 'p3'").distinct()
    left_out = v.tags.where("category = 'tetrad' and confidence < 0.1").select(
        F.lit("train").alias("scope"), "project", "fov_id"
    ).distinct()
    return pool.checked_fovs(v.tiles, roots, left_out, "train")


@query(
    "pool_membership",
    """SELECT 'root' AS kind, project, '' AS fov_id FROM (SELECT DISTINCT project FROM fx_tiles WHERE project <> 'p1' UNION SELECT 'new')
       UNION ALL SELECT 'excluded', project, fov_id FROM (SELECT DISTINCT project, fov_id FROM fx_tiles
         WHERE project <> 'p1' AND (project = 'p0' OR fov_id IN ('src2', 'src7')) AND fov_id <> 'src4')""",
)
def _(v: Views):
    fovs = v.tiles.select("project", "fov_id").distinct()
    out = fovs.where("project in ('p0', 'p1')").withColumn("scope", F.lit("train"))
    out = pool.set_included(out, "train", fovs.where("fov_id in ('src2', 'src7')"), False)
    out = pool.set_included(out, "train", fovs.where("fov_id = 'src4'"), True)
    roots, out = pool.remove_project(fovs.select("project").distinct(), out, "p1")
    roots = pool.add_project(roots, "new")
    a = roots.select(F.lit("root").alias("kind"), "project", F.lit("").alias("fov_id"))
    return a.unionByName(out.select(F.lit("excluded").alias("kind"), "project", "fov_id"))


# --- class shares -----------------------------------------------------------------

# The last digit of a field-of-view name stands for its condition; src13 is left out.
_FOVS = """fovs AS (SELECT DISTINCT project, fov_id, fov_id <> 'src13' AS include,
    CASE WHEN fov_id = 'src5' THEN '99' ELSE regexp_extract(fov_id, '([0-9])$', 1) END AS variable FROM fx_tiles)"""


def _fov_map(v: Views):
    fovs = v.tiles.select("project", "fov_id").distinct().select(
        "project",
        "fov_id",
        (F.col("fov_id") != "src13").alias("include"),
        F.lit(None).cast("string").alias("index"),
        F.when(F.col("fov_id") == "src5", "99").otherwise("").alias("variable"),
    )
    return analytics.extract_variable(fovs, "([0-9])$")


@query(
    "extract_variable",
    f"""WITH {_FOVS} SELECT project, fov_id, include, CASE WHEN include THEN regexp_extract(fov_id, '([0-9])$', 1) END AS idx,
       CASE WHEN include THEN variable ELSE '' END AS variable FROM fovs""",
)
def _(v: Views):
    return _fov_map(v).select("project", "fov_id", "include", F.col("index").alias("idx"), "variable")


@query(
    "coerce_variable",
    f"WITH {_FOVS} SELECT project, fov_id, CAST(variable AS DOUBLE) AS variable, concat('v', variable) AS text FROM fovs WHERE include",
)
def _(v: Views):
    fovs = _fov_map(v).where("include").select("project", "fov_id", "variable", F.concat(F.lit("v"), "variable").alias("text"))
    return analytics.coerce_variable(analytics.coerce_variable(fovs), "text")


@query(
    "class_share",
    f"""WITH {_FOVS}, c AS (SELECT CAST(variable AS DOUBLE) AS variable, category, count(*) AS n FROM fx_tags
         JOIN fovs USING (project, fov_id) WHERE include AND category IN ('single', 'two', 'bud', 'tetrad') GROUP BY 1, 2)
       SELECT variable, category, n, round(100.0 * n / sum(n) OVER (PARTITION BY variable), 6) AS percentage FROM c""",
)
def _(v: Views):
    fovs = analytics.coerce_variable(_fov_map(v).where("include"))
    return analytics.class_share(v.tags, fovs, categories=VOCABULARY).withColumn("percentage", r6("percentage"))


@query(
    "variable_totals",
    f"""WITH {_FOVS} SELECT variable, count(*) AS total_count FROM fx_tags JOIN fovs USING (project, fov_id)
        WHERE include AND confidence IS NULL GROUP BY 1""",
)
def _(v: Views):
    return analytics.variable_totals(v.tags, _fov_map(v), confirmed_only=True)


@query(
    "fov_class_share",
    f"""WITH {_FOVS}, c AS (SELECT project, fov_id AS fov, variable, category, count(*) AS count FROM fx_tags
         JOIN fovs USING (project, fov_id) WHERE include GROUP BY 1, 2, 3, 4)
       SELECT *, round(100.0 * count / sum(count) OVER (PARTITION BY project, fov), 6) AS percentage FROM c""",
)
def _(v: Views):
    return analytics.fov_class_share(v.tags, _fov_map(v)).withColumn("percentage", r6("percentage"))


# --- vocabularies -----------------------------------------------------------------


@query(
    "duplicate_categories",
    """SELECT lower(trim(name)) AS key, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM fx_names GROUP BY 1
       HAVING count(DISTINCT name) > 1""",
)
def _(v: Views):
    return tags.duplicate_categories(v.names).select("key", F.array_join("names", "|").alias("names"))


@query(
    "union_vocabulary",
    """SELECT key, name AS category, fov, event_id AS position FROM (SELECT lower(trim(name)) AS key, *,
       row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY fov, event_id) AS rn FROM fx_names) WHERE rn = 1""",
)
def _(v: Views):
    n = v.names.select(F.col("name").alias("category"), "fov", F.col("event_id").alias("position"))
    return vocab.union_vocabulary(n, ["fov", "position"])


_DECLARED = """declared AS (SELECT DISTINCT project, fov_id, CAST(unnest([1, 2]) AS BIGINT) AS position, unnest(['two', 'single']) AS category
    FROM fx_tiles WHERE project = 'p1')"""


def _declared(v: Views):
    rows = F.array(
        F.struct(F.lit(1).alias("position"), F.lit("two").alias("category")),
        F.struct(F.lit(2).alias("position"), F.lit("single").alias("category")),
    )
    fovs = v.tiles.where("project = 'p1'").select("project", "fov_id").distinct()
    return fovs.select("project", "fov_id", F.explode(rows).alias("r")).select("project", "fov_id", "r.*")


@query(
    "fallback_vocabulary",
    f"""WITH {_DECLARED} SELECT project, fov_id, position, category FROM declared UNION ALL
       SELECT project, fov_id, row_number() OVER (PARTITION BY project, fov_id ORDER BY category), category
       FROM (SELECT DISTINCT project, fov_id, category FROM fx_tags WHERE project <> 'p1')""",
)
def _(v: Views):
    return vocab.fallback_vocabulary(_declared(v), v.tags)


def _project_vocab(v: Views):
    return _declared(v).select("project", "position", "category").distinct()


@query(
    "add_category",
    """SELECT 'p1' AS project, * FROM (VALUES (1, 'two'), (2, 'single'), (3, 'ghost')) t(position, category)
       WHERE EXISTS (SELECT 1 FROM fx_tiles WHERE project = 'p1')
       UNION ALL SELECT project, row_number() OVER (PARTITION BY project ORDER BY category = 'ghost', category), category
       FROM (SELECT DISTINCT project, category FROM fx_tags WHERE project <> 'p1'
             UNION SELECT project, 'ghost' FROM fx_tags WHERE project <> 'p1')""",
)
def _(v: Views):
    first = vocab.add_category(_project_vocab(v), v.tags, " ghost ")
    return vocab.add_category(first, v.tags, "GHOST").select("project", F.col("position").cast("long"), "category")


@query(
    "remove_category",
    "SELECT DISTINCT project, CAST(1 AS BIGINT) AS position, 'two' AS category FROM fx_tiles WHERE project = 'p1'",
)
def _(v: Views):
    return vocab.remove_category(_project_vocab(v), "single")


@query(
    "rename_category",
    """SELECT 'tag' AS kind, project, fov_id, cell_id, CASE category WHEN 'bud' THEN 'budding' WHEN 'tetrad' THEN 'two' ELSE category END AS category,
       confidence FROM fx_tags
       UNION ALL SELECT DISTINCT 'vocab', project, '', '', 'single', CAST(NULL AS DOUBLE) FROM fx_tiles WHERE project = 'p1'""",
)
def _(v: Views):
    renamed = tags.rename_category(v.tags, {"bud": "budding", "tetrad": " two"})
    words = vocab.rename_in_vocabulary(_project_vocab(v), "two", "single").select(
        F.lit("vocab").alias("kind"), "project", F.lit("").alias("fov_id"), F.lit("").alias("cell_id"), "category",
        F.lit(None).cast("double").alias("confidence"),
    )
    return renamed.select(F.lit("tag").alias("kind"), *KEY, "category", "confidence").unionByName(words)


# --- merges -----------------------------------------------------------------------


@query(
    "apply_human_tags",
    """WITH last AS (SELECT project, fov_id, cell_id, arg_max(category, seq) AS cat FROM fx_edits GROUP BY 1, 2, 3)
       SELECT coalesce(g.project, l.project) AS project, coalesce(g.fov_id, l.fov_id) AS fov_id,
         coalesce(g.cell_id, l.cell_id) AS cell_id, CASE WHEN l.cell_id IS NOT NULL THEN l.cat ELSE g.category END AS category,
         CASE WHEN l.cell_id IS NULL THEN g.confidence END AS confidence
       FROM fx_tags g FULL JOIN last l ON g.project = l.project AND g.fov_id = l.fov_id AND g.cell_id = l.cell_id
       WHERE l.cell_id IS NULL OR l.cat <> ''""",
)
def _(v: Views):
    return tags.apply_human_tags(v.tags, v.edits)


@query(
    "apply_predictions",
    """SELECT p.project, p.fov_id, p.cell_id, CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN g.category ELSE p.pred END AS category,
         CASE WHEN g.category IS NOT NULL AND g.confidence IS NULL THEN NULL ELSE p.score END AS confidence
       FROM fx_pred p LEFT JOIN fx_tags g USING (project, fov_id, cell_id)
       UNION ALL SELECT project, fov_id, cell_id, category, confidence FROM fx_tags g
       WHERE NOT EXISTS (SELECT 1 FROM fx_pred p WHERE p.cell_id = g.cell_id AND p.fov_id = g.fov_id)""",
)
def _(v: Views):
    return tags.apply_predictions(v.tags, v.pred_tags)


@query(
    "auto_annotate",
    """SELECT project, fov_id, cell_id, category, confidence FROM fx_tags UNION ALL
       SELECT project, fov_id, cell_id, pred, score FROM fx_pred p
       WHERE NOT EXISTS (SELECT 1 FROM fx_tags g WHERE p.cell_id = g.cell_id AND p.fov_id = g.fov_id)""",
)
def _(v: Views):
    return tags.apply_predictions(v.tags, v.pred_tags, mode="untagged_only")


@query(
    "accept_predictions",
    """SELECT project, fov_id, cell_id, category, CASE WHEN confidence >= 0.5 THEN NULL ELSE confidence END AS confidence FROM fx_tags""",
)
def _(v: Views):
    return tags.accept_predictions(v.tags, v.tags.where("confidence >= 0.5"))


@query("clear_unconfirmed", "SELECT project, fov_id, cell_id, category FROM fx_tags WHERE confidence IS NULL")
def _(v: Views):
    return tags.clear_unconfirmed(v.tags).select(*KEY, "category")


@query("count_unconfirmed", "SELECT count(confidence) AS n_removed FROM fx_tags")
def _(v: Views):
    return tags.count_unconfirmed(v.tags)


@query(
    "remap_tags",
    """WITH m AS (SELECT project, fov_id, cell_id, CASE WHEN label % 10 = 0 THEN NULL
           WHEN label % 10 = 1 THEN printf('%s_cell%05d', fov_id, label + 20)
           ELSE printf('%s_cell%05d', fov_id, label - 20) END AS new_id FROM fx_tiles WHERE label % 10 IN (0, 1, 2)),
       j AS (SELECT g.*, m.cell_id IS NOT NULL AS mapped, m.new_id FROM fx_tags g LEFT JOIN m USING (project, fov_id, cell_id)),
       placed AS (SELECT project, fov_id, CASE WHEN mapped THEN new_id ELSE cell_id END AS cell_id, category, confidence, mapped, cell_id AS old
         FROM j WHERE NOT mapped OR new_id IS NOT NULL)
       SELECT project, fov_id, cell_id, category, confidence FROM (SELECT *, row_number() OVER
         (PARTITION BY project, fov_id, cell_id ORDER BY mapped DESC, old DESC) AS rn FROM placed) WHERE rn = 1""",
)
def _(v: Views):
    m = F.col("label") % 10
    new_id = (
        F.when(m == 1, nm.cell_id_for("fov_id", F.col("label") + 20)).when(m == 2, nm.cell_id_for("fov_id", F.col("label") - 20))
    )
    mapping = v.tiles.where(m < 3).select(*KEY, new_id.alias("new_cell_id"))
    return tags.remap_tags(v.tags, mapping)


@query(
    "fold_tag_events",
    """WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY ts DESC, event_id DESC) AS rn
           FROM fx_tag_events WHERE actor = 'human') WHERE rn = 1),
       a AS (SELECT e.*, row_number() OVER (PARTITION BY e.tile ORDER BY e.ts DESC, e.event_id DESC) AS rn
           FROM fx_tag_events e LEFT JOIN h ON e.tile = h.tile
           WHERE e.actor = 'ai' AND (h.tile IS NULL OR e.ts > h.ts OR (e.ts = h.ts AND e.event_id > h.event_id))),
       t AS (SELECT DISTINCT tile FROM fx_tag_events)
       SELECT t.tile, CASE WHEN coalesce(h.category, '') <> '' THEN h.category ELSE a.category END AS category,
         round(CASE WHEN coalesce(h.category, '') <> '' THEN NULL ELSE a.confidence END, 6) AS confidence
       FROM t LEFT JOIN h ON h.tile = t.tile LEFT JOIN a ON a.tile = t.tile AND a.rn = 1
       WHERE coalesce(h.category, '') <> '' OR coalesce(a.category, '') <> ''""",
)
def _(v: Views):
    return tags.fold_tag_events(v.tag_events).withColumn("confidence", r6("confidence"))


# --- order, paging, sampling --------------------------------------------------------


@query(
    "review_queue",
    f"""SELECT t.cell_id, coalesce(g.category, '') AS category, g.confidence FROM {_TAGGED}
        ORDER BY 2, g.confidence IS NULL, g.confidence, 1""",
)
def _(v: Views):
    t = tags.tag_tiles(v.tiles, v.tags)
    return ranking.review_queue(t).select("cell_id", F.coalesce("category", F.lit("")).alias("category"), "confidence")


@query(
    "page",
    """SELECT cell_id, label FROM fx_tiles ORDER BY CAST(substr(fov_id, 4) AS BIGINT), label LIMIT 50 OFFSET 100""",
)
def _(v: Views):
    return ranking.page(v.tiles, "cell_id", 2, 50).select("cell_id", "label")


@query(
    "page_deep",
    """SELECT cell_id, label FROM (SELECT *, row_number() OVER (ORDER BY CAST(substr(fov_id, 4) AS BIGINT), label) - 1 AS pos, count(*) OVER () AS n FROM fx_tiles)
       WHERE pos // 30 = n // 45""",
)
def _(v: Views):
    return ranking.page(v.tiles, "cell_id", v.tiles.count() // 45, 30, shallow=0).select("cell_id", "label")


@query("page_count", "SELECT greatest(1, CAST(ceil(count(*) / 48) AS BIGINT)) AS n_pages FROM fx_tiles")
def _(v: Views):
    return ranking.page_count(v.tiles, 48)


@query(
    "natural_order",
    """SELECT cell_id FROM fx_tiles ORDER BY CAST(substr(fov_id, 4) AS BIGINT), label""",
)
def _(v: Views):
    return v.tiles.orderBy(nm.natural_key("cell_id"), "cell_id").select("cell_id")


@query(
    "lasso_order",
    """SELECT v.vec_id, coalesce(g.category, 'unlabeled') AS category FROM fx_vecs v
       LEFT JOIN (SELECT * FROM fx_vec_tags WHERE confidence IS NULL) g USING (project, fov_id, cell_id)
       WHERE v.embedding[1] > 0 ORDER BY category <> 'unlabeled', category, vec_id""",
)
def _(v: Views):
    from ..operators.embeddings import label_points

    picked = v.vecs.where(F.get("embedding", F.lit(0)) > 0)
    points = label_points(picked, tags.confirmed_records(v.vec_tags), KEY)
    return points.orderBy(F.col("category") != "unlabeled", "category", "vec_id").select("vec_id", "category")


@query(
    "sample_unlabeled",
    """SELECT t.cell_id FROM fx_tiles t WHERE NOT EXISTS (SELECT 1 FROM fx_tags g
       WHERE g.project = t.project AND g.fov_id = t.fov_id AND g.cell_id = t.cell_id AND g.confidence IS NULL)
       ORDER BY md5(concat(t.cell_id, ':7')), t.cell_id LIMIT 40""",
)
def _(v: Views):
    return ranking.sample_rows(tags.unlabeled(v.tiles, v.tags), "cell_id", 40, 7).select("cell_id")


@query(
    "sample_half",
    """SELECT cell_id FROM (SELECT cell_id, row_number() OVER (ORDER BY md5(concat(cell_id, ':3')), cell_id) AS rn, count(*) OVER () AS n FROM fx_tiles) WHERE rn <= n // 2""",
)
def _(v: Views):
    return ranking.sample_rows(v.tiles, "cell_id", v.tiles.count() // 2, 3).select("cell_id")


@query(
    "keep_last",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
       ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(v: Views):
    li = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    last = ranking.keep_last(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return last.drop("l_shipdate")


def _index_frames(v: Views):
    """Every line has a role: returned ones are exported now (odd suppliers as fields that are new), the others were before."""
    returned = F.col("l_returnflag") == "R"
    name = F.col("l_suppkey").cast("string")
    fov = F.when(returned & (F.col("l_suppkey") % 2 == 1), F.concat(F.lit("x"), name)).otherwise(name)
    frame = v.table("lineitem").select(
        nm.cell_id_for(fov, "l_partkey").alias("cell_id"),
        fov.alias("fov_id"),
        F.col("l_partkey").alias("label"),
        F.when(returned, "t/R").otherwise("t/N").alias("crop_path"),
    ).distinct()
    return frame.where("crop_path = 't/N'"), frame.where("crop_path = 't/R'")


_OLD = """fr AS (SELECT CASE WHEN l_returnflag = 'R' AND l_suppkey % 2 = 1 THEN concat('x', l_suppkey) ELSE CAST(l_suppkey AS VARCHAR) END AS fov_id, l_partkey AS label,
    CASE WHEN l_returnflag = 'R' THEN 't/R' ELSE 't/N' END AS crop_path FROM lineitem),
    ix AS (SELECT DISTINCT printf('%s_cell%05d', fov_id, label) AS cell_id, fov_id, label, crop_path FROM fr),
    old AS (SELECT * FROM ix WHERE crop_path = 't/N'), new AS (SELECT * FROM ix WHERE crop_path = 't/R')"""


@query("concat_index", f"WITH {_OLD} SELECT * FROM old UNION ALL SELECT * FROM new")
def _(v: Views):
    old, new = _index_frames(v)
    return ranking.concat_index(old, new.withColumn("label", F.col("label").cast("int")))


@query(
    "upsert_tile_index",
    f"""WITH {_OLD}, redone AS (SELECT DISTINCT fov_id FROM new
           UNION SELECT DISTINCT fov_id FROM old WHERE CAST(fov_id AS BIGINT) % 11 = 1)
       SELECT o.* FROM old o WHERE fov_id NOT IN (SELECT fov_id FROM redone)
       UNION ALL SELECT * FROM new""",
)
def _(v: Views):
    old, new = _index_frames(v)
    fov = F.expr("try_cast(fov_id as bigint)")
    redone = new.select("fov_id").union(old.where(fov % 11 == 1).select("fov_id"))
    return ranking.upsert_tile_index(old, new, redone).select(*old.columns)
