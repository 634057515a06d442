"""Secrets in texts, scanned once per content and rule version.

Every text is addressed by its sha256. A ledger ``(sha256, rules, spans)`` holds what earlier runs found, empty results
included. A run takes the contents that the ledger lacks for the present rule version, scans one carrier of each, and
adds rows for them; findings reach every path (row) that has the content through a join on the address. A content that
a third of all rows share is scanned once, and its rows are joined, never gathered.

Positions come from matches and the gaps between them: ``split`` and ``regexp_extract_all`` walk the same matches, so a
match starts where the gaps and matches before it end. Offsets are code points.

Defined results: a null text is empty; empty texts have no spans; repeated rows get the same findings; an empty table
gives no rows; other columns are carried through ``scan`` untouched, except that those named like the two new
ones (parameters ``address`` and ``spans``) are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Kind, pattern, group that must be long enough, its least length, what a text must hold for a match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES: list[tuple[str, str, int, int, str]] = [
    ("assign", ASSIGN, 2, 6, "[:=]"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, r"\.[A-Za-z0-9_-]{8,}\."),
    ("hosted", r"\b(?:gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 0, "_|xox"),
]
BASE = ("assign", "access", "hex")
RULES_VERSION = "3"
SPAN = "array<struct<start:long,kind_no:int,kind:string,end:long>>"


def _spans(no: int, kind: str, pattern: str, group: int, least: int, needs: str) -> Column:
    """Spans of one kind; the costly walk is made only over texts that can match."""
    whole = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(F.col("text"), pattern, -1)
    steps = F.arrays_zip(F.transform(whole, F.length).alias("n"), F.transform(tested, F.length).alias("t"), F.transform(F.slice(gaps, 1, F.size(whole)), F.length).alias("g"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["g"]
        end = begin + s["n"]
        span = F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["t"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    may = F.col("text").rlike(needs) if any(c in needs for c in "[|\\") else F.contains("text", F.lit(needs))
    return F.when(may & F.col("text").rlike(pattern), F.aggregate(steps, start, step, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def find_spans(contents: DataFrame) -> DataFrame:
    """Adds ``spans``: of all rules, by start and then in the order of the rules."""
    found = [_spans(i, *rule) for i, rule in enumerate(RULES)]
    return contents.withColumn("spans", F.array_sort(F.concat(*found)))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows ``(sha256, rules, spans)`` for the contents of ``versions`` (sha256, path, text) not yet scanned."""
    carriers = versions.groupBy("sha256").agg(F.min("path").alias("path"))
    if ledger is not None:
        seen = ledger.where(F.col("rules") == RULES_VERSION).select("sha256")
        carriers = carriers.join(seen, "sha256", "left_anti")
    one = versions.join(carriers, ["sha256", "path"]).select("sha256", "text")
    return find_spans(one).select("sha256", F.lit(RULES_VERSION).alias("rules"), "spans").dropDuplicates(["sha256"])


def scan(docs: DataFrame, path: str = "doc_id", ledger: DataFrame | None = None, address: str = "sha256", spans: str = "spans") -> tuple[DataFrame, DataFrame]:
    """``docs`` with columns ``address`` and ``spans``, and the ledger as it is after the run."""
    addressed = docs.drop(address, spans).withColumn("text", F.coalesce("text", F.lit(""))).withColumn(address, F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    versions = addressed.select(F.col(address).alias("sha256"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "text")
    fresh = stored(update_ledger(versions, ledger), "ledger")
    whole = fresh if ledger is None else ledger.unionByName(fresh)
    hits = whole.where((F.col("rules") == RULES_VERSION) & (F.size("spans") > 0)).select(F.col("sha256").alias(address), F.col("spans").alias(spans))
    return addressed.join(hits, address, "left").withColumn(spans, F.coalesce(F.col(spans), F.array().cast(SPAN))), whole


def redact(docs: DataFrame, mark: str = "[SECRET]", spans: str = "spans") -> DataFrame:
    """Texts with ``mark`` in place of every span (overlapping ones once); needs the column ``spans``, keeps the others."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], acc["at"])
        fresh = s["end"] > acc["at"]
        piece = F.col("text").substr((acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        tail = F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit(""))
        return F.struct(F.when(fresh, F.concat(acc["done"], piece, tail)).otherwise(acc["done"]).alias("done"), F.when(fresh, s["end"]).otherwise(acc["at"]).alias("at"))

    whole = F.aggregate(F.col(spans), start, step, lambda a: F.concat(a["done"], F.col("text").substr((a["at"] + 1).cast("int"), F.length("text"))))
    return docs.withColumn("text", F.when(F.size(F.col(spans)) > 0, whole).otherwise(F.col("text")))


def _joined(kinds: tuple[str, ...] | None) -> Column:
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, numbers of spans of the base kinds, their sha256 and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return docs.select("doc_id", *map(count, BASE), F.sha2(_joined(BASE).cast("binary"), 256).alias("base_sha256"), _joined(None).alias("spans"))


def oracle_sql() -> str:
    """The same in DuckDB SQL."""
    def kind(no: int, name: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, {no} AS kind_no, '{name}' AS kind, unnest(w) AS hit, unnest(t) AS tested, unnest(g) AS gap, generate_subscripts(w, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(x, '{p}') AS w, regexp_extract_all(x, '{p}', {group}) AS t, string_split_regex(x, '{p}')[1:len(regexp_extract_all(x, '{p}'))] AS g FROM d WHERE regexp_matches(x, '{p}'))"""

    parts = reduce(lambda a, b: f"{a} UNION ALL {b}", (f"SELECT *, {least} AS least FROM ({kind(i, k, p, g, least)})" for i, (k, p, g, least, _) in enumerate(RULES)))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), m AS ({parts}),
        s AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS stop FROM m),
        f AS (SELECT doc_id, kind_no, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE length(tested) >= least),
        j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans FROM f GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN j USING (doc_id)"""
