import hashlib
import re

from pyspark.sql import functions as F

from cellframe.llm.exact_copies import exact_duplicates

SCHEMA = "doc_id long, text string, digest string, rank int, n int, body string, same boolean"


def brute(rows):
    groups = {}
    for d, t in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d is None, d or 0))
    out = []
    for body, members in groups.items():
        best = min(members)
        for k, m in enumerate(sorted(members)):
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), k == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def saved(spark, rows, path, mode="overwrite", files=3):
    spark.createDataFrame([(d, t, "x", 1, 2, "y", True) for d, t in rows], SCHEMA).repartition(files).write.mode(mode).parquet(str(path))
    return str(path)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a  b"), (5, None), (6, ""), (7, " \t\n"), (8, "c"), (None, "c"), (None, "d"), (9, "A b"), (10, "a b"), (10, "e"), (10, "e"), (11, "x y " * 200_000)]


def test_groups_and_what_stays(spark, tmp_path):
    path = saved(spark, ROWS, tmp_path / "t")
    got = sorted(map(tuple, exact_duplicates(spark, path).collect()), key=str)
    assert got == brute(ROWS)
    assert exact_duplicates(spark, saved(spark, [], tmp_path / "none")).count() == 0


def test_state_outlives_a_run_and_takes_new_files_only(spark, tmp_path):
    path, state = saved(spark, ROWS, tmp_path / "t"), str(tmp_path / "state")
    exact_duplicates(spark, path, state, batch_bytes=1).count()
    first = len(list((tmp_path / "state" / "commits").glob("[0-9]*")))
    assert first == 3  # a file each
    more = [(0, "a  b"), (20, "c  "), (21, "new")]
    saved(spark, more, path, "append", files=1)
    got = sorted(map(tuple, exact_duplicates(spark, path, state).collect()), key=str)
    assert got == brute(ROWS + more)
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) == first + 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")  # settings are put back


def test_bytes_decide_where_digests_meet(spark, tmp_path):
    rows = [(i, f"text {i % 40} of many") for i in range(200)]
    path = saved(spark, rows, tmp_path / "t")
    got = exact_duplicates(spark, path, digest=lambda sha: F.unhex(F.substring(sha, 1, 1))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
