"""Line dedup against brute force and its SQL."""

import hashlib
from collections import Counter, defaultdict

from llm_data import ROWS, awkward, empty
from pyspark.sql import functions as F

from sieve.llm import linededup as L

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs, min_chars=1):
    seen = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if len(k) >= min_chars)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and seen[key(x)] >= min_docs)]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = digest(L.line_dedup_documents(docs))
    assert got == brute(rows, 10) and sum(r[2] for r in got) > 0


def test_awkward_rows(spark):
    many = [(100 + i, f" Shared LINE\t\nown {i}\n\n  Ärger \n{'x' * (i % 2)}", "en", "a", 1) for i in range(10)]
    many += [(300, "\n".join(["shared line"] * 200 + ["last"]), "en", "a", 1), (None, "shared line", "en", "a", 1), (301, "SHARED LINE", None, None, None)]
    many += [(302, "only here but ten times in one document\n" * 10, "en", "a", 1)]
    rows = spark.createDataFrame(many, awkward(spark, clash=False).schema)
    for c in set(awkward(spark).columns) - set(rows.columns):
        rows = rows.withColumn(c, F.lit("x"))
    docs = awkward(spark).unionByName(rows)
    assert digest(L.line_dedup_documents(docs)) == brute([*ROWS, *many], 10)
    assert digest(L.line_dedup_documents(empty(spark))) == []
    clean = L.drop_lines(docs, min_docs=10)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[300] == "last" and texts[100] == "own 0\n\n" and texts[109] == "own 9\n\nx" and texts[301] == "" and texts[3] is None


def test_copies_count_as_documents_of_their_own(spark):
    copies = [(1, "same\nother"), (1, "same\nother"), (2, "same")]
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in L.drop_lines(docs, min_docs=3).collect())
    assert got == [(1, "other"), (1, "other"), (2, "")]
    once = spark.createDataFrame([(1, "same\nsame\nsame"), (2, "same")], "doc_id long, text string")
    assert [r["text"] for r in L.drop_lines(once, min_docs=3).orderBy("doc_id").collect()] == ["same\nsame\nsame", "same"]


def test_first_place_stays(spark):
    rows = [(i, f"shared {i % 3}\nshared {i % 3}\nown {i}") for i in range(30)]
    out = L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, keep="first").collect()
    left = defaultdict(int)
    for r in out:
        for line in r["text"].split("\n"):
            left[line] += 1
    assert all(left[f"shared {k}"] == 1 for k in range(3)) and all(left[f"own {i}"] == 1 for i in range(30))


def test_bitmaps_leave_out_words_that_keep_all(spark):
    text = "\n".join("common" if i in (5, 200) else f"line {i}" for i in range(300))
    rows = [(0, text), *((i, "common") for i in range(1, 12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    maps = [r["kept"] for r in L.line_bitmaps(docs).collect()]
    assert sorted(map(len, maps))[-1] == 2
    big = next(m for m in maps if len(m) == 2)
    assert [(w["word"], w["bits"] ^ -1) for w in big] == [(0, 1 << 5), (3, 1 << 8)]
    kept = {r["doc_id"]: r["text"] for r in L.drop_lines(docs).collect()}[0].split("\n")
    assert kept == [f"line {i}" for i in range(300) if i not in (5, 200)]


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = L.line_dedup_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_common_line_is_dealt_to_many_tasks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("common").alias("text"))
    dealt = L.line_occurrences(docs).repartitionByRange(8, "h", "g", *L.MARK)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500
