import pytest
from churnspark.operators import levels
from churnspark.sources import files
from churnspark.sources.workspace import Workspace
from conftest import telco
from pyspark.sql import functions as F


def test_indexes_are_ranks(spark):
    rows = [(k, None if k % 9 == 0 else f"v{k % 13}", "é" if k % 2 else "z") for k in range(300)]
    df = spark.createDataFrame(rows, "`a.b` int, t string, u string")
    found = levels.dictionary(df, ["a.b", "t", "u"])
    got = {(r["column"], r["value"]): r["index"] for r in found.collect()}
    want = {}
    for j, c in enumerate(["a.b", "t", "u"]):
        want |= {(c, v): k for k, v in enumerate(sorted({str(r[j]) for r in rows if r[j] is not None}))}
    assert got == want
    more = df.unionByName(spark.createDataFrame([(-5, "new", None)], df.schema))
    out = levels.attach(more, found, ["a.b", "t", "u"])
    first = levels.offsets(found, ["a.b", "t", "u"])
    assert out.columns == ["a.b", "t", "u", "i_a.b", "i_t", "i_u"] and first == {"a.b": 0, "t": 300, "u": 313}
    for r in out.withColumn("s", levels.slots(first)).collect():
        assert [r["i_a.b"], r.i_t, r.i_u] == [got.get((c, str(r[c]))) for c in ("a.b", "t", "u")]
        assert list(r.s) == [first[c] + r["i_" + c] for c in first if r["i_" + c] is not None]


def test_empty(spark):
    df = spark.createDataFrame([], "t string")
    found = levels.dictionary(df, ["t"])
    assert found.collect() == [] and levels.attach(df, found, ["t"]).collect() == [] and levels.offsets(found, ["t"]) == {"t": 0}


def test_a_million_levels(spark):
    """No task holds the levels: the largest range is a fraction of them, and every index occurs once."""
    n = 1_000_000
    df = spark.range(n).select(F.concat(F.lit("level "), F.xxhash64("id").cast("string")).alias("t"))
    found = levels.dictionary(df, ["t"])
    facts = found.agg(F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"), F.countDistinct("index").alias("d")).first()
    assert tuple(facts) == (n, 0, n - 1, n)
    wrong = found.alias("a").join(found.alias("b"), F.expr("a.index + 1 = b.index")).where("a.value >= b.value")
    assert wrong.isEmpty()


@pytest.mark.parametrize("line, kind, kept", [
    ("1,x", "short", True), ("1,x,y,z", "long", False), ('1,"x,y', "quote", False), ('1,"x, ""q""",y', None, True), ("1,x,", None, True),
    ("1,x,y,", "long", False), ('1,"x",y,"z,w"', "long", False),
])
def test_malformed_lines(spark, tmp_path, line, kind, kept):
    (tmp_path / "a.csv").write_text(f"id, name ,Malformed\n{line}\n2,b,c\n")
    found, mark = files.read_csv_checked(spark, str(tmp_path / "a.csv"))
    rows = found.collect()
    assert found.columns == ["id", "name", "Malformed", "malformed_"] and mark == "malformed_"
    assert sorted((r[mark] for r in rows), key=str) == sorted([kind, None], key=str)


def test_ingest_reports_malformed_lines(spark, tmp_path):
    df = telco(spark)
    lines = [",".join(df.columns)] + [",".join("" if v is None else str(v) for v in r) for r in df.collect()]
    ragged = lines + [lines[1] + ",more", lines[2].rsplit(",", 1)[0], lines[3].replace(",", ',"', 1)]
    for name, content in (("good", lines), ("ragged", ragged)):
        (tmp_path / f"{name}.csv").write_text("\n".join(content) + "\n")
    ws = Workspace(spark, str(tmp_path / "ws"))
    good = ws.ingest(str(tmp_path / "good.csv"))["validation"]
    assert "File Structure" not in [c[0] for c in good["checks"]]
    n = ws.extract().count()
    bad = ws.ingest(str(tmp_path / "ragged.csv"))["validation"]
    assert ("File Structure", "warning", 3.0) in [tuple(c[:3]) for c in bad["checks"]] and ws.extract().count() == n + 1
