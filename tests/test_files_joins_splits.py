"""Record numbers of files, changed sources, joins that check their keys, splits that only grow."""

import json
import os

import pytest
from corvane.operators import joins, splits
from corvane.sources import files
from pyspark.sql import functions as F


@pytest.fixture()
def split_small(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


def test_records_have_the_same_numbers_in_any_split(spark, tmp_path, split_small):
    lines = {}
    for name, n in (("a.jsonl", 700), ("b.jsonl", 90)):
        lines[name] = [json.dumps({"k": i % 50, "v": f"{name}{i}" + "x" * (i % 40)}) for i in range(n)]
        lines[name][5:5] = ["", '{"k": 1, "v": "cut', "   "]
        (tmp_path / name).write_text("\n".join(lines[name]) + "\n")
    got = []
    for size in (64 << 20, 4096, 700):
        split_small(size)
        rows = files.read_json_records(spark, f"{tmp_path}/*.jsonl", "k long, v string")
        one = sorted((os.path.basename(r["file"]), r["seq"], r["k"], r["v"], r["bad"]) for r in rows.collect())
        last = sorted((r["k"], r["v"]) for r in files.latest_record(rows.where("bad is null"), ["k"]).collect())
        got.append((one, last))
    assert got[0] == got[1] == got[2]
    for name, text in lines.items():
        mine = {s: (v, bad) for f, s, _, v, bad in got[0][0] if f == name}
        assert set(mine) == {i for i, t in enumerate(text) if t.strip()}
        assert all((json.loads(t)["v"], None) == mine[i] for i, t in enumerate(text) if t.strip() and "cut" not in t) and mine[6] == (None, "bad json")
    assert dict(got[0][1])[0] == "b.jsonl50" + "x" * 10  # the last of the last file


def test_sources_with_sidecars_and_changes(spark, tmp_path):
    for name, text in (("m_d_judged.csv", "a\n"), ("m_smoke_judged.csv", "b\n"), ("n_d_judged.csv", "c\n"), ("m_d.meta.json", '{\n"model": "m", "max_tokens": 5}'), ("other.meta.json", "{}"), ("n_d.meta.json", "{broken")):
        (tmp_path / name).write_text(text)
    found = {r["run"]: r for r in files.sources(spark, str(tmp_path), "model string, max_tokens long").collect()}
    assert {k: (r["skipped"], r["model"], r["max_tokens"], r["size"]) for k, r in found.items()} == {"m_d": (None, "m", 5, 2), "m_smoke": ("smoke", None, None, 2), "n_d": (None, None, None, 2)}
    assert [r["run"] for r in files.sources(spark, str(tmp_path), "model string", only="n_", smoke=True).collect()] == ["n_d"]
    before = files.listing(spark, f"{tmp_path}/*_judged.csv").collect()
    old = spark.createDataFrame(before)
    assert files.stale_sources(old, files.listing(spark, f"{tmp_path}/*_judged.csv")).count() == 0
    (tmp_path / "m_d_judged.csv").write_text("longer\n")
    (tmp_path / "n_d_judged.csv").unlink()
    (tmp_path / "z_judged.csv").write_text("z")
    got = {r["name"]: r["status"] for r in files.stale_sources(old, files.listing(spark, f"{tmp_path}/*_judged.csv")).collect()}
    assert got == {"m_d_judged.csv": "changed", "n_d_judged.csv": "missing", "z_judged.csv": "new"}
    for name in ("m_d", "other", "n_d"):
        (tmp_path / f"{name}.meta.json").unlink()
    assert all(r["model"] is None for r in files.sources(spark, str(tmp_path), "model string").collect())


def test_older_tables_are_upgraded(spark, tmp_path):
    spark.range(3).select("id", F.lit("x").alias("a")).write.parquet(f"{tmp_path}/t")
    spark.range(3, 5).select("id", F.lit("y").alias("a"), F.lit(None).cast("boolean").alias("flag")).write.mode("append").parquet(f"{tmp_path}/t")
    df = files.read_upgraded(spark, f"{tmp_path}/t", "a string, id int, flag boolean, n long", {"flag": F.lit(False), "n": F.length("a")})
    assert df.dtypes == [("a", "string"), ("id", "int"), ("flag", "boolean"), ("n", "bigint")]
    assert sorted(map(tuple, df.collect())) == [("x", i, False, 1) for i in range(3)] + [("y", 3, False, 1), ("y", 4, False, 1)]
    with pytest.raises(ValueError, match="gone"):
        files.read_upgraded(spark, f"{tmp_path}/t", "a string, gone long", {})


def failing(df):
    with pytest.raises(Exception) as e:
        df.collect()
    return str(e.value)


def test_joins_name_the_key_that_breaks_them(spark):
    left = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "c", 0)], "k long, l string, z int")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "k long, r string")
    assert sorted(map(tuple, joins.checked_join(left, right, ["k"]).collect())) == [(1, "a", 0, "x"), (1, "b", 0, "x"), (2, "c", 0, None)]
    assert "left: not one row for k=1" in failing(joins.checked_join(left, right, ["k"], "1:1", name="pairs"))
    twice = right.union(right.where("k = 3"))
    assert "k=3" in failing(joins.checked_join(left, twice, ["k"]).select("l"))  # though r is not read
    assert "no partner right for k=2" in failing(joins.checked_join(left, right, ["k"], every_left=True).groupBy().count())
    assert "no partner left for k=3" in failing(joins.checked_join(left, right, ["k"], every_right=True))
    nulls = right.union(spark.createDataFrame([(None, "n")], right.schema))
    assert "k=null" in failing(joins.unique(nulls, ["k"], "x")) and joins.checked_join(left, nulls, ["k"]).count() == 3
    ok = joins.checked_join(left.where("l <> 'b'"), right.where("k = 1").union(spark.createDataFrame([(2, "q")], right.schema)), ["k"], "1:1", every_left=True, every_right=True)
    assert ok.columns == ["k", "l", "z", "r"] and sorted(map(tuple, ok.collect())) == [(1, "a", 0, "x"), (2, "c", 0, "q")]
    for wrong in ((left, right.withColumnRenamed("r", "l"), ["k"], "m:1"), (left, right, ["k"], "m:m"), (left, right, ["q"], "m:1")):
        with pytest.raises(ValueError):
            joins.checked_join(*wrong)
    plan = joins.checked_join(left, right, ["k"], "1:1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 or "BroadcastExchange" in plan  # the counts add no shuffle of their own


def test_extension_moves_no_old_question(spark):
    rows = [(f"q{i}", c, p) for i in range(400) for c, p in (("x", "positive"), ("y", "negative")) if i % 3 or c == "x"]
    df = spark.createDataFrame(rows, "question_id string, hint_style string, case string")
    first = splits.assign_splits(df.where("cast(substring(question_id, 2) as int) < 250"), 7)
    given = {r["question_id"]: r["split"] for r in first.collect()}
    carried = splits.carry_over(df, first)
    assert tuple(splits.carry_report(carried).first()) == (first.count(), 250, df.count() - first.count())
    with pytest.raises(ValueError):
        splits.assign_splits(carried, 7)
    out = splits.assign_splits(carried, 7, extend=True).collect()
    by = {}
    for r in out:
        assert by.setdefault(r["question_id"], r["split"]) == r["split"]
    assert len(out) == df.count() and {q: by[q] for q in given} == given and None not in by.values()
    late = [by[q] for q in by if q not in given]
    assert abs(late.count("train") / 150 - 0.7) < 0.03 and abs(late.count("test") / 150 - 0.15) < 0.03
    anew = {r["question_id"]: r["split"] for r in splits.assign_splits(carried, 8, force=True).collect()}
    assert anew != by and set(anew) == set(by)
    assert splits.carry_over(df, df) is df
    two = first.union(first.limit(1).withColumn("split", F.lit("elsewhere")))
    assert "several splits" in failing(splits.carry_over(df, two))
    with pytest.raises(ValueError):
        splits.question_splits(df, 1, (0.8, 0.3))


def test_columns_that_nobody_reads_are_not_dealt(spark):
    from corvane.operators import joins
    from pyspark.sql import functions as F

    wide = spark.range(20).select(F.col("id").alias("k"), *[F.concat(F.lit("v"), F.col("id")).alias(f"wide_{c}") for c in "abc"])
    plan = joins.unique(wide, ["k"], "wide").select("k", "wide_b")._jdf.queryExecution().optimizedPlan().toString()
    assert "wide_b" in plan and "wide_a" not in plan and "wide_c" not in plan and "raise_error" in plan
    with pytest.raises(Exception, match="wide: not one row for k=1"):
        joins.unique(wide.unionByName(wide.where("k = 1")), ["k"], "wide").select("k").collect()
