"""Readers of question sets on rows of their layouts, good and malformed."""

import pytest
from corvane.sources import datasets
from pyspark.sql import functions as F


def rows_of(df):
    return {r["original_index"]: r for r in df.collect()}


def test_lettered_options(spark):
    cases = [
        (["A)1", "B)2", "C)3", "D)4", "E)5"], ["1", "2", "3", "4", "5"]),
        ([" a ) x\ny ", "B) B)2", "C)D)3", "d)4", "E)5 "], ["x\ny", "2", "D)3", "4", "5"]),
        (["A)1", "B)2", "C)3", "D)4"], None),
        (["A)1", "C)2", "B)3", "D)4", "E)5"], None),
        (["A)1", "B)", "C)3", "D)4", "E)5"], None),
        (["A)1", None, "C)3", "D)4", "E)5"], None),
        (["A)A)", "B)2", "C)3", "D)4", "E)5"], None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, o) for i, (o, _) in enumerate(cases)], "i int, o array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", datasets.lettered_options(F.col("o")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_labelled_choices(spark):
    cases = [
        (list("ABCDE"), ["1", " 2 ", "3", "4", "5"], ["1", "2", "3", "4", "5"]),
        (["b ", "A", "e", "D", "C"], ["2", "1", "5", "4", "3"], ["1", "2", "3", "4", "5"]),
        (list("ABCDD"), list("12345"), None),
        (list("ABCD"), list("1234"), None),
        (list("ABCDE"), list("1234"), None),
        (list("ABCDE"), ["1", "", "3", "4", "5"], None),
        (list("ABCDF"), list("12345"), None),
        (None, list("12345"), None),
    ]
    df = spark.createDataFrame([(i, a, t) for i, (a, t, _) in enumerate(cases)], "i int, a array<string>, t array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", datasets.labelled_choices(F.col("a"), F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def test_numbers_are_those_of_the_file_before_any_filter(spark, tmp_path):
    rows = [(f"Q{i}", [f"a{i}", f"b{i}", f"c{i}", f"d{i}"], i % 4, ["law", "art", None][i % 3]) for i in range(90)]
    spark.createDataFrame(rows, "question string, choices array<string>, answer long, subject string").coalesce(1).write.parquet(f"{tmp_path}/mmlu")
    out = rows_of(datasets.load(spark, " MMLU ", f"{tmp_path}/mmlu", subjects=["law", "art"], without=["art"], per_subject=7))
    assert len(out) == 7 and all(i % 3 == 0 and r["question"] == f"Q{i}" and r["additional_fields"] == {"subject": "law"} for i, r in out.items())
    assert all(r["prompt"] == f"Q{i}\n\nA) a{i}\nB) b{i}\nC) c{i}\nD) d{i}" and r["groundtruth"] == "ABCD"[i % 4] for i, r in out.items())
    assert len(rows_of(datasets.load(spark, "mmlu", f"{tmp_path}/mmlu", split="auxiliary_train", subjects=["law"]))) == 90
    shuffled = rows_of(datasets.load(spark, "mmlu", f"{tmp_path}/mmlu", shuffle=True, seed=3))
    for i, r in shuffled.items():
        order = [int(x) for x in r["additional_fields"]["answers_order"].split(",")]
        assert sorted(order) == [0, 1, 2, 3] and r["choices"] == [rows[i][1][k] for k in order] and r["choices"][r["answer_idx"]] == rows[i][1][i % 4]
        assert r["additional_fields"]["original_groundtruth"] == "ABCD"[i % 4] and r["groundtruth"] == "ABCD"[r["answer_idx"]]
    assert len({r["additional_fields"]["answers_order"] for r in shuffled.values()}) > 15
    with pytest.raises(ValueError, match="unknown dataset"):
        datasets.load(spark, "nope", str(tmp_path))


def test_gpqa_moves_the_right_answer(spark):
    raw = spark.createDataFrame([(i, f"Q{i}", "same" if i == 5 else "right", "same" if i == 5 else "w1", "w2", "w3", " Physics ", "") for i in range(60)], "original_index long, Question string, `Correct Answer` string, `Incorrect Answer 1` string, `Incorrect Answer 2` string, `Incorrect Answer 3` string, `High-level domain` string, Subdomain string")
    out = rows_of(datasets.gpqa(raw))
    assert {r["answer_idx"] for r in out.values()} == {0, 1, 2, 3} and all(r["choices"][r["answer_idx"]] == ("same" if i == 5 else "right") for i, r in out.items())
    assert out[0]["additional_fields"] == {"subset": "gpqa_diamond", "domain": "Physics"}
    assert "answers_order" in rows_of(datasets.gpqa(raw, shuffle=True))[0]["additional_fields"]
    with pytest.raises(ValueError, match="Question"):
        datasets.gpqa(raw.drop("Question"))


def test_mmlu_pro_leaves_placeholders_out(spark):
    schema = "question_id long, question string, options array<string>, answer_index int, category string, src string"
    raw = spark.createDataFrame([(7, "q", ["N/A", "x", "N/A", "y"], 3, "law", None), (8, "q", list("abcd"), 0, None, " s ")], schema)
    out = rows_of(datasets.mmlu_pro(raw))
    assert out[7]["choices"] == ["x", "y"] and out[7]["answer_idx"] == 1 and out[7]["groundtruth"] == "B" and out[8]["additional_fields"] == {"src": "s"}
    assert list(rows_of(datasets.mmlu_pro(raw, options=2))) == [7] and list(rows_of(datasets.mmlu_pro(raw, without=["law"]))) == [8]
    for bad in (0, 4, -1):
        with pytest.raises(Exception, match="no option of question 7"):
            datasets.mmlu_pro(raw.where("question_id = 7").withColumn("answer_index", F.lit(bad))).collect()


def test_medqa_wants_four_options_and_a_letter(spark):
    schema = "original_index long, question string, options map<string,string>, answer_idx string, meta_info string"
    whole = dict(zip("DCBA", "4321", strict=True))
    raw = spark.createDataFrame([(0, "q", whole, " b", " step1 "), (1, "q", whole | {"C": " "}, "A", None), (2, "q", None, "A", None), (3, "q", whole, "A", "")], schema)
    out = rows_of(datasets.medqa(raw))
    assert sorted(out) == [0, 3] and out[0]["choices"] == list("1234") and out[0]["answer_idx"] == 1 and out[0]["additional_fields"] == {"step": "step1"} and out[3]["additional_fields"] == {}
    with pytest.raises(Exception, match="no letter in row 3"):
        datasets.medqa(raw.where("original_index = 3").withColumn("answer_idx", F.lit("E"))).collect()


def test_commonsense_qa_and_aqua_drop_what_they_cannot_trust(spark):
    schema = "original_index long, question string, choices struct<label:array<string>,text:array<string>>, answerKey string, question_concept string"
    raw = spark.createDataFrame([(0, "q", (list("ABCDE"), list("12345")), "c", "idea"), (1, "q", (list("ABCDE"), list("12345")), "", None), (2, "q", (list("ABCD"), list("1234")), "A", None), (3, "q", None, "A", None)], schema)
    out = rows_of(datasets.commonsense_qa(raw))
    assert list(out) == [0] and out[0]["groundtruth"] == "C" and out[0]["additional_fields"] == {"question_concept": "idea"}
    with pytest.raises(ValueError, match="no labels"):
        datasets.commonsense_qa(raw, split=" Test ")
    with pytest.raises(ValueError, match="answerKey"):
        datasets.commonsense_qa(raw.drop("answerKey"))
    a = spark.createDataFrame([(0, "q", ["A)1", "B)2", "C)3", "D)4", "E)5"], "e", "because"), (1, "q", ["A)1", "B)2", "C)3", "D)4", "E)5"], "AB", ""), (2, "q", ["A)1"], "A", "")], "original_index long, question string, options array<string>, correct string, rationale string")
    out = rows_of(datasets.aqua(a))
    assert list(out) == [0] and out[0]["answer_idx"] == 4 and out[0]["additional_fields"] == {} and "rationale" not in out[0].asDict()


def test_exclusion_list(spark, tmp_path):
    (tmp_path / "x.json").write_text("[3,\n 5, 3]")
    assert sorted(r[0] for r in datasets.exclusion_list(spark, str(tmp_path / "x.json")).collect()) == [3, 5]
    assert datasets.exclusion_list(spark, None).count() == 0
