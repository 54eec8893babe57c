"""Question sets in their published layouts as one table of questions.

Every reader gives (original_index, question, choices, answer_idx, groundtruth, prompt, additional_fields); rows whose options can't be trusted
are dropped or refused, never relabelled by position.  Columns are made by expressions, so that a scan reads what they need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.joins import required

LETTERS = "ABCDEFGHIJ"
#: The placeholder of an option that isn't there, the split without labels, the subset without questions' columns.
NO_OPTION, UNLABELLED = "N/A", "test"
#: Fixed values: "A)21", the letter and the text.
OPTION = r"(?s)^\s*([A-Za-z])\s*\)\s*(.*)$"


def _has(raw: DataFrame, name: str, columns: tuple[str, ...]) -> None:
    if missing := sorted(set(columns) - set(raw.columns)):
        raise ValueError(f"{name} lacks {missing}, wants {sorted(columns)}")


def _text(c: Column) -> Column:
    """A trimmed text, null where nothing is left."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def _letter(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def _fields(raw: DataFrame, pairs: dict[str, str], **fixed: Column) -> Column:
    """The fields of ``pairs`` (name to column) that a row has, and fixed ones, as a map."""
    values = dict(fixed) | {k: _text(F.col(f"`{c}`")) for k, c in pairs.items() if c in raw.columns}
    made = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]) if values else F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.filter(made, lambda x: x["value"].isNotNull()))


def lettered_options(options: Column, width: int = 5) -> Column:
    """The texts of options like "A)21", null unless there are ``width`` of them, labelled in order, each with a text.

    A label that is repeated within the text is cut once; another letter there stays.
    """

    def one(o: Column, i: Column) -> Column:
        letter = F.substring(F.lit(LETTERS), i + 1, F.lit(1))
        named = lambda t: F.upper(F.regexp_extract(t, OPTION, 1)) == letter
        rest = lambda t: F.regexp_replace(F.regexp_extract(t, OPTION, 2), r"\s+$", "")
        text = rest(o)
        return F.when(o.rlike(OPTION) & named(o), F.nullif(F.when(named(text), rest(text)).otherwise(text), F.lit("")))

    texts = F.transform(options, one)
    return F.when((F.size(options) == width) & F.forall(texts, lambda t: t.isNotNull()), texts)


def labelled_choices(labels: Column, texts: Column, width: int = 5) -> Column:
    """The texts in the order of their labels, null unless the labels are the first ``width`` letters, each once, each with a text."""
    pairs = F.array_sort(F.zip_with(labels, texts, lambda a, t: F.struct(_letter(a).alias("label"), _text(t).alias("text"))))
    order = F.array_join(F.transform(pairs, lambda p: p["label"]), ",")
    whole = (F.size(labels) == width) & (F.size(texts) == width) & (order == ",".join(LETTERS[:width])) & F.forall(pairs, lambda p: p["text"].isNotNull())
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(pairs, lambda p: p["text"]))


def option_order(seed: int, index: Column, width: Column) -> Column:
    """The places of a question's options in an order that depends on (seed, index) alone."""
    keyed = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), index, i), 256).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def _questions(rows: DataFrame, *, seed: int, shuffle: bool, noted: bool = True) -> DataFrame:
    """Finished questions of (original_index, question, choices, answer_idx, fields), their options shuffled where asked.

    ``noted``: a shuffled row also tells its first right letter.
    """
    letter = F.substring(F.lit(LETTERS), F.col("answer_idx") + 1, F.lit(1))
    if shuffle:
        rows = rows.withColumn("order", option_order(seed, F.col("original_index"), F.size("choices")))
        more = {"answers_order": F.array_join("order", ",")} | ({"original_groundtruth": letter} if noted else {})
        rows = rows.withColumns(
            {
                "fields": F.map_concat("fields", F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v)])),
                "choices": F.transform("order", lambda i: F.get("choices", i)),
                "answer_idx": (F.array_position("order", F.col("answer_idx")) - 1).cast("int"),
            }
        )
    lines = F.transform("choices", lambda c, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(") "), c))
    prompt = F.concat(F.col("question"), F.lit("\n\n"), F.array_join(lines, "\n"))
    return rows.select(F.col("original_index").cast("long").alias("original_index"), "question", "choices", F.col("answer_idx").cast("int").alias("answer_idx"), letter.alias("groundtruth"), prompt.alias("prompt"), F.col("fields").alias("additional_fields"))


def chosen(raw: DataFrame, group: str, *, only: list[str] | None = None, without: list[str] | None = None, most: int | None = None, seed: int = 42) -> DataFrame:
    """Rows of the groups asked for, at most ``most`` of each, the first by a hash of (seed, index)."""
    if only:
        raw = raw.where(F.col(group).isin(only))
    if without:
        raw = raw.where(F.col(group).isNull() | ~F.col(group).isin(without))
    if most is not None:
        h = F.sha2(F.concat_ws(":", F.lit(str(seed)), "original_index"), 256)
        raw = raw.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(h, "original_index"))).where(F.col("_place") <= most).drop("_place")
    return raw


def mmlu(raw: DataFrame, *, split: str = "test", subjects: list[str] | None = None, without: list[str] | None = None, per_subject: int | None = None, seed: int = 42, shuffle: bool = False) -> DataFrame:
    """MMLU: (question, choices, answer, subject).  The training split has no subjects, so that their filters don't apply to it."""
    _has(raw, "mmlu", ("question", "choices", "answer"))
    if split not in ("train", "auxiliary_train") and "subject" in raw.columns:
        raw = chosen(raw, "subject", only=subjects, without=without, most=per_subject, seed=seed)
    rows = raw.select("original_index", "question", "choices", F.col("answer").cast("int").alias("answer_idx"), _fields(raw, {"subject": "subject"}).alias("fields"))
    return _questions(rows, seed=seed, shuffle=shuffle)


def gpqa(raw: DataFrame, *, subset: str = "gpqa_diamond", seed: int = 42, shuffle: bool = False) -> DataFrame:
    """GPQA: the right answer stands first and is always moved by seed; ``shuffle`` also notes the order."""
    _has(raw, f"gpqa subset {subset}", ("Question", "Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"))
    choices = F.array(*[F.col(f"`{c}`") for c in ("Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3")])
    fields = _fields(raw, {"domain": "High-level domain", "subdomain": "Subdomain"}, subset=F.lit(subset))
    rows = raw.select("original_index", F.col("Question").alias("question"), choices.alias("choices"), F.lit(0).alias("answer_idx"), fields.alias("fields"))
    made = _questions(rows, seed=seed, shuffle=True, noted=False)
    return made if shuffle else made.withColumn("additional_fields", F.map_filter("additional_fields", lambda k, v: k != "answers_order"))


def mmlu_pro(raw: DataFrame, *, categories: list[str] | None = None, without: list[str] | None = None, per_category: int | None = None, options: int | None = None, seed: int = 42, shuffle: bool = False) -> DataFrame:
    """MMLU-Pro: placeholder options are left out and the answer's place follows; an answer that is one fails the job.

    ``options`` keeps questions of just that many real options, before ``per_category`` cuts categories.
    """
    _has(raw, "mmlu_pro", ("question_id", "question", "options", "answer_index", "category"))
    raw = raw.withColumn("original_index", F.col("question_id"))
    real = F.filter("options", lambda o: o != NO_OPTION)
    if options is not None:
        raw = raw.where(F.size(real) == options)
    raw = chosen(raw, "category", only=categories, without=without, most=per_category, seed=seed)
    at = F.col("answer_index").cast("int")
    good = (at >= 0) & (F.get("options", at) != NO_OPTION)
    raw = required(raw, good, F.concat(F.lit("mmlu_pro: the answer is no option of question "), F.col("question_id").cast("string")))
    before = F.size(F.filter(F.slice("options", F.lit(1), at), lambda o: o == NO_OPTION))
    rows = raw.select("original_index", "question", real.alias("choices"), (at - before).alias("answer_idx"), _fields(raw, {"category": "category", "src": "src"}).alias("fields"))
    return _questions(rows, seed=seed, shuffle=shuffle)


def medqa(raw: DataFrame, *, seed: int = 42, shuffle: bool = False) -> DataFrame:
    """MedQA: options as a struct or map by letter; rows without four of them are dropped, an answer that is no letter fails the job."""
    _has(raw, "medqa", ("question", "options", "answer_idx"))
    options = F.array(*[F.col("options")[x] for x in LETTERS[:4]])
    whole = raw.where(F.forall(options, lambda o: _text(o).isNotNull()))
    at = F.instr(F.lit(LETTERS[:4]), _letter(F.col("answer_idx"))) - 1
    whole = required(whole, (F.length(_letter(F.col("answer_idx"))) == 1) & (at >= 0), F.concat(F.lit("medqa: no letter in row "), F.col("original_index").cast("string")))
    rows = whole.select("original_index", "question", options.alias("choices"), at.alias("answer_idx"), _fields(raw, {"step": "meta_info"}).alias("fields"))
    return _questions(rows, seed=seed, shuffle=shuffle)


def _five(raw: DataFrame, choices: Column, answer: str, fields: Column, seed: int, shuffle: bool) -> DataFrame:
    said = _letter(F.col(answer))
    at = F.when(F.length(said) == 1, F.instr(F.lit(LETTERS[:5]), said) - 1).otherwise(-1)
    rows = raw.select("original_index", "question", choices.alias("choices"), at.alias("answer_idx"), fields.alias("fields"))
    return _questions(rows.where(F.col("choices").isNotNull() & (F.col("answer_idx") >= 0)), seed=seed, shuffle=shuffle)


def aqua(raw: DataFrame, *, seed: int = 42, shuffle: bool = False) -> DataFrame:
    """AQuA: five options "A)..."; malformed rows are dropped, the worked solution is not carried."""
    _has(raw, "aqua", ("question", "options", "correct"))
    return _five(raw, lettered_options(F.col("options")), "correct", _fields(raw, {}), seed, shuffle)


def commonsense_qa(raw: DataFrame, *, split: str = "validation", seed: int = 42, shuffle: bool = False) -> DataFrame:
    """CommonsenseQA: choices as (label, text) lists; malformed rows are dropped, the split without labels is refused."""
    if split.strip().lower() == UNLABELLED:
        raise ValueError("the test split of commonsense_qa has no labels; take validation or train")
    _has(raw, "commonsense_qa", ("question", "choices", "answerKey"))
    return _five(raw, labelled_choices(F.col("choices.label"), F.col("choices.text")), "answerKey", _fields(raw, {"question_concept": "question_concept"}), seed, shuffle)


READERS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (mmlu, gpqa, mmlu_pro, medqa, aqua, commonsense_qa)}


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """A question set by its name, in any case, from Parquet; original_index is the row's number in its file, before any filter."""
    reader = READERS.get(name.strip().lower())
    if reader is None:
        raise ValueError(f"unknown dataset {name}, known: {sorted(READERS)}")
    raw = spark.read.parquet(path)
    return reader(raw.withColumn("original_index", F.col("_metadata.row_index")), **options)


def exclusion_list(spark: SparkSession, path: str | None) -> DataFrame:
    """(original_index) of a JSON list of numbers; empty without a path."""
    if path is None:
        return spark.createDataFrame([], "original_index long")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<long>")).alias("original_index")).distinct()
