"""Secret scan: candidate strings, a random forest on labelled findings that removes false positives; DataFrames only."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.language_id import labelled_sample
from riskweave.llm.scratch import saved

#: A candidate: an unbroken run of so many letters, digits and the signs that keys are written with.
CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
#: Characters looked at on either side of a candidate.
AROUND = 48
#: Labelled findings of a kind that the forest is fitted on, about: a bounded sample by hash.
TRAINING_FINDINGS = 20_000
TREES, DEPTH, WORD_SLOTS, SEED = 40, 8, 128, 17
#: Least occurrences that make a word of the texts a word of the dictionary.
DICTIONARY_COUNT = 5
NUMBERS = (
    "length", "digits", "uppers", "lowers", "signs", "runs", "changes", "transitions", "coverage", "slashes", "in_path", "assigned", "quoted",
)

# fixed values: formats and names by which findings are labelled when no labels are given
KEY_ID = (
    r"^((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{40,}|glpat-[\w\-]{20,}|npm_[A-Za-z0-9]{36}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|[spr]k_(live|test)_[A-Za-z0-9]{16,}|AIza[\w\-]{35}|eyJ[\w\-]{13,})$"
)
HEX_TOKEN = r"(?i)^[0-9a-f]{32,}$"
#: Base64, of either alphabet: upper and lower case and digits.
BASE64_TOKEN = r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_\-]{20,}={0,2}$"
#: The signature of a web token follows its other parts after a dot.
SIGNATURE, DOT = r"^[\w\-]{43,}$", r"^\.$"
KEY_NAMES = r"(?i)(token|secret|passw(or)?d|api[_-]?key|key)[\"']?\s*[:=]\s*[\"']?$"


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, place, value, before, after) of every candidate of every whole text; place counts from 1 in a text.

    Null texts have none; repeated rows repeat their candidates.
    """
    body = F.translate(F.col(f"`{text}`"), "\u0001\u0002", "  ")
    marked = docs.filter(F.col(f"`{text}`").rlike(CANDIDATE)).select(
        F.col(f"`{id_column}`").alias("id"), F.split(F.regexp_replace(body, f"({CANDIDATE})", "\u0001$1\u0002"), "\u0001").alias("pieces")
    )
    pairs = F.arrays_zip(
        F.slice("pieces", F.lit(1), F.size("pieces") - 1).alias("left"), F.slice("pieces", F.lit(2), F.size("pieces") - 1).alias("right")
    )
    rows = marked.select("id", F.posexplode(pairs).alias("place", "pair"))
    left, right = F.col("pair").getField("left"), F.col("pair").getField("right")
    return rows.select(
        "id", (F.col("place") + 1).alias("place"), F.substring_index(right, "\u0002", 1).alias("value"),
        # what stands between the candidate before and this one
        F.right(F.substring_index(left, "\u0002", -1), F.lit(AROUND)).alias("before"),
        F.left(F.substring_index(right, "\u0002", -1), F.lit(AROUND)).alias("after"),
    )


def dictionary_grams(spark: SparkSession, docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Log shares of the letter pairs, and the letter triples, of the dictionary: the lower-case ASCII words that occur
    DICTIONARY_COUNT times or more in all texts. At most 27 squared and 27 cubed rows, a blank standing for a word's edge."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(r"(?<![a-z0-9])[a-z]{2,24}(?![a-z0-9])"), F.lit(0))).alias("word"))
    words = saved(spark, words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= DICTIONARY_COUNT), "dictionary")
    pairs = _grams(words, "n", "word", 2).groupBy("gram").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.left("gram", F.lit(1))))
    pairs = pairs.select("gram", F.log(F.col("n") / total).alias("weight"))
    triples = _grams(words, "n", "word", 3).select("gram").distinct()
    return saved(spark, pairs, "pairs"), saved(spark, triples, "triples")


def _grams(rows: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(key, gram) of the overlapping n-grams of the padded string in ``column``, in one pass over it; the string itself
    does not go with them."""
    padded = F.concat(F.lit(" "), F.col(column), F.lit(" "))
    return rows.select(key, F.explode(F.regexp_extract_all(padded, F.lit(f"(?=(.{{{size}}}))"), F.lit(1))).alias("gram"))


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def features(spark: SparkSession, found: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """``found`` with the numbers of NUMBERS and the neighbouring words of each candidate.

    Letter transitions and dictionary coverage are worked out once for each different value.
    """
    found = found.withColumn("digest", F.md5(F.col("value").cast("binary")))
    values = found.groupBy("digest").agg(F.lower(F.regexp_replace(F.first("value"), "[^A-Za-z0-9]", " ")).alias("low"))
    two = _grams(values, "digest", "low", 2).groupBy("digest", "gram").agg(F.count(F.lit(1)).alias("n")).join(pairs, "gram", "left")
    two = two.groupBy("digest").agg((F.sum(F.col("n") * F.coalesce("weight", F.lit(-12.0))) / F.sum("n")).alias("transitions"))
    three = _grams(values, "digest", "low", 3).groupBy("digest", "gram").agg(F.count(F.lit(1)).alias("n"))
    three = three.join(triples.withColumn("known", F.col("gram")), "gram", "left").groupBy("digest").agg(
        (F.sum(F.when(F.col("known").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[+/_=\\-]+", "-")
    words = F.array_compact(F.concat(
        F.transform(F.slice(F.reverse(F.split(F.lower("before"), "[^a-z]+")), 1, 4), lambda w: F.when(w != "", F.concat(F.lit("before "), w))),
        F.transform(F.slice(F.split(F.lower("after"), "[^a-z]+"), 1, 4), lambda w: F.when(w != "", F.concat(F.lit("after "), w))),
    ))
    return found.join(two, "digest").join(three, "digest").drop("digest").withColumns({
        "length": F.length("value").cast("double"), "digits": _share(F.col("value"), "[0-9]"), "uppers": _share(F.col("value"), "[A-Z]"),
        "lowers": _share(F.col("value"), "[a-z]"), "signs": _share(F.col("value"), "[+/_=-]"), "runs": F.length(classes).cast("double"),
        "changes": F.length(classes) / F.length("value"), "slashes": F.regexp_count("value", F.lit("/")).cast("double"),
        "in_path": (F.col("before").rlike(r"(://|[/.\\])\S*$") | F.col("after").rlike(r"^\.\w|^://")).cast("double"),
        "assigned": F.col("before").rlike(r"[:=]\s*[\"']?$").cast("double"), "quoted": F.col("before").rlike("[\"']$").cast("double"),
        "words": words,
    })


def labelled_by_format(found: DataFrame) -> DataFrame:
    """``found`` with label 1 for what has the form of a key or stands, as a token, behind a key's name; null for what else
    stands behind one, and for what may be a web token's signature; else 0."""
    value, named = F.col("value"), F.col("before").rlike(KEY_NAMES)
    secret = value.rlike(KEY_ID) | ((value.rlike(HEX_TOKEN) | value.rlike(BASE64_TOKEN)) & named)
    unknown = named | (value.rlike(SIGNATURE) & F.col("before").rlike(DOT))
    return found.withColumn("label", F.when(secret, 1).when(~unknown, 0))


def fit_forest(spark: SparkSession, labelled: DataFrame, bound: int = TRAINING_FINDINGS) -> PipelineModel | None:
    """The forest of labelled findings: rows of ``features`` with a column label, 1 for a secret, 0 for none, null for
    not known. About ``bound`` findings of each kind are used, chosen by a hash; None if a kind is missing."""
    rows = labelled.filter("label in (0, 1)").withColumn("key", F.xxhash64("value", "before", "after"))
    rows = labelled_sample(rows, "key", "label", bound, "secrets").select("key", "label", "words", *NUMBERS)
    rows = saved(spark, rows.repartition(8, "key").sortWithinPartitions("key", "label"), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    share = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 1.0 / share[1]).otherwise(1.0 / share[0]) * sum(share.values()) / 2)
    stages = [
        HashingTF(inputCol="words", outputCol="hashed", numFeatures=WORD_SLOTS, binary=True),
        VectorAssembler(inputCols=[*NUMBERS, "hashed"], outputCol="vector"),
        RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                               featureSubsetStrategy="0.3", probabilityCol="probability", predictionCol="class"),
    ]
    return Pipeline(stages=stages).fit(rows)


def scan(
    spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None, training: Column | None = None,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(id, place, value, before, after, label, score, is_secret) of every candidate of every whole text.

    The forest learns from ``labelled``, a table (value, before, after, label) of reviewed findings, or, without one,
    from the candidates of the texts that ``training`` holds for (all, without one) as ``labelled_by_format`` labels
    them. score is the forest's probability of a secret and is_secret says that it is 0.5 or more; if one kind of label
    is missing nothing is removed and score is null. Null and empty texts have no candidates; repeated rows repeat
    theirs; a null id keeps its candidates; an empty table gives an empty result.
    """
    pairs, triples = dictionary_grams(spark, docs, text)
    found = saved(spark, features(spark, saved(spark, candidates(docs, id_column, text), "candidates"), pairs, triples), "features")
    if labelled is None:
        known = labelled_by_format(found if training is None else found.filter(training))
    else:
        known = features(spark, labelled.select("value", "before", "after", "label"), pairs, triples)
    forest = fit_forest(spark, known)
    found = labelled_by_format(found)
    columns = ["id", "place", "value", "before", "after", "label"]
    if forest is None:
        return found.select(*columns, F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_secret"))
    scored = forest.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*columns, "score", (F.col("score") >= 0.5).alias("is_secret"))
