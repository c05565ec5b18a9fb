"""Secret scan: token-like strings are found by one pattern and a random forest removes the false ones.

Only DataFrame and SQL functions run on the data. Candidates are values of at least ``SHORTEST_SET`` characters
that are set to a credential name (``=``, ``:`` or ``>`` between them), up to a space, quote, bracket or separator, and
maximal runs of at least ``SHORTEST`` letters, digits and ``_ + / -`` that hold a digit, have a published key
format or follow a credential name; key formats that are shorter count too. The forest sees their length, shares and
transitions of character classes, how much of them common words of the corpus cover, marks of
paths, and the words beside them; it never sees the label rule's verdict.

``fit_filter`` takes findings with a ``label`` column. There is no table of labelled findings here, so
``rule_labels`` marks them: published key formats and assignments to a credential name are true, the rest false.
Of each label at most ``sample`` different findings (by hash) are fitted on, equal ones once, and both labels weigh
the same, so rare secrets and much copied text neither fill nor leave the sample. Words of the dictionary are
counted over all documents.

Defined cases: a null or empty text has no findings; without findings of both labels every finding gets
the share of label 1 as its probability (1 without labels, so nothing is removed unseen); equal findings are
each reported; an empty table gives an empty result; other columns are kept by ``find`` with the row.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.llm.common import stored

SHORTEST = 16
RUN = rf"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{{{SHORTEST},}}"
SHORTEST_SET = 4
AROUND = 48
MARK = "\ue000"  # a character for private use
COMMON = 20
WORD = "[a-z]{4,}"
SAMPLE = 20_000
TREES, DEPTH = 40, 6
NEIGHBOURS = 16
CREDENTIAL = r"(?i)(pass(word|wd)?|pwd|secret|token|api[_-]?key|auth|bearer|credential)\W{0,4}$"
# Published shapes of access keys.
KEY_SHAPES = r"^(AKIA|ASIA)[A-Z2-7]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$"

# What stands between a credential name and its value. Names end in at most 12 more letters; the short first part is a quick test.
SET = r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|auth|bearer|credential)\w{0,12}[\"'`\])\\]{0,3}\s{0,3}[:=>]{1,2}\s{0,3}\\?[\"'`]?"
SET_BEFORE = rf"(?<=[:=>]\s{{0,3}}\\?[\"'`]?)(?<={SET})"
VALUE = rf"(?![:=>])[^\s\"'`<>,;&(){{}}\[\]\\]{{{SHORTEST_SET},}}(?<![.:?])"
CANDIDATE = rf"{SET_BEFORE}{VALUE}|{RUN}|(?<![A-Za-z0-9_+/-])xox[abprs]-[A-Za-z0-9-]{{10,}}"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate: the document's other columns, nth, finding, before and after."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "nth", "finding", "before", "after")]
    whole = F.col(f"`{text}`")
    # one pass sets a mark around every candidate; a text that holds the mark itself takes two
    pieces = F.split(F.regexp_replace(whole, f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK)
    plain = ~F.contains(whole, F.lit(MARK))
    found = F.when(plain, F.filter(pieces, lambda _, i: i % 2 == 1)).otherwise(F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0)))
    between = F.when(plain, F.filter(pieces, lambda _, i: i % 2 == 0)).otherwise(F.split(whole, CANDIDATE))
    cut = docs.select("*", F.explode(F.array(F.struct(found.alias("found"), between.alias("parts")))).alias("_cut")).select("*", F.col("_cut.found").alias("_found"), F.col("_cut.parts").alias("_parts"))
    # a name may itself be part of the candidate before
    before = lambda i: F.right(F.concat(F.coalesce(F.right(F.get("_found", i - 1), F.lit(AROUND)), F.lit("")), F.get("_parts", i)), F.lit(AROUND))
    each = F.transform(F.col("_found"), lambda x, i: F.struct(i.alias("nth"), x.alias("finding"), before(i).alias("before"), F.left(F.get("_parts", i + 1), F.lit(AROUND)).alias("after")))
    wanted = lambda s: s["finding"].rlike("[0-9]") | s["finding"].rlike(KEY_SHAPES) | s["before"].rlike(CREDENTIAL) | s["before"].rlike(f"{SET}$")
    some = cut.where(F.size("_found") > 0).withColumn("_each", F.filter(each, wanted))
    return some.select(*others, F.explode("_each").alias("_f")).select(*others, "_f.nth", "_f.finding", "_f.before", "_f.after")


def common_words(docs: DataFrame, text: str = "text", least: int = COMMON) -> DataFrame:
    """Words of at least four letters that ``least`` documents or more hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(WORD), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


def covered(findings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(finding, coverage): share of its characters in common words, for each different finding that has any."""
    runs = findings.select("finding").distinct().select("finding", F.explode(F.regexp_extract_all(F.lower("finding"), F.lit(WORD), F.lit(0))).alias("word"))
    return runs.join(dictionary, "word").groupBy("finding").agg((F.sum(F.length("word")) / F.length("finding")).alias("coverage"))


def _features() -> dict[str, Column]:
    x, size = F.col("finding"), F.length("finding").cast("double")
    share = lambda p: F.regexp_count(x, F.lit(p)) / size
    last, next_ = F.lower(F.regexp_extract("before", r"(\w+)\W*$", 1)), F.lower(F.regexp_extract("after", r"^\W*(\w+)", 1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = {
        "size": size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "hex": share("[0-9a-f]"),
        "different": F.size(F.array_distinct(F.split(x, ""))) / size,
        "digit_digit": share("[0-9](?=[0-9])"),
        "letter_digit": share("[A-Za-z](?=[0-9])"),
        "digit_letter": share("[0-9](?=[A-Za-z])"),
        "rise": share("[a-z](?=[A-Z])"),
        "fall": share("[A-Z](?=[a-z])"),
        "vowel_consonant": share("(?i)[aeiou](?=[b-df-hj-np-tv-z])"),
        "covered": F.coalesce("coverage", F.lit(0.0)),
        "slashes": share("/"),
        "dashes": share("[_-]"),
        "path_before": flag(F.col("before").rlike(r"[/\\.~@:]$")),
        "address_before": flag(F.col("before").rlike(r"(?i)(https?|ftp|www)\S*$")),
        "set_before": flag(F.col("before").rlike("[=:]\\s{0,2}[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "credential_before": flag(F.col("before").rlike(CREDENTIAL.replace(r"\W{0,4}$", r"\W{0,12}\w{0,12}\W{0,4}$"))),
        "ends_word_after": flag(F.col("after").rlike(r"^[\s.,;]|^$")),
    }
    for side, word in (("left", last), ("right", next_)):
        bucket = F.pmod(F.xxhash64(word), F.lit(NEIGHBOURS))
        out |= {f"{side}_{k}": flag((bucket == k) & (word != "")) for k in range(NEIGHBOURS)}
        out[f"{side}_size"] = F.length(word).cast("double")
    return {f"_f_{k}": F.coalesce(v, F.lit(0.0)) for k, v in out.items()}


def with_features(findings: DataFrame, dictionary: DataFrame) -> DataFrame:
    joined = findings.join(covered(findings, dictionary), "finding", "left")
    features = _features()
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(joined.withColumns(features)).drop(*features, "coverage")


def rule_labels(findings: DataFrame) -> DataFrame:
    """Findings with ``label``: 1 for key formats and for values set to a credential name, else 0."""
    rule = F.col("finding").rlike(KEY_SHAPES) | (F.col("before").rlike(CREDENTIAL) & F.col("finding").rlike("[A-Za-z]"))
    return findings.withColumn("label", F.coalesce(rule, F.lit(False)).cast("double"))


def fit_filter(labelled: DataFrame, sample: int = SAMPLE, seed: int = 7):
    """A fitted forest, or the share of label 1 where all findings have one label (or none). ``labelled`` has _features and label (1 or 0)."""
    named = labelled.where("label is not null").withColumn("_h", F.xxhash64("finding", "before", "after"))
    folded = stored(named.select("label", "_h").distinct(), "different-findings")
    totals = {r.label: r.n for r in folded.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return 0.0 if 0.0 in totals else 1.0
    least = F.row_number().over(Window.partitionBy("label").orderBy("_h"))
    picked = folded.withColumn("_k", least).where(F.col("_k") <= sample).select("label", "_h")
    rows = named.join(F.broadcast(picked), ["label", "_h"]).select("_features", "label", "_h").dropDuplicates(["label", "_h"])
    # both labels weigh the same, whatever their shares and however many were left out
    true, false = (min(sample, totals[x]) for x in (1.0, 0.0))
    weight = F.when(F.col("label") == 1, F.lit((true + false) / 2 / true)).otherwise(F.lit((true + false) / 2 / false))
    rows = stored(rows.withColumn("_weight", weight).repartition(1).sortWithinPartitions("_h", "label"), "labelled-findings")
    return RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(rows)


def with_probability(featured: DataFrame, model) -> DataFrame:
    if isinstance(model, float):
        return featured.withColumn("probability", F.lit(model)).drop("_features")
    scored = model.transform(featured).withColumn("_p", vector_to_array("probability")[1])
    return scored.drop("probability", "rawPrediction", "prediction", "_features").withColumnRenamed("_p", "probability")


def scan(docs: DataFrame, text: str = "text", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Every candidate with its probability and whether it is kept as a secret."""
    # the texts are searched once; features and coverage read what was found
    findings = stored(find(docs, text), "candidates")
    featured = stored(with_features(findings, common_words(docs, text)), "findings")
    model = fit_filter(rule_labels(featured), sample)
    return with_probability(featured, model).withColumn("kept", F.col("probability") >= least)


def scan_table(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    return found.select("doc_id", "nth", F.length("finding").alias("n_chars"), F.sha2(F.col("finding").cast("binary"), 256).alias("finding_sha256"), F.round("probability", 6).alias("probability"), "kept")
