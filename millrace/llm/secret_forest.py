"""Secret scan: candidate strings, and a random forest that removes the false ones.  DataFrame functions only.

Candidates are runs of 16 or more characters that keys are made of.  Features: length, shares of character
classes, transitions between classes, different characters, coverage by the letter trigrams of the corpus'
own words (at most 26**3 of them, which bounds what the driver holds), words of the path, and the neighbouring
words and characters on both sides.  The forest is trained on labelled findings and then scores every finding;
nothing is joined or shuffled by candidate.

Where no reviewed findings are given, the forest learns from planted ones, whose truth is known because they
are written here: keys with and without a key word before them, and harmless digests, identifiers, numbers and
placeholders, some of them with a key word.  So no single feature tells the label.  The corpus adds findings
of digits or letters alone as harmless ones, drawn by a hash, as many as there are planted ones (about).

Defined results: null and empty texts have no findings; repeated rows repeat theirs; null sources are
empty paths; where labels are missing or all alike every finding is kept with their mean (or null); an
empty table gives an empty result.  Very long texts, words and candidates are read whole, in time that grows
with their length.  Findings are numbered in the order of the text, so they cannot tie.  Further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
KEY_WORDS = r"(?i)(password|passwd|secret|token|api.?key|access.?key|credential)"
SUM_WORDS = r"(?i)\b(commit|revision|sha-?[0-9]*|md5|checksum|digest|hash|etag|uuid|guid|id|order|invoice|serial|number)\b"
FEATURES = ["length", "digits", "uppers", "lowers", "signs", "transitions", "different", "hex", "coverage", "path_test", "path_code", "before_key", "before_sum", "before_sign", "after_quote", "alone"]


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, nth (from 0 in its text), candidate; lead and rest: what stands in its word between it and
    the candidates next to it; before, after: these with the two words before and the one after."""
    text = docs[text_col]
    src = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[path_col].cast("string"), F.lit("")).alias("path"), text.alias("__text")).filter(text.rlike(CANDIDATE))
    words = src.select("doc_id", "path", F.split("__text", r"[\x20\x09-\x0D]+").alias("w"))
    at = words.withColumn("i", F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at("w", i).rlike(CANDIDATE)))
    word = lambda i: F.coalesce(F.get("w", i - 1), F.lit(""))

    def of_word(i: Column) -> Column:
        between = F.split(word(i), CANDIDATE, -1)
        parts = F.arrays_zip(F.regexp_extract_all(word(i), F.lit(CANDIDATE), F.lit(0)), between, F.slice(between, 2, F.size(between)))
        parts = F.filter(parts, lambda z: z["0"].isNotNull())
        return F.transform(parts, lambda z: F.struct(z["0"].alias("candidate"), z["1"].alias("lead"), z["2"].alias("rest"), F.concat_ws(" ", word(i - 2), word(i - 1), z["1"]).alias("before"), F.concat_ws(" ", z["2"], word(i + 1)).alias("after")))

    each = at.select("doc_id", "path", F.posexplode(F.flatten(F.transform("i", of_word))).alias("nth", "x"))
    return each.select("doc_id", "path", F.col("nth").cast("long").alias("nth"), "x.candidate", "x.lead", "x.rest", "x.before", "x.after")


def letter_trigrams(docs: DataFrame, *, text_col: str = "text", least_words: int = 5) -> DataFrame:
    """The trigrams of a-z in at least ``least_words`` different words of the corpus that stand in several texts."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(docs[text_col]), r"[^a-z]+"))).alias("w")).filter(F.length("w") >= 3)
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    gram = lambda z: F.concat(z["0"], z["1"], z["2"])
    letters = F.split("w", "")
    triples = F.transform(_triples(letters, F.length("w")), gram)
    grams = often.select(F.explode(F.array_distinct(triples)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return grams.filter(F.col("n") >= least_words).select("gram")


def _triples(items: Column, n: Column) -> Column:
    """Each three neighbours of an array of n (three at least), as fields 0, 1 and 2."""
    return F.arrays_zip(F.slice(items, 1, n - 2), F.slice(items, 2, n - 2), F.slice(items, 3, n - 2))


def packed(trigrams: DataFrame) -> list[int]:
    """For each two letters, the third ones that make a known trigram, as bits."""
    bits = [0] * 26 * 26
    for r in trigrams.collect():  # 26**3 rows at most
        a, b, c = (ord(x) - 97 for x in r.gram)
        bits[26 * a + b] |= 1 << c
    return bits


def _coverage(text: Column, known: list[int]) -> Column:
    """The share of three neighbouring characters that are a known trigram."""
    codes = F.transform(F.split(F.lower(text), ""), lambda x: F.ascii(x) - 97)
    table = F.lit(known).cast("array<bigint>")
    letter = lambda x: (x >= 0) & (x < 26)
    one = lambda z: F.when(letter(z["0"]) & letter(z["1"]) & letter(z["2"]), F.call_function("bit_get", F.get(table, z["0"] * 26 + z["1"]), z["2"]).cast("int")).otherwise(0)
    return F.aggregate(F.transform(_triples(codes, F.length(text)), one), F.lit(0), lambda s, x: s + x) / (F.length(text) - 2)


def with_features(found: DataFrame, known: list[int]) -> DataFrame:
    """Adds FEATURES, all doubles."""
    c = F.col("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / F.length(c)
    steps = r"(?<=[0-9])(?=[^0-9])|(?<=[A-Z])(?=[^A-Z])|(?<=[a-z])(?=[^a-z])|(?<=[+/_-])(?=[^+/_-])"
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return found.withColumns(
        {
            "length": F.length(c).cast("double"),
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "lowers": share("[a-z]"),
            "signs": share("[+/_-]"),
            "transitions": F.regexp_count(c, F.lit(steps)) / (F.length(c) - 1),
            "different": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(64)),
            "hex": flag(c.rlike("^[0-9A-Fa-f]+$")),
            "coverage": _coverage(c, known),
            "path_test": flag(F.col("path").rlike("(?i)(test|example|sample|mock|fixture)")),
            "path_code": flag(F.col("path").rlike(r"(?i)(\.(py|js|java|go|rb|sh|env|ya?ml|json|cfg|conf)$|config)")),
            "before_key": flag(F.col("before").rlike(KEY_WORDS)),
            "before_sum": flag(F.col("before").rlike(SUM_WORDS) | F.col("after").rlike(SUM_WORDS)),
            "before_sign": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
            "after_quote": flag(F.col("after").rlike("^[\"']")),
            "alone": flag((F.col("lead") == "") & (F.col("rest") == "")),
        }
    )


#: Contexts of planted findings: whether the finding is a secret, the words around it, its kind.
CONTEXTS = [
    (1, 'token = "', '"', "hex"),
    (1, "api_key: ", "", "base64"),
    (1, "export ACCESS_KEY=", " # prod", "id"),
    (1, "the password is ", " for now", "base64"),
    (1, "connect with ", " please", "base64"),
    (1, 'auth("', '")', "hex"),
    (0, "commit ", " fixes it", "hex"),
    (0, 'checksum: "', '"', "hex"),
    (0, "token number ", " was used", "digits"),
    (0, "request id ", " failed", "uuid"),
    (0, 'secret = "', '"', "placeholder"),
    (0, "see ", " below", "path"),
    (0, "order ", "", "digits"),
    (0, "token hash ", " matches", "hex"),
]


def planted_documents(spark: SparkSession, n: int = 4_200) -> DataFrame:
    """doc_id, text, source, label: one finding in each text, its characters from digests of the id."""
    h = F.sha2(F.concat(F.lit("planted "), F.col("id").cast("string")), 256)
    b64 = F.translate(F.base64(F.unhex(h)), "=", "")
    words = F.translate(F.substring(h, 1, 6), "0123456789abcdef", "aeioutnrslaeiost")
    part = lambda a, n: F.substring(h, a, n)
    kinds = {
        "hex": F.when(F.col("id") % 3 == 0, part(1, 32)).when(F.col("id") % 3 == 1, part(1, 40)).otherwise(F.upper(part(1, 40))),
        "base64": F.when(F.col("id") % 2 == 0, b64).otherwise(F.substring(b64, 1, 24)),
        "id": F.concat(F.lit("AKIA"), F.upper(part(1, 16))),
        "digits": F.translate(part(1, 16), "abcdef", "135790"),
        "uuid": F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
        "placeholder": F.concat_ws("-", F.lit("your"), words, F.lit("value-goes-here")),
        "path": F.concat_ws("/", F.lit("src/main"), words, F.lit("module_index")),
    }
    pick, text, label = F.col("id") % len(CONTEXTS), F.lit(""), F.lit(0)
    for k, (truth, before, after, kind) in enumerate(CONTEXTS):
        text = F.when(pick == k, F.concat(F.lit(before), kinds[kind], F.lit(after))).otherwise(text)
        label = F.when(pick == k, truth).otherwise(label)
    paths = F.element_at(F.array(*map(F.lit, ["app/config.yaml", "README.md", "tests/test_login.py", "web", "main.go"])), (F.conv(part(60, 4), 16, 10).cast("int") % 5 + 1).cast("int"))
    return spark.range(n).select((-1 - F.col("id")).alias("doc_id"), text.alias("text"), paths.alias("source"), label.alias("label"))


def planted_findings(spark: SparkSession, known: list[int], n: int = 4_200) -> DataFrame:
    """FEATURES, doc_id, nth, candidate and label of planted findings."""
    docs = planted_documents(spark, n)
    truth = docs.select(F.col("doc_id").alias("__id"), "label")
    found = with_features(candidates(docs), known)
    return found.join(truth, found["doc_id"] == truth["__id"]).drop("__id")


def plain_findings(found: DataFrame) -> DataFrame:
    """Findings that are harmless by their format alone, digits or letters only, with label 0."""
    return found.filter(F.col("candidate").rlike("^([0-9]+|[a-z]+|[A-Z]?[a-z]+)$")).withColumn("label", F.lit(0))


def _drawn(rows: DataFrame, most: int, n: int) -> DataFrame:
    steps = 1 << 20
    return rows.filter(F.pmod(F.xxhash64("doc_id", "nth", "candidate"), F.lit(steps)) < max(1, int(steps * min(1.0, most / max(n, 1)))))


def train_forest(labelled: DataFrame, *, max_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 7):
    """labelled: FEATURES and label (0, 1).  A forest, or the mean label where there is nothing to tell apart."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, low, high, mean = labelled.agg(F.count("label"), F.min("label"), F.max("label"), F.avg("label")).first()
    if not n or low == high:
        return mean
    drawn = _drawn(labelled, max_rows, n)
    drawn = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(drawn.select(*FEATURES, F.col("label").cast("double").alias("label")))
    return RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(drawn)


def score_findings(found: DataFrame, forest, *, least: float = 0.5) -> DataFrame:
    """Adds p_secret and is_secret."""
    if forest is None or isinstance(forest, float):
        return found.withColumn("p_secret", F.lit(forest).cast("double")).withColumn("is_secret", F.lit(True))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(found))
    return out.withColumn("p_secret", vector_to_array("probability")[1]).withColumn("is_secret", F.col("p_secret") >= least).drop("__x", "probability", "rawPrediction", "prediction")


def scan_secrets(docs: DataFrame, labelled: Callable[[DataFrame], DataFrame] | None = None, *, planted: int = 4_200, **columns: str) -> DataFrame:
    """doc_id, nth, candidate, FEATURES, p_secret, is_secret for every finding.

    labelled: takes the findings with FEATURES, returns some of them with ``label`` (0, 1); about ``planted``
    planted and as many plain ones where it is None."""
    text = {"text_col": columns["text_col"]} if "text_col" in columns else {}
    known = packed(letter_trigrams(docs, **text))
    found = materialize(with_features(candidates(docs, **columns), known), "findings")
    if labelled is not None:
        rows = labelled(found)
    else:
        plain, names = plain_findings(found), [*FEATURES, "doc_id", "nth", "candidate", "label"]
        rows = _drawn(plain, planted, plain.count()).select(*names).unionByName(planted_findings(docs.sparkSession, known, planted).select(*names))
    return score_findings(found, train_forest(rows)).select("doc_id", "nth", "candidate", *FEATURES, "p_secret", "is_secret")
