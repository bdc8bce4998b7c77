"""Secret scans: candidates by pattern, false positives removed by a random forest; SQL functions and MLlib only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A candidate: sixteen or more characters of keys with their padding, or a dotted token. Runs are taken whole, so that a text
#: is read once, however long they are.
CANDIDATE = r"eyJ[A-Za-z0-9_\-]++(?:\.[A-Za-z0-9_\-]++){1,2}|[A-Za-z0-9+/_\-]{16,}+={0,2}"
#: Labelled findings that a fit takes at most.
TRAIN_ROWS = 20_000
_SPLIT = r"[\x20\x09-\x0D]+"

# Fixed word lists of the features.
DICTIONARY = "example sample dummy placeholder change your insert replace secret token password user admin test demo foo bar value string number name file path image version build release commit page index article photo product order the and for with this that from http https www com html".split()
KEY_WORDS = "key token secret password passwd pwd auth bearer api credential access private"
HASH_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid etag revision build id isbn order page version"
TEST_PATHS = "test spec example sample fixture mock doc readme demo"

FEATURES = ["length", "transitions", "distinct", "digits", "upper", "hex", "symbols", "longest_run", "dictionary", "path_test", "path_depth", "key_before", "hash_before", "assigned", "quoted", "key_after"]


def _any(words: str) -> str:
    return "(?i)(?:" + "|".join(words.split()) + ")"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(key, word, nth, candidate, raw, before, after, path): every candidate of every whitespace-separated word, with the two
    words before and the one after. word is the place in the text and nth the place among the word's candidates, from 0. raw is
    the candidate with the text between it and its neighbours in the word; a name after it belongs to the next one. Null
    texts have none. A run of letters alone is a candidate only where a name of a key stands before it, with up to 40 more characters of
    the name after the word that marks it (so that long runs of such words are read in linear time)."""
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"), F.col(text).alias("_text")).where(F.col("_text").rlike(CANDIDATE))
    words = F.split(F.trim(F.regexp_replace("_text", _SPLIT, " ")), " ")

    def found(ws: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            return F.when(
                w.rlike(CANDIDATE),
                F.struct(
                    i.alias("word"), w.alias("raw"),
                    F.concat_ws(" ", F.when(i > 1, F.get(ws, i - 2)), F.when(i > 0, F.get(ws, i - 1))).alias("before"), F.coalesce(F.get(ws, i + 1), F.lit("")).alias("after"),
                ),
            )

        return F.filter(F.transform(ws, at), lambda x: x.isNotNull())

    # The words are bound to a lambda's variable, so that they are split once and not for every element.
    hits = F.get(F.transform(F.array(words), found), F.lit(0))
    out = rows.select(key, F.col("_path").alias("path"), F.explode(hits).alias("h")).select("*", F.regexp_extract_all("h.raw", F.lit(CANDIDATE), F.lit(0)).alias("_c"), F.split("h.raw", CANDIDATE, -1).alias("_between"))
    each = F.arrays_zip(F.col("_c").alias("c"), F.col("_between").alias("left"), F.slice("_between", F.lit(2), F.size("_c")).alias("right"))
    out = out.select(key, "path", "h", F.size("_c").alias("_n"), F.posexplode(each).alias("nth", "m")).where("m.c is not null")
    right = F.when(F.col("nth") + 1 < F.col("_n"), F.regexp_extract("m.right", "^[^A-Za-z0-9]*", 0)).otherwise(F.col("m.right"))
    raw = F.concat("m.left", "m.c", right)
    named = F.concat_ws(" ", F.col("h.before"), F.col("m.left")).rlike(_any(KEY_WORDS) + r"[A-Za-z0-9_\-]{0,40}[\"']?\s*[:=]+\s*[\"']?$")
    out = out.where(F.col("m.c").rlike("[0-9]") | named)
    return out.select(key, F.col("h.word").alias("word"), "nth", F.col("m.c").alias("candidate"), raw.alias("raw"), F.col("h.before").alias("before"), F.col("h.after").alias("after"), "path")


def with_features(found: DataFrame) -> DataFrame:
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[^aB1]", "_")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    letters = F.lower(c)
    rest = F.regexp_replace(letters, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    around = F.concat_ws(" ", "before", F.regexp_extract("raw", r"^(.*?)[=:]", 1))
    return found.withColumns({
        "length": n,
        "transitions": (F.length(runs) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": F.length(F.regexp_replace(c, "[^0-9]", "")) / n,
        "upper": F.length(F.regexp_replace(c, "[^A-Z]", "")) / n,
        "hex": c.rlike(r"^[0-9a-f\-]+$").cast("double"),
        "symbols": F.length(F.regexp_replace(c, "[A-Za-z0-9]", "")) / n,
        "longest_run": F.length(F.regexp_extract(c, r"(.)\1{3,}", 0)) / n,
        "dictionary": (n - F.length(rest)) / n,
        "path_test": F.col("path").rlike(_any(TEST_PATHS)).cast("double"),
        "path_depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
        "key_before": around.rlike(_any(KEY_WORDS)).cast("double"),
        "hash_before": around.rlike(_any(HASH_WORDS)).cast("double"),
        "assigned": F.concat_ws(" ", "before", "raw").rlike(r"(=|:)\s*[\"']?[A-Za-z0-9+/_\-]{8,}|(=|:)$").cast("double"),
        "quoted": F.col("raw").rlike("[\"']").cast("double"),
        "key_after": F.col("after").rlike(_any(KEY_WORDS)).cast("double"),
    })


def fit(labelled: DataFrame, trees: int = 24, depth: int = 7, seed: int = 3, rows: int = TRAIN_ROWS) -> RandomForestClassificationModel:
    """A forest on labelled findings: (candidate, raw, before, after, path, label 0 or 1), the rows of the smallest hashes."""
    bounded = labelled.where("candidate is not null and label in (0, 1)").orderBy(F.xxhash64("candidate", "before", "path"), "candidate").limit(rows)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(with_features(bounded)).select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.9).fit(data)


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(key, word, nth, candidate_sha256, length, score, is_secret): every candidate of every whole text, with the forest's
    probability that it is a secret. The candidate itself is not returned. Null and empty texts give no rows, null paths
    count as empty, repeated rows repeat their findings, an empty table gives none, and other columns are not read."""
    found = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(with_features(candidates(docs, key, text, path)))
    scored = model.transform(found.select(F.col(key).alias("_key"), "word", "nth", "candidate", "features"))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return scored.select(
        F.col("_key").alias(key), "word", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), score.alias("score"), (score >= threshold).alias("is_secret")
    )


def labelled_findings(spark: SparkSession, n: int = 240, salt: str = "train") -> DataFrame:
    """Labelled findings made by rule, n of each form: keys of several formats beside the words that name them, and digests,
    identifiers, numbers, paths and placeholders that look like keys."""
    ids = spark.range(n).select(F.col("id"), F.concat(F.lit(salt), F.col("id").cast("string")).alias("s"))
    sha = F.sha1(F.col("s").cast("binary"))
    long = F.sha2("s", 256)
    base = F.regexp_replace(F.base64(F.unhex(F.substring(long, 1, 48))), "[=+/]", "7")
    pick = lambda *w: F.get(F.array(*[F.lit(x) for x in w]), F.pmod(F.xxhash64("s"), F.lit(len(w))).cast("int"))
    filler = pick("the of", "and in", "to be", "der die", "les des", "que los")
    source = pick("src0", "src7", "app/config.py", "deploy/settings.env", "lib/client.js")
    forms = [
        # (label, candidate, raw before, raw after, words before, path)
        (1, sha, '"', '"', F.concat(pick("token", "api_key", "secret", "auth_token"), F.lit(" =")), source),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(base, 1, 16))), "", "", pick("access key", "aws key", "the id"), source),
        (1, F.concat(F.lit("ghp_"), F.substring(F.concat(base, base), 1, 36)), '"', '"', pick("token =", "auth:", "password ="), source),
        (1, base, "", "", pick("password:", "api_key =", "secret =", "credential ="), source),
        (1, base, "password=", "", filler, source),
        (1, F.substring(long, 1, 32), "'", "',", pick("api key:", "private token"), source),
        (1, F.concat(F.lit("eyJ"), F.substring(base, 1, 20), F.lit("."), F.substring(base, 9, 24), F.lit("."), F.substring(base, 3, 28)), "", "", pick("Bearer", "token:", "auth ="), source),
        (1, F.concat(base, F.substring(base, 1, 32)), "", "", pick("PRIVATE KEY-----", "RSA PRIVATE KEY-----"), source),
        (1, F.translate(F.concat(base, F.substring(base, 5, 8)), "0123456789", "QxZvKpWjXq"), '"', '"', pick("password =", "api_key =", "secret:"), source),
        (0, F.concat(F.lit("InsertYourSecretTokenHere"), F.translate(F.substring(long, 1, 4), "0123456789", "abcdefghij")), '"', '"', pick("password =", "token =", "secret:"), source),
        (0, sha, "", "", pick("commit", "at revision", "sha1", "in commit"), source),
        (0, long, "", "", pick("sha256", "checksum", "digest:", "etag"), source),
        (0, sha, '"', '"', pick("checksum =", "commit =", "etag ="), source),
        (0, F.concat_ws("-", F.substring(long, 1, 8), F.substring(long, 9, 4), F.substring(long, 13, 4), F.substring(long, 17, 4), F.substring(long, 21, 12)), "", "", pick("uuid", "id", "request id", "order"), source),
        (0, F.substring(F.regexp_replace(long, "[a-f]", "4"), 1, 16), "", "", filler, source),
        (0, F.concat(F.lit("your-api-key-here-"), F.col("id").cast("string"), F.lit("-example")), '"', '"', pick("token =", "api_key ="), source),
        (0, F.concat(F.lit("example_token_"), F.lpad(F.col("id").cast("string"), 6, "0")), '"', '"', pick("token =", "secret ="), pick("tests/spec.js", "docs/readme.md", "examples/demo.py")),
        (0, F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.col("id").cast("string")), "", "", pick("password:", "key ="), source),
        (0, F.concat(F.lit("article/2024/photo-"), F.col("id").cast("string"), F.lit("-index-page")), "", "", filler, source),
        (0, F.concat(F.lit("InternationalBuildVersion"), F.col("id").cast("string")), "", "", filler, source),
        (0, F.concat(F.lit("theandingation"), F.col("id").cast("string"), F.lit("tionhereion")), "", "", filler, source),
    ]
    out = None
    for label, candidate, left, right, before, path in forms:
        part = ids.select(
            candidate.alias("candidate"), F.concat(F.lit(left), candidate, F.lit(right)).alias("raw"), before.alias("before"), F.lit("and").alias("after"), path.alias("path"), F.lit(label).alias("label")
        )
        out = part if out is None else out.unionByName(part)
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit(labelled_findings(spark)))
