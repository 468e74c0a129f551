"""Secret scan with a random forest that removes false positives.

Candidates are all stretches of key characters in the words of a text: those of 16 or more with a digit, and
those of 6 or more right after a word that asks for a secret. Each gets
features, all as SQL expressions: length, rate of changes between character classes, share of digits,
upper case and hex digits, longest share covered by dictionary words, path and address marks, and what its neighbouring
words say. A forest trained on labelled findings gives the probability that a candidate is a secret.

The labelled findings are ``FINDINGS`` generated ones (seeded, so of fixed number): keys, tokens and
passwords in the places where they leak, against commit hashes, checksums, identifiers,
paths, addresses, placeholders and long numbers. Training and scoring use DataFrame
operations only.

Null and empty texts have no candidates. Repeated rows are scanned each, and a stretch that a word repeats is a
candidate each time. Null keys stay. A probability of just ``THRESHOLD`` counts as a secret. An
empty table gives an empty result. Secrets of fewer than 16 characters, or without a digit, are candidates only right after
a word that asks.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import common

FINDINGS, TREES, DEPTH, SEED, THRESHOLD = 4000, 24, 7, 11, 0.5
FEATURES = ("length", "changes", "digits", "upper", "hexes", "dictionary", "paths", "address", "asks", "denies", "shape", "quoted")

# Word lists of the features.
ASKS = "token|secret|passw(?:or)?d|passwd|pwd|api_?key|apikey|access_?key|private_?key|auth|bearer|credential|client_?secret|key"
DENIES = "commit|sha1|sha256|md5|checksum|hash|digest|uuid|guid|example|sample|dummy|placeholder|test|build|revision|version|order|invoice|phone|card|id"
DICTIONARY = "about|account|admin|api|app|auth|backup|base|bin|build|cache|change|client|cloud|code|common|config|content|core|data|database|default|demo|dev|doc|document|domain|download|dummy|email|enter|error|example|file|folder|form|function|group|handler|home|host|html|http|https|image|index|info|insert|internal|json|key|lib|link|list|local|login|mail|main|manager|message|method|model|module|name|network|number|object|option|order|page|password|path|placeholder|process|product|project|public|query|replace|report|request|response|sample|script|secret|server|service|session|setting|site|source|static|status|store|string|system|table|target|template|test|text|time|token|type|update|upload|user|utils|value|version|view|web|with|your"
PREFIXES = "AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|eyJ[0-9A-Za-z_-]{10,}\\.[0-9A-Za-z_-]+|AIza[0-9A-Za-z_-]{30,}"
SHAPE = r"[A-Za-z0-9+/_=.\-:@]{6,}"
NEXT = rf"(?:^|[^a-z])(?:{ASKS})[a-z0-9_]*[^a-z0-9]*(?:(?:is|was)[^a-z0-9]+)?$"


def candidates(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """carried (a struct of columns ``carry``), word_no (from 0), candidate, word (the candidate with the stretch before it) and the words around it (before, after)."""
    rows = docs.select(F.struct(*carry).alias("carried"), F.split(F.col(text), r"[\x20\x09-\x0D]+").alias("words"), F.lower(text).rlike(ASKS).alias("asking"))
    near = lambda i, k: F.coalesce(F.get("words", i + k), F.lit(""))
    size = lambda i: F.length(F.get("words", i))
    asked = lambda i: F.lower(F.concat_ws(" ", *(F.get("words", i - k) for k in (3, 2, 1, 0)))).rlike(ASKS)
    at = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: (size(i) >= 6) & (((size(i) >= 16) & F.get("words", i).rlike("[0-9]")) | (F.col("asking") & asked(i))) & F.get("words", i).rlike(SHAPE),
    )
    i = F.col("word_no")
    before = F.when(i > 0, F.concat_ws(" ", F.when(i > 2, near(i, -3)), F.when(i > 1, near(i, -2)), near(i, -1))).otherwise("")
    # each match is the gap before a stretch and the stretch, so that a stretch that occurs twice has its own context
    pieces = F.regexp_extract_all(F.get("words", i), F.lit(rf"(?s)\G.*?{SHAPE}"), F.lit(0))
    found = (
        rows.where(F.size("words") > 0)
        .select("carried", "words", F.explode(at).alias("word_no"))
        .select("carried", "word_no", before.alias("before"), near(i, 1).alias("after"), pieces.alias("pieces"))
        .select("carried", "word_no", "before", "after", F.size("pieces").alias("n"), F.explode(F.transform("pieces", lambda x, k: F.struct(k.alias("k"), x.alias("piece"), F.get("pieces", k - 1).alias("last")))).alias("x"))
        .select("carried", "word_no", "before", "after", "n", "x.*", F.regexp_extract("x.piece", f"({SHAPE})$", 1).alias("candidate"))
        .select(
            "carried",
            "word_no",
            "candidate",
            F.concat(F.when(F.col("k") > 0, F.regexp_extract("last", f"({SHAPE})$", 1)).otherwise(""), F.expr("left(piece, length(piece) - length(candidate))")).alias("lead"),
            F.when(F.col("k") > 0, "").otherwise(F.col("before")).alias("before"),
            F.when(F.col("k") < F.col("n") - 1, "").otherwise(F.col("after")).alias("after"),
        )
    )
    told = F.lower(F.concat_ws(" ", "before", "lead")).rlike(NEXT)
    long = (F.length("candidate") >= 16) & F.col("candidate").rlike("[0-9]")
    return found.where(long | told).select("carried", "word_no", "candidate", F.concat("lead", "candidate").alias("word"), "before", "after")


def with_features(found: DataFrame) -> DataFrame:
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda kind: F.regexp_count(c, F.lit(kind)) / n
    around = F.lower(F.concat_ws(" ", "before", F.split_part("word", c, F.lit(1))))
    says = lambda words: (F.regexp_count(around, F.lit(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")) > 0).cast("double")
    made: dict[str, Column] = {
        "length": n,
        "changes": F.regexp_count(c, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "hexes": share("[0-9a-fA-F]"),
        "dictionary": (n - F.length(F.regexp_replace(F.lower(c), F.lit(DICTIONARY), F.lit("")))) / n,
        "paths": F.regexp_count(c, F.lit(r"[/\\]|\.[a-z]{2,4}(?:$|[^a-z])")).cast("double"),
        "address": F.regexp_count(c, F.lit("@|://|www[.]")).cast("double"),
        "asks": says(ASKS),
        "denies": says(DENIES),
        "shape": c.rlike(PREFIXES).cast("double"),
        "quoted": F.concat("before", "word").rlike("[=:]\\s*[\"']?|[\"'`]").cast("double"),
    }
    return found.withColumns(made)


def findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, float]]:
    """(candidate, word, before, after, label): generated labelled findings."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexes = lambda k: some(dig + "abcdef", k)
    plain = lambda: some(low, r.randint(2, 9))
    words = DICTIONARY.split("|")
    asks = ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key", "auth", "client_secret", "key"]
    denies = ["commit", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "build", "revision", "example", "test", "id"]
    secret = [
        lambda: hexes(r.choice([32, 40, 40, 40, 64])),
        lambda: hexes(r.choice([32, 40])).upper(),
        lambda: some(low + up + dig, r.randint(20, 48)),
        lambda: some(low + up + dig + "+/", r.randint(38, 64)) + "=" * r.randint(0, 2),
        lambda: "AKIA" + some(up + dig, 16),
        lambda: "ghp_" + some(low + up + dig, 36),
        lambda: "sk_live_" + some(low + up + dig, 24),
        lambda: some(low + up + dig, r.randint(6, 15)),
        lambda: some(low + up, r.randint(8, 20)),
        lambda: plain() + some(dig, r.randint(4, 6)),
        lambda: "xoxb-" + some(dig, 12) + "-" + some(low + up + dig, 24),
    ]
    harmless = [
        (lambda: hexes(r.choice([32, 40, 40, 64])), True),
        (lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)), True),
        (lambda: "/".join(r.choice(words) for _ in range(r.randint(2, 5))) + f"/{plain()}{r.randint(0, 99)}.{r.choice(['py', 'txt', 'html', 'json'])}", False),
        (lambda: f"https://{plain()}.{r.choice(['com', 'org', 'net'])}/{plain()}/{r.randint(1, 9999)}", False),
        (lambda: f"{plain()}.{r.randint(1, 99)}@{plain()}{r.randint(0, 9)}.example.com", False),
        (lambda: r.choice(["_", "-"]).join(r.choice(words) for _ in range(r.randint(3, 5))) + str(r.randint(0, 99)), False),
        (lambda: "your-" + r.choice(words) + "-" + r.choice(words) + "-here-" + str(r.randint(1, 9)), False),
        (lambda: some(dig, r.randint(16, 20)), False),
        (lambda: "".join(r.choice(words) for _ in range(r.randint(3, 5))) + str(r.randint(0, 99)), False),
        (lambda: r.choice(["x", "0", "1"]) * r.randint(16, 40) + r.choice(dig), False),
        (lambda: f"20{some(dig, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T0{r.randint(1, 9)}:{r.randint(10, 59)}:{r.randint(10, 59)}.000", False),
    ]
    out = []
    for i in range(n):
        if i % 2:
            c, key = r.choice(secret)(), r.choice(asks)
            form = r.randint(0, 4)
            if form == 4 and not c.startswith(("AKIA", "ghp_", "sk_live_", "xoxb-")):
                form = r.randint(0, 3)
            key = key.upper() if r.random() < 0.2 else key
            word, before = [(f'"{c}"', f"{plain()} {key} ="), (c, f"{plain()} {key}:"), (f'{key}="{c}"', f"{plain()} {plain()}"), (f"{c},", f"{plain()} {key} ="), (c, f"{plain()} {plain()}")][form]
        elif r.random() < 0.15:  # running text after a word that asks
            c = some(low, r.randint(6, 16))
            word, before = r.choice([c, c + ",", c + "."]), f"{plain()} {plain()} {r.choice(asks)}"
        else:
            make, denied = r.choice(harmless)
            c = make()
            key = r.choice(denies) if denied or r.random() < 0.2 else plain() if r.random() < 0.85 else r.choice(asks)
            word, before = r.choice([(c, f"{plain()} {key}"), (c, f"{plain()} {key} ="), (f'"{c}"', f"{plain()} {key}:"), (c + ".", f"{plain()} {key}")]) if denied else r.choice([(c, f"{plain()} {plain()} {key}"), (c + ",", f"{plain()} {key}"), (f"({c})", f"{plain()} {plain()}")])
        out.append((c, word, before, plain(), float(i % 2)))
    return out


def train(spark: SparkSession, labelled: list[tuple[str, str, str, str, float]] | None = None) -> RandomForestClassificationModel:
    rows = spark.createDataFrame(labelled or findings(), "candidate string, word string, before string, after string, label double").coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(rows))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)


def scan(docs: DataFrame, carry: list[str], model: RandomForestClassificationModel | None = None, text: str = "text") -> DataFrame:
    """Columns ``carry``, word_no, candidate, probability, is_secret: a row per candidate. Names altered where ``carry`` has them."""
    model = model or train(docs.sparkSession)
    names = common.unused(docs.select(*carry), "word_no", "candidate", "probability", "is_secret")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(docs, carry, text)))
    scored = model.transform(vectors).withColumn("probability", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return scored.select("carried.*", "word_no", "candidate", "probability", (F.col("probability") >= THRESHOLD).alias("is_secret")).toDF(*carry, *names)


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


QUERIES = {"op9_secret_forest": op9_secret_forest}
ORACLES: dict[str, str] = {}
