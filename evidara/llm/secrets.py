"""Secret scans: candidates by pattern, a random forest to remove false positives. DataFrame functions only.

A candidate is a vendor-prefixed key, a value assigned to a name, or a bare run of 16 or more token characters with a digit.
Its features are its length, the likelihood of its character transitions, how much of it dictionary words cover, its document's path and
the words next to it. Transitions and dictionary are learnt from the words of all documents (``learn``). A forest trained from labelled findings gives
the probability that a candidate is a secret.

Labelled findings are any frame with the columns of ``FINDINGS``; ``labelled_findings`` makes a bounded default set from
a rule (``n`` rows, half of them false positives: ids, digests of commits and files, card numbers, addresses, placeholders, paths,
ordinary words).

Results: one row per candidate with its character offset, probability and verdict; a null or empty text has none. A value that
occurs several times is reported at each place. Rows that repeat both id and text count once; different texts of one id, and rows without an id, are all scanned,
and ``text_hash`` tells whose finding it is. ``redact`` replaces what was judged a secret and leaves everything else as it is, in every row and column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.llm.common import dropped, written
from evidara.plans.registry import texts

#: Rows of the default training set; a forest of TREES trees of DEPTH levels is fitted to them.
LABELLED, TREES, DEPTH, SEED = 4000, 24, 7, 7
THRESHOLD = 0.5
#: Words of the learnt dictionary, the most frequent of MIN_WORD to MAX_WORD letters.
WORDS, MIN_WORD, MAX_WORD = 4096, 4, 20
#: Kinds of characters in transitions: 26 letters and everything else.
KINDS = 27
FINDINGS = "candidate string, before string, after string, path string, label double"

#: Public key prefixes of well-known services.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ")
#: Names that announce a secret, and names that announce another kind of identifier.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "bearer", "credential")
OTHER_NAMES = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "etag", "uuid", "guid", "hash", "version", "build", "card", "iban", "phone", "order", "invoice", "ip", "mail", "isbn")
#: Words that placeholders, paths and ordinary names are made of.
DICTIONARY = (
    "password secret token example sample test demo dummy changeme change your here insert value user name admin root public private default "
    "string number project service server client account access config setting environment production development staging version release build "
    "document report index table column message error warning request response session module package library function class object method"
).split()

#: No letter, digit or underscore before: Java releases differ in what \\b takes for a letter.
_BEGIN = "(?<![A-Za-z0-9_])"
_NAMED = r"(?i:token|secret|passwo?r?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)[\"']?\s{0,2}(?:=>|[:=])\s{0,2}"
#: A value in quotes ends at its quote (in the same line), any other at white space or a quote. A bare run is looked at from its start alone, once.
PATTERN = (
    r"(?:" + _BEGIN + "(?:" + "|".join(x.replace("-", r"\-") for x in PREFIXES) + r")[A-Za-z0-9_.\-]{12,})"
    + r"|(?:" + _NAMED + r"(?:\"[^\"\n]{6,}+(?=\")|'[^'\n]{6,}+(?=')|[\"']?[^\s\"']{6,}+))"
    + r"|(?:(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=.-]*+[0-9])[_+/=.-]*+[A-Za-z0-9][A-Za-z0-9_+/=.-]{15,}+)"
)
#: Left of the value within a match of the second or third kind.
ASSIGNED = r"^(?:" + _NAMED + r"[\"']?|[_+/=.-]+)"
TRAIL = r"[.,;:!?)\]}]+$"
CONTEXT = 48


@dataclass(frozen=True)
class Learnt:
    """What a corpus says of ordinary text. words: the most frequent; transitions: log-likelihood of each kind of character after each other, KINDS a row."""

    words: tuple[str, ...] = ()
    transitions: tuple[float, ...] = (0.0,) * KINDS**2


@dataclass(frozen=True)
class Scanner:
    forest: RandomForestClassificationModel
    learnt: Learnt


def learn(docs: DataFrame, *, text: str = "text") -> Learnt:
    """Dictionary and transitions from the counts of all words (runs of the letters a to z, in lower case) of all texts."""
    word = F.explode(F.split(F.lower(F.col(text)), "[^a-z]+"))
    counts = written(docs.select(word.alias("word")).where(F.length("word").between(2, MAX_WORD)).groupBy("word").agg(F.count("*").alias("n")))
    most = counts.where(F.length("word") >= MIN_WORD).orderBy(F.desc("n"), "word").limit(WORDS)
    kinds = F.concat(F.array(F.lit(KINDS - 1)), F.transform(F.split("word", ""), lambda x: F.ascii(x) - 97), F.array(F.lit(KINDS - 1)))
    pairs = counts.select("n", kinds.alias("k")).select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("k") - 2), lambda i: F.get("k", i) * KINDS + F.get("k", i + 1))).alias("pair"))
    found = {x["pair"]: float(x["n"]) for x in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # KINDS * KINDS rows at most
    words = tuple(x["word"] for x in most.select("word").collect())
    dropped(counts)
    rows = [[found.get(a * KINDS + b, 0.0) + 1.0 for b in range(KINDS)] for a in range(KINDS)]
    return Learnt(words, tuple(round(math.log(x / sum(row)), 9) for row in rows for x in row))


def _scanned(docs: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    """(doc_id, text, path, text_hash) of all rows with a text; those that repeat id and text once."""
    has_path = path is not None and path in docs.columns
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), (F.col(path) if has_path else F.lit(None)).cast("string").alias("path")).where("text is not null")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("doc_id", "text").agg(F.min("path").alias("path"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def candidates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id, text_hash, start (characters before it), candidate, before, after, path."""
    rows = _scanned(docs, key, text, path)
    found = rows.where(F.col("text").rlike(PATTERN)).select(
        "doc_id", "text_hash", "path", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"), F.split("text", PATTERN, -1).alias("around")
    )
    # text before the i-th match is around[i], after it around[i + 1]
    parts = F.transform("found", lambda m, i: F.struct(i.alias("i"), m.alias("match"), F.length(F.get("around", i)).alias("gap"), F.substring(F.get("around", i), -CONTEXT, CONTEXT).alias("before"), F.substring(F.get("around", i + 1), 1, CONTEXT).alias("after")))
    one = found.select("doc_id", "text_hash", "path", F.inline(parts))
    upto = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("doc_id", "text_hash").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    one = one.withColumn("at", upto - F.length("match"))
    name = F.regexp_extract("match", ASSIGNED, 0)
    raw = F.substr("match", F.length(name) + 1)
    mark = F.regexp_extract(name, "[\"']$", 0)
    quoted = (mark != "") & F.startswith(F.coalesce("after", F.lit("")), mark)
    value = F.when(quoted, raw).otherwise(F.regexp_replace(raw, TRAIL, ""))
    return one.select(
        "doc_id", "text_hash", (F.col("at") + F.length(name)).cast("int").alias("start"), value.alias("candidate"), F.concat(F.coalesce("before", F.lit("")), name).alias("before"), "after", "path"
    ).where(F.length("candidate") >= 6)


def features(df: DataFrame, learnt: Learnt) -> tuple[DataFrame, list[str]]:
    """Feature columns of candidate, before, after and path."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    low = F.lower(c)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[A-Z]", "A"), "[a-zß-öø-ÿ]", "a"), "[^9Aa]", ".")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = lambda names: "|".join(names)
    near = F.lower(F.concat(F.substring(F.coalesce("before", F.lit("")), -24, 24), F.lit(" "), F.substring(F.coalesce("after", F.lit("")), 1, 12)))
    left = F.lower(F.substring(F.coalesce("before", F.lit("")), -24, 24))
    path = F.lower(F.coalesce("path", F.lit("")))
    letters = F.concat(F.lit(" "), low, F.lit(" "))
    kind = F.transform(F.split(letters, ""), lambda x: F.when(x.rlike("^[a-z]$"), F.ascii(x) - 97).otherwise(KINDS - 1))
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in learnt.transitions) + ")")
    likelihood = F.aggregate(F.zip_with(F.slice(kind, 1, n + 1), F.slice(kind, 2, n + 1), lambda a, b: a * KINDS + b), F.lit(0.0), lambda a, i: a + F.get(table, i.cast("int")))
    runs = F.transform(F.split(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+"), lambda x: F.lower(x))
    # words are letters a to z alone, so they can stand in an expression
    known = [x for x in sorted({*DICTIONARY, *learnt.words}) if x.isascii() and x.isalpha()]
    df = df.withColumn("_runs", runs)
    covered = F.expr("aggregate(transform(_runs, x -> if(x in (" + ",".join(f"'{x}'" for x in known) + "), length(x), 0)), 0, (a, b) -> a + b)")
    made: dict[str, Column] = {
        "f_length": n.cast("double"),
        "f_class_changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "f_letter_digit": (count(kinds, "(?<=[Aa])9") + count(kinds, "(?<=9)[Aa]")) / n,
        "f_case_changes": (count(kinds, "(?<=A)a") + count(kinds, "(?<=a)A")) / n,
        "f_vowel_consonant": count(low, "(?<=[aeiou])[bcdfghjklmnpqrstvwxyz]") / n,
        "f_transitions": likelihood / (n + 1),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_digits": count(c, "[0-9]") / n,
        "f_hex": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "f_all_digits": c.rlike("^[0-9.:-]+$").cast("double"),
        "f_prefix": c.rlike("^(?:" + words(PREFIXES) + ")").cast("double"),
        "f_shape_id": c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|@|://|^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$").cast("double"),
        "f_dictionary": F.greatest(1 - F.length(F.regexp_replace(low, words(DICTIONARY), "")) / n, covered / n),
        "f_repeats": count(low, r"(.)\1\1") / n,
        "f_near_secret": near.rlike(words(SECRET_NAMES)).cast("double"),
        "f_near_other": left.rlike(words(rf"\b{x}\b" for x in OTHER_NAMES)).cast("double"),
        "f_assigned": F.coalesce("before", F.lit("")).rlike("[=:]\\s{0,2}[\"']?$").cast("double"),
        "f_quoted": F.coalesce("after", F.lit("")).rlike("^[\"']").cast("double"),
        "f_path_test": path.rlike("test|example|sample|fixture|mock|docs?/").cast("double"),
        "f_path_config": path.rlike("\\.env|config|settings|\\.ya?ml|\\.properties|credential").cast("double"),
    }
    return df.withColumns(made).drop("_runs"), list(made)


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """A bounded default training set made by rule from row numbers; the same for the same n."""
    ids = spark.range(0, n, 1, 4)
    salt = lambda s: F.sha2(F.concat(F.lit(s), F.col("id").cast("string")), 256)
    pick = lambda values, s: F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(len(values))) + 1).cast("int"))
    word = lambda s: pick(DICTIONARY, s)
    b64 = F.regexp_replace(F.base64(F.unhex(salt("b"))), "=+$", "")
    upper = F.translate(F.upper(salt("u")), "0123456789", "QRSTUVWXYZ")
    mixed = F.concat(F.substring(upper, 1, 7), F.substring(F.upper(salt("m")), 1, 9))
    true = [F.substring(salt("a"), 1, 40), F.substring(salt("a"), 1, 18), F.concat(F.lit("AKIA"), mixed), b64, F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)), F.upper(F.substring(salt("c"), 1, 40)), F.concat(F.lit("AKIA"), F.substring(upper, 1, 16))]
    false = [
        F.substring(salt("d"), 1, 40), F.concat_ws("-", F.substring(salt("e"), 1, 8), F.substring(salt("e"), 9, 4), F.substring(salt("e"), 13, 4), F.substring(salt("e"), 17, 4), F.substring(salt("e"), 21, 12)),
        F.translate(F.substring(salt("f"), 1, 16), "abcdef", "123456"), F.concat(word("g"), F.lit("_"), word("h"), F.lit("_"), F.col("id").cast("string")), F.concat(F.lit("your_"), word("i"), F.lit("_here")),
        F.concat(word("j"), F.lit("."), F.pmod("id", F.lit(99)).cast("string"), F.lit("@mail"), F.pmod("id", F.lit(9)).cast("string"), F.lit(".example.com")), F.concat(word("k"), F.lit("/"), word("l"), F.lit("/"), word("m"), F.lit("-v"), F.pmod("id", F.lit(40)).cast("string"), F.lit(".json")), F.lit("xxxxxxxxxxxxxxxx"),
    ]
    true_before = [F.concat(pick(SECRET_NAMES, "n"), pick((" = \"", "=", ": ", " = '"), "o")), F.concat(pick(SECRET_NAMES, "p"), F.lit("=")), F.concat(word("q"), F.lit(" ")), F.concat(pick(SECRET_NAMES, "n"), F.lit(": \"")), F.concat(word("q"), F.lit(" ")), F.concat(word("r"), F.lit(" = ")), F.concat(F.upper(pick(SECRET_NAMES, "n")), F.lit(" = \"")), F.concat(word("s"), F.lit(" "))]
    false_before = [F.concat(pick(OTHER_NAMES, "n"), pick((" ", "=", ": ", " = \""), "o")), F.concat(pick(("id", "uuid", "request"), "p"), pick((" ", "=", ": "), "o")), F.concat(word("q"), F.lit(" ")), F.concat(pick(SECRET_NAMES, "n"), pick((" = \"", "=", " "), "o")), F.concat(pick(SECRET_NAMES, "n"), pick(("=", ": "), "o")), F.concat(word("t"), F.lit(" ")), F.concat(word("v"), F.lit(" ")), F.concat(pick(SECRET_NAMES, "n"), F.lit("="))]
    kind, positive = (F.pmod(F.shiftright("id", 1), F.lit(8)) + 1).cast("int"), F.pmod("id", F.lit(2)) == 0
    of = lambda t, f: F.when(positive, F.element_at(F.array(*t), kind)).otherwise(F.element_at(F.array(*f), kind))
    before = of(true_before, false_before)
    return ids.select(
        of(true, false).alias("candidate"), before.alias("before"), F.when(before.rlike("[\"']$"), F.lit("\" ")).otherwise(F.concat(F.lit(" "), word("w"))).alias("after"),
        pick(("src0", "src7", "config/app.yml", "src/main.py", ".env", "notes.txt", "tests/data.json"), "x").alias("path"), positive.cast("double").alias("label"),
    )


def fit(findings: DataFrame, learnt: Learnt) -> Scanner:
    """A forest from labelled findings (candidate, before, after, path, label)."""
    made, names = features(findings.where("candidate is not null and label is not null"), learnt)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(made).select("features", "label")
    return Scanner(RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows), learnt)


def scan(docs: DataFrame, scanner: Scanner, *, key: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate with its probability: doc_id, text_hash, start, length, candidate, probability, is_secret."""
    made, names = features(candidates(docs, key=key, text=text, path=path), scanner.learnt)
    scored = scanner.forest.transform(VectorAssembler(inputCols=names, outputCol="features").transform(made))
    p = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "text_hash", "start", F.length("candidate").alias("length"), "candidate", p.alias("probability"), (p >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, *, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Documents with every finding that was judged a secret replaced by a mark; all columns and rows stay.

    A finding belongs to the rows of its id and text, so rows that repeat an id are each redacted by their own findings."""
    spans = findings.where("is_secret").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    folded = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"), (s["start"] + s["length"]).alias("at")),
        lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)),
    )
    new = F.when(F.col("spans").isNull(), F.col("text")).otherwise(folded)
    return joined.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    found = scan(docs, fit(labelled_findings(spark), learn(docs)))
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("value_sha256"), "probability", "is_secret")
