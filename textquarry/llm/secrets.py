"""Secret scan: candidate strings, and a random forest that removes false findings.

Candidates are the longest runs of 16 or more letters, digits and ``+/_-`` with at
least one digit, with the word before them, and besides them the values of six or
more characters without space that are assigned (``=``, ``:``) to a secret-bearing word,
with or without digits; such a value ends before a quote and before punctuation
that stands at its end.  Features: length, share of digits
and of upper case, distinct characters, share of signs, changes between letters and digits and
between cases, how likely its neighbouring letters are in dictionary words, hexadecimal
only, digits only, share of letters in dictionary words, path separators, the
neighbouring word (whether it assigns, ``=`` or ``:``, and how often such words stood
before secrets in the labelled findings), and the path (how often findings there
were secrets, and whether it is of tests or examples).

The forest is learnt from labelled findings (``value``, ``before``, ``label``, and if
there are such columns ``lead``, the text between word and value, and ``path``): by
default rule-labelled candidates of a bounded sample of documents (``max_docs``,
4000; ``max_findings`` of them, 8000) and made-up findings of known secret and
harmless forms.  Dictionary words are counted over all documents: those in a
``SHARE`` of them.  All of it, learning included, is DataFrame and JVM code.

Defined results
* null or empty text: no findings.  Null ids pass through as null.
* a string that stands in a document many times is one finding with its count and
  the place of its first match; word and score are those of the place that scores
  most (of several, the first).  A row in the input many times has its findings as often.
* empty table: no rows.  Extra columns but the path are not read; without a path it is empty.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.session import Scratch, small

# The form of a candidate and of the word and sign before it.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
LEAD = r"(?:(?<![A-Za-z_.-])[A-Za-z_.-]{2,32}+[\"']?[ \t]{0,2}[=:]?[ \t]{0,2})?[\"']?\z"
#: A lead has fewer characters than this, and one more tells where its word begins.
LEAD_CHARS = 64
RUN = r"^(?=.*[0-9])[A-Za-z0-9+/_-]{16,}$"
BEFORE = r"^([A-Za-z_.-]{2,32})[\"']?[ \t]*[=: \"']"
# Fixed value: a value assigned to a secret-bearing word; its last three groups hold the value.
ASSIGNED = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:password|passwd|pwd|token|secret|api[_.-]?key|access[_.-]?key|auth[_.-]?token|private[_.-]?key)[\"']?[ \t]{0,2}(?::=|=>|==|[=:])[ \t]{0,2}(?:\"([^\"\s]{6,})(?=\"|$)|'([^'\s]{6,})(?='|$)|[\"']?([^\s\"']{5,}[^\s\"'.,;:)\]}>]))"
# Forms that label a finding as a secret.
SECRET_VALUE = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abps]-[0-9A-Za-z-]{16,}|sk_live_[0-9A-Za-z]{16,})$"
SECRET_WORD = r"^(password|passwd|pwd|token|secret|api[_.-]?key|access[_.-]?key|auth[_.-]?token|private[_.-]?key)$"
#: Assigned values that are no secrets: numbers, one word after a colon, stars, and names that are filled in.
HARMLESS_VALUE = r"^([0-9]+|[*x.X-]+|[$%<{\[(].*|[A-Za-z_.]+[(\[].*|(?i:true|false|none|null|undefined)\W*)$"
PROSE_VALUE = r"^[A-Za-z]?[a-z]+\W?$"
#: Paths whose findings are mostly made up.
TEST_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|mocks?|docs?)([/_.-]|$)"
FEATURES = "length digits upper distinct signs flips cases letters hex number dictionary slashes assigns quoted word_odds path_odds test_path".split()
#: A dictionary word stands in this share of all documents, and in two at least.
SHARE = 0.001


@dataclass
class SecretModel:
    forest: Model
    dictionary: DataFrame
    pairs: dict[str, float]
    odds: DataFrame


def _places(text: Column, hits: Column, pattern: str, kind: int) -> Column:
    """kind, hit, the hit before, and the length and end of the text between them, of each match in order."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    made = lambda x, i: F.struct(F.lit(kind).alias("kind"), x["hit"].alias("hit"), F.get(hits, i - 1).alias("last"), F.length(x["gap"]).cast("long").alias("gap"), F.right(x["gap"], F.lit(LEAD_CHARS)).alias("near"))
    return F.transform(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), made)


def _lead(hit: Column, near: Column, last: Column) -> Column:
    """The word and sign right before a run: of whole words only, and not what the run itself goes on from."""
    near = F.when(last.rlike("[A-Za-z_-]$"), F.regexp_replace(near, "^[A-Za-z_.-]+", "")).otherwise(near)
    lead = F.regexp_extract(near, LEAD, 0)
    return F.when(hit.rlike("^[A-Za-z_-]") & lead.rlike("[A-Za-z_.-]$"), "").otherwise(lead)


def candidates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """row, doc_id, path, value, before, lead, n, start (code points): the candidates of each row by value and lead.

    ``row`` tells rows of the input apart; ``start`` is the first of the ``n`` matches.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), where.alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    runs = F.regexp_extract_all("__t", F.lit(CANDIDATE), F.lit(0))
    named = F.regexp_extract_all("__t", F.lit(ASSIGNED), F.lit(0))
    # Made by a generator of one row, as filters on plain columns would be pushed below and match again.
    rows = rows.select("doc_id", "path", "__t", F.inline(F.array(F.struct(runs.alias("__f"), named.alias("__g"))))).where("size(__f) > 0 or size(__g) > 0")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # Texts without hits are gone; from here on only hits are carried, and a row is known by its number.
    hits = F.concat(_places(F.col("__t"), F.col("__f"), CANDIDATE, 0), _places(F.col("__t"), F.col("__g"), ASSIGNED, 1))
    rows = rows.select("row", "doc_id", "path", F.posexplode(hits).alias("pos", "h"))
    # A match begins after all gaps up to it and all matches before it.
    length = F.length("h.hit").cast("long")
    upto = F.sum(F.col("h.gap") + length).over(Window.partitionBy("row", "h.kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    assigned = F.concat(*[F.regexp_extract("h.hit", ASSIGNED, i) for i in (1, 2, 3)])
    is_run = F.col("h.kind") == 0
    before = F.when(is_run, _lead(F.col("h.hit"), F.col("h.near"), F.col("h.last"))).otherwise("")
    rows = rows.select("row", "doc_id", "path", "h.kind", F.concat(before, "h.hit").alias("hit"), (upto - length - F.length(before)).alias("at"), F.when(is_run, F.col("h.hit")).otherwise(assigned).alias("value"))
    # Assigned values that are runs are candidates already.
    rows = rows.where((F.col("kind") == 0) | ~F.col("value").rlike(RUN))
    lead = F.substring("hit", F.lit(1), F.length("hit") - F.length("value"))
    rows = rows.select("row", "doc_id", "path", "value", F.lower(F.regexp_extract("hit", BEFORE, 1)).alias("before"), lead.alias("lead"), (F.col("at") + F.length(lead)).alias("start"))
    return rows.groupBy("row", "doc_id", "path", "value", "before", "lead").agg(F.count("*").alias("n"), F.min("start").alias("start"))


def rule_label() -> Column:
    """1 for the forms known as secrets, 0 for any other."""
    assigned = F.col("before").rlike(SECRET_WORD) & F.col("lead").rlike("[=:]")
    prose = F.col("value").rlike(PROSE_VALUE) & ~F.col("lead").contains("=")
    return (F.col("value").rlike(SECRET_VALUE) | (assigned & ~F.col("value").rlike(HARMLESS_VALUE) & ~prose)).cast("int")


def made_up(spark, count: int = 2400) -> DataFrame:
    """value, before, lead, label: findings of known secret and harmless forms, from hashes of numbers."""
    t = F.col("id").cast("string")
    md5, sha = F.md5(t), F.sha1(t)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(t, 256))), "[^A-Za-z0-9]", "x")
    word = F.element_at(F.array(*[F.lit(w) for w in "the of report page see in file number item and".split()]), (F.col("id") % 10 + 1).cast("int"))
    forms = [
        (F.concat(F.lit("AKIA"), F.substring(F.upper(mixed), 1, 16)), word, " ", 1),
        (F.substring(md5, 1, 18), F.lit("password"), "=", 1),
        (sha, F.lit("token"), ' = "', 1),
        (F.substring(mixed, 1, 32), F.lit("api_key"), ": ", 1),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), word, " ", 1),
        (F.substring(mixed, 1, 40), F.lit("secret"), "=", 1),
        (F.lpad(F.conv(F.substring(md5, 1, 14), 16, 10), 16, "4"), word, " ", 0),
        (sha, F.lit("commit"), " ", 0),
        (F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 4), F.substring(md5, 21, 12)), word, " ", 0),
        (F.concat(F.lit("static/js/main-"), F.substring(md5, 1, 8)), word, " ", 0),
        (md5, F.lit("checksum"), ": ", 0),
        (F.concat(word, F.lit("-report-final-"), F.substring(F.conv(F.substring(md5, 1, 8), 16, 10), 1, 4)), word, " ", 0),
        (F.concat(F.initcap(word), F.substring(mixed, 1, 6)), F.lit("password"), "=", 1),
        (F.concat(F.substring(mixed, 1, 5), F.lit("!"), F.substring(mixed, 6, 4), F.lit("@"), word), F.lit("pwd"), ": ", 1),
        (F.concat(F.substring(mixed, 1, 20), F.lit("."), F.substring(mixed, 21, 15)), F.lit("token"), ": ", 1),
        (F.concat(F.translate(F.substring(md5, 1, 8), "0123456789", "ghijklmnop"), word), F.lit("passwd"), "=", 1),
        (F.concat(F.lit("${"), F.upper(word), F.lit("_PASSWORD")), F.lit("password"), "=", 0),
        (F.repeat(F.lit("*"), F.pmod("id", F.lit(9)).cast("int") + 6), F.lit("password"), "=", 0),
        (F.concat(F.lit("get_"), word, F.lit("("), word), F.lit("secret"), "=", 0),
        (F.element_at(F.array(*[F.lit(w) for w in "something required another therefore however usually".split()]), (F.pmod("id", F.lit(6)) + 1).cast("int")), F.lit("secret"), ": ", 0),
        (F.substring(F.conv(F.substring(md5, 1, 14), 16, 10), 1, 8), F.lit("token"), ": ", 0),
    ]
    made = F.element_at(F.array(*[F.struct(v.alias("value"), b.alias("before"), F.concat(b, F.lit(s)).alias("lead"), F.lit(y).alias("label")) for v, b, s, y in forms]), (F.pmod(F.xxhash64("id"), F.lit(len(forms))) + 1).cast("int"))
    return spark.range(count).select(made.alias("m")).select("m.*")


def dictionary_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """w: the runs of four or more letters that stand in a ``SHARE`` of all documents, and in two at least."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))
    # The empty word stands in every document, so its count is theirs.
    counts = docs.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), words))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = Scratch(docs.sparkSession, "secret-words").write(counts.where("n > 1"), "counts")
    total = counts.where("w = ''").first()
    return counts.where((F.col("w") != "") & (F.col("n") >= SHARE * (total["n"] if total else 0))).select("w")


def _covered(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``rows`` with __covered, the letters of the value's distinct dictionary words."""
    columns = rows.columns
    runs = F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,}"), F.lit(0)))
    # SHARE bounds this side by the mean distinct words of a document over SHARE, so it may be broadcast.
    known = F.broadcast(dictionary.select(F.col("w").alias("__w"), F.length("w").alias("__n")))
    parts = rows.select(*columns, F.explode_outer(runs).alias("__w")).join(known, "__w", "left")
    sums = parts.groupBy(*columns).agg(F.count("*").alias("__rows"), F.coalesce(F.sum("__n"), F.lit(0)).alias("__sum"))
    # Equal rows were summed up together; each is returned.
    times = (F.col("__rows") / F.greatest(F.size(runs), F.lit(1))).cast("int")
    return sums.select(*columns, (F.col("__sum") / times).alias("__covered"), F.explode(F.array_repeat(F.lit(0), times)).alias("__i")).drop("__i")


def letter_pairs(dictionary: DataFrame) -> dict[str, float]:
    """The log share of each pair of neighbouring letters in the dictionary words (26 x 26 at most)."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2))))
    counts = {r["p"]: r["n"] for r in dictionary.select(pair.alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values()) + 26 * 26
    return {p: round(math.log((n + 1) / total), 6) for p, n in sorted(counts.items())} | {"": round(math.log(1 / total), 6)}


def _letters(value: Column, pairs: dict[str, float]) -> Column:
    """The mean log share of the pairs of neighbouring letters of a value; without any, that of an unknown pair."""
    known = F.from_json(F.lit(json.dumps(pairs)), "map<string,double>")
    found = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))), lambda i: F.substring(F.lower(value), i, F.lit(2))), lambda p: p.rlike("^[a-z]{2}$"))
    total = F.aggregate(found, F.lit(0.0), lambda s, p: s + F.coalesce(F.element_at(known, p), F.lit(pairs[""])))
    return F.when(F.size(found) > 0, total / F.size(found)).otherwise(F.lit(pairs[""]))


def _features(rows: DataFrame, dictionary: DataFrame, pairs: dict[str, float], odds: DataFrame) -> DataFrame:
    """The columns of ``FEATURES`` beside those of ``rows``."""
    columns = rows.columns
    rows = _covered(rows, dictionary)
    for name in ("before", "path"):
        of = odds.where(F.col("what") == name).select(F.col("key").alias(name), F.col("odds").alias(f"__{name}_odds"))
        rows = rows.join(small(of), name, "left")
    v = F.col("value")
    n = F.length(v).cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    made = {
        "length": n, "digits": share("[0-9]"), "upper": share("[A-Z]"), "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "signs": share("[^A-Za-z0-9+/_-]"), "flips": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"), "cases": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "letters": _letters(v, pairs), "hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"), "number": v.rlike("^[0-9_+/-]+$").cast("double"),
        "dictionary": F.col("__covered") / n, "slashes": share("[/-]"),
        "assigns": F.col("lead").rlike("[=:]").cast("double"), "quoted": F.col("lead").rlike("[\"']$").cast("double"), "word_odds": F.coalesce("__before_odds", F.lit(0.0)),
        "path_odds": F.coalesce("__path_odds", F.lit(0.0)), "test_path": F.col("path").rlike(TEST_PATH).cast("double"),
    }
    return rows.select(*columns, *[c.cast("double").alias(f"__{k}") for k, c in made.items()])


_ASSEMBLER = dict(inputCols=[f"__{f}" for f in FEATURES], outputCol="__x", handleInvalid="keep")


def _findings(rows: DataFrame) -> DataFrame:
    """value, before, lead, path, label of labelled findings; a missing lead is a space after the word."""
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), default) if c in rows.columns else default
    rows = rows.withColumn("before", F.coalesce(F.lower("before"), F.lit("")))
    return rows.select(F.col("value").cast("string").alias("value"), "before", text("lead", F.concat("before", F.lit(" "))).alias("lead"), text("path", F.lit("")).alias("path"), F.col("label").cast("int").alias("label")).where("value <> '' and label is not null")


def fit(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", row_id: str = "doc_id", path: str | None = None, max_docs: int = 4000, max_findings: int = 8000, trees: int = 24, depth: int = 6, seed: int = 9) -> SecretModel:
    """The forest learnt from ``findings`` (value, before, label; lead, path), or from the default ones."""
    spark = docs.sparkSession
    dictionary = dictionary_words(docs, text)
    if findings is None:
        ids = docs.select(F.col(row_id).cast("long").alias("__id")).dropna().distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
        # max_docs bounds this side, so it may be broadcast at any size of the corpus.
        some = docs.join(F.broadcast(ids), F.col(row_id).cast("long") == F.col("__id"), "left_semi")
        found = candidates(some, text, row_id, path).select("value", "before", "lead", "path").withColumn("label", rule_label())
        findings = found.distinct().orderBy(F.xxhash64("value"), "value", "before", "lead", "path").limit(max_findings).unionByName(made_up(spark).withColumn("path", F.lit("")))
    findings = Scratch(spark, "secret-findings").write(_findings(findings), "findings")
    odds = None
    for name in ("before", "path"):
        n, y = F.count("*").alias("n"), F.sum("label").alias("y")
        one = findings.groupBy(F.col(name).alias("key")).agg(n, y).where("n >= 5 and key <> ''")
        one = one.select(F.lit(name).alias("what"), "key", F.log((F.col("y") + 0.5) / (F.col("n") - F.col("y") + 0.5)).alias("odds"))
        odds = one if odds is None else odds.unionByName(one)
    odds = Scratch(spark, "secret-odds").write(odds, "odds")
    pairs = letter_pairs(dictionary)
    rows = VectorAssembler(**_ASSEMBLER).transform(_features(findings, dictionary, pairs, odds)).select("__x", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(rows)
    return SecretModel(forest, dictionary, pairs, odds)


def scan(docs: DataFrame, model: SecretModel, threshold: float = 0.5, text: str = "text", row_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, path, value, before, n, start, score and secret of every finding; ``secret`` is what the forest keeps."""
    rows = _features(candidates(docs, text, row_id, path), model.dictionary, model.pairs, model.odds)
    scored = model.forest.transform(VectorAssembler(**_ASSEMBLER).transform(rows))
    scored = scored.withColumn("score", F.round(vector_to_array("probability")[1], 9))
    best = F.max(F.struct("score", (-F.col("start")).alias("s"), "before")).alias("best")
    one = scored.groupBy("row", "doc_id", "path", "value").agg(F.sum("n").alias("n"), F.min("start").alias("start"), best)
    return one.select("doc_id", "path", "value", F.col("best.before").alias("before"), "n", "start", F.col("best.score").alias("score")).withColumn("secret", F.col("score") >= threshold)


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """``scan`` with a model learnt from ``findings`` or the default ones."""
    return scan(docs, fit(docs, findings, path=path), path=path)
