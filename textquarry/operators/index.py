"""An inverted index as tables: postings sorted by term, terms with document counts, corpus totals.

Built once, it answers a query from the postings of its few terms: files hold ranges
of (term, id), so the filter prunes to the files and row groups of the terms, and the
postings of a frequent term are spread over files.  The files are as many as the
postings need at ``PART_ROWS`` a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions import text as T
from textquarry.operators.search import B, K1, parsed_query
from textquarry.session import Scratch, small

#: Postings in a file, about 100 MB of them.
PART_ROWS = 8_000_000


def postings(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """term, id, tf, dl.  Terms are counted within each row's array: no exchange."""
    t = T.words(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(row_id).alias("id"), F.array_sort(t).alias("t")).withColumn("dl", F.size("t"))
    # In a sorted array a term's run ends where the next element differs.
    n = F.size("t")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == n) | (F.get("t", i) != F.get("t", i - 1))))
    runs = F.transform(F.arrays_zip(ends.alias("e"), F.concat(F.array(F.lit(0)), ends).alias("s")), lambda r: F.struct(F.get("t", r["e"] - 1).alias("term"), (r["e"] - r["s"]).alias("tf"), r["e"].alias("e")))
    out = rows.select("id", "dl", F.explode(F.filter(runs, lambda r: r["e"].isNotNull())).alias("r"))
    return out.select("r.term", "id", "r.tf", "dl")


def term_counts(postings_: DataFrame) -> DataFrame:
    """term, df, cf: documents and occurrences of each term."""
    return postings_.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def fingerprint(docs: DataFrame) -> str:
    """What tells one set of rows from another: their number and the sum of their hashes over all columns."""
    r = docs.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*docs.columns).cast("decimal(20,0)")).alias("h")).first()
    return f"{r['n']}:{r['h']}"


def built_from(spark: SparkSession, path: str) -> str | None:
    """The fingerprint that an index was stored with."""
    return spark.read.parquet(f"{path}/corpus").select("built_from").first()[0]


def build(docs: DataFrame, path: str, text: str = "text", row_id: str = "doc_id", built_from: str | None = None) -> None:
    """Writes the index, with the fingerprint of what it is built from; texts are tokenised once, and the postings sorted from what was written."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "postings")
    p = scratch.write(postings(docs, text, row_id), "raw")
    files = max(1, -(-p.count() // PART_ROWS))
    p.repartitionByRange(files, "term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    scratch.drop()
    term_counts(spark.read.parquet(f"{path}/postings")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    size = F.size(T.words(F.coalesce(F.col(text), F.lit(""))))
    docs.agg(F.count("*").alias("n"), F.avg(size).alias("avgdl")).withColumn("built_from", F.lit(built_from).cast("string")).write.mode("overwrite").parquet(f"{path}/corpus")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole index is at ``path``: its last table is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/corpus/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """id, score of all documents that hold a term of the query, as ``search.bm25`` scores them; none for a query without words."""
    return score(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/corpus"), query)


#: Terms that are handed to the scan as a list, so that it reads only their files.
LISTED = 1000


def search_many(spark: SparkSession, path: str, queries: DataFrame, key: str, query: str = "query", k: int = 10) -> DataFrame:
    """key, id, score, rn: the ``k`` best documents of each query, all queries in one plan.

    The queries' distinct words are joined with the postings and their document counts; scores are sums over the words
    a document holds, and a group limit keeps ``k`` of a query before the exchange.
    """
    wanted = queries.select(key, F.explode(F.array_distinct(T.words(F.col(query)))).alias("term"))
    p, terms, corpus = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "corpus"))
    some = wanted.select("term").distinct().limit(LISTED + 1).collect()  # bounded by its limit
    if len(some) <= LISTED:
        p = p.where(F.col("term").isin([r["term"] for r in some]))
    c = corpus.first()
    known = wanted.join(terms.select("term", "df"), "term")
    idf = F.log(F.lit(1.0) + (F.lit(c["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hits = p.join(small(known.select(key, "term", idf.alias("idf"))), "term")
    n = F.col("tf").cast("double")
    part = F.col("idf") * (n * (K1 + 1)) / (n + K1 * (1 - B + B * F.col("dl") / F.lit(c["avgdl"])))
    scored = hits.groupBy(key, "id").agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)


def score(postings_: DataFrame, terms: DataFrame, corpus: DataFrame, query: str) -> DataFrame:
    wanted = parsed_query(query)
    c = corpus.first()
    df = {r["term"]: r["df"] for r in terms.where(F.col("term").isin(wanted)).collect()}
    wanted = [t for t in wanted if t in df]
    if not wanted:
        return postings_.select("id", F.lit(0.0).alias("score")).where("false")
    hits = postings_.where(F.col("term").isin(wanted))
    tf = lambda t: F.max(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).cast("double")
    rows = hits.groupBy("id").agg(F.max("dl").alias("dl"), *[tf(t).alias(f"n{i}") for i, t in enumerate(wanted)])
    total = F.lit(0.0)
    for i, t in enumerate(wanted):
        idf = F.log(F.lit(1.0) + F.lit((c["n"] - df[t] + 0.5) / (df[t] + 0.5)))
        n = F.col(f"n{i}")
        total = total + idf * (n * (K1 + 1)) / (n + K1 * (1 - B + B * F.col("dl") / F.lit(c["avgdl"])))
    return rows.select("id", F.round(total, 6).alias("score"))
