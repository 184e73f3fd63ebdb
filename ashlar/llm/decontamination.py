"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly; in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, spare, stage, table

SHINGLE, CONTAINMENT = 5, 0.8
#: Sketch values of an item beyond the least number that makes the search complete.
SPARE = 4
#: Sketches of at most this many values (16 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_VALUES = 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hashed_words(text: Column) -> Column:
    """The 64-bit hashes of a text's words in order.

    Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased; an empty text and null give an empty array.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(text: Column, width: int = SHINGLE, shorter: Column | None = None) -> Column:
    """The distinct 64-bit hashes of a text's runs of `width` words, and of as many words as each of shorter says.

    shorter is an array of lengths below width, those of short items. A text of fewer words than a length has no such run.
    """
    runs = lambda h, n: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    of = lambda h, n: F.when(F.size(h) >= n, runs(h, n)).otherwise(F.array().cast("array<bigint>"))
    more = lambda h: [] if shorter is None else [F.when(F.array_contains(shorter, n), of(h, n)).otherwise(F.array().cast("array<bigint>")) for n in range(1, width)]
    # aggregate() binds the hashed words once; named twice they would be computed twice.
    return F.aggregate(F.array(hashed_words(text)), F.array().cast("array<bigint>"), lambda acc, h: F.array_distinct(F.concat(of(h, width), *more(h))))


def item_shingles(text: Column, width: int = SHINGLE) -> Column:
    """shingles() of an item; one of fewer words than `width` has its whole word sequence as its only one."""
    whole = lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.coalesce(*[F.when(F.size(h) == n, F.array(F.xxhash64(*[F.get(h, k) for k in range(n)]))) for n in range(1, width)]))
    return F.aggregate(F.array(hashed_words(text)), F.array().cast("array<bigint>"), lambda acc, h: F.when(F.size(h) >= width, shingles_of(h, width)).otherwise(whole(h)))


def shingles_of(hashes: Column, width: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])))


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """(item, hash, least) from items(item, hashes): each item's smallest values under a random order.

    Items fall into size classes, the powers of two of their number of shingles m. The sketch of a class
    holds as many values as its largest item may lack, (1 - containment) * m, and SPARE more: a text with the
    item's share of shingles then holds at least `least` of them, which is one or more, so none is missed.
    """
    sized = items.select("item", F.size("hashes").alias("m"), F.explode("hashes").alias("hash"))
    lacks = lambda m: F.floor(m * (1 - containment) + 1e-9)
    top = F.pow(F.lit(2), F.floor(F.log2("m")) + 1) - 1
    kept = F.least(F.col("m"), lacks(top) + SPARE).cast("int")
    order = Window.partitionBy("item").orderBy(F.xxhash64(F.lit("minhash"), "hash"), "hash")
    return sized.withColumn("kept", kept).withColumn("place", F.row_number().over(order)).where("place <= kept").select("item", "hash", (F.col("kept") - lacks(F.col("m"))).cast("int").alias("least"))


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_found, containment, _hash) of each document and item inside it.

    An item counts as inside a document if at least `containment` of its distinct five-word shingles
    are among the document's. An item of fewer words has one, its whole word sequence, and is inside a document
    whose words hold that in a row; items without a word are inside none. Rows of
    equal doc_id and text give one result, and so do equal items; a null doc_id or item_id is carried
    along. Null and empty texts hold nothing; empty tables give an empty result; other columns are ignored.
    """
    items = stage(
        benchmark.select("item_id", "text").distinct().withColumn("hashes", item_shingles(F.col("text"))).withColumn("n_words", F.size(hashed_words(F.col("text")))).where(F.size("hashes") > 0).select("item_id", "n_words", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").alias("item"), "hashes"),
        "benchmark",
    )
    sketch = stage(sketches(items, containment), "benchmark-sketch")
    small = sketch.count() <= BROADCAST_VALUES
    lengths = F.array(*[F.lit(r.n_words) for r in items.where(F.col("n_words") < SHINGLE).select("n_words").distinct().collect()]).cast("array<int>")  # four at most
    own = docs.select(_key(F.col("doc_id")).alias("_doc"), F.xxhash64("text").alias("_hash"), "text")
    runs = own.select("_doc", "_hash", F.explode(shingles(F.col("text"), shorter=lengths)).alias("hash"))
    hits = runs.join(F.broadcast(sketch) if small else sketch, "hash").groupBy("_doc", "_hash", "item").agg(F.count_distinct("hash").alias("hits"), F.first("least").alias("least"))
    pairs = stage(hits.where("hits >= least").select("_doc", "_hash", "item"), "benchmark-candidates")
    texts = pairs.select("_doc", "_hash").distinct()
    mine = docs.select("doc_id", _key(F.col("doc_id")).alias("_doc"), F.xxhash64("text").alias("_hash"), "text").join(texts, ["_doc", "_hash"], "left_semi").dropDuplicates(["_doc", "_hash"])
    held = mine.select("doc_id", "_doc", "_hash", shingles(F.col("text"), shorter=lengths).alias("own"))
    both = pairs.join(held, ["_doc", "_hash"]).join(items, "item")
    found = F.size(F.array_intersect("own", "hashes"))
    out = both.select("doc_id", "item_id", F.size("hashes").cast("long").alias("n_item_shingles"), found.cast("long").alias("n_found"), "_hash")
    return out.withColumn("containment", F.col("n_found") / F.col("n_item_shingles")).where(F.col("n_found") >= F.ceil(F.col("n_item_shingles") * containment - 1e-9))


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    names = spare(docs, "_doc", "_hash")
    found = contaminated(docs, benchmark).select(_key(F.col("doc_id")).alias(names[0]), F.col("_hash").alias(names[1])).distinct()
    marked = docs.withColumns(dict(zip(names, (_key(F.col("doc_id")), F.xxhash64("text")), strict=True)))
    return marked.join(found, names, "left_anti").select(*docs.columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of benchmark, all documents against all items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_hash")


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))"
_FIVE = _RUNS.format(n=5)
SQL = {
    "op6_benchmark_decontamination": f"""
WITH b AS (SELECT item_id, text AS item, len(w) AS words, CASE WHEN len(w) >= 5 THEN {_FIVE} ELSE [array_to_string(w, ' ')] END AS r FROM (SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
e AS (SELECT item_id, item, words, len(r) AS m, unnest(r) AS s FROM b), t AS (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents),
d AS (SELECT doc_id, text, 5 AS n, unnest({_FIVE}) AS s FROM t {" ".join(f"UNION ALL SELECT doc_id, text, {n}, unnest({_RUNS.format(n=n)}) FROM t WHERE EXISTS (SELECT 1 FROM b WHERE words = {n})" for n in range(1, 5))}),
f AS (SELECT doc_id, d.text, item_id, item, m, count(*) AS k FROM d JOIN e ON d.s = e.s AND d.n = least(e.words, 5) GROUP BY ALL)
SELECT doc_id, item_id, CAST(m AS BIGINT) AS n_item_shingles, CAST(k AS BIGINT) AS n_found, k / m AS containment FROM f WHERE 5 * k >= 4 * m"""
}
