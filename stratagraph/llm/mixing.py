"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n documents and target weight w out of T output documents has the
repetition rate T*w/n.  Each document draws its count by inverting the Poisson
distribution of that mean at a uniform number hashed from (seed, id): the count
is the number of k with P(X <= k) <= u.  Counts are exploded and the copies
dealt to partitions, and ordered there, by a hash of (seed, id, copy): a global
shuffle that any retry repeats.

Only per-source counts (one row a source) meet the documents, so a source with
a third of all rows costs nothing extra: they are aggregated before the shuffle
and joined from a counted, broadcast side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm.common import partitions, small_side, written

SEED = 17
#: Without explicit weights, a source's weight is its number of documents to this power.
TEMPERATURE = 0.5
#: Copies of a document that one task makes; with a rate of a quarter, no count comes near.
PIECE = 1000
#: 2**52: thirteen hexadecimal digits, exact in a double.
_UNIT = 4503599627370496.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 over the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """source, cdf of rows source, rate: P(X <= k) for k = 0 .. rate + 12*sqrt(rate) + 40, beyond which the tail is
    under 2**-53.  A row a source and k; terms are running sums of logarithms, so large rates don't underflow."""
    last = F.ceil(F.col("rate") + F.sqrt("rate") * 12 + 40).cast("int")
    terms = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    sofar = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log = -F.col("rate") + F.sum(F.when(F.col("k") > 0, F.ln(F.col("rate") / F.col("k"))).otherwise(0.0)).over(sofar)
    summed = terms.withColumn("p", F.exp(log)).withColumn("p", F.sum("p").over(sofar))
    return summed.groupBy("source").agg(F.sort_array(F.collect_list("p")).alias("cdf"))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """source, n, rate: one row a source.  weights need not sum to one; a source they don't
    name gets none.  total: documents to make (as many as there are, if None)."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        given = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map(F.lit(""), F.lit(0.0))
        given = counts.withColumn("w", F.coalesce(named[F.col("source")], F.lit(0.0)).cast("double"))
    given = written(given, "mixing-counts")
    sums = given.agg(F.sum("w").alias("all_weights"), F.sum("n").alias("all_rows"))  # one row
    size = F.col("all_rows").cast("double") if total is None else F.lit(float(total))
    rate = F.when(F.col("all_weights") > 0, size * F.col("w") / F.col("all_weights") / F.col("n")).otherwise(F.lit(0.0))
    return given.join(F.broadcast(sums)).select("source", "n", rate.alias("rate"))


def replicate(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """doc (docs' columns, whatever their names), copy (from 1) and shuffle_key, globally shuffled."""
    known = written(rates(docs, source_col, weights, total), "mixing-rates")
    table = small_side(written(poisson_cdf(known).withColumnRenamed("source", "key"), "mixing-tables"))
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    of = F.col("doc").getField
    drawn = whole.withColumn("u", uniform(seed, of(id_col))).join(table, of(source_col).eqNullSafe(F.col("key")))
    drawn = drawn.select("doc", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("times")).where("times > 0")
    copies = drawn.where(F.col("times") <= PIECE).select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    if (known.agg(F.max("rate")).first()[0] or 0) > PIECE / 4:  # else no count is beyond PIECE
        begin = F.explode(F.sequence(F.lit(1), F.col("times"), F.lit(PIECE))).alias("begin")
        pieces = drawn.where(F.col("times") > PIECE).select("doc", "times", begin).repartition(partitions(docs), F.xxhash64("doc", "begin"))
        more = F.explode(F.sequence(F.col("begin"), F.least(F.col("times"), F.col("begin") + PIECE - 1))).alias("copy")
        copies = copies.union(pieces.select("doc", more))
    key = F.md5(F.concat_ws("|", F.lit(f"shuffle{seed}"), F.coalesce(of(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", key).repartition(partitions(docs), "shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs' columns with `copy` (from 1) and `shuffle_key`, replicated and globally shuffled; replicate's options.

    A null source is a source of its own.  A null id draws as the text "null";
    rows that repeat an id repeat its count.  An empty table, or weights that
    are all zero, give no rows.  Input columns named copy or shuffle_key are
    replaced; further columns are carried along, whatever their names.  Counts
    of more than PIECE are dealt out in pieces before they are exploded.
    """
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    return replicate(docs, **options).select(*(F.col("doc").getField(c).alias(c) for c in kept), "copy", "shuffle_key")


#: Rows of mix(documents) in DuckDB: {docs} is the relation, {select} the columns.
MIX_SQL = """
WITH docs AS ({docs}),
counts AS (SELECT source AS s, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM docs GROUP BY source),
sums AS (SELECT sum(w) AS allw, CAST(sum(n) AS DOUBLE) AS rows FROM counts),
rates AS (SELECT s, rows * w / allw / n AS rate FROM counts, sums),
terms AS (SELECT s, k, -rate + coalesce(sum(ln(rate / k)) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS logp
          FROM (SELECT s, rate, unnest(range(1, CAST(ceil(rate + sqrt(rate) * 12 + 40) AS BIGINT) + 1)) AS k FROM rates)),
cdf AS (SELECT s, k, sum(exp(logp)) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) AS p
        FROM (SELECT s, k, logp FROM terms UNION ALL SELECT s, 0, -rate FROM rates)),
tables AS (SELECT s, list(p ORDER BY k) AS cdf FROM cdf GROUP BY s),
drawn AS (SELECT docs.*, len(list_filter(cdf, lambda c: c <= CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0)) AS times
          FROM docs JOIN tables ON source IS NOT DISTINCT FROM s),
copies AS (SELECT *, unnest(range(1, CAST(times AS BIGINT) + 1)) AS c FROM drawn WHERE times > 0)
SELECT {select} FROM copies
"""
