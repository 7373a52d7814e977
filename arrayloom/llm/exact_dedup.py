"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical after deleting the six ASCII white-space characters. A group is combined in
three steps: inside each input partition (map-side aggregation), by (digest, salt), and by digest over the salts'
winners. The grouping key of each step is the digest *and the whole normalised text*, so full content is compared at
every stage; a digest alone only serves to leave out texts that nothing can equal, by a bit table of fixed size (it lets
more of them through as the input grows, which moves more texts and changes nothing else).

Defined cases: null text is empty text, and empty texts form one group; of equal texts the one with the most code
points in its original text stays, then the least doc_id; rows with a null doc_id count in group_size and stay only
where their whole group has no doc_id; rows that repeat a doc_id are members each and share the answer of that
doc_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch, numbered, own_columns, read_table, row_per_id, text_or_empty

SALTS = 16
_TOP, _STEP = 9223372036854775807, 18446744073709551616


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _rank() -> Column:
    """One number whose maximum is the row with most code points, then the least doc_id (fits decimal(38))."""
    return F.col("n_cp").cast("decimal(18,0)") * _number(_STEP) + (_number(_TOP) - F.col("doc_id").cast("decimal(20,0)"))


def _keep(rank: Column) -> Column:
    return (_number(_TOP) - rank % _number(_STEP)).cast("long")


def _slot() -> Column:
    """A digest's place in a table of 2**24 bits, kept as at most 2**18 words (4 MB to broadcast, whatever the input)."""
    return F.xxhash64("sha").bitwiseAND(F.lit((1 << 24) - 1).cast("long"))


def _bit() -> Column:
    return F.expr("shiftleft(1L, cast(slot & 63 AS int))")


def find_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_t"))
    full = base.select("doc_id", F.length("_t").cast("long").alias("n_cp"), normalised(F.col("_t")).alias("norm"))
    digests = scratch.table(full.select("doc_id", "n_cp", F.unhex(F.sha2("norm", 256)).alias("sha")), "digests")
    repeated = scratch.table(digests.groupBy("sha").count().where("count > 1").select("sha"), "repeated")
    # Texts whose digest occurs once stay where they are but for the few that the bit table lets through.
    bits = scratch.table(repeated.select(_slot().alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(_bit()).alias("bits")), "bits")
    mates = full.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("slot", _slot())
    mates = mates.join(F.broadcast(bits), F.shiftright("slot", 6) == F.col("word")).where(F.col("bits").bitwiseAND(_bit()) != 0)
    mates = mates.select("sha", "norm", _rank().alias("w"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    salted = mates.groupBy("sha", "norm", "salt").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("sha", "norm").agg(F.max("w").alias("w"), F.sum("n").alias("n")).select("sha", _keep(F.col("w")).alias("keep"), F.col("n").alias("n"), "norm")
    groups = scratch.table(groups.where("n > 1 or keep is null"), "groups")
    clash = groups.groupBy("sha").count().where("count > 1").limit(1).count()
    every, some = F.sequence(F.lit(0), F.lit(salts - 1)), F.pmod(F.xxhash64("doc_id", "n_cp"), F.lit(salts)).cast("int")
    if clash:  # two contents under one digest: assign by content
        found = full.withColumn("sha", F.unhex(F.sha2("norm", 256))).join(groups, ["sha", "norm"], "left")
    else:  # a group meets its members under each salt, so that no key has all members of a large one
        found = digests.withColumn("salt", some).join(groups.select("sha", "keep", "n", F.explode(every).alias("salt")), ["sha", "salt"], "left")
    keep = F.coalesce(F.col("keep"), F.col("doc_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with their own columns; rows with a doc_id come first."""
    if not row_per_id(docs):
        rows = numbered(docs, Scratch(docs.sparkSession, "drop-copies"))
        groups = find_copies(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "keep_id")
        order = F.struct(F.col("doc_id").isNull(), -F.length(text_or_empty()), "doc_id", "row")
        kept = rows.select("row", order.alias("order")).join(groups, "row").groupBy("keep_id").agg(F.min("order").alias("first")).select("first.row")
        return own_columns(rows.join(kept, "row", "left_semi"), docs)
    kept = find_copies(docs).where("kept").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]), "left_semi")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return find_copies(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n_cp DESC, doc_id)
"""
