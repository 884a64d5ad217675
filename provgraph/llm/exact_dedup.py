"""Exact deduplication over an extendible-hash index kept in shared files.

Only DataFrame functions are used.  The index maps the 64-bit hash of a
normalised text to its group, in buckets:

* **Directory.**  A slot for each value of the hash's first bits names the bucket that owns it.  Doubling the
  directory adds a bit; a bucket of over ``bucket_capacity`` different hashes is split by it, others
  keep their depth.  Where doubling ends is known from counts: a bucket is the shortest prefix that is not overfull,
  or one of the last depth.  The directory is a table made by joins and counts; the driver holds a row count only.
  It has at most ``2**MAX_DEPTH`` slots (a larger corpus gets larger buckets), which bounds what is broadcast of it.
* **Owner tasks.**  Texts find their bucket through the directory and are grouped inside it, by hash *and bytes*,
  with map-side combining, so a group of copies of any size arrives as one row per map task.  The entries
  then go to the task that owns their range of buckets and are written there, one folder an owner, sorted by bucket and hash.
* **Collisions.**  Different texts with one hash form a chain in their bucket, told apart by their
  bytes when grouped, and by the digest of those bytes from then on.
* **Lookup.**  A document goes through the directory to its bucket and there along the chain.  A slot that is
  missing or names another bucket loses rows, so the directory decides the result.

Texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``.
A null text counts as empty, and all empty texts are one group.  Of a group the
row with the most code points in the original text stays, then the smallest
``doc_id``; a null ``doc_id`` comes last.  Rows that repeat a ``doc_id`` are rows of their own: of two rows of one group and id the
longer stays, and those of one length as well (ties) are both marked ``kept``, of which ``drop_copies`` keeps one.  Texts of any length are
hashed and compared whole.  An empty table gives an empty result; further columns are ignored, ``drop_copies`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import clean
from .shared import fresh_path, stored

MAX_DEPTH, SPARE = 20, 4
WHITE = " \t\n\x0b\f\r"
BIG = "36893488147419103232"  # 2**65


def prefix_of(h: Column, depth: int) -> Column:
    """The top ``depth`` bits of a hash (0 for depth 0)."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def norm_of(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def hash_of(norm: Column, hash_bits: int) -> Column:
    full = F.xxhash64(norm)
    return full if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(full, 64 - hash_bits), 64 - hash_bits)


def build_directory(entries: DataFrame, bucket_capacity: int, hash_bits: int) -> tuple[DataFrame, int]:
    """``slot, bucket, depth`` and the global depth, for a table of different hashes ``h``.  A bucket is named by its first slot;
    slots without entries are left out.  A bucket overfull at the last depth stays so."""
    n = entries.count()
    capacity = max(bucket_capacity, -(-n // (1 << MAX_DEPTH - SPARE)))
    depth = min(hash_bits, (n // capacity).bit_length() + SPARE)
    slots = stored(entries.groupBy(prefix_of(F.col("h"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "dedup-slots")
    doublings = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(slot, {depth} - depth)"))
    sizes = doublings.groupBy("depth", "prefix").agg(F.sum("n").alias("entries"))
    fits = doublings.join(sizes, ["depth", "prefix"]).filter((F.col("entries") <= capacity) | (F.col("depth") == depth))
    buckets = fits.groupBy("slot").agg(F.min(F.struct("depth", "prefix")).alias("b"))
    return stored(buckets.select("slot", F.expr(f"shiftleft(b.prefix, {depth} - b.depth)").alias("bucket"), "b.depth"), "dedup-directory"), depth


def in_bucket(frame: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """Looks the bucket of each row's hash up."""
    slots = F.broadcast(directory.select("slot", "bucket"))  # 2**MAX_DEPTH rows of two numbers at most
    return frame.withColumn("slot", prefix_of(F.col("h"), depth)).join(slots, "slot").drop("slot")


def build_index(source: DataFrame, prints: DataFrame, bucket_capacity: int, hash_bits: int) -> tuple[DataFrame, DataFrame, int]:
    """The stored index ``bucket, h, text_sha256, group_size, keep_chars, keep_id``, its directory and global depth."""
    spark = source.sparkSession
    directory, depth = build_directory(prints.select("h").distinct(), bucket_capacity, hash_bits)
    norm = norm_of("text")
    texts = source.select("doc_id", F.length("text").cast("long").alias("n_chars"), norm.alias("norm"), hash_of(norm, hash_bits).alias("h"))
    groups = (
        in_bucket(texts, directory, depth)
        .groupBy("bucket", "h", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("n_chars").alias("keep_chars"), F.max(rank_of("n_chars", "doc_id")).alias("best"))
    )
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    owner = F.expr(f"CAST(bucket * {owners} DIV {1 << depth} AS INT)")
    index = groups.select(owner.alias("owner"), "bucket", "h", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_chars", keep_id_of("best").alias("keep_id"))
    path = fresh_path(spark, "dedup-index")
    index.repartitionById(owners, "owner").sortWithinPartitions("owner", "bucket", "h", "text_sha256").write.partitionBy("owner").parquet(path)
    return spark.read.schema(index.schema).parquet(path), directory, depth


def exact_dedup(docs: DataFrame, bucket_capacity: int = 100_000, hash_bits: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``hash_bits`` under 64 forces collisions, for tests.
    """
    source = clean(docs, text=text, key=key)
    prints = stored(source.select("doc_id", *marks_of(hash_bits)), "dedup-prints")
    index, directory, depth = build_index(source, prints, bucket_capacity, hash_bits)
    found = found_in(prints, index, directory, depth)
    return found.select("doc_id", "keep_id", "group_size", stays().alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, bucket_capacity: int = 100_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, all columns, with one row of each group of equal texts; of rows that tie in length and id, the least."""
    source = clean(docs, text=text, key=key)
    prints = stored(source.select("doc_id", *marks_of(64)), "dedup-prints")
    index, directory, depth = build_index(source, prints, bucket_capacity, 64)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), F.col(key).cast("long").alias("doc_id"))
    kept = found_in(rows.select("row", "doc_id", *marks_of(64)), index, directory, depth).filter(stays())
    ties = stored(prints.groupBy("h", "text_sha256", "n_chars", "doc_id").count().filter("count > 1").select("h", "text_sha256").distinct(), "dedup-ties")
    if ties.isEmpty():
        return kept.select("row.*")
    tied = kept.join(ties, ["h", "text_sha256"], "left_semi").groupBy("h", "text_sha256").agg(F.min("row").alias("row"))
    return kept.join(ties, ["h", "text_sha256"], "left_anti").select("row.*").union(tied.select("row.*"))


def marks_of(hash_bits: int) -> list[Column]:
    norm = norm_of("text")
    return [F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), hash_of(norm, hash_bits).alias("h"), F.sha2(norm, 256).alias("text_sha256")]


def found_in(rows: DataFrame, index: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """Rows with the entry of their text.  Both sides of the join are plain scans, so Spark can split the partition of a hot group."""
    return in_bucket(rows, directory, depth).join(index.drop("owner"), ["bucket", "h", "text_sha256"])


def stays() -> Column:
    return (F.col("n_chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))


def rank_of(n_chars: str, doc_id: str) -> Column:
    """Greatest for the most code points, then the smallest id, then a null id; a decimal, so that the
    hash aggregation can update it in place."""
    low = F.lit("9223372036854775808").cast("decimal(20,0)") - F.col(doc_id).cast("decimal(20,0)")
    return (F.col(n_chars).cast("decimal(10,0)") * F.lit(BIG).cast("decimal(20,0)") + F.coalesce(low, F.lit(0).cast("decimal(20,0)"))).cast("decimal(38,0)")


def keep_id_of(best: str) -> Column:
    low = F.col(best) % F.lit(BIG).cast("decimal(20,0)")
    return F.when(low > 0, (F.lit("9223372036854775808").cast("decimal(20,0)") - low).cast("long"))
