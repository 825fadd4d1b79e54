"""Lines that many documents share: all copies go but one.

Built from DataFrame functions alone.  Lines are exploded with their position, normalised and
hashed; a first count over the hashes finds those with enough lines at all, an exact count of
distinct documents decides among them, and every row gets the positions it loses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddledger.llm.sampling import counted
from oddledger.session import staged

BREAK = "\n"
# fixed values: white space around a line that its key leaves out
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Shared:
    """A key counts from ``chars`` code points on, and goes from ``documents`` documents on."""

    chars: int = 40
    documents: int = 5


def _lowered(text: Column) -> Column:
    """A-Z in lower case; where all is ASCII the plain function does the same, faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, text): ``copy`` tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("copy"), text.alias("text"))


def keys(docs: DataFrame, p: Shared) -> DataFrame:
    """(doc_id, copy, pos, key) of every line long enough, from position 0 on."""
    lines = _rows(docs).select(
        "doc_id", "copy", F.posexplode(F.split("text", BREAK, -1)).alias("pos", "line")
    )
    bare = lines.withColumn("line", F.trim("line", F.lit(WHITE)))
    long = bare.filter(F.length("line") >= p.chars)
    return long.select("doc_id", "copy", "pos", F.unhex(F.md5(_lowered(F.col("line")))).alias("key"))


def dropped(docs: DataFrame, p: Shared) -> DataFrame:
    """(doc_id, copy, gone): positions of the lines that rows lose; rows without are left out.

    A key with enough documents has enough lines, so a count of lines, combined before the
    exchange, leaves few keys to count documents for.
    """
    found = keys(docs, p)
    often = found.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") >= p.documents)
    spots = staged(found.join(counted(often.select("key")), "key"), "lines")
    frequent = (
        spots.select("key", "doc_id")
        .distinct()
        .groupBy("key")
        .agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("owner"))
        .filter(F.col("n") >= p.documents)
        .select("key", "owner")
    )
    gone = spots.join(counted(frequent), "key").filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    return gone.groupBy("doc_id", "copy").agg(F.collect_list("pos").alias("gone"))


def drop_lines(docs: DataFrame, p: Shared | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of ``docs`` (doc_id, text).

    A line's key is the line without white space at its ends, A-Z in lower case.  Keys found
    in enough documents lose all their lines but those of the largest doc_id that holds them.
    Null and empty texts are one empty line.  Rows with one doc_id are one document when
    documents are counted, and each is returned.  A row without doc_id is returned, counts as
    no document and never keeps a shared line.  Other columns are left aside.
    """
    p = p or Shared()
    lost = dropped(docs, p)
    rows = _rows(docs).withColumnRenamed("doc_id", "id").withColumnRenamed("copy", "own")
    # what rows lose grows with the corpus, so it is shuffled at every size
    met = rows.join(
        lost.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("copy")), "left"
    )
    lines = F.split("text", BREAK, -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    count = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit(BREAK), F.lit(""))) + 1
    cut = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), BREAK)
    some = F.col("gone").isNotNull()
    return met.select(
        F.col("id").alias("doc_id"),
        count.cast("long").alias("n_lines"),
        F.when(some, F.size(F.array_distinct("gone"))).otherwise(0).cast("long").alias("n_dropped"),
        F.when(some, cut).otherwise(F.col("text")).alias("kept"),
    )
