"""Merkle audit of archives of WARC records.

Each replica builds two trees for each of its files, alone. The content tree's leaves are prefixes of the hash of a record's page and
copy and hash the records' lengths and digests: bytes that were added or lost change no other leaf. The offset tree's leaves
are ranges of the file and hash which records follow each other from which offset; it says where a replica holds a record, as
`moved`. Two replicas are compared at the roots; only children of nodes that differ are read further down, so equal files cost one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import buckets_for, cut, running

FAN = 16
#: Records that a file is meant to hold.
RECORDS_PER_FILE = 4096
#: Levels above the leaves: a file has FAN ** LEVELS leaves of records, and a root for as many ranges of FAN records.
LEVELS = 2


def records(pages: DataFrame) -> DataFrame:
    """page_id, record (bytes): each page as a WARC response record. Null texts are empty."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col("url"), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def archive(records_: DataFrame, files: int) -> DataFrame:
    """file, seq, offset, length, page_id, digest, copy of each record.

    copy numbers the records of a page, in an order of their digests. A file takes the records that hash to it, by page
    and by RECORDS_PER_FILE copies, in the order of page_id and copy: no page can fill a file.
    """
    hashed = records_.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    distinct = cut(hashed.groupBy(page.alias("page"), "page_id", "length", "digest").agg(F.count("*").alias("times")))
    counted = running(distinct, ["page"], F.xxhash64("digest"), [F.col("digest")], F.col("times"), "before", buckets_for(distinct.count()))
    every = counted.withColumn("copy", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("times"))))
    filed = every.withColumn("file", F.pmod(F.xxhash64("page_id", F.floor((F.col("copy") - 1) / RECORDS_PER_FILE), F.lit("file")), F.lit(files)))
    order = W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "copy")
    return filed.select("file", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "length", "page_id", "digest", "copy")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _grown(leaves: DataFrame) -> list[DataFrame]:
    """The levels (file, node, hash) of a tree, from its leaves up: a node hashes its FAN children in order."""
    levels = [cut(leaves)]
    for _ in range(LEVELS):
        above = F.floor(F.col("node") / FAN).cast("long")
        up = levels[-1].groupBy("file", above.alias("above")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"))  # FAN children at most
        levels.append(cut(up.select("file", F.col("above").alias("node"), _hash(F.array_join(F.transform("c", lambda c: F.concat_ws(":", c.node.cast("string"), c.hash)), ",")).alias("hash"))))
    return levels


def _leaf_of(archived: DataFrame) -> DataFrame:
    """archived with its leaves: `leaf` by the hash of page and copy, `range` by the place in the file."""
    leaf = F.pmod(F.xxhash64("page_id", "copy", F.lit("leaf")), F.lit(FAN**LEVELS)).cast("long")
    return archived.withColumns({"leaf": leaf, "range": F.floor(F.col("seq") / FAN).cast("long")})


def _leaves(placed: DataFrame, by: str, *said: str) -> DataFrame:
    """A leaf hashes what is `said` of its records, in order."""
    record = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in said))
    order = F.struct("seq" if by == "range" else record, record.alias("record"))
    return placed.groupBy("file", F.col(by).alias("node")).agg(_hash(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda r: r.record), "\n")).alias("hash"))


def content_tree(placed: DataFrame) -> list[DataFrame]:
    """The tree of a file's records. A leaf is a prefix of the hash of page and copy, so records that were added or lost move no others."""
    return _grown(_leaves(placed, "leaf", "page_id", "copy", "length", "digest"))


def offset_tree(placed: DataFrame) -> list[DataFrame]:
    """The tree of a file's ordered offset ranges: a leaf says which records follow each other from where, whatever they hold."""
    return _grown(_leaves(placed, "range", "offset", "length", "page_id", "copy"))


def _below(level: DataFrame, bad: DataFrame) -> DataFrame:
    """A level's nodes whose parents differ; no others reach the comparison."""
    return level.withColumn("_above", F.floor(F.col("node") / FAN).cast("long")).join(bad.select("file", F.col("node").alias("_above")), ["file", "_above"], "left_semi").drop("_above")


def compare(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """file, node of the leaves that differ or that one tree lacks. The roots are joined; each further level only below nodes that differ."""
    bad = None
    for l, r in zip(reversed(one), reversed(other), strict=True):
        if bad is not None:
            l, r = _below(l, bad), _below(r, bad)
        both = l.withColumnRenamed("hash", "l_hash").join(r.withColumnRenamed("hash", "r_hash"), ["file", "node"], "full")
        bad = cut(both.where("not (l_hash <=> r_hash)").select("file", "node"))
        if bad.isEmpty():
            break
    return bad


def _matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, seq, page_id, offset, length, digest, state, moved of the records of left and right, both from leaves that differ.

    Copies of a page are in order of digest, so one that changed shifts others: equal records are matched first, then what is left of each page.
    """
    sides = [left.select("file", "page_id", "digest", "seq", F.struct("seq", "offset", "length", "digest").alias("l")), right.select("file", "page_id", "digest", "seq", F.struct("seq", "offset", "length", "digest").alias("r"))]

    def join(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
        order = W.partitionBy(*keys).orderBy("digest", "seq")
        a = one.withColumn("n", F.row_number().over(order)).select("file", "page_id", "n", "digest", "l").alias("a")
        b = other.withColumn("n", F.row_number().over(order)).select("file", "page_id", "n", "digest", "r").alias("b")
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "n"]]
        return a.join(b, on, "full").select(F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.page_id", "b.page_id").alias("page_id"), "l", "r")

    equal = cut(join(*sides, ["file", "page_id", "digest"]))
    lost, new = equal.where("r is null"), equal.where("l is null")
    rest = join(lost.select("file", "page_id", "l.digest", "l.seq", "l"), new.select("file", "page_id", "r.digest", "r.seq", "r"), ["file", "page_id"])
    both = equal.where("l is not null and r is not null").withColumn("state", F.lit("same")).unionByName(rest.withColumn("state", F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "added").otherwise("changed")))
    one = F.coalesce("l", "r")
    return both.select("page_id", "file", *(one[c].alias(c) for c in ("seq", "offset", "length", "digest")), "state", F.coalesce(F.col("l.offset") != F.col("r.offset"), F.lit(False)).alias("moved"))


def audit(pages: DataFrame, replica: DataFrame, files: int | None = None) -> DataFrame:
    """page_id, file, seq, offset, length, digest, state, moved of each of the pages' records: `same`, `changed` or `missing` in the replica.

    replica has the columns of pages. Records that only the replica has are `added`, with its offset, length and digest,
    and a seq after the file's last. moved tells that the replica holds the record at another offset, whatever its
    state. Repeated pages are records of their own; a null page_id sorts first. Empty tables give no rows. Of equal replicas
    only roots are compared: each side builds its trees alone, and records meet only below leaves that differ.
    """
    files = files or max(1, -(-pages.count() // RECORDS_PER_FILE))
    mine, theirs = (cut(_leaf_of(archive(records(side), files))) for side in (pages, replica))
    content = compare(content_tree(mine), content_tree(theirs)).withColumnRenamed("node", "leaf")
    places = compare(offset_tree(mine), offset_tree(theirs)).withColumnRenamed("node", "range")
    differ = lambda side: side.join(content, ["file", "leaf"], "left_semi")
    found = cut(_matched(differ(mine), differ(theirs)))
    ends = mine.groupBy("file").agg((F.max("seq") + 1).alias("_end"))
    added = found.where("state = 'added'").withColumn("_n", F.row_number().over(W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest", "seq")) - 1)
    added = added.join(ends, "file", "left").withColumn("seq", (F.coalesce("_end", F.lit(0)) + F.col("_n")).cast("long")).drop("_n", "_end")
    equal = mine.join(content, ["file", "leaf"], "left_anti")
    still = equal.join(places, ["file", "range"], "left_anti").withColumn("moved", F.lit(False))
    there = theirs.join(places, ["file", "range"], "left_semi").select(F.col("file").alias("_file"), F.col("page_id").alias("_page"), F.col("copy").alias("_copy"), F.col("offset").alias("_offset"))
    same = [F.col("file") == F.col("_file"), F.col("page_id").eqNullSafe(F.col("_page")), F.col("copy") == F.col("_copy")]
    shifted = equal.join(places, ["file", "range"], "left_semi").join(there, same, "left").withColumn("moved", F.coalesce(F.col("offset") != F.col("_offset"), F.lit(False)))
    told = [d.select("page_id", "file", "seq", "offset", "length", "digest", F.lit("same").alias("state"), "moved") for d in (still, shifted)]
    return told[0].unionByName(told[1]).unionByName(found.where("state <> 'added'")).unionByName(added)
