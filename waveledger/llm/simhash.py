"""SimHash near-dedup with anchor points from a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from waveledger.llm.shared import NO_ID, checked, components, id_or_least, long_type, real_id, text_or_empty
from waveledger.sources.tables import staged

#: Fixed values of the fingerprint.
SHINGLE = 3
SEED = 42
BITS = 64
#: Fingerprints link at so many differing bits or fewer.
DISTANCE = 3

#: Two blocks of so many bits are covered by the Hamming code of that length.
BLOCK = 31
#: Of DISTANCE differing bits one of the two blocks has at most this many.
BLOCK_DISTANCE = DISTANCE // 2
_LOW = (1 << BLOCK) - 1
#: Row j of the code's parity check: the bits whose position (from 1) has bit j set.
_CHECKS = [sum(1 << (p - 1) for p in range(1, BLOCK + 1) if p >> j & 1) for j in range(5)]


def fingerprint(text: str) -> int:
    """SimHash of one text, unsigned."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    tails = ends[SHINGLE - 1:] or ends[-1:]
    digest = xxhash.xxh64_digest
    hashed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, tails)])
    bits = np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, BITS)
    majority = 2 * bits.sum(0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(majority).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h1, h2, fp): name and fingerprint of every whole text, as signed longs; fp 0 for texts without words."""
    checked(docs, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints.view(np.int64))], ["id", "h1", "h2", "fp"])

    return docs.select(*_named(id_col, text_col), text_or_empty(text_col)).mapInArrow(
        rows, long_type("id", "h1", "h2", "fp"))


def _named(id_col: str, text_col: str) -> list[Column]:
    """What rows of one document agree in: id, and 128 bits that name the text."""
    text = text_or_empty(text_col)
    return [id_or_least(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _syndrome(block: Column) -> Column:
    """0 for a code word, else the position of the bit that makes the block one."""
    bits = [F.shiftleft(F.bit_count(block.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), j) for j, m in enumerate(_CHECKS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int"))


def anchored(prints: DataFrame, guests: bool) -> DataFrame:
    """`prints` (with fp) once for each of its anchors: block, anchor.

    The anchors are the words of the perfect [31, 26] Hamming code, whose covering radius is 1.
    Home rows (`guests` false) go to the one anchor within the radius; guests go to every
    anchor within radius plus block distance, 1 + 1: the home anchor and, unless the block is
    a code word itself, the 15 anchors two bits away.
    """
    blocks = F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * BLOCK).bitwiseAND(F.lit(_LOW)).alias("word"))
        for k in range(2)]))
    rows = prints.withColumn("_b", blocks).select(*prints.columns, "_b.block", "_b.word")
    rows = rows.withColumn("_s", _syndrome(F.col("word")))
    home = F.when(F.col("_s") == 0, F.col("word")).otherwise(F.col("word").bitwiseXOR(_bit(F.greatest("_s", F.lit(1)))))
    if not guests:
        return rows.withColumn("anchor", home).drop("word", "_s")
    others = F.filter(F.sequence(F.lit(1), F.lit(BLOCK)),
                      lambda i: (i != F.col("_s")) & (i < i.bitwiseXOR(F.col("_s"))))
    two = F.transform(others, lambda i: F.col("word").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(F.col("_s")))))
    every = F.when(F.col("_s") == 0, F.array(home)).otherwise(F.concat(F.array(home), two))
    return rows.withColumn("anchor", F.explode(every)).drop("word", "_s")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) of all pairs of distinct fingerprints (fp, node) at most DISTANCE bits apart.

    Differing bits fall into two 31-bit blocks and two bits outside, so one block has at most
    one of them; there the second print is a guest of the first one's home anchor.
    """
    homes = anchored(prints, guests=False).select("block", "anchor", F.col("fp").alias("fa"), F.col("node").alias("na"))
    visits = anchored(prints, guests=True).select("block", "anchor", F.col("fp").alias("fb"), F.col("node").alias("nb"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= DISTANCE
    return homes.join(visits, (homes.block == visits.block) & (homes.anchor == visits.anchor) & near
                      & (F.col("na") > F.col("nb"))).select(F.col("na").alias("a"), F.col("nb").alias("b"))


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, best): for each fingerprint the first document (missing, id, h1, h2) of its class.

    Nodes are fingerprints, so documents that share an id, or have none, link nothing.
    """
    first = F.struct((F.col("id") == NO_ID).alias("missing"), "id", "h1", "h2")
    nodes = staged(prints.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("node"))), "a", "b").withColumnRenamed("node", "fp")
    # both written, so that large classes and common fingerprints can be split where they are joined
    firsts = staged(roots.join(nodes, "fp").groupBy("root").agg(F.min("first").alias("best")), "firsts")
    linked = roots.join(firsts, "root").select("fp", "best")
    return staged(nodes.join(linked, "fp", "left").select("fp", F.coalesce("best", "first").alias("best")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per document, class ids are smallest document ids.

    Documents of one fingerprint are one node, so copies never make pairs; equal or missing ids
    link nothing. A missing id stays null and names a class only if all its ids are missing;
    classes that have the same smallest id, because rows repeat it, have the same class id.
    Equal rows give equal rows; an empty table an empty result. Texts without words share the
    fingerprint zero and are linked like any other.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "prints")
    named = _classes(prints).select(F.col("fp").alias("_fp"), F.col("best.id").alias("root"))
    return prints.join(named, F.col("fp") == F.col("_fp")).select(
        real_id(F.col("id")).alias("doc_id"), "fp", real_id(F.col("root")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one of smallest id, then of least text hash; all columns unchanged.

    Missing ids come after all others. Rows that agree in id and text are one document, and one
    of them stays; rows that share an id, or have none, and are not near copies all stay.
    """
    best = _classes(staged(fingerprints(docs, id_col, text_col), "prints")).select("best.id", "best.h1", "best.h2").distinct()
    best = best.toDF("_id", "_h1", "_h2")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"),
                       *[c.alias(n) for c, n in zip(_named(id_col, text_col), best.columns)])
    # rows come out of the join by id and text, so repeated ones need no further shuffle
    return rows.join(best, best.columns, "left_semi").dropDuplicates(best.columns).select("_row.*")
