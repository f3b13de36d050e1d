"""Bounded samples to fit classifiers on, and the split that contracts fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows and characters of a sample, on average; rows are taken by a hash of their doc_id.
TRAIN_ROWS, TRAIN_CHARS = 20_000, 16_000_000


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 5 (null for a null doc_id)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


#: Rows that are taken where a share comes out empty although there are labels.
LEAST = 100


def share(rate: float) -> Column:
    """A fixed share of doc_ids, however small: the whole 64-bit hash is compared."""
    return F.lit(True) if rate >= 1 else F.xxhash64("doc_id") < F.lit(int(rate * 2**64) - 2**63)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[str, int | str]]:
    """(text, label) of a bounded sample of the labelled rows, in the order of doc_id.

    Of a repeated doc_id the highest label counts. Null texts and labels are left out. Where labels exist but a share of them
    leaves none, the LEAST first in the order of the hash are taken, so the sample of labelled texts is never empty.
    """
    given = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    given = given.groupBy("doc_id").agg(F.max(label).alias("label"))
    n = given.count()
    few = given.where(share(min(1.0, rows / n))) if n else given
    texts = docs.where("text is not null").select("doc_id", "text")
    joined = texts.join(F.broadcast(few), "doc_id")  # at most about `rows` ids
    total = joined.agg(F.sum(F.length("text"))).first()[0] or 0
    if total > chars:
        rate = chars / total * min(1.0, rows / n)
        joined = texts.join(F.broadcast(given.where(share(rate))), "doc_id")
    found = joined.select("doc_id", "text", "label").collect()
    if not found and n:
        found = texts.join(given, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(LEAST).select("doc_id", "text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]
