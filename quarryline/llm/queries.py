"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.common import table
from quarryline.llm import credentials, leakage, packing, provenance, spam, syntax


def p1_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Files that nobody wrote by hand in their repository, with the reason."""
    return provenance.not_hand_written(table(spark, base, "files"), table(spark, base, "file_text"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Files that nobody wrote by hand in their repository."""
    return p1_kinds(spark, base).select("file_id")


def p1_subtrees(spark: SparkSession, base: str) -> DataFrame:
    """Folders that are alike in several repositories."""
    return provenance.shared_subtrees(table(spark, base, "files"), table(spark, base, "file_text"))


def _judged(spark: SparkSession, base: str) -> DataFrame:
    return syntax.judged(table(spark, base, "files"), table(spark, base, "file_text"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Files whose text is not valid in the language of their extension."""
    return _judged(spark, base).where("not ok").select("file_id").distinct()


def p3_rates(spark: SparkSession, base: str) -> DataFrame:
    """Share of invalid files per repository and language."""
    return syntax.rates(_judged(spark, base))


def _credential_texts(spark: SparkSession, base: str) -> DataFrame:
    return credentials.texts(*(table(spark, base, t) for t in ("files", "file_text", "memory_rev")))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Lines in which a credential begins."""
    return credentials.credential_lines(_credential_texts(spark, base))


def p4_redacted(spark: SparkSession, base: str) -> DataFrame:
    """The texts that hold credentials, masked."""
    return credentials.redacted(_credential_texts(spark, base))


def p7_packed(spark: SparkSession, base: str) -> DataFrame:
    """Container of every document."""
    return packing.packed(table(spark, base, "documents"))


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    """How full and how even the containers are."""
    return packing.fill_report(p7_packed(spark, base))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that hold an evaluation item for the larger part."""
    return leakage.leaked(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p8_items(spark: SparkSession, base: str) -> DataFrame:
    """Number of documents that hold each evaluation item."""
    return leakage.leaks_per_item(p8_found(spark, base), table(spark, base, "eval_items"))


def p9_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Documents made of links, tags, stuffed keywords (in phrases or mixed) or other word salad, with the kind."""
    return spam.spam_pages(table(spark, base, "documents"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents made to attract searches: keywords, links or tags in place of sentences.

    Word salad counts if its words are keywords that come back; the words of a passage in another order repeat nothing.
    """
    return spam.spam_pages(table(spark, base, "documents"), salad=False).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_kinds, p1_subtrees, p3_found, p3_rates, p4_found, p4_redacted, p7_packed, p7_fill, p8_found, p8_items, p9_found, p9_kinds)}
ORACLE: dict[str, str] = {}
