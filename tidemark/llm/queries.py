"""Queries of the text problems p7 to p9, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, subjects
from tidemark.session import materialise, read_table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"))


#: Production curriculum: weights of sources over quarters of training. The office's clean texts lead early, archive and
#: scans come late; sources that aren't named keep an even weight, as far as each quarter takes the same tokens.
CURRICULUM = {"norva_office": [4.0, 3.0, 2.0, 1.0], "sund_archive": [0.0, 1.0, 2.0, 3.0], "peth_scans": [1.0, 1.0, 2.0, 2.0]}


def _p8(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents, targets, and the mix."""
    sized = materialise(mixing.sized_documents(read_table(spark, sf_dir, "documents")), "sized")
    targets = read_table(spark, sf_dir, "mix_targets")
    return sized, targets, mixing.mix(sized, targets, schedules=CURRICULUM)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats, in training order."""
    return _p8(spark, sf_dir)[2]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached tokens and shares of each listed source."""
    sized, targets, chosen = _p8(spark, sf_dir)
    return mixing.shares(sized, chosen, targets)


def p8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached share of each source in each quarter of training."""
    sized, targets, chosen = _p8(spark, sf_dir)
    return mixing.shares_over_time(sized, chosen, targets, CURRICULUM)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of every patent's invention."""
    return subjects.subject_areas(*(read_table(spark, sf_dir, t) for t in ("documents", "subject_terms", "subject_labels")))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by area."""
    return subjects.composition(p9_found(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p7_ids, p8_mix, p8_shares, p8_curriculum, p9_found, p9_composition)}
ORACLES: dict[str, str] = {}
