"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from . import decontamination, lattice, licenses, mixing, negatives, pii, quality, repair, sharding, simhash, site_lines, substrings, token_counts
from .common import table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return add


@_query("op1_sharding")
def op1_sharding(spark, sf_dir):
    return sharding.shard_report(table(spark, sf_dir, "documents"))


@_query("op8_mixing", mixing.ORACLE)
def op8_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@_query("op6_quality_rules", quality.ORACLE)
def op6_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    return decontamination.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op9_simhash")
def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op5_site_lines", site_lines.ORACLE)
def op5_site_lines(spark, sf_dir):
    return site_lines.site_lines(table(spark, sf_dir, "pages"))


@_query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@_query("op7_pii")
def op7_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


@_query("op10_lattice_scores")
def op10_lattice_scores(spark, sf_dir):
    return lattice.lattice_scores(table(spark, sf_dir, "documents"))


@_query("op2_substring_dedup", substrings.ORACLE)
def op2_substring_dedup(spark, sf_dir):
    return substrings.substring_report(table(spark, sf_dir, "documents"))


@_query("op13_license_scans", licenses.ORACLE)
def op13_license_scans(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


@_query("op11_hard_negatives", negatives.ORACLE)
def op11_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@_query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    return repair.repair_report(repair.damaged(table(spark, sf_dir, "conversations")))
