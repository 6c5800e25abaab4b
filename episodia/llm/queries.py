"""The dealt queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship
from .conversations import conversation_repair
from .decontam import decontamination
from .langid import language_id
from .language_model import language_model_scores
from .licenses import license_scan
from .mixing import mixture
from .near_dedup import near_duplicates
from .packing import pack
from .quality import quality_rules
from .secrets import secret_scan
from .spelling import spelling_variants
from .suffix_dedup import remove_repeats
from .topk import exact_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return run
    return register


@query("op1_language_id")
def op1(spark, d):
    return language_id(read_table(spark, d, "documents"))


@query("op2_secret_scan")
def op2(spark, d):
    return secret_scan(read_table(spark, d, "documents"))


@query("op3_suffix_dedup")
def op3(spark, d):
    return remove_repeats(read_table(spark, d, "documents"))


@query("op4_source_mixture")
def op4(spark, d):
    return mixture(read_table(spark, d, "documents"))


@query("op5_license_scan")
def op5(spark, d):
    return license_scan(read_table(spark, d, "documents"))


@query("op6_near_duplicates")
def op6(spark, d):
    return near_duplicates(read_table(spark, d, "documents"), width=4)


@query("op7_quality_rules")
def op7(spark, d):
    return quality_rules(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@query("op8_best_fit_packing")
def op8(spark, d):
    return pack(read_table(spark, d, "documents"))


@query("op9_language_model")
def op9(spark, d):
    return language_model_scores(read_table(spark, d, "documents"))


@query("op10_exact_topk")
def op10(spark, d):
    return exact_topk(read_table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_conversation_repair")
def op11(spark, d):
    return conversation_repair(read_table(spark, d, "conversations"))


@query("op12_spelling_variants")
def op12(spark, d):
    return spelling_variants(read_table(spark, d, "documents"))


@query("op13_benchmark_decontamination")
def op13(spark, d):
    return decontamination(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
