"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spectrafold.llm import bpe, decontamination, fill_in_middle, filter_audit, jaccard_join, line_dedup, packing, pii, secrets, substring_dedup, toxicity, vector_graph, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_vector_graph": vector_graph.op2_vector_graph,
        "op3_packing": packing.op3_packing,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_warc": warc.op5_warc,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_bpe": bpe.op7_bpe,
        "op8_secrets": secrets.op8_secrets,
        "op9_pii": pii.op9_pii,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_substring_dedup": substring_dedup.op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": fill_in_middle.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
