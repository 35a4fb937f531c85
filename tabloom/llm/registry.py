"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import alignment, decontamination, language, lines, mixing, pii, sharding, simhash, spelling, substrings, suffixes, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sharding": sharding.op2_sharding,
    "op3_pii": pii.op3_pii,
    "op4_substrings": substrings.op4_substrings,
    "op5_topk": topk.op5_topk,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_language": language.op8_language,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
    "op11_spelling": spelling.op11_spelling,
    "op12_lines": lines.op12_lines,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES: dict[str, Callable[[], str]] = {
    "op2_sharding": sharding.oracle,
    "op4_substrings": substrings.oracle,
    "op5_topk": topk.oracle,
    "op6_decontamination": decontamination.oracle,
    "op11_spelling": spelling.oracle,
    "op12_lines": lines.oracle,
}
