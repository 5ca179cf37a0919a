"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from tellurion.llm import ann, chat, exactdup, langid, linedup, mixing, neardup, packing, periodic, quality, resampling, scoring, substring

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_nearest": ann.op2_nearest,
    "op3_substring": substring.op3_substring,
    "op4_perspectives": chat.op4_perspectives,
    "op5_scoring": scoring.op5_scoring,
    "op6_neardup": neardup.op6_neardup,
    "op7_mixing": mixing.op7_mixing,
    "op8_langid": langid.op8_langid,
    "op9_linedup": linedup.op9_linedup,
    "op10_quality": quality.op10_quality,
    "op11_periodic": periodic.op11_periodic,
    "op12_resampling": resampling.op12_resampling,
    "op13_exactdedup": exactdup.op13_exactdedup,
}

SQL = {"op4_perspectives": chat.OP4_SQL, "op12_resampling": resampling.OP12_SQL, "op13_exactdedup": exactdup.OP13_SQL}
