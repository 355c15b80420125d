"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import crf, grammar, longmatch, mixing, nearby, pieces, quality, recipes, toolcalls, urls

QUERIES = {
    "op1_language": crf.op1_language,
    "op2_recipes": recipes.op2_recipes,
    "op3_near": nearby.op3_near,
    "op4_url_rules": urls.op4_url_rules,
    "op5_mixing": mixing.op5_mixing,
    "op6_tool_calls": toolcalls.op6_tool_calls,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_quality": quality.op8_quality,
    "op9_grammar": grammar.op9_grammar,
    "op10_long_matches": longmatch.op10_long_matches,
}

ORACLES = {
    "op2_recipes": recipes.OP2_SQL,
    "op3_near": nearby.OP3_SQL,
    "op4_url_rules": urls.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_tool_calls": toolcalls.OP6_SQL,
    "op8_quality": quality.OP8_SQL,
    "op10_long_matches": longmatch.OP10_SQL,
}
