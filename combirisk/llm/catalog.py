"""The queries of the corpus operators and the SQL that checks them."""

import corpus_pipeline
from combirisk.llm import chat, conversations, decontamination, filter_audit, lines, mixing, pseudo_likelihood, repetition, simhash, suffix_dedup, tokens, toxicity, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_benchmark_decontamination": decontamination.op1_benchmark_decontamination,
    "op3_warc_bundles": warc.op3_warc_bundles,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_repetition_rules": repetition.op6_repetition_rules,
    "op7_token_attribution": tokens.op7_token_attribution,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_pseudo_likelihood": pseudo_likelihood.op9_pseudo_likelihood,
    "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
CHECKS: dict[str, str] = {
    "op3_warc_bundles": warc.OP3_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_line_dedup": lines.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
