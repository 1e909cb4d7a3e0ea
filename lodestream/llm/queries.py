"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from lodestream.llm import chat, decontam, infill, jaccard, lines, mixing, quality, repeated_lines, rules, secrets, suffixes, tokens, whitening
from lodestream.llm.common import read_table


def op1_secret_scan(spark, sf_dir):
    return secrets.digest(read_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffixes.dedup(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return lines.digest(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_tool_call_chats(spark, sf_dir):
    calls, results, others = chat.from_conversations(read_table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.REPLY_SCHEMA, others)


def op6_token_counts(spark, sf_dir):
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard.join(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_decontamination(spark, sf_dir):
    return decontam.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark, sf_dir):
    return repeated_lines.digest(read_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark, sf_dir):
    return infill.digest(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_suffix_dedup, op3_line_dedup, op4_quality_classifier, op5_tool_call_chats, op6_token_counts, op7_source_mixing, op8_jaccard_join, op9_quality_rules, op10_decontamination, op11_line_dedup, op12_embedding_whitening, op13_fill_in_middle)}
ORACLE_SQL = {"op5_tool_call_chats": chat.REPLY_SQL, "op3_line_dedup": lines.LINES_SQL, "op11_line_dedup": repeated_lines.COMMON_LINES_SQL, "op13_fill_in_middle": infill.INFILL_SQL}
