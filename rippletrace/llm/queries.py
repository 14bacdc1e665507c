"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, with SQL where it can say the same."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html_text, jaccard, pii, secrets, suffix_dedup, token_counts, topk, toxicity, turn_repair
from ._common import table


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_text(spark, sf_dir):
    return html_text.report(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op7_secrets(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark, sf_dir):
    return chat.report(table(spark, sf_dir, "conversations"))


def op9_topk(spark, sf_dir):
    return topk.report(table(spark, sf_dir, "embeddings"))


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"), *tokenizer())


def op11_turn_repair(spark, sf_dir):
    return turn_repair.report(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_html_text": op4_html_text,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pii": op6_pii,
    "op7_secrets": op7_secrets,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_topk": op9_topk,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_turn_repair": op11_turn_repair,
    "op12_token_counts": op12_token_counts,
}
