"""The registered queries of this package and the SQL that some of them are checked against."""

from __future__ import annotations

from sparktrail.llm import (
    chat,
    decontaminate,
    jaccard,
    linededup,
    middle,
    mixing,
    quality,
    ranked,
    rules,
    sharding,
    spans,
    surrogates,
    tokenfile,
)


def op4_ngram_jaccard(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return jaccard.jaccard_components(documents).drop("text_hash")


QUERIES = {
    "op1_substring_dedup": spans.op1_substring_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_pii_surrogates": surrogates.op5_pii_surrogates,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_mixing": mixing.op10_mixing,
    "op11_token_files": tokenfile.op11_token_files,
    "op12_fill_in_middle": middle.op12_fill_in_middle,
    "op13_ranked_search": ranked.op13_ranked_search,
}

ORACLES = {
    "op2_sharding": sharding.OP2_SQL,
    "op3_line_dedup": linededup.OP3_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op12_fill_in_middle": middle.OP12_SQL,
    "op13_ranked_search": ranked.OP13_SQL,
}


def register() -> tuple[dict, dict]:
    """Queries and SQL of this package and of the pipeline."""
    import corpus_pipeline

    queries, oracles = dict(QUERIES), dict(ORACLES)
    queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries, oracles
