"""Queries of the training-data operators and, where SQL can express one, its DuckDB statement."""

from __future__ import annotations

from . import collocations, decontaminate, language, merkle, mixing, packing, quality, secrets, sharding, simhash, substring_dedup, token_store, toxicity


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_decontaminate,
        secrets.op2_secrets,
        token_store.op3_token_store,
        simhash.op4_simhash,
        quality.op5_quality,
        toxicity.op6_toxicity,
        language.op7_language,
        sharding.op8_sharding,
        mixing.op9_mixing,
        substring_dedup.op10_substring_dedup,
        packing.op11_packing,
        collocations.op12_collocations,
        merkle.op13_merkle,
    )
} | {"pipeline": _pipeline}

ORACLE_SQL = {"op1_decontaminate": decontaminate.ORACLE, "op2_secrets": secrets.ORACLE, "op10_substring_dedup": substring_dedup.ORACLE, "op12_collocations": collocations.ORACLE, "op13_merkle": merkle.ORACLE}
