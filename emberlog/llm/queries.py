"""The registered queries on training text, and the SQL of those that have one."""

import corpus_pipeline
from emberlog.llm import (
    collocations,
    decontaminate,
    jaccard,
    licences,
    mixing,
    personal,
    quality,
    rules,
    secrets,
    sharding,
    substrings,
    tokenfiles,
    tries,
)

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_licence_scan": licences.query,
    "op3_quality_sites": quality.query,
    "op4_kd_sharding": sharding.query,
    "op5_decontamination": decontaminate.query,
    "op6_jaccard_join": jaccard.query,
    "op7_quality_rules": rules.query,
    "op8_token_files": tokenfiles.query,
    "op9_substring_dedup": substrings.query,
    "op10_mixing": mixing.query,
    "op11_personal_data": personal.query,
    "op12_conversation_trie": tries.query,
    "op13_collocations": collocations.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_licence_scan": licences.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op7_quality_rules": rules.ORACLE,
    "op9_substring_dedup": substrings.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_personal_data": personal.ORACLE,
    "op12_conversation_trie": tries.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
