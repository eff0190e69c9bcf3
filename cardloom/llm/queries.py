"""The operators' queries by name, and SQL for those that it can express."""

from . import bpe, chat_format, decontamination, filter_audit, html_extract, lm_scoring, merkle, near_dedup, piece_encoding, quality_rules, sharding, token_output, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        html_extract.op1_block_lstm, chat_format.op2_perspective_rotation, near_dedup.op3_order_minhash,
            toxicity.op4_string_kernel_toxicity,
        decontamination.op5_winnowing_decontamination, lm_scoring.op6_log_bilinear, quality_rules.op7_line_rules,
            sharding.op8_rendezvous_sharding,
        token_output.op9_token_files, bpe.op10_bpe_tree, filter_audit.op11_lattice_edges, merkle.op12_mountain_range,
            piece_encoding.op13_distinct_chunks,
    )
}

ORACLES = {"op2_perspective_rotation": chat_format.ORACLE_SQL, "op5_winnowing_decontamination": decontamination.ORACLE_SQL,
    "op11_lattice_edges": filter_audit.ORACLE_SQL}
