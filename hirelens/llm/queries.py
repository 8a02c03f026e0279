"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from hirelens.llm import chat, decontaminate, lang_id, line_dedup, packing, periodic_runs, pipeline, quality, sharding, simhash, token_alignment, token_blocks, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        url_filter.op1_url_filter,
        token_blocks.op2_token_blocks,
        lang_id.op3_language,
        decontaminate.op4_decontaminate,
        line_dedup.op5_line_dedup,
        simhash.op6_simhash,
        quality.op7_quality,
        packing.op8_packing,
        chat.op9_chat,
        toxicity.op10_toxicity,
        token_alignment.op11_token_alignment,
        sharding.op12_sharding,
        periodic_runs.op13_periodic_runs,
    )
} | {"pipeline": pipeline.run}
ORACLES = {"op1_url_filter": url_filter.oracle(), "op4_decontaminate": decontaminate.oracle(), "op5_line_dedup": line_dedup.oracle()}
