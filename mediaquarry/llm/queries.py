"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, decontam, htmlcut, linededup, minhash, mixing, quality, rpforest, sharding, spelling, tokencounts, urlfilter, warc


def queries() -> dict:
    return {
        "op1_mincut_text": htmlcut.op1_mincut_text,
        "op2_warc_roundtrip": warc.op2_warc_roundtrip,
        "op3_bfd_shards": sharding.op3_bfd_shards,
        "op4_hyperminhash_dedup": minhash.op4_hyperminhash_dedup,
        "op5_forest_dedup": rpforest.op5_forest_dedup,
        "op6_quality": quality.op6_quality,
        "op7_decontaminate": decontam.op7_decontaminate,
        "op8_temporal_url_filter": urlfilter.op8_temporal_url_filter,
        "op9_line_dedup": linededup.op9_line_dedup,
        "op10_pareto_mix": mixing.op10_pareto_mix,
        "op11_gemm_centroids": centroids.op11_gemm_centroids,
        "op12_parity_spelling": spelling.op12_parity_spelling,
        "op13_rank_merge_tokens": tokencounts.op13_rank_merge_tokens,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_roundtrip": warc.SQL,
        "op4_hyperminhash_dedup": minhash.SQL,
        "op5_forest_dedup": rpforest.SQL,
        "op8_temporal_url_filter": urlfilter.SQL,
        "op9_line_dedup": linededup.SQL,
        "op10_pareto_mix": mixing.SQL,
        "op11_gemm_centroids": centroids.SQL,
        "op12_parity_spelling": spelling.SQL,
    }
