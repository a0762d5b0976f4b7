"""The queries opN_<name> and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from folioforge.llm import audio, centroids, decontaminate, fingerprints, language_id, licenses, line_dedup, ngram_join, packing, pii, quality, sharding, spelling

QUERIES = {
    "op1_audio_features": audio.op1_audio_features,
    "op2_pii": pii.op2_pii,
    "op3_jump_shards": sharding.op3_jump_shards,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_quality": quality.op6_quality,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_language_id": language_id.op8_language_id,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_exponion": centroids.op11_exponion,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_weighted_sampling": fingerprints.op13_weighted_sampling,
}

ORACLES = {
    "op3_jump_shards": sharding.SHARD_SQL,
    "op4_line_dedup": line_dedup.LINE_SQL,
    "op5_license_scan": licenses.LICENSE_SQL,
    "op11_exponion": centroids.CENTROID_SQL,
    "op12_spelling_variants": spelling.SPELLING_SQL,
}
