"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from evalmill.llm.chat_format import OP1_SQL, op1_chat_format
from evalmill.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from evalmill.llm.language_id import op10_language_id
from evalmill.llm.license_scan import op5_license_scan
from evalmill.llm.near_dedup import op7_minhash_near_dedup
from evalmill.llm.packing import op8_best_fit_packing
from evalmill.llm.periodic import op11_periodic_runs
from evalmill.llm.quality import op2_quality_rules
from evalmill.llm.quality_fm import op12_quality_classifier
from evalmill.llm.quality_sql import OP2_SQL
from evalmill.llm.secret_scan import OP9_SQL, op9_secret_scan
from evalmill.llm.token_counts import op6_token_counts
from evalmill.llm.tokenizers_bpe import op3_bpe_codec
from evalmill.llm.whitening import op13_embedding_whitening


def queries() -> dict:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_quality_rules": op2_quality_rules,
        "op3_bpe_codec": op3_bpe_codec,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_token_counts": op6_token_counts,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_secret_scan": op9_secret_scan,
        "op10_language_id": op10_language_id,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_embedding_whitening": op13_embedding_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_quality_rules": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op9_secret_scan": OP9_SQL}
