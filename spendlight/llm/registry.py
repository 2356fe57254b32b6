"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from spendlight.llm import conversations
from spendlight.llm.alignment import op11_cross_tokenizer_alignment
from spendlight.llm.ann import op3_collision_counting_ann
from spendlight.llm.conversations import op13_conversation_repair
from spendlight.llm.decontamination import op7_benchmark_decontamination
from spendlight.llm.html_text import op5_site_style_tree
from spendlight.llm.line_dedup import op6_line_dedup
from spendlight.llm.packing import op8_bm25_packing
from spendlight.llm.personal_data import op12_personal_data
from spendlight.llm.quality import op1_quality_classifier
from spendlight.llm.secret_scan import op4_secret_scan
from spendlight.llm.sharding import op9_rendezvous_sharding
from spendlight.llm.simhash import op10_simhash_near_dedup
from spendlight.llm.toxicity import op2_toxicity


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_quality_classifier,
            op2_toxicity,
            op3_collision_counting_ann,
            op4_secret_scan,
            op5_site_style_tree,
            op6_line_dedup,
            op7_benchmark_decontamination,
            op8_bm25_packing,
            op9_rendezvous_sharding,
            op10_simhash_near_dedup,
            op11_cross_tokenizer_alignment,
            op12_personal_data,
            op13_conversation_repair,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op13_conversation_repair": conversations.ORACLE_SQL}
