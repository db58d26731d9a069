"""The queries of this folder, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline
from corvane.llm.alignment import op12_alignment
from corvane.llm.bpe import op3_bpe
from corvane.llm.divergence import OP13_SQL, op13_divergence
from corvane.llm.html import op5_html
from corvane.llm.lines import op7_lines
from corvane.llm.media import op2_media
from corvane.llm.packing import op9_packing
from corvane.llm.quality import op10_quality
from corvane.llm.ring import OP11_SQL, op11_sharding
from corvane.llm.scoring import op1_scoring
from corvane.llm.simhash import op4_simhash
from corvane.llm.substrings import op8_substrings
from corvane.llm.urls import OP6_SQL, op6_urls


def queries() -> dict:
    found = (
        op1_scoring, op2_media, op3_bpe, op4_simhash, op5_html, op6_urls, op7_lines, op8_substrings, op9_packing, op10_quality,
        op11_sharding, op12_alignment, op13_divergence,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op6_urls": OP6_SQL, "op11_sharding": OP11_SQL, "op13_divergence": OP13_SQL}
