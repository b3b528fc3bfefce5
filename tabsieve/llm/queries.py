"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from .embedding_dedup import OP1_SQL, op1_pigeonhole_join
from .language_id import op4_language_id
from .language_model import op8_pitman_yor_lm
from .minhash_dedup import op3_minhash_dedup
from .mixing import op10_mix_sources
from .packing import op2_lexical_packing
from .secrets import op6_credential_links
from .sharding import op7_external_shuffle
from .suffix_dedup import op5_difference_cover
from .topk_search import OP9_SQL, op9_topk_nra

QUERIES = {
    "op5_difference_cover": op5_difference_cover,
    "op8_pitman_yor_lm": op8_pitman_yor_lm,
    "op1_pigeonhole_join": op1_pigeonhole_join,
    "op2_lexical_packing": op2_lexical_packing,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_language_id": op4_language_id,
    "op6_credential_links": op6_credential_links,
    "op7_external_shuffle": op7_external_shuffle,
    "op9_topk_nra": op9_topk_nra,
    "op10_mix_sources": op10_mix_sources,
}

SQL: dict[str, str] = {"op1_pigeonhole_join": OP1_SQL, "op9_topk_nra": OP9_SQL}
