"""Queries of this subpackage and, where SQL can state one, the same in DuckDB SQL."""

from kindred.llm.asof import OP13_SQL, op13_asof_orders
from kindred.llm.byte_language import op11_byte_language
from kindred.llm.jaccard_forest import OP4_SQL, op4_jaccard_forest
from kindred.llm.licences import op5_licences
from kindred.llm.long_repeats import OP10_SQL, op10_long_repeats
from kindred.llm.main_text import op2_main_text
from kindred.llm.mixing import OP8_SQL, op8_mixing
from kindred.llm.near_vectors import OP1_SQL, op1_near_vectors
from kindred.llm.order_minhash import op7_order_minhash
from kindred.llm.part_codes import OP12_SQL, op12_part_codes
from kindred.llm.pieces import op3_pieces
from kindred.llm.toxicity import op6_toxicity
from kindred.llm.warc import op9_warc

_ALL = (
    op1_near_vectors, op2_main_text, op3_pieces, op4_jaccard_forest, op5_licences, op6_toxicity, op7_order_minhash, op8_mixing, op9_warc, op10_long_repeats,
    op11_byte_language, op12_part_codes, op13_asof_orders,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_near_vectors": OP1_SQL, "op4_jaccard_forest": OP4_SQL, "op8_mixing": OP8_SQL, "op10_long_repeats": OP10_SQL, "op12_part_codes": OP12_SQL, "op13_asof_orders": OP13_SQL}
