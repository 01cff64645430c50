"""Column-expression builders: every function returns a ``Column`` that
Catalyst can fold into whole-stage codegen (no Python UDFs)."""

from curbscope.functions.grid import hex_cell_id, hex_grid_constants
from curbscope.functions.numeric import clip, rint_round
from curbscope.functions.tags import parse_tags, record_severity, strip_ws
from curbscope.functions.text import normalize_missing, recommended_action
from curbscope.functions.timeparts import ist_timestamp

__all__ = [
    "hex_cell_id", "hex_grid_constants", "clip", "rint_round", "parse_tags",
    "record_severity", "strip_ws", "normalize_missing", "recommended_action",
    "ist_timestamp",
]
