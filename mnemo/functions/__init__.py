"""Column-level building blocks (property values, text forms, matching)."""

from mnemo.functions.text import (  # noqa: F401
    any_word_matches, any_word_matches_col, is_blank_query, js_trim, tokenize, tokenize_col,
)
from mnemo.functions.values import (  # noqa: F401
    PROPS_DDL, PROPS_TYPE, PV_DDL, PV_TYPE, empty_props, is_falsy, js_number_text, null_pv,
    order_keys, props_map, pv_array, pv_boolean, pv_number, pv_string, search_text,
)
