"""Column expressions (JVM-side) used by the operators."""

from .text import (NULL_TOKENS, fingerprint_long, null_if_token, path_stem, resolve_instruction,
                   resolve_instruction_col, row_fingerprint, tokens, truncate_tokens, with_prompt)
from .vector import (affine, argmax_prefix, as_double, as_float_vector, dot, l2_norm, l2_normalize,
                     row_mse, scale, sq_dist, sum_sq)

__all__ = [
    "NULL_TOKENS", "fingerprint_long", "null_if_token", "path_stem", "resolve_instruction",
    "resolve_instruction_col", "row_fingerprint", "tokens", "truncate_tokens", "with_prompt",
    "affine", "argmax_prefix", "as_double", "as_float_vector", "dot", "l2_norm", "l2_normalize",
    "row_mse", "scale", "sq_dist", "sum_sq",
]
