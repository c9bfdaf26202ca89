"""Building blocks for long native expressions, as the operators here use them."""

from stratalore.functions.expressions import SPACE, let, prefix_maxima, prefix_sums, words

__all__ = ["SPACE", "let", "prefix_maxima", "prefix_sums", "words"]
