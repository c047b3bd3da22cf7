"""Vector and metadata expressions."""

from stellate.functions.vectors import (
    cosine_distance,
    distance,
    inner_product_distance,
    l2_distance,
    l2_squared,
    magnitude,
    normalize,
    similarity,
)

__all__ = ["cosine_distance", "distance", "inner_product_distance", "l2_distance", "l2_squared", "magnitude", "normalize", "similarity"]
