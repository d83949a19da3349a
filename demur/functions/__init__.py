from .draws import uniform
from .expr import (half_even_k, interval_score, percent_true, relative_error,
                   significant, stars)

__all__ = ["uniform", "half_even_k", "interval_score", "percent_true",
           "relative_error", "significant", "stars"]
