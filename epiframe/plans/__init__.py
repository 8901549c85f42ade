from epiframe.plans.joins import sized_broadcast
from epiframe.plans.ordering import cumulative_by_score, ordered_index

__all__ = ["sized_broadcast", "cumulative_by_score", "ordered_index"]
