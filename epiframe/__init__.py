"""epiframe: labelled-sequence preparation, sampling, scoring and evaluation on Spark.

Every public operator is a function from DataFrame(s) to DataFrame. Column-level
building blocks live in ``epiframe.functions``; readers and writers in
``epiframe.sources``; relational operators in ``epiframe.operators``; the few
plan shapes that need care at scale (two-level ordering, size-checked broadcast)
in ``epiframe.plans``.
"""

__version__ = "0.1.0"
