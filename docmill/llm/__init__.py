"""Training-data operators.

Nothing else in the package imports this one.  Each module holds one operator with a
general interface and a thin ``opN_*`` query over the benchmark tables; ``registry``
lists the queries and their SQL twins.
"""
