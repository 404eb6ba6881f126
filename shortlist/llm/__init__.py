"""Training-data operators on Spark DataFrames.

Each module holds one operator with a general interface; ``queries`` derives
the digest columns of the registered ``opN_<name>`` queries from them.
"""
