"""Operators for preparing text corpora: ten composable DataFrame operators and their queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
