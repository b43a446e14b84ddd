"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``showerlake.llm.queries`` lists
the registered queries and their SQL.
"""
