"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it; its queries and SQL live in
:mod:`lodestone.llm.queries`.
"""
