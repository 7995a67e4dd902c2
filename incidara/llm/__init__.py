"""Operators that prepare training text: dedup, filters, extraction, encoding, packing.

Nothing outside this subpackage imports it; its queries are in ``incidara.llm.queries``.
"""
