"""Training-data operators: language ID, near-dedup, decontamination, packing and friends.

Nothing outside this subpackage imports it; its queries are registered through
:mod:`hypnoframe.llm.registry`.
"""
