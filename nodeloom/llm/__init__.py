"""Training-data operators: cleaning, deduplication, tokenising, mixing and scoring of text at scale.

Nothing outside this subpackage imports it; `queries` lists what it registers.
"""
