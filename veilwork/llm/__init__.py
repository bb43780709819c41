"""Training-data operators: URL filters, quality rules, dedup, tokenising, archives, mixing, toxicity, HTML text.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
