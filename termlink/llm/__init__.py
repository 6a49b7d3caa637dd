"""Training-data operators: packing, mixing, decontamination, token counts,
near-duplicates, classifiers, HTML extraction, embedding links, URL filters.

Nothing outside this package (and the top-level ``corpus_pipeline.py``)
imports it."""
