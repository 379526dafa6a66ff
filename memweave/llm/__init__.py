"""Training-data operators: fingerprints, classifiers, deduplication, decontamination, formatting and mixing.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
