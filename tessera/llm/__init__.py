"""Training-data operators (near duplicates, quality, toxicity, extraction, token counts, mixing, language, BPE).

Nothing outside this folder (and `corpus_pipeline.py`) imports it.
"""
