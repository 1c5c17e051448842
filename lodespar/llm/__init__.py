"""Training-data operators: one module each, the queries over them in ``catalogue``.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; deleting it leaves the rest of
the library whole.
"""
