"""Training-data operators: classification, de-duplication, search, decontamination,
formatting, output encoding, extraction and mixing as Spark jobs.

One module per operator; ``registered`` holds their queries for the driver.
Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
