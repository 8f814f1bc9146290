"""Operations for large-scale training-data preparation, one module per operator.

Every operator takes DataFrames and returns DataFrames. Work is partitioned and shuffled by Spark; NumPy
runs inside tasks on whole Arrow batches. Conventions shared by all operators:

* a row with a null key (``doc_id``, ``vec_id``, ``conv_id``) is not a record and is left out;
* rows that repeat a key count once (the smallest text, nulls first, stays);
* a null text is an empty text; only the named columns are read, so extra columns never clash.
"""
