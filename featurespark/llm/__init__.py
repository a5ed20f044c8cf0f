"""Training-data operators: deduplication, archives, sharding, quality, decontamination, mixing.

Nothing else in the library imports this subpackage. Conventions shared by all operators:

* the input frame may carry any extra columns; only the named id / text / source columns are read;
* a null text is an empty text unless an operator says otherwise;
* intermediate tables are written to the folder named by ``spark.checkpoint.dir``.
"""
