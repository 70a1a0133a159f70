"""tablewright: table profiling, preparation, modelling and catalog ranking as Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` function or a ``pyspark.ml`` stage.
Sub-packages:

* ``sources``   - readers (format dispatch, CSV sniffing, ARFF, headerless) and sinks
* ``functions`` - reusable column expressions (parsing guards, tokens, URL parts)
* ``operators`` - profile, quality, typing, cleaning, split, features, text, catalog,
                  models, evaluation
* ``plans``     - composed flows (prepare-and-train, catalog ranking) and the query registry
* ``streaming`` - row-wise operators applied to a streaming frame
"""

__version__ = "0.1.0"
