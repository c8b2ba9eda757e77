"""harmonium: entity matching, feature building and recommendation on PySpark.

Every operator takes and returns Spark ``DataFrame``s. Physical choices (join
strategy, partial aggregation, pruning) are left to Catalyst and AQE; the
package only adds what they cannot decide: how to split a crowded group, how
to find similar names without comparing all pairs, and how to keep fitted
state small.
"""
