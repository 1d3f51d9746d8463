"""Analytics over decoded wireless captures, as Spark DataFrame operations.

Every operator takes a frame table (``framewright.sources.frames.SCHEMA``) and
returns a DataFrame; none knows where the frames came from. What could not be
measured stays NULL and is left out of denominators.
"""
