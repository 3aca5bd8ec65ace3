"""Training-data operators.

Every operator takes DataFrames and column names, reads only the columns it is
told to read and returns only columns of its own, so other columns of the input
(clashing names included) can neither break it nor leak into its result.
"""
