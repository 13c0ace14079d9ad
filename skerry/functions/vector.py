"""Vector arithmetic inside the JVM, in doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def literal(values) -> Column:
    return F.lit([float(x) for x in values])
