"""Fixed schemas; nothing is inferred."""

from pyspark.sql import types as T

DICTIONARY = T.StructType([T.StructField("word", T.StringType(), False), T.StructField("freq", T.LongType(), False)])
QUERIES = T.StructType([T.StructField("qid", T.LongType()), T.StructField("max_distance", T.IntegerType()), T.StructField("word", T.StringType())])
RESULT = T.StructType([T.StructField("word", T.StringType()), T.StructField("freq", T.LongType()), T.StructField("distance", T.IntegerType())])

#: Frequencies are whole numbers that fit 32 bits; zero would mean that there is no such word.
MAX_FREQ = 4294967295
