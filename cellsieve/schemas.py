"""Table schemas; nothing is inferred."""

from pyspark.sql import types as T

ITEMS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("ext_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("revdate", T.TimestampNTZType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("entity", T.StringType()),
    ]
)

# Raw article rows as they arrive in CSV: all text, typed by the load step.
RAW = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("item_id", "id", "title", "text", "url", "revdate", "token_count", "entity")
    ]
)

CENTROIDS = T.StructType(
    [
        T.StructField("cell_id", T.LongType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType())),
    ]
)

CODEBOOKS = T.StructType(
    [
        T.StructField("m", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("codeword", T.ArrayType(T.DoubleType())),
    ]
)

INDEX_META = T.StructType(
    [
        T.StructField("dim", T.IntegerType()),
        T.StructField("nlist", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("pq_m", T.IntegerType()),
        T.StructField("pq_bits", T.IntegerType()),
        T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
    ]
)

DISPLAY_COLUMNS = ("item_id", "title", "revdate", "token_count")
ITEM_COLUMNS = tuple(ITEMS.fieldNames())
