"""The canonical record: stations with an ordered list of prices."""

from pyspark.sql import types as T

PRICE = T.StructType([
    T.StructField("fuel_type", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("currency", T.StringType()),
    T.StructField("unit", T.StringType()), T.StructField("updated_at", T.TimestampType()),
])
STATION = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "country", "name", "brand", "address", "city")),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("source", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("prices", T.ArrayType(PRICE)),
])
STATION_COLUMNS = STATION.fieldNames()
CACHE = T.StructType([
    T.StructField("country", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
])
