"""Record layouts and the fixed values every layer agrees on."""

from pyspark.sql import types as T

POSITIVE = 1
NEGATIVE = -1

GAMES = T.StructType([
    T.StructField("app_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("release_year", T.IntegerType()),
    T.StructField("windows", T.BooleanType()),
    T.StructField("mac", T.BooleanType()),
    T.StructField("linux", T.BooleanType()),
    T.StructField("avg_playtime", T.LongType()),
    T.StructField("genres", T.ArrayType(T.StringType(), containsNull=False)),
])

REVIEWS = T.StructType([
    T.StructField("app_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.ByteType()),
])

STAT = T.StructType([
    T.StructField("app_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("stat", T.LongType()),
])

# CSV position of every field that is read, and the least number
# of fields a record must have.
GAME_FIELDS = {
    "app_id": 0,
    "name": 1,
    "release_date": 2,
    "windows": 17,
    "mac": 18,
    "linux": 19,
    "avg_playtime": 29,
    "genres": 36,
}
GAME_WIDTH = 37

REVIEW_FIELDS = {"app_id": 0, "text": 2, "score": 3}
REVIEW_WIDTH = 4

# Result headers by question number.
RESULT_HEADERS = {
    1: ("Linux", "Mac", "Windows"),
    2: ("AppID", "Name", "Average playtime forever"),
    3: ("AppID", "Name", "Reviews"),
    4: ("AppID", "Name", "Reviews"),
    5: ("AppID", "Name", "Reviews"),
}
