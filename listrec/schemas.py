"""Fixed schemas of the model tables."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}[t]) for n, t in (f.split() for f in text.split(","))])


EVENTS = _schema("user_id long,item_id long,timestamp long,eid int")
ITEMS = _schema("item_id long,vertical_id int,category_ext_y int,region_id_y int,loc_id_y int")
TARGETS = _schema("user_id long,item_id long")
