"""The relations of a catalog: entries, mounts and content."""

from pyspark.sql import types as T

EXTENT = T.StructType([
    T.StructField("log", T.LongType()),
    T.StructField("phys", T.LongType()),  # null: a hole
    T.StructField("len", T.LongType()),
])
RECIPE = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("packed_size", T.LongType()),
    T.StructField("crc", T.LongType()),
    T.StructField("extents", T.ArrayType(EXTENT)),
    T.StructField("prefix", T.BinaryType()),
    T.StructField("error", T.StringType()),
])
FINDER = T.StructType([
    T.StructField("ftype", T.BinaryType()),
    T.StructField("creator", T.BinaryType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("ctime_ns", T.LongType()),
    T.StructField("comment", T.StringType()),
])
ENTRY = T.StructType([
    T.StructField("fs_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("parent", T.StringType()),
    T.StructField("base", T.StringType(), False),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),  # file, dir, implicit_dir, symlink, mount
    T.StructField("member_id", T.LongType()),
    T.StructField("ord", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("perm", T.IntegerType()),
    T.StructField("link_target", T.StringType()),
    T.StructField("recipe", RECIPE),
    T.StructField("finder", FINDER),
])
#: What a level of the expansion gives: entries, and bytes of those that are archives.
FOUND = T.StructType([*ENTRY.fields, T.StructField("format", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("open_error", T.StringType())])
