"""Star-schema tables seen as imaging tables, in Spark and, for oracles, in DuckDB SQL.

Every operator can so be run on any scale factor; each projection is deterministic, reads all rows
of its table, and has fields of view in proportion to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS, CHANNELS = 2, 4
#: How many keys make a field of view: orders of an image, events of a spot table, masks, embeddings.
IMAGE_KEYS, SPOT_KEYS, MASK_KEYS, FEATURE_KEYS = 16_384, 2_048, 20, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fov(key: str, size: int) -> Column:
    return F.concat(F.lit("fov_"), F.floor(F.col(key) / size).cast("string"))


def _folded(column: str) -> Column:
    """ROUNDS * CHANNELS sums over the whole embedding: the n-th is that of every value whose position leaves n."""
    n = ROUNDS * CHANNELS
    return F.expr(f"transform(sequence(0, {n - 1}), i -> aggregate(filter(CAST({column} AS array<double>), (v, j) -> j % {n} = i), 0.0D, (s, v) -> s + v))")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id, trace: each embedding folded to ROUNDS * CHANNELS values, round-major; fov by id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(_fov("vec_id", FEATURE_KEYS).alias("fov"), F.col("vec_id").alias("feature_id"), _folded("embedding").alias("trace"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_idx, target, trace: of each label the embedding with the smallest id."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return first.select(F.col("label").cast("int").alias("code_idx"), F.concat(F.lit("G"), F.col("label").cast("string")).alias("target"), _folded("v").alias("trace"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense image stack: fields of view by line status and order key, each of 4 rounds, 3 channels, 2 planes of 16 x 16; value 0 to 1."""
    li = table(spark, sf_dir, "lineitem").withColumn("fov", F.concat_ws("_", "l_linestatus", F.floor(F.col("l_orderkey") / IMAGE_KEYS).cast("string")))
    fovs = li.select("fov").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4 * 3 * 2 * 16 * 16 - 1))))
    part = lambda by, n: F.pmod(F.floor(F.col("i") / by), F.lit(n)).cast("int")
    grid = fovs.select("fov", part(1536, 4).alias("r"), part(512, 3).alias("c"), part(256, 2).alias("z"), part(16, 16).alias("y"), part(1, 16).alias("x"))
    measured = li.groupBy(
        "fov", F.pmod(F.col("l_linenumber") - 1, F.lit(4)).cast("int").alias("r"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("c"),
        F.pmod("l_orderkey", F.lit(2)).cast("int").alias("z"), F.pmod("l_suppkey", F.lit(16)).cast("int").alias("y"), F.pmod("l_partkey", F.lit(16)).cast("int").alias("x"),
    ).agg((F.avg("l_quantity") / 50).alias("value"))
    return grid.join(measured, ["fov", "r", "c", "z", "y", "x"], "left").na.fill(0.0, ["value"])


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots in 4 rounds and 5 channels, with unrounded x; fields of view by event_id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        _fov("event_id", SPOT_KEYS).alias("fov"), F.pmod("event_id", F.lit(4)).cast("int").alias("r"), F.pmod(F.length("event_type"), F.lit(5)).cast("int").alias("c"),
        F.col("event_id").alias("spot_id"), F.lit(0.0).alias("z"), F.pmod("user_id", F.lit(64)).cast("double").alias("y"), F.pmod("value", F.lit(64.0)).alias("x"),
        F.lit(1.0).alias("radius"), (F.col("value") / 500).alias("intensity"),
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mask_pixels: a rectangle for each part, MASK_KEYS of them, which may overlap, in a field of view of 64 x 64.

    Parts are dealt out before they are spread: a small file of them, in few tasks, makes a hundred times as many rows.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    y0, x0 = F.pmod(F.col("p_partkey") * 13, F.lit(48)), F.pmod(F.col("p_partkey") * 29, F.lit(48))
    size = F.col("p_size") % 12 + 4
    return p.select(
        _fov("p_partkey", MASK_KEYS).alias("fov"), (F.col("p_partkey") % MASK_KEYS).cast("int").alias("mask_id"), F.lit(0).alias("z"),
        y0.cast("int").alias("y0"), x0.cast("int").alias("x0"), size.cast("int").alias("n"),
    ).select("fov", "mask_id", "z", F.explode(F.sequence("y0", F.col("y0") + F.col("n") - 1)).alias("y"), "x0", "n").select(
        "fov", "mask_id", "z", "y", F.explode(F.sequence("x0", F.col("x0") + F.col("n") - 1)).alias("x"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded spots with physical coordinates in fields of view by nation, whose bounding boxes overlap here and there."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.format_string("fov_%02d", "c_nationkey").alias("fov"), F.col("c_custkey").alias("feature_id"),
        (F.pmod("c_nationkey", F.lit(5)) * 9000 + F.col("c_acctbal")).alias("xc"), (F.floor(F.col("c_nationkey") / 5) * 900 + F.pmod("c_custkey", F.lit(1000))).cast("double").alias("yc"),
        F.col("c_mktsegment").alias("target"),
    )


def _folded_sql(column: str) -> str:
    n = ROUNDS * CHANNELS
    return f"list_transform(range(0, {n}), lambda i: list_sum(list_transform(range(0, len({column}) // {n}), lambda j: {column}[1 + i + {n} * j]::DOUBLE)))"


#: The same in DuckDB, as common table expressions by name; each uses tables and earlier ones only.
SQL = {
    "features": f"SELECT 'fov_' || (vec_id // {FEATURE_KEYS}) AS fov, vec_id AS feature_id, {_folded_sql('embedding')} AS trace FROM embeddings",
    "codes": f"SELECT label::INT AS code_idx, 'G' || label AS target, {_folded_sql('v')} AS trace FROM (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)",
    "pixels": f"""SELECT fov, r::INT AS r, c::INT AS c, z::INT AS z, y::INT AS y, x::INT AS x, coalesce(value, 0.0) AS value
        FROM (SELECT * FROM (SELECT DISTINCT l_linestatus || '_' || (l_orderkey // {IMAGE_KEYS}) AS fov FROM lineitem), range(4) a(r), range(3) b(c), range(2) d(z), range(16) e(y), range(16) f(x)) g
        LEFT JOIN (SELECT l_linestatus || '_' || (l_orderkey // {IMAGE_KEYS}) AS fov, (l_linenumber - 1) % 4 AS r, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, l_orderkey % 2 AS z,
            l_suppkey % 16 AS y, l_partkey % 16 AS x, avg(l_quantity) / 50 AS value FROM lineitem GROUP BY ALL) USING (fov, r, c, z, y, x)""",
    "spots": f"""SELECT 'fov_' || (event_id // {SPOT_KEYS}) AS fov, (event_id % 4)::INT AS r, (length(event_type) % 5)::INT AS c, event_id AS spot_id, 0.0::DOUBLE AS z, (user_id % 64)::DOUBLE AS y, value % 64 AS x, 1.0::DOUBLE AS radius, value / 500 AS intensity
        FROM events""",
    "mask_pixels": f"""SELECT fov, mask_id, 0 AS z, y, unnest(range(x0, x0 + n))::INT AS x FROM (
        SELECT fov, mask_id, unnest(range(y0, y0 + n))::INT AS y, x0, n FROM (
        SELECT 'fov_' || (p_partkey // {MASK_KEYS}) AS fov, (p_partkey % {MASK_KEYS})::INT AS mask_id, (p_partkey * 13 % 48)::INT AS y0, (p_partkey * 29 % 48)::INT AS x0, (p_size % 12 + 4)::INT AS n FROM part))""",
    "areas": """SELECT printf('fov_%02d', c_nationkey) AS fov, c_custkey AS feature_id, (c_nationkey % 5) * 9000 + c_acctbal AS xc, ((c_nationkey // 5) * 900 + c_custkey % 1000)::DOUBLE AS yc, c_mktsegment AS target FROM customer""",
}


def with_(*names: str, **more: str) -> str:
    """WITH clause of the named projections and further ones."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in {**{n: SQL[n] for n in names}, **more}.items()) + "\n"
