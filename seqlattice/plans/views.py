"""Views over the test tables that give the operators their inputs, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores; a file of one row group is read by one task, and the views below make many rows of each of its.

    A table of many files or row groups is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base, row_idx, text, split``: every document's lines in the alphabet."""
    own = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("base"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    clean = F.regexp_replace(F.upper(F.regexp_replace("line", "[^A-Za-z&:)]", "")), "[JV]", "")
    split = F.when(F.col("base") % 10 == 0, "val").when(F.col("base") % 10 == 1, "test").otherwise("train")
    return own.select("base", F.col("pos").cast("bigint").alias("row_idx"), clean.alias("text"), split.alias("split"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that other views and queries are made of: whole lines."""
    return lines(spark, sf_dir)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base, row_idx, split, truth, pred``: rows and a corrupted reading of them."""
    return rows(spark, sf_dir).where(F.length("text") > 0).select("base", "row_idx", "split", F.col("text").alias("truth"), F.translate(F.replace(F.col("text"), F.lit("AN"), F.lit("A")), "OSI", "QZL").alias("pred"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selector input from ``lineitem``: one row for each order, its lines the candidates."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).cast("bigint").alias("fold"),
        F.col("l_orderkey").cast("bigint").alias("row_key"),
        (F.row_number().over(order) - 1).cast("bigint").alias("candidate_index"),
        (20 + F.col("l_orderkey") % 7).cast("bigint").alias("chars"),
        (F.col("l_partkey") % 6).cast("bigint").alias("edit_distance"),
        (-F.col("l_extendedprice").cast("double") / 1000).alias("visual_sum"),
        (-F.col("l_quantity").cast("double")).alias("ppm_sum"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, box_id, cx, cy, w, h``: a jittered grid of letter boxes for each 250 order lines of a supplier."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    n = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", (F.row_number().over(order) - 1).cast("bigint").alias("n"))
    b = n.select(
        (F.col("l_suppkey") * 1000 + F.floor(F.col("n") / 250)).cast("bigint").alias("file_id"),
        (F.col("n") % 250).alias("box_id"),
        (F.col("l_partkey") % 5 - 2).alias("jx"),
        (F.col("l_linenumber") % 5 - 2).alias("jy"),
    )
    return b.select("file_id", "box_id", (100 + 40 * (F.col("box_id") % 20) + F.col("jx")).cast("double").alias("cx"), (100 + 60 * F.floor(F.col("box_id") / 20) + F.col("jy")).cast("double").alias("cy"), F.lit(30.0).alias("w"), F.lit(40.0).alias("h"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, seg_id, x0, y0, x1, y1``: two touching baseline segments for each grid row."""
    grid = boxes(spark, sf_dir).select("file_id", F.floor(F.col("box_id") / 20).cast("bigint").alias("g")).distinct().select("file_id", "g", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    y = (100.0 + 60 * F.col("g")).alias("y")
    return grid.select("file_id", (F.col("g") * 2 + F.col("half")).alias("seg_id"), (80.0 + 410 * F.col("half")).alias("x0"), y.alias("y0"), (490.0 + 410 * F.col("half")).alias("x1"), y.alias("y1"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base, row_idx, chunk_idx, label, logits``: class scores from the first 27 components of ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 13).cast("bigint").alias("base"), F.floor(F.col("vec_id") % 13 / 4).cast("bigint").alias("row_idx"), (F.col("vec_id") % 13 % 4).cast("bigint").alias("chunk_idx"), F.col("label").cast("bigint").alias("label"), F.slice("embedding", 1, 27).cast("array<double>").alias("logits"))


def whole_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`logits`, with all thirteen positions of an object in one row."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 13).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("row_idx"), (F.col("vec_id") % 13).cast("bigint").alias("chunk_idx"), F.col("label").cast("bigint").alias("label"), F.slice("embedding", 1, 27).cast("array<double>").alias("logits"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base, row_idx, chunk_idx, t``: rows cut into fours."""
    cut = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 4).cast("int") - 1))
    return rows(spark, sf_dir).where(F.length("text") > 0).select("base", "row_idx", "text", cut.alias("chunk_idx")).select("base", "row_idx", "chunk_idx", F.substring("text", F.col("chunk_idx") * 4 + 1, F.lit(4)).alias("t"))


def chunks2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second view: some chunks altered, and the first row of every eleventh object missing."""
    return chunks(spark, sf_dir).where("NOT (base % 11 = 0 AND row_idx = 0)").withColumn("t", F.when((F.col("base") + F.col("row_idx") + F.col("chunk_idx")) % 97 == 0, F.concat("t", F.lit("A"))).otherwise(F.col("t")))


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base, row_idx, pos, ch, conf``: per-letter confidence."""
    letters = rows(spark, sf_dir).where(F.length("text") > 0).select("base", "row_idx", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    return letters.select("base", "row_idx", "pos", "ch", ((F.ascii("ch") + F.col("pos") + 1 + F.col("base")) % 7 != 0).alias("conf"))


def _flags(text: str) -> Column:
    """The flags of :func:`confidence` of a row as one array."""
    return F.transform(F.split(text, ""), lambda ch, pos: (F.ascii(ch) + pos + 1 + F.col("base")) % 7 != 0).alias("flags")


def confidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base, row_idx, flags``: :func:`confidence` with the flags of a row as one array."""
    return rows(spark, sf_dir).where(F.length("text") > 0).select("base", "row_idx", _flags("text"))


def flagged_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base, row_idx, text, pred, flags``: :func:`preds` with the flags of :func:`confidence_rows`."""
    return preds(spark, sf_dir).select("base", "row_idx", F.col("truth").alias("text"), "pred", _flags("truth"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base, rotation, file_name``: objects with one to several images."""
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("bigint") % 4000).alias("base"), F.concat(F.lit("Rotation"), (1 + F.col("o_custkey") % 2).cast("string")).alias("rotation"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_name"))


#: The same views in SQL; each may use those above it.
SQL = {
    "v_lines": """SELECT base, CAST(pos AS BIGINT) AS row_idx, regexp_replace(upper(regexp_replace(line, '[^A-Za-z&:)]', '', 'g')), '[JV]', '', 'g') AS text, CASE base % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id AS base, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) l""",
    "v_rows": "SELECT base, row_idx, text, split FROM v_lines",
    "v_preds": "SELECT base, row_idx, split, text AS truth, translate(replace(text, 'AN', 'A'), 'OSI', 'QZL') AS pred FROM v_rows WHERE length(text) > 0",
    "v_candidates": """SELECT CAST(l_orderkey % 5 AS BIGINT) AS fold, CAST(l_orderkey AS BIGINT) AS row_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS candidate_index,
CAST(20 + l_orderkey % 7 AS BIGINT) AS chars, CAST(l_partkey % 6 AS BIGINT) AS edit_distance, -CAST(l_extendedprice AS DOUBLE) / 1000 AS visual_sum, -CAST(l_quantity AS DOUBLE) AS ppm_sum FROM lineitem""",
    "v_boxes": """SELECT file_id, box_id, CAST(100 + 40 * (box_id % 20) + jx AS DOUBLE) AS cx, CAST(100 + 60 * floor(box_id / 20.0) + jy AS DOUBLE) AS cy, 30.0::DOUBLE AS w, 40.0::DOUBLE AS h FROM (
SELECT CAST(l_suppkey * 1000 + floor(n / 250.0) AS BIGINT) AS file_id, n % 250 AS box_id, l_partkey % 5 - 2 AS jx, l_linenumber % 5 - 2 AS jy FROM (
SELECT l_suppkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS n FROM lineitem) a) b""",
    "v_segments": """SELECT file_id, g * 2 + half AS seg_id, CAST(80 + 410 * half AS DOUBLE) AS x0, CAST(100 + 60 * g AS DOUBLE) AS y0, CAST(490 + 410 * half AS DOUBLE) AS x1, CAST(100 + 60 * g AS DOUBLE) AS y1
FROM (SELECT DISTINCT file_id, CAST(floor(box_id / 20.0) AS BIGINT) AS g FROM v_boxes) a CROSS JOIN (SELECT 0 AS half UNION ALL SELECT 1 AS half) b""",
    "v_logits": "SELECT CAST(floor(vec_id / 13.0) AS BIGINT) AS base, CAST(floor((vec_id % 13) / 4.0) AS BIGINT) AS row_idx, CAST(vec_id % 13 % 4 AS BIGINT) AS chunk_idx, CAST(label AS BIGINT) AS label, list_transform(embedding[1:27], lambda x: CAST(x AS DOUBLE)) AS logits FROM embeddings",
    "v_whole": "SELECT CAST(floor(vec_id / 13.0) AS BIGINT) AS base, 0::BIGINT AS row_idx, CAST(vec_id % 13 AS BIGINT) AS chunk_idx, CAST(label AS BIGINT) AS label, list_transform(embedding[1:27], lambda x: CAST(x AS DOUBLE)) AS logits FROM embeddings",
    "v_chunks1": "SELECT base, row_idx, chunk_idx, substring(text, CAST(chunk_idx * 4 + 1 AS BIGINT), 4) AS t FROM (SELECT base, row_idx, text, unnest(range(0, CAST(ceil(length(text) / 4.0) AS BIGINT))) AS chunk_idx FROM v_rows WHERE length(text) > 0) a",
    "v_chunks2": "SELECT base, row_idx, chunk_idx, CASE WHEN (base + row_idx + chunk_idx) % 97 = 0 THEN concat(t, 'A') ELSE t END AS t FROM v_chunks1 WHERE NOT (base % 11 = 0 AND row_idx = 0)",
    "v_conf": "SELECT base, row_idx, i - 1 AS pos, substring(text, i, 1) AS ch, (ascii(substring(text, i, 1)) + i + base) % 7 <> 0 AS conf FROM (SELECT base, row_idx, text, unnest(range(1, length(text) + 1)) AS i FROM v_rows WHERE length(text) > 0) a",
    "v_views": "SELECT CAST(o_orderkey AS BIGINT) % 4000 AS base, concat('Rotation', CAST(1 + o_custkey % 2 AS VARCHAR)) AS rotation, concat('f', CAST(o_orderkey AS VARCHAR)) AS file_name FROM orders",
}
_USES = {"v_rows": ("v_lines",), "v_preds": ("v_lines", "v_rows"), "v_segments": ("v_boxes",), "v_chunks1": ("v_lines", "v_rows"), "v_chunks2": ("v_lines", "v_rows", "v_chunks1"), "v_conf": ("v_lines", "v_rows")}


def sql(body: str, *names: str, **more: str) -> str:
    """``body`` with the named views, and those they need, in front; ``more`` adds views of its own."""
    wanted = {n for name in names for n in (*_USES.get(name, ()), name)}
    parts = [f"{name} AS ({text})" for name, text in SQL.items() if name in wanted] + [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
