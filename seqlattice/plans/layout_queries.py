"""Queries of box layout, view pairing, and the tables of objects, files and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import folds as fo
from ..operators import layout as ly
from ..operators import evaluate as ev
from ..operators import pairing as pa
from ..operators import scoring as sc
from ..sources import ingest
from . import views as v
from .registry import query

_CORNERS = "SELECT file_id, box_id, cx - w / 2 AS xnw, cy - h / 2 AS ynw, cx - w / 2 AS xsw, cy + h / 2 AS ysw, cx + w / 2 AS xse, cy + h / 2 AS yse, cx + w / 2 AS xne, cy - h / 2 AS yne FROM v_boxes"


@query(v.sql("SELECT file_id, box_id, (xnw + xsw + xse + xne) / 4 AS center_x, (ynw + ysw + yse + yne) / 4 AS center_y, round((sqrt(pow(xnw - xse, 2) + pow(ynw - yse, 2)) + sqrt(pow(xne - xsw, 2) + pow(yne - ysw, 2))) / 4, 6) AS radius, round(sqrt(pow(xne - xnw, 2) + pow(yne - ynw, 2)) * sqrt(pow(xsw - xnw, 2) + pow(ysw - ynw, 2)), 6) AS area, round(atan2(yne - ynw, xne - xnw), 6) AS angle FROM corners", "v_boxes", corners=_CORNERS))
def g1_box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ly.measures(ly.with_corners(v.boxes(spark, sf_dir)))
    return m.select("file_id", "box_id", "center_x", "center_y", *[F.round(c, 6).alias(c) for c in ("radius", "area", "angle")])


@query("SELECT event_id, round(atan2(sin(a), cos(a)), 6) AS angle FROM (SELECT event_id, CAST(value AS DOUBLE) / 7 - 3 AS a FROM events) e")
def g2_angle_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "events").select("event_id", F.round(ly.wrap_angle(F.col("value").cast("double") / 7 - 3), 6).alias("angle"))


_PAIRS = "SELECT a.file_id, a.box_id, b.box_id AS j, sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)) AS d, b.cx - a.cx AS dx, b.cy - a.cy AS dy, (pow(b.w, 2) + pow(b.h, 2)) / 4 AS rr FROM v_boxes a JOIN v_boxes b ON a.file_id = b.file_id AND round((a.cy - 100) / 60) = round((b.cy - 100) / 60) AND a.box_id <> b.box_id"  # an accepted box lies less than its radius of 25 off the line, so in the same grid row
_SIDES = "SELECT *, CASE WHEN dx > 0 THEN 1.0 ELSE -1.0 END AS side FROM pairs"
_NEAR = "SELECT file_id, box_id, side, j FROM (SELECT *, row_number() OVER (PARTITION BY file_id, box_id, side ORDER BY d, j) AS r FROM sides WHERE pow(dx - side * d, 2) + pow(dy, 2) < rr) a WHERE r = 1"


@query(v.sql("SELECT b.file_id, b.box_id, coalesce(l.j, -1) AS left_id, coalesce(r.j, -1) AS right_id FROM v_boxes b LEFT JOIN near l ON l.file_id = b.file_id AND l.box_id = b.box_id AND l.side < 0 LEFT JOIN near r ON r.file_id = b.file_id AND r.box_id = b.box_id AND r.side > 0", "v_boxes", pairs=_PAIRS, sides=_SIDES, near=_NEAR))
def g3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.neighbours(v.boxes(spark, sf_dir)).select("file_id", "box_id", "left_id", "right_id")


def _clusters(spark: SparkSession, sf_dir: str, cut: bool = True) -> DataFrame:
    return ly.row_clusters(ly.neighbours(v.boxes(spark, sf_dir)), cut)


#: On the grid each box is linked with the next ones of its row, and the walk starts at a row's first box.
_GRID_ROWS = "SELECT file_id, CAST(floor(box_id / 20.0) AS BIGINT) AS cluster, box_id % 20 AS step, box_id FROM v_boxes"


@query(v.sql(_GRID_ROWS, "v_boxes"))
def g4_link_repair_first_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, False)


@query(v.sql(_GRID_ROWS, "v_boxes"))
def g5_row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


def _grid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the grid as clusters, numbered from the bottom; a box's step is its place from the right."""
    b = v.boxes(spark, sf_dir)
    cluster = F.floor(F.col("box_id") / 20)
    order = Window.partitionBy("file_id", cluster).orderBy(F.desc("box_id"))
    return b.select("file_id", "box_id", (-cluster).cast("bigint").alias("cluster"), (F.row_number().over(order) - 1).cast("bigint").alias("step"))


_ORDER = "SELECT file_id, box_id, dense_rank() OVER (PARTITION BY file_id ORDER BY seed, cluster) - 1 AS row_idx, row_number() OVER (PARTITION BY file_id, cluster ORDER BY cx, step) - 1 AS pos FROM (SELECT *, min(CASE WHEN step = 0 THEN cy END) OVER (PARTITION BY file_id, cluster) AS seed FROM (SELECT file_id, box_id, cx, cy, -CAST(floor(box_id / 20.0) AS BIGINT) AS cluster, row_number() OVER (PARTITION BY file_id, floor(box_id / 20.0) ORDER BY box_id DESC) - 1 AS step FROM v_boxes) a) b"


@query(v.sql("SELECT file_id, box_id, row_idx, pos FROM ord", "v_boxes", ord=_ORDER))
def g6_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.reading_order(_grid_clusters(spark, sf_dir), v.boxes(spark, sf_dir))


_LINES = "SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY seg_id)::BIGINT AS label FROM (SELECT *, CASE WHEN lag(seg_id) OVER w IS NULL OR (lag(x1) OVER w = x0 AND lag(y1) OVER w = y0) THEN 0 ELSE 1 END AS new FROM v_segments WINDOW w AS (PARTITION BY file_id ORDER BY seg_id)) a"


@query(v.sql("SELECT file_id, seg_id, label FROM polys", "v_segments", polys=_LINES))
def g7_polyline_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.polylines(v.segments(spark, sf_dir)).select("file_id", "seg_id", F.col("label").cast("bigint").alias("label"))


_DIST = "SELECT b.file_id, b.box_id, s.seg_id, s.label, sqrt(pow(b.cx - s.x0 - t * (s.x1 - s.x0), 2) + pow(b.cy - s.y0 - t * (s.y1 - s.y0), 2)) AS d FROM (SELECT b.*, s.seg_id, greatest(least(((b.cx - s.x0) * (s.x1 - s.x0) + (b.cy - s.y0) * (s.y1 - s.y0)) / (pow(s.x1 - s.x0, 2) + pow(s.y1 - s.y0, 2)), 1), 0) AS t FROM v_boxes b JOIN v_segments s ON b.file_id = s.file_id) b JOIN polys s ON b.file_id = s.file_id AND b.seg_id = s.seg_id"
_NEAREST = "SELECT file_id, box_id, label, d FROM (SELECT *, row_number() OVER (PARTITION BY file_id, box_id ORDER BY d, seg_id) AS r FROM dist) a WHERE r = 1"


@query(v.sql("SELECT file_id, box_id, label, round(d, 6) AS distance FROM nearest", "v_segments", polys=_LINES, dist=_DIST, nearest=_NEAREST))
def g8_nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ly.nearest_polyline(v.boxes(spark, sf_dir), ly.polylines(v.segments(spark, sf_dir)))
    return n.select("file_id", "box_id", F.col("label").cast("bigint").alias("label"), F.round("distance", 6).alias("distance"))


@query(v.sql("SELECT file_id, box_id, label, row_number() OVER (PARTITION BY file_id, label ORDER BY (cx - fx) * 30.0, box_id) - 1 AS pos FROM (SELECT n.file_id, n.box_id, n.label, b.cx, first_value(b.cx) OVER (PARTITION BY n.file_id, n.label ORDER BY n.box_id) AS fx FROM nearest n JOIN v_boxes b ON n.file_id = b.file_id AND n.box_id = b.box_id) a", "v_segments", polys=_LINES, dist=_DIST, nearest=_NEAREST))
def g9_polyline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = v.boxes(spark, sf_dir)
    labels = ly.nearest_polyline(boxes, ly.polylines(v.segments(spark, sf_dir)))
    return ly.polyline_order(labels, boxes).select("file_id", "box_id", F.col("label").cast("bigint").alias("label"), "pos")


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter and a flag for each box."""
    alphabet = F.array(*[F.lit(c) for c in "ABCDEFGHIKLMNOPQRSTUWXYZ&:)"])
    b = v.boxes(spark, sf_dir)
    return b.select("file_id", "box_id", F.floor(F.col("box_id") / 20).alias("row_idx"), F.get(alphabet, ((F.col("file_id") + F.col("box_id") * 7) % 27).cast("int")).alias("ch"), ((F.col("file_id") + F.col("box_id")) % 6 != 0).alias("conf"))


_LETTERS = "SELECT file_id, box_id, substring('ABCDEFGHIKLMNOPQRSTUWXYZ&:)', CAST((file_id + box_id * 7) % 27 + 1 AS BIGINT), 1) AS ch, (file_id + box_id) % 6 <> 0 AS conf FROM v_boxes"


@query(v.sql("SELECT file_id, string_agg(t, chr(10) ORDER BY row_idx) AS text FROM (SELECT o.file_id, o.row_idx, string_agg(l.ch, '' ORDER BY o.pos) AS t FROM ord o JOIN letters l ON o.file_id = l.file_id AND o.box_id = l.box_id WHERE l.conf GROUP BY o.file_id, o.row_idx) a GROUP BY file_id", "v_boxes", ord=_ORDER, letters=_LETTERS))
def g10_row_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ly.reading_order(_grid_clusters(spark, sf_dir), v.boxes(spark, sf_dir))
    return ly.row_transcripts(order, _letters(spark, sf_dir), only_confident=True)


@query(v.sql("SELECT base, line, count(*) AS n, count(*) FILTER (WHERE conf) AS confident FROM (SELECT base, pos // 1000000 AS line, pos, bool_or(conf) AS conf FROM (SELECT base, row_idx * 1000000 + pos AS pos, conf FROM v_conf UNION ALL SELECT base, row_idx * 1000000 + pos, NOT conf AND pos % 2 = 0 FROM v_conf WHERE base % 9 <> 4) a WHERE base % 9 <> 4 GROUP BY base, pos) b GROUP BY base, line", "v_conf"))
def g11_confidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.confidence_rows(spark, sf_dir)
    one = c.select("base", F.lit(1).alias("file_id"), "row_idx", "flags")
    two = c.where("base % 9 <> 4").select("base", F.lit(2).alias("file_id"), "row_idx", F.transform("flags", lambda f, pos: ~f & (pos % 2 == 0)).alias("flags"))
    union = ly.confidence_union_rows(one.unionByName(two))
    return union.select("base", F.col("row_idx").alias("line"), F.size("flags").cast("bigint").alias("n"), F.size(F.filter("flags", lambda f: f)).cast("bigint").alias("confident"))


@query(v.sql("SELECT count(DISTINCT base) AS files, count(*) AS boxes, count(*) FILTER (WHERE NOT conf) AS obscured FROM v_conf", "v_conf"))
def g12_confidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.confidence_coverage(v.confidence(spark, sf_dir).withColumnRenamed("base", "file_id"))


def _odd_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the grid; in every third file the first box of a row skips the second, which has none."""
    odd, step = F.col("file_id") % 3 == 0, F.col("box_id") % 20
    links = ly.neighbours(v.boxes(spark, sf_dir))
    right = F.when(odd & (step == 0), F.col("box_id") + 2).when(odd & (step == 1), -1).otherwise(F.col("right_id"))
    return links.select("file_id", "box_id", F.when(odd & (step == 1), -1).otherwise(F.col("left_id")).alias("left_id"), right.alias("right_id"))


@query(v.sql("SELECT DISTINCT file_id FROM v_boxes WHERE file_id % 3 = 0 AND box_id % 20 = 2", "v_boxes"))
def g13_grouping_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, boxes = _odd_links(spark, sf_dir), v.boxes(spark, sf_dir)
    return ly.differing_files(*[ly.reading_order(ly.row_clusters(links, cut), boxes) for cut in (True, False)])


_TILE = "SELECT base, row_idx, i, n, CAST(ceil(n / 8.0) AS BIGINT) AS q FROM (SELECT base, row_idx, length(text) AS n, unnest(range(0, length(text))) AS i FROM v_rows WHERE length(text) > 0) a"


@query(v.sql("SELECT base, row_idx, chunk, min(i) AS first, max(i) AS last FROM (SELECT base, row_idx, i, CAST(CASE WHEN i < (n % q) * (n // q + 1) THEN i // (n // q + 1) ELSE n % q + (i - (n % q) * (n // q + 1)) // (n // q) END AS BIGINT) AS chunk FROM tiles) a GROUP BY base, row_idx, chunk", "v_rows", tiles=_TILE))
def g14_balanced_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.rows(spark, sf_dir).where("length(text) > 0").withColumn("n", F.length("text"))
    items = rows.select("base", "row_idx", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return items.groupBy("base", "row_idx", ly.tile(F.col("i"), F.col("n"), 8).alias("chunk")).agg(F.min("i").cast("bigint").alias("first"), F.max("i").cast("bigint").alias("last"))


@query(v.sql("SELECT file_id, chunk, x0, y0, x1, y1 FROM (SELECT file_id, chunk, greatest(CAST(trunc(a) AS BIGINT) - 8, 0) AS x0, greatest(CAST(trunc(b) AS BIGINT) - 8, 0) AS y0, least(CAST(trunc(c) AS BIGINT) + 8, 900) AS x1, least(CAST(trunc(d) AS BIGINT) + 8, 700) AS y1 FROM (SELECT file_id, CAST(floor(box_id / 5.0) AS BIGINT) AS chunk, min(xnw) AS a, min(ynw) AS b, max(xse) AS c, max(yse) AS d FROM corners GROUP BY 1, 2) e) f WHERE x1 - x0 >= 8 AND y1 - y0 >= 8", "v_boxes", corners=_CORNERS))
def g15_chunk_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ly.with_corners(v.boxes(spark, sf_dir)).withColumn("chunk", F.floor(F.col("box_id") / 5))
    return ly.chunk_boxes(c, ["file_id", "chunk"], F.lit(900), F.lit(700))


_SKEW = "SELECT *, CASE WHEN file_id % 3 = 0 THEN NULL ELSE (file_id % 7) / 50.0 END AS a FROM corners"


@query(v.sql("SELECT file_id, box_id, round(CASE WHEN a IS NULL OR degrees(a) < 0.3 THEN xnw ELSE cos(a) * (xnw - 500) + sin(a) * (ynw - 400) + floor(800 * sin(a) + 1000 * cos(a)) / 2 END, 6) AS xnw, round(CASE WHEN a IS NULL OR degrees(a) < 0.3 THEN yse ELSE -sin(a) * (xse - 500) + cos(a) * (yse - 400) + floor(800 * cos(a) + 1000 * sin(a)) / 2 END, 6) AS yse FROM skew", "v_boxes", corners=_CORNERS, skew=_SKEW))
def g16_deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ly.with_corners(v.boxes(spark, sf_dir))
    angle = F.when(F.col("file_id") % 3 == 0, None).otherwise((F.col("file_id") % 7) / 50.0)
    return ly.deskew(c.withColumn("a", angle), F.col("a"), F.lit(1000.0), F.lit(800.0)).select("file_id", "box_id", F.round("xnw", 6).alias("xnw"), F.round("yse", 6).alias("yse"))


_CHUNKS = "SELECT file_id, g, i, n, xnw, ynw, xse, yse, ch, CAST(CASE WHEN i < (n % q) * (n // q + 1) THEN i // (n // q + 1) ELSE n % q + (i - (n % q) * (n // q + 1)) // (n // q) END AS BIGINT) AS chunk_idx FROM (SELECT *, CAST(ceil(n / 8.0) AS BIGINT) AS q FROM (SELECT c.file_id, c.box_id // 20 AS g, c.box_id % 20 AS i, count(*) OVER (PARTITION BY c.file_id, c.box_id // 20) AS n, c.xnw, c.ynw, c.xse, c.yse, l.ch FROM corners c JOIN letters l ON c.file_id = l.file_id AND c.box_id = l.box_id) a) b"


@query(v.sql("SELECT file_id, g AS row_idx, chunk_idx, string_agg(ch, '' ORDER BY i) AS text, greatest(CAST(trunc(min(xnw)) AS BIGINT) - 8, 0) AS x0, greatest(CAST(trunc(min(ynw)) AS BIGINT) - 8, 0) AS y0, least(CAST(trunc(max(xse)) AS BIGINT) + 8, 1000) AS x1, least(CAST(trunc(max(yse)) AS BIGINT) + 8, 900) AS y1 FROM parts GROUP BY file_id, g, chunk_idx", "v_boxes", corners=_CORNERS, letters=_LETTERS, parts=_CHUNKS))
def g17_chunk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = v.boxes(spark, sf_dir)
    order = ly.reading_order(_clusters(spark, sf_dir), boxes)
    return ly.assemble(order, boxes, _letters(spark, sf_dir), F.lit(1000), F.lit(900))


@query(v.sql("SELECT file_id, box_id, row_number() OVER (PARTITION BY file_id ORDER BY row_idx, pos, box_id) - 1 AS n FROM ord", "v_boxes", ord=_ORDER))
def g18_flat_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.flat_order(ly.reading_order(_grid_clusters(spark, sf_dir), v.boxes(spark, sf_dir)))


# --- pairing

_COUNTS = "SELECT coalesce(a.base, b.base) AS base, coalesce(a.n = b.n, false) AS same FROM (SELECT base, count(DISTINCT row_idx) AS n FROM v_chunks1 GROUP BY base) a FULL JOIN (SELECT base, count(DISTINCT row_idx) AS n FROM v_chunks2 GROUP BY base) b ON a.base = b.base"
_BOTH = "SELECT coalesce(a.base, b.base) AS base, coalesce(a.row_idx, b.row_idx) AS row_idx, coalesce(a.chunk_idx, b.chunk_idx) AS chunk_idx, a.t AS t1, b.t AS t2, coalesce(a.t = b.t, false) AS eq FROM v_chunks1 a FULL JOIN v_chunks2 b ON a.base = b.base AND a.row_idx = b.row_idx AND a.chunk_idx = b.chunk_idx"
_FLAGS = "SELECT b.*, c.same, c.same AND bool_and(eq) OVER (PARTITION BY b.base, b.row_idx) AS dual, count(t1) OVER (PARTITION BY b.base, b.row_idx) = count(t2) OVER (PARTITION BY b.base, b.row_idx) AS as_many FROM both_ b JOIN counts c ON b.base = c.base"


def _pair_sql(body: str) -> str:
    return v.sql(body, "v_chunks2", counts=_COUNTS, both_=_BOTH, flags=_FLAGS)


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return v.chunks(spark, sf_dir), v.chunks2(spark, sf_dir)


def _long_chunk(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


@query(_pair_sql("SELECT base, row_idx, chunk_idx, t1 AS t, dual FROM flags WHERE t1 IS NOT NULL"))
def p1_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_chunk(pa.pair_rows(*_two(spark, sf_dir)))


@query(_pair_sql("SELECT base, row_idx, chunk_idx, same AND as_many AND eq AS aligned FROM flags WHERE t1 IS NOT NULL"))
def p2_chunk_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_chunk(pa.chunk_aligned(*_two(spark, sf_dir)))


@query(_pair_sql("SELECT count(DISTINCT base) AS objects, count(*) AS rows, count(*) FILTER (WHERE d) AS dual_rows, sum(n)::BIGINT AS chunks, sum(CASE WHEN d THEN n ELSE 0 END)::BIGINT AS dual_chunks, round(count(*) FILTER (WHERE d) / greatest(count(*), 1)::DOUBLE, 6) AS row_rate, round(sum(CASE WHEN d THEN n ELSE 0 END) / greatest(sum(n), 1)::DOUBLE, 6) AS chunk_rate FROM (SELECT base, row_idx, bool_and(dual) AS d, count(*) AS n FROM flags WHERE t1 IS NOT NULL GROUP BY base, row_idx) a"))
def p3_pairing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pa.pairing_statistics(*_two(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("row_rate", "chunk_rate")})


@query(_pair_sql("SELECT base, row_idx, chunk_idx, t1 AS t, CASE WHEN dual THEN 'pair' ELSE 'rot1' END AS kind FROM flags WHERE t1 IS NOT NULL UNION ALL SELECT base, row_idx, chunk_idx, t2, 'rot2' FROM flags WHERE NOT dual AND t2 IS NOT NULL"))
def p4_training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_chunk(pa.training_pairs(*_two(spark, sf_dir)))


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of 32 values from 0 to 255 for each embedding."""
    e = v.table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: F.floor(F.pmod(x.cast("double") * 400, F.lit(256.0))).cast("double"))
    return e.select("vec_id", scaled.alias("s")).select("vec_id", F.slice("s", 1, 32).alias("a"), F.slice("s", 33, 32).alias("b"))


_CH = "SELECT vec_id, i, floor((((CAST(embedding[i] AS DOUBLE) * 400) % 256) + 256) % 256) AS a, floor((((CAST(embedding[i + 32] AS DOUBLE) * 400) % 256) + 256) % 256) AS b FROM (SELECT vec_id, embedding, unnest(range(1, 33)) AS i FROM embeddings) e"


@query(v.sql("SELECT vec_id, i - 1 AS i, least(a, b) AS lo, greatest(a, b) AS hi, (a + b) / 2 AS mid, least(greatest(128 + (a - b) / 2, 0), 255) AS diff FROM ch", ch=_CH))
def p5_array_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _channels(spark, sf_dir)
    fused = {n: pa.fuse(F.col("a"), F.col("b"), m) for n, m in (("lo", "min"), ("hi", "max"), ("mid", "mean"), ("diff", "diff"))}
    z = c.select("vec_id", F.arrays_zip(*[x.alias(n) for n, x in fused.items()]).alias("z"))
    return z.select("vec_id", F.posexplode("z").alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), "x.lo", "x.hi", "x.mid", "x.diff")


_NORM = "SELECT vec_id, quantile_cont(abs(a - b), 0.95) AS d, quantile_cont(a, 0.02) AS a2, quantile_cont(a, 0.98) AS a98, quantile_cont(b, 0.02) AS b2, quantile_cont(b, 0.98) AS b98 FROM ch GROUP BY vec_id"


@query(v.sql("SELECT c.vec_id, i - 1 AS i, round(least(greatest(128 + 64 * least(greatest((a - b) / CASE WHEN d = 0 THEN 1 ELSE d END, -2), 2), 0), 255), 4) AS diffnorm, round(least(least(greatest((a - a2) * (255.0 / (a98 - a2)), 0), 255), least(greatest((b - b2) * (255.0 / (b98 - b2)), 0), 255)), 4) AS robustmin FROM ch c JOIN norm n ON c.vec_id = n.vec_id", ch=_CH, norm=_NORM))
def p5_array_fusion_normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pa.fuse_normed(_channels(spark, sf_dir), ["vec_id"])
    z = f.select("vec_id", F.posexplode(F.arrays_zip("diffnorm", "robustmin")).alias("i", "x"))
    return z.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x.diffnorm", 4).alias("diffnorm"), F.round("x.robustmin", 4).alias("robustmin"))


# --- objects, files, shards


@query(v.sql("SELECT a.base, a.p AS ann_path, b.r1 AS rot1_img, b.r2 AS rot2_img FROM (SELECT base, min(file_name) AS p FROM v_views WHERE rotation = 'Rotation1' GROUP BY base) a JOIN (SELECT base, min(CASE WHEN rotation = 'Rotation1' THEN file_name END) AS r1, min(CASE WHEN rotation = 'Rotation2' THEN file_name END) AS r2 FROM v_views WHERE base % 13 <> 5 GROUP BY base) b ON a.base = b.base", "v_views"))
def s4_object_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = v.views(spark, sf_dir).withColumnRenamed("file_name", "path")
    return ingest.object_index(views, views.where("base % 13 <> 5"))


@query(v.sql("SELECT o.base, l.split FROM (SELECT DISTINCT base FROM v_views) o LEFT JOIN (SELECT base, CASE max(r) WHEN 3 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM (SELECT base, CASE WHEN rotation = 'Rotation1' AND base % 7 = 1 THEN 3 WHEN rotation = 'Rotation2' AND base % 5 = 2 THEN 2 ELSE 1 END AS r FROM v_views WHERE base % 17 <> 3) a GROUP BY base) l ON o.base = l.base", "v_views"))
def s5_split_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = v.views(spark, sf_dir)
    split = F.when((F.col("rotation") == "Rotation1") & (F.col("base") % 7 == 1), "test").when((F.col("rotation") == "Rotation2") & (F.col("base") % 5 == 2), "val").otherwise("train")
    return fo.attach_split(views.select("base").distinct(), views.where("base % 17 <> 3").select("base", split.alias("split")))


@query(v.sql("SELECT DISTINCT base FROM v_views WHERE base % 17 = 3", "v_views"))
def s5_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = v.views(spark, sf_dir)
    return fo.unassigned(views.select("base").distinct(), views.where("base % 17 <> 3").select("base"))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY base, rotation ORDER BY file_name) AS r FROM v_views"
_PICKS = "SELECT base, max(CASE WHEN rotation = 'Rotation1' AND r = 1 THEN file_name END) AS a1, max(CASE WHEN rotation = 'Rotation1' AND r = 2 THEN file_name END) AS a2, max(CASE WHEN rotation = 'Rotation2' AND r = 1 THEN file_name END) AS b1, max(CASE WHEN rotation = 'Rotation2' AND r = 2 THEN file_name END) AS b2 FROM ranked GROUP BY base"
_SLOTS = "SELECT base, 1 AS slot, coalesce(a1, b1) AS file_name FROM picks UNION ALL SELECT base, 2, CASE WHEN a1 IS NOT NULL THEN coalesce(b1, a2, a1) ELSE coalesce(b2, b1) END FROM picks"


@query(v.sql("SELECT s.base, CAST(s.slot AS BIGINT) AS slot, s.file_name, v.rotation FROM slots s JOIN v_views v ON s.base = v.base AND s.file_name = v.file_name", "v_views", ranked=_RANKED, picks=_PICKS, slots=_SLOTS))
def s6_canonical_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.canonical_views(v.views(spark, sf_dir))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.confidence(spark, sf_dir)
    split = F.when(F.col("base") % 10 == 0, "val").when(F.col("base") % 10 == 1, "test").otherwise("train")
    return c.select(split.alias("split"), "base", F.lit(None).cast("string").alias("rot1_img"), F.lit(None).cast("string").alias("rot2_img"), F.col("row_idx").cast("int").alias("row_idx"), F.col("pos").cast("int").alias("chunk_idx"), F.col("ch").alias("row_text"), F.when(F.col("pos") % 11 == 3, "J").otherwise(F.col("ch")).alias("label"), F.col("conf").alias("chunk_aligned"), F.col("base").cast("int").alias("base_pos"))


@query(v.sql("SELECT base, row_idx, pos AS chunk_idx, ch AS label FROM v_conf WHERE base % 10 = 1 AND pos % 11 <> 3 AND base % 3 <> 0", "v_conf"))
def s7_example_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir)
    exclude = e.where("base % 3 = 0").select("base").distinct()
    out = ingest.filter_examples(e, "test", exclude=exclude)
    return out.select("base", F.col("row_idx").cast("bigint").alias("row_idx"), F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "label")


@query(v.sql("SELECT 'rows' AS check, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS n_bad FROM v_logits UNION ALL SELECT 'width', count(*) FILTER (WHERE len(logits) <> 27) FROM v_logits UNION ALL SELECT 'label', count(*) FILTER (WHERE label * 4 NOT BETWEEN 0 AND 26) FROM v_logits UNION ALL SELECT 'keys', count(*) FILTER (WHERE base IS NULL) FROM v_logits", "v_logits"))
def s9_logits_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.logits_checks(v.logits(spark, sf_dir).withColumn("label", F.col("label") * 4))


@query("SELECT 16 AS n_shards, 16 - count(DISTINCT id) AS n_missing, count(*) - count(DISTINCT id) AS n_duplicate, 1 AS n_counts, count(*) FILTER (WHERE n <> e) AS n_row_mismatch FROM (SELECT l_suppkey % 15 AS id, count(*) AS n, count(*) - CASE WHEN l_suppkey % 15 = 4 THEN 1 ELSE 0 END AS e FROM lineitem GROUP BY l_suppkey % 15) a")
def s10_shard_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 15).cast("bigint").alias("shard_id")).agg(F.count("*").alias("n_rows"))
    shards = s.withColumn("n_shards", F.lit(16).cast("bigint")).withColumn("expected_rows", F.col("n_rows") - F.when(F.col("shard_id") == 4, 1).otherwise(0))
    return ingest.shard_check(shards)


@query("SELECT field, expected, found FROM (SELECT 'rows' AS field, '0' AS expected, CAST(count(*) AS VARCHAR) AS found FROM lineitem UNION ALL SELECT 'order', '12', '12' UNION ALL SELECT 'beam', '256', NULL) a WHERE expected IS DISTINCT FROM found")
def s11_manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = v.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows")).withColumn("order", F.lit(12))
    return ingest.manifest_mismatches(manifest, {"rows": 0, "order": 12, "beam": 256})


def _letter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.letter_texts(ly.with_corners(v.boxes(spark, sf_dir)), _letters(spark, sf_dir), v.segments(spark, sf_dir))


_FILE = "'s' || CAST(file_id AS VARCHAR) || '_Rotation1_300dpi_letters.txt'"


@query(v.sql(f"SELECT {_FILE} AS file, box_id, xnw, ynw, xse, yse FROM corners", "v_boxes", corners=_CORNERS))
def s1_letter_file_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.letter_tables(_letter_files(spark, sf_dir))["boxes"].select("file", "box_id", "xnw", "ynw", "xse", "yse")


@query(v.sql(f"SELECT {_FILE} AS file, box_id, conf FROM letters", "v_boxes", letters=_LETTERS))
def s1_letter_file_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.letter_tables(_letter_files(spark, sf_dir))["confidence"]


@query(v.sql(f"SELECT {_FILE} AS file, CAST(floor(box_id / 20.0) AS BIGINT) AS line_no, string_agg(ch, '' ORDER BY box_id) AS text FROM letters GROUP BY 1, 2", "v_boxes", letters=_LETTERS))
def s1_letter_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.letter_tables(_letter_files(spark, sf_dir))["transcript_lines"]


@query(v.sql(f"SELECT {_FILE} AS file, seg_id, x0, y0, x1, y1 FROM v_segments", "v_segments"))
def s1_letter_file_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.letter_tables(_letter_files(spark, sf_dir))["segments"]


@query(v.sql(f"SELECT {_FILE} AS file, row_number() OVER (PARTITION BY file_id ORDER BY box_id) - 1 AS box_id, xnw, ynw, xse, yse FROM (SELECT c.* FROM corners c JOIN letters l ON c.file_id = l.file_id AND c.box_id = l.box_id WHERE l.conf) a", "v_boxes", corners=_CORNERS, letters=_LETTERS))
def s1_confident_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.confident_tables(ingest.letter_tables(_letter_files(spark, sf_dir)))["boxes"].select("file", "box_id", "xnw", "ynw", "xse", "yse")


@query(v.sql(f"SELECT {_FILE} AS file, CAST(floor(box_id / 20.0) AS BIGINT) AS line_no, coalesce(string_agg(CASE WHEN conf THEN ch END, '' ORDER BY box_id), '') AS text FROM letters GROUP BY 1, 2", "v_boxes", letters=_LETTERS))
def s1_confident_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.confident_tables(ingest.letter_tables(_letter_files(spark, sf_dir)))["transcript_lines"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    s = lambda c: F.col(c).cast("string")
    o = v.table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("s"), s("o_orderkey"), F.when(k == 1, "_Rotation3_300dpi.png").otherwise("_Rotation2_300dpi.png")).alias("file_name"),
        F.lit(None).cast("string").alias("image"),
        F.when(k == 2, "Rotation1").alias("rotation"),
        F.when(k == 3, F.concat(F.lit("q"), s("o_custkey"))).alias("squeeze_id"),
        F.when(k <= 3, F.concat(F.lit("b"), s("o_custkey"))).alias("base_id"),
        F.when(k == 4, F.concat(F.lit("c"), s("o_custkey"))).alias("source_base_id"),
        F.when(k == 5, F.concat(F.lit("ann/a"), s("o_orderkey"), F.lit(".txt"))).alias("annotation_file"),
        F.when(k == 3, F.lit("inline\r\ntext")).alias("raw_annotation"),
    )


_RECORDS = "SELECT o_orderkey, o_orderkey % 6 AS k, CASE WHEN o_orderkey % 6 = 3 THEN 'q' || o_custkey WHEN o_orderkey % 6 <= 3 THEN 'b' || o_custkey WHEN o_orderkey % 6 = 4 THEN 'c' || o_custkey ELSE 's' || o_orderkey END AS base, CASE WHEN o_orderkey % 6 = 2 THEN 'Rotation1' ELSE 'Rotation2' END AS rotation, 's' || o_orderkey || '_Rotation2_300dpi.png' AS file_name FROM orders WHERE o_orderkey % 6 <> 1"


@query(v.sql("SELECT base, rotation, file_name FROM recs", recs=_RECORDS))
def s2_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.resolve_metadata(_records(spark, sf_dir))[0].select("base", "rotation", "file_name")


_IMAGES = "SELECT 'Rotation1/s' || o_orderkey || '_Rotation1_300dpi.png' AS name, o_orderkey AS k FROM orders"
_PLACES = "SELECT 'set/meta/' || name AS path FROM images WHERE k % 5 = 0 UNION ALL SELECT 'set/' || name FROM images WHERE k % 3 = 0 UNION ALL SELECT 'set/data/' || name FROM images WHERE k % 7 <> 1"


@query(v.sql("SELECT name AS file_name, CASE WHEN k % 5 = 0 THEN 'set/meta/' || name WHEN k % 3 = 0 THEN 'set/' || name WHEN k % 7 <> 1 THEN 'set/data/' || name END AS image_path FROM images", images=_IMAGES))
def s2_image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    images = v.table(spark, sf_dir, "orders").select(key, F.concat(F.lit("Rotation1/s"), key.cast("string"), F.lit("_Rotation1_300dpi.png")).alias("image"))
    places = [("set/meta/", key % 5 == 0), ("set/", key % 3 == 0), ("set/data/", key % 7 != 1)]
    listing = images.select(F.explode(F.array_compact(F.array(*[F.when(there, F.concat(F.lit(p), "image")) for p, there in places]))).alias("path"))
    blank = [F.lit(None).cast("string").alias(f.name) for f in ingest.METADATA if f.name not in ("file_name", "image")]
    records = ingest.resolve_metadata(images.select(F.when(key % 2 == 0, F.col("image")).otherwise("").alias("file_name"), "image", *blank))[0]
    found, missing = ingest.resolve_images(records, listing, "set/meta", "set")
    return found.select("file_name", "image_path").unionByName(missing.select("file_name", F.lit(None).cast("string").alias("image_path")))


@query(v.sql("SELECT base, rotation, file_name, CASE k WHEN 3 THEN 'inline' || chr(10) || 'text' WHEN 5 THEN 'named' ELSE 'stem' END AS annotation FROM recs WHERE k IN (3, 5) OR (k = 4 AND o_orderkey % 4 = 0)", recs=_RECORDS))
def s3_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    named = o.where("o_orderkey % 6 = 5").select(F.concat(F.lit("a"), key, F.lit(".txt")).alias("file"), F.lit("named").alias("value"))
    stems = o.where("o_orderkey % 6 = 4 AND o_orderkey % 4 = 0").select(F.concat(F.lit("s"), key, F.lit("_Rotation2_300dpi_letters.txt")).alias("file"), F.lit("stem").alias("value"))
    return ingest.resolve_annotations(ingest.resolve_metadata(_records(spark, sf_dir))[0], named.unionByName(stems))[0]


@query()
def e10_score_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .selector_queries import _whole_objects

    m = ev.micro(ev.object_scores(*_whole_objects(spark, sf_dir)), ev.SCORES)
    c = ly.confidence_coverage(v.confidence(spark, sf_dir).withColumnRenamed("base", "file_id"))
    g = g13_grouping_agreement(spark, sf_dir).agg(F.count("*").alias("files_grouped_differently"))
    return ev.score_card(m, c, g)


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Letter files of both views of every object, the flags differing, every other object with segments; and transcripts."""
    boxes, letters = ly.with_corners(v.boxes(spark, sf_dir)), _letters(spark, sf_dir)
    segments = v.segments(spark, sf_dir).where("file_id % 2 = 0")
    one = ingest.letter_texts(boxes, letters, segments, view=1)
    two = ingest.letter_texts(boxes, letters.withColumn("conf", F.col("box_id") % 5 == 0), segments, view=2)
    read = letters.where("file_id % 7 <> 3").withColumn("ch", F.translate(F.col("ch"), "OSIW", "QZL"))
    rows = read.groupBy("file_id", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "ch"))), lambda x: x["ch"]), "").alias("pred"))
    # row by row as they are read: a last row of which nothing is left still has its line break
    texts = ev.joined_rows(rows.withColumnRenamed("file_id", "base"), "pred", ["base"])
    name = F.concat(F.lit("s"), F.col("base").cast("string"))
    return one.unionByName(two), texts.select(F.when(F.col("base") % 3 == 0, F.concat(name, F.lit("_Rotation2_300dpi"))).otherwise(name).alias("base"), "text")


_RUN_ROWS = "SELECT file_id, CAST(floor(box_id / 20.0) AS BIGINT) AS row_idx, string_agg(ch, '' ORDER BY box_id) AS t, string_agg(ch, '' ORDER BY box_id) FILTER (WHERE conf OR box_id % 5 = 0) AS c, string_agg(translate(ch, 'OSIW', 'QZL'), '' ORDER BY box_id) AS p FROM letters GROUP BY 1, 2"
_RUN = "SELECT r.file_id, k AS view, string_agg(t, chr(10) ORDER BY row_idx) AS truth, coalesce(string_agg(c, chr(10) ORDER BY row_idx) FILTER (WHERE c <> ''), '') AS sure, CASE WHEN r.file_id % 7 = 3 OR r.file_id % 3 = 0 AND k = 1 THEN '' ELSE string_agg(p, chr(10) ORDER BY row_idx) END AS pred FROM rr r CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) x GROUP BY r.file_id, k"
_RUN_SCORES = "SELECT 's' || CAST(file_id AS VARCHAR) || '_Rotation' || CAST(view AS VARCHAR) || '_300dpi_letters.txt' AS file_id, levenshtein(pred, sure) AS n_err, length(sure) AS n_char, levenshtein(pred, truth) AS n_all_err, length(truth) AS n_all_char FROM run_pairs"


@query(v.sql(_RUN_SCORES, "v_boxes", letters=_LETTERS, rr=_RUN_ROWS, run_pairs=_RUN))
def e8_run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.run_scores(*_run(spark, sf_dir)).select("file_id", "n_err", "n_char", "n_all_err", "n_all_char")


@query()
def e10_run_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = sc.score_run(*_run(spark, sf_dir))
    return card.select(*[F.round(c, 6).alias(c) if c in ev.SCORES else F.col(c) for c in card.columns])


_RUN_TOTALS = f"""SELECT count(*) AS scored_files, round(sum(n_err) / sum(n_char)::DOUBLE, 6) AS cer, round(sum(n_all_err) / sum(n_all_char)::DOUBLE, 6) AS all_cer, sum(n_err)::BIGINT AS n_err, sum(n_char)::BIGINT AS n_char, sum(n_all_err)::BIGINT AS n_all_err, sum(n_all_char)::BIGINT AS n_all_char,
(SELECT 2 * count(DISTINCT file_id) FROM letters) AS files, (SELECT 2 * count(DISTINCT file_id) FROM letters) AS files_with_section, (SELECT 2 * count(*) FROM letters) AS boxes, (SELECT count(*) FILTER (WHERE NOT conf) + count(*) FILTER (WHERE box_id % 5 <> 0) FROM letters) AS obscured, 0::BIGINT AS files_grouped_differently
FROM ({_RUN_SCORES}) scores"""


@query(v.sql(_RUN_TOTALS, "v_boxes", letters=_LETTERS, rr=_RUN_ROWS, run_pairs=_RUN))
def e10_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run card but for the masked score, which SQL can't state."""
    card = sc.score_run(*_run(spark, sf_dir)).drop("opt_cer", "n_opt_err", "n_opt_char")
    return card.select(*[F.round(c, 6).alias(c) if c in ev.SCORES else F.col(c) for c in card.columns])
