"""Queries of text conversion, names, alphabets, and rows of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import numbering as nu
from . import views as v
from .registry import query

#: Latin letters of the documents as Greek ones, so that the converters have something to convert.
GREEK = ("abcdefghiklmnoprstuvxyzABGDEHIKLMNOPRSTUX", "αβψδεφγηικλμνοπρστυνξυζΑΒΓΔΕΗΙΚΛΜΝΟΠΡΣΤΥΞ")


def _sql_map(column: str, pairs: tuple[str, str]) -> str:
    quoted = [x.replace("'", "''") for x in pairs]
    return f"translate({column}, '{quoted[0]}', '{quoted[1]}')"


def _greek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", F.translate(F.regexp_replace("text", "[^ -~\n]", ""), *GREEK).alias("t"))


_GREEK = f"SELECT doc_id, {_sql_map("regexp_replace(text, '[^ -~' || chr(10) || ']', '', 'g')", GREEK)} AS t FROM documents"


#: The proxies of GREEK's Greek letters under the new and the old map, written out apart from the converters.
_NEW = (GREEK[1], "ABUDEFGHIKLMNOPRSTYNXYZABGDEHIKLMNOPRSTYX")
_OLD = (GREEK[1], "ABCDEFGHIKLMNOPRSTUNXUZABGDEHIKLMNOPRSTUX")


@query(f"SELECT doc_id, upper({_sql_map('t', _NEW)}) AS converted FROM ({_GREEK}) g")
def t1_greek_new_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greek(spark, sf_dir).select("doc_id", tx.convert(F.col("t")).alias("converted"))


@query(f"SELECT doc_id, upper({_sql_map('t', _OLD)}) AS converted FROM ({_GREEK}) g")
def t2_greek_old_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greek(spark, sf_dir).select("doc_id", tx.convert(F.col("t"), True).alias("converted"))


@query("SELECT doc_id, translate(text, 'YCUycu', 'CUYcuy') AS swapped FROM documents")
def t3_latin_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", tx.latin_swap(F.col("text")).alias("swapped"))


@query(f"SELECT use_old, count(*) AS n, sum(length(CASE WHEN use_old THEN a ELSE b END)) AS chars, sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS differing FROM (SELECT upper({_sql_map('t', _OLD)}) AS a, upper({_sql_map('t', _NEW)}) AS b FROM ({_GREEK}) g) c CROSS JOIN (SELECT true AS use_old UNION ALL SELECT false) f GROUP BY use_old")
def t4_convert_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _greek(spark, sf_dir)
    parts = [g.select(F.lit(old).alias("use_old"), F.length(tx.convert(F.col("t"), old)).alias("k"), (tx.convert(F.col("t"), True) != tx.convert(F.col("t"))).cast("int").alias("d")) for old in (True, False)]
    return parts[0].unionByName(parts[1]).groupBy("use_old").agg(F.count("*").alias("n"), F.sum("k").alias("chars"), F.sum("d").alias("differing"))


@query("SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^ -~]', '', 'g')), '[^ABCDEFGHIKLMNOPQRSTUWXYZ&:)]', '', 'g') AS kept FROM documents")
def t5_keep_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", tx.keep_alphabet(F.regexp_replace("text", "[^ -~]", "")).alias("kept"))


#: The patterns of names, as in the text functions.
_SLUG = "coalesce(nullif(substring(trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(url), '^hf://datasets/', ''), '^https://huggingface\\.co/datasets/', ''), '/'), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), 1, 140), ''), 'input')"
_BASE = "coalesce(nullif(substring(trim(regexp_replace(replace(trim(url), '/', '_'), '[^A-Za-z0-9._+:-]+', '_', 'g'), '._-'), 1, 180), ''), 'squeeze')"


@query(f"SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'none') AS safe, {_SLUG} AS slug, {_BASE} AS base FROM pages")
def t6_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return v.table(spark, sf_dir, "pages").select("page_id", tx.safe_name(u).alias("safe"), tx.data_set_slug(u).alias("slug"), tx.safe_base(u).alias("base"))


_NAME = "CASE o_orderkey % 4 WHEN 0 THEN 's' || o_custkey || '_Rotation1_300dpi.png' WHEN 1 THEN 'd/s' || o_custkey || '_Merged_Rotation2_300dpi.png' WHEN 2 THEN 's' || o_custkey || '_Merged.txt' ELSE 'x' || o_custkey END"


@query(
    f"""SELECT o_orderkey, regexp_replace(regexp_replace(s, '_Rotation[12]_300dpi$', ''), '_Merged', '', 'g') AS base, nullif(regexp_extract(s, '_(Rotation[12])_300dpi', 1), '') AS rotation,
substring(name, 1, least(CASE WHEN strpos(name, '_Rotation') > 1 THEN strpos(name, '_Rotation') - 1 ELSE length(name) END, CASE WHEN strpos(name, '_Merged') > 1 THEN strpos(name, '_Merged') - 1 ELSE length(name) END)) AS clipped
FROM (SELECT o_orderkey, name, regexp_replace(regexp_extract(name, '([^/]*)$', 1), '\\.[^.]*$', '') AS s FROM (SELECT o_orderkey, {_NAME} AS name FROM orders) a) b"""
)
def t7_name_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("s"), c, F.lit("_Rotation1_300dpi.png"))).when(k == 1, F.concat(F.lit("d/s"), c, F.lit("_Merged_Rotation2_300dpi.png"))).when(k == 2, F.concat(F.lit("s"), c, F.lit("_Merged.txt"))).otherwise(F.concat(F.lit("x"), c))
    named = v.table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    n = F.col("name")
    return named.select("o_orderkey", tx.base_id(n).alias("base"), tx.rotation(n).alias("rotation"), tx.clip_squeeze(n).alias("clipped"))


@query(f"SELECT doc_id, array_to_string(string_split(translate(upper({_sql_map('t', tx.NEW_MAP)}), ' ' || chr(9), ''), chr(10)), '|') AS rows FROM ({_GREEK}) g")
def t8_transcript_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greek(spark, sf_dir).select("doc_id", F.array_join(tx.normalise(F.col("t")), "|").alias("rows"))


@query(v.sql("SELECT DISTINCT split, ch FROM (SELECT split, unnest(string_split(text, '')) AS ch FROM v_rows WHERE length(text) > 0) a WHERE ch <> ''", "v_rows"))
def t9_alphabet_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rows(spark, sf_dir).where(F.length("text") > 0).select("split", F.explode(F.split("text", "")).alias("ch")).distinct().orderBy("split", "ch")


@query(v.sql("SELECT base, row_idx, text FROM v_rows WHERE split = 'train' AND length(text) > 0 AND base % 5 <> 2", "v_rows"))
def t10_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.folds import keep_folds

    rows = v.rows(spark, sf_dir)
    folds = rows.select("base").distinct().withColumn("fold", F.col("base") % 5)
    return keep_folds(rows.where((F.col("split") == "train") & (F.length("text") > 0)), folds, [2], exclude=True).select("base", "row_idx", "text")


@query(
    v.sql(
        "SELECT split, base, count(*) AS chars, min(chunk_idx) AS first_chunk, max(chunk_idx) AS last_chunk FROM (SELECT split, base, row_idx, i - 1 AS chunk_idx, upper(substring(l, i, 1)) AS ch FROM (SELECT doc_id AS base, CASE doc_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, 0 AS row_idx, l, unnest(range(1, length(l) + 1)) AS i FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS l FROM documents) d) e) x WHERE strpos('ABCDEFGHIKLMNOPQRSTUWXYZ&:)', ch) > 0 GROUP BY split, base"
    )
)
def t11_char_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 == 0, "val").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    letters = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("base"), split.alias("split"), F.posexplode(F.split(F.regexp_replace("text", "[^ -~]", "?"), "")).alias("chunk_idx", "c"))
    kept = letters.where((F.length("c") == 1) & F.lit(tx.ALPHABET).contains(F.upper("c")))
    return kept.groupBy("split", "base").agg(F.count("*").alias("chars"), F.min("chunk_idx").cast("bigint").alias("first_chunk"), F.max("chunk_idx").cast("bigint").alias("last_chunk"))


@query("SELECT (rn - 1) % 8 AS shard, count(*) AS n, min(row_key) AS first_key, sum(rn) AS numbers FROM (SELECT o_orderkey AS row_key, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS rn FROM orders) a GROUP BY 1")
def t12_row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy(F.col("o_custkey") % 5).orderBy("o_orderkey")
    rows = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_key"), F.row_number().over(order).alias("rn"))
    return rows.groupBy(((F.col("rn") - 1) % 8).cast("bigint").alias("shard")).agg(F.count("*").alias("n"), F.min("row_key").alias("first_key"), F.sum("rn").alias("numbers"))


@query("SELECT row_key, rn AS number, (rn - 1) % 8 AS shard, (rn - 1) // 8 < 100 AS within_limit FROM (SELECT o_orderkey AS row_key, row_number() OVER (ORDER BY o_custkey % 5, o_orderkey) AS rn FROM orders) a")
def t12_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("fold"), F.col("o_orderkey").alias("row_key"))
    place = F.col("number") - 1
    return nu.numbered(rows, ["fold", "row_key"]).select("row_key", "number", (place % 8).alias("shard"), (F.floor(place / 8) < 100).alias("within_limit"))


@query("SELECT doc_id, pos, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) a WHERE length(line) > 0 AND length(line) <= 64")
def t13_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = v.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(F.length("line").between(1, 64)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")
