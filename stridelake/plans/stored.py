"""Files written from the driver's tables and read back: archives of motions, and a bundle with its manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators.scratch import Scratch
from stridelake.plans.bodies import FRAME, SEQ
from stridelake.plans.catalogue import R, query, table
from stridelake.sources import files


@query(f"""WITH e AS (SELECT {SEQ} AS seq, {FRAME} AS frame, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT seq, unnest(list_transform(range(61), lambda i: abs(x[i + 1] - b[i + 1]))) AS d FROM (SELECT seq, x, lag(x) OVER (PARTITION BY seq ORDER BY frame) AS b FROM e) WHERE b IS NOT NULL),
m AS (SELECT seq, avg(d) AS d FROM d GROUP BY 1), g AS (SELECT seq, count(*) AS n, max(list_max(list_transform(x[1:61], lambda v: abs(v)))) AS pose, max(list_max(list_transform(x[62:64], lambda v: abs(v)))) AS trans, sum(x[1]) AS s, sum(x[64] * (frame + 1)) AS t FROM e GROUP BY 1)
SELECT seq::VARCHAR AS name, n AS n_frames, 61 AS pose_width, 3 AS trans_width, round(pose, 6) AS pose_max, round(trans, 6) AS trans_max, round(coalesce(d, 0), 6) AS motion_mean, TRUE AS lengths_match, 'fps' AS missing, n AS read_frames, round(s, 6) AS first_sum, round(t, 6) AS last_sum, FALSE AS broken
FROM g LEFT JOIN m USING (seq) UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', NULL, NULL, NULL, TRUE""")
def q106_archives(spark, sf_dir):
    """An archive for each motion, and one file that is none; headers, identities and frames as they are read."""
    scratch = Scratch(spark, "archives")
    root = scratch.path("npz")
    x = F.col("embedding").cast("array<double>")
    e = table(spark, sf_dir, "embeddings").select(F.expr(SEQ).alias("seq"), F.expr(FRAME).alias("frame"), F.slice(x, 1, 61).alias("poses"), F.slice(x, 62, 3).alias("trans"))
    scratch.keep(files.write_archives(e, "seq", "frame", ["poses", "trans"], root), "written")
    files.write_lines(spark.createDataFrame([("no archive",)], "line string").coalesce(1), "line", f"{root}/text")
    found = files.discover(spark, root, "*.npz", content=True).unionByName(files.discover(spark, f"{root}/text", "part-*", content=True))
    heads = files.read_archives(found)
    names = files.base_records(files.discover(spark, root, "*.npz"), root).select("path", "name")
    frames = files.archive_frames(found.where("path like '%.npz'")).groupBy("path").agg(F.count("*").alias("read_frames"), R(F.sum(F.get("pose", F.lit(0)))).alias("first_sum"), R(F.sum(F.get("trans", F.lit(2)) * (F.col("frame_id") + 1))).alias("last_sum"))
    both = heads.join(names, "path", "left").join(frames, "path", "left")
    return both.select(F.coalesce("name", F.lit("broken")).alias("name"), "n_frames", "pose_width", "trans_width", R("pose_abs_max").alias("pose_max"), R("trans_abs_max").alias("trans_max"), R("motion_mean").alias("motion_mean"), "lengths_match", F.array_join("missing", ",").alias("missing"), "read_frames", "first_sum", "last_sum", F.col("error").isNotNull().alias("broken"))


@query(r"""SELECT p_partkey AS motion_id, 'a "' || p_name || '", b' AS said, p_size, '["' || lower(p_type) || '",null]' AS tags, '{"a":' || p_size || ',"z":' || p_partkey || '}' AS counts, p_partkey % 4 = 0 AS listed, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS note FROM part""")
def q107_bundle(spark, sf_dir):
    """A bundle's table with nested columns as CSV, its rows as JSON lines and a list of names, joined as they are read back."""
    scratch = Scratch(spark, "bundle")
    root = scratch.path("bundle")
    p = table(spark, sf_dir, "part")
    rows = p.select(
        F.col("p_partkey").alias("motion_id"), F.concat(F.lit('a "'), "p_name", F.lit('", b')).alias("said"), "p_size", F.array(F.lower("p_type"), F.lit(None).cast("string")).alias("tags"),
        F.create_map(F.lit("z"), F.col("p_partkey"), F.lit("a"), F.col("p_size").cast("bigint")).alias("counts"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("note"),
    )
    files.write_bundle({"inventory.csv": rows.drop("note"), "records.jsonl": rows.select("motion_id", "note")}, root, csv=("inventory.csv",))
    files.write_lines(rows.where("motion_id % 4 = 0"), "motion_id", f"{root}/names.txt")
    table_ = spark.read.option("header", "true").option("escape", '"').csv(f"{root}/inventory.csv").withColumns({"motion_id": F.col("motion_id").cast("bigint"), "p_size": F.col("p_size").cast(rows.schema["p_size"].dataType)})
    notes = files.read_manifest(spark, f"{root}/records.jsonl", "motion_id bigint, note string", "motion_id")
    listed = files.read_path_list(spark, f"{root}/names.txt").select(F.col("path").cast("bigint").alias("motion_id"), F.lit(True).alias("listed"))
    both = table_.join(notes, "motion_id").join(listed, "motion_id", "left")
    return both.select("motion_id", "said", "p_size", "tags", "counts", F.coalesce("listed", F.lit(False)).alias("listed"), "note")
