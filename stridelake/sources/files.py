"""Files in, reports out: discovery, archives, annotations, manifests, sinks, freeze checks."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import re
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import yaml
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

from stridelake.functions import normalize
from stridelake.operators import digests, rules
from stridelake.operators.scratch import Scratch

ALIASES = {
    "pose": ("poses", "body_pose", "pose_body"),
    "trans": ("trans", "transl"),
    "fps": ("mocap_framerate", "mocap_frame_rate", "fps"),
    "betas": ("betas",),
    "gender": ("gender",),
}
#: What ``read_archives`` says of an archive, in order.
HEADER = {
    "path": pa.string(), "has_pose": pa.bool_(), "has_translation": pa.bool_(), "has_fps": pa.bool_(), "has_betas": pa.bool_(), "has_gender": pa.bool_(),
    "n_frames": pa.int64(), "pose_width": pa.int32(), "trans_frames": pa.int64(), "trans_width": pa.int32(), "pose_shape_valid": pa.bool_(), "trans_shape_valid": pa.bool_(),
    "frame_count_valid": pa.bool_(), "lengths_match": pa.bool_(), "pose_has_nan": pa.bool_(), "pose_has_inf": pa.bool_(), "trans_has_nan": pa.bool_(), "trans_has_inf": pa.bool_(),
    "pose_abs_max": pa.float64(), "trans_abs_max": pa.float64(), "motion_mean": pa.float64(), "fps": pa.float64(), "fps_valid": pa.bool_(), "duration_sec": pa.float64(),
    "expected_frames_30": pa.int64(), "gender": pa.string(), "betas": pa.list_(pa.float64()), "exact_hash": pa.string(), "near_hash": pa.string(), "missing": pa.list_(pa.string()),
    "has_nan": pa.bool_(), "has_inf": pa.bool_(), "error": pa.string(),
}
ARROW = pa.schema(list(HEADER.items()))
DDL = ", ".join(f"{n} {from_arrow_type(k).simpleString()}" for n, k in HEADER.items())
SAMPLES, TOLERANCE = 32, 1e-4  # frames and step of the near hash


def _binary(spark: SparkSession, root: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)


def discover(spark: SparkSession, root: str, pattern: str = "*", exclude: tuple[str, ...] = (), recursive: bool = True, content: bool = False) -> DataFrame:
    """``path, length`` of matching files, sorted by path; contents are read only if asked for."""
    files = _binary(spark, root, pattern, recursive)
    for x in exclude:
        files = files.where(~F.col("path").rlike(fnmatch.translate(f"*{x}")))
    return files.select("path", "length", *(["content"] if content else [])).orderBy("path")


def _numeric(z, key: str):
    found = next((k for k in ALIASES[key] if k in z), None)
    return None if found is None else z[found]


def _motion_hashes(pose: np.ndarray, trans: np.ndarray) -> tuple[str, str]:
    """A hash of both arrays as they are, and one of quantised frames evenly spread, translation relative to the first."""
    exact = hashlib.sha1()
    for a in (pose, trans):
        exact.update(f"{a.shape}{a.dtype}".encode() + np.ascontiguousarray(a).tobytes())
    at = np.rint(np.linspace(0, len(pose) - 1, SAMPLES)).astype(int)
    p, t = (np.asarray(a[at], np.float64).reshape(SAMPLES, -1) for a in (pose, trans))
    cells = np.rint(np.concatenate([p, t - t[:1]], axis=1) / TOLERANCE).astype("<i8")
    return exact.hexdigest(), hashlib.sha1(cells.tobytes()).hexdigest()


def _header(path: str, raw: bytes) -> dict:
    out = dict.fromkeys(HEADER) | {"path": path, "missing": [], "has_nan": False, "has_inf": False}
    try:
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            got = {k: _numeric(z, k) for k in ALIASES}
        out |= {f"has_{n}": got[k] is not None for n, k in (("pose", "pose"), ("translation", "trans"), ("fps", "fps"), ("betas", "betas"), ("gender", "gender"))}
        out["missing"] = [k for k in ("pose", "trans", "fps") if got[k] is None]
        for k, frames, width in (("pose", "n_frames", "pose_width"), ("trans", "trans_frames", "trans_width")):
            if (a := got[k]) is None:
                continue
            out[f"{k}_shape_valid"] = a.ndim == 2
            out[frames] = int(a.shape[0]) if a.ndim else 0
            out[width] = int(a.shape[1]) if a.ndim == 2 else None
            a = np.asarray(a, np.float64)
            out[f"{k}_has_nan"], out[f"{k}_has_inf"] = bool(np.isnan(a).any()), bool(np.isinf(a).any())
            out["has_nan"] |= out[f"{k}_has_nan"]
            out["has_inf"] |= out[f"{k}_has_inf"]
            out[f"{k}_abs_max"] = float(np.max(np.abs(a))) if a.size else None
        pose, trans = got["pose"], got["trans"]
        if pose is not None:
            out["frame_count_valid"] = out["n_frames"] > 0
            if pose.size:
                out["motion_mean"] = float(np.abs(np.diff(np.asarray(pose, np.float64), axis=0)).mean()) if len(pose) > 1 else 0.0
        if pose is not None and trans is not None and pose.ndim and trans.ndim:
            out["lengths_match"] = len(pose) == len(trans)
            if pose.ndim == trans.ndim == 2 and len(pose) and out["lengths_match"] and not (out["has_nan"] or out["has_inf"]):
                out["exact_hash"], out["near_hash"] = _motion_hashes(pose, trans)
        if got["fps"] is not None:
            out["fps"] = float(np.asarray(got["fps"]).ravel()[0])
            out["fps_valid"] = bool(np.isfinite(out["fps"]) and out["fps"] > 0)
            if out["fps_valid"] and out["frame_count_valid"]:
                out["duration_sec"] = round(out["n_frames"] / out["fps"], 6)
                out["expected_frames_30"] = round(out["n_frames"] / out["fps"] * 30.0)
        if got["gender"] is not None:
            g = np.asarray(got["gender"]).ravel()[0]
            out["gender"] = g.decode() if isinstance(g, bytes) else str(g)
        if got["betas"] is not None:
            out["betas"] = np.asarray(got["betas"], np.float64).ravel().tolist()
    except Exception as x:  # a broken file is data here
        out["error"] = f"{type(x).__name__}: {x}"[:500]
    return out


def read_archives(files: DataFrame) -> DataFrame:
    """``HEADER`` of NPZ archives from ``files(path, content)``; a broken archive is a row with ``error``.

    Hashes are null unless pose and translation are finite, of two dimensions and equally long.
    """

    def run(batches):
        for b in batches:
            rows = [_header(p.as_py(), c.as_py()) for p, c in zip(b.column("path"), b.column("content"))]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.select("path", "content").mapInArrow(run, DDL)


def base_records(files: DataFrame, root: str) -> DataFrame:
    """Identity of every file below ``root`` without opening it: source and subject from the folders, name, id, size.

    A file two folders down has the root's name for its source, one right below it no subject.
    """
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), f"^{re.escape('/' + re.sub('^[a-z]+:/+', '', root).strip('/'))}/", "")
    parts = F.split(relative, "/")
    own = F.lit(root.rstrip("/").rsplit("/", 1)[-1])
    deep, n = F.size(parts) >= 3, F.size(parts)
    last = F.element_at(parts, -1)
    name = F.when(last.endswith("_stageii.npz"), F.regexp_replace(last, r"_stageii\.npz$", "")).otherwise(F.regexp_replace(last, r"(.)\.[^.]*$", "$1"))
    out = files.select("path", "length", relative.alias("relative_path"), F.when(deep, parts[0]).otherwise(own).alias("source"), F.when(deep, F.get(parts, F.lit(1))).when(n == 2, parts[0]).otherwise(F.lit("")).alias("subject"), name.alias("name"))
    return out.withColumns({"motion_id": normalize.motion_id(F.col("source"), F.col("subject"), F.col("name"), F.col("relative_path")), "size_mb": F.round(F.col("length") / F.lit(float(1 << 20)), 6)})


def load_config(path: str, sections: list[str] = ()) -> dict:
    """A YAML or JSON file as a dictionary; ValueError if it is none or lacks a section."""
    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f)
    missing = [s for s in sections if not isinstance(out, dict) or s not in out]
    if missing or not isinstance(out, dict):
        raise ValueError(f"{path}: no section {', '.join(missing) or 'at all'}")
    return out


def archive_frames(files: DataFrame) -> DataFrame:
    """``path, frame_id, pose, trans``: a row for each frame; fails on a broken archive."""
    schema = pa.schema([("path", pa.string()), ("frame_id", pa.int64()), ("pose", pa.list_(pa.float64())), ("trans", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    pose, trans = _numeric(z, "pose"), _numeric(z, "trans")
                    for at in range(0, len(pose), 1024):
                        part = slice(at, at + 1024)
                        n = len(pose[part])
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n)), pa.array(list(np.asarray(pose[part], np.float64))), pa.array(list(np.asarray(trans[part], np.float64)))], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, frame_id bigint, pose array<double>, trans array<double>")


def strict(headers: DataFrame) -> DataFrame:
    """Headers as they are; the query fails on any that is broken, empty or not finite."""
    bad = F.col("error").isNotNull() | (F.size("missing") > 0) | F.col("has_nan") | F.col("has_inf") | (F.coalesce("n_frames", F.lit(0)) < 1) | ~(F.coalesce("fps", F.lit(0.0)) > 0)
    return headers.where(F.when(bad, F.raise_error(F.concat(F.lit("bad archive: "), "path")).cast("boolean")).otherwise(F.lit(True)))


_LABEL = "raw_label:string,proc_label:string,act_cat:array<string>"


def annotation_entries(texts: DataFrame, value: str = "value", split: str = "split") -> DataFrame:
    """``ann_id, split, feat_p, duration, seq_labels, frame_labels`` of rows that hold a JSON object of entries each.

    A text is parsed once; fields are typed paths into it.  What isn't of its path's type is null, lists
    are empty then, and so is a missing duration 0.  Texts that aren't JSON have no rows: ``malformed`` has them.
    """
    of = lambda path, kind: F.try_variant_get("e", path, kind)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    seq, frame = f"array<struct<{_LABEL}>>", f"array<struct<{_LABEL},start_t:double,end_t:double>>"
    rows = texts.select(split, F.try_parse_json(value).alias("__v")).where("__v is not null")
    rows = rows.select(split, F.explode(F.try_variant_get("__v", "$", "map<string,variant>")).alias("ann_id", "e"))
    return rows.select(
        "ann_id", split, F.coalesce(of("$.feat_p", "string"), F.lit("")).alias("feat_p"), F.coalesce(of("$.dur", "double"), F.lit(0.0)).alias("duration"),
        empty(of("$.seq_ann.labels", seq), seq).alias("seq_labels"), empty(of("$.frame_ann.labels", frame), frame).alias("frame_labels"),
    )


def malformed(texts: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose text isn't JSON, or isn't an object of entries."""
    return texts.where(F.col(value).isNotNull() & F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>").isNull())


def all_evidence(seq_labels: Column, frame_labels: Column) -> Column:
    """Sorted evidence of all labels of an entry."""
    of = lambda l: normalize.label_evidence(l["act_cat"], l["proc_label"], l["raw_label"])
    return F.array_sort(F.array_distinct(F.flatten(F.concat(F.transform(seq_labels, of), F.transform(frame_labels, of)))))


def read_annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``annotation_entries`` of files, which are one JSON object each; the split is the file's stem."""
    raw = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1).alias("split"), "value")
    return annotation_entries(raw).orderBy("split", F.lower("feat_p"), "ann_id")


def useful_frame_labels(labels: Column) -> Column:
    """Labels with both times that name a category."""
    named = lambda l: F.size(normalize.label_categories(l["act_cat"], l["proc_label"], l["raw_label"])) > 0
    return F.filter(labels, lambda l: l["start_t"].isNotNull() & l["end_t"].isNotNull() & named(l))


def read_jsonl(spark: SparkSession, path: str, schema: str, fail: bool = False) -> DataFrame:
    """JSON lines, blank ones skipped; with ``fail`` a line that doesn't parse fails the query."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    if fail:
        rows = rows.where(F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("not JSON: "), "_bad")).cast("boolean")).otherwise(F.lit(True)))
    return rows.drop("_bad")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, blank ones skipped; the first line that doesn't parse fails the query with its file and number.

    Whole files are rows here, as is meant for manifests.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where(F.trim("line") != "")
    parsed = raw.withColumn("r", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    wrong = F.raise_error(F.concat("f", F.lit(":"), (F.col("n") + 1).cast("string"), F.lit(": not JSON"))).cast("boolean")
    return parsed.where(F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), wrong).otherwise(True)).select("r.*").drop("_bad")


def read_manifest(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A JSON-lines manifest with a unique key."""
    return rules.assert_unique(read_jsonl(spark, path, schema, fail=True), key)


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """One path a line, blank lines skipped; the query fails on repeats."""
    return rules.assert_unique(spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''"), "path")


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    sorted_map = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return df.select(*((sorted_map(f.name) if isinstance(f.dataType, T.MapType) else F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, path: str, sep: str = ",", mark: bool = False) -> None:
    """CSV with a header; lists and maps as JSON, map keys sorted; with ``mark`` a byte-order mark before it.  Refuses to overwrite."""
    flat = _flat(df)
    if mark and flat.columns:
        flat = flat.toDF("\ufeff" + flat.columns[0], *flat.columns[1:])
    flat.write.mode("errorifexists").option("header", "true").option("sep", sep).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """JSON lines of the chosen columns, nulls written.  Refuses to overwrite."""
    (df.select(*columns) if columns else df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text manifest: one value a line.  Refuses to overwrite."""
    df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).write.mode("errorifexists").text(path)


def write_bundle(tables: dict[str, DataFrame], root: str, csv: tuple[str, ...] = ()) -> None:
    """Each table under its own name below ``root``, which must not exist."""
    for name, df in tables.items():
        (write_csv if name in csv else write_jsonl)(df, f"{root}/{name}")


def _identity_first(records: DataFrame) -> DataFrame:
    """Identity columns, then all others by name."""
    first = [c for c in ("motion_id", "source", "subject", "name", "relative_path", "final_status", "final_status_reason") if c in records.columns]
    return records.select(*first, *sorted(c for c in records.columns if c not in first))


def write_first_selection(records: DataFrame, mapping: DataFrame, summary: DataFrame, mapping_summary: DataFrame, root: str, candidate: list[str] | None = None, dual: list[str] | None = None) -> None:
    """The first selection's seven tables: the inventory twice, what passed both filters, what was selected, path mapping, two summaries."""
    passed = records.where((F.col("heuristic_status") == "heuristic_passed") & F.col("semantic_status").isin(*rules.PASSED_SEMANTIC))
    write_csv(records, f"{root}/amass_inventory.csv", mark=True)
    write_jsonl(records, f"{root}/amass_inventory.jsonl")
    write_jsonl(passed, f"{root}/dual_filter_passed.jsonl", dual)
    write_jsonl(records.where("final_status = 'selected_candidate'"), f"{root}/candidate_v1.jsonl", candidate)
    write_csv(mapping, f"{root}/babel_path_mapping.csv", mark=True)
    write_jsonl(summary, f"{root}/scan_summary.json")
    write_jsonl(mapping_summary, f"{root}/babel_path_summary.json")


def write_refined_selection(records: DataFrame, clusters: DataFrame, reports: dict[str, DataFrame], root: str, candidates: str = "candidate_v3.jsonl") -> None:
    """A later selection's tables: inventory twice, rows passed and rows for review, selected rows, clusters, and ``reports`` by name."""
    rows = _identity_first(records)
    write_csv(rows, f"{root}/amass_inventory.csv", mark=True)
    write_jsonl(rows, f"{root}/amass_inventory.jsonl")
    write_jsonl(rows.where("heuristic_status = 'heuristic_passed'"), f"{root}/dual_filter_passed.jsonl")
    write_jsonl(rows.where("heuristic_status = 'review_heuristic'"), f"{root}/review_candidates.jsonl")
    write_jsonl(rows.where("final_status = 'selected_candidate'"), f"{root}/{candidates}")
    write_jsonl(clusters, f"{root}/dedup_clusters.jsonl")
    for name, df in reports.items():
        write_jsonl(df, f"{root}/{name}")


def npz_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """An NPZ archive that is the same for the same arrays: members sorted, one fixed time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(arrays):
            member = io.BytesIO()
            np.lib.format.write_array(member, np.asarray(arrays[name]), allow_pickle=False)
            z.writestr(zipfile.ZipInfo(f"{name}.npy", (1980, 1, 1, 0, 0, 0)), member.getvalue(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_archives(frames: DataFrame, seq: str, frame: str, arrays: list[str], root: str) -> DataFrame:
    """One NPZ for each sequence, arrays stacked in the order of its frames; returns ``path, frames``.

    An archive appears under its name when it is whole: it is written beside it and moved.  A
    sequence is one task's; its frames have to fit a worker's memory, as the archive does.
    """

    def run(key, group):
        order = np.argsort(group.column(frame).to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        raw = npz_bytes({a: np.array(group.column(a).to_pylist()) for a in arrays})
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        store.create_dir(base, recursive=True)
        path = f"{base}/{key[0].as_py()}.npz"
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(raw)
        store.move(part, path)
        return pa.table({"path": [path], "frames": pa.array([group.num_rows], pa.int64())})

    return frames.groupBy(seq).applyInArrow(run, "path string, frames bigint")


def delete_below(spark: SparkSession, root: str, path: str) -> None:
    """Delete ``path`` if it lies strictly below ``root``; ValueError if it doesn't."""
    jvm = spark._jvm
    at, top = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, root))
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    at, top = store.makeQualified(at), store.makeQualified(top)
    inside = at.toString().startswith(top.toString().rstrip("/") + "/") and ".." not in at.toString().split("/")
    if not inside:
        raise ValueError(f"{path} is not below {root}")
    store.delete(at, True)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version below ``path`` and name it in ``path/_current``, which is replaced in one step.

    A reader by ``read_table`` sees the version before or the new one, whole.  Of the versions
    before only the last one stays, for those who read it still.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    store = at("").getFileSystem(conf)
    before = _current(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    note = at(f"_{version}")
    out = store.create(note, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = rename
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(note).toUri(), conf).rename(store.makeQualified(note), store.makeQualified(at("_current")), kinds)
    for f in store.listStatus(at("")):
        name = f.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            store.delete(f.getPath(), True)


def _current(spark: SparkSession, path: str) -> str | None:
    """The version that ``path/_current`` names; None without one."""
    jvm = spark._jvm
    note = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    store = note.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(note):
        return None
    stream = store.open(note)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``replace_table`` wrote last."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(f"{path}/{version}")


def file_digests(spark: SparkSession, root: str | list[str], pattern: str = "*") -> DataFrame:
    """``path, sha256`` of every file: taken before and after a run, the two must be equal.

    In no order, since a content that is sorted travels; here none leaves the task that reads it.
    """
    return _binary(spark, root, pattern).select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.withColumnRenamed("sha256", "was").join(after.withColumnRenamed("sha256", "now"), "path", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def digest_tree(spark: SparkSession, root: str | list[str], depth: int | None = None) -> DataFrame:
    """``level, node, parent, digest`` of ``digests.tree`` over all files below ``root``; a file's node is its path.

    Files are read at once and once only: the tree's levels are made of digests that are written first.
    """
    own = Scratch(spark, "digests").keep(file_digests(spark, root), "files")
    return digests.tree(own, "path", F.col("sha256"), depth)
