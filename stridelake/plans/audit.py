"""More of the query catalogue: final decisions, policies, summaries, audits, frames and trajectories.

The tables stand in for a motion catalogue as in ``catalogue``; conditions that a table lacks are
written once, in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stridelake.functions import intervals, normalize, vectors
from stridelake.operators import dedup, matching, metrics, plugins, reports, rules, trajectory
from stridelake.plans import catalogue as base
from stridelake.plans.catalogue import BASIC, MOTIONS, R, _CASCADE, _FRAMES, _M, _TIERS, frames, motions, query, table
from stridelake.sources import files

# ---- labels, identities, selections


@query("SELECT vec_id, min(vec_id) OVER (PARTITION BY list_transform(embedding, lambda v: round(v::DOUBLE * 4, 0))) AS first_id FROM embeddings")
def q41_exact_hash(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double") * 4, 0) + 0.0).alias("x"))
    h = e.select("vec_id", dedup.exact_hash("x").alias("h"))
    return h.join(h.groupBy("h").agg(F.min("vec_id").alias("first_id")), "h").select("vec_id", "first_id")


@query(_CASCADE + "SELECT l.p_partkey AS local_id, CASE count(r.ann_id) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM l LEFT JOIN r ON r.local_id = l.p_partkey GROUP BY 1")
def q42_local_status(spark, sf_dir):
    annotations, local = base._paths(spark, sf_dir)
    return matching.local_status(matching.cascade_match(annotations, local), local)


@query("""SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS labelled, n_chars FROM documents d WHERE n_chars / 100.0 BETWEEN 2 AND 15 AND n_chars >= 300""")
def q43_in_range(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") / F.lit(100.0)).alias("seconds"))
    d = rules.keep_in_range(d, "seconds", "n_chars", min_sec=2, max_sec=15, min_frames=300)
    return matching.flag_member(d, table(spark, sf_dir, "labels"), "doc_id", "labelled").select("doc_id", "labelled", "n_chars")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)")
def q44_pick_one(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    low = p.agg(F.min("p_partkey").alias("low"))
    return matching.pick_one(p.join(F.broadcast(low), F.col("p_partkey") == F.col("low")), F.lit(True)).select("p_partkey", "p_name")


_CLEAN = "coalesce(nullif(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"
_PART_PATH = "p_type || '/' || p_brand || '/' || p_name || CASE p_partkey % 3 WHEN 0 THEN '_poses.npz' WHEN 1 THEN '_STAGEII.npz' ELSE '.npz' END"


@query(f"""WITH p AS (SELECT *, {_PART_PATH} AS path FROM part)
SELECT p_partkey, {_CLEAN.format('p_type')} || '_' || {_CLEAN.format('p_brand')} || '_' || {_CLEAN.format('p_name')} || '_' || substr(sha1(path), 1, 8) AS motion_id, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS stem, p_partkey % 11 <> 0 AS safe FROM p""")
def q45_identity(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("path", F.expr(_PART_PATH))
    outside = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("a/../"), "path")).otherwise(F.col("path"))
    return p.select("p_partkey", normalize.motion_id(F.col("p_type"), F.col("p_brand"), F.col("p_name"), F.col("path")).alias("motion_id"), normalize.motion_stem(F.col("path")).alias("stem"), rules.safe_relative(outside).alias("safe"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN p_partkey % 3 = 0 THEN [lower(p_type), lower(p_brand)] WHEN p_partkey % 3 = 1 THEN [lower(p_name)] ELSE [lower(p_brand)] END)), ',') AS labels,
array_to_string(list_sort(list_distinct(list_concat(CASE WHEN p_partkey % 3 = 0 THEN [lower(p_type)] WHEN p_partkey % 3 = 1 THEN [lower(p_name)] ELSE [] END, [lower(p_brand)]))), ',') AS evidence FROM part""")
def q46_label_evidence(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    act = F.when(F.col("p_partkey") % 3 == 0, F.array("p_type", "p_brand"))
    proc = F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.lit(""))
    said = {"labels": normalize.label_categories(act, proc, F.col("p_brand")), "evidence": normalize.label_evidence(act, proc, F.col("p_brand"))}
    return p.select("p_partkey", *(F.array_join(c, ",").alias(n) for n, c in said.items()))


TAXONOMY = normalize.taxonomy({"romance": ["fr", "ES"], "germanic": ["de", "src1"], "source": ["src2", "src3"], "meta": ["src4", "src5"]}, ["Meta"])


@query("""WITH l AS (SELECT doc_id, unnest([lang, source, CASE WHEN doc_id % 9 = 0 THEN '' END]) AS label FROM documents),
g AS (SELECT doc_id, CASE WHEN label IN ('fr', 'es') THEN 'romance' WHEN label IN ('de', 'src1') THEN 'germanic' WHEN label IN ('src2', 'src3') THEN 'source' WHEN label IN ('src4', 'src5') THEN NULL ELSE 'other' END AS g FROM l WHERE label <> '')
SELECT doc_id, coalesce(array_to_string(list_sort(list(DISTINCT g) FILTER (g IS NOT NULL)), ','), '') AS categories FROM g GROUP BY 1""")
def q47_taxonomy(spark, sf_dir):
    labels = F.array(normalize.normalize_label(F.col("lang")), normalize.normalize_label(F.col("source")), F.when(F.col("doc_id") % 9 == 0, ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(normalize.map_labels(labels, TAXONOMY), ",").alias("categories"))


@query(f"""WITH d AS (SELECT doc_id, sha256('sample-3:' || doc_id) AS h FROM documents) SELECT doc_id FROM d ORDER BY h, doc_id LIMIT 50""")
def q48_hash_sample(spark, sf_dir):
    return normalize.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "sample-3", 50)


# ---- policies


@query("""WITH e AS (SELECT user_id, event_type AS c, value / 1000 AS s FROM events), l AS (SELECT user_id, c, sum(s) FILTER (s >= 0.1) AS long FROM e GROUP BY 1, 2)
SELECT user_id, coalesce(array_to_string(list(c ORDER BY c) FILTER (long IS NOT NULL), ','), '') AS long, coalesce(array_to_string(list(c ORDER BY c) FILTER (long IS NULL), ','), '') AS short, round(coalesce(sum(long) FILTER (c = 'error'), 0), 6) AS error_seconds FROM l GROUP BY 1""")
def q49_event_evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("category"), F.lit(0.0).alias("start"), (F.col("value") / 1000).alias("end"))
    t = rules.event_evidence(e, "user_id", "category", "start", "end")
    return t.select("user_id", F.array_join("long", ",").alias("long"), F.array_join("short", ",").alias("short"), R(F.coalesce(F.try_element_at("seconds", F.lit("error")), F.lit(0.0))).alias("error_seconds"))


_LABELS = "CASE WHEN doc_id % 2 = 0 THEN 'click' ELSE 'view' END"


@query(f"""WITH d AS (SELECT *, [lang, {_LABELS}] AS ls, doc_id % 13 = 0 AS old, CASE doc_id % 5 WHEN 0 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT doc_id, CASE WHEN split = 'test' THEN 'unverified' WHEN lang = 'es' OR old THEN 'reject' WHEN list_has_any(ls, ['click', 'en', 'fr']) THEN 'eligible' ELSE 'unverified' END AS status, CASE WHEN lang = 'es' AND split <> 'test' THEN round(n_chars / 100.0, 6) END AS reject_seconds FROM d""")
def q50_policy_evidence(spark, sf_dir):
    policy = rules.Policy({"R": ["error", "es"], "C": ["click", "en"], "A": ["fr"], "M": ["view", "de"]})
    d = table(spark, sf_dir, "documents").withColumn("hits", policy.hits(F.array("lang", F.expr(_LABELS))))
    split = F.expr("CASE doc_id % 5 WHEN 0 THEN 'test' ELSE 'train' END")
    evidence = F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("calibration")))
    seconds = policy.reject_seconds(F.col("hits"), F.create_map("lang", F.col("n_chars") / F.lit(100.0)))
    own = F.when(policy.usable(split), F.try_element_at(seconds, F.lit("es")))
    return d.select("doc_id", policy.status(F.col("hits"), split, evidence).alias("status"), own.alias("reject_seconds"))


@query("""WITH p(tier, label) AS (VALUES ('R', 'error'), ('C', 'click'), ('A', 'purchase'), ('A', 'signup'), ('M', 'view')), o AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)
SELECT tier, count(o.label)::INT AS labels FROM o FULL JOIN p ON p.label = o.label GROUP BY 1 HAVING count(*) FILTER (o.label IS NULL OR p.label IS NULL) = 0""")
def q51_validate_policy(spark, sf_dir):
    policy = rules.Policy({"R": ["error"], "C": ["click"], "A": ["purchase", "signup"], "M": ["view"]})
    return rules.validate_policy(table(spark, sf_dir, "events").select(F.col("event_type").alias("label")), policy)


@query(r"""WITH p AS (SELECT p_partkey, lower(p_type) AS t, ' ' || lower(p_name) || ' ' AS n FROM part)
SELECT CASE WHEN t = 'promo' OR contains(n, ' red ') THEN 'rejected' WHEN t = 'economy' OR contains(n, ' small ') THEN 'review' ELSE 'core' END AS hands_status, count(*) AS n FROM p GROUP BY 1""")
def q52_hands_policy(spark, sf_dir):
    labels = F.array(normalize.normalize_label(F.col("p_type")))
    hits = normalize.phrase_hits(F.array(normalize.free_text(F.col("p_name"))), ["red", "small"])
    status = rules.hands_status(labels, hits, ["promo"], ["economy"], ["red"], ["small"])
    return table(spark, sf_dir, "part").groupBy(status.alias("hands_status")).agg(F.count("*").alias("n"))


# ---- basic and magnitude checks with their texts


@query(f"""WITH {MOTIONS}, s AS (SELECT *, {BASIC} AS status FROM m)
SELECT doc_id, status, CASE status WHEN 'reject_corrupt' THEN 'ValueError: empty' WHEN 'reject_missing_field' THEN 'missing required field(s): pose' || CASE WHEN doc_id % 20 = 0 THEN ', fps' ELSE '' END WHEN 'reject_invalid_value' THEN 'FPS must be finite and > 0'
 WHEN 'review_short' THEN printf('duration=%.4fs, below minimum 2.0000s', duration) WHEN 'defer_very_long' THEN printf('duration=%.4fs, above defer limit 30.0000s', duration) WHEN 'defer_long' THEN printf('duration=%.4fs, above v1 maximum 15.0000s', duration)
 WHEN 'defer_low_fps' THEN format('source_fps={{:.6g}}, below target_fps=30', fps) WHEN 'defer_fps' THEN format('source_fps={{:.6g}}, not an integer multiple of 30', fps) ELSE 'passed_v1_basic_filter' END AS reason FROM s""")
def q53_basic_reason(spark, sf_dir):
    m = base.basic_status(motions(spark, sf_dir))
    missing = {"pose": F.lit(True), "fps": F.col("doc_id") % 20 == 0}
    reason = rules.basic_reason(F.col("status"), F.col("duration"), F.col("fps"), F.lit("ValueError: empty"), missing, {"FPS must be finite and > 0": F.lit(True)})
    return m.select("doc_id", "status", reason.alias("reason"))


@query("""SELECT l_returnflag, CASE WHEN l_quantity > 45 OR l_extendedprice > 90000 OR l_tax < 0.01 THEN 'reject_heuristic' ELSE 'heuristic_passed' END AS status, round(avg(least(1, l_tax / 0.02)), 6) AS quality,
count(*) FILTER (l_quantity > 45) AS pose, count(*) FILTER (l_extendedprice > 90000) AS trans, count(*) FILTER (l_tax < 0.01) AS motion FROM lineitem GROUP BY 1, 2""")
def q54_magnitude_rules(spark, sf_dir):
    codes = rules.all_of(rules.magnitude_rules(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"), 45.0, 90000.0, 0.01))
    li = table(spark, sf_dir, "lineitem").withColumn("codes", codes)
    has = lambda c: F.count_if(F.array_contains("codes", c))
    return li.groupBy("l_returnflag", rules.magnitude_status(F.col("codes")).alias("status")).agg(R(F.avg(rules.heuristic_quality(F.col("l_tax")))).alias("quality"), has("pose_abs_max").alias("pose"), has("trans_abs_max").alias("trans"), has("low_motion").alias("motion"))


# ---- final decisions

_RECORD = {
    "motion_id": "doc_id",
    "semantic_status": "CASE WHEN doc_id % 17 = 0 THEN 'reject_semantic_hard' WHEN doc_id % 4 = 0 THEN 'babel_unmatched' ELSE 'semantic_passed' END",
    "semantic_status_reason": "CASE WHEN doc_id % 17 = 0 THEN 'hard label' ELSE 'none' END",
    "basic_status": "CASE WHEN n_chars < 300 THEN 'review_short' ELSE 'basic_passed' END",
    "basic_status_reason": "CASE WHEN n_chars < 300 THEN 'short' ELSE 'passed' END",
    "dedup_status": "CASE WHEN doc_id % 7 = 0 THEN 'defer_exact_duplicate' WHEN doc_id % 11 = 0 THEN 'defer_redundant_take' ELSE 'unique' END",
    "duplicate_of": "CASE WHEN doc_id % 7 = 0 THEN doc_id - 1 END",
    "quota_status": "CASE doc_id % 3 WHEN 0 THEN 'selected_candidate' WHEN 1 THEN 'defer_source_quota' ELSE 'defer_global_budget' END",
    "quota_status_reason": "CASE doc_id % 3 WHEN 0 THEN 'accepted' ELSE 'full' END",
    "in_candidate": "doc_id % 5 <> 0",
}
_EARLY = {"heuristic_status": "CASE WHEN doc_id % 6 = 0 THEN 'reject_heuristic' ELSE 'heuristic_passed' END", "heuristic_status_reason": "CASE WHEN doc_id % 6 = 0 THEN 'pose' ELSE 'passed' END"}
_LATE = {
    "heuristic_status": "CASE doc_id % 6 WHEN 0 THEN 'reject_heuristic_high_confidence' WHEN 1 THEN 'review_heuristic' ELSE 'heuristic_passed' END",
    "heuristic_primary_reason": "CASE doc_id % 6 WHEN 0 THEN 'reject_floor_high_confidence' WHEN 1 THEN 'review_static' ELSE 'heuristic_passed' END",
}


def _records(spark, sf_dir, later: dict[str, str], **changed: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", *(F.expr(e).alias(n) for n, e in (_RECORD | later | changed).items()))
    return d.withColumn("heuristic_all_reasons", F.array("heuristic_primary_reason", F.lit("review_crawling"))) if "heuristic_primary_reason" in d.columns else d


def _records_sql(later: dict[str, str], **changed: str) -> str:
    return f"r AS (SELECT doc_id, source, lang, n_chars, {', '.join(f'{e} AS {n}' for n, e in (_RECORD | later | changed).items())} FROM documents)"


_DEFERRED = "WHEN dedup_status <> 'unique' THEN {0}"
_OF = "dedup_status || ' of ' || coalesce(duplicate_of::VARCHAR, 'None')"


@query(f"""WITH {_records_sql(_EARLY)}
SELECT doc_id, CASE WHEN semantic_status LIKE 'reject_semantic%' THEN semantic_status WHEN basic_status <> 'basic_passed' THEN basic_status WHEN heuristic_status <> 'heuristic_passed' THEN heuristic_status WHEN dedup_status <> 'unique' THEN 'defer_duplicate' ELSE quota_status END AS final_status,
CASE WHEN semantic_status LIKE 'reject_semantic%' THEN semantic_status_reason WHEN basic_status <> 'basic_passed' THEN basic_status_reason WHEN heuristic_status <> 'heuristic_passed' THEN heuristic_status_reason WHEN dedup_status <> 'unique' THEN {_OF} ELSE quota_status_reason END AS reason,
heuristic_status = 'heuristic_passed' AND semantic_status IN ('semantic_passed', 'babel_unmatched', 'babel_ambiguous') AND basic_status = 'basic_passed' AS eligible FROM r""")
def q55_final_first(spark, sf_dir):
    r = _records(spark, sf_dir, _EARLY)
    status, reason = rules.final_status_first(F.col)
    return r.select("doc_id", status.alias("final_status"), reason.alias("reason"), rules.eligible(F.col("heuristic_status"), F.col("semantic_status"), F.col("basic_status")).alias("eligible"))


_ALL = "heuristic_primary_reason || '; review_crawling'"
_HEURISTIC = "WHEN heuristic_status <> 'heuristic_passed' THEN"


@query(f"""WITH {_records_sql(_LATE)}
SELECT doc_id, CASE WHEN semantic_status LIKE 'reject_semantic%' THEN semantic_status WHEN basic_status <> 'basic_passed' THEN basic_status {_HEURISTIC} heuristic_primary_reason {_DEFERRED.format('dedup_status')} ELSE quota_status END AS final_status,
CASE WHEN semantic_status LIKE 'reject_semantic%' THEN semantic_status_reason WHEN basic_status <> 'basic_passed' THEN basic_status_reason {_HEURISTIC} {_ALL} {_DEFERRED.format(_OF)} ELSE quota_status_reason END AS reason FROM r""")
def q56_final_refined(spark, sf_dir):
    status, reason = rules.final_status_refined(F.col)
    return _records(spark, sf_dir, _LATE).select("doc_id", status.alias("final_status"), reason.alias("reason"))


_CORE = "CASE WHEN doc_id % 8 = 0 THEN 'reject_semantic_any_occurrence' ELSE 'semantic_core_eligible' END"


@query(f"""WITH {_records_sql(_LATE, semantic_status=_CORE)}
SELECT doc_id, CASE WHEN NOT in_candidate THEN 'defer_not_in_v3_candidate' WHEN semantic_status <> 'semantic_core_eligible' THEN semantic_status WHEN basic_status <> 'basic_passed' THEN basic_status {_HEURISTIC} heuristic_primary_reason {_DEFERRED.format('dedup_status')} ELSE quota_status END AS final_status,
CASE WHEN NOT in_candidate THEN 'not selected by frozen V3 candidate set' WHEN semantic_status <> 'semantic_core_eligible' THEN semantic_status_reason WHEN basic_status <> 'basic_passed' THEN basic_status_reason {_HEURISTIC} {_ALL} {_DEFERRED.format(_OF)} ELSE quota_status_reason END AS reason FROM r""")
def q57_final_policy(spark, sf_dir):
    status, reason = rules.final_status_policy(F.col)
    return _records(spark, sf_dir, _LATE, semantic_status=_CORE).select("doc_id", status.alias("final_status"), reason.alias("reason"))


@query(f"WITH {_records_sql(_EARLY)} SELECT doc_id, quota_status AS quota_status_v2, dedup_status AS dedup_status_v2, 'not_eligible' AS quota_status, NULL::VARCHAR AS dedup_status FROM r")
def q58_snapshot(spark, sf_dir):
    fresh = {"quota_status": F.lit("not_eligible"), "dedup_status": F.lit(None).cast("string")}
    r = rules.snapshot(_records(spark, sf_dir, _EARLY), ["quota_status", "dedup_status"], "_v2", fresh)
    return r.select("doc_id", "quota_status_v2", "dedup_status_v2", "quota_status", "dedup_status")


# ---- summaries

_STAGES = {"semantic": "semantic_status", "basic": "basic_status", "heuristic": "heuristic_status", "dedup": "dedup_status", "quota": "quota_status"}


@query(f"""WITH {_records_sql(_EARLY)}, c AS ({' UNION ALL '.join(f"SELECT '{s}' AS stage, {c} AS status FROM r" for s, c in _STAGES.items())}), g AS (SELECT stage, status, count(*) AS n FROM c GROUP BY 1, 2)
SELECT stage, status, n FROM g UNION ALL SELECT 'quota', 'defer_subject_quota', 0""")
def q59_stage_counts(spark, sf_dir):
    return reports.stage_counts(_records(spark, sf_dir, _EARLY), _STAGES, {"quota": ["selected_candidate", "defer_subject_quota"]})


@query(f"""WITH {MOTIONS}, s AS (SELECT {BASIC} AS status FROM m), k(status) AS (VALUES ('reject_corrupt'), ('reject_missing_field'), ('review_short'), ('basic_passed'), ('never_seen'))
SELECT k.status, count(s.status) AS n FROM k LEFT JOIN s ON s.status = k.status GROUP BY 1""")
def q60_status_counts(spark, sf_dir):
    return reports.status_counts(base.basic_status(motions(spark, sf_dir)), "status", ["reject_corrupt", "reject_missing_field", "review_short", "basic_passed", "never_seen"])


@query(f"""WITH {_TIERS}, x AS (SELECT unnest(rj) AS reason, 'r' AS k, len(rj) + len(rv) > 1 AS o FROM l UNION ALL SELECT unnest(rv), 'v', len(rj) + len(rv) > 1 FROM l)
SELECT reason, count(*) FILTER (k = 'r') AS reject_count, count(*) FILTER (k = 'v') AS review_count, count(*) FILTER (o) AS overlap_count FROM x GROUP BY 1""")
def q61_rule_statistics(spark, sf_dir):
    d, t = base._three_tier(spark, sf_dir)
    return reports.rule_statistics(d.select(t["reject_reasons"].alias("rj"), t["review_reasons"].alias("rv")), "rj", "rv")


@query(f"""WITH {_TIERS}, x AS (SELECT unnest(rj) AS reason FROM l) SELECT reason, count(*) AS n FROM x GROUP BY 1""")
def q62_reason_counts(spark, sf_dir):
    d, t = base._three_tier(spark, sf_dir)
    return reports.reason_counts(d.select(t["reject_reasons"].alias("rj")), "rj")


_IN = {"before_filter": "true", "after_heuristic": "heuristic_status = 'heuristic_passed'", "after_dedup": "heuristic_status = 'heuristic_passed' AND dedup_status = 'unique'", "final_selected": "heuristic_status = 'heuristic_passed' AND dedup_status = 'unique' AND quota_status = 'selected_candidate'"}


@query(f"""WITH {_records_sql(_LATE)}, s AS ({' UNION ALL '.join(f"SELECT '{s}' AS stage, * FROM r WHERE {c}" for s, c in _IN.items())}), g AS (SELECT stage, source, count(*) AS n, sum(n_chars / 100.0::DOUBLE) AS d FROM s GROUP BY 1, 2)
SELECT stage, source, n, round(d, 6) AS seconds, round(n / sum(n) OVER (PARTITION BY stage), 8) AS count_ratio, round(round(d, 6) / sum(d) OVER (PARTITION BY stage), 8) AS duration_ratio FROM g""")
def q63_staged_distribution(spark, sf_dir):
    r = _records(spark, sf_dir, _LATE).withColumn("seconds", F.col("n_chars") / F.lit(100.0))
    return reports.staged_distribution(r, {s: F.expr(c) for s, c in _IN.items()}, "source", "seconds")


@query(f"""WITH {MOTIONS} SELECT count(*) AS sequences, round(sum(duration), 6) AS seconds, count(quality) AS matched, count(*) - count(quality) AS unmatched, round(sum(duration * 0.65 + duration * 0.25), 6) AS allocated FROM m""")
def q64_scope_totals(spark, sf_dir):
    m = motions(spark, sf_dir).withColumn("alloc", F.create_map("lang", F.col("duration") * 0.65, F.lit("unknown"), F.col("duration") * 0.25))
    return reports.scope_totals(m, "alloc", "duration", F.col("quality").isNotNull())


@query("""WITH d AS (SELECT doc_id, [lang, source, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END] AS ls FROM documents), x AS (SELECT unnest(ls) AS label FROM d)
SELECT label, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, label LIMIT 10""")
def q65_top_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.array("lang", "source", F.expr("CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END")).alias("ls"))
    return reports.top_labels(d, "ls", 10)


@query("SELECT unnest(['R', 'C', 'A', 'M']) AS tier, unnest([count(*) FILTER (lang = 'es'), count(*) FILTER (lang = 'en' OR doc_id % 2 = 0), count(*) FILTER (lang = 'fr'), count(*) FILTER (lang = 'de' OR doc_id % 2 = 1)]) AS n FROM documents")
def q66_tier_presence(spark, sf_dir):
    policy = rules.Policy({"R": ["error", "es"], "C": ["click", "en"], "A": ["fr"], "M": ["view", "de"]})
    return reports.tier_presence(table(spark, sf_dir, "documents").select(policy.hits(F.array("lang", F.expr(_LABELS))).alias("hits")), "hits")


@query(f"""WITH {MOTIONS} SELECT count(*) AS inputs, count(*) FILTER (duration >= 5) AS selected, count(*) FILTER (duration < 5) AS rejected, round(coalesce(sum(duration) FILTER (duration >= 5), 0), 6) AS selected_seconds, round(min(duration) FILTER (duration >= 5), 6) AS min_selected, round(max(duration) FILTER (duration < 5), 6) AS max_rejected FROM m""")
def q67_duration_summary(spark, sf_dir):
    return reports.duration_summary(motions(spark, sf_dir), F.col("duration") >= 5, "duration", "fps")[0]


@query(f"WITH {MOTIONS} SELECT fps, count(*) AS n FROM m WHERE duration >= 5 GROUP BY 1")
def q68_selected_rates(spark, sf_dir):
    return reports.duration_summary(motions(spark, sf_dir), F.col("duration") >= 5, "duration", "fps")[1]


def _level(name: str, below: str, digits: int) -> str:
    return f"{name} AS (SELECT substr(p, 1, {digits}) AS p, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM (SELECT p, substr(p, 1, {digits + 1}) || '=' || d AS line FROM {below}) GROUP BY 1)"


@query(f"""WITH {MOTIONS}, s AS (SELECT doc_id::VARCHAR || '=' || sha256({BASIC}) AS line, substr(sha256(doc_id::VARCHAR), 1, 2) AS p FROM m), g2 AS (SELECT p, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM s GROUP BY 1), {_level('g1', 'g2', 1)}, {_level('g0', 'g1', 0)} SELECT d AS digest FROM g0""")
def q69_status_digest(spark, sf_dir):
    return reports.status_digest(base.basic_status(motions(spark, sf_dir)), "doc_id", "status", depth=2)


_TWO = {"static_fraction": "doc_id * 37 % 101 / 100.0", "lying_fraction": "doc_id * 53 % 97 / 130.0"}


@query(f"""WITH a AS (SELECT doc_id, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _TWO.items())} FROM documents), d AS ({' UNION ALL '.join(f"SELECT '{n}' AS metric, {n} - ({n} + (doc_id % 5 - 2) / 10.0) AS d, doc_id % 50 <> 0 AS same FROM a" for n in _TWO)})
SELECT metric, round(avg(d), 6) AS mean_signed, round(avg(abs(d)), 6) AS mean_abs, round(max(abs(d)), 6) AS max_abs, round(avg(same::INT), 6) AS agreement FROM d GROUP BY 1""")
def q70_metric_differences(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", *(F.expr(e).cast("double").alias(n) for n, e in _TWO.items()), F.lit("pass").alias("status"))
    b = a.withColumns({n: F.col(n) + (F.col("doc_id") % 5 - 2) / F.lit(10.0) for n in _TWO} | {"status": F.when(F.col("doc_id") % 50 == 0, "reject").otherwise("pass")})
    d = reports.metric_differences(a, b, "doc_id", list(_TWO), "status")
    return d.select("metric", *(R(c).alias(c) for c in ("mean_signed", "mean_abs", "max_abs", "agreement")))


@query(f"""WITH {MOTIONS} SELECT source || '/' || lang AS subject, count(*) AS n, round(sum(duration), 6) AS seconds FROM m GROUP BY 1 ORDER BY n DESC, subject LIMIT 50""")
def q71_top_by_count(spark, sf_dir):
    return reports.top_groups(motions(spark, sf_dir).withColumn("subject", F.concat_ws("/", "source", "lang")), "subject", "duration", 50, "n")


# ---- duplicates


def _pairs(spark, sf_dir) -> DataFrame:
    v = base._vectors(spark, sf_dir).withColumn("hash", (F.col("vec_id") % 50).cast("string"))
    pairs = dedup.hash_star(v, "vec_id", "hash")
    return dedup.pair_metrics(pairs, v, "vec_id", "x", "root", "duration", ("subject", "hash"))


_STAR = "p AS (SELECT min(vec_id) OVER (PARTITION BY vec_id % 50) AS a, vec_id AS b FROM embeddings)"


@query(f"WITH {_STAR} SELECT a, b FROM p WHERE a <> b")
def q72_exact_edges(spark, sf_dir):
    return dedup.exact_edges(_pairs(spark, sf_dir))


@query(f"""WITH {_STAR}, v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT p.a, p.b, u.label = w.label AS same, list_cosine_similarity(u.x, w.x) AS c, (list_distance(u.x[1:3], w.x[1:3]) + list_distance(u.x[4:6], w.x[4:6])) / 2 AS r FROM p JOIN v u ON u.vec_id = a JOIN v w ON w.vec_id = b WHERE a <> b)
SELECT a, b FROM m WHERE same AND c >= 0.05 AND r <= 0.35""")
def q73_thresholded_edges(spark, sf_dir):
    apart = _pairs(spark, sf_dir).withColumns({"hash_a": F.col("a"), "hash_b": F.col("b")})
    return dedup.exact_edges(apart, 0.05, 0.0, 0.35, 10.0)


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda e: e / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings WHERE label IS NOT NULL),
f AS (SELECT label, unnest(u) AS e, unnest(range(len(u))) AS i FROM v), c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(e) AS m FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, round(list_cosine_similarity(u, m), 6) AS centrality FROM v JOIN c USING (label)""")
def q74_centrality(spark, sf_dir):
    v = base._vectors(spark, sf_dir).where("label is not null")
    return dedup.centrality(v, "label", "vec_id", "x").select("vec_id", R("centrality").alias("centrality"))


@query("""WITH k AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY r) AS sr FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (sr > 1)::INT, r) <= 3 AS kept FROM s)
SELECT source, count(*) AS cluster_size, count(*) FILTER (kept) AS kept_count, array_to_string(list(doc_id ORDER BY r) FILTER (kept), ',') AS kept_ids FROM q GROUP BY 1""")
def q75_cluster_audit(spark, sf_dir):
    d = dedup.keep_diverse(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "lang", [F.asc("doc_id")])
    kept = dedup.cluster_audit(d, "source", "doc_id", "lang").where("kept")  # three of each
    a = kept.groupBy("source", "cluster_size", "kept_count").agg(F.array_sort(F.collect_list(F.struct("cluster_rank", "motion_id"))).alias("l"))
    return a.select("source", "cluster_size", "kept_count", F.array_join(F.transform("l", lambda m: m["motion_id"].cast("string")), ",").alias("kept_ids"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, x, list_transform(range(16), lambda j: (x[j + 1] + x[j + 17] + x[j + 33] + x[j + 49]) / 4) AS c FROM v), z AS (SELECT vec_id, list_transform(range(64), lambda i: x[i + 1] - c[i % 16 + 1]) AS z FROM m)
SELECT vec_id, round(z[1] / sqrt(list_dot_product(z, z)), 6) AS first, round(z[64] / sqrt(list_dot_product(z, z)), 6) AS last FROM z""")
def q76_centred(spark, sf_dir):
    c = base._vectors(spark, sf_dir).select("vec_id", dedup.center_and_normalise(F.col("x"), 16).alias("z"))
    return c.select("vec_id", R(F.get("z", F.lit(0))).alias("first"), R(F.get("z", F.lit(63))).alias("last"))


# ---- frames and trajectories


@query(f"WITH {_FRAMES}, n AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1), k AS (SELECT user_id, n, greatest(1, n // 2) AS k FROM n), i AS (SELECT user_id, n, k, unnest(generate_series(0, k - 1)) AS i FROM k), w AS (SELECT user_id, i AS sample_id, CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN n - 1 ELSE round_even(i * ((n - 1)::DOUBLE / (k - 1)), 0)::BIGINT END AS frame FROM i) SELECT user_id, sample_id, value FROM w JOIN f USING (user_id, frame)")
def q77_sampled_frames(spark, sf_dir):
    s = metrics.sampled(frames(spark, sf_dir), "user_id", "frame", 60.0, 30.0)
    return s.select("user_id", F.col("sample_id").cast("bigint").alias("sample_id"), "value")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), i AS (SELECT vec_id, x, unnest(range(32)) AS i FROM v), k AS (SELECT vec_id, x, i, CASE WHEN i = 31 THEN 20 ELSE round_even(i * (20 / 31.0::DOUBLE), 0)::BIGINT END AS k FROM i)
SELECT vec_id, i, round(x[3 * k + 1] - x[1], 6) + 0.0 AS dx, round(x[3 * k + 3] - x[3], 6) + 0.0 AS dz FROM k""")
def q78_root_descriptor(spark, sf_dir):
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda f: F.slice(F.col("x"), f * 3 + 1, 3))
    d = base._vectors(spark, sf_dir).select("vec_id", vectors.root_descriptor(points).alias("d"))
    at = lambda k: R(F.get("d", F.col("i") * 3 + k)) + 0.0
    return d.select("vec_id", "d", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")).select("vec_id", F.col("i").cast("bigint").alias("i"), at(0).alias("dx"), at(2).alias("dz"))


_JOINTS = {
    "root_step": "value / 10000",
    "turn_sum": "value / 1000",
    "turn_mean": "(event_id * 7 % 100) / 10000.0",
    "turn_max": "value / 300",
    "pelvis": "(event_id * 13 % 100) / 100.0",
    "head": "(event_id * 17 % 100) / 60.0",
    "wrist": "(event_id * 19 % 100) / 100.0",
    "knee": "(event_id * 23 % 100) / 100.0",
    "span": "(event_id * 29 % 100) / 100.0",
    "torso": "(event_id * 31 % 100) / 100.0",
    "knee_angle": "event_id * 37 % 180 * 1.0",
    "elbow": "150.0 + event_id * 41 % 30",
    "wrist_span": "0.5 + (event_id * 43 % 50) / 100.0",
    "wrist_drop": "(event_id * 47 % 60) / 100.0 - 0.15",
    "foot": "(event_id * 53 % 100) / 500.0",
    "ground": "0.02",
}
_LATER = ("root_step", "turn_sum", "turn_mean", "turn_max")  # null on the first frame


@query(f"""WITH {_FRAMES}, j AS (SELECT user_id, frame, {', '.join(f"({e})::DOUBLE AS {n}" if n not in _LATER else f"CASE WHEN frame > 0 THEN ({e})::DOUBLE END AS {n}" for n, e in _JOINTS.items())} FROM f),
h AS (SELECT *, coalesce(root_step * 30, lead(root_step * 30) OVER w, 0) AS rs, coalesce(turn_mean * 30, lead(turn_mean * 30) OVER w, 0) AS ms, coalesce(turn_max * 30, lead(turn_max * 30) OVER w, 0) AS xs FROM j WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
m AS (SELECT *, rs < 0.03 AND ms < 0.2 AS st, rs > 8 OR xs > 20 AS ex FROM h), c AS (SELECT *, elbow > 160 AND wrist_span > 0.65 AND wrist_drop BETWEEN -0.08 AND 0.32 AND torso > 0.7 AND st AS ca FROM m),
g AS (SELECT user_id, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM c WHERE ex), e AS (SELECT user_id, max(n) AS n FROM (SELECT user_id, g, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1)
SELECT c.user_id, round(avg(st::INT), 6) AS static_fraction, round(avg(ca::INT), 6) AS calibration_fraction, round(avg((pelvis < 0.42 AND torso > 0.7 AND knee_angle < 135)::INT), 6) AS sitting_fraction, round(avg((span < 0.55 AND torso < 0.55 AND least(pelvis, head) < 0.28)::INT), 6) AS lying_fraction,
round(avg((pelvis < 0.48 AND torso < 0.65 AND wrist < 0.3 AND knee < 0.3)::INT), 6) AS crawl_fraction, round(avg((least(pelvis, head) < 0.28)::INT), 6) AS floor_fraction, round(avg((foot > ground + 0.08)::INT), 6) AS jump_fraction, round(avg(ex::INT), 6) AS extreme_fraction,
round(coalesce(sum(root_step), 0), 6) AS path_length, round(coalesce(sum(turn_sum), 0), 6) AS joint_integral, round(coalesce(quantile_cont(root_step * 30, 0.99), 0), 6) AS root_speed_p99, round(coalesce(quantile_cont(turn_max * 30, 0.99), 0), 6) AS body_speed_p99, coalesce(any_value(e.n), 0) AS extreme_run FROM c LEFT JOIN e ON e.user_id = c.user_id GROUP BY 1""")
def q79_motion_metrics(spark, sf_dir):
    first = lambda n, e: F.when(F.col("frame") > 0, e) if n in _LATER else e
    f = frames(spark, sf_dir)
    f = f.select("user_id", "frame", *(first(n, F.expr(e).cast("double")).alias(n) for n, e in _JOINTS.items()))
    m = metrics.motion_metrics(f, "user_id", "frame", 30.0)
    return m.select("user_id", *(R(c).alias(c) for c in m.columns if c not in ("user_id", "extreme_run", "calibration_run")), "extreme_run")


@query(f"""WITH {_FRAMES}, b AS (SELECT user_id, greatest(quantile_cont(value + 1, 0.5), 1e-6) AS scale, quantile_cont(value, 0.01) AS ground FROM f GROUP BY 1)
SELECT f.user_id, frame, round((value - ground) / scale, 6) AS height FROM f JOIN b ON b.user_id = f.user_id""")
def q80_ground_heights(spark, sf_dir):
    f = frames(spark, sf_dir)
    scale = metrics.body_scale(f.withColumn("lengths", F.array(F.col("value"), F.lit(1.0))), "user_id", "lengths")
    return metrics.ground_heights(f.join(scale, "user_id"), "user_id", "value", "scale").select("user_id", "frame", R("height").alias("height"))


_TURN = "array(cos(value / 400), sin(value / 400), 0D, 0D)"


@query(f"""WITH {_FRAMES}, d AS (SELECT user_id, frame, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)) / 200 AS d FROM f) SELECT user_id, frame, round(least(d, 2 * pi() - d) * 30, 6) AS largest, round(least(d, 2 * pi() - d) * 15, 6) AS mean FROM d WHERE d IS NOT NULL""")
def q81_joint_speed(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("q", F.array(F.expr(_TURN), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))))
    f = f.withColumn("before", F.lag("q").over(metrics.by_frame("user_id", "frame"))).where("before is not null")
    largest, mean = metrics.joint_speed("q", F.col("before"), 30.0)
    return f.select("user_id", "frame", R(largest).alias("largest"), R(mean).alias("mean"))


@query(f"""WITH {_FRAMES}, g AS (SELECT user_id, frame, value, us / 1e6 AS t FROM f), n AS (SELECT user_id, frame, abs(coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value)) / 200 AS d, coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t) AS dt FROM g WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT user_id, frame, CASE WHEN dt > 0 THEN round(least(d, 2 * pi() - d) / dt, 6) ELSE 0 END AS turn FROM n""")
def q82_angular_velocity(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"q": F.expr(_TURN), "t": F.col("us") / F.lit(1e6)})
    v = f.select("user_id", "frame", trajectory.angular_velocity("q", "t", "user_id", "frame").alias("v"))
    return v.select("user_id", "frame", R(vectors.norm(F.col("v"))).alias("turn"))


@query(f"""WITH {_FRAMES}, l AS (SELECT user_id, max(frame) AS last FROM f GROUP BY 1), t AS (SELECT user_id, unnest(generate_series(0, (last * 30 // 20))) AS k FROM l), p AS (SELECT *, k * 20.0::DOUBLE / 30 AS x FROM t),
b AS (SELECT p.user_id, k, x - floor(x) AS u, a.value / 4000 AS a, c.value / 4000 AS c FROM p JOIN f a ON a.user_id = p.user_id AND a.frame = floor(x) JOIN f c ON c.user_id = p.user_id AND c.frame = ceil(x))
SELECT user_id, k AS target_frame, round(cos(a + u * (c - a)), 5) AS w FROM b""")
def q83_resampled(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("q", F.expr("array(cos(value / 4000), sin(value / 4000), 0D, 0D)"))
    r = trajectory.resampled(f, "q", "user_id", "frame", 20.0, 30.0)
    return r.select("user_id", "target_frame", R(F.get("q", F.lit(0)), 5).alias("w"))


@query(f"WITH {_FRAMES} SELECT user_id, frame, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY frame), 6) + 0.0 AS x, round(value / 2 + 0.25, 6) AS z FROM f")
def q84_root_offsets(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"x": F.col("value"), "y": -F.col("value"), "z": F.col("value") / 2})
    return trajectory.root_offsets(f, "x", "y", "z", "user_id", "frame", 0.25).select("user_id", "frame", (R("x") + 0.0).alias("x"), R("z").alias("z"))


@query(f"""WITH {_FRAMES}, g AS (SELECT *, frame + (event_id % 131 = 0)::INT AS id FROM f), c AS (SELECT user_id, 'contiguous' AS "check", count(*) FILTER (id <> frame) AS bad FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id, us) - 1 AS frame FROM g) GROUP BY 1),
s AS (SELECT user_id, 'slice' AS "check", count(*) FILTER (event_id % 53 = 0) AS bad FROM f WHERE frame % 2 = 0 GROUP BY 1) SELECT user_id, "check", bad FROM s UNION ALL SELECT user_id, 'monotone', count(*) FILTER (us <= b) FROM (SELECT user_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY frame) AS b FROM f) GROUP BY 1
UNION ALL SELECT user_id, 'unit', count(*) FILTER (event_id % 37 = 0) FROM f GROUP BY 1 UNION ALL SELECT user_id, 'contiguous', 0 FROM f GROUP BY 1""")
def q85_validate_output(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("q", F.array(F.when(F.col("event_id") % 37 == 0, 1.1).otherwise(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    half = trajectory.even_frames(f, "frame").withColumn("value", F.col("value") + (F.col("event_id") % 53 == 0).cast("int"))
    return trajectory.validate_output(f, half, "user_id", "frame", "us", ["value"], "q")


@query(f"WITH {_FRAMES} SELECT user_id, frame AS id FROM f WHERE user_id % 4 = 0 AND frame = 2 UNION ALL SELECT user_id, max(frame) + 1 FROM f WHERE user_id % 4 = 0 GROUP BY 1 HAVING max(frame) >= 2")
def q86_missing_ids(spark, sf_dir):
    moved = F.when((F.col("user_id") % 4 == 0) & (F.col("frame") == 2), F.col("last") + 1).otherwise(F.col("frame"))
    f = frames(spark, sf_dir).withColumn("last", F.max("frame").over(Window.partitionBy("user_id")))
    return trajectory.missing_ids(f.select("user_id", moved.alias("frame")), "user_id", "frame")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, sqrt(9 + l_quantity * l_quantity) AS p, l_tax * 2 AS r FROM lineitem)
SELECT l_orderkey, round(coalesce(max(p) FILTER (l_linenumber % 2 = 1), 0), 6) AS position, round(coalesce(max(r) FILTER (l_linenumber % 3 = 1), 0), 6) AS rotation FROM l GROUP BY 1""")
def q87_largest_errors(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    distance, angle = trajectory.task_errors(F.array(F.col("l_quantity"), F.lit(3.0), F.lit(0.0)), zero, F.array(F.cos("l_tax"), F.sin("l_tax"), F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    e = F.struct(distance.alias("position"), angle.alias("rotation"), (F.col("l_linenumber") % 2).alias("position_weight"), (F.col("l_linenumber") % 3 == 1).cast("int").alias("rotation_weight"))
    g = li.groupBy("l_orderkey").agg(F.collect_list(e).alias("e"))
    position, rotation = trajectory.largest_errors(F.col("e"))
    return g.select("l_orderkey", R(position).alias("position"), R(rotation).alias("rotation"))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS px, round(embedding[5]::DOUBLE, 6) AS qx, round(embedding[4]::DOUBLE, 6) AS qw, round(embedding[13]::DOUBLE, 6) AS dof, round(embedding[6]::DOUBLE, 6) AS turn, vec_id % 10 <> 0 AS whole FROM embeddings""")
def q88_split_state(spark, sf_dir):
    v = base._vectors(spark, sf_dir)
    p, q, d = trajectory.split_state(F.col("x"), [7, 12])
    _, w, _ = trajectory.split_velocity(F.col("x"), [6, 7])
    v = v.withColumns({"p": p, "q": q, "d": d, "w": w})
    broken = F.when(F.col("vec_id") % 10 == 0, F.array(F.lit(9.0), F.lit(9.0))).otherwise(F.col("d"))
    first = lambda c, k=0: R(F.get(c, F.lit(k)))
    return v.select("vec_id", first("p").alias("px"), first("q").alias("qx"), first("q", 3).alias("qw"), first("d", 1).alias("dof"), first("w", 2).alias("turn"), trajectory.reconstructs(F.col("x"), F.col("p"), F.col("q"), broken, [7, 12]).alias("whole"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(x[4] * 0.9 + (x[1] - x[4]) * 1.2 - x[8], 6) AS px, round(x[5] * 0.9 + (x[2] - x[5]) * 1.2 + x[7], 6) AS py, round(1.66 + 0.1 * x[10], 6) AS height FROM v""")
def q89_scale_and_offset(spark, sf_dir):
    x = F.col("x")
    p = trajectory.scaled_joint(F.slice(x, 1, 3), F.slice(x, 4, 3), F.lit(1.2), F.lit(0.9))
    half = F.lit(0.5**0.5)
    moved, _ = trajectory.offset_joint(F.col("p"), F.array(half, F.lit(0.0), F.lit(0.0), half), F.slice(x, 7, 3), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))  # a quarter turn about the vertical
    v = base._vectors(spark, sf_dir).withColumn("p", p).select("vec_id", moved.alias("m"), trajectory.human_height(F.slice(x, 10, 2)).alias("h"))
    return v.select("vec_id", R(F.get("m", F.lit(0))).alias("px"), R(F.get("m", F.lit(1))).alias("py"), R("h").alias("height"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS z, CASE WHEN l_linenumber <= 2 THEN 'left_foot' ELSE 'head' END AS joint FROM lineitem), g AS (SELECT l_orderkey, min(z) FILTER (joint = 'left_foot') AS low FROM l GROUP BY 1)
SELECT l_orderkey, l_linenumber, joint, round(z + coalesce(0.1 - low, 0), 6) AS z FROM l JOIN g USING (l_orderkey)""")
def q90_on_ground(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("frame"), F.when(F.col("l_linenumber") <= 2, "left_foot").otherwise("head").alias("joint"), F.col("l_quantity").alias("z"))
    return trajectory.on_ground(li, "l_orderkey", "frame", "joint", "z").select("l_orderkey", "l_linenumber", "joint", R("z").alias("z"))


@query(f"WITH {_FRAMES} SELECT user_id, count(*) AS frames, CASE WHEN user_id % 6 = 0 THEN count(*) ELSE 0 END AS wrong_rate, count(*) FILTER (event_id % 41 = 0) AS off_grid FROM f GROUP BY 1")
def q91_canonical_grid(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"t": F.col("frame") / F.lit(30.0) + (F.col("event_id") % 41 == 0).cast("int"), "fps": F.when(F.col("user_id") % 6 == 0, 60.0).otherwise(30.0)})
    return trajectory.off_grid(f, "user_id", "frame", "t", "fps")


@query("""WITH l AS (SELECT l_suppkey AS robot, l_quantity AS k, min(l_tax) AS low FROM lineitem GROUP BY 1, 2) SELECT robot::VARCHAR AS robot, count(*) + 7 AS nq, count(*) + 6 AS nv, count(*) AS dof, array_to_string(list('j' || k::INT ORDER BY k), ',') AS names, round(min(low) FILTER (k % 2 = 0), 6) AS low FROM l GROUP BY 1""")
def q92_robot_schema(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("robot"), "l_quantity").agg(F.min("l_tax").alias("low"))
    j = j.select("robot", F.concat(F.lit("j"), F.col("l_quantity").cast("int").cast("string")).alias("joint"), F.lit("hinge").alias("kind"), F.col("l_quantity").cast("int").alias("qpos_address"), (F.col("l_quantity") % 2 == 0).alias("limited"), "low", F.lit(1.0).alias("high"))
    root = j.select("robot").distinct().select("robot", F.lit("root").alias("joint"), F.lit("free").alias("kind"), F.lit(0).alias("qpos_address"), F.lit(False).alias("limited"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    s = plugins.robot_schema(j.unionByName(root))
    return s.select("robot", "nq", "nv", "dof", F.array_join("dof_names", ",").alias("names"), R(F.array_min(F.transform("limits", lambda l: l["low"]))).alias("low"))


_ROBOT = "CASE o_custkey % 7 WHEN 0 THEN 'unitree_g1' WHEN 1 THEN 'booster_t1' WHEN 2 THEN 'stanford_toddy' WHEN 3 THEN 'fourier_n1' WHEN 4 THEN 'engineai_pm01' WHEN 5 THEN 'hightorque_hi' ELSE 'unknown' END"


@query(f"""WITH r(robot, base) AS (VALUES ('unitree_g1', 'pelvis'), ('booster_t1', 'Waist'), ('stanford_toddy', 'waist_link'), ('fourier_n1', 'base_link'), ('engineai_pm01', 'LINK_BASE'), ('hightorque_hi', 'base_link')), o AS (SELECT *, {_ROBOT} AS robot FROM orders)
SELECT o.robot, base, o_orderstatus AS status, count(*) AS jobs, round(sum(o_totalprice), 2) AS value FROM o LEFT JOIN r ON r.robot = o.robot GROUP BY 1, 2, 3""")
def q93_robots(spark, sf_dir):
    """Jobs by robot, the body that carries its root, and status; robots that aren't known have no body."""
    o = table(spark, sf_dir, "orders").select(F.expr(_ROBOT).alias("robot"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    jobs = o.groupBy("robot", "status").agg(F.count("*").alias("jobs"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    return matching.lookup(jobs, plugins.robots(spark), "robot", ["base"]).select("robot", "base", "status", "jobs", "value")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(cos(x[1] + x[2] + x[3]), 6) AS w, round(sin(x[1] + x[3]), 6) AS other FROM v""")
def q94_kinematic_tree(spark, sf_dir):
    turn = lambda k: F.array(F.cos(F.get("x", F.lit(k))), F.sin(F.get("x", F.lit(k))), F.lit(0.0), F.lit(0.0))
    g = trajectory.global_rotations(F.array(turn(0), turn(1), turn(2), turn(2)), [-1, 0, 1, 0])
    v = base._vectors(spark, sf_dir).select("vec_id", g.alias("g"))
    return v.select("vec_id", R(F.col("g")[2][0]).alias("w"), R(F.col("g")[3][1]).alias("other"))


@query(f"""WITH {MOTIONS}, c AS (SELECT doc_id, n_chars, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE duration END, 0), nullif(duration / 2, 0), 0) AS s FROM m) SELECT doc_id, round(s, 6) AS seconds FROM c""")
def q95_effective_duration(spark, sf_dir):
    m = motions(spark, sf_dir).withColumn("own", F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise(F.col("duration")))
    return m.select("doc_id", R(reports.effective_duration(F.col("own"), F.col("duration") / 2)).alias("seconds"))


_GROUPS = {"quality": "vec_id * 37 % 11", "hash": "CASE WHEN vec_id % 3 = 0 THEN vec_id % 100 END", "near": "CASE WHEN vec_id % 5 <> 0 THEN vec_id % 40 END", "subject": "vec_id % 7"}


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, {', '.join(f'{e} AS {n}' for n, e in _GROUPS.items())} FROM embeddings),
e AS (SELECT *, CASE WHEN hash IS NOT NULL THEN first_value(vec_id) OVER (PARTITION BY hash ORDER BY quality DESC, vec_id) END AS best FROM v),
l AS (SELECT vec_id, quality, subject, near, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) AS u FROM e WHERE near IS NOT NULL AND (best IS NULL OR best = vec_id)),
g AS (SELECT near, count(*) AS size, 'cluster_' || substr(sha1(string_agg(vec_id::VARCHAR, chr(10) ORDER BY vec_id::VARCHAR)), 1, 12) AS cluster_id FROM l GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT near, unnest(u) AS c, unnest(range(len(u))) AS i FROM l), m AS (SELECT near, list(c ORDER BY i) AS m FROM (SELECT near, i, avg(c) AS c FROM f GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT l.*, cluster_id, size, row_number() OVER (PARTITION BY l.near ORDER BY list_cosine_similarity(u, m) DESC, quality DESC, vec_id) AS r FROM l JOIN g USING (near) JOIN m USING (near)),
s AS (SELECT *, row_number() OVER (PARTITION BY near, subject ORDER BY r) AS sr FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY near ORDER BY (sr > 1)::INT, r) <= 3 AS kept FROM s),
w AS (SELECT *, arg_min(vec_id, r) FILTER (kept) OVER (PARTITION BY near) AS rep FROM o)
SELECT e.vec_id, CASE WHEN best <> e.vec_id THEN 'defer_exact_duplicate' WHEN kept THEN 'unique_cluster_representative' WHEN NOT kept THEN 'defer_redundant_take' ELSE 'unique' END AS dedup_status,
CASE WHEN best <> e.vec_id THEN best WHEN NOT kept THEN rep END AS duplicate_of, cluster_id, size AS cluster_size, r AS cluster_rank, rep AS representative FROM e LEFT JOIN w ON w.vec_id = e.vec_id""")
def q96_resolve_duplicates(spark, sf_dir):
    v = base._vectors(spark, sf_dir).select("vec_id", "x").withColumns({n: F.expr(e) for n, e in _GROUPS.items()})
    best = dedup.resolve_exact(v, dedup.hash_star(v, "vec_id", "hash"), "vec_id", "quality").where("exact_of is null")
    d = dedup.resolve_duplicates(v, dedup.hash_star(v, "vec_id", "hash"), dedup.hash_star(best, "vec_id", "near"), "vec_id", "quality", "subject", "x")
    return d.select("vec_id", "dedup_status", "duplicate_of", "cluster_id", "cluster_size", "cluster_rank", "representative")


@query("""SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q97_lookup(spark, sf_dir):
    return matching.lookup(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


# ---- what a user asks of decided records


@query(f"""WITH {base._SWEEP}, fb AS (SELECT user_id, arg_min(event_type, event_id) AS fallback FROM events GROUP BY 1), u AS (SELECT user_id, seconds FROM al WHERE category = 'unknown'),
x AS (SELECT user_id, category, seconds FROM al WHERE category <> 'unknown' UNION ALL SELECT u.user_id, CASE WHEN u.user_id % 5 = 0 THEN 'unknown' ELSE fallback END, seconds FROM u JOIN fb USING (user_id)), g AS (SELECT user_id, category, sum(seconds) AS seconds FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seconds DESC, category) AS k, sum(seconds) OVER (PARTITION BY user_id) AS total FROM g)
SELECT user_id, category AS primary_category, round(seconds / duration, 6) AS dominance, round(total / duration, 6) AS labelled FROM r JOIN d USING (user_id) WHERE k = 1""")
def q102_fill_policy(spark, sf_dir):
    first = base.user_events(spark, sf_dir)[0].groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("fallback"))
    a = base.allocations(spark, sf_dir).join(first, "user_id").withColumn("fallback", F.when(F.col("user_id") % 5 != 0, F.col("fallback")))
    a = a.withColumn("alloc", intervals.conserved(intervals.fill_unlabeled(F.col("alloc"), "fill_with_primary_seq_label", F.col("fallback")), F.col("duration")))
    labelled = F.aggregate(F.map_values(intervals.proportions(F.col("alloc"), F.col("duration"))), F.lit(0.0), lambda s, v: s + v)
    return a.select("user_id", intervals.primary_category(F.col("alloc")).alias("primary_category"), R(intervals.dominance(F.col("alloc"), F.col("duration"))).alias("dominance"), R(labelled).alias("labelled"))


_HANDS = (["promo", "standard"], ["economy"], ["red", "blue"], ["small", "steel"])


@query(r"""WITH p AS (SELECT p_partkey, [lower(p_type)] AS ls, ' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n, p_brand FROM part),
h AS (SELECT *, list_sort(list_filter(ls, lambda x: list_contains(['promo', 'standard'], x))) AS ml, list_sort(list_filter(ls, lambda x: x = 'economy')) AS cl, list_filter(['blue', 'red'], lambda w: contains(n, ' ' || w || ' ')) AS mp, list_filter(['small', 'steel'], lambda w: contains(n, ' ' || w || ' ')) AS cp FROM p)
SELECT p_partkey, 'v1' AS g1_no_hands_policy_version, CASE WHEN len(ml) + len(mp) > 0 THEN 'rejected_manipulation_required' WHEN len(cl) + len(cp) > 0 THEN 'review_fixed_hand_gesture' ELSE 'selected_core' END AS g1_no_hands_status,
array_to_string(CASE WHEN len(ml) + len(mp) > 0 THEN list_concat(ml, list_transform(mp, lambda w: 'free_text:' || w)) ELSE list_concat(cl, list_transform(cp, lambda w: 'free_text:' || w)) END, ',') AS g1_no_hands_reasons, '/data/' || p_brand || '.npz' AS source_npz_absolute FROM h""")
def q103_decorated_records(spark, sf_dir):
    labels = F.array(normalize.normalize_label(F.col("p_type")))
    hits = normalize.phrase_hits(F.array(normalize.free_text(F.col("p_name"))), _HANDS[2] + _HANDS[3])
    names = F.create_map(*(F.lit(x) for pair in rules.HANDS.items() for x in pair))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", labels.alias("labels"), hits.alias("hits"))
    status = names[rules.hands_status(F.col("labels"), F.col("hits"), *_HANDS)]
    d = rules.decorated(p, "g1_no_hands", "v1", status, rules.hands_reasons(F.col("labels"), F.col("hits"), *_HANDS), F.concat(F.lit("/data/"), "p_brand", F.lit(".npz")))
    return d.select("p_partkey", "g1_no_hands_policy_version", "g1_no_hands_status", F.array_join("g1_no_hands_reasons", ",").alias("g1_no_hands_reasons"), "source_npz_absolute")


@query("""WITH q AS (SELECT l_orderkey, CASE WHEN max(l_discount) >= 0.09 THEN 'warning' ELSE 'passed' END AS quality_status, sum(l_quantity)::BIGINT AS f, count(*) AS h, sum(l_tax) AS t FROM lineitem GROUP BY 1),
j AS (SELECT q.*, CASE WHEN quality_status = 'passed' THEN 'generated' WHEN quality_status IS NOT NULL THEN 'generated_with_warnings' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'pending' END AS s FROM orders LEFT JOIN q ON o_orderkey = l_orderkey),
x AS (SELECT 'status' AS scope, s AS name, * FROM j UNION ALL SELECT 'quality', quality_status, * FROM j WHERE quality_status IS NOT NULL UNION ALL SELECT 'total', 'total', * FROM j)
SELECT scope, name, count(*) AS n, coalesce(sum(f) FILTER (s LIKE 'generated%'), 0)::BIGINT AS full_frames, coalesce(sum(h) FILTER (s LIKE 'generated%'), 0)::BIGINT AS half_frames, round(coalesce(sum(t) FILTER (s LIKE 'generated%'), 0)::DOUBLE, 4) AS seconds FROM x GROUP BY 1, 2""")
def q104_job_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    q = li.agg(F.when(F.max("l_discount") >= 0.09, "warning").otherwise("passed").alias("quality_status"), F.sum("l_quantity").cast("bigint").alias("full"), F.count("*").alias("half"), F.sum("l_tax").alias("took"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(q.drop("quality_status"), "o_orderkey", "left")
    jobs = reports.job_inventory(o, q.select("o_orderkey", "quality_status"), o.where("o_orderstatus = 'F'"), "o_orderkey")
    return reports.job_totals(jobs, "full", "half", "took").withColumn("seconds", R("seconds", 4))


#: A JSON text for each event, one in fifty cut off; both engines make it alike and read it back.
_ENTRY = """concat('{"', event_id, '": {"feat_p": "', event_type, '/', user_id, '", "dur": ', CASE WHEN event_id % 6 = 0 THEN 'null' WHEN event_id % 6 = 1 THEN '"long"' ELSE concat(event_id % 100, '.5') END, ', "extra": ', props,
', "seq_ann": {"labels": [{"raw_label": " Raw  ', event_type, '", "act_cat": ', CASE WHEN event_id % 3 = 0 THEN concat('["', event_type, '", "Big  Step", ""]') ELSE 'null' END, '}]}',
CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(', "frame_ann": {"labels": [{"raw_label": "", "proc_label": ', CASE WHEN event_id % 2 = 0 THEN concat('"Do ', event_type, '"') ELSE 'null' END, ', "start_t": ', event_id % 10, ', "end_t": ', CASE WHEN event_id % 4 = 1 THEN 'null' ELSE '11.25' END, '}]}') END, CASE WHEN event_id % 50 = 0 THEN '' ELSE '}}' END)"""
_SAID = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT event_id, user_id % 3 AS split, {_ENTRY} AS value FROM events), v AS (SELECT split, value, unnest(json_keys(value)) AS ann_id FROM t WHERE json_valid(value)), e AS (SELECT ann_id, split, json_extract(value, '$."' || ann_id || '"') AS e FROM v),
f AS (SELECT *, e->>'$.seq_ann.labels[0].raw_label' AS sr, (e->'$.seq_ann.labels[0].act_cat[*]') AS sa, e->>'$.frame_ann.labels[0].proc_label' AS fp, e->>'$.frame_ann.labels[0].end_t' AS ft FROM e),
w AS (SELECT *, list_filter(list_concat(list_transform(sa, lambda a: {_SAID.format("a->>'$'")}), [{_SAID.format('sr')}, {_SAID.format('fp')}]), lambda x: x IS NOT NULL AND x <> '') AS said FROM f)
SELECT ann_id, 'part' || split AS split, e->>'$.feat_p' AS feat_p, coalesce(TRY_CAST(e->>'$.dur' AS DOUBLE), 0) AS duration, array_to_string(list_sort(list_distinct(said)), ',') AS evidence, (fp IS NOT NULL AND ft IS NOT NULL)::INT AS useful, FALSE AS malformed FROM w
UNION ALL SELECT event_id::VARCHAR, 'part' || split, NULL, NULL, NULL, NULL, TRUE FROM t WHERE NOT json_valid(value)""")
def q105_annotation_entries(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("part"), F.col("user_id") % 3).alias("split"), F.expr(_ENTRY).alias("value"))
    e = files.annotation_entries(t)
    useful = F.size(files.useful_frame_labels(F.col("frame_labels")))
    rows = e.select("ann_id", "split", "feat_p", "duration", F.array_join(files.all_evidence(F.col("seq_labels"), F.col("frame_labels")), ",").alias("evidence"), useful.alias("useful"), F.lit(False).alias("malformed"))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("feat_p", "string"), ("duration", "double"), ("evidence", "string"), ("useful", "int"))]
    return rows.unionByName(files.malformed(t).select(F.col("event_id").cast("string").alias("ann_id"), "split", *none, F.lit(True).alias("malformed")))
