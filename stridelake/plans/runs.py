"""A whole selection over the driver's tables, and the same in SQL, from the matching of paths to the final statuses.

Motions are those of ``bodies``, with the header of the document of the same number; annotations are
users, whose events are the actions; paths are those of parts, changed for some annotations at some
level.  Nothing is decided by a number that stands for a status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stridelake.operators import quota, rules, selection
from stridelake.plans.bodies import FRAMES_SQL, JOINTS_SQL, METRICS_SQL, SEQ, joint_rows
from stridelake.plans.catalogue import _METRICS, _TIERS, query, table

BUDGET = quota.Budget(
    max_sec=60.0, max_count=12, tolerance=1.0, dominance=0.6,
    categories={"click": quota.Limit(min_sec=4, max_ratio=0.3, max_count=6), "error": quota.Limit(max_ratio=0.25), "unknown": quota.Limit(max_ratio=0.6, max_count=8)},
    source=quota.Limit(max_ratio=0.6, count_ratio=0.7), subject=quota.Limit(max_sec=20, max_count=3),
)
RULES = selection.Rules(
    hard=("error",), hard_seconds=4.0, soft=("view",), coverage=0.6, sit_labels=("purchase",), basic=rules.BasicLimits(max_sec=20.0, defer_max_sec=40.0), pose_limit=1.7, trans_limit=3.0,
    points=4, neighbours=3, exact={"cosine": 0.9, "ratio": 0.5, "root": 5.0, "pose": 1.0}, near={"cosine": 0.15, "ratio": 0.3, "root": 5.0}, keep=2, budget=BUDGET,
    policy=rules.Policy({"R": ["error"], "C": ["click", "purchase"], "A": ["signup"], "M": ["view"]}), label_seconds=1.0,
)
_KEYS = {"k0": "p_brand || '/' || p_type || '/' || p_name", "k1": "p_brand || '/' || p_type || '/' || p_size", "k2": "p_type || '/' || p_size", "k3": "p_type"}
_HEADER = {
    "source": "source", "subject": "lang", "duration": "n_chars / CAST(400.0 AS DOUBLE)", "fps": "CAST(CASE WHEN doc_id % 5 = 4 THEN 60.0 WHEN doc_id % 11 = 7 THEN 20.0 ELSE 30.0 END AS DOUBLE)",
    "quality": "CAST(quality AS DOUBLE)", "corrupt": "n_chars = 0", "missing": "quality IS NULL AND doc_id % 10 = 0", "invalid": "coalesce(toxic, 0) = 1",
}
_CHANGED = {"k0": "user_id % 5 = 0", "k1": "user_id % 5 < 2", "k2": "user_id % 5 < 3", "k3": "user_id % 5 < 4"}
_SPLIT = "CASE WHEN user_id % 6 = 5 THEN 'test' ELSE 'train' END"


def inputs(spark, sf_dir) -> selection.Inputs:
    seqs = table(spark, sf_dir, "embeddings").select(F.expr(SEQ).alias("motion_id")).distinct()
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("number"), *(F.expr(e).alias(k) for k, e in _KEYS.items()))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    motions = seqs.join(docs, seqs.motion_id == docs.doc_id).join(parts, seqs.motion_id == parts.number, "left").select("motion_id", *_KEYS, *(F.expr(e).alias(n) for n, e in _HEADER.items()))
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    start = (F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / F.lit(1e11)
    acts = e.select(F.col("user_id").alias("ann_id"), F.col("event_type").alias("category"), start.alias("start"), (start + F.col("value") / F.lit(50.0)).alias("end"))
    users = e.select("user_id").distinct().join(parts, F.col("user_id") == F.col("number"))
    changed = [F.when(F.expr(c), F.col(k)).otherwise(F.concat(F.col(k), F.lit("_x"))).alias(k) for k, c in _CHANGED.items()]
    return selection.Inputs(motions, users.select(F.col("user_id").alias("ann_id"), *changed, F.expr(_SPLIT).alias("split")), acts, joint_rows(spark, sf_dir).withColumnRenamed("seq", "motion_id"))


OUT = ["motion_id", "match_status", "semantic_status", "semantic_status_reason", "basic_status", "basic_status_reason", "heuristic_status", "heuristic_primary_reason", "dedup_status", "duplicate_of", "quota_status", "final_status", "final_status_reason", "policy_status", "policy_status_reason"]



# ---- the same in SQL, a stage a paragraph

_MATCH = f"""sq AS (SELECT DISTINCT seq FROM jr0), pk AS (SELECT p_partkey - 1 AS number, {', '.join(f'{e} AS {k}' for k, e in _KEYS.items())} FROM part),
mo AS (SELECT seq, {', '.join(_KEYS)}, {', '.join(f'{e} AS {n}' for n, e in _HEADER.items())} FROM sq JOIN documents ON doc_id = seq LEFT JOIN labels USING (doc_id) LEFT JOIN pk ON number = seq),
an AS (SELECT user_id AS ann_id, {', '.join(f"CASE WHEN {c} THEN {k} ELSE {k} || '_x' END AS {k}" for k, c in _CHANGED.items())}, {_SPLIT} AS split FROM (SELECT DISTINCT user_id FROM events) JOIN pk ON number = user_id),
hm AS (SELECT ann_id, {', '.join(f'list(mo.seq) FILTER (mo.{k} = an.{k}) AS h{i}' for i, k in enumerate(_KEYS))} FROM an LEFT JOIN mo ON {' OR '.join(f'mo.{k} = an.{k}' for k in _KEYS)} GROUP BY 1),
dm AS (SELECT ann_id, CASE WHEN len(hits) = 1 THEN hits[1] END AS hit, coalesce(len(hits), 0) AS n FROM (SELECT ann_id, coalesce(h0, h1, h2, h3) AS hits FROM hm)), cl AS (SELECT hit, count(*) AS n, min(ann_id) AS ann_id FROM dm WHERE hit IS NOT NULL GROUP BY 1),
ma AS (SELECT seq, CASE WHEN n = 1 THEN an.ann_id END AS ann_id, CASE WHEN n = 1 THEN split END AS split, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status FROM mo LEFT JOIN cl ON hit = seq LEFT JOIN an ON an.ann_id = cl.ann_id)"""

_SEMANTIC = f"""ev AS (SELECT user_id, event_type AS category, s, s + value / 50 AS t FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e11 AS s FROM events)),
ac AS (SELECT seq, category, greatest(s, 0.0) AS s, least(t, duration) AS t FROM ev JOIN ma ON ma.ann_id = user_id JOIN mo USING (seq) WHERE least(t, duration) > greatest(s, 0.0)),
vo AS (SELECT *, max(t) OVER (PARTITION BY seq ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM ac WHERE category IN ({', '.join(repr(c) for c in RULES.soft)})),
vg AS (SELECT *, sum(CASE WHEN hi IS NULL OR s > hi THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY s, t) AS g FROM vo), cv AS (SELECT seq, sum(n) AS c FROM (SELECT seq, g, max(t) - min(s) AS n FROM vg GROUP BY 1, 2) GROUP BY 1),
bd AS (SELECT seq, s AS x FROM ac UNION SELECT seq, t FROM ac UNION SELECT seq, 0.0 FROM mo WHERE duration > 0 UNION SELECT seq, duration FROM mo WHERE duration > 0), sg AS (SELECT seq, x AS p, lead(x) OVER (PARTITION BY seq ORDER BY x) AS q FROM bd),
ag AS (SELECT DISTINCT sg.seq, p, q, category FROM sg LEFT JOIN ac ON ac.seq = sg.seq AND ac.s <= (p + q) / 2 AND (p + q) / 2 < ac.t WHERE q IS NOT NULL),
al AS (SELECT seq, coalesce(category, 'unknown') AS category, sum((q - p) / n) AS seconds FROM (SELECT *, count(*) OVER (PARTITION BY seq, p) AS n FROM ag) GROUP BY 1, 2),
pc AS (SELECT seq, category AS c, seconds / duration AS dom FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY seconds DESC, category) AS k FROM al) JOIN mo USING (seq) WHERE k = 1),
hd AS (SELECT seq, bool_or(category IN ({', '.join(repr(c) for c in RULES.hard)}) AND t - s > {RULES.hard_seconds}) AS hard, list(DISTINCT category) FILTER (t - s >= {RULES.label_seconds}) AS labels FROM ac GROUP BY 1),
sc AS (SELECT mo.seq, match_status, split, coalesce(hd.labels, []) AS labels, coalesce(pc.c, 'unknown') AS c, coalesce(dom, 0) AS dom, coalesce(hard, FALSE) AS hard, CASE WHEN duration > 0 THEN coalesce(cv.c, 0) / duration ELSE 0 END AS covered FROM mo JOIN ma USING (seq) LEFT JOIN cv USING (seq) LEFT JOIN hd USING (seq) LEFT JOIN pc USING (seq)),
se AS (SELECT *, list_has_any(labels, {list(RULES.sit_labels)!r}) AND covered >= 0.3 AS sit, CASE WHEN match_status <> 'matched' THEN 'babel_' || match_status WHEN hard THEN 'reject_semantic_hard' WHEN covered >= {RULES.coverage} THEN 'reject_semantic_coverage' ELSE 'semantic_passed' END AS semantic_status FROM sc)"""

_B = RULES.basic
_BASIC = f"""bs AS (SELECT seq, duration, fps, CASE WHEN corrupt THEN 'reject_corrupt' WHEN missing THEN 'reject_missing_field' WHEN invalid THEN 'reject_invalid_value' WHEN duration < {_B.min_sec} THEN 'review_short' WHEN duration > {_B.defer_max_sec} THEN 'defer_very_long' WHEN duration > {_B.max_sec} THEN 'defer_long'
  WHEN fps < 30 THEN 'defer_low_fps' WHEN NOT (abs(fps / 30 - round_even(fps / 30, 0)) <= 1e-4 AND round_even(fps / 30, 0) >= 1) THEN 'defer_fps' ELSE 'basic_passed' END AS basic_status FROM mo),
ba AS (SELECT seq, basic_status, CASE basic_status WHEN 'reject_corrupt' THEN 'unreadable' WHEN 'reject_missing_field' THEN 'missing required field(s): pose' WHEN 'reject_invalid_value' THEN 'fps and arrays must be finite' WHEN 'review_short' THEN printf('duration=%.4fs, below minimum %.4fs', duration, {_B.min_sec}::DOUBLE)
  WHEN 'defer_very_long' THEN printf('duration=%.4fs, above defer limit %.4fs', duration, {_B.defer_max_sec}::DOUBLE) WHEN 'defer_long' THEN printf('duration=%.4fs, above v1 maximum %.4fs', duration, {_B.max_sec}::DOUBLE) WHEN 'defer_low_fps' THEN format('source_fps={{:.6g}}, below target_fps=30', fps)
  WHEN 'defer_fps' THEN format('source_fps={{:.6g}}, not an integer multiple of 30', fps) ELSE 'passed_v1_basic_filter' END AS basic_reason FROM bs),
mg AS (SELECT seq, max(greatest(abs(rx), abs(ry), abs(rz))) > {RULES.pose_limit} AS pose, max(greatest(abs(x), abs(y), abs(z))) FILTER (joint = 0) > {RULES.trans_limit} AS trans FROM jr0 GROUP BY 1),
hf AS (SELECT seq, CASE WHEN pose OR trans THEN 'reject_heuristic' ELSE 'heuristic_passed' END AS first_status, concat_ws('; ', CASE WHEN pose THEN 'pose_abs_max' END, CASE WHEN trans THEN 'trans_abs_max' END) AS first_reason FROM mg)"""

_METRIC = f"""po0 AS (SELECT mo.* FROM mo JOIN se USING (seq) JOIN ba USING (seq) JOIN hf USING (seq) WHERE first_status = 'heuristic_passed' AND semantic_status IN ('semantic_passed', 'babel_unmatched', 'babel_ambiguous') AND basic_status = 'basic_passed'),
fc AS (SELECT seq, any_value(fps) AS fps, count(*) AS n, greatest(1, count(*) // greatest(1, floor(any_value(fps) / 30)::BIGINT)) AS k FROM jr0 JOIN po0 USING (seq) WHERE joint = 0 GROUP BY 1),
tk AS (SELECT seq, i AS sample, CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN n - 1 ELSE round_even(i * ((n - 1)::DOUBLE / (k - 1)), 0)::BIGINT END AS frame FROM (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM fc)),
jr AS MATERIALIZED (SELECT jr0.seq, sample AS frame, joint, x, y, z, rx, ry, rz FROM jr0 JOIN tk ON tk.seq = jr0.seq AND tk.frame = jr0.frame), rate AS (SELECT seq, CASE WHEN fps > 30 THEN k / n * fps ELSE fps END AS fps FROM fc),
{FRAMES_SQL}, {METRICS_SQL}, th AS (SELECT quantile_cont(joint_integral, 0.05) AS j FROM mt),
k AS (SELECT mt.*, mt.seq AS doc_id, 'sit' AS soft, sit::INT AS soft_coverage, '' AS lang FROM mt JOIN se USING (seq)), {_TIERS.removeprefix(f'{_METRICS}, ').strip()},
dc AS (SELECT doc_id AS seq, CASE WHEN len(rj) > 0 THEN 'reject_heuristic_high_confidence' WHEN len(rv) > 0 THEN 'review_heuristic' ELSE 'heuristic_passed' END AS heuristic_status, CASE WHEN len(rj) > 0 THEN rj[1] WHEN len(rv) > 1 THEN 'review_multiple_heuristics' WHEN len(rv) = 1 THEN rv[1] ELSE 'heuristic_passed' END AS primary_reason, array_to_string(list_concat(rj, rv), '; ') AS all_reasons FROM l)"""

_P = RULES.points
_W = 63
_DEDUP = f"""pa AS (SELECT po0.* FROM po0 JOIN dc USING (seq) WHERE heuristic_status = 'heuristic_passed'), nf AS (SELECT seq, max(frame) + 1 AS n FROM jr JOIN pa USING (seq) GROUP BY 1),
wt AS (SELECT seq, i, CASE WHEN i = {_P - 1} THEN n - 1 ELSE round_even(i * ((n - 1) / {_P - 1}.0::DOUBLE), 0)::BIGINT END AS frame FROM (SELECT *, unnest(range({_P})) AS i FROM nf)),
px AS (SELECT seq, list(v ORDER BY i, joint, axis) AS x FROM (SELECT wt.seq, i, joint, unnest([rx, ry, rz]) AS v, unnest([0, 1, 2]) AS axis FROM wt JOIN jr ON jr.seq = wt.seq AND jr.frame = wt.frame WHERE joint > 0) GROUP BY 1),
rx AS (SELECT seq, list(x ORDER BY i) AS ax, list(y ORDER BY i) AS ay, list(z ORDER BY i) AS az FROM wt JOIN jr USING (seq, frame) WHERE joint = 0 GROUP BY 1),
cx AS (SELECT seq, x, list_transform(range({_W}), lambda j: ({' + '.join(f'x[j + {1 + _W * f}]' for f in range(_P))}) / {_P}) AS c FROM px), zx AS (SELECT seq, x, list_transform(range({_W * _P}), lambda i: x[i + 1] - c[i % {_W} + 1]) AS z FROM cx),
ux AS (SELECT pa.*, x, ax, ay, az, CASE WHEN list_dot_product(z, z) > 0 THEN list_transform(z, lambda v: v / sqrt(list_dot_product(z, z))) END AS u, list_transform(x, lambda v: round_even(v / 1e-9, 0)::BIGINT) AS h FROM pa JOIN zx USING (seq) JOIN rx USING (seq)),
nn AS (SELECT i, j FROM (SELECT p.seq AS i, q.seq AS j, row_number() OVER (PARTITION BY p.seq ORDER BY list_cosine_similarity(p.u, q.u) DESC, q.seq) AS r FROM ux p JOIN ux q ON p.seq <> q.seq WHERE p.u IS NOT NULL AND q.u IS NOT NULL) WHERE r <= {RULES.neighbours}),
pp AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM (SELECT * FROM nn UNION ALL SELECT min(seq) OVER (PARTITION BY h), seq FROM ux) WHERE i <> j),
pm AS (SELECT a, b, list_cosine_similarity(p.u, q.u) AS cosine, list_distance(p.u, q.u) / sqrt({_W * _P}) AS rms, least(p.duration, q.duration) / greatest(p.duration, q.duration) AS ratio, p.h = q.h AS same, p.source = q.source AND p.subject = q.subject AS who,
  list_sum(list_transform(range({_P}), lambda i: sqrt(((p.ax[i + 1] - p.ax[1]) - (q.ax[i + 1] - q.ax[1])) ** 2 + ((p.ay[i + 1] - p.ay[1]) - (q.ay[i + 1] - q.ay[1])) ** 2 + ((p.az[i + 1] - p.az[1]) - (q.az[i + 1] - q.az[1])) ** 2))) / {_P} AS away FROM pp JOIN ux p ON p.seq = a JOIN ux q ON q.seq = b),
xe AS (SELECT a, b FROM pm WHERE same OR (who AND cosine >= {RULES.exact['cosine']} AND ratio >= {RULES.exact['ratio']} AND away <= {RULES.exact['root']} AND rms <= {RULES.exact['pose']})),
xs AS (SELECT a, b FROM xe UNION SELECT b, a FROM xe), xr AS (SELECT a AS n, b AS m FROM xs UNION SELECT xr.n, xs.b FROM xr JOIN xs ON xr.m = xs.a), xc AS (SELECT seq, least(seq, coalesce(min(m), seq)) AS comp FROM ux LEFT JOIN xr ON n = seq GROUP BY 1),
xb AS (SELECT seq, first_value(seq) OVER (PARTITION BY comp ORDER BY coalesce(quality, 0) DESC, seq) AS best FROM xc JOIN ux USING (seq)), lv AS (SELECT ux.* FROM ux JOIN xb USING (seq) WHERE best = seq),
ne AS (SELECT a, b FROM pm SEMI JOIN lv p ON p.seq = a SEMI JOIN lv q ON q.seq = b WHERE cosine >= {RULES.near['cosine']} AND ratio >= {RULES.near['ratio']} AND away <= {RULES.near['root']}),
ns AS (SELECT a, b FROM ne UNION SELECT b, a FROM ne), nr AS (SELECT a AS n, b AS m FROM ns UNION SELECT nr.n, ns.b FROM nr JOIN ns ON nr.m = ns.a), nc AS (SELECT seq, least(seq, coalesce(min(m), seq)) AS comp FROM lv LEFT JOIN nr ON n = seq GROUP BY 1),
ng AS (SELECT comp FROM nc GROUP BY 1 HAVING count(*) > 1), nm AS (SELECT comp, list(v ORDER BY i) AS m FROM (SELECT comp, i, avg(v) AS v FROM (SELECT comp, unnest(u) AS v, unnest(range({_W * _P})) AS i FROM nc JOIN lv USING (seq) SEMI JOIN ng USING (comp)) GROUP BY 1, 2) GROUP BY 1),
nk AS (SELECT seq, comp, source || '/' || subject AS who, row_number() OVER (PARTITION BY comp ORDER BY coalesce(list_cosine_similarity(u, m), 0) DESC, coalesce(quality, 0) DESC, seq) AS r FROM nc JOIN lv USING (seq) JOIN nm USING (comp)),
no AS (SELECT *, row_number() OVER (PARTITION BY comp, who ORDER BY r) AS sr FROM nk), np AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY (sr > 1)::INT, r) <= {RULES.keep} AS kept FROM no), nq AS (SELECT *, arg_min(seq, r) FILTER (kept) OVER (PARTITION BY comp) AS rep FROM np),
dd AS (SELECT xb.seq, CASE WHEN best <> xb.seq THEN 'defer_exact_duplicate' WHEN kept THEN 'unique_cluster_representative' WHEN NOT kept THEN 'defer_redundant_take' ELSE 'unique' END AS dedup_status, CASE WHEN best <> xb.seq THEN best WHEN NOT kept THEN rep END AS duplicate_of FROM xb LEFT JOIN nq ON nq.seq = xb.seq)"""


def _seconds(limit: quota.Limit) -> float | None:
    given = [x for x in (limit.max_sec, None if limit.max_ratio is None else limit.max_ratio * BUDGET.max_sec) if x is not None]
    return min(given) if given else None


def _refusal() -> str:
    """Why a candidate ``p`` can't be accepted in the state ``st``, by the figures of ``BUDGET``."""
    checks = []
    for c, limit in sorted(BUDGET.categories.items()):
        if _seconds(limit) is not None:
            checks.append(f"WHEN p.c = '{c}' AND p.dom >= {BUDGET.dominance} AND st.s_{c} + p.a_{c} > {_seconds(limit) + BUDGET.tolerance} THEN 'category_duration'")
        if limit.max_count is not None:
            checks.append(f"WHEN p.c = '{c}' AND st.n_{c} + 1 > {limit.max_count} THEN 'category_count'")
    checks.append(f"WHEN coalesce(st.src[p.so].s, 0) + p.d > {BUDGET.source.max_ratio}::DOUBLE * st.bs THEN 'source_duration'")
    checks.append(f"WHEN coalesce(st.src[p.so].n, 0) + 1 > floor({BUDGET.source.count_ratio}::DOUBLE * st.bn) THEN 'source_count'")
    checks.append(f"WHEN coalesce(st.sub[p.who].s, 0) + p.d > {BUDGET.subject.max_sec} THEN 'subject_duration'")
    checks.append(f"WHEN coalesce(st.sub[p.who].n, 0) + 1 > {BUDGET.subject.max_count} THEN 'subject_count'")
    checks += [f"WHEN st.n + 1 > {BUDGET.max_count} THEN 'global_count'", f"WHEN st.sec + p.d > {BUDGET.max_sec + BUDGET.tolerance} THEN 'global_duration'"]
    return f"CASE {' '.join(checks)} END"


def _budgeted(x: str, pool: str) -> str:
    """``{x}qs`` with the quota's status and reason of the motions of ``pool``: rounds of passes until the achieved bases stay."""
    cats = sorted(BUDGET.categories)
    minima = sorted((l.min_sec, c) for c, l in BUDGET.categories.items() if l.min_sec > 0)
    passes = [f"SELECT {k} AS phase, '{c}' AS goal, {low}::DOUBLE AS low, row_number() OVER (ORDER BY -a_{c}, -score, id) AS place, * FROM {x}pl WHERE a_{c} > 0" for k, (low, c) in enumerate(minima)]
    passes.append(f"SELECT {len(minima)}, NULL, NULL, row_number() OVER (ORDER BY -score, id), * FROM {x}pl")
    used = " ".join(f"WHEN '{c}' THEN st.s_{c}" for c in cats)
    empty = "MAP([]::VARCHAR[], []::STRUCT(s DOUBLE, n INT)[])"
    zeros = ", ".join(f"0.0::DOUBLE AS s_{c}, 0 AS n_{c}" for c in cats)
    grown = lambda m, k: f"CASE WHEN ended THEN {empty} WHEN ok THEN map_concat({m}, MAP([{k}], [{{'s': coalesce({m}[{k}].s, 0) + d, 'n': (coalesce({m}[{k}].n, 0) + 1)::INT}}])) ELSE {m} END"
    sums = ", ".join(f"CASE WHEN ended THEN 0 WHEN ok THEN s_{c} + coalesce(a_{c}, 0) ELSE s_{c} END, CASE WHEN ended THEN 0 ELSE n_{c} + (ok AND c = '{c}')::INT END" for c in cats)
    names = {"category": "defer_category_quota", "source": "defer_source_quota", "subject": "defer_subject_quota", "global": "defer_global_budget"}
    return f"""{x}al AS (SELECT al.* FROM al SEMI JOIN {pool} USING (seq)), {x}pc AS (SELECT category, sum(seconds) AS pool FROM {x}al GROUP BY 1), {x}ps AS (SELECT source, sum(duration) AS pool FROM {pool} GROUP BY 1),
{x}sh AS (SELECT seq, sum(share / sqrt(pool + 1)) AS rare, -sum(share * ln(share + 1e-12)) AS h, {', '.join(f"sum(seconds) FILTER (category = '{c}') AS a_{c}" for c in cats)} FROM (SELECT *, seconds / duration AS share FROM {x}al JOIN {pool} USING (seq)) JOIN {x}pc USING (category) GROUP BY 1),
{x}pl AS (SELECT o.seq AS id, se.c, se.dom, o.source AS so, o.source || '/' || o.subject AS who, o.duration AS d, {', '.join(f'a_{c}' for c in cats)}, round(coalesce(nullif(o.quality, 0), 1) + coalesce(rare, 0) + 0.3 * coalesce(h, 0) + 1 / sqrt(ps.pool + 1), 10) AS score FROM {pool} o JOIN se USING (seq) LEFT JOIN {x}sh USING (seq) JOIN {x}ps ps ON ps.source = o.source),
{x}pp AS ({' UNION ALL '.join(passes)}), {x}p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY phase, place) AS k, * FROM {x}pp),
{x}st AS (SELECT 0 AS r, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::VARCHAR AS goal, FALSE AS tried, NULL::VARCHAR AS refused, 0 AS n, 0.0::DOUBLE AS sec, {BUDGET.max_sec}::DOUBLE AS bs, {BUDGET.max_count}::DOUBLE AS bn, {zeros}, []::BIGINT[] AS early, {empty} AS src, {empty} AS sub
  UNION ALL SELECT r + ended::INT, coalesce(k, 0), id, goal, coalesce(tried, FALSE), refused, CASE WHEN ended THEN 0 ELSE n + ok::INT END, CASE WHEN ended THEN 0 WHEN ok THEN sec + d ELSE sec END,
    CASE WHEN ended THEN least(bs, sec) ELSE bs END, CASE WHEN ended THEN least(bn, n) ELSE bn END, {sums}, CASE WHEN ended THEN [] WHEN ok AND goal IS NOT NULL THEN list_append(early, id) ELSE early END, {grown('src', 'so')}, {grown('sub', 'who')}
  FROM (SELECT *, coalesce(tried AND refused IS NULL, FALSE) AS ok FROM (SELECT st.r, p.k, p.k IS NULL AS ended, p.id, p.goal, p.c, p.so, p.who, p.d, st.n, st.sec, st.bs, st.bn, st.early, st.src, st.sub, {", ".join(f"st.s_{c}, st.n_{c}, p.a_{c}" for c in cats)},
    NOT list_contains(st.early, p.id) AND (p.goal IS NULL OR CASE p.goal {used} END < p.low) AS tried, {_refusal()} AS refused FROM {x}st st LEFT JOIN {x}p p ON p.k = st.k + 1))
  WHERE NOT (ended AND abs(least(bs, sec) - bs) <= 1e-9 AND least(bn, n) = bn)),
{x}qs AS (SELECT id AS seq, CASE WHEN refused IS NULL THEN 'selected_candidate' ELSE CASE split_part(refused, '_', 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} END END AS quota_status, coalesce(refused, 'minimum_' || goal, 'score') AS quota_reason
  FROM {x}st WHERE tried AND (refused IS NULL OR goal IS NULL) AND r = (SELECT max(r) FROM {x}st))"""


_TIER = lambda t: "[" + ", ".join(repr(x) for x in RULES.policy.tiers[t]) + "]"
_DECIDED = "heuristic_status IN ('reject_heuristic_high_confidence', 'review_heuristic')"
_FINAL = f"""pu AS (SELECT pa.* FROM pa JOIN dd USING (seq) WHERE dedup_status IN ('unique', 'unique_cluster_representative')), {_budgeted('a', 'pu')},
rc AS (SELECT mo.*, match_status, semantic_status, CASE WHEN semantic_status = 'reject_semantic_coverage' THEN printf('coverage=%.4f', covered) ELSE semantic_status END AS semantic_reason, basic_status, basic_reason, split, labels, dedup_status, duplicate_of, quota_status, quota_reason,
  CASE WHEN heuristic_status IS NULL AND first_status <> 'heuristic_passed' THEN 'reject_heuristic_high_confidence' ELSE heuristic_status END AS heuristic_status, CASE WHEN heuristic_status IS NULL AND first_status <> 'heuristic_passed' THEN first_status ELSE primary_reason END AS primary_reason, CASE WHEN heuristic_status IS NULL AND first_status <> 'heuristic_passed' THEN first_reason ELSE all_reasons END AS all_reasons
  FROM mo JOIN se USING (seq) JOIN ba USING (seq) JOIN hf USING (seq) LEFT JOIN dc USING (seq) LEFT JOIN dd USING (seq) LEFT JOIN aqs USING (seq)),
fi AS (SELECT *, CASE WHEN semantic_status LIKE 'reject_semantic%' THEN semantic_status WHEN basic_status <> 'basic_passed' THEN basic_status WHEN {_DECIDED} THEN primary_reason WHEN dedup_status LIKE 'defer%' THEN dedup_status ELSE quota_status END AS final_status,
  CASE WHEN semantic_status LIKE 'reject_semantic%' THEN semantic_reason WHEN basic_status <> 'basic_passed' THEN basic_reason WHEN {_DECIDED} THEN all_reasons WHEN dedup_status LIKE 'defer%' THEN dedup_status || ' of ' || duplicate_of ELSE quota_reason END AS final_reason FROM rc),
co AS (SELECT *, CASE WHEN split IN ('train', 'val') AND list_has_any(labels, {_TIER('R')}) THEN 'reject_semantic_any_occurrence' WHEN split IN ('train', 'val') AND list_has_any(labels, list_concat({_TIER('A')}, {_TIER('C')})) THEN 'semantic_core_eligible' ELSE 'semantic_unverified' END AS core FROM fi),
pv AS (SELECT * FROM co WHERE final_status = 'selected_candidate' AND core = 'semantic_core_eligible'), {_budgeted('b', 'pv')},
done AS (SELECT co.*, CASE WHEN final_status <> 'selected_candidate' THEN 'defer_not_in_v3_candidate' WHEN core <> 'semantic_core_eligible' THEN core ELSE bqs.quota_status END AS policy_status,
  CASE WHEN final_status <> 'selected_candidate' THEN 'not selected by frozen V3 candidate set' WHEN core <> 'semantic_core_eligible' THEN 'policy: ' || core ELSE bqs.quota_reason END AS policy_reason, bqs.quota_status AS policy_quota FROM co LEFT JOIN bqs USING (seq))"""

_WHOLE = f"WITH RECURSIVE {JOINTS_SQL.replace('jr AS', 'jr0 AS', 1)}, {_MATCH}, {_SEMANTIC}, {_BASIC}, {_METRIC}, {_DEDUP}, {_FINAL}"


def _selected(spark, sf_dir) -> tuple[selection.Run, DataFrame]:
    run = selection.Run(spark, "selection", tuple(f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings", "events", "labels", "part")))
    done = selection.select(run, inputs(spark, sf_dir), RULES)
    run.finish()
    return run, done


@query(_WHOLE + """ SELECT seq AS motion_id, match_status, semantic_status, semantic_reason AS semantic_status_reason, basic_status, basic_reason AS basic_status_reason, heuristic_status, primary_reason AS heuristic_primary_reason, dedup_status, duplicate_of, quota_status, final_status, final_reason AS final_status_reason, policy_status, policy_reason AS policy_status_reason FROM done""")
def q100_selection_run(spark, sf_dir):
    return _selected(spark, sf_dir)[1].select(*OUT)


def _among(column: str, *values: str) -> dict[str, str]:
    return {v: f"{column} = '{v}'" for v in values}


#: The table of each stage, and conditions of its counters.
_COUNTERS = [
    ("motions", "mo", {}),
    ("match", "(SELECT dm.*, claims FROM dm LEFT JOIN (SELECT hit, count(*) AS claims FROM dm GROUP BY 1) USING (hit))", {"matched": "claims = 1", "unmatched": "n = 0", "ambiguous": "n > 1", "ambiguous_local_conflict": "n = 1 AND claims > 1"}),
    ("motion_match", "ma", _among("match_status", "matched", "ambiguous", "unmatched")),
    ("actions", "ac", {}),
    ("semantic", "se", _among("semantic_status", "reject_semantic_hard", "reject_semantic_coverage", "semantic_passed", "babel_unmatched", "babel_ambiguous")),
    ("basic", "ba", _among("basic_status", "basic_passed")),
    ("magnitudes", "hf", _among("first_status", "heuristic_passed")),
    ("records", "mo", {}),
    ("sampled", "tk", {}),
    ("metrics", "mt", {}),
    ("decisions", "dc", _among("heuristic_status", "heuristic_passed", "review_heuristic", "reject_heuristic_high_confidence")),
    ("descriptors", "ux", {}),
    ("pairs", "pm", {}),
    ("dedup", "dd", _among("dedup_status", "unique", "unique_cluster_representative", "defer_exact_duplicate", "defer_redundant_take")),
    ("quota", "aqs", _among("quota_status", "selected_candidate")),
    ("final", "fi", _among("final_status", "selected_candidate")),
    ("policy_quota", "bqs", _among("quota_status", "selected_candidate")),
    ("policy", "done", _among("policy_status", "selected_candidate", "defer_not_in_v3_candidate")),
]


@query(_WHOLE + " " + " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{name}' AS counter, count(*) FILTER ({c}) AS n FROM {t}" for stage, t, own in _COUNTERS for name, c in {"rows": "TRUE", **own}.items()))
def q101_run_counters(spark, sf_dir):
    return _selected(spark, sf_dir)[0].counters()
