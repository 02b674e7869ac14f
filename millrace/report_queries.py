"""Queries over states of metrics, reports, audits, divergences and rows of points, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import divergence as D
from .functions import geometry as G
from .operators import annotations as A
from .operators import attributes as T
from .operators import efficiency as E
from .operators import metrics as M
from .operators import sequences
from .operators.metric_states import Metrics, step_parts
from .plans import packing, sampling
from .planning_queries import TOKENS, token_rows
from .queries import BOXES, WORD, line_boxes, quantise_sql, query, softmax_sql, table, words
from .record_queries import LINES, line_parameters

SAMPLES = f"""samples AS (SELECT doc_id, lang AS dataset, doc_id % 4 AS rank, doc_id // 64 AS step, doc_id // 16 % 4 AS microbatch, greatest(len(regexp_extract_all(coalesce(text, ''), '{WORD}')), 1)::BIGINT AS tokens,
  regexp_matches(text, '^[A-Z]') AS valid, NOT regexp_matches(text, '[.!?]$') AS partial, (n_chars < 500)::INT AS parsed, quality AS target FROM documents JOIN labels USING (doc_id))"""


def samples(spark, sf_dir):
    """Documents as samples: valid if they begin with a capital, partial without a mark at the end; short ones are taken for bad, their label is the target."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        "doc_id", F.col("lang").alias("dataset"), (F.col("doc_id") % 4).alias("rank"), F.floor(F.col("doc_id") / 64).alias("step"), (F.floor(F.col("doc_id") / 16) % 4).alias("microbatch"), words().alias("tokens"),
        F.col("text").rlike("^[A-Z]").alias("valid"), (~F.col("text").rlike(r"[.!?]\z")).alias("partial"), (F.col("n_chars") < 500).cast("int").alias("parsed"), F.col("quality").alias("target"), F.col("quality").cast("double").alias("loss"),
    )


WANTED = {"parse_success": ("parse_success", {}), "parse_partial_rate": ("parse_partial_rate", {}), "exact_match": ("exact_match", {}), "loss": ("weighted_mean", {}), "quality": ("mean", {"column": "target"})}


@query(f"""WITH {SAMPLES} SELECT dataset, round(avg((valid AND NOT partial)::INT), 9) AS parse_success, round(avg((valid AND partial)::INT), 9) AS parse_partial_rate, round(avg((valid AND parsed = target)::INT), 9) AS exact_match,
round(sum(target::DOUBLE * tokens) / sum(tokens), 9) AS loss, round(avg(target), 9) AS quality FROM samples GROUP BY dataset""")
def merged_metrics(spark, sf_dir):
    """Metrics of each dataset from states of ranks and microbatches, added up in two steps."""
    metrics = Metrics(WANTED)
    states = metrics.update(samples(spark, sf_dir), "dataset", "rank", "step", "microbatch")
    out = metrics.compute(metrics.merge(metrics.merge(states, "dataset", "rank"), "dataset"))
    return out.select("dataset", *(F.round(m, 9).alias(m) for m in WANTED))


@query(f"""WITH {SAMPLES} SELECT step, rank, microbatch, round(sum(target * tokens)::DOUBLE, 6) AS numerator, round(any_value(whole), 6) AS denominator, round(sum(target * tokens) / any_value(whole), 9) AS share
FROM samples JOIN (SELECT step, sum(tokens)::DOUBLE AS whole FROM samples GROUP BY step) USING (step) GROUP BY step, rank, microbatch""")
def step_losses(spark, sf_dir):
    rows = step_parts(samples(spark, sf_dir), "step", ["rank", "microbatch"], "loss", "tokens")
    return rows.select("step", "rank", "microbatch", F.round("numerator", 6).alias("numerator"), F.round("denominator", 6).alias("denominator"), F.round("share", 9).alias("share"))


FRAMES = """frames AS (SELECT event_type, event_id // 4 + 1 AS step, event_id % 4 AS rank, k % 5 + 1 AS segments, k % 2 + 1 AS packs, 100 + k AS useful_tokens, 200 AS materialized_tokens, k AS supervised_tokens, 100 + k AS length_sum, (100 + k) * (100 + k) AS length_square_sum,
  k * 3 AS vision_patches, k % 5 AS supervision_microbatches, k % 4 AS vision_microbatches, 4 AS microbatches, k / 10.0::DOUBLE AS supervision_mass, value * 0.1 AS acquire_seconds, value * 0.05 AS prepare_seconds, value * 0.7 AS step_seconds, value * 0.15 AS optimizer_seconds,
  CASE WHEN k % 3 <> 0 THEN value * 0.8 END AS device_seconds, k % 7 <> 0 AS update_applied FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
timed AS (SELECT *, acquire_seconds + prepare_seconds + coalesce(device_seconds, step_seconds + optimizer_seconds) AS critical FROM frames)"""


def frames(spark, sf_dir):
    k, v = F.get_json_object("props", "$.k").cast("long"), F.col("value")
    fields = {
        "step": F.floor(F.col("event_id") / 4) + 1, "rank": F.col("event_id") % 4, "segments": k % 5 + 1, "packs": k % 2 + 1, "useful_tokens": 100 + k, "materialized_tokens": F.lit(200).cast("long"), "supervised_tokens": k, "length_sum": 100 + k,
        "length_square_sum": (100 + k) * (100 + k), "vision_patches": k * 3, "supervision_microbatches": k % 5, "vision_microbatches": k % 4, "microbatches": F.lit(4).cast("long"), "supervision_mass": k / 10.0,
        "acquire_seconds": v * 0.1, "prepare_seconds": v * 0.05, "step_seconds": v * 0.7, "optimizer_seconds": v * 0.15, "device_seconds": F.when(k % 3 != 0, v * 0.8), "update_applied": k % 7 != 0,
    }
    return table(spark, sf_dir, "events").select("event_type", *(c.alias(n) for n, c in fields.items()))


SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in E.COUNTS)
SLOWEST = ", ".join(f"arg_max({t}, (critical, -rank)) AS {t}" for t in ("acquire_seconds", "prepare_seconds", "step_seconds", "optimizer_seconds"))


@query(f"""WITH {FRAMES},
one AS (SELECT step, {SUMS}, sum(supervision_mass) AS supervision_mass, {SLOWEST}, first(device_seconds ORDER BY critical DESC, rank) AS device_seconds, arg_max(update_applied, (critical, -rank)) AS update_applied, max(critical) AS critical FROM timed GROUP BY step),
r AS (SELECT rank, sum(critical) AS seconds FROM timed GROUP BY rank),
w AS (SELECT count(*) AS world, round(min(seconds), 6) AS rank_min_seconds, round(avg(seconds), 6) AS rank_mean_seconds, round(max(seconds), 6) AS rank_max_seconds, round((max(seconds) - min(seconds)) / avg(seconds), 9) AS rank_skew FROM r)
SELECT min(step) AS first_step, max(step) AS last_step, count(*) AS steps, {SUMS}, round(sum(supervision_mass), 6) AS supervision_mass, count(*) FILTER (WHERE update_applied) AS update_applied_steps,
round(sum(acquire_seconds), 6) AS acquire_seconds, round(sum(prepare_seconds), 6) AS prepare_seconds, round(sum(step_seconds), 6) AS step_seconds, round(sum(optimizer_seconds), 6) AS optimizer_seconds, round(sum(device_seconds), 6) AS device_seconds,
count(device_seconds) AS device_steps, round(sum(critical), 6) AS critical_seconds, round(quantile_cont(critical, 0.5), 9) AS p50_seconds, round(quantile_cont(critical, 0.95), 9) AS p95_seconds, max(step) - min(step) + 1 = count(*) AS contiguous,
round((sum(materialized_tokens) - sum(useful_tokens)) / sum(materialized_tokens), 9) AS padding_fraction, round(sum(supervised_tokens) / sum(useful_tokens), 9) AS supervision_fraction, round(sum(segments) / sum(packs), 9) AS segments_per_pack,
round(sum(useful_tokens) / sum(critical), 6) AS useful_tokens_per_second, round(sum(segments) / sum(critical), 6) AS segments_per_second, round(sum(vision_patches) / sum(critical), 6) AS vision_patches_per_second, round(sum(supervised_tokens) / sum(critical), 6) AS supervised_tokens_per_second,
round(sum(acquire_seconds) / sum(critical), 9) AS acquire_fraction, round(sum(prepare_seconds) / sum(critical), 9) AS prepare_fraction, round(sum(length_sum) / sum(segments), 9) AS mean_length,
round(sqrt(greatest(sum(length_square_sum) / sum(segments) - (sum(length_sum) / sum(segments)) ** 2, 0)), 6) AS std_length, round(sum(supervision_microbatches) / sum(microbatches), 9) AS supervision_coverage, round(sum(vision_microbatches) / sum(microbatches), 9) AS vision_coverage,
any_value(world) AS world, any_value(rank_min_seconds) AS rank_min_seconds, any_value(rank_mean_seconds) AS rank_mean_seconds, any_value(rank_max_seconds) AS rank_max_seconds, any_value(rank_skew) AS rank_skew,
(SELECT min(n) FROM (SELECT count(DISTINCT rank) AS n FROM timed GROUP BY step)) = any_value(world) AS ranks_agree
FROM one, w""")
def efficiency_report(spark, sf_dir):
    """One run of four ranks: counts over all ranks, seconds of the slowest, ratios, and how far the ranks are apart."""
    out = E.summary(frames(spark, sf_dir).withColumn("run", F.lit("all")), ["run"]).drop("run")
    six = {*E.TIMES, "supervision_mass", "critical_seconds", "std_length", "rank_min_seconds", "rank_mean_seconds", "rank_max_seconds"}
    return out.select(*(F.round(c, 6 if c in six or c.endswith("per_second") else 9).alias(c) if t == "double" else c for c, t in out.dtypes))


@query(f"""WITH {FRAMES} SELECT event_type, count(*) AS frames, count(*) FILTER (WHERE error IS NOT NULL) AS wrong, coalesce(min(error), 'none') AS error
FROM (SELECT *, CASE WHEN segments <= 0 OR packs <= 0 THEN 'empty' WHEN useful_tokens > materialized_tokens THEN 'more useful than materialized tokens' WHEN supervised_tokens > useful_tokens THEN 'more supervised than useful tokens'
WHEN greatest(supervision_microbatches, vision_microbatches) > microbatches THEN 'more covered than all microbatches' WHEN acquire_seconds < 0 THEN 'seconds' END AS error FROM timed) GROUP BY event_type""")
def frame_faults(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("error", E.frame_errors())
    return rows.groupBy("event_type").agg(F.count("*").alias("frames"), F.count("error").alias("wrong"), F.coalesce(F.min("error"), F.lit("none")).alias("error"))


TEMPERATURE = 2.0


def logit_chunks(spark, sf_dir, size: int):
    """Halves of each vector as the logits of student and teacher at a position, in chunks of ``size``."""
    at = F.explode(F.sequence(F.lit(1), F.lit(32), F.lit(size)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", at.alias("at"))
    size = F.least(F.lit(size), 33 - F.col("at"))
    return rows.select("vec_id", "label", F.slice("embedding", F.col("at"), size).alias("student"), F.slice("embedding", F.col("at") + 32, size).alias("teacher"))


DIVERGENCES = f"""v AS (SELECT vec_id, label, list_transform(embedding[1:32], lambda x: x::DOUBLE / {TEMPERATURE}) AS s, list_transform(embedding[33:64], lambda x: x::DOUBLE / {TEMPERATURE}) AS t FROM embeddings),
l AS (SELECT vec_id, label, {softmax_sql('s')} AS s, {softmax_sql('t')} AS t FROM v),
m AS (SELECT *, list_transform(list_zip(s, t), lambda z: ln((exp(z[1]) + exp(z[2])) / 2)) AS m FROM l),
d AS (SELECT vec_id, label, list_sum(list_transform(list_zip(s, t), lambda z: exp(z[1]) * (z[1] - z[2]))) AS reverse_kl, list_sum(list_transform(list_zip(t, s), lambda z: exp(z[1]) * (z[1] - z[2]))) AS forward_kl,
(list_sum(list_transform(list_zip(s, m), lambda z: exp(z[1]) * (z[1] - z[2]))) + list_sum(list_transform(list_zip(t, m), lambda z: exp(z[1]) * (z[1] - z[2])))) / 2 AS jsd FROM m)"""


@query(f"WITH {DIVERGENCES} SELECT vec_id, round(reverse_kl, 6) AS reverse_kl, round(forward_kl, 6) AS forward_kl, round(jsd, 6) AS jsd FROM d")
def chunked_divergence(spark, sf_dir):
    rows = D.chunked_divergences(logit_chunks(spark, sf_dir, 5), ["vec_id"], "student", "teacher", TEMPERATURE)
    return rows.select("vec_id", *(F.round(k, 6).alias(k) for k in ("reverse_kl", "forward_kl", "jsd")))


@query(f"WITH {DIVERGENCES} SELECT label, round(sum(jsd) * {TEMPERATURE ** 2}, 6) AS numerator, count(*) AS denominator, round(avg(jsd) * {TEMPERATURE ** 2}, 6) AS loss FROM d GROUP BY label")
def divergence_objective(spark, sf_dir):
    """The distillation loss of each label: the middle divergence over its positions."""
    rows = D.chunked_divergences(logit_chunks(spark, sf_dir, 7), ["vec_id", "label"], "student", "teacher", TEMPERATURE)
    out = D.objective_sums(rows, ["label"], "jsd", TEMPERATURE)
    return out.select("label", F.round("numerator", 6).alias("numerator"), "denominator", F.round("loss", 6).alias("loss"))


@query("""WITH r AS (SELECT event_id, user_id, event_id // 200 AS done, epoch_us(ts) / 1000000.0 AS t FROM events),
n AS (SELECT *, coalesce(lag(done) OVER (PARTITION BY user_id ORDER BY t, done) <> done, true) AS new FROM r),
o AS (SELECT *, done - first_value(done) OVER w AS dv, t - first_value(t) OVER w AS dt FROM n WINDOW w AS (PARTITION BY user_id, new ORDER BY t, done ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, CASE WHEN new THEN CASE WHEN dt > 0 AND dv > 0 THEN dv / dt ELSE 0.0 END END AS rate FROM o)
SELECT event_id, user_id, round(last_value(rate IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, done ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS rate FROM q""")
def progress_rates(spark, sf_dir):
    """Rates over the last 20 different counts that each user was seen at; a count seen again is no new observation."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"), F.floor(F.col("event_id") / 200).alias("done"))
    return M.rolling_rate(rows, "user_id", "at", "done").select("event_id", "user_id", F.round("rate", 9).alias("rate"))


@query(f"""WITH d AS (SELECT doc_id, lang, text, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
f AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n > 3000 THEN 'too long' END AS fatal FROM d),
i AS (SELECT doc_id, unnest(list_filter([CASE WHEN n < 30 THEN 'short' END, CASE WHEN NOT regexp_matches(text, '^[A-ZÀ-Þ]') THEN 'begin:no capital' END, CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 'end:no mark' END], lambda x: x IS NOT NULL)) AS code FROM f WHERE fatal IS NULL),
c AS (SELECT unnest(['lang:' || lang, 'words:' || length(n::VARCHAR) || ' digits', 'valid']) AS x FROM f WHERE fatal IS NULL)
SELECT 'rows' AS section, 'source_rows' AS code, NULL AS value, count(*) AS n, NULL AS ids FROM f UNION ALL SELECT 'rows', 'valid_rows', NULL, count(*) FILTER (WHERE fatal IS NULL), NULL FROM f UNION ALL SELECT 'rows', 'fatal_rows', NULL, count(fatal), NULL FROM f
UNION ALL SELECT 'fatal', fatal, NULL, count(*), array_to_string(list(doc_id ORDER BY doc_id)[1:20], ',') FROM f WHERE fatal IS NOT NULL GROUP BY fatal
UNION ALL SELECT 'issue', code, NULL, count(*), array_to_string(list(doc_id ORDER BY doc_id)[1:20], ',') FROM i GROUP BY code
UNION ALL SELECT 'distribution', split_part(x, ':', 1), CASE WHEN contains(x, ':') THEN x[instr(x, ':') + 1:] END, count(*), NULL FROM c GROUP BY x""")
def audit_report(spark, sf_dir):
    """Documents audited: what makes one useless, what is odd about the others, and how these are spread."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    rows = table(spark, sf_dir, "documents").withColumn("_n", n)
    some = lambda *rules: F.filter(F.array(*(F.when(c, k) for k, c in rules)), lambda x: x.isNotNull())
    issues = some(("short", F.col("_n") < 30), ("begin:no capital", ~F.col("text").rlike("^[A-ZÀ-Þ]")), ("end:no mark", ~F.col("text").rlike(r"[.!?]\z")))
    counted = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("words:"), F.length(F.col("_n").cast("string")).cast("string"), F.lit(" digits")), F.lit("valid"))
    return M.audit_report(rows, "doc_id", {"empty": F.col("_n") == 0, "too long": F.col("_n") > 3000}, issues, counted)


@query(f"""WITH {LINES} SELECT CASE WHEN m = 1 THEN 'straight_shape' WHEN m <> 0 THEN 'straight_path_multi' ELSE 'straight_path_single' END AS macro,
CASE WHEN m = 2 THEN 'round' ELSE 'none' END || '|none|solid|' || CASE WHEN p = 3 THEN 0 ELSE 1 END || '|solid|' || CASE WHEN m = 2 THEN 'True' ELSE 'missing' END || '|missing' AS stratum, count(*) AS n FROM line_rows GROUP BY ALL""")
def line_macros(spark, sf_dir):
    p = F.col("parameters")
    return T.alike(line_parameters(spark, sf_dir), "parameters").groupBy(T.line_macro(p).alias("macro"), T.line_group(p).alias("stratum")).agg(F.sum("n").alias("n"))


@query(f"""WITH {TOKENS}, w AS (SELECT doc_id, ids, len(ids) AS n, list_transform(ids, lambda x: CASE WHEN x % 7 = 0 THEN 3 ELSE 1 END) AS widths FROM tokens),
t AS (SELECT *, list_sum(widths)::BIGINT AS total, list_transform(range(1, n + 1), lambda i: coalesce(list_sum(widths[1:i - 1]), 0)::BIGINT) AS places FROM w),
f AS (SELECT *, greatest(total - 12, 0) AS gone, list_transform(list_filter(range(3, n), lambda i: ids[i] NOT IN (5, 6) AND widths[i] = 1 AND places[i] NOT IN (4, 5)), lambda i: places[i]) AS free FROM t)
SELECT doc_id, CASE WHEN len(free) >= gone THEN list_filter(range(total), lambda p: NOT list_contains(free[1:gone], p)) END AS kept, CASE WHEN len(free) < gone THEN 'too few tokens can go' END AS error FROM f""")
def kept_prefixes(spark, sf_dir):
    """Prefixes cut to 12 places: the second token up to the last but one may go, but for special ones, media and two guarded places."""
    rows = token_rows(spark, sf_dir)
    widths = F.transform("ids", lambda x: F.when(x % 7 == 0, 3).otherwise(1))
    n = F.size("ids")
    span = F.when(n > 3, F.array(F.struct(F.lit(2).alias("start"), (n - 1).alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    guarded = F.array(F.struct(F.lit(4).alias("start"), F.lit(6).alias("stop")))
    found = packing.prefix_places(F.col("ids"), widths, span, [5, 6], guarded, F.lit(12))
    return rows.select("doc_id", found.alias("x")).select("doc_id", F.transform("x.kept", lambda p: p.cast("long")).alias("kept"), "x.error")


DRAW = "(('0x' || substr(sha256('{tag}' || chr(10) || image || chr(10) || idx), 1, 16))::UBIGINT // 2048)::DOUBLE / 9007199254740992.0"


@query(f"""WITH {BOXES}, u AS (SELECT image, idx, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE AS h, {DRAW.format(tag='low')} AS a, {DRAW.format(tag='side')} AS b FROM boxes),
s AS (SELECT *, round_even(exp(ln(24) + b * (ln(96) - ln(24))), 0) AS short FROM u)
SELECT image, idx, CASE WHEN a < 0.4 AND least(w, h) > short THEN greatest(4, round_even(w * (short / least(w, h)), 0)::INTEGER) END AS width, CASE WHEN a < 0.4 AND least(w, h) > short THEN greatest(4, round_even(h * (short / least(w, h)), 0)::INTEGER) END AS height FROM s""")
def low_resolutions(spark, sf_dir):
    draw = lambda tag: sampling.unit_draw(F.lit(tag), F.col("image").cast("string"), F.col("idx").cast("string"))
    small = G.low_resolution(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 0.4, 24, 96, draw("low"), draw("side"))
    return line_boxes(spark, sf_dir).select("image", "idx", small.alias("s")).select("image", "idx", "s.width", "s.height")


POINTS = f"""p AS (SELECT image, idx, '[' || {quantise_sql('x1', 640)} || ',' || {quantise_sql('y1', 480)} || ']' AS a, '[' || {quantise_sql('x2', 640)} || ',' || {quantise_sql('y2', 480)} || ']' AS b FROM boxes)"""


@query(f"""WITH {BOXES}, {POINTS} SELECT image, idx, CASE WHEN idx % 4 <> 3 THEN '{{"keypoints_2d":[' || a || ',' || b || ']}}' END AS arrow, CASE WHEN idx % 4 = 3 THEN 'an arrow has two points or more' END AS arrow_error,
'{{"type":"line","parameters":{{"is_single":' || (idx % 2 = 1)::VARCHAR || ',"points":[' || CASE WHEN idx % 2 = 0 THEN '[' || a || ',' || b || '],[' || b || ',' || a || ']' ELSE '[' || a || ',' || b || ']' END || ']}}}}' AS line FROM p""")
def point_training_rows(spark, sf_dir):
    """Boxes' diagonals as arrows and as lines of one segment or two, every fourth arrow without its head."""
    num = lambda c: F.col(c).cast("double").cast("string")
    point = lambda x, y: F.concat(F.lit("["), num(x), F.lit(", "), num(y), F.lit("]"))
    a, b = point("x1", "y1"), point("x2", "y2")
    two = F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))
    rows = line_boxes(spark, sf_dir)
    arrows = A.point_rows(rows, "point_arrow", F.when(F.col("idx") % 4 == 3, F.concat(F.lit("["), a, F.lit("]"))).otherwise(two), 640, 480, "Where is it?")
    arrows = arrows.withColumnsRenamed({"target_text": "arrow", "error": "arrow_error"}).drop("user_prompt", "extra")
    segments = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("["), two, F.lit(", ["), b, F.lit(","), a, F.lit("], [[1, 2]]]"))).otherwise(two)
    return A.point_rows(arrows, "point_line", segments, 640, 480, "Trace it.").select("image", "idx", "arrow", "arrow_error", F.col("target_text").alias("line"))


@query(f"""WITH {SAMPLES}, m AS (SELECT dataset, count(*) AS n, avg((valid AND NOT partial)::INT) AS parse_success, avg((valid AND parsed = target)::INT) AS exact_match FROM samples GROUP BY dataset)
SELECT dataset, n, round(parse_success, 9) AS parse_success, round(exact_match, 9) AS exact_match, round(greatest(0.0, least(1.0, (exact_match - 0.1) / 0.4)), 9) AS score FROM m""")
def dataset_metrics(spark, sf_dir):
    """Two metrics of each dataset; exact matches from 0.1 to 0.5 make its score."""
    out = M.dataset_metrics(samples(spark, sf_dir), {k: M.METRICS.get(k)() for k in ("parse_success", "exact_match")}, {"exact_match": (0.1, 0.5)}, "exact_match")
    return out.select("dataset", "n", *(F.round(c, 9).alias(c) for c in ("parse_success", "exact_match", "score")))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)
SELECT o_orderkey, n FROM s ORDER BY n DESC, o_custkey, o_orderkey LIMIT (SELECT round_even(count(*) * 0.3, 0)::BIGINT FROM customer)""")
def richest_sample(spark, sf_dir):
    """The orders with the most lines, three for ten customers."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").na.fill({"n": 0})
    return sampling.richest_rows(rows, table(spark, sf_dir, "customer").count(), 0.3, "n", ["o_custkey", "o_orderkey"]).select("o_orderkey", "n")


@query(f"""WITH {BOXES}, a AS (SELECT image, idx, label, x1, idx <= 2 AS target FROM boxes),
n AS (SELECT image, idx, CASE WHEN idx = 1 THEN 'new' WHEN idx = 2 AND image % 5 = 0 THEN '' ELSE label END AS label, x1 - CASE WHEN idx = 2 THEN 100 ELSE 0 END AS x1 FROM boxes)
SELECT image, count(a.target) AS n_before, count(n.label) AS n_after, count(*) FILTER (WHERE NOT target AND (a.label <> n.label OR a.x1 <> n.x1)) AS n_changed_outside, count(*) FILTER (WHERE target AND (n.label = '' OR n.x1 < 0)) AS n_broken,
array_to_string(list_filter([CASE WHEN bool_or(target AND n.x1 < 0) THEN 'inside' END, CASE WHEN bool_or(target AND n.label = '') THEN 'labelled' END], lambda x: x IS NOT NULL), ',') AS broken, n_before = n_after AND n_changed_outside = 0 AND n_broken = 0 AS ok
FROM a JOIN n USING (image, idx) GROUP BY image""")
def target_audit(spark, sf_dir):
    """Boxes after a change of the first two of each image, which have to keep a label and lie inside."""
    before = line_boxes(spark, sf_dir).select("image", "idx", "label", "x1", (F.col("idx") <= 2).alias("target"))
    label = F.when(F.col("idx") == 1, "new").when((F.col("idx") == 2) & (F.col("image") % 5 == 0), "").otherwise(F.col("label"))
    after = before.select("image", "idx", label.alias("label"), (F.col("x1") - F.when(F.col("idx") == 2, 100).otherwise(0)).alias("x1"))
    return sequences.output_audit(before, after, "image", ["image", "idx"], ["label", "x1"], "target", {"labelled": F.col("label") != "", "inside": F.col("x1") >= 0})
