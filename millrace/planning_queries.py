"""Queries over samples, batches and evaluation: selection, token batches, scores and summaries, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import json_text, prompts
from .functions import polylines as P
from .operators import metrics as M
from .plans import mixing, packing, sampling
from .queries import BOXES, CAPACITY, PLANNER, RANKED, STREAM_DRAWS, document_draws, id_bin, line_boxes, query, table, words
from .sources.scratch import Rounds, shared_folder
from .streaming import draws

# ---------------------------------------------------------------- selection


@query("""SELECT doc_id, CASE ('0x' || substr(sha256('p:' || doc_id), 1, 15))::BIGINT % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'polite' ELSE 'terse' END AS prompt FROM documents""")
def hashed_prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sampling.hash_choice(["plain", "polite", "terse"], F.lit("p"), F.col("doc_id").cast("string")).alias("prompt"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('review:' || doc_id), doc_id) - 1 AS position FROM documents QUALIFY position < 25")
def review_sample(spark, sf_dir):
    return sampling.review_sample(table(spark, sf_dir, "documents").select("doc_id"), 25, "doc_id", "review")


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'arrow' ELSE 'line' END AS kind FROM documents), c AS (SELECT count(*) FILTER (WHERE kind = 'line') AS l, count(*) FILTER (WHERE kind = 'arrow') AS a FROM d),
q AS (SELECT 'line' AS kind, least(l, 20) AS quota FROM c UNION ALL SELECT 'arrow', least(a, 40 - least(l, 20)) FROM c)
SELECT doc_id, kind FROM (SELECT *, {RANKED.format(s='kind', seed='pilot')} AS r FROM d) JOIN q USING (kind) WHERE r <= quota""")
def pilot_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "arrow").otherwise("line").alias("kind"))
    return sampling.take_counts(rows, sampling.pilot_quotas(sampling.strata_counts(rows, "kind"), 40, "line", "arrow"), "kind", "doc_id", "pilot")


@query()
def two_level_sample(spark, sf_dir):
    """Groups by weight, their strata by size, one group kept whole."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", F.concat_ws("/", "lang", "quality").alias("stratum"))
    counts = {(r["lang"], r["stratum"]): r["n"] for r in rows.groupBy("lang", "stratum").agg(F.count("*").alias("n")).collect()}  # a row for each stratum
    sizes = {}
    for (lang, _), n in counts.items():
        sizes[lang] = sizes.get(lang, 0) + n
    rare = min(sizes, key=lambda k: (sizes[k], k))
    quotas = sampling.two_level_quotas(counts, sizes[rare] + 60, {k: float(n) ** 0.5 for k, n in sorted(sizes.items())}, {rare})
    return sampling.take_counts(rows, {s: q for (_, s), q in quotas.items()}, "stratum", "doc_id", "two")


@query("""WITH u AS (SELECT doc_id, n, -ln(greatest((('0x' || substr(sha256('w' || chr(10) || doc_id || chr(10) || n), 1, 16))::UBIGINT // 2048)::DOUBLE / 9007199254740992.0, 1e-300)) / w AS key FROM documents, (VALUES ('blur', 3.0), ('jpeg', 2.0), ('noise', 1.0)) t(n, w))
SELECT doc_id, string_agg(n, ',' ORDER BY key, n) AS operations FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY key, n) <= 2) GROUP BY doc_id""")
def drawn_operations(spark, sf_dir):
    drawn = sampling.without_replacement({"blur": 3.0, "jpeg": 2.0, "noise": 1.0, "never": 0.0}, 2, F.lit("w"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(drawn, ",").alias("operations"))


@query(f"""WITH {BOXES} SELECT CASE WHEN s < 80 THEN 'tiny' WHEN s < 120 THEN 'small' WHEN s < 160 THEN 'medium' ELSE 'large' END AS tier, CASE WHEN s < 80 THEN 0 WHEN s < 120 THEN 1 ELSE 2 END AS operations, count(*) AS n FROM (SELECT least(x2 - x1, y2 - y1) AS s FROM boxes) GROUP BY ALL""")
def degradation_plans(spark, sf_dir):
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    weights = {"blur": 2.0, "jpeg": 1.0, "noise": 1.0}
    short = F.least(x2 - x1, y2 - y1) / 80.0 * 16.0
    scaled = F.when(short < 16, short).when(short < 24, 20.0).when(short < 32, 40.0).otherwise(90.0)
    plan = sampling.degradation_plan(scaled, {"tiny": {}, "small": weights, "medium": weights, "large": weights}, {"tiny": 0, "small": 1, "medium": 2, "large": 2}, F.lit("d"), F.col("image").cast("string"), F.col("idx").cast("string"))
    return line_boxes(spark, sf_dir).select(plan.alias("p")).groupBy("p.tier", F.size("p.operations").alias("operations")).agg(F.count("*").alias("n"))


@query()
def balanced_bands(spark, sf_dir):
    bands = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4096).alias("part"), bands.alias("bands"))
    return sampling.balanced_bands(rows, "part", "doc_id", "bands", "bands")


@query("""SELECT e.event_id, coalesce(p.policy, 'as it is') AS policy FROM events e LEFT JOIN (VALUES ('click', 'short'), ('view', 'long')) p(event_type, policy) USING (event_type)""")
def source_policies(spark, sf_dir):
    """The policy of each row's kind; a kind without one passes as it is."""
    policies = spark.createDataFrame([("click", "short"), ("view", "long")], "event_type string, policy string")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type").join(policies, "event_type", "left")
    return rows.select("event_id", F.coalesce("policy", F.lit("as it is")).alias("policy"))


# ---------------------------------------------------------------- token batches


def token_rows(spark, sf_dir):
    """(doc_id, batch, ids, prefix): ids made from the document's number; some have an end id of their own."""
    n = (F.col("doc_id") * 7 % 23 + 1).cast("int")
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: (F.col("doc_id") * 31 + i) % 50 + 3)
    ids = F.when(F.col("doc_id") % 6 == 0, F.concat(ids, F.array(F.lit(2).cast("long")))).otherwise(ids)
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), ids.alias("ids"), (F.col("doc_id") % 11).alias("prefix"))


TOKENS = """tokens AS (SELECT doc_id, doc_id // 8 AS batch, doc_id % 11 AS prefix, list_concat(list_transform(range(1, doc_id * 7 % 23 + 2), lambda i: (doc_id * 31 + i) % 50 + 3), CASE WHEN doc_id % 6 = 0 THEN [2::BIGINT] ELSE []::BIGINT[] END) AS ids FROM documents)"""


@query(f"""WITH {TOKENS}, m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS most FROM tokens)
SELECT doc_id, list_concat(ids, list_transform(range(most - len(ids)), lambda i: 0::BIGINT)) AS "right", list_concat(list_transform(range(most - len(ids)), lambda i: -100::BIGINT), ids) AS "left" FROM m""")
def padded_batches(spark, sf_dir):
    rows = token_rows(spark, sf_dir).withColumns({"right": F.col("ids"), "left": F.col("ids")})
    return packing.padded(packing.padded(rows, ["batch"], "right", 0), ["batch"], "left", -100, left=True).select("doc_id", "right", "left")


@query(f"""WITH {TOKENS}, b AS (SELECT *, 20 - prefix AS budget, CASE WHEN ids[-1] <> 2 THEN 1 ELSE 0 END AS wants FROM tokens)
SELECT doc_id, CASE WHEN len(ids) + wants <= budget THEN list_concat(ids, CASE WHEN wants = 1 THEN [2::BIGINT] ELSE []::BIGINT[] END) ELSE ids[1:budget] END AS target, CASE WHEN prefix < 8 THEN prefix ELSE 7 END AS kept FROM b""")
def truncated_targets(spark, sf_dir):
    rows = token_rows(spark, sf_dir)
    return rows.select("doc_id", packing.truncated(F.col("ids"), F.col("prefix"), 20, 2).alias("target"), packing.prefix_kept(F.col("prefix"), 8).alias("kept"))


@query(f"""WITH {TOKENS} SELECT doc_id, len(ids) * 0.5 + prefix AS everything, len(ids) * 0.5 AS last_round, len(ids) * 0.5 + least(greatest(prefix - 2, 0), 3) AS standard FROM tokens""")
def loss_weights(spark, sf_dir):
    rows = token_rows(spark, sf_dir).withColumn("spans", F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("stop"))))
    total = lambda s: F.aggregate(packing.loss_weights(s, F.col("prefix"), F.size("ids"), F.col("spans"), 1.0, 0.5), F.lit(0.0), lambda a, w: a + w)
    return rows.select("doc_id", total("all").alias("everything"), total("last_round").alias("last_round"), total("default").alias("standard"))


@query(f"""WITH {TOKENS} SELECT batch, count(*) AS rows, sum(len(ids))::BIGINT AS useful_tokens, count(*) * max(len(ids)) AS materialized_tokens, sum(len(list_filter(ids[2:], lambda x: x % 5 <> 0)))::BIGINT AS supervised_tokens, sum(len(ids) * len(ids))::BIGINT AS square_sum FROM tokens GROUP BY batch""")
def batch_stats(spark, sf_dir):
    rows = token_rows(spark, sf_dir).withColumn("labels", F.transform("ids", lambda x: F.when(x % 5 == 0, -100).otherwise(x)))
    return packing.batch_stats(rows, ["batch"], "ids", "labels")


@query("""SELECT event_id, unnest(['chosen', 'rejected']) AS side, unnest([0, 1]) AS part, unnest(['c' || event_id, event_type]) AS text FROM events""")
def pair_batches(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chosen_text"), F.col("event_type").alias("rejected_text"))
    return packing.pair_rows(pairs, "event_id")


@query(f"""WITH {BOXES}, c AS (SELECT image, idx, (floor((x2 - x1) * 4 / 14) * floor((y2 - y1) * 4 / 14))::BIGINT AS patches, (image % 500)::BIGINT AS target FROM boxes)
SELECT image * 100 + idx AS draw_id, patches AS vision_patches, (100 + target + floor(patches / 4.0))::BIGINT AS llm_tokens,
CASE WHEN 100 + target + floor(patches / 4.0) > 900 THEN 'draw ' || (image * 100 + idx) || ': over the token budget' WHEN patches > 1500 THEN 'draw ' || (image * 100 + idx) || ': over the patch budget' END AS error FROM c""")
def sample_costs(spark, sf_dir):
    w, h = (F.col("x2") - F.col("x1")) * 4, (F.col("y2") - F.col("y1")) * 4
    rows = line_boxes(spark, sf_dir).select((F.col("image") * 100 + F.col("idx")).alias("draw_id"), packing.sample_cost(F.lit(100), F.col("image") % 500, w, h).alias("cost"))
    return rows.select("draw_id", "cost.vision_patches", "cost.llm_tokens", packing.cost_error(F.col("draw_id"), F.col("cost"), 900, 1500).alias("error"))


@query("""WITH s AS (SELECT event_id // 6 AS pack, event_id % 6 AS k, 10 * (event_id % 6) + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END AS start, 10 * (event_id % 6) + CASE WHEN event_id % 70 = 9 THEN 0 ELSE 10 END AS stop FROM events),
l AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY pack ORDER BY start), 0) AS before FROM s)
SELECT pack, min(CASE WHEN before <> start THEN 'not contiguous' WHEN stop <= start THEN 'empty segment' WHEN stop > 50 THEN 'over the capacity' END) AS error FROM l GROUP BY pack HAVING error IS NOT NULL""")
def layout_errors(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.floor(e / 6).alias("pack"), (10 * (e % 6) + F.when(e % 50 == 7, 1).otherwise(0)).alias("start"), (10 * (e % 6) + F.when(e % 70 == 9, 0).otherwise(10)).alias("stop"))
    return packing.check_layout(rows, ["pack"], 50)


@query()
def ranked_packs(spark, sf_dir):
    """Eight documents a step as packs of their own, dealt to four ranks."""
    rows = document_draws(spark, sf_dir).select(F.floor(F.col("draw_id") / 8).alias("step"), (F.col("draw_id") % 8).alias("pack_index"), "tokens")
    return packing.ranked_packs(rows, "step", 4, 3, 65_536)


@query()
def length_batches(spark, sf_dir):
    rows = document_draws(spark, sf_dir).withColumn("stream", F.floor(F.col("draw_id") / STREAM_DRAWS))
    return packing.length_batches(rows, "stream", 4, 2, 32)


BUDGETED = packing.Planner(world_size=4, local_limit=4, max_tokens=4 * CAPACITY, buffer_size=32, seed=42, budgets={"vision_patches": 16_384})


def costed_draws(spark, sf_dir):
    """Documents as draws with two costs: their words, and the patches of the boxes of the image of their number."""
    patches = F.floor((F.col("x2") - F.col("x1")) * 4 / 14) * F.floor((F.col("y2") - F.col("y1")) * 4 / 14)
    images = line_boxes(spark, sf_dir).groupBy(F.col("image").alias("draw_id")).agg(F.sum(patches).cast("long").alias("vision_patches"))
    rows = document_draws(spark, sf_dir).join(images, "draw_id", "left").na.fill({"vision_patches": 0})
    return rows.withColumn("stream", F.floor(F.col("draw_id") / STREAM_DRAWS))


@query()
def budgeted_microbatches(spark, sf_dir):
    return packing.planned_microbatches(costed_draws(spark, sf_dir), "stream", BUDGETED, oversize=True)


@query()
def balanced_frames(spark, sf_dir):
    """The same microbatches, dealt to ranks so that over eight steps they carry alike."""
    return packing.balanced_frames(budgeted_microbatches(spark, sf_dir), "stream", BUDGETED, 8).withColumn("skew", F.round("skew", 9))


@query()
def budgeted_ranks(spark, sf_dir):
    """Eight documents a step as packs of their own, dealt to four ranks under two caps."""
    rows = costed_draws(spark, sf_dir).withColumns({"step": F.floor(F.col("draw_id") / 8), "pack_index": F.col("draw_id") % 8})
    return packing.ranked_packs(rows, "step", 4, 3, 2 * CAPACITY, {"vision_patches": 9_000})


@query()
def streamed_microbatches(spark, sf_dir):
    """All documents, in spread order of their sources, as a stream of draws that is planned as it comes; what its log holds at the end."""
    tables = Rounds(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("tokens"))
    docs = tables.table("documents", sampling.ordinals(docs, ["source"], id_bin(), ["doc_id"], "row_index"))
    sizes = docs.groupBy("source").agg(F.count("*").alias("size")).withColumn("weight", F.col("size").cast("double"))
    sources = tables.table("sources", mixing.largest_remainders(mixing.active_sources(sizes), 512))
    length = docs.count()
    rows = mixing.spread(draws.draws(spark, length, STREAM_DRAWS), sources, 512).join(docs.hint("merge"), ["source", "row_index"])  # no broadcast, which would take the documents through the driver in each micro-batch
    rows = rows.withColumn("stream", F.floor(F.col("draw_id") / STREAM_DRAWS))
    log = draws.PlanLog(spark, f"{shared_folder(spark)}/millrace-plan-{uuid.uuid4().hex}")
    query = log.start(draws.planned(rows, "stream", PLANNER, ends=length, per_stream=STREAM_DRAWS), processingTime="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return log.planned()


# ---------------------------------------------------------------- scores and summaries


@query("""SELECT event_type AS dataset, round(avg(CASE WHEN event_id % 4 = 0 OR event_id % 6 = 0 THEN 0.0 ELSE 1.0 END), 9) AS subattr_fields FROM events GROUP BY event_type""")
def field_scores(spark, sf_dir):
    e = F.col("event_id")
    target = F.concat(F.lit('{"stroke":"'), F.col("event_type"), F.lit('","style":1}'))
    made = F.when(e % 4 == 0, '{"stroke":"other","style":1}').when(e % 6 == 0, F.concat(F.lit('{"stroke":"'), F.col("event_type"), F.lit('"}'))).otherwise(F.concat(F.lit('{"style":1, "stroke":" '), F.col("event_type"), F.lit(' "}')))
    rows = json_text.decode(table(spark, sf_dir, "events").select("event_type", "event_id", target.alias("whole"), made.alias("made")), F.col("made"), "d", "json_object")
    score = M.subattr_fields(json_text.comparable(F.col("d.parsed")), F.col("whole"), ["stroke", "style"])
    return rows.groupBy(F.col("event_type").alias("dataset")).agg(F.round(F.avg(F.when(F.col("d.valid"), score).otherwise(0.0)), 9).alias("subattr_fields"))


KEYPOINTS = """k AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


@query(f"""WITH {KEYPOINTS} SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE (1 + (k <= 49)::INT) / 2.0 END, 9) AS codes, round(CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE (1 + (k * k <= (0.05 * 640) ** 2)::INT) / 2.0 END, 9) AS image FROM k""")
def keypoint_scores(spark, sf_dir):
    """Two points, one of them off by k, under three names and as flat or nested lists; every fifth lacks a point."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    flat = F.concat(F.lit("[[10,20],["), (300 + k).cast("string"), F.lit(",40]]"))
    points = F.when(e % 5 == 0, "[[10,20]]").when(e % 2 == 0, flat).otherwise(F.concat(F.lit("["), flat, F.lit("]")))
    made = F.when(e % 3 == 0, F.concat(F.lit('{"points_2d":'), points, F.lit("}"))).when(e % 3 == 1, F.concat(F.lit('{"keypoints_2d":'), points, F.lit("}"))).otherwise(F.concat(F.lit('{"parameters":{"points":'), points, F.lit("}}")))
    short = F.when((e % 5 == 0) & (e % 2 == 1), F.lit(None)).otherwise(made)
    found, target = P.keypoints(short), P.keypoints(F.lit('{"points_2d":[[10,20],[300,40]]}'))
    rows = table(spark, sf_dir, "events").select("event_id", found.alias("a"), target.alias("b"))
    return rows.select("event_id", F.round(M.keypoint_share(F.col("a"), F.col("b"), 0.05, "codes"), 9).alias("codes"), F.round(M.keypoint_share(F.col("a"), F.col("b"), 0.05, "image", F.lit(640.0), F.lit(480.0)), 9).alias("image"))


@query("""SELECT event_id, (event_id % 4 <> 0)::INT::DOUBLE AS parse_success, (event_id % 4 <> 0 AND event_id % 3 <> 0)::INT::DOUBLE AS exact_match, 2.0 * (event_id % 4 <> 0)::INT + (event_id % 4 <> 0 AND event_id % 3 <> 0)::INT AS total FROM events""")
def reward_values(spark, sf_dir):
    """Rewards bound to a codec and weights: a partial or unlike prediction gets nothing for a match."""
    e = F.col("event_id")
    made = F.when(e % 4 == 0, '{"a":[1, 2').when(e % 3 == 0, '{"a":[1,3]}').otherwise('{"a": [1, 2]} ')
    rows = json_text.decode(table(spark, sf_dir, "events").select("event_id", made.alias("made")), F.col("made"), "d", "json_object")
    rows = rows.select("event_id", "d.valid", "d.partial", json_text.comparable(F.col("d.parsed")).alias("parsed"), json_text.comparable(json_text.canonical(F.lit('{"a":[1,2]}'))).alias("target"))
    made = M.reward_columns([{"name": "parse_success", "weight": 2.0}, {"name": "exact_match"}])
    return rows.select("event_id", *(c.alias(n) for n, c in made.items()))


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS prediction FROM events)
SELECT 'total' AS field, 'records' AS value, count(*) AS n FROM r UNION ALL SELECT 'total', 'parse_failed', count(*) FILTER (WHERE prediction IS NULL) FROM r UNION ALL SELECT 'total', 'unique_success', count(DISTINCT user_id) FILTER (WHERE prediction IS NOT NULL) FROM r
UNION ALL SELECT 'distribution', coalesce(prediction, 'parse_failed'), count(*) FROM r GROUP BY ALL""")
def result_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("prediction"))
    return M.result_summary(rows, "prediction", "prediction", "user_id", "event_id")


@query(f"""WITH {BOXES} SELECT 'total' AS field, 'images' AS value, count(DISTINCT image) AS n FROM boxes UNION ALL SELECT 'total', 'target_images', count(DISTINCT image) FILTER (WHERE label IN ('A', 'N')) FROM boxes
UNION ALL SELECT 'total', 'target_instances', count(*) FILTER (WHERE label IN ('A', 'N')) FROM boxes UNION ALL SELECT 'label', label, count(*) FROM boxes GROUP BY label""")
def scan_summary(spark, sf_dir):
    return M.scan_summary(line_boxes(spark, sf_dir), ["A", "N"])


@query("""WITH s AS (SELECT lang AS dataset, sum(quality::DOUBLE * n_chars) / sum(n_chars) AS loss FROM documents JOIN labels USING (doc_id) GROUP BY lang), w AS (SELECT 'en' AS dataset, 0.6 AS weight UNION ALL SELECT 'fr', 0.4 UNION ALL SELECT 'xx', 3.0)
SELECT round(sum(loss * weight) / sum(weight), 9) AS final_loss, count(*) AS datasets FROM s JOIN w USING (dataset)""")
def final_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("dataset"), F.col("quality").cast("double").alias("loss"), "n_chars")
    weights = spark.createDataFrame([("en", 0.6), ("fr", 0.4), ("xx", 3.0)], "dataset string, weight double")
    return M.final_loss(rows, weights, "loss", "n_chars").withColumn("final_loss", F.round("final_loss", 9))


ARGUMENTS = {"event_type": {"type": "enum", "values": ["click", "view"]}, "k": {"type": "integer"}}
TEMPLATE = "{{ event_type }} had {{ k | json }}"


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","k":' || json_extract(props, '$.k')::VARCHAR || '}') AS args_sha256, sha256(event_type || ' had ' || json_extract(props, '$.k')::VARCHAR) AS rendered_sha256,
sha256('{{ event_type }} had {{ k | json }}') AS template_sha256, CASE WHEN event_id % 4 = 0 THEN 'missing: k' WHEN event_id % 5 = 0 THEN 'unexpected: more' END AS error FROM events""")
def prompt_audit(spark, sf_dir):
    checked = prompts.schema(ARGUMENTS)
    parts = prompts.compile_prompt(TEMPLATE, {k: v["type"] for k, v in checked.items()})
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = rows.withColumn("rendered", prompts.render(parts)).withColumn("args", json_text.canonical(F.to_json(F.struct("event_type", "k"))))
    names = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("event_type"))).when(F.col("event_id") % 5 == 0, F.array(F.lit("event_type"), F.lit("k"), F.lit("more"))).otherwise(F.array(F.lit("event_type"), F.lit("k")))
    rows = rows.select("event_id", prompts.audit(TEMPLATE, checked, F.col("args"), F.col("rendered")).alias("a"), prompts.argument_errors(names, checked).alias("error"))
    return rows.select("event_id", "a.args_sha256", "a.rendered_sha256", "a.template_sha256", "error")
