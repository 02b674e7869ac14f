"""The registered queries of the core library, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import divergence as D
from .functions import geometry as G
from .functions import json_text, prompts
from .operators import boxes as B
from .operators import metrics as M
from .operators import sequences
from .plans import mixing, packing, sampling
from .sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def id_bin(id_col: str = "doc_id"):
    """Ranges of ids, within which rows are ordered by one task."""
    return F.floor(F.col(id_col) / 65536)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- records

CLEAN_TURNS = r"""
turns AS (
  SELECT conv_id, turn, CASE WHEN trim(lower(coalesce(role, 'user'))) = '' THEN 'user' ELSE trim(lower(coalesce(role, 'user'))) END AS role,
         regexp_replace(coalesce(text, ''), '^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS text
  FROM conversations),
ends AS (
  SELECT conv_id, max(turn) AS last, count(*) AS n_turns, arg_max(role, turn) = 'assistant' AND arg_max(text, turn) <> '' AS has_target,
         arg_max(text, turn) AS last_text, coalesce(arg_min(text, turn) FILTER (WHERE role = 'system'), '') AS system_prompt
  FROM turns GROUP BY conv_id)"""


@query(f"""WITH {CLEAN_TURNS}
SELECT e.conv_id, e.n_turns, count(*) AS n_prompt_turns, e.system_prompt, string_agg(t.role || ': ' || t.text, chr(10) ORDER BY t.turn) AS prompt, e.last_text AS target_text
FROM ends e JOIN turns t ON t.conv_id = e.conv_id AND t.turn < e.last WHERE e.has_target GROUP BY ALL""")
def sft_records(spark, sf_dir):
    rows = records.conversation_records(table(spark, sf_dir, "conversations"))
    return rows.filter("has_target AND n_prompt_turns > 0").drop("has_target")


@query(f"""WITH {CLEAN_TURNS}
SELECT e.conv_id, e.n_turns, string_agg(t.role || ': ' || t.text, chr(10) ORDER BY t.turn) AS prompt
FROM ends e JOIN turns t USING (conv_id) WHERE NOT e.has_target GROUP BY ALL""")
def prompt_only_records(spark, sf_dir):
    return records.conversation_records(table(spark, sf_dir, "conversations")).filter("NOT has_target").select("conv_id", "n_turns", "prompt")


@query("SELECT role, count(*) AS turns, sum(length(text))::BIGINT AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def role_stats(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"), F.count_distinct("conv_id").alias("conversations"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def event_props_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing")).filter("k IS NOT NULL")


@query("SELECT min(doc_id) AS doc_id, source, count(*) AS copies FROM documents GROUP BY source, text")
def dedup_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("source", F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def keep_first_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("h"))
    return records.keep_first(rows.filter("h IS NOT NULL"), ["h"], ["doc_id"]).drop("h")


@query("""SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type""")
def last_write_wins_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return records.last_write(rows, ["user_id", "event_type"], "event_id")


@query("""SELECT u.user_id, u.event_type, coalesce(p.value, u.value) AS value, p.value IS NOT NULL AS merged
FROM (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL) u
LEFT JOIN (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90 GROUP BY ALL) p USING (user_id, event_type)""")
def upsert_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    base = records.last_write(rows.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")
    news = records.last_write(rows.filter(F.get_json_object("props", "$.k").cast("long") > 90).select("user_id", "event_type", "event_id", F.col("value").alias("news")), ["user_id", "event_type"], "event_id")
    joined = base.join(news.drop("event_id"), ["user_id", "event_type"], "left")
    return joined.select("user_id", "event_type", F.coalesce("news", "value").alias("value"), F.col("news").isNotNull().alias("merged"))


@query("""SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)
AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)""")
def exclude_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    held = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("h"))
    return docs.join(toxic, "doc_id", "left_anti").join(held, "h", "left_anti").select("doc_id", "source")


@query("""SELECT a.h, a.n AS train, b.n AS val FROM (SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE doc_id % 10 < 8 GROUP BY 1) a
JOIN (SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE doc_id % 10 >= 8 GROUP BY 1) b USING (h)""")
def split_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    train = docs.filter("doc_id % 10 < 8").groupBy("h").agg(F.count("*").alias("train"))
    return train.join(docs.filter("doc_id % 10 >= 8").groupBy("h").agg(F.count("*").alias("val")), "h")


@query("""SELECT code, n, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM hits h WHERE h.code = c.code ORDER BY doc_id LIMIT 20)) AS ids FROM (
SELECT code, count(*) AS n FROM hits GROUP BY code) c""".join(["""WITH hits AS (
SELECT doc_id, 'short' AS code FROM documents WHERE n_chars < 50 UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 10000
UNION ALL SELECT doc_id, 'no_lang' FROM documents WHERE lang IS NULL OR lang = '' UNION ALL SELECT doc_id, 'has_pipe' FROM documents WHERE contains(text, '|')) """, ""]))
def error_code_audit(spark, sf_dir):
    rules = {"short": F.col("n_chars") < 50, "long": F.col("n_chars") > 10000, "no_lang": F.col("lang").isNull() | (F.col("lang") == ""), "has_pipe": F.contains("text", F.lit("|"))}
    return M.error_audit(table(spark, sf_dir, "documents"), "doc_id", rules)


@query("""SELECT CASE WHEN n_chars < 50 THEN 'short' WHEN lang <> 'en' THEN 'foreign' WHEN n_chars > 10000 THEN 'long' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def drop_reasons(spark, sf_dir):
    reason = M.first_error({"short": F.col("n_chars") < 50, "foreign": F.col("lang") != "en", "long": F.col("n_chars") > 10000})
    return table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- mixing

SOURCES = """
sources AS (
  SELECT (row_number() OVER (ORDER BY source) - 1)::BIGINT AS idx, source, size, weight::DOUBLE / sum(weight) OVER () AS share,
         (sum(size) OVER (ORDER BY source) - size)::BIGINT AS first, (sum(size) OVER (ORDER BY source))::BIGINT AS "end"
  FROM (SELECT source, count(*) AS size, 1 + ascii(right(source, 1)) % 4 AS weight FROM documents GROUP BY source))"""
QUOTAS = f"""{SOURCES},
quotas AS (
  SELECT *, (floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, idx) <= 512 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota
  FROM (SELECT *, round(share * 512, 9) AS exact FROM sources))"""


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("size"))
    return mixing.active_sources(sizes.withColumn("weight", 1 + F.ascii(F.substring("source", -1, 1)) % 4))


@query(f"WITH {QUOTAS} SELECT source, size, round(share, 9) AS share, quota FROM quotas")
def source_mixture_quotas(spark, sf_dir):
    return mixing.largest_remainders(document_sources(spark, sf_dir), 512).select("source", "size", F.round("share", 9).alias("share"), "quota")


@query(f"""WITH {SOURCES}
SELECT d.draw_id, s.source, d.position - s.first AS row_index
FROM (SELECT range AS draw_id, range % (SELECT sum(size) FROM sources)::BIGINT AS position FROM range((SELECT 2 * sum(size) + 7 FROM sources)::BIGINT)) d
JOIN sources s ON d.position >= s.first AND d.position < s."end" """)
def concat_plan(spark, sf_dir):
    sources = document_sources(spark, sf_dir)
    return mixing.concat_draws(spark, sources, 2 * sources.agg(F.sum("size")).first()[0] + 7)


@query()
def concat_shuffled_plan(spark, sf_dir):
    sources = document_sources(spark, sf_dir)
    return mixing.concat_draws(spark, sources, 2 * sources.agg(F.sum("size")).first()[0], seed=42)


SPREAD = f"""{QUOTAS},
tickets AS (
  SELECT row_number() OVER (ORDER BY (2 * k + 1) / (2 * quota), idx) - 1 AS ticket, source, size, quota, k
  FROM (SELECT *, unnest(range(quota)) AS k FROM quotas)),
draws AS (
  SELECT range AS draw_id, t.source, (range // 512 * t.quota + t.k) % t.size AS row_index
  FROM range((SELECT sum(size) FROM sources)::BIGINT) r JOIN tickets t ON t.ticket = r.range % 512)"""


def spread_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = mixing.largest_remainders(document_sources(spark, sf_dir), 512)
    return mixing.spread_draws(spark, sources, sources.agg(F.sum("size")).first()[0], 512)


@query(f"WITH {SPREAD} SELECT draw_id, source, row_index FROM draws")
def weighted_unshuffled_plan(spark, sf_dir):
    return spread_plan(spark, sf_dir)


@query(f"""WITH {SPREAD.replace("range((SELECT sum(size) FROM sources)::BIGINT)", "range((SELECT 2 * sum(size) FROM sources)::BIGINT, (SELECT 3 * sum(size) FROM sources)::BIGINT)")}
SELECT draw_id, draw_id - (SELECT 2 * sum(size) FROM sources)::BIGINT AS position, 2 AS plan_cycle, source, row_index FROM draws""")
def plan_cycle(spark, sf_dir):
    """The third round of a plan as long as all sources together: its draws go on where the second one ended."""
    sources = mixing.largest_remainders(document_sources(spark, sf_dir), 512)
    plan = mixing.finite_plan(spark, sources.agg(F.sum("size")).first()[0], 2)
    return plan.join(mixing.spread(plan, sources, 512), "draw_id").select("draw_id", "position", "plan_cycle", "source", "row_index")


@query()
def weighted_shuffled_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()  # a row for each source
    names = [r["source"] for r in rows]
    return mixing.shuffled_draws(spark, names, [r["n"] for r in rows], [1.0 + ord(n[-1]) % 4 for n in names], sum(r["n"] for r in rows), seed=42)


@query(f"""WITH {SPREAD} SELECT d.draw_id, d.source, d.row_index, r.doc_id FROM draws d
JOIN (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index FROM documents) r USING (source, row_index)""")
def drawn_documents(spark, sf_dir):
    rows = sampling.ordinals(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], id_bin(), ["doc_id"], "row_index")
    return spread_plan(spark, sf_dir).join(rows, ["source", "row_index"])


@query("""WITH m AS (SELECT doc_id, (xor(xor(42::UBIGINT, doc_id::UBIGINT), 11562461410679940143::UBIGINT)::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM documents),
a AS (SELECT doc_id, (xor(v::UBIGINT, v::UBIGINT >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM m),
b AS (SELECT doc_id, (xor(v::UBIGINT, v::UBIGINT >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM a)
SELECT doc_id, xor(v::UBIGINT, v::UBIGINT >> 31)::VARCHAR AS transform_seed FROM b""")
def transform_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", mixing.transform_seed("doc_id", F.lit(42).cast("long")).alias("transform_seed"))


@query("SELECT doc_id AS draw_id, doc_id % 3 AS rank, doc_id // 3 AS step FROM documents WHERE doc_id < (SELECT count(*) // 3 * 3 FROM documents)")
def rank_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("draw_id"))
    return mixing.rank_shard(docs, 3, drop_last=True, total=docs.count())


@query("""SELECT doc_id AS draw_id, doc_id // 8 * 48 + r.range * 16 + doc_id % 8 * 2 + m.range AS position FROM documents, range(3) r, range(2) m""")
def grouped_repeats(spark, sf_dir):
    return mixing.grouped_repeats(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("draw_id")), 8, 3, 2)


# ---------------------------------------------------------------- sampling



@query("""SELECT conv_id, turn, CASE WHEN u < 0.5 THEN 'plain' WHEN u < 0.8 THEN 'polite' ELSE 'terse' END AS variant, u FROM (
SELECT conv_id, turn, (('0x' || substr(sha256('42' || chr(10) || conv_id || chr(10) || turn), 1, 16))::UBIGINT // 2048)::DOUBLE / 9007199254740992.0 AS u FROM conversations)""")
def prompt_variant_draw(spark, sf_dir):
    u = sampling.unit_draw(F.lit("42"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", u.alias("u"))
    return rows.withColumn("variant", F.when(F.col("u") < 0.5, "plain").when(F.col("u") < 0.8, "polite").otherwise("terse"))


RANKED = "row_number() OVER (PARTITION BY {s} ORDER BY sha256('{seed}:' || {s} || ':' || doc_id), doc_id)"


@query(f"""WITH d AS (SELECT doc_id, source || '/' || quality AS stratum FROM documents JOIN labels USING (doc_id)),
c AS (SELECT stratum, count(*) AS n, count(*) * 100 // sum(count(*)) OVER () AS f, count(*) * 100 % sum(count(*)) OVER () AS rest FROM d GROUP BY stratum),
q AS (SELECT stratum, LEAST(n, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END) AS quota FROM c)
SELECT doc_id, stratum FROM (SELECT doc_id, stratum, {RANKED.format(s='stratum', seed='s7')} AS r FROM d) JOIN q USING (stratum) WHERE r <= quota""")
def hash_stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.concat_ws("/", "source", "quality").alias("stratum"))
    return sampling.take_quotas(rows, sampling.proportional_quotas(rows, "stratum", 100), "stratum", "doc_id", "s7")


def quota_sample(spark, sf_dir, quotas, seed):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    made = spark.createDataFrame(list(quotas(sampling.strata_counts(rows, "lang")).items()), "lang string, quota long")
    return sampling.take_quotas(rows, made, "lang", "doc_id", seed)


# shares by square root, remainders to the largest weights; right as long as no share is above what its stratum has
ROOTS = """h AS (SELECT lang, n, sqrt(n) AS w FROM c WHERE n > {keep}), t AS (SELECT {target} - coalesce((SELECT sum(n) FROM c WHERE n <= {keep}), 0) AS target),
f AS (SELECT lang, n, w, target, floor(target * w / sum(w) OVER () + 1e-9) AS whole FROM h, t),
q AS (SELECT lang, (whole + CASE WHEN row_number() OVER (ORDER BY w DESC, lang) <= target - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f UNION ALL SELECT lang, n FROM c WHERE n <= {keep})"""
COUNTS = "c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)"


@query()
def sqrt_quota_sample(spark, sf_dir):
    return quota_sample(spark, sf_dir, lambda c: sampling.sqrt_quotas(c, 120), "sqrt")


@query(f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
level AS (SELECT max(range) AS l FROM range((SELECT max(n) + 1 FROM c)) WHERE (SELECT sum(least(n, range)) FROM c) <= 30 * (SELECT count(*) FROM c)),
more AS (SELECT lang, n, l, 30 * (SELECT count(*) FROM c) - (SELECT sum(least(n, l)) FROM c) AS rest, row_number() OVER (PARTITION BY n > l ORDER BY lang) AS p FROM c, level),
q AS (SELECT lang, least(n, l) + CASE WHEN n > l AND p <= rest THEN 1 ELSE 0 END AS quota FROM more)
SELECT doc_id, lang, source FROM (SELECT *, {RANKED.format(s='lang', seed='water')} AS r FROM documents) JOIN q USING (lang) WHERE r <= quota""")
def waterfill_quota_sample(spark, sf_dir):
    return quota_sample(spark, sf_dir, lambda c: sampling.waterfill_quotas(c, 30 * len(c)), "water")


@query(f"""WITH {COUNTS}, {ROOTS.format(keep=60, target=150)}
SELECT doc_id, lang, source FROM (SELECT *, {RANKED.format(s='lang', seed='rare')} AS r FROM documents) JOIN q USING (lang) WHERE r <= quota""")
def rare_whole_sample(spark, sf_dir):
    return quota_sample(spark, sf_dir, lambda c: sampling.rare_whole_quotas(c, 150, 60), "rare")


@query()
def class_cap_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")
    return sampling.class_capped(rows, F.col("quality") == 1, 0.4, "lang", "doc_id", "cap")


@query(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('over:' || quality || ':' || doc_id), doc_id) AS r FROM labels),
k AS (SELECT *, count(*) OVER (PARTITION BY quality) AS n FROM r WHERE r <= 300)
SELECT doc_id, quality, unnest(range(CASE WHEN n >= 200 THEN 1 ELSE (200 - r) // n + 1 END)) AS view_index FROM k""")
def oversample_min_class(spark, sf_dir):
    return sampling.oversampled(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 200, 300, "over")


@query("SELECT doc_id, lang, LEAST(3, 4 * (row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // count(*) OVER (PARTITION BY lang))::BIGINT AS quartile FROM documents")
def quartile_buckets(spark, sf_dir):
    return sampling.quartiles(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "doc_id", "lang").drop("n_chars")


@query("SELECT doc_id FROM documents WHERE lang <> 'en' ORDER BY sha256('neg:' || doc_id), doc_id LIMIT (SELECT round_even(count(*) * 0.25, 0)::BIGINT FROM documents WHERE lang = 'en')")
def ratio_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.ratio_rows(docs.filter("lang <> 'en'"), docs.filter("lang = 'en'").count(), 0.25, "doc_id", "neg").select("doc_id")


# ---------------------------------------------------------------- boxes

BOX_COLUMNS = {
    "image": "l_orderkey", "label": "l_returnflag", "x1": "CAST((l_partkey * 37) % 400 AS DOUBLE)", "y1": "CAST((l_suppkey * 53 + l_linenumber * 11) % 300 AS DOUBLE)",
    "x2": "CAST((l_partkey * 37) % 400 + 40 + l_partkey % 160 AS DOUBLE)", "y2": "CAST((l_suppkey * 53 + l_linenumber * 11) % 300 + 40 + CAST(l_quantity AS BIGINT) * 7 % 160 AS DOUBLE)",
}
IDX = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
BOXES = "boxes AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in BOX_COLUMNS.items()) + f", {IDX} AS idx FROM lineitem)"
SHIFTED = "shifted AS (SELECT image, label, idx, x1 + (idx * 13) % 40 AS x1, y1 + (idx * 7) % 30 AS y1, x2 + (idx * 13) % 40 AS x2, y2 + (idx * 7) % 30 AS y2 FROM boxes)"


def area_sql(p: str) -> str:
    return f"({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1)"


def iou_sql(a: str, b: str) -> str:
    inter = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    return f"({inter}) / ({area_sql(a)} + {area_sql(b)} - ({inter}))"


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{v} AS {k}" for k, v in BOX_COLUMNS.items()), f"CAST({IDX} AS BIGINT) AS idx")


def shifted_boxes(rows: DataFrame) -> DataFrame:
    dx, dy = (F.col("idx") * 13) % 40, (F.col("idx") * 7) % 30
    return rows.select("image", "label", "idx", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"))


def quantise_sql(v: str, size: int) -> str:
    return f"floor(greatest(0.0, least({v}, {size - 1}.0)) / {size - 1}.0 * 999.0 + 0.5)::BIGINT"


@query(f"WITH {BOXES} SELECT image, idx, {quantise_sql('x1', 640)} AS qx1, {quantise_sql('y1', 480)} AS qy1, {quantise_sql('x2', 640)} AS qx2, {quantise_sql('y2', 480)} AS qy2 FROM boxes")
def bbox_quantize(spark, sf_dir):
    rows = line_boxes(spark, sf_dir)
    x1, x2 = G.grown(G.quantise(F.col("x1"), 640), G.quantise(F.col("x2"), 640))
    y1, y2 = G.grown(G.quantise(F.col("y1"), 480), G.quantise(F.col("y2"), 480))
    return rows.select("image", "idx", x1.alias("qx1"), y1.alias("qy1"), x2.alias("qx2"), y2.alias("qy2"))


@query(f"""WITH {BOXES}, {SHIFTED} SELECT a.image, a.idx AS a_idx, b.idx AS b_idx, round({iou_sql('a', 'b')}, 9) AS iou
FROM shifted a JOIN boxes b ON a.image = b.image AND a.label = b.label WHERE {iou_sql('a', 'b')} >= 0.3""")
def iou_candidates(spark, sf_dir):
    rows = line_boxes(spark, sf_dir)
    return B.candidates(shifted_boxes(rows), rows, 0.3).select("image", "a_idx", "b_idx", F.round("iou", 9).alias("iou"))


@query(f"""WITH {BOXES}, {SHIFTED},
p AS (SELECT a.image, a.idx, b.idx AS b_idx, {iou_sql('a', 'b')} AS iou, a.idx = b.idx AS own FROM shifted a JOIN boxes b ON a.image = b.image AND a.label = b.label WHERE {iou_sql('a', 'b')} >= 0.5),
r AS (SELECT *, row_number() OVER w AS r, lead(iou) OVER w AS next FROM p WINDOW w AS (PARTITION BY image, idx ORDER BY own DESC, iou DESC, b_idx))
SELECT s.image, s.idx, r.b_idx, round(r.iou, 9) AS iou, CASE WHEN r.b_idx IS NULL THEN 'none' WHEN NOT own AND next = iou THEN 'tie' ELSE 'matched' END AS status
FROM shifted s LEFT JOIN (SELECT * FROM r WHERE r = 1) r USING (image, idx)""")
def iou_best_match(spark, sf_dir):
    rows = line_boxes(spark, sf_dir)
    return B.best_match(shifted_boxes(rows), rows, 0.5).withColumn("iou", F.round("iou", 9))


@query(f"""WITH {BOXES}, d AS (SELECT image, label, x1, y1, x2, y2, min(idx) AS idx FROM boxes GROUP BY ALL)
SELECT image, idx, label, x1, y1, x2, y2, row_number() OVER (PARTITION BY image ORDER BY floor(y1 / 20), x1, y1, -((x2 - x1) * (y2 - y1)), x2, y2, label) - 1 AS position FROM d""")
def canonical_order(spark, sf_dir):
    return B.canonical_order(line_boxes(spark, sf_dir))


@query(f"""WITH {BOXES}, c AS (SELECT image, idx, floor(greatest(0, x1 - (x2 - x1) * 0.1)) AS x1, floor(greatest(0, y1 - (y2 - y1) * 0.1)) AS y1, least(640, ceil(x2 + (x2 - x1) * 0.1)) AS x2, least(480, ceil(y2 + (y2 - y1) * 0.1)) AS y2 FROM boxes)
SELECT c.image, c.idx, count(b.idx) AS n FROM c LEFT JOIN boxes b ON b.image = c.image AND b.idx <> c.idx AND c.x1 < b.x2 AND b.x1 < c.x2 AND c.y1 < b.y2 AND b.y1 < c.y2 GROUP BY ALL""")
def crop_distractors(spark, sf_dir):
    rows = line_boxes(spark, sf_dir)
    x1, y1, x2, y2 = G.padded(B.box(), 0.1, 640, 480)
    crops = rows.select("image", "idx", "label", x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))
    return B.distractors(rows, crops)


GREEDY = f"""
pairs AS (SELECT a.image, a.idx AS a_idx, b.idx AS b_idx, {iou_sql('a', 'b')} AS iou FROM shifted a JOIN boxes b ON a.image = b.image AND a.label = b.label WHERE {iou_sql('a', 'b')} >= 0.5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY iou DESC, a_idx, b_idx) AS r FROM pairs),
walk AS (
  SELECT image, 0::BIGINT AS r, []::BIGINT[] AS used_a, []::BIGINT[] AS used_b, 0::BIGINT AS n, 0.0::DOUBLE AS total FROM (SELECT DISTINCT image FROM pairs)
  UNION ALL
  SELECT w.image, p.r, CASE WHEN free THEN list_append(used_a, a_idx) ELSE used_a END, CASE WHEN free THEN list_append(used_b, b_idx) ELSE used_b END, n + free::INT, total + CASE WHEN free THEN round(iou, 12) ELSE 0 END
  FROM walk w JOIN ranked p ON p.image = w.image AND p.r = w.r + 1, LATERAL (SELECT NOT list_contains(used_a, a_idx) AND NOT list_contains(used_b, b_idx) AS free)),
hits AS (SELECT image, arg_max(n, r) AS n_match, arg_max(total, r) AS iou_sum FROM walk GROUP BY image)"""


@query(f"""WITH RECURSIVE {BOXES}, {SHIFTED}, {GREEDY}, sizes AS (SELECT image, count(*) AS n FROM boxes GROUP BY image)
SELECT image, n AS n_pred, n AS n_target, coalesce(n_match, 0) AS n_match, round(2.0 * coalesce(n_match, 0) / (2 * n), 9) AS f1, round(CASE WHEN n_match > 0 THEN iou_sum / n_match ELSE 0 END, 9) AS mean_iou,
round(least(1.0, coalesce(iou_sum, 0) / n), 9) AS reward FROM sizes LEFT JOIN hits USING (image)""")
def det_f1(spark, sf_dir):
    rows = line_boxes(spark, sf_dir)
    return B.detection(shifted_boxes(rows), rows, 0.5).withColumns({c: F.round(c, 9) for c in ("f1", "mean_iou", "reward")})


@query(f"""WITH RECURSIVE {BOXES},
over AS (SELECT a.image, a.idx, list(b.idx) AS others FROM boxes a JOIN boxes b ON a.image = b.image AND a.label = b.label AND b.idx < a.idx AND {iou_sql('a', 'b')} >= 0.3 GROUP BY ALL),
walk AS (
  SELECT image, 0::BIGINT AS idx, []::BIGINT[] AS kept FROM (SELECT DISTINCT image FROM boxes)
  UNION ALL
  SELECT w.image, b.idx, CASE WHEN o.others IS NULL OR NOT list_has_any(o.others, w.kept) THEN list_append(w.kept, b.idx) ELSE w.kept END
  FROM walk w JOIN boxes b ON b.image = w.image AND b.idx = w.idx + 1 LEFT JOIN over o ON o.image = b.image AND o.idx = b.idx),
ends AS (SELECT image, arg_max(kept, idx) AS kept FROM walk GROUP BY image)
SELECT b.image, b.label, b.x1, b.y1, b.x2, b.y2, b.idx FROM boxes b JOIN ends e ON e.image = b.image AND list_contains(e.kept, b.idx)""")
def nms(spark, sf_dir):
    return B.suppressed(line_boxes(spark, sf_dir), 0.3)


# ---------------------------------------------------------------- scores and telemetry


@query("""WITH s AS (SELECT lang AS dataset, count(*) AS n, avg((quality = 1)::INT::DOUBLE) / 2 AS score FROM documents JOIN labels USING (doc_id) GROUP BY lang),
w AS (SELECT 'en' AS dataset, 0.5 AS weight UNION ALL SELECT 'fr', 0.3 UNION ALL SELECT 'de', 0.2 UNION ALL SELECT 'xx', 9.0)
SELECT round(sum(score * weight) / sum(weight), 9) AS final_score, count(*) AS datasets FROM s JOIN w USING (dataset)""")
def dataset_weighted_score(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("dataset", F.col("lang"))
    scores = M.dataset_scores(rows, F.avg((F.col("quality") == 1).cast("double")), 0.0, 2.0)
    weights = spark.createDataFrame([("en", 0.5), ("fr", 0.3), ("de", 0.2), ("xx", 9.0)], "dataset string, weight double")
    return M.weighted_score(scores, weights).select(F.round("final_score", 9).alias("final_score"), "datasets")


@query("SELECT source, sum(n_chars)::BIGINT AS weight, round(sum(quality::DOUBLE * n_chars) / sum(n_chars), 9) AS loss FROM documents JOIN labels USING (doc_id) GROUP BY source")
def weighted_token_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("double")), "doc_id")
    return M.token_mean(rows, ["source"], "quality", "n_chars").withColumn("loss", F.round("loss", 9))


FRAMES = "frames AS (SELECT event_id // 4 AS step, event_id % 4 AS rank, event_type, 100 + CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, 200 AS padded, value AS seconds FROM events)"


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("step"), (F.col("event_id") % 4).alias("rank"), "event_type", (100 + k).alias("tokens"), F.lit(200).cast("long").alias("padded"), F.col("value").alias("seconds"))


EFFICIENCY = f"""WITH {FRAMES} SELECT event_type, count(*) AS frames, sum(tokens)::BIGINT AS tokens, max(step) - min(step) + 1 = count(DISTINCT step) AS contiguous,
round((sum(padded) - sum(tokens)) / sum(padded), 9) AS padding, round(sum(tokens) / sum(seconds), 6) AS tokens_per_second, round(sum(tokens) / count(*), 9) AS mean_length,
round(sqrt(greatest(0, sum(tokens * tokens) / count(*) - (sum(tokens) / count(*)) ** 2)), 6) AS std_length, round(quantile_cont(seconds, 0.5), 9) AS p50_seconds, round(quantile_cont(seconds, 0.95), 9) AS p95_seconds FROM frames GROUP BY event_type"""


@query(EFFICIENCY)
def efficiency_summary(spark, sf_dir):
    out = M.efficiency(event_frames(spark, sf_dir), ["event_type"])
    return out.withColumns({c: F.round(c, 6 if c in ("tokens_per_second", "std_length") else 9) for c in ("padding", "tokens_per_second", "mean_length", "std_length", "p50_seconds", "p95_seconds")})


@query(f"WITH {FRAMES} SELECT step, count(*) AS ranks, sum(tokens)::BIGINT AS tokens, arg_max(rank, (seconds, -rank)) AS slowest_rank, max(seconds) AS seconds FROM frames GROUP BY step")
def slowest_rank(spark, sf_dir):
    return M.slowest_ranks(event_frames(spark, sf_dir))


@query(f"""WITH {FRAMES} SELECT step, count(*) AS ranks, sum(n)::BIGINT AS total, min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(greatest(max(n) - avg(n), avg(n) - min(n)) / avg(n), 9) AS skew
FROM (SELECT step, rank, sum(tokens) AS n FROM frames GROUP BY ALL) GROUP BY step""")
def rank_skew(spark, sf_dir):
    return packing.rank_skew(event_frames(spark, sf_dir), "step", "rank", "tokens").withColumn("skew", F.round("skew", 9))


@query(f"""WITH {FRAMES}, r AS (SELECT event_type, count(*) AS frames, sum(tokens)::BIGINT AS tokens FROM frames GROUP BY event_type)
SELECT event_type, frames, tokens, round(frames / (SELECT frames FROM r WHERE event_type = 'view'), 9) AS frames_ratio, round(tokens / (SELECT tokens FROM r WHERE event_type = 'view'), 9) AS tokens_ratio FROM r""")
def run_comparison(spark, sf_dir):
    runs = event_frames(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("frames"), F.sum("tokens").alias("tokens"))
    out = M.compared(runs, "event_type", "view", ["frames", "tokens"])
    return out.withColumns({c: F.round(c, 9) for c in ("frames_ratio", "tokens_ratio")})


@query("""SELECT event_id, user_id, round(CASE WHEN dt > 0 AND dv > 0 THEN dv / dt ELSE 0.0 END, 9) AS rate FROM (
SELECT event_id, user_id, event_id - first_value(event_id) OVER w AS dv, epoch_us(ts) / 1000000.0 - epoch_us(first_value(ts) OVER w) / 1000000.0 AS dt FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def rolling_rate(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"))
    return M.rolling_rate(rows, "user_id", "at", "event_id").select("event_id", "user_id", F.round("rate", 9).alias("rate"))


@query("""WITH s AS (SELECT user_id, event_id AS start, event_id + 20 + CAST(json_extract(props, '$.k') AS BIGINT) AS "end" FROM events),
o AS (SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start - 1) THEN 1 ELSE 0 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS spans FROM i GROUP BY user_id, island""")
def span_union(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    spans = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 20 + k).alias("end"))
    return M.span_union(spans, "user_id")


@query("""SELECT field, value, count(*) AS n FROM (SELECT 'lang' AS field, lang AS value FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'source', source FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'quality', quality::VARCHAR FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def distribution_report(spark, sf_dir):
    return M.distributions(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), ["lang", "source", "quality"])


@query("""SELECT event_type AS dataset, round(avg((event_id % 3 = 0 AND event_id % 30 + 3 < length(t))::INT), 9) AS parse_partial_rate, round(avg((event_id % 3 <> 0 OR event_id % 30 + 3 >= length(t))::INT), 9) AS parse_success
FROM (SELECT *, '{"items": [1, 2], "v": ' || props || '}' AS t FROM events) GROUP BY event_type""")
def decoded_metrics(spark, sf_dir):
    """Rates of JSON cut off at a place that depends on the event: whole or repaired."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "props")
    text = F.concat(F.lit('{"items": [1, 2], "v": '), "props", F.lit("}"))
    cut = F.when(F.col("event_id") % 3 == 0, F.substring(text, F.lit(1), (F.col("event_id") % 30 + 3).cast("int"))).otherwise(text)
    rows = json_text.decode(rows, cut, "d").select(F.col("event_type").alias("dataset"), "d.*")
    return rows.groupBy("dataset").agg(*(F.round(M.METRICS.get(n)(), 9).alias(n) for n in ("parse_partial_rate", "parse_success")))


@query("""SELECT event_id, 'Event ' || event_type || ' had {"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '} for ' || to_json(event_type) || '.' AS prompt FROM events""")
def rendered_prompts(spark, sf_dir):
    parts = prompts.compile_prompt('Event {{ event_type }} had {"k":{{ k | json }}} for {{ event_type | json }}.', {"event_type": "string", "k": "integer"})
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.select("event_id", prompts.render(parts).alias("prompt"))


# ---------------------------------------------------------------- packing


WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text"):
    """Words of a text, which stand for its tokens; one at least, as a draw has a cost."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")


def document_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("draw_id"), words().alias("tokens"), F.floor(F.col("doc_id") / 64).alias("window"))


DRAWS = f"draws AS (SELECT doc_id AS draw_id, greatest(len(regexp_extract_all(coalesce(text, ''), '{WORD}')), 1)::BIGINT AS tokens, doc_id // 64 AS \"window\" FROM documents)"


@query(f'WITH {DRAWS} SELECT draw_id, tokens, "window", row_number() OVER (PARTITION BY "window" ORDER BY tokens DESC, draw_id) - 1 AS position FROM draws')
def length_grouped(spark, sf_dir):
    return packing.length_order(document_draws(spark, sf_dir), "window")


@query(f"""WITH {DRAWS} SELECT draw_id, tokens, "window", (sum(tokens) OVER (PARTITION BY "window" ORDER BY draw_id) - tokens)::BIGINT AS start, (sum(tokens) OVER (PARTITION BY "window" ORDER BY draw_id))::BIGINT AS stop,
(sum(tokens) OVER (PARTITION BY "window"))::BIGINT AS pack_length FROM draws""")
def varlen_offsets(spark, sf_dir):
    return packing.varlen_offsets(document_draws(spark, sf_dir), ["window"], "draw_id")


CAPACITY = 32_768  # tokens of a pack


@query()
def greedy_packs(spark, sf_dir):
    return packing.greedy_packs(document_draws(spark, sf_dir), "window", 2, CAPACITY)


@query()
def packing_stats(spark, sf_dir):
    return packing.pack_stats(greedy_packs(spark, sf_dir), ["window", "round", "pack_index"], ["window"])


PLANNER = packing.Planner(world_size=4, local_limit=4, max_tokens=4 * CAPACITY, buffer_size=32, seed=42)
STREAM_DRAWS = 65536  # draws in a stream, which is what one task holds


@query()
def planned_microbatches(spark, sf_dir):
    rows = document_draws(spark, sf_dir).withColumn("stream", F.floor(F.col("draw_id") / STREAM_DRAWS))
    return packing.planned_microbatches(rows, "stream", PLANNER)


# ---------------------------------------------------------------- vectors


def softmax_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x - list_max({v}) - ln(list_sum(list_transform({v}, lambda y: exp(y - list_max({v}))))))"


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE / 0.5) AS s, list_transform(embedding[33:64], lambda x: x::DOUBLE / 0.5) AS t FROM embeddings),
l AS (SELECT vec_id, {softmax_sql('s')} AS s, {softmax_sql('t')} AS t FROM v),
m AS (SELECT *, list_transform(list_zip(s, t), lambda z: ln((exp(z[1]) + exp(z[2])) / 2)) AS m FROM l)
SELECT vec_id, round(list_sum(list_transform(list_zip(s, t), lambda z: exp(z[1]) * (z[1] - z[2]))), 6) AS reverse_kl, round(list_sum(list_transform(list_zip(t, s), lambda z: exp(z[1]) * (z[1] - z[2]))), 6) AS forward_kl,
round((list_sum(list_transform(list_zip(s, m), lambda z: exp(z[1]) * (z[1] - z[2]))) + list_sum(list_transform(list_zip(t, m), lambda z: exp(z[1]) * (z[1] - z[2])))) / 2, 6) AS jsd FROM m""")
def softmax_divergence(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", D.log_softmax(F.slice("embedding", 1, 32), 0.5).alias("s"), D.log_softmax(F.slice("embedding", 33, 32), 0.5).alias("t"))
    return rows.select("vec_id", *(F.round(D.divergence(F.col("s"), F.col("t"), k), 6).alias(k) for k in ("reverse_kl", "forward_kl", "jsd")))


@query(f"""WITH l AS (SELECT vec_id, list_reverse_sort({softmax_sql('list_transform(embedding, lambda v: v::DOUBLE)')})[1:8] AS top FROM embeddings)
SELECT vec_id, list_transform(list_append(top, ln(1 - list_sum(list_transform(top, lambda v: exp(v))))), lambda v: round(v, 6)) AS log_probs FROM l""")
def top_k_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", D.top_with_tail(D.log_softmax(F.col("embedding")), 8).alias("log_probs"))
    return rows.select("vec_id", F.transform("log_probs", lambda x: F.round(x, 6)).alias("log_probs"))


@query("""SELECT vec_id, round(len(list_filter(range(1, 33), lambda i: (embedding[i]::DOUBLE - embedding[i + 32]) ** 2 <= 0.01)) / 32.0, 9) AS pck FROM embeddings""")
def keypoint_pck(spark, sf_dir):
    close = F.filter(F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda a, b: F.pow(a.cast("double") - b, 2.0)), lambda d: d <= 0.01)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.size(close) / 32.0, 9).alias("pck"))


@query("""WITH s AS (SELECT DISTINCT event_id // 4 AS step FROM events), g AS (SELECT step, least(1.0, greatest(0.0, (step - 100) / 900.0)) AS gone FROM s)
SELECT step, round(CASE WHEN step < 100 THEN step / 100.0 ELSE 1 - gone END, 9) AS linear, round(CASE WHEN step < 100 THEN step / 100.0 ELSE 0.5 * (1 + cos(pi() * gone)) END, 9) AS cosine,
round(CASE WHEN step < 100 THEN step / 100.0 ELSE sqrt(100.0 / step) END, 9) AS inverse_sqrt, round(CASE WHEN step < 100 THEN step / 100.0 ELSE (1 - gone) ** 2 END, 9) AS polynomial,
round(CASE WHEN step < 100 THEN step / 100.0 WHEN gone >= 1 THEN 0.0 ELSE 0.5 * (1 + cos(pi() * ((3 * gone) % 1.0))) END, 9) AS cosine_restarts FROM g""")
def lr_schedules(spark, sf_dir):
    """The factors of the learning rate at the steps that the events' frames belong to."""
    steps = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("step")).distinct()
    more = {"polynomial": {"power": 2.0}, "cosine_restarts": {"cycles": 3}}
    return steps.select("step", *(F.round(D.lr_scale(k, F.col("step"), 100, 1000, **more.get(k, {})), 9).alias(k) for k in ("linear", "cosine", "inverse_sqrt", "polynomial", "cosine_restarts")))


# ---------------------------------------------------------------- sequences, caps and audits


@query(f"""WITH s AS (SELECT doc_id, source FROM (SELECT *, {RANKED.format(s='source', seed='top')} AS r FROM documents) WHERE r <= 10)
SELECT doc_id, source, row_number() OVER (ORDER BY sha256('top-order:' || doc_id), doc_id) - 1 AS position FROM s""")
def top_k_sample(spark, sf_dir):
    return sampling.top_k_by_hash(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10, "top")


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
WHERE r <= CASE event_type WHEN 'click' THEN 20 WHEN 'view' THEN 50 ELSE 5 END""")
def type_row_caps(spark, sf_dir):
    return sampling.type_caps(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", {"click": 20, "view": 50}, 5)


@query(f"""WITH {BOXES} SELECT a.image, a.idx AS crop_idx, b.idx FROM boxes a JOIN boxes b ON a.image = b.image AND b.x1 >= a.x1 AND b.y1 >= a.y1 AND b.x2 <= a.x2 AND b.y2 <= a.y2""")
def crop_containment(spark, sf_dir):
    rows = line_boxes(spark, sf_dir)
    return B.contained(rows, rows)


@query(f"""WITH {BOXES} SELECT image, idx, row_number() OVER (PARTITION BY image ORDER BY y1, x1, label, idx) - 1 AS position FROM boxes""")
def reading_order(spark, sf_dir):
    return B.reading_order(line_boxes(spark, sf_dir)).select("image", "idx", "position")


@query(f"""WITH {BOXES}, b AS (SELECT *, floor(log2(greatest((x2 - x1) * (y2 - y1), 1.0)))::BIGINT AS bucket FROM boxes)
SELECT image, idx, bucket, row_number() OVER (PARTITION BY image ORDER BY bucket DESC, y1, x1, y2, x2, label, idx) - 1 AS position FROM b""")
def area_order(spark, sf_dir):
    return B.area_order(line_boxes(spark, sf_dir)).select("image", "idx", "bucket", "position")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def unreferenced_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE r = 1 OR event_type IS DISTINCT FROM before""")
def event_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return sequences.without_repeats(rows, "user_id", ["ts", "event_id"], "event_type").drop("ts")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS occurrence FROM events")
def user_occurrences(spark, sf_dir):
    return sequences.occurrences(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", ["event_id"])


@query("""SELECT l_suppkey, after, before FROM (SELECT l_suppkey, l_orderkey AS after, lead(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS before FROM lineitem) WHERE before - after > 1""")
def step_gaps(spark, sf_dir):
    return sequences.gaps(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey"), "l_suppkey", "l_orderkey")


@query(f"""WITH {BOXES}, a AS (SELECT image, idx, label, x1, idx = 1 AS target FROM boxes),
n AS (SELECT image, idx, CASE WHEN idx = 1 THEN 'new' ELSE label END AS label, x1 + CASE WHEN image % 97 = 0 THEN 1 ELSE 0 END AS x1 FROM boxes WHERE NOT (image % 89 = 0 AND idx = 2))
SELECT image, count(a.target) AS n_before, count(n.label) AS n_after,
count(*) FILTER (WHERE NOT coalesce(a.target, false) AND (a.label IS DISTINCT FROM n.label OR a.x1 IS DISTINCT FROM n.x1)) AS n_changed_outside,
n_before = n_after AND n_changed_outside = 0 AS ok
FROM a FULL JOIN n USING (image, idx) GROUP BY image""")
def output_audit(spark, sf_dir):
    before = line_boxes(spark, sf_dir).select("image", "idx", "label", "x1", (F.col("idx") == 1).alias("target"))
    after = before.filter(~((F.col("image") % 89 == 0) & (F.col("idx") == 2))).select(
        "image", "idx", F.when(F.col("target"), "new").otherwise(F.col("label")).alias("label"), (F.col("x1") + F.when(F.col("image") % 97 == 0, 1).otherwise(0)).alias("x1"))
    return sequences.output_audit(before, after, "image", ["image", "idx"], ["label", "x1"], "target")


@query("SELECT doc_id, substr(sha256(doc_id::VARCHAR), 1, 2) AS shard FROM documents")
def hash_shards(spark, sf_dir):
    return records.sharded_by_id(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents, each text once, drawn from their sources in spread order, packed by window, with figures per pack."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_anti")
    docs = records.keep_first(docs.select("doc_id", "source", words().alias("tokens"), F.sha2("text", 256).alias("h")), ["h"], ["doc_id"])
    docs = sampling.ordinals(docs, ["source"], id_bin(), ["doc_id"], "row_index")
    sizes = docs.groupBy("source").agg(F.count("*").alias("size")).withColumn("weight", F.col("size").cast("double"))
    sources = mixing.largest_remainders(mixing.active_sources(sizes), 512)
    draws = mixing.spread_draws(spark, sources, sources.agg(F.sum("size")).first()[0] or 0, 512).join(docs, ["source", "row_index"])
    rows = draws.select("draw_id", "tokens", F.floor(F.col("draw_id") / 64).alias("window"))
    return packing.pack_stats(packing.greedy_packs(rows, "window", 2, CAPACITY), ["window", "round", "pack_index"], ["window"])


QUERIES["flagship"] = flagship
