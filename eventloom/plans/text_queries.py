"""Registered queries over texts, answers, metrics and news tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import text
from eventloom.functions.rand import u01, u01_sql
from eventloom.operators import metrics, parsing, prepare, rank_tests
from eventloom.plans.queries import query
from eventloom.plans.views import LP_SQL, NODES_SQL, ev_nodes, lp_rows
from eventloom.runtime import table
from eventloom.sources.news import windows


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# -- preparation of events


@query("SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.keep_first(_documents(spark, sf_dir), "text", "doc_id").select("doc_id", "lang", "source")


@query("WITH k AS (SELECT min(event_id) AS ord FROM events GROUP BY user_id) SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS seq_id FROM k")
def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = prepare.keep_first(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord")), "user_id", "ord")
    return prepare.renumber(first, "ord").select("ord", "seq_id")


@query(
    """SELECT event_id, concat_ws('_', CAST(event_id AS VARCHAR), lower(array_to_string(list_transform(string_split(event_type || ', News Item ,' || CAST(user_id AS VARCHAR), ','), lambda k: replace(trim(k, ' '), ' ', '_')), '_')), strftime(ts, '%Y-%m-%d')) AS name FROM events"""
)
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = F.concat("event_type", F.lit(", News Item ,"), F.col("user_id").cast("string"))
    e = table(spark, sf_dir, "events").withColumn("keywords", keywords)
    return e.select("event_id", text.event_id("event_id", "keywords", "ts").alias("name"))


_DATE_SQL = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN 'soon' ELSE NULL END"


@query(f"WITH d AS (SELECT event_id, TRY_CAST({_DATE_SQL} AS TIMESTAMP) AS w FROM events) SELECT event_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS w FROM d WHERE w IS NOT NULL")
def invalid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    stamp = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd")).when(kind == 2, "soon")
    rows = prepare.valid_dates(table(spark, sf_dir, "events").select("event_id", stamp.alias("w")), "w")
    return rows.select("event_id", F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("w"))


#: Places as the extraction writes them, by event_id modulo their number.
_WHERE = (
    '{"text": "a", "locations": [{"country": "Brazil", "lat": -10.5, "long": -55}]}',
    '[{"locations": [{"country": "France", "lat": 46, "long": 2.25}]}, {"country": "X", "lat": 1, "long": 1}]',
    '{"locations": []}',
    '{"locations": [{"country": "Chile", "lat": null, "long": -71}]}',
    '{"country": "Japan", "lat": 36.5, "long": 138}',
    '{"country": "Peru", "lat": "-9.2", "long": -75}',
    '{"country": "Nowhere", "lat": 91, "long": 10}',
    '{"locations": [{"lat": 5, "long": 6}]}',
    '{"text": "only text"}',
    "not json",
)


@query(
    """WITH e AS (SELECT event_id, CAST(CASE event_id % 10 """
    + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WHERE))
    + """ END AS VARCHAR) AS w FROM events), j AS (SELECT event_id, TRY_CAST(w AS JSON) AS w FROM e),
    i AS (SELECT event_id, CASE WHEN json_type(w) = 'ARRAY' THEN json_extract(w, '$[0]') ELSE w END AS w FROM j),
    s AS (SELECT event_id, CASE WHEN json_type(w, '$.locations') IS NOT NULL THEN json_extract(w, '$.locations[0]') ELSE w END AS p FROM i),
    n AS (SELECT event_id, json_extract_string(p, '$.country') AS country, CASE WHEN json_type(p, '$.lat') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract(p, '$.lat') AS DOUBLE) END AS lat, CASE WHEN json_type(p, '$.long') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract(p, '$.long') AS DOUBLE) END AS lon FROM s),
    g AS (SELECT *, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS ok FROM n)
    SELECT event_id, CASE WHEN ok THEN coalesce(country, 'Unknown') ELSE 'Unknown' END AS country, CASE WHEN ok THEN lat ELSE 0.0 END AS lat, CASE WHEN ok THEN lon ELSE 0.0 END AS lon FROM g"""
)
def geo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.get(F.array(*[F.lit(w) for w in _WHERE]), (F.col("event_id") % len(_WHERE)).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("where", where)
    country, lat, lon = prepare.geo_columns("where")
    return rows.select("event_id", country.alias("country"), lat.alias("lat"), lon.alias("lon"))


# -- answers


def _picked(templates: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(t) for t in templates]), (F.col("doc_id") % len(templates)).cast("int"))


def _picked_sql(templates: tuple[str, ...]) -> str:
    return f"CASE doc_id % {len(templates)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(templates)) + " END"


_ANSWERS = (
    '{"link": true, "explanation": "same city"}', '```json\n{"link": false, "explanation": "far apart"}\n```', "[]", "{}", '{"link": "true"}',
    '{"explanation": "no link key"}', '{"link": true, "explanation": "cut off', "", "true", "--- {\"link\": true, \"explanation\": 3} ---", '{"explanation": "x", "link": true',
)
_CLEAN_SQL = "regexp_replace(replace(replace(replace(a, '```', ''), 'json', ''), '---', ''), '^\\s+|\\s+$', '', 'g')"
_LINK_SQL = """
  o AS (SELECT doc_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM p),
  g AS (SELECT doc_id, j, coalesce(j IS NOT NULL AND coalesce(json_type(j, '$.link'), 'BOOLEAN') = 'BOOLEAN' AND coalesce(json_type(j, '$.explanation'), 'VARCHAR') = 'VARCHAR', false) AS success FROM o)
  SELECT doc_id, success, CASE WHEN success THEN coalesce(CAST(json_extract_string(j, '$.link') AS BOOLEAN), false) ELSE false END AS link, CASE WHEN success THEN coalesce(json_extract_string(j, '$.explanation'), '') ELSE '' END AS explanation FROM g"""


@query(f"WITH d AS (SELECT doc_id, {_picked_sql(_ANSWERS)} AS a FROM documents), p AS (SELECT doc_id, TRY_CAST({_CLEAN_SQL} AS JSON) AS j FROM d), {_LINK_SQL}")
def parse_link_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", parsing.link_answer(_picked(_ANSWERS)).alias("a")).select("doc_id", "a.*")


@query(f"WITH d AS (SELECT doc_id, {_picked_sql(_ANSWERS)} AS b FROM documents), r AS (SELECT doc_id, CASE WHEN regexp_matches(b, '(true|false)$') THEN b || '}}' ELSE b END AS a FROM d), p AS (SELECT doc_id, TRY_CAST({_CLEAN_SQL} AS JSON) AS j FROM r), {_LINK_SQL}")
def repair_link_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", parsing.link_answer(parsing.repaired(_picked(_ANSWERS))).alias("a")).select("doc_id", "a.*")


_EXTRACTIONS = (
    '{"keywords": "a, b", "what": "flood", "who": "city", "why": "rain", "how": "river", "where": {"country": "X"}}', '```json {"what": "vote"} ```', "{}", '{"what": 3}', "[1]", "oops", '{"what": "x", "who": null}',
)


@query(
    f"""WITH d AS (SELECT doc_id, {_picked_sql(_EXTRACTIONS)} AS a FROM documents), p AS (SELECT doc_id, TRY_CAST({_CLEAN_SQL} AS JSON) AS j FROM d),
    o AS (SELECT doc_id, CASE WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0 THEN j END AS j FROM p),
    g AS (SELECT doc_id, j, coalesce(j IS NOT NULL AND """
    + " AND ".join(f"coalesce(json_type(j, '$.{k}'), 'VARCHAR') = 'VARCHAR'" for k in parsing.EXTRACTED)
    + """, false) AS success FROM o) SELECT doc_id, success, """
    + ", ".join(f"CASE WHEN success THEN coalesce(json_extract_string(j, '$.{k}'), '') END AS {k}" for k in parsing.EXTRACTED)
    + " FROM g"
)
def parse_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parsing.extraction(_picked(_EXTRACTIONS), F.lit("2026-01-01").cast("timestamp"))
    return _documents(spark, sf_dir).select("doc_id", e.alias("e")).select("doc_id", "e.success", *[f"e.{k}" for k in parsing.EXTRACTED])


_TAGGED = (
    "<event>\nWhen: 2026-01-01\nWhat: a: b\nWho: c\nWhy: d\nWhere: e\nHow: f\nID: 7\n</event>", "<event>\nWhat: one\nplain line\nWhat: two\n</event> text <event>\nWho: z\n</event>", "no block", "<event></event>",
)


@query(
    f"""WITH d AS (SELECT doc_id, {_picked_sql(_TAGGED)} AS t FROM documents),
    b AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS block FROM (SELECT doc_id, regexp_extract_all(t, '(?s)<event>(.*?)</event>', 1) AS x FROM d)),
    l AS (SELECT doc_id, pos, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, pos, string_split(regexp_replace(block, '^\\s+|\\s+$', '', 'g'), chr(10)) AS x FROM b)),
    k AS (SELECT doc_id, pos, i, lower(trim(split_part(line, ':', 1))) AS k, CASE WHEN contains(line, ':') THEN trim(regexp_replace(line, '^[^:]*:', '')) ELSE '' END AS v FROM l WHERE trim(line) <> '')
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE k WHEN 'id' THEN 'event_id' ELSE k END AS k, arg_max(v, i) AS v FROM k GROUP BY ALL"""
)
def parse_tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _documents(spark, sf_dir).select("doc_id", F.posexplode(parsing.tagged_events(_picked(_TAGGED))).alias("pos", "e"))
    return events.select("doc_id", "pos", F.explode("e").alias("k", "v"))


@query(
    f"""WITH d AS (SELECT doc_id, {_picked_sql(_TAGGED)} AS t FROM documents),
    b AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS block FROM (SELECT doc_id, regexp_extract_all(t, '(?s)<event>(.*?)</event>', 1) AS x FROM d)),
    m AS (SELECT doc_id, pos, list_filter(['event_id', 'how', 'what', 'when', 'where', 'who', 'why'], lambda k: NOT regexp_matches(lower(block), '(?m)^\\s*' || CASE k WHEN 'event_id' THEN 'id' ELSE k END || '\\s*:')) AS missing FROM b)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(missing, ',') AS missing, CAST(len(missing) AS INTEGER) AS n, len(missing) = 0 AS valid FROM m"""
)
def missing_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _documents(spark, sf_dir).select("doc_id", F.posexplode(parsing.tagged_events(_picked(_TAGGED))).alias("pos", "e"))
    missing = parsing.missing_keys(F.col("e"))
    return events.select("doc_id", "pos", F.array_join(missing, ",").alias("missing"), F.size(missing).alias("n"), parsing.is_event(F.col("e")).alias("valid"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'true') THEN true WHEN contains(lower(text), 'false') THEN false ELSE NULL END AS label FROM documents")
def naive_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", parsing.naive_label("text", None).alias("label"))


@query("SELECT doc_id, list_extract(string_split(text, '. '), -1) AS tail FROM documents")
def text_after_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", parsing.after_last("text", ". ").alias("tail"))


# -- texts

_EVENT_SQL = (
    NODES_SQL
    + """, ev AS (SELECT seq_id, strftime(t, '%Y-%m-%d-%H:%M:%S') AS w, how, CAST(who AS VARCHAR) AS who, why, CAST(seq_id AS VARCHAR) AS event_id FROM ev_nodes)"""
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ev_nodes(spark, sf_dir)
    return n.select("seq_id", text.event_time("when").alias("when"), F.col("how").alias("what"), F.col("who").cast("string").alias("who"), "why", F.lit(None).cast("string").alias("where"), "how", F.col("seq_id").cast("string").alias("event_id"))


@query(f"WITH {_EVENT_SQL} SELECT seq_id, '<event>' || chr(10) || 'When: ' || w || chr(10) || 'What: ' || how || chr(10) || 'Who: ' || who || chr(10) || 'Why: ' || coalesce(why, 'None') || chr(10) || 'Where: None' || chr(10) || 'How: ' || how || chr(10) || 'ID: ' || event_id || chr(10) || '</event>' || chr(10) AS event_text FROM ev")
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("seq_id", text.tagged_event().alias("event_text"))


def _quoted(value: str) -> str:
    return f"""coalesce('"' || replace(replace({value}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"', 'null')"""


@query(
    f"""WITH {_EVENT_SQL} SELECT seq_id, '{{"what": ' || {_quoted("how")} || ', "who": ' || {_quoted("who")} || ', "when": ' || {_quoted("w")} || ', "where": null, "why": ' || {_quoted("why")} || ', "how": ' || {_quoted("how")} || '}}' AS flat,
    '{{' || chr(10) || '  "what": ' || {_quoted("how")} || ',' || chr(10) || '  "where": null' || chr(10) || '}}' AS indented FROM ev"""
)
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("seq_id", text.json_object(text.CONTEXT).alias("flat"), text.json_object(("what", "where"), 2).alias("indented"))


@query("SELECT DISTINCT source, 'Src' || substr(source, 4) || ' Lang 7B' AS pretty FROM documents WHERE source IS NOT NULL")
def prettified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("source is not null").select("source").distinct().withColumn("_n", F.concat("source", F.lit("_lang_7b"))).select("source", text.prettified("_n").alias("pretty"))


# -- metrics

_CLASSES_SQL = """, ends AS (SELECT model, theme, label AS class, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp, CASE WHEN label <> pred THEN 1 ELSE 0 END AS fn, 0 AS fp FROM good
  UNION ALL SELECT model, theme, pred, 0, 0, CASE WHEN label <> pred THEN 1 ELSE 0 END FROM good)"""
_REPORT_SQL = """, per AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f, tp + fn AS s FROM cls),
 rep AS (SELECT {keys}, sum(tp) / sum(s) AS accuracy, avg(p) AS macro_precision, avg(r) AS macro_recall, avg(f) AS macro_f1, sum(p * s) / sum(s) AS weighted_precision, sum(r * s) / sum(s) AS weighted_recall, sum(f * s) / sum(s) AS weighted_f1, CAST(sum(s) AS BIGINT) AS support FROM per GROUP BY {keys})"""
_METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)
_GOOD = f"{LP_SQL}, good AS (SELECT * FROM lp WHERE success)"
_BY_MODEL = f"{_GOOD}{_CLASSES_SQL}, cls AS (SELECT model, theme, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ends GROUP BY ALL){_REPORT_SQL.format(keys='model, theme')}"


def _by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(lp_rows(spark, sf_dir).where("success"), ["model", "theme"])


@query(f"WITH {_BY_MODEL} SELECT model, theme, {_ROUNDED}, support FROM rep")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_model(spark, sf_dir)


@query(f"WITH {_GOOD}{_CLASSES_SQL}, cls AS (SELECT model, theme, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ends GROUP BY GROUPING SETS ((model, theme, class), (model, class), (class))){_REPORT_SQL.format(keys='model, theme')} SELECT model, theme, {_ROUNDED}, support FROM rep")
def report_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(lp_rows(spark, sf_dir).where("success"), ["model", "theme"], sets=[["model", "theme"], ["model"], []])


@query(f"WITH {_GOOD}, n AS (SELECT theme, label, pred, count(*) AS n FROM good GROUP BY ALL) SELECT theme, label, pred, n, round(n / sum(n) OVER (PARTITION BY theme, label), 6) AS share FROM n")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(lp_rows(spark, sf_dir).where("success"), ["theme"])


@query(f"WITH {LP_SQL} SELECT model, count(*) AS n, round(avg(CAST(success AS INTEGER)), 6) AS success_rate, round(avg(CASE WHEN pred THEN 1.0 ELSE 0 END), 6) AS link_rate, round(avg(CASE WHEN success AND pred THEN 1.0 ELSE 0 END), 6) AS valid_link_rate, CAST(sum(CASE WHEN NOT success THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM lp GROUP BY model")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return lp_rows(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"), share(F.col("success")).alias("success_rate"), share(F.col("pred")).alias("link_rate"), share(F.col("success") & F.col("pred")).alias("valid_link_rate"), F.count_if(~F.col("success")).alias("invalid"))


@query(
    f"""WITH {LP_SQL}, good AS (SELECT ctx AS model, 0 AS theme, label, pred FROM lp WHERE success){_CLASSES_SQL}, cls AS (SELECT model, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ends GROUP BY ALL){_REPORT_SQL.format(keys='model')}
    SELECT CAST(k AS BIGINT) AS ctx, {", ".join(f"round(coalesce({m}, 0), 6) AS {m}" for m in _METRICS)}, coalesce(support, 2) AS support, round(coalesce(support, 0) / (SELECT count(*) FROM good), 6) AS share FROM range(7) r(k) LEFT JOIN rep ON model = k"""
)
def metrics_by_context_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = lp_rows(spark, sf_dir).where("success")
    n = F.broadcast(good.agg(F.count(F.lit(1)).alias("_all")))
    sizes = spark.range(7).withColumnRenamed("id", "ctx")
    found = metrics.report(good, ["ctx"]).withColumn("_n", F.col("support"))
    out = metrics.with_dummies(sizes, found, ["ctx"]).crossJoin(n)  # one row
    return out.select("ctx", *_METRICS, "support", (F.when(F.col("_n").isNull(), 0.0).otherwise(F.col("_n")) / F.col("_all")).alias("share"))


@query(f"WITH {_BY_MODEL} SELECT model, count(*) AS themes, round(avg(macro_f1), 6) AS f1_mean, round(stddev_samp(macro_f1), 6) AS f1_std, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std FROM rep GROUP BY model")
def metrics_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_model(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("themes"), F.avg("macro_f1").alias("f1_mean"), F.stddev_samp("macro_f1").alias("f1_std"), F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"))


@query(f"WITH {_BY_MODEL} SELECT model, format('${{:.3f}} \\pm {{:.3f}}$', avg(macro_f1), stddev_samp(macro_f1)) AS cell, replace(format('{{:.3f}}', avg(accuracy)), '.', ',') AS comma FROM rep GROUP BY model HAVING count(*) > 1")
def latex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _by_model(spark, sf_dir).groupBy("model").agg(F.avg("macro_f1").alias("m"), F.stddev_samp("macro_f1").alias("s"), F.avg("accuracy").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return by.select("model", F.format_string("$%.3f \\pm %.3f$", F.bround("m", 3), F.bround("s", 3)).alias("cell"), F.replace(F.format_string("%.3f", F.bround("a", 3)), F.lit("."), F.lit(",")).alias("comma"))


@query(f"WITH {_BY_MODEL} SELECT theme, model, round(macro_f1, 6) AS macro_f1 FROM rep QUALIFY row_number() OVER (PARTITION BY theme ORDER BY round(macro_f1, 9) DESC, model) = 1")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("theme").orderBy(F.desc(F.round("macro_f1", 9)), "model")
    return _by_model(spark, sf_dir).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("theme", "model", "macro_f1")


@query(f"WITH {_BY_MODEL}, d AS (SELECT round(macro_precision - macro_recall, 9) AS d FROM rep) SELECT round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END), 6) AS share, round(median(d) FILTER (d > 0), 6) AS above, round(median(d) FILTER (d < 0), 6) AS below FROM d")
def precision_vs_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _by_model(spark, sf_dir).select(F.round(F.col("macro_precision") - F.col("macro_recall"), 9).alias("d"))
    return d.agg(F.avg((F.col("d") > 0).cast("double")).alias("share"), F.median(F.when(F.col("d") > 0, F.col("d"))).alias("above"), F.median(F.when(F.col("d") < 0, F.col("d"))).alias("below"))


@query(f"WITH {LP_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY model, theme ORDER BY doc_id) AS pos FROM lp) SELECT a.model AS a, b.model AS b, count(*) AS n, CAST(sum(CASE WHEN a.pred = a.label AND b.pred <> b.label THEN 1 ELSE 0 END) AS BIGINT) AS only_a FROM n a JOIN n b ON a.theme = b.theme AND a.pos = b.pos AND a.model < b.model WHERE a.success AND b.success GROUP BY a.model, b.model")
def model_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lp_rows(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("model", "theme").orderBy("doc_id"))).where("success").withColumn("right", F.col("pred") == F.col("label"))
    a, b = (n.select("theme", "pos", F.col("model").alias(x), F.col("right").alias(f"r{x}")) for x in "ab")
    return a.join(b, ["theme", "pos"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ra") & ~F.col("rb")).alias("only_a"))


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT g.vec_id AS id, round(1 - max(list_inner_product(g.x, t.x)), 6) AS novelty FROM v g JOIN v t ON g.vec_id % 2 = 0 AND t.vec_id % 2 = 1 GROUP BY g.vec_id")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return metrics.novelty(v.where("id % 2 = 0"), v.where("id % 2 = 1"))


_LOSS = "l AS (SELECT l_orderkey AS example, CAST(l_discount AS DOUBLE) * 10 AS loss, l_returnflag <> 'N' AS mask FROM lineitem)"


@query(f"WITH {_LOSS} SELECT example, round(exp(sum(CASE WHEN mask THEN loss ELSE 0 END) / nullif(sum(CASE WHEN mask THEN 1 ELSE 0 END), 0)), 6) AS perplexity FROM l GROUP BY example")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("example"), (F.col("l_discount").cast("double") * 10).alias("loss"), (F.col("l_returnflag") != "N").alias("mask"))
    return metrics.perplexity(rows, "example").withColumn("perplexity", F.round("perplexity", 6))


@query("SELECT lang, count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.75), 6) AS q75, max(n_chars) AS max FROM documents GROUP BY lang")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.describe(_documents(spark, sf_dir), ["lang"], "n_chars")


_FRIED = f"{_BY_MODEL}, whole AS (SELECT theme, model, round(macro_f1, 9) AS v FROM rep WHERE model IN (SELECT model FROM rep GROUP BY model HAVING count(*) = (SELECT count(DISTINCT theme) FROM rep)))"


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = _by_model(spark, sf_dir).select("theme", "model", F.round("macro_f1", 9).alias("v"))
    themes = rep.select("theme").distinct().count()
    full = rep.groupBy("model").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == themes).select("model")
    return rep.join(full, "model")


@query(
    f"""WITH {_FRIED}, r AS (SELECT theme, model, rank() OVER (PARTITION BY theme ORDER BY v) + (count(*) OVER (PARTITION BY theme, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY theme, v) AS same FROM whole),
    s AS (SELECT sum(x * x) AS ss, count(*) AS k FROM (SELECT sum(r) AS x FROM r GROUP BY model)), t AS (SELECT sum(same * same - 1) AS ties, count(DISTINCT theme) AS n FROM r)
    SELECT k, n, round((12.0 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1.0))), 6) AS statistic FROM s, t"""
)
def friedman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.friedman(_complete(spark, sf_dir), "theme", "model", "v")


@query(
    f"""WITH {_FRIED}, d AS (SELECT x.model AS a, y.model AS b, round(x.v - y.v, 12) AS d FROM whole x JOIN whole y ON x.theme = y.theme AND x.model < y.model WHERE round(x.v - y.v, 12) <> 0),
    r AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r FROM d)
    SELECT a, b, count(*) AS n, round(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 6) AS w FROM r GROUP BY a, b"""
)
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.wilcoxon(_complete(spark, sf_dir), "theme", "model", "v")


_FRIEDMAN_TEST = f"""WITH {_FRIED}, r AS (SELECT theme, model, rank() OVER (PARTITION BY theme ORDER BY v) + (count(*) OVER (PARTITION BY theme, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY theme, v) AS same FROM whole),
s AS (SELECT sum(x * x) AS ss, count(*) AS k FROM (SELECT sum(r) AS x FROM r GROUP BY model)), t AS (SELECT sum(same * same - 1) AS ties, count(DISTINCT theme) AS n FROM r),
f AS (SELECT k, n, (12.0 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1.0))) AS x FROM s, t)
SELECT k, n, round(x, 6) AS statistic, round(CASE WHEN x <= 0 THEN 1 ELSE 1 - (SELECT sum(exp(((k - 1) / 2.0 + i) * ln(x / 2) - x / 2 - lgamma((k - 1) / 2.0 + i + 1))) FROM range(300) q(i)) END, 6) AS p_value FROM f"""


@query(_FRIEDMAN_TEST)
def friedman_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_tests.friedman_test(_complete(spark, sf_dir), "theme", "model", "v")


# All ways to give each rank a sign are listed; Holm's limits are compared in the order of the p-values.
_SIGNED = f"""{_FRIED}, m AS (SELECT x.theme, x.model AS a, y.model AS b, round(x.v - y.v, 12) AS d FROM whole x JOIN whole y ON x.theme = y.theme AND x.model < y.model),
r AS (SELECT a, b, d, 2 * rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + count(*) OVER (PARTITION BY a, b, abs(d)) - 1 AS r FROM m WHERE d <> 0),
g AS (SELECT a, b, count(*) AS n, list(r) AS rs, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w2 FROM r GROUP BY a, b),
e AS (SELECT a, b, n, w2, rs, unnest(range(CAST(1 AS BIGINT) << n)) AS s FROM g),
p AS (SELECT a, b, any_value(n) AS n, any_value(w2) / 2 AS w, least(1.0, 2 * count(*) FILTER (list_sum(list_transform(rs, lambda x, i: x * ((s >> (i - 1)) & 1))) <= w2) / count(*)) AS p_value FROM e GROUP BY a, b),
w AS (SELECT DISTINCT m.a, m.b, coalesce(n, 0) AS n, coalesce(w, 0.0) AS w, coalesce(p_value, 1.0) AS p_value FROM m LEFT JOIN p ON p.a = m.a AND p.b = m.b),
h AS (SELECT *, p_value <= 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p_value) + 1) AS ok, row_number() OVER (ORDER BY p_value) AS place FROM w),
tested AS (SELECT a, b, n, w, p_value, bool_and(ok) OVER (ORDER BY place) AS rejected FROM h)"""


@query(f"WITH {_SIGNED} SELECT a, b, n, round(w, 6) AS w, round(p_value, 6) AS p_value, rejected FROM tested")
def wilcoxon_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_tests.wilcoxon_test(_complete(spark, sf_dir), "theme", "model", "v")


@query(
    f"""WITH {_SIGNED}, means AS (SELECT model, avg(r) AS mean_rank FROM (SELECT model, rank() OVER (PARTITION BY theme ORDER BY v DESC) + (count(*) OVER (PARTITION BY theme, v) - 1) / 2.0 AS r FROM whole) GROUP BY model),
    ways AS (SELECT a, b FROM tested WHERE rejected UNION ALL SELECT b, a FROM tested WHERE rejected)
    SELECT m.model, round(m.mean_rank, 6) AS mean_rank, count(*) FILTER (o.mean_rank > m.mean_rank) AS wins, count(*) FILTER (o.mean_rank < m.mean_rank) AS losses
    FROM means m LEFT JOIN ways ON ways.a = m.model LEFT JOIN means o ON o.model = ways.b GROUP BY m.model, m.mean_rank"""
)
def model_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_tests.leaderboard(_complete(spark, sf_dir), "theme", "model", "v")


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, round(avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS v FROM events GROUP BY 1),
    b AS (SELECT day, v, max(v) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d),
    i AS (SELECT *, best IS NULL OR v > best AS improved FROM b), g AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (ORDER BY day) AS g FROM i)
    SELECT CAST(day AS VARCHAR) AS day, v, best, improved, CAST(row_number() OVER (PARTITION BY g ORDER BY day) - 1 AS INTEGER) AS stale, row_number() OVER (PARTITION BY g ORDER BY day) - 1 >= 3 AS stop FROM g"""
)
def early_stopping_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg((F.col("user_id") % 3 == 0).cast("double")), 6).alias("v"))
    return metrics.early_stopping(log, "day", "v", 3)


# -- news tables


@query("SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def news_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per type


@query(
    """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events), b AS (SELECT min(day) AS a, max(day) AS b FROM e), t AS (SELECT DISTINCT event_type FROM e)
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, t.event_type, (SELECT count(*) FROM e WHERE e.day = CAST(d AS DATE) AND e.event_type = t.event_type) AS n FROM t, b, generate_series(b.a, b.b, INTERVAL 1 DAY) g(d)"""
)
def news_daily_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = counts.select("event_type").distinct().crossJoin(F.broadcast(span))  # days by types: the asked calendar
    return grid.join(counts, ["event_type", "day"], "left").select(F.col("day").cast("string").alias("day"), "event_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT user_id % 10 AS bucket, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def news_pivot_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)
    return e.groupBy("bucket").pivot("event_type", ["click", "view", "purchase"]).count().fillna(0)


@query(f"WITH {_BY_MODEL} SELECT model, theme, metric, round(value, 6) AS value FROM (SELECT model, theme, accuracy, macro_f1 FROM rep) UNPIVOT (value FOR metric IN (accuracy, macro_f1))")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_model(spark, sf_dir).unpivot(["model", "theme"], ["accuracy", "macro_f1"], "metric", "value")


@query("WITH w AS (SELECT CAST(d AS DATE) AS last, row_number() OVER (ORDER BY d DESC) - 1 AS n FROM generate_series(DATE '2026-03-01', DATE '2026-04-01', INTERVAL 2 DAY) g(x), LATERAL (SELECT DATE '2026-04-01' - CAST(DATE '2026-04-01' - CAST(x AS DATE) AS INTEGER) + (CAST(DATE '2026-04-01' - DATE '2026-03-01' AS INTEGER) % 2) AS d)) SELECT CAST(last AS VARCHAR) AS last, CAST(last - 1 AS VARCHAR) AS first, CAST(n AS BIGINT) AS n, CAST(n // 5 AS BIGINT) AS batch FROM w WHERE last <= DATE '2026-04-01'")
def collection_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, "2026-03-01", "2026-04-01", 2, 5)


@query(f"SELECT doc_id FROM documents ORDER BY {u01_sql(2026, 'doc_id')}, doc_id LIMIT 25")
def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).orderBy(u01(2026, "doc_id"), "doc_id").limit(25).select("doc_id")
