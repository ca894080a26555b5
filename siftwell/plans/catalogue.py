"""All queries of the engine's own operators, with the SQL they are checked against."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.context import Options
from siftwell.functions import probe_id
from siftwell.operators import profile, registry, relations, roles, texts
from siftwell.plans import decide
from siftwell.plans.diagnose import diagnose
from siftwell.plans.inspect import table_of
from siftwell.sources import scratch, structure
from siftwell.sources.detect import detect_column, list_files
from siftwell.streaming import rollups

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, minus zero as zero."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """documents with their labels, where there are any: the labels' nulls are the missing values."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


LABELLED = "labelled AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def sparse_lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with holes: quantities of 1 and taxes of 0 are missing."""
    return table(spark, sf, "lineitem").select("l_extendedprice", "l_discount", F.nullif("l_quantity", F.lit(1.0)).alias("l_quantity"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))


SPARSE = "sparse AS (SELECT l_extendedprice, l_discount, nullif(l_quantity, 1.0) AS l_quantity, nullif(l_tax, 0.0) AS l_tax FROM lineitem)"
LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def unions(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# aggregates -----------------------------------------------------------------


@query(f"WITH {LABELLED} " + unions([f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({m}) AS n_missing, round(avg(CASE WHEN {m} THEN 1 ELSE 0 END), 6) AS missing_rate FROM labelled" for c, m in (("doc_id", "doc_id IS NULL"), ("lang", "lang IS NULL OR trim(lang) = ''"), ("source", "source IS NULL OR trim(source) = ''"), ("n_chars", "n_chars IS NULL"), ("quality", "quality IS NULL"), ("toxic", "toxic IS NULL"))]))
def missing_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.missing_rates(labelled(spark, sf)))


@query(f"WITH {LABELLED} SELECT round((count(*) FILTER (quality IS NULL) + count(*) FILTER (toxic IS NULL)) / (6.0 * count(*)), 6) AS overall_missing_rate FROM labelled")
def missing_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.overall_missing(labelled(spark, sf)))


@query(f"WITH {SPARSE} SELECT 'l_quantity' AS a, 'l_tax' AS b, round(corr(CASE WHEN l_quantity IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN l_tax IS NULL THEN 1.0 ELSE 0.0 END), 6) AS corr FROM sparse")
def missing_indicator_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.missing_indicator_corr(sparse_lines(spark, sf)))


@query(f"WITH {SPARSE}, y AS (SELECT stddev_pop(l_extendedprice) AS s FROM sparse) " + unions([f"SELECT '{c}' AS \"column\", round(abs(avg(l_extendedprice) FILTER ({c} IS NULL) - avg(l_extendedprice) FILTER ({c} IS NOT NULL)) / any_value(s), 6) AS effect FROM sparse, y" for c in ("l_quantity", "l_tax")]))
def missing_target_effect(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.missing_target_effect(sparse_lines(spark, sf), "l_extendedprice"))


@query(f"WITH {LABELLED}, c AS (SELECT lang, count(*) FILTER (quality IS NULL) AS mq, count(*) FILTER (quality IS NOT NULL) AS pq, count(*) FILTER (toxic IS NULL) AS mt, count(*) FILTER (toxic IS NOT NULL) AS pt FROM labelled GROUP BY lang), t AS (SELECT sum(mq) AS smq, sum(pq) AS spq, sum(mt) AS smt, sum(pt) AS spt FROM c) SELECT 'quality' AS \"column\", round(0.5 * sum(abs(mq / smq - pq / spq)), 6) AS tv FROM c, t UNION ALL SELECT 'toxic', round(0.5 * sum(abs(mt / smt - pt / spt)), 6) FROM c, t")
def missing_target_tv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.missing_target_tv(labelled(spark, sf), "lang"))


SIZED = (("orders", "o_totalprice", 5), ("lineitem", "l_extendedprice", 10), ("documents", "lang", 4), ("embeddings", "label", 2))


@query(unions([f"SELECT '{t}' AS \"table\", count(*) AS n_rows, CAST({d} AS BIGINT) AS d_features, round(count(*) / {d}.0, 6) AS n_over_d, CASE WHEN count(*) / {d}.0 < 5 THEN 'low_data_high_d' WHEN count(*) / {d}.0 < 20 THEN 'moderate_data_medium_d' ELSE 'data_adequate_for_many_models' END AS regime, CASE WHEN count(*) / {d}.0 < 5 THEN 'mandatory' WHEN count(*) / {d}.0 < 20 THEN 'recommended' ELSE 'task_dependent' END AS regularization FROM {t}" for t, _, d in SIZED]))
def sample_size_regime(spark: SparkSession, sf: str) -> DataFrame:
    parts = [rounded(profile.sample_size(table(spark, sf, t), y)).select(F.lit(t).alias("table"), "*") for t, y, _ in SIZED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


LABELS = (("orders", "o_orderstatus"), ("events", "event_type"), ("labels", "quality"), ("embeddings", "label"))


@query(unions([f"SELECT '{t}' AS \"table\", count(*) AS classes, CAST(sum(n) AS BIGINT) AS total, round(min(n) / sum(n), 6) AS minority_rate, round(max(n) / min(n), 6) AS imbalance_ratio, min(n) / sum(n) < 0.05 AS rare_event, count(*) >= 10 AND max(n) / sum(n) < 0.5 AS long_tail FROM (SELECT {y}, count(*) AS n FROM {t} WHERE {y} IS NOT NULL GROUP BY {y})" for t, y in LABELS]))
def label_dist_classes(spark: SparkSession, sf: str) -> DataFrame:
    parts = [rounded(profile.class_distribution(table(spark, sf, t), y)).select(F.lit(t).alias("table"), "*") for t, y in LABELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("SELECT CAST(o_orderstatus AS VARCHAR) AS label, count(*) AS n FROM orders GROUP BY 1")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_counts(table(spark, sf, "orders"), "o_orderstatus")


@query("SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(quantile_cont(o_totalprice, 0.01), 4) AS q01, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.99), 4) AS q99, round(skewness(o_totalprice), 4) AS skew FROM orders")
def label_dist_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.value_distribution(table(spark, sf, "orders"), "o_totalprice"), 4)


def iqr_oracle(source: str, columns: list[str]) -> str:
    return "WITH " + ", ".join(f"q_{c} AS (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source})" for c in columns) + " " + unions([f"SELECT '{c}' AS \"column\", count({c}) AS n, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(CASE WHEN any_value(q3) > any_value(q1) THEN avg(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) ELSE 0 END, 4) AS outlier_rate FROM {source}, q_{c}" for c in columns])


@query(iqr_oracle("lineitem", LINE_NUMBERS))
def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.iqr_outliers(table(spark, sf, "lineitem"), LINE_NUMBERS), 4)


@query(iqr_oracle("events", ["value"]))
def iqr_outliers_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.iqr_outliers(table(spark, sf, "events"), ["value"]), 4)


def scale_oracle(source: str, columns: list[str]) -> str:
    made = unions([f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, stddev_pop({c}) AS std, quantile_cont({c}::DOUBLE, 0.05) AS q05, quantile_cont({c}::DOUBLE, 0.95) AS q95, skewness({c}) AS skew FROM {source}" for c in columns])
    return f"WITH s AS ({made})"


ROUNDED_SCALE = 'SELECT "column", n, round(min, 4) AS min, round(max, 4) AS max, round(std, 4) AS std, round(q05, 4) AS q05, round(q95, 4) AS q95, round(skew, 4) + 0.0 AS skew, abs(skew) > 2 AS heavy_tail, q05 > 0 AND q95 / greatest(q05, 1e-9) > 100 AND skew > 1 AS log_candidate FROM s'


@query(f"{scale_oracle('lineitem', LINE_NUMBERS)} {ROUNDED_SCALE}")
def feature_scale_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.feature_scale(table(spark, sf, "lineitem"), LINE_NUMBERS), 4)


@query(f"{scale_oracle('part', ['p_size', 'p_retailprice'])} {ROUNDED_SCALE}")
def feature_scale_part(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.feature_scale(table(spark, sf, "part"), ["p_size", "p_retailprice"]), 4)


@query(f"{scale_oracle('lineitem', LINE_NUMBERS)} SELECT count(*) AS n_features, round(max(std) / min(std), 4) AS std_scale_ratio, round(max(max - min) / min(max - min), 4) AS range_scale_ratio, round(log10(max(max - min) / min(max - min)), 4) AS orders_of_magnitude_span FROM s")
def scale_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.scale_ratios(profile.feature_scale(table(spark, sf, "lineitem"), LINE_NUMBERS)), 4)


def corr_oracle(source: str, columns: list[str]) -> str:
    return unions([f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM {source}" for i, a in enumerate(columns) for b in columns[i + 1 :]])


@query(corr_oracle("lineitem", LINE_NUMBERS))
def corr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.corr_pairs(table(spark, sf, "lineitem"), LINE_NUMBERS))


EMBEDDED = "WITH x AS (SELECT vec_id, u.i AS i, embedding[u.i]::DOUBLE AS v FROM embeddings, unnest(range(1, 65)) AS u(i))"


@query(f"{EMBEDDED} SELECT concat('e', a.i - 1) AS a, concat('e', b.i - 1) AS b, round(corr(a.v, b.v), 6) AS corr FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i")
def corr_pairs_wide(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(relations.wide_corr(rows, [f"e{i}" for i in range(64)]))


@query("SELECT * FROM (SELECT 'l_quantity' AS a, 'twice' AS b, round(corr(l_quantity, 2 * l_quantity), 4) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 4) FROM lineitem UNION ALL SELECT 'twice', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 4) FROM lineitem) WHERE abs(corr) >= 0.9")
def corr_high(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_quantity", (2 * F.col("l_quantity")).alias("twice"), "l_extendedprice")
    return relations.high_corr(relations.corr_pairs(lines))


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS n_distinct, round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents))) / count(*), 6) AS duplicate_rate FROM documents")
def dup_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.duplicate_rows(table(spark, sf, "documents").select("text", "lang", "source")))


TWINS = ["l_quantity", "l_linenumber", "again", "nearly", "l_orderkey"]


@query("WITH t AS (SELECT l_quantity, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS again, CASE WHEN l_linenumber = 4 THEN 0 ELSE l_linenumber END AS nearly, l_orderkey FROM lineitem) " + unions([f"SELECT '{a}' AS a, '{b}' AS b FROM (SELECT count(*) FILTER (CAST({a} AS DOUBLE) IS DISTINCT FROM CAST({b} AS DOUBLE)) AS n FROM t) WHERE n = 0" for i, a in enumerate(TWINS) for b in TWINS[i + 1 :]]))
def dup_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of lineitem, every row twice, with a copy of one and another that differs in some rows."""
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_linenumber", F.col("l_quantity").cast("int").cast("double").alias("again"), F.when(F.col("l_linenumber") == 4, 0).otherwise(F.col("l_linenumber")).alias("nearly"), "l_orderkey")
    return relations.duplicate_columns(rows.unionAll(rows))


@query(f"WITH {LABELLED}, g AS (SELECT lang, source, count(*) AS n, count(DISTINCT quality) AS m FROM labelled GROUP BY lang, source) SELECT count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n > 1 AND m > 1) AS conflicting, round(count(*) FILTER (n > 1 AND m > 1) / greatest(count(*) FILTER (n > 1), 1), 6) AS conflict_rate FROM g")
def conflict_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.conflict_rate(labelled(spark, sf), "quality", ["lang", "source"]))


@query("WITH g AS (SELECT user_id, count(DISTINCT event_type) AS m FROM events GROUP BY user_id) SELECT count(*) AS n_groups, count(*) FILTER (m > 1) AS n_leaked, round(count(*) FILTER (m > 1) / count(*), 6) AS leakage_fraction FROM g")
def group_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.group_leakage(table(spark, sf, "events"), "event_type", "user_id"))


def shift_oracle(source: str, split: str, columns: list[str]) -> str:
    parts = unions([f"SELECT {split} AS s, '{c}' AS \"column\", {c}::DOUBLE AS x FROM {source}" for c in columns])
    return f"""WITH sizes AS (SELECT {split} AS s, row_number() OVER (ORDER BY count(*) DESC, {split}) AS r FROM {source} WHERE {split} IS NOT NULL GROUP BY {split}),
long AS ({parts}), base AS (SELECT s FROM sizes WHERE r = 1), others AS (SELECT s FROM sizes WHERE r BETWEEN 2 AND 4)
SELECT base.s AS base, others.s AS other, "column", round(abs(avg(x) FILTER (long.s = base.s) - avg(x) FILTER (long.s = others.s)) / stddev_pop(x), 6) AS shift
FROM base, others, long WHERE long.s = base.s OR long.s = others.s GROUP BY base.s, others.s, "column" HAVING stddev_pop(x) > 0"""


@query(shift_oracle("orders", "o_orderstatus", ["o_orderkey", "o_custkey", "o_totalprice"]))
def split_shift_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.split_shift(table(spark, sf, "orders"), "o_orderstatus"))


@query(shift_oracle("documents", "lang", ["n_chars"]))
def split_shift_documents(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.split_shift(table(spark, sf, "documents"), "lang", ["n_chars"]))


def drift_oracle(source: str, time: str, tie: str, columns: list[str]) -> str:
    return f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {time}, {tie}) <= floor(count(*) OVER () / 2) AS early FROM {source}) " + unions([f"SELECT '{c}' AS \"column\", count({c}) FILTER (early) AS n_early, count({c}) FILTER (NOT early) AS n_late, round(abs(avg({c}) FILTER (early) - avg({c}) FILTER (NOT early)) / stddev_pop({c}), 6) AS shift FROM r" for c in columns])


@query(drift_oracle("events", "ts", "event_id", ["value", "user_id"]))
def time_drift_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.time_drift(table(spark, sf, "events"), "ts", "event_id", ["value", "user_id"]))


@query(drift_oracle("orders", "o_orderdate", "o_orderkey", ["o_totalprice", "o_custkey"]))
def time_drift_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relations.time_drift(table(spark, sf, "orders"), "o_orderdate", "o_orderkey", ["o_totalprice", "o_custkey"]))


@query(unions([f"SELECT '{t}' AS \"table\", count(*) AS classes, round(CASE WHEN count(*) >= 2 THEN min(n) / sum(n) END, 6) AS imbalance, CASE WHEN count(*) >= 2 AND min(n) / sum(n) < 0.1 THEN 'pr_auc' ELSE 'roc_auc' END AS metric FROM (SELECT {y}, count(*) AS n FROM {t} GROUP BY {y})" for t, y in LABELS[:3]]))
def metric_choice(spark: SparkSession, sf: str) -> DataFrame:
    parts = [profile.metric_imbalance(table(spark, sf, t), y).select(F.lit(t).alias("table"), "classes", F.round("imbalance", 6).alias("imbalance"), F.when(F.col("imbalance") < 0.1, "pr_auc").otherwise("roc_auc").alias("metric")) for t, y in LABELS[:3]]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("WITH s AS (SELECT l.quality, least(1.0, d.n_chars / 5000.0) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id), t AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND quality = 1) AS tp, count(*) FILTER (score >= threshold AND quality = 0) AS fp, count(*) FILTER (score < threshold AND quality = 1) AS fn FROM s, t GROUP BY threshold), p AS (SELECT *, tp / (tp + fp + 1e-12) AS p, tp / (tp + fn + 1e-12) AS r FROM c) SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-12), 6) AS f1 FROM p")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"))
    return rounded(relations.threshold_sweep(scored, "quality", "score", [i / 10 for i in range(11)]))


# texts and files ------------------------------------------------------------

SPLIT = "string_split(regexp_replace(coalesce({0}, ''), '\\r\\n?', chr(10), 'g'), chr(10))"
SOLID = "list_filter({0}, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '')"


@query(f"WITH l AS (SELECT doc_id, {SPLIT.format('text')} AS l FROM documents), s AS (SELECT doc_id, len(l) AS n_lines, {SOLID.format('l')} AS s FROM l) SELECT doc_id, n_lines, len(s) AS n_solid, round(CASE WHEN len(s) = 0 THEN 0 ELSE list_sum(list_transform(s, lambda x: length(x))) / len(s) END, 2) AS mean_length, len(list_filter(s, lambda x: contains(x, ','))) AS commas, len(list_filter(s, lambda x: contains(x, ';'))) AS semicolons, len(list_filter(s, lambda x: contains(x, '|'))) AS pipes, len(list_filter(s, lambda x: contains(x, chr(9)))) AS tabs FROM s")
def text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return texts.text_stats(table(spark, sf, "documents"), "text", "doc_id")


@query(f"""WITH l AS (SELECT doc_id, {SPLIT.format('text')} AS l FROM documents), s AS (SELECT doc_id, list_slice({SOLID.format('l')}, 1, 50) AS s FROM l),
m AS (SELECT unnest([0, 1, 2, 3]) AS r, unnest([',', chr(9), ';', '|']) AS d), e AS (SELECT doc_id, r, d, len(string_split(u.x, d)) AS w FROM s, m, unnest(s) AS u(x)),
c AS (SELECT doc_id, r, d, w, count(*) AS n FROM e GROUP BY doc_id, r, d, w), t AS (SELECT doc_id, r, d, sum(n) OVER (PARTITION BY doc_id, r) AS total, w, n, row_number() OVER (PARTITION BY doc_id, r ORDER BY n DESC, w DESC) AS i FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w * (n / total) DESC, r) AS b FROM t WHERE i = 1 AND total >= 2 AND w >= 2 AND n / total >= 0.8) SELECT doc_id, d AS delimiter, w AS columns, round(n / total, 6) AS consistency FROM f WHERE b = 1""")
def delimiter_sniff(spark: SparkSession, sf: str) -> DataFrame:
    return texts.delimiter_widths(table(spark, sf, "documents"), "text", "doc_id")


@query(r"WITH l AS (SELECT doc_id, u.i AS pos, " + SPLIT.format("text") + r"[u.i] AS line FROM documents, unnest(range(1, len(" + SPLIT.format("text") + r") + 1)) AS u(i)), p AS (SELECT doc_id, pos, regexp_extract(line, '^\s*([A-Za-z0-9_.\-]+)\s*[:=]\s*(.+?)\s*$', 1) AS name, regexp_extract(line, '^\s*([A-Za-z0-9_.\-]+)\s*[:=]\s*(.+?)\s*$', 2) AS value FROM l WHERE regexp_matches(line, '^\s*([A-Za-z0-9_.\-]+)\s*[:=]\s*(.+?)\s*$')) SELECT doc_id, name, arg_min(value, pos) AS value FROM p GROUP BY doc_id, name")
def kv_lines(spark: SparkSession, sf: str) -> DataFrame:
    return texts.key_values(table(spark, sf, "documents"), "text", "doc_id")


@query("SELECT p_partkey, u.name AS name, u.value AS value FROM part, unnest([{'name': 'brand', 'value': p_brand}, {'name': 'size.in_cm', 'value': p_size::VARCHAR}, {'name': 'note', 'value': 'x = ' || p_type}]) AS t(u)")
def kv_lines_part(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in lines of both kinds, with blanks, a repeated name and lines that hold no pair."""
    text = F.concat(F.lit("  brand: "), "p_brand", F.lit("  \nno pair here\nsize.in_cm="), F.col("p_size").cast("string"), F.lit("\nbrand = other\n: nor here\nnote : x = "), "p_type")
    return texts.key_values(table(spark, sf, "part").select("p_partkey", text.alias("text")), "text", "p_partkey")


@query(r"SELECT page_id, len(regexp_extract_all(lower(html), '<table[\s>]')) AS n_tables, octet_length(encode(html)) AS n_bytes FROM pages")
def html_table_count(spark: SparkSession, sf: str) -> DataFrame:
    return texts.html_table_count(table(spark, sf, "pages"), "html", "page_id")


@query("SELECT CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' ELSE 'float' END AS kind, count(*) AS n FROM events GROUP BY 1")
def json_props_shape(spark: SparkSession, sf: str) -> DataFrame:
    return texts.json_kinds(table(spark, sf, "events"), "props")


@query("WITH k AS (SELECT props, unnest(json_keys(props)) AS key FROM events) SELECT key, CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'float' END AS kind, count(*) AS n FROM k GROUP BY 1, 2")
def record_schema_summary(spark: SparkSession, sf: str) -> DataFrame:
    return texts.record_schema(table(spark, sf, "events"), "props")


@query()
def detect_text_types(spark: SparkSession, sf: str) -> DataFrame:
    """The format of every document's and page's text taken as a file of its own."""
    docs = detect_column(table(spark, sf, "documents").select(F.lit("documents").alias("table"), F.col("doc_id").alias("id"), "text"), "text")
    pages = detect_column(table(spark, sf, "pages").select(F.lit("pages").alias("table"), F.col("page_id").alias("id"), F.col("html").alias("text")), "text")
    return docs.unionAll(pages).groupBy("table", "file_type", "confidence").agg(F.count("*").alias("n"))


#: Texts of known formats.
KNOWN = (
    ("json", '{"id": 5, "list": [1, 2]}'), ("jsonl", '{"id": 5}\n{"id": 6}\n'), ("csv", "a,b,c\n1,2,3\n4,5,6\n"), ("tsv", "a\tb\n1\t2\n3\t4\n"), ("delimited", "a|b|c\n1|2|3\n4|5|6\n"), ("ini", "[main]\nkey = 1\n[other]\nk = 2\n"), ("xml", '<?xml version="1.0"?><r><a>1</a></r>'),
    ("html", "<html><body><table><tr><td>1</td></tr></table></body></html>"), ("text_kv", "one: 1\ntwo = 2\nthree: x y\none: 9\n"), ("yaml", "app:\n  name: x\nitems:\n  - 1\n  - 2\n"), ("text", "just some words here\nand some more of them\n"),
)


@query(unions([f"SELECT '{kind}' AS expected, '{kind}' AS file_type, count(*) AS n FROM orders WHERE o_orderkey % {len(KNOWN)} = {i} GROUP BY 1" for i, (kind, _) in enumerate(KNOWN)]))
def detect_known_types(spark: SparkSession, sf: str) -> DataFrame:
    """The detector on a column whose formats are known."""
    at = (F.col("o_orderkey") % len(KNOWN)).cast("int") + 1
    rows = table(spark, sf, "orders").select(F.element_at(F.array(*[F.lit(k) for k, _ in KNOWN]), at).alias("expected"), F.element_at(F.array(*[F.lit(t) for _, t in KNOWN]), at).alias("text"))
    return detect_column(rows, "text").groupBy("expected", "file_type").agg(F.count("*").alias("n"))


#: How part is written, and what the detector calls it.
WRITTEN = (("csv", "csv"), ("tsv", "tsv"), ("jsonl", "jsonl"), ("parquet", "parquet"), ("csv_gz", "gzip"), ("json_bz2", "bzip2"))


@query(unions([f"SELECT '{name}' AS written, '{kind}' AS file_type, count(*) AS n_rows, CAST(sum(p_partkey) AS BIGINT) AS keys, CAST(sum(p_size) AS BIGINT) AS sizes, round(sum(p_retailprice), 2) AS prices, count(DISTINCT p_brand) AS brands, CAST(sum(length(p_name) + length(p_brand) + 8) AS BIGINT) AS note_chars FROM part" for name, kind in WRITTEN]))
def read_formats(spark: SparkSession, sf: str) -> DataFrame:
    """part written in several formats (with quotes and line breaks inside of cells), detected, and read again by what the detector said."""
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand", F.concat("p_name", F.lit('\nsays "'), "p_brand", F.lit('"')).alias("note"))
    root, out = scratch.new_folder(spark), None
    csv = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true"}
    for name, kind in WRITTEN:
        path = f"{root}/{name}"
        if name == "parquet":
            part.write.parquet(path)
        elif name.startswith("json"):
            part.write.option("compression", "bzip2" if name == "json_bz2" else "none").json(path)
        else:
            part.write.options(**csv, sep="\t" if name == "tsv" else ",", compression="gzip" if name == "csv_gz" else "none").csv(path)
        found = structure.summarise_files(list_files(spark, path)).select("file_type", "details", "summary").orderBy("summary").first()
        files = f"{path}/*{dict(gzip='.gz', bzip2='.bz2').get(kind, '')}"
        df, _ = table_of(spark, files, found.file_type, dict(found.details or {}), Options(), json.loads(found.summary))
        if df is None:
            raise ValueError(f"{name}: files of type {found.file_type} hold no table")
        row = df.agg(F.lit(name).alias("written"), F.lit(found.file_type).alias("file_type"), F.count("*").alias("n_rows"), F.sum("p_partkey").cast("long").alias("keys"), F.sum("p_size").cast("long").alias("sizes"), F.round(F.sum("p_retailprice"), 2).alias("prices"), F.countDistinct("p_brand").alias("brands"), F.sum(F.length("note")).cast("long").alias("note_chars"))
        out = row if out is None else out.unionAll(row)
    return out


@query("SELECT 'html' AS file_type, count(*) AS n FROM pages WHERE contains(lower(left(ltrim(html), 2048)), '<html') OR contains(lower(left(ltrim(html), 2048)), '<table')")
def detect_pages_html(spark: SparkSession, sf: str) -> DataFrame:
    found = detect_column(table(spark, sf, "pages").select("page_id", "html"), "html")
    return found.where("file_type = 'html'").groupBy("file_type").agg(F.count("*").alias("n"))


# roles and types ------------------------------------------------------------

PART_FACTS = """WITH facts AS (
SELECT 'p_partkey' AS c, 'number' AS kind, count(p_partkey) AS n, count(DISTINCT p_partkey) AS u, true AS whole, avg(length(p_partkey::VARCHAR)) AS len, 0.0 AS sep FROM part UNION ALL
SELECT 'p_name', 'string', count(p_name), count(DISTINCT p_name), false, avg(length(p_name)), avg(regexp_matches(p_name, '[,|;]')::INT) FROM part UNION ALL
SELECT 'p_brand', 'string', count(p_brand), count(DISTINCT p_brand), false, avg(length(p_brand)), avg(regexp_matches(p_brand, '[,|;]')::INT) FROM part UNION ALL
SELECT 'p_type', 'string', count(p_type), count(DISTINCT p_type), false, avg(length(p_type)), avg(regexp_matches(p_type, '[,|;]')::INT) FROM part UNION ALL
SELECT 'p_size', 'number', count(p_size), count(DISTINCT p_size), true, avg(length(p_size::VARCHAR)), 0.0 FROM part UNION ALL
SELECT 'p_retailprice', 'number', count(p_retailprice), count(DISTINCT p_retailprice), bool_and(p_retailprice % 1 = 0), avg(length(p_retailprice::VARCHAR)), 0.0 FROM part)"""


@query(f"{PART_FACTS} SELECT c AS \"column\", n AS n_present, u AS n_distinct, kind, whole FROM facts")
def column_facts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.column_facts(table(spark, sf, "part")).select("column", "n_present", "n_distinct", "kind", "whole")


TYPED = (
    ("flag", "CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' WHEN o_orderkey % 3 = 1 THEN 'no' END", "string"), ("nearly_flag", "CASE WHEN o_orderkey % 50 = 0 THEN 'maybe' ELSE 'true' END", "string"), ("day", "CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE '2020-01-0' || (1 + o_orderkey % 9) END", "string"),
    ("tags", "CASE WHEN o_orderkey % 5 = 0 THEN 'a' ELSE 'a,b' END", "string"), ("one", "CAST(o_orderkey % 2 AS INTEGER)", "number"), ("status", "o_orderstatus", "string"),
)


@query(unions([f"SELECT '{c}' AS \"column\", '{kind}' AS kind, coalesce(bool_and(lower({x}::VARCHAR) IN ('0', '1', 'true', 'false', 'yes', 'no')), false) AS bool_like, round(coalesce(avg((try_cast({x} AS TIMESTAMP) IS NOT NULL)::INT) FILTER (({x}) IS NOT NULL), 0), 6) AS date_rate, round(coalesce(avg(regexp_matches({x}, '[,|;]')::INT), 0), 6) AS label_like, round(coalesce(avg(length({x})), 0), 6) AS mean_length FROM orders" if kind == "string" else f"SELECT '{c}', '{kind}', bool_and({x} IN (0, 1)), 0.0, 0.0, round(avg(length(({x})::VARCHAR)), 6) FROM orders" for c, x, kind in TYPED]))
def column_signs(spark: SparkSession, sf: str) -> DataFrame:
    """Signs of truth values, dates and lists of labels, in columns that have them in part."""
    made = table(spark, sf, "orders").select(*[F.expr(x.replace("VARCHAR", "STRING")).alias(c) for c, x, _ in TYPED])
    return rounded(profile.column_facts(made).select("column", "kind", "bool_like", "date_rate", "label_like", "mean_length"))


@query(f"{PART_FACTS} SELECT c AS \"column\", CASE WHEN kind = 'number' THEN 1.0 + CASE WHEN u <= 2 THEN 2.5 WHEN u <= greatest(10, floor(0.02 * n)) THEN 1.2 WHEN u >= floor(0.6 * n) THEN -2.0 ELSE 0 END ELSE CASE WHEN u <= greatest(20, floor(0.08 * n)) THEN 1.8 WHEN u >= floor(0.8 * n) THEN -2.0 ELSE 0 END END + CASE WHEN u <= 1 THEN -5 ELSE 0 END AS score FROM facts")
def target_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(roles.target_scores(profile.column_facts(table(spark, sf, "part"))))


@query(f"{PART_FACTS} SELECT c AS \"column\", CASE WHEN sep >= 0.6 THEN 'multilabel_classification' WHEN u <= 2 THEN 'binary_classification' WHEN kind = 'number' AND whole AND u <= greatest(20, floor(0.1 * n)) THEN 'multiclass_classification' WHEN kind = 'number' THEN 'regression' ELSE 'multiclass_classification' END AS task_type, CASE WHEN sep >= 0.6 THEN 0.65 WHEN kind = 'number' AND u <= 2 THEN 0.9 WHEN u <= 2 THEN 0.85 WHEN kind = 'number' AND whole AND u <= greatest(20, floor(0.1 * n)) THEN 0.7 WHEN kind = 'number' THEN 0.75 ELSE 0.8 END AS confidence FROM facts")
def task_inference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(roles.tasks(profile.column_facts(table(spark, sf, "part"))))


@query(f"{PART_FACTS} SELECT c AS \"column\", CASE WHEN kind = 'number' AND whole AND u <= greatest(30, floor(0.05 * n)) THEN 'numeric_discrete' WHEN kind = 'number' THEN 'numeric_continuous' WHEN len > 40 OR (len > 16 AND u / n > 0.6) THEN 'text' ELSE 'categorical_nominal' END AS feature_type FROM facts")
def feature_types(spark: SparkSession, sf: str) -> DataFrame:
    return roles.feature_types(profile.column_facts(table(spark, sf, "part")), compat=False)


@query(f"{PART_FACTS} SELECT c AS \"column\", CASE WHEN kind = 'number' AND n >= 5 THEN 'datetime' WHEN len > 40 OR (len > 16 AND u / n > 0.6) THEN 'text' ELSE 'categorical_nominal' END AS feature_type FROM facts")
def feature_types_compat(spark: SparkSession, sf: str) -> DataFrame:
    return roles.feature_types(profile.column_facts(table(spark, sf, "part")))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' ORDER BY p_name")
def snippet_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a registry by name prefix; the prefix reaches the scan as a filter."""
    return table(spark, sf, "part").where(F.col("p_name").startswith("small")).select("p_partkey", "p_name").orderBy("p_name")


@query("WITH r AS (SELECT user_id, event_id, event_type, round(value, 6) AS value, event_id % 3 = 0 AS fresh FROM events) SELECT user_id, arg_max(event_id, fresh::INT * 1000000000000 + event_id) AS event_id, arg_max(event_type, fresh::INT * 1000000000000 + event_id) AS event_type, arg_max(value, fresh::INT * 1000000000000 + event_id) AS value FROM r GROUP BY user_id")
def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of each user's event, brought up to date by every third event."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))
    return registry.upsert(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), ["user_id"], ["event_id"])


@query("WITH h AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY substr(md5('42:' || o_orderkey), 1, 13)) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT CASE WHEN r < floor(0.8 * n) THEN 'train' WHEN r < floor(0.8 * n) + floor(0.1 * n) THEN 'val' ELSE 'test' END AS split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM h GROUP BY 1")
def seeded_split(spark: SparkSession, sf: str) -> DataFrame:
    """Orders split 80/10/10 by a seeded hash, in exact sizes."""
    return registry.seeded_split(table(spark, sf, "orders"), "o_orderkey").groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


# decisions ------------------------------------------------------------------


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """A probe request for every customer, as planned probes look like."""
    kinds = F.array(*[F.lit(k) for k in decide.METRICS])
    rows = table(spark, sf, "customer").select(F.concat(F.lit("ds_"), F.col("c_custkey").cast("string")).alias("dataset_id"), F.element_at(kinds, (F.col("c_custkey") % 6 + 1).cast("int")).alias("probe_kind"), F.col("c_mktsegment").alias("reason"))
    return rows.withColumn("request_id", probe_id(F.col("dataset_id"), F.col("probe_kind"), F.col("reason"))).withColumns({"candidate_family": F.lit("mlp"), "signals": F.array(F.lit("a")), "max_trials": F.lit(20), "max_runtime_minutes": F.lit(30)})


ASKED = """kinds AS (SELECT ['supervised_baseline_probe', 'split_sensitivity_probe', 'unsupervised_structure_probe', 'missingness_impact_probe', 'feature_redundancy_probe', 'uncertainty_resolution_probe'] AS k),
named AS (SELECT concat('ds_', c_custkey) AS dataset_id, k[c_custkey % 6 + 1] AS probe_kind, c_mktsegment AS reason FROM customer, kinds),
hashed AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws(':', dataset_id, probe_kind, reason))) AS h FROM named),
asked AS (SELECT dataset_id, probe_kind, reason, concat('probe_', substr(h, 1, 12), '5', substr(h, 14, 3)) AS request_id FROM hashed)"""


@query(f"WITH {ASKED} SELECT dataset_id, probe_kind, reason, request_id FROM asked")
def probe_ids(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("dataset_id", "probe_kind", "reason", "request_id")


@query(f"WITH {ASKED}, s AS (SELECT *, CAST(('0x' || substr(sha256(request_id), 1, 12)) AS BIGINT) / 281474976710655.0 AS s FROM asked) SELECT request_id, probe_kind, 'success' AS status, round(s, 6) AS seed, CAST(greatest(1, round_even(20 * (0.7 + 0.25 * s), 0)) AS INTEGER) AS trials_run, round_even(CASE probe_kind WHEN 'supervised_baseline_probe' THEN 0.02 + 0.04 * s WHEN 'split_sensitivity_probe' THEN 0.018 + 0.03 * (1 - (0.01 + 0.08 * (1 - s))) WHEN 'unsupervised_structure_probe' THEN 0.015 + 0.035 * abs(-0.02 + 0.42 * s) WHEN 'missingness_impact_probe' THEN 0.01 + 0.03 * abs(-0.03 + 0.12 * s) WHEN 'feature_redundancy_probe' THEN 0.008 + 0.03 * abs(-0.05 + 0.08 * s) ELSE 0.01 + 0.03 * s END, 6) AS confidence_gain FROM s")
def probe_sim(spark: SparkSession, sf: str) -> DataFrame:
    done = decide.simulated(asked(spark, sf))
    return done.select("request_id", "probe_kind", "status", F.round("seed", 6).alias("seed"), "trials_run", "confidence_gain")


@query(f"WITH {ASKED} SELECT dataset_id, request_id FROM asked WHERE CAST(substr(dataset_id, 4) AS BIGINT) % 3 <> 0")
def probe_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Requests without a result yet."""
    requests = asked(spark, sf)
    results = requests.where(F.substring("dataset_id", 4, 20).cast("long") % 3 == 0).select("request_id")
    return requests.join(results, "request_id", "left_anti").select("dataset_id", "request_id")


@query(f"WITH {ASKED}, p AS (SELECT CASE WHEN probe_kind LIKE 's%' THEN 'high' WHEN probe_kind LIKE 'u%' THEN 'medium' ELSE 'low' END AS priority FROM asked) SELECT priority, count(*) AS n, CAST(20 * count(*) AS BIGINT) AS trials, CAST(30 * count(*) AS BIGINT) AS minutes FROM p GROUP BY priority")
def probe_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return decide.probe_totals(asked(spark, sf).withColumn("priority", F.when(F.col("probe_kind").startswith("s"), "high").when(F.col("probe_kind").startswith("u"), "medium").otherwise("low")))


@query("WITH c AS (SELECT concat('ds_', c_nationkey) AS dataset_id, concat('f', c_custkey) AS family, floor(c_acctbal / 1000) / 10 AS fit_score, c_custkey AS gen_order FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY fit_score DESC, gen_order) AS rank FROM c) SELECT dataset_id, family, fit_score, CAST(rank AS INTEGER) AS rank, concat(dataset_id, '_cand_', lpad(rank::VARCHAR, 2, '0')) AS candidate_id FROM r WHERE rank <= 3")
def candidate_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.concat(F.lit("ds_"), F.col("c_nationkey").cast("string")).alias("dataset_id"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("family"), (F.floor(F.col("c_acctbal") / 1000) / 10).alias("fit_score"), F.col("c_custkey").alias("gen_order"))
    return decide.candidate_rank(rows)


LOOP = "SELECT o_orderkey AS id, 4 AS datasets, o_orderkey % 5 AS ready, (4 - o_orderkey % 5) % 3 AS degraded, (4 - o_orderkey % 5) - (4 - o_orderkey % 5) % 3 AS blocked, o_custkey % 14 AS results, (o_orderkey % 7) / 100.0 AS mean_gain, 1 + o_custkey % 4 AS round_index, 3 AS max_rounds, 12 AS max_results, 0.02 AS min_gain FROM orders"


@query(f"WITH s AS ({LOOP}) SELECT id, CASE WHEN ready = datasets AND blocked = 0 AND degraded = 0 THEN 'finalize' WHEN round_index > max_rounds THEN 'stop' WHEN results >= max_results THEN 'stop' WHEN results > 0 AND blocked = 0 AND degraded > 0 AND mean_gain < min_gain THEN 'await_operator' WHEN blocked > 0 OR degraded > 0 THEN 'request_probes' ELSE 'finalize' END AS action FROM s")
def loop_action(spark: SparkSession, sf: str) -> DataFrame:
    k, left = F.col("o_orderkey"), 4 - F.col("o_orderkey") % 5
    state = table(spark, sf, "orders").select(k.alias("id"), F.lit(4).alias("datasets"), (k % 5).alias("ready"), (left % 3).alias("degraded"), (left - left % 3).alias("blocked"), (F.col("o_custkey") % 14).alias("results"), ((k % 7) / 100).alias("mean_gain"), (1 + F.col("o_custkey") % 4).alias("round_index"), F.lit(3).alias("max_rounds"), F.lit(12).alias("max_results"), F.lit(0.02).alias("min_gain"))
    return decide.loop_action(state).select("id", "action")


def made_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """A diagnosed dataset for every customer, of varied statuses."""
    c = F.col("c_custkey")
    status = lambda n: F.element_at(F.array(F.lit("auto_accept"), F.lit("needs_user_verification"), F.lit("unresolved")), (F.floor(c / n) % 3 + 1).cast("int"))
    part = lambda k, n: F.struct(F.lit(k).alias("key"), F.when(status(n) != "unresolved", F.lit("x")).alias("value"), F.lit(0.5).alias("confidence"), status(n).alias("status"), F.lit("").alias("source"), F.array().cast("array<string>").alias("evidence"), F.lit("").alias("risk_if_wrong"))
    found = lambda k: F.struct(F.lit(k).alias("key"), F.lit("").alias("title"), F.lit("supported").alias("status"), F.lit(0.8).alias("confidence"), F.lit("").alias("summary"), F.lit('{"n_over_d": 12.0, "d_features": 6}').alias("evidence"), F.array().cast("array<string>").alias("warnings"))
    # few bytes, but much work a row: dealt by rows, about 5,000 a task
    rows = table(spark, sf, "customer").select("c_custkey")
    rows = rows.repartition(max(1, rows.count() // 5000), "c_custkey")
    return rows.select(
        F.concat(F.lit("ds_"), c.cast("string")).alias("dataset_id"), F.lit("d").alias("display_name"), F.lit("csv").alias("detected_type"), F.lit(0.9).alias("detection_confidence"), (c % 13).cast("int").alias("supported"), F.lit(12).alias("total"),
        F.array(*[part(k, n) for k, n in (("task_type", 1), ("target_column", 3), ("split_column", 9), ("time_column", 27), ("group_column", 81), ("objective_metric", 243))]).alias("assumptions"), F.array(*[found(k) for k in ("problem_type", "target_definition", "data_splitting_structure", "evaluation_metric", "sample_size_vs_feature_dimension")]).alias("vital_findings"), F.array().cast("array<string>").alias("warnings"),
    )


MADE = "d AS (SELECT concat('ds_', c_custkey) AS dataset_id, c_custkey % 13 AS supported, [c_custkey % 3, (c_custkey // 3) % 3, (c_custkey // 9) % 3, (c_custkey // 27) % 3, (c_custkey // 81) % 3, (c_custkey // 243) % 3] AS s FROM customer)"


@query(f"WITH {MADE} SELECT dataset_id, CASE WHEN s[1] = 2 OR s[2] = 2 THEN 'blocked' WHEN list_max(s) > 0 THEN 'degraded' ELSE 'ready' END AS readiness_state, round_even(0.5 * supported / 12 + 0.3 * list_sum(list_transform(s, lambda x: CASE x WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0 END)) / 6 + 0.2 * 0.8, 3) AS confidence_score, CAST(CASE WHEN s[1] = 2 OR s[2] = 2 THEN (s[1] = 2)::INT + (s[2] = 2)::INT ELSE 0 END AS INTEGER) AS n_blocking FROM d")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    return decide.readiness(made_datasets(spark, sf)).select("dataset_id", "readiness_state", "confidence_score", F.size("blocking_reasons").alias("n_blocking"))


@query(f"WITH {MADE}, r AS (SELECT *, s[1] = 2 OR s[2] = 2 AS bad FROM d) SELECT count(*) AS dataset_count, CAST(sum(len(list_filter(s, lambda x: x > 0))) AS BIGINT) AS assumptions_needing_verification, CAST(sum(supported) AS BIGINT) AS supported_vital_checks, CAST(12 * count(*) AS BIGINT) AS total_vital_checks, CASE WHEN bool_or(bad) THEN 'blocked' ELSE 'degraded' END AS readiness_state FROM r")
def bundle_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return decide.bundle_summary(decide.readiness(made_datasets(spark, sf))).drop("confidence_score")


@query(f"WITH {MADE} SELECT dataset_id, CASE WHEN s[1] = 2 OR s[2] = 2 THEN 'blocked' WHEN list_max(s) > 0 OR supported / 12 < 0.6 THEN 'degraded' ELSE 'ready' END AS decision_state, CASE WHEN s[3] < 2 THEN 'predefined_split_column' WHEN s[4] < 2 THEN 'time_series_split' WHEN s[5] < 2 THEN 'group_kfold' END AS validation, CAST(CASE WHEN s[1] = 2 OR s[2] = 2 THEN 0 ELSE 1 END AS INTEGER) AS n_candidates, CASE WHEN NOT (s[1] = 2 OR s[2] = 2) THEN 0.66 END AS fit_score, CASE WHEN NOT (s[1] = 2 OR s[2] = 2) THEN 60 END AS max_trials FROM d")
def recommendation(spark: SparkSession, sf: str) -> DataFrame:
    out = decide.recommendation(decide.readiness(made_datasets(spark, sf)))
    first = F.try_element_at("candidates", F.lit(1))
    return out.select("dataset_id", "decision_state", "validation", F.size("candidates").alias("n_candidates"), first["fit_score"].alias("fit_score"), first["max_trials"].alias("max_trials"))


PLANNED = f"""WITH {MADE}, w AS (SELECT dataset_id, s[1] = 2 OR s[2] = 2 AS blocked, list_max(s) > 0 OR supported / 12 < 0.6 AS open, s[3] > 0 OR s[4] > 0 OR s[5] > 0 AS divided, s[2] > 0 AS unsure FROM d),
p AS (SELECT dataset_id, list_slice(list_filter([CASE WHEN NOT blocked THEN 1 END, CASE WHEN divided THEN 2 END, CASE WHEN unsure OR blocked THEN 3 END], lambda x: x IS NOT NULL), 1, 2) AS k FROM w WHERE blocked OR open),
o AS (SELECT dataset_id, u.i - 1 AS plan_order, k[u.i] AS k FROM p, unnest(range(1, len(k) + 1)) AS u(i)),
n AS (SELECT dataset_id, CAST(plan_order AS INTEGER) AS plan_order, {{0}} AS probe_kind, {{1}} AS priority, {{2}} AS reason FROM o)
SELECT dataset_id, plan_order, concat('probe_', substr(h, 1, 12), '5', substr(h, 14, 3)) AS request_id, probe_kind, priority FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws(':', dataset_id, probe_kind, reason))) AS h FROM n)""".format(*["(['" + "', '".join(p[i] for p in decide.PROBES[:3]) + "'])[k]" for i in range(3)])


@query(PLANNED)
def probe_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Probes planned for every dataset that isn't ready."""
    return decide.planned_probes(decide.recommendation(decide.readiness(made_datasets(spark, sf)))).select("dataset_id", "plan_order", "request_id", "probe_kind", "priority")


# whole diagnoses ------------------------------------------------------------


def finding_rows(spark: SparkSession, df: DataFrame, options: Options) -> DataFrame:
    rows = [(f.key, f.status, round(f.confidence, 3), json.dumps(f.evidence, sort_keys=True, default=str)) for f in diagnose(df, options)]
    return spark.createDataFrame(rows, "key string, status string, confidence double, evidence string")


@query()
def diagnose_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve findings of orders, with the order status as target and the date as time."""
    return finding_rows(spark, table(spark, sf, "orders"), Options(target_column="o_orderstatus", time_column="o_orderdate"))


@query()
def diagnose_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve findings of documents with their labels, quality being the target and language the split."""
    return finding_rows(spark, labelled(spark, sf), Options(target_column="quality", split_column="lang"))


def leaves(value: object, path: str = "") -> list[tuple[str, object]]:
    """The leaves of a finding's evidence by dotted path; a list is one leaf, its items joined by commas."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}" if path else str(k))]
    return [(path, ",".join(map(str, value)) if isinstance(value, list) else value)]


def evidence_rows(spark: SparkSession, df: DataFrame, options: Options, wanted: dict[tuple[str, str], str]) -> DataFrame:
    """(check, path, value, text): the wanted evidence of the findings; numbers and truth values are values, all else is text."""
    rows = []
    for f in diagnose(df, options):
        for path, x in leaves(f.evidence):
            if (f.key, path) in wanted:
                rows.append((f.key, path, None if x is None or isinstance(x, str) else round(float(x), 6) + 0.0, x if isinstance(x, str) else None))
    return spark.createDataFrame(rows, "check string, path string, value double, text string")


def facts(numbers: list[str], others: dict[tuple[str, str], str]) -> dict[tuple[str, str], str]:
    """SQL of evidence by (check, path), over a table ``t`` and its class counts ``c``; texts are told by how their SQL begins."""
    size, label, noise, scale = "sample_size_vs_feature_dimension", "label_distribution", "noise_level", "feature_scale"
    out = {(size, "n_rows_sampled"): "(SELECT count(*) FROM t)", (label, "classes"): "(SELECT count(*) FROM c)", (label, "minority_rate"): "(SELECT min(n) / sum(n) FROM c)", (label, "imbalance_ratio"): "(SELECT max(n) / min(n) FROM c)", (label, "rare_event"): "(SELECT min(n) / sum(n) < 0.05 FROM c)", (label, "long_tail"): "(SELECT count(*) >= 10 AND max(n) / sum(n) < 0.5 FROM c)"}
    rates = []
    for x in numbers:
        rates.append(f"(SELECT avg((q3 > q1 AND ({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)))::INT) FROM t, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM t))")
        out[noise, f"outlier_rate_by_feature.{x}"] = rates[-1]
        for name, f in (("min", "min({})"), ("max", "max({})"), ("std", "stddev_pop({})"), ("q05", "quantile_cont({}, 0.05)"), ("q95", "quantile_cont({}, 0.95)"), ("skew", "coalesce(skewness({}), 0)")):
            out[scale, f"feature_stats.{x}.{name}"] = f"(SELECT {f.format(x)} FROM t)"
    spread, ranges = (f"[{', '.join(f'(SELECT {f.format(x=x)} FROM t)::DOUBLE' for x in numbers)}]" for f in ("stddev_pop({x})", "max({x}) - min({x})"))
    out |= {(noise, "max_numeric_outlier_rate"): f"greatest({', '.join(rates)})", (scale, "numeric_feature_count"): str(len(numbers)), (scale, "std_scale_ratio"): f"list_max({spread}) / list_min({spread})", (scale, "range_scale_ratio"): f"list_max({ranges}) / list_min({ranges})", (scale, "orders_of_magnitude_span"): f"log10(list_max({ranges}) / list_min({ranges}))"}
    return out | others


def facts_oracle(source: str, target: str, wanted: dict[tuple[str, str], str]) -> str:
    rows = [f"SELECT '{check}' AS \"check\", '{path}' AS path, " + (f"CAST(NULL AS DOUBLE) AS value, CAST({x} AS VARCHAR) AS text" if x.startswith(("'", "concat", "array_to_string", "CASE")) else f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS value, CAST(NULL AS VARCHAR) AS text") for (check, path), x in wanted.items()]
    return f"WITH t AS ({source}), c AS (SELECT {target}::VARCHAR AS label, count(*) AS n FROM t WHERE {target} IS NOT NULL GROUP BY 1) " + " UNION ALL ".join(rows)


def classes_of(labels: list[str]) -> dict[tuple[str, str], str]:
    return {("label_distribution", f"counts.{x}"): f"(SELECT sum(n) FROM c WHERE label = '{x}')" for x in labels}


ORDER_FACTS = facts(["o_orderkey", "o_custkey", "o_totalprice"], classes_of(["F", "O", "P"]) | {
    ("problem_type", "task_type"): "CASE WHEN (SELECT count(*) FROM c) <= 2 THEN 'binary_classification' ELSE 'multiclass_classification' END", ("problem_type", "target_column"): "'o_orderstatus'", ("data_splitting_structure", "structure"): "'temporal_order_detected'", ("data_splitting_structure", "time_column"): "'o_orderdate'",
    ("data_splitting_structure", "duplicate_row_rate"): "(SELECT count(*) - count(DISTINCT o_orderkey) FROM t) / (SELECT count(*) FROM t)", ("sample_size_vs_feature_dimension", "d_features"): "5", ("sample_size_vs_feature_dimension", "n_over_d"): "(SELECT count(*) / 5 FROM t)", ("missingness", "overall_missing_rate"): "(SELECT avg((o_orderpriority IS NULL OR o_totalprice IS NULL)::INT) FROM t)",
    ("noise_level", "label_conflict_proxy"): "(SELECT count(*) FILTER (n > 1 AND m > 1) / greatest(count(*) FILTER (n > 1), 1) FROM (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS m FROM t GROUP BY o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority))",
    ("correlation_structure", "high_corr_pair_count"): "(SELECT (abs(corr(o_orderkey, o_custkey)) >= 0.9)::INT + (abs(corr(o_orderkey, o_totalprice)) >= 0.9)::INT + (abs(corr(o_custkey, o_totalprice)) >= 0.9)::INT FROM t)",
    ("evaluation_metric", "recommended_metrics"): "CASE WHEN (SELECT min(n) / sum(n) FROM c) < 0.1 THEN 'pr_auc,f1_macro,balanced_accuracy' ELSE 'roc_auc,f1_macro,accuracy' END",
})


@query(facts_oracle("SELECT * FROM orders", "o_orderstatus", ORDER_FACTS))
def findings_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence of the findings of orders, a row for each value."""
    return evidence_rows(spark, table(spark, sf, "orders"), Options(target_column="o_orderstatus", time_column="o_orderdate"), ORDER_FACTS)


LABEL_FACTS = facts(["doc_id", "n_chars", "toxic"], classes_of(["0", "1"]) | {
    ("problem_type", "task_type"): "'binary_classification'", ("problem_type", "target_column"): "'quality'", ("data_splitting_structure", "structure"): "'explicit_split_column'", ("data_splitting_structure", "split_values_sample"): "array_to_string(list_sort((SELECT list(DISTINCT lang) FROM t)), ',')",
    ("sample_size_vs_feature_dimension", "d_features"): "5", ("sample_size_vs_feature_dimension", "n_over_d"): "(SELECT count(*) / 5 FROM t)", ("missingness", "overall_missing_rate"): "(SELECT (count(*) FILTER (quality IS NULL) + count(*) FILTER (toxic IS NULL)) / (6 * count(*)) FROM t)",
    ("missingness", "missing_columns"): "'quality,toxic'", ("missingness", "missing_rate_by_column.quality"): "(SELECT avg((quality IS NULL)::INT) FROM t)", ("missingness", "missing_rate_by_column.lang"): "(SELECT avg((lang IS NULL)::INT) FROM t)", ("missingness", "max_missing_indicator_corr"): "(SELECT abs(corr((quality IS NULL)::INT, (toxic IS NULL)::INT)) FROM t)",
    ("missingness", "target_missingness_signal"): "(SELECT 0.5 * sum(abs(gone / sum_gone - there / sum_there)) FROM (SELECT quality, count(*) FILTER (toxic IS NULL) AS gone, count(*) FILTER (toxic IS NOT NULL) AS there, sum(count(*) FILTER (toxic IS NULL)) OVER () AS sum_gone, sum(count(*) FILTER (toxic IS NOT NULL)) OVER () AS sum_there FROM t GROUP BY quality))",
    ("missingness", "missingness_kind"): "'possibly_informative_missingness'", ("distribution_shift_risk", "base_split"): "concat((SELECT lang FROM t GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1))", ("distribution_shift_risk", "split_values"): "array_to_string((SELECT list(lang ORDER BY n DESC, lang) FROM (SELECT lang, count(*) AS n FROM t GROUP BY lang)), ',')",
    ("evaluation_metric", "recommended_metrics"): "CASE WHEN (SELECT min(n) / sum(n) FROM (SELECT count(*) AS n FROM t GROUP BY quality)) < 0.1 THEN 'pr_auc,f1_macro,balanced_accuracy' ELSE 'roc_auc,f1_macro,accuracy' END",
})


@query(f"WITH {LABELLED}, " + facts_oracle("SELECT * FROM labelled", "quality", LABEL_FACTS).removeprefix("WITH "))
def findings_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence of the findings of documents with their labels, a row for each value."""
    return evidence_rows(spark, labelled(spark, sf), Options(target_column="quality", split_column="lang"), LABEL_FACTS)


@query()
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming rollup over events, run as a batch: the same plan without a watermark."""
    return rollups.by_window(table(spark, sf, "events"), "ts", "event_type", "value", "1 hour")


ORACLES["event_windows"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type AS label, count(*) AS n, count(*) FILTER (value IS NULL OR isnan(value)) AS n_missing, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2, 3"


from siftwell.plans import file_queries, record_queries  # noqa: E402, F401  add their queries to the tables above
