"""A registered query for each operator, on the driver's tables, with SQL to check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.functions import profile
from gritsieve.functions.scalar import frac_year
from gritsieve.operators import categories, completeness, duplicates, embeddings, mcl, neighbours, numeric, typos
from gritsieve.plans import ledger as ledgers
from gritsieve.plans.engine import DataQuality
from gritsieve.plans.ledger import IDX
from gritsieve.plans.storage import materialize, put_bytes, shared_dir
from gritsieve.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

#: The tables are clean; these statements, good in both dialects, plant what is to be found.
DIRT = {
    "copied": """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from {orders} union all
        select o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from {orders} where o_orderkey % 500 = 0""",
    "holes": """select c_custkey, case when c_custkey % 50 = 0 then null else c_name end as c_name, case when c_custkey % 50 = 0 then null else c_nationkey end as c_nationkey,
        c_acctbal, case when c_custkey % 50 = 0 then null else c_mktsegment end as c_mktsegment from {customer}""",
    "order": """select l_orderkey * 10 + l_linenumber as id, l_quantity, case when l_orderkey % 5000 = 1 then -l_extendedprice else l_extendedprice end as l_extendedprice from {lineitem}""",
    "pairs": """select o_orderkey, o_orderstatus as a, case when o_orderkey % 10000 = 3 then 'S_X' else concat('S_', o_orderstatus) end as b from {orders}""",
    "misspelt": """select o_orderkey, case when o_orderkey % 3000 = 7 then concat(substr(o_orderpriority, 1, 2), substr(o_orderpriority, 4)) else o_orderpriority end as priority from {orders}""",
    "gaps": """select p_partkey, p_name, p_brand, p_type, p_size, case when p_partkey % 40 = 0 then null else p_retailprice end as p_retailprice from {part}""",
    "odd": """select o_orderkey, case when o_orderkey = 77 then 'ODD' else o_orderstatus end as s from {orders}""",
    "mixed": """select c_custkey + shift as c_custkey, case when c_custkey % 50 = 0 then null else c_name end as c_name, case when c_custkey % 50 = 0 then null else c_nationkey end as c_nationkey,
        floor(c_acctbal / 10) * 10 * case when c_custkey % 400 = 1 then 1000 else 1 end as balance, case when c_custkey % 50 = 0 then null else c_mktsegment end as c_mktsegment
        from {customer} cross join (select 0 as shift union all select 100000000 as shift) s where shift = 0 or c_custkey % 200 = 1""",
    "whole": """select o_orderkey + shift as id, case when o_orderkey % 1000 = 5 then null when o_orderkey % 3000 = 7 then concat(substr(o_orderpriority, 1, 2), substr(o_orderpriority, 4)) else o_orderpriority end as priority,
        case when o_orderkey % 1000 = 5 then null else floor(o_totalprice / 1000) * 1000 * case when o_orderkey % 5000 = 3 then 1000 else 1 end end as price,
        case when o_orderkey % 1000 = 5 then null else o_orderstatus end as status, o_custkey as customer
        from {orders} cross join (select 0 as shift union all select 100000000 as shift) s where shift = 0 or o_orderkey % 400 = 1""",
    "parts": """select p_partkey, p_size as low, p_size + case when p_partkey % 2500 = 1 then -1 else 10 end as high, p_retailprice as price, concat(p_name, cast(p_partkey as string)) as name from {part}""",
    "second": """select o_orderkey, o_orderstatus as a, case when o_orderkey % 10000 = 3 then 'S_X' else concat('S_', o_orderstatus) end as b, o_totalprice as low,
        o_totalprice + case when o_orderkey % 5000 = 1 then -1 else 10 end as high from {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str, recipe: str) -> DataFrame:
    text = DIRT[recipe]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "part") if f"{{{t}}}" in text})


def quality(df: DataFrame, **params) -> DataQuality:
    """A table whose first column is its row id."""
    return DataQuality(df, index_col=df.columns[0], **params)


def findings(ledger: DataFrame) -> DataFrame:
    return ledger.select("idx", "check", "errtype", "column", "column2", F.round("num1", 4).alias("num1"), F.round("num2", 4).alias("num2"))


def texts(ledger: DataFrame) -> DataFrame:
    return ledger.select("idx", "check", "errtype", "column", "column2", "value1", "value2")


def column_uniqueness(spark, sf):
    df = table(spark, sf, "lineitem")
    return profile.uniqueness_table(df, df.columns).select("column", F.round("uniqueness", 6).alias("uniqueness"))


def column_null_fraction(spark, sf):
    df = dirty(spark, sf, "holes")
    return profile.null_fraction_table(df, df.columns).select("column", F.round("null_fraction", 6).alias("null_fraction"))


def column_kinds(spark, sf):
    return profile.kinds_table(table(spark, sf, "events"))


def fractional_year(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(frac_year(F.col("o_orderdate")), 6).alias("year"))


def shared_label_codes(spark, sf):
    return profile.label_codes(dirty(spark, sf, "pairs"), ["a", "b"]).select("value", F.col("code").cast("long").alias("code"))


def string_correlation(spark, sf):
    return profile.string_correlation(dirty(spark, sf, "pairs"), ["a", "b"]).select("column1", "column2", F.round("corr", 6).alias("corr"))


def _mask(keep):
    return lambda spark, sf: duplicates.duplicated(quality(dirty(spark, sf, "copied")).data, keep).select(F.col(IDX).alias("idx"), "duplicated")


def dedup_rows(spark, sf):
    return duplicates.deduplicated(quality(dirty(spark, sf, "copied")).data).select(F.col(IDX).alias("idx"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def check_duplication(spark, sf):
    return findings(quality(dirty(spark, sf, "copied")).check_duplication())


def check_duplication_strict(spark, sf):
    return findings(quality(dirty(spark, sf, "copied"), semantics="strict").check_duplication())


def drop_non_unique_high(spark, sf):
    return duplicates.non_unique(quality(dirty(spark, sf, "copied")).data, "o_totalprice", 0.9, clean_dup=False).select(F.col(IDX).alias("idx"))


def drop_non_unique_low(spark, sf):
    return duplicates.non_unique(quality(dirty(spark, sf, "odd")).data, "s", thresh_2=0.01, clean_dup=False).select(F.col(IDX).alias("idx"), "s")


def check_completeness(spark, sf):
    return findings(quality(dirty(spark, sf, "holes")).check_completeness())


def empty_columns(spark, sf):
    df = dirty(spark, sf, "holes")
    found = completeness.empty_columns(tables.prepare(df, index_col="c_custkey"), 0.02)
    return spark.createDataFrame([(c,) for c in found], "column string")


def zscore_rows(spark, sf):
    q = quality(table(spark, sf, "events"))
    return numeric.z_score(q.data, "value", q.uniq_col["value"]).select(F.col(IDX).alias("idx"), F.round("value", 6).alias("value"))


def check_extreme_value(spark, sf):
    return findings(quality(table(spark, sf, "events")).check_extreme_value())


def check_extreme_value_tuned(spark, sf):
    return findings(quality(table(spark, sf, "events")).check_extreme_value(thresh_std=4.5, thresh_unique1=0.99))


def check_tendency(spark, sf):
    return findings(quality(dirty(spark, sf, "order")).check_tendency())


def knn_impute(spark, sf):
    q = quality(dirty(spark, sf, "gaps"))
    return q.imputation().select(F.col(IDX).alias("idx"), "p_size", F.round("p_retailprice", 6).alias("p_retailprice"))


def lof_scores(spark, sf):
    q = quality(table(spark, sf, "part"))
    return q.outlier_lof().select(F.col(IDX).alias("idx"), F.round("lof", 6).alias("lof"))


def check_outlier(spark, sf):
    return findings(quality(table(spark, sf, "part")).check_outlier(contamination=0.01))


def check_logic(spark, sf):
    q = quality(dirty(spark, sf, "pairs"))
    q.corr_col = categories.correlated(q.data, q.roles, q.uniq_col, 0.5, thresh_unique=0.01)
    return texts(q.check_logic(thres_uniqueness=0.01))


def check_mixed_logic(spark, sf):
    return findings(quality(table(spark, sf, "events").drop("ts", "props")).check_mixed_logic(thres_unique_str=0.01, thresh_std=5))


def check_mixed_logic_strict(spark, sf):
    return findings(quality(table(spark, sf, "events").drop("ts", "props"), semantics="strict").check_mixed_logic(thres_unique_str=0.01, thresh_std=5))


def col_combined_result(spark, sf):
    q = quality(dirty(spark, sf, "copied"))
    q.check_duplication()
    return q.col_combined_result("o_orderstatus", "o_orderpriority").select(F.col(IDX).alias("idx"), "o_orderstatus", "o_orderpriority")


def dual_hist(spark, sf):
    return quality(dirty(spark, sf, "pairs")).dual_hist("a", "b")


def _names(spark, sf):
    return mcl.vocabulary(table(spark, sf, "part"), "p_name")


def string_similarity(spark, sf):
    return typos.string_similarity(_names(spark, sf)).select("i", "j", F.round("s", 6).alias("s"))


def tf_vectors(spark, sf):
    return mcl.tf_vectors(_names(spark, sf)).select(F.col("id").cast("long").alias("id"), "token", F.round("w", 6).alias("w"))


def _matrix(step, digits=6):
    def run(spark, sf):
        m = materialize(mcl.cosine_similarity(_names(spark, sf)))
        return step(m).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("v", digits).alias("v"))

    return run


def _nations(spark, sf):
    return mcl.vocabulary(table(spark, sf, "nation"), "n_name")


def mcl_labels(spark, sf):
    words = _nations(spark, sf)
    labels = mcl.MarkovClustering(mcl.tf_vectors(words)).fit().extract_labels()
    return labels.join(words.select("id", "word"), "id").select("id", "word", "label")


def mcl_clusters(spark, sf):
    found = mcl.clusters(mcl.word_clusters(_nations(spark, sf)).select("label", "id"))
    return found.select("label", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def distance_matrix(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.explode(F.create_map(F.lit("key"), F.col("n_nationkey").cast("double"), F.lit("region"), F.col("n_regionkey").cast("double"))).alias("token", "w"))
    each = [mcl.feature_similarity(rows, rows.select("id").distinct(), m).select(F.lit(m).alias("metric"), "i", "j", F.round("v", 6).alias("v")) for m in ("euclidean", "manhattan")]
    return each[0].unionByName(each[1])


def string_similarity_regions(spark, sf):
    words = mcl.vocabulary(table(spark, sf, "region"), "r_name")
    return typos.string_similarity(words).select("i", "j", F.round("s", 6).alias("s"))


def rare_words(spark, sf):
    rows = dirty(spark, sf, "misspelt")
    return typos.rare_words(typos.clustered(typos.vocabularies(rows, ["priority"]))).select("column", "word", "n")


def typo_rows(spark, sf):
    rows = dirty(spark, sf, "misspelt").select(F.col("o_orderkey").alias(IDX), "priority")
    return typos.typo_rows(rows, "priority").select(F.col(IDX).alias("idx"), "word")


def check_extension(spark, sf):
    paths = ("a.csv", "dir/B.JSON", "c.sql", "d.xlsx", "e.parquet", "e.parquet/", "f.txt", "csv", "g.csv.gz")
    return spark.createDataFrame([(p, tables.check_extension(p)) for p in paths], "path string, kind string")


def push_bad_index(spark, sf):
    q = quality(table(spark, sf, "nation"))
    q.push_bad_index(ledgers.finding(q.data.filter("n_regionkey = 3"), "own", "note", F.lit("n_name"), value1=F.col("n_name")))
    q.push_bad_index(ledgers.finding(q.data.filter("n_regionkey = 4"), "own", "note", F.lit("n_regionkey"), num1=F.col("n_regionkey")))
    return q.bad_index.select("idx", "check", "errtype", "column", "value1", "num1")


def set_profile(spark, sf):
    """The profile as it is set: numbers without the date, and a uniqueness that leaves ``value`` out."""
    q = quality(table(spark, sf, "events"))
    q.nbr_col = ["user_id", "value"]
    q.uniq_col = {**q.uniq_col, "user_id": 0.5, "value": 1.0}
    return findings(q.check_extreme_value(thresh_std=1.5))


def load_by_default(spark, sf):
    """A table as it is loaded: without its first column, rows numbered as they are read."""
    path = f"{shared_dir(spark)}/region-{spark.sparkContext.applicationId}.csv"
    table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return DataQuality.load(spark, path).data.select(F.col(IDX).alias("idx"), "r_name")


def read_sql_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/nation-{spark.sparkContext.applicationId}.sql"
    query = f"select n_nationkey,\n n_name from parquet.`{sf}/nation.parquet`\nwhere n_regionkey < 3;"
    spark.createDataFrame([(query,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return tables.read(spark, path)


def read_excel_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/nation-{spark.sparkContext.applicationId}.xlsx"
    put_bytes(spark, path, tables.workbook(["key", "name", "region"], [(r.n_nationkey, r.n_name, r.n_regionkey) for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]))  # 25 rows
    return tables.read(spark, path)


def mcl_clusters_of_parts(spark, sf):
    found = mcl.clusters(mcl.word_clusters(_names(spark, sf)).select("label", "id"))
    return found.select("label", F.size("members").alias("words"))


def typo_correction(spark, sf):
    words = dirty(spark, sf, "misspelt").select(F.col("o_orderkey").alias(IDX), F.concat(F.regexp_replace("priority", "[^A-Za-z]+", " "), F.when(F.col("o_orderkey") % 97 == 5, " ").otherwise("")).alias("priority"))
    return mcl.typo_correction(words, "priority").select(F.col(IDX).alias("idx"), "word", "suggestion")


def check_typo_ap(spark, sf):
    return texts(quality(dirty(spark, sf, "misspelt")).check_typo(tresh_unique=0.01))


def check_typo_mcl(spark, sf):
    return texts(quality(dirty(spark, sf, "misspelt")).check_typo(tresh_unique=0.01, method="MCL"))


def typo_suggestions(spark, sf):
    rows = dirty(spark, sf, "misspelt").select(F.col("o_orderkey").alias(IDX), "priority")
    return typos.typo_suggestions(rows, "priority", 2).select(F.col(IDX).alias("idx"), "word", F.array_join("suggestions", "|").alias("suggestions"))


def word_embeddings(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias(IDX), "p_brand", "p_type")
    return embeddings.embedded(rows, ["p_brand", "p_type"]).select(F.col(IDX).alias("idx"), "column", "word", F.size("vector").alias("size"))


def _first(spark, sf):
    q = quality(dirty(spark, sf, "mixed"), semantics="strict")
    return q, q.firstpass("duplication", "extreme_value", "completeness")


def firstpass_ledger(spark, sf):
    return findings(_first(spark, sf)[1])


def good_index_after_firstpass(spark, sf):
    return _first(spark, sf)[0].good_index.select(F.col(IDX).alias("idx"))


def secondpass_ledger(spark, sf):
    q = quality(dirty(spark, sf, "second"))
    return texts(q.secondpass("tendency", "logic", "mixed_logic")).select("idx", "check", "errtype", "column", "column2")


def firstpass_default(spark, sf):
    return findings(quality(dirty(spark, sf, "whole"), semantics="strict").firstpass())


def secondpass_default(spark, sf):
    return findings(quality(dirty(spark, sf, "parts")).secondpass())


def save_result_roundtrip(spark, sf):
    q = quality(table(spark, sf, "events"))
    q.check_extreme_value(thresh_std=4.5)
    path = f"{shared_dir(spark)}/report-{spark.sparkContext.applicationId}.csv"
    q.save_result(path)
    back = tables.read(spark, path)
    return back.select("idx", "column", "errtype", F.round(F.col("value1").cast("double"), 4).alias("value1"))


def read_json_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/nation-{spark.sparkContext.applicationId}.json"
    table(spark, sf, "nation").repartition(4).write.mode("overwrite").json(path)
    return tables.read(spark, path).select("n_nationkey", "n_name", "n_regionkey")


def read_csv_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/holes-{spark.sparkContext.applicationId}.csv"
    dirty(spark, sf, "holes").write.mode("overwrite").option("header", True).csv(path)
    return tables.read(spark, path)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        column_uniqueness, column_null_fraction, column_kinds, fractional_year, shared_label_codes, string_correlation, dedup_rows, check_duplication, check_duplication_strict,
        drop_non_unique_high, drop_non_unique_low, check_completeness, empty_columns, zscore_rows, check_extreme_value, check_extreme_value_tuned, check_tendency, knn_impute, lof_scores,
        check_outlier, check_logic, check_mixed_logic, check_mixed_logic_strict, col_combined_result, dual_hist, string_similarity, tf_vectors, mcl_clusters, typo_correction, check_typo_ap,
        check_typo_mcl, typo_suggestions, rare_words, typo_rows, mcl_labels, mcl_clusters_of_parts, distance_matrix, string_similarity_regions, check_extension, push_bad_index, set_profile,
        load_by_default, read_sql_roundtrip, read_excel_roundtrip, firstpass_default, secondpass_default, word_embeddings, firstpass_ledger, good_index_after_firstpass, secondpass_ledger, save_result_roundtrip, read_json_roundtrip, read_csv_roundtrip,
    )
} | {
    "duplicate_mask_first": _mask("first"), "duplicate_mask_last": _mask("last"), "duplicate_mask_any": _mask(False),
    "cosine_similarity": _matrix(lambda m: m), "mcl_self_loops": _matrix(mcl.self_loops), "mcl_normalize": _matrix(mcl.normalize), "mcl_expand": _matrix(lambda m: mcl.expand(mcl.normalize(m)), 4), "mcl_inflate": _matrix(lambda m: mcl.inflate(mcl.normalize(m))),
}


def _sql(recipe: str) -> str:
    return DIRT[recipe].format(orders="orders", customer="customer", lineitem="lineitem", part="part")


_ORDER_COLUMNS = "o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_COPIED = f"with t as ({_sql('copied')}), c as (select *, min(o_orderkey) over w as lo, max(o_orderkey) over w as hi, count(*) over w as n from t window w as (partition by {_ORDER_COLUMNS})) "
_LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_HOLES = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _extremes(times: float) -> str:
    year = "(year(ts) + month(ts) / 12.0::double + day(ts) / 365.0::double)"
    parts = [
        f"""select event_id as idx, '{c}' as "column", {e}::double as v, avg({e}::double) over () as m, stddev_samp({e}::double) over () as s, (select count(distinct {e}) / count({e})::double from events) as u from events"""
        for c, e in (("ts", year), ("user_id", "user_id"), ("value", "value"))
    ]
    return f"""select idx, 'extreme_value' as "check", 'extreme' as errtype, "column", null::varchar as column2, round(v, 4) as num1, null::double as num2
        from ({' union all '.join(parts)}) where u between 0.0001 and 0.99 and v is not null and not (v > m - {times} * s and v < m + {times} * s)"""


_VOCAB = "words as (select row_number() over (order by p_name) - 1 as id, p_name as word from (select distinct p_name from part where p_name is not null)), tokens as (select id, unnest(regexp_extract_all(lower(word), '\\b\\w\\w+\\b')) as token from words), counts as (select id, token, count(*) as c from tokens group by all), tf as (select id, token, c / sqrt(sum(c * c) over (partition by id)) as w from counts), sim as (select a.id as i, b.id as j, sum(a.w * b.w) as v from tf a join tf b on a.token = b.token and a.id <> b.id group by all union all select id, id, 1.0 from words)"
_LOF = """p as (select p_partkey as id, p_size::double as x, p_retailprice::double as y from part),
 d as (select a.id as i, b.id as j, greatest(abs(a.x - b.x), abs(a.y - b.y)) as d from p a join p b on a.id <> b.id),
 nb as (select i, j, d from d qualify row_number() over (partition by i order by d, j) <= 20),
 kd as (select i, max(d) as kd from nb group by i),
 lrd as (select nb.i, 1.0 / (avg(greatest(kd.kd, nb.d)) + 1e-10) as lrd from nb join kd on kd.i = nb.j group by nb.i),
 lof as (select nb.i, avg(b.lrd) / any_value(a.lrd) as lof from nb join lrd b on b.i = nb.j join lrd a on a.i = nb.i group by nb.i)"""
_MIXED = """e as (select event_id as idx, event_type as c, value as v from events where event_type is not null and value is not null),
 u as (select count(distinct event_type) / count(event_type)::double as ut, count(distinct value) / count(value)::double as uv, count(distinct user_id) / count(user_id)::double as uu from events),
 s as (select c, avg(v) as m, stddev_samp(v) as s from e group by c),
 o as (select distinct e.c, e.v from e join s using (c), u where ut < 0.01 and uv > 0.04 and uv < 0.9 and not coalesce(v > m - 5 * s and v < m + 5 * s, false))"""
_PAIRS = f"""t as ({_sql('pairs')}), n as (select a, b, count(*) as n from t group by all),
 x as (select v, row_number() over (order by v) - 1 as code from (select a as v from t union select b from t)),
 r as (select corr(p.code, q.code) as r from t join x p on p.v = a join x q on q.v = b)"""

_FIRST = f"""t as ({_sql('mixed')}), g as (select *, min(c_custkey) over (partition by c_name, c_nationkey, balance, c_mktsegment) as lo from t), d as (select * from g where c_custkey = lo),
 f as (select avg((c_name is null)::int) as n1, avg((c_nationkey is null)::int) as n2, avg((balance is null)::int) as n3, avg((c_mktsegment is null)::int) as n4 from d),
 u as (select count(distinct balance) / count(balance)::double as ub, count(distinct c_nationkey) / count(c_nationkey)::double as un from t),
 s as (select avg(balance) as m, stddev_samp(balance) as s, avg(c_nationkey) as m2, stddev_samp(c_nationkey) as s2 from d),
 found as (select c_custkey as idx, 'duplication' as "check", 'duplication' as errtype, 'ALL' as "column", null::varchar as column2, c_custkey::double as num1, lo::double as num2 from g where c_custkey <> lo
  union all select c_custkey, 'extreme_value', 'extreme', 'balance', null, round(balance, 4), null from d, s, u where ub between 0.0001 and 0.99 and balance is not null and not coalesce(balance > m - 6 * s and balance < m + 6 * s, false) and s > 0
  union all select c_custkey, 'extreme_value', 'extreme', 'c_nationkey', null, c_nationkey, null from d, s, u where un between 0.0001 and 0.99 and c_nationkey is not null and not coalesce(c_nationkey > m2 - 6 * s2 and c_nationkey < m2 + 6 * s2, false) and s2 > 0
  union all select c_custkey, 'completeness', 'empty', 'All', null, null, null from d, f
   where ((c_name is null)::int + (c_nationkey is null)::int + (balance is null)::int + (c_mktsegment is null)::int) / 4.0 >= 0.7
   and ((n1 < 0.8 and c_name is null)::int + (n2 < 0.8 and c_nationkey is null)::int + (n3 < 0.8 and balance is null)::int + (n4 < 0.8 and c_mktsegment is null)::int)
     / ((n1 < 0.8)::int + (n2 < 0.8)::int + (n3 < 0.8)::int + (n4 < 0.8)::int)::double >= 0.5)"""

_WHOLE = f"""t as ({_sql('whole').replace('as string', 'as varchar')}), g as (select *, min(id) over w as lo, count(*) over w as copies from t window w as (partition by priority, price, status, customer)), d as (select * from g where id = lo),
 f as (select avg((priority is null)::int) as n1, avg((price is null)::int) as n2, avg((status is null)::int) as n3, avg((customer is null)::int) as n4 from d),
 u as (select count(distinct price) / count(price)::double as up, count(distinct customer) / count(customer)::double as uc from t),
 s as (select avg(price) as m, stddev_samp(price) as s, avg(customer) as m2, stddev_samp(customer) as s2 from d),
 v as (select priority, count(*) as n from d where priority is not null group by priority),
 found as (select id as idx, 'duplication' as "check", 'duplication' as errtype, 'ALL' as "column", null::varchar as column2, id::double as num1, lo::double as num2 from g where id <> lo
  union all select id, 'typo', 'typo', 'priority', null, null, null from d join v using (priority) where n <= 10 and priority in ('1-RGENT', '2-IGH', '3-EDIUM', '4-OT SPECIFIED', '5-OW')
  union all select id, 'extreme_value', 'extreme', 'price', null, round(price, 4), null from d, s, u where up between 0.0001 and 0.99 and price is not null and not coalesce(price > m - 6 * s and price < m + 6 * s, false)
  union all select id, 'extreme_value', 'extreme', 'customer', null, customer, null from d, s, u where uc between 0.0001 and 0.99 and not coalesce(customer > m2 - 6 * s2 and customer < m2 + 6 * s2, false)
  union all select id, 'completeness', 'empty', 'All', null, null, null from d, f
   where ((priority is null)::int + (price is null)::int + (status is null)::int + (customer is null)::int) / 4.0 >= 0.7
   and ((n1 < 0.8 and priority is null)::int + (n2 < 0.8 and price is null)::int + (n3 < 0.8 and status is null)::int + (n4 < 0.8 and customer is null)::int)
     / ((n1 < 0.8)::int + (n2 < 0.8)::int + (n3 < 0.8)::int + (n4 < 0.8)::int)::double >= 0.5)"""
_PARTS = """t as (select p_partkey as id, p_size as low, p_size + case when p_partkey % 2500 = 1 then -1 else 10 end as high, p_retailprice as price from part),
 d as (select a.id as i, b.id as j, greatest(abs(a.low - b.low), abs(a.high - b.high), abs(a.price - b.price)) as d from t a join t b on a.id <> b.id),
 nb as (select i, j, d from d qualify row_number() over (partition by i order by d, j) <= 20),
 kd as (select i, max(d) as kd from nb group by i),
 lrd as (select nb.i, 1.0 / (avg(greatest(kd.kd, nb.d)) + 1e-10) as lrd from nb join kd on kd.i = nb.j group by nb.i),
 lof as (select nb.i, avg(b.lrd) / any_value(a.lrd) as lof from nb join lrd b on b.i = nb.j join lrd a on a.i = nb.i group by nb.i),
 c as (select quantile_cont(-lof, 0.0005) as cut from lof),
 twos as (select id, a, b, x, y from (select id, 'low' as a, 'high' as b, low as x, high as y from t union all select id, 'low', 'price', low, price from t union all select id, 'high', 'price', high, price from t)),
 p as (select a, b, count(*) filter (where x < y) / count(*)::double as ab, count(*) filter (where x > y) / count(*)::double as ba from twos group by a, b)"""
_CORRECTED = f"""t as ({_sql('misspelt')}), w as (select o_orderkey as idx, regexp_replace(priority, '[^A-Za-z]+', ' ', 'g') || case when o_orderkey % 97 = 5 then ' ' else '' end as word from t),
 n as (select word, count(*) as n, regexp_extract(trim(word), '[A-Za-z]+$') as k from w group by word), best as (select k, max(n) as top, arg_max(word, n) as suggestion from n group by k)"""

ORACLES: dict[str, str] = {
    "firstpass_default": f"with {_WHOLE} select * from found",
    "secondpass_default": f"""with {_PARTS} select id as idx, 'tendency' as "check", 'Logic error' as errtype, a as "column", b as column2, round(x, 4)::double as num1, round(y, 4)::double as num2 from twos join p using (a, b) where ab > 0.999 and x > y
        union all select id, 'tendency', 'Logic error', b, a, round(y, 4), round(x, 4) from twos join p using (a, b) where ba > 0.999 and y > x
        union all select i, 'outlier', 'Outlier', 'NA', null, null, null from lof, c where -lof < cut""",
    "rare_words": f"""with t as ({_sql('misspelt')}) select 'priority' as "column", priority as word, count(*) as n from t where o_orderkey % 3000 = 7 group by priority having count(*) <= 10""",
    "typo_rows": f"with t as ({_sql('misspelt')}) select o_orderkey as idx, priority as word from t where o_orderkey % 3000 = 7 qualify count(*) over (partition by priority) <= 10",
    # fixed results of exemplar clustering: the urgent and high ones are alike, the low ones like none
    "check_typo_ap": f"""with t as ({_sql('misspelt')}) select min(o_orderkey) as idx, 'typo' as "check", 'typo' as errtype, 'priority' as "column", null::varchar as column2, priority as value1, '' as value2 from t where priority <> '5-LOW' group by priority""",
    "check_typo_mcl": f"""with t as ({_sql('misspelt')}) select min(o_orderkey) as idx, 'typo' as "check", 'typo' as errtype, 'priority' as "column", null::varchar as column2, priority as value1, '' as value2 from t group by priority
        qualify count(*) over (partition by regexp_extract(priority, '[A-Z][A-Z]+$')) > 1""",
    "typo_suggestions": f"""with t as ({_sql('misspelt')}) select o_orderkey as idx, priority as word, case when priority in ('1-RGENT', '2-IGH') then '2-HIGH|1-URGENT' when priority = '3-EDIUM' then '3-MEDIUM|3-EDIUM' else '4-NOT SPECIFIED|4-OT SPECIFIED' end as suggestions
        from t where o_orderkey % 3000 = 7""",
    "typo_correction": f"with {_CORRECTED} select idx, word, suggestion from w join n using (word) join best using (k) where n < top",
    "mcl_labels": "with w as (select n_name as word, row_number() over (order by n_name) - 1 as id from nation) select id, word, min(id) over (partition by split_part(word, ' ', 1)) as label from w",
    "mcl_clusters": "with w as (select n_name as word, row_number() over (order by n_name) - 1 as id from nation) select min(id) as label, string_agg(id::varchar, ',' order by id) as members from w group by split_part(word, ' ', 1)",
    "mcl_clusters_of_parts": "select 0::bigint as label, count(distinct p_name)::int as words from part",
    # fixed values: ratios of the five region names in sorted order
    "string_similarity_regions": "select i::bigint as i, j::bigint as j, s::double as s from (values (0, 0, 1.0), (0, 1, 0.769231), (0, 2, 0.6), (0, 3, 0.166667), (0, 4, 0.235294), (1, 0, 0.769231), (1, 1, 1.0), (1, 2, 0.545455), (1, 3, 0.307692), (1, 4, 0.333333), (2, 0, 0.6), (2, 1, 0.545455), (2, 2, 1.0), (2, 3, 0.0), (2, 4, 0.266667), (3, 0, 0.166667), (3, 1, 0.307692), (3, 2, 0.0), (3, 3, 1.0), (3, 4, 0.235294), (4, 0, 0.117647), (4, 1, 0.111111), (4, 2, 0.266667), (4, 3, 0.235294), (4, 4, 1.0)) v(i, j, s)",
    "distance_matrix": """with p as (select a.n_nationkey::bigint as i, b.n_nationkey::bigint as j, abs(a.n_nationkey - b.n_nationkey)::double as x, abs(a.n_regionkey - b.n_regionkey)::double as y from nation a, nation b)
        select * from (select 'euclidean' as metric, i, j, round(1 - sqrt(x * x + y * y), 6) as v from p union all select 'manhattan', i, j, round(1 - x - y, 6) from p) where v <> 0""",
    "check_extension": "select * from (values ('a.csv', 'csv'), ('dir/B.JSON', 'json'), ('c.sql', 'sql'), ('d.xlsx', 'xlsx'), ('e.parquet', 'parquet'), ('e.parquet/', 'parquet'), ('f.txt', 'none'), ('csv', 'none'), ('g.csv.gz', 'none')) v(path, kind)",
    "push_bad_index": """select n_nationkey::bigint as idx, 'own' as "check", 'note' as errtype, case when n_regionkey = 3 then 'n_name' else 'n_regionkey' end as "column", case when n_regionkey = 3 then n_name else '' end as value1,
        case when n_regionkey = 4 then 4.0::double end as num1 from nation where n_regionkey in (3, 4)""",
    "set_profile": """select event_id as idx, 'extreme_value' as "check", 'extreme' as errtype, 'user_id' as "column", null::varchar as column2, user_id::double as num1, null::double as num2 from events
        qualify not (user_id > avg(user_id) over () - 1.5 * stddev_samp(user_id) over () and user_id < avg(user_id) over () + 1.5 * stddev_samp(user_id) over ())""",
    "load_by_default": "select row_number() over (order by r_regionkey) - 1 as idx, r_name from region",
    "read_sql_roundtrip": "select n_nationkey, n_name from nation where n_regionkey < 3",
    "read_excel_roundtrip": "select n_nationkey::bigint as key, n_name as name, n_regionkey::bigint as region from nation",
    "column_uniqueness": " union all ".join(f"""select '{c}' as "column", round(count(distinct {c}) / count({c})::double, 6) as uniqueness from lineitem""" for c in _LINEITEM),
    "column_null_fraction": f"with t as ({_sql('holes')}) " + " union all ".join(f"""select '{c}' as "column", round(avg(({c} is null)::int), 6) as null_fraction from t""" for c in _HOLES),
    "column_kinds": """select * from (values ('event_id', 'int'), ('ts', 'date'), ('user_id', 'int'), ('event_type', 'str'), ('value', 'float'), ('props', 'str')) v("column", kind)""",
    "fractional_year": "select o_orderkey, round(year(o_orderdate) + month(o_orderdate) / 12.0::double + day(o_orderdate) / 365.0::double, 6) as year from orders",
    "shared_label_codes": f"with t as ({_sql('pairs')}) select value, row_number() over (order by value) - 1 as code from (select a as value from t union select b from t)",
    "string_correlation": f"with {_PAIRS} select 'a' as column1, 'b' as column2, round(r, 6) as corr from r union all select 'b', 'a', round(r, 6) from r",
    "duplicate_mask_first": _COPIED + "select o_orderkey as idx, o_orderkey <> lo as duplicated from c",
    "duplicate_mask_last": _COPIED + "select o_orderkey as idx, o_orderkey <> hi as duplicated from c",
    "duplicate_mask_any": _COPIED + "select o_orderkey as idx, n > 1 as duplicated from c",
    "dedup_rows": _COPIED + "select o_orderkey as idx, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from c where o_orderkey = lo",
    "check_duplication": _COPIED + """, l as (select o_orderkey, row_number() over (order by o_orderkey) as r from c where n > 1 and o_orderkey <> lo), f as (select o_orderkey, row_number() over (order by o_orderkey) as r from c where n > 1 and o_orderkey = lo)
        select l.o_orderkey as idx, 'duplication' as "check", 'duplication' as errtype, 'ALL' as "column", null::varchar as column2, l.o_orderkey::double as num1, f.o_orderkey::double as num2 from l join f using (r)""",
    "check_duplication_strict": _COPIED + """select o_orderkey as idx, 'duplication' as "check", 'duplication' as errtype, 'ALL' as "column", null::varchar as column2, o_orderkey::double as num1, lo::double as num2 from c where o_orderkey <> lo""",
    "drop_non_unique_high": f"with t as ({_sql('copied')}), u as (select count(distinct o_totalprice) / count(o_totalprice)::double as u from t) select o_orderkey as idx from t, u where u > 0.9 qualify count(*) over (partition by o_totalprice) > 1",
    "drop_non_unique_low": f"with t as ({_sql('odd')}), u as (select count(distinct s) / count(s)::double as u from t) select o_orderkey as idx, s from t, u where u < 0.01 qualify count(*) over (partition by s) = 1",
    "check_completeness": f"""with t as ({_sql('holes')}) select c_custkey as idx, 'completeness' as "check", 'empty' as errtype, 'All' as "column", null::varchar as column2, null::double as num1, null::double as num2 from t
        qualify ((c_name is null)::int + (c_nationkey is null)::int + (c_acctbal is null)::int + (c_mktsegment is null)::int) / 4.0 >= 0.7 and c_custkey = min(c_custkey) over (partition by c_name, c_nationkey, c_acctbal, c_mktsegment)""",
    "empty_columns": f"with t as ({_sql('holes')}) " + " union all ".join(f"""select '{c}' as "column" from t having avg(({c} is null)::int) >= 0.02""" for c in _HOLES[1:]),
    "zscore_rows": "select event_id as idx, round(value, 6) as value from events qualify not (value > avg(value) over () - 6 * stddev_samp(value) over () and value < avg(value) over () + 6 * stddev_samp(value) over ())",
    "check_extreme_value": _extremes(6),
    "check_extreme_value_tuned": _extremes(4.5),
    "check_tendency": f"""with t as ({_sql('order')}), p as (select count(*) filter (where l_quantity < l_extendedprice) / count(*)::double as ab, count(*) filter (where l_quantity > l_extendedprice) / count(*)::double as ba from t)
        select id as idx, 'tendency' as "check", 'Logic error' as errtype, 'l_quantity' as "column", 'l_extendedprice' as column2, round(l_quantity, 4) as num1, round(l_extendedprice, 4) as num2 from t, p where ab > 0.999 and l_quantity > l_extendedprice
        union all select id, 'tendency', 'Logic error', 'l_extendedprice', 'l_quantity', round(l_extendedprice, 4), round(l_quantity, 4) from t, p where ba > 0.999 and l_extendedprice > l_quantity""",
    "knn_impute": f"""with t as ({_sql('gaps')}), d as (select p_partkey as id, p_size::double as x, p_retailprice as y from t qualify p_partkey = min(p_partkey) over (partition by p_name, p_brand, p_type, p_size, p_retailprice)),
        nb as (select a.id, b.y from d a join d b on a.y is null and b.y is not null qualify row_number() over (partition by a.id order by sqrt(2.0 * (a.x - b.x) * (a.x - b.x)), b.id) <= 10),
        f as (select id, avg(y) as y from nb group by id) select d.id as idx, x as p_size, round(coalesce(d.y, f.y), 6) as p_retailprice from d left join f on d.id = f.id""",
    "lof_scores": f"with {_LOF} select i as idx, round(lof, 6) as lof from lof",
    "check_outlier": f"""with {_LOF}, c as (select quantile_cont(-lof, 0.01) as cut from lof) select i as idx, 'outlier' as "check", 'Outlier' as errtype, 'NA' as "column", null::varchar as column2, null::double as num1, null::double as num2 from lof, c where -lof < cut""",
    "check_logic": f"""with {_PAIRS}, u as (select count(distinct a) / count(a)::double as ua, count(distinct b) / count(b)::double as ub from t), hit as (select o_orderkey, a, b from t join n using (a, b), r, u where n < 10 and abs(r) >= 0.5 and ua < 0.01 and ub < 0.01)
        select o_orderkey as idx, 'logic' as "check", 'Logic error' as errtype, 'a' as "column", 'b' as column2, a as value1, b as value2 from hit union all select o_orderkey, 'logic', 'Logic error', 'b', 'a', b, a from hit""",
    "check_mixed_logic": f"""with {_MIXED} select idx, 'mixed_logic' as "check", 'Logic error' as errtype, 'event_type' as "column", 'value' as column2, null::double as num1, round(e.v, 4) as num2 from e join o on e.v = o.v""",
    "check_mixed_logic_strict": f"""with {_MIXED} select idx, 'mixed_logic' as "check", 'Logic error' as errtype, 'event_type' as "column", 'value' as column2, null::double as num1, round(e.v, 4) as num2 from e join o on e.v = o.v and e.c = o.c""",
    "col_combined_result": _COPIED + ", l as (select o_orderkey, row_number() over (order by o_orderkey) as r from c where n > 1 and o_orderkey <> lo), f as (select row_number() over (order by o_orderkey) as r from c where n > 1 and o_orderkey = lo) select o_orderkey as idx, o_orderstatus, o_orderpriority from c where o_orderstatus is not null and o_orderpriority is not null and o_orderkey not in (select o_orderkey from l join f using (r))",
    "dual_hist": f"""with t as ({_sql('pairs')}) select a, b, count(*) as "count" from t group by all""",
    "tf_vectors": f"with {_VOCAB} select id, token, round(w, 6) as w from tf",
    "cosine_similarity": f"with {_VOCAB} select i, j, round(v, 6) as v from sim",
    "mcl_self_loops": f"with {_VOCAB} select i, j, round(v + case when i = j then 0.01 else 0 end, 6) as v from sim",
    "mcl_normalize": f"with {_VOCAB} select i, j, round(v / sum(v) over (partition by i), 6) as v from sim",
    "mcl_expand": f"with {_VOCAB}, m as (select i, j, v / sum(v) over (partition by i) as v from sim) select a.i, b.j, round(sum(a.v * b.v), 4) as v from m a join m b on a.j = b.i group by all",
    "mcl_inflate": f"with {_VOCAB}, m as (select i, j, v / sum(v) over (partition by i) as v from sim) select i, j, round(v * v, 6) as v from m where v >= 1e-10",
    "firstpass_ledger": f"""with {_FIRST} select * from found""",
    "good_index_after_firstpass": f"with {_FIRST} select c_custkey as idx from t where c_custkey not in (select idx from found)",
    "secondpass_ledger": f"""with t as ({_sql('second')}), n as (select a, b, count(*) as n from t group by all), x as (select v, row_number() over (order by v) - 1 as code from (select a as v from t union select b from t)),
        r as (select corr(p.code, q.code) as r from t join x p on p.v = a join x q on q.v = b), u as (select count(distinct a) / count(a)::double as ua, count(distinct b) / count(b)::double as ub, avg((low < high)::int) as ab, avg((high < low)::int) as ba from t),
        hit as (select o_orderkey from t join n using (a, b), r, u where n < 10 and abs(r) >= 0.5 and ua < 0.001 and ub < 0.001)
        select o_orderkey as idx, 'tendency' as "check", 'Logic error' as errtype, 'low' as "column", 'high' as column2 from t, u where ab > 0.999 and low > high
        union all select o_orderkey, 'tendency', 'Logic error', 'high', 'low' from t, u where ba > 0.999 and high > low
        union all select o_orderkey, 'logic', 'Logic error', 'a', 'b' from hit union all select o_orderkey, 'logic', 'Logic error', 'b', 'a' from hit""",
    "save_result_roundtrip": f"""select idx, "column", errtype, num1 as value1 from ({_extremes(4.5)})""",
    "read_json_roundtrip": "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation",
    "read_csv_roundtrip": f"select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from ({_sql('holes')})",
}
