"""A query for each mask and metric over whole tables, with DuckDB SQL where the result doesn't hang on drawn numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.core import at_once, new_folder, with_groups, with_position, with_ranks
from veilwork.operators import cluster, group, noise, recode, risk, utility
from veilwork.plans import angles, cache, encode, entity, models, ranking, search, sensitivity, text_vectors
from veilwork.sources import tables
from veilwork.streaming import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.load_data(spark, f"{sf_dir}/{name}.parquet", "parquet")


def _draw(key: str, name: str, seed: int, at: int = 0) -> str:
    """SQL of a keyed draw."""
    return f"((('0x' || substr(md5({key} || '|{name}|{seed}'), {1 + 13 * at}, 13))::bigint + 0.5::double) / 4503599627370496)"


def _normal(key: str, name: str, seed: int) -> str:
    return f"(sqrt(-2 * ln({_draw(key, name, seed)})) * cos(2 * pi() * {_draw(key, name, seed, 1)}))"


def _one(spark: SparkSession, **values: object) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


# --- row-local masks --------------------------------------------------------------------------------------------------


@query("select o_orderkey, round_even(cast(o_totalprice as double), -2) as o_totalprice from orders")
def mask_rounding(spark: SparkSession, d: str) -> DataFrame:
    return recode.rounding(_t(spark, d, "orders"), 2, cols="o_totalprice").select("o_orderkey", "o_totalprice")


@query("select o_orderkey, case when o_totalprice < 100000 then o_totalprice else 100000 end as o_totalprice from orders")
def mask_top_recode(spark: SparkSession, d: str) -> DataFrame:
    return recode.top_recode(_t(spark, d, "orders"), 100000, cols="o_totalprice").select("o_orderkey", "o_totalprice")


@query("select c_custkey, case when c_acctbal > 0 then c_acctbal else -1 end as c_acctbal from customer")
def mask_bottom_recode(spark: SparkSession, d: str) -> DataFrame:
    return recode.bottom_recode(_t(spark, d, "customer"), 0, -1, cols="c_acctbal").select("c_custkey", "c_acctbal")


@query("select c_custkey, case when (case when c_acctbal < 5000 then c_acctbal else 5000 end) > 100 then (case when c_acctbal < 5000 then c_acctbal else 5000 end) else 100 end as c_acctbal from customer")
def mask_topbot_recode(spark: SparkSession, d: str) -> DataFrame:
    out = recode.topbot_recode(_t(spark, d, "customer"), "both", top_cutoff=5000, bottom_cutoff=100, cols="c_acctbal")
    return out.select("c_custkey", "c_acctbal")


@query("select c_custkey, substr(c_name, 4, greatest(length(c_name) - 6, 0)) as c_name from customer")
def mask_truncate_index(spark: SparkSession, d: str) -> DataFrame:
    return recode.truncate(_t(spark, d, "customer"), idx=3, trim_from="both", cols="c_name").select("c_custkey", "c_name")


@query("select c_custkey, case when instr(c_name, '#') > 0 then substr(c_name, instr(c_name, '#') + 1) else c_name end as c_name from customer")
def mask_truncate_match(spark: SparkSession, d: str) -> DataFrame:
    return recode.truncate(_t(spark, d, "customer"), "match", match="#", keep_before=False, cols="c_name").select("c_custkey", "c_name")


@query(r"select o_orderkey, regexp_replace(o_orderpriority, '\bHIGH\b', 'X', 'g') as o_orderpriority, case when o_custkey = 1 then 0 else o_custkey end as o_custkey from orders")
def mask_substitute(spark: SparkSession, d: str) -> DataFrame:
    out = recode.substitute(_t(spark, d, "orders"), "HIGH", "X", cols="o_orderpriority")
    return recode.substitute(out, 1, 0, cols="o_custkey").select("o_orderkey", "o_orderpriority", "o_custkey")


@query("select c_custkey, sha256('pepper' || c_name) as c_name, md5(c_mktsegment) as c_mktsegment from customer")
def mask_hashing(spark: SparkSession, d: str) -> DataFrame:
    out = recode.hashing(_t(spark, d, "customer"), "sha256", salt="pepper", append_salt=False, cols="c_name")
    return recode.hashing(out, "md5", cols="c_mktsegment").select("c_custkey", "c_name", "c_mktsegment")


@query()
def mask_hashing_salted_cells(spark: SparkSession, d: str) -> DataFrame:
    return recode.hashing(_t(spark, d, "customer"), "blake2b", salt=8, key="c_custkey", cols="c_name")


@query("select * from customer")
def mask_rank_swap(spark: SparkSession, d: str) -> DataFrame:
    return recode.rank_swap(_t(spark, d, "customer"), "c_acctbal")


# --- fitted masks -----------------------------------------------------------------------------------------------------


@query("""select c_custkey, case when c_acctbal < 0 or c_acctbal > 10000 then null when c_acctbal <= 2500 then 'a' when c_acctbal <= 5000 then 'b' when c_acctbal <= 7500 then 'c' else 'd' end as c_acctbal from customer""")
def mask_global_recode(spark: SparkSession, d: str) -> DataFrame:
    out = recode.global_recode(_t(spark, d, "customer"), [0, 2500, 5000, 7500, 10000], labels="abcd", cols="c_acctbal")
    return out.select("c_custkey", "c_acctbal")


@query("""with q as (select quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) as q from part)
select p_partkey, case when p_retailprice <= q[1] then 'a' when p_retailprice <= q[2] then 'b' when p_retailprice <= q[3] then 'c' else 'd' end as p_retailprice from part, q""")
def mask_global_recode_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return recode.global_recode(_t(spark, d, "part"), 4, "quantiles", labels="abcd", cols="p_retailprice").select("p_partkey", "p_retailprice")


@query("""with f as (select count(*) as n, avg(c_acctbal) as m from customer),
c as (select m, case when n < 500 then sqrt((n - 1 - 0.05::double) / ((n + 1) * 1.05::double)) else sqrt((n - 1) / (n + n * 0.05::double - 1)) end as c from f)
select c_custkey, round(c * c_acctbal + (1 - c) * m, 6) as c_acctbal from customer, c""")
def mask_noise_restricted(spark: SparkSession, d: str) -> DataFrame:
    out = noise.add_noise(_t(spark, d, "customer"), "restricted", magnitude=5, cols="c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(f"""with f as (select stddev_samp(c_acctbal) as s from customer)
select c_custkey, round(c_acctbal + {_normal("c_custkey", "c_acctbal", 1234)} * 0.05::double * s, 6) as c_acctbal from customer, f""")
def mask_noise_additive(spark: SparkSession, d: str) -> DataFrame:
    out = noise.add_noise(_t(spark, d, "customer"), "additive", key="c_custkey", cols="c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(f"""with f as (select stddev_samp(c_acctbal) as s, avg(c_acctbal) as m, sqrt(1 - 0.05::double ** 2) as d from customer)
select c_custkey, round(c_acctbal * d + (1 - d) * m + {_normal("c_custkey", "c_acctbal", 1234)} * 0.05::double * s, 6) as c_acctbal from customer, f""")
def mask_noise_centered(spark: SparkSession, d: str) -> DataFrame:
    out = noise.add_noise(_t(spark, d, "customer"), "additive", centered=True, key="c_custkey", cols="c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


CORRELATED = """with f as (select var_samp({a}) * {w} as va, covar_samp({a}, {b}) * {w} as ab, var_samp({b}) * {w} as vb from {t}),
r as (select sqrt(va) as r11, ab / sqrt(va) as r21, sqrt(vb - ab * ab / va) as r22 from f),
z as (select {key} as k, {a} as a, {b} as b, {z0} as z0, {z1} as z1 from {t})
"""


@query(CORRELATED.format(a="p_size", b="p_retailprice", w="0.05::double", t="part", key="p_partkey", z0=_normal("p_partkey", "z0", 1234), z1=_normal("p_partkey", "z1", 1234))
       + "select k as p_partkey, cast(trunc(a + z0 * r11) as int) as p_size, round(b + z0 * r21 + z1 * r22, 6) as p_retailprice from z, r")
def mask_noise_correlated(spark: SparkSession, d: str) -> DataFrame:
    out = noise.add_noise(_t(spark, d, "part"), "correlated", key="p_partkey", cols=["p_size", "p_retailprice"])
    return out.select("p_partkey", "p_size", F.round("p_retailprice", 6).alias("p_retailprice"))


@query(CORRELATED.format(a="s", b="x", w="0.0025::double", t="(select c_custkey, dense_rank() over (order by c_mktsegment) - 1 as s, c_acctbal as x from customer)", key="c_custkey", z0=_normal("c_custkey", "z0", 1234), z1=_normal("c_custkey", "z1", 1234))
       + "select k as c_custkey, round(a + z0 * r11, 6) as c_mktsegment, round(b + z0 * r21 + z1 * r22, 6) as c_acctbal from z, r")
def mask_noise_correlated_encoded(spark: SparkSession, d: str) -> DataFrame:
    out = noise.add_noise(_t(spark, d, "customer"), "correlated", encode_non_numeric=True, key="c_custkey", cols=["c_mktsegment", "c_acctbal"])
    return out.select("c_custkey", F.round("c_mktsegment", 6).alias("c_mktsegment"), F.round("c_acctbal", 6).alias("c_acctbal"))


@query()
def mask_noise_outliers(spark: SparkSession, d: str) -> DataFrame:
    return noise.add_noise(_t(spark, d, "part"), "outliers", key="p_partkey", cols=["p_size", "p_retailprice"])


@query(f"""with c as (select list(distinct o_orderpriority order by o_orderpriority) as c from orders),
u as (select o_orderkey, list_position(c, o_orderpriority) as place, c, {_draw("o_orderkey", "o_orderpriority", 1234)} as u from orders, c)
select o_orderkey, c[1 + len(list_filter([1, 2, 3, 4], lambda j: (if(place <= j, j * 0.05::double + 0.75, j * 0.05::double) <= u)))] as o_orderpriority from u""")
def mask_pram_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A matrix that keeps a category with a chance of 0.8."""
    chances = [[0.8 if i == j else 0.05 for j in range(5)] for i in range(5)]
    out = noise.pram(_t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", {"o_orderpriority": chances}, key="o_orderkey")
    return out.select("o_orderkey", "o_orderpriority")


@query("select o_orderpriority is not null as there, count(*) as rows, count(distinct o_orderpriority) as categories, true as near from orders group by 1")
def mask_pram(spark: SparkSession, d: str) -> DataFrame:
    """A drawn matrix keeps each category's expected frequency: within five deviations of a binomial number."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    out = noise.pram(o, "o_orderpriority", key="o_orderkey")
    a, b = (t.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias(n)) for t, n in ((o, "a"), (out, "b")))
    both = a.join(b, "o_orderpriority")
    near = F.bool_and(F.abs(F.col("a") - F.col("b")) <= 5 * F.sqrt(F.col("a") + 1.0))
    return both.groupBy(F.col("o_orderpriority").isNotNull().alias("there")).agg(F.sum("b").alias("rows"), F.count(F.lit(1)).alias("categories"), near.alias("near"))


@query()
def mask_geometric(spark: SparkSession, d: str) -> DataFrame:
    return noise.geometric(_t(spark, d, "part"), ["p_size", "p_retailprice"], key="p_partkey")


@query("select count(*) as rows, count(distinct p_partkey) as keys, true as moved, true as other_columns_stay from part")
def mask_geometric_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """With rows shuffled, the masked values are those of the mask, on other rows."""
    p = _t(spark, d, "part")
    a, b = (noise.geometric(p, ["p_size", "p_retailprice"], key="p_partkey", shuffle=s).select("p_partkey", "p_name", F.round("p_retailprice", 6).alias("v")) for s in (False, True))
    same = a.groupBy("v").count().join(b.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v", "full").filter("not (count <=> c)").count() == 0
    both = b.alias("b").join(a.alias("a"), "p_partkey")
    share = F.avg((F.col("a.v") != F.col("b.v")).cast("double")) > 0.9
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("p_partkey").alias("keys"), (share & F.lit(same)).alias("moved"), F.bool_and(F.col("a.p_name") == F.col("b.p_name")).alias("other_columns_stay"))


# --- ranks and groups -------------------------------------------------------------------------------------------------


@query("""with f as (select c_custkey, c_acctbal as x, rank() over (order by c_acctbal) - 1 as i, count(*) over () as n from customer),
c as (select count(*) as c from f where i = 0),
b as (select *, greatest((i * (n // 4) + n - 2) // (n - 1), (c - 1) * (n // 4) // (n - 1) + 1) as bin from f, c)
select c_custkey, round(avg(x) over (partition by bin), 6) as c_acctbal from b""")
def mask_magg_quantile(spark: SparkSession, d: str) -> DataFrame:
    out = group.microaggregation(_t(spark, d, "customer"), "quantile", aggr=4, cols="c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("""with r as (select c_custkey, c_acctbal as x, (row_number() over (order by c_custkey) - 1) // 3 as k from customer)
select c_custkey, round(avg(x) over (partition by k), 6) as c_acctbal from r""")
def mask_magg_sequential(spark: SparkSession, d: str) -> DataFrame:
    out = group.microaggregation(_t(spark, d, "customer"), "sequential", aggr=3, key="c_custkey", cols="c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("""with r as (select p_partkey, cast(p_size as double) as x, row_number() over (order by p_size, p_partkey) - 1 as i, rank() over (order by p_size) - 1 as lo from part),
chunk as (select i // 5 as k, avg(x) as v from r group by 1)
select p_partkey, round(v, 6) as p_size from r join chunk on lo // 5 = k""")
def mask_magg_ranking(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    out = group.microaggregation(part, "ranking", aggr=5, rank_method="min", key="p_partkey", cols="p_size")
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"))


def _ranking(method: str, rank: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        part = _t(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
        out = group.microaggregation(part, "ranking", aggr=5, rank_method=method, key="p_partkey", cols="p_size")
        return out.select("p_partkey", F.round("p_size", 6).alias("p_size"))

    run.__name__ = f"mask_magg_ranking_{method}"
    query(f"""with r as (select p_partkey, cast(p_size as double) as x, row_number() over (order by p_size, p_partkey) - 1 as i, rank() over (order by p_size) - 1 as lo, count(*) over (partition by p_size) as c, dense_rank() over (order by p_size) - 1 as d from part),
chunk as (select i // 5 as k, avg(x) as v from r group by 1)
select p_partkey, round(v, 6) as p_size from r join chunk on cast({rank} as bigint) // 5 = k""")(run)


for _method, _rank in (("first", "i"), ("max", "lo + c - 1"), ("average", "floor(lo + (c - 1) / 2)"), ("dense", "d")):
    _ranking(_method, _rank)


@query()
def mask_magg_robust(spark: SparkSession, d: str) -> DataFrame:
    return group.microaggregation(_t(spark, d, "part"), "robust", aggr=3, key="p_partkey", cols=["p_size", "p_retailprice"])


@query("select count(*) as rows, round(sum(cast(p_size as double)), 4) as p_size, round(sum(cast(p_retailprice as double)), 2) as p_retailprice, true as enough, true as moved from part")
def mask_magg_robust_groups(spark: SparkSession, d: str) -> DataFrame:
    """Robust groups keep each column's sum, no class has fewer rows than asked for, and few rows stay as they are but those
    that are a class already: three equal rows are the nearest ones, and their mean is what they were."""
    p = _t(spark, d, "part")
    out = group.robust_magg(p, 3, key="p_partkey", cols=["p_size", "p_retailprice"])
    classes = out.groupBy(F.round("p_size", 9).alias("a"), F.round("p_retailprice", 9).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("s"), F.sum("p_retailprice").alias("r"))
    sums = classes.agg(F.sum("n").alias("rows"), F.round(F.sum("s"), 4).alias("p_size"), F.round(F.sum("r"), 2).alias("p_retailprice"), (F.min("n") >= 3).alias("enough"))
    rare = with_groups(p, ["p_size", "p_retailprice"], {"_held": F.count(F.lit(1))}).filter("_held < 3")
    both = out.select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).join(rare, "p_partkey")
    same = both.agg(F.coalesce(F.avg(F.expr("size != p_size or price != p_retailprice").cast("int")) > 0.5, F.lit(True)).alias("moved"))
    return sums.crossJoin(same)  # one row each


@query()
def mask_magg_advanced(spark: SparkSession, d: str) -> DataFrame:
    return group.microaggregation(_t(spark, d, "part"), "advanced", aggr=3, clust="kmeans", reduct="pca", scale="standard", key="p_partkey", cols=["p_size", "p_retailprice"])


def _assigned(spark: SparkSession, d: str, method: str) -> DataFrame:
    """Per row, whether the value's place among the values is the score's place among the scores, and whether the values are as often as before."""
    p = _t(spark, d, "part")
    out = group.shuffle(p, "p_retailprice", "p_size", cor_method=method, key="p_partkey", scores=True)
    before = with_ranks(p.select("p_retailprice"), "p_retailprice").groupBy(F.col("p_retailprice").alias("v")).agg(F.first("_r_n").alias("n"), F.first("_r_c").alias("c"))
    laid = with_position(out.select("p_partkey", "p_retailprice", "score_p_retailprice"), [F.col("score_p_retailprice"), F.col("p_partkey")])
    both = laid.join(before, F.col("p_retailprice") == F.col("v"))
    return both.select("p_partkey", F.expr("_pos >= n and _pos < n + c").alias("in_place"))


@query("select p_partkey, true as in_place from part")
def mask_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d, "spearman")


@query("select p_partkey, true as in_place from part")
def mask_shuffle_kendall(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d, "kendall")


@query("""with r as (select p_size as x, p_retailprice as y, p_partkey as k from part where p_partkey % 4 = 1 or p_partkey % 4 <> 1),
p as (select sign(a.x - b.x) * sign(a.y - b.y) as s, a.x = b.x as tx, a.y = b.y as ty from r a join r b on a.k < b.k)
select round(sum(s) / sqrt(sum(case when tx then 0 else 1 end)::double * sum(case when ty then 0 else 1 end)), 9) as tau from p""")
def stat_kendall(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, tau=round(group.kendall(_t(spark, d, "part"), "p_size", "p_retailprice"), 9))


@query("""with r as (select *, count(c_acctbal) over (partition by c_nationkey, c_mktsegment) as n from customer)
select c_custkey, case when 1 / n > 0.15 then 'NA' else c_mktsegment end as c_mktsegment from r""")
def mask_local_suppression(spark: SparkSession, d: str) -> DataFrame:
    return group.local_suppression(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal", "NA", max_unique=30).select("c_custkey", "c_mktsegment")


# --- risk -------------------------------------------------------------------------------------------------------------


@query("""with c as (select count(*) as n from customer group by c_nationkey, c_mktsegment)
select sum(case when n <= 10 then n else 0 end) / sum(n) as share from c""")
def risk_k_anonymity(spark: SparkSession, d: str) -> DataFrame:
    return risk.k_anonymity_table(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 10)


@query("select bool_and(n > 1) as answer from (select count(*) as n from customer group by c_nationkey, c_mktsegment)")
def risk_is_k_anonymous(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, answer=risk.is_k_anonymous(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 1))


@query("select *, count(*) over w as k_count, count(*) over w > 10 as is_k_anon from customer window w as (partition by c_nationkey, c_mktsegment)")
def risk_k_anonymity_rows(spark: SparkSession, d: str) -> DataFrame:
    return risk.k_anonymity_rows(_t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 10)


@query("""select l_returnflag, l_linestatus, cast(count(distinct l_quantity) as double) as diversity, count(*) as rows from lineitem group by 1, 2""")
def risk_l_diversity_classes(spark: SparkSession, d: str) -> DataFrame:
    return risk.diversity_classes(_t(spark, d, "lineitem"), "l_quantity", quasi=["l_returnflag", "l_linestatus"])


@query("""with c as (select c_nationkey, c_mktsegment, count(*) as c from customer group by 1, 2)
select c_nationkey, cast(sum(c) as bigint) as rows, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 8) as diversity from c group by 1""")
def risk_l_diversity_entropy(spark: SparkSession, d: str) -> DataFrame:
    out = risk.diversity_classes(_t(spark, d, "customer"), "c_mktsegment", "entropy", "c_nationkey")
    return out.withColumn("diversity", F.round("diversity", 8))


@query("""with c as (select c_nationkey, count(distinct c_mktsegment) as v, count(*) as n from customer group by 1)
select sum(case when v <= 4 then n else 0 end) / sum(n) as share, min(v) >= 4 as diverse from c""")
def risk_l_diversity(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    return _one(spark, share=risk.l_diversity(c, "c_mktsegment", 4, quasi=["c_nationkey"]), diverse=risk.is_l_diverse(c, "c_mktsegment", 4, quasi=["c_nationkey"]))


CLOSE_CATEGORIES = """with n as (select count(*) as t from customer), q as (select c_mktsegment as s, count(*) / any_value(t) as q from customer, n group by 1),
k as (select c_nationkey, count(*) as rows from customer group by 1),
p as (select k.c_nationkey, rows, q.s, q.q, (select count(*) from customer c where c.c_nationkey = k.c_nationkey and c.c_mktsegment = q.s) / rows as p from k, q),
e as (select c_nationkey, rows, 0.5 * sum(abs(p - q)) as emd from p group by 1, 2)
"""


@query(CLOSE_CATEGORIES + "select c_nationkey, rows, round(emd, 8) as emd from e")
def risk_t_closeness_categories(spark: SparkSession, d: str) -> DataFrame:
    out = risk.closeness_classes(_t(spark, d, "customer"), "c_mktsegment", "categorical", "c_nationkey")
    return out.withColumn("emd", F.round("emd", 8))


@query("""with v as (select distinct p_size as s from part), m as (select count(*) as m from v), t as (select count(*) as t from part),
k as (select p_brand, count(*) as rows from part group by 1),
g as (select p_size as s, count(*) as g from part group by 1), c as (select p_brand, p_size as s, count(*) as c from part group by 1, 2),
f as (select p_brand, rows, s, coalesce(c, 0) / rows - g / t as diff from k cross join g cross join t left join c using (p_brand, s)),
a as (select p_brand, rows, s, sum(diff) over (partition by p_brand order by s) as cum from f)
select p_brand, rows, round(sum(abs(cum)) / any_value(m - 1), 8) as emd from a, m group by 1, 2""")
def risk_t_closeness_numbers(spark: SparkSession, d: str) -> DataFrame:
    out = risk.closeness_classes(_t(spark, d, "part"), "p_size", "numeric", "p_brand")
    return out.withColumn("emd", F.round("emd", 8))


@query(CLOSE_CATEGORIES + "select sum(case when emd >= 0.1 then rows else 0 end) / sum(rows) as share, max(emd) < 0.1 as close from e")
def risk_t_closeness(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    return _one(
        spark,
        share=risk.t_closeness(c, "c_mktsegment", 0.1, "categorical", ["c_nationkey"]),
        close=risk.is_t_close(c, "c_mktsegment", 0.1, "categorical", ["c_nationkey"]),
    )


@query("""with t as (select count(*) as t from customer), p as (select c_mktsegment, count(*) / any_value(t) as p from customer, t group by 1),
c as (select c_nationkey, c_mktsegment, count(*) as n, count(*) / sum(count(*)) over (partition by c_nationkey) as q from customer group by 1, 2)
select c_nationkey, c.c_mktsegment, n, round(p, 8) as p, round(cast(q as double), 8) as q, q > p and (q - p) / p > least(0.2::double, -ln(p)) as violates from c join p using (c_mktsegment)""")
def risk_beta_likeness_rows(spark: SparkSession, d: str) -> DataFrame:
    out = risk.beta_rows(_t(spark, d, "customer"), "c_mktsegment", 0.2, "c_nationkey")
    return out.select("c_nationkey", "c_mktsegment", "n", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"), "violates")


@query("""with t as (select count(*) as t from customer), p as (select c_mktsegment, count(*) / any_value(t) as p from customer, t group by 1),
c as (select c_nationkey, c_mktsegment, count(*) as n, cast(count(*) / sum(count(*)) over (partition by c_nationkey) as double) as q from customer group by 1, 2)
select round(sum(case when q > p and (q - p) / p > least(0.2::double, -ln(p)) then n else 0 end) / sum(n), 9) as share, bool_and(not (q > p and (q - p) / p > least(0.2::double, -ln(p)))) as "like" from c join p using (c_mktsegment)""")
def risk_beta_likeness(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    return _one(spark, share=round(risk.beta_likeness(c, "c_mktsegment", 0.2, ["c_nationkey"]), 9), like=risk.is_beta_like(c, "c_mktsegment", 0.2, ["c_nationkey"]))


INDIVIDUAL = """with r as (select c_custkey, cast(count(c_acctbal) over w as double) as f, sum(20.0::double) over w as g from customer window w as (partition by c_nationkey, c_mktsegment)),
p as (select *, f / g as p from r)
select c_custkey, round(case when f = g then 1 / f when f = 1 then p / (1 - p) * ln(1 / p) when f = 2 then p / (1 - p) - (p / (1 - p)) ** 2 * ln(1 / p) else p / (f - (1 - p)) end, 8) as risk from p"""


@query(INDIVIDUAL)
def risk_individual(spark: SparkSession, d: str) -> DataFrame:
    out = risk.individual_risk(_t(spark, d, "customer").withColumn("w", F.lit(20.0)), "c_acctbal", ["c_nationkey", "c_mktsegment"], weights="w")
    return out.select("c_custkey", F.round("risk", 8).alias("risk"))


@query("""with recursive r as (select cast(count(c_acctbal) as int) as f, c_nationkey, c_mktsegment from customer group by 2, 3),
i(n, v) as (select 1, ln(20::double) / 0.95 union all select n + 1, (1 / n::double - 0.05::double * v) / 0.95::double from i where n <= (select max(f) from r))
select c_custkey, case when f > 0 then round(0.05::double * v, 6) end as risk from customer join r using (c_nationkey, c_mktsegment) left join i on n = f""")
def risk_individual_exact(spark: SparkSession, d: str) -> DataFrame:
    out = risk.individual_risk(_t(spark, d, "customer").withColumn("w", F.lit(20.0)), "c_acctbal", ["c_nationkey", "c_mktsegment"], "exact", "w")
    return out.select("c_custkey", F.round("risk", 6).alias("risk"))


@query("""select c_custkey, count(c_acctbal) over w as samp_fq, cast(sum(2) over w as double) as pop_fq from customer window w as (partition by c_nationkey)""")
def risk_frequencies(spark: SparkSession, d: str) -> DataFrame:
    out = risk.frequencies(_t(spark, d, "customer").withColumn("w", F.lit(2)), "c_acctbal", "c_nationkey", "w")
    return out.select("c_custkey", "samp_fq", "pop_fq")


@query("select * from supplier")
def risk_suda(spark: SparkSession, d: str) -> DataFrame:
    return risk.suda(_t(spark, d, "supplier"))


@query("""with c as (select count(*) as n, grouping_id(l_returnflag, l_linestatus, l_linenumber) as set from lineitem group by cube (l_returnflag, l_linestatus, l_linenumber))
select set, cast(sum(n) as bigint) as rows, sum(case when n <= 1000 then n else 0 end) / sum(n) as share from c group by set""")
def risk_key_report(spark: SparkSession, d: str) -> DataFrame:
    return risk.key_report(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], 1000)


# --- utility ----------------------------------------------------------------------------------------------------------


@query("select avg(case when o_totalprice < 100000 then 0 else 1 end) / 5 as share from orders")
def utility_proportion_different(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return utility.proportion_different(o, recode.top_recode(o, 99999.995, 100000, cols="o_totalprice"), "o_orderkey")


@query("""with b as (select c_acctbal as x, 0 as t from customer union all select round_even(c_acctbal, -3), 1 from customer),
e as (select min(x) as lo, (max(x) - min(x)) / 99 as w from b),
h as (select cast(least(greatest(ceil((x - lo) / w), 1), 99) as int) as bin, sum(1 - t) as p, sum(t) as q from b, e group by 1),
s as (select p / sum(p) over () as p, q / sum(q) over () as q from h)
select 'c_acctbal' as "column", round(sqrt(sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)), 6) as distance from s""")
def utility_jensen_shannon(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_acctbal")
    return utility.jensen_shannon_columns(c, recode.rounding(c, 3)).withColumn("distance", F.round("distance", 6))


@query("""with v as (select distinct o_orderpriority as s from orders union select case when o_orderpriority = '2-HIGH' then '1-URGENT' else o_orderpriority end from orders),
k as (select s, dense_rank() over (order by s) - 1 as x from v),
b as (select x, 0 as t from orders join k on s = o_orderpriority union all select x, 1 from orders join k on s = case when o_orderpriority = '2-HIGH' then '1-URGENT' else o_orderpriority end),
e as (select min(x) as lo, (max(x) - min(x)) / 99 as w from b),
h as (select cast(least(greatest(ceil((x - lo) / w), 1), 99) as int) as bin, sum(1 - t) as p, sum(t) as q from b, e group by 1),
s as (select p / sum(p) over () as p, q / sum(q) over () as q from h)
select round(sqrt(sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)), 6) as distance from s""")
def utility_jensen_shannon_encoded(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderpriority")
    changed = o.select(F.when(F.col("o_orderpriority") == "2-HIGH", "1-URGENT").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return _one(spark, distance=round(utility.jensen_shannon(o, changed), 6))


@query()
def utility_propensity(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select("p_size", "p_retailprice", "p_brand")
    return _one(spark, score=utility.propensity_score(p, noise.add_noise(p, "additive", magnitude=80, cols="p_retailprice"), method="rfclass"))


@query()
def utility_attribute_inference(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("large"))
    return _one(spark, score=utility.auc_score(o, recode.rounding(o, 5, cols="o_totalprice"), "large", "logreg"))


@query("select round(avg(abs((o_totalprice - 150000) / o_totalprice)) * 100, 6) as mape from orders where o_totalprice <> 0")
def utility_mape(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").agg(F.round(utility.mape(F.col("o_totalprice"), F.lit(150000.0)), 6).alias("mape"))


@query("""with s as (select c_acctbal as threshold, sum(case when c_mktsegment = 'BUILDING' then 1 else 0 end) as p, count(*) as n from customer group by 1)
select threshold, round(sum(p) over o / sum(p) over (), 9) as tpr, round((sum(n) over o - sum(p) over o) / (sum(n) over () - sum(p) over ()), 9) as fpr from s window o as (order by threshold desc)""")
def utility_roc_points(spark: SparkSession, d: str) -> DataFrame:
    scored = _t(spark, d, "customer").withColumn("y", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    return utility.roc_points(scored, "y", "c_acctbal").select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


# --- clusterings by distance ------------------------------------------------------------------------------------------

#: Customers by balance and nation, and the classes of those within a distance of each other, by a closure over the pairs.
NEAR_SQL = """with recursive x as (select c_custkey as k, c_acctbal / 100 as a, c_nationkey * 3.0 as b from customer),
near as (select p.k as u, q.k as v from x p join x q on (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) <= {limit}),
core as (select u as k from near group by u having count(*) >= {least}),
links as (select u, v from near where u in (select k from core) and v in (select k from core)),
walk as (select k as root, k from core union select w.root, l.v from walk w join links l on l.u = w.k),
label as (select k, min(root) as first from walk group by k)"""


def _customers(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return cluster.features_of(c, {"a": F.col("c_acctbal") / 100, "b": F.col("c_nationkey") * 3.0})


def _by_first(found: DataFrame) -> DataFrame:
    """Clusters named by their smallest customer instead of by the order of their points."""
    return found.join(found.groupBy("prediction").agg(F.min("c_custkey").alias("first")), "prediction")


@query(NEAR_SQL.format(limit=1.44, least=4) + """
select x.k as c_custkey, x.k in (select k from core) as core, l.first from x left join label l on l.k = x.k where x.k in (select k from core)""")
def cluster_density_cores(spark: SparkSession, d: str) -> DataFrame:
    """Cores of the density clusters, each cluster named by its smallest core."""
    cores = cluster.dbscan(_customers(spark, d), 1.2, 4).filter("core").select("c_custkey", "prediction", "core")
    return _by_first(cores).select("c_custkey", "core", "first")


@query(NEAR_SQL.format(limit=1.44, least=4) + """
select x.k as c_custkey, x.k in (select u from near where v in (select k from core)) as clustered from x""")
def cluster_density_noise(spark: SparkSession, d: str) -> DataFrame:
    """Which rows are of a cluster: cores, and those within the radius of one."""
    return cluster.dbscan(_customers(spark, d), 1.2, 4).select("c_custkey", (F.col("prediction") >= 0).alias("clustered"))


@query(NEAR_SQL.format(limit=1, least=1) + "\nselect k as c_custkey, first from label")
def cluster_single_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Agglomerative clusters cut where they lie more than 1 apart."""
    found = cluster.single_linkage(_customers(spark, d), distance=1.0).select("c_custkey", "prediction")
    return _by_first(found).select("c_custkey", "first")


FEATURES_SQL = """with x as (select c_acctbal / 100 as a, (c_nationkey * 3)::double as b from customer), low as (select min(a) as la, min(b) as lb from x),
c as (select l, cast(floor((a - la) / {side}::double) as bigint) >> (l + 1) // 2 as i, cast(floor((b - lb) / {side}::double) as bigint) >> l // 2 as j,
  count(*) as n, sum(a) as a1, sum(b) as b1, sum(a * a) as a2, sum(b * b) as b2 from x, low, (select unnest(range(60)) as l) group by all),
pick as (select min(l) as l from (select l from c group by l having count(*) <= {most}))
"""


@query(FEATURES_SQL.format(side=0.5 / 2**0.5, most=200) + "select i, j, n, round(a1, 6) as a1, round(b1, 6) as b1, round(a2, 5) as a2, round(b2, 5) as b2 from c join pick using (l)")
def cluster_features(spark: SparkSession, d: str) -> DataFrame:
    """The level of the tree of clustering features that holds 200 of them at most."""
    found, at = cluster.feature_tree(_customers(spark, d), 0.5, 200)[0], F.col("cell")
    sums = [F.round(F.col(c)[i], 7 - k).alias(f"{n}{k}") for k, c in ((1, "sums"), (2, "squares")) for i, n in enumerate("ab")]
    return found.select(at[0].alias("i"), at[1].alias("j"), "n", *sums)


@query("select count(*) as n, round(sum(c_acctbal), 4) as balance, 8 as clusters from customer")
def cluster_birch(spark: SparkSession, d: str) -> DataFrame:
    """Customers in eight clusters of clustering features: all of them, whole."""
    found = cluster.birch(_customers(spark, d), 8, 0.5, 200).filter("prediction >= 0")
    each = found.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance"))
    return each.agg(F.sum("n").alias("n"), F.round(F.sum("balance"), 4).alias("balance"), F.count(F.lit(1)).cast("int").alias("clusters"))


@query(r"""with w as (select p_partkey, unnest(regexp_split_to_array(lower(p_brand || ' ' || p_type || ', ' || p_type), '[^a-z0-9]+')) as w from part), c as (select p_partkey, w, count(*) as c from w where w <> '' group by all),
m as (select w, sum(c) / (select count(*) from part) as m from c group by w), s as (select sum(m * m) as s from m)
select p.p_partkey, round(coalesce(sum(c.c * c.c), 0), 6) as of_counts, round(coalesce(sum(c.c * c.c - 2 * c.c * m.m), 0) + any_value(s.s), 6) as of_centred
from part p cross join s left join c using (p_partkey) left join m using (w) group by p.p_partkey""")
def encode_text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as long as the texts have directions keep every text's length: as it is (truncated), and from the mean (pca)."""
    part = _t(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" "), "p_type", F.lit(", "), "p_type").alias("said"))
    for name, method in (("of_counts", "truncated"), ("of_centred", "pca")):
        vector = text_vectors.fit(part, "said", 40, method, 1 << 14, near=1e-6).column(F.col("said"))
        part = part.withColumn(name, F.round(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v), 6))
    return part.drop("said")


# --- encoders, models, ranking, sensitivity, searches -----------------------------------------------------------------


@query("select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as o_orderpriority, dense_rank() over (order by o_orderstatus) - 1 as o_orderstatus from orders")
def encode_labels(spark: SparkSession, d: str) -> DataFrame:
    return encode.label_encode(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"))


@query()
def encode_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return encode.embed(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"), "o_orderstatus")


@query("select o_orderpriority, o_orderstatus, count(*) as n, true as near from orders group by all")
def encode_trained_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that can hold every status' share: read from them, shares are those of the orders to one in a hundred."""
    o = _t(spark, d, "orders")
    each = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    sums = each.groupBy(F.col("o_orderpriority").alias("_v")).agg(F.sum("n").alias("all"))
    said = entity.fit(o, "o_orderpriority", "o_orderstatus", 4, rounds=6).shares().join(sums, "_v")
    both = each.join(said, (F.col("_v") == F.col("o_orderpriority")) & (F.col("class") == F.col("o_orderstatus")), "left")
    return both.select("o_orderpriority", "o_orderstatus", "n", (F.abs(F.col("share") - F.col("n") / F.col("all")) < 0.01).alias("near"))


@query("select * from (values ('c_custkey', 'numerical'), ('c_name', 'textual'), ('c_mktsegment', 'categorical')) t(col, kind)")
def encode_column_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = encode.column_kinds(_t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    return spark.createDataFrame(list(kinds.items()), "col string, kind string")


@query("select unnest(['logreg', 'rfclass', 'tpotclass', 'larscv', 'encv', 'rfreg', 'tpotreg']) as model, true as tells")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Whether each kind of classifier and regressor tells, on rows that it hasn't seen, which parts cost more than most."""
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (F.col("p_retailprice") + F.col("p_size")).alias("sum"))
    middle = rows.agg(F.percentile("sum", 0.5)).first()[0]
    rows = rows.withColumn("label", (F.col("sum") > middle).cast("int")).withColumn("price", F.col("sum") - F.col("p_size"))
    seen = F.pmod(F.xxhash64("p_partkey"), F.lit(4)) != 0

    def tells(m: str) -> tuple[str, bool]:
        return m, bool(models.auc(models.train(rows.filter(seen), ["p_size", "price"], "label", m), rows.filter(~seen), "label") > 0.8)

    names = sorted((*models.CLASSIFIERS, *models.REGRESSORS), key=lambda m: m not in ("logreg", "tpotclass", "tpotreg"))  # the longest first
    return spark.createDataFrame(at_once(tells, names), "model string, tells boolean")


@query("""with x as (select cast(l_quantity as double) a, cast(l_linenumber as double) b, cast(l_extendedprice as double) y from lineitem),
m as (select stddev_pop(a) sa, stddev_pop(b) sb, covar_pop(a, y) / stddev_pop(a) ra, covar_pop(b, y) / stddev_pop(b) rb, corr(a, b) r from x),
f as (select *, abs(ra) >= abs(rb) as a_first, case when abs(ra) >= abs(rb) then ra else rb end as big, case when abs(ra) >= abs(rb) then rb else ra end as small from m),
g as (select *, sign(big) as s, least((abs(big) - small) / (1 - r * sign(big)), (abs(big) + small) / (1 + r * sign(big))) as way from f),
k as (select 0 as step, abs(big) as penalty, 0.0 as one, 0.0 as two, * from g
union all select 1, abs(big) - way, s * way, 0.0, * from g
union all select 2, 0.0, (big - r * small) / (1 - r * r), (small - r * big) / (1 - r * r), * from g)
select step, round(penalty, 4) as penalty, round(case when a_first then one else two end / sa, 6) as l_quantity,
round(case when a_first then two else one end / sb, 6) as l_linenumber from k""")
def model_least_angle_path(spark: SparkSession, d: str) -> DataFrame:
    """The knots of a lasso of two columns over all lines: where each joins, and the least squares."""
    found = angles.knots_table(_t(spark, d, "lineitem"), ["l_quantity", "l_linenumber"], "l_extendedprice")
    return found.select("step", F.round("penalty", 4).alias("penalty"), F.round("l_quantity", 6).alias("l_quantity"), F.round("l_linenumber", 6).alias("l_linenumber"))


@query("select * from region")
def model_cache(spark: SparkSession, d: str) -> DataFrame:
    """A table kept under the content of the rows that it was made from: the second time it is read, not made."""
    folder, r = new_folder(spark, "cache"), _t(spark, d, "region")
    cache.kept(folder, "regions", r, lambda: r, DataFrame)
    return cache.kept(folder, "regions", r.orderBy(F.desc("r_regionkey")), lambda: r.limit(0), DataFrame)


@query()
def ranking_key_variables(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").withColumn("rich", (F.col("c_acctbal") > 4500).cast("int")).select("rich", "c_acctbal", "c_nationkey", "c_mktsegment")
    return ranking.explore_key_variables(c, "rich")["ranking"]


@query()
def sensitivity_sobol(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select("p_size", "p_retailprice")
    params = sensitivity.parameters(p)
    table = sensitivity.samples(params, spark=spark)
    return sensitivity.analyze(lambda t: t.withColumn("prediction", F.col("p_size") * 10 + F.col("p_retailprice")), params, table)


# directions of four dimensions by their recurrences: 1; x + 1; x^2 + x + 1; x^3 + x + 1
SOBOL_SQL = """with recursive k as (select 0 as k, 1::bigint as p, 1::bigint as q1, 1::bigint as r1, 3::bigint as r2, 1::bigint as s1, 3::bigint as s2, 1::bigint as s3
  union all select k + 1, xor(2 * p, p), r1, r2, xor(xor(2 * r2, 4 * r1), r1), s2, s3, xor(xor(4 * s2, 8 * s1), s1) from k where k < 16),
v as (select unnest([1, 2, 3, 4]) as d, k, (unnest([1, p, q1, s1]) << (39 - k))::bigint as v from (select k, p, r1 as q1, s1 from k)),
x as (select i, d, bit_xor(case when (xor(i + 16384, (i + 16384) >> 1) >> k) & 1 = 1 then v else 0 end)::double / 1099511627776 as x from (select unnest(range(10000)) as i), v group by i, d),
w as (select i, max(case when d = 1 then x end) as a, max(case when d = 2 then x end) as b, max(case when d = 3 then x end) as c, max(case when d = 4 then x end) as d from x group by i),
m as (select i, unnest(['a', 'b', 'ab0', 'ab1', 'ba0', 'ba1']) as matrix, unnest([a, c, c, a, a, c]) as x, unnest([b, d, b, d, d, b]) as y from w),
e as (select min(p_size) as s0, max(p_size) as s1, min(p_retailprice) as r0, max(p_retailprice) as r1 from part)
select i as base, matrix, round(s0 + x * (s1 - s0), 6) as p_size, round(r0 + y * (r1 - r0), 6) as p_retailprice from m, e"""


@query(SOBOL_SQL)
def sensitivity_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples over the columns' ranges from Sobol's sequence."""
    params = sensitivity.parameters(_t(spark, d, "part").select("p_size", "p_retailprice"))
    return sensitivity.samples(params, spark=spark).select("base", "matrix", *[F.round(c, 6).alias(c) for c in params.names])


FUNCTIONS = {"rounding": recode.rounding, "topbot": recode.topbot_recode, "k": lambda df: risk.k_anonymity(df, ["c_nationkey", "c_acctbal"]), "classes": lambda df: df.select("c_nationkey", "c_acctbal").distinct().count() / df.count()}
MASKS = [{"rounding": {"magnitude": 4, "cols": "c_acctbal"}}, {"topbot": {"top_cutoff": 5000, "bottom_cutoff": 0, "cols": "c_acctbal"}}]
# the table after no mask, the first, the second, and both in either order, with each one's score
SCORES = """with x as (select c_nationkey as n, c_acctbal as v from customer),
t as (select 'none' as t, n, v from x union all select 'r', n, round_even(v, -4) from x
  union all select 'b', n, greatest(least(v, 5000), 0) from x
  union all select 'rb', n, greatest(least(round_even(v, -4), 5000), 0) from x
  union all select 'br', n, round_even(greatest(least(v, 5000), 0), -4) from x),
c as (select t, count(*) as c from t group by t, n, v),
f as (select t, count(*) / sum(c) as f from c group by t)
"""


def _log(spark: SparkSession, d: str, kind: type, **options: object) -> DataFrame:
    run = kind(_t(spark, d, "customer"), MASKS, [{"classes": {}}], functions=FUNCTIONS, **options)
    run.optimize()
    return run.log.frame(spark)


@query(SCORES + "select step, round(f, 9) as fitness from f join (values (0, 'none'), (1, 'r'), (2, 'rb')) s(step, t) using (t)")
def search_iterative(spark: SparkSession, d: str) -> DataFrame:
    """Masks in their order, until all are used."""
    log = _log(spark, d, search.IterativeSearch, randomize_mutations=False)
    return log.select("step", F.round("fitness", 9).alias("fitness"))


GREEDY = SCORES + """, s as (select max(case when t = 'none' then f end) as f0, max(case when t = 'r' then f end) as fr, max(case when t = 'b' then f end) as fb, max(case when t = 'rb' then f end) as frb from f),
one as (select *, case when fr < f0 then fr else f0 end as f1 from s),
two as (select *, case when fr < f0 then case when frb < fr then frb else fr end else case when fb < f0 then fb else f0 end end as f2 from one)
"""


@query(GREEDY + "select unnest([0, 1, 2]) as step, round(unnest([f0, f1, f2]), 9) as fitness, cast(3 - unnest([0, case when f1 < f0 then 0 else 1 end, case when f1 < f0 then 0 else 1 end + case when f2 < f1 then 0 else 1 end]) as double) as retry from two")
def search_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Masks in their order; one that doesn't make the score better goes, and costs a retry."""
    log = _log(spark, d, search.IncrementalSearch, randomize_mutations=False)
    return log.select("step", F.round("fitness", 9).alias("fitness"), "retry")


@query(GREEDY + "select unnest([0, 1, 2]) as step, round(unnest([f0, f1, f2]), 9) as cur_fitness from two")
def search_stochastic(spark: SparkSession, d: str) -> DataFrame:
    """Masks in their order at a temperature of zero: only better tables are kept."""
    log = _log(spark, d, search.StochasticSearch, randomize_mutations=False, temperature=0.0)
    return log.select("step", F.round(F.coalesce("cur_fitness", "fitness"), 9).alias("cur_fitness"))


@query(SCORES + "select step, cast(p as double) as perm_num, round(f, 9) as fitness from f join (values (0, 0, 'none'), (1, 1, 'r'), (2, 1, 'rb'), (3, 2, 'b'), (4, 2, 'br')) s(step, p, t) using (t)")
def search_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d, search.ExhaustiveSearch).select("step", "perm_num", F.round("fitness", 9).alias("fitness"))


@query(SCORES + "select step, kind, round(f, 9) as fitness from f join (values (0, 'iterative', 'none'), (1, 'iterative', 'r'), (2, 'iterative', 'rb'), (0, 'exhaustive', 'none'), (1, 'exhaustive', 'r'), (2, 'exhaustive', 'rb')) s(step, kind, t) using (t)")
def search_config(spark: SparkSession, d: str) -> DataFrame:
    """Searches of a configuration."""
    config = {"mitigations": MASKS, "metrics": [{"classes": {}}], "optimizations": {"iterative": {"randomize_mutations": False}}}
    runs = search.from_config(_t(spark, d, "customer"), config, {"optimizations": {"iterative": {"randomize_mutations": False}, "exhaustive": {"num_perms": 1}}}, functions=FUNCTIONS)
    logs = []
    for run, kind in zip(runs, ("iterative", "exhaustive"), strict=True):
        run.optimize()
        logs.append(run.log.frame(spark).select("step", F.lit(kind).alias("kind"), F.round("fitness", 9).alias("fitness")))
    return logs[0].union(logs[1])


@query(SCORES + """, u as (select t, avg(case when a.v = b.v then 0 else 1 end) / 2 as u from (select c_custkey, 'r' as t, round_even(c_acctbal, -4) as v from customer union all select c_custkey, 'rb', greatest(least(round_even(c_acctbal, -4), 5000), 0) from customer union all select c_custkey, 'none', c_acctbal from customer) a join (select c_custkey, c_acctbal as v from customer) b using (c_custkey) group by t)
select step, round(f, 9) as risk, round(u, 9) as utility from f join u using (t) join (values (0, 'none'), (1, 'r'), (2, 'rb')) s(step, t) using (t)""")
def search_risk_utility_points(spark: SparkSession, d: str) -> DataFrame:
    """Risk and lost utility at each step of a search, for a plot."""
    cells = lambda orig_df, mod_df: utility.proportion_different(orig_df, mod_df, "c_custkey").first()[0]
    target = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    cells.__name__, classes = "cells", lambda mod_df: FUNCTIONS["classes"](mod_df)
    classes.__name__ = "classes"
    run = search.IterativeSearch(target, MASKS, [{classes: {}}, {cells: {}}], functions=FUNCTIONS, randomize_mutations=False)
    run.optimize()
    points = utility.risk_utility_pairs(run.log.frame(spark), "classes", "cells")
    return points.select("step", F.round("risk", 9).alias("risk"), F.round("utility", 9).alias("utility"))


# --- sources ----------------------------------------------------------------------------------------------------------


@query(f"""with c as (select list(distinct o_orderstatus order by o_orderstatus) as c, count(*) as n from orders),
r as (select o_orderkey, o_orderstatus, c, n, row_number() over (order by {_draw("o_orderkey", "who", 1234)}) as place, {_draw("o_orderkey", "other", 1234)} as u from orders, c)
select o_orderkey, case when place <= cast(floor(n * 0.3::double) as bigint) then c[(list_position(c, o_orderstatus) - 1 + 1 + cast(floor(u * (len(c) - 1)) as bigint)) % len(c) + 1] else o_orderstatus end as o_orderstatus from r""")
def source_change_categories(spark: SparkSession, d: str) -> DataFrame:
    return tables.change_categories(_t(spark, d, "orders"), "o_orderstatus", 0.3, key="o_orderkey").select("o_orderkey", "o_orderstatus")


@query("select kind, cast(r_regionkey as bigint) as r_regionkey, r_name from region, (values ('csv'), ('json'), ('orc')) k(kind)")
def source_formats(spark: SparkSession, d: str) -> DataFrame:
    """A table written and loaded in each other format."""
    r, folder, parts = _t(spark, d, "region").select("r_regionkey", "r_name"), new_folder(spark, "formats"), []
    for kind in ("csv", "json", "orc"):
        r.write.format(kind).option("header", "true").save(f"{folder}/{kind}")
        parts.append(tables.load_data(spark, f"{folder}/{kind}", kind).select(F.lit(kind).alias("kind"), F.col("r_regionkey").cast("long"), "r_name"))
    return parts[0].union(parts[1]).union(parts[2])


@query("""with m as (select c_nationkey, case when case when v < 5000 then v else 5000 end > 0 then case when v < 5000 then v else 5000 end else 0 end as v from (select c_nationkey, round_even(c_acctbal, -4) as v from customer)),
c as (select count(*) as n from m group by c_nationkey, v)
select sum(case when n <= 5 then n else 0 end) / sum(n) as fitness from c""")
def search_apply_and_evaluate(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, fitness=search.apply_and_evaluate(_t(spark, d, "customer"), MASKS, [{"k": {}}], FUNCTIONS)[1])


@query("""with l as (select max(ts) - interval 10 minute as at from events),
c as (select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as rows from events group by 1, 2)
select start, start + interval 1 hour as "end", event_type, rows, rows > 5 as is_k_anon from c, l where start + interval 1 hour <= l.at""")
def stream_windowed_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class sizes per hour over the events as a stream, written as windows close, read back."""
    schema = _t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    folder = new_folder(spark, "windows")
    out = reports.windowed_classes(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema(out.schema).parquet(f"{folder}/out")
    return closed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""with l as (select max(ts) - interval 10 minute as at from events),
c as (select event_id, event_type, time_bucket(interval 1 hour, ts) + interval 1 hour as close, count(*) over (partition by time_bucket(interval 1 hour, ts), event_type) as n from events)
select event_id, case when n >= 3 then event_type end as event_type, n >= 3 as released from c, l where n >= 3 or close < l.at""")
def stream_released_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events that leave a stream once three of their type came within the hour, else without their type when it is over."""
    schema, folder = _t(spark, d, "events").schema, new_folder(spark, "released")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = reports.released_rows(rows, "ts", ["event_type"], 3)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").drop("ts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
