"""Registered queries over the relational tables, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import dna
from .functions.natural import order_columns
from .lang import legacy
from .operators import graph, statistics, tables, texts, tracks
from .plans.model import Model, relational
from .plans.table_definition import compile_columns
from .session import Session, set_operation
from .ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


_models: dict[tuple[str, str], Model] = {}


def session(spark: SparkSession, sf: str) -> Session:
    """A session over the tables of a folder; their schemas are read once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        _models[key] = m = relational(spark, sf)
        m.subclass("rich_customer", "customer", "c_acctbal > 5000")
        m.composite("party", ["customer", "supplier"])
    return Session(spark, _models[key])


def _ask(key: str, text: str, sql: str | None, **rounds: int) -> None:
    """Register a query of the select language; `rounds` gives decimals of columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = session(spark, sf).query(text).df
        return df.select(*[F.round(c, rounds[c]).alias(c) if c in rounds else F.col(c) for c in df.columns])

    run.__name__ = key
    QUERIES[key] = run
    if sql:
        ORACLE[key] = sql


def _op(sql: str | None):
    """Register a function as a query."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# -- scans, navigation, joins ---------------------------------------------------------
_ask("class_scan_filter", "select c, b from c in ?customer, b in c->c_acctbal where b > 9000", "select distinct c_custkey c, c_acctbal b from customer where c_acctbal > 9000")
_ask("object_lookup", 'select c, n from c in object("customer", 42), n in c->c_name', "select c_custkey c, c_name n from customer where c_custkey = 42")
_ask("ref_expand_outer", "select o, q from o in ?orders, l in o->lineitem, q in l->l_quantity", "select distinct o_orderkey o, l_quantity q from orders left join lineitem on l_orderkey = o_orderkey")
_ask("ref_expand_mandatory", "select o, q from o in ?orders, l in o->lineitem where l, q in l->l_quantity", "select distinct o_orderkey o, l_quantity q from orders join lineitem on l_orderkey = o_orderkey")
_ask("ref_null_required", "select o from o in ?orders, l in o->lineitem where ! l", "select distinct o_orderkey o from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
_ask("path_chain", "select q, rn from l in ?lineitem, q in l->l_quantity where q >= 45, rn in l->orders->customer->nation->region->r_name", """
    select distinct l_quantity q, r_name rn from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
    join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where l_quantity >= 45""")  # fmt: skip
_ask("inverse_expand", "select n, c from n in ?nation, c in n->customer", "select distinct n_nationkey n, c_custkey c from nation left join customer on c_nationkey = n_nationkey")
_ask("parallel_expand", "select n, cell from n in ?nation, cell in n=>customer", "select n_nationkey n, string_agg(c_custkey::varchar, '; ' order by c_custkey) cell from nation left join customer on c_nationkey = n_nationkey group by 1")
_ask("tag_test", "select d, q from d in ?documents, q in d#labels", "select doc_id d, case when exists (select 1 from labels l where l.doc_id = documents.doc_id) then 'labels' end q from documents")
_ask("independent_generators", "select r, m from x in ?region, r in x->r_name, y in ?nation, m in y->n_name", "select distinct r_name r, n_name m from region, nation")
_ask("theta_pairs", "select a, b from a in ?nation, r in a->region, b in r->nation where b > a", "select a.n_nationkey a, b.n_nationkey b from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey > a.n_nationkey")
_ask("inverse_self_join", "select a, b from a in ?customer, o in a->orders where o->o_totalprice > 480000, l in o->lineitem where l, p in l->part, k in p->lineitem, b in k->orders->customer where b > a", """
    select distinct a.o_custkey a, b.o_custkey b from orders a join lineitem l on l.l_orderkey = a.o_orderkey join lineitem k on k.l_partkey = l.l_partkey
    join orders b on b.o_orderkey = k.l_orderkey where a.o_totalprice > 480000 and b.o_custkey > a.o_custkey""")  # fmt: skip
_ask("star_enrichment", 'select l, cn, sn from x in ?lineitem where x->l_shipdate =~ `1996-05`, l in x->l_extendedprice, cn in x->orders->customer->c_name, sn in x->supplier->s_name', """
    select distinct l_extendedprice l, c_name cn, s_name sn from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
    join supplier on s_suppkey = l_suppkey where l_shipdate >= '1996-05-01' and l_shipdate < '1996-06-01'""")  # fmt: skip
_ask("chained_active_set", "select c in ?customer where c->c_acctbal > 8000 ; select n, k from c in @, n in c->nation, k in n->n_name", "select distinct n_nationkey n, n_name k from customer join nation on n_nationkey = c_nationkey where c_acctbal > 8000")
_ask("follow_tag", "select c in ?customer where c->c_acctbal > 9500 ; >nation", "select distinct c_nationkey _2 from customer where c_acctbal > 9500")
_ask("constant_source", "select x, y, z from x = 2, y = \"hello\", z = 2 * 3 + 4", "select 2.0::double x, 'hello' y, 10.0::double z")
_ask("method_name_class", "select c, m, k from c in ?nation, m in c.name, k in c.class", "select n_nationkey c, n_nationkey::varchar m, 'nation' k from nation")

# -- predicates -----------------------------------------------------------------------
_ask("multival_any_ne", 'select c in ?customer where c->orders->o_orderstatus != "F"', "select distinct o_custkey c from orders where o_orderstatus <> 'F'")
_ask("multival_not_eq", 'select c in ?customer where NOT c->orders->o_orderstatus == "F"', "select c_custkey c from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
_ask("ternary_not", "select d in ?documents where NOT d->labels->quality > 0", "select doc_id d from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id and quality > 0)")
_ask("missing_or_range", "select d, q from d in ?documents, l in d->labels, q in l->quality where q < 1 OR ! q", "select distinct d.doc_id d, quality q from documents d left join labels l on l.doc_id = d.doc_id where quality < 1 or quality is null")
_ask("wildcard", 'select p, n from p in ?part, n in p->p_name where n ~ "*a?? *g*"', "select p_partkey p, p_name n from part where regexp_full_match(p_name, '(?is).*a.. .*g.*')")
_ask("regex", "select p, n from p in ?part, n in p->p_name where n =~ '^[b-r].*(et|ring)$'", "select p_partkey p, p_name n from part where regexp_matches(p_name, '(?i)^[b-r].*(et|ring)$')")
_ask("exact_quotes", "select p, n from p in ?part, n in p->p_brand where n == 'brand#2'", "select p_partkey p, p_brand n from part where lower(p_brand) = 'brand#2'")
_ask("natural_compare", 'select s, n from s in ?supplier, n in s->s_name where n < "Supplier#25"', "select s_suppkey s, s_name n from supplier where s_suppkey <= 25")
_ask("logical_precedence", "select o, x, y from o in ?orders, x in o->o_orderstatus, y in o->o_totalprice where y > 490000 and x == F or y < 1500 xor x == P", """
    select o_orderkey o, o_orderstatus x, o_totalprice y from orders
    where (o_totalprice > 490000 and o_orderstatus = 'F') or ((o_totalprice < 1500) <> (o_orderstatus = 'P'))""")  # fmt: skip
_ask("arithmetic_filter", "select o, y from o in ?orders, y in o->o_totalprice where 2 * (y - 1000) < 300000 and y / 2 > 70000", "select o_orderkey o, o_totalprice y from orders where 2 * (o_totalprice - 1000) < 300000 and o_totalprice / 2 > 70000")
_ask("modulo_power_div", "select p, m, w, q, z from p in ?part, s in p->p_size, m = s modulo 7, w = s ^ 2, q = s / 4, z = (0 - s) modulo 7", "select p_partkey p, (p_size % 7)::double m, pow(p_size, 2) w, p_size / 4.0::double q, ((-p_size % 7 + 7) % 7)::double z from part")
_ask("division_by_zero", "select p, q from p in ?part, s in p->p_size, q = 10 / (s modulo 3)", "select p_partkey p, case when p_size % 3 <> 0 then 10.0::double / (p_size % 3) end q from part")
_ask("isa_subclass", "select c in ?customer where c ISA rich_customer", "select c_custkey c from customer where c_acctbal > 5000")
_ask("subclass_scan", "select c, b from c in class rich_customer, b in c->c_acctbal", "select c_custkey c, c_acctbal b from customer where c_acctbal > 5000")
_ask("composite_class", "select p in class party", "select c_custkey::varchar p from customer union select s_suppkey::varchar from supplier")
_ask("name_pattern", 'select n in ?nation, m in n->n_name where m like "*a*"', "select n_nationkey n, n_name m from nation where n_name ilike '%a%'")

# -- dates ----------------------------------------------------------------------------
_ask("date_strict", "select o, d from o in ?orders, d in o->o_orderdate where d > `1995-03` and d < `1995-06-15`", "select o_orderkey o, o_orderdate d from orders where o_orderdate >= '1995-03-01' and o_orderdate < '1995-06-15'")
_ask("date_loose", "select o, d from o in ?orders, d in o->o_orderdate where d =~ `1996-02` or d >~ `1998-11`", "select o_orderkey o, o_orderdate d from orders where (o_orderdate >= '1996-02-01' and o_orderdate < '1996-03-01') or o_orderdate >= '1998-11-01'")
_ask("datediff", 'select o, m, y from o in ?orders, d in o->o_orderdate, m in DATEDIFF("m", d, `1999-01-01`), y in DATEDIFF("y", d, `1999`)', "select o_orderkey o, (12 * (1999 - year(o_orderdate)) + 1 - month(o_orderdate))::double m, (1999 - year(o_orderdate))::double y from orders")

# -- counts and aggregates ------------------------------------------------------------
_ask("count_tag", "select c, n from c in ?customer, n in count c->orders", "select c_custkey c, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by 1")
_ask("count_subquery", "select c, n from c in ?customer, n in count {select o from o in c->orders where o->o_totalprice > 200000}", "select c_custkey c, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey and o_totalprice > 200000 group by 1")
_ask("count_zero", "select o in ?orders where count o->lineitem == 0", "select o_orderkey o from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
_ask("agg_min_max_sum_avg", "select o, a, b, s, m from o in ?orders, a in min o->lineitem->l_quantity, b in max o->lineitem->l_quantity, s in sum o->lineitem->l_quantity, m in average o->lineitem->l_quantity", "select o_orderkey o, min(l_quantity) a, max(l_quantity) b, sum(l_quantity) s, round(avg(l_quantity), 6) m from orders left join lineitem on l_orderkey = o_orderkey group by 1", m=6)
_ask("agg_stddev", "select c, s from c in ?customer, s in stddev c->orders->o_totalprice", "select c_custkey c, round(stddev_pop(o_totalprice), 2) s from customer left join orders on o_custkey = c_custkey group by 1", s=2)
_ask("count_having", "select c, n from c in ?customer, n in count c->orders where n > 14", "select o_custkey c, count(*) n from orders group by 1 having count(*) > 14")
_ask("flagship", "select rn, nn, n from x in ?nation, nn in x->n_name, rn in x->region->r_name, n in count {select o from c in x->customer where c->c_acctbal > 0, o in c->orders where o->o_orderdate >= `1996`}", """
    select r_name rn, n_name nn, count(o_orderkey) n from nation join region on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey and c_acctbal > 0
    left join orders on o_custkey = c_custkey and o_orderdate >= '1996-01-01' group by 1, 2""")  # fmt: skip


# -- older dialect and saved tables ---------------------------------------------------
@_op("select distinct c_nationkey name from customer where c_acctbal > 9000 and c_mktsegment = 'BUILDING'")
def legacy_query(spark, sf):
    s = session(spark, sf)
    legacy.query(s, 'find customer ; c_acctbal > 9000 AND c_mktsegment = "build*" ; >nation')
    return s.active[1]


@_op("select c_custkey name from customer where c_acctbal > 8000 and c_mktsegment <> 'BUILDING'")
def legacy_set_card(spark, sf):
    s = session(spark, sf)
    legacy.query(s, '{find customer ; c_acctbal > 8000} SETMINUS {find customer ; c_mktsegment = BUILDING}')
    return s.active[1]


@_op("""select c_custkey x1, n_name x2, count(o_orderkey) x3, round(max(o_totalprice), 2) x4 from customer join nation on n_nationkey = c_nationkey
    left join orders on o_custkey = c_custkey where c_acctbal > 9000 group by 1, 2""")  # fmt: skip
def saved_table(spark, sf):
    text = compile_columns([
        {"class": "customer", "condition": "c_acctbal > %least"},
        {"from": 1, "tag": "nation->n_name", "need": "mandatory", "title": "Nation"},
        {"from": 1, "tag": "orders", "show": "count"},
        {"from": 1, "tag": "orders->o_totalprice", "show": "max"},
    ], least=9000)
    return session(spark, sf).query(text).df.withColumn("x4", F.round("x4", 2))


# -- sets -----------------------------------------------------------------------------
def _set(spark, sf, cond):
    return session(spark, sf).query(f"select c in ?customer where {cond}").df.select(F.col("c").alias("name"))


_A, _B = "c->c_acctbal > 5000", 'c->c_mktsegment == "BUILDING"'
_SA, _SB = "select c_custkey name from customer where c_acctbal > 5000", "select c_custkey name from customer where c_mktsegment = 'BUILDING'"
for _how, _sql in {"and": f"{_SA} intersect {_SB}", "or": f"{_SA} union {_SB}", "minus": f"{_SA} except {_SB}", "xor": f"({_SA} except {_SB}) union ({_SB} except {_SA})"}.items():
    QUERIES[f"set_{_how}"] = lambda spark, sf, how=_how: set_operation(how, _set(spark, sf, _A), _set(spark, sf, _B))
    ORACLE[f"set_{_how}"] = _sql


@_op(_SB)
def set_else(spark, sf):
    s = session(spark, sf)
    legacy.query(s, "{find customer ; c_acctbal > 99999} SETELSE {find customer ; c_mktsegment = BUILDING}")
    return s.active[1]


def _two(spark, sf):
    n = _t(spark, sf, "nation").select("n_regionkey")
    return n.where("n_regionkey <= 2"), n.where("n_regionkey >= 2")


@_op("select n_regionkey from nation where n_regionkey <= 2 union all select n_regionkey from nation where n_regionkey > 2")
def table_union(spark, sf):
    return tables.table_union(*_two(spark, sf))


@_op("select n_regionkey from nation where n_regionkey < 2")
def table_diff(spark, sf):
    return tables.table_diff(*_two(spark, sf))


@_op("select n_regionkey from nation where n_regionkey = 2")
def table_intersect(spark, sf):
    return tables.table_intersect(*_two(spark, sf))


@_op("select signature, count(*) size, min(user_id) least from (select user_id, string_agg(distinct event_type, ',' order by event_type) signature from events where value > 60 group by 1) group by 1")
def set_partition(spark, sf):
    return tables.partition_sets(_t(spark, sf, "events").where("value > 60"), "user_id", "event_type")


@_op("select user_id, count(*) n from events group by 1 having count(*) >= 70")
def n_compress(spark, sf):
    return tables.repeated(_t(spark, sf, "events"), "user_id", 70)


# -- graphs ---------------------------------------------------------------------------
def _tree(spark, sf):
    return _t(spark, sf, "customer").select(F.expr("c_custkey div 2").alias("src"), F.col("c_custkey").alias("dst")).where("src <> dst")


@_op("with recursive r(start, node) as (select 3::bigint, c_custkey from customer where c_custkey // 2 = 3 and c_custkey <> 3 union select r.start, c_custkey from r join customer on c_custkey // 2 = r.node and c_custkey <> r.node) select start, node from r")
def closure_down(spark, sf):
    return graph.closure(_tree(spark, sf), spark.createDataFrame([(3,)], "start long"))


@_op("with recursive e as (select c_nationkey::bigint src, 1000 + c_custkey dst from customer union all select 1000 + c_custkey, c_nationkey from customer), r(start, node) as (select 5::bigint, dst from e where src = 5 union select r.start, e.dst from r join e on e.src = r.node) select distinct start, node from r where node <> start")
def closure_cycle(spark, sf):
    """From a nation to its customers and back: the cycle ends and the start is left out."""
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("n"), (F.col("c_custkey") + 1000).alias("c"))
    e = c.selectExpr("n as src", "c as dst").union(c.selectExpr("c as src", "n as dst"))
    return graph.closure(e, spark.createDataFrame([(5,)], "start long"))


@_op("""select node, total from (select r_name node, round(sum(c_acctbal), 2) total from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1
    union all select n_name, round(sum(c_acctbal), 2) from customer join nation on n_nationkey = c_nationkey group by 1)""")  # fmt: skip
def rollup_parent(spark, sf):
    n, r, c = (_t(spark, sf, x) for x in ("nation", "region", "customer"))
    edges = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    amounts = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("n_name", "c_acctbal")
    return graph.roll_up(edges, amounts, "n_name", "c_acctbal").select("node", F.round("total", 2).alias("total"))


@_op("""with recursive e as (select distinct l_orderkey a, -l_partkey b from lineitem where l_quantity > 49.5), s as (select a, b from e union all select b, a from e),
    r(x, y) as (select a, b from s union select r.x, s.b from r join s on s.a = r.y) select x node, least(x, min(y)) component from r group by x""")  # fmt: skip
def connected_components(spark, sf):
    """Components of all orders and parts (negative) of the large lines."""
    e = _t(spark, sf, "lineitem").where("l_quantity > 49.5").selectExpr("l_orderkey as src", "-l_partkey as dst").distinct()
    return graph.connected_components(e)


@_op("select distinct c_nationkey name from customer where c_acctbal > 9000")
def neighbours(spark, sf):
    c = _t(spark, sf, "customer")
    return graph.neighbours(c.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")), c.where("c_acctbal > 9000").select(F.col("c_custkey").alias("name")), "name")


# -- text search ----------------------------------------------------------------------
@_op("select 'part' as class, p_partkey::varchar as name from part where regexp_matches(p_name, '(?is)red.*widget')")
def grep(spark, sf):
    s = Session(spark, relational(spark, sf, ["part"]))
    return s.grep("red widget", [("part", "p_name")])


@_op("select 'documents' as class, doc_id::varchar as name from documents where regexp_matches(text, '(?is)worthless') union select 'benchmark', item_id::varchar from benchmark where regexp_matches(text, '(?is)worthless')")
def longgrep(spark, sf):
    return session(spark, sf).long_grep("worthless", [("documents", "text"), ("benchmark", "text")])


_HIT = "(contains(lower(text), 'the')::int + contains(lower(text), 'erinan')::int + contains(lower(text), 'thondre')::int)"


@_op(f"select doc_id, 3 - {_HIT} as rank, {_HIT} as hits from documents where {_HIT} > 0")
def ranked_search(spark, sf):
    return texts.search_ranked(_t(spark, sf, "documents"), "doc_id", F.col("text"), ["the", "erinan", "thondre"])


# -- order, top and pages -------------------------------------------------------------
@_op("select s_suppkey s, s_name n from supplier order by s_suppkey desc limit 10")
def order_spec(spark, sf):
    return session(spark, sf).query("select s, n from s in ?supplier, n in s->s_name order_by -n").page(1, 10)


@_op("select s_name from supplier order by s_suppkey limit 7")
def topn_natural(spark, sf):
    return _t(spark, sf, "supplier").select("s_name").orderBy(order_columns(F.col("s_name"), "string")).limit(7)


@_op("select s_suppkey s from supplier order by s_suppkey limit 10 offset 20")
def page(spark, sf):
    return session(spark, sf).query("select s in ?supplier").page(21, 10)


# -- statistics -----------------------------------------------------------------------
@_op("select l_returnflag, least(19, floor(l_quantity / 2.5))::int bin, count(*) n from lineitem group by 1, 2")
def histogram(spark, sf):
    return statistics.histogram(_t(spark, sf, "lineitem"), "l_quantity", 0, 50, 20, ["l_returnflag"])


@_op("select 'l_quantity' as column, least(9, floor(l_quantity / 5))::int bin, count(*) n from lineitem group by 2 union all select 'l_tax', 0, count(*) from lineitem")
def table_histograms(spark, sf):
    return statistics.table_histograms(_t(spark, sf, "lineitem"), ["l_quantity", "l_tax"], 0, 50, 10)


@_op("select l_shipmode, count(x) n, round(avg(x), 4) mean, median(x) median, round(stddev_pop(x), 4) sigma, min(x) low, max(x) high from (select l_linestatus l_shipmode, l_extendedprice x from lineitem) group by 1")
def robust_stats(spark, sf):
    out = statistics.robust(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_linestatus"]).withColumnRenamed("l_linestatus", "l_shipmode")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("sigma", F.round("sigma", 4))


@_op("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(corr(l_quantity, l_extendedprice), 6) r, count(*) n from lineitem group by 1")
def regression(spark, sf):
    out = statistics.regression(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("r", 6).alias("r"), "n")


_CHI = "n11 + n12 + n21 + n22"


@_op(f"select round(({_CHI})::double * (n11 * n22 - n12 * n21)::double * (n11 * n22 - n12 * n21) / ((n11 + n12)::double * (n21 + n22) * (n11 + n21) * (n12 + n22)), 6) chi2 from (select count(*) filter (quality = 1 and toxic = 1) n11, count(*) filter (quality = 1 and toxic = 0) n12, count(*) filter (quality = 0 and toxic = 1) n21, count(*) filter (quality = 0 and toxic = 0) n22 from labels)")
def chi2(spark, sf):
    c = lambda q, t: F.count(F.when((F.col("quality") == q) & (F.col("toxic") == t), 1)).cast("double")
    n = _t(spark, sf, "labels").agg(c(1, 1).alias("a"), c(1, 0).alias("b"), c(0, 1).alias("c"), c(0, 0).alias("d"))
    return n.select(F.round(statistics.chi_square(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("chi2"))


@_op("""with x as (select n_chars v, toxic g from documents join labels using (doc_id)), p as (select v, sum((g = 1)::int) k1, sum((g = 0)::int) k0 from x group by v),
    q as (select v, k1, k0, coalesce(sum(k0) over (order by v rows between unbounded preceding and 1 preceding), 0) b from p)
    select sum(k1)::bigint n1, sum(k0)::bigint n2, sum(k1 * (b + k0 / 2.0))::double u, round(sum(k1 * (b + k0 / 2.0))::double / (sum(k1) * sum(k0)), 8) auc from q""")  # fmt: skip
def mann_whitney(spark, sf):
    j = _t(spark, sf, "documents").select("doc_id", "n_chars").join(_t(spark, sf, "labels"), "doc_id")
    return statistics.mann_whitney(j, "n_chars", "toxic").withColumn("auc", F.round("auc", 8))


@_op("""with p as (select value x, count(*) k from events group by 1), q as (select x, sum(k) over w nl, sum(k * x) over w sl, sum(k) over () n, sum(k * x) over () s from p window w as (order by x)),
    z as (select x cut, nl::bigint n_low, (n - nl)::bigint n_high, sl / nl ml, (s - sl) / (n - nl) mh from q where n > nl) select cut, n_low, n_high, round(ml, 6) mean_low, round(mh, 6) mean_high from z order by n_low::double * n_high * (ml - mh) * (ml - mh) desc, cut limit 1""")  # fmt: skip
def two_populations(spark, sf):
    out = statistics.two_populations(_t(spark, sf, "events"), "value")
    return out.withColumn("mean_low", F.round("mean_low", 6)).withColumn("mean_high", F.round("mean_high", 6))


@_op("""with j as (select o_custkey, count(*) filter (o_orderstatus = 'F') h, count(*) t from orders group by 1), b as (select unnest(range(0, 20))::int bin), w as (select o_custkey, bin, h * ln((bin + 0.5) / 20) + (t - h) * ln(1 - (bin + 0.5) / 20) l from j, b),
    d as (select o_custkey, bin, exp(l - max(l) over (partition by o_custkey)) d from w), n as (select o_custkey, bin, d / sum(d) over (partition by o_custkey) p from d) select bin, round(sum(p), 6) weight from n group by 1""")  # fmt: skip
def smoothed_ratio(spark, sf):
    j = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("hits"), F.count("*").alias("total"))
    return statistics.smoothed_ratio(j, "hits", "total").withColumn("weight", F.round("weight", 6))


# -- records --------------------------------------------------------------------------
def _records(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_linestatus").alias("tag"), "l_quantity", "l_tax", F.col("l_partkey").alias("note"), F.struct("l_shipdate", "l_partkey").alias("at"))


@_op("select l_returnflag sample, l_linestatus tag, round(sum(l_quantity), 2) q, round(sum(l_tax), 2) t, arg_max(l_partkey, struct_pack(a := l_shipdate, b := l_partkey)) note from lineitem group by 1, 2")
def tsf_merge(spark, sf):
    out = tables.merge_records(_records(spark, sf), ["sample", "tag"], ["note"], "at")
    return out.select("sample", "tag", F.round("l_quantity", 2).alias("q"), F.round("l_tax", 2).alias("t"), "note")


@_op("select l_returnflag sample, round(sum(l_quantity) filter (l_linestatus = 'F'), 2) \"F\", round(sum(l_quantity) filter (l_linestatus = 'O'), 2) \"O\" from lineitem group by 1")
def tsf_pivot(spark, sf):
    out = tables.pivot_records(_records(spark, sf), "sample", "tag", "l_quantity", ["F", "O"])
    return out.select("sample", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@_op("select l_returnflag, round(100 * sum(l_tax) / sum(l_quantity), 6) \"_P_t\" from lineitem group by 1")
def percent_row(spark, sf):
    g = _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"))
    return tables.percent_of_first(g, ["q", "t"]).select("l_returnflag", F.round("_P_t", 6).alias("_P_t"))


@_op("select l_linestatus tag, 'all' as sample, round(sum(l_quantity), 2) q from lineitem group by 1")
def force_sample(spark, sf):
    r = _records(spark, sf).select("sample", "tag", "l_quantity")
    return tables.force_single(r, ["sample", "tag"], "sample", "all").select("tag", "sample", F.round("l_quantity", 2).alias("q"))


# -- tracks ---------------------------------------------------------------------------
def _spans(spark, sf):
    """Events as intervals in minutes: user groups are targets."""
    lo = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60) - 28401120
    return _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), lo.cast("long").alias("lo"), (lo + F.floor(F.col("value") / 10)).cast("long").alias("hi"))


_SPANS = "(select event_id id, event_type key, (epoch(date_trunc('minute', ts)) // 60 - 28401120)::bigint lo, ((epoch(date_trunc('minute', ts)) // 60 - 28401120) + floor(value / 10))::bigint hi from events)"


@_op(f"""with m as (select key target, lo x, 1.0::double d from {_SPANS} union all select key, hi + 1, -1.0::double from {_SPANS}), s as (select target, x, sum(d) d from m group by 1, 2),
    r as (select target, x x1, lead(x) over (partition by target order by x) - 1 x2, sum(d) over (partition by target order by x rows unbounded preceding) y from s) select * from r where x2 >= x1 and y > 0""")  # fmt: skip
def coverage_depth(spark, sf):
    return tracks.depth(_spans(spark, sf), "key", "lo", "hi")


def _track(spark, sf):
    return _spans(spark, sf).groupBy(F.col("key").alias("target"), F.expr("lo div 10").alias("x")).agg(F.count("*").cast("double").alias("y"))


_TRACK = f"(select key target, lo // 10 x, count(*)::double y from {_SPANS} group by 1, 2)"


@_op(f"""with h as (select *, case when x - lag(x) over (partition by target order by x) > 3 then 1 else 0 end nw from {_TRACK} where y >= 1), i as (select *, sum(nw) over (partition by target order by x rows unbounded preceding) k from h)
    select target, min(x) "start", max(x) "end", max(y) high, round(avg(y), 6) mean, sum(y) total from i group by target, k having sum(y) >= 3""")  # fmt: skip
def peaks(spark, sf):
    return tracks.peaks(_track(spark, sf), 1, gap=3, area=3.0).withColumn("mean", F.round("mean", 6))


@_op(f"""with h as (select l.level, t.*, case when x - lag(x) over (partition by l.level, target order by x) > 1 then 1 else 0 end nw from {_TRACK} t, (values (1.0::double), (2.0::double)) l(level) where y >= l.level),
    i as (select *, sum(nw) over (partition by level, target order by x rows unbounded preceding) k from h) select level, target, min(x) "start", max(x) "end", max(y) high from i group by level, target, k""")  # fmt: skip
def plateaus(spark, sf):
    return tracks.plateaus(_track(spark, sf), [1.0, 2.0])


@_op(f"""with k as (select i::bigint k, exp(-i * i / 8.0::double) w from (select unnest(range(-11, 12)) i) where exp(-i * i / 8.0::double) > 1e-6 or abs(i) <= 10), s as (select sum(w) s from k)
    select target, x + k x, round(sum(y * w / s), 9) y from {_TRACK}, k, s group by 1, 2""")  # fmt: skip
def gauss_smooth(spark, sf):
    return tracks.smooth(_track(spark, sf), 2.0).withColumn("y", F.round("y", 9))


@_op(f"""with a as (select * from {_TRACK}), n as (select sqrt(sum(y * y)) * sqrt(sum(y * y)) n from a) select lag.k as lag, round(sum(a.y * b.y) / any_value(n.n), 8) cosine
    from a join (select unnest(range(-3, 4))::int k) lag on true join a b on b.target = a.target and b.x - lag.k = a.x, n group by 1""")  # fmt: skip
def lag_correlation(spark, sf):
    t = _track(spark, sf)
    return tracks.lag_correlation(t, t, range(-3, 4)).withColumn("cosine", F.round("cosine", 8))


@_op(f"select coalesce(a.x, b.x) x, coalesce(a.y, 0) y, coalesce(b.y, 0) z from (select x, y from {_TRACK} where target = 'click') a full join (select x, y from {_TRACK} where target = 'view') b on a.x = b.x")
def track_pairs(spark, sf):
    t = _track(spark, sf)
    a, b = (t.where(F.col("target") == k).select("x", "y") for k in ("click", "view"))
    return tracks.pair_tracks(a, b, ["x"])


@_op(f"select a.key, a.id a_id, b.id b_id, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 shared from {_SPANS} a join {_SPANS} b on a.key = b.key and a.lo <= b.hi and b.lo <= a.hi and least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 >= 6")
def interval_overlap(spark, sf):
    s = _spans(spark, sf)
    return tracks.overlaps(s, s, "key", 16, 6)


@_op(f"select id, key, lead(id) over w next_id, lead(lo) over w - hi gap from {_SPANS} window w as (partition by key order by lo, id)")
def nearest_next(spark, sf):
    return tracks.nearest_next(_spans(spark, sf), "key", "lo", "hi", "id")


@_op(f"select id, 'z' || key to_key, 1000 + lo - 0 new_lo, 1000 + hi new_hi from {_SPANS} where lo >= 0 and hi <= 20000 and key = 'click'")
def remap(spark, sf):
    seg = spark.createDataFrame([("click", 0, 20000, "zclick", 1000, 1)], "key string, lo long, hi long, to_key string, to_lo long, strand int")
    return tracks.remap(_spans(spark, sf), seg, 1000)


@_op("select l_orderkey, l_quantity, count(*) n, any_value(u) unicity from (select *, count(*) over (partition by l_orderkey) u from (select *, rank() over (partition by l_orderkey order by l_quantity desc) r from lineitem) where r = 1) group by 1, 2")
def best_hit_rank(spark, sf):
    out = tracks.best_hits(_t(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", "l_quantity")
    return out.groupBy("l_orderkey", "l_quantity").agg(F.count("*").alias("n"), F.first("unicity").alias("unicity"))


# -- words and k-mers -----------------------------------------------------------------
_WORDS = "list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@_op("select kmer, count(*) n from (select unnest(list_transform(range(1, length(p_name) - 3), lambda i: substring(p_name, i, 5))) kmer from part) group by 1")
def kmer_count(spark, sf):
    return texts.kmer_count(_t(spark, sf, "part"), "p_name", 5)


_SHINGLE = "select {id} id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) s from (select {id}, " + _WORDS + " w from {t})"


@_op(f"with d as ({_SHINGLE.format(id='doc_id', t='documents')}), b as (select distinct s from ({_SHINGLE.format(id='item_id', t='benchmark')})) select d.id doc_id, count(*) n, count(b.s) found, round(100.0 * count(b.s) / count(*), 6) percent from d left join b on b.s = d.s group by 1")
def contamination(spark, sf):
    out = texts.containment(_t(spark, sf, "documents"), "doc_id", "text", _t(spark, sf, "benchmark"), "text", 5)
    return out.withColumn("percent", F.round("percent", 6))


@_op("select min(doc_id) least, count(*) copies from documents group by text having count(*) > 1")
def exact_dedup(spark, sf):
    return texts.exact_duplicates(_t(spark, sf, "documents"), "doc_id", "text")


@_op(f"with w as (select item_id id, unnest(list_distinct({_WORDS})) w from benchmark), f as (select w from w group by 1 having count(*) > 1) select x.id a, y.id b, count(*) shared from w x join f using (w) join w y on y.w = x.w and x.id < y.id group by 1, 2")
def token_overlap(spark, sf):
    return texts.token_overlap(_t(spark, sf, "benchmark"), "item_id", "text")


@_op("""with n as (select n_nationkey id, lower(n_name) t from nation), g as (select id, g, count(*) n from (select id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) g from n) group by 1, 2), m as (select id, sqrt(sum(n * n)) m from g group by 1)
    select a, b, cosine from (select x.id a, y.id b, round(sum(x.n * y.n) / (any_value(p.m) * any_value(q.m)), 9) cosine from g x join g y on x.g = y.g and x.id < y.id join m p on p.id = x.id join m q on q.id = y.id group by 1, 2) where cosine >= 0.2""")  # fmt: skip
def trigram_similarity(spark, sf):
    return texts.trigram_similarity(_t(spark, sf, "nation"), "n_nationkey", F.col("n_name"), 0.2).withColumn("cosine", F.round("cosine", 9))


# -- sequences ------------------------------------------------------------------------
@_op("select part.p_partkey, reverse(translate(substring(s, 2, 5), 'acgt', 'tgca')) rc, substring(s, 2, 5) fw from (select p_partkey, translate(lower(p_name), 'bdefhijklmnopqrsuvwxyz ', 'acgtacgtacgtacgtacgtacg') s from part) part")
def revcomp(spark, sf):
    s = F.translate(F.lower("p_name"), "bdefhijklmnopqrsuvwxyz ", "acgtacgtacgtacgtacgtacg")
    return _t(spark, sf, "part").select("p_partkey", dna.fragment(s, F.lit(6), F.lit(2)).alias("rc"), dna.fragment(s, F.lit(2), F.lit(6)).alias("fw"))


@_op("select o_orderkey, case o_orderkey % 4 when 0 then 'MK*' when 1 then 'FX' when 2 then 'GA' else '*' end pep from orders")
def translate(spark, sf):
    seq = F.element_at(F.array(F.lit("atgaaatag"), F.lit("tttc"), F.lit("ggagcc"), F.lit("TGA")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _t(spark, sf, "orders").select("o_orderkey", dna.translate(seq).alias("pep"))


# -- windows --------------------------------------------------------------------------
@_op("select date_trunc('hour', ts)::timestamp \"start\", event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2")
def stream_windows(spark, sf):
    from .streaming.events import windowed

    return windowed(_t(spark, sf, "events"), "1 hour").withColumn("total", F.round("total", 2))


@_op("""with s as (select *, case when ts - lag(ts) over w >= interval 30 minute then 1 else 0 end b from events window w as (partition by user_id order by ts)), g as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from s)
    select user_id, min(ts) "start", max(ts) + interval 30 minute "end", count(*) n from g group by user_id, k""")  # fmt: skip
def session_windows(spark, sf):
    from .streaming.events import sessions

    return sessions(_t(spark, sf, "events"), "30 minutes")


@_op("select event_id, get_bit_value k from (select event_id, (props::json ->> 'k')::int get_bit_value from events)")
def json_field(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@_op("""with u as (select user_id, date_trunc('day', ts)::date d, sum(value) v from events group by 1, 2), m as (select d, median(v) m from u where user_id % 10 = 0 group by 1) select user_id, u.d, round(v / m, 6) ratio from u join m on m.d = u.d""")
def control_ratio(spark, sf):
    u = _t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.sum("value").alias("v"))
    out = tables.ratio_to_controls(u, "d", "v", F.col("user_id") % 10 == 0)
    return out.select("user_id", "d", F.round("ratio", 6).alias("ratio"))


@_op("select l_partkey, l_suppkey, count(*) n, round(100.0 * count(*) / sum(count(*)) over (partition by l_partkey), 6) usage from lineitem group by 1, 2")
def usage_share(spark, sf):
    return tables.usage_share(_t(spark, sf, "lineitem"), "l_partkey", "l_suppkey").withColumn("usage", F.round("usage", 6))


@_op("select label, round(avg(norm), 6) norm, count(*) n from (select label, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))) norm from embeddings) group by 1")
def embedding_norms(spark, sf):
    e = _t(spark, sf, "embeddings").select("label", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm"))
    return e.groupBy("label").agg(F.round(F.avg("norm"), 6).alias("norm"), F.count("*").alias("n"))


# -- edits ----------------------------------------------------------------------------
@_op("select c_custkey, case when c_nationkey in (select n_nationkey from nation where n_regionkey = 1) then null else c_nationkey end c_nationkey from customer where c_acctbal >= 0")
def kill_objects(spark, sf):
    from .operators.edits import kill

    c = _t(spark, sf, "customer")
    out = kill(c.select("c_custkey", "c_nationkey"), "c_custkey", c.where("c_acctbal < 0").select("c_custkey"))
    return kill(out.withColumn("k", F.lit(-1)), "k", _t(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey"), {"c_nationkey": "nation"}).drop("k")


@_op("select n_nationkey, case when n_regionkey = 1 then 11 else n_regionkey end n_regionkey from nation")
def rename_objects(spark, sf):
    from .operators.edits import rename

    return rename(_t(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", spark.createDataFrame([(1, 11)], "a int, b int"))


@_op("select s_suppkey, 'ya' || (row_number() over (order by s_suppkey) + 5) || 'x.y' as fresh from supplier")
def fresh_names(spark, sf):
    from .operators.edits import new_names

    taken = spark.createDataFrame([("ya5x.y",), ("ya3x.y",), ("yb9x.y",)], "n string")
    return new_names(_t(spark, sf, "supplier").select("s_suppkey"), "ya%dx.y", taken, "fresh", ["s_suppkey"])


# -- reads ----------------------------------------------------------------------------
def _reads(spark, sf):
    """Part names as short reads over four letters."""
    return _t(spark, sf, "part").select("p_partkey", F.translate(F.lower("p_name"), "bdefhijklmnopqrsuvwxyz ", "acgtacgtacgtacgtacgtacg").alias("s"))


_READS = "(select p_partkey, translate(lower(p_name), 'bdefhijklmnopqrsuvwxyz ', 'acgtacgtacgtacgtacgtacg') s from part)"


@_op(f"select p_partkey, len(regexp_extract_all(s, 'ac'))::int ac, len(regexp_extract_all(s, 'g[at]'))::int gw from {_READS}")
def motif_counts(spark, sf):
    from .operators.sequences import motif_counts as count

    return count(_reads(spark, sf), "p_partkey", "s", {"ac": "ac", "gw": "g[at]"})


@_op(f"select i::int pos, substring(s, i, 1) base, count(*) n from {_READS}, unnest(range(1, length(s) + 1)) t(i) group by 1, 2")
def position_profile(spark, sf):
    from .operators.sequences import position_profile as profile

    return profile(_reads(spark, sf), "s")


@_op(f"""with w as (select p_partkey id, i::int pos, substring(s, i, 8) seed from {_READS}, unnest(range(1, length(s) - 6)) t(i)), f as (select seed from w group by 1 having count(*) <= 81)
    select a.id, b.id target_id, b.pos - a.pos diagonal, count(*) seeds from w a join f using (seed) join w b on b.seed = a.seed group by 1, 2, 3""")  # fmt: skip
def seed_join(spark, sf):
    from .operators.sequences import seed_join as join
    from .operators.sequences import seeds

    w = seeds(_reads(spark, sf), "p_partkey", "s", 8)
    return join(w, w)


@_op(f"""with w as (select p_partkey id, i::int pos, substring(s, i, 5) t from {_READS}, unnest(range(1, 30)) x(i) where i + 4 <= length(s))
    select id, pos, ((substring(t, 1, 1) <> 'a')::int + (substring(t, 2, 1) <> 'c')::int + (substring(t, 3, 1) not in ('a', 'g'))::int + (substring(t, 4, 1) <> 't')::int + (substring(t, 5, 1) <> 'a')::int)::int errors from w
    where (substring(t, 1, 1) <> 'a')::int + (substring(t, 2, 1) <> 'c')::int + (substring(t, 3, 1) not in ('a', 'g'))::int + (substring(t, 4, 1) <> 't')::int + (substring(t, 5, 1) <> 'a')::int <= 1""")  # fmt: skip
def fuzzy_match(spark, sf):
    from .operators.sequences import fuzzy_match as match

    return match(_reads(spark, sf), "p_partkey", "s", "acrta", 1, 0)


@_op("""with g as (select l_returnflag sample, l_linestatus target, l_linenumber pos, l_suppkey % 4 variant, count(*) cover, sum((l_quantity > 25)::int)::bigint support from lineitem group by 1, 2, 3, 4)
    select *, round(100.0 * support / cover, 6) percent from g where cover >= 10 and 100.0 * support / cover >= 48""")  # fmt: skip
def variant_support(spark, sf):
    from .operators.sequences import variant_support as support

    calls = _t(spark, sf, "lineitem").selectExpr("l_returnflag as sample", "l_linestatus as target", "l_linenumber as pos", "l_suppkey % 4 as variant", "l_quantity > 25 as is_variant")
    return support(calls, 10, 48.0).withColumn("percent", F.round("percent", 6))


@_op("""with a as (select distinct l_orderkey from lineitem where l_quantity > 25), b as (select distinct l_orderkey from lineitem where l_discount > 0.05), n as (select count(*) filter (a.l_orderkey is not null and b.l_orderkey is not null) tp,
    count(*) filter (b.l_orderkey is null) fp, count(*) filter (a.l_orderkey is null) fn from a full join b on a.l_orderkey = b.l_orderkey) select tp, fp, fn, round(tp / (tp + fp), 8) "precision", round(tp / (tp + fn), 8) recall, round(2 * tp / (2 * tp + fp + fn), 8) f from n""")  # fmt: skip
def against_truth(spark, sf):
    from .operators.sequences import against_truth as compare

    li = _t(spark, sf, "lineitem")
    out = compare(li.where("l_quantity > 25"), li.where("l_discount > 0.05"), ["l_orderkey"])
    return out.select("tp", "fp", "fn", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f")])


@_op(f"select target, floor(a / 50)::bigint ka, count(*) support from (select key target, lo a, hi b from {_SPANS}) group by target, floor(a / 50), floor(b / 50) having count(*) >= 2")
def break_points(spark, sf):
    from .operators.sequences import break_points as points

    s = _spans(spark, sf).select(F.col("key").alias("target"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    return points(s, 50).select("target", F.floor(F.col("donor") / 50).cast("long").alias("ka"), "support")


@_op(None)
def principal_directions(spark, sf):
    from .operators.linear import principal, project

    e = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    mean, dirs, _ = principal(e, "embedding", 2)
    return project(e, "embedding", mean, dirs).select("vec_id", "projection")


@_op("select x target, x + 7 x1, y from (select user_id x, count(*)::double * 2 y from events group by 1) where y >= 100")
def reshape_track(spark, sf):
    t = _t(spark, sf, "events").groupBy(F.col("user_id").alias("target")).agg(F.count("*").cast("double").alias("y")).withColumn("x", F.col("target"))
    return tracks.reshape(t, 2.0, 7, 100.0).select("target", F.col("x").alias("x1"), "y")


# -- tags of several columns ----------------------------------------------------------
def _lines_session(spark, sf) -> Session:
    """Orders with a tag Line of three columns (part, quantity, tax), one line each."""
    from pyspark.sql.functions import collect_list, struct

    from .plans.model import Class, Column, Tag

    li, o = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    rows = li.groupBy(F.col("l_orderkey").alias("k")).agg(collect_list(struct(F.col("l_partkey").cast("double").alias("c1"), F.col("l_quantity").alias("c2"), F.col("l_tax").alias("c3"))).alias("rows"))
    df = o.join(rows, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.struct(F.col("rows").isNotNull().alias("present"), F.coalesce("rows", F.array().cast("array<struct<c1:double,c2:double,c3:double>>")).alias("rows")).alias("Line"))
    c = Class("ord", lambda: df, "o_orderkey", "number")
    c.add(Tag("Line", [Column("number")] * 3, "struct", "Line"))
    return Session(spark, Model([c]))


def _on_lines(key: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _lines_session(spark, sf).query(text).df

    run.__name__ = key
    QUERIES[key], ORACLE[key] = run, sql


_OUTER = "from orders left join lineitem on l_orderkey = o_orderkey"
_on_lines("tag_offset", "select o, q from o in ?ord, q in o->Line[2]", f"select distinct o_orderkey o, l_quantity q {_OUTER}")
_on_lines("right_move", "select o, p, q, t from o in ?ord, p in o->Line, q in p[1], t in p[2]", f"select distinct o_orderkey o, l_partkey::double p, l_quantity q, l_tax t {_OUTER}")
_on_lines("rerooted_product", "select o, q, t from o in ?ord, q in o->Line[2], t in o->Line[3] where t > 0.05", "select distinct a.l_orderkey o, a.l_quantity q, b.l_tax t from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where b.l_tax > 0.05")
_on_lines("tag_line_column", "select o, q from o in ?ord, p in o#Line, q in p[2]", f"select distinct o_orderkey o, l_quantity q {_OUTER}")
_on_lines("struct_parallel_count", "select o, n from o in ?ord, n in count o->Line where n > 4", "select l_orderkey o, count(*) n from lineitem group by 1 having count(*) > 4")

# -- more of the language -------------------------------------------------------------
_ask("first_last", "select c, a, b from c in ?customer, a in first c->orders->o_orderpriority, b in last c->orders->o_totalprice", "select c_custkey c, min(o_orderpriority) a, max(o_totalprice) b from customer left join orders on o_custkey = c_custkey group by 1")
_ask("unit_differences", "select o, y, m, w, d, h from o in ?orders, t in o->o_orderdate, y in YEARDIFF(`1999-01-01`, t), m in MONTHDIFF(`1999-01-01`, t), w in WEEKDIFF(`1999-01-01`, t), d in DAYDIFF(`1999-01-01`, t), h in HOURDIFF(`1999-01-01_00`, t)", """
    select o_orderkey o, (1999 - year(o_orderdate))::double y, (12 * (1999 - year(o_orderdate)) + 1 - month(o_orderdate))::double m, trunc(date_diff('day', o_orderdate::date, date '1999-01-01') / 7.0)::bigint::double w,
    date_diff('day', o_orderdate::date, date '1999-01-01')::double d, date_diff('hour', date_trunc('hour', o_orderdate), timestamp '1999-01-01')::double h from orders""")  # fmt: skip
_ask("date_literal", "select x, y from x = `2016-1-7_3:7`, y = `2016-1`", "select '2016-01-07_03:07' x, '2016-01' y")
_ask("integer_range", "select p, z from p in ?part, z in p->p_size where z > 45 and z <= 48", "select p_partkey p, p_size z from part where p_size > 45 and p_size <= 48")


@_op("select n_nationkey n from nation where n_nationkey::varchar like '1%'")
def name_shorthand(spark, sf):
    df = session(spark, sf).query('select ?nation "1*"').df
    return df.toDF("n")


@_op("select p_partkey name from part where abs(p_retailprice - 1000) * 20 < abs(p_retailprice) and abs(p_retailprice - 1000) * 20 < 1000")
def legacy_like_number(spark, sf):
    s = session(spark, sf)
    legacy.query(s, "find part ; p_retailprice LIKE 1000")
    return s.active[1]


@_op("select c_custkey name from customer where c_acctbal > 8000 and c_mktsegment = 'BUILDING'")
def stack_and(spark, sf):
    s = session(spark, sf)
    s.command("select c in ?customer where c->c_acctbal > 8000")
    s.command("spush")
    s.command('select c in ?customer where c->c_mktsegment == "BUILDING"')
    s.command("sand")
    return s.active[1]


@_op("select c_custkey name from customer where c_acctbal > 8000")
def named_sets_and_undo(spark, sf):
    s = session(spark, sf)
    s.command("select c in ?customer where c->c_acctbal > 8000")
    s.command("kstore rich")
    s.command("select s in ?supplier")
    s.command("kget rich")
    s.command("select n in ?nation")
    s.command("undo")
    return s.active[1]


@_op("select c_custkey name from customer where c_acctbal > 9000 or c_acctbal < -900")
def expand_sets(spark, sf):
    s = session(spark, sf)
    for name, cond in (("rich", "> 9000"), ("poor", "< 0 - 900"), ("other", "> 0")):
        s.command(f"select c in ?customer where c->c_acctbal {cond}")
        s.command(f"kstore {name}")
    s.set_active(None, spark.createDataFrame([("rich",), ("poor",), ("absent",)], "name string"))
    s.command("expand")
    return s.active[1]


@_op("select s_suppkey name from supplier order by s_suppkey limit 6 offset 3")
def subset_of_set(spark, sf):
    s = session(spark, sf)
    s.command("select s in ?supplier")
    s.command("subset 4 6")
    return s.active[1]


@_op("select n_nationkey::varchar as name, 'n_name' tag, 0 line, [n_name] as values from nation where n_regionkey = 1")
def show_one_tag(spark, sf):
    s = session(spark, sf)
    s.command("select n in ?nation where n->n_regionkey == 1")
    return s.command("show n_name")


@_op("select n_nationkey::varchar as name, count(*) lines from (select n_nationkey, unnest(['n_nationkey', 'n_name', 'n_regionkey', 'region']) tag from nation union all select c_nationkey, c_custkey::varchar from customer union all select s_nationkey, s_suppkey::varchar from supplier) group by 1")
def show_objects(spark, sf):
    s = session(spark, sf)
    s.command("select n in ?nation")
    return s.command("show").groupBy("name").agg(F.count("*").alias("lines"))


@_op("select * from (select 'region' as class, count(*) n from region union all select 'nation', count(*) from nation union all select 'customer', count(*) from customer union all select 'lineitem', count(*) from lineitem)")
def class_counts(spark, sf):
    return session(spark, sf).class_counts().where(F.col("class").isin("region", "nation", "customer", "lineitem"))


@_op("select 'doc_id' tag, count(doc_id) n from documents union all select 'text', count(text) from documents union all select 'lang', count(lang) from documents union all select 'source', count(source) from documents union all select 'n_chars', count(n_chars) from documents union all select 'labels', count(distinct doc_id) from labels")
def tag_counts(spark, sf):
    return session(spark, sf).tag_counts("documents")


@_op("select n_nationkey n, case when n_regionkey = 2 then 'Edited' else n_name end m, case when n_regionkey = 2 then null else n_regionkey end r from nation")
def edit_active_set(spark, sf):
    s = Session(spark, relational(spark, sf, ["region", "nation"]))
    s.query("select n in ?nation where n->n_regionkey == 2")
    s.edit("n_name Edited\n-D n_regionkey")
    return s.query("select n, m, r from n in ?nation, m in n->n_name, r in n->n_regionkey").df


@_op("select l_shipmode m, q from (select distinct l_linestatus l_shipmode, l_quantity q from lineitem) order by m desc, q limit 20")
def sort_spec(spark, sf):
    return session(spark, sf).query("select m, q from l in ?lineitem, m in l->l_linestatus, q in l->l_quantity").sorted("-1+2").limit(20)


@_op("select c_custkey c, o_totalprice p from customer left join orders on o_custkey = c_custkey and o_totalprice > 450000 order by p nulls first, c limit 25")
def sort_null_smallest(spark, sf):
    return session(spark, sf).query("select c, p from c in ?customer, p in max {select q from o in c->orders, q in o->o_totalprice where q > 450000}").sorted("+2+1").limit(25)


# -- text and number helpers ----------------------------------------------------------
@_op("select p_partkey, case when regexp_matches(p_name, '(?i)e.*t') then length(regexp_extract(p_name, '(?is)^(.*?)e.*?t', 1)) + 1 else 0 end w, case when regexp_matches(p_name, '(?i)[aeiou]{2}') then length(regexp_extract(p_name, '(?is)^(.*?)[aeiou]{2}', 1)) + 1 else 0 end r from part")
def find_positions(spark, sf):
    from .functions import strings

    return _t(spark, sf, "part").select("p_partkey", strings.wildcard_at(F.col("p_name"), "*e*t*").cast("long").alias("w"), strings.regex_at(F.col("p_name"), "[aeiou]{2}").cast("long").alias("r"))


@_op("select p_partkey, '\"' || p_name || '\\\"x\"' q, p_name || '\"x' u, upper(p_name) up, md5(p_name) digest from part")
def quoting(spark, sf):
    from .functions import strings

    q = strings.quote(F.concat("p_name", F.lit('"x')))
    return _t(spark, sf, "part").select("p_partkey", q.alias("q"), strings.unquote(q).alias("u"), F.upper("p_name").alias("up"), F.md5("p_name").alias("digest"))


@_op("select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey end i, case when o_orderkey % 3 <> 2 then o_orderkey + case o_orderkey % 3 when 1 then 0.5 else 0 end end::double d from orders")
def strict_numbers(spark, sf):
    from .functions import strings

    text = F.concat(F.col("o_orderkey").cast("string"), F.element_at(F.array(F.lit(""), F.lit(".5"), F.lit("x")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return _t(spark, sf, "orders").select("o_orderkey", strings.strict_int(text).alias("i"), strings.strict_double(text).alias("d"))


@_op("""select p_partkey, case p_size when 0 then 0 else round(p_size / pow(10, floor(log10(p_size)))) * pow(10, floor(log10(p_size))) end l, (select min(v) from (select unnest([1.0, 2, 5, 10, 20, 50, 100]) v) where v >= p_size)::double u,
    case when p_size <= 16 then p_size else round(16 + 16 * (log2(p_size) - 4)) end::int b, round(case when p_size <= 16 then p_size::double else pow(2, (round(16 + 16 * (log2(p_size) - 4)) - 16) / 16.0 + 4) end, 6) back, round(lgamma(p_size + 1), 6) f from part""")  # fmt: skip
def roundings(spark, sf):
    from .functions import strings

    z = F.col("p_size").cast("double")
    b = strings.to_byte(z)
    return _t(spark, sf, "part").select("p_partkey", strings.leading_digit(z).alias("l"), strings.round_up(z).alias("u"), b.alias("b"), F.round(strings.from_byte(b), 6).alias("back"), F.round(statistics.log_factorial(F.col("p_size")), 6).alias("f"))


@_op("select p_partkey, p_size::bigint copies, (p_size + 10)::bigint aligned, (p_size + 12)::bigint spanned from part")
def read_names_and_cigars(spark, sf):
    from .sources.formats import cigar_sum, multiplicity

    cigar = F.concat(F.col("p_size").cast("string"), F.lit("M3I2D10M4S"))
    return _t(spark, sf, "part").select("p_partkey", multiplicity(F.concat(F.lit("read#"), F.col("p_size").cast("string"))).alias("copies"), cigar_sum(cigar, "M=X").alias("aligned"), cigar_sum(cigar, "MDN=X").alias("spanned"))


# -- regions and introns --------------------------------------------------------------
@_op(f"""with b as (select key, lo + i x from {_SPANS}, unnest(range(0, hi - lo + 1)) t(i)), d as (select key, x, count(*)::double y from b group by 1, 2), r as (select distinct key target, lo // 100 id, lo // 100 * 100 lo, lo // 100 * 100 + 99 hi from {_SPANS})
    select r.target, r.id, count(d.x) covered, coalesce(sum(y), 0) total, round(coalesce(sum(y), 0) / 100, 6) mean, coalesce(max(y), 0) high from r left join d on d.key = r.target and d.x between r.lo and r.hi group by 1, 2""")  # fmt: skip
def region_coverage(spark, sf):
    s = _spans(spark, sf)
    runs = tracks.depth(s, "key", "lo", "hi")
    regions = s.select(F.col("key").alias("target"), F.expr("lo div 100").alias("k")).distinct().select(F.struct("target", "k").alias("id"), "target", (F.col("k") * 100).alias("lo"), (F.col("k") * 100 + 99).alias("hi"))
    out = tracks.coverage_of_regions(runs, regions, 200)
    return out.select("target", F.col("id.k").alias("id"), "covered", "total", F.round("mean", 6).alias("mean"), "high")


@_op(f"select target, a1, a2, run, sum(support)::bigint support, count(*) n, case when a1 <= a2 then '+' else '-' end strand from (select key target, lo // 60 a1, (hi * 7) // 400 a2, id % 3 run, id % 5 support from {_SPANS}) group by 1, 2, 3, 4")
def intron_support(spark, sf):
    s = _spans(spark, sf).select(F.col("key").alias("target"), F.expr("lo div 60").alias("a1"), F.expr("(hi * 7) div 400").alias("a2"), (F.col("id") % 3).alias("run"), (F.col("id") % 5).alias("support"))
    return tracks.compact_introns(s, ["target", "a1", "a2", "run"], "support")


@_op(f"select target, x, round(log2((coalesce(a.y, 0) + 5) / (coalesce(b.y, 0) + 5)), 9) y from {_TRACK} a full join (select target, x + 1 x, y from {_TRACK}) b using (target, x)")
def damped_log_ratio(spark, sf):
    t = _track(spark, sf)
    return tracks.log_ratio(t, t.withColumn("x", F.col("x") + 1)).withColumn("y", F.round("y", 9))


@_op(f"select target, x // 5 * 5 x, avg(y * 2) y from {_TRACK} group by 1, 2")
def resampled_track(spark, sf):
    return tracks.reshape(_track(spark, sf), 2.0, step=5)


@_op("select l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 2) intercept, round(atanh(corr(l_quantity, l_extendedprice)) * sqrt(count(*) - 3), 4) z from lineitem group by 1")
def regression_fisher(spark, sf):
    out = statistics.regression(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.round("intercept", 2).alias("intercept"), F.round("z", 4).alias("z"))


@_op("select l_orderkey k, arg_max(l_returnflag, (n, l_returnflag)) flag, max(n) support, sum(n)::bigint reads, count(*) kinds from (select l_orderkey, l_returnflag, count(*) n from lineitem group by 1, 2) group by 1")
def key_consensus(spark, sf):
    from .operators.sequences import consensus

    return consensus(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("flag")), ["k"], "flag")
