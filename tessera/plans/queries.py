"""The registered queries of the engine's own operators, and their SQL.

Each query builds its plan with the library and flattens the result to scalar columns; its SQL says the same in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import fixpoint, moving, spatial
from ..operators.natural import Default, natural, symmetrized
from ..operators.query import from_
from ..operators.relation import Relation, assign, erase_at, insert_at, monotone, new_ids, numbered
from ..operators.slotmap import SlotMap
from ..operators.universe import Universe
from ..streaming import ticks

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name, read on first use; columns are pruned by the planner."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def relation(self, name: str, key: str, *columns: str, unique: bool = True, alias: str | None = None) -> Relation:
        df = getattr(self, name)
        return Relation(df.select(*columns) if columns else df, alias or name, (key,), unique)


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Run]:
    def register(f: Callable[[Tables], DataFrame]) -> Run:
        run: Run = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return run

    return register


def queries() -> dict[str, Run]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- scans and look-ups -----------------------------------------------------------------------------------------------


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def scan_columnar(t):
    return t.customer


@query("select c_acctbal from customer")
def scan_one_column(t):
    return t.customer.select("c_acctbal")


@query("select c_custkey, c_mktsegment from customer")
def scan_column_subset(t):
    return t.customer.select("c_custkey", "c_mktsegment")


@query("select c_name, c_custkey, row_number() over (order by c_name, c_custkey) - 1 as pos from customer")
def positions_by_name(t):
    return numbered(t.customer.select("c_name", "c_custkey"), ["c_name", "c_custkey"])


@query("select * from (select c_custkey, c_name, row_number() over (order by c_custkey) - 1 as pos from customer) where pos = 77")
def row_at_position(t):
    return numbered(t.customer.select("c_custkey", "c_name"), ["c_custkey"]).where("pos = 77")


@query("select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey")
def ordered_scan(t):
    return t.relation("orders", "o_orderkey", "o_orderkey", "o_custkey", "o_totalprice").ordered_scan()


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 7")
def point_lookup(t):
    return t.relation("orders", "o_orderkey", "o_orderkey", "o_custkey", "o_totalprice").find(7)


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey = 5")
def equal_range_lookup(t):
    return t.relation("lineitem", "l_orderkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", unique=False).equal_range(5)


@query("select n_nationkey, n_name, n_regionkey from nation")
def scan_named(t):
    return from_(t.relation("nation", "n_nationkey", alias="lands")).df.select("lands.*")


@query("select event_id, user_id, value from events order by ts")
def scan_flat_sorted(t):
    return t.relation("events", "ts").ordered_scan().select("event_id", "user_id", "value")


@query("select a.n_name as name, b.n_name as again, b.n_regionkey as region from nation a join nation b using (n_nationkey)")
def self_join_alias(t):
    nation = t.relation("nation", "n_nationkey")
    return from_(nation).join(nation.aliased("again")).merge().select(name=("nation", "n_name"), again=("again", "n_name"), region=("again", "n_regionkey"))


@query("select count(*) as n, count(*) = 0 as is_empty from orders")
def table_size(t):
    return t.orders.agg(F.count("*").alias("n")).withColumn("is_empty", F.col("n") == 0)


@query("select max(o_orderkey) as max_key from orders")
def max_key(t):
    return t.orders.agg(F.max("o_orderkey").alias("max_key"))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus <> 'O' and o_custkey <= 700")
def filter_compare(t):
    return t.orders.where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "O") & (F.col("o_custkey") <= 700)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey < 100 or (l_orderkey = 100 and l_linenumber < 3)")
def lexicographic_filter(t):
    key, bound = F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")), F.struct(F.lit(100).cast("long").alias("a"), F.lit(3).alias("b"))
    return t.lineitem.where((F.col("l_orderkey") <= 100) & (key < bound)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select p_partkey, p_brand from part")
def project_cols(t):
    return t.part.select("p_partkey", "p_brand")


# -- changes ----------------------------------------------------------------------------------------------------------


@query("select c_custkey, c_acctbal from customer union all select c_custkey + 1000000, c_acctbal from customer where c_custkey < 10")
def append_rows(t):
    old = t.relation("customer", "c_custkey", "c_custkey", "c_acctbal")
    return old.append(old.df.where("c_custkey < 10").withColumn("c_custkey", F.col("c_custkey") + 1_000_000), check=True).df


@query("""with p as (select c_custkey, row_number() over (order by c_custkey) - 1 as pos from customer)
select c_custkey, case when pos >= 10 then pos + 1 else pos end as pos from p union all select -1, 10""")
def positional_insert(t):
    rows = t.customer.sparkSession.createDataFrame([(-1, 0)], "c_custkey bigint, pos bigint")
    return insert_at(numbered(t.customer.select("c_custkey"), ["c_custkey"]), 10, rows)


@query("""with p as (select c_custkey, row_number() over (order by c_custkey) - 1 as pos from customer)
select c_custkey, case when pos >= 5 then pos + 25 else pos end as pos from p union all select -n_nationkey, n_nationkey + 5 from nation""")
def positional_insert_range(t):
    rows = numbered(t.nation.select((-F.col("n_nationkey")).cast("long").alias("c_custkey"), "n_nationkey"), ["n_nationkey"]).drop("n_nationkey")
    return insert_at(numbered(t.customer.select("c_custkey"), ["c_custkey"]), 5, rows)


@query("""with p as (select c_custkey, row_number() over (order by c_custkey) - 1 as pos from customer)
select c_custkey, case when pos >= 15 then pos - 10 else pos end as pos from p where pos < 5 or pos >= 15""")
def positional_erase(t):
    return erase_at(numbered(t.customer.select("c_custkey"), ["c_custkey"]), 5, 15)


@query("select c_custkey, c_acctbal from customer union all select s_suppkey, s_acctbal from supplier")
def keyed_insert(t):
    return t.relation("customer", "c_custkey", "c_custkey", "c_acctbal").insert(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))).df


@query("select c_custkey, c_acctbal from customer where c_custkey not in (select s_suppkey from supplier)")
def keyed_erase(t):
    return t.relation("customer", "c_custkey", "c_custkey", "c_acctbal").erase(t.supplier.select(F.col("s_suppkey").alias("c_custkey"))).df


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as rn from lineitem),
k as (select user_id as l_orderkey, row_number() over (partition by user_id) as rn from events)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from l anti join k using (l_orderkey, rn)""")
def keyed_erase_bag(t):
    items = t.relation("lineitem", "l_orderkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", unique=False)
    return items.erase(t.events.select(F.col("user_id").alias("l_orderkey"))).df


@query("select s_suppkey, s_name from supplier union all select n_nationkey + 5000, n_name from nation union all select r_regionkey + 9000, r_name from region")
def deferred_insert(t):
    with t.relation("supplier", "s_suppkey", "s_suppkey", "s_name").inserter() as batch:
        batch.add(t.nation.select((F.col("n_nationkey") + 5000).cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name")))
        batch.add(t.region.select((F.col("r_regionkey") + 9000).cast("long").alias("s_suppkey"), F.col("r_name").alias("s_name")))
    return batch.result.df


@query("select s_suppkey, s_name from supplier where s_suppkey not in (select n_nationkey from nation) and s_suppkey % 10 <> 3")
def deferred_erase(t):
    suppliers = t.relation("supplier", "s_suppkey", "s_suppkey", "s_name")
    with suppliers.eraser() as batch:
        batch.add(t.nation.select(F.col("n_nationkey").cast("long").alias("s_suppkey")))
        batch.add(suppliers.df.where("s_suppkey % 10 = 3").select("s_suppkey"))
    return batch.result.df


@query("select event_id, value from events")
def flat_insert(t):
    old, new = t.events.where("event_id < 500").select("event_id", "value"), t.events.where("event_id >= 500").select("event_id", "value")
    monotone(old, new, "event_id")
    return old.unionByName(new)


def _universe(t) -> Universe:
    talks = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("role", F.struct("turn", "role")).alias("role"))
    return Universe({"documents": t.documents.select("doc_id", "lang", "n_chars"), "labels": t.labels, "talks": talks}, "doc_id")


_TALKS = "talks as (select conv_id as doc_id, arg_min(role, (turn, role)) as role from conversations group by conv_id)"


@query("select doc_id, lang, quality from documents join labels using (doc_id) where doc_id % 7 <> 0")
def universe_erase(t):
    left = _universe(t).erase(t.documents.where("doc_id % 7 = 0"))
    return left.require("documents", "labels").select(doc_id=("documents", "doc_id"), lang=("documents", "lang"), quality=("labels", "quality"))


@query("select n_name, (select max(c_custkey) from customer) + row_number() over (order by n_nationkey) as id from nation")
def new_ids_query(t):
    used = t.customer.select(F.col("c_custkey").alias("id"))
    return new_ids(t.nation.select("n_name", "n_nationkey"), used, "id", ["n_nationkey"]).select("n_name", "id")


_QUERIES["new_ids"], _SQL["new_ids"] = _QUERIES.pop("new_ids_query"), _SQL.pop("new_ids_query")


@query("select s_suppkey, s_name, s_acctbal * 2 as s_acctbal from supplier")
def update_intersect(t):
    return assign(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), {"s_acctbal": F.col("s_acctbal") * 2, "angle": F.lit(0)})


@query("""with a as (select c_custkey, c_acctbal from customer union all select s_suppkey + 1000000, s_acctbal from supplier),
    n as (select o_custkey as c_custkey, max(o_totalprice) as c_acctbal from orders group by o_custkey)
    select c_custkey, c_acctbal from a anti join n using (c_custkey) union all select c_custkey, c_acctbal from n""")
def upsert(t):
    """Accounts of customers, who have orders, and of suppliers, who have none."""
    suppliers = t.supplier.select((F.col("s_suppkey") + 1_000_000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    accounts = t.relation("customer", "c_custkey", "c_custkey", "c_acctbal").insert(suppliers)
    return accounts.upsert(t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))).df


@query("select count(*) as erased from lineitem where l_orderkey in (select o_orderkey from orders where o_totalprice > 150000)")
def erase_by_key_all(t):
    keys = t.orders.where("o_totalprice > 150000").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.relation("lineitem", "l_orderkey", unique=False).erase_all(keys)[1]


@query("select s_suppkey, s_acctbal + 10.0 * 0.5 as s_acctbal from supplier where s_acctbal + 10.0 * 0.5 <= 5000")
def regen_update_delete(t):
    return t.supplier.select("s_suppkey", (F.col("s_acctbal") + F.lit(10.0) * F.lit(0.5)).alias("s_acctbal")).where("s_acctbal <= 5000")


@query("""select c_custkey, c_name, coalesce(s_acctbal, c_acctbal) as c_acctbal from customer left join supplier on s_suppkey = c_custkey""")
def update_from(t):
    return t.relation("customer", "c_custkey", "c_custkey", "c_name", "c_acctbal").update_from(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))).df


def _slots(t) -> SlotMap:
    return SlotMap.of(t.supplier.select("s_suppkey", "s_name"), ["s_suppkey"])


@query("select s_suppkey, s_name, row_number() over (order by s_suppkey) - 1 as handle from supplier")
def handle_assign(t):
    return _slots(t).scan()


@query("select * from (select s_suppkey, s_name, row_number() over (order by s_suppkey) - 1 as handle from supplier) where handle % 4 <> 0")
def handle_erase(t):
    slots = _slots(t)
    return slots.erase(slots.df.where("handle % 4 = 0")).scan()


@query("""select c_custkey, n_name from customer join (select n_name, row_number() over (order by n_nationkey) - 1 as handle from nation) on handle = c_nationkey""")
def handle_lookup(t):
    lands = SlotMap.of(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], scannable=False)
    return lands.lookup(t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey")), "c_nationkey").select("c_custkey", "n_name")


@query("select c_custkey, c_acctbal from customer where false union all select s_suppkey, s_acctbal from supplier")
def clear_and_insert(t):
    cleared = t.relation("customer", "c_custkey", "c_custkey", "c_acctbal").clear()
    return cleared.insert(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))).df


# -- index joins ------------------------------------------------------------------------------------------------------


def _docs(t):
    return t.relation("documents", "doc_id", "doc_id", "lang", "n_chars")


def _events(t, key="user_id"):
    return t.relation("events", key, "user_id", "event_id", "value", unique=False)


def _orders(t, key="o_custkey", unique=False):
    return t.relation("orders", key, "o_custkey", "o_orderkey", "o_totalprice", unique=unique)


_L = "(select user_id, event_id, value, row_number() over (partition by user_id order by event_id, value) as rn from events)"
_R = "(select o_custkey as user_id, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey, o_totalprice) as rn from orders)"


@query("select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def merge_join(t):
    return from_(_docs(t)).join(t.relation("labels", "doc_id")).merge().select(doc_id=("documents", "doc_id"), lang=("documents", "lang"), quality=("labels", "quality"), toxic=("labels", "toxic"))


@query(f"select user_id, event_id, value, o_orderkey, o_totalprice from {_L} join {_R} using (user_id, rn)")
def merge_join_zip(t):
    return from_(_events(t)).join(_orders(t)).merge().select(user_id=("events", "user_id"), event_id=("events", "event_id"), value=("events", "value"), o_orderkey=("orders", "o_orderkey"), o_totalprice=("orders", "o_totalprice"))


@query("select doc_id, quality, toxic from documents left join labels using (doc_id)")
def merge_outer_join(t):
    return from_(_docs(t)).outer_join(t.relation("labels", "doc_id")).merge().select(doc_id=("documents", "doc_id"), quality=("labels", "quality"), toxic=("labels", "toxic"))


@query(f"select user_id, event_id, o_orderkey, o_totalprice from events left join (select * from {_R} where rn = 1) using (user_id)")
def merge_outer_first(t):
    return from_(_events(t)).outer_join(_orders(t)).merge().select(user_id=("events", "user_id"), event_id=("events", "event_id"), o_orderkey=("orders", "o_orderkey"), o_totalprice=("orders", "o_totalprice"))


@query("select doc_id, lang from documents anti join labels using (doc_id)")
def merge_anti_join(t):
    return from_(_docs(t)).anti_join(t.relation("labels", "doc_id")).merge().select(doc_id=("documents", "doc_id"), lang=("documents", "lang"))


@query(f"select user_id, event_id, value from {_L} anti join {_R} using (user_id, rn)")
def merge_anti_bag(t):
    return from_(_events(t)).anti_join(_orders(t)).merge().select(user_id=("events", "user_id"), event_id=("events", "event_id"), value=("events", "value"))


@query("select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey")
def find_join(t):
    return from_(_orders(t)).join(t.relation("customer", "c_custkey", "c_custkey", "c_name", "c_mktsegment")).find().select(o_orderkey=("orders", "o_orderkey"), c_name=("customer", "c_name"), c_mktsegment=("customer", "c_mktsegment"))


@query(f"select user_id, event_id, o_orderkey from events join (select * from {_R} where rn = 1) using (user_id)")
def find_join_first(t):
    return from_(_events(t)).join(_orders(t)).find().select(user_id=("events", "user_id"), event_id=("events", "event_id"), o_orderkey=("orders", "o_orderkey"))


@query("select doc_id, n_chars, quality from documents left join labels using (doc_id)")
def find_outer_join(t):
    return from_(_docs(t)).outer_join(t.relation("labels", "doc_id")).find().select(doc_id=("documents", "doc_id"), n_chars=("documents", "n_chars"), quality=("labels", "quality"))


@query("select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem)")
def find_anti_join(t):
    items = t.relation("lineitem", "l_orderkey", "l_orderkey", unique=False)
    return from_(_orders(t, "o_orderkey", True)).anti_join(items).find().select(o_orderkey=("orders", "o_orderkey"), o_totalprice=("orders", "o_totalprice"))


def _items(t):
    return t.relation("lineitem", "l_orderkey", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", unique=False)


@query("select l_orderkey, l_linenumber, l_quantity, c_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey")
def on_scope_join(t):
    both = from_(_items(t)).join(_orders(t, "o_orderkey", True)).find().on("orders", "o_custkey")
    return both.join(t.relation("customer", "c_custkey", "c_custkey", "c_name")).find().select(l_orderkey=("lineitem", "l_orderkey"), l_linenumber=("lineitem", "l_linenumber"), l_quantity=("lineitem", "l_quantity"), c_name=("customer", "c_name"))


@query("select s_suppkey, s_name, n_name from supplier join nation on s_nationkey = n_nationkey")
def index_fk_join(t):
    return from_(t.relation("supplier", "s_suppkey")).index("s_nationkey").join(t.relation("nation", "n_nationkey")).find().select(s_suppkey=("supplier", "s_suppkey"), s_name=("supplier", "s_name"), n_name=("nation", "n_name"))


@query("""select l_orderkey, l_linenumber, l_quantity, c_name, n_name, r_name from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def chained_join(t):
    q = from_(_items(t)).join(_orders(t, "o_orderkey", True)).find().on("orders", "o_custkey")
    q = q.join(t.relation("customer", "c_custkey", "c_custkey", "c_name", "c_nationkey")).find().on("customer", "c_nationkey")
    q = q.join(t.relation("nation", "n_nationkey")).find().on("nation", "n_regionkey").join(t.relation("region", "r_regionkey")).find()
    return q.select(l_orderkey=("lineitem", "l_orderkey"), l_linenumber=("lineitem", "l_linenumber"), l_quantity=("lineitem", "l_quantity"), c_name=("customer", "c_name"), n_name=("nation", "n_name"), r_name=("region", "r_name"))


@query("select event_id, n_name from events join nation on user_id % 25 = n_nationkey")
def expression_key_join(t):
    return from_(_events(t)).index(lambda c: (c("user_id") % 25).cast("int")).join(t.relation("nation", "n_nationkey")).find().select(event_id=("events", "event_id"), n_name=("nation", "n_name"))


@query("select c_custkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey")
def named_select(t):
    return from_(_orders(t)).join(t.relation("customer", "c_custkey", "c_custkey", "c_name", "c_mktsegment")).find().df.select("customer.*")


@query("select d.doc_id, l.doc_id is not null as labelled from documents d left join labels l using (doc_id)")
def maybe_presence(t):
    q = from_(_docs(t)).outer_join(t.relation("labels", "doc_id")).find()
    return q.df.select(F.col("documents.doc_id").alias("doc_id"), q.present("labels").alias("labelled"))


# -- entities ---------------------------------------------------------------------------------------------------------


@query("select doc_id, lang, toxic from documents join labels using (doc_id)")
def universe_require(t):
    return _universe(t).require("documents", "labels").select(doc_id=("documents", "doc_id"), lang=("documents", "lang"), toxic=("labels", "toxic"))


@query(f"with {_TALKS} select doc_id, lang, quality, role from documents join labels using (doc_id) join talks using (doc_id)")
def universe_require_all(t):
    return _universe(t).require_all().select(doc_id=("documents", "doc_id"), lang=("documents", "lang"), quality=("labels", "quality"), role=("talks", "role"))


@query(f"with {_TALKS} select doc_id, quality, role from documents left join labels using (doc_id) left join talks using (doc_id)")
def universe_include(t):
    return _universe(t).require("documents").include("labels", "talks").select(doc_id=("documents", "doc_id"), quality=("labels", "quality"), role=("talks", "role"))


@query(f"with {_TALKS} select doc_id, lang from documents anti join labels using (doc_id) anti join talks using (doc_id)")
def universe_exclude(t):
    return _universe(t).require("documents").exclude("labels", "talks").select(doc_id=("documents", "doc_id"), lang=("documents", "lang"))


@query(f"with {_TALKS} select doc_id, lang, quality from documents left join labels using (doc_id) anti join talks using (doc_id)")
def universe_mixed(t):
    return _universe(t).require("documents").include("labels").exclude("talks").select(doc_id=("documents", "doc_id"), lang=("documents", "lang"), quality=("labels", "quality"))


# -- natural joins ----------------------------------------------------------------------------------------------------


def _customers(t) -> Relation:
    return Relation(t.customer.select(F.col("c_custkey").alias("custkey"), "c_name", F.col("c_nationkey").alias("nationkey")), "customers", ("custkey",))


@query("select o_custkey as custkey, o_orderkey, o_totalprice, c_name, c_nationkey as nationkey from orders join customer on o_custkey = c_custkey")
def natural_join_merge(t):
    orders = Relation(t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice"), "orders", ("custkey",), unique=False)
    return natural(orders).join(_customers(t)).select()


@query("select s_nationkey as nationkey, s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey")
def natural_join_hash(t):
    customers = Relation(t.customer.select(F.col("c_nationkey").alias("nationkey"), "c_custkey"), "customers", ("nationkey",), unique=False, ordered=False)
    return natural(t.supplier.select(F.col("s_nationkey").alias("nationkey"), "s_suppkey")).join(customers).select()


@query("select n_nationkey as nationkey, n_name as name, c_custkey from nation join customer on n_nationkey = c_nationkey")
def natural_join_overlap(t):
    customers = Relation(t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"), "c_custkey"), "customers", ("nationkey",), unique=False)
    return natural(Relation(t.nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name")), "nations", ("nationkey",))).join(customers).select()


@query("select a.n_nationkey as nation, a.n_regionkey as target, b.n_name as target_name from nation a join nation b on a.n_regionkey = b.n_nationkey")
def rename_self_join(t):
    targets = natural(t.nation.select("n_nationkey", "n_name")).rename("n_nationkey", "target").rename("n_name", "target_name").select()
    return natural(t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("target"))).join(Relation(targets, "targets", ("target",))).select()


@query("select c_custkey, c_acctbal * 2 as doubled, c_acctbal * 2 + 1 as more from customer where c_acctbal * 2 + 1 > 0")
def map_chain(t):
    return natural(t.customer.select("c_custkey", "c_acctbal")).map(lambda d: d.withColumn("doubled", F.col("c_acctbal") * 2), lambda d: d.withColumn("more", F.col("doubled") + 1), lambda d: d.where("more > 0").drop("c_acctbal")).select()


@query("select doc_id, cast(-1 as integer) as quality from documents")
def default_value(t):
    return natural(t.documents.select("doc_id")).join(Default({"quality": -1})).select()


@query("select d.doc_id, case when l.doc_id is not null then l.quality else -1 end as quality from documents d left join labels l using (doc_id)")
def amend_merge(t):
    documents = Relation(t.documents.select("doc_id"), "documents", ("doc_id",))
    return natural(documents).join(Default({"quality": -1})).amend(t.relation("labels", "doc_id")).select()


@query(f"select e.event_id, e.user_id, case when r.user_id is not null then r.o_totalprice else e.value end as value from events e left join (select * from {_R} where rn = 1) r using (user_id)")
def amend_hash(t):
    prices = Relation(t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.col("o_totalprice").alias("value")), "prices", ("user_id",), unique=False, ordered=False)
    first = Relation(prices.df.groupBy("user_id").agg(F.min(F.struct("o_orderkey", "value")).alias("f")).select("user_id", "f.value"), "prices", ("user_id",), ordered=False)
    return natural(t.events.select("event_id", "user_id", "value")).amend(first).select()


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def subtract(t):
    return natural(t.documents.select("doc_id", "lang")).subtract(t.relation("labels", "doc_id")).select()


@query("""select o_orderkey, o_custkey as custkey, c_name, c_nationkey as nationkey, 0 as race,
case when c.c_acctbal > 9000 then c.c_acctbal / 100 when n.n_regionkey % 2 = 0 then n.n_regionkey * 1.5e0 else 10.0e0 end as max_speed
from orders join customer c on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey""")
def default_amend_chain(t):
    """The flagship: a default, overridden by what is known of the nation, overridden by what is known of the customer."""
    moves = Relation(t.orders.select("o_orderkey", F.col("o_custkey").alias("custkey")), "moves", ("custkey",), unique=False)
    nations = Relation(t.nation.where("n_regionkey % 2 = 0").select(F.col("n_nationkey").alias("nationkey"), (F.col("n_regionkey") * 1.5).cast("double").alias("max_speed")), "nations", ("nationkey",), ordered=False)
    known = Relation(t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("custkey"), (F.col("c_acctbal") / 100).alias("max_speed")), "known", ("custkey",))
    return natural(moves).join(_customers(t)).join(Default({"race": 0})).join(Default({"max_speed": 10.0})).amend(nations).amend(known).select()


@query("select o_custkey as custkey, o_orderkey, c_name, c_nationkey as nationkey from orders join customer on o_custkey = c_custkey where o_custkey = 5")
def named_bodied_lookup(t):
    return natural(t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey")).join(_customers(t)).lookup(custkey=5)


@query(f"""select n_name as name, c_custkey as user_id, o_orderkey, o_totalprice from nation join customer on n_nationkey = c_nationkey
join (select * from {_R} where rn = 1) on user_id = c_custkey where n_regionkey = 1 and o_totalprice <> 0""")
def correlated_lookup(t):
    bodies = Relation(t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_custkey").alias("custkey")), "bodies", ("nationkey",), unique=False)
    lands = t.relation("nation", "n_nationkey").df.where("n_regionkey = 1").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    pairs = natural(lands).join(bodies).select()
    found = from_(Relation(pairs, "pairs", ("custkey",), unique=False)).join(_orders(t)).find()
    return found.where(lambda c: c("orders.o_totalprice") != 0).select(name=("pairs", "name"), user_id=("pairs", "custkey"), o_orderkey=("orders", "o_orderkey"), o_totalprice=("orders", "o_totalprice"))


@query("select n_nationkey as a, n_regionkey as b, n_nationkey * 0.5e0 as normal from nation union all select n_regionkey, n_nationkey, -(n_nationkey * 0.5e0) from nation")
def symmetrize_pairs(t):
    return symmetrized(t.nation.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), (F.col("n_nationkey") * F.lit(0.5)).alias("normal")), "a", "b", ["normal"])


# -- folds and windows ------------------------------------------------------------------------------------------------

_MOVES = {"view": (1.0, 0.0), "click": (-1.0, 0.0), "signup": (0.0, 1.0), "purchase": (0.0, -1.0)}


@query("""with s as (select user_id, sum(case event_type when 'view' then 1 when 'click' then -1 else 0 end)::double as x,
 sum(case event_type when 'signup' then 1 when 'purchase' then -1 else 0 end)::double as y from events group by user_id)
select user_id, round(case when sqrt(x * x + y * y) > 0.0001 then x / sqrt(x * x + y * y) else x end, 9) as dx,
 round(case when sqrt(x * x + y * y) > 0.0001 then y / sqrt(x * x + y * y) else y end, 9) as dy from s""")
def case_sum_moves(t):
    part = lambda k: F.sum(F.coalesce(*(F.when(F.col("event_type") == e, F.lit(v[k])) for e, v in _MOVES.items()), F.lit(0.0)))
    total = t.events.groupBy("user_id").agg(part(0).alias("x"), part(1).alias("y"))
    v = vectors.vec("x", "y")
    unit = F.when(vectors.length(v) > 0.0001, vectors.normalize(v)).otherwise(v)
    return total.select("user_id", unit.alias("u")).select("user_id", F.round("u.x", 9).alias("dx"), F.round("u.y", 9).alias("dy"))


@query("select event_type, bit_xor(event_id) as flags from events group by event_type")
def bit_xor_flags(t):
    return t.events.groupBy("event_type").agg(F.bit_xor("event_id").alias("flags"))


@query("select user_id, arg_min(event_id, (value, event_id)) as event_id, min(value) as cost from events group by user_id")
def argmin_by_key(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.min("value").alias("cost"))


def _trimmed(rows: str, value: str, divide: str) -> str:
    w = f"over (partition by user_id order by ts, event_id rows between {rows})"
    low = f"case when count({value}) {w} < 7 then least(0, coalesce(min({value}) {w}, 0)) else min({value}) {w} end"
    high = f"case when count({value}) {w} < 7 then greatest(0, coalesce(max({value}) {w}, 0)) else max({value}) {w} end"
    return f"(coalesce(sum({value}) {w}, 0) - ({low}) - ({high})) {divide} 5"


_KEY, _ORDER = ["user_id"], ["ts", "event_id"]


@query(f"select event_id, round({_trimmed('6 preceding and current row', 'value', '/')}, 6) as estimate from events")
def trimmed_moving_avg(t):
    return t.events.select("event_id", F.round(moving.trimmed_average("value", _KEY, _ORDER), 6).alias("estimate"))


@query(f"select event_id, round({_trimmed('7 preceding and 1 preceding', 'value', '/')}, 6) as estimate from events")
def trimmed_moving_pred(t):
    return t.events.select("event_id", F.round(moving.trimmed_prediction("value", _KEY, _ORDER), 6).alias("estimate"))


@query("select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 6 preceding and current row) / 7, 6) as estimate from events")
def moving_avg(t):
    return t.events.select("event_id", F.round(moving.average("value", _KEY, _ORDER), 6).alias("estimate"))


@query(f"""with d as (select *, cast(floor(value * 100000) as bigint) as ns from events),
p as (select event_id, ns, cast({_trimmed('7 preceding and 1 preceding', 'ns', '//')} as bigint) as predicted from d)
select event_id, ns, predicted, abs(predicted - ns) as error, case when predicted > ns then (predicted - ns) // 2 else 0 end as sleep from p""")
def frame_pacing(t):
    d = t.events.select("event_id", "user_id", "ts", F.floor(F.col("value") * 100000).cast("long").alias("ns"))
    p = d.select("event_id", "ns", moving.trimmed_prediction("ns", _KEY, _ORDER, whole=True).alias("predicted"))
    return p.withColumns({"error": F.abs(F.col("predicted") - F.col("ns")), "sleep": scalars.half_excess(F.col("predicted"), F.col("ns"))})


@query("""with d as (select event_id, event_id * 7919 % 12000000 as p, event_id * 104729 % 100000000 as d from events),
n as (select *, case when p >= 10000000 then 1 else d // (10000000 - p) + 1 end as n from d)
select event_id, cast(greatest(2000000, least(10000000, case when p >= 10000000 or n > 10 then 10000000 else (d + p * n) // n end)) as bigint) as step from n""")
def step_clamp(t):
    d = t.events.select("event_id", (F.col("event_id") * 7919 % 12_000_000).alias("p"), (F.col("event_id") * 104_729 % 100_000_000).alias("d"))
    return d.select("event_id", scalars.step(F.col("p"), F.col("d")).alias("step"))


@query("select event_id, greatest(event_id * 1000000, event_id * 1000000 + user_id * 100000 - 10000000) as game_time from events")
def lag_bound(t):
    now = F.col("event_id") * 1_000_000 + F.col("user_id") * 100_000
    return t.events.select("event_id", scalars.bounded_lag(F.col("event_id") * 1_000_000, now).alias("game_time"))


# -- ticks ------------------------------------------------------------------------------------------------------------


def _ticked(t) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", F.dayofmonth("ts").alias("tick"))


_TICKED = "ticked as (select event_id, user_id, event_type, value, cast(day(ts) as integer) as tick from events)"


@query(f"with {_TICKED} select event_id, tick, tick as reader_tick from ticked")
def tick_clear(t):
    return ticks.cleared(_ticked(t)).select("event_id", "tick", "reader_tick")


@query(f"""with {_TICKED}, c as (select tick, count(*) as n_new from ticked group by tick)
select tick, n_new, cast(coalesce(sum(n_new) over (order by tick rows between unbounded preceding and 1 preceding), 0) as bigint) as n_seen from c""")
def tick_snapshot(t):
    return ticks.snapshot_counts(_ticked(t))


@query(f"with {_TICKED} select event_id, tick, 15 as reader_tick from ticked where tick < 15")
def tick_snapshot_rows(t):
    return ticks.PerTick(_ticked(t), "snapshot").read(15).select("event_id", "tick", "reader_tick")


@query(f"""with {_TICKED} select 'clear' as kind, event_id from ticked where tick = 15 union all select 'snapshot', event_id from ticked where tick < 15
union all select 'buffer', event_id from ticked where tick = 14""")
def tick_declared(t):
    seen = [ticks.PerTick(_ticked(t), k).read(15).select(F.lit(k).alias("kind"), "event_id") for k in ("clear", "snapshot", "buffer")]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query(f"with {_TICKED} select event_id, tick, tick + 1 as reader_tick from ticked where tick + 1 in (select tick from ticked)")
def tick_double_buffer(t):
    rows = _ticked(t)
    return ticks.double_buffered(rows, rows.select("tick").distinct()).select("event_id", "tick", "reader_tick")


@query("select user_id from events group by user_id having arg_max(event_type in ('view', 'click'), (ts, event_id))")
def latest_state(t):
    return ticks.latest_state(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "click"))


@query("select event_id, value from events where value < 10.0 order by value")
def due_by_deadline(t):
    return ticks.due(t.events.select("event_id", "value"), "value", F.lit(10.0))


# -- scalars ----------------------------------------------------------------------------------------------------------


@query("select p_partkey, p_size::double as x, p_retailprice as y from part")
def vec_view(t):
    return t.part.select("p_partkey", vectors.vec(F.col("p_size").cast("double"), "p_retailprice").alias("v")).select("p_partkey", "v.x", "v.y")


@query("""with v as (select p_partkey, p_size::double as a, p_retailprice as b, (p_partkey % 7)::double as c from part)
select p_partkey, a * 2 - b as x, c * 2 - a as y, b * 2 - c as z, 0e0 + a * b + c * a + b * c as d, round(sqrt(0e0 + a * a + c * c), 9) as plane from v""")
def vec_three(t):
    v = t.part.select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 7).cast("double").alias("c"))
    p, q = vectors.vec_k("a", "c", "b"), vectors.vec_k("b", "a", "c")
    moved = vectors.add_k(vectors.subtract_k(vectors.scale_k(p, 2.0), q), vectors.zero_k(3))
    flat = F.round(vectors.length_k(vectors.subvector(p, 2)), 9)
    return v.select("p_partkey", moved[0].alias("x"), moved[1].alias("y"), moved[2].alias("z"), vectors.dot_k(p, q).alias("d"), flat.alias("plane"))


@query("""select event_id, event_id * 1234567 / 1e9 as seconds, cast(round(value * 1000) as bigint) * 1000000 as nanoseconds from events""")
def duration_casts(t):
    whole = F.floor(F.col("value") * 1000 + 0.5) / 1000
    return t.events.select("event_id", scalars.seconds(F.col("event_id") * 1_234_567).alias("seconds"), scalars.nanoseconds(whole).alias("nanoseconds"))


@query("""with v as (select p_partkey, (p_size - 10)::double as x, (p_size % 3)::double as y from part)
select p_partkey, x * x + y * y as squared, round(sqrt(x * x + y * y), 9) as length, round(x / nullif(sqrt(x * x + y * y), 0), 9) as unit_x from v""")
def vec_length(t):
    v = vectors.vec((F.col("p_size") - 10).cast("double"), (F.col("p_size") % 3).cast("double"))
    return t.part.select("p_partkey", vectors.length_squared(v).alias("squared"), F.round(vectors.length(v), 9).alias("length"), F.round(vectors.normalize(v)["x"], 9).alias("unit_x"))


@query("select p_partkey, least(p_size, 20) as low_x, least(p_partkey, 500) as low_y, greatest(p_size, 20) as high_x, greatest(p_partkey, 500) as high_y from part")
def vec_minmax(t):
    v, w = vectors.vec("p_size", "p_partkey"), vectors.vec(F.lit(20), F.lit(500).cast("long"))
    low, high = vectors.least(v, w), vectors.greatest(v, w)
    return t.part.select("p_partkey", low["x"].alias("low_x"), low["y"].alias("low_y"), high["x"].alias("high_x"), high["y"].alias("high_y"))


@query("select p_partkey, (p_size + p_retailprice) * 2 - 1 as x, (p_retailprice + p_size) * 2 - 1 as y, p_size * p_retailprice + p_retailprice * p_size as d from part")
def vec_arith(t):
    a, b = vectors.vec(F.col("p_size").cast("double"), "p_retailprice"), vectors.vec("p_retailprice", F.col("p_size").cast("double"))
    r = vectors.subtract(vectors.scale(vectors.add(a, b), 2), vectors.vec(F.lit(1.0), F.lit(1.0)))
    return t.part.select("p_partkey", r["x"].alias("x"), r["y"].alias("y"), vectors.dot(a, b).alias("d"))


@query("""select c_custkey, greatest(-100e0, least(100e0, (10e0 - (c_acctbal / 1000e0 * 0.6e0 + c_nationkey * 0.8e0)) * 25e0)) as force from customer""")
def move_force(t):
    velocity, heading = vectors.vec(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")), vectors.vec(F.lit(0.6), F.lit(0.8))
    return t.customer.select("c_custkey", vectors.clamp((F.lit(10.0) - vectors.dot(velocity, heading)) * F.lit(25.0), -100.0, 100.0).alias("force"))


@query("select p_partkey, case when p_size % 2 = 0 then substring(p_name, 1, greatest(length(p_name) - 1, 0)) else p_name || 'x' end as edited from part")
def string_edit(t):
    return t.part.select("p_partkey", scalars.edited(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "\b").otherwise("x")).alias("edited"))


@query("select p_partkey, p_size > 0 and (p_size & (p_size - 1)) = 0 as is_power from part")
def power_of_two(t):
    return t.part.select("p_partkey", scalars.power_of_two(F.col("p_size")).alias("is_power"))


@query("select p_partkey, cast(p_size as bigint) as size, coalesce(try_cast(regexp_extract(p_brand, '^\\s*([+-]?\\d+)', 1) as bigint), 0) as brand from part")
def parse_size(t):
    return t.part.select("p_partkey", scalars.leading_int(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("px"))).alias("size"), scalars.leading_int(F.col("p_brand")).alias("brand"))


@query("select page_id, regexp_extract(url, '([^/]*?)(?:\\.[^./]*)?$', 1) as stem from pages")
def path_stem(t):
    return t.pages.select("page_id", scalars.path_stem(F.col("url")).alias("stem"))


# -- closures, parsing, files, extensions -----------------------------------------------------------------------------


_GRAMMAR = [
    ("S", ("N", "V", "N"), 1.0),
    ("S", ("N", "V"), 2.0),
    ("N", ("A", "N"), 0.5),
    ("V", ("move",), 0.0),
    ("N", ("thing",), 0.0),
    ("A", ("kind",), 0.0),
]


@query("""with recursive e as (select n_nationkey as a, n_regionkey + 100 as b from nation union select r_regionkey + 100, r_regionkey + 101 from region),
c as (select a, b from e union select c.a, e.b from c join e on c.b = e.a) select a, b from c""")
def transitive_closure(t):
    edges = t.nation.select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 100).alias("b")).unionByName(t.region.select((F.col("r_regionkey") + 100).alias("a"), (F.col("r_regionkey") + 101).alias("b")))
    return fixpoint.transitive_closure(edges)


@query("""select * from (values (1, 1.0e0, '(S (N (thing)) (V (move)) (N (thing)))'), (2, 2.0e0, '(S (N (thing)) (V (move)))'),
    (3, 1.5e0, '(S (N (A (kind)) (N (thing))) (V (move)) (N (thing)))'), (4, null, null), (5, null, null)) t(id, cost, tree)""")
def cyk_parse_fixed(t):
    """A few sentences whose cheapest parses are written out in the SQL."""
    texts = ["thing move thing", "thing move", "kind thing move thing", "move thing", ""]
    sentences = t._spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string")
    words = {w: {w: 0.0} for w in ("thing", "move", "kind")}
    return fixpoint.parse_sentences(sentences, fixpoint.Grammar(_GRAMMAR), words, "S")


def _sentences(t) -> DataFrame:
    """user_id, day, text: all events of a user's day in order; an event without a type is the word '?'."""
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return days.select("user_id", "day", F.array_join(F.transform("e", lambda x: x.event_type), " ", "?").alias("text"))


@query()
def cyk_parse(t):
    grammar = fixpoint.Grammar(_GRAMMAR)
    kinds = {"view": {"thing": 0.0}, "click": {"move": 0.0}, "purchase": {"move": 0.2, "thing": 0.3}, "signup": {"kind": 0.0, "thing": 1.0}, "error": {"kind": 0.1}}
    return fixpoint.parse_sentences(_sentences(t), grammar, kinds, "S", "user_id", "day")


@query("""select * from (values (16::bigint, 'grass', 'a', 0), (16::bigint, 'grass', 'b', 1), (16::bigint, 'stone', 'c', 0), (32::bigint, 'stone', 'c', 0))
    t(size, type, name, array_index)""")
def dir_tree_source(t):
    from ..sources import files

    return files.sprite_tree(t._spark, files.sample_tree(t._spark))


def _boxes(t) -> DataFrame:
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    return t.part.select(F.col("p_partkey").alias("id"), x.alias("lo_x"), y.alias("lo_y"), (x + 1).alias("hi_x"), (y + 0.25).alias("hi_y"))


_BOXES = "b as (select p_partkey as id, p_size::double as lo_x, p_retailprice / 100 as lo_y, p_size::double + 1 as hi_x, p_retailprice / 100 + 0.25 as hi_y from part)"


@query(f"with {_BOXES} select a.id as a_id, b.id as b_id from b a join b on a.lo_x <= b.hi_x and b.lo_x <= a.hi_x and a.lo_y <= b.hi_y and b.lo_y <= a.hi_y")
def aabb_overlap(t):
    return spatial.overlapping(_boxes(t), _boxes(t), 2.0)


@query(f"with {_BOXES} select a.id as a_id, b.id as b_id from b a join b on a.id < b.id and a.lo_x <= b.hi_x and b.lo_x <= a.hi_x and a.lo_y <= b.hi_y and b.lo_y <= a.hi_y")
def overlapping_pairs(t):
    return spatial.overlapping_pairs(_boxes(t), 2.0)
