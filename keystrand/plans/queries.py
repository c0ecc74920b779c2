"""The registered queries: one for each operator, over databases made of the driver's tables, with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.functions.registry import Plugin, PluginContext, Registry
from keystrand.operators import cursor, duplicates, joins, lookup, overlay
from keystrand.plans.select import select
from keystrand.sources import storage
from keystrand.sources.catalog import Catalog, Database, database
from keystrand.sources.scratch import shared_dir
from keystrand.types import Kind

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

#: name: (id, table, key, record, key kind, record kind, order of duplicates)
DATABASES = {
    "orders": (1, "orders", "o_orderkey", "o_totalprice", Kind.INT64, Kind.REAL64, []),
    "lineitem": (2, "lineitem", "l_orderkey", "l_extendedprice", Kind.INT64, Kind.REAL64, LINE),
    "customer": (3, "customer", "c_custkey", "c_acctbal", Kind.INT64, Kind.REAL64, []),
    "part": (4, "part", "p_partkey", "p_size", Kind.INT64, Kind.INT32, []),
    "supplier": (5, "supplier", "s_suppkey", "s_acctbal", Kind.INT64, Kind.REAL64, []),
    "events": (6, "events", "user_id", "value", Kind.INT64, Kind.REAL64, ["event_id"]),
    "customer_orders": (7, "orders", "o_custkey", "o_orderkey", Kind.INT64, Kind.INT64, ["o_orderkey"]),
    "part_names": (8, "part", "p_name", "p_retailprice", Kind.TEXT, Kind.REAL64, ["p_partkey"]),
    "nation": (9, "nation", "n_nationkey", "n_regionkey", Kind.INT64, Kind.INT32, []),
}


def db(spark: SparkSession, sf_dir: str, name: str) -> Database:
    id, source, key, record, key_kind, record_kind, order = DATABASES[name]
    return database(id, spark.read.parquet(f"{sf_dir}/{source}.parquet"), key, record, key_kind, record_kind, order, duplicates=bool(order))


def sql(name: str) -> str:
    """A subquery with columns k, r, and n: the 0-based place of the pair among its key's."""
    _, source, key, record, _, _, order = DATABASES[name]
    place = f"row_number() over (partition by {key} order by {', '.join(order)}) - 1" if order else "0"
    return f"(select {key} as k, {record} as r, {place} as n from {source} where {key} is not null and {record} is not null)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = oracle


def _number(value: str, digits: int) -> str:
    return f"round(cast({value} as double), {digits})"


def single(name: str, label: str, base: str, oracle: str, digits: int | None, **arguments) -> None:
    """A one-row aggregate; reals are rounded, integers come as bigint."""
    value = (lambda c: F.round(c.cast("double"), digits)) if digits is not None else (lambda c: c.cast("bigint"))
    function = label.lower()
    shown = _number(oracle.partition("|")[0], digits) if digits is not None else f"cast({oracle.partition('|')[0]} as bigint)"
    register(
        name,
        lambda s, d: select(db(s, d, base), function, **arguments).select("key", value(F.col("record")).alias("value")),
        f"select '{label}' as key, {shown} as value from {oracle.partition('|')[2]}",
    )


big = lambda key, record: record > 100000
single("sum_key", "SUM", "orders", f"sum(k)|{sql('orders')}", None, on="key")
single("sum_key_dups", "SUM", "lineitem", f"sum(k)|(select distinct k from {sql('lineitem')})", None, on="key")
single("sum_record", "SUM", "orders", f"sum(r)|{sql('orders')}", 2, on="record")
single("sum_record_where", "SUM", "orders", f"sum(r)|{sql('orders')} where r > 100000", 2, on="record", where=big)
single("sum_record_distinct", "SUM", "lineitem", f"sum(r)|{sql('lineitem')} where n = 0", 2, on="record", distinct=True)
single("sum_key_where_record", "SUM", "lineitem", f"sum(k)|{sql('lineitem')} where r > 50000", None, on="key", where=lambda k, r: r > 50000)
single("average_key", "AVERAGE", "lineitem", f"avg(k)|(select distinct k from {sql('lineitem')})", 6, on="key")
single("average_record", "AVERAGE", "lineitem", f"avg(r)|{sql('lineitem')}", 6, on="record")
single("average_record_where", "AVERAGE", "customer", f"avg(r)|{sql('customer')} where k >= 100", 6, on="record", where=lambda k, r: k >= 100)
single("count_all", "COUNT", "lineitem", f"count(*)|{sql('lineitem')}", None)
single("count_where", "COUNT", "lineitem", f"count(*)|{sql('lineitem')} where r < 20000", None, where=lambda k, r: r < 20000)
single("count_distinct_keys", "COUNT", "lineitem", f"count(distinct k)|{sql('lineitem')}", None, distinct=True)
single("count_distinct_where", "COUNT", "events", f"count(*)|{sql('events')} where n = 0 and r > 50", None, distinct=True, where=lambda k, r: r > 50)
single("range_sum", "SUM", "orders", f"sum(r)|{sql('orders')} where k >= 100 and k < 900", 2, on="record", begin=100, end=900)
single("range_count", "COUNT", "lineitem", f"count(*)|{sql('lineitem')} where k >= 100 and k < 900", None, begin=100, end=900)


def pairs(name: str, base: str, function: str, oracle: str, **arguments) -> None:
    """A select whose result is pairs: columns key and record, as they are."""
    register(name, lambda s, d: select(db(s, d, base), function, **arguments), oracle)


def best(base: str, order: str, where: str = "true") -> str:
    return f"select k as key, r as record from {sql(base)} where {where} order by {order}, k, n limit 1"


def extremes(base: str, value: str, way: str, n: int, where: str = "true") -> str:
    return (
        f"select k as key, r as record from (select *, row_number() over (partition by {value} order by k, n) as f from {sql(base)} where {where}) "
        f"where f = 1 order by {value} {way} limit {n}"
    )


pairs("min_record", "lineitem", "min", best("lineitem", "r"), on="record")
pairs("min_record_where", "customer", "min", best("customer", "r", "r > 0"), on="record", where=lambda k, r: r > 0)
pairs("min_key", "events", "min", best("events", "k"), on="key")
pairs("max_record", "lineitem", "max", best("lineitem", "r desc"), on="record")
pairs("max_record_negative", "customer", "max", best("customer", "r desc", "r < 0"), on="record", where=lambda k, r: r < 0)
pairs("max_where", "part", "max", best("part", "r desc", "k < 150"), on="record", where=lambda k, r: k < 150)
pairs("top_record", "events", "top", extremes("events", "r", "desc", 20), on="record", limit=20)
pairs("top_where", "part", "top", extremes("part", "r", "desc", 10, "k > 50"), on="record", limit=10, where=lambda k, r: k > 50)
pairs("top_key", "lineitem", "top", extremes("lineitem", "k", "desc", 10), on="key", limit=10)
pairs("bottom_record", "events", "bottom", extremes("events", "r", "asc", 20), on="record", limit=20)
pairs("bottom_where", "customer", "bottom", extremes("customer", "r", "asc", 10, "r < 0"), on="record", limit=10, where=lambda k, r: r < 0)
pairs("value_key", "lineitem", "value", f"select k as key from {sql('lineitem')}", on="key")
pairs("value_record", "orders", "value", f"select r as record from {sql('orders')}", on="record")
pairs("value_both", "part_names", "value", f"select k as key, r as record from {sql('part_names')}", on="both")
pairs("value_where", "lineitem", "value", f"select k as key, r as record from {sql('lineitem')} where r > 90000", on="both", where=lambda k, r: r > 90000)
pairs("value_distinct", "events", "value", f"select k as key, r as record from {sql('events')} where n = 0", on="both", distinct=True)
pairs("range_value", "customer_orders", "value", f"select k as key, r as record from {sql('customer_orders')} where k >= 10 and k < 60", on="both", begin=10, end=60)


def _spread(rows: DataFrame) -> DataFrame:
    return rows.agg((F.max("record") - F.min("record")).alias("record")).select(F.lit("SPREAD").alias("key"), F.round("record", 2).alias("value"))


def _registry() -> Registry:
    found = Registry()
    found.aggregate("spread", _spread)
    found.predicate("cheap", lambda k, r: r < 50000)
    return found


register("user_aggregate", lambda s, d: select(db(s, d, "orders"), "spread", registry=_registry()), f"select 'SPREAD' as key, round(max(r) - min(r), 2) as value from {sql('orders')}")
register("user_aggregate_where", lambda s, d: select(db(s, d, "orders"), "Spread", where="cheap", registry=_registry()), f"select 'SPREAD' as key, round(max(r) - min(r), 2) as value from {sql('orders')} where r < 50000")
register("plugin_predicate", lambda s, d: select(db(s, d, "lineitem"), "count", where="CHEAP", registry=_registry()).select("key", F.col("record").alias("value")), f"select 'COUNT' as key, count(*) as value from {sql('lineitem')} where r < 50000")

PROBE = 333
for _mode, _test, _way in (("exact", "=", ""), ("lt", "<", "desc"), ("leq", "<=", "desc"), ("gt", ">", ""), ("geq", ">=", "")):
    register(
        f"find_{_mode}",
        lambda s, d, m=_mode: lookup.find(db(s, d, "lineitem"), PROBE, m),
        f"select k as key, r as record, cast(sign(k - {PROBE}) as integer) as sign from {sql('lineitem')} where k {_test} {PROBE} order by k {_way}, n limit 1",
    )
register(
    "find_near",
    lambda s, d: lookup.find(db(s, d, "customer_orders"), -5, "near"),
    f"select k as key, r as record, cast(sign(k + 5) as integer) as sign from {sql('customer_orders')} order by k = -5 desc, k < -5 desc, abs(k + 5), n limit 1",
)
for _mode, _test, _pick in (("leq", "<=", "max"), ("lt", "<", "max"), ("geq", ">=", "min"), ("gt", ">", "min")):
    register(
        f"batch_find_{_mode}",
        lambda s, d, m=_mode: lookup.find_all(db(s, d, "lineitem"), s.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") * 7 - 3).alias("p")), "p", m),
        f"with f as (select k, r from {sql('lineitem')} where n = 0), p as (select distinct p_partkey * 7 - 3 as probe from part), "
        f"m as (select probe, (select {_pick}(k) from f where k {_test} probe) as key from p) select probe, key, f.r as record from m left join f on f.k = m.key",
    )
register(
    "batch_find_exact",
    lambda s, d: lookup.find_all(db(s, d, "events"), s.read.parquet(f"{d}/customer.parquet").select("c_custkey"), "c_custkey", "exact"),
    f"select c_custkey as probe, f.k as key, f.r as record from customer left join (select * from {sql('events')} where n = 0) f on f.k = c_custkey",
)

register("cursor_first", lambda s, d: cursor.first(db(s, d, "events")), f"select k as key, r as record from {sql('events')} order by k, n limit 1")
register("cursor_last", lambda s, d: cursor.last(db(s, d, "events")), f"select k as key, r as record from {sql('events')} order by k desc, n desc limit 1")
for _name, _fn, _skip in (("next", "lead", False), ("prev", "lag", False), ("skip_dups", "lead", True)):
    register(
        f"cursor_{_name}",
        lambda s, d, f=_fn, k=_skip: cursor.neighbours(db(s, d, "customer_orders"), forward=f == "lead", skip_duplicates=k),
        f"select k as key, r as record, {_fn}(k) over (order by k, n) as other_key, {_fn}(r) over (order by k, n) as other_record from {sql('customer_orders')}{' where n = 0' if _skip else ''}",
    )
register("cursor_step", lambda s, d: cursor.step(db(s, d, "customer_orders"), 50), f"select k as key, r as record from {sql('customer_orders')} where k > 50 order by k, n limit 1")
register("dup_count", lambda s, d: cursor.duplicate_counts(db(s, d, "lineitem")), f"select k as key, count(*) as n from {sql('lineitem')} group by k")
register("dup_position", lambda s, d: cursor.duplicate_positions(db(s, d, "lineitem")), f"select k as key, r as record, cast(n as bigint) as position from {sql('lineitem')}")
register("dup_next", lambda s, d: cursor.next_duplicates(db(s, d, "events")), f"select k as key, r as record, lead(r) over (partition by k order by n) as next_record from {sql('events')}")
register("dup_first", lambda s, d: cursor.duplicate_ends(db(s, d, "lineitem")), f"select k as key, r as record from {sql('lineitem')} where n = 0")
register("dup_last", lambda s, d: cursor.duplicate_ends(db(s, d, "lineitem"), last=True), f"select k as key, arg_max(r, n) as record from {sql('lineitem')} group by k")
register("dup_prev", lambda s, d: cursor.next_duplicates(db(s, d, "events"), forward=False), f"select k as key, r as record, lag(r) over (partition by k order by n) as previous_record from {sql('events')}")
register("record_size", lambda s, d: cursor.record_sizes(db(s, d, "customer_orders")), f"select k as key, r as record, cast(8 as bigint) as size from {sql('customer_orders')}")
register(
    "record_size_text",
    lambda s, d: cursor.record_sizes(database(11, s.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_name", Kind.INT64, Kind.TEXT)),
    "select p_partkey as key, p_name as record, cast(strlen(p_name) as bigint) as size from part",
)

register(
    "join_nested_1n",
    lambda s, d: joins.one_to_many(db(s, d, "customer"), db(s, d, "customer_orders")),
    f"select a.k as key, a.r as left, b.r as right from {sql('customer')} a join {sql('customer_orders')} b on a.k = b.k",
)
register(
    "join_link_table",
    lambda s, d: joins.through_link(db(s, d, "customer"), db(s, d, "customer_orders"), db(s, d, "orders")),
    f"select a.k as key, a.r as left, c.k as right_key, c.r as right from {sql('customer')} a join {sql('customer_orders')} b on a.k = b.k join {sql('orders')} c on b.r = c.k",
)
register("semi_exists", lambda s, d: joins.existing(db(s, d, "customer"), db(s, d, "customer_orders")), f"select k as key, r as record from {sql('customer')} where k in (select k from {sql('customer_orders')})")
register("anti_missing", lambda s, d: joins.missing(db(s, d, "orders"), db(s, d, "lineitem")), f"select k as key, r as record from {sql('orders')} where k not in (select k from {sql('lineitem')})")

#: Two operations for each order, on its key and on a key past the last: by priority, then by status.
_FIRST = {"1-URGENT": "erase", "2-HIGH": "put", "3-MEDIUM": "insert", "4-NOT SPECIFIED": "find", "5-LOW": "erase"}
_SECOND = {"O": "insert", "F": "find", "P": "put"}


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    case = lambda column, of: F.coalesce(*[F.when(F.col(column) == k, v) for k, v in of.items()], F.lit("find"))
    target = F.col("o_orderkey") + F.col("o_custkey")
    one = orders.select((F.col("o_orderkey") * 2).alias("seq"), case("o_orderpriority", _FIRST).alias("op"), target.alias("key"), (F.col("o_totalprice") + 1).alias("record"))
    two = orders.select((F.col("o_orderkey") * 2 + 1).alias("seq"), case("o_orderstatus", _SECOND).alias("op"), target.alias("key"), (F.col("o_totalprice") + 2).alias("record"))
    return one.unionByName(two)


def _case(column: str, of: dict[str, str]) -> str:
    return f"case {' '.join(f"when {column} = '{k}' then '{v}'" for k, v in of.items())} else 'find' end"


_OPS = (
    f"ops as (select o_orderkey * 2 as seq, {_case('o_orderpriority', _FIRST)} as op, o_orderkey + o_custkey as key, o_totalprice + 1 as record from orders "
    f"union all select o_orderkey * 2 + 1, {_case('o_orderstatus', _SECOND)}, o_orderkey + o_custkey, o_totalprice + 2 from orders), "
    "base as (select o_orderkey as k, o_totalprice as r from orders), "
    "seen as (select ops.*, base.r as stored, last_value(case when op = 'erase' then 0 when op <> 'find' then 1 end ignore nulls) over w as prior from ops left join base on base.k = ops.key "
    "window w as (partition by key order by seq rows between unbounded preceding and 1 preceding)), "
    "there as (select *, coalesce(prior, case when stored is null then 0 else 1 end) = 1 as there from seen), "
    "wrote as (select *, case when op = 'put' or (op = 'insert' and not there) then record end as w from there), "
    "done as (select *, last_value(w ignore nulls) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as written from wrote)"
)
register(
    "bulk_ops",
    lambda s, d: overlay.outcomes(db(s, d, "orders"), _operations(s, d)).select("seq", "op", "key", "status", "found"),
    f"with {_OPS} select seq, op, key, case when op = 'insert' and there then 'DUPLICATE_KEY' when op in ('erase', 'find') and not there then 'KEY_NOT_FOUND' else 'OK' end as status, "
    "case when op = 'find' and there then coalesce(written, stored) end as found from done",
)
_AFTER = (
    "ends as (select key, arg_max(op, seq) filter (where op <> 'find') as op, arg_max(w, seq) filter (where w is not null) as w from done group by key) "
    "select k as key, coalesce(e.w, r) as record from base left join ends e on e.key = k where e.op is null or e.op <> 'erase' "
    "union all select key, w from ends where op <> 'erase' and w is not null and key not in (select k from base)"
)
register("overlay_applied", lambda s, d: overlay.applied(db(s, d, "orders"), _operations(s, d)).rows.select("key", "record"), f"with {_OPS}, {_AFTER}")


def _one_kind(op: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        return overlay.applied(db(s, d, "orders"), _log(s, d, op)).rows.select("key", "record")

    return query


def _log(s: SparkSession, d: str, op: str) -> DataFrame:
    """One operation for each customer, on the order key that equals its number doubled."""
    rows = s.read.parquet(f"{d}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("seq"), F.lit(op).alias("op"), (F.col("c_custkey") * 20).alias("key"), F.col("c_acctbal").alias("record"))


_C = "(select c_custkey * 20 as key, c_acctbal as record from customer)"
_O = "select o_orderkey as key, o_totalprice as record from orders"
register("overlay_insert", _one_kind("insert"), f"{_O} union all select key, record from {_C} where key not in (select o_orderkey from orders)")
register("overlay_overwrite", _one_kind("put"), f"{_O} where o_orderkey not in (select key from {_C}) union all select key, record from {_C}")
register("overlay_erase", _one_kind("erase"), f"{_O} where o_orderkey not in (select key from {_C})")


def _visible(s: SparkSession, d: str) -> DataFrame:
    """A committed insert, an open erase and an aborted overwrite: seen from outside and from the open transaction."""
    store = overlay.Overlay(db(s, d, "orders"))
    a = store.begin()
    store.write(a, _log(s, d, "insert"))
    store.commit(a)
    b = store.begin()
    store.write(b, _log(s, d, "put"))
    store.abort(b)
    c = store.begin()
    store.write(c, _log(s, d, "erase"))
    count = lambda view, name: view.rows.agg(F.count("*").alias("n"), F.round(F.sum("record"), 2).alias("total")).select(F.lit(name).alias("seen_by"), "n", "total")
    return count(store.view(), "others").unionByName(count(store.view(c), "itself"))


register(
    "txn_visible",
    _visible,
    f"with i as ({_O} union all select key, record from {_C} where key not in (select o_orderkey from orders)) "
    f"select 'others' as seen_by, count(*) as n, round(sum(record), 2) as total from i union all select 'itself', count(*), round(sum(record), 2) from i where key not in (select key from {_C})",
)
register(
    "recno_insert",
    lambda s, d: overlay.numbered(
        database(10, s.range(1, 8).select("id", F.lit(0.0).alias("v")), "id", "v", Kind.UINT32, Kind.REAL64, record_number=True),
        s.read.parquet(f"{d}/events.parquet"), F.col("value"), ["event_id"],
    ),
    "select 7 + row_number() over (order by event_id) as key, value as record from events",
)


def _merged(s: SparkSession, d: str) -> DataFrame:
    return storage.merge(db(s, d, "customer"), db(s, d, "supplier").with_rows(db(s, d, "supplier").rows.withColumn("key", F.col("key") * 100))).rows.select("key", "record")


register(
    "merge_import",
    _merged,
    "select c_custkey as key, c_acctbal as record from customer union all select s_suppkey * 100, s_acctbal from supplier where s_suppkey * 100 not in (select c_custkey from customer)",
)
register("dump_text", lambda s, d: storage.dump(db(s, d, "customer_orders"), 8, 4), f"select substring(cast(k as varchar), 1, 8) as key, substring(cast(r as varchar), 1, 4) as record from {sql('customer_orders')}")
register(
    "database_info",
    lambda s, d: storage.info(db(s, d, "lineitem")),
    f"select count(*) as n_pairs, count(distinct k) as n_keys, min(k) as least_key, max(k) as greatest_key, 8.0::double as mean_record_size from {sql('lineitem')}",
)
register(
    "integrity_check",
    lambda s, d: storage.violations(database(12, s.read.parquet(f"{d}/events.parquet"), "user_id", "value", Kind.INT64, Kind.REAL64)),
    f"select k as key, count(*) as n from {sql('events')} group by k having count(*) > 1",
)

# --- signed sums, key-only predicates, plugins --------------------------------

register(
    "sum_signed_negative",
    lambda s, d: select(database(13, s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (-F.col("o_custkey")).alias("v")), "o_orderkey", "v", Kind.INT64, Kind.INT64), "sum", "record").select("key", F.col("record").cast("bigint").alias("value")),
    "select 'SUM' as key, cast(sum(-o_custkey) as bigint) as value from orders",
)
for _name, _value in (("sum", "cast(sum(k) as bigint)"), ("average", "round(avg(k), 6)")):
    register(
        f"{_name}_key_where_key",
        lambda s, d, n=_name: select(db(s, d, "lineitem"), n, "key", where=lambda k, r: k % 3 == 0, where_reads_record=False).select("key", (F.col("record").cast("bigint") if n == "sum" else F.round("record", 6)).alias("value")),
        f"select '{_name.upper()}' as key, {_value} as value from (select distinct k from {sql('lineitem')}) where k % 3 = 0",
    )


def plugin_descriptor(name: str) -> Plugin | None:
    """What ``name@keystrand.plans.queries`` finds."""
    return Plugin(name, predicate=lambda k, r: k % 2 == 0, needs=frozenset({"key"})) if name == "even" else None


register("plugin_locator", lambda s, d: select(db(s, d, "lineitem"), "count", where="even@keystrand.plans.queries", registry=Registry()).select("key", F.col("record").alias("value")), f"select 'COUNT' as key, count(*) as value from {sql('lineitem')} where k % 2 = 0")


def _described(rows: DataFrame, context: PluginContext) -> DataFrame:
    """One row for each hundred of the key, with the types that the plugin was told."""
    kinds = f"{context.key_kind.value[0]} {context.record_kind.value[0]} {context.duplicates} {context.on} {context.distinct}"
    return rows.groupBy((F.col("key") / 100).cast("long").alias("key")).agg(F.count("*").alias("record")).withColumn("told", F.lit(kinds))


def _counting() -> Registry:
    found = Registry()
    found.aggregate("described", _described, needs=("key",))
    return found


register(
    "aggregate_many_rows",
    lambda s, d: select(db(s, d, "lineitem"), "described", registry=_counting()),
    f"select cast(floor(k / 100) as bigint) as key, count(*) as record, 'int64 real64 True key False' as told from {sql('lineitem')} group by 1",
)

# --- text keys, and keys in an order of their own -----------------------------

_PREFIXES = "(select distinct substring(p_name, 1, 7) as probe from part)"


def _prefixes(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select(F.substring("p_name", 1, 7).alias("probe"))


for _mode, _test, _pick in (("leq", "<=", "max"), ("lt", "<", "max"), ("geq", ">=", "min"), ("gt", ">", "min")):
    register(
        f"batch_find_{_mode}_text",
        lambda s, d, m=_mode: lookup.find_all(db(s, d, "part_names"), _prefixes(s, d), "probe", m),
        f"with f as (select k, r from {sql('part_names')} where n = 0), m as (select probe, (select {_pick}(k) from f where k {_test} probe) as key from {_PREFIXES}) "
        "select probe, key, f.r as record from m left join f on f.k = m.key",
    )
register(
    "batch_find_near",
    lambda s, d: lookup.find_all(db(s, d, "customer_orders"), s.range(-20, 2000).select((F.col("id") * 3).alias("p")), "p", "near"),
    f"with f as (select k, r from {sql('customer_orders')} where n = 0), p as (select unnest(range(-20, 2000)) * 3 as probe), "
    "m as (select probe, coalesce((select max(k) from f where k <= probe), (select min(k) from f where k > probe)) as key from p) select probe, key, f.r as record from m left join f on f.k = m.key",
)
for _name, _fn in (("next", "lead"), ("prev", "lag")):
    register(
        f"cursor_{_name}_text",
        lambda s, d, f=_fn: cursor.neighbours(db(s, d, "part_names"), forward=f == "lead"),
        f"select k as key, r as record, {_fn}(k) over (order by k, n) as other_key, {_fn}(r) over (order by k, n) as other_record from {sql('part_names')}",
    )


def _descending(s: SparkSession, d: str) -> Database:
    return db(s, d, "customer_orders").with_order(lambda key: -key)


register("order_descending_first", lambda s, d: cursor.first(_descending(s, d)), f"select k as key, r as record from {sql('customer_orders')} order by k desc, n limit 1")
register("order_descending_last", lambda s, d: cursor.last(_descending(s, d)), f"select k as key, r as record from {sql('customer_orders')} order by k, n desc limit 1")
register("order_descending_step", lambda s, d: cursor.step(_descending(s, d), 50), f"select k as key, r as record from {sql('customer_orders')} where k < 50 order by k desc, n limit 1")
register(
    "order_descending_next",
    lambda s, d: cursor.neighbours(_descending(s, d)),
    f"select k as key, r as record, lead(k) over (order by k desc, n) as other_key, lead(r) over (order by k desc, n) as other_record from {sql('customer_orders')}",
)
register(
    "order_descending_batch_find",
    lambda s, d: lookup.find_all(_descending(s, d), s.range(0, 500).select((F.col("id") * 7).alias("p")), "p", "leq"),
    f"with f as (select k, r from {sql('customer_orders')} where n = 0), p as (select unnest(range(0, 500)) * 7 as probe), "
    "m as (select probe, (select min(k) from f where k >= probe) as key from p) select probe, key, f.r as record from m left join f on f.k = m.key",
)
register("range_bookmark", lambda s, d: cursor.bookmark(db(s, d, "lineitem"), 100, 900), f"select k as key, r as record from {sql('lineitem')} where k >= 900 order by k, n limit 1")

# --- changes to single duplicates ----------------------------------------------


def _anchored(events: Database, op: str) -> DataFrame:
    """Two operations for each user of a number divisible by three, at the user's second event (one for overwrite and erase)."""
    # by the bookmark: other events of the user may have the same value
    at = events.rows.filter("key % 3 = 0 and ord.n = 1").select("key", "ord")
    # the log's order counts among the operations of one key; a number made from the key could overflow
    one = at.select(F.lit(0).cast("long").alias("seq"), F.lit(op).alias("op"), "key", F.col("ord").alias("at"), (F.col("key") * 1.0).alias("record"))
    return one if op in ("overwrite", "erase") else one.unionByName(one.withColumn("seq", F.col("seq") + 1).withColumn("record", F.col("record") + 0.5))


def _changed(op: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        events = db(s, d, "events")
        # null event_ids last, as the SQL has them
        late = F.struct(F.col("ord.event_id").isNull().alias("late"), "ord.event_id")
        # numbered first: events of a user may have the same event_id, and a bookmark is to name one of them
        events = duplicates.renumbered(events.with_rows(events.rows.withColumn("ord", late)))
        return cursor.duplicate_positions(duplicates.applied(events, _anchored(events, op)))

    return query


_E = sql("events")
_T = f"select k, k * 1.0::double as r from {_E} where n = 1 and k % 3 = 0"
for _op, _parts in {
    "first": f"select k, r, n + 10.0 as n from {_E} union all select k, r, 2.0 from ({_T}) union all select k, r + 0.5, 1.0 from ({_T})",
    "last": f"select k, r, n * 1.0 as n from {_E} union all select k, r, 1e9 from ({_T}) union all select k, r + 0.5, 2e9 from ({_T})",
    "before": f"select k, r, n * 1.0 as n from {_E} union all select k, r, 0.3 from ({_T}) union all select k, r + 0.5, 0.6 from ({_T})",
    "after": f"select k, r, n * 1.0 as n from {_E} union all select k, r, 1.6 from ({_T}) union all select k, r + 0.5, 1.3 from ({_T})",
    "overwrite": f"select k, case when n = 1 and k % 3 = 0 then k * 1.0::double else r end as r, n from {_E}",
    "erase": f"select k, r, n from {_E} where not (n = 1 and k % 3 = 0)",
}.items():
    register(
        f"dup_insert_{_op}" if _op not in ("overwrite", "erase") else f"dup_{_op}_one",
        _changed(_op),
        f"select k as key, r as record, row_number() over (partition by k order by n) - 1 as position from ({_parts})",
    )

# --- stored databases ------------------------------------------------------------


def _root(s: SparkSession) -> str:
    return f"{shared_dir(s)}/keystrand/catalog-{uuid.uuid4().hex}"


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Created under a root by one catalog, opened by number and read by another."""
    root = _root(s)
    Catalog(s, root).create(db(s, d, "lineitem"))
    return select(Catalog(s, root, read_only=True).open(DATABASES["lineitem"][0]), "value", "both", where=lambda k, r: r > 50000, distinct=True)


register("open_stored", _stored, f"select k as key, r as record from {sql('lineitem')} where n = 0 and r > 50000")


def _flushed(s: SparkSession, d: str) -> DataFrame:
    """Committed operations become a new version; an open transaction's don't."""
    root = _root(s)
    catalog = Catalog(s, root)
    store = overlay.Overlay(catalog.create(db(s, d, "orders")))
    one = store.begin()
    store.write(one, _log(s, d, "insert"))
    store.commit(one)
    store.write(store.begin(), _log(s, d, "erase"))
    catalog.flush(store.flush())
    return Catalog(s, root).open(DATABASES["orders"][0]).rows.select("key", "record")


register("flush_stored", _flushed, f"{_O} union all select key, record from {_C} where key not in (select o_orderkey from orders)")


def _cursor_view(s: SparkSession, d: str) -> DataFrame:
    """Cursors of others step over the keys that an open transaction has changed."""
    store = overlay.Overlay(db(s, d, "orders"))
    store.write(store.begin(), _log(s, d, "put"))
    return store.cursor_view(store.begin()).rows.select("key", "record")


register("txn_cursor", _cursor_view, f"{_O} where o_orderkey not in (select key from {_C})")


def _found_in_view(s: SparkSession, d: str) -> DataFrame:
    store = overlay.Overlay(db(s, d, "orders"))
    mine = store.begin()
    store.write(mine, _log(s, d, "erase"))
    return lookup.find_all(store.view(mine), s.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") * 20).alias("p")), "p", "leq")


register(
    "txn_find",
    _found_in_view,
    f"with f as ({_O} where o_orderkey not in (select key from {_C})), m as (select key as probe, (select max(key) from f where f.key <= c.key) as key from {_C} c) select probe, m.key, record from m left join f on f.key = m.key",
)


def _exported(s: SparkSession, d: str) -> DataFrame:
    path = f"{_root(s)}-export"
    storage.export_rows(db(s, d, "customer_orders"), path)
    return s.read.schema("key bigint, record bigint").json(path)


register("export_rows", _exported, f"select k as key, r as record from {sql('customer_orders')}")
