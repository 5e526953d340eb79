"""Queries of joins, aggregates, windows and scalar functions over the star schema and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import digests as D
from tracemill.functions import scalars as S
from tracemill.operators import relations as R
from tracemill.operators import stateful as ST
from tracemill.operators import trajectories as T
from tracemill.sources.files import ParseCsv
from tracemill.tables import load

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def column_total(spark, d):
    rows = load(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("sum_cents"), F.count("*").alias("n")
    )


@query("""
SELECT o_orderkey, c.c_custkey AS cust, c_mktsegment FROM orders JOIN customer c ON c.c_custkey = o_custkey
WHERE o_orderkey % 4 <> 1
""")
def coerced_join(spark, d):
    """Order keys written in several ways: with spaces they mean the same number, as a decimal they don't."""
    key = F.col("o_custkey").cast("string")
    written = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" "), key, F.lit("  "))).when(F.col("o_orderkey") % 4 == 1, F.concat(key, F.lit(".0"))).otherwise(key)
    left = load(spark, d, "orders").select("o_orderkey", written.alias("cust"))
    right = load(spark, d, "customer").select(F.col("c_custkey").alias("cust"), "c_mktsegment")
    return R.coerced_join(left, right, "cust", "cust", ["cust"])


@query("""
SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity < 10 THEN 10 WHEN l_quantity > 40 THEN 40 ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS total
FROM lineitem GROUP BY ALL
""")
def clamped_total(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(S.clamped(F.col("l_quantity").cast("bigint"), F.lit(10), F.lit(40)).cast("bigint")).alias("total"))


@query("""
SELECT l_orderkey, CAST(rn - 2 AS INTEGER) AS place, CAST(s AS BIGINT) AS total FROM (
    SELECT l_orderkey, row_number() OVER w AS rn, sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)
) WHERE rn >= 3
""")
def window_sums(spark, d):
    """Sums of three neighbouring lines of an order; orders have a handful of lines."""
    rows = load(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("q")).alias("x"))
    lists = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias("q"))
    return lists.select("l_orderkey", F.posexplode(S.window_sums(F.col("q"), 3)).alias("place", "total")).select("l_orderkey", (F.col("place") + 1).alias("place"), "total")


@query("""
SELECT l_orderkey, array_to_string(list_concat(l[len(l) - k + 1:], l[:len(l) - k]), ',') AS rotated FROM (
    SELECT l_orderkey, l, (l_orderkey % 11) % len(l) AS k FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l FROM lineitem GROUP BY ALL)
)
""")
def rotate_array(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("l"))
    return rows.select("l_orderkey", F.array_join(S.rotate_right(F.col("l"), (F.col("l_orderkey") % 11).cast("int")), ",").alias("rotated"))


@query("""
SELECT nation, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY ALL
) GROUP BY ALL
""")
def merge_counts(spark, d):
    a = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    b = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("m"))
    return a.join(b, "nation", "full").select("nation", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


@query("""
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS length FROM (
    SELECT user_id, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
        SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events
    )
) GROUP BY ALL
""")
def run_lengths(spark, d):
    return R.run_lengths(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "run", "event_type", "length")


@query("""
WITH marked AS (
    SELECT user_id, ts, event_id, event_type || props AS sig, lag(event_type || props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type <> 'view'
)
SELECT e.user_id, count(*) AS turns, count(*) FILTER (m.sig IS NOT NULL) AS parsed_turns, count(*) FILTER (m.sig = m.prev) AS repeated_turns
FROM events e LEFT JOIN marked m USING (user_id, ts, event_id) GROUP BY ALL
""")
def loop_rate(spark, d):
    """Events as turns of a user: views are turns without calls, which are passed over."""
    sig = F.when(F.col("event_type") != "view", F.array(F.concat("event_type", "props"))).otherwise(F.array().cast("array<string>"))
    turns = T.repeated(load(spark, d, "events").withColumn("sigs", sig), ["user_id"], ["ts", "event_id"], "sigs")
    return turns.groupBy("user_id").agg(F.count("*").alias("turns"), F.count_if(F.size("sigs") > 0).alias("parsed_turns"), F.count_if("repeated").alias("repeated_turns"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 15 = 0 THEN 'FizzBuzz' WHEN p_partkey % 3 = 0 THEN 'Fizz' WHEN p_partkey % 5 = 0 THEN 'Buzz' ELSE CAST(p_partkey AS VARCHAR) END AS said FROM part")
def fizzbuzz(spark, d):
    return load(spark, d, "part").select("p_partkey", S.fizzbuzz(F.col("p_partkey")).alias("said"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(CAST(round((p_size - 32) * 5.0 / 9) AS BIGINT) AS VARCHAR) || 'C'
    WHEN 1 THEN CAST(CAST(round(-p_size * 9.0 / 5 + 32) AS BIGINT) AS VARCHAR) || 'F' ELSE 'invalid' END AS converted FROM part
""")
def temp_convert(spark, d):
    n = F.col("p_size").cast("string")
    written = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit("F"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-"), n, F.lit("C"))).otherwise(F.concat(n, F.lit(" K")))
    return load(spark, d, "part").select("p_partkey", S.convert_temperature(written).alias("converted"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, abs(CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(38, 18)) - CAST(CAST(l_tax AS VARCHAR) AS DECIMAL(38, 18))) <= CAST(0.02 AS DECIMAL(38, 18)) AS near FROM lineitem
""")
def decimal_close(spark, d):
    near = S.decimal_close(F.col("l_discount").cast("string"), F.col("l_tax").cast("string"), "0.02")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", near.alias("near"))


@query("""
SELECT event_id, spent, spent - cost >= 5000 AS stopped, spent > 5000 AS over FROM (
    SELECT event_id, cost, CAST(sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS spent FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cost FROM events)
)
""")
def budget_stop(spark, d):
    cost = load(spark, d, "events").withColumn("cost", F.round(F.col("value") * 100).cast("bigint"))
    return T.over_budget(cost, ["user_id"], ["ts", "event_id"], "cost", F.lit(5000)).select("event_id", "spent", "stopped", "over")


def _ledger(spark, d):
    """Purchases of a user are withdrawals, other events deposits, in cents; the event id is the sequence number."""
    e = load(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "withdraw").otherwise("deposit").alias("kind"), F.round(F.col("value") * 100).cast("bigint").alias("amount"), "ts")


_LEDGER = """
WITH RECURSIVE steps AS (
    SELECT user_id, event_id AS seq, event_type = 'purchase' AS out, CAST(round(value * 100) AS BIGINT) AS amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events {where}
),
fold AS (
    SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS balance, CAST(NULL AS BIGINT) AS last_seq, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT user_id FROM steps)
    UNION ALL
    SELECT f.user_id, s.rn, CASE WHEN bad IS NULL THEN after ELSE balance END, CASE WHEN bad IS NULL THEN s.seq ELSE last_seq END, bad
    FROM fold f JOIN steps s ON s.user_id = f.user_id AND s.rn = f.rn + 1,
        LATERAL (SELECT f.balance + CASE WHEN s.out THEN -s.amount ELSE s.amount END AS after) a,
        LATERAL (SELECT CASE WHEN s.amount <= 0 THEN 'amount must be positive' WHEN s.out AND after < 0 THEN 'insufficient funds' END AS bad) b
    WHERE f.error IS NULL
)
"""
_LAST = "SELECT user_id, balance, last_seq, error FROM fold QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1"


@query(_LEDGER.format(where="") + _LAST)
def ledger_replay(spark, d):
    return ST.replay_ledger(_ledger(spark, d), ["user_id"], "ts")


_HALF = "(SELECT max(event_id) // 2 FROM events)"


@query(
    _LEDGER.format(where=f"WHERE event_id <= {_HALF}")
    + f"""SELECT user_id, last_seq AS seq, 'snapshot' AS kind, balance AS amount FROM ({_LAST}) WHERE error IS NULL AND last_seq IS NOT NULL
UNION ALL SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'withdraw' ELSE 'deposit' END, CAST(round(value * 100) AS BIGINT) FROM events WHERE event_id > {_HALF}"""
)
def log_compaction(spark, d):
    """The first half of the log as one snapshot per user, the rest as it is."""
    half = load(spark, d, "events").agg(F.max("event_id")).first()[0] // 2
    return ST.compact_ledger(_ledger(spark, d), ["user_id"], "ts", half)


#: Each user's events in order, one after the other: those of the last hour that were admitted are held, three at most.
_ADMITTED = """
WITH RECURSIVE call AS (
    SELECT event_id, user_id, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
),
walk AS (
    SELECT user_id, event_id, now, i, true AS allowed, CAST(0 AS DOUBLE) AS retry_after, [now] AS held FROM call WHERE i = 1
    UNION ALL
    SELECT user_id, event_id, now, i, len(live) < 3, CASE WHEN len(live) < 3 THEN CAST(0 AS DOUBLE) ELSE live[1] + 3600.0 - now END, CASE WHEN len(live) < 3 THEN list_append(live, now) ELSE live END
    FROM (SELECT c.*, list_filter(w.held, lambda x: c.now - x < 3600.0) AS live FROM walk w JOIN call c ON c.user_id = w.user_id AND c.i = w.i + 1)
)
"""


@query(_ADMITTED + "SELECT event_id, user_id, now, allowed, retry_after FROM walk")
def rate_limiter(spark, d):
    """Three events an hour per user."""
    calls = load(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"))
    return ST.limit_rate(calls, "user_id", "now", ["now", "event_id"], 3, 3600.0)


@query("""
WITH RECURSIVE drawn AS (
    SELECT s_suppkey AS id, 0 AS attempt, (CAST(s_suppkey AS HUGEINT) * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 AS state FROM supplier
    UNION ALL SELECT id, attempt + 1, (state * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM drawn WHERE attempt < 7
),
plan AS (SELECT id, attempt, least(30.0, 0.5 * pow(2.0, attempt)) * CAST(state // 2048 AS DOUBLE) / 9007199254740992.0 AS delay FROM drawn)
SELECT id, attempt, delay FROM (SELECT *, sum(delay) OVER (PARTITION BY id ORDER BY attempt) AS elapsed FROM plan) WHERE elapsed <= 60.0
""")
def backoff_plan(spark, d):
    """A retry plan per supplier."""
    s = load(spark, d, "supplier")
    return ST.backoff_plans(s.select(F.col("s_suppkey").alias("id"), F.lit(0.5).alias("base"), F.lit(2.0).alias("factor"), F.lit(30.0).alias("max_delay"), F.lit(60.0).alias("max_elapsed"), F.lit(8).alias("max_attempts"), F.col("s_suppkey").alias("seed")))


@query("""
SELECT o_custkey AS graph, CAST(o_orderkey AS VARCHAR) AS node, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, false AS cyclic
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
""")
def topo_sort(spark, d):
    """A customer's orders, each after the one before: graphs whose order is known. Names sort as numbers by padding."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    edges = load(spark, d, "orders").select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").cast("string").alias("src"), F.lead("o_orderkey").over(w).cast("string").alias("dst"))
    return ST.sort_graphs(edges.where("dst is not null"))


@query("SELECT p_partkey, CAST(0 AS INTEGER) AS record, CAST(i AS INTEGER) AS field, [p_name || ', \"new\"', p_brand, p_type][i + 1] AS value FROM part, range(3) t(i)")
def csv_parse(spark, d):
    """Parts written as CSV records and parsed again."""
    spark.udtf.register("parse_csv", ParseCsv)
    text = F.concat(F.lit('"'), F.replace(F.concat("p_name", F.lit(', "new"')), F.lit('"'), F.lit('""')), F.lit('",'), "p_brand", F.lit(","), "p_type", F.lit("\r\n"))
    load(spark, d, "part").select("p_partkey", text.alias("text")).createOrReplaceTempView("__csv_texts")
    return spark.sql("SELECT p_partkey, c.record, c.field, c.value FROM __csv_texts, LATERAL parse_csv(text) c")


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(trunc((p_partkey * 3 - 100) / CAST(p_size % 7 AS DOUBLE)) AS BIGINT) END AS value, CASE WHEN p_size % 7 = 0 THEN 'division by zero' END AS error FROM part")
def rpn_calc(spark, d):
    tokens = F.array(F.col("p_partkey").cast("string"), F.lit("3"), F.lit("*"), F.lit("100"), F.lit("-"), (F.col("p_size") % 7).cast("string"), F.lit("/"))
    return load(spark, d, "part").select("p_partkey", ST.evaluate_rpn(tokens).alias("r")).select("p_partkey", "r.value", "r.error")


@query("SELECT event_id, 'x y' AS a, CAST(user_id AS VARCHAR) AS b, event_type || '=1' AS c FROM events")
def query_string(spark, d):
    text = F.concat(F.lit("?a="), "event_type", F.lit("&&b="), F.col("user_id").cast("string"), F.lit("&c="), "event_type", F.lit("=1&a=x%20y"))
    m = S.query_string(text)
    return load(spark, d, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


@query("SELECT p_partkey, p_brand || '!' AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def parse_fields(spark, d):
    text = F.concat(F.lit("brand: old\n\n size :"), F.col("p_size").cast("string"), F.lit(" \nbrand: "), "p_brand", F.lit("!"))
    return load(spark, d, "part").select("p_partkey", S.parse_fields(text).alias("m")).select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size"))


@query("SELECT p_partkey, repeat('a', p_size) || 'bb' || p_brand AS text, CAST(p_size AS VARCHAR) || 'a2b' AS head FROM part")
def rle_round_trip(spark, d):
    """Texts encoded and decoded again; of the code the part that is known."""
    text = F.concat(F.expr("repeat('a', p_size)"), F.lit("bb"), "p_brand")
    coded = load(spark, d, "part").select("p_partkey", "p_size", S.rle_encode(F.regexp_replace(text, "[0-9]", "~")).alias("code"), text.alias("text"))
    head = F.substr("code", F.lit(1), F.length(F.col("p_size").cast("string")) + 3)
    good = S.rle_decode(F.col("code")) == F.regexp_replace("text", "[0-9]", "~")
    return coded.select("p_partkey", F.when(good, F.col("text")).alias("text"), head.alias("head"))


@query("""
SELECT c_custkey, 10 + CAST(CAST(('0x' || substr(sha256(c_custkey || ':size'), 1, 16)) AS UBIGINT) % 91 AS BIGINT) AS drawn FROM customer
""")
def counter_prng(spark, d):
    return load(spark, d, "customer").select("c_custkey", D.draw(F.col("c_custkey"), "size", 10, 100).alias("drawn"))


@query("""
SELECT o_custkey, sha256('[' || string_agg(entry, ',' ORDER BY o_orderpriority, entry) || ']') AS sha256 FROM (
    SELECT o_custkey, o_orderpriority, '{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS entry FROM orders
) GROUP BY ALL
""")
def fingerprint_sha256(spark, d):
    entry = F.concat(F.lit('{"priority":"'), "o_orderpriority", F.lit('","status":"'), "o_orderstatus", F.lit('"}'))
    return T.fingerprint(load(spark, d, "orders").withColumn("entry", entry), "o_orderpriority", "entry", ("o_custkey",))


@query("""
SELECT n_regionkey, sha256(encode('nations') || '\\x00'::BLOB || CAST(string_agg(frame, '' ORDER BY n_nationkey) AS BLOB)) AS digest FROM (
    SELECT n_regionkey, n_nationkey, repeat('\\x00', 7) || '\\x' || printf('%02x', length(n_name)) || n_name AS frame FROM nation
) GROUP BY ALL
""")
def framed_digest(spark, d):
    frames = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", D.framed(F.col("n_name")).alias("f")))), lambda x: x["f"])
    return load(spark, d, "nation").groupBy("n_regionkey").agg(D.framed_digest("nations", frames).alias("digest"))


@query("SELECT l_returnflag, round(sum(CASE WHEN l_quantity > 25 THEN l_discount ELSE 0 END) / count(*) FILTER (l_quantity > 25), 9) AS mean FROM lineitem GROUP BY ALL")
def masked_mean(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(S.masked_mean(F.col("l_discount"), F.col("l_quantity") > 25), 9).alias("mean"))


@query("""
SELECT r_name, n_name, count(*) AS customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def rollup_balances(spark, d):
    """Grouping sets over a star join: totals by region and nation."""
    rows = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cents"))


@query("""
SELECT c_mktsegment, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(rn AS INTEGER) AS place FROM (
    SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders JOIN customer ON c_custkey = o_custkey
) WHERE rn <= 5
""")
def top_orders(spark, d):
    """The five largest orders of each segment: a bounded list is kept while rows are read."""
    rows = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return rows.withColumn("place", place).where("place <= 5").select("c_mktsegment", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "place")


@query("""
SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND (p.ts, p.event_id) < (e.ts, e.event_id)
    AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'view' AND (q.ts, q.event_id) < (e.ts, e.event_id))) AS view_id
FROM events e WHERE e.event_type = 'purchase'
""")
def last_view(spark, d):
    """Each purchase with the user's last view before it, by one window instead of a range join."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = load(spark, d, "events").where("event_type in ('view', 'purchase')")
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", "view_id")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS offered FROM events
""")
def offered_events(spark, d):
    """Events of a user within the hour up to each: offered ones, not those a limiter admits."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return load(spark, d, "events").select("event_id", F.count("*").over(w).alias("offered"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def sql() -> dict[str, str]:
    return {name: s for name, (_, s) in _ALL.items() if s}
