"""Adapters: the driver's star-schema tables as preference relations. All are lazy projections and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Relations:
    """The relations of one data folder. Every property is a new lazy DataFrame."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @property
    def users(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 2).cast("int").alias("gender"), F.col("c_nationkey").alias("locale"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))

    @property
    def items(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))

    @property
    def purchases(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("poster"), F.col("l_quantity").alias("quantity"), (F.col("l_returnflag") == "R").cast("int").alias("liked"), F.col("l_shipdate").alias("shipped"))

    @property
    def ratings(self) -> DataFrame:
        """One row for each (user, item); a like wins over dislikes."""
        return self.purchases.groupBy("user_id", "item_id").agg(F.max("liked").alias("label"), F.max("quantity").alias("quantity"), F.max("shipped").alias("shipped"), F.min("poster").alias("poster"))

    @property
    def likes(self) -> DataFrame:
        return self.purchases.where("liked = 1").select("user_id", "item_id").distinct()

    @property
    def friends(self) -> DataFrame:
        """Users of the same locale and segment, in both directions."""
        u = self.users.select("user_id", "locale", "segment")
        return u.select(F.col("user_id").alias("ego"), "locale", "segment").join(u.select(F.col("user_id").alias("alter"), "locale", "segment"), ["locale", "segment"]).where("ego <> alter").select("ego", "alter")

    @property
    def circles(self) -> DataFrame:
        """user_id, circle: any two users of one circle are friends, so that nothing need list the pairs."""
        return self.users.where("locale is not null and segment is not null").select("user_id", F.struct("locale", "segment").alias("circle"))

    @property
    def events(self) -> DataFrame:
        return self.raw("events").select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("item_id"), "value")

    @property
    def contacts(self) -> DataFrame:
        """Directed contacts: who came to an item reaches whoever came to it first (ties: least user). target, actor, kind."""
        e = self.events
        first = e.groupBy("kind", "item_id").agg(F.min(F.struct("ts", "user_id")).alias("f")).select("kind", "item_id", F.col("f.user_id").alias("target"))
        return e.join(first, ["kind", "item_id"]).where("user_id <> target").select("target", F.col("user_id").alias("actor"), "kind", "item_id")

    @property
    def groups(self) -> DataFrame:
        return self.purchases.select("user_id", "item_id").join(self.items.select("item_id", "brand"), "item_id").select("user_id", F.col("brand").alias("group_id")).distinct()

    @property
    def pages(self) -> DataFrame:
        return self.purchases.select("user_id", "item_id").join(self.items.select("item_id", "kind"), "item_id").select("user_id", F.col("kind").alias("group_id")).distinct()

    @property
    def interests(self) -> DataFrame:
        """interest, user_id, group_id: what the items that a user bought have in common, by five attributes."""
        at = self.purchases.select("user_id", "item_id", "poster").join(self.raw("part").select(F.col("p_partkey").alias("item_id"), "p_brand", "p_type", "p_size", "p_name"), "item_id")
        held = F.array(*[F.struct(F.lit(i).alias("interest"), F.col(c).cast("string").alias("group_id")) for i, c in (("BRAND", "p_brand"), ("KIND", "p_type"), ("SIZE", "p_size"), ("NAME", "p_name"), ("POSTER", "poster"))])
        return at.select("user_id", F.explode(held).alias("h")).select("h.interest", "user_id", "h.group_id").where("group_id is not null").distinct()

    @property
    def messages(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", "turn", "role", "text")


#: The same relations as DuckDB common table expressions.
SQL = {
    "users": "users AS (SELECT c_custkey AS user_id, CAST(c_custkey % 2 AS INTEGER) AS gender, c_nationkey AS locale, c_mktsegment AS segment, c_acctbal AS balance FROM customer)",
    "items": "items AS (SELECT p_partkey AS item_id, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price FROM part)",
    "purchases": "purchases AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_suppkey AS poster, l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS liked, l_shipdate AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "ratings": "ratings AS (SELECT user_id, item_id, MAX(liked) AS label, MAX(quantity) AS quantity, MAX(shipped) AS shipped, MIN(poster) AS poster FROM purchases GROUP BY 1, 2)",
    "likes": "likes AS (SELECT DISTINCT user_id, item_id FROM purchases WHERE liked = 1)",
    "friends": "friends AS (SELECT a.user_id AS ego, b.user_id AS alter_id FROM users a JOIN users b ON a.locale = b.locale AND a.segment = b.segment AND a.user_id <> b.user_id)",
    "ev": "ev AS (SELECT event_id, ts, user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, value FROM events)",
    "contacts": "contacts AS (SELECT f.target, e.user_id AS actor, e.kind, e.item_id FROM ev e JOIN (SELECT kind, item_id, arg_min(user_id, (ts, user_id)) AS target FROM ev GROUP BY 1, 2) f ON e.kind = f.kind AND e.item_id = f.item_id WHERE e.user_id <> f.target)",
    "grp": "grp AS (SELECT DISTINCT user_id, brand AS group_id FROM purchases JOIN items USING (item_id))",
    "interests": "interests AS (SELECT DISTINCT interest, user_id, group_id FROM (SELECT user_id, UNNEST(['BRAND', 'KIND', 'SIZE', 'NAME', 'POSTER']) AS interest, UNNEST([p_brand, p_type, CAST(p_size AS VARCHAR), p_name, CAST(poster AS VARCHAR)]) AS group_id FROM purchases JOIN part ON item_id = p_partkey) x WHERE group_id IS NOT NULL)",
    "pg": "pg AS (SELECT DISTINCT user_id, items.kind AS group_id FROM purchases JOIN items USING (item_id))",
}
NEEDS = {"ratings": ["purchases"], "likes": ["purchases"], "friends": ["users"], "contacts": ["ev"], "grp": ["purchases", "items"], "interests": ["purchases"], "pg": ["purchases", "items"]}


def with_relations(sql: str, *names: str, recursive: bool = False) -> str:
    """sql behind the named relations and what they need. sql may begin with further expressions and a comma: `x AS (...) SELECT`."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    sql = sql.strip()
    more = not sql.upper().startswith("SELECT")
    if not order and not more:
        return sql
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(SQL[n] for n in order)}{', ' * (more and bool(order))}{' ' * (not more)}{sql}"
