"""Queries over the driver's tables, one or more for each part of the language, with their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.plans.collection import Collection, Database
from docmill.sources.documents import dynamic

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name; each is read where it is first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def df(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> Collection:
        if name not in TABLES:
            raise AttributeError(name)
        return Collection(self.df(name), _Lazy(self))


class _Lazy(dict):
    def __init__(self, tables: Tables):
        self._tables = tables

    def __contains__(self, name: object) -> bool:
        return name in TABLES

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables.df(name)


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- filters ---


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 24")
def match_cmp(t):
    return t.lineitem.aggregate([{"$match": {"l_quantity": {"$gte": 10, "$lt": 24}}}, {"$count": "n"}])


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_type NOT IN ('STANDARD', 'ECONOMY')")
def match_in_nin(t):
    return t.part.find({"p_brand": {"$in": ["Brand#11", "Brand#12", "Brand#23"]}, "p_type": {"$nin": ["STANDARD", "ECONOMY"]}}, {"_id": 0, "p_partkey": 1, "p_brand": 1, "p_type": 1})


@query(
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE (o_totalprice > 100000 OR o_orderstatus = 'F') AND NOT (o_orderpriority = '1-URGENT') AND NOT (o_totalprice > 400000) GROUP BY 1"
)
def match_logic(t):
    return t.orders.aggregate(
        [
            {"$match": {"$or": [{"o_totalprice": {"$gt": 100000}}, {"o_orderstatus": "F"}], "$nor": [{"o_orderpriority": "1-URGENT"}], "o_totalprice": {"$not": {"$gt": 400000}}}},
            {"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}},
            {"$project": {"_id": 0, "o_orderstatus": "$_id", "n": 1}},
        ]
    )


@query("SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1")
def match_missing_ne(t):
    return t.documents.aggregate(
        [
            {"$project": {"doc_id": 1}},
            {"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "label"}},
            {"$unwind": {"path": "$label", "preserveNullAndEmptyArrays": True}},
            {"$match": {"label.quality": {"$ne": 1}}},
            {"$count": "n"},
        ]
    )


@query("SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def match_exists(t):
    return t.documents.aggregate(
        [
            {"$project": {"doc_id": 1}},
            {"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "label"}},
            {"$unwind": {"path": "$label", "preserveNullAndEmptyArrays": True}},
            {"$match": {"label.quality": {"$exists": False}}},
            {"$count": "n"},
        ]
    )


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 7 = 3 OR (p_size & 5) = 5")
def match_mod_bits(t):
    return t.part.find({"$or": [{"p_size": {"$mod": [7, 3]}}, {"p_size": {"$bitsAllSet": 5}}]}, {"p_partkey": 1, "p_size": 1})


@query("SELECT p_size, (p_size & 3) <> 0 AS any_set, (p_size & 12) = 0 AS all_clear, count(*) AS n FROM part WHERE (p_size & 16) <> 16 GROUP BY 1, 2, 3")
def match_bits(t):
    any_set = t.part.find({"p_size": {"$bitsAnyClear": 16}})
    marked = Collection(any_set).aggregate([{"$set": {"one": 1}}])
    hit = Collection(marked).find({"p_size": {"$bitsAnySet": [0, 1]}}).select("p_partkey", F.lit(True).alias("any_set"))
    clear = Collection(marked).find({"p_size": {"$bitsAllClear": 12}}).select("p_partkey", F.lit(True).alias("all_clear"))
    both = marked.join(hit, "p_partkey", "left").join(clear, "p_partkey", "left").fillna(False, ["any_set", "all_clear"])
    return both.groupBy("p_size", "any_set", "all_clear").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'part.*7', 'i')")
def match_regex(t):
    return t.part.find({"p_name": {"$regex": "PART.*7", "$options": "i"}}, {"p_partkey": 1, "p_name": 1})


@query("SELECT count(*) AS n FROM lineitem WHERE l_extendedprice > l_quantity * 1000")
def match_expr(t):
    return t.lineitem.aggregate([{"$match": {"$expr": {"$gt": ["$l_extendedprice", {"$multiply": ["$l_quantity", 1000]}]}}}, {"$count": "n"}])


@query(
    "WITH g AS (SELECT l_orderkey, list({'q': l_quantity, 'f': l_returnflag}) AS ls, list(l_linenumber) AS ns FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey FROM g WHERE len(list_filter(ls, lambda x: x.q > 45 AND x.f = 'R')) > 0 AND len(list_filter(ns, lambda x: x = 1)) > 0 AND len(list_filter(ns, lambda x: x = 2)) > 0 AND len(ns) = 4"
)
def match_array(t):
    return t.lineitem.aggregate(
        [
            {"$group": {"_id": "$l_orderkey", "ls": {"$push": {"q": "$l_quantity", "f": "$l_returnflag"}}, "ns": {"$push": "$l_linenumber"}}},
            {"$match": {"ls": {"$elemMatch": {"q": {"$gt": 45}, "f": "R"}}, "ns": {"$all": [1, 2], "$size": 4}}},
            {"$project": {"_id": 0, "l_orderkey": "$_id"}},
        ]
    )


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def match_date(t):
    return t.orders.count({"o_orderdate": {"$gte": dt.datetime(1997, 1, 1, tzinfo=dt.timezone.utc), "$lt": dt.datetime(1998, 1, 1, tzinfo=dt.timezone.utc)}})


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice >= 1000 AND length(o_orderstatus) <= 1 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def match_json_schema(t):
    schema = {"bsonType": "object", "required": ["o_orderkey"], "properties": {"o_totalprice": {"bsonType": "double", "minimum": 1000}, "o_orderstatus": {"bsonType": "string", "maxLength": 1}, "o_orderpriority": {"enum": ["1-URGENT", "2-HIGH"]}}}
    return t.orders.count({"$jsonSchema": schema})


@query("SELECT count(*) AS n FROM part")
def match_type(t):
    return t.part.count({"p_size": {"$type": "number"}, "p_name": {"$type": ["string", 10]}, "p_retailprice": {"$not": {"$type": "int"}}})


# --- shaping ---


@query("SELECT o_orderkey, o_totalprice, round(o_totalprice * 1.1, 6) AS with_tax, o_orderstatus AS status FROM orders")
def project_incl_excl(t):
    return t.orders.aggregate(
        [
            {"$project": {"o_orderkey": 1, "o_totalprice": 1, "with_tax": {"$round": [{"$multiply": ["$o_totalprice", 1.1]}, 6]}, "status": "$o_orderstatus", "o_orderdate": "$o_orderdate"}},
            {"$project": {"o_orderdate": 0}},
        ]
    )


@query("SELECT s_suppkey, s_nationkey + 100 AS s_nationkey, s_acctbal > 0 AS good, upper(s_name) AS s_name FROM supplier")
def add_set_unset(t):
    return t.supplier.aggregate(
        [
            {"$addFields": {"extra": {"a": 1, "b": 2}, "good": {"$gt": ["$s_acctbal", 0]}}},
            {"$set": {"s_nationkey": {"$add": ["$s_nationkey", 100]}, "s_name": {"$toUpper": "$s_name"}}},
            {"$unset": ["s_acctbal", "extra.a"]}, {"$unset": "extra"},
        ]
    )


@query("SELECT o_orderstatus AS status, max(o_totalprice) AS top, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def replace_root(t):
    return t.orders.aggregate(
        [
            {"$group": {"_id": "$o_orderstatus", "top": {"$max": "$o_totalprice"}, "n": {"$sum": 1}}},
            {"$project": {"doc": {"status": "$_id", "top": "$top", "n": "$n"}}},
            {"$replaceRoot": {"newRoot": "$doc"}},
        ]
    )


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier WHERE s_nationkey < 20")
def redact_levels(t):
    return t.supplier.aggregate(
        [
            {"$project": {"s_suppkey": 1, "level": "$s_nationkey", "money": {"balance": "$s_acctbal", "level": {"$cond": [{"$gt": ["$s_acctbal", 0]}, 0, 99]}}}},
            {"$redact": {"$cond": [{"$gte": ["$level", 20]}, "$$PRUNE", "$$DESCEND"]}},
            {"$project": {"s_suppkey": 1, "balance": "$money.balance"}},
        ]
    )


_PUSHED = [{"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}]


@query("SELECT o_custkey AS _id, o_orderkey AS keys FROM orders")
def unwind_plain(t):
    return t.orders.aggregate([*_PUSHED, {"$unwind": "$keys"}])


@query("SELECT vec_id, i - 1 AS i, CAST(e AS DOUBLE) AS embedding FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def unwind_index(t):
    return t.embeddings.aggregate(
        [
            {"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}},
            {"$project": {"vec_id": 1, "i": 1, "embedding": {"$toDouble": "$embedding"}}},
        ]
    )


@query("SELECT c_custkey, o_orderkey AS orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def unwind_outer(t):
    big = t.orders.find({"o_totalprice": {"$gt": 300000}})
    return t.customer.aggregate(
        [
            {"$project": {"c_custkey": 1}},
            {"$lookup": {"from": big, "localField": "c_custkey", "foreignField": "o_custkey", "as": "found"}},
            {"$project": {"c_custkey": 1, "orders": {"$map": {"input": "$found", "as": "o", "in": "$$o.o_orderkey"}}}},
            {"$unwind": {"path": "$orders", "preserveNullAndEmptyArrays": True}},
        ]
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 10 LIMIT 25")
def sort_skip_limit(t):
    return t.orders.find({}, {"o_orderkey": 1, "o_totalprice": 1}, sort={"o_totalprice": -1, "o_orderkey": 1}, skip=10, limit=25)


@query()
def sample_rows(t):
    return t.orders.aggregate([{"$sample": {"size": 50}}])


# --- groups ---


@query(
    "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 GROUP BY 1, 2"
)
def group_basic(t):
    return t.lineitem.aggregate(
        [
            {"$match": {"l_quantity": {"$lt": 24}, "l_discount": {"$gte": 0.05}}},
            {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "price": {"$avg": "$l_extendedprice"}, "n": {"$sum": 1}}},
            {"$set": {"qty": {"$round": ["$qty", 2]}, "price": {"$round": ["$price", 2]}}},
            {"$sort": {"flag": 1, "status": 1}},
        ],
        flatten_id=True,
    )


@query("SELECT round(sum(o_totalprice), 0) AS total, count(*) AS n FROM orders")
def group_const(t):
    return t.orders.aggregate([{"$group": {"_id": None, "total": {"$sum": "$o_totalprice"}, "n": {"$count": {}}}}, {"$project": {"_id": 0, "total": {"$round": ["$total", 0]}, "n": 1}}])


@query(
    "SELECT l_returnflag AS _id, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss FROM lineitem GROUP BY 1"
)
def group_stats(t):
    return t.lineitem.aggregate(
        [
            {"$group": {"_id": "$l_returnflag", "a": {"$avg": "$l_discount"}, "lo": {"$min": "$l_shipdate"}, "hi": {"$max": "$l_extendedprice"}, "sp": {"$stdDevPop": "$l_quantity"}, "ss": {"$stdDevSamp": "$l_quantity"}}},
            {"$set": {"a": {"$round": ["$a", 6]}, "sp": {"$round": ["$sp", 6]}, "ss": {"$round": ["$ss", 6]}}},
        ]
    )


@query("SELECT user_id AS _id, arg_min(event_type, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY 1")
def group_first_last(t):
    return t.events.aggregate([{"$sort": {"ts": 1}}, {"$group": {"_id": "$user_id", "first": {"$first": "$event_type"}, "last": {"$last": "$value"}}}])


@query(
    "SELECT user_id AS _id, list(event_id ORDER BY ts DESC)[1:3] AS top, list(event_id ORDER BY ts DESC)[-2:] AS bottom, list(event_id ORDER BY ts)[1:2] AS first2, list_sort(list(event_id), 'DESC')[1:3] AS max3, list_sort(list(event_id))[1:3] AS min3, arg_max(event_id, ts) AS t1 FROM events GROUP BY 1"
)
def group_topn(t):
    return t.events.aggregate(
        [
            {"$sort": {"ts": 1}},
            {
                "$group": {
                    "_id": "$user_id",
                    "top": {"$topN": {"sortBy": {"ts": -1}, "output": "$event_id", "n": 3}},
                    "bottom": {"$bottomN": {"sortBy": {"ts": -1}, "output": "$event_id", "n": 2}},
                    "first2": {"$firstN": {"input": "$event_id", "n": 2}},
                    "max3": {"$maxN": {"input": "$event_id", "n": 3}},
                    "min3": {"$minN": {"input": "$event_id", "n": 3}},
                    "t1": {"$top": {"sortBy": {"ts": -1}, "output": "$event_id"}},
                }
            },
        ]
    )


@query("SELECT o_orderpriority AS _id, count(*) AS pushed, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1")
def group_push_set(t):
    return t.orders.aggregate(
        [
            {"$group": {"_id": "$o_orderpriority", "all": {"$push": "$o_orderkey"}, "set": {"$addToSet": "$o_orderstatus"}}},
            {"$project": {"pushed": {"$toLong": {"$size": "$all"}}, "kinds": {"$toLong": {"$size": "$set"}}}},
        ]
    )


@query("SELECT p_brand AS _id, round(quantile_cont(p_retailprice, 0.5), 4) AS med, round(quantile_cont(p_retailprice, 0.9), 4) AS p90 FROM part GROUP BY 1")
def group_percentile(t):
    return t.part.aggregate(
        [
            {"$group": {"_id": "$p_brand", "m": {"$median": {"input": "$p_retailprice", "method": "exact"}}, "p": {"$percentile": {"input": "$p_retailprice", "p": [0.5, 0.9], "method": "exact"}}}},
            {"$project": {"med": {"$round": ["$m", 4]}, "p90": {"$round": [{"$arrayElemAt": ["$p", 1]}, 4]}}},
        ]
    )


@query("SELECT user_id AS _id, arg_max(event_type, ts) AS kind, arg_max(value, ts) AS value FROM events GROUP BY 1")
def group_merge_objects(t):
    return t.events.aggregate(
        [
            {"$sort": {"ts": 1}},
            {"$group": {"_id": "$user_id", "doc": {"$mergeObjects": {"kind": "$event_type", "value": "$value"}}}},
            {"$project": {"kind": "$doc.kind", "value": "$doc.value"}},
        ]
    )


@query("SELECT p_brand AS _id, count(*) AS count FROM part GROUP BY 1")
def sort_by_count(t):
    return t.part.aggregate([{"$sortByCount": "$p_brand"}])


@query("SELECT CASE WHEN p_size < 10 THEN 1 WHEN p_size < 25 THEN 10 WHEN p_size < 40 THEN 25 ELSE -1 END AS _id, count(*) AS n, max(p_retailprice) AS hi FROM part WHERE p_size >= 1 GROUP BY 1")
def bucket(t):
    return t.part.aggregate([{"$bucket": {"groupBy": "$p_size", "boundaries": [1, 10, 25, 40], "default": -1, "output": {"n": {"$sum": 1}, "hi": {"$max": "$p_retailprice"}}}}])


@query(
    "WITH c AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1), b AS (SELECT v, n, CAST(floor((sum(n) OVER (ORDER BY v) - n) * 4.0 / (SELECT sum(n) FROM c)) AS INT) AS k FROM c) "
    "SELECT min(v) AS lo, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY k"
)
def bucket_auto(t):
    return t.part.aggregate([{"$bucketAuto": {"groupBy": "$p_size", "buckets": 4, "output": {"n": {"$sum": 1}}}}, {"$project": {"_id": 0, "lo": "$_id.min", "n": 1}}])


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT p_brand FROM part)) AS brands, (SELECT count(*) FROM part WHERE p_size > 40) AS large")
def facet(t):
    return t.part.aggregate(
        [
            {"$facet": {"brands": [{"$group": {"_id": "$p_brand"}}], "large": [{"$match": {"p_size": {"$gt": 40}}}, {"$count": "n"}]}},
            {"$project": {"brands": {"$toLong": {"$size": "$brands"}}, "large": {"$arrayElemAt": ["$large.n", 0]}}},
        ]
    )


@query("SELECT count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' LIMIT 1000)")
def count_cmd(t):
    return t.orders.count({"o_orderstatus": "O"}, limit=1000)


@query("SELECT DISTINCT o_orderpriority AS value FROM orders")
def distinct_cmd(t):
    return t.orders.distinct("o_orderpriority")


# --- joins ---


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def lookup_array(t):
    return t.customer.aggregate(
        [
            {"$project": {"c_custkey": 1}},
            {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}},
            {"$project": {"c_custkey": 1, "n": {"$toLong": {"$size": "$orders"}}}},
        ]
    )


@query("SELECT n_name, round(sum(o_totalprice), 0) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def lookup_unwind(t):
    return t.orders.aggregate(
        [
            {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}},
            {"$unwind": "$c"},
            {"$lookup": {"from": "nation", "localField": "c.c_nationkey", "foreignField": "n_nationkey", "as": "n"}},
            {"$unwind": "$n"},
            {"$group": {"_id": "$n.n_name", "total": {"$sum": "$o_totalprice"}}},
            {"$project": {"_id": 0, "n_name": "$_id", "total": {"$round": ["$total", 0]}}},
        ]
    )


@query("SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 100 GROUP BY 1")
def lookup_pipeline(t):
    return t.nation.aggregate(
        [
            {
                "$lookup": {
                    "from": "supplier",
                    "let": {"k": "$n_nationkey", "least": {"$multiply": ["$n_nationkey", 100]}},
                    "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$s_nationkey", "$$k"]}, {"$gt": ["$s_acctbal", "$$least"]}]}}}, {"$project": {"s_suppkey": 1}}],
                    "as": "rich",
                }
            },
            {"$project": {"n_nationkey": 1, "n": {"$toLong": {"$size": "$rich"}}}},
        ]
    )


@query("SELECT n_regionkey, list_sort(list(r_name)) AS names FROM nation JOIN region ON r_regionkey IN (n_regionkey, 0) GROUP BY n_nationkey, n_regionkey")
def lookup_local_array(t):
    return t.nation.aggregate(
        [
            {"$project": {"n_regionkey": 1, "both": ["$n_regionkey", 0]}},
            {"$lookup": {"from": "region", "localField": "both", "foreignField": "r_regionkey", "as": "r"}},
            {"$project": {"n_regionkey": 1, "names": {"$sortArray": {"input": "$r.r_name", "sortBy": 1}}}},
        ]
    )


@query("SELECT doc_id, source FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def lookup_semi(t):
    return t.documents.aggregate(
        [
            {"$project": {"doc_id": 1, "source": 1}},
            {"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "l"}},
            {"$match": {"l": {"$ne": []}}},
            {"$unset": "l"},
        ]
    )


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def lookup_anti(t):
    return t.documents.aggregate(
        [
            {"$project": {"doc_id": 1, "source": 1}},
            {"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "l"}},
            {"$match": {"l": []}},
            {"$project": {"l": 0}},
        ]
    )


@query("SELECT n_nationkey, r_name AS reached, CAST(0 AS BIGINT) AS depth FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_lookup(t):
    return t.nation.aggregate(
        [
            {"$graphLookup": {"from": "region", "startWith": "$n_regionkey", "connectFromField": "r_regionkey", "connectToField": "r_regionkey", "as": "path", "depthField": "depth", "maxDepth": 3}},
            {"$unwind": "$path"},
            {"$project": {"n_nationkey": 1, "reached": "$path.r_name", "depth": "$path.depth"}},
        ]
    )


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier WHERE s_acctbal > 0")
def union_with(t):
    return t.customer.aggregate(
        [
            {"$project": {"name": "$c_name"}},
            {"$unionWith": {"coll": "supplier", "pipeline": [{"$match": {"s_acctbal": {"$gt": 0}}}, {"$project": {"name": "$s_name"}}]}},
        ]
    )


# --- windows ---


@query(
    "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)"
)
def win_rank(t):
    return t.orders.aggregate(
        [
            {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderstatus": 1}, "output": {"r": {"$rank": {}}, "d": {"$denseRank": {}}}}},
            {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": {"n": {"$documentNumber": {}}}}},
            {"$project": {"o_orderkey": 1, "r": 1, "d": 1, "n": 1}},
        ]
    )


@query("SELECT event_id, lag(event_id, 1, -1) OVER w AS before, lead(event_id, 1) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def win_shift(t):
    return t.events.aggregate(
        [
            {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {"before": {"$shift": {"output": "$event_id", "by": -1, "default": -1}}, "after": {"$shift": {"output": "$event_id", "by": 1}}}}},
            {"$project": {"event_id": 1, "before": 1, "after": 1}},
        ]
    )


@query("SELECT event_id, round(sum(value) OVER w, 4) AS total, min(value) OVER w AS lo, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def win_frame_rows(t):
    frame = {"documents": [-3, "current"]}
    return t.events.aggregate(
        [
            {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {"total": {"$sum": "$value", "window": frame}, "lo": {"$min": "$value", "window": frame}, "n": {"$count": {}, "window": frame}}}},
            {"$project": {"event_id": 1, "total": {"$round": ["$total", 4]}, "lo": 1, "n": 1}},
        ]
    )


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW), 4) AS hour FROM events")
def win_frame_range(t):
    return t.events.aggregate(
        [
            {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {"hour": {"$sum": "$value", "window": {"range": [-1, "current"], "unit": "hour"}}}}},
            {"$project": {"event_id": 1, "hour": {"$round": ["$hour", 4]}}},
        ]
    )


@query(
    "SELECT event_id, round(covar_pop(value, user_id) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS cov, "
    "round((value - first_value(value) OVER w) / nullif((epoch_us(ts) // 1000 - epoch_us(first_value(ts) OVER w) // 1000) / 3600000.0, 0), 8) AS rate, "
    "(value + lag(value) OVER o) / 2 * (epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER o) // 1000) / 3600000.0 AS area FROM events "
    "WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), o AS (PARTITION BY event_type ORDER BY ts)"
)
def win_cov_deriv_integral(t):
    two = {"documents": [-1, "current"]}
    out = t.events.aggregate(
        [
            {
                "$setWindowFields": {
                    "partitionBy": "$event_type",
                    "sortBy": {"ts": 1},
                    "output": {
                        "cov": {"$covariancePop": ["$value", "$user_id"], "window": {"documents": [-9, "current"]}},
                        "rate": {"$derivative": {"input": "$value", "unit": "hour"}, "window": two},
                        "area": {"$integral": {"input": "$value", "unit": "hour"}, "window": two},
                        "seen": {"$count": {}, "window": two},
                    },
                }
            },
            {"$project": {"event_id": 1, "cov": {"$round": ["$cov", 8]}, "rate": {"$round": ["$rate", 8]}, "area": {"$cond": [{"$gt": ["$seen", 1]}, "$area", None]}}},
        ]
    )
    return out


@query("SELECT event_id, list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), lambda s, v: v * 0.5 + s * 0.5) AS ema FROM events")
def win_ema(t):
    return t.events.aggregate(
        [
            {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1, "event_id": 1}, "output": {"ema": {"$expMovingAvg": {"input": "$value", "N": 3}}}}},
            {"$project": {"event_id": 1, "ema": 1}},
        ]
    )


_HOURS = [{"$project": {"hour": {"$dateTrunc": {"date": "$ts", "unit": "hour"}}, "value": 1}}, {"$group": {"_id": "$hour", "value": {"$max": "$value"}}}, {"$project": {"_id": 0, "hour": "$_id", "value": 1}}]


@query(
    "WITH h AS (SELECT date_trunc('hour', ts) AS hour, max(value) AS value FROM events WHERE user_id = 7 GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour) "
    "SELECT s.hour, h.value FROM s LEFT JOIN h USING (hour)"
)
def densify(t):
    return t.events.aggregate([{"$match": {"user_id": 7}}, *_HOURS, {"$densify": {"field": "hour", "range": {"step": 1, "unit": "hour", "bounds": "full"}}}])


@query(
    "WITH h AS (SELECT date_trunc('hour', ts) AS hour, max(value) AS value FROM events WHERE user_id = 7 GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour), "
    "j AS (SELECT s.hour, h.value FROM s LEFT JOIN h USING (hour)), k AS (SELECT hour, value, last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER f AS v1, "
    "last_value(CASE WHEN value IS NOT NULL THEN epoch_ms(hour) END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN value IS NOT NULL THEN epoch_ms(hour) END IGNORE NULLS) OVER f AS t1 FROM j "
    "WINDOW b AS (ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT hour, v0 AS carried, coalesce(value, v0 + (v1 - v0) * ((epoch_ms(hour) - t0) / nullif(t1 - t0, 0))) AS line FROM k"
)
def fill_locf_linear(t):
    return t.events.aggregate(
        [
            {"$match": {"user_id": 7}},
            *_HOURS,
            {"$densify": {"field": "hour", "range": {"step": 1, "unit": "hour", "bounds": "full"}}},
            {"$set": {"carried": "$value", "line": "$value"}},
            {"$fill": {"sortBy": {"hour": 1}, "output": {"carried": {"method": "locf"}, "line": {"method": "linear"}}}},
            {"$project": {"hour": 1, "carried": 1, "line": 1}},
        ]
    )


# --- expressions ---


@query(
    "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(exp(p_size / 50.0), 6) AS e, round(ln(p_size + 1), 6) AS l, round(log10(p_size + 1), 6) AS l10, "
    "round(power(p_size, 2), 2) AS p, round(sqrt(p_size), 6) AS s, p_size % 7 AS m, CAST(trunc(p_retailprice) AS BIGINT) AS t, round(p_retailprice / p_size, 7) AS d, round(ln(p_size + 1) / ln(2), 6) AS l2, CAST(p_size + 3 AS BIGINT) AS s3 FROM part"
)
def expr_math(t):
    r = lambda e, n=6: {"$round": [e, n]}
    return t.part.aggregate(
        [
            {
                "$project": {
                    "p_partkey": 1,
                    "a": {"$toInt": {"$abs": {"$subtract": ["$p_size", 25]}}},
                    "c": {"$ceil": "$p_retailprice"},
                    "f": {"$floor": "$p_retailprice"},
                    "e": r({"$exp": {"$divide": ["$p_size", 50]}}),
                    "l": r({"$ln": {"$add": ["$p_size", 1]}}),
                    "l10": r({"$log10": {"$add": ["$p_size", 1]}}),
                    "p": r({"$pow": ["$p_size", 2]}, 2),
                    "s": r({"$sqrt": "$p_size"}),
                    "m": {"$mod": ["$p_size", 7]},
                    "t": {"$trunc": "$p_retailprice"},
                    "d": r({"$divide": ["$p_retailprice", "$p_size"]}, 7),
                    "l2": r({"$log": [{"$add": ["$p_size", 1]}, 2]}),
                    "s3": {"$sum": ["$p_size", 3, "text", None]},
                }
            }
        ]
    )


@query(
    "SELECT p_partkey, "
    + ", ".join(
        f"round({sql}, 6) AS {n}"
        for n, sql in {
            "si": "sin(x)", "co": "cos(x)", "ta": "tan(x)", "asi": "asin(y)", "aco": "acos(y)", "ata": "atan(x)", "at2": "atan2(x, y)", "sh": "sinh(y)", "ch": "cosh(y)", "th": "tanh(y)", "ash": "asinh(x)", "ach": "acosh(x + 1)", "ath": "atanh(y / 2)", "rad": "radians(x)", "deg": "degrees(y)",
        }.items()
    )
    + " FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_size / 51.0 AS y FROM part)"
)
def expr_trig(t):
    r = lambda e: {"$round": [e, 6]}
    return t.part.aggregate(
        [
            {"$project": {"p_partkey": 1, "x": {"$toDouble": "$p_size"}, "y": {"$divide": ["$p_size", 51]}}},
            {
                "$project": {
                    "p_partkey": 1,
                    "si": r({"$sin": "$x"}),
                    "co": r({"$cos": "$x"}),
                    "ta": r({"$tan": "$x"}),
                    "asi": r({"$asin": "$y"}),
                    "aco": r({"$acos": "$y"}),
                    "ata": r({"$atan": "$x"}),
                    "at2": r({"$atan2": ["$x", "$y"]}),
                    "sh": r({"$sinh": "$y"}),
                    "ch": r({"$cosh": "$y"}),
                    "th": r({"$tanh": "$y"}),
                    "ash": r({"$asinh": "$x"}),
                    "ach": r({"$acosh": {"$add": ["$x", 1]}}),
                    "ath": r({"$atanh": {"$divide": ["$y", 2]}}),
                    "rad": r({"$degreesToRadians": "$x"}),
                    "deg": r({"$radiansToDegrees": "$y"}),
                }
            },
        ]
    )


@query(
    "SELECT p_partkey, p_name || '-' || p_brand AS c, lower(p_name) AS lo, upper(p_name) AS up, CAST(length(p_name) AS INT) AS n, CAST(strlen(p_name) AS INT) AS nb, substr(p_name, 2, 3) AS s, CAST(strpos(p_name, 'a') - 1 AS INT) AS i, "
    "replace(p_name, 'a', 'A') AS ra, string_split(p_brand, '#') AS sp, trim(p_name, 'P0') AS tr, regexp_matches(p_name, '[0-9]+') AS rm, regexp_extract(p_name, '[0-9]+') AS rf, CAST(len(regexp_extract_all(p_name, '[0-9]')) AS INT) AS rn, "
    "regexp_replace(p_name, 'a', 'X') AS ro, CASE WHEN lower(p_brand) < 'brand#3' THEN -1 WHEN lower(p_brand) > 'brand#3' THEN 1 ELSE 0 END AS cmp FROM part"
)
def expr_string(t):
    return t.part.aggregate(
        [
            {
                "$project": {
                    "p_partkey": 1,
                    "c": {"$concat": ["$p_name", "-", "$p_brand"]},
                    "lo": {"$toLower": "$p_name"},
                    "up": {"$toUpper": "$p_name"},
                    "n": {"$strLenCP": "$p_name"},
                    "nb": {"$strLenBytes": "$p_name"},
                    "s": {"$substrCP": ["$p_name", 1, 3]},
                    "i": {"$indexOfCP": ["$p_name", "a"]},
                    "ra": {"$replaceAll": {"input": "$p_name", "find": "a", "replacement": "A"}},
                    "sp": {"$split": ["$p_brand", "#"]},
                    "tr": {"$trim": {"input": "$p_name", "chars": "P0"}},
                    "rm": {"$regexMatch": {"input": "$p_name", "regex": "[0-9]+"}},
                    "rf": {"$getField": {"field": "match", "input": {"$regexFind": {"input": "$p_name", "regex": "[0-9]+"}}}},
                    "rn": {"$size": {"$regexFindAll": {"input": "$p_name", "regex": "[0-9]"}}},
                    "ro": {"$replaceOne": {"input": "$p_name", "find": "a", "replacement": "X"}},
                    "cmp": {"$strcasecmp": ["$p_brand", "BRAND#3"]},
                }
            },
            {"$set": {"rf": {"$ifNull": ["$rf", ""]}}},
        ]
    )


@query(
    "SELECT o_orderkey, CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m, CAST(day(d) AS INT) AS dom, CAST(dayofyear(d) AS INT) AS doy, CAST(dayofweek(d) + 1 AS INT) AS dow, CAST(isodow(d) AS INT) AS idow, CAST(weekofyear(d) AS INT) AS iw, CAST(isoyear(d) AS INT) AS iy, "
    "CAST(hour(d) AS INT) AS h, CAST(strftime(d, '%U') AS INT) AS w, strftime(d, '%Y-%m-%d') AS s, date_trunc('month', d) AS t, d + INTERVAL 3 DAY AS plus, d - INTERVAL 2 MONTH AS minus, CAST(date_diff('month', d, TIMESTAMP '2001-01-15') AS BIGINT) AS diff, "
    "make_timestamp(year(d), month(d), 1, 12, 30, 0) AS made, strptime(strftime(d, '%Y/%m/%d'), '%Y/%m/%d') AS parsed, CAST(epoch_ms(d) - epoch_ms(TIMESTAMP '1995-01-01') AS BIGINT) AS ms FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)"
)
def expr_date(t):
    d = "$o_orderdate"
    return t.orders.aggregate(
        [
            {
                "$project": {
                    "o_orderkey": 1,
                    "y": {"$year": d},
                    "m": {"$month": d},
                    "dom": {"$dayOfMonth": d},
                    "doy": {"$dayOfYear": d},
                    "dow": {"$dayOfWeek": d},
                    "idow": {"$isoDayOfWeek": d},
                    "iw": {"$isoWeek": d},
                    "iy": {"$isoWeekYear": d},
                    "h": {"$hour": d},
                    "w": {"$week": d},
                    "s": {"$dateToString": {"date": d, "format": "%Y-%m-%d"}},
                    "t": {"$dateTrunc": {"date": d, "unit": "month"}},
                    "plus": {"$dateAdd": {"startDate": d, "unit": "day", "amount": 3}},
                    "minus": {"$dateSubtract": {"startDate": d, "unit": "month", "amount": 2}},
                    "diff": {"$dateDiff": {"startDate": d, "endDate": dt.datetime(2001, 1, 15, tzinfo=dt.timezone.utc), "unit": "month"}},
                    "made": {"$dateFromParts": {"year": {"$year": d}, "month": {"$month": d}, "hour": 12, "minute": 30}},
                    "parsed": {"$dateFromString": {"dateString": {"$dateToString": {"date": d, "format": "%Y/%m/%d"}}, "format": "%Y/%m/%d"}},
                    "ms": {"$subtract": [d, dt.datetime(1995, 1, 1, tzinfo=dt.timezone.utc)]},
                }
            }
        ]
    )


_LINES = [{"$group": {"_id": "$l_orderkey", "q": {"$push": {"$toInt": "$l_quantity"}}}}, {"$set": {"q": {"$sortArray": {"input": "$q", "sortBy": 1}}}}]
_LINES_SQL = "WITH g AS (SELECT l_orderkey AS _id, list_sort(list(CAST(l_quantity AS INT))) AS q FROM lineitem GROUP BY 1) "


@query(
    _LINES_SQL
    + "SELECT _id, q[1] AS first, q[-1] AS last, q[2] AS second, CAST(len(q) AS INT) AS n, list_filter(q, lambda x: x > 25) AS big, list_transform(q, lambda x: CAST(x AS BIGINT) * 2) AS twice, CAST(list_sum(q) AS BIGINT) AS total, list_contains(q, 10) AS has10, "
    "list_reverse(q) AS rev, q[1:2] AS two, list_concat(q, [0]) AS more, CAST(coalesce(list_position(q, 10), 0) - 1 AS INT) AS at10, range(0, CAST(len(q) AS BIGINT)) AS idx, list_max(q) AS hi FROM g"
)
def expr_array(t):
    return t.lineitem.aggregate(
        [
            *_LINES,
            {
                "$project": {
                    "first": {"$first": "$q"},
                    "last": {"$last": "$q"},
                    "second": {"$arrayElemAt": ["$q", 1]},
                    "n": {"$size": "$q"},
                    "big": {"$filter": {"input": "$q", "as": "x", "cond": {"$gt": ["$$x", 25]}}},
                    "twice": {"$map": {"input": "$q", "as": "x", "in": {"$multiply": ["$$x", 2]}}},
                    "total": {"$reduce": {"input": "$q", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}},
                    "has10": {"$in": [10, "$q"]},
                    "rev": {"$reverseArray": "$q"},
                    "two": {"$slice": ["$q", 2]},
                    "more": {"$concatArrays": ["$q", [0]]},
                    "at10": {"$indexOfArray": ["$q", 10]},
                    "idx": {"$range": [0, {"$size": "$q"}]},
                    "hi": {"$max": "$q"},
                }
            },
        ]
    )


@query(
    _LINES_SQL
    + "SELECT _id, list_sort(list_distinct(list_concat(q, [1, 2, 3]))) AS u, list_sort(list_intersect(q, [10, 20, 30, 40])) AS i, list_sort(list_filter(list_distinct(q), lambda x: NOT list_contains([10, 20, 30, 40], x))) AS d, list_has_all([10, 20, 30, 40], q) AS sub, "
    "list_sort(list_distinct(q)) = [10, 20] AS eq, len(list_filter(q, lambda x: x = 0)) = 0 AS all_, len(list_filter(q, lambda x: x <> 0)) > 0 AS any_ FROM g"
)
def expr_set(t):
    s = lambda e: {"$sortArray": {"input": e, "sortBy": 1}}
    few = [10, 20, 30, 40]
    return t.lineitem.aggregate(
        [
            *_LINES,
            {
                "$project": {
                    "u": s({"$setUnion": ["$q", [1, 2, 3]]}),
                    "i": s({"$setIntersection": ["$q", few]}),
                    "d": s({"$setDifference": ["$q", few]}),
                    "sub": {"$setIsSubset": ["$q", few]},
                    "eq": {"$setEquals": ["$q", [20, 10, 10]]},
                    "all_": {"$allElementsTrue": "$q"},
                    "any_": {"$anyElementTrue": "$q"},
                }
            },
        ]
    )


@query("SELECT s_suppkey, s_nationkey AS k, 'x' AS tag, 2 AS n, s_name AS field, s_acctbal AS v0, CAST(2 AS INT) AS pairs FROM supplier")
def expr_object(t):
    return t.supplier.aggregate(
        [
            {"$set": {"doc": {"$mergeObjects": [{"k": "$s_nationkey", "tag": "old"}, {"tag": "x"}]}, "list": {"$objectToArray": {"a": "$s_acctbal", "b": 1.0}}}},
            {"$set": {"doc": {"$setField": {"field": "n", "input": "$doc", "value": 2}}}},
            {"$project": {"s_suppkey": 1, "k": "$doc.k", "tag": "$doc.tag", "n": "$doc.n", "field": {"$getField": {"field": "s_name", "input": "$$ROOT"}}, "v0": {"$getField": {"field": "v", "input": {"$first": "$list"}}}, "pairs": {"$size": "$list"}}},
        ]
    )


@query(
    "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'ok' END AS c, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, 'none') AS f, CASE WHEN s_nationkey < 5 THEN 'a' WHEN s_nationkey < 15 THEN 'b' ELSE 'z' END AS s, round(s_acctbal * 2 + s_nationkey, 4) AS l, '$x' AS lit, "
    "CASE WHEN s_nationkey < 10 THEN -1 WHEN s_nationkey > 10 THEN 1 ELSE 0 END AS cmp, (s_nationkey > 3 AND s_acctbal > 0) OR NOT (s_nationkey <> 7) AS b FROM supplier"
)
def expr_cond(t):
    return t.supplier.aggregate(
        [
            {
                "$project": {
                    "s_suppkey": 1,
                    "c": {"$cond": {"if": {"$lt": ["$s_acctbal", 0]}, "then": "debt", "else": "ok"}},
                    "f": {"$ifNull": [{"$cond": [{"$gt": ["$s_acctbal", 0]}, "$s_name", None]}, "none"]},
                    "s": {"$switch": {"branches": [{"case": {"$lt": ["$s_nationkey", 5]}, "then": "a"}, {"case": {"$lt": ["$s_nationkey", 15]}, "then": "b"}], "default": "z"}},
                    "l": {"$round": [{"$let": {"vars": {"two": 2}, "in": {"$add": [{"$multiply": ["$s_acctbal", "$$two"]}, "$s_nationkey"]}}}, 4]},
                    "lit": {"$literal": "$x"},
                    "cmp": {"$cmp": ["$s_nationkey", 10]},
                    "b": {"$or": [{"$and": [{"$gt": ["$s_nationkey", 3]}, {"$gt": ["$s_acctbal", 0]}]}, {"$not": [{"$ne": ["$s_nationkey", 7]}]}]},
                }
            }
        ]
    )


@query(
    "SELECT s_suppkey, CAST(trunc(s_acctbal) AS INT) AS i, CAST(trunc(s_acctbal) AS BIGINT) AS l, CAST(s_nationkey AS DOUBLE) AS d, CAST(s_nationkey AS VARCHAR) AS s, s_nationkey <> 0 AS b, TRY_CAST(substr(s_name, 1, 1) AS INT) IS NULL AS bad, 'double' AS ty, true AS num, CAST(s_nationkey AS DOUBLE) AS dec FROM supplier"
)
def expr_convert(t):
    return t.supplier.aggregate(
        [
            {
                "$project": {
                    "s_suppkey": 1,
                    "i": {"$toInt": "$s_acctbal"},
                    "l": {"$toLong": "$s_acctbal"},
                    "d": {"$toDouble": "$s_nationkey"},
                    "s": {"$toString": "$s_nationkey"},
                    "b": {"$toBool": "$s_nationkey"},
                    "bad": {"$eq": [{"$convert": {"input": {"$substrCP": ["$s_name", 0, 1]}, "to": "int", "onError": None}}, None]},
                    "ty": {"$type": "$s_acctbal"},
                    "num": {"$isNumber": "$s_nationkey"},
                    "dec": {"$toDouble": {"$toDecimal": "$s_nationkey"}},
                }
            }
        ]
    )


# --- dynamic documents, searches ---


@query("SELECT CAST(props->>'k' AS DOUBLE) AS k, count(*) AS n, round(avg(value), 7) AS a FROM events WHERE CAST(props->>'k' AS INT) >= 3 GROUP BY 1")
def json_dynamic(t):
    events = Collection(dynamic(t.df("events"), "props"))
    return events.aggregate(
        [
            {"$match": {"props.k": {"$gte": 3, "$type": "number"}}},
            {"$set": {"k": {"$ifNull": [{"$sum": []}, 0]}}},
            {"$set": {"k": F.try_variant_get("props", "$.k", "double")}},
            {"$group": {"_id": "$k", "n": {"$sum": 1}, "a": {"$avg": "$value"}}},
            {"$project": {"_id": 0, "k": "$_id", "n": 1, "a": {"$round": ["$a", 7]}}},
        ]
    )


@query(
    "WITH d AS (SELECT doc_id, lower(text) AS x, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents), "
    "s AS (SELECT doc_id, list_transform(list_filter(w, lambda y: true), lambda y: CASE WHEN length(y) > 3 THEN regexp_replace(y, '(ing|ies|es|ed|s)$', '') ELSE y END) AS w FROM d) "
    "SELECT doc_id, CAST(len(list_filter(w, lambda y: y IN ('nicht', 'verer'))) AS DOUBLE) AS score FROM s WHERE list_contains(w, 'nicht') OR list_contains(w, 'verer')"
)
def text_search(t):
    found = Collection(t.df("documents").select("doc_id", "text")).aggregate([{"$match": {"$text": {"$search": "nicht verer the"}}}, {"$project": {"doc_id": 1, "score": {"$meta": "textScore"}}}])
    return found


def _knn(t: Tables, how: str) -> DataFrame:
    vector = [float(x) for x in t.df("embeddings").filter("vec_id = 0").first()["embedding"]]
    return t.embeddings.aggregate(
        [
            {"$search": {"cosmosSearch": {"vector": vector, "path": "embedding", "k": 10, "similarity": how}}},
            {"$project": {"vec_id": 1, "score": {"$round": [{"$meta": "searchScore"}, 5]}}},
        ]
    )


_VECTORS = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round({}, 5) AS score FROM embeddings, q ORDER BY {} LIMIT 10"


@query(_VECTORS.format("list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)", "list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC"))
def vector_knn_cos(t):
    return _knn(t, "COS")


@query(_VECTORS.format("list_distance(CAST(embedding AS DOUBLE[]), q)", "list_distance(CAST(embedding AS DOUBLE[]), q)"))
def vector_knn_l2(t):
    return _knn(t, "L2")


@query(_VECTORS.format("list_inner_product(CAST(embedding AS DOUBLE[]), q)", "list_inner_product(CAST(embedding AS DOUBLE[]), q) DESC"))
def vector_knn_ip(t):
    return _knn(t, "IP")


_PLACES = {"$project": {"c_custkey": 1, "place": {"lon": {"$subtract": [{"$mod": [{"$multiply": ["$c_custkey", 37]}, 360]}, 180]}, "lat": {"$subtract": [{"$mod": [{"$multiply": ["$c_custkey", 17]}, 180]}, 90]}}}}
_PLACES_SQL = "WITH p AS (SELECT c_custkey, radians((c_custkey * 37) % 360 - 180) AS lo, radians((c_custkey * 17) % 180 - 90) AS la FROM customer), a AS (SELECT c_custkey, 2 * asin(sqrt(least(1.0, sin((la - radians(40)) / 2) ** 2 + cos(la) * cos(radians(40)) * sin((lo - radians(10)) / 2) ** 2))) AS d FROM p) "


@query(_PLACES_SQL + "SELECT c_custkey FROM a WHERE d <= 0.3")
def geo_within(t):
    return t.customer.aggregate([_PLACES, {"$match": {"place": {"$geoWithin": {"$centerSphere": [[10, 40], 0.3]}}}}, {"$project": {"c_custkey": 1}}])


@query(_PLACES_SQL + "SELECT c_custkey, CAST(round(d * 6378100.0, 0) AS BIGINT) AS metres FROM a WHERE d * 6378100.0 <= 1500000")
def geo_near(t):
    near = {"near": {"type": "Point", "coordinates": [10, 40]}, "key": "place", "distanceField": "metres", "maxDistance": 1500000}
    return t.customer.aggregate([_PLACES, {"$geoNear": near}, {"$project": {"c_custkey": 1, "metres": {"$toLong": {"$round": ["$metres", 0]}}}}])


# --- further expressions, accumulators and commands ---


@query(
    "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, CAST(epoch_us(ts) // 1000 % 1000 AS INT) AS ms, minute(ts) AS minute_, second(ts) AS second_, CAST(epoch_us(ts) // 1000 % 1000 AS INT) AS milli, "
    "epoch_us(ts) // 1000 AS back FROM events"
)
def expr_date_fields(t):
    return t.events.aggregate(
        [
            {"$set": {"p": {"$dateToParts": {"date": "$ts"}}, "again": {"$toDate": {"$toLong": "$ts"}}}},
            {
                "$project": {
                    "event_id": 1,
                    "y": "$p.year",
                    "mo": "$p.month",
                    "d": "$p.day",
                    "h": "$p.hour",
                    "mi": "$p.minute",
                    "s": "$p.second",
                    "ms": "$p.millisecond",
                    "minute_": {"$minute": "$ts"},
                    "second_": {"$second": "$ts"},
                    "milli": {"$millisecond": "$ts"},
                    "back": {"$toLong": "$again"},
                }
            },
        ]
    )


@query(
    "SELECT doc_id, ltrim(concat('  ', lang, 'xx'), ' ') AS l, rtrim(concat(lang, 'xyx'), 'xy') AS r, substr(source, 2, 3) AS sub, substr(source, 2, 3) AS sub_bytes, strpos(source, 'e') - 1 AS at, strlen(coalesce(text, '')) AS size FROM documents"
)
def expr_bytes(t):
    return t.documents.aggregate(
        [
            {
                "$project": {
                    "doc_id": 1,
                    "l": {"$ltrim": {"input": {"$concat": ["  ", "$lang", "xx"]}}},
                    "r": {"$rtrim": {"input": {"$concat": ["$lang", "xyx"]}, "chars": "xy"}},
                    "sub": {"$substr": ["$source", 1, 3]},
                    "sub_bytes": {"$substrBytes": ["$source", 1, 3]},
                    "at": {"$indexOfBytes": ["$source", "e"]},
                    "size": {"$binarySize": {"$ifNull": ["$text", ""]}},
                }
            }
        ]
    )


@query(
    _LINES_SQL + "SELECT _id, list_transform(range(1, len(q) + 1), lambda i: [q[i], list_reverse(q)[i]]) AS pairs, true AS is_array, false AS no_array, CAST(q[1] AS INT) AS lo, CAST(q[-1] AS INT) AS hi, q[greatest(len(q) - 1, 1):] AS tail FROM g"
)
def expr_array_build(t):
    return t.lineitem.aggregate(
        [
            *_LINES,
            {"$set": {"o": {"$arrayToObject": [[{"k": "lo", "v": {"$first": "$q"}}, {"k": "hi", "v": {"$last": "$q"}}]]}}},
            {
                "$project": {
                    "pairs": {"$zip": {"inputs": ["$q", {"$reverseArray": "$q"}]}},
                    "is_array": {"$isArray": "$q"},
                    "no_array": {"$isArray": "$_id"},
                    "lo": "$o.lo",
                    "hi": "$o.hi",
                    "tail": {"$lastN": {"input": "$q", "n": 2}},
                }
            },
        ]
    )


@query("SELECT s_suppkey, s_nationkey AS k, NULL AS dropped, hex(unhex(lpad(CAST(s_suppkey AS VARCHAR), 24, '0'))) AS oid, 5 + (11 + 8) + (8 + 5 + strlen(s_name)) + (13 + 4) + (11 + 8) AS size FROM supplier")
def expr_fields_sizes(t):
    padded = {"$concat": ["000000000000000000000000", {"$toString": "$s_suppkey"}]}
    return t.supplier.aggregate(
        [
            {"$set": {"doc": {"$unsetField": {"field": "tag", "input": {"k": "$s_nationkey", "tag": "x"}}}, "size": {"$bsonSize": "$$ROOT"}, "padded": padded}},
            {"$set": {"oid": {"$toObjectId": {"$substrCP": ["$padded", {"$subtract": [{"$strLenCP": "$padded"}, 24]}, 24]}}}},
            {"$project": {"s_suppkey": 1, "k": "$doc.k", "dropped": "$doc.tag", "oid": "$oid", "size": 1}},
        ]
    ).withColumn("oid", F.hex("oid")).withColumn("dropped", F.lit(None).cast("int"))


@query(
    "SELECT c_nationkey AS _id, list(c_custkey ORDER BY c_custkey)[greatest(count(*) - 2, 1):] AS last3, max_by(c_name, c_custkey) AS bottom FROM customer GROUP BY 1"
)
def group_last_bottom(t):
    return t.customer.aggregate(
        [
            {"$sort": {"c_custkey": 1}},
            {"$group": {"_id": "$c_nationkey", "last3": {"$lastN": {"input": "$c_custkey", "n": 3}}, "bottom": {"$bottom": {"sortBy": {"c_custkey": 1}, "output": "$c_name"}}}},
        ]
    )


@query(
    "SELECT c_custkey, round(covar_samp(c_acctbal, c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cov FROM customer"
)
def win_cov_samp(t):
    window = {"partitionBy": "$c_nationkey", "sortBy": {"c_custkey": 1}, "output": {"cov": {"$covarianceSamp": ["$c_acctbal", "$c_custkey"], "window": {"documents": ["unbounded", "current"]}}}}
    return t.customer.aggregate([{"$setWindowFields": window}, {"$project": {"c_custkey": 1, "cov": {"$round": ["$cov", 0]}}}])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 50000 AND o_orderdate <= TIMESTAMP '1997-01-01'")
def match_lte_comment(t):
    return t.orders.find({"o_totalprice": {"$lte": 50000}, "o_orderdate": {"$lte": dt.datetime(1997, 1, 1)}, "$comment": "cheap and old"}, {"_id": 0, "o_orderkey": 1, "o_totalprice": 1}, limit=0)


@query(_LINES_SQL + "SELECT _id, [list_filter(q, lambda x: x > 30)[1]] AS q FROM g WHERE list_max(q) > 30")
def project_positional(t):
    lines = t.lineitem.aggregate(_LINES)
    return Collection(lines).find({"q": {"$gt": 30}}, {"_id": 1, "q.$": 1})


@query("SELECT 100 AS pct, least(count(*), 1000000) AS n, 0 AS outside FROM supplier")
def sample_rand(t):
    whole = t.supplier.aggregate([{"$match": {"$expr": {"$gte": [{"$rand": {}}, 0]}}}, {"$match": {"$sampleRate": 1.0}}, {"$sample": {"size": 1000000}}])
    return Collection(whole).aggregate([{"$set": {"r": {"$rand": {}}}}, {"$group": {"_id": None, "n": {"$sum": 1}, "outside": {"$sum": {"$cond": [{"$gte": ["$r", 1]}, 1, 0]}}}}, {"$project": {"_id": 0, "n": 1, "outside": 1, "pct": {"$literal": 100}}}])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 1000, 'NEW', NULL")
def insert_documents(t):
    return t.nation.insert([{"n_nationkey": 1000, "n_name": "NEW"}]).df


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'ONLY' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def replace_document(t):
    return t.nation.replace_one({"n_nationkey": 3}, {"n_nationkey": 3, "n_name": "ONLY"}).df


@query("SELECT c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END AS c_acctbal, c_nationkey < 5 AS stamped FROM customer")
def update_unset_current_date(t):
    done = t.customer.update_many({"c_nationkey": {"$lt": 5}}, {"$unset": {"c_acctbal": ""}, "$currentDate": {"seen": True}})
    return done.aggregate([{"$project": {"c_custkey": 1, "c_name": 1, "c_acctbal": 1, "stamped": {"$ne": ["$seen", None]}}}])


@query("SELECT s_nationkey AS _id, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def view_create_commands(t):
    """Create a view, rename it, list it, then query it by command documents."""
    db = Database(t.spark, {"supplier": t.df("supplier")})
    db.run_command({"create": "rich", "viewOn": "supplier", "pipeline": [{"$match": {"s_acctbal": {"$gt": 0}}}]})
    db.run_command({"renameCollection": "db.rich", "to": "db.solvent"})
    db.run_command({"createIndexes": "solvent", "indexes": [{"key": {"s_suppkey": 1}, "unique": True}]})
    db.run_command({"dropIndexes": "solvent", "index": "s_suppkey_1"})
    db.run_command({"drop": "supplier"})
    stages = [{"$group": {"_id": "$s_nationkey", "n": {"$sum": 1}, "total": {"$sum": "$s_acctbal"}}}, {"$set": {"total": {"$round": ["$total", 2]}}}]
    return db.run_command({"aggregate": "solvent", "pipeline": stages, "cursor": {}})


@query("SELECT 'gone' AS name, 'collection' AS type WHERE false UNION ALL SELECT unnest(['nation', 'region']), 'collection'")
def list_collections(t):
    db = Database(t.spark, {n: t.df(n) for n in ("nation", "region", "part")})
    db.run_command({"drop": "part"})
    return db.run_command({"listCollections": 1, "nameOnly": True})


@query("SELECT '_id_' AS name, '_id:1' AS key, false AS \"unique\", CAST(NULL AS BIGINT) AS \"expireAfterSeconds\" UNION ALL SELECT 'n_nationkey_1', 'n_nationkey:1', true, NULL UNION ALL SELECT 'old', 'ts:1', false, 3600")
def list_indexes(t):
    db = Database(t.spark, {"nation": t.df("nation")})
    db.run_command({"createIndexes": "nation", "indexes": [{"key": {"n_nationkey": 1}, "unique": True}, {"key": {"ts": 1}, "name": "old", "expireAfterSeconds": 3600}]})
    return db.run_command({"listIndexes": "nation"})


@query("SELECT event_id FROM events WHERE false")
def ttl_unexpired(t):
    """A TTL index of one second leaves nothing of a table of past events."""
    db = Database(t.spark, {"events": t.df("events")})
    db.run_command({"createIndexes": "events", "indexes": [{"key": {"ts": 1}, "expireAfterSeconds": 1}]})
    return db.unexpired("events").df.select("event_id")


@query("SELECT count(*) AS n FROM lineitem")
def validate_count(t):
    return Database(t.spark, {"lineitem": t.df("lineitem")}).run_command({"validate": "lineitem"})


@query(_PLACES_SQL + "SELECT c_custkey FROM a WHERE (c_custkey * 37) % 360 - 180 BETWEEN -20 AND 60 AND (c_custkey * 17) % 180 - 90 BETWEEN -30 AND 45")
def geo_intersects(t):
    ring = [[-20.5, -30.5], [60.5, -30.5], [60.5, 45.5], [-20.5, 45.5], [-20.5, -30.5]]
    return t.customer.aggregate([_PLACES, {"$match": {"place": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [ring]}}}}}, {"$project": {"c_custkey": 1}}])


@query("SELECT c_custkey, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1, 2")
def lookup_pipeline_group(t):
    stages = [
        {"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$key"]}, {"$gt": ["$o_totalprice", 1000]}]}}},
        {"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}},
    ]
    return t.customer.aggregate(
        [
            {"$lookup": {"from": "orders", "let": {"key": "$c_custkey"}, "pipeline": stages, "as": "by"}},
            {"$unwind": "$by"},
            {"$project": {"c_custkey": 1, "status": "$by._id", "n": "$by.n", "total": {"$round": ["$by.total", 2]}}},
        ]
    )


@query("SELECT n_nationkey, coalesce(list(c_custkey ORDER BY c_acctbal DESC, c_custkey) FILTER (c_custkey IS NOT NULL), [])[1:3] AS top, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def lookup_pipeline_top(t):
    richest = [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$key"]}}}, {"$sort": {"c_acctbal": -1, "c_custkey": 1}}, {"$limit": 3}, {"$project": {"c_custkey": 1}}]
    counted = [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$key"]}}}, {"$count": "n"}]
    return t.nation.aggregate(
        [
            {"$lookup": {"from": "customer", "let": {"key": "$n_nationkey"}, "pipeline": richest, "as": "rich"}},
            {"$lookup": {"from": "customer", "let": {"key": "$n_nationkey"}, "pipeline": counted, "as": "all"}},
            {"$project": {"n_nationkey": 1, "top": "$rich.c_custkey", "n": {"$ifNull": [{"$first": "$all.n"}, 0]}}},
        ]
    )


@query(
    "SELECT c_custkey, list_reverse_sort(list(c_acctbal) OVER w)[1:2] AS best, arg_max(c_custkey, c_acctbal) OVER w AS top, arg_min(c_custkey, c_acctbal) OVER w AS bottom, list_sort(list(c_acctbal) OVER w)[1:2] AS least FROM customer "
    "WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
)
def win_top(t):
    frame, by = {"window": {"documents": [-4, 0]}}, {"c_acctbal": -1}
    output = {
        "best": {"$topN": {"n": 2, "sortBy": by, "output": "$c_acctbal"}, **frame},
        "top": {"$top": {"sortBy": by, "output": "$c_custkey"}, **frame},
        "bottom": {"$bottom": {"sortBy": by, "output": "$c_custkey"}, **frame},
        "least": {"$bottomN": {"n": 2, "sortBy": by, "output": "$c_acctbal"}, **frame},
    }
    return t.customer.aggregate(
        [
            {"$setWindowFields": {"partitionBy": "$c_nationkey", "sortBy": {"c_custkey": 1}, "output": output}},
            {"$project": {"c_custkey": 1, "best": 1, "top": 1, "bottom": 1, "least": {"$reverseArray": "$least"}}},
        ]
    )


@query("SELECT c_custkey, c_nationkey AS nation, last_value(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM customer")
def win_merge_objects(t):
    merged = {"$mergeObjects": "$part", "window": {"documents": ["unbounded", "current"]}}
    return t.customer.aggregate(
        [
            {"$set": {"part": {"nation": "$c_nationkey", "balance": "$c_acctbal"}}},
            {"$setWindowFields": {"partitionBy": "$c_nationkey", "sortBy": {"c_custkey": 1}, "output": {"all": merged}}},
            {"$project": {"c_custkey": 1, "nation": "$all.nation", "balance": "$all.balance"}},
        ]
    )


# --- writes ---


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 'near' ELSE s_name END AS s_name, CASE WHEN s_nationkey < 10 THEN CAST(s_nationkey AS BIGINT) * 3 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_nationkey < 10 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_set_inc_mul(t):
    return t.supplier.update_many({"s_nationkey": {"$lt": 10}}, {"$set": {"s_name": "near"}, "$inc": {"s_acctbal": 100}, "$mul": {"s_nationkey": 3}}).df


@query("SELECT s_suppkey, least(s_nationkey, 12) AS s_nationkey, greatest(s_acctbal, 0) AS s_acctbal, s_name AS title FROM supplier")
def update_min_max(t):
    return t.supplier.update_many({}, {"$min": {"s_nationkey": 12}, "$max": {"s_acctbal": 0}, "$rename": {"s_name": "title"}}).df.drop("s_name")


@query(
    _LINES_SQL
    + "SELECT _id, list_concat(q, [7, 8]) AS pushed, CASE WHEN list_contains(q, 10) THEN q ELSE list_concat(q, [10]) END AS added, list_filter(q, lambda x: NOT x > 25) AS pulled, q[2:] AS popped, list_filter(q, lambda x: x NOT IN (10, 20)) AS without FROM g"
)
def update_array(t):
    base = t.lineitem.aggregate([*_LINES, {"$project": {"pushed": "$q", "added": "$q", "pulled": "$q", "popped": "$q", "without": "$q"}}])
    change = {"$push": {"pushed": {"$each": [7, 8]}}, "$addToSet": {"added": 10}, "$pull": {"pulled": {"$gt": 25}}, "$pop": {"popped": -1}, "$pullAll": {"without": [10, 20]}}
    return Collection(base).update_many({}, change).df


@query(
    "SELECT CASE WHEN s_nationkey = 3 AND s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 3) THEN 'picked' ELSE s_name END AS s_name, s_suppkey FROM supplier "
    "UNION ALL SELECT 'new', CAST(-5 AS BIGINT)"
)
def update_upsert(t):
    one = t.supplier.update({"s_nationkey": 3}, {"$set": {"s_name": "picked"}}, sort={"s_suppkey": 1})
    return one.update({"s_suppkey": -5}, {"$set": {"s_name": "new"}, "$setOnInsert": {"s_nationkey": 1}}, upsert=True).df.select("s_name", "s_suppkey")


@query("SELECT s_suppkey, s_nationkey & 6 AS a, (s_nationkey | 8) AS o FROM supplier")
def update_bit(t):
    base = t.supplier.aggregate([{"$project": {"s_suppkey": 1, "a": "$s_nationkey", "o": "$s_nationkey"}}])
    return Collection(base).update_many({}, {"$bit": {"a": {"and": 6}, "o": {"or": 8}}}).df


@query("SELECT s_suppkey, list_transform(q, lambda x: CASE WHEN x > 5 THEN CAST(x AS BIGINT) * 10 ELSE x END) AS q FROM (SELECT s_suppkey, [s_nationkey, 3] AS q FROM supplier)")
def update_array_filters(t):
    base = t.supplier.aggregate([{"$project": {"s_suppkey": 1, "q": [{"$toLong": "$s_nationkey"}, {"$toLong": {"$literal": 3}}]}}])
    return Collection(base).update_many({}, {"$mul": {"q.$[big]": 10}}, array_filters=[{"big": {"$gt": 5}}]).df


@query(
    "SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(b.s_name, a.s_name) AS s_name, a.s_acctbal FROM (SELECT * FROM supplier WHERE s_nationkey < 15) a FULL OUTER JOIN (SELECT s_suppkey, lower(s_name) AS s_name FROM supplier WHERE s_nationkey >= 10) b ON a.s_suppkey = b.s_suppkey"
)
def merge_stage(t):
    target = t.supplier.find({"s_nationkey": {"$lt": 15}}, {"s_suppkey": 1, "s_name": 1, "s_acctbal": 1})
    return t.supplier.aggregate(
        [
            {"$match": {"s_nationkey": {"$gte": 10}}},
            {"$project": {"s_suppkey": 1, "s_name": {"$toLower": "$s_name"}}},
            {"$merge": {"into": target, "on": "s_suppkey", "whenMatched": "merge", "whenNotMatched": "insert"}},
        ]
    )


@query("SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')")
def delete_many(t):
    return t.customer.delete({"$or": [{"c_acctbal": {"$lt": 0}}, {"c_mktsegment": "BUILDING"}]}).df.select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_nationkey >= 5 ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def find_and_modify(t):
    shown, _ = t.supplier.find_and_modify({"s_nationkey": {"$gte": 5}}, update={"$inc": {"s_acctbal": 1}}, new=True, sort={"s_acctbal": -1, "s_suppkey": 1}, fields={"s_suppkey": 1, "s_acctbal": 1})
    return shown


@query("SELECT CAST(count(*) AS BIGINT) AS count FROM orders")
def coll_stats(t):
    return t.orders.aggregate([{"$collStats": {"count": {}}}])


@query("SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, NULL")
def documents_literal(t):
    return Collection(t.spark.range(1).select()).aggregate([{"$documents": [{"a": 1, "b": "x"}, {"a": 2}]}, {"$set": {"a": {"$toInt": "$a"}}}])
