"""The language on small documents: null and missing, arrays, errors, updates."""

import datetime as dt
import re

import pytest

from docmill.errors import DocumentError
from docmill.functions.accumulators import accumulator_names
from docmill.functions.expressions import operator_names, register_expression
from docmill.operators.stages import stage_names
from docmill.operators.windows import window_operator_names
from docmill.plans.collection import Collection, Database
from docmill.plans.rewrite import rewrite
from docmill.sources.documents import from_documents


@pytest.fixture(scope="module")
def things(spark):
    rows = [
        (1, "a", 5, 1.5, [1, 2, 3], [("x", 1), ("y", 2)], ("in", 1)),
        (2, "B", None, -2.0, [], [], ("out", None)),
        (3, None, 7, None, None, None, None),
        (4, "a", 42, 42.0, [42, None], [("x", 42)], ("in", 9)),
    ]
    df = spark.createDataFrame(rows, "_id int, s string, n int, d double, arr array<int>, docs array<struct<k:string,v:int>>, sub struct<p:string,q:int>")
    return Collection(df)


def ids(df):
    return sorted(r._id for r in df.collect())


@pytest.mark.parametrize(
    "query,want",
    [
        ({}, [1, 2, 3, 4]),
        ({"s": "a"}, [1, 4]),
        ({"s": None}, [3]),
        ({"s": {"$ne": "a"}}, [2, 3]),
        ({"n": {"$gt": 5}}, [3, 4]),
        ({"n": {"$gt": 5.5, "$lte": 42}}, [3, 4]),
        ({"n": {"$not": {"$gt": 5}}}, [1, 2]),
        ({"n": 42.0}, [4]),
        ({"n": "42"}, []),
        ({"n": {"$gt": "4"}}, []),
        ({"n": {"$in": [5, None]}}, [1, 2]),
        ({"n": {"$nin": [5, None]}}, [3, 4]),
        ({"n": {"$in": [5.0, 5.5, "x"]}}, [1]),
        ({"s": {"$in": [re.compile("^b", re.I)]}}, [2]),
        ({"s": re.compile("A", re.I)}, [1, 4]),
        ({"s": {"$regex": "^b", "$options": "i"}}, [2]),
        ({"arr": 2}, [1]),
        ({"arr": [1, 2, 3]}, [1]),
        ({"arr": []}, [2]),
        ({"arr": {"$size": 0}}, [2]),
        ({"arr": {"$all": [1, 3]}}, [1]),
        ({"arr": {"$gt": 2}}, [1, 4]),
        ({"arr.1": 2}, [1]),
        ({"arr": {"$elemMatch": {"$gt": 1, "$lt": 3}}}, [1]),
        ({"docs.v": 42}, [4]),
        ({"docs": {"$elemMatch": {"k": "x", "v": {"$lt": 10}}}}, [1]),
        ({"docs.0.k": "x"}, [1, 4]),
        ({"sub.p": "in"}, [1, 4]),
        ({"sub": {"p": "in", "q": 1}}, [1]),
        ({"sub": {"q": 1, "p": "in"}}, []),
        ({"sub.q": None}, [2, 3]),
        ({"nothing": None}, [1, 2, 3, 4]),
        ({"nothing": 1}, []),
        ({"n": {"$exists": True}}, [1, 3, 4]),
        ({"n": {"$exists": 0}}, [2]),
        ({"n": {"$mod": [5, 2]}}, [3, 4]),
        ({"d": {"$mod": [2, 1]}}, [1]),
        ({"d": {"$bitsAllSet": 2}}, [2, 4]),
        ({"n": {"$bitsAnySet": [0]}}, [1, 3]),
        ({"n": {"$bitsAllClear": 5}}, [4]),
        ({"s": {"$type": "string"}}, [1, 2, 4]),
        ({"n": {"$type": ["double", "int"]}}, [1, 3, 4]),
        ({"n": {"$type": "null"}}, [2]),
        ({"arr": {"$type": "array"}}, [1, 2, 4]),
        ({"$or": [{"n": 5}, {"s": "B"}]}, [1, 2]),
        ({"$nor": [{"n": 5}, {"s": "B"}]}, [3, 4]),
        ({"$and": [{"n": {"$gt": 1}}, {"d": {"$lt": 40}}]}, [1]),
        ({"$expr": {"$eq": ["$n", "$d"]}}, [4]),
        ({"$expr": "$n"}, [1, 3, 4]),
        ({"$comment": "x", "n": {"$comment": "y", "$eq": 7}}, [3]),
        ({"$jsonSchema": {"required": ["n"], "properties": {"n": {"minimum": 6}}}}, [3, 4]),
    ],
)
def test_filters(things, query, want):
    assert ids(things.find(query)) == want


@pytest.mark.parametrize(
    "query,code",
    [
        ({"n": {"$bad": 1}}, 2),
        ({"$bad": 1}, 2),
        ({"n": {"$in": 5}}, 2),
        ({"n": {"$size": -1}}, 2),
        ({"n": {"$size": 1.5}}, 2),
        ({"n": {"$mod": [1]}}, 2),
        ({"n": {"$mod": [0, 1]}}, 2),
        ({"n": {"$bitsAllSet": -1}}, 2),
        ({"n": {"$bitsAllSet": [-1]}}, 2),
        ({"n": {"$type": "strange"}}, 2),
        ({"s": {"$regex": "("}}, 51091),
        ({"s": {"$regex": "a", "$options": "q"}}, 51108),
        ({"$and": []}, 2),
        ({"$expr": {"$gt": [1]}}, 16020),
        ({"$expr": {"$nothing": 1}}, 168),
        ({"$expr": {"$gt": [1, 2], "x": 1}}, 15983),
        ({"$expr": "$$none"}, 17276),
        ({"$expr": "$"}, 16872),
        ({"$expr": "$$"}, 9),
        ({"a..b": 1}, 15998),
    ],
)
def test_filter_errors(things, query, code):
    with pytest.raises(DocumentError) as e:
        things.find(query)
    assert e.value.code == code


@pytest.mark.parametrize(
    "stage,code",
    [
        ({"$limit": 0}, 15958),
        ({"$limit": 4.5}, 5107201),
        ({"$skip": -1}, 5107200),
        ({"$sort": {"n": 2}}, 15975),
        ({"$sort": {}}, 15976),
        ({"$project": {}}, 51272),
        ({"$project": {"a": {}}}, 51270),
        ({"$project": {"n": 1, "s": 0}}, 31254),
        ({"$project": {"arr.$": 1}}, 31324),
        ({"$unset": ["sub", "sub.p"]}, 31249),
        ({"$group": {"n": {"$sum": 1}}}, 15955),
        ({"$group": {"_id": None, "n": 5}}, 40234),
        ({"$group": {"_id": None, "n": {"$sum": [1]}}}, 40237),
        ({"$group": {"_id": None, "n": {"$what": 1}}}, 15952),
        ({"$count": "$x"}, 40156),
        ({"$unwind": "arr"}, 28818),
        ({"$nothing": 1}, 40324),
        ({"$bucket": {"groupBy": "$n", "boundaries": [3, 1]}}, 40194),
    ],
)
def test_stage_errors(things, stage, code):
    with pytest.raises(DocumentError) as e:
        things.aggregate([stage])
    assert e.value.code == code


def test_limit_takes_whole_doubles_and_counts_nothing_as_no_row(things):
    assert things.aggregate([{"$sort": {"_id": 1}}, {"$limit": 2.0}]).count() == 2
    assert things.aggregate([{"$match": {"n": -1}}, {"$count": "n"}]).count() == 0
    assert things.count({"n": -1}).first().n == 0
    assert things.find(limit=0).count() == 4


def test_sort_puts_null_lowest_and_arrays_by_their_edges(things):
    order = lambda spec: [r._id for r in things.aggregate([{"$sort": {**spec, "_id": 1}}]).collect()]
    assert order({"n": 1}) == [2, 1, 3, 4]
    assert order({"n": -1}) == [4, 3, 1, 2]
    assert order({"arr": 1})[-1] == 4 and order({"arr": -1})[0] == 4


def test_projections(things):
    assert things.aggregate([{"$project": {"sub.p": 1}}]).columns == ["_id", "sub"]
    assert things.aggregate([{"$project": {"_id": 0, "n": 1}}]).columns == ["n"]
    assert things.aggregate([{"$project": {"sub.p": 0, "arr": 0}}]).first().sub.asDict() == {"q": 1}
    r = things.find({"docs": {"$elemMatch": {"v": {"$gt": 1}}}, "_id": 1}, {"docs.$": 1}).first()
    assert [x.v for x in r.docs] == [2]
    assert things.find({"_id": 1}, {"arr": {"$slice": -2}}).first().arr == [2, 3]
    assert things.find({"_id": 1}, {"docs": {"$elemMatch": {"k": "y"}}}).first().docs[0].v == 2
    r = things.aggregate([{"$match": {"_id": 1}}, {"$addFields": {"sub.r": {"$add": ["$n", 1]}, "docs.w": 0, "s": "$$REMOVE"}}]).first()
    assert r.sub.asDict() == {"p": "in", "q": 1, "r": 6} and [x.w for x in r.docs] == [0, 0] and "s" not in r.asDict()


def test_unwind_forms(things):
    rows = things.aggregate([{"$unwind": {"path": "$arr", "includeArrayIndex": "i", "preserveNullAndEmptyArrays": True}}]).collect()
    assert sorted((r._id, -1 if r.arr is None else r.arr, r.i) for r in rows if r._id < 4) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, -1, None), (3, -1, None)]
    assert ids(things.aggregate([{"$unwind": "$n"}])) == [1, 3, 4]
    assert ids(things.aggregate([{"$unwind": "$docs.v"}])) == [1, 1, 4]


def test_distinct_unwinds_arrays(things):
    assert sorted(r.value for r in things.distinct("arr").collect()) == [1, 2, 3, 42]
    assert sorted(r.value for r in things.distinct("docs.k").collect()) == ["x", "y"]


def test_expressions_on_arrays_and_objects(things):
    r = things.aggregate([{"$match": {"_id": 1}}, {"$project": {
        "z": {"$zip": {"inputs": ["$arr", [9, 8]], "useLongestLength": True, "defaults": [0, 0]}},
        "r": {"$range": [5, 0, -2]},
        "m": {"$map": {"input": "$docs", "as": "d", "in": {"$concat": ["$$d.k", "!"]}}},
        "f": {"$reduce": {"input": "$docs.v", "initialValue": 1, "in": {"$multiply": ["$$value", "$$this"]}}},
        "o": {"$arrayToObject": [[["k", "v"]]]},
        "t": {"$type": "$nothing"}, "t2": {"$type": "$arr"},
        "sortd": {"$getField": {"field": "k", "input": {"$first": {"$sortArray": {"input": "$docs", "sortBy": {"v": -1}}}}}},
        "all": {"$regexFindAll": {"input": "a1b22", "regex": "[0-9]+"}},
        "sw": {"$switch": {"branches": [{"case": {"$isArray": "$arr"}, "then": "arr"}], "default": "no"}},
        "size": {"$bsonSize": {"a": {"$literal": 1}}},
        "d": {"$dateToString": {"date": dt.datetime(2020, 2, 3, 4, 5, tzinfo=dt.timezone.utc), "format": "%d/%m/%Y at %H"}},
    }}]).first()
    assert r.z == [[1, 9], [2, 8], [3, 0]] and r.r == [5, 3, 1] and r.m == ["x!", "y!"] and r.f == 2
    assert (r.t, r.t2, r.sortd, r.sw, r.size, r.d) == ("missing", "array", "y", "arr", 12, "03/02/2020 at 04")
    assert [(m.match, m.idx) for m in r["all"]] == [("1", 1), ("22", 3)]


def test_user_expressions(things):
    register_expression("$plusOne", lambda c: c + 1)
    assert things.aggregate([{"$match": {"_id": 1}}, {"$project": {"x": {"$plusOne": "$n"}}}]).first().x == 6


def test_lets_and_variables(things):
    assert ids(things.aggregate([{"$match": {"$expr": {"$eq": ["$n", "$$wanted"]}}}], let={"wanted": 7})) == [3]
    assert things.aggregate([{"$match": {"_id": 1}}, {"$addFields": {"copy": "$$ROOT"}}]).first().copy.n == 5


def test_updates(things):
    after = {r._id: r for r in things.update_many({"_id": {"$lte": 2}}, {"$inc": {"n": 2}, "$set": {"sub.p": "new", "fresh": 1}, "$push": {"arr": {"$each": [9, 0], "$sort": -1, "$slice": 2}}}).df.collect()}
    assert (after[1].n, after[2].n, after[4].n) == (7, 2, 42)
    assert after[1].sub.p == "new" and after[4].sub.p == "in" and after[1].fresh == 1 and after[4].fresh is None
    assert after[1].arr == [9, 3] and after[2].arr == [9, 0] and after[4].arr == [42, None]
    one = things.update({"s": "a"}, {"$set": {"s": "z"}}, sort={"n": -1}).df
    assert {r._id for r in one.collect() if r.s == "z"} == {4}
    first = things.update({"arr": {"$gt": 1}}, {"$set": {"arr.$": 100}}).df.filter("_id = 1").first()
    assert first.arr == [1, 100, 3]
    every = things.update_many({}, {"$inc": {"docs.$[d].v": 1}}, array_filters=[{"d.k": "x"}]).df
    assert [x.v for x in every.filter("_id = 1").first().docs] == [2, 2]
    replaced = things.replace_one({"_id": 2}, {"s": "only"}).df.filter("_id = 2").first()
    assert replaced.s == "only" and replaced.n is None and replaced.d is None
    piped = things.update_many({"_id": 4}, [{"$set": {"n": {"$multiply": ["$n", 2]}}}]).df.filter("_id = 4").first()
    assert piped.n == 84
    grown = things.update({"_id": 77}, {"$set": {"n": 1}, "$setOnInsert": {"s": "ins"}}, upsert=True).df.filter("_id = 77").first()
    assert (grown.n, grown.s) == (1, "ins")


@pytest.mark.parametrize("change,code", [({"$bad": {"n": 1}}, 9), ({"$set": {"n": 1}, "$inc": {"n": 1}}, 40), ({"$inc": {"n": "x"}}, 14), ({"$inc": {"s": 1}}, 14), ({"$pop": {"arr": 2}}, 9), ({"$push": {"n": 1}}, 2), ({"$set": {"a..b": 1}}, 15998)])
def test_update_errors(things, change, code):
    with pytest.raises(DocumentError) as e:
        things.update_many({}, change)
    assert e.value.code == code


def test_delete_and_find_and_modify(things):
    assert ids(things.delete({"s": "a"}, limit=1, sort={"_id": -1}).df) == [1, 2, 3]
    shown, after = things.find_and_modify({"s": "a"}, remove=True, sort={"_id": 1})
    assert ids(shown) == [1] and ids(after.df) == [2, 3, 4]
    shown, after = things.find_and_modify({"_id": 3}, update={"$set": {"n": 0}})
    assert shown.first().n == 7 and after.find({"_id": 3}).first().n == 0


def test_databases(spark, things):
    db = Database(spark, {"things": things.df})
    assert db.run_command({"count": "things", "query": {"s": "a"}}).first().n == 2
    assert ids(db.run_command({"find": "things", "filter": {"n": 7}})) == [3]
    db.run_command({"insert": "new", "documents": [{"_id": 1, "v": "x"}, {"_id": 2}]})
    assert ids(db["new"].df) == [1, 2]
    db.run_command({"update": "new", "updates": [{"q": {"_id": 2}, "u": {"$set": {"v": "y"}}}]})
    assert db["new"].find({"v": "y"}).count() == 1
    db.run_command({"delete": "new", "deletes": [{"q": {"_id": 1}, "limit": 0}]})
    assert ids(db["new"].df) == [2]
    assert db.create_indexes("new", [{"key": {"v": 1}, "unique": True}]) == 2
    assert {r.name for r in db.list_indexes("new").collect()} == {"_id_", "v_1"}
    db.create("seen", view_on="things", pipeline=[{"$match": {"s": "a"}}])
    assert ids(db["seen"].df) == [1, 4]
    db.rename("seen", "kept")
    assert [r.name for r in db.list_collections({"name": {"$in": ["kept", "seen"]}}).collect()] == ["kept"]
    assert db.run_command({"aggregate": "things", "pipeline": [{"$match": {"_id": 1}}], "cursor": {}}).count() == 1
    for command, code in (({"aggregate": "things", "pipeline": []}, 9), ({"find": "none"}, 73), ({"what": 1}, 59), ({"ping": 1}, 238)):
        with pytest.raises(DocumentError) as e:
            db.run_command(command)
        assert e.value.code == code
    assert sum(len(p) for p in things.pages(things.df, 3)) == 4


def test_rewrites():
    lookup = {"$lookup": {"from": "o", "localField": "a", "foreignField": "b", "as": "x"}}
    assert [next(iter(s)) for s in rewrite([lookup, {"$unwind": "$x"}])] == ["$joined"]
    assert [next(iter(s)) for s in rewrite([lookup, {"$match": {"x": []}}, {"$unset": "x"}])] == ["$matched"]
    assert [next(iter(s)) for s in rewrite([{"$sort": {"a": 1}}, {"$set": {"b": 1}}, {"$match": {"a": 1}}])] == ["$match", "$sort", "$set"]
    assert [next(iter(s)) for s in rewrite([{"$set": {"a": 1}}, {"$match": {"a": 1}}])] == ["$set", "$match"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS n", "cast(id AS string) AS s").write.parquet(f"{tmp_path}/t")
    plan = Collection(spark.read.parquet(f"{tmp_path}/t")).aggregate([{"$match": {"n": {"$gte": 10, "$lt": 20}}}, {"$project": {"s": 1}}])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,10)" in plan and "LessThan(n,20)" in plan
    assert "ReadSchema: struct<n:bigint,s:string>" in plan


def test_dynamic_documents(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": "1"}'), (3, "{}"), (4, '{"a": 2.5}')], "_id int, doc string").selectExpr("_id", "parse_json(doc) AS doc")
    c = Collection(df)
    assert ids(c.find({"doc.a": {"$gte": 1}})) == [1, 4]
    assert ids(c.find({"doc.a": "1"})) == [2]
    assert ids(c.find({"doc.b.c": "x"})) == [1]
    assert ids(c.find({"doc.a": {"$exists": False}})) == [3]
    assert ids(c.find({"doc.a": {"$type": "string"}})) == [2]


def test_streams(spark, tmp_path):
    from docmill.streaming.streams import stream_pipeline, windowed_group

    rows = [(i, dt.datetime(2024, 1, 1, 0, i), float(i)) for i in range(30)]
    spark.createDataFrame(rows, "k int, ts timestamp, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, ts timestamp, v double").parquet(f"{tmp_path}/in")
    grouped = windowed_group(stream_pipeline(stream, [{"$match": {"k": {"$gte": 10}}}]), "ts", "10 minutes", {"_id": None, "n": {"$sum": 1}, "v": {"$max": "$v"}})
    q = grouped.writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.v) for r in spark.table("win").collect()) == [(10, 19.0), (10, 29.0)]
    with pytest.raises(DocumentError):
        stream_pipeline(stream, [{"$sort": {"k": 1}}])


def test_merge_modes(spark):
    target = from_documents(spark, [{"_id": 1, "v": "a", "w": 1}, {"_id": 2, "v": "b", "w": 2}])
    source = Collection(from_documents(spark, [{"_id": 2, "v": "c"}, {"_id": 3, "v": "d"}]))

    def run(**how):
        return sorted((r._id, r.v) for r in source.aggregate([{"$merge": {"into": target, **how}}]).collect())

    assert run() == [(1, "a"), (2, "c"), (3, "d")]
    assert run(whenMatched="keepExisting") == [(1, "a"), (2, "b"), (3, "d")]
    assert run(whenNotMatched="discard") == [(1, "a"), (2, "c")]
    assert run(whenMatched=[{"$set": {"v": {"$concat": ["$v", "$$new.v"]}}}]) == [(1, "a"), (2, "bc"), (3, "d")]
    with pytest.raises(Exception, match="DuplicateKey"):
        run(whenMatched="fail")


def test_text_scores(spark):
    df = from_documents(spark, [{"_id": 1, "t": "They hunt whales and whales hunt them"}, {"_id": 2, "t": "hunting alone"}, {"_id": 3, "t": "quiet"}])
    rows = Collection(df).aggregate([{"$match": {"$text": {"$search": "hunt whales"}}}, {"$project": {"score": {"$meta": "textScore"}}}]).collect()
    assert {r._id: r.score for r in rows} == {1: 4.0, 2: 1.0}
    assert ids(Collection(df).find({"$text": {"$search": "hunt -whales"}})) == [2]


def test_shapes(spark):
    square = {"$geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [2, 1], [2, 2], [1, 2]]]}}
    df = from_documents(spark, [{"_id": i, "loc": [float(x), float(y)]} for i, (x, y) in enumerate([(3, 3), (1.5, 1.5), (5, 1)])])
    c = Collection(df)
    assert ids(c.find({"loc": {"$geoWithin": square}})) == [0]
    assert ids(c.find({"loc": {"$geoWithin": {"$box": [[0, 0], [2, 2]]}}})) == [1]
    assert ids(c.find({"loc": {"$near": {"$geometry": {"coordinates": [3, 3]}, "$maxDistance": 1000}}})) == [0]


@pytest.mark.parametrize("how", [{"N": 3}, {"alpha": 0.9}, {"alpha": 0.02}, {"N": 1}])
def test_moving_average_of_many_blocks(spark, monkeypatch, how):
    monkeypatch.setattr("docmill.operators.windows.SPREAD", 1e6)
    rows = [(i, i % 2, None if i % 7 in (0, 1) else float((i * 37) % 101 - 50)) for i in range(900)]
    rows += [(1000 + i, 2, float("inf") if i == 20 else 1.0) for i in range(400)] + [(2000, 3, None)]
    got = Collection(spark.createDataFrame(rows, "_id int, p int, v double")).aggregate(
        [{"$setWindowFields": {"partitionBy": "$p", "sortBy": {"_id": 1}, "output": {"e": {"$expMovingAvg": {"input": "$v"} | how}, "n": {"$documentNumber": {}}}}}]
    )
    assert got.columns == ["_id", "p", "v", "e", "n"]
    alpha, want = how.get("alpha") or 2 / (how["N"] + 1), {}
    for p in range(4):
        last = None
        for i, _, v in (r for r in rows if r[1] == p):
            if v is not None:
                last = v if last is None else v * alpha + (last * (1 - alpha) if alpha < 1 else 0.0)
            want[i] = float("inf") if p == 2 and i >= 1020 else last
    assert {r._id: r.e for r in got.collect()} == {i: e if e is None else pytest.approx(e, rel=1e-9, abs=1e-9) for i, e in want.items()}


def test_inventory():
    assert len(operator_names()) >= 138
    assert set(window_operator_names()) == {"$rank", "$denseRank", "$documentNumber", "$shift", "$expMovingAvg", "$derivative", "$integral", "$covariancePop", "$covarianceSamp", "$locf", "$linearFill"}
    assert {"$sum", "$avg", "$count", "$first", "$last", "$topN", "$bottomN", "$push", "$addToSet", "$mergeObjects", "$median", "$percentile"} <= set(accumulator_names())
    assert {"$match", "$group", "$lookup", "$graphLookup", "$facet", "$bucketAuto", "$setWindowFields", "$densify", "$fill", "$merge", "$out", "$redact", "$unionWith"} <= set(stage_names())


def test_graph_lookup_without_max_depth_follows_the_whole_chain(spark, monkeypatch):
    monkeypatch.setattr("docmill.operators.stages.MAX_DEPTH", 3, raising=False)
    nodes = spark.createDataFrame([(i, i + 1 if i < 19 else 0) for i in range(20)], "node int, next int")  # a ring
    starts = Collection(spark.createDataFrame([(5,)], "start int"), {"nodes": nodes})
    lookup = {"from": "nodes", "startWith": "$start", "connectFromField": "next", "connectToField": "node", "as": "path", "depthField": "depth"}
    for more, n in (({}, 20), ({"maxDepth": 2}, 3)):
        (row,) = starts.aggregate([{"$graphLookup": lookup | more}]).collect()
        assert sorted((d.depth, d.node) for d in row.path) == [(k, (5 + k) % 20) for k in range(n)]


def test_one_of_several_equal_rows_goes(spark):
    from docmill.plans.collection import Collection

    rows = Collection(spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "k int, s string"))
    left = lambda c: sorted((r.k, r.s) for r in c.df.collect())
    assert left(rows.delete({"k": 1}, limit=1)) == [(1, "a"), (1, "a"), (2, "b")]
    assert left(rows.delete({"k": 9}, limit=1)) == left(rows)
    assert left(rows.update({"k": 1}, {"$set": {"s": "z"}})) == [(1, "a"), (1, "a"), (1, "z"), (2, "b")]


def test_lookups_keep_repeated_rows(spark):
    from docmill.plans.collection import Collection

    foreign = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, v string")
    local = Collection(spark.createDataFrame([(1, [1, 2, 1]), (1, [1, 2, 1]), (2, None), (3, [])], "k int, ids array<int>"), {"f": foreign})
    got = local.aggregate([{"$lookup": {"from": "f", "localField": "ids", "foreignField": "id", "as": "out"}}]).collect()
    assert sorted((r.k, sorted(d.v for d in r.out)) for r in got) == [(1, ["x", "x", "y"]), (1, ["x", "x", "y"]), (2, []), (3, [])]
    pipeline = [{"$match": {"$expr": {"$eq": ["$id", "$$k"]}}}]
    got = local.aggregate([{"$lookup": {"from": "f", "let": {"k": "$k"}, "pipeline": pipeline, "as": "out"}}]).collect()
    assert sorted((r.k, [d.v for d in r.out]) for r in got) == [(1, ["x", "x"]), (1, ["x", "x"]), (2, ["y"]), (3, [])]


def test_lookup_pipelines_order_number_and_group_within_a_row(spark):
    from docmill.plans.collection import Collection

    foreign = spark.createDataFrame([(1, "x", 5), (1, "y", 7), (1, "x", 6), (2, "y", None), (None, "z", 1)], "id int, v string, n int")
    local = Collection(spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int"), {"f": foreign})

    def run(*stages):
        own = {"$match": {"$expr": {"$eq": ["$id", "$$k"]}}}
        rows = local.aggregate([{"$lookup": {"from": "f", "let": {"k": "$k"}, "pipeline": [own, *stages], "as": "out"}}]).collect()
        got = {r.k: [tuple(d) for d in r.out] for r in rows}
        assert len(rows) == 5 and got[3] == []
        return got

    assert run({"$sort": {"n": -1}}, {"$skip": 1}, {"$limit": 1}, {"$project": {"n": 1}}) == {1: [(6,)], 2: [], 3: [], None: []}
    assert run({"$sort": {"n": 1}}, {"$group": {"_id": None, "a": {"$first": "$n"}}})[1] == [(None, 5)]
    assert run({"$sortByCount": "$v"})[1] == [("x", 2), ("y", 1)]
    assert run({"$count": "c"})[1] == [(3,)]
    assert run({"$sort": {"n": 1}}, {"$limit": 1}, {"$replaceWith": {"all": "$$ROOT"}})[1][0][0].asDict() == {"id": 1, "v": "x", "n": 5}
    assert run({"$group": {"_id": {"v": "$v"}, "s": {"$sum": "$n"}}}, {"$match": {"s": {"$gt": 8}}})[1] == [(("x",), 11)]
    with pytest.raises(DocumentError) as e:
        run({"$facet": {"a": []}})
    assert e.value.code == 238


def test_sample_rates_and_picks_over_frames(spark):
    from docmill.plans.collection import Collection

    rows = Collection(spark.createDataFrame([(1, 3, "a"), (2, None, "b"), (3, 5, "c")], "k int, n int, s string"))
    assert (rows.find({"$sampleRate": 1}).count(), rows.find({"$sampleRate": 0}).count()) == (3, 0)
    for rate in (1.5, -1, "x", True):
        with pytest.raises(DocumentError):
            rows.find({"$sampleRate": rate})
    frame = {"window": {"documents": ["unbounded", "current"]}}
    output = {"top": {"$top": {"sortBy": {"n": -1, "s": 1}, "output": "$s"}, **frame}, "low": {"$bottomN": {"n": 2, "sortBy": {"n": -1}, "output": "$s"}, **frame}}
    got = rows.aggregate([{"$setWindowFields": {"sortBy": {"k": 1}, "output": output}}]).collect()
    assert sorted((r.k, r.top, r.low) for r in got) == [(1, "a", ["a"]), (2, "a", ["a", "b"]), (3, "c", ["a", "b"])]


def test_picks_over_frames_take_the_first_of_equal_keys(spark):
    from docmill.plans.collection import Collection

    rows = Collection(spark.createDataFrame([(k, 7, k % 2) for k in range(1, 9)], "k int, n int, m int"))
    frame = {"window": {"documents": [-2, 0]}}
    by = {"one": {"n": -1}, "up": {"n": 1}, "two": {"n": -1, "m": 1}}
    output = {f"{pick}_{b}": {f"${pick}": {"sortBy": sort, "output": "$k"}, **frame} for pick in ("top", "bottom") for b, sort in by.items()}
    output |= {f"{pick}_{b}_n": {f"${pick}N": {"n": 2, "sortBy": sort, "output": "$k"}, **frame} for pick in ("top", "bottom") for b, sort in by.items()}
    got = {r.k: r for r in rows.aggregate([{"$setWindowFields": {"sortBy": {"k": 1}, "output": output}}]).collect()}
    assert set(got[1].asDict()) == {"k", "n", "m", *output}
    assert [got[8][f"{pick}_{b}"] for pick in ("top", "bottom") for b in by] == [6, 6, 6, 6, 6, 7]
    assert [got[8][f"top_{b}_n"] for b in by] == [[6, 7], [6, 7], [6, 8]]
    assert [got[8][f"bottom_{b}_n"] for b in by] == [[7, 6], [7, 6], [6, 7]]
