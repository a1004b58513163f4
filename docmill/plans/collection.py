"""Collections: the commands over one DataFrame of documents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from docmill.errors import DocumentError, bad_value
from docmill.functions import values as V
from docmill.functions.expressions import needs_whole
from docmill.functions.paths import Scope, resolve
from docmill.operators import shaping, updates
from docmill.operators.filters import compile_filter, definite
from docmill.operators.stages import Context, run_pipeline, sort as sort_stage

FIRST_PAGE = 101


class Collection:
    """Commands on the documents of a DataFrame. Queries give DataFrames, writes the new collection."""

    def __init__(self, df: DataFrame, collections: dict[str, DataFrame] | None = None):
        self.df = df
        self._others = {} if collections is None else collections

    def context(self, let: dict | None = None, flatten_id: bool = False) -> Context:
        def other(name: str) -> DataFrame:
            if name not in self._others:
                raise DocumentError(73, f"no collection named {name!r}")
            return self._others[name]

        kinds = {k: (V.literal(v), self.df.sparkSession.range(1).select(V.literal(v).alias("x")).schema[0].dataType) for k, v in (let or {}).items()}
        return Context(self.df.sparkSession, other, kinds, flatten_id=flatten_id)

    def aggregate(self, pipeline: list[dict], *, let: dict | None = None, flatten_id: bool = False) -> DataFrame:
        return run_pipeline(self.df, pipeline, self.context(let, flatten_id))

    def find(self, filter: dict | None = None, projection: dict | None = None, *, sort: dict | None = None, skip: int = 0, limit: int = 0, let: dict | None = None, show_record_id: bool = False) -> DataFrame:
        """Filter, sort, skip, limit (0: none), projection. The positional path.$ and $elemMatch / $slice are allowed in it."""
        context = self.context(let)
        df, query = self.df, filter or {}
        if show_record_id:
            df = df.withColumn("$recordId", F.monotonically_increasing_id())
        df = run_pipeline(df, [{"$match": query}], context) if query else df
        if sort:
            df = sort_stage(df, sort, context)
        if skip:
            df = df.offset(needs_whole(skip, "skip", 0))
        if needs_whole(limit, "limit", 0):
            df = df.limit(int(limit))
        return _projected(df, projection, query, context) if projection else df

    def count(self, query: dict | None = None, *, skip: int = 0, limit: int = 0) -> DataFrame:
        """One row with n; an empty collection counts 0."""
        return self.find(query, skip=skip, limit=limit).agg(F.count(F.lit(1)).alias("n"))

    def distinct(self, key: str, query: dict | None = None) -> DataFrame:
        """The distinct values of a path, elements of arrays one by one; missing ones don't count."""
        if not isinstance(key, str) or not key:
            raise DocumentError(14, "distinct needs the name of a field")
        df = self.find(query)
        column, kind = resolve(Scope(df), key)
        while isinstance(kind, T.ArrayType):
            df = df.select(F.explode(column).alias("value"))
            column, kind = F.col("value"), kind.elementType
        return df.select(column.alias("value")).filter("value IS NOT NULL").distinct()

    def explain(self, pipeline: list[dict]) -> str:
        return self.aggregate(pipeline)._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def pages(self, df: DataFrame, batch_size: int = FIRST_PAGE) -> Iterator[list[Row]]:
        """The rows of a query page by page, without gathering them all."""
        if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size < 0:
            raise DocumentError(51024, f"BSON field 'batchSize' value must be >= 0, actual value '{batch_size}'")
        page: list[Row] = []
        for row in df.toLocalIterator(prefetchPartitions=True):
            page.append(row)
            if len(page) == max(batch_size, 1):
                yield page
                page = []
        if page:
            yield page

    # --- writes ---

    def _replaced(self, df: DataFrame) -> Collection:
        return Collection(df, self._others)

    def insert(self, documents: DataFrame | list[dict]) -> Collection:
        from docmill.sources.documents import from_documents

        new = documents if isinstance(documents, DataFrame) else from_documents(self.df.sparkSession, documents)
        return self._replaced(self.df.unionByName(new, allowMissingColumns=True))

    def update(self, query: dict, update: dict | list, *, multi: bool = False, upsert: bool = False, sort: dict | None = None, array_filters: list[dict] | None = None) -> Collection:
        return self._replaced(updates.update(self.df, query, update, self.context(), multi=multi, upsert=upsert, sort=sort, array_filters=array_filters or []))

    def update_many(self, query: dict, update: dict | list, **options: object) -> Collection:
        return self.update(query, update, multi=True, **options)

    def replace_one(self, query: dict, document: dict, *, upsert: bool = False) -> Collection:
        if any(k.startswith("$") for k in document):
            raise bad_value("the replacement document must not contain update operators")
        return self.update(query, document, upsert=upsert)

    def delete(self, query: dict, *, limit: int = 0, sort: dict | None = None) -> Collection:
        """Without the matching documents: all of them (limit 0) or the first (limit 1)."""
        if limit not in (0, 1):
            raise DocumentError(9, "The limit field in delete objects must be 0 or 1")
        hit = definite(compile_filter(query, Scope(self.df)))
        if not limit:
            return self._replaced(self.df.filter(~hit))
        return self._replaced(updates.marked_one(self.df, hit, sort).filter("NOT _one").drop("_one"))

    def find_and_modify(self, query: dict, *, update: dict | list | None = None, remove: bool = False, new: bool = False, sort: dict | None = None, fields: dict | None = None, upsert: bool = False) -> tuple[DataFrame, Collection]:
        """(the document before, or after if new, the changed collection)."""
        if remove == (update is not None):
            raise DocumentError(9, "Either an update or remove=true must be specified")
        if remove and new:
            raise DocumentError(9, "Cannot specify both new=true and remove=true; 'remove' always returns the deleted document")
        context = self.context()
        marked = updates.marked_one(self.df, compile_filter(query, Scope(self.df)), sort)
        before = marked.filter("_one").drop("_one")
        if remove:
            shown, after = before, self._replaced(marked.filter("NOT _one").drop("_one"))
        else:
            changed = updates.changed(marked, F.col("_one"), update, context, [])
            if upsert:
                changed = updates.with_upsert(changed, before, query, update, context)
            after = self._replaced(changed.drop("_one"))
            shown = changed.filter("_one").drop("_one") if new else before
        return (_projected(shown, fields, query, context) if fields else shown), after

    def create_unique_index(self, *paths: str) -> Collection:
        """Check that no two documents agree on all paths."""
        scope = Scope(self.df)
        keys = [resolve(scope, p)[0].alias(f"k{i}") for i, p in enumerate(paths)]
        if not self.df.select(*keys).groupBy(*[f"k{i}" for i in range(len(paths))]).count().filter("count > 1").isEmpty():
            raise DocumentError(11000, f"duplicate key error on {', '.join(paths)}")
        return self


def _projected(df: DataFrame, projection: dict, query: dict, context: Context) -> DataFrame:
    """A find projection; its own operators become computed fields."""
    scope, special, plain = context.scope(df), {}, {}
    for key, value in projection.items():
        if key.endswith(".$"):
            if len(key.split(".")) > 2 or any(k.endswith(".$") for k in special):
                raise DocumentError(31276, "Cannot specify more than one positional projection per query.")
            special[key[:-2]] = shaping.positional(df, key[:-2], query, scope)
        elif isinstance(value, dict) and "$slice" in value:
            special[key] = _slice(resolve(scope, key)[0], value["$slice"])
        elif isinstance(value, dict) and "$elemMatch" in value:
            special[key] = shaping.positional(df, key, {key: value}, scope)
        else:
            plain[key] = value
    only_slices = special and all(isinstance(v, dict) and "$slice" in v for k, v in projection.items() if k.removesuffix(".$") in special)
    if special:
        df = df.withColumns(special)
        if only_slices and not any(shaping._flag(v) for v in plain.values()):
            return shaping.project(df, plain, context.scope(df), find=True)
        plain |= {k: True for k in special}
    return shaping.project(df, plain, context.scope(df), find=True)


def _slice(column: Column, spec: object) -> Column:
    size = F.size(column)
    if isinstance(spec, (list, tuple)):
        skip, n = spec
        start = F.lit(skip) if skip >= 0 else F.greatest(size + skip, F.lit(0))
        return F.slice(column, start + 1, F.lit(n))
    if spec >= 0:
        return F.slice(column, 1, spec)
    return F.slice(column, F.greatest(size + spec, F.lit(0)) + 1, F.lit(-spec))


class Database:
    """Named collections of a session: create, drop, rename, list, and the commands by name."""

    def __init__(self, spark: SparkSession, collections: dict[str, DataFrame] | None = None):
        self.spark, self._tables = spark, dict(collections or {})
        self._indexes: dict[str, dict[str, dict]] = {}

    def __getitem__(self, name: str) -> Collection:
        if name not in self._tables:
            raise DocumentError(73, f"no collection named {name!r}")
        return Collection(self._tables[name], self._tables)

    def create(self, name: str, df: DataFrame | None = None, *, view_on: str | None = None, pipeline: list[dict] | None = None) -> Collection:
        if not name or "$" in name or "\0" in name or name.startswith((".", "system.")):
            raise DocumentError(73, f"Invalid collection name: {name}")
        if name in self._tables:
            raise DocumentError(48, f"Collection {name} already exists.")
        if view_on is not None:
            df = self[view_on].aggregate(pipeline or [])
        self._tables[name] = df if df is not None else self.spark.createDataFrame([], T.StructType([]))
        return self[name]

    def drop(self, name: str) -> bool:
        self._indexes.pop(name, None)
        return self._tables.pop(name, None) is not None

    def drop_database(self) -> None:
        self._tables.clear()
        self._indexes.clear()

    def rename(self, name: str, to: str, *, drop_target: bool = False) -> None:
        if name not in self._tables:
            raise DocumentError(26, f"Source collection {name} does not exist")
        if to in self._tables and not drop_target:
            raise DocumentError(48, "target namespace exists")
        self._tables[to] = self._tables.pop(name)

    def list_collections(self, filter: dict | None = None, *, name_only: bool = False) -> DataFrame:
        rows = [(n, "collection", len(df.columns)) for n, df in sorted(self._tables.items())]
        df = self.spark.createDataFrame(rows, "name string, type string, fields int")
        df = df.filter(compile_filter(filter, Scope(df))) if filter else df
        return df.select("name", "type") if name_only else df

    def create_indexes(self, name: str, indexes: list[dict]) -> int:
        """Declare indexes. They order nothing at run time; unique ones are checked, options are validated."""
        known = self._indexes.setdefault(name, {"_id_": {"key": {"_id": 1}}})
        for index in indexes:
            key = index.get("key")
            if not isinstance(key, dict) or not key:
                raise DocumentError(67, "an index needs a key document")
            for direction in key.values():
                if direction not in (1, -1, "text", "2d", "2dsphere", "hashed", "cosmosSearch"):
                    raise DocumentError(67, f"Values in the index key pattern can't be {direction!r}")
            if "text" in key.values() and any("text" in i["key"].values() for i in known.values()):
                raise DocumentError(67, "only one text index per collection allowed")
            if "cosmosSearch" in key.values():
                from docmill.operators.search import check_vector_index

                check_vector_index(index.get("cosmosSearchOptions", {}))
            if index.get("unique"):
                self[name].create_unique_index(*key)
            known[index.get("name") or "_".join(f"{k}_{v}" for k, v in key.items())] = index
        return len(known)

    def list_indexes(self, name: str) -> DataFrame:
        known = self._indexes.get(name, {"_id_": {"key": {"_id": 1}}})
        rows = [(n, ",".join(f"{k}:{v}" for k, v in i["key"].items()), bool(i.get("unique")), i.get("expireAfterSeconds")) for n, i in known.items()]
        return self.spark.createDataFrame(rows, "name string, key string, unique boolean, expireAfterSeconds long")

    def drop_indexes(self, name: str, index: str | list[str] = "*") -> None:
        known = self._indexes.get(name, {})
        for n in [x for x in known if x != "_id_"] if index == "*" else [index] if isinstance(index, str) else index:
            if n == "_id_":
                raise DocumentError(72, "cannot drop _id index")
            if known.pop(n, None) is None:
                raise DocumentError(27, f"index not found with name [{n}]")

    def unexpired(self, name: str) -> Collection:
        """The collection as its TTL indexes leave it now."""
        df = self._tables[name]
        for index in self._indexes.get(name, {}).values():
            if index.get("expireAfterSeconds") is not None:
                column, kind = resolve(Scope(df), next(iter(index["key"])))
                if V.value_class(kind) == "date":
                    df = df.filter(column.isNull() | (column + F.make_dt_interval(secs=F.lit(index["expireAfterSeconds"])) > F.current_timestamp()))
        return Collection(df, self._tables)

    def stats(self) -> DataFrame:
        sizes = [(n, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))) for n, df in self._tables.items()]
        return self.spark.createDataFrame([(len(sizes), sum(s for _, s in sizes))], "collections int, dataSize long")

    def run_command(self, command: dict) -> DataFrame | Collection | int | None:
        """A command document: the first key names it."""
        name, target = next(iter(command.items()))
        args = {k: v for k, v in command.items() if k not in (name, "$db", "lsid")}
        if name == "find":
            df = self[target].find(args.get("filter"), args.get("projection"), sort=args.get("sort"), skip=args.get("skip", 0), limit=args.get("limit", 0), let=args.get("let"))
            return df
        if name == "aggregate":
            if "cursor" not in args and not args.get("explain"):
                raise DocumentError(9, "The 'cursor' option is required, except for aggregate with the explain argument")
            base = Collection(self.spark.range(1).select(), self._tables) if target == 1 else self[target]
            return base.aggregate(args["pipeline"], let=args.get("let"))
        if name == "count":
            return self[target].count(args.get("query"), skip=args.get("skip", 0), limit=args.get("limit", 0))
        if name == "distinct":
            return self[target].distinct(args["key"], args.get("query"))
        if name == "insert":
            self._tables[target] = (self[target] if target in self._tables else Collection(self.spark.createDataFrame([], T.StructType([])))).insert(args["documents"]).df
            return len(args["documents"])
        if name == "update":
            for u in args["updates"]:
                self._tables[target] = self[target].update(u["q"], u["u"], multi=u.get("multi", False), upsert=u.get("upsert", False), array_filters=u.get("arrayFilters")).df
            return None
        if name == "delete":
            for d in args["deletes"]:
                self._tables[target] = self[target].delete(d["q"], limit=d["limit"]).df
            return None
        if name in ("findAndModify", "findandmodify"):
            shown, after = self[target].find_and_modify(args.get("query", {}), update=args.get("update"), remove=args.get("remove", False), new=args.get("new", False), sort=args.get("sort"), fields=args.get("fields"), upsert=args.get("upsert", False))
            self._tables[target] = after.df
            return shown
        if name == "create":
            return self.create(target, view_on=args.get("viewOn"), pipeline=args.get("pipeline"))
        if name == "drop":
            self.drop(target)
            return None
        if name == "dropDatabase":
            return self.drop_database()
        if name == "renameCollection":
            return self.rename(target.split(".")[-1], args["to"].split(".")[-1], drop_target=args.get("dropTarget", False))
        if name == "listCollections":
            return self.list_collections(args.get("filter"), name_only=args.get("nameOnly", False))
        if name == "listDatabases":
            return self.spark.sql("SHOW DATABASES")
        if name == "createIndexes":
            return self.create_indexes(target, args["indexes"])
        if name == "listIndexes":
            return self.list_indexes(target)
        if name == "dropIndexes":
            return self.drop_indexes(target, args.get("index", "*"))
        if name == "reIndex":
            return self.list_indexes(target)
        if name in ("collStats", "dataSize"):
            return self[target].aggregate([{"$collStats": {"storageStats": {"scale": args.get("scale", 1)}}}])
        if name in ("dbStats", "dbstats"):
            return self.stats()
        if name == "validate":
            return self[target].count()
        if name == "explain":
            inner = command["explain"]
            kind, coll = next(iter(inner.items()))
            if kind not in ("aggregate", "find", "count"):
                raise DocumentError(238, f"explain of {kind}")
            df = self.run_command({**inner, "cursor": {}} if kind == "aggregate" else inner)
            text = df._jdf.queryExecution().toString()
            return self.spark.createDataFrame([(text,)], "plan string")
        if name in ("ping", "hello", "buildInfo", "authenticate", "bulkWrite", "connPoolStats"):
            raise DocumentError(238, f"{name} belongs to a server; this is a library")
        raise DocumentError(59, f"no such command: '{name}'")
