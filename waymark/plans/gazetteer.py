"""The hierarchy of address objects: types, ancestor paths, leaf flags, index order, formatting.

``objects`` everywhere: code bigint, typ int, name string, super_code bigint, zip_code
string, lat and long decimal(10,3), atvk string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import text
from waymark.plans.store import Scratch

# Object types, with their order in the index and in a written address.
PIL, NOV, PAG, CIE, IEL, NLT, DZI = 104, 113, 105, 106, 107, 108, 109
INDEX_ORDER = {NOV: 1, PIL: 2, PAG: 3, CIE: 4, IEL: 5, NLT: 6, DZI: 7}
WRITTEN_ORDER = {IEL: 0, NLT: 1, DZI: 2, CIE: 3, PIL: 4, PAG: 5, NOV: 6}
SHORT = {PIL: "pil", NOV: "nov", PAG: "pag", CIE: "cie", IEL: "iel", NLT: "nlt", DZI: "dzv"}
BIG = (PIL, NOV, PAG, CIE)
POSTAL = (NLT, DZI)
MAX_DEPTH = 7


def by_type(values: dict[int, int], typ: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(typ == k, F.lit(v)).otherwise(out)
    return out


def known_types(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("typ").isin(*SHORT))


def with_paths(objects: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """Adds ``path``: the object and its ancestors, itself first, at most MAX_DEPTH; one row an object.

    The parents of all objects, then the parents of these, and so on are written, each time the fewer; from the top down one
    join a level gives them their parents' paths, and the last one gives all objects theirs.  Only rows with a parent go
    up, so those without one do not meet in one task.  Up to ``most_broadcast`` parents of a level are broadcast; more are
    shuffled, where AQE splits a parent of very many.  Of several objects with a parent's code the one of the highest type counts.
    """
    node = F.struct("code", "typ", "name", "super_code", "zip_code", "lat", "long", "atvk")
    scratch = Scratch(objects.sparkSession, "paths")
    place = F.coalesce(by_type(INDEX_ORDER, F.col("typ")), F.lit(len(INDEX_ORDER) + 1))
    levels, sizes = [], []
    for n in range(MAX_DEPTH - 1):
        below = levels[-1].select("_node.super_code") if levels else objects.select("super_code")
        named = below.where("super_code is not null").select(F.col("super_code").alias("_own")).distinct()
        if levels:
            own = levels[-1].join(F.broadcast(named) if sizes[-1] <= most_broadcast else named, "_own", "left_semi")
        else:
            own = objects.join(named, F.col("code") == F.col("_own"), "left_semi").groupBy(F.col("code").alias("_own")).agg(F.min(F.struct(place.alias("place"), node.alias("node"))).alias("best")).select("_own", F.col("best.node").alias("_node"))
        own = scratch.table(own, f"level{n}")
        size = own.count()
        if not size:
            break
        levels.append(own)
        sizes.append(size)
    above = None
    for own, size in zip(reversed(levels), reversed(sizes), strict=True):
        rows = own.select("_own", F.array("_node").alias("_path"), F.col("_node.super_code").alias("_next"))
        if above is not None:
            rows = rows.join(above.select(F.col("_own").alias("_up"), F.col("_path").alias("_rest")), F.col("_next") == F.col("_up"), "left")
            rows = rows.select("_own", F.when(F.col("_rest").isNull(), F.col("_path")).otherwise(F.concat("_path", "_rest")).alias("_path"))
        above = F.broadcast(rows.select("_own", "_path")) if size <= most_broadcast else rows.select("_own", "_path").hint("merge")
    own = F.array(node)
    if above is None:
        return objects.withColumn("path", own)
    out = objects.join(above, F.col("super_code") == F.col("_own"), "left")
    return out.withColumn("path", F.when(F.col("_path").isNull(), own).otherwise(F.concat(own, "_path"))).drop("_own", "_path")


def with_leaf_flag(objects: DataFrame) -> DataFrame:
    """Adds ``is_leaf``: no object names this one as its parent."""
    parents = objects.where("super_code is not null").select(F.col("super_code").alias("_parent")).distinct()
    return objects.join(parents, F.col("code") == F.col("_parent"), "left").withColumn("is_leaf", F.col("_parent").isNull()).drop("_parent")


def depth(path: Column) -> Column:
    return F.size(path)


def full_name(path: Column) -> Column:
    """Names from the root down."""
    return F.array_join(F.reverse(F.transform(path, lambda o: o["name"])), " ")


def named_path(path: Column) -> Column:
    """What names, addresses and written orders read of a path."""
    return F.transform(path, lambda o: F.struct(o["typ"].alias("typ"), o["name"].alias("name")))


def index_strings(paths: DataFrame, history: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """idx, code, text: every object's full name and past names, numbered in index order; columns in ``more``, none of them named w, n, key or name, stay.

    Order: type and depth, length of the folded name, the folded name, code, position.
    A city without a parent comes first.
    """
    lone_city = (F.col("typ") == PIL) & (F.size("path") == 1)
    weight = F.when(lone_city, 0).otherwise(by_type(INDEX_ORDER, F.col("typ"))) * 100 + F.size("path")
    rows = paths.select("code", weight.alias("w"), full_name(F.col("path")).alias("name"), *more)
    texts = F.array("name")
    if history is not None:
        past = history.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda h: h["text"]).alias("past"))
        rows = rows.join(past, "code", "left")
        texts = F.concat(texts, F.coalesce("past", F.array().cast("array<string>")))
    key = text.unaccent(F.col("name"))
    return number(rows, {"w": F.col("w"), "n": F.length(key), "key": key, "code": F.col("code")}, "idx", out=[F.col("code"), F.explode(texts).alias("text"), *more]).select("idx", "code", "text", *more)


def number(rows: DataFrame, order: list[str] | dict[str, Column], name: str, scratch: Scratch | None = None, out: list[Column] | None = None) -> DataFrame:
    """The rows, or their columns ``out``, and a dense number from 0 in the order of columns that tell all rows apart.

    Rows are dealt by ranges of the whole order, so no task gets a share that grows with a key, spread where ``out``
    explodes a column, counted where they are and written; the parts' sizes, a row each, shift the numbers within them.  Columns that the order
    defines are made after the rows are dealt, so the shuffle carries only what they are made of.
    """
    scratch = scratch or Scratch(rows.sparkSession, "number")
    order = order if isinstance(order, dict) else {c: F.col(c) for c in order}
    placed = rows.repartitionByRange(*order.values()).withColumns(order).sortWithinPartitions(*order).select(*(out or rows.columns))
    dealt = scratch.table(placed.withColumn("_at", F.monotonically_increasing_id()), "dealt")
    # The upper bits are the part, the lower 33 the place in it.
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = dealt.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return counted.withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("_at", "_before", "_part")


def inherited(path: Column, field: str) -> Column:
    """The nearest value of a field, the object's own first."""
    return F.get(F.filter(F.transform(path, lambda o: o[field]), lambda x: x.isNotNull()), F.lit(0))


def of_type(path: Column, typ: int) -> Column:
    """The path's object of a type, the highest if there are several."""
    return F.try_element_at(F.filter(path, lambda o: o["typ"] == typ), F.lit(-1))


def in_written_order(path: Column) -> Column:
    """One object a type, in the order of a written address."""
    slots = F.array(*[of_type(path, t) for t in sorted(WRITTEN_ORDER, key=WRITTEN_ORDER.get)])
    return F.filter(slots, lambda o: o.isNotNull())


def format_address(path: Column) -> Column:
    """street building - flat, then village, city, parish and municipality, a line each."""
    name = {t: of_type(path, t)["name"] for t in SHORT}
    first = F.concat(F.coalesce(F.concat_ws(" ", name[IEL], name[NLT]), F.lit("")), F.coalesce(F.concat(F.lit(" - "), name[DZI]), F.lit("")))
    return F.concat_ws("\n", F.when(first != "", first), name[CIE], name[PIL], name[PAG], name[NOV])


def address(paths: DataFrame, fields: tuple[str, ...] = ("struct", "lks_koord", "history", "atvk"), history: DataFrame | None = None) -> DataFrame:
    """The answer record of every object; ``fields`` names the groups that it has."""
    path = F.col("path")
    out = [F.col("code"), F.col("typ"), format_address(path).alias("address"), F.col("is_leaf").alias("irAdrese"), inherited(path, "zip_code").alias("zipCode")]
    if "lks_koord" in fields:
        out += [inherited(path, "lat").alias("lksLat"), inherited(path, "long").alias("lksLong")]
    if "struct" in fields:
        out += [of_type(path, t)[f].alias(f"{SHORT[t]}{n}") for t in SHORT for f, n in (("code", "Code"), ("name", "Name"))]
    if "atvk" in fields:
        out += [of_type(path, t)["atvk"].alias(f"{SHORT[t]}Atvk") for t in (PIL, NOV, PAG)]
    rows = paths
    if "history" in fields and history is not None:
        past = history.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda h: h["text"]).alias("history"))
        rows = rows.join(past, "code", "left")
        out.append(F.coalesce("history", F.array().cast("array<string>")).alias("history"))
    return rows.select(*out)


def is_post_address(leaf: Column, typ: Column) -> Column:
    return leaf & typ.isin(*POSTAL)


def synthetic(spark, sf_dir: str) -> DataFrame:
    """Objects made of the driver's tables, which have no address.

    region: municipality, nation: parish, supplier: village, customer: building,
    orders: flat; codes are the type's number and a key of six digits.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "supplier", "customer", "orders")}
    code = lambda typ, key: (F.lit(typ).cast("bigint") * 1_000_000 + F.col(key)).alias("code")
    up = lambda typ, key: (F.lit(typ).cast("bigint") * 1_000_000 + F.col(key)).alias("super_code")
    none = lambda kind: F.lit(None).cast(kind)
    point = lambda key, base: (F.lit(base) + F.col("c_acctbal")).cast("decimal(10,3)").alias(key)
    blank = [none("string").alias("zip_code"), none("decimal(10,3)").alias("lat"), none("decimal(10,3)").alias("long")]
    parts = [
        t["region"].select(code(NOV, "r_regionkey"), F.lit(NOV).alias("typ"), F.col("r_name").alias("name"), none("bigint").alias("super_code"), *blank, F.concat(F.lit("A"), "r_regionkey").alias("atvk")),
        t["nation"].select(code(PAG, "n_nationkey"), F.lit(PAG).alias("typ"), F.col("n_name").alias("name"), up(NOV, "n_regionkey"), *blank, F.concat(F.lit("B"), "n_nationkey").alias("atvk")),
        t["supplier"].select(code(CIE, "s_suppkey"), F.lit(CIE).alias("typ"), F.col("s_name").alias("name"), up(PAG, "s_nationkey"), *blank, none("string").alias("atvk")),
        t["customer"].select(code(NLT, "c_custkey"), F.lit(NLT).alias("typ"), F.col("c_name").alias("name"), up(PAG, "c_nationkey"), F.col("c_mktsegment").alias("zip_code"), point("lat", 300_000), point("long", 500_000), none("string").alias("atvk")),
        t["orders"].select(code(DZI, "o_orderkey"), F.lit(DZI).alias("typ"), F.col("o_orderpriority").alias("name"), up(NLT, "o_custkey"), *blank, none("string").alias("atvk")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
