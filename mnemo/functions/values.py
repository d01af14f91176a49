"""Property values (PV) and their text forms.

A memory's or connection's properties are a ``MAP<STRING, PV>`` where
``PV = STRUCT<kind, text, num, items, item_kind>``:

* ``kind``  -- 'string' | 'number' | 'boolean' | 'array'
* ``text``  -- the value's JavaScript ``toString()`` form, which is what
  search matches against (arrays: elements joined by one space)
* ``num``   -- the value as DOUBLE for numbers, else null
* ``items`` -- the elements of an array, as text, else null
* ``item_kind`` -- the kind of an array's elements (an array holds one
  scalar kind), so that ``[1, 2]`` and ``["1", "2"]`` stay apart

All helpers return Column expressions built from built-in functions, so
they stay inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PV_TYPE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("num", T.DoubleType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("item_kind", T.StringType()),
])
PROPS_TYPE = T.MapType(T.StringType(), PV_TYPE)
PV_DDL = "struct<kind:string,text:string,num:double,items:array<string>,item_kind:string>"
PROPS_DDL = f"map<string,{PV_DDL}>"

# Sort rank of each kind in ascending order (arrays first, numbers last,
# a missing value after everything).
KIND_RANK = {"array": 0, "string": 1, "boolean": 2, "number": 3}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_number_text(c) -> Column:
    """JavaScript ``Number.prototype.toString`` of a double.

    ``5.0 -> '5'``, ``1e7 -> '10000000'``, ``24.99 -> '24.99'``, ``1e-7 ->
    '1e-7'``, ``1e20 -> '100000000000000000000'``, ``1e21 -> '1e+21'``. The
    digits are those of the JVM's own text of the double; whole numbers and
    the range that the JVM prints plainly take shorter ways to the same text.
    """
    c = _col(c)
    size = F.abs(c)
    whole = (size < F.lit(1e15)) & (c == F.floor(c))
    plain = (size >= F.lit(1e-3)) & (size < F.lit(1e7))
    text = size.cast("string")
    mantissa = F.regexp_extract(text, r"^([0-9.]+)", 1)
    before = F.substring_index(mantissa, ".", 1)
    digits = F.regexp_replace(mantissa, r"\.", "")
    shown = F.regexp_replace(digits, r"^0+|0+$", "")
    exponent = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    leading = F.length(digits) - F.length(F.regexp_replace(digits, r"^0+", ""))
    # the value is 0.<shown> * 10**point
    point = F.length(before) + exponent - leading
    count = F.length(shown)
    first = F.substring(shown, 1, 1)
    rest = shown.substr(F.lit(2), F.greatest(count - 1, F.lit(0)))
    power = point - 1
    scientific = F.concat(first, F.when(count > 1, F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"),
                          F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))
    general = (F.when((count <= point) & (point <= 21), F.rpad(shown, point, "0"))
               .when((point > 0) & (point <= 21), F.concat(shown.substr(F.lit(1), point), F.lit("."),
                                                           shown.substr(point + 1, count)))
               .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), shown))
               .otherwise(scientific))
    sign = F.when(c < 0, "-").otherwise("")
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(c), "NaN").when(size == float("inf"), F.concat(sign, F.lit("Infinity")))
            .when(whole, c.cast("bigint").cast("string"))
            .when(plain, c.cast("string"))
            .otherwise(F.concat(sign, general)))


def _no_items() -> list[Column]:
    return [F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("string").alias("item_kind")]


def pv_string(c) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.struct(
        F.lit("string").alias("kind"), c.cast("string").alias("text"),
        F.lit(None).cast("double").alias("num"),
        *_no_items()))


def pv_number(c) -> Column:
    c = _col(c).cast("double")
    return F.when(c.isNotNull(), F.struct(
        F.lit("number").alias("kind"), js_number_text(c).alias("text"),
        c.alias("num"), *_no_items()))


def pv_boolean(c) -> Column:
    c = _col(c).cast("boolean")
    return F.when(c.isNotNull(), F.struct(
        F.lit("boolean").alias("kind"), c.cast("string").alias("text"),
        F.lit(None).cast("double").alias("num"),
        *_no_items()))


def pv_array(c, item_kind: str = "string") -> Column:
    """An array of scalars of one kind. Numbers are given as doubles, other
    kinds as text; null elements print as ''."""
    c = _col(c)
    c = F.transform(c.cast("array<double>"), js_number_text) if item_kind == "number" else c.cast("array<string>")
    text = F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), " ")
    return F.when(c.isNotNull(), F.struct(
        F.lit("array").alias("kind"), text.alias("text"),
        F.lit(None).cast("double").alias("num"), c.alias("items"),
        F.when(F.size(c) > 0, F.lit(item_kind)).alias("item_kind")))


def props_map(*pairs: tuple[str, Column], inputs: list[Column] | None = None) -> Column:
    """Build a property map from (key, PV column) pairs; null values are
    left out, as a null property is never stored.

    A filter takes its map, and all that the map is computed from, out of
    whole-stage code generation. ``inputs`` names the columns of which one
    is null wherever a value is null: rows in which none is need no filter."""
    if not pairs:
        return F.create_map().cast(PROPS_DDL)
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), v]
    filtered = F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull())
    if not inputs:
        return filtered
    return F.when(reduce(Column.__and__, [c.isNotNull() for c in inputs]), F.create_map(*flat)).otherwise(filtered)


def null_pv() -> Column:
    """A typed null property value (in an update: remove the key)."""
    return F.lit(None).cast(PV_DDL)


def empty_props() -> Column:
    return F.create_map().cast(PROPS_DDL)


def search_text(props) -> Column:
    """Lower-cased text of all property values, one value per line.

    A query word never holds whitespace, so "some property contains the
    word" is the same as "this text contains the word".
    """
    props = _col(props)
    return F.lower(F.concat_ws("\n", F.transform(F.map_values(props), lambda v: v["text"])))


def is_falsy(pv) -> Column:
    """JavaScript falsiness of a stored value: missing, '', 0 or false
    (NaN too). Arrays are never falsy."""
    pv = _col(pv)
    return (pv.isNull()
            | ((pv["kind"] == "string") & (pv["text"] == ""))
            | ((pv["kind"] == "number") & ((pv["num"] == 0) | F.isnan(pv["num"])))
            | ((pv["kind"] == "boolean") & (pv["text"] == "false")))


def sort_values(pv) -> list[Column]:
    """The values that a property with mixed types is compared by, in turn:
    rank of its kind, array, text, number (null where they do not apply)."""
    pv = _col(pv)
    rank = F.when(pv.isNull(), F.lit(None).cast("int"))
    for kind, r in KIND_RANK.items():
        rank = rank.when(pv["kind"] == kind, F.lit(r))
    number = pv["item_kind"] == "number"
    item_rank = F.when(number, KIND_RANK["number"]).when(pv["item_kind"] == "boolean", KIND_RANK["boolean"]).otherwise(KIND_RANK["string"])
    return [
        rank,
        F.when(pv["kind"] == "array", F.transform(pv["items"], lambda x: F.struct(
            item_rank.alias("rank"), F.when(number, F.lit(None)).otherwise(x).alias("text"),
            F.when(number, x.try_cast("double")).alias("num")))),
        F.when(pv["kind"].isin("string", "boolean"), pv["text"]),
        F.when(pv["kind"] == "number", pv["num"]),
    ]


def order_keys(pv, descending: bool) -> list[Column]:
    """Sort keys for a property value with mixed types.

    Ascending: arrays < strings < booleans < numbers < missing; descending
    is the exact reverse, so a missing value comes first. Arrays compare
    element by element by the same rules (numbers as numbers), a shorter
    array before a longer one that begins with it.
    """
    if descending:
        return [k.desc_nulls_first() for k in sort_values(pv)]
    return [k.asc_nulls_last() for k in sort_values(pv)]
