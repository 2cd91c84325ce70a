"""Scalar functions of the query language as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.lexer import QueryError

Type = T.DataType | None
_STRING, _LONG, _DOUBLE, _BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


class Missing(T.StringType):
    """The type of a property that no table has: null, of whatever type is needed beside it."""

    @classmethod
    def typeName(cls) -> str:
        return "string"


def literal(value: object) -> tuple[Column, Type]:
    if value is None:
        return F.lit(None), T.NullType()
    if isinstance(value, bool):
        return F.lit(value), _BOOL
    if isinstance(value, int):
        return F.lit(value).cast("long"), _LONG
    if isinstance(value, float):
        return F.lit(value).cast("double"), _DOUBLE
    if isinstance(value, (list, tuple)):
        items = [literal(x) for x in value]
        kind = common([t for _, t in items])
        return F.array(*[c.cast(kind) for c, _ in items]).cast(T.ArrayType(kind)), T.ArrayType(kind)
    if isinstance(value, dict):
        items = {k: literal(v) for k, v in value.items()}
        return F.struct(*[c.alias(k) for k, (c, _) in items.items()]), T.StructType([T.StructField(k, t) for k, (_, t) in items.items()])
    return F.lit(value), T._infer_type(value)


def common(types: list[Type]) -> T.DataType:
    """One type for values of several: numbers widen, anything else becomes a string."""
    kinds = {t.simpleString(): t for t in types if t is not None and not isinstance(t, (T.NullType, Missing))}
    if len(kinds) <= 1:
        return next(iter(kinds.values()), _STRING)
    if all(isinstance(t, T.NumericType) for t in kinds.values()):
        return _DOUBLE if any(isinstance(t, T.FractionalType) for t in kinds.values()) else _LONG
    return _STRING


def is_list(t: Type) -> bool:
    return isinstance(t, T.ArrayType)


def _same(f: Callable[..., Column], kind: Type = None):
    return lambda args, types: (f(*args), kind or types[0])


def _number(c: Column, t: Type, kind: str) -> Column:
    return c.cast(kind) if isinstance(t, (T.NumericType, T.BooleanType)) else c.try_cast(kind)


def _integer(args, types):
    if isinstance(types[0], T.StringType):
        # digits after a point are cut off
        return args[0].try_cast("double").try_cast("long"), _LONG
    return _number(args[0], types[0], "long"), _LONG


def _boolean(args, types):
    text = F.lower(args[0].cast("string"))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False), _BOOL


def _size(args, types):
    c, t = args[0], types[0]
    if is_list(t):
        return F.when(c.isNotNull(), F.size(c)).cast("long"), _LONG
    if isinstance(t, T.MapType):
        return F.cardinality(c).cast("long"), _LONG
    return F.length(c).cast("long"), _LONG


def _range(args, types):
    a, b = args[0], args[1]
    step = F.coalesce(F.nullif(args[2], F.lit(0)), F.lit(1)) if len(args) > 2 else F.lit(1)
    step = step.cast("long")
    ok = ((step > 0) & (a <= b)) | ((step < 0) & (a >= b))
    return F.when(ok, F.sequence(F.when(ok, a), F.when(ok, b), F.when(ok, step))).when(a.isNotNull() & b.isNotNull(), F.array().cast("array<bigint>")), T.ArrayType(_LONG)


def _substring(args, types):
    start = args[1].cast("int") + 1
    return (F.substr(args[0], start, args[2].cast("int")) if len(args) > 2 else F.substr(args[0], start)), _STRING


def _split(args, types):
    return F.when(args[0].isNull(), F.array().cast("array<string>")).otherwise(F.split(args[0], F.concat(F.lit("\\Q"), args[1], F.lit("\\E")))), T.ArrayType(_STRING)


def _keys(args, types):
    t = types[0]
    if isinstance(t, T.StructType):
        return F.array(*[F.lit(f.name) for f in t]), T.ArrayType(_STRING)
    if isinstance(t, T.MapType):
        return F.map_keys(args[0]), T.ArrayType(t.keyType)
    return F.json_object_keys(args[0]), T.ArrayType(_STRING)


def _element(n: int):
    def f(args, types):
        return F.try_element_at(args[0], F.lit(n)), types[0].elementType if is_list(types[0]) else None

    return f


def _tail(args, types):
    return F.slice(args[0], 2, F.greatest(F.size(args[0]) - 1, F.lit(0))), types[0]


def _coalesce(args, types):
    kind = common(types)
    return F.coalesce(*[c.cast(kind) for c in args]), kind


def _round(args, types):
    return F.round(args[0].cast("double"), *([args[1].cast("int")] if len(args) > 1 else [])), _DOUBLE


def _integral(f):
    return lambda args, types: ((f(args[0]).cast("double"), _DOUBLE) if isinstance(types[0], T.FractionalType) else (args[0], types[0]))


_NATIVE = {  # passed through to Spark under the same or another name
    "upper": "upper", "lower": "lower", "instr": "instr", "ifnull": "ifnull", "nullif": "nullif", "printf": "printf", "greatest": "greatest", "least": "least", "date": "to_date", "year": "year", "month": "month", "day": "day", "date_trunc": "date_trunc", "datetime": "to_timestamp", "concat": "concat", "sign": "sign", "exp": "exp", "log": "ln", "log10": "log10", "sin": "sin", "cos": "cos", "tan": "tan", "asin": "asin", "acos": "acos", "atan": "atan", "atan2": "atan2", "degrees": "degrees", "radians": "radians", "pi": "pi", "levenshtein": "levenshtein", "sha256": "sha2", "md5": "md5",
}
FUNCTIONS: dict[str, Callable] = {
    "tolower": _same(F.lower), "toupper": _same(F.upper), "trim": _same(F.trim), "ltrim": _same(F.ltrim), "rtrim": _same(F.rtrim),
    "left": lambda a, t: (F.left(a[0], a[1].cast("int")), _STRING), "right": lambda a, t: (F.right(a[0], a[1].cast("int")), _STRING),
    "substring": _substring, "replace": _same(F.replace), "split": _split, "reverse": _same(F.reverse),
    "size": _size, "length": _size, "char_length": _size,
    "tostring": lambda a, t: (a[0].cast("string"), _STRING), "tointeger": _integer, "tofloat": lambda a, t: (_number(a[0], t[0], "double"), _DOUBLE), "toboolean": _boolean,
    "coalesce": _coalesce, "abs": _same(F.abs), "round": _round, "ceil": _integral(F.ceil), "floor": _integral(F.floor),
    "sqrt": _same(F.sqrt, _DOUBLE), "power": lambda a, t: (F.pow(a[0].cast("double"), a[1].cast("double")), _DOUBLE), "rand": lambda a, t: (F.rand(), _DOUBLE),
    "range": _range, "head": _element(1), "last": _element(-1), "tail": _tail, "keys": _keys,
}
FUNCTIONS["pow"] = FUNCTIONS["power"]


def call(name: str, args: list[Column], types: list[Type]) -> tuple[Column, Type]:
    if name in FUNCTIONS:
        return FUNCTIONS[name](args, types)
    if name in _NATIVE:
        more = [F.lit(256)] if name == "sha256" else []
        return F.call_function(_NATIVE[name], *args, *more), None
    raise QueryError(f"unknown function {name}")
