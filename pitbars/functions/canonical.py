"""JSON in one canonical form as Column functions: sorted keys, no spaces, ASCII alone, numbers as the sources of digests write them.

Two texts of the same JSON value are the same canonical text, so digests of records, ids of events and digests of panels can be compared
with those taken elsewhere. Typed columns go through `encode`, parsed JSON (variants) through `encode_variant`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short escapes of JSON.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def string(text: Column, ascii_only: bool = True) -> Column:
    """A JSON string of ASCII characters: anything outside space to tilde is escaped, beyond 16 bits as a surrogate pair. Null stays null.
    Without ascii_only, only quotes, backslashes and control characters are escaped."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escaped(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        out = F.when(code < 32, unit(code)).otherwise(c)
        if ascii_only:
            out = F.when(code > 0xFFFF, F.concat(unit(F.shiftright(code - 0x10000, 10) + 0xD800), unit((code - 0x10000) % 0x400 + 0xDC00))).when(code > 126, unit(code)).otherwise(out)
        for plain, short in SHORT.items():
            out = F.when(c == plain, short).otherwise(out)
        return out

    plain = text.rlike(r"^[ !#-\[\]-~]*$") & ~text.contains("\n")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), "")), F.lit('"'))


def double(x: Column) -> Column:
    """The shortest text of a double as records hold it: 1.5, 100.0, 1e+16, 1e-05; NaN, Infinity, -Infinity."""
    text = F.abs(x).cast("string")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"\.0$", ""), r"\.", "")
    left, right = F.substring(digits, F.lit(1), exponent + 1), F.substring(digits, exponent + 2, F.length(digits))
    whole = F.concat(F.rpad(left, exponent + 1, "0"), F.lit("."), F.when(right == "", "0").otherwise(right))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    rest = F.substring(digits, F.lit(2), F.length(digits))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), "0"))
    body = F.when(exponent.isNull(), text).when((exponent >= 0) & (exponent < 16), whole).when((exponent < 0) & (exponent >= -4), small).otherwise(scientific)
    negative = (x < 0) | (x.cast("string") == "-0.0")
    return F.when(F.isnan(x), "NaN").otherwise(F.concat(F.when(negative, "-").otherwise(""), body))


def encode(x: Column, kind: T.DataType, ascii_only: bool = True) -> Column:
    """Canonical JSON of a column of the given type: structs and maps by sorted keys, missing values as null."""
    text = lambda c: string(c, ascii_only)
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [p for k, f in enumerate(fields) for p in (F.concat(F.lit("," if k else ""), text(F.lit(f.name)), F.lit(":")), encode(x[f.name], f.dataType, ascii_only))]
        out = F.when(x.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(x)) if kind.valueType.simpleString() != "variant" else F.transform(F.array_sort(F.map_keys(x)), lambda k: F.struct(k.alias("key"), F.try_element_at(x, k).alias("value")))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(text(e["key"]), F.lit(":"), encode(e["value"], kind.valueType, ascii_only))), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: encode(e, kind.elementType, ascii_only)), ","), F.lit("]"))
    elif isinstance(kind, T.VariantType):
        out = encode_variant(x)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = double(x)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = x.cast("string")
    else:
        out = text(x.cast("string"))
    return F.coalesce(out, F.lit("null"))


def encode_variant(v: Column, depth: int = 3) -> Column:
    """Canonical JSON of a parsed value nested `depth` levels at most; null where it is nested deeper. Numbers with a fraction or an exponent
    are doubles; a whole number written with a point (1.0) is parsed as 1."""
    kind = F.schema_of_variant(v)
    whole = kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    out = (
        F.when(v.isNull() | (kind == "VOID"), "null").when(kind == "STRING", string(F.try_variant_get(v, "$", "string"))).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("string"))
        .when(whole, F.try_variant_get(v, "$", "decimal(38,0)").cast("string")).when(kind.rlike("^(DOUBLE|DECIMAL)"), double(F.try_variant_get(v, "$", "double")))
    )
    if depth:
        inner = lambda x: encode_variant(x, depth - 1)
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), inner)
        held = F.try_variant_get(v, "$", "map<string,variant>")
        pairs = F.transform(F.array_sort(F.map_keys(held)), lambda k: F.concat(string(k), F.lit(":"), inner(F.try_element_at(held, k))))
        joined = lambda a: F.when(~F.exists(a, lambda x: x.isNull()), F.array_join(a, ","))
        out = out.when(kind.startswith("ARRAY"), F.concat(F.lit("["), joined(items), F.lit("]"))).when(kind.startswith("OBJECT"), F.concat(F.lit("{"), joined(pairs), F.lit("}")))
    return out
