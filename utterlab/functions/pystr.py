"""Argument values spelled the way the judges compare them.

Accepted values are plain strings, so a returned JSON value must be turned into
text by one fixed convention: True / False / None, integers and floats in their
shortest form, lists as ['a', 'b'].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterlab.functions.text import argument_form, let


def number_text(text: Column) -> Column:
    """A JSON number: integers verbatim, others in shortest float form."""
    value = text.try_cast("double")
    size = F.abs(value)
    plain = F.regexp_replace(
        F.regexp_replace(value.try_cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    java = value.cast("string")
    exponent = F.regexp_extract(java, r"E(-?\d+)$", 1)
    digits = F.regexp_replace(exponent, "-", "")
    scientific = F.concat(
        F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", ""),
        F.lit("e"),
        F.when(exponent.startswith("-"), "-").otherwise("+"),
        F.lpad(digits, 2, "0"),
    )
    float_form = (
        F.when(size == 0, F.when(text.startswith("-"), "-0.0").otherwise("0.0"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
    return F.when(text.rlike(r"^-?\d+$"), F.regexp_replace(text, "^-0$", "0")).otherwise(float_form)


def _quoted(text: Column) -> Column:
    escaped = F.regexp_replace(text, r"\\", r"\\\\\\\\")
    escaped = F.replace(escaped, F.lit("\n"), F.lit("\\n"))
    escaped = F.replace(escaped, F.lit("\t"), F.lit("\\t"))
    escaped = F.replace(escaped, F.lit("\r"), F.lit("\\r"))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"')))
        .when(single, F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))
    )


def _scalar(text: Column, kind: Column, quote: bool) -> Column:
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind == "STRING", _quoted(text) if quote else text)
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), text)
        .otherwise(number_text(text))
    )


def _elements(text: Column, value: Column, quote: bool) -> Column:
    """Elements of a JSON list as text; nested containers stay JSON text."""
    texts = F.from_json(text, "array<string>")
    kinds = F.transform(
        F.try_variant_get(value, "$", "array<variant>"), lambda v: F.schema_of_variant(v)
    )
    return F.zip_with(texts, kinds, lambda t, k: _scalar(t, k, quote))


def _json_text(text: Column, value: Column, kind: Column) -> Column:
    """The value as JSON with a blank after each list comma."""
    listed = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.to_json(v)),
            ", ",
        ),
        F.lit("]"),
    )
    raw = F.when(kind == "STRING", F.to_json(value)).when(kind == "VOID", "null").otherwise(text)
    return F.when(kind.startswith("ARRAY"), listed).otherwise(raw)


def argument_table(arguments_json: Column) -> Column:
    """map<param, struct<text, norm, elements, json, is_list>> of a call's arguments.

    ``norm`` is the comparison form of the whole value and ``elements`` the sorted
    distinct comparison forms of its items (a scalar is a one-item list).
    """

    def build(pair: Column) -> Column:
        texts, values = pair["texts"], pair["values"]

        def entry(name: Column) -> Column:
            found = F.struct(
                name.alias("name"),
                texts[name].alias("text"),
                values[name].alias("value"),
                F.schema_of_variant(values[name]).alias("kind"),
            )
            return let(found, typed)

        def typed(found: Column) -> Column:
            text, value, kind = found["text"], found["value"], found["kind"]
            is_list = kind.startswith("ARRAY")
            whole = F.when(
                is_list,
                F.concat(F.lit("["), F.array_join(_elements(text, value, True), ", "), F.lit("]")),
            ).otherwise(_scalar(text, kind, False))
            items = F.when(is_list, _elements(text, value, False)).otherwise(
                F.array(_scalar(text, kind, False))
            )
            return let(
                whole,
                lambda w: F.struct(
                    found["name"],
                    F.struct(
                        w.alias("text"),
                        argument_form(w).alias("norm"),
                        F.array_sort(F.array_distinct(F.transform(items, argument_form))).alias(
                            "elements"
                        ),
                        _json_text(text, value, kind).alias("json"),
                        is_list.alias("is_list"),
                    ),
                ),
            )

        return F.map_from_entries(F.transform(F.map_keys(texts), entry))

    parsed = F.struct(
        F.from_json(arguments_json, "map<string,string>").alias("texts"),
        F.from_json(arguments_json, "map<string,variant>").alias("values"),
    )
    return F.when(arguments_json.isNotNull(), let(parsed, build))
