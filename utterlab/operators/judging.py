"""Tool-call judges: exact, list-aware and meaning-aware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlab.functions.pystr import argument_table
from utterlab.functions.text import argument_form, has_devanagari
from utterlab.operators.logs import strict_lookup

PARAMS = "map<string,array<string>>"


def expected_call(raw_json: Column) -> Column:
    """struct<name, arguments> from [{name: {param: [accepted, ...]}}].

    Null when the list does not hold exactly one call.
    """
    calls = F.from_json(raw_json, f"array<map<string,{PARAMS}>>")
    one = F.get(calls, F.lit(0))
    name = F.get(F.map_keys(one), F.lit(0))
    return F.when(
        (F.size(calls) == 1) & (F.size(one) == 1),
        F.struct(name.alias("name"), one[name].alias("arguments")),
    )


def array_params(functions_json: Column, function: Column) -> Column:
    """Parameters the function's schema declares as arrays, sorted."""
    fns = F.from_json(
        functions_json,
        "array<struct<name:string,parameters:struct<properties:map<string,variant>>>>",
    )
    named = F.filter(fns, lambda f: f["name"] == function)
    found = F.flatten(
        F.transform(
            named,
            lambda f: F.coalesce(
                F.map_keys(
                    F.map_filter(
                        f["parameters"]["properties"],
                        lambda _, spec: F.coalesce(
                            F.try_variant_get(spec, "$.type", "string") == "array", F.lit(False)
                        ),
                    )
                ),
                F.array().cast("array<string>"),
            ),
        )
    )
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def prepare(calls: DataFrame) -> DataFrame:
    """Add the parsed argument table once; every judge reads it.

    ``calls`` has called_name, arguments_json (both null without a call),
    expected_name, expected (map<param, accepted values>), array_params, error_class.
    """
    return calls.withColumn("args", argument_table(F.col("arguments_json")))


def _missing_any() -> Column:
    return F.exists(F.map_keys("expected"), lambda p: ~F.map_contains_key(F.col("args"), p))


def mismatches(list_aware: bool) -> Column:
    """Expected parameters that were returned with a value nobody accepts."""

    def wrong(entry: Column) -> Column:
        accepted = F.transform(entry["value"], argument_form)
        given = F.col("args")[entry["key"]]
        scalar_ok = F.array_contains(accepted, given["norm"])
        if list_aware:
            list_ok = F.array_sort(F.array_distinct(accepted)) == given["elements"]
            ok = F.when(F.array_contains("array_params", entry["key"]), list_ok).otherwise(
                scalar_ok
            )
        else:
            ok = scalar_ok
        return F.map_contains_key(F.col("args"), entry["key"]) & ~ok

    return F.transform(F.filter(F.map_entries("expected"), wrong), lambda e: e["key"])


def _reached() -> Column:
    """The right function was called with every expected parameter."""
    return (
        F.col("called_name").isNotNull()
        & (F.col("called_name") == F.col("expected_name"))
        & ~_missing_any()
    )


def verdict(list_aware: bool) -> Column:
    ok = _reached() & (F.size(mismatches(list_aware)) == 0)
    return F.coalesce(ok, F.lit(False))


def failure_class(list_aware: bool = False) -> Column:
    """struct<category, list_valued, devanagari, other>: the first check failed, in
    the judge's order, and what kind of value did not match."""
    bad = mismatches(list_aware)
    category = (
        F.when(F.col("error_class") == "tool_validation_failed", "provider_rejected")
        .when(F.col("called_name").isNull(), "no_call")
        .when(F.col("called_name") != F.col("expected_name"), "wrong_function")
        .when(_missing_any(), "missing_argument")
        .otherwise("value_mismatch")
    )
    mismatch = category == "value_mismatch"
    listed = mismatch & F.coalesce(F.arrays_overlap(bad, F.col("array_params")), F.lit(False))
    deva = mismatch & F.coalesce(
        F.exists(bad, lambda p: has_devanagari(F.col("args")[p]["text"])), F.lit(False)
    )
    return F.struct(
        category.alias("category"),
        listed.alias("list_valued"),
        deva.alias("devanagari"),
        (mismatch & ~listed & ~deva).alias("other"),
    )


ITEM = ["language", "example_id", "parameter", "value_key"]


def mismatch_items(prepared: DataFrame) -> DataFrame:
    """One row per list-aware mismatch of a call that reached the value checks."""
    # no filter: it would move below ``args`` and parse the arguments once more per parameter
    return (
        prepared.select(
            "*",
            F.explode(F.when(_reached(), mismatches(list_aware=True))).alias("parameter"),
        )
        .withColumn("returned_value", F.col("args")[F.col("parameter")]["json"])
        .withColumn("value_key", argument_form(F.col("returned_value")))
        .withColumn("accepted_values", F.array_join(F.col("expected")[F.col("parameter")], " | "))
    )


def judged_population(prepared: DataFrame) -> DataFrame:
    """Mismatches deduplicated on (language, example, parameter, value), first kept."""
    kept = ["query", "expected_name", "accepted_values", "returned_value"]
    return (
        mismatch_items(prepared.where(F.col("outcome") != "incomplete"))
        .groupBy(*ITEM)
        .agg(F.min_by(F.struct(*kept), "ingest_pos").alias("first"))
        .select(*ITEM, "first.*")
        .withColumn("key", F.concat_ws("|", *ITEM))
    )


def meaning_outcomes(prepared: DataFrame, verdicts: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell: passes when every list-aware mismatch was judged equivalent.

    A mismatch without a verdict is an error, never a silent failure.
    """
    items = mismatch_items(prepared).select(*cell, F.concat_ws("|", *ITEM).alias("key"))
    judged = (
        strict_lookup(items.distinct(), verdicts, ["key"], "equivalent")
        .groupBy(*cell)
        .agg(F.bool_and("equivalent").alias("all_equivalent"))
    )
    return (
        prepared.withColumn("reached", F.coalesce(_reached(), F.lit(False)))
        .join(judged, cell, "left")
        .withColumn(
            "meaning_ok", F.col("reached") & F.coalesce("all_equivalent", F.lit(True))
        )
        .drop("reached", "all_equivalent")
    )
