"""Column helpers over text: trimming, verbatim comparison, paths, prompts and tokens."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SUBTASK = "-d[0-9]+$"
GENERAL = "general"


def strip(text: Column) -> Column:
    """Without white space at both ends; trim() would only drop spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold_kind(kind: Column) -> Column:
    """Lower-cased; not trimmed."""
    return F.lower(kind)


def verbatim(text: Column) -> Column:
    """For comparison of a quote with its source: no backticks, single spaces, no space at the ends."""
    return strip(F.regexp_replace(F.replace(text, F.lit("`"), F.lit("")), r"(?U)\s+", " "))


def is_verbatim(quote: Column, review: Column) -> Column:
    return F.contains(verbatim(review), verbatim(quote))


def diff_files(diff: Column) -> Column:
    """Sorted paths of the files that a unified diff touches."""
    paths = F.regexp_extract_all(diff, F.lit(r"(?md)^[+-]{3} (?:[ab]/)?(.+)$"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(paths, lambda p: p != "/dev/null")))


def parent_task(task_id: Column) -> Column:
    return F.regexp_replace(task_id, SUBTASK, "")


def population(task_id: Column) -> Column:
    return F.when(task_id.rlike(SUBTASK), "sub-tasks").otherwise("curated")


def model_of(run: Column) -> Column:
    """The third of the parts between double hyphens, or the whole name where there are fewer."""
    return F.coalesce(F.try_element_at(F.split(run, "--"), F.lit(3)), run)


def resolved_model(agent: Column, run: Column) -> Column:
    return F.coalesce(F.nullif(agent, F.lit("")), model_of(run))


def stem(path: Column) -> Column:
    """A file's name without folders and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def strip_fences(text: Column) -> Column:
    """Without Markdown fence markers at the start or the end of any line."""
    return strip(F.regexp_replace(text, r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def review_prompt(context: Column, notes: Column, diff: Column) -> Column:
    said = F.coalesce(F.nullif(notes, F.lit("")), F.lit("(no description provided)"))
    return F.concat(F.lit("## Context\n\n"), context, F.lit("\n\n## Description\n\n"), said, F.lit("\n\n## Diff\n\n"), diff)


def pruned_context(context: Column, path: Column, others: Column) -> Column:
    """Without the paragraphs that name one of the other files and not this one."""
    keep = lambda p: ~(F.exists(others, lambda f: F.contains(p, f)) & ~F.contains(p, path))
    return F.array_join(F.filter(F.split(context, "\n\n"), keep), "\n\n")


def delimiter_balance(text: Column) -> Column:
    """Opening brackets minus closing ones; nesting isn't looked at."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return count("([{") - count(")]}")


def _object(said: Column) -> Column:
    """A JSON text if it is an object, else null."""
    return F.when(said.startswith("{"), said)


def schema_snippet(body: Column) -> Column:
    """The JSON schema that a request asks for: that of its response format, else the first among its
    function tools."""
    tools = F.from_json(F.get_json_object(body, "$.tools"), "array<string>")
    found = F.transform(tools, lambda t: F.when(F.get_json_object(t, "$.type") == "function", _object(F.get_json_object(t, "$.function.input_schema"))))
    return F.coalesce(_object(F.get_json_object(body, "$.response_format.json_schema.schema")), F.try_element_at(F.array_compact(found), F.lit(1)))


@F.pandas_udf(StringType())
def _indented(value: pd.Series) -> pd.Series:
    """JSON laid out with two spaces; to_json's own layout differs."""
    return value.map(lambda v: None if v is None else json.dumps(json.loads(v), indent=2))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def prompt_of_request(body: Column) -> Column:
    """One prompt from a chat request (JSON): the schema it asks for with a preamble, its system text (a
    text or blocks), then its messages as role and content, blocks of text joined by line ends."""
    schema = schema_snippet(body)
    whole = F.parse_json(body)
    none = F.array().cast("array<string>")
    blocks = lambda raw: F.transform(
        F.filter(F.coalesce(F.from_json(raw, "array<string>"), none), lambda b: F.get_json_object(b, "$.type") == "text"), lambda b: F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))
    )
    system, kind = F.get_json_object(body, "$.system"), _kind(F.try_variant_get(whole, "$.system", "variant"))
    head = F.when((kind == "STRING") & (system != ""), F.array(system)).when(kind.startswith("ARRAY"), blocks(system)).otherwise(none)

    def said(m: Column) -> Column:
        role = F.coalesce(F.get_json_object(m, "$.role"), F.lit("user"))
        content, kind = F.get_json_object(m, "$.content"), _kind(F.try_variant_get(F.parse_json(m), "$.content", "variant"))
        text = F.array_join(blocks(content), "\n")
        return F.when(kind == "STRING", F.concat(role, F.lit(": "), content)).when(kind.startswith("ARRAY") & (text != ""), F.concat(role, F.lit(": "), text))

    messages = F.transform(F.coalesce(F.from_json(F.get_json_object(body, "$.messages"), "array<string>"), none), said)
    preamble = F.when(schema.isNotNull(), F.array(F.lit("Output must be a single JSON object matching this JSON Schema:"), _indented(schema))).otherwise(none)
    return F.array_join(F.concat(preamble, head, F.array_compact(messages)), "\n\n")


def request_model(requested: Column, judge_id: str, judge_model: str, model: str) -> Column:
    """The judge's model for requests that name the judge's id, else the reviewer's."""
    return F.when(F.contains(F.lower(F.coalesce(requested, F.lit(""))), F.lit(judge_id.lower())), judge_model).otherwise(model)


def model_family(model: Column, heads: list[str]) -> Column:
    """Whether the part of a model's name before the first hyphen is one of heads."""
    return F.split(F.lower(model), "-")[0].isin(heads)


def identifiers(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def looks_like_binding(code: Column) -> Column:
    return strip(code).rlike(r"^(?:import |from |(?:def|class|async def)\s+|[A-Za-z_][A-Za-z0-9_]*\s*=)")
