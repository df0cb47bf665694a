"""Replies of language models: repair, parse, fill and score them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

THINK = r"(?s)<think>(.*?)</think>"


def first_structure(text: str | None) -> str | None:
    """The first balanced object or list of a text, quotes respected."""
    t = text or ""
    start = min((k for k in (t.find("{"), t.find("[")) if k >= 0), default=-1)
    if start < 0:
        return None
    depth, quoted, k = 0, False, start
    while k < len(t):
        c = t[k]
        if quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return t[start : k + 1]
        k += 1
    return None


def repaired(text: str | None) -> str | None:
    """JSON of a reply: without thoughts and fences, trailing commas and bare keys mended; null if hopeless."""
    found = first_structure(re.sub(THINK, "", text or ""))
    if found is None:
        return None
    for candidate in (found, re.sub(r",\s*([}\]])", r"\1", found), re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', re.sub(r",\s*([}\]])", r"\1", found))):
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def repair(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(repaired), "string")(c)


def outer_braces(c: Column) -> Column:
    """From the first brace to the last."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def entry(reply: Column) -> Column:
    """question, answer, reasoning and confidence of a reply; a reply that is no JSON is the answer."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(reply, THINK, ""), r"^```(?:json)?\s*|\s*```$", ""))
    v = F.try_parse_json(clean)
    get = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
    return F.struct(
        F.coalesce(get("question"), F.lit("")).alias("question"),
        F.coalesce(get("answer"), F.when(v.isNull(), clean), F.lit("")).alias("answer"),
        F.coalesce(F.nullif(F.regexp_extract(reply, THINK, 1), F.lit("")), get("reasoning"), F.lit("")).alias("reasoning"),
        F.coalesce(get("confidence_score", "double"), F.lit(0.0)).alias("confidence"),
    )


def normalised_entry(raw: Column) -> Column:
    """question and answer of an entry given as JSON: a fenced list's first pair, instruction and output, or as they are."""
    v = F.try_parse_json(raw)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    fenced = F.try_parse_json(F.trim(F.regexp_replace(get("$.raw_response"), r"^```(?:json)?\s*|\s*```$", "")))
    adaptive = get("$.source_type") == "extract_adaptive"
    q = F.when(adaptive, F.try_variant_get(fenced, "$[0].question", "string"))
    a = F.when(adaptive, F.try_variant_get(fenced, "$[0].answer", "string"))
    instruction = F.trim(F.concat_ws("\n", get("$.instruction"), F.nullif(get("$.input"), F.lit(""))))
    return F.struct(F.coalesce(q, get("$.question"), F.nullif(instruction, F.lit("")), F.lit("")).alias("question"), F.coalesce(a, get("$.answer"), get("$.output"), F.lit("")).alias("answer"))


def completeness(values: Column) -> Column:
    """Filled over all values of a map, up to 1; an empty map is 0."""
    filled = F.size(F.filter(F.map_values(values), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    return F.when(F.size(values) > 0, F.least(F.lit(1.0), filled / F.size(values))).otherwise(0.0)


def nested_completeness(c: Column) -> Column:
    """Filled over all leaves of JSON, a tenth more if a top value is a container, up to 1."""

    def one(text: str | None) -> float:
        try:
            top = json.loads(text or "")
        except ValueError:
            return 0.0
        if not isinstance(top, dict):
            return 0.0
        filled = total = 0
        todo = list(top.values())
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                todo += x.values()
            else:
                total += 1
                filled += x not in (None, "", [])
        share = filled / total if total else 0.0
        return min(1.0, share + (0.1 if any(isinstance(x, (dict, list)) for x in top.values()) else 0.0))

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s], dtype="float64"), "double")(c)


def path_chain(c: Column, *paths: str) -> Column:
    """The first path of JSON that has a value."""
    return F.coalesce(*[F.get_json_object(c, p) for p in paths])


def masked_log(c: Column) -> Column:
    """A log line with the values of secrets masked."""
    return F.regexp_replace(c, r"(?i)((?:api[_-]?key|token|password|secret|authorization)[\"']?\s*[=:]\s*[\"']?)[^\s\"',}]+", "$1***")
