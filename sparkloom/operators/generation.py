"""Dataset generation: prompts of every mode, model calls, entries; classification in stages.

All of it is columns around one call of a model per chunk (``models.apply``): prompts are
expressions, replies are parsed as variants, and what comes out are rows for the
quality, evaluation and export operators.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as P
from . import evaluation as E
from . import models as M

#: What a mode asks for, with the names under which its replies have question and answer.
MODES = {
    "qa": ("Write {n} question and answer pairs about the content{complexity_level_context}.", "question", "answer"),
    "questions": ("Write {n} questions that the content answers{complexity_level_context}.", "question", None),
    "answers": ("Write {n} statements that the content supports{complexity_level_context}.", None, "answer"),
    "summary": ("Summarise the content in up to {n} summaries{complexity_level_context}.", "title", "summary"),
    "instruction": ("Write {n} instructions with the responses that the content gives{complexity_level_context}.", "instruction", "output"),
    "extract": ("List up to {n} entities of the content with what it says about each{complexity_level_context}.", "entity", "description"),
    "evaluation": ("Write {n} test questions on the content, each with its expected answer{complexity_level_context}.", "question", "expected_answer"),
}
ENDING = "\n\nUse only what the content says. Reply with a JSON list of objects."
# Dataset parameters that are not given.
DEFAULTS = {"custom_audience": "", "custom_purpose": "", "complexity_level": "intermediate", "domain": "general", "purpose_context": "", "audience_context": ""}


def parameters(rows: DataFrame) -> DataFrame:
    """Dataset parameters with defaults for missing and null ones, and complexity_level_context: empty for ``auto`` and the empty level."""
    own = {k: F.coalesce(F.col(k).cast("string"), F.lit(v)) if k in rows.columns else F.lit(v) for k, v in DEFAULTS.items()}
    level = F.col("complexity_level")
    return rows.withColumns(own).withColumn("complexity_level_context", F.when(level.isin("auto", ""), "").otherwise(F.concat(F.lit(" with "), level, F.lit(" complexity level"))))


def focus(purpose: Column, audience: Column) -> Column:
    """How a taxonomy is used: clinical purposes by audience, else in general."""
    p, a = F.lower(F.coalesce(purpose, F.lit(""))), F.lower(F.coalesce(audience, F.lit("")))
    has = lambda c, *words: F.greatest(*[F.contains(c, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(c, F.lit(words[0]))
    # Names of the ways.
    clinical = F.when(has(a, "expert"), "clinical_diagnosis_expert").when(has(a, "novice", "student"), "clinical_diagnosis_novice").otherwise("clinical_diagnosis_general")
    return F.when(has(p, "clinical", "diagnosis"), clinical).otherwise("general")


def prompts(chunks: DataFrame, mode: str | Column, content: str = "chunk", per_chunk: int = 3, template: Column | None = None, taxonomy: Column | None = None) -> Column:
    """The prompt of each chunk by mode, or from a custom ``template`` with {chunk}; parameters among the columns are filled in.

    ``taxonomy`` names categories that replies should keep to.
    """
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    by_name = lambda m: F.lit(MODES[m][0] + ENDING)
    if template is not None:
        body = template
    elif isinstance(mode, str):
        body = by_name(mode)
    else:
        body = F.coalesce(*[F.when(mode == m, by_name(m)) for m in MODES])
    for name in ("complexity_level_context", "purpose_context", "audience_context"):
        value = F.coalesce(F.col(name), F.lit("")) if name in chunks.columns else F.lit(" with intermediate complexity level" if name.startswith("complexity") else "")
        body = F.replace(body, F.lit("{" + name + "}"), value)
    body = F.replace(body, F.lit("{n}"), F.lit(str(per_chunk)))
    if taxonomy is not None:
        body = F.concat(body, F.when(taxonomy.isNotNull(), F.concat(F.lit("\n\nKeep to these categories: "), taxonomy)).otherwise(""))
    # what the chunk holds is put in last, so that braces in it stay
    return F.when(F.contains(body, F.lit("{chunk}")), F.replace(body, F.lit("{chunk}"), text)).otherwise(F.concat(F.lit("Content: "), text, F.lit("\n\n"), body))


def generated(chunks: DataFrame, mode: str, model: M.Model, content: str = "chunk", per_chunk: int = 3, template: Column | None = None, taxonomy: Column | None = None) -> DataFrame:
    """The chunks' columns with mode, entry_index (from 0), question, answer, reasoning and confidence of at most ``per_chunk`` entries each.

    A reply is a JSON list, an object, or a list fenced in text; names follow the mode, and
    question and answer are understood in all. Entries without both are left out, and
    replies that are no JSON are one entry, all answer. Failed calls have none.
    """
    _, asked, told = MODES["qa" if mode == "custom" else mode]
    rest = [c for c in chunks.columns if c != content]
    reply = M.apply(chunks, prompts(chunks, "qa" if mode == "custom" else mode, content, per_chunk, template, taxonomy), model).select(*rest, "reply")
    mended = F.coalesce(P.repair(F.col("reply")), F.to_json(F.struct(F.col("reply").alias("answer"))))
    whole = F.try_parse_json(mended)
    listed = F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.array(whole))
    each = reply.where("reply IS NOT NULL").select(*rest, F.posexplode(F.slice(listed, 1, per_chunk)).alias("entry_index", "_v"))
    get = lambda name, kind="string": F.try_variant_get("_v", f"$.{name}", kind)
    named = lambda own, usual: F.coalesce(*([get(own)] if own else []), get(usual), F.lit(""))
    out = each.select(
        *rest, F.lit(mode).alias("mode"), "entry_index", named(asked, "question").alias("question"), named(told, "answer").alias("answer"),
        F.coalesce(get("reasoning"), F.lit("")).alias("reasoning"), F.coalesce(get("confidence_score", "double"), F.lit(0.0)).alias("confidence"),
    )
    return out.where("question <> '' OR answer <> ''")


def multi_stage(chunks: DataFrame, models: Mapping[str, M.Model], primary: str, prompt: Column, check: Column, key: str = "chunk_id", category: str = "category", threshold: float = 0.5) -> DataFrame:
    """chunk_id, category, value, weight and agreement by stages.

    Every model classifies; the primary model is asked again with ``check``, which may
    use column ``best``, the value voted with most confidence, and its reply is one more
    vote where that confidence reaches ``threshold``. agreement is the mean share of the
    most frequent value; value has the most confidence of all votes.
    """
    coarse = M.classify(chunks, models, prompt, key, category)
    first = coarse.groupBy("chunk_id").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", "classifier")).alias("b"))
    asked = chunks.join(first.select(F.col("chunk_id").alias(key), F.col("b.value").alias("best"), F.col("b.confidence").alias("_c")), key).where(F.col("_c") >= threshold)
    again = M.apply(asked, check, models[primary])
    votes = again.select(F.col(key).alias("chunk_id"), F.lit(f"{primary}_validated").alias("classifier"), F.lit(category).alias("category"), F.col("reply").alias("value"), F.when(F.col("reply").isNull(), 0.0).otherwise(1.0).alias("confidence"))
    every = coarse.unionByName(votes).where("value IS NOT NULL")
    return E.vote_ensemble(every).join(E.vote_agreement_modal(every).withColumnRenamed("score", "agreement"), "chunk_id")
