"""Chat formatting by quotation linking (operator 8).

Lines that start with ``>`` are quotes, one level per sign; the rest is a message's
own text. Own texts, their paragraphs and lines are the passages others can quote.
Passages are normalised (lower case, single spaces) and hashed. A quoted passage
links to the first message of its conversation that has it as its own, if that is
earlier. A message replies to the source of its lowest quote level that links, of
the longest quote, and then the latest source. Roots and depths follow by pointer
doubling, so a chain of n replies takes about log2(n) joins.

The first message per passage is a partial aggregate, so that a line said thousands
of times in a conversation is one row before it meets the quotes of it; joins on a
hot passage or parent are of rows, never pairs, and Spark splits them.

``conversation`` order is root_turn, depth, turn, and ``ordered`` writes it out in
ranges, so that a conversation with most of the rows spans many tasks.

Null or empty texts have no own text and no quotes; a line of attribution before a
quote belongs to the quote. Rows with a null conv_id or turn link to nothing.
Repeated rows come out once each. Texts, lines and lines of attribution are read
whole, whatever their length. A message whose text is quotes only keeps an empty text.
Other columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

QUOTE = re.compile(r"^\s{0,3}((?:>[ \t]?)+)(.*)$")
# First and last words of the lines that mail programs write before a quote; what may follow the last.
ATTRIBUTIONS = (("On", "wrote", False), ("Am", "schrieb", True), ("Le", "a écrit", False), ("El", "escribió", False))
PARSED = "own string, passages array<string>, quotes array<struct<level:int,passage:string>>"


def attribution(line: str) -> bool:
    """Whether a line names who wrote the quote below: it ends in a colon, starts with one word and has another behind."""
    said = line.strip()
    if not said.endswith(":"):
        return False
    said = said[:-1].rstrip()
    for first, last, more in ATTRIBUTIONS:
        rest = said.removeprefix(first)
        if rest is said or len(rest) == len(said) or re.match(r"\w", rest):
            continue
        if more and re.search(rf"\b{last}\b", rest) or rest.endswith(last) and not re.match(r"\w", rest[-len(last) - 1 :]):
            return True
    return False


def normalised(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def passages(lines: list[str]) -> list[str]:
    """The whole, paragraphs and lines of a run of lines, normalised, each once."""
    found = {normalised(lines): None}
    paragraph: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
            found[normalised([line])] = None
        elif paragraph:
            found[normalised(paragraph)] = None
            paragraph = []
    return [p for p in found if p]


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """Own text, its passages, and (level, passage) of quotes."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    before = 0
    for line in (text or "").splitlines():
        m = QUOTE.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if not before:
                while own and not own[-1].strip() and len(own) > 1 and attribution(own[-2]):
                    own.pop()
                if own and attribution(own[-1]):
                    own.pop()
            if before != level:
                runs.append((level, []))
            runs[-1][1].append(m[2])
        before = level
    said = "\n".join(own).strip()
    quoted = {(level, p): None for level, lines in runs for p in passages(lines)}
    return said, passages(said.splitlines()), list(quoted)


def _parsed(texts: pd.Series) -> pd.DataFrame:
    rows = [parse(t if isinstance(t, str) else None) for t in texts]
    return pd.DataFrame({"own": [r[0] for r in rows], "passages": [r[1] for r in rows], "quotes": [[{"level": a, "passage": b} for a, b in r[2]] for r in rows]})


def parents(parsed: DataFrame) -> DataFrame:
    """conv_id, turn and parent of the messages that reply to one."""
    said = parsed.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", F.md5(F.col("p").cast("binary")).alias("key"))
    first = said.groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
    quoted = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", F.col("q.level").alias("level"), F.length("q.passage").alias("n"), F.md5(F.col("q.passage").cast("binary")).alias("key"))
    linked = quoted.join(first, ["conv_id", "key"]).where(F.col("source") < F.col("turn"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "n", "source"))
    return linked.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.source").alias("parent"))


def roots(links: DataFrame) -> DataFrame:
    """links with root and depth, by pointer doubling."""
    state = written(links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        upper = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        joined = state.join(upper, ["conv_id", "root"], "left")
        moved = F.col("_root").isNotNull()
        state = written(joined.select("conv_id", "turn", "parent", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), moved.alias("moved")))
        if state.where("moved").isEmpty():
            return state.drop("moved")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quotes, parent_turn, root_turn and depth of every message."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = written(rows.select("conv_id", "turn", "role", F.pandas_udf(_parsed, PARSED)("text").alias("p")).select("conv_id", "turn", "role", "p.*"))
    linked = roots(parents(parsed))
    out = parsed.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").cast("long").alias("n_quotes"))
    out = out.join(linked, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "n_quotes", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def ordered(found: DataFrame) -> DataFrame:
    """Conversations in reply order, in ranges of rows."""
    keys = ["conv_id", "root_turn", "depth", "turn"]
    return found.repartitionByRange(*keys).sortWithinPartitions(*keys)
