"""Context for an agent within a token budget."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import first_lines, token_estimate

MAX_TOKENS = 8000


def within_budget(ranked: DataFrame, group: list[str], order: list, tokens: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose tokens fit the budget. Every row has a token at least, so sums only grow."""
    upto = F.sum(tokens).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running_tokens", upto).where(F.col("running_tokens") <= budget)


@dataclass
class Context:
    query: str
    budget: int
    sections: list[tuple[str, str, int]] = field(default_factory=list)
    used: int = 0
    truncated: bool = False

    def add(self, title: str, content: str) -> bool:
        """Adds a section if it fits; empty ones are left out."""
        if not content:
            return True
        tokens = len(content.encode()) // 4 + 1
        if self.used + tokens > self.budget:
            self.truncated = True
            return False
        self.sections.append((title, content, tokens))
        self.used += tokens
        return True


def build_context(query: str, hits: DataFrame, chunks: DataFrame, edges: DataFrame, path: str | None = None, budget: int = MAX_TOKENS) -> Context:
    """Primary hits, the call graph around the first hit and the first chunks of a hinted path, each if it fits.

    hits come ranked and limited from hybrid search, so what is collected is bounded.
    """
    out = Context(query, budget)
    full = hits.select("chunk_id", "rank").join(chunks.select(F.col("id").alias("chunk_id"), "relative_path", "symbol_name", "start_line", "end_line", "content"), "chunk_id")
    text = F.format_string("### %s (%s:%d-%d)\n%s", "symbol_name", "relative_path", "start_line", "end_line", "content")
    told = within_budget(full.select("rank", "chunk_id", "symbol_name", text.alias("text"), token_estimate(text).alias("tokens")), [], ["rank"], "tokens", budget)
    rows = told.orderBy("rank").collect()
    out.truncated = len(rows) < full.count()
    out.add("Primary hits", "\n\n".join(r.text for r in rows))
    if rows:
        name = rows[0].symbol_name.lower()
        near = edges.where((F.lower("caller_name") == name) | (F.col("callee_lc") == name)).select(F.lower("caller_name").alias("a"), "callee_lc").distinct()
        lines = [f"{r.a} -> {r.callee_lc}" for r in near.orderBy("a", "callee_lc").limit(200).collect()]
        out.add("Call graph", "\n".join(lines))
    if path:
        own = chunks.where(F.col("relative_path") == path).orderBy("start_line", "id").limit(5)
        out.add(f"File {path}", "\n\n".join(r.t for r in own.select(first_lines(F.col("content"), 12).alias("t")).collect()))
    out.truncated = out.truncated or out.used >= budget
    return out
