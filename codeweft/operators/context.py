"""What goes into a context: focus sets, file relevance, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import CHARS_PER_TOKEN, estimate_tokens
from codeweft.operators.reports import find_impact
from codeweft.storage import materialize

# Fixed values of the data model: the default budget.
BUDGET = {"tokens": 24_000, "files": 30, "methods": 50, "hops": 3, "reranked": 10, "snippet_lines": 60}


def budget_cut(sections: DataFrame, budget: int, group: str = "pack") -> DataFrame:
    """Sections(group, ordinal, body) within a token budget, in order; the one that crosses it is cut.

    Adds ``cost`` and ``left``, the tokens free before the section.
    """
    order = Window.partitionBy(group).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    spent = sections.withColumn("cost", estimate_tokens(F.col("body")))
    spent = spent.withColumn("left", F.lit(budget) - F.coalesce(F.sum("cost").over(order), F.lit(0))).where("left > 0")
    fits = F.col("cost") <= F.col("left")
    cut = F.substr("body", F.lit(1), (F.col("left") * CHARS_PER_TOKEN).cast("int"))
    return spent.select(group, "ordinal", "cost", "left", F.when(fits, F.col("body")).otherwise(cut).alias("body"), (~fits).alias("cut"))


def prompt_reserve(budget: int) -> int:
    """Tokens kept for the answer."""
    return min(3000, max(400, budget // 4))


def assemble_prompts(heads: DataFrame, sections: DataFrame, budget: int = BUDGET["tokens"], group: str = "pack") -> DataFrame:
    """``prompt, tokens, sections`` for each of heads(group, head): the head, then sections(group, ordinal, title, body) in order.

    What the answer needs is kept free of the budget. Blank sections do not count; the section that crosses what is left is
    cut, and those after it fall away. A group's text is no longer than its budget.
    """
    room = max(600, budget - prompt_reserve(budget))
    first = heads.select(group, "head", (F.lit(room) - estimate_tokens(F.col("head"))).alias("free"))
    order = Window.partitionBy(group).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    spent = sections.where(F.trim(F.regexp_replace("body", r"\s+", " ")) != "").withColumn("cost", estimate_tokens(F.col("body"))).join(first.select(group, "free"), group)
    spent = spent.withColumn("left", F.col("free") - F.coalesce(F.sum("cost").over(order), F.lit(0))).where("left > 0")
    body = F.when(F.col("cost") <= F.col("left"), F.col("body")).otherwise(F.substr("body", F.lit(1), (F.col("left") * CHARS_PER_TOKEN).cast("int")))
    parts = spent.select(group, "ordinal", F.concat(F.lit("\n\n---\n# "), "title", F.lit("\n\n"), body).alias("part"))
    told = parts.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "part"))), lambda x: x["part"]), "").alias("rest"), F.count("*").alias("sections"))
    prompt = F.concat("head", F.coalesce("rest", F.lit("")))
    return first.join(told, group, "left").select(group, prompt.alias("prompt"), estimate_tokens(prompt).alias("tokens"), F.coalesce("sections", F.lit(0)).alias("sections"))


def relevant_files(focus: DataFrame, nodes: DataFrame, most: int = BUDGET["files"]) -> DataFrame:
    """Files by the number of focus symbols in them, most first."""
    placed = focus.join(nodes.select("id", "file"), "id").where("file IS NOT NULL")
    return placed.groupBy("file").agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "file").limit(most)


def focus_set(seeds: DataFrame, callers: DataFrame, callees: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """``id, role, rank, depth``: each id once, in the first role it has, with the rank of the seed that led there.

    Roles in order: 0 method seeds(id, rank), 1 callers and 2 callees(seed, id, depth), 3 other seeds, 4 related types(seed, id).
    A seed whose id begins with ``method:`` is a method. Sort by role, rank, depth, id for the order of a context.
    """
    ranks = seeds.select(F.col("id").alias("seed"), "rank")
    own = seeds.select("id", F.when(F.col("id").startswith("method:"), 0).otherwise(3).alias("role"), "rank", F.lit(0).alias("depth"))
    around = [(1, callers), (2, callees)] + ([(4, related.withColumn("depth", F.lit(1)))] if related is not None else [])
    for role, part in around:
        own = own.unionByName(part.join(ranks, "seed").select("id", F.lit(role).alias("role"), "rank", "depth"))
    return own.groupBy("id").agg(F.min(F.struct("role", "rank", "depth")).alias("place")).select("id", "place.*")


def _page(name: str, df: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows of a page, numbered; cut before they are numbered, so that a page is never larger than ``most``."""
    first = df.orderBy(*order).limit(most)
    return first.select(F.lit(name).alias("page"), F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order)).alias("position"), "id")


def task_focus(nodes: DataFrame, edges: DataFrame, hits: DataFrame, budget: dict[str, int] = BUDGET) -> dict[str, DataFrame]:
    """What surrounds retrieved hits(id, rank): ``focus``, ``callers``, ``callees``, ``tests`` and the SQL and tables next to them.

    Only the first method hits, as many as the budget allows, are followed; all hits are in the focus.
    """
    methods = hits.where(F.col("id").startswith("method:")).orderBy("rank", "id").limit(budget["methods"])
    seeds = materialize(methods.select("id"), "seeds")
    impact = find_impact(nodes, edges, seeds, budget["hops"])
    related = impact["related"].select(F.col("id").alias("seed"), F.explode("related").alias("id"))
    of = lambda kind: related.where(F.col("id").startswith(f"{kind}:"))
    focus = focus_set(hits, impact["direct_callers"], impact["callees"], of("type").distinct())
    return {"focus": materialize(focus, "focus"), "callers": impact["direct_callers"], "callees": impact["callees"], "tests": impact["tests"], "sql": of("sql"), "tables": of("table")}


def task_pack(nodes: DataFrame, edges: DataFrame, hits: DataFrame, budget: dict[str, int] = BUDGET) -> DataFrame:
    """``page, position, id``: the rows of a task's pages, each page cut to the budget."""
    found, most = task_focus(nodes, edges, hits, budget), budget["methods"]
    pages = [
        _page("symbols", hits, ["rank", "id"], most),
        _page("files", relevant_files(found["focus"], nodes, budget["files"]).withColumnRenamed("file", "id"), [F.desc("symbols"), "id"], budget["files"]),
        _page("source", found["focus"].join(nodes.where("file IS NOT NULL").select("id"), "id", "left_semi"), ["role", "rank", "depth", "id"], most),
    ]
    pages += [_page(name, found[name].select("id").distinct(), ["id"], most) for name in ("callers", "callees", "tests", "sql", "tables")]
    return reduce(DataFrame.unionByName, pages)
