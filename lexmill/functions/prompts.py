"""Rows as blocks of a prompt (F33, F36), citations and links (F32), and guarded JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import bge_url, strip_fence

# fixed values: headings and tags that prompts are made of
PARTS = [("regeste", "--- REGESTE (Summary) ---"), ("facts", "--- FACTS ---"), ("reasoning", "--- REASONING ---"), ("decision", "--- DECISION ---")]
TAGS = {"codex": ("[CODEX - Swiss Laws]", "[END CODEX]"), "library": ("[LIBRARY - Case Law]", "[END LIBRARY]"), "dossier": ("[DOSSIER - Your Documents]", "[END DOSSIER]")}
HISTORY = ("[CHAT HISTORY]", "[END CHAT HISTORY]")


def told(c: Column, otherwise: str) -> Column:
    return F.coalesce(c, F.lit(otherwise))


def decision_block(number: Column, court: Column, date: Column, parts: dict[str, Column]) -> Column:
    """a decision with its filled sections, each under its heading and closed by an empty line."""
    head = F.concat(F.lit("=== DECISION: "), told(number, "Unknown"), F.lit(" ===\nCourt: "), told(court, "Unknown Court"), F.lit("\nDate: "), told(date, "Unknown Date"), F.lit("\n"))
    own = [F.when(F.coalesce(parts[k], F.lit("")) != "", F.concat(F.lit(f"\n{heading}\n"), parts[k], F.lit("\n"))).otherwise("") for k, heading in PARTS if k in parts]
    return F.concat(head, *own)


def law_blocks(articles: DataFrame, law: str, number: str, title: str, body: str, order: str, only: DataFrame | None = None) -> DataFrame:
    """(law, block) of rows of articles; only (law, number): the articles to show, for laws that have any there."""
    rows = articles.select(F.col(law).alias("law"), F.col(number).alias("number"), F.col(title).alias("title"), F.col(body).alias("body"), F.col(order).alias("order"))
    if only is not None:
        wanted = only.select(F.col(law).alias("law"), F.col(number).alias("number")).distinct().withColumn("wanted", F.lit(True))
        some = wanted.select("law").distinct().withColumn("some", F.lit(True))
        rows = rows.join(wanted, ["law", "number"], "left").join(some, "law", "left").where("wanted or some is null")
    line = F.concat(F.lit("Art. "), "number", F.lit(" "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("order", line.alias("line"))))
    head = F.concat(F.lit("=== LAW: SR "), F.col("law").cast("string"), F.lit(" ===\n"))
    return rows.groupBy("law").agg(parts.alias("parts")).select("law", F.concat(head, F.array_join(F.transform("parts", lambda x: F.concat(F.lit("\n"), x["line"])), "")).alias("block"))


def tagged(rows: DataFrame, by: str, lane: str, ident: str, body: str, order: str) -> DataFrame:
    """(by, context): the rows of each lane, in order, between the lane's tags; lanes without rows are left out."""
    line = F.concat(F.lit("- "), told(F.col(ident).cast("string"), "unknown"), F.lit(": "), told(F.col(body), ""))
    each = rows.groupBy(by, lane).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), line.alias("line")))).alias("x"))
    tags = lambda k: F.coalesce(*(F.when(F.col(lane) == name, pair[k]) for name, pair in TAGS.items()))
    place = F.coalesce(*(F.when(F.col(lane) == name, n) for n, name in enumerate(TAGS)))
    block = F.concat(tags(0), F.lit("\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n"), tags(1))
    kept = each.where(F.col(lane).isin(*TAGS)).select(by, F.struct(place.alias("place"), block.alias("block")).alias("x"))
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["block"]), "\n\n").alias("context"))


def history_block(turns: DataFrame, by: str, order: str, role: str, body: str, most: int = 10) -> DataFrame:
    """(by, history): the last 2 * most messages between tags."""
    near = turns.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_n") <= 2 * most)
    line = F.concat(F.when(F.col(role) == "user", "User: ").otherwise("Assistant: "), told(F.col(body), ""))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), line.alias("line"))))
    whole = F.concat(F.lit(HISTORY[0] + "\n"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), F.lit("\n" + HISTORY[1]))
    return near.groupBy(by).agg(whole.alias("history"))


def citation(decision: Column, abbreviation: Column, article: Column, number: Column) -> Column:
    """F32: an official decision's reference, else `ABBR Art. n`, else `SR n`."""
    official = F.when(F.upper(decision).rlike(r"^(?:CH[ -])?BGE[ -]"), bge_url(decision))
    return F.coalesce(official, F.concat(F.nullif(abbreviation, F.lit("")), F.lit(" Art. "), article), F.concat(F.lit("SR "), number))


def guarded(answer: Column, defaults: dict[str, str]) -> Column:
    """map of the keys of defaults from a JSON answer, fenced or not; a missing key has its default, an answer that is no object all of them."""
    got = F.from_json(strip_fence(answer), "map<string,string>")
    return F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), F.coalesce(F.try_element_at(got, F.lit(k)), F.lit(v)))))
