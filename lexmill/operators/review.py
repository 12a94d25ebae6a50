"""Review tables: presets as rows, answers to cells with checked citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text

PRESET = "preset string, position int, name string, display_name string, kind string, description string, options array<string>"


def load_presets(spark: SparkSession, path: str) -> DataFrame:
    """Field definitions from JSON lines; kinds: string, date, boolean, enum, integer."""
    return spark.read.schema(PRESET).option("mode", "DROPMALFORMED").json(path)


def prompt_schema(fields: DataFrame) -> DataFrame:
    """(preset, n_fields, schema): one line a field, in order."""
    line = text.prompt_field("name", "kind", "description", F.coalesce("options", F.array().cast("array<string>")))
    parts = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return fields.groupBy("preset").agg(F.count("*").alias("n_fields"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("schema"))


#: Fields a preset may have.
MOST_FIELDS = 500


def preset(presets: DataFrame, name: str) -> list[Row]:
    """The fields of one preset, in order; a preset of more than MOST_FIELDS is refused."""
    rows = presets.where(F.col("preset") == name).orderBy("position").limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"preset {name!r} has more than {MOST_FIELDS} fields")
    return rows


def answered(v: Column, field: Row) -> Column:
    """What an answer (a variant) tells of a field: a plain value, or an object of value, quote, page and section."""
    path = f"$['{field.name}']"
    nested = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.lit(False))
    part = lambda p, kind="string": F.when(nested, F.try_variant_get(v, f"{path}.{p}", kind))
    value = F.when(nested, part("value")).otherwise(F.try_variant_get(v, path, "string"))
    wrong = F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "no object")
    if field.kind == "enum":
        wrong = wrong.when(value.isNotNull() & ~value.isin(*(field.options or [])), "no option")
    if field.kind == "integer":
        wrong = wrong.when(value.isNotNull() & value.try_cast("long").isNull(), "no integer")
    quote = F.nullif(F.substring(part("quote"), 1, 200), F.lit(""))
    return F.struct(F.lit(field.name).alias("field"), value.alias("value"), quote.alias("quote"), part("section").alias("section"), F.coalesce(part("page", "int"), F.lit(1)).alias("told"), wrong.alias("error"))


def cells(answers: DataFrame, fields: list[Row], pages: DataFrame) -> DataFrame:
    """(doc, field, value, page, section, quote, error) of each answer (doc, answer) and each field.

    A value may be plain or {value, quote, page, section}; quotes are cut at 200 characters, and a quote
    found in the document's pages (doc, page, text) by its first 50 characters gets that page, else the page it tells.
    A missing field gives a null value; error tells of answers that are no JSON object, and of values that are no
    option of an enum or no integer (these values stay).
    """
    # the answer is parsed once, not for each use of it
    told = text.once(F.try_parse_json(text.strip_fence("answer")), lambda v: F.array(*(answered(v, f) for f in fields)))
    rows = answers.select("doc", F.explode(told).alias("x")).select("doc", "x.*")
    norm = lambda c: F.lower(text.squeeze(c))
    asked = rows.where("quote is not null").select("doc", "field", norm(F.substring("quote", 1, 50)).alias("q"))
    # quotes are short, so they are hashed; the pages aren't sorted
    seen = asked.hint("shuffle_hash").join(pages.select("doc", "page", norm("text").alias("t")), "doc").where("contains(t, q)").groupBy("doc", "field").agg(F.min("page").alias("found"))
    out = rows.join(seen, ["doc", "field"], "left")
    cited = F.col("quote").isNotNull()
    return out.select("doc", "field", "value", F.when(cited, F.coalesce("found", "told")).alias("page"), F.when(cited, F.col("section")).alias("section"), "quote", "error")


def sheets(cells: DataFrame, fields: list[Row]) -> dict[str, DataFrame]:
    """K7: the sheets of a review: data (a row a document, a column a field), citations, and a summary of each field."""
    names = [f.name for f in fields]
    count = lambda c: F.count_if(c).alias
    summary = cells.groupBy("field").agg(count(F.col("value").isNotNull())("filled"), count(F.col("quote").isNotNull())("cited"), count(F.col("error").isNotNull())("errors"))
    return {
        "data": cells.groupBy("doc").pivot("field", names).agg(F.first("value")),
        "citations": cells.where("quote is not null").select("doc", "field", "page", text.squeeze("quote").alias("quote")),
        "summary": summary,
    }


#: Characters of a bin of positions.
BIN = 2048


def page_at(positions: DataFrame, pages: DataFrame) -> DataFrame:
    """The page whose [char_start, char_end) holds the position, within each document.

    Positions and pages meet by (doc, bin); a page is told in every bin it reaches, so no position meets a page that
    is far away, and a wide page or a long document is dealt over its bins.
    """
    wide = pages.where("char_start < char_end").withColumn("_bin", F.explode(F.sequence(F.expr(f"char_start div {BIN}"), F.expr(f"(char_end - 1) div {BIN}"))))
    near = positions.withColumn("_bin", F.expr(f"pos div {BIN}")).join(wide, ["doc", "_bin"])
    return near.where("char_start <= pos and pos < char_end").select("doc", "pos", "page")


def context(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc, context) of long cells (doc, field, value): one line for each value that is not null, in the fields' order.

    Truth values are Yes and No. Fields (name, display_name, position, kind) are a preset's: few, so they are broadcast.
    """
    told = F.when(F.col("kind") == "boolean", F.when(F.lower("value").isin("true", "1", "yes"), "Yes").otherwise("No")).otherwise(F.col("value"))
    rows = cells.where("value is not null").join(F.broadcast(fields.select(F.col("name").alias("field"), "display_name", "position", "kind")), "field")
    line = F.concat(F.lit("- **"), F.col("display_name"), F.lit("**: "), told)
    parts = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return rows.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("context"))


def as_map(cells: DataFrame) -> DataFrame:
    """(doc, fields) with the cells of a document as a map."""
    return cells.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def history(messages: DataFrame, key: str, order: str, most: int = 10) -> DataFrame:
    """The last messages of each conversation."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
