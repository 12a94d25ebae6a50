"""Articles by one fold over a text, against windows over its lines."""

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import strip
from lexmill.operators import articles as fold
from lexmill.operators import chunk

FLAGS = "(?iu)"
ARTICLE = fold.ARTICLE.pattern


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", strip("line"))


def hierarchy(rows: DataFrame, key: str) -> DataFrame:
    """Each line with the headings above it; a heading resets those below its level."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    for name, pattern, word in fold.LEVELS:
        pattern = FLAGS + pattern
        number = F.coalesce(*(F.nullif(F.regexp_extract("line", pattern, k), F.lit("")) for k in (1, 2, 3)))
        label = F.regexp_extract("line", pattern, 4)
        own = F.concat(number, F.lit(f". {word}: "), label) if name != "section" else F.when(number.isNull(), F.concat(F.lit("Abschnitt: "), label)).otherwise(F.concat(F.lit("Abschnitt "), number, F.lit(": "), label))
        rows = rows.withColumn(f"_{name}", F.when(F.col("line").rlike(pattern), own))
    above = None
    for name, *_ in fold.LEVELS:
        # the place of the latest heading of a higher level; an older one of this level is void
        last = F.last(F.when(F.col(f"_{name}").isNotNull(), F.struct("line_no", F.col(f"_{name}").alias("v"))), True).over(w)
        rows = rows.withColumn(f"_l_{name}", last)
        value = F.col(f"_l_{name}.v")
        place = F.col(f"_l_{name}.line_no")
        rows = rows.withColumn(name, value if above is None else F.when(above.isNull() | (place > above), value))
        above = place if above is None else F.greatest(above, place)
    return rows.drop(*(f"_{n}" for n, *_ in fold.LEVELS), *(f"_l_{n}" for n, *_ in fold.LEVELS))


def by_windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, article_number, article_title, part, title, chapter, section, start_line, end_line, article_text)."""
    rows = hierarchy(lines(df, key, text), key)
    by_line = Window.partitionBy(key).orderBy("line_no")
    ahead = F.lead("line").over(by_line)
    inline = F.nullif(F.regexp_extract("line", ARTICLE, 2), F.lit(""))
    heading = F.when((ahead != "") & ~ahead.rlike("^[0-9¹²³]+") & ~ahead.startswith("Art."), ahead)
    is_article = F.col("line").rlike(ARTICLE)
    rows = rows.withColumns({
        "article_number": F.when(is_article, F.regexp_extract("line", ARTICLE, 1)),
        "article_title": F.when(is_article, F.coalesce(inline, heading)),
        "_own_line": F.when(is_article, F.when(inline.isNull() & heading.isNotNull(), 2).otherwise(1)),
    })
    number = F.sum(is_article.cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_n", number).where("_n > 0")
    # an article's lines are one group of (key, _n): sorted and joined there
    body = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    first = lambda c: F.min_by(c, "line_no").alias(c)
    got = rows.groupBy(key, "_n").agg(*(first(c) for c in ("article_number", "article_title", "part", "title", "chapter", "section", "_own_line")), F.min("line_no").alias("start_line"), (F.max("line_no") + 1).alias("end_line"), body.alias("_body"))
    text_ = F.array_join(F.transform(F.slice("_body", F.col("_own_line") + 1, F.size("_body")), lambda x: x["line"]), "\n")
    return got.withColumn("article_text", strip(F.regexp_replace(text_, r"^\n+|\n+$", ""))).drop("_n", "_body", "_own_line")



def statute(rng):
    menu = ["1. Teil: Anfang", "2. Titel: Mitte", "Titre 3e: milieu", "Titolo 4: x", "1. Kapitel: Eins", "Capitolo 2º: due", "Abschnitt: Rest", "3. Abschnitt: Mehr", "Section 5 : fin", "Teil", "Art. 1 Zweck", "Art. 2", "Art. 3a", " Art. 4bis Ende ", "Art.5ter",
            "Geltung", "1 Nummer", "¹ Absatz", "", "  Text mit Worten ", "Art. x", "Artikel 7"]
    return "\n".join(rng.choices(menu, k=rng.randint(0, 40)))


def test_fold_equals_windows(spark):
    rng = random.Random(1)
    rows = [(i, statute(rng)) for i in range(150)] + [(200, None), (201, ""), (202, "keine Artikel"), (203, "Art. 1")]
    df = spark.createDataFrame(rows, "sr int, text string")
    columns = ["sr", "article_number", "article_title", "part", "title", "chapter", "section", "start_line", "end_line", "article_text"]
    got = sorted(map(tuple, fold.articles(df, "sr", "text").select(columns).collect()), key=str)
    want = sorted(map(tuple, by_windows(df.where("text is not null"), "sr", "text").select(columns).collect()), key=str)
    assert got == want and len(got) > 500


def test_long_articles_are_split(spark):
    word = "wort " * 12
    texts = [f"kurz {word}", f"1 {word}\n2 {word}\n3 {word}", f"a. {word}\nb. {word}", f"{word}\n\n{word}", f"{word.strip()}. " * 6]
    df = spark.createDataFrame([(k, t.strip()) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.p for r in df.select("k", fold.paragraphs(F.col("t"), 20).alias("p")).collect()}
    assert [len(got[k]) for k in range(4)] == [1, 3, 2, 2] and [p.split()[0] for p in got[1]] == ["1", "2", "3"]
    assert 3 <= len(got[4]) <= 6 and " ".join(got[4]) == texts[4].strip()


def test_articles_of_some_texts_at_a_time(spark):
    """rows are told as they come, not as one array a text; keys keep their values, nulls too."""
    from pyspark.sql import functions as F

    big = (1 << 60) + 1
    rows = [(big, "Art. 1 Zweck\nA\nArt. 2\nB"), (None, "Art. 3\nC"), (3, None), (4, "nothing")]
    got = fold.articles(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(((r.k or 0), r.article_number) for r in got.collect()) == [(0, "3"), (big, "1"), (big, "2")]
    assert got.where(F.col("k").isNull()).count() == 1
