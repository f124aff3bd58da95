"""Chunkers: one row in, many rows out, with stable positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import tags, text as T


def slices(df: DataFrame, column: str, size: int = 12_000) -> DataFrame:
    """Fixed slices of a long text, numbered from 1; blank ones go, numbers keep the gaps."""
    n = F.greatest(F.ceil(F.length(column) / size), F.lit(1)).cast("int")
    out = df.withColumn("chunk", F.explode(F.sequence(F.lit(1), n)))
    return out.withColumn("part", F.substring(F.col(column), (F.col("chunk") - 1) * size + 1, F.lit(size))).where(F.trim("part") != "")


def packed(sentences: Column, most: int = 420, least: int = 35) -> Column:
    """Greedy packing of sentences into chunks of at most ``most`` characters.

    Sentences below ``least`` are dropped and longer ones than ``most`` are cut at a word.
    """
    cut = lambda s: F.when(F.length(s) > most, F.trim(F.regexp_replace(F.substring(s, 1, most), " [^ ]*$", ""))).otherwise(s)
    kept = F.transform(F.filter(sentences, lambda s: F.length(s) >= least), cut)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, s: Column) -> Column:
        full = (a["now"] != "") & (F.length(a["now"]) + F.length(s) + 1 > most)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(full | (a["now"] == ""), s).otherwise(F.concat_ws(" ", a["now"], s)).alias("now"),
        )

    return F.aggregate(kept, start, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def snippets(c: Column, most_words: int = 120, least_words: int = 35) -> Column:
    """Sentences of 45 to 450 characters packed by word count; short snippets go."""
    sentences = F.filter(F.transform(F.split(T.repaired(c), r"(?<=[.!?]) "), lambda x: F.trim(x)), lambda s: F.length(s).between(45, 450))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, s: Column) -> Column:
        full = (a["now"] != "") & (T.word_count(F.concat_ws(" ", a["now"], s)) > most_words)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(full | (a["now"] == ""), s).otherwise(F.concat_ws(" ", a["now"], s)).alias("now"),
        )

    chunks = F.aggregate(sentences, start, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    return F.filter(chunks, lambda s: T.word_count(s) >= least_words)


def windows(words: Column, size: int = 180, stride: int = 120, tail: bool = False) -> Column:
    """Sliding windows as structs ``(start, words)``; without ``tail`` the walk ends with the window that reaches the end."""
    n = F.size(words)
    last = F.greatest(n - 1, F.lit(0))
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    kept = starts if tail else F.filter(starts, lambda i: (i == 0) | (i - stride + size < n))
    return F.transform(kept, lambda i: F.struct(i.alias("start"), F.slice(words, i + 1, size).alias("words")))


def table_fields(pages: DataFrame, column: str = "text") -> DataFrame:
    """Rows of field names and values from lines: `name: value`, `a | b`, or a line with an amount.

    The first form that fits a line wins; ``idx`` is the line's place among those not blank.
    """
    rows = pages.select("*", F.posexplode(T.lines(F.col(column))).alias("idx", "line"))
    line = F.col("line")
    amount, date = T.TABLE_AMOUNT, r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b"
    left, right = F.trim(F.regexp_extract(line, "^([^:]*):", 1)), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
    colon = line.contains(":") & (right != "") & (right.rlike(amount) | right.rlike(date) | (F.length(right) <= 80))
    cells = F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    pipe = line.contains("|") & (F.size(cells) >= 2)
    loose = line.rlike(amount) & (F.length(line) <= 160)
    before = F.trim(F.split(line, r"\$")[0])
    name = F.when(colon, left).when(pipe, F.try_element_at(cells, F.lit(1))).when(loose, F.when(before == "", "value").otherwise(before))
    value = F.when(colon, right).when(pipe, F.array_join(F.slice(cells, 2, 1000), " | ")).when(loose, F.array_join(T.found(line, amount), " "))
    out = rows.withColumns({"field_name": name, "field_value": value}).where("field_name IS NOT NULL")
    plain = F.replace(T.collapsed(F.col("field_value")), F.lit(" ,"), F.lit(","))
    return out.withColumns({
        "normalized_field_name": F.trim(F.regexp_replace(F.lower("field_name"), "[^a-z0-9]+", " ")),
        "normalized_field_value": plain,
        "field_type": tags.field_type(F.col("field_name"), line),
        "numeric_value": T.numeric_value(plain),
        "value_unit": T.numeric_unit(plain),
    })


def evidence_rows(df: DataFrame) -> DataFrame:
    """Report pages to evidence rows: each text, then each table row as a sentence."""
    texts = df.select("filename", F.posexplode(F.concat("pre_text", "post_text")).alias("i", "t")).select("filename", F.concat(F.lit("text_"), "i").alias("key"), F.trim("t").alias("text"), F.lit("text").alias("kind"))
    rows = df.select("filename", F.col("table")[0].alias("header"), F.posexplode("table").alias("i", "row"))
    tables = rows.select("filename", F.concat(F.lit("table_"), "i").alias("key"), T.table_row_text(F.col("header"), F.col("row")).alias("text"), F.lit("table").alias("kind"))
    ident = F.concat(F.lit("finqa_a_"), F.substring(F.sha2(F.concat_ws("#", "filename", "key"), 256), 1, 24))
    return texts.unionByName(tables).withColumn("id", ident)
