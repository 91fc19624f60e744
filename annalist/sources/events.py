"""Event records from JSON, CSV and marked-up text, and their merge to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import lexicons as lx
from ..functions.columns import found, text_array, trimmed
from ..operators.running import running_index

EVENT_SCHEMA = (
    "title string, date string, location string, content string, keywords array<string>, source string"
)
EVENT_STRUCT = "title:string,date:string,location:string,content:string,keywords:array<string>,source:string"
FIELDS = ("title", "date", "location", "content", "keywords", "source")


def _defaults(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in lx.EVENT_DEFAULTS.items()], "keywords", "source"
    )


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of events; missing values get defaults. Files that do not parse add nothing."""
    return _defaults(_json_files(spark, path).where("_valid").select(F.inline("_items")))


def skipped_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that are not JSON arrays: ``(file, reason)``."""
    return _json_files(spark, path).where("NOT _valid").select("file", F.lit("invalid json").alias("reason"))


def _json_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its items, and whether it is an array at all."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    valid = F.try_parse_json("value").isNotNull() & trimmed(F.col("value")).startswith("[")
    return raw.select("file", valid.alias("_valid"), F.from_json("value", f"array<struct<{EVENT_STRUCT}>>").alias("_items"))


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with headers; defaults fill missing columns only, an empty cell stays empty.

    Files may name different columns, or the same ones in another order: those of one header are read together. Files that
    are no UTF-8 and rows that have not as many cells as their header add nothing, see ``skipped_csv``.
    """
    parts = [_csv_of_header(spark, files) for files in _files_by_header(spark, path).values()]
    whole = parts[0] if parts else spark.createDataFrame([], EVENT_SCHEMA)
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def skipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(file, reason)``: files that are no UTF-8, and how many rows of a file had too few or too many cells."""
    skipped = _not_utf8(spark, path)
    for files in _files_by_header(spark, path).values():
        rows = _csv_rows(spark, files)
        bad = rows.where(F.col(BAD_ROW).isNotNull())
        bad = bad.groupBy("_file").agg(F.count("*").alias("n"))
        skipped = skipped.unionByName(bad.select(F.col("_file").alias("file"), F.concat(F.lit("rows with a wrong number of cells: "), F.col("n").cast("string")).alias("reason")))
    return skipped


def _not_utf8(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("_metadata.file_name").alias("file"), F.lit("invalid utf-8").alias("reason"))


def _files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their first line; only the first block of each file is looked at."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"),
    )
    heads = lines.where("start = 0").groupBy("file", "name").agg(F.min_by("value", "line").alias("header"))
    heads = heads.join(_not_utf8(spark, path).select(F.col("file").alias("name")), "name", "left_anti")
    found: dict[str, list[str]] = {}
    for row in heads.orderBy("header", "file").collect():
        found.setdefault(row["header"].strip("\ufeff\r "), []).append(row["file"])
    return found


#: Where a row of CSV goes that does not fit its header.
BAD_ROW = "_bad_row"


def _csv_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows of files with one header, all cells as text, with the file's name; rows that do not fit are marked."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = reader.csv(files).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, BAD_ROW])
    rows = reader.schema(schema).option("columnNameOfCorruptRecord", BAD_ROW).option("columnPruning", False).csv(files)
    # Spark does not read bad rows alone, as a count would: the condition, always true, asks for another column as well.
    marked = F.when(F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0, F.col(BAD_ROW))
    return rows.withColumn(BAD_ROW, marked).withColumn("_file", F.col("_metadata.file_name"))


def _csv_of_header(spark: SparkSession, files: list[str]) -> DataFrame:
    raw = _csv_rows(spark, files).where(F.col(BAD_ROW).isNull())
    have = set(raw.columns)
    columns = [
        (F.coalesce(c, F.lit("")) if c in have else F.lit(default)).alias(c) for c, default in lx.EVENT_DEFAULTS.items()
    ]
    words = F.lit(None).cast("array<string>")
    if "keywords" in have:
        words = F.when(F.col("keywords") != "", F.transform(F.split("keywords", ","), trimmed))
    source = F.col("source") if "source" in have else F.lit(None).cast("string")
    return raw.select(*columns, words.alias("keywords"), source.alias("source"))


def events_from_text(df: DataFrame, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks between ``---`` marks; labelled lines become fields, the last label wins."""
    blocks = F.filter(F.transform(F.split(text, "---"), trimmed), lambda b: b != "")
    rows = df.select(*carry, F.posexplode(blocks).alias("block_index", "_block"))
    lines = F.transform(F.split("_block", "\n"), trimmed)
    labels = lx.EVENT_LABELS

    def labelled(name: str) -> Column:
        label = labels[name]
        hits = F.filter(lines, lambda line: line.startswith(label))
        value = trimmed(F.substr(F.element_at(hits, -1), F.lit(len(label) + 1)))
        return F.when(F.size(hits) > 0, value).otherwise(F.lit(lx.EVENT_DEFAULTS[name]))

    body = F.filter(lines, lambda line: ~F.exists(text_array(labels.values()), lambda label: line.startswith(label)))
    content = trimmed(F.array_join(body, "\n"))
    parsed = rows.select(
        *carry, "block_index", *[labelled(n).alias(n) for n in labels], content.alias("_content"), "_block"
    )
    kept = parsed.where((F.col("_content") != "") | (F.col("title") != lx.EVENT_DEFAULTS["title"]))
    return kept.select(
        *carry, "block_index", "title", "date", "location",
        F.when(F.col("_content") != "", F.col("_content")).otherwise(F.col("_block")).alias("content"),
        F.lit(None).cast("array<string>").alias("keywords"), F.lit(None).cast("string").alias("source"),
    )


def read_events_txt(spark: SparkSession, path: str) -> DataFrame:
    """Marked-up text files. Files that are no UTF-8 add nothing, see ``skipped_txt``."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("value")).where(F.is_valid_utf8("value"))
    return events_from_text(raw, "value").select(*FIELDS)


def skipped_txt(spark: SparkSession, path: str) -> DataFrame:
    """``(file, reason)``: files that are no UTF-8, and those in which no event was found."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), F.col("content").cast("string").alias("value"))
    fine = files.where(F.is_valid_utf8("value"))
    empty = fine.join(events_from_text(fine, "value", ("file",)).select("file"), "file", "left_anti")
    return _not_utf8(spark, path).unionByName(empty.select("file", F.lit("no events").alias("reason")))


def read_corpus(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """All events of a directory and the side table of what was skipped: ``(file, reason)``."""
    parts, skipped = [], spark.createDataFrame([], "file string, reason string")
    readers = (("*.json", read_events_json, skipped_json), ("*.csv", read_events_csv, skipped_csv), ("*.txt", read_events_txt, skipped_txt))
    for pattern, reader, report in readers:
        path = f"{directory}/{pattern}"
        if not _has_files(spark, path):
            continue
        parts.append(reader(spark, path))
        skipped = skipped.unionByName(report(spark, path))
    if not parts:
        return spark.createDataFrame([], EVENT_SCHEMA), skipped
    corpus = parts[0]
    for part in parts[1:]:
        corpus = corpus.unionByName(part, allowMissingColumns=True)
    return corpus, skipped


def _has_files(spark: SparkSession, path: str) -> bool:
    return not spark.read.format("binaryFile").load(path).select("path").limit(1).isEmpty() if _globs(spark, path) else False


def _globs(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException:
        return False


def merge_to_documents(events: DataFrame, order_col: str, source: Column | None = None) -> DataFrame:
    """One text per event: title, date in brackets, place, body; blank ones dropped; ids from zero.

    The body is the first present of content, text and description.
    """
    body = F.coalesce(*[F.col(c) for c in ("content", "text", "description") if c in events.columns])
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    text = F.concat_ws(
        "\n",
        F.when(filled(F.col("title")), F.col("title")),
        F.when(filled(F.col("date")), F.concat(F.lit("("), F.col("date"), F.lit(")"))),
        F.when(filled(F.col("location")), F.concat(F.lit("地点："), F.col("location"))),
        F.when(filled(body), body),
    )
    merged = events.select(F.col(order_col), text.alias("text"), (source if source is not None else F.lit(None).cast("string")).alias("source"))
    merged = merged.where(trimmed(F.col("text")) != "")
    return running_index(merged, [order_col], "_id").select(
        F.col("_id").cast("string").alias("id"), "text", "source", order_col
    )


def split_bullets(df: DataFrame, doc_id: str, text: str, bullet: str = "●", default_date: str = "未知") -> DataFrame:
    """A bullet line starts an event, later lines join it; text before the first is dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda s: s != "")
    joined = F.array_join(lines, "\n")
    pieces = F.filter(F.split(joined, f"(?m)^(?={bullet})"), lambda p: p.startswith(bullet))
    bodies = F.transform(pieces, lambda p: trimmed(F.substr(p, F.lit(len(bullet) + 1))))
    return _dated(df, doc_id, bodies, default_date)


def split_numbered(df: DataFrame, doc_id: str, text: str, default_date: str = "未知") -> DataFrame:
    """Lines that open with a number and a dot, one event each."""
    lines = F.transform(F.split(text, "\n"), lambda s: found(trimmed(s), r"^[0-9]+\.(.*)"))
    return _dated(df, doc_id, F.transform(F.filter(lines, lambda s: s.isNotNull()), trimmed), default_date)


def split_blocks(df: DataFrame, doc_id: str, text: str, block: str = r"\n\s*\n", default_date: str = "未知") -> DataFrame:
    """Blank-line blocks, their lines joined by blanks."""
    blocks = F.transform(
        F.split(text, block),
        lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), trimmed), lambda s: s != ""), " "),
    )
    return _dated(df, doc_id, F.filter(blocks, lambda b: b != ""), default_date)


def split_lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One event per non-blank line."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda s: s != "")
    return df.select(doc_id, F.posexplode(lines).alias("event_no", "content"))


def _dated(df: DataFrame, doc_id: str, bodies: Column, default_date: str) -> DataFrame:
    rows = df.select(doc_id, F.posexplode(bodies).alias("event_no", "content"))
    year = found(F.col("content"), "([0-9]{4}年)")
    return rows.withColumn("date", F.coalesce(year, F.lit(default_date)))


def carry_forward_year(
    df: DataFrame, doc_id: str, text: str,
    heading: str = "[一二三四五六七八九〇零○0-9]{4}年", date: str = "[0-9]{1,2}月[0-9]{1,2}日",
) -> DataFrame:
    """Lines under a year heading: ``(doc_id, section, event_no, year, date, content)``.

    The text is cut in front of each heading line, so the year of a section is its first
    line and nothing needs to be filled forward across rows.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda s: s != "")
    sections = F.split(F.array_join(lines, "\n"), f"(?m)^(?={heading}$)")
    dated = F.filter(sections, lambda s: s.rlike(f"(?m)\\A{heading}$"))
    rows = df.select(doc_id, F.posexplode(dated).alias("section", "_s")).select(
        doc_id, "section", F.substring_index("_s", "\n", 1).alias("year"),
        F.posexplode(F.filter(F.slice(F.split("_s", "\n"), 2, 1_000_000_000), lambda s: s != "")).alias("event_no", "content"),
    )
    day = found(F.col("content"), f"^({date})")
    return rows.select(
        doc_id, "section", "event_no", "year", F.concat_ws(" ", "year", day).alias("date"), "content"
    )
