"""Free-form files: any encoding, nested JSON, segment sets, graph tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import lexicons as lx
from ..functions.columns import let, trimmed
from ..functions.text import record_to_text, stringify


def read_text_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of each file, read once. Valid UTF-8 stays in the JVM, only other bytes go to Python."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    as_text = F.col("content").cast("string")
    valid = F.is_valid_utf8(as_text)
    other = _from_gb18030(F.when(~valid, F.col("content")))
    return raw.select("path", F.when(valid, F.regexp_replace(as_text, "^\ufeff", "")).otherwise(other).alias("text"))


@F.pandas_udf(T.StringType())
def _from_gb18030(content: pd.Series) -> pd.Series:
    return content.map(decode_bytes, na_action="ignore")


def decode_bytes(content: bytes) -> str:
    """Bytes that are no UTF-8: GB 18030, or what is left of UTF-8 without the bad bytes."""
    text = content.decode("gb18030", errors="replace")
    return text if "\ufffd" not in text else content.decode("utf-8", errors="ignore")


def nested_items(root: object) -> Iterator[tuple[int, str | None, object]]:
    """All values of a JSON tree in document order, as ``(depth, key, value)``; items of lists have no key.

    A caller that does not want what lies below an object empties it.
    """
    waiting = [(0, None, root)]
    while waiting:
        depth, key, value = waiting.pop()
        yield depth, key, value
        below = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
        waiting += [(depth + 1, k, v) for k, v in list(below)[::-1]]


def _parse(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def records_from_json(files: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Records at any depth of JSON texts ``(path, text)``: ``(path, record_index, record)``.

    Nesting has no bound, which column expressions cannot follow, so each file is walked
    in an Arrow batch; the record comes out as a variant for the JVM to read.
    """
    names = frozenset(fields or lx.RECORD_FIELDS)

    def outermost(text: str) -> Iterator[str]:
        for _, _, value in nested_items(_parse(text)):
            if isinstance(value, dict) and names & value.keys():
                yield json.dumps(value, ensure_ascii=False)
                value.clear()  # records inside a record are part of it

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch.assign(json=[list(outermost(t)) for t in batch["text"]])[["path", "json"]]
            found = found[found["json"].map(len) > 0].explode("json")
            yield found.assign(record_index=found.groupby(level=0).cumcount().astype("int32"))[["path", "record_index", "json"]]

    walked = files.select("path", "text").mapInPandas(walk, "path string, record_index int, json string")
    return walked.select("path", "record_index", F.parse_json("json").alias("record"))


def record_texts(records: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Labelled text of each record with its title, date and place."""
    labels = labels or lx.RECORD_FIELDS

    def field(name: str):
        as_list = F.try_variant_get("record", f"$.{name}", "array<string>")
        as_map = F.try_variant_get("record", f"$.{name}", "map<string,string>")
        as_text = F.try_variant_get("record", f"$.{name}", "string")
        return (
            F.when(as_list.isNotNull(), stringify(as_list, "array"))
            .when(as_map.isNotNull(), stringify(as_map, "map"))
            .otherwise(stringify(as_text))
        )

    values = {name: field(name) for name in labels}
    rows = records.select(
        "path", "record_index", record_to_text(values, labels).alias("text"),
        *[values[c].alias(c) for c in ("title", "date", "location") if c in values],
    )
    return rows.where(F.col("text") != "")


def read_recursive_json(spark: SparkSession, path: str) -> DataFrame:
    return record_texts(records_from_json(read_text_any_encoding(spark, path)))


def flatten_json_text(files: DataFrame, fields: list[str] | None = None, max_depth: int = 10) -> DataFrame:
    """All descriptive strings of a JSON text joined by blank lines: ``(path, n_texts, text)``."""
    names = frozenset(fields or lx.FLAT_TEXT_FIELDS)

    def strings(text: str) -> list[str]:
        # A string lies one level below the object that holds it.
        return [
            value for depth, key, value in nested_items(_parse(text))
            if isinstance(value, str) and key in names and depth <= max_depth + 1
        ]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch["text"].map(strings)
            yield pd.DataFrame({"path": batch["path"], "n_texts": found.map(len).astype("int32"), "text": found.map("\n\n".join)})

    return files.select("path", "text").mapInPandas(walk, "path string, n_texts int, text string")


SEGMENT_SCHEMA = "array<struct<id:string,chapter:string,historical_tag:array<string>,original_text:string>>"


def segment_sets(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of accepted JSON texts ``(path, text)``, and a report of all files.

    A file counts only if it is an array whose items all carry a text.
    """
    parsed = files.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.startswith(trimmed(F.col("text")), F.lit("[")).alias("_is_array"),
        F.from_json("text", SEGMENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("_items"),
        F.try_parse_json("text").isNotNull().alias("_valid"),
    )
    complete = F.forall("_items", lambda s: F.coalesce(s["original_text"].isNotNull(), F.lit(False)))
    accepted = F.coalesce(F.col("_valid") & F.col("_is_array") & complete, F.lit(False))
    reason = F.when(~F.col("_valid"), "invalid json").when(~accepted, "schema mismatch")
    segments = parsed.where(accepted).select("source_file", F.inline("_items"))
    return segments, parsed.select("source_file", accepted.alias("loaded"), reason.alias("reason"))


def read_segment_sets(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.text(f"{directory}/*.json", wholetext=True)
    return segment_sets(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


#: Current and older file names of the graph tables, and the columns each must offer.
GRAPH_TABLES = {
    "entities": (("entities", "create_final_entities"), {"id": ["id"], "title": ["title", "name"], "type": ["type"], "description": ["description"]}),
    "relationships": (
        ("relationships", "create_final_relationships"),
        {"source": ["source", "source_title"], "target": ["target", "target_title"], "description": ["description"], "weight": ["weight"]},
    ),
    "text_units": (("text_units", "create_final_text_units"), {"id": ["id"], "text": ["text", "content"]}),
    "communities": (
        ("community_reports", "create_final_community_reports"),
        {"community": ["community", "id"], "title": ["title"], "summary": ["summary"], "full_content": ["full_content", "summary"]},
    ),
}


def read_graph_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The four graph tables with uniform columns; a missing table is empty."""
    return {name: _graph_table(spark, directory, *spec) for name, spec in GRAPH_TABLES.items()}


def _graph_table(spark: SparkSession, directory: str, files: tuple[str, ...], columns: dict[str, list[str]]) -> DataFrame:
    for file in files:
        try:
            raw = spark.read.parquet(f"{directory}/{file}.parquet")
        except AnalysisException:
            continue
        picked = []
        for name, spellings in columns.items():
            present = [F.col(s).cast("double" if name == "weight" else "string") for s in spellings if s in raw.columns]
            default = F.lit(1.0) if name == "weight" else F.lit(None).cast("string")
            picked.append((F.coalesce(*present, F.lit(1.0)) if name == "weight" and present else F.coalesce(*present) if present else default).alias(name))
        return raw.select(*picked)
    schema = T.StructType([T.StructField(n, T.DoubleType() if n == "weight" else T.StringType()) for n in columns])
    return spark.createDataFrame([], schema)


def is_ready(tables: dict[str, DataFrame]) -> bool:
    """Retrieval needs entities."""
    return not tables["entities"].isEmpty()


#: Stand for an escaped backslash and an escaped quote while quotes are judged; not characters of any text.
ESCAPES = {"\\\\\\\\": "\ufdd0", '\\\\"': "\ufdd1"}


def repaired_quotes(text: Column) -> Column:
    """A JSON text whose stray quotes, those inside strings that no structural character follows, are typographic.

    Each quote gets a flag, whether structure or the end follows it. Written as a row of flags, a literal is any quote,
    then quotes that close nothing, then one that closes: a regular language, so no state is carried along.
    """
    held = text
    for pattern, stand_in in ESCAPES.items():
        held = F.regexp_replace(held, pattern, stand_in)

    def with_pieces(pieces: Column) -> Column:
        after = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        last = F.size(pieces) - 2
        structure = lambda p, i: p.rlike(r"\A[ \t\r\n]*[,:}\]]") | ((i == last) & (F.btrim(p, F.lit(" \t\r\n")) == ""))
        flags = F.array_join(F.transform(after, lambda p, i: F.when(structure(p, i), "1").otherwise("0")), "")
        literals = F.regexp_extract_all(flags, F.lit("(.0*1?)"), F.lit(1))
        closed = lambda g: (F.length(g) > 1) & g.endswith("1")
        # Of n stray quotes, the odd ones open and the even ones close.
        stray = lambda g: F.lpad(F.lit(""), F.length(g) - F.when(closed(g), 2).otherwise(1), F.lit("“”"))
        marks = F.array_join(F.transform(literals, lambda g: F.concat(F.lit('"'), stray(g), F.when(closed(g), '"').otherwise(""))), "")
        return let(marks, lambda m: F.concat(
            F.get(pieces, F.lit(0)),
            F.array_join(F.transform(after, lambda p, i: F.concat(F.substring(m, i + 1, F.lit(1)), p)), ""),
        ))

    mended = let(F.split(held, '"', -1), with_pieces)
    for original, stand_in in (("\\\\", "\ufdd0"), ('\\"', "\ufdd1")):
        mended = F.replace(mended, F.lit(stand_in), F.lit(original))
    return mended


def repair_json_quotes(df: DataFrame, text: str) -> DataFrame:
    """Texts with stray inner quotes made typographic."""
    return df.withColumn(text, repaired_quotes(F.col(text)))
