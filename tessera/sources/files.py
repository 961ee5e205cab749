"""Readers and writers of evaluation files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paraphrase import cell_text, coerced, literal_pattern
from tessera.sources.adapters import FORMATS

#: One evaluation row; ``_ord`` keeps the file's order for last-wins rules.
EVALUATION = "question_id string, question string, answer string, prediction string, modality string, source string, viz_type string, difficulty string, task string, exact_match double, f1 double, numeric_accuracy double"
ITEM = "question_id string, question string, answer string, modality string, data_id string, task string, difficulty string, viz_methods array<string>, metadata map<string,string>, data_format string, data string, source string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; a path that isn't there has none. Strict fails on a bad line, else such lines stay in ``_corrupt``."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """The good rows and how many lines were bad; blank lines count as neither."""
    rows = read_jsonl(spark, path, schema, strict=False)
    if "_corrupt" not in rows.columns:
        return rows, 0
    lines = spark.read.text(path).filter("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = parsed.filter("r._corrupt is not null").count()
    return parsed.filter("r._corrupt is null").select("r.*").drop("_corrupt"), bad


def read_checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict rows; raises if there are none."""
    rows = read_jsonl(spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def normalized_records(rows: DataFrame) -> DataFrame:
    """Either naming of the scores, defaults for what is missing."""
    score = lambda *names: F.coalesce(*[F.col(n).cast("double") for n in names if n in rows.columns], F.lit(0.0))
    text = lambda name, default="": F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)
    return rows.select(*[text(c).alias(c) for c in ("model", "question_id", "question", "answer", "prediction", "viz_type", "modality")], text("source", "synthetic").alias("source"), score("exact_match", "exact").alias("exact_match"), score("f1").alias("f1"), score("numeric_accuracy", "numeric").alias("numeric_accuracy"))


def read_models(spark: SparkSession, paths: dict[str, str], least: int = 1) -> DataFrame:
    """One file a model, joined with ``model`` and ``source_group``; raises if a model has fewer rows than ``least``."""
    out = None
    for model, path in sorted(paths.items()):
        rows = read_jsonl(spark, path, EVALUATION).withColumn("model", F.lit(model))
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("source_group", F.when(F.coalesce("source", F.lit("synthetic")) == "synthetic", "synthetic").otherwise("real_world"))
    counts = {r["model"]: r["count"] for r in out.groupBy("model").count().toLocalIterator()}  # a row a model
    if short := [m for m in paths if counts.get(m, 0) < least]:
        raise ValueError(f"fewer than {least} rows: {', '.join(sorted(short))}")
    return out


def decoded_items(items: DataFrame) -> DataFrame:
    """Payloads by their tag: a variant for tables, series and graphs, null for raw ones."""
    known = F.col("data_format").isin("dataframe_records", "networkx_node_link", "timeseries_list", "json_dict")
    return items.withColumn("source", F.coalesce("source", F.lit("synthetic"))).withColumn("payload", F.when(known, F.try_parse_json("data")))


def series_points(items: DataFrame) -> DataFrame:
    """(data_id, t, value) of items that hold a series."""
    values = F.variant_get("payload", "$", "array<double>")
    return items.filter("data_format = 'timeseries_list'").select("data_id", F.posexplode(values).alias("t", "value"))


def graph_edges(items: DataFrame) -> DataFrame:
    """(data_id, src, dst), src < dst, of items that hold a node-link graph."""
    links = F.coalesce(F.try_variant_get("payload", "$.links", "array<struct<source:long,target:long>>"), F.try_variant_get("payload", "$.edges", "array<struct<source:long,target:long>>"))
    e = items.filter("data_format = 'networkx_node_link'").select("data_id", F.explode(links).alias("e"))
    return e.select("data_id", F.least("e.source", "e.target").alias("src"), F.greatest("e.source", "e.target").alias("dst")).filter("src < dst").distinct()


def table_cells(claims: DataFrame) -> DataFrame:
    """Long cells of claim tables: the first row of each table_id, headers cleaned, rows padded or cut to the header; a row number column where no column is numeric."""
    from tessera.operators.dedupe import first_wins

    first = first_wins(claims, ["table_id"], ["id"])
    rows = first.select("table_id", "table_column_names", F.posexplode("table_content_values").alias("row_idx", "cells"))
    cells = rows.select("table_id", "row_idx", F.posexplode("table_column_names").alias("col_idx", "name"), "cells").select("table_id", "row_idx", "col_idx", cell_text(F.col("name")).alias("col_name"), F.coalesce(F.get("cells", F.col("col_idx")), F.lit("")).alias("raw"))
    cells = cells.select("table_id", "row_idx", "col_idx", "col_name", coerced(F.col("raw")).alias("num_value"), cell_text(F.col("raw")).alias("str_value"))
    lacking = cells.groupBy("table_id").agg(F.count("num_value").alias("k")).filter("k = 0").select("table_id")
    index = cells.select("table_id", "row_idx").distinct().join(lacking, "table_id").select("table_id", "row_idx", F.lit(-1).alias("col_idx"), F.lit("__row_index__").alias("col_name"), F.col("row_idx").cast("double").alias("num_value"), F.col("row_idx").cast("string").alias("str_value"))
    return cells.unionByName(index)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of one JSON array, label or else human_label."""
    schema = "id string, claim string, label string, human_label string, table_id string, table_caption string, table_column_names array<string>, table_content_values array<array<string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("label", F.coalesce("label", "human_label", F.lit("")))


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """(series, t, value) of every numeric column but ``date`` of CSV files."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    columns = [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType) and f.name != "date"]
    order = F.col("date") if "date" in rows.columns else F.monotonically_increasing_id()
    from pyspark.sql import Window

    numbered = rows.withColumn("__file", F.input_file_name())
    numbered = numbered.withColumn("t", F.row_number().over(Window.partitionBy("__file").orderBy(order)) - 1)
    return numbered.select("t", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["t"], columns, "series", "value")


def read_ratings(spark: SparkSession, path: str, canon: Column | None = None) -> DataFrame:
    """(item_id, evaluator, rating) of a long or a wide sheet; blank ratings are dropped, unknown ones raise."""
    rows = spark.read.option("header", True).csv(path)
    if "rating" in rows.columns and "evaluator" in rows.columns:
        long = rows.select("item_id", "evaluator", "rating")
    else:
        long = rows.unpivot(["item_id"], [c for c in rows.columns if c != "item_id"], "evaluator", "rating")
    low = F.lower(F.trim("rating"))
    known = F.when(low.isin("correct", "c", "1", "yes"), "c").when(low.isin("ambiguous", "a"), "a").when(low.isin("incorrect", "i", "0", "no"), "i").otherwise(F.raise_error(F.concat(F.lit("unknown rating "), F.col("rating"))))
    return long.filter("trim(coalesce(rating, '')) <> ''").withColumn("rating", canon if canon is not None else known)


def image_index(spark: SparkSession, path: str, formats: Sequence[str] = FORMATS) -> DataFrame:
    """(question_id, viz_type, path, width, height) of PNG files named question_format.png, the longest format that fits; sizes from the header."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.png$", 1)
    pattern = rf"^(.*)_({literal_pattern(list(formats))})$"
    size = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return files.select(F.regexp_extract(name, pattern, 1).alias("question_id"), F.regexp_extract(name, pattern, 2).alias("viz_type"), "path", size(17).alias("width"), size(21).alias("height")).filter("viz_type <> ''")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a file that holds a JSON array or ids between white space."""
    text = spark.read.option("wholetext", True).text(path)
    array = F.from_json("value", "array<string>")
    ids = F.when(F.trim("value").startswith("["), array).otherwise(F.split(F.trim("value"), r"\s+"))
    return text.select(F.explode(ids).alias("id")).filter("id <> ''").distinct()


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One file with a header, for reports of few rows."""
    rows.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _cells(rows: DataFrame, columns: Sequence[str], decimals: int, escape) -> list[list[str]]:
    shown = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    held = rows.select(*columns).limit(10_001).collect()
    if len(held) > 10_000:
        raise ValueError("a report holds at most 10,000 rows")
    return [[escape(shown(r[c])) for c in columns] for r in held]


def markdown(rows: DataFrame, columns: Sequence[str], decimals: int = 2) -> str:
    """A report table; reports hold at most 10,000 rows."""
    body = _cells(rows, columns, decimals, lambda t: t.replace("|", "\\|"))
    return "\n".join("| " + " | ".join(x) + " |" for x in [list(columns), ["---"] * len(columns), *body])


def latex(rows: DataFrame, columns: Sequence[str], decimals: int = 2) -> str:
    """A tabular with escaped text; reports hold at most 10,000 rows."""
    special = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    escape = lambda t: "".join(special.get(c, c) for c in t)
    body = _cells(rows, columns, decimals, escape)
    lines = [" & ".join(x) + r" \\" for x in [[escape(c) for c in columns], *body]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}"])


def read_config(path: str) -> dict:
    """A configuration of nested ``key: value`` lines, by indentation; numbers, booleans and null as such. Read on the driver: it is small."""
    root: dict = {}
    stack = [(-1, root)]
    with open(path) as lines:
        for line in lines:
            bare = line.split(" #")[0].rstrip()
            if not bare.strip() or bare.lstrip().startswith("#"):
                continue
            depth = len(bare) - len(bare.lstrip())
            key, _, text = bare.strip().partition(":")
            while stack[-1][0] >= depth:
                stack.pop()
            if text.strip():
                stack[-1][1][key] = _scalar(text.strip())
            else:
                stack[-1][1][key] = child = {}
                stack.append((depth, child))
    return root


def _scalar(text: str):
    plain = {"true": True, "false": False, "null": None, "~": None}
    if text.lower() in plain:
        return plain[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("\"'")


def read_all_jsonl(spark: SparkSession, folder: str, schema: str, strict: bool = True) -> DataFrame:
    """All JSON-lines files of a folder, as one."""
    return read_jsonl(spark, f"{folder}/*.jsonl", schema, strict)


def png_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height of each PNG, from its header alone; null for files that aren't PNGs."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(folder)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return found.select("path", F.when(png, number(17)).alias("width"), F.when(png, number(21)).alias("height"))


def assembled_ratings(spark: SparkSession, sheets: dict[str, str]) -> DataFrame:
    """Sheets of several annotators, (name, path), in long form with ``evaluator``; columns that a sheet lacks are null."""
    if not sheets:
        raise ValueError("there's no sheet")
    frames = [spark.read.option("header", True).csv(path).withColumn("evaluator", F.lit(name)) for name, path in sheets.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_items(items: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Benchmark items as JSON lines with just these columns, nulls kept."""
    items.select(*columns).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def bundle(results: dict[str, DataFrame]) -> DataFrame:
    """(name, json): result tables, each as one JSON array in row order of its JSON; for results of few rows."""
    out = None
    for name, rows in results.items():
        text = F.to_json(F.struct(*rows.columns))
        one = rows.select(text.alias("j")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("]")).alias("json")).select(F.lit(name).alias("name"), "json")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("there's no result")
    return out
