"""CSV ingest with type inference on NA-normalised text.

Quoted fields may hold quotes (doubled), commas and line breaks.  A file of any
size is read by many tasks all the same: its physical lines are scanned in
blocks, and a line starts a record where an even number of quotes stands before
it in its file.  Prefix sums over the blocks (one row each) and inside those blocks that
need it say so for every line; ``from_csv`` then reads the records.  A file whose
quotes do not stand at the ends of fields cannot be cut that way, and an input with one
is read by one task a file.

NA tokens become null first and the records are parsed once and written; one
aggregate over them types each column: numeric when every non-null value is written as a plain number
(integral ones become bigint), boolean when every row holds true or false.  This
mirrors the tabular read of the scoring job, where ``nan``/``NA``/empty mean missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from febrile import config as C
from febrile.session import ensure_checkpoint_dir, scratch_path


#: Text forms of numbers and booleans (a suffix such as D or F is no number).
NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"
BOOLEANS = ["True", "False", "TRUE", "FALSE", "true", "false"]


def na_normalised(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    at = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    return df.select([at[c] if c in (keep or []) else F.when(at[c].isin(*C.NA_TOKENS), F.lit(None).cast("string"))
                       .otherwise(at[c]).alias(c) for c in df.columns])


def _type_counts(names: list[str]) -> list[Column]:
    """Per column, how many values fail to be a double or a bigint, are booleans, or are there at all."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(names):
        v = F.col(f"`{c}`")
        aggs.append(F.count_if(v.isNotNull() & ~v.rlike(NUMBER)).alias(f"nondouble{i}"))
        aggs.append(F.count_if(v.isNotNull() & (~v.rlike(WHOLE) | v.try_cast("bigint").isNull())).alias(f"nonlong{i}"))
        aggs.append(F.count_if(v.isin(*BOOLEANS)).alias(f"bool{i}"))
        aggs.append(F.count(v).alias(f"n{i}"))
    return aggs


def _types_of(names: list[str], counts: Row) -> dict[str, str]:
    """Integral columns become bigint only without missing values (a gap makes
    the column double, as in the tabular read being rebuilt)."""
    types, rows = {}, counts["__rows"]
    for i, c in enumerate(names):
        if counts[f"n{i}"] == 0:
            types[c] = "double"          # all missing: numeric NaN column
        elif counts[f"bool{i}"] == rows:
            types[c] = "boolean"         # a gap leaves the column text, as in the tabular read
        elif counts[f"nondouble{i}"] > 0:
            types[c] = "string"
        elif counts[f"nonlong{i}"] == 0 and counts[f"n{i}"] == rows:
            types[c] = "bigint"          # integral without gaps; with gaps -> double
        else:
            types[c] = "double"
    return types


CSV_OPTIONS = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": True}
_RECORD_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


#: Bits of a row's place that number it inside its block; the block's rank stands above them.
PLACE_BITS = 33


def scan_csv_inferred(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      order_col: str | None = None) -> DataFrame:
    """Headered CSV -> typed DataFrame with NA tokens as null.

    Records end at ``\\n`` or ``\\r\\n``; line breaks inside quotes stay as they are written.
    ``order_col`` adds the row's place over all files (files by path, then rows
    as written), for rules where the first or last row counts.
    """
    whole = spark.read.options(**CSV_OPTIONS).csv(path)
    if not whole.columns:
        return whole
    placed = bool(order_col) and order_col not in whole.columns
    order = [F.col(f"`{order_col}`")] if placed else []
    raw = records(spark, path, [*whole.columns[:-1], whole.columns[-1].removesuffix("\r")], order_col if placed else None)
    if raw is None:
        raw = with_file_order(whole, order_col) if placed else whole
    text = na_normalised(raw, keep=[order_col] if placed else [])
    names = [c for c in text.columns if not placed or c != order_col]
    if schema is not None:
        return text.select(*order, *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    # parsed once and written; an observed write would type in the same job, but models cannot score in its session afterwards
    ensure_checkpoint_dir(spark)
    kept = scratch_path(spark, "csv-records")
    text.write.parquet(kept)
    text = spark.read.schema(text.schema).parquet(kept)
    types = _types_of(names, text.agg(*_type_counts(names)).first())
    return text.select(*order, *[F.col(f"`{c}`").try_cast(t).alias(c) if t != "string" else F.col(f"`{c}`") for c, t in types.items()])


def record_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The physical lines below ``path``, and one row for each block of a file.

    Lines: file, block, id (order inside the block), value, odd (1 where the line
    holds an odd number of quotes), opens (whether the quote without a partner stands at
    the start of a field).  They are written once, because the blocks of a file are not
    the same when it is scanned again.  Blocks: odd_before (odd lines before
    the block in its file), odd, rank (over all files), header (the place of the first line of the file that is not empty).
    """
    v = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
        ((F.octet_length(v) - F.octet_length(F.replace(v, F.lit('"'), F.lit("")))) % 2).alias("odd"))
    lines = lines.withColumns({
        "opens": F.when(F.col("odd") == 1, F.regexp_replace(v, '"[^"]*"', "").rlike('(^|,)"[^"]*$')),
        "empty": v.isin("", "\r", "\ufeff", "\ufeff\r")})
    kept = scratch_path(spark, "csv-lines")
    lines.write.parquet(kept)
    lines = spark.read.schema(lines.schema).parquet(kept)
    blocks = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.min(F.when(~F.col("empty"), F.col("id"))).alias("first"))
    # windows over one row a block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("*", (F.row_number().over(Window.orderBy("file", "block")) - 1).cast("bigint").alias("rank"),
                           F.coalesce(F.sum("odd").over(before), F.lit(0)).alias("odd_before"))
    first = F.min(F.when(F.col("first").isNotNull(), _place(F.col("rank"), F.col("first"))))
    blocks = blocks.select("file", "block", "odd", "odd_before", "rank", first.over(Window.partitionBy("file")).alias("header"))
    return lines, blocks.checkpoint(eager=True)


def _place(rank: Column, row_id: Column) -> Column:
    return F.shiftleft(rank, PLACE_BITS) + row_id.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def records(spark: SparkSession, path: str, names: list[str], order_col: str | None = None) -> DataFrame | None:
    """The records below ``path`` as text columns, cut at line breaks (``\\n`` or ``\\r\\n``) outside quotes; None where the quotes forbid it.

    A record on one line goes straight on; lines in blocks without an odd line and
    outside quotes need no window, and only the lines of records over several lines are
    grouped.  A record of any number of lines is one row in the end.
    """
    ensure_checkpoint_dir(spark)
    lines, blocks = record_lines(spark, path)
    state = blocks.select("file", "block", F.col("odd").alias("block_odd"), "odd_before", "rank", "header")
    lines = lines.join(state, ["file", "block"]).select("*", _place(F.col("rank"), F.col("id")).alias("place"))
    calm = (F.col("block_odd") == 0) & (F.col("odd_before") % 2 == 0)
    upto = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("odd_before") + F.coalesce(F.sum("odd").over(upto), F.lit(0))

    # an odd line outside quotes opens a field, and the last field of a file is closed
    odd = lines.filter("odd = 1").select("file", "block", "id", "odd", "odd_before", "opens").withColumn("before", before)
    ends = blocks.groupBy("file").agg(F.sum("odd").alias("odd")).filter("odd % 2 = 1")
    if odd.filter("before % 2 = 0 and not opens").limit(1).count() or ends.limit(1).count():
        return None

    lines = lines.select("file", "block", "id", "place", "header", "odd", "odd_before", "block_odd", "value", "empty")
    stirred = lines.filter(~calm).withColumn("before", before)
    single = (F.col("before") % 2 == 0) & (F.col("odd") == 0)
    parts = stirred.filter(~single).groupBy("file", F.floor(F.col("before") / 2).alias("record"), "header").agg(
        F.array_sort(F.collect_list(F.struct("place", "value"))).alias("lines"))
    columns = ["place", "header", "value"]
    cut = (lines.filter(calm & ~F.col("empty")).select(*columns)
           .unionByName(stirred.filter(single & ~F.col("empty")).select(*columns))
           .unionByName(parts.select(F.col("lines")[0]["place"].alias("place"), "header",
                                     F.array_join(F.col("lines")["value"], "\n").alias("value"))))
    text = F.regexp_replace("value", r"\r\z", "")
    fields = ", ".join("`" + c.replace("`", "``") + "` string" for c in names)
    parsed = cut.filter("place <> header").select("place", F.from_csv(text, fields, _RECORD_OPTIONS).alias("r"))
    order = [F.col("place").alias(order_col)] if order_col else []
    return parsed.select(*[F.col(f"r.`{c}`") for c in names], *order)


def with_file_order(raw: DataFrame, order_col: str) -> DataFrame:
    """Number the rows of a file scan: the file's rank by path (and block), then the row's place in it.

    Spark packs files by size, so row ids alone do not follow the files' order.
    The scan is written once, because ids are not the same when it runs again.
    """
    names = raw.columns
    spots = raw.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("__file"),
                       F.monotonically_increasing_id().alias("__id"))
    ensure_checkpoint_dir(raw.sparkSession)
    spots = spots.checkpoint(eager=True)
    # one row per file or block
    files = spots.select("__file").distinct().withColumn("__rank", F.row_number().over(Window.orderBy("__file")) - 1)
    place = F.shiftleft(F.col("__rank").cast("bigint"), 33) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return spots.join(files, "__file").select(*names, place.alias(order_col))


def assert_required_columns(df: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the input has no column {', '.join(missing)}")


def profile_feature_columns(df: DataFrame, excluded: list[str]) -> tuple[list[str], list[str]]:
    """Split the non-key, non-label columns into numeric and categorical lists."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in excluded:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            num.append(f.name)
        else:
            cat.append(f.name)
    return num, cat


def require_features(num_cols: list[str], cat_cols: list[str]) -> None:
    if not num_cols and not cat_cols:
        raise ValueError("besides the key and the labels there is no column to learn from")
