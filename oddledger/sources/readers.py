"""Readers for transaction files.  Values arrive as text, trimmed, empty as NULL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddledger.errors import IngestError
from oddledger.schema import REQUIRED_FIELDS, TABULAR_FILE_TYPES
from oddledger.session import durable, staged

BROADCAST_BLOCKS = 200_000
ROW_TAGS = ("_source_file", "_source_path", "_row_number")
_TAGS = T.StructType(
    [
        T.StructField("_source_file", T.StringType()),
        T.StructField("_source_path", T.StringType()),
        T.StructField("_row_number", T.LongType()),
    ]
)
QUOTE = '"'
WHITE = " \t\n\x0b\x0c\r"
REJECTED = "_rejected"
# lines that one task numbers at a time, and the most that one record may have
RUN_LINES = 1_000_000
RECORD_LINES = 10_000


def plain_path(path: Column) -> Column:
    """One spelling for a path, whichever reader names it."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^([A-Za-z0-9]+):/+", "$1:/")


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``_source_file``, ``_source_path`` and the 1-based ``_row_number`` within the file.

    A file is read as several blocks, each by one task, in order.  The rows are stored
    once with their block, as the cut into blocks follows the cluster and may differ from
    scan to scan; the rows of the earlier blocks of a file give the offset of a block.  No
    file passes through a single task and the rows themselves are not shuffled.
    """
    stored = staged(
        df.select(
            "*",
            F.col("_metadata.file_name").alias("_source_file"),
            F.col("_metadata.file_path").alias("_source_path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_mid"),
        ),
        "rows",
    )
    return numbered_blocks(stored)


def numbered_blocks(stored: DataFrame, name: str = "_row_number", keep: tuple[str, ...] = ()) -> DataFrame:
    """Number of stored rows within their file, from ``_source_path``, ``_start`` and ``_mid``."""
    earlier = Window.partitionBy("_source_path").orderBy("_start")
    blocks = durable(
        stored.groupBy("_source_path", "_start")
        .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("_n")
    )
    side = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
    kept = [c for c in stored.columns if c not in ("_start", "_mid") or c in keep]
    return (
        stored.join(side, ["_source_path", "_start"])
        .withColumn(name, F.col("_mid") - F.col("_first") + F.col("_before") + 1)
        .select(*[F.col(f"`{c}`") for c in kept], name)
    )


def tidy_text(df: DataFrame) -> DataFrame:
    """Trim text columns of all white space; empty text becomes NULL."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {c: F.nullif(F.trim(F.col(f"`{c}`"), F.lit(WHITE)), F.lit("")) for c in texts if not c.startswith("_")}
    )


def read_csv(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Header row, every column as text, quoted values may hold line breaks.

    Files may have their columns in different orders, and different columns; a column without
    a name is left out.  ``encoding`` must write line breaks as ASCII does.
    """
    return csv_rows(stored_lines(spark.read.text(path), encoding), delimiter, schema)


def stored_lines(text: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """Lines of a text scan, stored once with file, block and whether they hold a quote."""
    line = F.col("value")
    if encoding.upper().replace("-", "") != "UTF8":
        # the scan cuts at the bytes of line breaks, whatever lies between
        line = F.decode(line.cast("binary"), encoding)
    return staged(
        text.select(
            F.col("_metadata.file_name").alias("_source_file"),
            F.col("_metadata.file_path").alias("_source_path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_mid"),
            line.alias("line"),
        ).withColumns({"blank": F.trim("line") == "", "quoted": F.contains("line", F.lit(QUOTE))}),
        "lines",
    )


def csv_rows(stored: DataFrame, delimiter: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """Records of ``stored_lines``, their columns by the names in the header of their file."""
    lines = numbered_blocks(stored, "_line", keep=("_start",))
    records = _records(lines, delimiter)
    heads, fields = _headers(records, delimiter)
    if heads is None:
        empty = schema or T.StructType()
        return records.sparkSession.createDataFrame([], T.StructType([*empty.fields, *_TAGS.fields]))
    names = [f.name for f in schema] if schema is not None else _column_names(heads)
    lowered = F.transform("_names", lambda n: F.lower(F.trim(n)))
    # the last one of a repeated name counts, as in a mapping
    places = F.array(
        *[F.size(lowered) - F.array_position(F.reverse(lowered), n.lower()) if n else F.lit(None) for n in names]
    )
    found = [F.array_contains(lowered, n.lower()) for n in names]
    spots = [F.when(has, F.get(places, F.lit(i))).cast("int") for i, has in enumerate(found)]
    by_file = durable(heads.select("_source_path", "_first", F.array(*spots).alias("_places")))
    side = F.broadcast(by_file) if by_file.count() <= BROADCAST_BLOCKS else by_file
    rows = records.join(side, "_source_path").filter(F.col("_line") > F.col("_first"))
    rows = rows.withColumn("_values", fields("record"))
    kinds = {f.name: f.dataType for f in schema} if schema is not None else {}
    values = [
        F.get("_values", F.get("_places", F.lit(i))).cast(kinds.get(n, T.StringType())).alias(n)
        for i, n in enumerate(names)
    ]
    return tidy_text(
        rows.select(
            *values,
            "_source_file",
            "_source_path",
            (F.col("_number") - 1).alias("_row_number"),
        )
    )


def _headers(records: DataFrame, delimiter: str) -> tuple[DataFrame | None, Callable[[str], Column] | None]:
    """(the first record of every file as its column names, how to cut a record into fields).

    (None, None) where no file has a record.
    """
    heads = durable(
        records.filter("_start = 0")
        .groupBy("_source_path")
        .agg(F.min("_line").alias("_first"), F.min_by("record", "_line").alias("record"))
    )
    options = {"sep": delimiter, "quote": QUOTE, "escape": QUOTE, "maxCharsPerColumn": "-1"}
    options |= {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    # a header has no more fields than separators and one
    cuts = F.length("record") - F.length(F.replace("record", F.lit(delimiter), F.lit("")))
    most = heads.agg(F.max(cuts)).first()[0]
    if most is None:
        return None, None
    width = most // len(delimiter) + 1
    kind = ", ".join(f"c{i} string" for i in range(width))

    def fields(record: str) -> Column:
        found = F.from_csv(record, kind, options)
        return F.array(*[found[f"c{i}"] for i in range(width)])

    bare = heads.withColumn("record", F.regexp_replace("record", "^\ufeff", ""))
    return durable(bare.withColumn("_names", fields("record")).drop("record")), fields


def required_by_file(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """S5 for every CSV file: (_source_path, present, missing, valid), names in lower case."""
    lines = numbered_blocks(stored_lines(spark.read.text(path)), "_line", keep=("_start",))
    heads, _ = _headers(_records(lines, delimiter), delimiter)
    if heads is None:
        return spark.createDataFrame(
            [], "_source_path string, present array<string>, missing array<string>, valid boolean"
        )
    named = F.filter("_names", lambda n: F.trim(n) != "")
    present = F.transform(named, lambda n: F.lower(F.trim(n)))
    required = F.array(*[F.lit(c) for c in REQUIRED_FIELDS])
    found = heads.select("_source_path", present.alias("present"))
    found = found.withColumn("missing", F.array_except(required, "present"))
    return found.withColumn("valid", F.size("missing") == 0)


def _column_names(heads: DataFrame) -> list[str]:
    """Names over all headers in the order they come up; one that differs in case is the same."""
    each = heads.select("_source_path", F.posexplode("_names").alias("at", "name"))
    named = each.filter("trim(name) <> ''").withColumn("name", F.trim("name"))
    first = named.groupBy(F.lower("name").alias("key")).agg(
        F.min(F.struct("_source_path", "at", "name")).alias("first")
    )
    return [r["name"] for r in first.select("first.*").orderBy("_source_path", "at").collect()]


def _records(lines: DataFrame, delimiter: str) -> DataFrame:
    """(_source_file, _source_path, _start, _line, record, _number): lines put together.

    ``_number`` counts the records of a file from 1.  A line that begins outside a quoted
    value may end inside one (``_opens``), and one that begins inside may end inside
    (``_stays``): every line is a function of one bit, and functions of blocks of lines give
    the bit at the start of each block, so a file is cut up by all tasks at once.
    """
    plain = lines.withColumnRenamed("line", "record")
    marks = lines.filter("quoted").select(
        "_source_path",
        "_line",
        _ends_inside(F.col("line"), delimiter).alias("_opens"),
        _stays_inside(F.col("line"), delimiter).alias("_stays"),
    )
    blanks = not lines.filter("blank").isEmpty()
    if marks.filter("_opens").isEmpty():
        if not blanks:
            return plain.withColumn("_number", F.col("_line")).drop("blank", "quoted")
        return _counted(plain.filter("not blank"))
    spans = _spans(marks)
    inner = durable(
        spans.select("_source_path", "_head", F.explode(F.sequence("_head", "_tail")).alias("_line"))
    )
    side = F.broadcast(inner) if inner.count() <= BROADCAST_BLOCKS else inner
    met = lines.join(side, ["_source_path", "_line"], "left")
    single = met.filter("_head is null and not blank").withColumnRenamed("line", "record").drop("_head")
    pieces = F.sort_array(F.collect_list(F.struct("_line", "line", "_source_file", "_start")))
    whole = met.filter("_head is not null").groupBy("_source_path", "_head").agg(pieces.alias("p"))
    whole = whole.select(
        F.col("p")[0]["_source_file"].alias("_source_file"),
        "_source_path",
        F.col("p")[0]["_start"].alias("_start"),
        F.col("_head").alias("_line"),
        F.array_join("p.line", "\n").alias("record"),
    )
    return _counted(single.select(whole.columns).unionByName(whole))


def _counted(records: DataFrame) -> DataFrame:
    """``_number`` of records whose lines do not follow on one another: counts per run of lines."""
    run = F.floor(F.col("_line") / RUN_LINES)
    kept = ["_source_file", "_source_path", "_start", "_line", "record"]
    cut = records.select(*kept, run.alias("_run"))
    earlier = Window.partitionBy("_source_path").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = durable(
        cut.groupBy("_source_path", "_run")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_source_path", "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    side = F.broadcast(before) if before.count() <= BROADCAST_BLOCKS else before
    order = Window.partitionBy("_source_path", "_run").orderBy("_line")
    return (
        cut.withColumn("_at", F.row_number().over(order))
        .join(side, ["_source_path", "_run"])
        .select(*kept, (F.col("_before") + F.col("_at")).alias("_number"))
    )


INSIDE = '[^"]*+(?:""[^"]*+)*+'


def _field_pattern(delimiter: str) -> tuple[str, str, str]:
    """(a whole field with its separator, the start of a quoted one, what may follow a closing quote)."""
    d = re.escape(delimiter)
    opening = '[ ]*+"' if delimiter == "\t" else '[ \\t]*+"'
    rest = (f"[^{d}]*+" if len(delimiter) == 1 else f"(?:(?!{d}).)*+") + d
    return f'(?:{opening}{INSIDE}"{rest}|(?!{opening}){rest})', opening, rest


def _ends_inside(line: Column, delimiter: str) -> Column:
    """A quote opens a value of the line and nothing closes it."""
    field, opening, _ = _field_pattern(delimiter)
    return line.rlike(f"(?s)^{field}*+{opening}{INSIDE}$")


def _stays_inside(line: Column, delimiter: str) -> Column:
    """The same for a line that begins inside a quoted value."""
    field, opening, rest = _field_pattern(delimiter)
    return line.rlike(f'(?s)^{INSIDE}(?:"{rest}{field}*+{opening}{INSIDE})?+$')


def _running(order: WindowSpec) -> tuple[Column, Column]:
    """(swaps so far, bit that the last fixed function leaves, with the swaps up to it taken out)."""
    swaps = F.sum((F.col("_opens") & ~F.col("_stays")).cast("long")).over(order)
    fixed = F.when(F.col("_opens") == F.col("_stays"), F.col("_opens").cast("long").bitwiseXOR(F.col("_swaps") % 2))
    return swaps, F.last(fixed, ignorenulls=True).over(order)


def _spans(marks: DataFrame) -> DataFrame:
    """(_source_path, _head, _tail): first and last line of records of several lines.

    A record of more than ``RECORD_LINES`` lines comes from a quote that nothing closes; its
    lines stay records of their own.
    """
    run = F.floor(F.col("_line") / RUN_LINES)
    order = Window.partitionBy("_source_path", "_run").orderBy("_line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = marks.withColumn("_run", run)
    swaps, base = _running(upto)
    cut = durable(cut.withColumn("_swaps", swaps).withColumn("_base", base))
    runs = cut.groupBy("_source_path", "_run").agg(
        F.max_by(F.struct("_swaps", "_base"), "_line").alias("end")
    )
    odd = F.col("end._swaps") % 2
    runs = runs.select(
        "_source_path",
        "_run",
        # what the run makes of 0 and of 1
        F.coalesce(F.col("end._base"), F.lit(0)).bitwiseXOR(odd).cast("boolean").alias("_opens"),
        F.coalesce(F.col("end._base"), F.lit(1)).bitwiseXOR(odd).cast("boolean").alias("_stays"),
    )
    over = Window.partitionBy("_source_path").orderBy("_run")
    swaps, base = _running(over.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("_swaps", swaps).withColumn("_base", base)
    after = F.coalesce("_base", F.lit(0)).bitwiseXOR(F.col("_swaps") % 2)
    runs = runs.select("_source_path", "_run", F.coalesce(F.lag(after).over(over), F.lit(0)).alias("_in"))
    state = F.coalesce("_base", "_in").bitwiseXOR(F.col("_swaps") % 2)
    lines = cut.join(runs, ["_source_path", "_run"]).withColumn("_after", state)
    # between runs the state comes from the run before
    lines = lines.withColumn("_before", F.coalesce(F.lag("_after").over(order), F.col("_in")))
    turns = lines.filter("_before <> _after").withColumn("_next", F.lead("_line").over(order))
    turns = durable(turns.select("_source_path", "_run", "_line", "_after", "_next"))
    ahead = over.rowsBetween(1, Window.unboundedFollowing)
    later = turns.groupBy("_source_path", "_run").agg(F.min("_line").alias("_line"))
    later = later.select("_source_path", "_run", F.first("_line").over(ahead).alias("_later"))
    heads = turns.filter("_after = 1").join(later, ["_source_path", "_run"])
    tail = F.coalesce("_next", "_later")
    return heads.select("_source_path", F.col("_line").alias("_head"), tail.alias("_tail")).filter(
        tail - F.col("_line") < RECORD_LINES
    )


def line_files(spark: SparkSession, path: str, **scan) -> DataFrame:
    """(_source_path, lines): whether a JSON file holds one object on each line.

    It does when it begins with an object and its first line, or half of its lines, open and
    close one; a broken line does not make it a file of another shape.
    """
    text = spark.read.options(**scan).text(path).select(
        F.col("_metadata.file_path").alias("_source_path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        F.trim("value").alias("line"),
    )
    opens = F.col("line").startswith("{")
    whole = opens & F.col("line").endswith("}")
    found = (
        text.filter("line <> ''")
        .select("_source_path", "start", "at", opens.alias("opens"), whole.alias("whole"))
        .groupBy("_source_path")
        .agg(
            F.min_by(F.struct("opens", "whole"), F.struct("start", "at")).alias("first"),
            F.count(F.lit(1)).alias("n"),
            F.count_if("whole").alias("objects"),
        )
    )
    several = (F.col("n") > 1) & F.col("first.opens")
    most = F.col("first.whole") | (2 * F.col("objects") >= F.col("n"))
    return found.select("_source_path", (several & most).alias("lines"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """An array of objects, ``{"transactions": [...]}``, one object per file or per line.

    Files of all these shapes may lie side by side.  What does not parse is in
    ``read_json_parts``.
    """
    return read_json_parts(spark, path, schema)[0]


def read_json_parts(
    spark: SparkSession, path: str, schema: T.StructType | None = None, **scan
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): rejects are (_source_file, _source_path, _row_number, text).

    ``scan`` are options that choose files.
    """
    shapes = staged(line_files(spark, path, **scan), "shapes")
    # names of files, as the driver's listing of them holds already
    files: dict[bool, list[str]] = {}
    for r in shapes.select("lines", plain_path(F.col("_source_path")).alias("path")).collect():
        files.setdefault(r["lines"], []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]))
    parts, rejects = [], []
    for lines in sorted(files):
        reader = spark.read.options(
            multiLine=not lines, primitivesAsString=True, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED
        )
        if schema is not None:
            reader = reader.schema(T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())]))
        raw = number_rows(reader.json(files[lines]))
        if REJECTED in raw.columns:
            tags = [t for t in ROW_TAGS if t in raw.columns]
            rejects.append(raw.filter(F.col(REJECTED).isNotNull()).select(*tags, F.col(REJECTED).alias("text")))
            raw = raw.filter(F.col(REJECTED).isNull()).drop(REJECTED)
        if len(files) > 1:
            raw = _without_empty(raw)
        parts.append(_unwrapped(raw))
    if not parts:
        parts = [spark.createDataFrame([], T.StructType([*(schema or T.StructType()).fields, *_TAGS.fields]))]
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    bad = spark.createDataFrame([], T.StructType([*_TAGS.fields, T.StructField("text", T.StringType())]))
    for other in rejects:
        bad = bad.unionByName(other)
    return tidy_text(rows), bad


def _without_empty(rows: DataFrame) -> DataFrame:
    """Leave out columns that no row fills: they come from files of another shape."""
    names = [c for c in rows.columns if c not in ROW_TAGS]
    if not names:
        return rows
    filled = rows.agg(
        *[F.max(F.col(f"`{c}`").isNotNull()).alias(f"_{i}") for i, c in enumerate(names)]
    ).first()
    return rows.drop(*[c for i, c in enumerate(names) if not filled[i]])


def _unwrapped(raw: DataFrame) -> DataFrame:
    """Records of wrapped files as rows beside those of plain files."""
    if "transactions" not in raw.columns or not isinstance(
        raw.schema["transactions"].dataType, T.ArrayType
    ):
        return raw
    inside = raw.filter(F.col("transactions").isNotNull()).select(
        "_source_file", "_source_path", F.posexplode("transactions").alias("_at", "_t")
    )
    inside = inside.select(
        "_t.*", "_source_file", "_source_path", (F.col("_at") + 1).cast("long").alias("_row_number")
    )
    plain = raw.filter(F.col("transactions").isNull()).drop("transactions")
    others = [c for c in plain.columns if c not in ROW_TAGS]
    if not others or plain.isEmpty():
        return inside
    # what only describes a wrapper is empty in every plain row
    return inside.unionByName(_without_empty(plain), allowMissingColumns=True)


def read_xml(spark: SparkSession, path: str, row_tag: str = "transaction") -> DataFrame:
    """S3: every ``row_tag`` element; attributes and children become fields."""
    raw = (
        spark.read.format("xml")
        .options(rowTag=row_tag, attributePrefix="", valueTag="_text", inferSchema=False)
        .load(path)
    )
    return tidy_text(number_rows(raw))


READERS = {"csv": read_csv, "json": read_json, "xml": read_xml}


def read_transactions(spark: SparkSession, path: str, file_type: str, **options) -> DataFrame:
    if file_type not in READERS:
        raise IngestError(f"Unsupported file type: {file_type}")
    return READERS[file_type](spark, path, **options)


def check_required_columns(df: DataFrame, file_type: str) -> dict:
    """Tabular files must bring the required columns (any case)."""
    required = REQUIRED_FIELDS if file_type in TABULAR_FILE_TYPES else []
    present = {c.lower() for c in df.columns}
    missing = [c for c in required if c not in present]
    result = {
        "valid": not missing,
        "required_columns": list(required),
        "missing_columns": missing,
        "present_columns": list(df.columns),
    }
    if missing:
        result["message"] = f"Missing required columns: {', '.join(missing)}"
    return result
