"""Scans: typed CSV, documents, source files, JSON lines, run files and JDBC tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lamina import schemas
from lamina.constants import ENERGY_COLUMNS, FAULT_TYPES, PLATE_COLUMNS, PRODUCTION_LINES, SHIFTS
from lamina.constants import STEEL_GRADES
from lamina.functions.calendar import parse_day_first
from lamina.functions.text import content_hash
from lamina.sources.sinks import RUN_COLUMNS


def require_columns(df: DataFrame, wanted: Sequence[str]) -> None:
    """Fail before any job runs when a source lacks expected columns."""
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"source is missing expected columns: {missing}")


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain scan at least one partition per core before costly per-row work.

    A file of a single row group is one split however many cores there are. A large table has
    more splits than cores and is returned as it is, so it is never shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def scan_csv(
    spark: SparkSession, path: str, columns: Mapping[str, str], types: Mapping[str, str],
    parsers: Mapping[str, object] | None = None, extra: Sequence[str] = (),
) -> DataFrame:
    """Read a CSV with a header, keep and rename ``columns``, cast to ``types``.

    Only the header is read up front; every value column arrives as text and is cast in the
    same stage as the scan. A byte-order mark is dropped by the reader. A file whose header
    differs from the first one's, in order too, and a row of another width fail the job.
    """
    names = spark.read.csv(path, header=True).columns
    text = StructType([StructField(name, StringType()) for name in names])
    # Without pruning the reader sees, and so can count, every value of a row.
    raw = spark.read.option("columnPruning", "false").csv(
        path, schema=text, header=True, enforceSchema=False, mode="FAILFAST"
    )
    require_columns(raw, [*columns, *extra])
    parsers = parsers or {}

    def typed(source: str, target: str) -> Column:
        text = F.col(f"`{source}`")
        parse = parsers.get(target)
        return (parse(text) if parse else text.cast(types[target])).alias(target)

    return raw.select(
        *[typed(source, target) for source, target in columns.items()],
        *[F.col(f"`{name}`") for name in extra],
    )


def scan_energy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Energy readings from the supplier's file: day-first stamps, original column names."""
    return scan_csv(
        spark, path, ENERGY_COLUMNS, schemas.ENERGY_TYPES, parsers={"ts": parse_day_first}
    )


def chronological(df: DataFrame, ts: str) -> DataFrame:
    """Rows in the order of ``ts``; an instant that occurs twice, or is NULL, fails the load."""
    others = [c for c in df.columns if c != ts]
    message = F.concat(F.lit(f"{ts} occurs more than once: "), F.coalesce(F.col(ts).cast("string"), F.lit("NULL")))
    grouped = df.groupBy(ts).agg(F.count("*").alias("_n"), F.min(F.struct(*others)).alias("_row"))
    once = F.when((F.col("_n") == 1) & F.col(ts).isNotNull(), F.col(ts)).otherwise(
        F.raise_error(message).cast(df.schema[ts].dataType)
    )
    checked = grouped.select(once.alias(ts), "_row.*").select(*df.columns)
    return checked.orderBy(ts)


def collapse_one_hot(df: DataFrame, flags: Mapping[str, str], target: str) -> DataFrame:
    """Replace 0/1 columns by the name of the set one; a row without exactly one set fails."""
    set_count = sum((F.col(f"`{flag}`").cast("int") for flag in flags), F.lit(0))
    first_set = F.coalesce(
        *[F.when(F.col(f"`{flag}`").cast("int") == 1, name) for flag, name in flags.items()]
    )
    message = F.concat(F.lit(f"{target}: expected exactly one flag, found "), set_count)
    # A NULL flag leaves the sum NULL, which must fail as well.
    checked = F.when(set_count == 1, first_set).otherwise(
        F.raise_error(F.coalesce(message, F.lit(f"{target}: flag is null"))).cast("string")
    )
    return df.withColumn(target, checked).drop(*flags)


def scan_plates_csv(spark: SparkSession, path: str) -> DataFrame:
    """Plate inspections with their one-hot fault and grade columns collapsed."""
    faults = {row[0]: row[0] for row in FAULT_TYPES}
    raw = scan_csv(
        spark, path, PLATE_COLUMNS, schemas.PLATE_TYPES, extra=[*faults, *STEEL_GRADES]
    )
    with_fault = collapse_one_hot(raw, faults, "fault_code")
    return collapse_one_hot(with_fault, STEEL_GRADES, "steel_grade")


def scan_text_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Whole files below ``path`` as (path, text); ``path`` is the file name."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}")
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    return files.select(F.url_decode(name).alias("path"), F.col("value").alias("text"))


def scan_code(spark: SparkSession, path: str, suffixes: Sequence[str] = (".py", ".sql")) -> DataFrame:
    """Source files of several suffixes."""
    scans = [scan_text_files(spark, path, suffix) for suffix in suffixes]
    merged = scans[0]
    for scan in scans[1:]:
        merged = merged.unionByName(scan)
    return merged


def with_front_matter(files: DataFrame) -> DataFrame:
    """Split documents (path, text) into ``doc_id``, ``metadata``, ``body`` and ``source_hash``.

    The block between two ``---`` lines at the top holds ``key: value`` lines. The last value of a
    repeated key counts. A list of plain items, ``[a, b]`` or in lines of their own that begin with a dash, is
    written as ``['a', 'b']``, numbers and truth values in it bare. Other indented lines and comments are passed over.
    """
    block_pattern = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
    block = F.regexp_extract("text", block_pattern, 1)
    unquote = r"""^["'](.*)["']$"""

    def scalar(text: Column) -> Column:
        return F.regexp_replace(F.trim(text), unquote, "$1")

    def item(text: Column) -> Column:
        plain = scalar(text)
        bare = F.trim(text).rlike(r"^-?\d+(?:\.\d+)?$")
        truth = F.when(F.lower(F.trim(text)) == "true", "True").when(F.lower(F.trim(text)) == "false", "False")
        quote = F.when(F.contains(plain, F.lit("'")), '"').otherwise("'")
        return F.coalesce(truth, F.when(bare, F.trim(text)), F.concat(quote, plain, quote))

    entry = "struct<key: string, value: string, items: array<string>>"
    none = F.array().cast("array<string>")

    def folded(found: Column, line: Column) -> Column:
        """One entry a key; items go to the last key, if it has no value."""
        raw = F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        inline = F.regexp_extract(raw, r"^\[(.*)\]$", 1)
        listed = F.when(raw.rlike(r"^\[.*\S.*\]$"), F.transform(F.split(inline, ","), item)).otherwise(none)
        key = F.array(F.struct(F.trim(F.substring_index(line, ":", 1)).alias("key"), scalar(raw).alias("value"), listed.alias("items")).cast(entry))
        last = F.element_at(found, -1)
        more = F.concat(last["items"], F.array(item(F.regexp_replace(line, r"^\s*-\s+", ""))))
        longer = F.struct(last["key"].alias("key"), last["value"].alias("value"), more.alias("items")).cast(entry)
        takes = (F.size(found) > 0) & line.rlike(r"^\s*-\s+\S") & ~line.rlike(r":(?:\s|$)")
        return F.when(line.rlike(r"^[^\s#:-][^:]*:"), F.concat(found, key)).when(
            takes & (F.try_element_at(found, F.lit(-1))["value"] == ""), F.concat(F.slice(found, 1, F.size(found) - 1), F.array(longer))).otherwise(found)

    entries = F.aggregate(F.split(block, r"\r?\n"), F.array().cast(f"array<{entry}>"), folded)
    def pair(e: Column) -> Column:
        listed = F.concat(F.lit("["), F.array_join(e["items"], ", "), F.lit("]"))
        return F.struct(e["key"].alias("key"), F.when(F.size(e["items"]) > 0, listed).otherwise(e["value"]).alias("value"))

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use(value)`` with ``value`` worked out once, however often it is named there."""
        return F.transform(F.array(value), use)[0]

    def last_of_each(pairs: Column) -> Column:
        # Entries from the last to the first: the first of a key is then the one that counts.
        def kept(backwards: Column) -> Column:
            keys = F.transform(backwards, lambda q: q["key"])
            return bound(keys, lambda known: F.filter(backwards, lambda p, i: F.array_position(known, p["key"]) == i + 1))

        return F.reverse(bound(F.reverse(pairs), kept))

    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    return files.select(
        "path",
        F.map_from_entries(last_of_each(F.transform(entries, pair))).alias("metadata"),
        F.regexp_replace(
            F.regexp_replace("text", block_pattern, ""), r"\A\s+|\s+\z", ""
        ).alias("body"),
        content_hash(F.col("text")).alias("source_hash"),
        stem.alias("_stem"),
    ).select(
        F.coalesce(F.col("metadata")["doc_id"], "_stem").alias("doc_id"),
        "path", "metadata", "body", "source_hash",
    )


def scan_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown documents below ``path`` with their front matter parsed."""
    return with_front_matter(scan_text_files(spark, path, ".md"))


def scan_jsonl(spark: SparkSession, path: str, schema: str = schemas.QUESTIONS) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a malformed line fails."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def scan_jdbc(
    spark: SparkSession, url: str, table: str, *, column: str, lower: object, upper: object,
    partitions: int, **options: str,
) -> DataFrame:
    """Read a database table in ``partitions`` parallel key ranges."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower),
        upperBound=str(upper), numPartitions=str(partitions), **options,
    )
    return reader.load()


def optional_bool(text: Column) -> Column:
    """``True``/``False`` texts as booleans, empty as NULL."""
    return F.when(F.length(text) > 0, text == "True")


def split_list(text: Column) -> Column:
    """A ``|``-joined list without its empty items."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\|")
    return F.filter(parts, lambda item: item != "")


def _run_of(file: str) -> tuple[str, str]:
    """Configuration and stamp of a run file, from its path."""
    in_folder = re.search(r"run=([^/]+)/config=([^/]+)/[^/]+$", file)
    if in_folder:
        return in_folder[2], in_folder[1]
    by_name = re.search(r"([^/]+)-(\d{8}-\d{6})\.csv$", file)
    if by_name:
        return by_name[1], by_name[2]
    raise ValueError(f"not the name of a run file: {file}")


def scan_run_csv(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of the latest run of every configuration.

    Runs are files ``<config>-<yyyyMMdd-HHmmss>.csv`` or folders ``run=<stamp>/config=<config>``
    as ``sink_run_csv`` writes them. The newest stamp per configuration comes from the list of
    files alone; those of older runs are not opened.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option(
        "recursiveFileLookup", "true").load(path).inputFiles()
    newest: dict[str, tuple[str, list[str]]] = {}
    for file in listed:
        config, stamp = _run_of(file)
        known, files = newest.setdefault(config, (stamp, []))
        if stamp > known:
            newest[config] = stamp, [file]
        elif stamp == known:
            files.append(file)
    chosen = [unquote(file) for _, files in newest.values() for file in files]
    schema = ", ".join(f"{name} string" for name in RUN_COLUMNS)
    raw = spark.read.schema(schema).csv(
        chosen, header=True, enforceSchema=False, multiLine=True, escape='"')
    file_path = F.col("_metadata.file_path")
    folder, name = r"run=[^/]+/config=([^/]+)/[^/]+$", r"([^/]+)-\d{8}-\d{6}\.csv$"
    # A folder name is escaped once by the writer and once more in the path.
    escaped = F.url_decode(F.url_decode(F.regexp_extract(file_path, folder, 1)))
    plain = F.url_decode(F.regexp_extract(file_path, name, 1))
    rows = raw.withColumn("config", F.when(file_path.rlike(folder), escaped).otherwise(plain))

    def number(name: str, kind: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).cast(kind)

    def count(name: str) -> Column:
        return F.coalesce(number(name, "int"), F.lit(0)).alias(name)

    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).alias(name)

    return rows.select(
        "config", "id", "category", "lang", "question",
        split_list(F.col("tools_called")).alias("tools_called"),
        split_list(F.col("expected_tools")).alias("expected_tools"),
        text("sql_generated"),
        *[optional_bool(F.col(n)).alias(n) for n in ("sql_valid", "sql_correct", "refused")],
        *[number(n, "double").alias(n)
          for n in ("retrieval_hit", "faithfulness", "answer_correctness")],
        *[count(n) for n in ("numbers_checked", "numbers_grounded", "latency_ms")],
        F.coalesce("answer", F.lit("")).alias("answer"), text("error"),
    )


def seed_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """The three constant reference tables."""
    return {
        "production_lines": spark.createDataFrame(PRODUCTION_LINES, schemas.PRODUCTION_LINES),
        "shifts": spark.createDataFrame(SHIFTS, schemas.SHIFTS),
        "fault_types": spark.createDataFrame(FAULT_TYPES, schemas.FAULT_TYPES),
    }
