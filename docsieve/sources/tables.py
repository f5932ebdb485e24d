"""Tables of a data folder, and readers and writers of records as files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tables:
    """The Parquet tables of a folder, as attributes; each is scanned with the columns that a query needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; malformed lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str | None = None) -> DataFrame:
    """One JSON document (or array of them) a file, in a folder; ``pattern`` filters file names."""
    return spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter=pattern)


def read_csv_quoted(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, doubled quotes and line breaks in quotes; cells are trimmed and blank rows dropped."""
    rows = spark.read.csv(
        path, header=True, multiLine=multi_line, quote='"', escape='"',
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    return rows.na.drop("all")


def read_csv_two_columns(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """Lines cut at the first comma, outer quotes taken off; the first line of a file is its header."""
    lines = spark.read.text(path, wholetext=False).withColumn("at", F.instr("value", ","))
    rows = lines.where((F.col("at") > 0) & ~F.col("value").startswith(f"{first},"))
    tail = F.expr("substring(value, at + 1)")
    return rows.select(
        F.expr("left(value, at - 1)").alias(first), F.regexp_replace(tail, r'^"|"$', "").alias(second)
    )


def normalised_headers(rows: DataFrame, alternatives: dict[str, list[str]]) -> DataFrame:
    """Columns by lower-case names with underscores; each wanted one is the first alternative that is there."""
    named = rows.toDF(*[c.strip().lower().replace(" ", "_") for c in rows.columns])
    empty = F.lit(None).cast("string")
    return named.select(
        *[
            F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in names if c in named.columns], empty).alias(wanted)
            for wanted, names in alternatives.items()
        ]
    )


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows whose keys aren't in the new ones, and the new ones."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def updated(rows: DataFrame, where: Column, **changes: Column) -> DataFrame:
    """The rows with columns changed where the condition holds."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def rebuild_partitions(rows: DataFrame, path: str, owner: str) -> None:
    """Replaces the owners' folders that occur in the rows, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, quoteAll=True, escape='"')


def tsv_line(*columns: Column) -> Column:
    """One tab-separated line; quotes are doubled and every cell is quoted."""
    cells = [F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws("\t", *cells)


def validated(rows: DataFrame, **rules: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and the others with the names of the broken ones in ``broken``."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull()
    )
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; a temporary one for a local master where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='docsieve-')).rstrip('/')}/files-{uuid.uuid4().hex}"


def computed(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept in spark.checkpoint.dir, for plans that use them several times.

    Where that is unset, a temporary folder is set, but only for a local master.
    """
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="docsieve-"))
    return rows.checkpoint()


def dealt(rows: DataFrame, many: int, *keys: str, most: int = 250_000) -> DataFrame:
    """The rows, about ``many`` of them, dealt by keys so that a task has about ``most``, however large the tables are.

    The number is always given, as adaptive execution would merge tasks again by the bytes of slim rows.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-many // most)), *keys)


def lookup(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Slim rows, computed once, to be broadcast if they are no more than ``most``, else joined as any others."""
    once = computed(rows)
    return F.broadcast(once) if once.count() <= most else once
