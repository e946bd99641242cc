"""Summary tables in many text files, and partitioned sinks that can be written again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trajstats.session import small_side
from trajstats.sources.dumps import path_mode, path_temperature

#: Names that a column may have in the header of a file, in the order in which they count (fixed values).
ID_NAMES = ("id", "system", "condition")
TEMPERATURE_NAMES = ("temperature_k", "temperature", "temp")
OBSERVABLE_NAMES, VALUE_NAMES = ("observable", "observable_key"), ("value",)


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, ",", -1), lambda c: F.trim(c))


def read_summaries(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], sums: Mapping[str, tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Observables of all comma-separated files below ``path``, and the lines that can't be read.

    Each file says by its header what it is: tidy (an observable and its value on a line) or wide (a column for each observable). The
    header is the line that begins with a name of an id column; it may be anywhere in the file, so files are split and read in
    parallel, and only headers, one for each file, are joined back. ``aliases`` lists for each observable the column names it may have:
    the first that is filled counts. ``sums`` gives for an observable two columns whose sum stands in where none is filled.
    Temperature comes from a column, or from TEMP_<number> in the path; the mode from the path.

    Good rows: (file, kind, temperature_k, mode, id, observable, value). Bad rows: (file, line, reason).
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    is_header = F.lower(F.get(_cells(F.col("line")), F.lit(0))).isin(*ID_NAMES)
    headers = lines.filter(is_header).groupBy("file").agg(F.transform(_cells(F.lower(F.min("line"))), lambda c: c).alias("names"))
    body = lines.filter(~is_header).join(small_side(headers), "file", "left").withColumn("cells", _cells(F.col("line")))
    reason = F.when(F.col("names").isNull(), "no header").when(F.size("cells") != F.size("names"), "number of fields").when(F.get("cells", F.lit(0)) == "", "no id")
    body = body.withColumn("reason", reason)
    row = body.filter("reason IS NULL").withColumn("cell", F.map_from_arrays("names", F.transform("cells", lambda c: F.when(c != "", c))))
    pick = lambda names: F.coalesce(*[F.try_element_at("cell", F.lit(n)) for n in names])
    number = lambda c: c.try_cast("double")
    tidy = F.array_contains("names", OBSERVABLE_NAMES[0]) | F.array_contains("names", OBSERVABLE_NAMES[1])

    def known(name: Column) -> Column:
        out = F.lit(None).cast("string")
        for observable, others in aliases.items():
            out = F.when(name.isin(observable, *others), observable).otherwise(out)
        return out

    def wide(observable: str) -> Column:
        found = pick([observable, *aliases[observable]])
        return found if not (sums and observable in sums) else F.coalesce(found, (number(pick([sums[observable][0]])) + number(pick([sums[observable][1]]))).cast("string"))

    pairs = F.when(tidy, F.array(F.struct(known(F.lower(pick(OBSERVABLE_NAMES))).alias("observable"), pick(VALUE_NAMES).alias("text")))).otherwise(
        F.array(*[F.struct(F.lit(o).alias("observable"), wide(o).alias("text")) for o in aliases]))
    out = row.select(
        "file", "line", F.when(tidy, "tidy").otherwise("wide").alias("kind"), F.coalesce(number(pick(TEMPERATURE_NAMES)).cast("int"), path_temperature(F.col("file"))).alias("temperature_k"),
        path_mode(F.col("file")).alias("mode"), pick(ID_NAMES).alias("id"), F.explode(pairs).alias("o"))
    value = number(F.col("o.text"))
    wrong = F.when((F.col("kind") == "tidy") & F.col("o.observable").isNull(), "unknown observable").when(F.col("o.text").isNotNull() & value.isNull(), "not a number")
    out = out.withColumn("reason", wrong)
    good = out.filter("reason IS NULL AND o.text IS NOT NULL").select("file", "kind", "temperature_k", "mode", "id", "o.observable", value.alias("value"))
    bad = body.filter("reason IS NOT NULL").select("file", "line", "reason").unionByName(out.filter("reason IS NOT NULL").select("file", "line", "reason").distinct())
    return good, bad


def replace_partitions(rows: DataFrame, path: str, partitions: Sequence[str], fmt: str = "parquet") -> None:
    """Write ``rows`` as a table partitioned by ``partitions``. Partitions that occur in ``rows`` are replaced as a whole, others stay, so
    that writing the same rows again changes nothing. Rows are dealt by partition and a hash of the row: a large partition has several writers.
    """
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(8))
    rows.repartition(*partitions, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).format(fmt).save(path)
