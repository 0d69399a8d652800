"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException

from granary.sources.formats import SAMPLE_ROWS, voted_kind


@udtf
class InferredTypes:
    """One row with the columns of any table, each with its type by vote over the first rows: SELECT * FROM inferred_types(TABLE(t)).

    The rows meet in one task, so a large table comes with a limit: TABLE(SELECT * FROM t LIMIT 100). No rows give none."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(T.StructType([T.StructField(f.name, T.StringType()) for f in table.dataType.fields]), withSinglePartition=True)

    def __init__(self, result: AnalyzeResult):
        self.columns: list[list[str]] = [[] for _ in result.schema.fields]
        self.seen = 0

    def eval(self, row):
        for values, value in zip(self.columns, row, strict=True):
            values.append("" if value is None else str(value))
        self.seen += 1
        if self.seen == SAMPLE_ROWS:
            raise SkipRestOfInputTableException("enough rows")

    def terminate(self):
        yield tuple(map(voted_kind, self.columns))


def registered(spark: SparkSession) -> None:
    spark.udtf.register("inferred_types", InferredTypes)


def first_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """The sampled rows of a table in files: the first by file name and place. A bare limit takes them from any file."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return files.select(*columns, *(c.alias(f"_place{i}") for i, c in enumerate(place))).orderBy("_place0", "_place1").limit(SAMPLE_ROWS).select(*columns)


def inferred_types(rows: DataFrame) -> DataFrame:
    """One row with the columns of `rows` and their types by vote; no more than a sample of rows leaves its partition."""
    registered(rows.sparkSession)
    return rows.sparkSession.sql("SELECT * FROM inferred_types(TABLE({rows}))", rows=rows.limit(SAMPLE_ROWS))
