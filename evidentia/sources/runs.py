"""Tables of a run, a folder for each cell of the design, and cells rewritten one at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.sources.tables import exists, stored

CELL = ("chunking", "embedding", "rerank")

_CELLS = "chunking string, embedding string, rerank string"
_SCALES = "faithfulness double, relevance double, completeness double"

#: What each table of a run holds. Chunks depend on the chunking alone.
SCHEMAS = {
    "chunks": "chunk_id string, doc_id long, chunk_index int, n_tokens int, char_start int, char_end int, text string, content_sha256 string, chunking string",
    "results": f"item_id long, item string, doc_id long, char_start int, char_end int, n_tokens int, text string, score double, rank int, used long, {_CELLS}",
    "answers": f"item_id long, question string, reference string, context string, answer string, n_prompt_tokens int, n_completion_tokens int, {_CELLS}",
    "judgements": f"item_id long, pass_index int, verdict string, {_SCALES}, rationale string, error string, {_CELLS}",
}
KEYS = {"chunks": ["chunk_id"], "results": ["item_id", "rank"], "answers": ["item_id"], "judgements": ["item_id", "pass_index"]}


class RunTable:
    """One table of a run under ``path``: a folder for each cell, whose files change only when that cell is written."""

    def __init__(self, spark: SparkSession, path: str, kind: str):
        self.spark, self.path, self.key = spark, f"{path}/{kind}", KEYS[kind]
        self.schema = StructType.fromDDL(SCHEMAS[kind])
        self.cell = [c for c in CELL if c in self.schema.names]

    def read(self, **levels: str) -> DataFrame:
        """All rows, or those of the cells of these levels: the folders of other cells are not listed as input. No table yet, no rows."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        for name, level in levels.items():
            if name not in self.cell:
                raise ValueError(f"{name} is no level of a cell of {self.path}")
            rows = rows.filter(F.col(name) == level)
        return rows.select(*self.schema.names)

    def write(self, rows: DataFrame) -> None:
        """The cells of ``rows``, anew; other cells keep their files."""
        self._ordered(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.cell).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Those of ``rows`` whose keys their cell lacks, once each, so that a run that was cut off goes on."""
        keys = [*self.cell, *self.key]
        new = rows.dropDuplicates(keys).join(self.read().select(*keys), keys, "left_anti")
        self._ordered(new).write.mode("append").partitionBy(*self.cell).parquet(self.path)

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (cell and key) that the table does not hold yet."""
        keys = [c for c in [*self.cell, *self.key] if c in wanted.columns]
        return wanted.join(self.read().select(*keys).distinct(), keys, "left_anti")

    def drop(self, condition: Column) -> int:
        """Takes out the rows of ``condition`` and says how many; only cells that hold such rows are rewritten, and one without any other goes."""
        touched = self.read().filter(condition).groupBy(*self.cell).agg(F.count("*").alias("n")).collect()  # no more than there are cells
        if not touched:
            return 0
        here = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(c) == row[c] for c in self.cell)) for row in touched))
        stay = stored(self.read().filter(here).filter(~F.coalesce(condition, F.lit(False))))
        self.write(stay)
        left = {tuple(r) for r in stay.select(*self.cell).distinct().collect()}
        for row in touched:
            if tuple(row[c] for c in self.cell) not in left:
                self._remove("/".join(f"{c}={row[c]}" for c in self.cell))
        return sum(row["n"] for row in touched)

    def _ordered(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).repartition(*self.cell).sortWithinPartitions(*self.cell, *self.key)

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
