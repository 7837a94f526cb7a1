"""Feature preparation with Spark ML transformers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Binarizer, IndexToString, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import prefix_sums

MAX_CATEGORIES = 4
# A flag that cannot be known (a series without a price cap) is a category of its own.
UNKNOWN_FLAG = -1
UNKNOWABLE = ("is_irrational",)


def known_flags(df: DataFrame) -> DataFrame:
    """Null flags of series without a price cap become ``UNKNOWN_FLAG``, so their rows stay."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(UNKNOWN_FLAG)) for c in UNKNOWABLE if c in df.columns})


def complete_rows(columns: Sequence[str]) -> Column:
    """True where no column is null (or NaN)."""
    out = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        out = out & x.isNotNull() & ~F.isnan(x)
    return F.coalesce(out, F.lit(False))


def assembler(features: Sequence[str], output: str = "features") -> VectorAssembler:
    """Features -> vector. A null feature is an error: callers fill flags with
    ``known_flags`` and leave out (and count) other incomplete rows with ``complete_rows``."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error")


def binarizer(label: str, output: str = "label", threshold: float = 0.5) -> Binarizer:
    """Label > threshold -> 1.0 else 0.0."""
    return Binarizer(threshold=threshold, inputCol=label, outputCol=output)


def label_indexer(label: str = "label", output: str = "indexed_label") -> StringIndexer:
    """Label -> index by descending frequency (ties alphabetical)."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="frequencyDesc", handleInvalid="keep")


def feature_indexer(features: str = "features", output: str = "indexed_features",
                    max_categories: int = MAX_CATEGORIES) -> VectorIndexer:
    """T4: vector slots with at most ``max_categories`` distinct values become categorical."""
    return VectorIndexer(inputCol=features, outputCol=output, maxCategories=max_categories, handleInvalid="keep")


def label_converter(labels: Sequence[str], prediction: str = "prediction",
                    output: str = "predicted_label") -> IndexToString:
    """T5: predicted index -> original label text; an index beyond the labels (unseen class) has none."""
    return IndexToString(inputCol=prediction, outputCol=output, labels=[*labels, "__unknown"])


def prepare_pipeline(label: str, features: Sequence[str], binarize: bool = True) -> Pipeline:
    """Assemble (and binarise) as one pipeline; nothing fitted is thrown away."""
    stages = [assembler(features)]
    if binarize:
        stages.append(binarizer(label))
    return Pipeline(stages=stages)


def prepare(df: DataFrame, label: str, features: Sequence[str], binarize: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(features vector, label) rows ready for a classifier, with the ``keep`` columns.
    Unknown flags are filled; other rows with a null feature or label are left out."""
    rows = known_flags(df).where(complete_rows([*features, label]))
    out = prepare_pipeline(label, features, binarize).fit(rows).transform(rows)
    if not binarize:
        out = out.withColumn("label", F.col(label).cast("double"))
    return out.select(*keep, "features", "label")


def long_vectors(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The feature vectors as rows (keep columns, slot, feature, value)."""
    from pyspark.ml.functions import vector_to_array

    slots = F.posexplode(vector_to_array("features")).alias("slot", "value")
    names = F.array(*[F.lit(f) for f in features])
    return df.select(*keep, slots).select(*keep, "slot", F.get(names, F.col("slot")).alias("feature"), "value")


def label_index_table(df: DataFrame, label: str) -> DataFrame:
    """The StringIndexer mapping as data: (label text, index, count).

    Same order as ``StringIndexer(stringOrderType="frequencyDesc")``: count descending, ties
    by label text. A label's index is the number of labels before it: a distributed running
    count, so a column with very many labels is never sorted in one task.
    """
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    found = prefix_sums(counts, [F.desc("n"), F.asc("label")], {"label_index": F.lit(1).cast("bigint")})
    return found.select("label", F.col("label_index").cast("double").alias("label_index"), "n")
