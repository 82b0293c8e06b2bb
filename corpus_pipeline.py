"""From raw documents to token files in five stages, each a Spark job over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Repeated ids, null ids, empty tables and further columns of any name go through every stage.
Tables that a stage needs on its way are deleted; of its decisions a narrow one stays, which the rows it
returns are read by.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from boxoffice.functions.scale import materialize, scratch, settled
from boxoffice.llm.decontamination import contaminated
from boxoffice.llm.jaccard_join import jaccard_components
from boxoffice.llm.language_id import UNKNOWN, held_out, predict, train
from boxoffice.llm.mixing import mix
from boxoffice.llm.queries import END_ID, TOKENIZER
from boxoffice.llm.token_files import read_token_files, token_folder, write_token_files

#: A document whose best language is less likely than this is rejected.
LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle, and the similarity in percent.
SHINGLE, PERCENT = 5, 80


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a name of the row that is never null and the same for equal ids and texts, and its column."""
    row = _free(docs, "_pipeline_row")
    return docs.withColumn(row, F.xxhash64("doc_id", "text")), row


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: not without letters, nor doubtful. If nothing can
    be learnt, as no document has a language, nothing is rejected."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang").filter(~held_out("id"))
    with scratch(spark):
        model = train(rows)
    if model is None:
        return docs
    marks = _free(docs, "_pipeline_lang"), _free(docs, "_pipeline_score")
    marked = predict(docs, model, marks)
    return marked.filter((F.col(marks[0]) != UNKNOWN) & (F.col(marks[1]) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of linked documents the one with the least id, one without an id only where no
    other has one. Of rows that repeat an id and a text the first in the order of their columns stays."""
    named, row = _named(docs)

    def decide() -> DataFrame:
        groups = jaccard_components(named, SHINGLE, PERCENT, id_col=row).select(F.col(row).alias("of"), F.col("component_id").alias("group"))
        groups = groups.groupBy("of", "group").agg(F.count(F.lit(1)).alias("times"))
        ids = named.select(F.col(row).alias("node"), F.col("doc_id").alias("id")).distinct()
        ranked = ids.join(groups, F.col("node") == F.col("of"))
        first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "node", "times"))
        return ranked.groupBy("group").agg(first.alias("head")).select(F.col("head.node").alias("node"), F.col("head.times").alias("times"))

    heads = settled(spark, decide, "heads")
    single, several = (heads.filter(x).select("node") for x in (F.col("times") == 1, F.col("times") > 1))
    kept = named.join(single, named[row] == single["node"], "left_semi").select(*docs.columns)
    repeated = named.join(several, named[row] == several["node"], "left_semi")
    first = repeated.groupBy(F.col(row).alias("own")).agg(F.min(F.struct(*docs.columns)).alias("whole")).select("whole.*")
    return kept.unionByName(first)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named, row = _named(docs)
    hits = settled(spark, lambda: contaminated(named, benchmark, id_col=row).select(F.col(row).alias("hit")).distinct(), "hits")
    return named.join(hits, named[row] == hits["hit"], "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes: none, one, two or more. Rows of one id and text
    share their copies; where these do not divide, the first in the order of their columns get one more."""
    named, row = _named(docs)

    def decide() -> DataFrame:
        copies = mix(named, id_col=row).select(F.col(row).alias("lot"), F.col("copies").alias("n"))
        return copies.groupBy("lot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("times"))

    lots = settled(spark, decide, "lots")
    lot, n, times, same, before, copy = (_free(docs, f"_pipeline_{k}") for k in ("lot", "n", "times", "same", "before", "copy"))
    lots = lots.filter(F.col("n") > 0).select(F.col("lot").alias(lot), F.col("n").alias(n), F.col("times").alias(times))
    taken = named.join(lots, F.col(row) == F.col(lot)).drop(row)
    # Equal rows become one with their number, so that no task numbers all rows of a lot.
    equal = taken.filter(F.col(times) > 1).groupBy(*taken.columns).agg(F.count(F.lit(1)).alias(same))
    so_far = Window.partitionBy(lot).orderBy(*docs.columns).rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn(before, F.coalesce(F.sum(same).over(so_far), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col(same), F.col(n) % F.col(times) - F.col(before)))
    shared = equal.withColumn(n, F.floor(F.col(n) / F.col(times)) * F.col(same) + more).filter(F.col(n) > 0)
    rows = taken.filter(F.col(times) == 1).select(*docs.columns, n).unionByName(shared.select(*docs.columns, n))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(copy)).drop(copy)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, public_tokenizers.path(TOKENIZER), END_ID, token_folder(spark)))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("token_files", token_files),
]

#: The language model and the draws of the mix have no SQL; the stages are tested against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
