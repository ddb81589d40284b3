"""Corpus preparation: documents in, token shards out, in five stages.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import stage, table
from pixelloom.llm.decontaminate import benchmark_hits
from pixelloom.llm.jaccard_join import jaccard_classes
from pixelloom.llm.source_mix import mix_sources, size_of
from pixelloom.llm.token_binary import token_binary
from pixelloom.llm.toxicity import fit_toxicity, held_out, score_toxicity

#: Keys of documents to drop that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on this stage's input, does not reject.

    Null and empty texts are scored like others (the bias alone) and repeated rows alike;
    labels of rows that are held out are not read.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model, keep=tuple(docs.columns)).where("score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share 0.8 of their five-word shingles.

    The smallest id of a class stays (a null one only if there is no other). Rows that
    repeat an id and its text are one document. Rows that share an id only are documents of
    their own, told apart by their texts. Texts without words (null or empty) are alike with
    nothing and stay.
    """
    classes = jaccard_classes(docs, k=5, percent=80, marks=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("f")
    named = classes.where("class is not null").groupBy("class").agg(first).select("f.doc_id", "f.mark")
    kept = named.union(classes.where("class is null").select("doc_id", "mark")).distinct()
    kept = stage(kept.select(F.col("doc_id").alias("k"), F.col("mark").alias("m")), "pipeline")
    out = docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("k")) & (F.xxhash64("text") == F.col("m")), "left_semi")
    if classes.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item.

    Null and empty texts hold none and stay; rows that share an id are told apart by their
    texts; repeated rows share their fate. An empty benchmark rejects nothing.
    """
    hits = stage(benchmark_hits(docs, table(spark, sf_dir, "benchmark")).select("key", "mark").distinct(), "pipeline")
    near = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    return docs.join(near, F.col("doc_id").eqNullSafe(F.col("key")) & (F.xxhash64("text") == F.col("mark")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once, or twice.

    Null texts have no words; a null id or source is a value like others. Rows that share
    id, source and size are alike to the mix: each gets the copies of one of them.
    """
    same = ["k", "s", "n"]
    taken = stage(mix_sources(docs).select(F.col("doc_id").alias("k"), F.col("source").alias("s"), F.col("size").alias("n"), "copies"), "pipeline")
    rows = docs.withColumns({"s_": F.col("source"), "n_": size_of("text")})
    alike = (F.col("doc_id").eqNullSafe(F.col("k"))) & (F.col("s_").eqNullSafe(F.col("s"))) & (F.col("n_") == F.col("n"))
    if taken.groupBy(*same).agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        taken = taken.withColumn("at", F.row_number().over(Window.partitionBy(*same).orderBy("copies")))
        rows = rows.withColumn("at_", F.row_number().over(Window.partitionBy("doc_id", "s_", "n_").orderBy("text")))
        alike = alike & (F.col("at") == F.col("at_"))
    joined = rows.join(taken.where("copies > 0").hint("merge"), alike)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_")).drop("copy_")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all that is left, read back: begin, size and checksum of each document.

    Every row is a document, repeated ones too; a null or empty text is its end id alone.
    """
    import public_tokenizers

    return token_binary(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_texts),
    ("source mix", mix),
    ("token binary", tokenize),
]

#: Learned scores, classes of links and a library's tokens: no SQL; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
