"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, and other columns that docs has, as they were. A
stage works on all that the one before it kept. Nulls, empty texts and repeated rows
are handled as the operators say: null and empty texts pass the filters as their
scores tell and are no copies of each other; documents without an id are kept like
others, and the copies among them found. Of a row that is repeated with its id and
text one stays. An empty table passes as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, packing, quality, secrets, toxicity
from tessera.llm.base import checkpointed, table, whole

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: What columns of docs are called while an operator uses their names for its own.
OWN = "__own_"


def _chosen(docs: DataFrame, names: tuple[str, ...], scored, condition: str) -> DataFrame:
    """``docs`` where ``condition`` holds on the columns ``names`` that ``scored`` adds."""
    clashing = {c: OWN + c for c in docs.columns if c in names}
    kept = scored(docs.withColumnsRenamed(clashing)).filter(condition)
    return kept.select(*[F.col(clashing.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below a half."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _chosen(docs, toxicity.OUTPUT, lambda rows: toxicity.scored(rows, lexicon), "predicted = 0")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the combined posterior keeps."""
    classifier = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _chosen(docs, quality.OUTPUT, lambda rows: quality.scored(rows, classifier), "keep")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document of the least id, null ids last; of equal ids that of the least text hash."""
    # a row is known by its id, in the order of numbers, and its text
    place = F.coalesce(F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit("null"))
    row = F.concat(place, F.lit(":"), F.sha2(whole("text"), 256), F.when(F.col("text").isNull(), "-").otherwise("+"))
    found = jaccard.joined(docs.select(row.alias("row"), "text"), n=5, percent=80, id_col="row", id_type="string")
    kept = found.filter("component_id = row").select(F.col("row").alias(OWN + "kept")).distinct()
    rows = docs.withColumn(OWN + "row", row)
    return rows.join(kept, F.col(OWN + "row") == F.col(OWN + "kept"), "left_semi").dropDuplicates([OWN + "row"]).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by [SECRET], n_chars counted anew there."""
    ledger = secrets.advanced(docs.select("doc_id", "text"))
    found = ledger.filter("spans <> ''").select(F.col("blob").alias(OWN + "blob"), F.col("spans").alias(OWN + "spans"))
    mask = F.pandas_udf(lambda texts, spans: texts.combine(spans, lambda t, s: secrets.masked(t, s) if s else t), "string")
    joined = docs.join(found, F.sha2(F.col("text"), 256) == F.col(OWN + "blob"), "left")
    hit = F.col(OWN + "spans").isNotNull()
    masked = joined.withColumn("text", F.when(hit, mask(F.coalesce("text", F.lit("")), F.coalesce(OWN + "spans", F.lit("")))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into windows of 1024 ids."""
    return packing.packed(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_poor), ("n-gram Jaccard join", drop_near_copies), ("secret scans", mask_secrets), ("packing", pack)]
#: SQL can't express the classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept in the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
