"""Byte-level BPE in DataFrame expressions.

A text is split by the tokenizer's pattern; a word's bytes are folded by Spark's
``aggregate``: each step joins the adjacent pair of pieces whose concatenation has
the least rank, leftmost first, until no pair has one. The rank map is a literal of
the plan: for every way to cut a vocabulary entry into two entries, the rank of the
whole under the pair of ranks; an array of small maps, one of which a pair's number
picks. Its size is that of the vocabulary file, fixed.

Words repeat, so distinct words are folded once where that pays: the most frequent
``DICTIONARY`` words of all documents, counted with map-side combining, are folded
as rows of their own and become a second literal of bounded size. A word outside it,
most often one that occurs once, is folded where it stands. No text and no word list
of unbounded size is moved.

Decoding looks up the binary piece of each id and concatenates the pieces; like
encoding it is done once for the ids of a word in the dictionary. Binary pieces are
carried as strings of the same bytes, which Spark joins as they are.

Null texts count as empty: no ids, digests of no bytes. Among words of equal counts
the lesser comes into the dictionary, which only speed feels. Repeated rows are encoded
alike; an empty table gives an empty result; other columns are kept, output columns
of clashing names replaced. A run of n characters without a break costs n squared
steps, so a text of one 100 thousand character word takes minutes.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column

from tessera.llm.base import checkpointed, whole

#: The most words folded ahead: some 100 bytes each are sent to every executor.
DICTIONARY = 786_432
#: Entries of the arrays that hashes index; a prime for the pairs' numbers, a power of two for words.
RANK_BUCKETS, PAIR_BUCKETS, WORD_BUCKETS = 65_536, 131_071, 262_144
#: A pair's number is its first rank times this and its second.
PAIR = 1 << 20


def java_pattern(pattern: str) -> str:
    """The pattern with white space as Unicode has it."""
    return "(?U)" + pattern


def literal(row: DataFrame) -> Column:
    """The one value of ``row`` as a literal, in Spark's own compact form: subqueries can't stand within higher-order functions."""
    spark = row.sparkSession
    jvm = spark.sparkContext._jvm
    value = row._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    kind = row._jdf.schema().apply(0).dataType()
    made = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, kind)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(made))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Vocabulary:
    """Literals of one vocabulary file (base64 of the bytes, blank, rank)."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            rows = [(bytearray(base64.b64decode(a)), int(b)) for a, b in map(bytes.split, lines)]
        self.pattern = java_pattern(pattern)
        ranks = checkpointed(spark.createDataFrame(rows, "piece binary, rank int").repartition(8))
        top = max(rank for _, rank in rows) + 1
        buckets = ranks.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(RANK_BUCKETS)))
        self.maps = self._indexed(buckets, F.struct("piece", "rank"), RANK_BUCKETS, "struct<piece:binary,rank:int>")
        cuts = ranks.filter(F.octet_length("piece") > 1).select("piece", "rank", F.explode(F.sequence(F.lit(1), F.octet_length("piece") - 1)).alias("at"))
        cuts = cuts.select("rank", F.substring("piece", F.lit(1), F.col("at")).alias("a"), F.substring("piece", F.col("at") + 1, F.octet_length("piece")).alias("b"))
        first, second = (ranks.select(F.col("piece").alias(c), F.col("rank").alias(r)) for c, r in (("a", "ra"), ("b", "rb")))
        pairs = cuts.join(first, "a").join(second, "b").select((F.col("ra").cast("long") * PAIR + F.col("rb")).alias("pair"), "rank")
        self.pairs = self._indexed(pairs.withColumn("bucket", F.col("pair") % PAIR_BUCKETS), F.struct("pair", "rank"), PAIR_BUCKETS, "struct<pair:bigint,rank:int>")
        self.pieces = self._array(ranks.select(F.col("rank").cast("long").alias("bucket"), F.col("piece").cast("string").alias("v")), top)
        little = spark.range(top).select(F.col("id").alias("bucket"), F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(F.col("id"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])).cast("string").alias("v"))
        self.little = self._array(little, top)
        own = {bytes(p): r for p, r in rows if len(p) == 1}
        self.bytes = F.array(*[F.lit(own.get(bytes([k]))).cast("int") for k in range(256)])
        self.dictionary: Column | None = None

    @staticmethod
    def _array(rows: DataFrame, size: int) -> Column:
        """A literal: array whose n-th element is the text v of bucket n, counted from 0, "" where there is none."""
        every = rows.sparkSession.range(size).withColumnRenamed("id", "bucket").join(rows, "bucket", "left")
        return literal(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("v", F.lit("")).alias("v")))), lambda x: x["v"]).alias("v")))

    @staticmethod
    def _indexed(rows: DataFrame, entry: Column, size: int, kind: str) -> Column:
        """A literal: array whose n-th element is the map of the entries of bucket n."""
        grouped = rows.groupBy("bucket").agg(F.collect_list(entry).alias("m"))
        every = rows.sparkSession.range(size).withColumnRenamed("id", "bucket").join(grouped, "bucket", "left")
        filled = F.coalesce("m", F.array().cast(f"array<{kind}>")).alias("m")
        return literal(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", filled))), lambda x: F.map_from_entries(x["m"])).alias("v")))

    def rank(self, piece: Column) -> Column:
        """Of a whole vocabulary entry, else null."""
        return F.try_element_at(F.get(self.maps, F.pmod(F.xxhash64(piece), F.lit(RANK_BUCKETS)).cast("int")), piece)

    def joined_rank(self, a: Column, b: Column) -> Column:
        """Of two pieces' concatenation, from their ranks, else null."""
        pair = a.cast("long") * PAIR + b
        return F.try_element_at(F.get(self.pairs, (pair % PAIR_BUCKETS).cast("int")), pair)

    def word_ids(self, word: Column) -> Column:
        """array<int> of one word's ids: the fold."""

        none = F.array().cast("array<int>")

        def joined(acc: Column, k: Column) -> Column:
            """The state after joining pieces k and k + 1, counted from 1: p holds pieces' ranks, r those of adjacent pairs."""
            p, r = acc["p"], acc["r"]
            m, n = F.get(r, k - 1), F.size(p)
            pieces = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.when(i < k, F.get(p, i - 1)).when(i == k, m).otherwise(F.get(p, i)))
            ranks = F.transform(
                F.sequence(F.lit(1), n - 2),
                lambda i: F.when(i < k - 1, F.get(r, i - 1)).when(i == k - 1, self.joined_rank(F.get(p, k - 2), m)).when(i == k, self.joined_rank(m, F.get(p, k + 1))).otherwise(F.get(r, i)),
            )
            return F.struct(pieces.alias("p"), F.when(n > 2, ranks).otherwise(none).alias("r"))

        def step(acc: Column, _: Column) -> Column:
            # no least rank: nothing to join, the place is null
            return let(F.array_position(acc["r"], F.array_min(acc["r"])).cast("int"), lambda k: F.when(k.isNull() | (k == 0), acc).otherwise(joined(acc, k)))

        def merged(start: Column) -> Column:
            n = F.size(start)
            pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: self.joined_rank(F.get(start, i - 1), F.get(start, i)))
            return F.aggregate(F.sequence(F.lit(1), n - 1), F.struct(start.alias("p"), pairs.alias("r")), step)["p"]

        data = F.encode(word, "UTF-8")
        # each byte as a character of its own number, so as its rank
        single = F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.get(self.bytes, F.ascii(c)))
        return let(self.rank(data), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(let(single, lambda start: F.when(F.size(start) < 2, start).otherwise(merged(start)))))

    def spelled(self, ids: Column) -> Column:
        """An array<int> of ids as little-endian unsigned 32-bit integers and as the bytes they stand for, both as strings of these bytes."""
        own = lambda table: F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
        return F.struct(own(self.little).alias("ids"), own(self.pieces).alias("decoded"))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def learn_dictionary(self, documents: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> None:
        """Folds the most frequent distinct words of ``documents`` ahead."""
        words = documents.select(F.explode(self.words(whole(text_col))).alias("word"))
        counts = words.groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") < 100) & (F.col("n") > 1))
        top = checkpointed(counts.orderBy(F.desc("n"), "word").limit(most).repartition(64))
        spelled = let(self.word_ids(F.col("word")), self.spelled)
        entries = checkpointed(top.select(F.xxhash64("word").bitwiseAND(WORD_BUCKETS - 1).alias("bucket"), "word", spelled.alias("spelled")))
        self.dictionary = self._indexed(entries, F.struct("word", "spelled"), WORD_BUCKETS, "struct<word:string,spelled:struct<ids:string,decoded:string>>")

    def parts(self, text: Column) -> Column:
        """Each word of a text spelled: from the dictionary, or folded here."""

        def part(word: Column) -> Column:
            here = let(self.word_ids(word), self.spelled)
            if self.dictionary is None:
                return here
            bucket = F.get(self.dictionary, F.xxhash64(word).bitwiseAND(WORD_BUCKETS - 1).cast("int"))
            return F.coalesce(F.try_element_at(bucket, word), here)

        return F.transform(self.words(text), part)


OUTPUT = ("n_tokens", "ids", "decoded")


def round_trip(documents: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``documents`` with n_tokens, ids (binary: little-endian unsigned 32-bit integers) and decoded (binary: what the ids stand for)."""
    rows = documents.drop(*OUTPUT).withColumn("__parts", vocabulary.parts(whole(text_col)))
    joined = lambda side: F.array_join(F.col("__parts")[side], "").cast("binary")
    rows = rows.withColumn("ids", joined("ids")).withColumn("decoded", joined("decoded"))
    return rows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).drop("__parts")
