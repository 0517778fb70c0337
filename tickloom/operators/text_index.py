"""Which nodes hold a word, from a stored index of three-letter pieces: hundreds of words without a scan of all texts.

A text that contains a word contains all its pieces, so a word's candidates are the nodes in all lists of its rarest
pieces; they are then verified. The index is only appended to: a changed node's older entries cost candidates, not results.
Where the lists of all words together are longer than the index, as with words by the hundred thousand that share pieces, each
text is read once instead: at a word's rarest piece, the stretch that would be the word is cut out and looked up by equality.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.shared import cut

#: Pieces of a word that are looked up, the rarest ones; folders of the index, by hash of piece or node.
RAREST, FOLDERS = 3, 64
#: Words, and candidates, up to which their table is broadcast.
SIDE = 200_000


def node_text(name: str = "name", text: str = "text") -> Column:
    """What a node is searched by: its name, else its text, in lower case."""
    return F.lower(F.coalesce(name, text, F.lit("")))


def _pieces(c: Column) -> Column:
    """The different runs of three letters."""
    n = F.length(c)
    at = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(3))))


def _folder(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FOLDERS)).cast("int")


@dataclass
class TextIndex:
    """Nodes (id, text, seq) and lists (piece, id) in the folders of ``path``. Ids are long or text, as first added."""

    spark: SparkSession
    path: str
    #: Entries that words may read from lists, as a multiple of all entries; beyond it all texts are read once.
    most: float = 1.0

    def add(self, vertices: DataFrame) -> None:
        """Adds nodes (id, name, text), or replaces those whose id is known; of equal ids at once the greatest text stands.

        Lists are written before nodes, so that an addition that failed half way leaves nothing that is found wrongly, and
        can be repeated.
        """
        seq = self._last() + 1
        nodes = cut(vertices.where("id IS NOT NULL").groupBy("id").agg(F.max(node_text()).alias("text")))
        lists = nodes.select(F.explode(_pieces(F.col("text"))).alias("piece"), "id").withColumn("folder", _folder("piece"))
        lists.repartition("folder").sortWithinPartitions("folder", "piece").write.mode("append").partitionBy("folder").parquet(f"{self.path}/lists")
        rows = nodes.withColumns({"seq": F.lit(seq).cast("long"), "folder": _folder("id")})
        rows.repartition("folder").sortWithinPartitions("folder", "id").write.mode("append").partitionBy("folder").parquet(f"{self.path}/nodes")

    def _last(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/nodes").agg(F.max("seq")).first()[0] or 0
        except Exception as e:  # the reader has no narrower class for a missing path
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return 0
            raise

    def nodes(self) -> DataFrame:
        """(id, text, folder): every node as it was last added."""
        rows = self.spark.read.parquet(f"{self.path}/nodes")
        return rows.groupBy("id", "folder").agg(F.max_by("text", "seq").alias("text"))

    def candidates(self, words: DataFrame) -> DataFrame:
        """(word, id) of nodes that may hold a word of three letters or more; those that do are among them."""
        return self._candidates(self._rare(words))

    def _rare(self, words: DataFrame) -> DataFrame:
        """(word, rare): the rarest pieces of each word of three letters or more, as (n, piece) with the length of their lists."""
        wanted = cut(words.where("length(word) >= 3").select("word", F.explode(_pieces(F.col("word"))).alias("piece")))
        pieces = cut(wanted.select("piece").distinct().withColumn("folder", _folder("piece")))
        lists = self.spark.read.parquet(f"{self.path}/lists").join(self._side(pieces), ["folder", "piece"])
        sizes = pieces.select("piece").join(lists.groupBy("piece").agg(F.count("*").alias("n")), "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return cut(wanted.join(sizes, "piece").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "piece"))), 1, RAREST).alias("rare")))

    def _candidates(self, rare: DataFrame) -> DataFrame:
        asked = cut(rare.select("word", F.size("rare").alias("k"), F.explode("rare").alias("p")).select("word", "k", F.col("p.piece").alias("piece")).withColumn("folder", _folder("piece")))
        met = self.spark.read.parquet(f"{self.path}/lists").join(self._side(asked), ["folder", "piece"]).select("word", "k", "piece", "id").distinct()
        return met.groupBy("word", "id", "k").agg(F.count("*").alias("n")).where("n = k").select("word", "id")

    def _stretches(self, rare: DataFrame) -> DataFrame:
        """(word, id) of nodes that hold a word: stretches of each text around words' rarest pieces, met with the words by equality.

        A text makes a stretch for each of its pieces and each place and length that words have around that piece, however many the words are.
        """
        anchored = rare.select("word", F.element_at("rare", 1)["piece"].alias("piece"))
        places = cut(anchored.select("piece", F.instr("word", F.col("piece")).alias("before"), F.length("word").alias("size")).distinct())
        text, at = F.col("text"), F.col("at") - F.col("before") + 1
        last = F.length(text) - 2
        pieces = self.nodes().where(F.length(text) >= 3).select("id", "text", F.explode(F.sequence(F.lit(1), last)).alias("at")).withColumn("piece", F.substring(text, F.col("at"), F.lit(3)))
        fits = pieces.join(self._side(places), "piece").where((at >= 1) & (at + F.col("size") - 1 <= F.length(text)))
        cut_out = fits.select("id", F.substring(text, at, F.col("size")).alias("word"))
        return cut_out.join(self._side(rare.select("word")), "word").distinct()

    @staticmethod
    def _side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= SIDE else df

    def _verified(self, rare: DataFrame) -> DataFrame:
        """(word, id) of nodes that hold a word, by candidates from the lists."""
        found = cut(self._candidates(rare).withColumn("folder", _folder("id")))
        ids = found.select("folder", "id").distinct()
        texts = self.spark.read.parquet(f"{self.path}/nodes").join(self._side(ids), ["folder", "id"], "left_semi").groupBy("id").agg(F.max_by("text", "seq").alias("text"))
        return found.join(texts, "id").where(F.col("text").contains(F.col("word"))).select("word", "id")

    def search(self, words: DataFrame) -> DataFrame:
        """(word, id): for each of ``words`` (word) the nodes whose text contains it, whatever the case.

        Only candidates' texts are read, unless their number could be larger than that of the index's entries; a word of one or two letters has no piece and is sought in all texts. An empty word
        is in every text, null in none.
        """
        words = cut(words.select(F.lower("word").alias("word")).where("word IS NOT NULL").distinct())
        if not self._last():
            return words.crossJoin(self.spark.range(0).select("id"))  # nothing was added
        rare = self._rare(words)
        entries = self.spark.read.parquet(f"{self.path}/lists").count()
        cost = rare.agg(F.sum(F.aggregate("rare", F.lit(0).cast("long"), lambda n, r: n + r["n"]))).first()[0] or 0
        long = self._stretches(rare) if cost > entries * self.most else self._verified(rare)
        short = words.where("length(word) < 3")
        if short.isEmpty():
            return long
        return long.unionAll(self.nodes().join(self._side(short), F.col("text").contains(F.col("word"))).select("word", "id"))
