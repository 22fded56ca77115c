"""Helpers that several operators share: scratch tables, column access and a tokenizer cache."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.session import prepare, shared_dir

#: ASCII white space as the word contracts define it: space and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"
#: Words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and the files survive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            jvm = table.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch, since single texts can be long."""
    prepare(spark, rows)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, never reach an operator's inner columns."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


#: A key of more rows than this, and than one in ``HOT_KEYS`` of all, is broadcast: there are at most HOT_KEYS of them.
HOT_ROWS = 20_000
HOT_KEYS = 100_000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``keyed``, which has one row a key and in ``count`` how many rows have it (inner or left).

    Few keys are broadcast.  Of many, the hot ones are, and their number is bounded; so no task of the shuffle gets more than a
    bounded share of the rows.  ``keyed`` is read several times and should be a stored table.
    """
    total, n_keys = keyed.agg(F.sum(count), F.count("*")).first()
    if n_keys <= HOT_KEYS:
        return rows.join(F.broadcast(keyed), keys, how)
    hot = materialize(keyed.filter(F.col(count) > max(HOT_ROWS, total // HOT_KEYS)), "hot-keys")
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed, keys, how)
    return cold.unionByName(rows.join(F.broadcast(hot), keys).select(*cold.columns))


def rows_per_bucket(n_rows: int, rows: int = 50_000) -> int:
    """How many hash buckets hold about ``rows`` rows each."""
    return max(1, -(-n_rows // rows))


#: The normaliser and the pre-tokenizer of tokenizer files whose words can be encoded one by one.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordIds:
    """Token ids of texts as little-endian uint32 bytes; of tokenizer files whose normaliser and pre-tokenizer are ``WORD_NORMALIZER``
    and ``WORD_SPLIT`` word by word, of any others text by text.

    Such a tokenizer lower-cases, drops white space and never merges across it, nor between a letter or digit and a punctuation mark
    behind it.  So the ids of a text are the joined ids of its words, and a new word with a capital or with one full stop or
    comma at its end takes those of the plain word; only plain words that are new reach the tokenizer, many at a time.  Two
    generations of about ``cap`` words of at most ``LONG_WORD`` characters bound the memory; a word that is met again moves to the young one.
    """

    def __init__(self, path: str, cap: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.by_word = told.get("normalizer") == WORD_NORMALIZER and told.get("pre_tokenizer") == WORD_SPLIT
        self.cap, self.young, self.old = cap, {"": b""}, {}
        self.marks = {mark: self._ids(mark) for mark in ".,"} if self.by_word else {}

    def clear(self) -> None:
        self.young, self.old = {"": b""}, {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Ids of new words, none of which holds white space: encoded as one text and cut at the words' places."""
        found = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        starts = np.array([start for start, _ in found.offsets], np.int64)
        ends = np.cumsum([len(word) + 1 for word in new])
        cuts = [0, *(np.searchsorted(starts, ends) * 4).tolist()]
        ids = np.array(found.ids, "<u4").tobytes()
        for word, at, end in zip(new, cuts, cuts[1:], strict=False):
            self.young[word] = ids[at:end]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        split = [text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") for text in texts]
        young, old = self.young, self.old
        derived: list[tuple[str, str, bytes]] = []
        new: dict[str, None] = {}
        long: list[str] = []
        for word in set().union(*split):
            if word in young:
                continue
            if word in old:
                young[word] = old[word]
                continue
            plain, tail = word, b""
            if len(word) > LONG_WORD:
                long += (word, word.lower(), word[:-1].lower())
            # Two letters are lower-cased by their context or into two; they and control strings stay as they are.
            if "\u03a3" not in word and "\u0130" not in word and "<|" not in word:
                if len(word) > 1 and word[-1] in ".," and word[-2].isalpha():
                    plain, tail = word[:-1], self.marks[word[-1]]
                plain = plain.lower()
            if plain != word:
                derived.append((word, plain, tail))
            if plain in young:
                continue
            if plain in old:
                young[plain] = old[plain]
            else:
                new[plain] = None
        if new:
            self._learn(list(new))
        for word, plain, tail in derived:
            young[word] = young[plain] + tail
        out = [b"".join(map(young.__getitem__, words)) for words in split]
        for word in long:
            young.pop(word, None)
        if len(young) > self.cap:
            self.old, self.young = young, {"": b""}
        return out


#: Longer words are not kept.
LONG_WORD = 64
_WORD_IDS: dict[str, WordIds] = {}

def forget_words() -> None:
    """Empty the word caches of this worker: it is reused, and the next operator needs the room."""
    for cache in _WORD_IDS.values():
        cache.clear()


def word_ids(path: str) -> WordIds:
    """One cache for each tokenizer file and worker process; workers are reused between tasks."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def with_prefix_counts(counts: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` by ``order`` within ``keys``; meant for small tables of counts."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
