"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 6), and decoding.

Byte-level BPE first cuts a text into words by a pattern and then encodes each word by itself, so a word has the same
ids wherever it stands. The words are cut in the JVM, once, each distinct word of the corpus is encoded once, and the ids
are joined back by position. The corpus never passes through Python, only its vocabulary does.

Words are very unequal: a few stand in every text. They are counted first (combined map side); the most frequent ones,
a fixed number of them within a fixed number of bytes, are joined as a broadcast table, the rest by a shuffle on the
word. A word outside the broadcast table can hold at most a 1/`common`-th of all positions, so that shuffle has no hot
key, and most positions never take part in it. (A frequent word too large for the table, a run of blanks of megabytes
in very many texts, say, is left to it, too; adaptive execution splits such a key.)

Each id is then one whole number of 64 bits, of the position of its word, its place in the word and itself; those of a
text are gathered where they come up before they are shuffled, so a text crosses the network once or twice, in about
eight bytes an id. Texts of more words, or words of more ids, than those bits hold take a wider form by the same steps.

The pattern's classes depend on the Unicode version. A text with a code point that the JVM doesn't know (category Cn) is
cut by the tokenizer's own pattern engine instead; so are the few signs whose class differs between the two.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
texts of any length are encoded whole; of repeated rows (one key, one text) one row comes out, different texts under one
key give a row each, null keys are keys; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("SLUICEBOX_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"
#: The words of byte-level BPE (fixed pattern of the public tokenizer).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the JVM, with \s as Unicode's White_Space.
JVM_WORDS = WORDS.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
#: Most frequent words that are broadcast, and the bytes they may have together.
COMMON_WORDS = 20_000
COMMON_BYTES = 2 << 20


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def tokenizer_path(name: str = TOKENIZER, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


def _unknown_to_jvm(text: Column) -> Column:
    return text.rlike(r"\p{Cn}")


def cut_words(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, h, words: the words of each text that isn't empty; their concatenation is the text, h a hash of it."""
    path = path or tokenizer_path()
    some = documents.where(F.col(text) != "").select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    known = some.where(~_unknown_to_jvm(F.col("text"))).select("key", "h", F.regexp_extract_all("text", F.lit(JVM_WORDS), F.lit(0)).alias("words"))

    def cut(batches: Iterator) -> Iterator:
        import pandas as pd

        t = _tokenizer(path).pre_tokenizer
        for pdf in batches:
            words = [[x[a:b] for _, (a, b) in t.pre_tokenize_str(x)] for x in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "h": pdf["h"], "words": words})

    kind = some.schema["key"].dataType.simpleString()
    odd = some.where(_unknown_to_jvm(F.col("text"))).mapInPandas(cut, f"key {kind}, h bigint, words array<string>")
    return known.unionByName(odd)


def split_words(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, h, pos, word: the words of each text, by position. The cut texts are written to the shared folder once, as
    they are read twice: for the table of words, and to be encoded by it."""
    return stored(cut_words(documents, key, text, path), "cut").select("key", "h", F.posexplode("words").alias("pos", "word"))


def word_table(words: DataFrame, path: str | None = None) -> DataFrame:
    """word, n, ids of each distinct word, written to the shared folder."""
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    path = path or tokenizer_path()

    def encode(batches: Iterator) -> Iterator:
        import pandas as pd

        t = _tokenizer(path)
        for pdf in batches:
            done = t.encode_batch(pdf["word"].tolist(), add_special_tokens=False)
            yield pd.DataFrame({"word": pdf["word"], "n": pdf["n"], "ids": [e.ids for e in done]})

    return stored(counted.mapInPandas(encode, "word string, n bigint, ids array<int>"), "words")


def _common(table: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """word, ids of the most frequent words, within both bounds; a word that overruns the bytes is passed over.

    The driver sees the words it takes, within the bounds, and of the others among the `most` only their sizes.
    """
    top = table.select("word", "n", (F.octet_length("word") + 4 * F.size("ids") + 64).alias("bytes")).orderBy(F.desc("n"), "word").limit(most)
    room, taken = most_bytes, []
    fits = F.when(F.col("bytes") <= most_bytes, F.col("word"))
    for row in top.select(fits.alias("word"), "bytes", "n").orderBy(F.desc("n"), "word").toLocalIterator():
        if row.bytes <= room:
            room -= row.bytes
            taken.append((row.word,))
    words = table.sparkSession.createDataFrame(taken, "word string")
    return table.join(F.broadcast(words), "word", "left_semi").select("word", "ids")


#: Bits of an id, of its place in its word, and of the position of the word: 63 in all.
_ID, _PLACE, _POSITION = 20, 19, 24


def _codes(words: DataFrame) -> DataFrame:
    """key, h, code: a whole number for each id, that sorts by position."""
    base = F.shiftleft(F.col("pos").cast("bigint"), _ID + _PLACE)
    coded = F.transform("ids", lambda x, i: base + F.shiftleft(i.cast("bigint"), _ID) + x.cast("bigint"))
    return words.select("key", "h", F.explode(coded).alias("code"))


def _joined(words: DataFrame, table: DataFrame, frequent: DataFrame) -> DataFrame:
    """key, h, pos, ids of every word: by the broadcast table where the word is in it, else by shuffle."""
    marked = words.join(F.broadcast(frequent), "word", "left")
    near = marked.where("ids is not null").select("key", "h", "pos", "ids")
    rare = table.join(F.broadcast(frequent.select("word")), "word", "left_anti").select("word", "ids")
    far = marked.where("ids is null").select("key", "h", "pos", "word").join(rare, "word").select("key", "h", "pos", "ids")
    return near.unionByName(far)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, common: int = COMMON_WORDS, common_bytes: int = COMMON_BYTES, wide: bool | None = None) -> DataFrame:
    """key, ids ARRAY<INT>: the ids of each text, without special tokens. wide: whether ids go in the wider form (by
    default, where the narrow one can't hold them)."""
    words = split_words(documents, key, text, path)
    table = word_table(words, path)
    if wide is None:
        ends = words.agg(F.max("pos").alias("pos")).first().pos or 0
        sizes = table.agg(F.max(F.size("ids")).alias("k"), F.max(F.array_max("ids")).alias("id")).first()
        wide = ends >= 1 << _POSITION or (sizes.k or 0) >= 1 << _PLACE or (sizes.id or 0) >= 1 << _ID
    joined = _joined(words, table, _common(table, common, common_bytes))
    if wide:
        parts = joined.groupBy("key", "h").agg(F.array_sort(F.collect_set(F.struct("pos", "ids"))).alias("parts"))
        encoded = parts.select(F.col("key").alias(key), F.flatten(F.col("parts.ids")).alias("ids"))
    else:
        codes = _codes(joined).groupBy("key", "h").agg(F.array_sort(F.collect_set("code")).alias("codes"))
        encoded = codes.select(F.col("key").alias(key), F.transform("codes", lambda c: c.bitwiseAND((1 << _ID) - 1).cast("int")).alias("ids"))
    none = documents.where(F.col(text).isNull() | (F.col(text) == "")).select(F.col(key), F.array().cast("array<int>").alias("ids")).distinct()
    return encoded.unionByName(none)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, common: int = COMMON_WORDS, common_bytes: int = COMMON_BYTES) -> DataFrame:
    """key, n_tokens BIGINT of each text: the same plan with lengths in place of ids, so it adds up map side."""
    words = split_words(documents, key, text, path)
    table = word_table(words, path)
    sized = _joined(words, table.select("word", F.array(F.size("ids")).alias("ids")), _common(table, common, common_bytes).select("word", F.array(F.size("ids")).alias("ids")))
    sized = sized.select("key", "h", "pos", F.col("ids")[0].alias("k"))
    sums = sized.groupBy("key", "h").agg(F.sum("k").alias("k"), F.count_if(F.col("pos") == 0).alias("rows"))
    sums = sums.select(F.col("key").alias(key), F.expr("k div rows").alias("n_tokens"))
    none = documents.where(F.col(text).isNull() | (F.col(text) == "")).select(F.col(key), F.lit(0).cast("bigint").alias("n_tokens")).distinct()
    return sums.unionByName(none)


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, bytes of every token: the vocabulary, whose size is fixed by the tokenizer."""
    import json

    path = path or tokenizer_path()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    rows = [(i, bytearray(byte_of[c] for c in piece)) for piece, i in vocabulary.items() if all(c in byte_of for c in piece)]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key, text: ids turned back by a join with the (bounded) piece table. Empty lists give empty texts."""
    vocabulary = F.broadcast(pieces(encoded.sparkSession, path))
    flat = encoded.select(F.col(key).alias("key"), F.posexplode(ids).alias("pos", "id"))
    joined = flat.join(vocabulary, "id", "left").withColumn("h", F.hex("bytes"))
    texts = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("parts"))
    full = texts.select(F.col("key").alias(key), F.decode(F.unhex(F.array_join(F.col("parts.h"), "")), "UTF-8").alias("text"))
    none = encoded.where(F.size(ids) == 0).select(F.col(key), F.lit("").alias("text"))
    return full.unionByName(none)
