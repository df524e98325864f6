"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of its own text. A text is put in lower case, what isn't a
letter becomes a space, and it is encoded in blocks with every dictionary; the language of the smallest total is chosen.
Blocks are short, so that the dictionary decides rather than the text's own beginning. A narrow margin is marked as
rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

#: Bounds of the fit: languages that are learned, the most frequent ones; bytes of a dictionary; rows sampled for a language
#: (BUCKETS x PER_BUCKET), each giving an equal share of the dictionary in SLICES taken from all over its text.
MAX_LANGUAGES = 256
DICTIONARY_BYTES = 1 << 16
BUCKETS, PER_BUCKET = 32, 4
SLICES = 4
#: Bytes encoded at once, and the relative margin below which a prediction is marked as rejected.
BLOCK = 512
MARGIN = 0.01
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def _prepared(text: str) -> bytes:
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


def share(text: str) -> bytes:
    """What a sampled text gives to its language's dictionary: all of it or, where it is longer than a row's share, slices
    that begin with a word and lie at equal distances from its beginning to its end."""
    data = _prepared(text)
    most = DICTIONARY_BYTES // (BUCKETS * PER_BUCKET)
    if len(data) <= most:
        return data
    size, out = most // SLICES, []
    for k in range(SLICES):
        at = (len(data) - size) * k // (SLICES - 1)
        at = max(data.rfind(b" ", 0, at + 1), 0)
        out.append(data[at : at + size].decode("utf-8", "ignore").encode())
    return b"".join(out)


class LanguageModel:
    """Dictionaries by language, the most frequent language first; ties go to the earlier one."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self._encoders = None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_encoders": None}

    def sizes(self, text: str) -> dict[str, int]:
        """Bytes of the whole text under each language."""
        if self._encoders is None:
            import zstandard as z

            settings = z.ZstdCompressionParameters.from_level(3, min_match=3, strategy=z.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
            self._encoders = {k: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=settings) for k, d in self.dictionaries.items()}
        data = _prepared(text)
        out = dict.fromkeys(self._encoders, 0)
        for a in range(0, len(data), BLOCK):
            block = data[a : a + BLOCK]
            for k, e in self._encoders.items():
                out[k] += len(e.compress(block))
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow. The score is the best language's share if every byte
        more halves a language's odds; it is 0 where there is nothing to go by."""
        if not text or not self.dictionaries or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(sizes, key=sizes.get)
        least = sizes[best]
        others = sorted(v for k, v in sizes.items() if k != best)
        score = 1 / sum(2.0 ** max(-1000, least - v) for v in sizes.values())
        return best, score, bool(others) and others[0] - least < MARGIN * least


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Dictionaries from a bounded sample of the rows with a text and a language.

    For each language the sample holds the texts with the smallest hashes in each of ``BUCKETS`` ranges, copies counted
    once, so that neither a large source nor a large group of copies fills it. Each gives its ``share``. Of more than
    ``MAX_LANGUAGES`` languages the most frequent are learned, ties by name. An empty table, or one without a text that
    has a language, gives a model that knows none.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return LanguageModel({})
    learned = F.broadcast(docs.sparkSession.createDataFrame([(r.lang,) for r in counts], "lang string"))
    first = Window.partitionBy("lang", F.pmod("h", F.lit(BUCKETS))).orderBy("h")
    chosen = rows.join(learned, "lang").select("lang", "h").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= PER_BUCKET).select("lang", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([share(t) for t in b.column(2).to_pylist()], pa.binary())], ["lang", "h", "share"])

    shares = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text").mapInArrow(run, "lang string, h long, share binary")
    found = {r.lang: bytearray() for r in counts}
    for r in sorted(shares.groupBy("lang", "h").agg(F.min("share").alias("share")).collect(), key=lambda r: (r.lang, r.h)):  # a dictionary a language
        found[r.lang] += r.share
    return LanguageModel({k: bytes(v[:DICTIONARY_BYTES]) for k, v in found.items() if v.strip()})


def held_out(id_col: str = "doc_id"):
    """Whether a row belongs to the fold that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every row, from its text alone.

    A null text, and one without a letter, gives ``und`` with score 0, as does any text if no language is known. Null and
    repeated ids keep their rows; an empty table gives an empty result; other columns are ignored; whole texts are encoded.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DICTIONARY_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.predict(t) for t in b.column(1).to_pylist()]
            lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: learned from the folds that aren't held out, predicted for the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where("doc_id is not null").where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
