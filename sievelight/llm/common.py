"""Shared pieces of the corpus operators: scratch space, hashing, tokenizing."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between ASCII blanks (\x20 and \x09 to \x0D).
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` under the checkpoint folder that the cluster names.

    The setting is read from the session. Only where it is unset, and the
    session is local (tests), does it get a local folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="sievelight-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files that no frame refers to any more, before the next large shuffle."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rested(spark: SparkSession) -> None:
    """``released``, and executors give back what their heaps grew by: between large steps.

    A heap that was filled once stays as large, and the Python workers of the
    steps so far live on beside it: both share an executor's memory.
    """
    released(spark)
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spaced_words(text: Column) -> Column:
    """The words of a text, each with the blanks after it."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, counted without building them (long)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id's decimal text falls in ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def trimmed(run):
    """``run`` over Arrow batches, with what it freed given back to the system at its end: workers live on and share an executor's memory."""

    def freeing(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return freeing


def batches(columns: dict[str, pa.DataType], rows: list[tuple], step: int = 1 << 14):
    """Arrow batches of at most ``step`` rows from a list of tuples."""
    names, types = list(columns), list(columns.values())
    for i in range(0, len(rows), step):
        part = list(zip(*rows[i : i + step], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(part, types, strict=True)], names)


def utf8(array: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as bytes, null as empty."""
    return [b"" if v is None else v for v in array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()]


#: ASCII symbols (not the apostrophe) after an ASCII or Latin-1 letter, at the end of a chunk.
_SYMBOL = rb"[!-&(-/:-@\[-`{-~]"
_TAIL = re.compile(rb"%s(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))%s*(?=[\x20\x09-\x0d]|$)" % (_SYMBOL, _SYMBOL), re.DOTALL)
#: Lower-case ASCII letters, Latin-1 letters and nothing else.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: Byte-level vocabularies write a byte as itself where that is a visible character, else as the next code point from 256.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


class ChunkEncoder(dict):
    """The tokenizers library behind a cache of blank-separated chunks.

    It serves tokenizers that compose (NFC), fold case, drop white space and
    then split letters from punctuation, as ``word_bpe_49k.json`` does: such a
    text has the concatenated ids of the chunks between its ASCII blanks, so
    a chunk is encoded by the library when it is met and looked up after that.
    Fewer chunks are distinct once ASCII letters are lower-cased and trailing
    symbols are cut off; neither changes an id unless the text has combining
    marks or the bracket of a special token, and such texts are only split.

    The cache is two generations of at most about ``half`` chunks: a full
    young one replaces the old one, from which chunks that are met again move
    up. Chunks over ``longest`` bytes are never kept.
    """

    def __init__(self, path: str, half: int = 200_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.half, self.longest = Tokenizer.from_file(path), half, longest
        self.model = self.tokenizer.model
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def chunks(text: bytes) -> list[bytes]:
        if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
            return text.split()
        return _TAIL.sub(rb" \g<0>", text.lower()).split()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = array("I", self._ids(chunk)).tobytes()
            if len(chunk) > self.longest:
                return ids
        self[chunk] = ids
        return ids

    def _ids(self, chunk: bytes) -> list[int]:
        # letters alone leave nothing to compose or to split: the model is enough
        if len(chunk) <= self.longest:
            if chunk.isalpha() and chunk.islower():
                return [t.id for t in self.model.tokenize(chunk.decode())]
            if _PLAIN(chunk):
                return [t.id for t in self.model.tokenize(chunk.decode().lower().encode().decode("latin-1").translate(_BYTE_CHARS))]
        return self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each UTF-8 text its ids as little-endian unsigned 32-bit integers."""
        get, out = self.__getitem__, []
        for i in range(0, len(texts), 64):
            out += [b"".join(map(get, self.chunks(t))) for t in texts[i : i + 64]]
            if len(self) > self.half:
                self.old = dict(self)
                self.clear()
        return out


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and file."""
    return ChunkEncoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies (the path is a parameter of all that use it)."""
    import public_tokenizers

    return public_tokenizers.path(name)
