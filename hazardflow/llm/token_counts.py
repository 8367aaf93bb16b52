"""Token counts of whole texts from a cache keyed by content and tokenizer version.

The digest of a text names its content, the digest of the vocabulary file and of the settings names the tokenizer.
Documents are joined with the stored counts by digest; each distinct text that has none is encoded once, and its
count is appended to the cache as one more batch folder. A later run over grown tables encodes only what is new.

Content is normalised as far as the count cannot change: null becomes empty, and where the model writes spaces as
the mark U+2581, that mark and a space are the same content.

Odd rows: a null or empty text has no tokens and no bytes; a null id stays null; repeated rows each come back; an empty
table gives an empty one; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardflow.llm import encoding, pieces
from hazardflow.llm.storage import stored

LIMIT = 4096
MODEL = "piece_bpe_32k.model"
# A content that at least one row in so many has is joined by broadcast: there are at most so many of them.
HEAVY = 1000
CACHED = "content binary, n_tokens long"


def tokenizer_digest(vocab: str) -> str:
    """Version of a tokenizer: library, settings and the bytes of its file."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if vocab.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    settings = f"{library}; no begin, end or added tokens; special strings by default; {pieces.file_digest(encoding.vocabulary(vocab))}"
    return hashlib.sha256(settings.encode()).hexdigest()


def content_digest(text: Column, vocab: str = MODEL) -> Column:
    """SHA-256 of the normalised content."""
    known = F.coalesce(text.cast("string"), F.lit(""))
    if vocab.endswith(".model"):
        known = F.translate(known, pieces.MARK, " ")
    return F.unhex(F.sha2(known, 256))


def cached(spark: SparkSession, cache: str, vocab: str = MODEL) -> DataFrame:
    """Stored counts of one tokenizer, each content once, however often it was appended. No folder: no rows."""
    try:
        rows = spark.read.schema(f"{CACHED}, batch string").parquet(f"{cache}/tokenizer={tokenizer_digest(vocab)}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHED)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(vocab: str):
    """Batches of (content, text) to (content, n_tokens)."""
    path = encoding.vocabulary(vocab)

    def lengths(texts: list[str]) -> list[int]:
        if vocab.endswith(".model"):
            return [len(ids) // encoding.ID_BYTES for ids in pieces.encoder(path).encode(texts)]
        return [len(e.ids) for e in _library(path).encode_batch(texts, add_special_tokens=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contents, texts in encoding.text_runs(batches):
            columns = [pa.array(contents, pa.binary()), pa.array(lengths(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["content", "n_tokens"])

    return run


_LOADED: dict[str, object] = {}


def _library(path: str):
    """A vocabulary of the tokenizers library with its own defaults, without truncation and padding."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].no_truncation()
        _LOADED[path].no_padding()
    return _LOADED[path]


def append_missing(docs: DataFrame, contents: DataFrame, cache: str, text_col: str = "text", vocab: str = MODEL) -> None:
    """Encode each distinct content without a stored count once and append the counts as one batch.

    ``contents`` has the digests of ``docs``. Texts that are stored already are not shuffled if the missing digests
    are few (a broadcast the optimizer chooses by their measured size). The batch appears only when it is complete;
    a batch that is written twice, or by two jobs at once, does no harm, since equal contents have equal counts.
    """
    spark = docs.sparkSession
    missing = stored(contents.select("content").distinct().join(cached(spark, cache, vocab), "content", "left_anti"), "missing")
    texts = docs.select(content_digest(F.col(text_col), vocab).alias("content"), F.col(text_col).cast("string").alias("text"))
    # Copies collapse inside their tasks before one text per content is shuffled.
    once = texts.groupBy("content").agg(F.first("text").alias("text")).join(missing, "content", "left_semi")
    counts = once.select("content", "text").mapInArrow(_counter(vocab), CACHED)
    counts.write.parquet(f"{cache}/tokenizer={tokenizer_digest(vocab)}/batch={uuid.uuid4().hex}")


def counted(
    docs: DataFrame, cache: str, id_col: str = "doc_id", text_col: str = "text", vocab: str = MODEL, limit: int = LIMIT
) -> DataFrame:
    """One row per document: id, UTF-8 bytes, tokens, and whether these exceed ``limit``.

    ``cache`` is a folder all executors reach; it is made when it is not there and grows by what it lacked.
    """
    spark = docs.sparkSession
    keyed = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
            content_digest(F.col(text_col), vocab).alias("content"),
        ),
        "contents",
    )
    append_missing(docs, keyed, cache, text_col, vocab)
    counts = cached(spark, cache, vocab)
    # Contents of at least a 1/HEAVY part of the rows number HEAVY at most; all others spread evenly.
    rows = keyed.count()
    heavy = keyed.groupBy("content").agg(F.count("*").alias("_n")).where(F.col("_n") * HEAVY >= rows).select("content")
    heavy = stored(counts.join(F.broadcast(heavy), "content", "left_semi"), "heavy")
    light = keyed.join(F.broadcast(heavy.select("content")), "content", "left_anti").join(counts, "content")
    found = light.unionByName(keyed.join(F.broadcast(heavy), "content"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
