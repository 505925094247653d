"""What the operators share: table reading, bucketed tables, hashing in blocks."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.session import remove, shared_dir, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that ends a word: \x20 and \x09-\x0D. bytes.split() without arguments splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many `_` after it as keep it apart from the columns of df, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that are written: it looks for them only when the driver collects garbage."""
    spark._jvm.System.gc()


def _forget(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session is gone, and its catalog with it
        pass


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """As `written`, in buckets of `key`: what groups or joins by it reads the table without a shuffle of it."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    atexit.register(remove, spark, path)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Rows of texts that are hashed at a time.
ROWS = 1000
#: Bytes of text that are hashed at a time, and words that get xxhash instead, as a polynomial is weak on them.
SLICE, LONG_WORD = 1 << 16, 256
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CODE[65:91] = _CODE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = _powers(_BASE, SLICE + 1), _powers(_INVERSE, SLICE + 1)


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """uint64 hashes of the spans from start to end of a run of codes (random uint64 for each letter): a polynomial, and the length. Weak on spans of over LONG_WORD letters."""
    n = len(codes)
    up, down = (_UP, _DOWN) if n <= SLICE else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _slice_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a run of bytes that is no word's part."""
    import xxhash

    gap = np.concatenate([[True], _SPACE[data], [True]])
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turn[::2], turn[1::2]
    h = span_hashes(_CODE[data], start, end)
    for i in np.flatnonzero(end - start > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes().lower())
    return h, start


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hashes of the words `[^\\x20\\x09-\\x0D]+` of whole texts (an Arrow array of strings), A-Z lowered, and how many words each text has (0 for null).

    Bytes are hashed in slices that end at white space or at a text's end, so a task needs a fixed room whatever a text's length."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    hashes, counts = [], np.zeros(n, np.int64)
    at, last, first = int(offsets[0]), int(offsets[-1]), 0
    while at < last:
        # Up to the last text's end in reach, or else within a text up to its last white space in reach.
        stop = int(np.searchsorted(offsets, at + SLICE, "right")) - 1
        if offsets[stop] > at:
            end = int(offsets[stop])
        else:
            text_end, end = int(offsets[stop + 1]), at + SLICE
            while end < text_end:
                gaps = np.flatnonzero(_SPACE[data[end - SLICE : end]])
                if len(gaps):
                    end = end - SLICE + int(gaps[-1]) + 1
                    break
                end += SLICE
            end = min(end, text_end)
        first = int(np.searchsorted(offsets, at, "right")) - 1
        own = offsets[first : int(np.searchsorted(offsets, end, "left")) + 1]
        inner = own[(own > at) & (own < end)] - at
        part = data[at:end]
        if len(inner):
            # A gap between texts, so that no word reaches from one into the next.
            part = np.insert(part, inner, 32)
            inner = inner + np.arange(len(inner))
        h, start = _slice_words(part)
        hashes.append(h)
        bounds = np.concatenate([[0], np.searchsorted(start, inner), [len(start)]])
        texts_here = np.searchsorted(offsets, np.concatenate([[at], own[(own > at) & (own < end)]]), "right") - 1
        np.add.at(counts, texts_here, np.diff(bounds))
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def map_texts(rows: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with `run`, which takes Arrow batches of rows, of at most ROWS rows each, and gives pandas frames."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def frames(batches):
        import pyarrow as pa

        small = (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))
        for pdf in run(small):
            yield pa.RecordBatch.from_pandas(pdf, schema=fields, preserve_index=False)

    return rows.mapInArrow(frames, schema)


def planes(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, byte plane by byte plane, so that the shuffle's compression removes the empty planes."""
    d = sorted_values.copy()
    d[1:] -= sorted_values[:-1]
    return d.view(np.uint8).reshape(-1, d.itemsize).T.tobytes()


def unplanes(block: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    d = np.frombuffer(block, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()
    return np.cumsum(d, dtype=dtype)
