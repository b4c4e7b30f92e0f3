"""What the operators of this subpackage share: Arrow mapping, sorted groups, words, and fixed tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Texts are cut into slices of about this many characters, so that lists of words stay small.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task turns into Python objects at once.
ROWS_AT_ONCE = 1024


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(begin, ROWS_AT_ONCE)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that yields dicts of columns, typed by ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(_small(batches)):
            arrays = [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type, from_pandas=False)
                      for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """Rows of ``df`` that pass a test in Python, all columns kept and nothing shuffled; ``start`` runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = start()
        for batch in _small(batches):
            yield batch.filter(pa.array(passes(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null becomes the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def longs(batch: pa.RecordBatch, column: str) -> list[int | None]:
    return batch.column(column).to_pylist()


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of a stream whose rows are sorted by ``key``, one table at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            if held and keys[begin] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut at a space between two characters that are none.

    The space stays at the start of the next part, so the parts add up to the text.
    """
    begin = 0
    while len(text) - begin > size:
        cut = begin + size
        while (cut := text.find(" ", cut)) > 0 and cut + 1 < len(text) and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut += 1
        if cut < 0 or cut + 1 >= len(text):
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:] if begin else text


_SPACES = bytes.maketrans(bytes(range(128)), bytes(b if chr(b).isalpha() else 32 for b in range(128)))


def letter_words(text: str) -> list[bytes]:
    """Lower-case runs of letters as UTF-8 bytes; every character beyond ASCII counts as a letter."""
    return text.lower().encode("utf-8", "replace").translate(_SPACES).split()



def crc_of(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    return materialize(df, f"llm-{name}")
