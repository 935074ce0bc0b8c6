"""Fill-in-middle transformation by in-place block rotation.

A text is cut at line ends into prefix, middle and suffix; the cuts, whether a text is
transformed and which of two orders it takes follow from a hash of its id. The text's
UTF-8 bytes lie in a bytearray. A scan of its line feeds turns line cuts into byte
offsets, sentinels are inserted at them, and two neighbouring blocks change places by
three reversals, each of which swaps chunks from both ends inside the array:

  psm   <P>prefix <M>middle <S>suffix   ->  the last two blocks change places
  spm   <P>prefix <M>middle <S>suffix   ->  <S>suffix moves before the other two
  plain the text

`restore` finds the sentinels (a text that contains one stays plain, so each is there
once), rotates back and deletes them: the bytes are those of the text again.

The work is per row and needs a text and its output in memory; nothing is shuffled, so
copies and hot sources only cost their own reading.

Defined results: null text counts as empty and is plain with output ''; a null id hashes
as an empty number; repeated rows give equal rows; lines end with a line feed, a last line
may lack it; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_CHUNK = 1 << 16


def reverse(data: bytearray, start: int, end: int) -> None:
    """Reverse data[start:end] in place, chunk by chunk from both ends."""
    view = np.frombuffer(data, np.uint8)
    while end - start > 1:
        k = min(_CHUNK, (end - start) // 2)
        left = view[start:start + k][::-1].copy()
        view[start:start + k] = view[end - k:end][::-1]
        view[end - k:end] = left
        start, end = start + k, end - k


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """The blocks [start, middle) and [middle, end) change places."""
    reverse(data, start, middle)
    reverse(data, middle, end)
    reverse(data, start, end)


def line_starts(data: bytes | bytearray) -> np.ndarray:
    """Byte offsets where lines start, and the end: cut k lies before line k."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends]).astype(np.int64)


def characters(data: bytearray, start: int, end: int) -> int:
    """Code points of a UTF-8 range: its bytes that continue none."""
    part = np.frombuffer(data, np.uint8)[start:end]
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def draws(id_: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def transform(data: bytes, numbers: tuple[int, int, int, int], rate: int,
              spm_rate: int) -> tuple[bytearray, int, str, int | None, int | None]:
    """(output, lines, form, prefix and middle in characters)."""
    out = bytearray(data)
    cuts = line_starts(out)
    n = len(cuts) - 1
    if not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or numbers[2] % 100 >= rate:
        return out, n, PLAIN, None, None
    one, two = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    first, second = int(cuts[one]), int(cuts[two])
    sizes = characters(out, 0, first), characters(out, first, second)
    # from the back, so that earlier offsets hold
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    form = SPM if numbers[3] % 100 < spm_rate else PSM
    rotate(out, middle if form == PSM else 0, suffix, len(out))
    return out, n, form, *sizes


def restore(data: bytes, form: str) -> bytearray:
    """The text of an output."""
    out = bytearray(data)
    if form == PLAIN:
        return out
    s, p, m = (out.index(x) for x in (SUFFIX, PREFIX, MIDDLE))
    if form == PSM:                        # P prefix S suffix M middle
        rotate(out, s, m, len(out))
    else:                                  # S suffix P prefix M middle
        rotate(out, 0, p, len(out))
    s, m = out.index(SUFFIX), out.index(MIDDLE)
    del out[s:s + len(SUFFIX)]
    del out[m:m + len(MIDDLE)]
    del out[:len(PREFIX)]
    return out


def _rows(schema: T.StructType, seed: int, rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                out.append(transform(text.as_py() or b"", draws(id_, seed), rate, spm_rate))
            output, n, form, prefix, middle = (list(c) for c in zip(*out)) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(bytes, output), pa.binary()).cast(pa.string()),
                 pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64())], names=schema.names)
    return run


def fill_in_middle(docs: DataFrame, keep: list[Column] | None = None, id_col: str = "doc_id",
                   text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """row (struct of the columns in `keep`; all by default), output, n (lines), form,
    prefix_chars, middle_chars. `rate` of 100 texts are transformed, `spm_rate` of 100 of
    those take the order suffix, prefix, middle."""
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    schema = T.StructType([rows.schema["row"], T.StructField("output", T.StringType()),
                           T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())])
    return rows.mapInArrow(_rows(schema, seed, rate, spm_rate), schema)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [bytes(restore(t.as_py() or b"", f)) for t, f in
                 zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())],
                                         names=["row", "text"])


def restored(outputs: DataFrame, keep: list[Column], output_col: str = "output",
             form_col: str = "form") -> DataFrame:
    """row (struct of the columns in `keep`), text: the texts that outputs were made from."""
    rows = outputs.select(F.struct(*keep).alias("row"), F.col(output_col).alias("o"), F.col(form_col).alias("f"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(_restored, schema)
