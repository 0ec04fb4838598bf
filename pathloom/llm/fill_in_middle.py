"""Fill-in-middle transformation: a text is cut in three and rearranged, so a model learns to write the middle.

Cuts fall between tokens, ``[A-Za-z]+|[^A-Za-z]`` from left to right over code points.  The offsets of all
token boundaries of a text form a sorted list; a learned rank index predicts the offset of a boundary from
its rank: straight segments whose error is at most ``ERROR`` bytes, found by halving where one line does
not fit, and one stored byte per boundary, the residual, that makes a prediction exact.  A cut at rank
``k`` reads one segment and one residual.

Where a text is cut and which form it takes follows from sha256 of ``salt`` and its id alone, so a rerun
or a recomputed task repeats it.  Forms: ``psm`` ``<P>prefix<S>suffix<M>middle``, ``spm``
``<S>suffix<P>prefix<M>middle``, ``plain`` the text as it is.

Cases: a null text is empty; an empty text, and one that holds a mark, is plain, so every output can be
undone; a null id is hashed as no digits; repeated rows get equal outputs; an empty table gives an empty
table.  A text is worked on whole, with some 60 bytes of memory for each of its bytes; a slice holds
``SLICE_BYTES`` or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.tables import texts
from pathloom.llm.text import Slice, byte_class, slices

ERROR = 127  # bytes a segment may be wrong by: a residual is one signed byte
SLICE_BYTES = 1 << 20
_FRACTION = 16  # binary places of a slope
_LETTERS = byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class RankIndex:
    """Rank -> offset for several sorted lists that stand one after the other in ``at``.

    ``first[i]`` is where list i starts; ``first[-1]`` is the end of the last one.  No list is empty.
    """

    def __init__(self, at: np.ndarray, first: np.ndarray):
        self.residual = np.zeros(len(at), np.int8)
        found: list[tuple[np.ndarray, ...]] = []
        low, high = first[:-1].astype(np.int64), first[1:].astype(np.int64)
        while len(low):
            size = high - low
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            step = np.arange(size.sum()) - np.repeat(start, size)  # rank inside the segment
            rank = np.repeat(low, size) + step
            slope = ((at[high - 1] - at[low]) << _FRACTION) // np.maximum(size - 1, 1)
            off = at[rank] - np.repeat(at[low], size) - ((np.repeat(slope, size) * step) >> _FRACTION)
            least, most = np.minimum.reduceat(off, start), np.maximum.reduceat(off, start)
            middle = (least + most) >> 1
            fits = most - least <= 2 * ERROR
            inside = np.repeat(fits, size)
            self.residual[rank[inside]] = (off - np.repeat(middle, size))[inside]
            found.append((low[fits], (at[low] + middle)[fits], slope[fits]))
            half = low + (size >> 1)
            low, high = np.concatenate((low[~fits], half[~fits])), np.concatenate((half[~fits], high[~fits]))
        low, base, slope = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(low)
        self.low, self.base, self.slope = low[order], base[order], slope[order]

    def __getitem__(self, rank: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.low, rank, side="right") - 1
        predicted = self.base[segment] + ((self.slope[segment] * (rank - self.low[segment])) >> _FRACTION)
        return predicted + self.residual[rank]


def boundaries(docs: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets in the slice of every token boundary, text after text (a text of n tokens has n + 1),
    and where each text's boundaries start."""
    data = docs.bytes
    letter = _LETTERS[data]
    starts = (data & 0xC0) != 0x80
    joined = letter[1:] & letter[:-1]
    starts[1:] &= ~joined
    opening = docs.offsets[:-1][np.diff(docs.offsets) > 0]
    starts[opening] = True
    token = np.flatnonzero(starts)
    first = np.searchsorted(token, docs.offsets)
    # One more boundary, the end, after the tokens of each text.
    at = np.insert(token, first[1:], docs.offsets[1:])
    return at, first + np.arange(docs.n + 1)


def draws(doc_id: int | None, salt: str) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the hash of a document."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4))


def _rearrange(docs: Slice, salt: str, rate: int, spm: int) -> pa.RecordBatch:
    at, first = boundaries(docs)
    index = RankIndex(at, first)
    tokens = np.diff(first) - 1
    ids = docs.rows.column("doc_id").to_pylist()
    h = np.array([draws(i, salt) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (tokens + 1)[:, None], axis=1)
    cut = index[first[:-1, None] + cuts]
    chars = np.concatenate(([0], np.cumsum((docs.bytes & 0xC0) != 0x80)))
    lengths = np.diff(chars[np.column_stack((docs.offsets[:-1], cut))], axis=1)
    whole = docs.bytes.tobytes()
    forms, outputs = [], []
    for i, (start, end) in enumerate(zip(docs.offsets[:-1].tolist(), docs.offsets[1:].tolist(), strict=True)):
        text = whole[start:end]
        if not text or h[i, 2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            forms.append("plain")
            outputs.append(text)
            continue
        one, two = cut[i].tolist()
        prefix, middle, suffix = whole[start:one], whole[one:two], whole[two:end]
        if h[i, 3] % 100 < spm:
            forms.append("spm")
            outputs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
        else:
            forms.append("psm")
            outputs.append(b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    plain = np.array([f == "plain" for f in forms], bool)
    columns = [
        docs.rows.column("doc_id"), pa.array(tokens), pa.array(forms, pa.string()), pa.array(lengths[:, 0], mask=plain),
        pa.array(lengths[:, 1], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, salt: str = "1:", rate: int = 90, spm: int = 20) -> DataFrame:
    """Per document ``doc_id, n, form, prefix_chars, middle_chars, output``; see FORMS.

    Of 100 texts ``rate`` are rearranged, and of 100 of those ``spm`` put the suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE_BYTES):
            yield _rearrange(part, salt, rate, spm)

    return texts(docs).mapInArrow(run, FORMS)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text an output was made from.  A rearranged text holds no mark, so its three marks are its own."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
