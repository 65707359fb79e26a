"""Records of BAM files as Arrow columns: a batch of records lies in one buffer, and each field of all of them is taken out of it at once."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandlake.functions import kinetics

SCHEMA = "read_id long, qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual array<short>, fi array<int>, ri array<int>, fp array<int>, rp array<int>, fn int, rn int, ec double, mm string, ml array<short>, zp array<float>"
# Fixed values of the format: letters of the 4-bit base codes and of the cigar codes, and struct letters of the tag types.
BASES, CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TYPES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "A": "c"}
FIXED = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
#: Tags of pulse signals.
SIGNALS = ("fi", "ri", "fp", "rp")
#: Operations that a record's own cigar can have; a longer one is in tag CG, and a clip of the whole read and a skip stand in its place.
MOST_OPS = 65_535

_letters = np.frombuffer(BASES.encode(), dtype=np.uint8)
_PAIRS = np.stack([_letters[np.arange(256) >> 4], _letters[np.arange(256) & 15]], axis=1)
_FRAME, _CODE, _STEP = np.array(kinetics.SEGMENTS).T


def codes(name: str, kind: str, values: np.ndarray) -> np.ndarray:
    """Codes of a signal: bytes (C) as they are, raw frames (S) encoded."""
    if kind not in "CS":
        raise ValueError(f"tag {name} is B:{kind}, not B:C or B:S")
    if kind == "C":
        return values.astype(np.int32)
    v = np.minimum(np.asarray(values, dtype=np.int32), kinetics.MOST_FRAMES)
    at = np.searchsorted(_FRAME, v, "right") - 1
    return (_CODE[at] + (v - _FRAME[at]) // _STEP[at]).astype(np.int32)


def _gather(a: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Some bytes from each of some places, in a row."""
    begin = np.cumsum(size) - size
    return a[np.repeat(start - begin, size) + np.arange(int(size.sum()))]


def _text(data: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.append(0, np.cumsum(size)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def _lists(values: np.ndarray, size: np.ndarray, missing: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind), mask=pa.array(missing))


class _Arrays:
    """Where an array tag of each record lies: none, or its type, place and length."""

    def __init__(self, n: int) -> None:
        self.kind, self.start, self.size = np.zeros(n, dtype="U1"), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def values(self, a: np.ndarray, name: str, kind: str) -> np.ndarray:
        begin = np.cumsum(self.size) - self.size
        out = np.zeros(int(self.size.sum()), dtype=kind)
        for k in np.unique(self.kind[self.kind != ""]):
            own = self.kind == k
            item, size = np.dtype("<" + TYPES[str(k)]), self.size[own]
            found = _gather(a, self.start[own], size * item.itemsize).view(item)
            place = np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(len(found))
            out[place] = codes(name, str(k), found) if name in SIGNALS else found
        return out


def _tags(data: bytes, at: int, end: int, i: int, arrays: dict[str, _Arrays], single: dict[str, list]) -> None:
    """Note the places of a record's array tags and the values of its others."""
    while at < end:
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(0, at, end)
            if name in single:
                single[name][i] = data[at:stop].decode()
            at = stop + 1
        elif kind == "B":
            item, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            if name in arrays:
                own = arrays[name]
                own.kind[i], own.start[i], own.size[i] = item, at + 5, n
            at += 5 + n * struct.calcsize(TYPES[item])
        else:
            if name in single:
                single[name][i] = struct.unpack_from("<" + TYPES[kind], data, at)[0]
            at += struct.calcsize(TYPES[kind])
    if at != end:
        raise ValueError("a record's tags go beyond its end")


def _cigars(a: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ops = _gather(a, start, 4 * size).view("<u4")
    if len(ops) and int((ops & 15).max()) >= len(CIGAR):
        raise ValueError("unknown cigar operation")
    letters = pa.array(list(CIGAR)).take(pa.array(ops & 15))
    each = pc.binary_join_element_wise(pa.array(ops >> 4).cast(pa.string()), letters, "")
    at = np.append(0, np.cumsum(size)).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), each), "")
    return pc.if_else(pa.array(size > 0), joined, "*")


def decoded(data: bytes, start: np.ndarray, size: np.ndarray, names: list[str], ids: np.ndarray) -> pa.RecordBatch:
    """A batch of the records of ``size`` bytes that begin at ``start`` (their length fields left out)."""
    a, n = np.frombuffer(data, dtype=np.uint8), len(start)
    head = a[start[:, None] + np.arange(FIXED.itemsize)].view(FIXED).ravel()
    l_seq, l_name, n_ops = (head[c].astype(np.int64) for c in ("l_seq", "l_name", "n_cigar"))
    name_at = start + FIXED.itemsize
    ops_at = name_at + l_name
    seq_at = ops_at + 4 * n_ops
    qual_at = seq_at + (l_seq + 1) // 2
    tags_at = qual_at + l_seq
    if (l_seq < 0).any() or (l_name < 1).any() or (tags_at > start + size).any():
        raise ValueError("a record's fields go beyond its end")

    arrays = {t: _Arrays(n) for t in (*SIGNALS, "ML", "ZP", "CG")}
    single: dict[str, list] = {t: [None] * n for t in ("MM", "fn", "rn", "ec")}
    for i, (at, end) in enumerate(zip(tags_at.tolist(), (start + size).tolist(), strict=True)):
        _tags(data, at, end, i, arrays, single)

    # A clip of the whole read, then a skip: the cigar is in CG.
    first = np.zeros(n, dtype=np.int64)
    two = n_ops == 2
    first[two] = _gather(a, ops_at[two], np.full(int(two.sum()), 4)).view("<u4")
    long = two & (arrays["CG"].kind == "I") & (first == (l_seq << 4 | CIGAR.index("S")))
    ops_at, n_ops = np.where(long, arrays["CG"].start, ops_at), np.where(long, arrays["CG"].size, n_ops)

    letters = _PAIRS[_gather(a, seq_at, (l_seq + 1) // 2)].ravel()
    odd = np.cumsum((l_seq + 1) // 2 * 2)[l_seq % 2 == 1] - 1
    qual = _gather(a, qual_at, l_seq)
    begins = np.cumsum(l_seq) - l_seq
    no_qual = np.zeros(n, dtype=bool)
    no_qual[l_seq > 0] = qual[begins[l_seq > 0]] == 0xFF
    if len(head) and (int(head["ref"].max()) >= len(names) or int(head["ref"].min()) < -1):
        raise ValueError("a record's contig is not in the header")
    whole = lambda t: pa.array([int(v or 0) for v in single[t]], pa.int32())
    listed = lambda t, kind, arrow: _lists(arrays[t].values(a, t, kind), arrays[t].size, arrays[t].kind == "", arrow)
    columns = {
        "read_id": pa.array(ids, pa.int64()),
        "qname": _text(_gather(a, name_at, l_name - 1), l_name - 1),
        "flag": pa.array(head["flag"].astype(np.int32)),
        "rname": pa.array([*names, "*"], pa.string()).take(pa.array(np.where(head["ref"] < 0, len(names), head["ref"]))),
        "pos": pa.array(head["pos"]),
        "mapq": pa.array(head["mapq"].astype(np.int32)),
        "cigar": _cigars(a, ops_at, n_ops),
        "seq": _text(np.delete(letters, odd), l_seq),
        "qual": _lists(qual.astype(np.int16), l_seq, no_qual, pa.int16()),
        **{t: listed(t, "i4", pa.int32()) for t in SIGNALS},
        "fn": whole("fn"),
        "rn": whole("rn"),
        "ec": pa.array([float(v or 0) for v in single["ec"]], pa.float64()),
        "mm": pa.array(single["MM"], pa.string()),
        "ml": listed("ML", "i2", pa.int16()),
        "zp": listed("ZP", "f4", pa.float32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _number(a: np.ndarray, k: int, n: int) -> np.ndarray:
    """The four bytes from k on of each of the first n places, as a signed number."""
    v = sum(a[k + j : k + j + n].astype(np.int64) << 8 * j for j in range(4))
    return v - ((v >> 31) << 32)


def likely_heads(data: bytes, n_refs: int) -> Iterator[int]:
    """Places where a record may begin (with its length field), in order: all fields are in range and fit into it, and its name is text."""
    a = np.frombuffer(data, dtype=np.uint8)
    n = len(a) - FIXED.itemsize - 4
    if n <= 0:
        return
    size, ref, pos, l_seq, mate_ref, mate_pos = (_number(a, k, n) for k in (0, 4, 8, 20, 24, 28))
    l_name, n_ops = a[12 : 12 + n].astype(np.int64), a[16 : 16 + n].astype(np.int64) | a[17 : 17 + n].astype(np.int64) << 8
    ok = (ref >= -1) & (ref < n_refs) & (pos >= -1) & (l_name > 0) & (l_seq >= 0) & (mate_ref >= -1) & (mate_ref < n_refs) & (mate_pos >= -1)
    ok &= FIXED.itemsize + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq <= size
    for p in np.flatnonzero(ok).tolist():
        name = data[p + 36 : p + 36 + int(l_name[p])]
        if len(name) < l_name[p] or name[-1] == 0 and all(32 < c < 127 for c in name[:-1]):
            yield p
