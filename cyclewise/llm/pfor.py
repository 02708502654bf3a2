"""Patched frame-of-reference blocks of token ids.

A segment image, little-endian:

    magic ``PFR1``, uint32 n_docs, uint64 n_ids, uint32 n_blocks
    int64[n_docs] document ids, uint32[n_docs] ids of each document
    uint32[n_blocks + 1] block starts, in bytes from the first block
    blocks: uint32 minimum, uint8 width, uint8 n_exceptions, 2 zero bytes,
            BLOCK values of ``width`` bits, then n_exceptions uint8 places and
            n_exceptions uint32 high parts

A block holds BLOCK consecutive ids, whatever their document.  The width is the
bits that ``PERCENTILE`` per cent of the differences to the minimum need; the
high bits of larger ones go to the exception list.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
PERCENTILE = 90
HEAD = 8
MAGIC = b"PFR1"


def _bits(d: np.ndarray) -> np.ndarray:
    return np.frexp(d.astype(np.float64))[1].astype(np.uint8)


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """(n, BLOCK) values under 2**w to (n, BLOCK * w / 8) bytes."""
    t = np.ascontiguousarray(v.T).astype(np.uint64)
    out = np.zeros((BLOCK * w // 32 + 1, v.shape[0]), dtype=np.uint64)
    for j in range(BLOCK):
        k, s = divmod(j * w, 32)
        x = t[j] << np.uint64(s)
        out[k] |= x & np.uint64(0xFFFFFFFF)
        if s + w > 32:
            out[k + 1] |= x >> np.uint64(32)
    return np.ascontiguousarray(out[:-1].T.astype("<u4")).view(np.uint8)


def _unpack(b: np.ndarray, w: int) -> np.ndarray:
    t = np.ascontiguousarray(b).view("<u4").T.astype(np.uint64)
    out = np.empty((BLOCK, b.shape[0]), dtype=np.uint32)
    mask = np.uint64((1 << w) - 1)
    for j in range(BLOCK):
        k, s = divmod(j * w, 32)
        x = t[k] >> np.uint64(s)
        if s + w > 32:
            x = x | (t[k + 1] << np.uint64(32 - s))
        out[j] = (x & mask).astype(np.uint32)
    return out.T


def encode(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Segment image of documents whose ids stand one after the other in ``ids``."""
    n_blocks = -(-len(ids) // BLOCK)
    head = MAGIC + struct.pack("<IQI", len(doc_ids), len(ids), n_blocks)
    tables = doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes()
    if not n_blocks:
        return head + tables + np.zeros(1, "<u4").tobytes()
    m = np.empty(n_blocks * BLOCK, dtype=np.uint32)
    m[:len(ids)] = ids
    m[len(ids):] = ids[-1]
    m = m.reshape(n_blocks, BLOCK)
    low = m.min(axis=1)
    d = m - low[:, None]
    place = -(-PERCENTILE * BLOCK // 100) - 1
    # bit length is monotone: the percentile of the bits is the bits of the percentile
    width = np.maximum(_bits(np.partition(d, place, axis=1)[:, place]), 1).astype(np.int64)
    out_row, out_col = np.nonzero(d >> np.minimum(width, 31).astype(np.uint32)[:, None] if (width < 32).all()
                                  else (d.astype(np.uint64) >> width.astype(np.uint64)[:, None]))
    n_out = np.bincount(out_row, minlength=n_blocks)
    size = HEAD + BLOCK * width // 8 + 5 * n_out
    start = np.concatenate([[0], np.cumsum(size)])
    buf = np.zeros(start[-1], dtype=np.uint8)
    for w in np.unique(width):
        rows = np.nonzero(width == w)[0]
        body = np.zeros((len(rows), HEAD + BLOCK * w // 8), dtype=np.uint8)
        body[:, :4] = low[rows].astype("<u4")[:, None].view(np.uint8)
        body[:, 4] = w
        body[:, 5] = n_out[rows]
        body[:, HEAD:] = _pack(d[rows] & np.uint32((1 << int(w)) - 1), int(w))
        buf[start[rows][:, None] + np.arange(body.shape[1])] = body
    if len(out_row):
        nth = np.arange(len(out_row)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        at = start[out_row] + HEAD + BLOCK * width[out_row] // 8
        buf[at + nth] = out_col.astype(np.uint8)
        high = (d[out_row, out_col].astype(np.uint64) >> width[out_row].astype(np.uint64)).astype("<u4")
        buf[(at + n_out[out_row] + 4 * nth)[:, None] + np.arange(4)] = high[:, None].view(np.uint8)
    return head + tables + start.astype("<u4").tobytes() + buf.tobytes()


def decode(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc_ids, counts, ids`` of a segment image."""
    if image[:4] != MAGIC:
        raise ValueError("not a segment image")
    n_docs, n_ids, n_blocks = struct.unpack_from("<IQI", image, 4)
    at = 20
    doc_ids = np.frombuffer(image, "<i8", n_docs, at)
    counts = np.frombuffer(image, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    start = np.frombuffer(image, "<u4", n_blocks + 1, at).astype(np.int64)
    buf = np.frombuffer(image, np.uint8, offset=at + 4 * (n_blocks + 1))
    if not n_blocks:
        return doc_ids, counts, np.zeros(0, np.uint32)
    first = start[:-1]
    low = buf[first[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, n_out = buf[first + 4].astype(np.int64), buf[first + 5].astype(np.int64)
    d = np.empty((n_blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        rows = np.nonzero(width == w)[0]
        d[rows] = _unpack(buf[(first[rows] + HEAD)[:, None] + np.arange(BLOCK * w // 8)], int(w))
    if n_out.any():
        row = np.repeat(np.arange(n_blocks), n_out)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        body = first[row] + HEAD + BLOCK * width[row] // 8
        col = buf[body + nth]
        high = buf[(body + n_out[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        d[row, col] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return doc_ids, counts, (d + low[:, None]).reshape(-1)[:n_ids]
