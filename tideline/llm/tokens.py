"""Token ids of whole texts by a public tokenizer, each distinct piece of text encoded once.

A byte-level BPE with the usual splitting pattern cuts a text before any space that a visible
character follows, between letters and ASCII marks, and around a single line feed. Ids of a text
are the ids of its pieces between such places, one after another. Pieces repeat a lot: distinct
ones are found by hash, and only those that this process has not met go to the tokenizer.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np

from tideline.llm.text import Chunk, _mask

#: Pieces of text that a worker remembers, some 30 bytes each and as much again while they grow.
MAX_KNOWN = 500_000
CHUNK = 1 << 20
_ASCII_LETTER = _mask((65, 90), (97, 122))
_MARK = _mask((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))  # no apostrophe
_SHOWN = _mask((0x21, 0x7E))
#: Bytes that surely start a visible character: printable ASCII and lead bytes under which
#: Unicode has no white space.
_VISIBLE = _mask((0x21, 0x7E), (0xC3, 0xDF), (0xE4, 0xF4))


def _state(vocabulary: str) -> types.SimpleNamespace:
    """The tokenizer of a vocabulary file's content, and its known pieces. They outlive a task:
    functions of this module travel by value, so what is to stay is held by the process."""
    held = sys.modules.setdefault("_tideline_tokens", types.ModuleType("_tideline_tokens"))
    state = getattr(held, "state", None)
    if state is None or state.vocabulary != vocabulary:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(vocabulary)
        special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        width = np.zeros(tok.get_vocab_size(with_added_tokens=True), np.int64)
        for piece, i in tok.get_vocab(with_added_tokens=True).items():
            width[i] = len(piece.encode()) if piece in special else len(piece)  # a character is a byte
        state = types.SimpleNamespace(vocabulary=vocabulary, tok=tok, width=width, special=[s.encode() for s in special])
        _forget(state)
        held.state = state
    return state


def _forget(state) -> None:
    none = np.zeros(0, np.int64)
    state.keys, state.start, state.size, state.ids = np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint16)


def _encode_pieces(state, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids of each piece). Pieces that start with a space are encoded joined,
    and parted by the widths of their ids."""
    spaced = np.array([p[:1] == b" " for p in pieces], bool)
    parts: list[np.ndarray] = []
    size = np.zeros(len(pieces), np.int64)
    order = np.concatenate((np.flatnonzero(spaced), np.flatnonzero(~spaced)))
    joined = [pieces[i] for i in np.flatnonzero(spaced)]
    groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
    at = 0
    for group, e in zip(groups, state.tok.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)):
        ids = np.array(e.ids, np.int64)
        ends = np.searchsorted(np.cumsum(state.width[ids]), np.cumsum([len(p) for p in group])) + 1
        size[order[at : at + len(group)]] = np.diff(np.concatenate(([0], ends)))
        parts.append(ids)
        at += len(group)
    alone = [pieces[i].decode() for i in np.flatnonzero(~spaced)]
    for k, e in enumerate(state.tok.encode_batch_fast(alone, add_special_tokens=False)):
        parts.append(np.array(e.ids, np.int64))
        size[order[at + k]] = len(e.ids)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    begin = np.zeros(len(pieces), np.int64)
    begin[order] = np.concatenate(([0], np.cumsum(size[order])[:-1]))
    return flat, np.stack((begin, size))


def _cuts(raw: np.ndarray, off: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Starts of pieces."""
    n = len(raw)
    cut = np.zeros(n, bool)
    here, after = raw[:-1], raw[1:]
    cut[:-1] = (here == 0x20) & _VISIBLE[after]
    data = raw.tobytes()
    if not any(s in data for s in special):
        letter = _ASCII_LETTER[raw]
        # Two-byte letters under lead byte C3, which has two signs among its letters.
        letter[1:] |= (here == 0xC3) & (after != 0x97) & (after != 0xB7)
        mark = _MARK[raw]
        cut[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & _ASCII_LETTER[after])
        feed = (after == 10) & _SHOWN[here]  # a line feed after a visible character
        cut[1:] |= feed
        cut[2:] |= feed[:-1] & _VISIBLE[raw[2:]]
    full = off[:-1] < off[1:]
    # A cut that looks ahead is void where the next row begins; a cut that looks back is remade.
    last = off[1:][full] - 1
    cut[last[raw[last] == 0x20]] = False
    cut[off[:-1][full]] = True
    return np.flatnonzero(cut)


def encode(chunk: Chunk, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows end to end, row borders)."""
    state = _state(vocabulary)
    raw, off = chunk.raw, chunk.off
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    start = _cuts(raw, off, state.special)
    end = np.append(start[1:], len(raw))
    h = chunk.span_hash(chunk.prefix_hash(raw), start, end)
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    if len(state.keys) > MAX_KNOWN:
        _forget(state)
    at = np.minimum(np.searchsorted(state.keys, u), max(0, len(state.keys) - 1))
    fresh = np.flatnonzero(state.keys[at] != u) if len(state.keys) else np.arange(len(u))
    if len(fresh):
        data = raw.tobytes()
        flat, where = _encode_pieces(state, [data[start[i] : end[i]] for i in first[fresh]])
        keys = np.concatenate((state.keys, u[fresh]))
        order = np.argsort(keys, kind="stable")
        state.start = np.concatenate((state.start, where[0] + len(state.ids)))[order]
        state.size = np.concatenate((state.size, where[1]))[order]
        state.ids = np.concatenate((state.ids, flat.astype(np.uint16 if len(state.width) <= 1 << 16 else np.uint32)))
        state.keys = keys[order]
        at = np.searchsorted(state.keys, u)
    size, begin = state.size[at][inverse], state.start[at][inverse]
    border = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(begin - border[:-1], size) + np.arange(border[-1])
    return state.ids[take], border[np.searchsorted(start, off)]


def largest_id(vocabulary: str) -> int:
    return len(_state(vocabulary).width) - 1
