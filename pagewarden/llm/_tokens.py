"""Byte-level BPE ids of whole texts, by the tokenizers library, with repeated words encoded once.

The pre-tokenizer of byte-level vocabularies never joins a non-space character with white space after
it, nor an ASCII letter with punctuation after it, and looks at nothing before a token. So a text may
be cut at such places and its pieces encoded apart: the ids of the text are those of its pieces, one
after the other. Pieces repeat (a word with the space before it), so each distinct one is encoded once
per worker and the rest is array work. Cuts are made only before ASCII white space that follows
something that is surely not white space, and before ASCII punctuation that follows an ASCII letter
(but for characters that stand so inside an added token); elsewhere pieces just stay longer.

A vocabulary file with another pre-tokenizer, a normaliser or stripping added tokens is seen when it is
loaded: then whole texts are encoded one by one.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from pagewarden.llm._text import flat, same_spans, word_hashes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lead bytes of white space beyond ASCII: U+0085, U+00A0; U+1680; U+2000-U+205F; U+3000.
_LEADS = np.array([0xC2, 0xE1, 0xE2, 0xE3], dtype=np.uint8)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
#: Pieces encoded as one text, and put before those that do not begin with white space.
_RUN, _BEFORE = 2000, b"\n"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cuttable(spec: dict) -> bool:
    """Whether a tokenizer file has the rules that the cuts rely on."""
    before = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and (spec.get("model") or {}).get("type") == "BPE"
        and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
        and not any(_SPACE[b] for t in added for b in t["content"].encode())
    )


class Encoder:
    """encode(strings) -> (ids, ends): all ids in a row, and where each row's begin.

    keep: pieces remembered from one call to the next; beyond that, only the pieces of the current call
    stay. A remembered piece is found by its hash and told by its bytes.
    """

    def __init__(self, path: str, keep: int = 2_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        with open(path, encoding="utf-8") as f:
            self.cuttable = _cuttable(json.load(f))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: Bytes that each id stands for; a byte is one character in this vocabulary.
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(added[i]) if i in added else len(token)
        self.mark = _MARK.copy()
        for content in added.values():
            for a, b in zip(content, content[1:]):
                self.mark[b] &= not _LETTER[a]
        self.kind = np.uint16 if len(self.width) <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        #: Of known pieces: hashes in ascending order with the piece of each, bytes, and ids.
        self.hashes, self.code = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.bytes, self.begin = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        self.ids, self.at = np.zeros(0, dtype=self.kind), np.zeros(1, dtype=np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n): ids of each piece on its own."""
        got = self.plain([p.decode() for p in pieces])
        return np.concatenate([*got, np.zeros(0, dtype=np.uint32)]).astype(self.kind), np.array([len(g) for g in got], dtype=np.int64)

    def together(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n): pieces that end in something that is not white space are encoded in long runs, and cut by their bytes."""
        first, last = data[begin[:-1]], data[begin[1:] - 1]
        alone = _SPACE[last] | (last >= 0x80)
        if alone.any():  # white space beyond ASCII ends in such a byte too; few pieces do
            ends = begin[1:]
            alone &= _SPACE[last] | (data[np.maximum(ends - 2, 0)] == 0xC2) | np.isin(data[np.maximum(ends - 3, 0)], _LEADS[1:])
        n = np.zeros(len(first), dtype=np.int64)
        runs, texts = [], []
        rest = np.flatnonzero(~alone)
        raw = data.tobytes()
        begins = begin.tolist()
        bare = _SPACE[first].tolist()
        for lo in range(0, len(rest), _RUN):
            run = rest[lo : lo + _RUN]
            runs.append(run)
            texts.append(b"".join(raw[begins[i] : begins[i + 1]] if bare[i] else _BEFORE + raw[begins[i] : begins[i + 1]] for i in run.tolist()).decode())
        pools: list[tuple[np.ndarray, np.ndarray]] = []
        singles = np.flatnonzero(alone).tolist()
        for run, ids in zip(runs, self.plain(texts)):
            ends = np.cumsum(self.width[ids])
            extra = ~_SPACE[first[run]]
            want = np.cumsum(begin[run + 1] - begin[run] + extra)
            cut = np.searchsorted(ends, want)
            start = np.concatenate([[0], cut[:-1] + 1]) + extra
            ok = cut[-1] == len(ids) - 1 and (ends[cut] == want).all() and (ends[start[extra] - 1] == want[extra] - (begin[run + 1] - begin[run])[extra]).all()
            if not ok:  # not this vocabulary's rule
                singles += run.tolist()
                continue
            size = cut + 1 - start
            n[run] = size
            keep = np.ones(len(ids), dtype=bool)
            keep[start[extra] - 1] = False
            pools.append((run, ids[keep].astype(self.kind)))
        if singles:
            ids, sizes = self.apart([raw[begins[i] : begins[i + 1]] for i in singles])
            n[singles] = sizes
            pools.append((np.array(singles), ids))
        at = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), dtype=self.kind)
        for which, ids in pools:
            own = n[which]
            out[np.repeat(at[which] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return out, n

    def known(self, data: np.ndarray, begin: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The remembered piece of each, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        code = np.where(self.hashes[at] == hashes, self.code[at], -1).astype(np.int64)
        met = np.flatnonzero(code >= 0)
        same = same_spans(data, begin[:-1][met], begin[1:][met], self.bytes, self.begin[code[met]], self.begin[code[met] + 1])
        code[met[~same]] = -1
        return code

    def learn(self, data: np.ndarray, begin: np.ndarray, hashes: np.ndarray) -> None:
        ids, n = self.together(data, begin)
        new = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(n), dtype=np.int32)
        self.begin = np.concatenate([self.begin, self.begin[-1] + begin[1:]])
        self.bytes = np.concatenate([self.bytes, data])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(hashes, kind="stable")
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.code = np.insert(self.hashes, place, hashes[order]), np.insert(self.code, place, new[order])

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuttable:
            got = self.plain(strings.to_pylist())
            return np.concatenate([*got, np.zeros(0, dtype=np.uint32)]), np.concatenate([[0], np.cumsum([len(g) for g in got], dtype=np.int64)])
        data, ends = flat(strings)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(ends), dtype=np.int64)
        space = _SPACE[data]
        cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        two, three = np.maximum(cut - 2, 0), np.maximum(cut - 3, 0)
        odd = (data[two] == 0xC2) | (np.isin(data[three], _LEADS[1:]) & (data[cut - 1] >= 0x80))
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[1:-1] = self.mark[data[1:]] & _LETTER[data[:-1]]
        begins[ends[:-1]] = True
        begins[cut[~odd]] = True
        start = np.flatnonzero(begins[:-1])
        bounds = np.append(start, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        own, own_begin = flat(pieces.dictionary)
        hashes = word_hashes(own, own_begin[:-1], own_begin[1:])
        if len(self.hashes) > self.keep:
            self.forget()
        code = self.known(own, own_begin, hashes)
        if len(missing := np.flatnonzero(code < 0)):
            base = len(self.begin) - 1
            new, new_begin = flat(pieces.dictionary.take(pa.array(missing)))
            self.learn(new, new_begin, hashes[missing])
            code[missing] = base + np.arange(len(missing))
        code = code.astype(np.int32)[pieces.indices.to_numpy()]
        n = np.diff(self.at).astype(np.int32)[code]
        before = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        source = np.repeat(self.at[code] - before[:-1], n)
        source += np.arange(before[-1])
        return self.ids[source].astype(np.uint32), before[np.searchsorted(start, ends)]


#: Bytes of text encoded at once: a worker holds about thirty times that in arrays.
UNIT_BYTES = 8 << 20

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
