"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text's symbols lie in flat numpy arrays, word after word. In every round each
word takes the lowest pair rank it holds (segmented minimum) and merges it where
it stands, leftmost first, all words at once; merged symbols are compacted and
words without a mergeable pair leave, until none remains. No library call
encodes or decodes: the model file is only read for its pieces and scores.

Words: no piece holds a space mark after another character, nor a character
outside the vocabulary, so texts are cut there first and every distinct word is
merged once a batch. Merging all places of a pair in one round equals the
library's one-by-one order only if no merge can enable a better pair; pieces for
which it can (found when the model is loaded) merge only at their leftmost place.

Defined results: null and empty texts give no ids and the empty text; rows are
handled one by one, so repeated rows and any other columns come back unchanged.
Byte pieces that are not valid UTF-8 decode to U+FFFD each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rulemark.llm.frames import fresh
from rulemark.llm.textbatch import pieces as chunks

SPACE = "▁"
#: Words remembered between batches of a worker before it starts afresh.
REMEMBERED = 300_000
NONE = np.int32(2**31 - 1)
#: A word longer than this is cut further where no piece spans the place.
LONG_WORD = 48
UNKNOWN = " ⁇ "


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the runs ``index`` of a ragged array; returns (values, offsets)."""
    sizes = offsets[index + 1] - offsets[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return flat[np.repeat(offsets[index] - out[:-1], sizes) + np.arange(out[-1])], out


def ragged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


class PieceModel:
    """The tables of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = m.vocab_size()
        texts = [m.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([m.is_byte(i) for i in range(n)])
        self.is_control = np.array([m.is_control(i) for i in range(n)])
        plain = [i for i in range(n) if not (self.is_byte[i] or self.is_control[i] or m.is_unknown(i))]
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.is_byte):
            self.byte_id[int(texts[i][3:-1], 16)] = i
        ids = {texts[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece holds a space mark after another character")
        # Symbols: pieces by id, then characters that only occur within pieces.
        chars = sorted({c for p in ids for c in p})
        symbol = dict(ids)
        for c in chars:
            symbol.setdefault(c, n + len(symbol))
        self.width = n + len(symbol) + 1
        self.code = np.array([ord(c) for c in chars], np.int32)
        self.code_symbol = np.array([symbol[c] for c in chars], np.int32)
        self.bigrams = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
        scores = {p: m.get_score(i) for p, i in ids.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.full(self.width, NONE, np.int32)
        ties = np.zeros(len(order) + 1, np.int32)
        for p, i in ids.items():
            self.rank[i] = order[scores[p]]
            ties[order[scores[p]]] += len(p) > 1
        keys, merged, single = [], [], np.zeros(self.width, bool)
        for p, i in ids.items():
            single[i] |= ties[self.rank[i]] > 1
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    merged.append(i)
                    for part in (a, b):
                        if self.rank[i] <= self.rank[part]:
                            single[part] = True
        self.single = single
        self._table(np.array(keys, np.int64), np.array(merged, np.int32))
        # Separate small words: control characters of plain text that no piece holds.
        lone = "".join(c for c in "\n\t\r" if c not in set(chars))
        self.words = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + (f"|[{lone}]" if lone else ""))
        self.decimal = ragged([b"%d," % i for i in range(n)])
        surface = [b""] * n
        for i in range(n):
            if self.is_byte[i]:
                surface[i] = bytes([int(texts[i][3:-1], 16)])
            elif not self.is_control[i]:
                surface[i] = (UNKNOWN if m.is_unknown(i) else texts[i].replace(SPACE, " ")).encode()
        self.surface = ragged(surface)
        self.marked = np.zeros(n, bool)
        self.marked[[i for i in plain if texts[i].startswith(SPACE)]] = True
        self.forget()

    def _table(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Hash table of the pairs with linear probing, at most one slot in eight used."""
        self.shift = np.uint64(64 - max(4, int(len(keys) * 8).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(slots, -2, np.int64), np.full(slots, -1, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] == -2
            first = np.unique(at[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], merged[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) % slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair(self, keys: np.ndarray) -> np.ndarray:
        """The merged piece of each pair key, -1 if there is none."""
        out, todo, at = np.full(len(keys), -1, np.int32), np.flatnonzero(keys >= 0), None
        at = self._slot(keys[todo])
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            rest = ~hit & (there != -2)
            todo, at = todo[rest], (at[rest] + 1) % len(self.keys)
        return out

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        """Words that no merge can span, in order."""
        if not text:
            return []
        found = self.words.findall(SPACE + text.replace(" ", SPACE))
        if max(map(len, found)) <= LONG_WORD:
            return found
        out = []
        for w in found:
            if len(w) <= LONG_WORD:
                out.append(w)
                continue
            at = 0
            for k in range(1, len(w)):
                if w[k - 1 : k + 1] not in self.bigrams:
                    out.append(w[at:k])
                    at = k
            out.append(w[at:])
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the words by merge rounds."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        sizes = np.array([len(w) for w in words], np.int64)
        at = np.minimum(np.searchsorted(self.code, points), len(self.code) - 1)
        # A character of no piece is a symbol of its own, below zero, that never merges.
        sym = np.where(self.code[at] == points, self.code_symbol[at], -1 - points).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(sym))
        done_sym, done_word, done_place = [], [], []
        while len(sym):
            keys = np.where((sym[:-1] >= 0) & (sym[1:] >= 0) & (word[:-1] == word[1:]), sym[:-1] * self.width + sym[1:], -1)
            target = np.append(self.pair(keys), np.int32(-1))
            rank = np.where(target >= 0, self.rank[target], NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            spans = np.diff(np.append(first, len(word)))
            low = np.repeat(np.minimum.reduceat(rank, first), spans)
            open_ = low < NONE
            take = open_ & (rank == low)
            # Places of one run overlap one another: every second one merges, from the left.
            runs = np.flatnonzero(take & ~np.append(False, take[:-1] & (word[1:] == word[:-1])))
            place_in = np.flatnonzero(take)
            take[place_in] = (place_in - runs[np.searchsorted(runs, place_in, "right") - 1]) % 2 == 0
            # Pieces that can enable a better pair merge at the word's leftmost place only.
            once = np.flatnonzero(take & self.single[target])
            if len(once):
                later = np.append(False, word[once][1:] == word[once][:-1])
                take[once[later]] = False
            at = np.flatnonzero(take)
            sym[at] = target[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            shut = keep & ~open_
            done_sym.append(sym[shut]), done_word.append(word[shut]), done_place.append(place[shut])
            keep &= open_
            sym, word, place = sym[keep], word[keep], place[keep]
        none = np.zeros(0, np.int64)
        sym, word, place = (np.concatenate(x or [none]) for x in (done_sym, done_word, done_place))
        order = np.argsort(place, kind="stable")
        return self._with_bytes(sym[order], word[order], len(words))

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary become the byte pieces of their characters."""
        odd = (sym < 0) | (sym >= self.size)
        counts = np.bincount(word, minlength=n).astype(np.int64)
        if odd.any():
            out, where = [], np.flatnonzero(odd)
            names = dict(zip(self.code_symbol.tolist(), self.code.tolist(), strict=True))
            at = 0
            for k in where.tolist():
                s = int(sym[k])
                raw = chr(-1 - s if s < 0 else names[s]).encode()
                out += [sym[at:k], self.byte_id[list(raw)]]
                counts[word[k]] += len(raw) - 1
                at = k + 1
            sym = np.concatenate([*out, sym[at:]])
        return sym.astype(np.int32), np.append(0, np.cumsum(counts))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of whole texts."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = [self.split(t or "") for t in texts]
        new = list(dict.fromkeys(filterfalse(self.known.__contains__, chain.from_iterable(split))))
        if new:
            ids, offsets = self.merge(new)
            base = len(self.known)
            self.known.update((w, base + k) for k, w in enumerate(new))
            self.flat, self.offsets = np.append(self.flat, ids), np.append(self.offsets, offsets[1:] + self.offsets[-1])
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        ids, by_word = gather(self.flat, self.offsets, index)
        return ids, by_word[np.append(0, np.cumsum([len(ws) for ws in split], dtype=np.int64))]

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The ids of each text in decimal, joined by commas."""
        flat, by = gather(*self.decimal, ids)
        raw, ends = flat.tobytes(), by[offsets].tolist()
        return [raw[a : max(a, b - 1)].decode() for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        flat, by = gather(*self.surface, ids)
        raw, ends = flat.tobytes(), by[offsets].tolist()
        # The mark that encoding puts first goes: the first piece's, but for controls.
        spoken = np.append(np.flatnonzero(~self.is_control[ids]), len(ids))
        first = spoken[np.searchsorted(spoken, offsets[:-1])]
        strip = [f < e and bool(self.marked[ids[f]]) for f, e in zip(first.tolist(), offsets[1:].tolist(), strict=True)]
        out = []
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            part = raw[a + strip[k] : b]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self._repaired(ids[offsets[k] : offsets[k + 1]])[strip[k] :])
        return out

    def _repaired(self, ids: np.ndarray) -> str:
        """As decode, with every byte piece that is part of no valid character replaced."""
        flat, at = self.surface
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += bytes(flat[at[i] : at[i + 1]])
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[:k].decode())
                        run = run[k:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    run = run[1:]
            if i >= 0:
                out.append(bytes(flat[at[i] : at[i + 1]]).decode())
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, loaded once a worker."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str | None = "ids", decimals: str | None = None, decoded: str | None = None, n_tokens: str | None = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) and, where named, the results.

    ids: array<int>; decimals: the ids in decimal joined by commas; decoded: the
    text that the ids decode to; n_tokens: long. Names that docs has already get
    underscores in front.
    """
    keep = docs.columns if keep is None else keep
    source = docs.select(*dict.fromkeys([*keep, text]))
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decimals": T.StringType(), "decoded": T.StringType()}
    wanted = {k: v for k, v in {"n_tokens": n_tokens, "ids": ids, "decimals": decimals, "decoded": decoded}.items() if v}
    names = dict(zip(wanted, fresh(docs, *wanted.values()), strict=True))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(v, kinds[k]) for k, v in names.items()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in chunks(batch, text):
                got, offsets = m.encode(part.column(text).cast(pa.string()).to_pylist())
                made = {
                    "n_tokens": lambda: pa.array(np.diff(offsets), pa.int64()),  # noqa: B023
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(got, pa.int32())),  # noqa: B023
                    "decimals": lambda: pa.array(m.decimals(got, offsets), pa.string()),  # noqa: B023
                    "decoded": lambda: pa.array(m.decode(got, offsets), pa.string()),  # noqa: B023
                }
                columns = [part.column(c) for c in keep] + [made[k]() for k in names]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names.values()])

    return source.mapInArrow(work, schema)


def decode_documents(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text that each row's ids (array<int>) decode to; null ids give null."""
    (out,) = fresh(rows, out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            sizes = [len(x or ()) for x in lists]
            flat = np.fromiter((i for x in lists for i in x or ()), np.int64, sum(sizes))
            texts = m.decode(flat, np.append(0, np.cumsum(sizes, dtype=np.int64)))
            texts = [None if x is None else t for x, t in zip(lists, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(work, schema)
