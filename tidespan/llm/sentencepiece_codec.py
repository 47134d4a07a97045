"""SentencePiece encoding and decoding on the Tokenizers library.

The model protobuf is read here (wire format, no generated classes); its normaliser, meta-space marker, scores or merges
and byte fallback are rebuilt as a ``tokenizers.Tokenizer``, which encodes batches on several threads.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBERED = 400_000
_APART = re.compile(" +[^ ]*|[^ ]+").findall
PROBES = ("", " ", "  two  spaces ", "Plain words, then more.", "naïve café über straße niño", "tabs\tand\nlines\r\n\n", "日本語 \U0001f600 Жз", "1,234.5 + x_y == {z}", "▁marked▁", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "<s> </s> <unk> <0x41>")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of one protobuf message."""
    i, n = 0, len(data)

    def varint(i: int) -> tuple[int, int]:
        shift = out = 0
        while True:
            b = data[i]
            out |= (b & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if b < 0x80:
                return out, i

    while i < n:
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 1:
            value, i = data[i : i + 8], i + 8
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        elif kind == 5:
            value, i = data[i : i + 4], i + 4
        else:
            raise ValueError(f"not a protobuf message: wire type {kind}")
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type), model type and normaliser settings of a serialised model."""
    pieces, model = [], {"type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "suffix": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True}
    names = {2: {3: "type", 24: "suffix", 35: "byte_fallback", 40: "unk_id"}, 3: {2: "charsmap", 3: "dummy_prefix", 4: "squeeze", 5: "escape"}}
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            pieces.append((piece, score, kind))
        elif number in names:
            for k, v in fields(value):
                if name := names[number].get(k):
                    model[name] = v if isinstance(model[name], bytes) else type(model[name])(v)
    if not pieces:
        raise ValueError("the model has no pieces")
    return model | {"pieces": pieces}


class Codec:
    """``encode``, ``decode`` and ``normalise`` for one model file's bytes."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        m = self.model = parse_model(data)
        if m["type"] not in (UNIGRAM, BPE) or m["suffix"] or not m["escape"]:
            raise ValueError("only unigram and BPE models with an escaped leading marker are supported")
        pieces = m["pieces"]
        if odd := [p for p, _, kind in pieces if kind in (USER, UNUSED)]:
            raise ValueError(f"user-defined and unused pieces are not supported: {odd[:3]}")
        self.unk_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        if m["type"] == UNIGRAM:
            # A control piece is never the reading of a text: here it is named by code points that no text may hold.
            model = models.Unigram([(f"\ufdd0{i}\ufdd1" if kind == CONTROL else p, s) for i, (p, s, kind) in enumerate(pieces)], unk_id=self.unk_id, byte_fallback=m["byte_fallback"])
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
            model = models.BPE(vocab, self._merges(), unk_token=pieces[self.unk_id][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
        self.tokenizer = t = Tokenizer(model)
        steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
        if m["squeeze"]:
            steps += [normalizers.Replace(Regex(f"[ {MARK}]+"), " "), normalizers.Strip()]
        self.plain = normalizers.Sequence(list(steps)) if steps else None
        steps += ([normalizers.Prepend(MARK)] if m["dummy_prefix"] else []) + [normalizers.Replace(" ", MARK)]
        t.normalizer = normalizers.Sequence(steps)
        # Words can be encoded apart (and remembered) if no piece goes on after a letter with a marker.
        self.apart = all(MARK not in p.lstrip(MARK) for p, _, kind in pieces if kind == NORMAL)
        if self.apart:
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        self.words = Tokenizer(model)
        self._seen: dict[str, bytes] = {}
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else []))
        self._bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self._bytes[self.unk_id] = " ⁇ ".encode()

    def _merges(self) -> list[tuple[str, str]]:
        known = {p: (s, i) for i, (p, s, kind) in enumerate(self.model["pieces"]) if kind == NORMAL}
        found = []
        for piece, (score, _) in known.items():
            for k in range(1, len(piece)):
                if (left := known.get(piece[:k])) and (right := known.get(piece[k:])):
                    found.append((-score, left[1], right[1], piece[:k], piece[k:]))
        return [x[3:] for x in sorted(found)]

    def normalise(self, text: str) -> str:
        """The text that decoding gives back."""
        text = self.plain.normalize_str(text) if self.plain else text
        return text.replace(MARK, " ")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, by the tokenizer alone."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The same ids as int32 arrays.  Where words can be encoded apart, each different word of the batch is encoded
        once, in one multithreaded call, and remembered for later batches (about ``REMEMBERED`` words at most, until ``forget``)."""
        if not self.apart:
            return [np.asarray(x, np.int32) for x in self.encode(texts)]
        prefix = " " if self.model["dummy_prefix"] else ""
        if self.plain:
            texts = [self.plain.normalize_str(t) for t in texts]
        split = [_APART((prefix + t).replace(MARK, " ")) if t else () for t in texts]
        if len(self._seen) > REMEMBERED:
            self._seen.clear()
        seen = self._seen
        new = list(set().union(*split).difference(seen))
        for word, x in zip(new, self.words.encode_batch_fast([w.replace(" ", MARK) for w in new], add_special_tokens=False)):
            seen[word] = np.asarray(x.ids, np.int32).tobytes()
        return [np.frombuffer(b"".join(map(seen.__getitem__, x)), np.int32) for x in split]

    def forget(self) -> None:
        self._seen.clear()

    def decode(self, ids) -> str:
        """The text of ids; the same as the tokenizer's own decoder, by one join of the pieces' bytes."""
        raw = b"".join(map(self._bytes.__getitem__, ids))
        return (raw[1:] if self.model["dummy_prefix"] and raw[:1] == b" " else raw).decode(errors="replace")


@functools.lru_cache(2)
def codec(path: str, threads: int = 2) -> Codec:
    """One codec per worker process and file."""
    with open(path, "rb") as f:
        return Codec(f.read(), threads)


def parity(path: str, texts=PROBES) -> list[str]:
    """The texts whose ids differ from those of the sentencepiece library (if it is installed)."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = list(texts)
    c = codec(path)
    return [t for t, a, x, b in zip(texts, c.encode(texts), c.encode_arrays(texts), other.encode(texts)) if a != b or x.tolist() != b]


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "token_ids", check: str | None = None, threads: int = 2) -> DataFrame:
    """Add ``out`` array<int>, the ids of ``text``; with ``check``, also whether decoding them gives the text back.

    Each batch of rows is encoded by one multithreaded call in the Python worker.  A null text has null ids (and a null
    check); an empty one has an empty array.  An existing column named ``out`` or ``check`` is replaced; all others, rows
    and repeats included, are kept.  ``check`` compares with the normalised text, as normalisation is not undone.
    ``model_path`` must be readable on each executor.
    """
    kept = [c for c in docs.columns if c not in (out, check)]
    df = docs.select(*kept)
    schema = df.select("*", F.lit(None).cast("array<int>").alias(out), *([F.lit(None).cast("boolean").alias(check)] if check else [])).schema

    def run(batches):
        c = codec(model_path, threads)
        for big in batches:
            for i in range(0, big.num_rows, 256):
                batch = big.slice(i, 256)
                texts = batch.column(kept.index(text)).to_pylist()
                ids = c.encode_arrays([t or "" for t in texts])
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
                null = np.array([t is None for t in texts], bool)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                col = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array(null))
                more = [col]
                if check:
                    more.append(pa.array([None if t is None else c.decode(x.tolist()) == c.normalise(t) for t, x in zip(texts, ids)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, out, *([check] if check else [])])
        c.forget()  # the worker goes on to other tasks, which need the memory

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "token_ids", out: str = "decoded", threads: int = 2) -> DataFrame:
    """Add ``out``, the text of ``ids``; null stays null, an empty array gives an empty text."""
    kept = [c for c in df.columns if c != out]
    df = df.select(*kept)
    schema = df.select("*", F.lit(None).cast("string").alias(out)).schema

    def run(batches):
        c = codec(model_path, threads)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
