"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; the normaliser, the metaspace marker,
the pieces with their scores and byte fallback are rebuilt as a tokenizers
pipeline: a unigram lattice from the scores, or for a BPE model the merges that
the scores imply. Texts are cut before every run of markers where no piece can
reach across, so that what repeats is encoded once per worker; the distinct
chunks of a batch, many to a text, go to the library's multithreaded batch
encoder. Parity with the sentencepiece library is verified on every distinct chunk
when it is first encoded (a chunk that only stands beside a line feed is verified
there), and its ids are taken where the two differ.

Defined results: a null or empty text has no ids and decodes to the empty text;
parity is null where a chunk could not be compared; ids outside the vocabulary raise; repeated rows are encoded each.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batches import held, map_columns

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct chunks a worker remembers before it starts anew; chunks in one text of a batch.
MEMO_CHUNKS, TOGETHER = 1_000_000, 2_000
#: Threads of a worker's batches; more than an executor has cores for each task only wait for one another.
THREADS = 2


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """``(number, wire type, value)`` of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, kind, data[at:at + size]
            at += size


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True
    escape: bool = True

    @staticmethod
    def parse(data: bytes) -> Model:
        m = Model()
        for number, _, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, _, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append((piece, score, kind))
            elif number == 2:
                for n, _, v in fields(value):
                    if n == 3:
                        m.kind = v
                    elif n == 35:
                        m.byte_fallback = bool(v)
                    elif n == 24:
                        m.suffix_mark = bool(v)
            elif number == 3:
                for n, _, v in fields(value):
                    if n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.one_space = bool(v)
                    elif n == 5:
                        m.escape = bool(v)
        return m


def merges(model: Model) -> list[tuple[str, str]]:
    """Merges in the order that a BPE model's scores imply: the best-scored result first."""
    known = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
    rank = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    out = []
    for piece, score, kind in model.pieces:
        if kind != NORMAL or len(piece) < 2:
            continue
        ways = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
        out += [(-score, rank[piece], rank[a], rank[b], a, b) for a, b in ways]
    return [(a, b) for *_, a, b in sorted(out)]


class Bridge:
    """A model file as a tokenizers pipeline, with a memory of chunks."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library first runs a batch
        import sentencepiece
        from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers

        with open(path, "rb") as f:
            self.model = m = Model.parse(f.read())
        if m.suffix_mark or not m.escape:
            raise ValueError("models that mark word ends or leave spaces alone are not supported")
        unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
        name = m.pieces[unknown][0] if unknown is not None else None
        if m.kind == UNIGRAM:
            usable = [(p, s if kind in (NORMAL, USER) else -1e6) for p, s, kind in m.pieces]
            core = models.Unigram(usable, unknown, byte_fallback=m.byte_fallback)
        elif m.kind == BPE:
            core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=merges(m), unk_token=name,
                              fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are supported")
        self.normal = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.tok = Tokenizer(core)
        self.words = Tokenizer(core)  # for many one-marker chunks in one text
        self.words.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.opens = np.asarray([p.startswith(MARK) for p, *_ in m.pieces])
        steps = [decoders.ByteFallback()] if m.byte_fallback else []
        self.tok.decoder = decoders.Sequence([*steps, decoders.Fuse()])
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.silent = {i for i, p in enumerate(m.pieces) if p[2] == CONTROL}
        # a chunk ends before a marker unless some piece holds a marker after another character
        self.across = any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER))
        self.user = any(kind == USER for _, _, kind in m.pieces)
        # so it does around a line feed that only bytes can spell
        self.lines = m.byte_fallback and not any("\n" in p for p, *_ in m.pieces)
        self.seen: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.unheld: set[str] = set()

    def normalised(self, text: str) -> str:
        """The text as pieces see it: mapped characters, spaces as markers, one marker in front."""
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        if self.model.one_space:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (" " + text if self.model.dummy_prefix else text).replace(" ", MARK)

    def chunks(self, text: str) -> list[str]:
        if self.across or self.user:
            return [text]
        if MARK + MARK in text or "\0" in text:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)
        text = text.replace(MARK, "\0" + MARK)
        return (text.replace("\n", "\0\n\0") if self.lines else text).split("\0")

    def learn(self, wanted: set[str]) -> None:
        """Encode the chunks that are new, and hold each against the sentencepiece library."""
        if len(self.seen) + len(wanted) > MEMO_CHUNKS:
            self.seen.clear()
            self.differ.clear()
            self.unheld.clear()
        self.seen[""] = b""
        new = [c for c in wanted if c not in self.seen]
        one = [c for c in new if c[0] == MARK and len(c) > 1 and MARK not in c[1:]] if not (self.across or self.user) else []
        self._together([one[a:a + TOGETHER] for a in range(0, len(one), TOGETHER)])
        self._apart([c for c in new if c not in self.seen])

    def _plain(self, chunk: str) -> str:
        """The text that normalising turns into ``chunk``, with spaces for markers where it keeps them, if any text does."""
        bare = chunk[1:] if self.model.dummy_prefix and chunk.startswith(MARK) else chunk
        spaced = bare.replace(MARK, " ")
        return spaced if spaced == bare or self.normalised(spaced) == chunk else bare

    def _together(self, groups: list[list[str]]) -> None:
        """Encode groups of chunks that each open with their only marker, a group as one text of a batch, where that gives one opening piece for each."""
        texts = ["".join(g) for g in groups]
        plain = [self._plain(t) for t in texts]
        told = self.reference.encode(plain, num_threads=THREADS) if plain else []
        for chunks, text, p, e, r in zip(groups, texts, plain, self.words.encode_batch_fast(texts, add_special_tokens=False), told, strict=True):
            if e.ids != r or self.normalised(p) != text:
                continue  # taken apart, to find the chunks that differ
            flat = np.asarray(r, dtype="<u4")
            cuts = (4 * np.flatnonzero(self.opens[flat])).tolist()
            if len(cuts) == len(chunks) and cuts[0] == 0:
                data = flat.tobytes()
                self.seen.update(zip(chunks, (data[i:j] for i, j in zip(cuts, [*cuts[1:], len(data)], strict=True)), strict=True))

    def _apart(self, new: list[str]) -> None:
        """Encode chunks one by one; the library sees each as a text or, where it would change that text, between line feeds."""
        got = self.tok.encode_batch_fast(new, add_special_tokens=False)
        plain = [self._plain(c) for c in new]
        told = self.reference.encode(plain, num_threads=THREADS) if new else []
        for c, p, e, r in zip(new, plain, got, told, strict=True):
            ids, right = e.ids, r if self.normalised(p) == c else self._between_lines(c)
            if right is None:
                self.unheld.add(c)
            elif ids != right:
                self.differ.add(c)
                ids = right
            self.seen[c] = np.asarray(ids, dtype="<u4").tobytes()

    def _between_lines(self, chunk: str) -> list[int] | None:
        """The library's ids of a chunk between two line feeds that no piece reaches across; None if it cannot be shown so."""
        text = "x\n" + chunk.replace(MARK, " ") + "\nx"
        if not self.lines or self.normalised(text) != self.normalised("x\n") + chunk + "\nx":
            return None
        head, both, whole = (self.reference.encode(t) for t in ("x\n", "x\n\nx", text))
        tail = both[len(head):]
        return whole[len(head):len(whole) - len(tail)] if whole[:len(head)] == head and whole[len(whole) - len(tail):] == tail else None

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, bool | None]]:
        """Little-endian unsigned 32-bit ids of each text, and whether every chunk had parity: None if some chunk could not be compared."""
        cut = [self.chunks(self.normalised(t)) if t else [] for t in texts]
        self.learn(set().union(*cut))
        held = lambda c: False if self.differ and not self.differ.isdisjoint(c) else None if self.unheld and not self.unheld.isdisjoint(c) else True
        return [(b"".join(map(self.seen.__getitem__, c)), held(c)) for c in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become spaces, the one in front goes, control ids are silent."""
        ids = [i for i in ids if i not in self.silent]
        if ids and not 0 <= min(ids) <= max(ids) < len(self.model.pieces):
            raise ValueError("an id is outside the vocabulary")
        return self.opened(self.tok.decode(ids, skip_special_tokens=False))

    def opened(self, text: str) -> str:
        """Markers as spaces, without those that normalising puts or leaves none of in front."""
        text = text.replace(MARK, " ")
        if self.model.one_space:
            return text.lstrip(" ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decode_all(self, many: list[list[int]]) -> list[str]:
        for ids in many:
            if ids and not 0 <= min(ids) <= max(ids) < len(self.model.pieces):
                raise ValueError("an id is outside the vocabulary")
        texts = self.tok.decode_batch([[i for i in ids if i not in self.silent] for ids in many], skip_special_tokens=False)
        return [self.opened(t) for t in texts]


def bridge(path: str) -> Bridge:
    return held("pieces " + path, lambda: Bridge(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, parity`` of every row."""

    def run(doc_id: list, text: list) -> dict:
        got = bridge(path).encode_all(text)
        return {"doc_id": doc_id, "ids": [np.frombuffer(b, dtype="<u4").astype(np.int32) for b, _ in got], "parity": [p for _, p in got]}

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, ids array<int>, parity boolean", run)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``(doc_id, ids)`` rows."""

    def run(doc_id: list, ids: list) -> dict:
        return {"doc_id": doc_id, "text": bridge(path).decode_all([i or [] for i in ids])}

    return map_columns(encoded.select(F.col("doc_id").cast("long"), "ids"), "doc_id long, text string", run)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_crc32, parity, restored`` (its ids decode to the text as the model normalises it)."""

    def run(doc_id: list, text: list) -> dict:
        b = bridge(path)
        got = b.encode_all(text)
        back = b.decode_all([np.frombuffer(data, dtype="<u4").tolist() for data, _ in got])
        shown = [b.opened(b.normalised(t)) if t else "" for t in text]
        return {"doc_id": doc_id, "n_tokens": [len(d) // 4 for d, _ in got], "ids_crc32": [zlib.crc32(d) for d, _ in got],
                "parity": [p for _, p in got], "restored": [x == s for x, s in zip(back, shown, strict=True)]}

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"),
                       "doc_id long, n_tokens long, ids_crc32 long, parity boolean, restored boolean", run)
