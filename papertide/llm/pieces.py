"""SentencePiece encoding and decoding by merges (operator 12).

A merge-type vocabulary is applied as its algorithm is defined: an agenda of
adjacent symbol pairs, best score first and leftmost of equal scores, until no
pair is a piece.  Merges never cross certain places, which the vocabulary
itself tells: before a space mark that follows something else, between letters
and others, and around characters that are in no longer piece.  Texts are cut there and each distinct
chunk is merged once per task, those of some hundred texts side by side in
numpy: every chunk's agenda is a row of keys, of which the least is taken.  The sentencepiece library then encodes the same
Arrow batch and every text's ids are compared.  One pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .shared import map_batches, sent, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Code points of a text that are encoded at once, where it has a space to be cut at.
SLICE = 1 << 18
#: Chunks longer than this are not remembered, and so many are at most.
SHORT, REMEMBERED = 64, 400_000
#: So many texts are worked on together.
TOGETHER = 512
IDS = pa.list_(pa.int32())
SPARK_TYPES = {IDS: "array<int>", pa.bool_(): "boolean", pa.string(): "string", pa.int64(): "bigint"}
#: An entry of the agenda is a rank and, in so many bits, the place of its left symbol.
PLACE = 40
LOW = (1 << PLACE) - 1
#: The rank of a pair that is no piece, and how many chunks are merged side by side.
NEVER = (1 << 63 - PLACE) - 1
SIDE_BY_SIDE = 50_000
#: Texts that a normaliser leaves alone, but for space marks, if it is the identity.
PROBES = ("a b", " a  b ", "ﬁ ①", "\ta\n\nb\r", "é \xa0　x", "\x00\x7f")


def _chunks(longer: list[str]) -> str:
    """A pattern of what merges stay inside: space marks and the characters after them that can merge.

    Letters and other characters are apart if no piece has one next to the other.
    """
    joined = sorted({c for p in longer for c in p})
    kinds = [[c for c in joined if c.isalpha()], [c for c in joined if not c.isalpha()]]
    if any(a.isalpha() != b.isalpha() for p in longer for a, b in zip(p, p[1:])):
        kinds = [joined]
    runs = "|".join("[" + "".join(map(re.escape, k)) + "]+" for k in kinds if k)
    return f"{MARK}+(?:{runs})?|{runs}|."


class Pieces(dict):
    """Chunks and their ids; chunks not yet met are merged."""

    def __init__(self, model: bytes):
        super().__init__()
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(lib.vocab_size())
        if [i for i in every if lib.is_unused(i)]:
            raise ValueError("unused pieces are resegmented, which merges alone do not tell")
        plain = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        scores = sorted({lib.get_score(i) for i in plain}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        #: Pieces by the place of their score, best first; equal scores share it.
        self.rank = {lib.id_to_piece(i): place[lib.get_score(i)] for i in plain}
        self.id = {lib.id_to_piece(i): i for i in plain}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(lib.is_byte(i) for i in self.byte)
        self.eos = lib.eos_id()
        longer = [p.replace(MARK, "") for p in self.id if len(p) > 1]
        spaced = any(MARK in p.lstrip(MARK) for p in self.id)
        self.chunk = re.compile(".+" if spaced else _chunks(longer), re.DOTALL)
        self.side_by_side = not spaced
        self._tables(lib.vocab_size())
        #: Whether a text may be cut at a space without a change of what is normalised.
        self.local = not spaced and all(lib.normalize(p) == MARK + p.replace(" ", MARK) for p in PROBES)

    def _tables(self, n: int) -> None:
        """Symbols as numbers: pieces by id, other characters of longer pieces after them; and all pairs that make a piece."""
        number = dict(self.id)
        for c in sorted({c for p in self.id for c in p}):
            number.setdefault(c, n + len(number))
        self.of_point = np.full(0x110000, -1, np.int64)
        for c, k in number.items():
            if len(c) == 1:
                self.of_point[ord(c)] = k
        pairs = [(number[p[:k]] << 32 | number[p[k:]], self.rank[p], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.pair, self.pair_rank, self.pair_into = np.array(sorted(pairs) or [(-1, NEVER, -1)], np.int64).T.copy()

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols, NEVER where they make no piece, and the pieces."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where(self.pair[at] == wanted, self.pair_rank[at], NEVER), self.pair_into[at]

    def learn(self, chunks: Iterable[str]) -> None:
        """Merges chunks that are not known yet, all at once."""
        new = [c for c in set(chunks) if 1 < len(c) <= SHORT and c not in self] if self.side_by_side else []
        if len(self) + len(new) > REMEMBERED:
            self.clear()
        for i in range(0, len(new), SIDE_BY_SIDE):
            part = new[i : i + SIDE_BY_SIDE]
            self.update(zip(part, self.merged_together(part)))

    def merged_together(self, chunks: list[str]) -> Iterator[tuple[int, ...]]:
        """``merged`` of many short chunks, whose characters must all be in pieces; one merge of each in a round."""
        sym = self.of_point[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        rank, into = np.full(len(sym), NEVER), np.full(len(sym), -1)
        rank[:-1], into[:-1] = self._ranked(sym[:-1], sym[1:])
        rank[:-1][owner[1:] != owner[:-1]] = NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank << PLACE | np.arange(len(sym)), first)
            going = least >> PLACE != NEVER
            at = least[going] & LOW
            sym[at] = into[at]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            if not going.all():
                over = np.repeat(~going, np.diff(np.append(first, len(sym))))
                done.append((owner[over], sym[over]))
                left &= ~over
            # a place moves by what goes before it
            at = np.cumsum(left)[at] - 1
            sym, owner, rank, into = sym[left], owner[left], rank[left], into[left]
            if not len(sym):
                break
            rank[at] = NEVER
            for place in (at[at + 1 < len(sym)], at[at > 0] - 1):
                place = place[owner[place] == owner[place + 1]]
                rank[place], into[place] = self._ranked(sym[place], sym[place + 1])
        owner, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        ids, ends = sym[order].tolist(), np.cumsum(np.bincount(owner, minlength=len(chunks))).tolist()
        return (tuple(ids[a:b]) for a, b in zip([0, *ends], ends))

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = tuple(self.merged(chunk))  # tuples of numbers are no work for the collector
        if len(chunk) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def merged(self, chunk: str) -> list[int]:
        """The agenda: pairs by score, then by place; what no longer is the pair at its place is passed over."""
        symbols, rank = list(chunk), self.rank.get
        n = len(symbols)
        # the rank of the pair that begins at each symbol, -1 where it is no piece or the symbol is gone
        pair = [rank(a + b, -1) for a, b in zip(chunk, chunk[1:])]
        pair.append(-1)
        agenda = [r << PLACE | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & LOW
            if pair[i] != entry >> PLACE:
                continue
            j = after[i]
            symbols[i] = piece = symbols[i] + symbols[j]
            symbols[j], pair[j] = "", -1
            nxt = after[i] = after[j]
            r = -1
            if nxt < n:
                before[nxt] = i
                r = rank(piece + symbols[nxt], -1)
                if r >= 0:
                    heapq.heappush(agenda, r << PLACE | i)
            pair[i] = r
            i = before[i]
            if i >= 0:
                pair[i] = r = rank(symbols[i] + piece, -1)
                if r >= 0:
                    heapq.heappush(agenda, r << PLACE | i)
        known = self.id
        out: list[int] = []
        for s in symbols:
            if s in known:
                out.append(known[s])
            elif s:
                out += self.spelled(s)
        return out

    def spelled(self, symbol: str) -> list[int]:
        """Ids of a symbol that is no piece: its bytes, if the vocabulary has them."""
        return [self.byte[b] for b in symbol.encode()] if self.fallback else [self.library.unk_id()]

    def slices(self, text: str, most: int) -> Iterator[str]:
        """The text in parts, cut at spaces that follow something else; the space itself is the next part's prefix."""
        at = 0
        while self.local and len(text) - at > most:
            cut = at + most
            while True:
                cut = text.find(" ", cut)
                if cut < 0 or (cut > at and text[cut - 1] not in (" ", MARK)):
                    break
                cut += 1
            if cut < 0:
                break
            yield text[at:cut]
            at = cut + 1
        yield text[at:]

    def cut(self, part: str, follows: bool) -> list[str]:
        """The chunks of a text or of a part that follows another."""
        if self.local:  # an empty text has no prefix, but a part that is empty had a space before it
            whole = MARK + part.replace(" ", MARK) if part or follows else ""
        else:
            whole = self.library.normalize(part)
        return self.chunk.findall(whole)

    def encode(self, text: str, most: int = SLICE, chunks: list[str] | None = None) -> Iterator[tuple[list[int], bool]]:
        """For each part of the text its ids and whether the library gives the same; the last part has the end id.

        Where they differ, the library's ids stand.  ``chunks`` are those of a
        text of one part, learned before.
        """
        parts = [text] if chunks is not None else list(self.slices(text, most))
        for k, part in enumerate(parts):
            if chunks is None or k:
                chunks = self.cut(part, k > 0)
                self.learn(chunks)
            own = list(chain.from_iterable(map(self.__getitem__, chunks)))
            theirs = self.library.encode(part) if part or not k else own
            if k == len(parts) - 1:
                own, theirs = [*own, self.eos], [*theirs, self.eos]
            yield theirs, own == theirs

    def encode_all(self, texts: list[str]) -> Iterator[Iterator[tuple[list[int], bool]]]:
        """``encode`` of each text; what is new in the shorter ones is learned together."""
        cut = [self.cut(t, False) if len(t) <= SLICE else None for t in texts]
        self.learn(chain.from_iterable(c for c in cut if c))
        return (self.encode(t, chunks=c) for t, c in zip(texts, cut))

def model_bytes(path: str | None = None) -> bytes:
    """The model file, of a bounded size, as the driver reads it; tasks get it by broadcast."""
    return Path(path or public_tokenizers.path(MODEL)).read_bytes()


def _mapped(docs: DataFrame, id_col: str, col: str, model: str | None, outs: dict[str, pa.DataType], rows: Callable[[Pieces, list], Iterator[tuple]]) -> DataFrame:
    flat = docs.select(docs[id_col], docs[col])
    kind = flat.schema[0].dataType.simpleString()
    packed = sent(docs.sparkSession, model_bytes(model))
    held: list[Pieces] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not held:
                held.append(Pieces(packed()))
            for i in range(0, len(batch), TOGETHER):
                part = batch.slice(i, TOGETHER)
                made = zip(*rows(held[0], part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(made, outs.values()))], names=[id_col, *outs])

    schema = ", ".join(f"{name} {SPARK_TYPES[t]}" for name, t in outs.items())
    return map_batches(flat, work, f"`{id_col}` {kind}, {schema}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (end id last) and ``agrees``, whether the library gives the same.

    A null text is taken as empty: the end id alone.  Repeated rows and null
    ids are encoded row by row; other columns may have any names.  Very long
    texts are encoded in parts of some 262,144 code points; a run of
    letters without a space is one part however long, at some 500 bytes a letter.
    """

    def rows(pieces: Pieces, texts: list[str | None]) -> Iterator[tuple]:
        for found in pieces.encode_all([t or "" for t in texts]):
            parts = list(found)
            yield list(chain.from_iterable(ids for ids, _ in parts)), all(ok for _, ok in parts)

    return _mapped(docs, id_col, text_col, model, {"ids": IDS, "agrees": pa.bool_()}, rows)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Id and ``text`` of rows of ids; null ids are an empty text."""
    return _mapped(rows, id_col, ids_col, model, {"text": pa.string()}, lambda p, lists: ((p.library.decode(list(ids or [])),) for ids in lists))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """As ``encode``, then decoded, both as SHA-256: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``agrees``.

    Neither ids nor decoded texts leave the task, and of a long text only a part is held.
    """

    def rows(pieces: Pieces, texts: list[str | None]) -> Iterator[tuple]:
        for parts in pieces.encode_all([t or "" for t in texts]):
            ids_sha, text_sha, n, same = hashlib.sha256(), hashlib.sha256(), 0, True
            for k, (ids, ok) in enumerate(parts):
                # what parts decode to, joined by a space, is what all ids decode to
                ids_sha.update(f"{' ' if k and ids else ''}{' '.join(map(str, ids))}".encode())
                text_sha.update(f"{' ' if k else ''}{pieces.library.decode(ids)}".encode())
                n, same = n + len(ids), same and ok
            yield n, ids_sha.hexdigest(), text_sha.hexdigest(), same

    return _mapped(docs, id_col, text_col, model, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "agrees": pa.bool_()}, rows)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
