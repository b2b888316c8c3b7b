"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs.

Two characters that stand side by side in no piece of the vocabulary never
merge, so a text is cut between them.  A span is encoded once per worker by the
agenda and kept in a bounded cache (see spans.py); every new span is checked
against the sentencepiece library before it is used, a batch at a time.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.shared import give_back
from noticeflow.llm.spans import SpanIds, encoded

MARK = "▁"
#: New spans that the library checks in one text.
TOGETHER = 100


class PieceEncoder:
    """Encodes by the agenda; the library gives the vocabulary, the check and decode()."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib, size = self.library, self.library.get_piece_size()
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}
        byte = {i for i in range(size) if lib.is_byte(i)}
        self.ids = {lib.id_to_piece(i): i for i in range(size) if i not in special and i not in byte}
        self.scores = {lib.id_to_piece(i): lib.get_score(i) for i in range(size) if i not in special and i not in byte}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece has a space mark after another character: texts can't be cut into spans")
        if lib.normalize(" a éé ") != f"{MARK}{MARK}a{MARK}éé{MARK}":
            raise ValueError("only identity normalisation with a leading space mark is supported")
        self.bytes = [lib.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.begin, self.end, self.line = lib.bos_id(), lib.eos_id(), self.bytes[10]
        if self.bytes[0] == lib.unk_id() or any("\n" in piece for piece in self.ids):
            raise ValueError("only vocabularies with byte fallback, and without line feeds in their pieces, are supported")
        self.apart = np.ones((128, 128), bool)  # characters that stand side by side in no piece
        for piece in self.ids:
            plain = piece.replace(MARK, " ")
            for x, y in zip(plain, plain[1:]):
                if x < "\x80" and y < "\x80":
                    self.apart[ord(x), ord(y)] = False
        self.kept = SpanIds(self._encode)

    def prepared(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with a space before each text that isn't empty, as the library has it."""
        full = at[:-1] < at[1:]
        return np.insert(raw, at[:-1][full], 32), at + np.concatenate([[0], np.cumsum(full)])

    def spans(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of spans that no piece crosses."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(n + 1, bool)
        low, now = raw < 128, raw[1:]
        cut[1:n] = low[:-1] & low[1:] & self.apart[raw[:-1] & 127, now & 127]
        after = np.flatnonzero(~low[:-1] & (now == 32)) + 1  # a space behind another character, unless it is a written space mark
        cut[after] = ~((raw[after - 1] == 0x81) & (raw[np.maximum(after - 2, 0)] == 0x96))
        cut[at[:-1][at[:-1] < at[1:]]] = True
        cut[n] = True
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]

    def merge(self, segment: str) -> list[str]:
        """Pieces of a segment: the best-scored adjacent pair merges first, of equal ones the leftmost."""
        parts = list(segment)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.scores, []
        for i in range(n - 1):
            s = scores.get(parts[i] + parts[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not parts[i] or not parts[j] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue  # a part of it has merged meanwhile
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                s = scores.get(parts[i] + parts[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, len(parts[i]) + len(parts[k])))
            h = before[i]
            if h >= 0:
                s = scores.get(parts[h] + parts[i])
                if s is not None:
                    heapq.heappush(agenda, (-s, h, i, len(parts[h]) + len(parts[i])))
        return [p for p in parts if p]

    def span_ids(self, span: str) -> list[int]:
        out: list[int] = []
        for piece in self.merge(span) if len(span) > 1 else [span]:
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in piece.encode())
        return out

    def _encode(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [s.decode("utf-8", "surrogatepass") for s in spans]
        own = [self.span_ids(t.replace(" ", MARK)) for t in texts]
        self._check(texts, own)
        count = np.array([len(x) for x in own], np.int64)
        return np.array([i for x in own for i in x], np.uint32), count

    def _check(self, texts: list[str], own: list[list[int]]) -> None:
        """Raise an error where the library differs: it gets many spans as lines of one text, which nothing merges across."""
        shown = [k for k, t in enumerate(texts) if "\n" not in t]  # a line feed is a span of its own
        groups = [shown[i : i + TOGETHER] for i in range(0, len(shown), TOGETHER)]
        theirs = self.library.encode(["\n" + "\n".join([texts[k] for k in g]) for g in groups], num_threads=1)
        for group, found in zip(groups, theirs):
            want = [i for k in group for i in (self.line, *own[k])]
            if found[-len(want) :] != want:
                raise ValueError(f"the agenda differs from the library among {[texts[k] for k in group]!r}")

    def encode_batch(self, texts, ends: bool = False):
        """(first, last, ids, offsets) of slices of an Arrow array of texts (null: empty), with begin and end ids if asked for."""
        return encoded(texts, self, (self.begin,) if ends else (), (self.end,) if ends else ())


@lru_cache(1)
def encoder(model_path: str) -> PieceEncoder:
    return PieceEncoder(model_path)


def encode_pieces(docs: DataFrame, model_path: str, decode: bool = True, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array, null unless asked for), ids_sha256, decoded, decoded_sha256.

    Ids have begin and end ids around them.  A null or empty text gives these
    two only.  Texts are encoded whole, however long; repeated rows alike; an
    empty table gives an empty result.  The last two columns are null without
    `decode`; `decoded` is the text from the library's decode(ids).
    """

    def work(batches):
        import hashlib

        import pyarrow as pa

        enc = encoder(model_path)
        names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for first, last, tokens, at in enc.encode_batch(batch.column(1), ends=True):
                edges = list(zip(at[:-1].tolist(), at[1:].tolist()))
                texts = [enc.library.decode(tokens[a:b].tolist()) for a, b in edges] if decode else [None] * len(edges)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last],
                        pa.array(np.diff(at)),
                        lists if ids else pa.nulls(len(edges), lists.type),
                        pa.array([sha(tokens[a:b]) for a, b in edges], pa.string()),
                        pa.array(texts if ids else [None] * len(texts), pa.string()),
                        pa.array([None if t is None else sha(t.encode()) for t in texts], pa.string()),
                    ],
                    names,
                )
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
