"""Whole-text encoding with the tokenizers library, each distinct piece of text once.

Both vocabularies cut a text into pre-tokens that are merged on their own.  A
text is cut where a pre-token surely ends: before white space, and between
letters, digits and other signs.  Each distinct span is encoded by the library
once per worker (see spans.py); spans that are one pre-token go to its merge
step at once, many in a call, without its normaliser and pattern, which do
nothing to them but lower-case.  A vocabulary of any other build is not cut.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.shared import give_back
from noticeflow.llm.spans import SpanIds, encoded, gather

#: Spans of one pre-token each that the merge step gets in one text.
TOGETHER = 50
#: The patterns of pre-tokens that this module knows how to cut.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: One pre-token of either vocabulary: letters (ASCII, Latin-1) or signs that don't begin with an apostrophe, with a space before them or not.
PLAIN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)")
UNKNOWN, WHITE, LETTER, DIGIT, SIGN = range(5)


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[33:127] = SIGN
    for low, high, kind in ((9, 13, WHITE), (32, 32, WHITE), (48, 57, DIGIT), (65, 90, LETTER), (97, 122, LETTER)):
        table[low : high + 1] = kind
    return table


CLASSES = _classes()


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: in `folder`, in $TOKENIZER_DIR, or where public_tokenizers has it."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def classes_of(raw: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8: Latin-1 letters are letters, other characters beyond ASCII unknown."""
    found = CLASSES[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # the signs of multiplication and division
    found[lead] = found[lead + 1] = LETTER
    return found


def ends_white(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character beyond ASCII that ends before `at` may be white space (U+0085, U+00A0, U+1680, U+2000-U+207F, U+3000-U+303F)."""
    one, two = raw[at - 1], raw[np.maximum(at - 2, 0)]
    three = raw[np.maximum(at - 3, 0)]
    wide = ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    return wide | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))


class SegmentEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Split

        self.library = lib = Tokenizer.from_file(path)
        lib.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            built = json.load(file)
        steps = built["pre_tokenizer"].get("pretokenizers", []) if built["pre_tokenizer"] else []
        words = bool(steps) and steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("invert") and steps[0]["behavior"] == "Removed"
        known = words or built["pre_tokenizer"] == BYTE_LEVEL and built["normalizer"] is None
        self.known = known and built["model"]["type"] == "BPE" and not built["post_processor"]
        self.drops_space = self.lowers = words
        # the merge step alone: its texts are bytes as the vocabulary writes them, parted by line feeds
        self.merger = Tokenizer(lib.model)
        show = ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {c: show.pre_tokenize_str(chr(c))[0][0] for c in (10, *range(32, 127), *range(0xC0, 0x100))}
        self.merger.pre_tokenizer = Split(shown[10], "isolated")
        self.shown, self.line = shown, self.merger.encode(shown[10], add_special_tokens=False).ids
        self.known = self.known and len(self.line) == 1
        self.kept = SpanIds(self._encode)

    def prepared(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return raw, at

    def spans(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of spans that no pre-token crosses; white space alone is passed over where it has no ids."""
        n = len(raw)
        first = np.unique(at[:-1][at[:-1] < at[1:]])  # where texts start that aren't empty
        if not n or not self.known:
            return first, np.append(first[1:], n)[: len(first)]
        kind = classes_of(raw)
        before, now = kind[:-1], kind[1:]
        cut = np.zeros(n + 1, bool)
        sure = (before >= LETTER) & (now >= LETTER) & (raw[:-1] != 39)
        cut[1:n] = sure & ((before != now) | (now == DIGIT) if self.drops_space else before != now)
        blank = np.flatnonzero((now == WHITE) & (before != WHITE)) + 1
        wide = blank[raw[blank - 1] >= 0x80]
        cut[blank] = True
        cut[wide[ends_white(raw, wide)]] = False
        cut[first] = True
        cut[n] = True
        if not self.drops_space:
            edges = np.flatnonzero(cut)
            return edges[:-1], edges[1:]
        ink = np.concatenate([[False], kind != WHITE, [False]])
        opens, closes = ink[1:-1] & (~ink[:-2] | cut[:-1]), ink[1:-1] & (~ink[2:] | cut[1:])
        return np.flatnonzero(opens), np.flatnonzero(closes) + 1

    def _encode(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [s.decode("utf-8", "surrogatepass") for s in spans]
        plain = [k for k, t in enumerate(texts) if PLAIN.fullmatch(t)] if self.known else []
        count, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts = []
        if plain:
            joined = "\n".join([texts[k] for k in plain])
            words = (joined.lower() if self.lowers else joined).translate(self.shown).split(self.shown[10])
            many = [self.shown[10].join(words[i : i + TOGETHER]) + self.shown[10] for i in range(0, len(words), TOGETHER)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.merger.encode_batch_fast(many, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.line[0])
            begins = np.concatenate([[0], ends[:-1] + 1])
            if len(ends) != len(plain):
                raise ValueError("a line feed is not a token of its own in this vocabulary")
            start[plain], count[plain] = begins, ends - begins
            parts.append(ids)
        done = len(parts[0]) if parts else 0
        chosen = set(plain)
        rest = [k for k in range(len(texts)) if k not in chosen]
        for i in range(0, len(rest), 5000):
            some = rest[i : i + 5000]
            found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)]
            count[some] = n = np.array([len(x) for x in found])
            start[some] = done + np.cumsum(n) - n
            done += int(n.sum())
            parts += found
        return gather(np.concatenate([*parts, np.zeros(0, np.uint32)]), start, count), count

    def encode_batch(self, texts, tail: tuple[int, ...] = ()):
        """(first, last, ids, offsets) of slices of an Arrow array of texts (null: empty); the first text of each is held against the library."""
        for first, last, ids, at in encoded(texts, self, tail=tail):
            whole = self.library.encode(texts[first].as_py() or "", add_special_tokens=False).ids
            if whole != ids[: at[1] - len(tail)].tolist():
                raise ValueError("the spans' ids differ from the library's on a whole text")
            yield first, last, ids, at


@lru_cache(1)
def encoder(path: str) -> SegmentEncoder:
    return SegmentEncoder(path)


def encode_documents(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>, with the end id), n_tokens.

    Null and empty texts have the end id alone; repeated rows are encoded alike;
    an empty table gives an empty result; columns besides id and text are not read.
    """

    def work(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            for first, last, ids, at in enc.encode_batch(batch.column(1), (end_id,)):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], lists, pa.array(np.diff(at))], ["doc_id", "ids", "n_tokens"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, ids array<int>, n_tokens long")
